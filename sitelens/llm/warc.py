"""WARC archives of Zstandard frames with a dictionary, written from pages and read back.

An archive is a skippable frame that holds the dictionary, then one frame per record. Archives of a bounded size are rows
of a table in the shared folder, so that Spark's committer makes a repeated task harmless and any store will do;
``export_archives`` puts them out as files. Of records with equal payloads the one with the largest page_id is the
response, others are revisits of it. The reader loads the dictionary, decodes frame by frame and validates the version
line, headers, lengths and digests; a damaged archive raises ValueError.

Defined cases: null html is an empty payload; a null url has no target line; a null page_id is never the response of
others; rows that repeat the largest page_id are all responses; repeated rows are records each; very long pages are records like
others; no rows give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast, slices, table, tidied

#: Magic number of the skippable frame that holds a dictionary.
MAGIC = 0x184D2A5D
#: How a compressed frame begins.
FRAME = b"\x28\xb5\x2f\xfd"
#: Bytes of each row that a bitmap travels in.
PART = 1 << 14
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id, url: str | None, payload: bytes | None, refers_to=None, size: int = 0, sha: str = "") -> bytes:
    """A response with its payload, or a revisit from the payload's size and SHA-1 alone."""
    if refers_to is None:
        size, mark = len(payload), digest(payload)
    else:
        payload, mark = b"", base64.b32encode(bytes.fromhex(sha)).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]._-"))
    lines += [f"WARC-Payload-Digest: sha1:{mark}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = 8192) -> bytes:
    """A dictionary from a bounded sample: trained where there is enough of it, else its bytes."""
    samples = [s[:4096] for s in samples[:64] if s]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)


def archive(records: list[bytes], raw: bytes) -> bytes:
    c = _compressor(raw)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *(c.compress(r) for r in records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    if len(data) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC or len(data) < 8 + size:
        raise ValueError("no dictionary frame")
    raw, view, at = bytes(data[8 : 8 + size]), memoryview(data), 8 + size
    if raw[:4] == FRAME:  # the format allows a compressed dictionary
        try:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        except zstandard.ZstdError as e:
            raise ValueError(f"the dictionary is damaged: {e}") from e
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    while at < len(data):
        out, o = [], d.decompressobj()
        try:
            while not o.eof:
                part = view[at : at + 65536]
                if not len(part):
                    raise ValueError("a frame is cut off")
                out.append(o.decompress(part))
                at += len(part) - len(o.unused_data)
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame is damaged: {e}") from e
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """page_id (text), payload_bytes, payload_digest, record_type, refers_to (text or None), payload, after validation."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    h: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in h:
            raise ValueError(f"bad or repeated header {line!r}")
        h[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "warc-block-digest", "content-length"):
        if name not in h:
            raise ValueError(f"{name} is missing")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the length differs from the header")
    block = rest[:n]
    if h["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block differs from its digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    kind = h["warc-type"]
    if not mark or size is None or kind not in ("response", "revisit"):
        raise ValueError("not a page's record")
    if kind == "response" and (len(payload) != size or h["warc-payload-digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in h or h.get("warc-profile") != PROFILE):
        raise ValueError("not a revisit of a response")
    uri = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    return {"page_id": uri(h["warc-record-id"]), "payload_bytes": size, "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "record_type": kind, "refers_to": uri(h["warc-refers-to"]) if kind == "revisit" else None, "payload": payload}


def _write(most: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, c, parts, held = None, None, [], 0
        for b in slices(batches, 256):
            ids, urls, html, refs, sizes, shas = (b.column(k).to_pylist() for k in range(6))
            payloads = [(x or "").encode() for x in html]
            if raw is None:
                raw = dictionary(payloads)
                c = _compressor(raw)
            for p, u, x, r, n, s in zip(ids, urls, payloads, refs, sizes, shas, strict=True):
                parts.append(c.compress(record(p, u, x, r, n, s)))
                held += len(parts[-1])
                if held >= most:
                    yield pa.record_batch([pa.array([b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *parts])], pa.binary()), pa.array([len(parts)], pa.int64())], names=["archive", "records"])
                    parts, held = [], 0
        if parts:
            yield pa.record_batch([pa.array([b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *parts])], pa.binary()), pa.array([len(parts)], pa.int64())], names=["archive", "records"])

    return run


def _marks(shared, columns: int) -> callable:
    """For mapInArrow over rows whose last column is a hash: those that pass the bitmap."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, n_bits = shared.value
        for b in slices(batches):
            at = _bit(b.column(columns).to_numpy(zero_copy_only=False), n_bits)
            hit = ((raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            yield pa.record_batch([*b.columns[:columns], pa.array(hit)], names=[*b.schema.names[:columns], "hit"])

    return run


def _bit(h: np.ndarray, n_bits: int) -> np.ndarray:
    return (h.astype(np.int64).view(np.uint64) & np.uint64(n_bits - 1)).astype(np.int64)


def _bits(n_bits: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits, bool)
        for b in batches:
            bits[_bit(b.column(0).to_numpy(zero_copy_only=False), n_bits)] = True
        raw = np.packbits(bits)
        parts = [p for p in range(0, len(raw), PART) if raw[p : p + PART].any()]
        yield pa.record_batch([pa.array([p // PART for p in parts], pa.int32()), pa.array([raw[p : p + PART].tobytes() for p in parts], pa.binary())], names=["part", "bits"])

    return run


def _or(t: pa.Table) -> pa.Table:
    return pa.table({"part": t.column("part")[:1], "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()]).tobytes()], pa.binary())})


def _bitmap(hashes: DataFrame, count: int):
    """A broadcast bitmap (at most 32 MB) of a column of hashes; it passes all of them and few others."""
    n_bits = 1 << min(28, max(17, int(count * 16).bit_length()))
    raw = np.zeros(n_bits // 8, np.uint8)
    for r in hashes.mapInArrow(_bits(n_bits), "part int, bits binary").groupBy("part").applyInArrow(_or, "part int, bits binary").collect():
        raw[r["part"] * PART : r["part"] * PART + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return broadcast(hashes.sparkSession, (raw, n_bits))


def write_archives(pages: DataFrame, revisit_from: int = 0, most: int = 1 << 20) -> DataFrame:
    """A table of archives (archive, records) in the shared folder; equal payloads of fewer bytes are all responses.

    Payloads stay where they are read. Who is a revisit is found on (page_id, SHA-1, size) alone, and its record needs no
    payload. A row whose digest surely doesn't repeat is written at once; of the others only those travel, by page_id, that
    a bitmap takes for responses.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    raw = F.coalesce("html", F.lit("")).cast("binary")
    sha, key = F.sha1(raw), F.xxhash64("page_id", "sha")
    light, _ = table(pages.select("page_id", "url", sha.alias("sha"), F.octet_length(raw).alias("size")), "digests")
    best = light.where(F.col("size") >= revisit_from).groupBy("sha").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select("sha", "best")
    best, _ = table(best, "repeated")
    # equal digests are many: the join's hot keys are light rows, which adaptive execution splits
    typed, _ = table(light.join(best, "sha").withColumn("again", F.coalesce(~F.col("page_id").eqNullSafe(F.col("best")) & F.col("best").isNotNull(), F.lit(False))), "typed")
    revisits = typed.where("again").select("page_id", "url", F.lit(None).cast("string").alias("html"), F.col("best").alias("refers_to"), "size", "sha")
    n = best.count()
    often = _bitmap(best.select(F.xxhash64("sha")), n)
    own = pages.select("page_id", "url", "html", sha.alias("sha"))
    own = own.select("*", F.xxhash64("sha").alias("h")).mapInArrow(_marks(often, 4), f"page_id {kind}, url string, html string, sha string, hit boolean")
    at_once = own.where("not hit")
    # rows that the bitmap passes by chance are responses too, so they are in the list
    there = light.select("page_id", "sha", F.xxhash64("sha").alias("h")).mapInArrow(_marks(often, 2), f"page_id {kind}, sha string, hit boolean").where("hit")
    there = there.join(best, "sha", "left").where(F.col("best").isNull() | F.col("page_id").eqNullSafe(F.col("best"))).select("page_id", "sha").distinct()
    there, _ = table(there, "responses")
    first = _bitmap(there.select(key), there.count())
    maybe = own.where("hit").select("page_id", "url", "html", "sha", key.alias("h")).mapInArrow(_marks(first, 4), f"page_id {kind}, url string, html string, sha string, hit boolean").where("hit")
    b = there.toDF("p2", "s2")
    maybe = maybe.join(b, (F.col("sha") == F.col("s2")) & F.col("page_id").eqNullSafe(F.col("p2")), "left_semi")
    full = lambda df: df.select("page_id", "url", "html", F.lit(None).cast(kind).alias("refers_to"), F.lit(0).alias("size"), "sha")
    p = full(at_once).unionByName(full(maybe)).unionByName(revisits)
    return table(p.mapInArrow(_write(most), "archive binary, records long"), "warc")[0]


@tidied
def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        rows = [parse(r) for r in read_archive(b.column(0)[0].as_py())]
        if len(rows) != b.column(1)[0].as_py():
            raise ValueError("the archive's count of records differs")
        c = lambda k, t: pa.array([x[k] for x in rows], t)
        yield pa.record_batch([c("page_id", pa.string()), c("payload_bytes", pa.int64()), c("payload_digest", pa.string()), c("record_type", pa.string()), c("refers_to", pa.string()), c("payload", pa.binary())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_archives(archives: DataFrame) -> DataFrame:
    """Records page_id, payload_bytes, payload_digest, record_type, refers_to, payload (empty for revisits)."""
    return archives.select("archive", "records").mapInArrow(_read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def export_archives(archives: DataFrame, folder: str) -> None:
    """Put each archive out as a file of ``folder`` (any address that pyarrow.fs knows), named by its place and content."""

    @tidied
    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches, 1)):
            data = b.column(0)[0].as_py()
            name = f"{path}/{part:05d}-{k:05d}-{hashlib.sha1(data).hexdigest()}.warc.zst"
            with store.open_output_stream(f"{name}.part") as f:
                f.write(data)
            store.move(f"{name}.part", name)
        yield pa.record_batch([pa.array([], pa.int64())], names=["n"])

    archives.select("archive").mapInArrow(put, "n long").count()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; a row per record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType.simpleString()
    r = read_archives(write_archives(pages))
    return r.select(F.expr(f"try_cast(page_id as {kind})").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr(f"try_cast(refers_to as {kind})").alias("refers_to"))


QUERIES = {"op9_warc": op9_warc}

#: Base 32 of the digest: each five hexadecimal digits are four letters.
ORACLE_SQL = {
    "op9_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS sha FROM p
), d AS (
  SELECT page_id, n, sha, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)
    FOR i IN range(32)], '') AS digest FROM h
), m AS (SELECT sha, max(page_id) AS best FROM h GROUP BY sha)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d JOIN m USING (sha)
"""
}
