"""Fill-in-middle: seeded cuts of documents over an index of distinct texts.

Each task first gathers its copies of a text, so that one row carries the text and the ids of its documents. These rows
meet by the text's hash, are told apart by their content, and each distinct text gets its list of token boundaries once,
as an Elias-Fano list. The ids came along with the text, so the join back to the documents is local: each document looks
its two seeded cuts up in its text's list. A text with more than ``FEW`` copies in a task is dealt over the shuffle's
partitions, a list for each part, so no text's documents meet in one task. One shuffle carries each text once a task.

Defined cases: null and empty texts have no tokens and stay plain; a null doc_id is seeded by the prefix alone; repeated
rows are rows each, with the same cut; a text in which a mark occurs stays plain, as it couldn't be restored; equal cuts
give an empty middle; very long texts are cut whole; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, tidied

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are cut, and of those that are written suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Copies of a text in a task that go without a salt, and documents of a salted row.
FEW, CHUNK = 8, 64
#: Bytes of text that a task gathers at a time, and of a very long text that are looked at together.
GATHER, BLOCK = 16 << 20, 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


class EliasFano:
    """An increasing list of numbers up to ``top``: low bits in planes, high parts in unary, ones counted every 64 bytes."""

    def __init__(self, n: int, top: int, blocks: Iterable[np.ndarray]) -> None:
        self.n = n
        self.low = max(0, (top // max(1, n)).bit_length() - 1)
        high = np.zeros(n + (top >> self.low) + 1, bool)
        planes = np.zeros((self.low, n), bool)
        k = 0
        for v in blocks:
            high[(v >> self.low) + np.arange(k, k + len(v))] = True
            for b in range(self.low):
                planes[b, k : k + len(v)] = (v >> b) & 1
            k += len(v)
        self.planes = np.packbits(planes, axis=1, bitorder="little")
        self.high = np.packbits(high, bitorder="little")
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), 64)))))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        blk = int(np.searchsorted(self.ones, i, "right")) - 1
        bits = np.flatnonzero(np.unpackbits(self.high[blk * 64 : blk * 64 + 64], bitorder="little"))
        v = (blk * 512 + int(bits[i - self.ones[blk]]) - i) << self.low
        for b in range(self.low):
            v |= (int(self.planes[b, i >> 3]) >> (i & 7) & 1) << b
        return v


def _ends(raw: bytes) -> Iterator[np.ndarray]:
    """The bytes at which tokens end, in blocks: runs of ASCII letters, and every other code point alone."""
    data = np.frombuffer(raw, np.uint8)
    for a in range(0, len(data), BLOCK):
        x = data[a : a + BLOCK + 1]
        letter = _LETTER[x]
        # the next byte begins a token: it is no continuation, and no letter after a letter
        yield np.flatnonzero(((x[1:] & 0xC0) != 0x80) & ~(letter[1:] & letter[:-1])) + (a + 1)
    if raw:
        yield np.array([len(data)])


def boundaries(raw: bytes) -> EliasFano:
    """The ends of a text's tokens, in bytes of UTF-8."""
    return EliasFano(sum(map(len, _ends(raw))), len(raw), _ends(raw))


def chars(raw: bytes) -> int:
    return len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))


class Entry:
    """A distinct text with its boundaries."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.ends = raw, boundaries(raw)
        self.whole = not raw or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE))

    def cut(self, doc_id) -> tuple:
        """(n, form, prefix_chars, middle_chars, output) of a document."""
        n = self.ends.n
        h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        if self.whole or h3 % 100 >= CUT:
            return n, "plain", None, None, self.raw
        a, b = (self.ends[i - 1] if i else 0 for i in sorted((h1 % (n + 1), h2 % (n + 1))))
        before, between, after = self.raw[:a], self.raw[a:b], self.raw[b:]
        p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
        out = (s, after, p, before, m, between) if form == "spm" else (p, before, s, after, m, between)
        return n, form, chars(before), chars(between), b"".join(out)


def _gather(parts: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, dealt = TaskContext.get().partitionId(), 0

        def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal dealt
            t = pa.Table.from_batches(held).combine_chunks()
            d = pa.chunked_array([t.column(0).cast(pa.large_string())]).combine_chunks().dictionary_encode()
            codes = d.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            starts = np.searchsorted(codes[order], np.arange(len(d.dictionary) + 1))
            cuts, which, salt = [], [], []
            for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                step = b - a if b - a <= FEW else CHUNK
                for c in range(a, b, step):
                    cuts.append(c)
                    which.append(k)
                    dealt += b - a > FEW
                    salt.append(1 + (pid * 2_654_435_761 + dealt * 40_503) % parts if b - a > FEW else 0)
            ids = pa.ListArray.from_arrays(pa.array([*cuts, len(codes)], pa.int32()), t.column(1).combine_chunks().take(pa.array(order)))
            first = pa.array(order[starts[:-1]][which])
            out = pa.record_batch([t.column(2).combine_chunks().take(first), pa.array(salt, pa.int64()), d.dictionary.take(pa.array(which)), ids], names=["key", "salt", "text", "ids"])
            for a in range(0, out.num_rows, 1000):
                x = out.slice(a, 1000)
                yield x.set_column(2, "text", x.column(2).cast(pa.string()))

        held, size = [], 0
        for b in slices(batches):
            held.append(b)
            size += b.get_total_buffer_size() if b.num_rows < 1000 else b.nbytes
            if size > GATHER:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)

    return run


@tidied
def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, entries, own, size, kind = None, {}, [], 0, None

    def out() -> pa.RecordBatch:
        c = lambda k, t: pa.array([x[k] for x in own], t)
        return pa.record_batch([c(0, kind), c(1, pa.int64()), c(2, pa.string()), c(3, pa.int64()), c(4, pa.int64()), c(5, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    for batch in slices(batches, 200):
        kind = batch.column(3).type.value_type
        texts = batch.column(2).cast(pa.large_binary())
        for k, (key, salt, ids) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if at != (key, salt):
                at, entries = (key, salt), {}
            raw = texts[k].as_py()
            entry = entries.get(raw)  # equal bytes, not only equal hashes
            if entry is None:
                entry = entries[raw] = Entry(raw)
            for d in ids:
                own.append((d, *entry.cut(d)))
                size += len(raw) + 100
                if size > 4 << 20:
                    yield out()
                    own, size = [], 0
    if own:
        yield out()


def infill(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every document cut at its seeded places."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").withColumn("key", F.xxhash64("text"))
    d = d.mapInArrow(_gather(parts), f"key long, salt long, text string, ids array<{kind}>")
    d = d.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return d.mapInArrow(_cut, f"doc_id {kind}, {_FIELDS}")


def restore(cut: DataFrame) -> DataFrame:
    """``cut`` with ``restored``, the text rebuilt from form and output alone."""
    parts = F.split("output", "<[PSM]>", -1)
    three = lambda *k: F.concat(*[F.get(parts, F.lit(i)) for i in k])
    return cut.withColumn("restored", F.when(F.col("form") == "psm", three(1, 3, 2)).when(F.col("form") == "spm", three(2, 3, 1)).otherwise(F.col("output")))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cut, with digests of its output and of the text restored from it."""
    return restore(infill(documents(spark, sf_dir))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


QUERIES = {"op11_infill": op11_infill}

ORACLE_SQL = {
    "op11_infill": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t
  FROM documents
), n AS (
  SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, list_aggregate(t[1:least(x, y)], 'string_agg', '') AS p0, list_aggregate(t[least(x, y) + 1:greatest(x, y)], 'string_agg', '') AS m0,
    list_aggregate(t[greatest(x, y) + 1:], 'string_agg', '') AS s0
  FROM n
), o AS (
  SELECT *, coalesce(p0, '') AS p, coalesce(m0, '') AS m, coalesce(s0, '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""
}
