"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are 10 consecutive words (an item of fewer words, not none, is one window). A window's tokens are its
shingles of up to 3 words, ordered by rarity over all documents. As containment needs every token, the rarest one is a
sufficient prefix: document positions are joined with it alone, then the length and positional bounds (the window must
lie inside the document around that position) and every word are verified.

Items are broadcast in blocks of a bounded number of words; more blocks are more passes over the documents.

Defined cases: null or wordless text has no words and no hits; very long texts are scanned whole; of tokens that are
equally rare a window takes the one of least hash; null or wordless items have no windows; repeated rows are
rows of the result each; items of the same text are counted each; null item_ids are ignored; no documents give no rows;
no items give no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash as wh
from .common import broadcast, chunks, documents, drop, slices, table, tidied, utf8

SHINGLE = 3
#: Words of all items in one block; bounds what is broadcast to some 300 bytes a word.
BLOCK_WORDS = 400_000


class Windows:
    """The distinct windows of a block of items."""

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        found: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.items: list[list[int]] = []
        self.ids = ids
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        h, _, bounds = wh.words(data, offsets, wh.ALNUM)
        for i in range(len(texts)):
            a, b = int(bounds[i]), int(bounds[i + 1])
            size = min(window, b - a)
            for s in range(a, b - size + 1) if size else ():
                w = h[s : s + size]
                k = found.setdefault(w.tobytes(), len(self.words))
                if k == len(self.words):
                    self.words.append(w)
                    self.items.append([])
                if not self.items[k] or self.items[k][-1] != i:
                    self.items[k].append(i)
        self.tokens = [wh.shingles(w, min(SHINGLE, len(w))) for w in self.words]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.words})
        self.known = np.unique(np.concatenate(self.tokens)) if self.tokens else np.zeros(0, np.uint64)

    def choose(self, count: np.ndarray) -> None:
        """Each window's prefix: its rarest token, of those the least hash. count: by ``known``."""
        prefix = []
        for w, tokens in enumerate(self.tokens):
            c = count[np.searchsorted(self.known, tokens)]
            at = min(range(len(tokens)), key=lambda j: (c[j], tokens[j]))
            prefix.append((tokens[at], w, at))
        prefix.sort(key=lambda x: x[0])
        self.token = np.array([x[0] for x in prefix], np.uint64)
        self.window = np.array([x[1] for x in prefix], np.int64)
        self.at = np.array([x[2] for x in prefix], np.int64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.first = np.unique(self.token)
        self.matrix = np.zeros((len(self.words), max(self.length, default=0)), np.uint64)
        for k, w in enumerate(self.words):
            self.matrix[k, : len(w)] = w


def member(known: np.ndarray, bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of x that are in the sorted ``known``; ``bits`` (of 2**20) passes few others."""
    near = np.flatnonzero(bits[x & np.uint64(len(bits) - 1)])
    if not len(near):
        return near
    at = np.minimum(np.searchsorted(known, x[near]), len(known) - 1)
    return near[known[at] == x[near]]


def bits_of(known: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[known & np.uint64((1 << 20) - 1)] = True
    return bits


def _rarity(block) -> callable:
    @tidied
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = block.value
        bits, total = bits_of(w.known), np.zeros(len(w.known), np.int64)
        for batch in slices(batches):
            data, offs = utf8(batch.column(0))
            for i, j in chunks(offs):
                h, _, bounds = wh.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], wh.ALNUM)
                for k in w.sizes:
                    s = wh.shingles(h, k)
                    total += np.bincount(np.searchsorted(w.known, s[member(w.known, bits, s)]), minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(total[k])], names=["k", "n"])

    return count


def _hits(w: Windows, bits: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> tuple[dict, dict]:
    """By row: hit spans in words from the row's first, and items."""
    got_s, got_w = [], []
    for k in w.sizes:
        s = wh.shingles(h, k)
        pos = member(w.first, bits, s)
        lo, hi = np.searchsorted(w.token, s[pos], "left"), np.searchsorted(w.token, s[pos], "right")
        n = hi - lo
        at = np.repeat(pos, n)
        e = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        win = w.window[e]
        start = at - w.at[e]
        row = np.searchsorted(bounds, at, "right") - 1
        ok = (start >= bounds[row]) & (start + w.length[win] <= bounds[row + 1])
        start, win = start[ok], win[ok]
        for size in np.unique(w.length[win]):
            own = np.flatnonzero(w.length[win] == size)
            own = own[(h[start[own][:, None] + np.arange(size)] == w.matrix[win[own], :size]).all(1)]
            got_s.append(start[own])
            got_w.append(win[own])
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    if got_s:
        start, win = np.concatenate(got_s), np.concatenate(got_w)
        order = np.argsort(start, kind="stable")
        rows = np.searchsorted(bounds, start[order], "right") - 1
        for r, s, x in zip(rows.tolist(), start[order].tolist(), win[order].tolist(), strict=True):
            s -= int(bounds[r])
            e = s + int(w.length[x])
            own = spans.setdefault(r, [])
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
            items.setdefault(r, set()).update(w.items[x])
    return spans, items


def _keep(block, at: int) -> callable:
    @tidied
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = block.value
        bits = bits_of(w.first)
        for batch in slices(batches):
            data, offs = utf8(batch.column(at))
            ok = np.ones(batch.num_rows, bool)
            for i, j in chunks(offs):
                h, _, bounds = wh.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], wh.ALNUM)
                ok[[i + r for r in _hits(w, bits, h, bounds)[0]]] = False
            yield batch.filter(pa.array(ok))

    return keep


_FOUND = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _scan(block, last: bool) -> callable:
    @tidied
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = block.value
        bits = bits_of(w.first)
        for batch in slices(batches):
            data, offs = utf8(batch.column(1))
            old_spans, old_items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n_words, spans, items = [], [], []
            for i, j in chunks(offs):
                h, _, bounds = wh.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], wh.ALNUM)
                n_words.append(np.diff(bounds))
                new, ids = _hits(w, bits, h, bounds)
                for r in range(j - i):
                    own = sorted([[x["start"], x["stop"]] for x in old_spans[i + r]] + new.get(r, []))
                    merged: list = []
                    for s, e in own:
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    spans.append([{"start": s, "stop": e} for s, e in merged])
                    items.append(old_items[i + r] + sorted({w.ids[x] for x in ids.get(r, ())}))
            out = [batch.column(0), *([] if last else [batch.column(1)]), pa.array(spans, pa.list_(_FOUND)), pa.array(items, pa.list_(pa.string())), pa.array(np.concatenate(n_words) if n_words else [], pa.int64())]
            yield pa.record_batch(out, names=["doc_id", *([] if last else ["text"]), "spans", "items", "n_words"])

    return scan


def _blocks(docs: DataFrame, items: DataFrame, window: int, block_words: int) -> Iterator[tuple[object, bool]]:
    """(broadcast windows of a block with their prefixes chosen, whether it is the last block)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null").distinct()
    sized = items.withColumn("n", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_words))
    for b in range(blocks):
        own = sized.where((F.col("n") > 0) & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).select("item_id", "text").orderBy("item_id", "text").collect()
        w = Windows([r["item_id"] for r in own], [r["text"] for r in own], window)
        count = np.zeros(len(w.known), np.int64)
        if len(w.known):
            for r in docs.select("text").mapInArrow(_rarity(broadcast(spark, w)), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
                count[r["k"]] = r["n"]
        w.choose(count)
        yield broadcast(spark, w), b == blocks - 1


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows doc_id, spans (hit words, from 0, stop exclusive), items (item_ids as text), n_words; one per row of docs."""
    rows = docs.select("doc_id", "text", F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    id_type = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    rest = [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())]
    written = None
    for block, last in _blocks(docs, items, window, block_words):
        schema = T.StructType([id_type, *([] if last else [T.StructField("text", T.StringType())]), *rest])
        rows = rows.select("doc_id", "text", "spans", "items").mapInArrow(_scan(block, last), schema)
        if not last:
            rows, path = table(rows, "decontam")
            if written:
                drop(docs.sparkSession, written)
            written = path
    return rows


def clean(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, whole, in which no window occurs; nothing is shuffled."""
    at, out = docs.columns.index("text"), docs
    for block, _ in _blocks(docs, items, window, block_words):
        out = out.mapInArrow(_keep(block, at), docs.schema)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: hit words and items per document."""
    found = find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


QUERIES = {"op4_decontaminate": op4_decontaminate}

ORACLE_SQL = {
    "op4_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM iw
), dw AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, item_id, dw.size AS size, p FROM dw JOIN iw USING (size, win)
), words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS x FROM hit) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
}
