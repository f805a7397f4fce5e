"""How far the sources of a language diverge in their terms, by exact integer probabilities.

Terms are counted per task before anything is shuffled, then meet by (lang, term): a posting is a term's count in a source.
A language keeps the terms of at least ``least`` documents. With N counts of V kept terms a term of count c has the
probability p(c) = 1 + floor(10^9 (c + 5) / (N + 5 V)) in parts of a billion.

Terms that stand out of a source: p depends on the count only, so a bucket of counts, with the least probability that the
language gives to one of its terms, bounds the divergence of all of them. Buckets are evaluated best first: those that
hold the first k terms, then every other whose bound is not strictly below the kth value found; no later one can matter.

Pairs of sources: their distance is V |p(0) - p'(0)| corrected by each source's own postings, by prefix sums over its
sorted probabilities, and by the terms both hold, from the terms' posting lists. A language's postings are dealt by term
over blocks and its sources by ``STRIP`` over strips, so no task holds a language; blocks are summed.

Defined cases: null text, lang and source are empty; texts without terms still make a group; repeated rows are documents
each; very long texts are counted whole; equal values rank by the bytes of the item; a language without kept terms has
pairs of value 0 and no terms, one with a single source has no pairs; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, documents, scratch, slices, table, tidied, utf8

#: Rows of counts that a task gathers before it sends them on.
GATHER = 400_000
#: Postings of a block at least, at most, and sources of a strip.
LEAST, MOST, STRIP = 8_000, 2_000_000, 256
#: Buckets of counts for each doubling.
FINE = 8

_INSIDE = np.zeros(256, bool)
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, letters A-Z folded, and the text in which each lies."""
    ok = _INSIDE[data]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = ok[heads]
    starts = np.flatnonzero(first)
    length = np.bincount(np.cumsum(first)[ok] - 1, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_FOLD[data[ok]])])
    return words, np.searchsorted(offsets, starts, "right") - 1


@tidied
def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, df): occurrences and documents."""

    def merged(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "df_sum"]).rename_columns(["lang", "source", "term", "n", "df"])

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for name in ("lang", "source", "term"):
            t = t.set_column(t.schema.get_field_index(name), name, t.column(name).cast(pa.string()))
        yield from t.to_batches(10_000)

    held, size = [], 0
    for batch in slices(batches):
        names = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"]).to_pylist()
        which: dict[tuple, int] = {}
        group = np.array([which.setdefault((x["lang"], x["source"]), len(which)) for x in names])
        langs, sources = (pa.array([x[k] for x in which], pa.large_string()) for k in (0, 1))
        data, offs = utf8(batch.column(2))
        for i, j in chunks(offs):
            words, doc = terms_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            if not len(words):
                continue
            d = words.dictionary_encode()
            size_d = len(d.dictionary)
            pair, n = np.unique(doc * size_d + d.indices.to_numpy(zero_copy_only=False), return_counts=True)
            own, at = np.unique(group[i + pair // size_d] * size_d + pair % size_d, return_inverse=True)
            total = np.zeros(len(own), np.int64)
            np.add.at(total, at, n)
            g = pa.array(own // size_d)
            held.append(pa.table([langs.take(g), sources.take(g), d.dictionary.take(pa.array(own % size_d)), total, np.bincount(at)], names=["lang", "source", "term", "n", "df"]))
            size += len(own)
        if size > GATHER:
            t = merged(held)
            if t.num_rows > GATHER // 2:
                yield from out(t)
                t = t.slice(0, 0)
            held, size = [t], t.num_rows
    if held:
        yield from out(merged(held))


def _p(n: str, total: str, kept: str) -> Column:
    """The probability of a count, by decimals: exact at any size; NULL without kept terms."""
    return 1 + F.expr(f"(cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(20,0))) div cast(nullif({total} + 5 * {kept}, 0) as decimal(20,0))")


def postings(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, source, term, n, lang_n): counts of the kept terms in the sources they occur in, and in the language."""
    d = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    c = d.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    c = c.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    c = c.withColumns({"lang_n": F.sum("n").over(of_term), "_df": F.sum("df").over(of_term)}).where(F.col("_df") >= least)
    return c.select("lang", "source", "term", "n", "lang_n")


def groups(docs: DataFrame, post: DataFrame) -> DataFrame:
    """(lang, source, idx, total, kept, lang_total, rows, p0) of every occurring group; idx counts a language's sources."""
    g = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = post.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_rows"))
    kept = post.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    g = g.join(own, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0)
    g = g.withColumns({"idx": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"), "rows": F.sum("own_rows").over(Window.partitionBy("lang"))})
    return g.select("lang", "source", "idx", "total", "kept", "lang_total", "rows", F.lit(0).cast("long").alias("_0")).withColumn("p0", _p("_0", "total", "kept")).drop("_0")


def top_terms(terms: DataFrame, k: int) -> DataFrame:
    """(lang, source, term, value), the k best of each group at most; terms: lang, source, term, n, p, q, bucket."""
    of = ["lang", "source"]
    by_bucket = terms.groupBy(*of, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("held")).where("bound > 0")
    best_first = Window.partitionBy(*of).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket, _ = table(by_bucket.withColumn("before", F.coalesce(F.sum("held").over(best_first), F.lit(0))), "buckets")

    def best(of_buckets: DataFrame) -> DataFrame:
        t = terms.join(of_buckets.select(*of, "bucket"), [*of, "bucket"]).withColumn("value", F.col("p") - F.col("q")).where("value > 0")
        rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("value"), "term"))
        return t.select(*of, "term", "value", rank.alias("r")).where(F.col("r") <= k).drop("r")

    first, _ = table(best(by_bucket.where(F.col("before") < k)), "first")
    kth = first.groupBy(*of).agg(F.when(F.count("*") >= k, F.min("value")).alias("kth"))
    rest = by_bucket.where(F.col("before") >= k).join(kth, of, "left").where("kth is null or bound >= kth")
    return first.unionByName(best(rest))


def _distances(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over one block of terms and one strip of sources: rows lang, i, j, value for i of the strip and j > i."""
    right = right.sort_by("idx")
    lang, blk, strip = right.column("lang")[0].as_py(), right.column("blk")[0].as_py(), right.column("strip")[0].as_py()
    p0 = right.column("p0").fill_null(0).to_numpy()
    kept, size = right.column("kept")[0].as_py(), right.num_rows
    left = left.select(["term", "idx", "p"]).combine_chunks()
    codes = left.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if left.num_rows else np.zeros(0, np.int64)
    idx, p = left.column("idx").to_numpy(), left.column("p").to_numpy()
    order = np.lexsort((idx, codes))
    codes, idx, p = codes[order], idx[order], p[order]
    stop = np.searchsorted(codes, codes, "right")
    by_source = np.argsort(idx, kind="stable")
    cuts = np.searchsorted(idx[by_source], np.arange(size + 1))

    def alone(i: int, others: np.ndarray) -> np.ndarray:
        """What source i's postings change against each of ``others``, as if it had none of their terms."""
        own = np.sort(p[by_source[cuts[i] : cuts[i + 1]]])
        below = np.searchsorted(own, p0[others])
        sums = np.concatenate(([0], np.cumsum(own)))
        gap = (2 * below - len(own)) * p0[others] - 2 * sums[below] + sums[-1]
        return gap - len(own) * np.abs(p0[i] - p0[others])

    sources = np.arange(size)
    out_i, out_j, out_v = [], [], []
    mine = range(strip * STRIP, min(size, (strip + 1) * STRIP))
    # each other source against the strip's, and the strip's against the others
    back = {j: alone(j, sources[strip * STRIP : min(j, (strip + 1) * STRIP)]) for j in range(strip * STRIP + 1, size)}
    for i in mine:
        later = sources[i + 1 :]
        if not len(later):
            continue
        value = alone(i, later) + (kept * np.abs(p0[i] - p0[later]) if blk == 0 else 0)
        value = value + np.array([back[j][i - strip * STRIP] for j in later])
        rows = by_source[cuts[i] : cuts[i + 1]]
        n = stop[rows] - rows - 1
        at = np.arange(int(n.sum())) + np.repeat(rows + 1 - (np.cumsum(n) - n), n)
        a, b, pi, pj = p0[i], p0[idx[at]], np.repeat(p[rows], n), p[at]
        both = np.abs(pi - pj) - np.abs(pi - b) - np.abs(a - pj) + np.abs(a - b)
        shared = np.zeros(size, np.int64)
        np.add.at(shared, idx[at], both)
        out_i.append(np.full(len(later), i))
        out_j.append(later)
        out_v.append(value + shared[i + 1 :])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    i = cat(out_i)
    return pa.table([pa.array([lang] * len(i), pa.string()), i, cat(out_j), cat(out_v)], names=["lang", "i", "j", "value"])


def pairs(terms: DataFrame, g: DataFrame) -> DataFrame:
    """(lang, i, j, value) for sources i < j of a language: their distance over all kept terms."""
    sources = Window.partitionBy("lang")
    many = F.count("*").over(sources)
    g = g.select("lang", "idx", "p0", "kept", F.greatest(F.lit(1), F.ceil(F.col("rows") / F.least(F.lit(MOST), F.greatest(F.lit(LEAST), many * many)))).cast("long").alias("blocks"), F.ceil(many / STRIP).cast("long").alias("strips"))
    dealt = g.groupBy("lang").agg(F.first("blocks").alias("blocks"), F.first("strips").alias("strips"))
    strips = F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)).alias("strip")
    left = terms.join(dealt, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("blk"), strips, "idx", "term", "p")
    right = g.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("blk")).select("lang", "blk", strips, "idx", "p0", "kept")
    key = ["lang", "blk", "strip"]
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_distances, "lang string, i long, j long, value long")
    return parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 30, k: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the k terms that stand out most."""
    with scratch(docs.sparkSession) as keep:
        post, _ = table(postings(docs, least), "postings")
        g, _ = table(groups(docs, post), "groups")
        of = g.select("lang", "source", "idx", "total", "kept", "lang_total")
        t = post.join(of, ["lang", "source"]).withColumns({"p": _p("n", "total", "kept"), "q": _p("lang_n", "lang_total", "kept"), "bucket": F.floor(F.log2("n") * FINE)})
        t, _ = table(t.select("lang", "source", "idx", "term", "n", "p", "q", "bucket"), "terms")
        top = top_terms(t, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
        both = pairs(t, g)
        both = both.select("lang", "value", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x"))
        name = lambda c, out: g.select("lang", F.col("idx").alias(c), F.col("source").alias(out))
        both = both.select("lang", "x.i", "x.j", "value").join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"])
        out = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(top)
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        out = out.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= k))
        out, path = table(out, "divergence")
        keep.append(path)
    return out


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distances to the other sources of its language, and the 50 terms that stand out of it most."""
    return audit(documents(spark, sf_dir))


QUERIES = {"op12_divergence": op12_divergence}

#: Every group's probability of every kept term is laid out.
ORACLE_SQL = {
    "op12_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM (SELECT r, lang, source, unnest(t) AS term FROM d) GROUP BY ALL
), k AS MATERIALIZED (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 30
), g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
t AS (
  SELECT lang, source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
}
