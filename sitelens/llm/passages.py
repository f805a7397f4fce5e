"""Passages that repeat across documents: paragraph MinHash banding, verified and clustered.

Two kinds of units are compared. Texts part into paragraphs at line ends and sentence ends (one of over ``LONG`` words
also after words whose hash says so), so a passage set into other text still has paragraphs of its own; neighbours of
under five words join, but for one in four by the hash of its last word. Each paragraph of five words or more is the
set of its 5-word shingles; its MinHash bands are tuned for recall at the threshold. Colliding paragraphs meet in packed
blocks of bounded size and are chained; components of chains are verified by exact Jaccard and clustered. Windows are 20
words wherever they start: those whose hash is the least of 11 in a row, so which ones are taken inside a span depends
on its words only, not on the text or sentence around it. Equal windows are one cluster.

A cluster that spans documents marks its units as repeats; neighbouring repeats join to runs, and runs of ``min_words``
covered words or more are the result. The lowest doc_id of a cluster keeps its units; those elsewhere are to be removed.
A run of both is told apart into parts; if no part has ``min_words``, the whole run is one row and is kept.

Recall: equal paragraphs always meet; others of similarity 0.8 with the banding's chance (0.98 or more as tuned). Of a
span of 30 words or more that is equal in two documents, windows cover all but 10 words at each end or fewer, hence 31
of 51 words, which is a run.

Defined cases: null, empty and short texts have no paragraphs; very long texts are read whole; repeated rows of one doc_id
and text count once, and of one doc_id with several texts each has rows of its own (what repeats only among them is no
repeat across documents); of equal candidates the lowest doc_id keeps, ties of place go by class; documents with a null
doc_id take no part; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import broadcast, chunks, connected_components, documents, slices, table, tidied, tidy, utf8
from .jaccard import _LISTS, GROUP, PART, Sketch, _bits, _chains, _exact, _or, _verified, across, from_bytes, rarity, sketch_size, to_bytes

U = np.uint64
K, LONG, BLOCK = 5, 40, 500_000
#: Windows of so many words, a multiple of K; one of so many in a row is taken.
WINDOW, ROW = 20, 11
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def tune(threshold: float, recall: float = 0.98, most: int = 64) -> tuple[int, int]:
    """(bands, rows): at least this recall at the threshold, then fewest chance meetings at 0.3, within 4 bands if it can be."""
    fits = [(b, r) for r in range(1, 9) for b in range(1, most // r + 1) if 1 - (1 - threshold**r) ** b >= recall]
    return min(fits, key=lambda x: (max(x[0], 4), 1 - (1 - 0.3 ** x[1]) ** x[0]))


class Units:
    """Paragraphs of some texts: sentences of five words or more, and shorter ones joined to as many."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        h, starts, bounds = wh.words(data, offsets, wh.SPACED)
        n = len(h)
        last = np.zeros(n, bool)
        if n:
            ok = wh.SPACED[data]
            nxt = np.concatenate([starts[1:], [len(data)]])
            space = np.concatenate(([0], np.cumsum(~ok)))
            end = nxt - (space[nxt] - space[starts]) - 1  # separators all follow the word
            lines = np.concatenate(([0], np.cumsum(data == 10)))
            last = _STOP[data[end]] | (lines[nxt] > lines[starts])
            ends_text = bounds[1:][bounds[1:] > bounds[:-1]] - 1
            last[ends_text] = True
            first = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
            size = np.diff(np.append(first, n))
            last |= np.repeat(size > LONG, size) & ((h & U(15)) == 0)
            # short ones next to each other join, but for every fourth by its last word
            at = np.flatnonzero(last)
            short = np.diff(at, prepend=-1) < K
            join = short & np.append(short[1:], False) & ((h[at] >> U(4)) & U(3) != 0)
            last[at[join]] = False
            last[ends_text] = True
        stop = np.flatnonzero(last) + 1
        first = np.concatenate(([0], stop[:-1])).astype(np.int64) if len(stop) else np.zeros(0, np.int64)
        own = stop - first >= K
        self.first, self.stop = first[own], stop[own]
        self.text = np.searchsorted(bounds, self.first, "right") - 1
        self.at = self.first - bounds[self.text]
        s = wh.shingles(h, K)
        count = self.stop - self.first - K + 1
        self.cut = np.cumsum(count) - count
        self.shingle = s[np.repeat(self.first - self.cut, count) + np.arange(count.sum())] if len(count) else np.zeros(0, U)
        if len(count):
            with np.errstate(over="ignore"):
                total = np.add.reduceat(wh.mix(self.shingle ^ U(0x1F83D9ABFB41BD6B)), self.cut)
                self.node = wh.mix(total + count.astype(U)).view(np.int64)
        else:
            self.node = np.zeros(0, np.int64)
        self.all = s, bounds

    def windows(self) -> Windows:
        return Windows(*self.all)

    def bands(self, b: int, r: int) -> np.ndarray:
        out = np.zeros((len(self.node), b), U)
        for k in range(b * r):
            low = np.minimum.reduceat(wh.mix(self.shingle ^ U(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), self.cut)
            out[:, k // r] = wh.mix(out[:, k // r] * U(0xD6E8FEB86659FD93) + low + U(k))
        return out

    def set(self, i: int) -> np.ndarray:
        end = self.cut[i + 1] if i + 1 < len(self.cut) else len(self.shingle)
        return np.unique(self.shingle[self.cut[i] : end])


def _slide(x: np.ndarray, of: np.ufunc) -> np.ndarray:
    """The least or greatest of each ROW numbers in a row."""
    n, size = len(x) - ROW + 1, 1
    while 2 * size <= ROW:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[:n], x[ROW - size : ROW - size + n])


class Windows:
    """The windows of some texts whose hash is the least of some ROW windows in a row."""

    def __init__(self, s: np.ndarray, bounds: np.ndarray) -> None:
        m = int(bounds[-1]) - WINDOW + 1
        at, g = np.zeros(0, np.int64), np.zeros(0, U)
        if m >= ROW:
            g = wh.mix(sum(s[j : j + m] * wh._STEP[j] for j in range(0, WINDOW, K))) | U(1)
            room = np.repeat(bounds[1:], np.diff(bounds))[:m] - np.arange(m)
            low = _slide(g, np.minimum)
            low[room[: len(low)] < WINDOW + ROW - 1] = 0  # these would reach into the next text
            at = np.flatnonzero(_slide(np.pad(low, ROW - 1), np.maximum) == g)
            g = g[at]
        self.node = wh.mix(g ^ U(0x3C6EF372FE94F82B)).view(np.int64)
        self.text = np.searchsorted(bounds, at, "right") - 1
        self.at = at - bounds[self.text]


def _units(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, Units]]:
    data, offs = utf8(batch.column(at))
    for i, j in chunks(offs):
        yield i, Units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _lists(b: int, r: int, blocks: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0

        def packed() -> pa.RecordBatch:
            node, own = np.unique(np.concatenate(nodes), return_index=True)
            key = np.concatenate(keys)[own].ravel()
            node = np.repeat(node, b)
            block = (wh.mix(key) % U(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[order], prepend=-1))
            rows = [order[x:y] for x, y in zip(cut, [*cut[1:], len(order)], strict=True)]
            one = lambda k: pa.array([np.ones(len(x), k).tobytes() for x in rows], pa.binary())
            return pa.record_batch([pa.array(block[order][cut]), pa.array([key[x].tobytes() for x in rows], pa.binary()), pa.array([node[x].tobytes() for x in rows], pa.binary()), one(np.uint32), one(np.uint8)], names=["block", "key", "node", "n", "flag"])

        for batch in slices(batches):
            for _, u in _units(batch, 0):
                if len(u.node):
                    keys.append(u.bands(b, r))
                    nodes.append(u.node)
                    held += len(u.node)
                if held > 150_000:
                    yield packed()
                    keys, nodes, held = [], [], 0
        if held:
            yield packed()

    return run


@tidied
def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least and greatest doc_id, whether a window) of the nodes in each part of a task."""
    for batch in slices(batches, 4000):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        nodes, docs, kinds = [np.zeros(0, np.int64)], [np.zeros(0, ids.dtype)], [np.zeros(0, bool)]
        for i, u in _units(batch, 1):
            for own, window in ((u, False), (u.windows(), True)):
                nodes.append(own.node)
                docs.append(ids[i + own.text])
                kinds.append(np.full(len(own.node), window))
        node, doc, kind = np.concatenate(nodes), np.concatenate(docs), np.concatenate(kinds)
        order = np.lexsort((doc, node))
        node, doc, kind = node[order], doc[order], kind[order]
        cut = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
        ends = np.concatenate([cut[1:], [len(node)]]) - 1 if len(cut) else cut
        yield pa.record_batch([pa.array(node[cut]), pa.array(doc[cut]), pa.array(doc[ends]), pa.array(kind[cut])], names=["node", "lo", "hi", "window"])


def _pass(shared, node: np.ndarray) -> np.ndarray:
    raw, n_bits = shared.value
    at = (wh.mix(node.view(U)) & U(n_bits - 1)).astype(np.int64)
    return np.flatnonzero((raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)


def _sets_of(shared) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            nodes, sets = [], []
            for _, u in _units(batch, 0):
                for i in _pass(shared, u.node).tolist():
                    n = int(u.node[i])
                    if n not in seen:
                        if len(seen) < 500_000:
                            seen.add(n)
                        nodes.append(n)
                        sets.append(to_bytes(u.set(i)))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def _places(shared) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, which = batch.column(0), batch.column(2)
            for i, u in _units(batch, 1):
                for x, size in ((u, u.stop - u.first), (w := u.windows(), np.full(len(w.node), WINDOW))):
                    own = _pass(shared, x.node)
                    rows = pa.array(i + x.text[own])
                    yield pa.record_batch([ids.take(rows), which.take(rows), pa.array(x.at[own]), pa.array((x.at + size)[own]), pa.array(x.node[own])], names=["doc_id", "which", "start", "stop", "node"])

    return run


def _filter(nodes: DataFrame, column: str, count: int):
    """A broadcast bitmap of at most 32 MB that passes these nodes and few others."""
    n_bits = 1 << min(28, max(17, int(count * 64).bit_length()))
    raw = np.zeros(n_bits // 8, np.uint8)
    for r in nodes.select(column).mapInArrow(_bits(n_bits), "part int, bits binary").groupBy("part").applyInArrow(_or, "part int, bits binary").collect():
        at = r["part"] * PART
        raw[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return broadcast(nodes.sparkSession, (raw, n_bits))


def _rare(size: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(size)
        for b in slices(batches):
            for x in b.column(0):
                sketch.add(from_bytes(x.as_py()))
        yield sketch.packed()

    return run


def _runs(units: DataFrame, keys: list[str], name: str, gap: int) -> DataFrame:
    """The units with the number of their run, at most ``gap`` words apart, and the words that no unit before covers."""
    w = Window.partitionBy(*keys).orderBy("start", "stop", "class_id")
    units = units.withColumn("before", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    units = units.withColumn("new", F.when(F.col("start") - F.col("before") <= gap, 0).otherwise(1))
    units = units.withColumns({name: F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "own": F.col("stop") - F.least("stop", F.greatest("start", "before"))})
    return units.drop("before", "new")


def repeated_runs(docs: DataFrame, num: int = 80, den: int = 100, min_words: int = 30, gap: int = 12, group_bytes: int = GROUP) -> DataFrame:
    """Rows doc_id, start, stop (words), n_words (covered), class_id, kept_by (doc_id), removed; one per run of repeats."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    b, r = tune(num / den)
    counts = docs.mapInArrow(_counts, f"node long, lo {kind}, hi {kind}, window boolean").groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("window").alias("window"))
    counts, _ = table(counts.where("not window or lo <> hi"), "units")
    n = counts.where("not window").count()
    lists = docs.select("text").mapInArrow(_lists(b, r, max(24, n * b // BLOCK + 1)), _LISTS)
    edges, _ = table(lists.groupBy("block").applyInArrow(_chains(1, 1), "u long, v long").distinct(), "edges")
    met, _ = table(connected_components(edges, "u", "v"), "met")
    size = met.groupBy("component").agg(F.count("*").alias("nodes"))
    met = met.join(size, "component")
    sets = docs.select("text").mapInArrow(_sets_of(_filter(met, "node", met.count())), "node long, set binary").join(met, "node")
    # every task that holds a paragraph has sent its set: one stays
    sets, _ = table(sets.dropDuplicates(["node"]), "sets")
    total = sets.agg(F.coalesce(F.sum(F.length("set")), F.lit(0)).alias("s"), F.coalesce(F.avg(F.length("set")), F.lit(64.0)).alias("m")).first()
    most = max(2, int(group_bytes // max(total["m"], 6)))
    share = F.ceil(F.col("nodes") / most)
    groups = max(24, int(total["s"] * 3 // group_bytes) + 1)
    grp = F.when(share <= 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("node"), share)))
    links, _ = table(sets.select("component", "node", "set", grp.alias("grp")).groupBy("grp").applyInArrow(_exact(num, den), "u long, v long"), "links")
    large = sets.where(share > 1).select("component", "node", "set")
    if size.where(F.col("nodes") > most).limit(1).count():
        # first the edges, then whatever is still apart
        large, _ = table(large, "large")
        x, y = (large.select(F.col("node").alias(n), F.col("set").alias(c)) for n, c in (("u", "x"), ("v", "y")))
        pairs = edges.join(x, "u").join(y, "v").select("u", "v", "x", "y")
        links, _ = table(links.union(pairs.mapInArrow(_verified(num, den), "u long, v long")), "links")
        size = sketch_size(total["s"] // 8)
        common = rarity(large.select("set").mapInArrow(_rare(size), "part int, counts binary"), size)
        links = links.union(across(large, links, broadcast(docs.sparkSession, (common,)), num, den, group_bytes))
    cls = connected_components(links, "u", "v")
    near = counts.join(cls, "node")
    near_cls = near.groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    rep = near.select("node", "component").join(near_cls, "component").select("node", F.col("component").alias("class_id"), F.col("lo").alias("kept_by"))
    same = counts.where("lo <> hi").join(cls, "node", "left_anti").select("node", F.col("node").alias("class_id"), F.col("lo").alias("kept_by"))
    rep, _ = table(rep.union(same), "repeats")
    which = docs.withColumn("which", F.xxhash64("text"))
    places = which.mapInArrow(_places(_filter(rep, "node", rep.count())), f"doc_id {kind}, which long, start long, stop long, node long").join(rep, "node").select("doc_id", "which", "start", "stop", "class_id", "kept_by").distinct()
    runs = _runs(places.withColumn("removed", F.col("kept_by") != F.col("doc_id")), ["doc_id", "which"], "run", gap)
    # words of units that are kept elsewhere go, also where units that are kept here reach over them
    w = Window.partitionBy("doc_id", "which").orderBy("start", "stop", "class_id")
    end = F.max(F.when(F.col("removed"), F.col("stop"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begin = F.min(F.when(F.col("removed"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    runs = runs.withColumns({"end": end, "begin": begin})
    runs = runs.withColumns({"start": F.when(F.col("removed"), F.col("start")).otherwise(F.greatest("start", "end")), "stop": F.when(F.col("removed"), F.col("stop")).otherwise(F.least("stop", "begin"))}).where("start < stop")
    parts = _runs(runs.drop("own"), ["doc_id", "which", "run", "removed"], "part", gap)
    one = lambda of: [F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum(of).alias("n_words"), F.min("class_id").alias("class_id"), F.min("kept_by").alias("kept_by")]
    parts = parts.groupBy("doc_id", "which", "run", "removed", "part").agg(*one("own"))
    parts = parts.withColumn("most", F.max("n_words").over(Window.partitionBy("doc_id", "which", "run")))
    whole = F.col("most") < min_words
    parts = parts.withColumns({"part": F.when(whole, -1).otherwise(F.col("part")), "side": ~whole & F.col("removed")})
    out = parts.groupBy("doc_id", "which", "run", "side", "part").agg(*one("n_words"), F.min("removed").alias("removed"))
    tidy()
    return out.where(F.col("n_words") >= min_words).select("doc_id", "start", "stop", "n_words", "class_id", "kept_by", "removed")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of words that repeat across documents."""
    return repeated_runs(documents(spark, sf_dir))


QUERIES = {"op10_passages": op10_passages}
ORACLE_SQL: dict[str, str] = {}
