"""N-gram Jaccard join, size-aware heavy-light, with the classes of linked documents.

A document's set are its distinct 5-word shingles as 64-bit hashes; documents of equal sets are one node, named by
a 64-bit hash of the set; sets that share a name but not a second hash of 64 bits get names of their own. Two nodes link when ``den * intersection >= num * union``. Every link is found:

* light, both sets of at most ``boundary`` shingles: linked sets share a subset of the size their overlap needs; all
  such fixed-size subsets are enumerated and equal ones meet;
* heavy, the larger set above the boundary: inverted lists over each set's necessary prefix are scanned, tokens ordered
  by rarity, with size and index-probe bounds. Rarity comes from a counting sketch of bounded size over the shingles of
  all documents (a task counts equal sets once); its counters are exact sums of what falls on them. Any common order
  finds all links.

The boundary is the one of least cost: subsets to write against list entries to scan. Entries travel as packed blocks,
a bounded number each; lists of tokens that very many documents hold are dealt over blocks by node. What meets in a list
is joined as a chain, never as all pairs; the chains' components are then joined exactly, in groups of bounded size,
testing only nodes that no verified link connects yet. A component above that size is joined in blocks; where a prefix
token's list still has several classes, a short list is paired and a long one cut into blocks, every two of which meet in
a task of bounded size. The result does not depend on the sizes.

Defined cases: null, empty and wordless texts have the empty set, link with nothing and are their own component (by
doc_id); very long texts are read whole; repeated rows are rows of the result each; a null doc_id gets the class of its text, null if alone; no rows give
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import broadcast, chunks, connected_components, documents, slices, table, tidied, tidy, utf8

U = np.uint64
#: Shingles to a counter of the rarity sketch, up to 2**MOST counters in all (64 MB); counters of each row it travels in.
LOAD, MOST, PART = 8, 26, 1 << 14
#: Nodes of a list that are paired one by one.
SHORT = 32
#: Sets up to this size can be light.
MOST_LIGHT = 12
#: Entries of a block of lists; documents of a token above which its list is dealt over blocks; bytes of a group of sets.
BLOCK, HOT, GROUP = 500_000, 1 << 17, 30 << 20


def need(n: int, m: int, num: int, den: int) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-num * (n + m) // (num + den))


def probe(n, num: int, den: int):
    """Length of the prefix that meets every smaller or equal set."""
    return n + (-num * n // den) + 1


def index(n, num: int, den: int):
    """Length of the prefix that meets every larger or equal set."""
    return n + (-num * 2 * n // (num + den)) + 1


def overlaps(n: int, most: int, num: int, den: int) -> list[int]:
    """The overlaps that sets of up to ``most`` elements need with one of n."""
    return sorted({need(n, m, num, den) for m in range(-(-num * n // den), min(most, den * n // num) + 1)})


def names_of(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two hashes of a set; the first of so many bits."""
    with np.errstate(over="ignore"):
        x = np.array([wh.mix(s ^ U(c)).sum(dtype=U) + U(len(s)) for c in (0x5BD1E995A7C15F39, 0x3C79AC492BA7B653)], U)
    one, two = wh.mix(x)
    return int((one >> U(64 - bits)).astype(np.int64)), int(two.astype(np.int64))


def node_of(s: np.ndarray, clash: dict[int, int], bits: int = 64) -> int:
    """A set's name; ``clash`` has the second hash that keeps a name which several sets share."""
    one, two = names_of(s, bits)
    return two if clash and clash.get(one, two) != two else one


def to_bytes(s: np.ndarray) -> bytes:
    return s.tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, U)


def _sets(batch: pa.RecordBatch, at: int, k: int) -> Iterator[np.ndarray]:
    data, offs = utf8(batch.column(at))
    for i, j in chunks(offs):
        yield from wh.shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)


class Sketch:
    """A task's counters; what goes beyond a byte is held apart, so none saturates."""

    def __init__(self, size: int) -> None:
        self.count = np.zeros(size, np.uint8)
        self.more: dict[int, int] = {}
        self.new: list[np.ndarray] = []
        self.held = 0

    def add(self, tokens: np.ndarray) -> None:
        self.new.append(tokens)
        self.held += len(tokens)
        if self.held > 500_000:
            self.close()

    def close(self) -> None:
        if self.new:
            at, n = np.unique((np.concatenate(self.new) & U(len(self.count) - 1)).astype(np.int64), return_counts=True)
            total = self.count[at] + n
            self.count[at] = np.minimum(total, 255)
            for k in np.flatnonzero(total > 255).tolist():
                self.more[int(at[k])] = self.more.get(int(at[k]), 0) + int(total[k]) - 255
            self.new, self.held = [], 0

    def packed(self) -> pa.RecordBatch:
        """The parts that aren't empty."""
        self.close()
        rest: dict[int, list[tuple[int, int]]] = {}
        for at, n in self.more.items():
            rest.setdefault(at // PART, []).append((at % PART, n))
        parts, raw = [], []
        for p in range(len(self.count) // PART):
            own = self.count[p * PART : (p + 1) * PART]
            if own.any():
                parts.append(p)
                raw.append(encode(own, rest.get(p, [])))
        return pa.record_batch([pa.array(parts, pa.int32()), pa.array(raw, pa.binary())], names=["part", "counts"])


def encode(count: np.ndarray, rest: list[tuple[int, int]]) -> bytes:
    """Counters of a part as gaps between those above 0 and the counts above 1; as they are where that is shorter."""
    total = count.astype(np.int64)
    for at, n in rest:
        total[at] += n
    at = np.flatnonzero(total)
    gap = np.diff(at, prepend=-1) - 1
    far, many = np.flatnonzero(gap > 255), np.flatnonzero(total[at] > 1)
    if 2 * len(many) > PART:
        return b"\0" + zlib.compress(total.astype("<u4").tobytes(), 1)
    head = np.array([len(at), len(far), len(many)], "<u4").tobytes()
    more = (far.astype("<u2"), (gap[far] >> 8).astype("<u2"), many.astype("<u2"), total[at[many]].astype("<u4"))
    return b"\1" + zlib.compress(head + (gap & 255).astype(np.uint8).tobytes() + b"".join(x.tobytes() for x in more), 1)


def decode(raw: bytes) -> np.ndarray:
    kind, raw = raw[:1], zlib.decompress(raw[1:])
    if kind == b"\0":
        return np.frombuffer(raw, "<u4").astype(np.int64)
    n, far, many = np.frombuffer(raw, "<u4", 3).tolist()
    gap = np.frombuffer(raw, np.uint8, n, 12).astype(np.int64)
    a = 12 + n
    gap[np.frombuffer(raw, "<u2", far, a)] += np.frombuffer(raw, "<u2", far, a + 2 * far).astype(np.int64) << 8
    a += 4 * far
    each = np.ones(n, np.int64)
    each[np.frombuffer(raw, "<u2", many, a)] = np.frombuffer(raw, "<u4", many, a + 2 * many)
    out = np.zeros(PART, np.int64)
    out[np.cumsum(gap + 1) - 1] = each
    return out


def sketch_size(tokens: int) -> int:
    return 1 << min(MOST, max(16, (int(tokens) // LOAD).bit_length()))


def _level(t: pa.Table) -> pa.Table:
    total = np.zeros(PART, np.int64)
    for c in t.column("counts"):
        total += decode(c.as_py())
    level = np.floor(4 * np.log2(1 + total)).astype(np.uint8)
    return pa.table({"part": t.column("part")[:1], "level": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), "total": pa.array([int(total.sum())])})


class Rarity:
    """About how many sets hold a token: its counter over all tasks, in quarters of a power of two."""

    def __init__(self, level: np.ndarray, mean: float = 0.0) -> None:
        self.level, self.mean = level, mean

    def counts(self, x: np.ndarray) -> np.ndarray:
        return _COUNTS[self.level[(x & U(len(self.level) - 1)).astype(np.int64)]]

    def expected(self, x: np.ndarray) -> np.ndarray:
        """Without what other tokens put on a counter on average, so sums over many tokens are right."""
        return 1.09 * self.counts(x) - self.mean


_COUNTS = np.floor(np.exp2(np.arange(256) / 4))


def rarity(counted: DataFrame, size: int) -> Rarity:
    """The sum of the tasks' sketches."""
    level, total = np.zeros(size, np.uint8), 0
    for r in counted.groupBy("part").applyInArrow(_level, "part int, level binary, total long").collect():
        level[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(zlib.decompress(r["level"]), np.uint8)
        total += r["total"]
    return Rarity(level, total / size)


_NODES = "n long, node long, other long, small binary, part int, counts binary"


def _nodes(k: int, size: int, bits: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kind = Sketch(size), None
        seen: set[int] = set()
        names = ["doc_id", "n", "node", "other", "small", "part", "counts"]
        for batch in slices(batches):
            ids = batch.column(0)
            kind = ids.type
            ns, nodes, others, small = [], [], [], []
            for s in _sets(batch, 1, k):
                one, two = names_of(s, bits) if len(s) else (None, None)
                ns.append(len(s))
                nodes.append(one)
                others.append(two)
                small.append(s.tobytes() if len(s) <= MOST_LIGHT else None)
                if len(s) and two not in seen:
                    sketch.add(s)
                    if len(seen) < 200_000:
                        seen.add(two)
            m = len(ns)
            yield pa.record_batch([ids, pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(small, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if kind:
            own = sketch.packed()
            m = own.num_rows
            yield pa.record_batch([pa.nulls(m, kind), *(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.binary()), *own.columns], names=names)

    return run


def _ordered(s: np.ndarray, common: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set by rarity, then hash, and the counts."""
    n = common.counts(s)
    order = np.argsort(n, kind="stable")
    return s[order], n[order]


def subset_keys(s: np.ndarray, boundary: int, num: int, den: int) -> list[int]:
    """A hash for each fixed-size subset that a linked light set shares."""
    n, out = len(s), []
    x = wh.mix(s ^ U(0x2545F4914F6CDD1D))
    for t in overlaps(n, boundary, num, den):
        left = np.array(list(combinations(range(n), n - t)), np.int64).reshape(comb(n, t), n - t)
        with np.errstate(over="ignore"):
            out.append(wh.mix(x.sum(dtype=U) - x[left].sum(1, dtype=U) + U(t) * U(0x9E3779B97F4A7C15)))
    return out


def _lists(shared, k: int, num: int, den: int) -> callable:
    """Entries (key, node, n, flag) of lists as packed blocks. flag: 0 probe only, 1 index, 2 dealt over blocks."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, boundary, blocks, hot, clash, bits = shared.value
        keys, nodes, sizes, flags, held = [], [], [], [], 0
        seen: set[int] = set()

        def packed() -> pa.RecordBatch:
            key = np.concatenate(keys)
            reps = [len(x) for x in keys]
            node, n, flag = np.repeat(np.array(nodes, np.int64), reps), np.repeat(np.array(sizes, np.uint32), reps), np.concatenate(flags)
            dealt = np.flatnonzero(flag >= 2)
            deal = np.zeros(len(key), U)
            deal[dealt] = wh.mix(node[dealt].view(U)) % (U(1) + (common.counts(key[dealt]) / hot).astype(U))
            block = (wh.mix(key + deal * U(0xD6E8FEB86659FD93)) % U(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[order], prepend=-1))
            rows = [order[a:b] for a, b in zip(cut, [*cut[1:], len(order)], strict=True)]
            return pa.record_batch([pa.array(block[order][cut]), *(pa.array([x[r].tobytes() for r in rows], pa.binary()) for x in (key, node, n, flag))], names=["block", "key", "node", "n", "flag"])

        for batch in slices(batches):
            for s in _sets(batch, 0, k):
                if not len(s) or (node := node_of(s, clash, bits)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                n = len(s)
                own, flag = [], []
                if n <= boundary:
                    own += subset_keys(s, boundary, num, den)
                    flag += [np.ones(len(x), np.uint8) for x in own]
                if den * n > num * boundary:
                    t, count = _ordered(s, common)
                    p = probe(n, num, den)
                    f = (np.arange(p) < index(n, num, den)).astype(np.uint8)
                    f[count[:p] >= hot] = 2
                    own.append(t[:p])
                    flag.append(f)
                keys.append(np.concatenate(own))
                flags.append(np.concatenate(flag))
                nodes.append(node)
                sizes.append(n)
                held += len(keys[-1])
                if held > 300_000:
                    yield packed()
                    keys, nodes, sizes, flags, held = [], [], [], [], 0
        if held:
            yield packed()

    return run


_LISTS = "block long, key binary, node binary, n binary, flag binary"


def _unpack(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])


def _chains(num: int, den: int) -> callable:
    def run(t: pa.Table) -> pa.Table:
        key, node, n, flag = _unpack(t, "key", U), _unpack(t, "node", np.int64), _unpack(t, "n", np.uint32).astype(np.int64), _unpack(t, "flag", np.uint8)
        order = np.lexsort((node, n, key))
        key, node, n, flag = key[order], node[order], n[order], flag[order]
        if len(key):
            own = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node, n, flag = key[own], node[own], n[own], flag[own]
        at = np.arange(len(key))
        last = np.maximum.accumulate(np.where(flag >= 1, at, -1)) if len(at) else at
        prev = np.concatenate(([-1], last[:-1])) if len(at) else at
        ok = (prev >= 0) & (flag < 2)
        ok &= (key[prev] == key) & (den * n[prev] >= num * n)
        u, v = node[at[ok]], node[prev[ok]]
        dealt = flag >= 2
        u, v = np.concatenate([u, node[dealt]]), np.concatenate([v, wh.mix(key[dealt] ^ U(0xA0761D6478BD642F)).view(np.int64)])
        e = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        tidy()
        return pa.table({"u": e[:, 0].copy(), "v": e[:, 1].copy()})

    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def classes(sets: list[np.ndarray], num: int, den: int, known: list[int] | None = None) -> list[int]:
    """The exact classes of linked sets, as the place of one of them; a pair is tested unless links connect it already.

    ``known``: of each set one that is in its class for other reasons.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    root = list(known or range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if len(sets) <= 6:
        for b in range(1, len(order)):
            for a in range(b):
                i, j = order[a], order[b]
                if den * len(sets[i]) >= num * len(sets[j]) and find(i) != find(j) and linked(sets[i], sets[j], num, den):
                    root[find(j)] = find(i)
        return [find(i) for i in range(len(sets))]
    flat = np.concatenate(sets)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum([len(s) for s in sets])
    lists: dict[int, dict[int, list[int]]] = {}
    for j in order:
        n = len(sets[j])
        own = token[ends[j] - n : ends[j]]
        own = own[np.argsort(count[own], kind="stable")][: probe(n, num, den)].tolist()
        tested: set[int] = set()
        for x in own:
            for r, members in list(lists.get(x, {}).items()):
                if find(r) == find(j):
                    continue
                for i in reversed(members):
                    if i not in tested:
                        tested.add(i)
                        if den * len(sets[i]) >= num * n and linked(sets[i], sets[j], num, den):
                            root[find(i)] = find(j)
                            break
        for x in own[: index(n, num, den)]:
            lists.setdefault(x, {}).setdefault(find(j), []).append(j)
        for x in own:
            if len(lists.get(x, ())) > 1:
                joined: dict[int, list[int]] = {}
                for r, members in lists[x].items():
                    joined.setdefault(find(r), []).extend(members)
                lists[x] = joined
    return [find(i) for i in range(len(sets))]


def _exact(num: int, den: int) -> callable:
    """Of a group: (node, class) for nodes whose class is another node."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("component", "ascending"), ("node", "ascending")])
        comp, node, raw = t.column("component").to_numpy(), t.column("node").to_numpy(), t.column("set").combine_chunks()
        cut = [*np.flatnonzero(np.concatenate(([True], comp[1:] != comp[:-1]))), len(comp)] if len(comp) else [0]
        u, v = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < 2:
                continue
            own = classes([from_bytes(raw[i].as_py()) for i in range(a, b)], num, den)
            for i, r in enumerate(own):
                if r != i:
                    u.append(node[a + i])
                    v.append(node[a + r])
        tidy()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _bits(n_bits: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits, bool)
        for b in batches:
            bits[(wh.mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)) & U(n_bits - 1)).astype(np.int64)] = True
        raw = np.packbits(bits)
        parts = [p for p in range(0, len(raw), PART) if raw[p : p + PART].any()]
        yield pa.record_batch([pa.array([p // PART for p in parts], pa.int32()), pa.array([raw[p : p + PART].tobytes() for p in parts], pa.binary())], names=["part", "bits"])

    return run


def _or(t: pa.Table) -> pa.Table:
    return pa.table({"part": t.column("part")[:1], "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()]).tobytes()], pa.binary())})


def _wanted(shared, k: int) -> callable:
    """The sets of the documents whose id passes the filter; the join after it drops the few others."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, n_bits, clash, bits = shared.value
        for batch in slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = (wh.mix(ids.astype(np.int64).view(U)) & U(n_bits - 1)).astype(np.int64)
            own = np.flatnonzero((raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            if len(own):
                some = batch.take(pa.array(own))
                sets = list(_sets(some, 1, k))
                yield pa.record_batch([some.column(0), pa.array([node_of(s, clash, bits) if len(s) else None for s in sets], pa.int64()), pa.array([to_bytes(s) for s in sets], pa.binary())], names=["doc_id", "node", "set"])

    return run


def _prefixes(shared, num: int, den: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value[0]
        for batch in slices(batches):
            for node, cls, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "cls", "set")), strict=True):
                s = from_bytes(raw)
                p = probe(len(s), num, den)
                key = _ordered(s, common)[0][:p].view(np.int64)
                c = lambda x: pa.array(np.full(p, x), pa.int64())
                yield pa.record_batch([c(node), c(cls), c(len(s)), pa.array(key), pa.array(np.arange(p))], names=["node", "cls", "n", "key", "at"])

    return run


def _verified(num: int, den: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = [linked(from_bytes(x), from_bytes(y), num, den) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], names=["u", "v"])

    return run


def _joined(num: int, den: int) -> callable:
    """Of two blocks of a list: (class, class) of those that verified links join."""

    def run(t: pa.Table) -> pa.Table:
        cls = t.column("cls").to_pylist()
        place: dict[int, int] = {}
        known = [place.setdefault(c, i) for i, c in enumerate(cls)]
        own = classes([from_bytes(x.as_py()) for x in t.column("set")], num, den, known)
        e = sorted({(cls[i], cls[r]) for i, r in enumerate(own) if cls[i] != cls[r]})
        return pa.table({"u": pa.array([x[0] for x in e], pa.int64()), "v": pa.array([x[1] for x in e], pa.int64())})

    return run


def across(sets: DataFrame, links: DataFrame, shared, num: int, den: int, group_bytes: int, short: int = SHORT) -> DataFrame:
    """Verified links (u, v) between what ``links`` leaves in different classes of ``sets``: all that share a prefix token."""
    cls = connected_components(links, "u", "v")
    apart, _ = table(sets.select("node", "set").join(cls.select("node", F.col("component").alias("cls")), "node", "left").withColumn("cls", F.coalesce("cls", "node")), "apart")
    pre = apart.mapInArrow(_prefixes(shared, num, den), "node long, cls long, n long, key long, at long")
    pre, _ = table(pre, "prefixes")
    # lists that one class fills whole have nothing left to test
    several = pre.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("m"), F.sum("n").alias("size")).where("a <> b")
    several, _ = table(several.select("key", "m", F.ceil(F.col("size") * 16 / group_bytes).alias("blocks")), "several")
    few = pre.join(several.where(F.col("m") <= short).select("key"), "key")
    a, b = (few.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "cls", "n", "at")]) for x in "ab")
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    pairs = a.join(b, "key").where("cls_a < cls_b").where((den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")) & (most * (num + den) >= num * (F.col("n_a") + F.col("n_b"))))
    pairs = pairs.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct()
    own = apart.select("node", "set")
    pairs = pairs.join(own.withColumnRenamed("node", "u").withColumnRenamed("set", "x"), "u").join(own.withColumnRenamed("node", "v").withColumnRenamed("set", "y"), "v")
    found, _ = table(pairs.select("u", "v", "x", "y").mapInArrow(_verified(num, den), "u long, v long"), "found")
    # block i of a long list goes to the pairs (i, j) of blocks for all j
    i = F.pmod(F.xxhash64("node"), "blocks")
    many = pre.select("key", "node", "cls").join(several.where(F.col("m") > short).select("key", "blocks"), "key")
    many = many.select("key", "node", "cls", i.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    many = many.select("node", "cls", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("grp"))
    many = many.join(own, "node").groupBy("grp").applyInArrow(_joined(num, den), "u long, v long")
    return found.union(table(many, "joined")[0])


def choose_boundary(rows: list, num: int, den: int) -> int:
    """rows: (n, sets, list entries that their prefixes meet). Least of subsets written and entries scanned."""
    sets, meets = {r["n"]: r["c"] for r in rows}, {r["n"]: r["s"] for r in rows}
    light = lambda n, x: sum(comb(n, t) for t in overlaps(n, x, num, den))
    cost = lambda x: sum(sets[n] * light(n, x) for n in sets if n <= x) + sum(sets[n] * probe(n, num, den) + max(0.0, meets[n]) for n in sets if den * n > num * x)
    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _costs(shared, num: int, den: int) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        out: dict[int, list[float]] = {}
        for b in batches:
            for raw in b.column(0).to_pylist():
                s = np.frombuffer(raw, U)
                if len(s):
                    met = common.expected(_ordered(s, common)[0][: probe(len(s), num, den)])
                    own = out.setdefault(len(s), [0, 0.0])
                    own[0] += 1
                    own[1] += float(met.sum())
        yield pa.record_batch([pa.array(list(out), pa.int64()), pa.array([x[0] for x in out.values()], pa.int64()), pa.array([x[1] for x in out.values()], pa.float64())], names=["n", "c", "s"])

    return run


def near_classes(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, group_bytes: int = GROUP, hot: int = HOT, key_bits: int = 64) -> DataFrame:
    """Rows doc_id, n_shingles, component_id; one per row of docs."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # some six letters a word
    words = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 6
    size = sketch_size(words)
    both, _ = table(docs.mapInArrow(_nodes(k, size, key_bits), f"doc_id {id_type}, {_NODES}"), "sets")
    common = rarity(both.where("part is not null").select("part", "counts"), size)
    nodes = both.where("part is null").select("doc_id", "n", "node", "other")
    # names that different sets share: some 70 are expected among 5e10 sets
    clash = {r["node"]: r["lo"] for r in nodes.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("node", "lo").collect()}
    if clash:
        keeps = F.create_map(*[F.lit(x).cast("long") for pair in clash.items() for x in pair])[F.col("node")]
        nodes = nodes.withColumn("node", F.when(keeps != F.col("other"), F.col("other")).otherwise(F.col("node")))
    nodes = nodes.drop("other")
    costs = both.where("small is not null and part is null").select("small").mapInArrow(_costs(broadcast(spark, common), num, den), "n long, c long, s double").groupBy("n").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    boundary = choose_boundary(costs.collect(), num, den)
    entries = nodes.agg(F.coalesce(F.sum(F.col("n") * (den - num) / den + 1), F.lit(0)).alias("e")).first()["e"]
    blocks = max(24, int(entries // BLOCK) + 1)
    shared = broadcast(spark, (common, boundary, blocks, hot, clash, key_bits))
    lists = docs.select("text").mapInArrow(_lists(shared, k, num, den), _LISTS)
    # written, so that no task needs two Python workers at once
    edges, _ = table(lists.groupBy("block").applyInArrow(_chains(num, den), "u long, v long"), "edges")
    met = connected_components(edges, "u", "v")
    firsts = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    firsts, _ = table(firsts, "firsts")
    wanted, _ = table(firsts.where("rep is not null").join(met.select("node", "component"), "node"), "wanted")
    by_comp = wanted.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("nodes")).where("nodes > 1")
    total = by_comp.agg(F.count("*").alias("c"), F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("n")).first()
    groups = max(24, int(total["s"] * 64 // group_bytes) + 1)
    wanted = wanted.join(by_comp.select("component", "size"), "component")
    n_bits = 1 << min(28, max(17, int(total["n"] * 64).bit_length()))
    raw = np.zeros(n_bits // 8, np.uint8)
    for r in wanted.select("rep").mapInArrow(_bits(n_bits), "part int, bits binary").groupBy("part").applyInArrow(_or, "part int, bits binary").collect():
        raw[r["part"] * PART : r["part"] * PART + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    sets = docs.where("doc_id is not null").mapInArrow(_wanted(broadcast(spark, (raw, n_bits, clash, key_bits)), k), f"doc_id {id_type}, node long, set binary")
    share = F.ceil(F.col("size") * 8 / group_bytes)
    sets = sets.join(wanted.withColumnRenamed("rep", "doc_id"), ["doc_id", "node"])
    sets = sets.select("component", "node", "set", F.when(share <= 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("node"), share))).alias("grp"), (share > 1).alias("large"))
    large = total["c"] and by_comp.where(F.col("size") * 8 > group_bytes).limit(1).count() > 0
    if large:
        sets, _ = table(sets, "sets")
    links, _ = table(sets.groupBy("grp").applyInArrow(_exact(num, den), "u long, v long"), "links")
    if large:
        links = links.union(across(sets.where("large"), links, shared, num, den, group_bytes))
    final = connected_components(links, "u", "v")
    found = firsts.join(final, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("cls"))
    least = final.join(firsts, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = found.join(least.withColumnRenamed("component", "cls"), "cls", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    out = nodes.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: set size and the class of documents that links of 0.8 or more reach."""
    return near_classes(documents(spark, sf_dir))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}

ORACLE_SQL = {
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * c >= 80 * (na + nb - c)
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m.b, doc_id)) AS component_id FROM s LEFT JOIN m ON m.a = doc_id
"""
}
