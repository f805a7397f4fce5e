import random

import numpy as np
import pyarrow as pa

from sitelens.llm import jaccard
from sitelens.llm.common import utf8


def brute(docs):
    sets = []
    for _, t in docs:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def near_copies(seed, n):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        base = [r.choice("abcdefghij") + r.choice("klmnop") for _ in range(r.choice([1, 3, 5, 7, 9, 12, 14, 16, 18, 25, 60, 200]))]
        for _ in range(r.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(r.randrange(3)):
                i = r.randrange(len(w))
                w[i : i + r.randrange(2)] = [r.choice(["x", "Y", "é"])]
            out.append(" ".join(w))
    return list(enumerate(out[:n]))


def test_against_brute_force(spark):
    docs = near_copies(1, 420) + [(1001, None), (1002, ""), (1003, " \t\n"), (1004, "One  two"), (1005, "one two"), (1006, "one"), (1006, "one"), (1007, "a b c d e a b c d e"), (1008, "a b c d e a b c d e a")]
    df = spark.createDataFrame([(*d, "q", 3) for d in docs], "doc_id long, text string, node string, n int")
    want = brute(docs)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_classes(df).collect())
    assert got == want
    assert sum(c != d for d, _, c in want) > 100
    assert jaccard.near_classes(df.limit(0)).collect() == []


def test_large_components_and_hot_tokens_give_the_same(spark):
    docs = near_copies(2, 250)
    base = [f"w{i}" for i in range(60)]
    r = random.Random(3)
    for k in range(150):
        w = list(base)
        for _ in range(1 + k % 5):
            w[r.randrange(60)] = f"z{r.randrange(9)}"
        docs.append((5000 + k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.near_classes(df, group_bytes=6000, hot=20).collect())
    assert got == brute(docs)


def test_light_and_heavy_meet_at_every_boundary():
    r = random.Random(5)
    for boundary in range(0, 13):
        for _ in range(60):
            n, m = r.randrange(1, 16), r.randrange(1, 16)
            pool = list(range(1, 40))
            a = r.sample(pool, n)
            both = r.randrange(min(n, m) + 1)
            b = (r.sample(a, both) + r.sample([x for x in range(100, 140)], 20))[:m]
            a, b = (np.sort(jaccard.wh.mix(np.array(sorted(set(x)), np.uint64))) for x in (a, b))
            if not jaccard.linked(a, b, 80, 100):
                continue
            n, m = sorted((len(a), len(b)))
            if m <= boundary:
                ka, kb = (set(np.concatenate(jaccard.subset_keys(x, boundary, 80, 100)).tolist()) for x in (a, b))
                assert ka & kb
            else:
                assert 100 * n > 80 * boundary and 100 * m > 80 * boundary


def test_names_that_sets_share_are_told_apart(spark):
    docs = near_copies(6, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.near_classes(df, key_bits=4).collect())
    assert got == brute(docs)


def test_counters_are_exact_sums(spark):
    size = 1 << 16
    rows = []
    for t in range(6):
        sketch = jaccard.Sketch(size)
        sketch.add(np.repeat(np.arange(1, 50, dtype=np.uint64), 40 * np.arange(1, 50)))
        rows += [tuple(x.values()) for x in sketch.packed().to_pylist()]
    common = jaccard.rarity(spark.createDataFrame(rows, "part int, counts binary"), size)
    want = 240 * np.arange(1, 50)
    got = common.counts(np.arange(1, 50, dtype=np.uint64))
    assert (got <= want + 1).all() and (got > 0.8 * want).all()
    assert common.counts(np.array([1000], np.uint64)).tolist() == [1]


def test_counters_travel_whole():
    r = np.random.default_rng(5)
    for share, high in ((0.0001, 3), (0.01, 3), (0.3, 300), (0.9, 70_000), (1.0, 2)):
        c = np.where(r.random(jaccard.PART) < share, r.integers(1, high, jaccard.PART), 0)
        rest = [(int(k), int(c[k]) - 255) for k in np.flatnonzero(c > 255)]
        assert (jaccard.decode(jaccard.encode(np.minimum(c, 255).astype(np.uint8), rest)) == c).all()


def test_hot_lists_are_dealt_at_the_real_limit():
    """A token in more sets than ``HOT`` goes to several blocks, by true counts summed over tasks that each hold few."""
    hot = jaccard.wh.shingle_sets(*utf8(pa.array(["one two three four five"])), 5)[0]
    texts = pa.array([f"one two three four five {k}" for k in range(900)])
    common = jaccard.Rarity(np.full(1 << 16, int(4 * np.log2(5.5 * jaccard.HOT)), np.uint8))

    class Shared:
        value = common, 0, 1000, jaccard.HOT, {}, 64

    out = list(jaccard._lists(Shared, 5, 80, 100)(iter([pa.record_batch([texts], names=["text"])])))
    blocks = set()
    for b in out:
        for at, key, flag in zip(*(b.column(c).to_pylist() for c in ("block", "key", "flag"))):
            own = np.frombuffer(key, np.uint64) == hot[0]
            if own.any():
                blocks.add(at)
                assert (np.frombuffer(flag, np.uint8)[own] == 2).all()
    assert len(blocks) in (5, 6)


def test_boundary_is_that_of_true_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = jaccard.sketch_size(df.selectExpr("sum(length(text)) as n").first()["n"] // 6)
    both = df.select("doc_id", "text").coalesce(2).mapInArrow(jaccard._nodes(5, size, 64), f"doc_id long, {jaccard._NODES}").persist()
    common = jaccard.rarity(both.where("part is not null").select("part", "counts"), size)
    texts = [x["text"] for x in df.select("text").collect()]
    sets = {s.tobytes(): s for s in jaccard.wh.shingle_sets(*utf8(pa.array(texts, pa.large_string())), 5) if len(s)}
    count = {}
    for s in sets.values():
        for x in s.tolist():
            count[x] = count.get(x, 0) + 1
    small = [s for s in (np.frombuffer(x["small"], np.uint64) for x in both.where("small is not null").select("small").collect()) if len(s)]
    both.unpersist()

    class True_:
        expected = counts = staticmethod(lambda x: np.array([count[i] for i in x.tolist()]))

    def boundary(rarity):
        rows = {}
        for s in small:
            own = rows.setdefault(len(s), {"n": len(s), "c": 0, "s": 0.0})
            own["c"] += 1
            own["s"] += rarity.expected(jaccard._ordered(s, rarity)[0][: jaccard.probe(len(s), 80, 100)]).sum()
        return jaccard.choose_boundary(list(rows.values()), 80, 100)

    assert abs(boundary(common) - boundary(True_)) <= 1


def test_very_long_text(spark):
    r = random.Random(9)
    long = " ".join(str(r.randrange(10**6)) for _ in range(200_000))
    docs = [(1, long), (2, long + " more words"), (3, long[: len(long) // 2]), (4, "short text"), (5, "short text")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1][0] > 199_000 and [got[d][1] for d in range(1, 6)] == [1, 1, 3, 4, 4]
