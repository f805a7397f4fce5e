import random
import re
from collections import Counter

from sitelens.llm import divergence


def brute(rows, least, k):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= least]
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: prob(c) for s, c in count.items()}, prob(sum(count.values(), Counter()))
        for s in count:
            pair = sorted(((o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in count if o != s), key=lambda x: (-x[1], x[0].encode()))
            term = sorted(((t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:k]
            out += [(lang, s, part, i, v, r + 1) for part, x in (("pair", pair), ("term", term)) for r, (i, v) in enumerate(x)]
    return sorted(out)


def rows_of(seed, n):
    r = random.Random(seed)
    words = [f"{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'é' * (k % 3)}{'xyz'[k % 3]}{'k' * (k // 26)}" for k in range(120)] + ["Über", "ÉA", "the", "The", "THE", "a1b", "x_y"]
    rows = []
    for _ in range(n):
        s = r.randrange(9)
        text = " ".join(r.choice(words[s * 3 :] if r.random() < 0.7 else words) for _ in range(r.randrange(40)))
        rows.append((r.choice(["en", "en", "de", None, "x"]), f"s{s}" if s else None, text))
    rows += [("en", "empty", None), ("en", "empty", ""), ("solo", "only", "the the"), ("zero", "a", "rare"), ("zero", "b", "1234 ...")]
    return rows + [("en", "long", "the Über word " * 30_000)] + rows[:20]


def test_against_brute_force(spark, monkeypatch):
    rows = rows_of(4, 500)
    df = spark.createDataFrame([(*x, 1, "q") for x in rows], "lang string, source string, text string, n int, term string").repartition(5)
    got = lambda **a: sorted(tuple(r) for r in divergence.audit(df, **a).collect())
    assert got() == brute(rows, 30, 50)
    assert got(least=3, k=4) == brute(rows, 3, 4)
    # small gathers, blocks and strips give the same rows
    monkeypatch.setattr(divergence, "LEAST", 150)
    monkeypatch.setattr(divergence, "MOST", 150)
    assert got(least=3, k=4) == brute(rows, 3, 4)
    assert divergence.audit(df.limit(0)).collect() == []


def test_strips(monkeypatch):
    """A strip of sources and a block of terms at a time give the sums of the whole."""
    rows = [("en", s, t) for _, s, t in rows_of(8, 200) if s]
    docs = sorted({s for _, s, _ in rows})
    want = {(i, j): v for _, i, part, j, v, _ in brute(rows, 3, 5) if part == "pair"}
    words = {s: Counter() for s in docs}
    for _, s, t in rows:
        words[s].update(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    df = Counter(t for _, _, x in rows for t in set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))))
    kept = sorted(t for t in df if df[t] >= 3)
    prob = lambda s, t: 1 + 10**9 * (words[s][t] + 5) // (sum(words[s][x] for x in kept) + 5 * len(kept))
    monkeypatch.setattr(divergence, "STRIP", 4)
    got = Counter()
    for blk in range(3):
        post = [(t, k, prob(s, t)) for k, s in enumerate(docs) for n, t in enumerate(kept) if n % 3 == blk and words[s][t]]
        left = divergence.pa.table({"term": [x[0] for x in post], "idx": [x[1] for x in post], "p": [x[2] for x in post]})
        for strip in range((len(docs) + 3) // 4):
            right = divergence.pa.table({"lang": ["en"] * len(docs), "blk": [blk] * len(docs), "strip": [strip] * len(docs), "idx": range(len(docs)), "p0": [1 + 5 * 10**9 // (sum(words[s][x] for x in kept) + 5 * len(kept)) for s in docs], "kept": [len(kept)] * len(docs)})
            for r in divergence._distances(left, right).to_pylist():
                got[docs[r["i"]], docs[r["j"]]] += r["value"]
    assert got == {k: v for k, v in want.items() if k[0] < k[1]}


def test_bounds_stop_the_search(spark):
    """Buckets that can't hold one of the k best are never joined with their terms, and the rows are the same."""
    r = random.Random(2)
    rows = [("en", f"s{k % 3}", f"t{k}", r.randrange(1, 4) if k > 60 else 50 + k) for k in range(600)]
    t = spark.createDataFrame([(a, b, c, n, 1000 * n, 700 + n) for a, b, c, n in rows], "lang string, source string, term string, n long, p long, q long").withColumn("bucket", divergence.F.floor(divergence.F.log2("n") * 8))
    got = sorted(tuple(x) for x in divergence.top_terms(t, 5).collect())
    best = lambda s: sorted((("en", s, c, 999 * n - 700) for _, b, c, n in rows if b == s and 999 * n > 700), key=lambda x: (-x[3], x[2]))[:5]
    assert {x for s in ("s0", "s1", "s2") for x in best(s)} <= set(got) and len(got) < 40
