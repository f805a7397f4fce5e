import random
import re

from sitelens.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            q = words(it)
            n = min(10, len(q))
            wins = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out)


def got(rows):
    return sorted((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in rows)


def test_against_brute_force(spark):
    base = " ".join(f"w{k % 7}x{k % 11}" for k in range(300))
    w = base.split()
    items = [(1, " ".join(w[20:45])), (2, "Alpha, beta"), (3, "   "), (4, None), (5, "solo"), (6, " ".join(w[30:60])), (7, " ".join(w[20:45])), (8, "a a a a a a a a a a a a")]
    docs = [(1, base), (2, None), (3, ""), (4, "ALPHA beta alpha  beta"), (5, "x solo solo é"), (6, " ".join(w[:40]) + " solo"), (7, "a " * 15), (7, "a " * 15), (8, "é,ü ß"), (9, "beta"), (10, "alpha")]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, items string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert got(decontam.find_contamination(d, i).collect()) == want
    assert got(decontam.find_contamination(d, i, block_words=20).collect()) == want
    dirty = {(x[0]) for x in want if x[2]}
    for words_in in (400_000, 20):
        kept = decontam.clean(d, i, block_words=words_in)
        assert kept.columns == d.columns and sorted(x[0] for x in kept.collect()) == sorted(x[0] for x in docs if x[0] not in dirty)
    assert decontam.find_contamination(d.limit(0), i).collect() == []
    none = decontam.find_contamination(d, i.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["items"] or r["spans"] for r in none)


def test_very_long_text(spark):
    r = random.Random(8)
    words = [str(r.randrange(10**6)) for _ in range(300_000)]
    item = [f"item{k}" for k in range(12)]
    text = " ".join(words[:250_000] + item + words[250_000:])
    assert len(text) > 1 << 20
    docs = spark.createDataFrame([(1, text), (2, " ".join(words))], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_words"], [tuple(s) for s in x["spans"]], list(x["items"])) for x in decontam.find_contamination(docs, spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")).collect()}
    assert got == {1: (300_012, [(250_000, 250_012)], ["i"]), 2: (300_000, [], [])}
