import itertools
import os
import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import toxicity as T

BAD = ["idiot", "moron", "scumbag", "pathetic"]


def prose(r, n):
    return ["".join(r.choice(["th", "an", "er", "ou", "in", "st", "ble"]) for _ in range(r.randrange(1, 4))) for _ in range(n)]


def corpus(seed, n):
    r = random.Random(seed)
    texts, labels = [], []
    for d in range(n):
        w = prose(r, r.randrange(15, 80))
        if d % 3 == 0:
            w.insert(r.randrange(len(w)), r.choice(BAD))
        texts.append(" ".join(w) + ".")
        labels.append(int(d % 3 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return T.train(*corpus(1, 600), 1 / 3)


def test_fold():
    table = T.alphabet(["abc"])
    same = lambda *texts: len({T.fold(x, table).tobytes() for x in texts}) == 1
    assert same("an idiot", "An  i-d.i_o​t", "an i d i o t", "an iidioooot", "an\ni\td i  o t")
    assert not same("a b", "ab") and not same("an idiot", "anidiot")
    assert len(T.fold("", table)) == 0 and T.fold("　", table).tolist() == [1] and len(T.fold("\U0001f600。", table)) == 0
    assert T.fold("中", table).tolist() == [T.A - 1]
    # spaces between all characters leave three or more at a word's end
    for text in ("you are an idiot, really. Feel it", "no-one  is 1 moron", "it is so"):
        assert same(text, " ".join(text), "-".join(text))
    assert same("an idiot is", "an i d i o t   i s", "an i d i o t   is") and not same("i d i o t   y o u", "i d i o t  y o u")


def test_kernel_by_brute_force():
    """The kernel of two windows is the sum over all pairs of equal subsequences, weighted by the symbols they skip."""
    r = np.random.default_rng(2)
    x, y = (r.integers(1, 6, (4, T.W + T.REACH)).astype(np.uint8) for _ in range(2))

    def weights(w):
        out = {}
        for at in itertools.combinations(range(len(w)), 4):
            steps = np.diff(at)
            if at[0] < T.W and max(steps) <= 3 and sum(steps) <= T.REACH:
                key = tuple(w[list(at)])
                out[key] = out.get(key, 0) + T._DECAY ** (sum(steps) - 3)
        return out

    got = T.Marks(x).kernel(y)
    for i, j in itertools.product(range(4), range(4)):
        a, b = weights(x[j]), weights(y[i])
        assert abs(got[i, j] - sum(v * b.get(k, 0) for k, v in a.items())) < 1e-3


def test_disguised_insults_are_found(model):
    r = random.Random(3)
    texts, labels = corpus(5, 300)
    y = np.array(labels) == 1

    def inside(w):
        k = r.randrange(1, len(w)) if len(w) > 1 else 0
        return w[:k] + r.choice(string.ascii_lowercase) + w[k:] if k else w

    def only_bad(f):
        return lambda t: " ".join(f(w) if w.strip(".") in BAD else w for w in t.split())

    plain = model.scores(texts)
    limit = np.quantile(plain[~y], 0.98)
    recall = (plain[y] > limit).mean()
    assert recall > 0.9
    for change in (
        lambda t: " ".join(inside(w) for w in t.split()), only_bad(inside), only_bad(" ".join), only_bad("-".join),
        lambda t: "".join(2 * c for c in t), lambda t: " ".join(t),
    ):
        s = model.scores([change(t) for t in texts])
        assert (s[y] > np.quantile(s[~y], 0.98)).mean() >= 0.8 * recall


def test_held_out_rows(spark):
    """The figures that the README states, on rows whose labels were not learned."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = T.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where(T.held_out() & F.col("toxic").isin(0, 1)).select("text", "toxic").collect()
    y = np.array([r["toxic"] for r in rows]) == 1
    for change in (str, " ".join, "-".join):
        s = model.scores([change(r["text"] or "") for r in rows])
        rank = np.searchsorted(np.sort(s), s, "left") + np.searchsorted(np.sort(s), s, "right") + 1
        auc = (rank[y].sum() / 2 - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
        assert auc >= 0.9 and (s[y] >= 0.3).mean() >= 0.75 and (s[~y] >= 0.3).mean() <= 0.03


def test_blocks_and_ends(model):
    long = " ".join(prose(random.Random(6), 150_000))
    assert len(T.fold(long, model.symbols)) > T._MOST
    at = long.index(" ", len(long) // 2)
    s = model.scores([long, long[:at] + " pathetic idiot" + long[at:], long + " moron", "moron", "", "。", "x"])
    assert s[1] > s[0] and s[4] == s[5] <= s[3] and ((0 <= s) & (s <= 1)).all()
    whole = T.fold(long, model.symbols)
    sums = T.window_sums(np.concatenate([whole, np.zeros(T.GAP, np.uint8)]), model.weight)
    assert np.isclose(T.raw_scores([long], model.symbols, model.weight)[0], max(0, sums.max()), atol=1e-2)


def test_defined_cases(spark):
    texts, labels = corpus(7, 400)
    docs = [(d, t, "k", 0.0) for d, t in enumerate(texts)] + [(1000, None, "k", 0.0), (1001, "", "k", 0.0), (None, texts[0], "k", 0.0), (3, texts[3], "k", 0.0), (3, "another text", "k", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double")
    lab = [(d, 1, y) for d, y in enumerate(labels)] + [(0, 1, 1 - labels[0]), (1, 1, None), (None, 1, 1), (5000, 1, 1)]
    lab = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    model = T.fit(df, lab, sample=120)
    got = T.score(df, model).select("doc_id", "text", "score", T.held_out().alias("held_out")).collect()
    assert len(got) == len(docs) and all(0 <= x["score"] <= 1 for x in got)
    by_text = {}
    for x in got:
        by_text.setdefault(x["text"] or "", set()).add(x["score"])
        assert x["held_out"] == (None if x["doc_id"] is None else zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
    assert all(len(v) == 1 for v in by_text.values())
    # no labels, one class, no rows, labels that all contradict each other
    assert {x["score"] < 1e-6 for x in T.score(df, T.fit(df, lab.limit(0))).collect()} == {True}
    one = T.score(df, T.fit(df, lab.where("toxic = 1"))).select("score").distinct().collect()
    assert len(one) == 1 and one[0]["score"] > 0.9
    both = lab.where("doc_id < 50").unionByName(lab.where("doc_id < 50").withColumn("toxic", 1 - F.col("toxic")))
    assert len(T.score(df, T.fit(df, both)).select("score").distinct().collect()) == 1
    assert T.score(df.limit(0), model).collect() == [] and T.fit(df.limit(0), lab) is not None
