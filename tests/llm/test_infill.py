import hashlib
import random
import re

import numpy as np

from sitelens.llm import infill


def brute(doc_id, text):
    text = text or ""
    t = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, text
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if h4 % 100 < 20:
        return doc_id, len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_elias_fano(monkeypatch):
    rng = np.random.default_rng(3)
    for top in (0, 1, 5, 1000, 100_000):
        for n in {0, min(top, 1), min(top, 7), min(top, 700), top}:
            v = np.sort(rng.choice(top, n, replace=False)) + 1 if n else np.zeros(0, np.int64)
            e = infill.EliasFano(n, top, [v[: n // 2], v[n // 2 :]])
            assert [e[i] for i in range(n)] == v.tolist()
    monkeypatch.setattr(infill, "BLOCK", 7)
    for text in ("", "a", "é", "ab, cdé  x\nKZ" * 9, "abcdefghijklmnopqrstuvwxyz" * 4, "é" * 30):
        raw = text.encode()
        e = infill.boundaries(raw)
        ends = [len(text[: m.end()].encode()) for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        assert [e[i] for i in range(e.n)] == ends


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice(["word", "é", " ", "<", "P>", "\n", "Zz", "漢", "😀", "3"]) for _ in range(r.randrange(60))) for _ in range(60)]
    texts += [None, "", "<P> in it", "a <S>", "<M>", "<", "x" * 5000, "long é, text " * 20_000]
    rows = [(k, r.choice(texts[:20]) if k % 3 else "the same text, copied") for k in range(900)]
    rows += [(1000 + k, t) for k, t in enumerate(texts)] + [(None, "no id here"), (None, None), (7, "one doc_id, two texts"), (7, "one doc_id, two texts")]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = infill.restore(infill.infill(df)).collect()
    order = lambda x: repr(x)
    assert sorted(((g["doc_id"], g["n"], g["form"], g["prefix_chars"], g["middle_chars"], g["output"]) for g in got), key=order) == sorted((brute(*x) for x in rows), key=order)
    assert sorted(repr((g["doc_id"], g["restored"])) for g in got) == sorted(repr((d, t or "")) for d, t in rows)
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}
    assert infill.infill(df.limit(0)).collect() == []


def test_same_hash_other_text(spark):
    a, b = infill.Entry(b"one two"), infill.Entry(b"one, two")
    assert (a.ends.n, b.ends.n) == (3, 4)
    batch = infill.pa.record_batch([infill.pa.array([5, 5, 5]), infill.pa.array([0, 0, 0]), infill.pa.array(["one two", "one, two", "one two"]), infill.pa.array([[1], [2, 3], [4]])], names=["key", "salt", "text", "ids"])
    out = [x for b in infill._cut([batch]) for x in b.to_pylist()]
    assert [(x["doc_id"], x["n"]) for x in out] == [(1, 3), (2, 4), (3, 4), (4, 3)]


def test_copies_are_dealt_out(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a text of a third of all', concat('own ', id)) as text").repartition(4)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("key", infill.F.xxhash64("text")).select("text", "doc_id", "key").mapInArrow(infill._gather(parts), "key long, salt long, text string, ids array<long>")
    hot = rows.where("text like 'a text%'")
    assert hot.agg(infill.F.sum(infill.F.size("ids"))).first()[0] == 6667 and hot.count() < 130
    assert hot.groupBy("salt").agg(infill.F.sum(infill.F.size("ids")).alias("n")).agg(infill.F.max("n")).first()[0] < 4000
