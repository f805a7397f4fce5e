import random
import zlib

import numpy as np

import corpus_pipeline
from sitelens.llm import toxicity


def test_stages(spark, sf_dir, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["th", "an", "er", "ou", "in"]) for _ in range(r.randrange(1, 4)))
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for d in range(500):
        w = [word() for _ in range(r.randrange(20, 120))]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((d, " ".join(w), "en", "s", 0))
        labels.append((d, 1, int(toxic)))
    item = " ".join(f"bench{k}" for k in range(14))
    rows += [(601, rows[3][1] + " extra", "en", "s", 0), (602, " ".join(word() for _ in range(70)) + " " + item, "en", "s", 0), (603, rows[11][1] + " write to x.y@example.com now please " + rows[12][1], "en", "s", 0), (604, None, "en", "s", None), (605, "", None, None, 0), (606, rows[8][1] + " you i.d.i.o.t " + rows[9][1], "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, d)
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = {x["doc_id"]: x for x in docs.collect()}
    gone = {x[0] for x in rows} - set(kept["toxicity"])
    toxic = {x for x in range(0, 500, 5)} | {606}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 5
    assert 601 not in kept["near_duplicates"] and 3 in kept["near_duplicates"]
    assert len(kept["near_duplicates"]) == len(kept["toxicity"]) - 1
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {602}
    assert "<EMAIL>" in kept["pii"][603]["text"] and kept["pii"][603]["n_chars"] == len(kept["pii"][603]["text"])
    assert {x["doc_id"] for x in docs.collect()} == set(kept["pii"])
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).limit(1).collect() == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op6_toxicity(spark, d).collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    lab = {x["doc_id"]: x["toxic"] for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    s = np.array([x["score"] for x in got if x["held_out"] and x["doc_id"] in lab])
    y = np.array([lab[x["doc_id"]] for x in got if x["held_out"] and x["doc_id"] in lab])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc > 0.7


def test_window_sums_are_the_kernel():
    """The folded weights give what kernel values at the landmarks give."""
    r = np.random.default_rng(3)
    marks = r.integers(1, 8, (5, toxicity.W + toxicity.REACH)).astype(np.uint8)
    x = r.integers(1, 8, 40).astype(np.uint8)
    held = toxicity.Marks(marks)
    v = r.normal(size=5)
    weight = np.zeros(toxicity.A**4, np.float32)
    weight[held.codes] = held.dense.T @ v
    toxicity.silent(weight)
    sums = toxicity.window_sums(np.concatenate([x, np.zeros(toxicity.GAP, np.uint8)]), weight)
    windows = np.stack([toxicity._padded(x, k) for k in range(len(x))])
    assert np.allclose(sums[: len(x)][: len(sums)], (held.kernel(windows) @ v)[: len(sums)], atol=1e-3)
