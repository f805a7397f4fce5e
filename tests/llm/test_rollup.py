import public_tokenizers
import pytest

from sitelens.llm import rollup
from sitelens.llm.common import new_path

EVENTS = "source string, lang string, version string, op string, n_tokens long, old_tokens long, n_chars long"


def rows(r):
    return sorted((x["source"] or "", x["lang"] or "", x["version"], x["n_docs"], x["n_tokens"], x["n_chars"]) for x in r.totals().collect())


def test_commits_are_additive_and_idempotent(spark):
    r = rollup.Rollup(spark, new_path(spark, "t"))
    assert rows(r) == []
    one = spark.createDataFrame([("a", "en", "v1", "insert", 10, None, 50), ("a", "en", "v1", "insert", None, None, None), (None, "en", "v1", "insert", 3, None, 9)], EVENTS)
    assert r.commit("1", one) and not r.commit("1", one)
    assert rows(r) == [("", "en", "v1", 1, 3, 9), ("a", "en", "v1", 2, 10, 50)]
    two = spark.createDataFrame([("a", "en", "v1", "revise", 7, 10, 50), (None, "en", "v1", "delete", 3, None, 9)], EVENTS)
    assert r.commit("2", two)
    assert rows(r) == [("a", "en", "v1", 2, 7, 50)]
    r.compact()
    assert not r.commit("2", two) and r.commit("3", one.limit(0))
    r.compact()
    assert rows(r) == [("a", "en", "v1", 2, 7, 50)] and not r.commit("1", one)
    with pytest.raises(Exception, match="unknown op"):
        r.commit("4", spark.createDataFrame([("a", "en", "v1", "upsert", 1, None, 1)], EVENTS))
    assert r.commit("4", one)


def plain(docs):
    """Totals by (source, lang, version) of one document of each text, counted one by one."""
    enc = {v: rollup.encoding(public_tokenizers.path(f)) for v, f in rollup.TOKENIZERS.items()}
    order = sorted(docs, key=lambda d: (d["doc_id"] is None, d["doc_id"] or 0, d["source"] or "", d["lang"] or ""))
    kept = {}
    for d in order:
        kept.setdefault(d["text"] or "", d)
    want = {}
    for t, d in kept.items():
        for v, e in enc.items():
            n, w, c = want.get(k := (d["source"], d["lang"], v), (0, 0, 0))
            want[k] = (n + 1, w + len(e.encode_ordinary(t)), c + len(t))
    return {k: x for k, x in want.items() if x[0]}


def found(df):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in df.collect()}


def test_query_matches_a_plain_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert found(rollup.op5_token_counts(spark, sf_dir)) == plain(docs)


def test_hard_documents(spark, tmp_path):
    long = "word é 中文 " * 30_000
    rows = [(1, "same", "en", "a"), (1, "same", "en", "a"), (2, "same", "en", "b"), (None, "same", "en", "b"), (None, "alone", None, None), (None, "alone", "en", None), (3, None, "en", "a"), (4, "", "en", "a"), (5, long, "en", "c"), (6, "<|endoftext|>", "en", "a")]
    rows += [(100 + k, "copied everywhere", "en", f"s{k % 3}") for k in range(200)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, source string, version string, copies int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = found(rollup.op5_token_counts(spark, str(tmp_path)))
    assert got == plain(df.collect()) and got[("s0", "en", "byte-50k")][0] == 1
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert rollup.op5_token_counts(spark, f"{tmp_path}/none").collect() == []
