import glob
import os

import duckdb
import numpy as np
import pytest

from sitelens.plans import queries as q

NAMES = sorted(q.ORACLE_SQL)


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return round(float(v), 5) + 0.0


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, sf_dir, con, name):
    df = q.QUERIES[name](spark, sf_dir)
    got = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = con.execute(q.ORACLE_SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([norm(r[cols.index(c)]) for c in sorted(cols)]) for r in rel.fetchall())
    assert got == want


def test_flagship(spark, sf_dir):
    rows = q.flagship(spark, sf_dir).collect()
    assert rows and any(r["on_front"] for r in rows)


def test_queries_do_the_whole_job(spark, sf_dir, monkeypatch):
    draws = []
    boot = q.resampling.bootstrap
    monkeypatch.setattr(q.resampling, "bootstrap", lambda *a, **k: draws.append((a[5:], k)) or boot(*a, **k))
    q.bootstrap_ci(spark, sf_dir)
    assert draws == [((), {})] and boot.__defaults__[1] == 2000
    monkeypatch.undo()
    p = q.mantel(spark, sf_dir).first()["p"]
    assert p < 0.005 and round(p, 3) == p
    rows = q.gridsearch(spark, sf_dir).collect()
    assert sorted((r["min_cluster_size"], r["min_samples"]) for r in rows) == sorted(q.density.candidate_grid(25))


def test_mantel_of_a_distance_without_spread(spark, tmp_path):
    """Centres closer than a half: all whole distances are 0, and SQL says NaN and 1."""
    rows = [(k, [float((k * p % 13 - 6) / 40) for p in (3, 5, 7, 11)], k % 6) for k in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(q.ORACLE_SQL["mantel"]).fetchall()
    got = [tuple(r) for r in q.mantel(spark, str(tmp_path)).collect()]
    assert repr(got) == repr(want) == "[(6, nan, 1.0)]"


@pytest.mark.parametrize("name", ["quantile_bins", "good_poor"])
def test_rows_of_a_cohort_stay_dealt(spark, sf_dir, name):
    """Two cohorts: a join that shuffles rows by cohort puts half of them into a task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_good_poor_leaves_rows_of_one_cohort_in_their_tasks(spark):
    """One cohort and one missing metric in eight: every task of the table keeps its own rows, labelled by the whole cohort's median."""
    v = q.F.when(q.F.col("id") % 8 > 0, (q.F.col("id") * 7919 % 4001).cast("double"))
    x = spark.range(0, 4000, 1, 4).select("id", q.F.lit("c").alias("cohort"), v.alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = q.binning.good_poor(x, "v", "cohort").withColumn("task", q.F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {k: float(k * 7919 % 4001) for k in range(4000) if k % 8}
    cut = round(float(np.median(list(want.values()))), 4)
    assert {r["id"]: (r["v"], r["split"]) for r in rows} == {k: (m, "good" if m >= cut else "poor") for k, m in want.items()} and len(rows) == len(want)
    assert [sum(r["task"] == t for r in rows) for t in range(4)] == [875] * 4
