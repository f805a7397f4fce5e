"""The queries of the subpackage against their SQL."""

import glob
import os

import duckdb
import pytest

from sitelens.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = q.QUERIES[name](spark, sf_dir)
    rel = con.execute(q.ORACLE_SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in sorted(cols)]) for r in df.collect()) == want
