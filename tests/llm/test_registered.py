"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from larder.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    assert set(got.columns) == set(want.columns) and len(got) == len(want)
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(want)]
