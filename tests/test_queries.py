"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from planmatch.plans import oracle
from planmatch.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


def text(value) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return "~"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.sql(oracle.SQL[name]).df()
    spark.catalog.clearCache()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) - set(oracle.SQL) == {"work_area_ring"}
