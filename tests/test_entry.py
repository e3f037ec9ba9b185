"""The registered queries against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return None
    if isinstance(x, float) and math.isfinite(x):
        return int(x) if x == int(x) else float(f"{x:.12g}")
    return x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="session")
def tables(sf_dir):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, tables, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert rows(got) == rows(tables.execute(sql).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
