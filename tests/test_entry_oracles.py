"""The driver contract: entry smoke, and every oracle query against DuckDB at sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["market_segment", "month", "sales", "quantity", "profit"]


def test_every_query_has_a_callable_and_oracles_are_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 70


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", list(E.oracle_sql()))
def test_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    b = sorted((tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()), key=str)
    assert a == b
