"""Every query of the catalogue against the SQL that states its result."""

from __future__ import annotations

import decimal
import math
import os

import pytest

from corpusloom.plans import catalogue, records, runs, tools  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame) -> list:
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("<NA>", "NaT"):
            return None
        if isinstance(x, decimal.Decimal):
            return float(x)
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x.is_integer() else x  # a null in a column makes its integers floats

    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
