"""Every registered reconciliation query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from concord.plans import catalogue


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["match_cascade", "override_cascade", "track_diff"])
def test_limits_of_the_reference(spark, name):
    """At sf0.01 words have more than 100 targets and fewer than 500, and some best scores are from 0.65 to 0.8."""
    con, narrow = duckdb.connect(), f"{name}_narrow"
    for t in ("part", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    got, cut = (rows(catalogue.QUERIES[n](spark, "/root/testdata/sf0.01").toPandas()) for n in (name, narrow))
    assert got == rows(con.execute(catalogue.ORACLES[name]).df()) != cut


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
