"""Every query with check SQL against DuckDB on the smallest tables."""

import duckdb
import pytest
from check_queries import TABLES, compare

import __spark_entry__ as entry
from cellweft.plans import registry

FOLDER = "/root/testdata/sf0.001"


def own(names):
    """Without the corpus operators, which have tests of their own."""
    return {k: v for k, v in names.items() if not k.startswith("op") and k != "pipeline"}


CHECKS = own(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_a_check():
    assert set(own(registry.QUERIES)) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, duck, name):
    text, same = compare(spark, duck, FOLDER, name, entry.queries()[name], CHECKS[name])
    assert same, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rainfall_7d" in df.columns
