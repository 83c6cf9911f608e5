import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.core.QUERIES if n not in ("kmer_count_minimizer_plan", "kmer_count_k63")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    expected = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    one = sorted(tuple(r[c] for c in columns) for r in got.collect())
    two = sorted(tuple(r[expected.columns.index(c)] for c in columns) for r in expected.fetchall())
    assert one == two


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(entry.core.ORACLES) == set(entry.core.QUERIES)
