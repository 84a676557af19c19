"""Every query against its SQL, and the entry."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from tessella import catalog

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(str, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_sql(spark, tables, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracle_sql():
        assert rows(got) == rows(tables.execute(catalog.oracle_sql()[name]).df())
    else:
        assert len(got)


@pytest.fixture(scope="module")
def odd_lines(spark, tmp_path_factory):
    """Tables of documents whose first lines are blank, without letters, of signs and digits, or titles that aren't entries."""
    at, rng = str(tmp_path_factory.mktemp("odd")), random.Random(3)
    kinds = ["", " ", "12", "12 x", "+1 (389)", "1. a", "1.5", "-3 b", "007", "### | %", "8.8.8.8", "a b", "One two three four", "contents", "Index", "iv", "x" * 201, "é 7"]
    rows = [(d, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 9))), "s") for d in range(600)]
    spark.createDataFrame([*rows, (600, None, "s"), (601, "", "s")], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["p23_unit_numbers", "a09_contents_entries"])
def test_query_equals_its_sql_on_odd_lines(spark, odd_lines, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd_lines}/documents.parquet/*.parquet'")
    assert rows(catalog.queries()[name](spark, odd_lines).toPandas()) == rows(con.execute(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
