"""Each query against its SQL on the smallest data."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import oracle, queries

DATA = Path(os.environ.get("CORPUSLOOM_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def _rows(df):
    show = lambda v: "-" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got, want = queries.queries()[name](spark, str(DATA)).toPandas(), db.execute(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_extracted_symbols_are_those_of_the_table(spark):
    found = queries.queries()["extracted_symbols"](spark, str(DATA)).where("symbol_type <> 'chunk'").select("chunk_id").distinct()
    given = spark.read.parquet(f"{DATA}/code_symbol.parquet").where("symbol_type <> 'chunk'").select("chunk_id").distinct()
    assert given.join(found, "chunk_id", "left_anti").count() == 0


def test_extracted_exports_are_those_of_the_table(spark):
    script = "symbol_type <> 'chunk' and language in ('javascript', 'typescript')"
    given = spark.read.parquet(f"{DATA}/code_symbol.parquet").where(script).select("chunk_id", "exports").distinct()
    found = queries.queries()["extracted_symbols"](spark, str(DATA)).select("chunk_id", "exports")
    assert given.count() > 0 and given.join(found, ["chunk_id", "exports"], "left_anti").count() == 0
