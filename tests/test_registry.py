import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import registry as R

T = [dt.datetime(2025, 1, d) for d in (1, 2, 3)]
ROWS = [("a", "u1", "indexing", None, 0), ("a", "u1", "indexed", T[2], 9), ("a", None, "indexed", T[1], 5), ("b", "u2", "indexed", T[0], 1), ("b", "u2", "indexed", T[0], 1)]


@pytest.fixture
def history(spark):
    return spark.createDataFrame(ROWS, "name string, url string, status string, indexed_at timestamp, symbol_count long")


def test_current_takes_late_rows_in_place(history):
    assert sorted((r.name, r.symbol_count) for r in R.current(history).collect()) == [("a", 9), ("b", 1)]
    assert R.current(history.where("false")).count() == 0


def test_upsert_is_idempotent(history, spark):
    new = spark.createDataFrame([("b", "u3", "indexed", T[2], 7), ("c", None, "indexing", None, 0)], history.schema)
    once = R.upsert(R.current(history), new, "name")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, R.upsert(once, new, "name").collect()))
    assert {r.name: r.symbol_count for r in once.collect()} == {"a": 9, "b": 7, "c": 0}


def test_register_resets_and_change_keeps(history, spark):
    base = R.current(history)
    names = spark.createDataFrame([("a",), ("n",)], "name string")
    again = {r.name: r for r in R.register(base, names, status=F.lit("indexing"), symbol_count=F.lit(0)).collect()}
    assert again["a"].symbol_count == 0 and again["a"].url is None and again["n"].status == "indexing" and again["b"].symbol_count == 1
    changed = {r.name: r for r in R.change(base, spark.createDataFrame([("a", 50)], "name string, symbol_count long")).collect()}
    assert changed["a"].symbol_count == 50 and changed["b"].symbol_count == 1
    with pytest.raises(ValueError):
        R.change(base, spark.createDataFrame([("a", 1)], "name string, nothing long"))


def test_without(history, spark):
    gone = spark.createDataFrame([("a",), ("zz",)], "name string")
    assert {r.name for r in R.without(history, gone, "name").collect()} == {"b"}
