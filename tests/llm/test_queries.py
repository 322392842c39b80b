import os
from pathlib import Path

import duckdb
import pytest

from corpusloom.llm import queries as Q

DATA = Path(os.environ.get("CORPUSLOOM_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
COLUMNS = {
    "p1_found": ["chunk_id string", "start_at bigint"], "p2_found": ["repo string", "file string"], "p3_found": ["chunk_id_a string", "chunk_id_b string"], "p4_found": ["repo string", "file string"], "p5_found": ["symbol_id_a string", "symbol_id_b string"],
    "p6_found": ["chunk_id string"], "p7_ids": ["doc_id bigint", "ids array<int>"], "p9_found": ["doc_id bigint", "start_at bigint", "kind string"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = Q.queries()[name](spark, str(DATA))
    assert [f"{n} {t}" for n, t in df.dtypes] == COLUMNS[name]
    rows = df.collect()
    assert len(rows) > 0 and (name == "p7_ids" or len(set(rows)) == len(rows))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = Q.queries()[name](spark, str(DATA)).toPandas(), db.execute(Q.oracle_sql()[name]).df()
    key = sorted(want.columns)
    assert sorted(map(tuple, got[key].astype(str).values)) == sorted(map(tuple, want[key].astype(str).values))
