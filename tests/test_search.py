import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import search as S
from corpusloom.plans.queries import queries

DATA = Path(os.environ.get("CORPUSLOOM_TEST_DATA", "/root/testdata/sf0.001"))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_topk_equals_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[5] = m[6]  # a tie
    m[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {}
    for r in S.top_k(df.where("id % 50 = 0"), df, 4, "id", "v", metric).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    x = m.astype(np.float64)
    for q in range(0, 300, 50):
        if metric == "cosine":
            n = np.sqrt((x * x).sum(1))
            with np.errstate(all="ignore"):
                s = np.round(x @ x[q] / (n * n[q]), 6)
            order = sorted((i for i in range(300) if np.isfinite(s[i])), key=lambda i: (-s[i], i))
        else:
            s = np.round(((x - x[q]) ** 2).sum(1), 6)
            order = sorted(range(300), key=lambda i: (s[i], i))
        assert [got[q][k] for k in sorted(got[q])] == order[:4]


def test_topk_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    assert S.top_k(df, df, 10, "id", "v").count() == 4
    assert S.top_k(df.where("false"), df, 3, "id", "v").count() == 0
    assert S.top_k(df, df.where("false"), 3, "id", "v").count() == 0
    with pytest.raises(ValueError):
        S.top_k(df, df, 1, "id", "v", "dice")


def test_topk_within_own_value(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), i % 4 if i % 9 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    got = {}
    for r in S.top_k(df.where("id % 10 = 0"), df, 3, "id", "v", within="label").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    unit = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v, _ in rows}
    label = {i: own for i, _, own in rows}
    want = {q: sorted((i for i in unit if label[i] == label[q]), key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:3] for q in range(0, 240, 10) if label[q] is not None}
    assert {q: [g[k] for k in sorted(g)] for q, g in got.items()} == want and len({label[q] for q in want}) > 1


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_every_labelled_query_is_answered(spark):
    found = queries()["cosine_topk_by_label"](spark, str(DATA)).select("query_id").distinct().count()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 50 = 0 and label is not null and embedding is not null")
    assert found == e.select("vec_id").distinct().count() > e.where("label = 3").select("vec_id").distinct().count()


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")), V.squared_distance(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx(0.96) and rows[0][1] == 2.0 and rows[1][0] is None and rows[2][0] is None


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("q", 1, "a" * 100), ("q", 2, "b" * 150), ("q", 3, "c"), ("r", 1, "d" * 300)], "query_id string, rank int, section string")
    kept = S.within_budget(df, budget=200)
    assert [(r.query_id, r["rank"]) for r in kept.collect()] == [("q", 1)]
    text = S.contexts(df, budget=251).first().context
    assert text.index("a" * 100) < text.index("b" * 150) and "\nc\n" in text


def test_prompt_and_section(spark):
    df = spark.createDataFrame([(None, None)], "c string, n string")
    hit = {k: F.col("n") for k in ("symbol_type", "symbol_name", "file", "language", "retrieval_text")}
    s = df.select(S.section(F.lit(1), hit, F.lit(None).cast("double"))).first()[0]
    assert s.count("Unknown") == 4 and "Distance: N/A" in s and "-" * 60 in s
    p = df.select(S.prompt(F.col("c"), F.lit("why?"), "Be brief.")).first()[0]
    assert p.startswith("Be brief.") and S.NO_CONTEXT in p and p.endswith("Answer:")


def test_hashed_embedding_is_unit(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    rows = [r.embedding for r in S.hashed_embedding(df, "t", size=16).collect()]
    assert np.linalg.norm(rows[0]) == pytest.approx(1) and set(rows[1]) == {0.0} and rows[2] is None
