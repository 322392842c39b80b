import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import neardup as D
from corpusloom.llm.neighbours import NeighbourGraph


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(25, 90))]
        rows.append((f"b{i}", " ".join(base)))
        for k in range(rng.randint(0, 3)):
            edit = list(base)
            for _ in range(rng.randint(0, 4)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            rows.append((f"b{i}e{k}", " ".join(edit)))
    return rows + [("c1", rows[0][1].upper()), ("c2", rows[0][1] + " !"), ("n", None), ("e", ""), ("b0", rows[0][1]), ("long", " ".join(words * 40)), ("long2", " ".join(words * 40) + " end")]


def sets(text, width=3, least=30):
    import re

    w = re.findall(r"[a-z0-9_]+", (text or "").lower())
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= least else None  # noqa: B905


def brute(rows):
    s = {i: x for i, t in rows if (x := sets(t)) is not None}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) * 10 >= 7 * len(s[a] | s[b])}


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    got = [(r.id_a, r.id_b) for r in D.similar_pairs(spark.createDataFrame(rows, "id string, text string")).distinct().collect()]
    want = brute(rows)
    assert set(got) <= want and len(set(got)) >= 0.99 * len(want) and len(want) > 40


def test_many_copies_are_paired_with_the_first(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:02d}", text) for i in range(12)] + [("near", text + " end"), ("far", " ".join(f"z{i}" for i in range(40)))]
    got = {(r.id_a, r.id_b) for r in D.similar_pairs(spark.createDataFrame(rows, "id string, text string"), full=10).collect()}
    assert got == {("c00", f"c{i:02d}") for i in range(1, 12)} | {("c00", "near")}


def test_only_byte_equal_copies_are_paired_with_the_first(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(f"c{i:02d}", " ".join(w.upper() if k == i else w for k, w in enumerate(words))) for i in range(12)] + [("near", " ".join(words) + " end")]
    got = [(r.id_a, r.id_b) for r in D.similar_pairs(spark.createDataFrame(rows, "id string, text string"), full=10).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got)) == 78


def test_large_classes_are_paired_in_full(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 5)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:02d}", text) for i in range(17)] + [(f"d{i}", text + " end") for i in range(8)] + [("b", text + " END of"), ("far", " ".join(f"z{i}" for i in range(40)))]
    got = [(r.id_a, r.id_b) for r in D.similar_pairs(spark.createDataFrame(rows, "id string, text string")).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got)) == 26 * 25 // 2


def test_copies_beyond_a_thousand(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.range(1_100).select(F.format_string("c%04d", "id").alias("id"), F.lit(text).alias("text"))
    assert D.similar_pairs(df).distinct().count() == 1_100 * 1_099 // 2


def test_groups_are_components(spark):
    chain = ["x%d" % i for i in range(40)]
    texts = []
    for k in range(6):  # each differs from the one before by little, from the first by much
        texts.append((f"t{k}", " ".join(chain[: 40 - 2 * k] + [f"y{k}_{i}" for i in range(2 * k)])))
    rows = [("a", texts[0][1]), ("alone", " ".join(f"z{i}" for i in range(40))), *texts]
    members, links = D.similar_classes(spark.createDataFrame(rows, "id string, text string"))
    got = {r.id: r for r in D.groups(members, links).collect()}
    pairs, name = brute(rows), {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    for a in name:
        for b in name:
            assert (got[a].group_id == got[b].group_id) == (name[a] == name[b]), (a, b)
    assert got["a"].class_id == got["t0"].class_id and got["alone"].n_links == 0


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([("a", "too short"), ("b", None)], "id string, text string")
    assert D.similar_pairs(df).count() == 0 and D.similar_pairs(df.where("false")).count() == 0


def test_forest_reaches_target():
    f = D.Forest(0.7, 32, 0.999)
    assert f.met(0.7, f.shallowest) >= 0.999 > f.met(0.7, f.shallowest + 1)
    rng = np.random.default_rng(2)
    met = []
    shift = np.uint64(64 - 8 * f.shallowest)
    for _ in range(200):
        shared = rng.integers(0, 2**63, 140, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, 30, dtype=np.uint64)])) for _ in range(2))
        met.append(bool((f.labels(a).view(np.uint64) >> shift == f.labels(b).view(np.uint64) >> shift).any()))
    assert np.mean(met) >= 0.985


def test_crowded_places_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "CROWD", 5)
    rows = corpus() + [(f"k{i}", " ".join([f"s{j}" for j in range(60)] + [f"k{i}_{j}" for j in range(4 + i % 9)])) for i in range(60)]
    got = [(r.id_a, r.id_b) for r in D.similar_pairs(spark.createDataFrame(rows, "id string, text string")).distinct().collect()]
    want = brute(rows)
    assert set(got) <= want and len(got) >= 0.995 * len(want) and len(want) > 1_000


def test_one_place_of_many_distinct_texts(spark):
    """20,000 texts whose common half fills the same places, and a few near-duplicates among them."""
    head = F.lit(" ".join(f"h{i}" for i in range(36)))
    own = F.concat_ws(" ", *[F.concat(F.lit(f"t{j}x"), F.col("id")) for j in range(20)])
    texts = spark.range(20_000).select(F.format_string("c%06d", "id").alias("id"), F.concat_ws(" ", head, own).alias("text"))
    near = texts.where("id < 'c000050'").select(F.concat(F.lit("n"), "id").alias("id"), F.concat("text", F.lit(" end")).alias("text"))
    got = {(r.id_a, r.id_b) for r in D.similar_pairs(texts.unionByName(near)).distinct().collect()}
    assert got == {(f"c{i:06d}", f"nc{i:06d}") for i in range(50)}


def vectors(n=900, size=24, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, size))
    return (centres[rng.integers(0, 30, n)] + 0.5 * rng.normal(size=(n, size))).astype(np.float32)


def nearest(ids, m, k):
    m = m.astype(np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = np.round(m @ m.T, 9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]}


def test_graph_recall_and_bad_vectors(spark):
    m = vectors()
    ids = [f"s{i:04d}" for i in range(len(m))]
    rows = [(i, v.tolist()) for i, v in zip(ids, m, strict=True)]
    bad = [("nan", [float("nan")] * 24), ("zero", [0.0] * 24), ("short", [1.0] * 3), ("null", None), (None, m[0].tolist()), ("hole", [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows + rows[:50] + bad, "symbol_id string, embedding array<float>")
    graph = NeighbourGraph(df, size=24)
    got = {(r.id, r.neighbour) for r in graph.neighbours().collect()}
    want = nearest(ids, m, 10)
    assert len(got & want) / len(want) >= 0.95 and len(got) == len(want)


def test_graph_ties_and_few(spark):
    same = [(f"t{i:02d}", [1.0, 2.0, 3.0]) for i in range(30)] + [("u", [3.0, 2.0, 1.0])]
    got = {(r.id, r.neighbour) for r in NeighbourGraph(spark.createDataFrame(same, "symbol_id string, embedding array<float>"), size=3).neighbours().collect()}
    assert {b for a, b in got if a == "t05"} == {f"t{i:02d}" for i in range(11) if i != 5}
    assert {b for a, b in got if a == "t29"} == {f"t{i:02d}" for i in range(10)} == {b for a, b in got if a == "u"}
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "symbol_id string, embedding array<float>")
    assert len(NeighbourGraph(few, size=2).neighbours().collect()) == 6
    assert NeighbourGraph(few.where("false"), size=2).neighbours().count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_graph_other_k(spark, k):
    m = vectors(200, 8)
    ids = [f"s{i:03d}" for i in range(200)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m, strict=True)], "symbol_id string, embedding array<float>")
    got = {(r.id, r.neighbour) for r in NeighbourGraph(df, size=8, k=k).neighbours().collect()}
    assert len(got & nearest(ids, m, k)) >= 0.9 * 200 * k


def test_greedy_search_of_vectors_outside_the_graph(spark):
    m = vectors(960)
    ids = [f"s{i:04d}" for i in range(900)]
    schema = "symbol_id string, embedding array<float>"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m[:900], strict=True)], schema)
    asked = [(f"q{i}", v.tolist()) for i, v in enumerate(m[900:])] + [("nan", [float("nan")] * 24), ("null", None), ("copy", m[5].tolist())]
    graph = NeighbourGraph(df, size=24)
    rows = graph.search(spark.createDataFrame(asked, schema)).collect()
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1)[:, None]
    s = np.round(u[[*range(900, 960), 5]] @ u[:900].T, 9)
    names = [*(f"q{i}" for i in range(60)), "copy"]
    want = {(q, ids[j]) for q, row in zip(names, s, strict=True) for j in sorted(range(900), key=lambda j: (-row[j], ids[j]))[:10]}  # noqa: B023
    got = {(r.query_id, r.id) for r in rows}
    assert len(rows) == len(got) == 610 and len(got & want) >= 0.95 * len(want)
    assert [r.id for r in rows if r.query_id == "copy" and r["rank"] == 1] == ["s0005"]
    assert NeighbourGraph(df.where("false"), size=24).search(df).count() == 0 and graph.search(df.where("false")).count() == 0


def test_vectors_of_one_direction_tie_by_id(spark):
    rng = np.random.default_rng(8)
    m = np.concatenate([np.outer(rng.uniform(0.1, 9, 60), rng.normal(size=12)), rng.normal(size=(300, 12))]).astype(np.float32)
    ids = [f"s{i:03d}" for i in rng.permutation(len(m))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m, strict=True)], "symbol_id string, embedding array<float>")
    got = {(r.id, r.neighbour) for r in NeighbourGraph(df, size=12).neighbours().collect()}
    want = nearest(ids, m, 10)
    copies = set(ids[:60])
    assert {x for x in want if x[0] in copies} == {x for x in got if x[0] in copies} and len(got) == len(want)
    assert len(got & want) >= 0.98 * len(want)


def test_cells_are_cut_into_parts(spark, monkeypatch):
    import corpusloom.llm.neighbours as N

    monkeypatch.setattr(N, "PART", 200)
    m = vectors(600)
    ids = [f"s{i:04d}" for i in range(len(m))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m, strict=True)], "symbol_id string, embedding array<float>")
    graph = NeighbourGraph(df, size=24, pivots=2)
    assert graph.parts.where("n > 1").count()
    got = {(r.id, r.neighbour) for r in graph.neighbours().collect()}
    assert len(got & nearest(ids, m, 10)) >= 0.9 * 6000
    found = graph.search(df.limit(40), k=1).collect()
    assert all(r.id == r.query_id for r in found) and len(found) == 40


def test_lists_of_a_cluster_are_compared_in_one_cell(spark, monkeypatch):
    """A round sends each vector to little more than one cell, though pivots cut through clusters."""
    import corpusloom.llm.neighbours as N

    sends, write = [], N.materialise

    def spy(df, name, bucket=None):
        out = write(df, name, bucket)
        if name == "knn-lists":
            sends.append(out.select("cell", F.explode("x").alias("x")).distinct().count())
        return out

    monkeypatch.setattr(N, "materialise", spy)
    rng = np.random.default_rng(5)
    m = (rng.normal(size=(75, 96)).repeat(40, axis=0) + 0.4 * rng.normal(size=(3_000, 96))).astype(np.float32)
    ids = [f"s{i:04d}" for i in range(len(m))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m, strict=True)], "symbol_id string, embedding array<float>")
    graph = NeighbourGraph(df, size=96, pivots=32)
    got = {(r.id, r.neighbour) for r in graph.neighbours().collect()}
    assert len(got & nearest(ids, m, 10)) >= 0.995 * 30_000 and sends[0] <= 1.7 * len(m)


def test_rounds_go_on_until_lists_settle(monkeypatch):
    shares = [0.5, 0.3, 0.1, 0.05, 0.02, 0.005, 0.001, 0.0001, 0.0]
    for name in ("_number", "_place", "_start"):
        monkeypatch.setattr(NeighbourGraph, name, lambda *a: None)
    monkeypatch.setattr(NeighbourGraph, "_refine", lambda self: self.changed.append(shares[len(self.changed)]) or True)
    assert NeighbourGraph(None).changed == shares[:8]
    assert NeighbourGraph(None, rounds=2).changed == shares[:2]
