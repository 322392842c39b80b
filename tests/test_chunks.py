from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chunks as C


def test_closed_form_sizes(spark):
    for n, want in {0: 1, 1: 1, 60: 1, 61: 2, 95: 2, 96: 3, 150: 4}.items():
        assert len(C.chunk_text("x\n" * n)) == want, n


def test_paragraphs_and_headings():
    assert [c[:2] for c in C.chunk_text("a\nb\n\nc\nd\n", target=2, overlap=1)] == [(1, 3), (4, 5)]
    assert [c[:2] for c in C.chunk_text("a\n" * 40 + "\n" + "b\n" * 40)] == [(1, 41), (42, 81)]
    assert [c[0] for c in C.chunk_text("# a\n" + "x\n" * 40 + "# b\n" + "x\n" * 40, markdown=True)] == [1, 42]
    assert C.chunk_text(None) == [(1, 1, "")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "", "# h", "  "]), max_size=300), st.booleans())
def test_every_line_is_covered(lines, markdown):
    text = "".join(x + "\n" for x in lines)
    found = C.chunk_text(text, markdown)
    covered = {i for a, b, _ in found for i in range(a, b + 1)}
    assert covered >= set(range(1, len(lines) + 1)) and all(b - a + 1 <= C.TARGET_LINES + C.SLACK for a, b, _ in found)
    assert [f[0] for f in found] == sorted({f[0] for f in found})


def test_native_equals_single_block(spark):
    texts = ["x\n" * n for n in (0, 1, 59, 60, 61, 95, 96, 150, 151)] + ["a\nb", "\n\n", None]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "id int, text string, content2 string")
    got = {}
    for r in C.fixed_windows(df).collect():
        got.setdefault(r.id, []).append((r.start_line, r.end_line, r.content))
    for i, t in enumerate(texts):
        lines = (t or "").removesuffix("\n").split("\n")
        want = [(a + 1, b, "\n".join(lines[a:b])) for a, b in C.windows([0, len(lines)])]
        assert sorted(got[i]) == want


def test_chunks_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "x\n" * 120, "c"), (2, None, "d")], "id int, text string, source string")
    rows = C.chunks(df).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.source, r.start_line, r.total_chunks) for r in rows] == [(1, "c", 1, 3), (1, "c", 46, 3), (1, "c", 91, 3), (2, "d", 1, 1)]
    assert C.chunks(df.where("false")).count() == 0
    assert C.chunks(df.withColumn("md", F.lit(True)), markdown="md").count() == 4


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "x\n", 7, "old")], "id int, text string, start_line int, content string")
    for made in (C.chunks(df), C.fixed_windows(df)):
        row = made.first()
        assert row.start_line == 1 and row.content.strip() == "x" and made.columns.count("content") == 1
