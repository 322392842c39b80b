import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
from corpusloom.llm import packing as P  # noqa: E402
from corpusloom.llm import tokens as T  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=T.WORDS, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aabeo  \n\t.,'1٣²Ⅷéü日一😀\u200b\x1c\x85\xa0\u3000_-", "the", "ing", "'s", "<|endoftext|>", "  ", "\r\n"]), max_size=80).map("".join))
def test_ids_equal_reference(reference, text):
    ids = T.encoder()(text)
    assert ids == reference.encode_ordinary(text) and T.encoder().length(text) == len(ids)
    assert T.automaton().decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "=" * 9_999, " " * 5_000 + "x", "é" * 3_000, "日本" * 4_000])
def test_long_words_stay_linear(reference, text):
    assert T.encoder()(text) == reference.encode_ordinary(text)


def test_small_vocabulary_ties():
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")} | {b"aa": 3, b"ab": 4, b"aab": 5}
    auto = T.Automaton(ranks)

    def merges(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 99), i) for i in range(len(parts) - 1)), default=(99, 0))
            if best[0] == 99:
                return tuple(ranks[p] for p in parts)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for n in range(1, 7):
        for k in range(3**n):
            word = bytes(b"abc"[k // 3**i % 3] for i in range(n))
            assert auto.word(word) == merges(word)


def test_tables(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "y"), (3, None, "z"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    rows = T.encode_texts(df).collect()
    assert [len(r.ids) for r in rows] == [2, 0, 0, 2] and T.encode_texts(df).dtypes[-1] == ("ids", "array<int>")
    assert [r.text for r in T.decode_ids(T.encode_texts(df)).collect()] == ["hello world", "", "", "hello world"]
    assert [r.n_tokens for r in T.count_tokens(df).collect()] == [2, 0, 0, 2]
    assert T.encode_texts(df.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(20, 40))
def test_first_fit_decreasing(sizes, capacity):
    got = P.first_fit_decreasing(sizes, capacity)
    rooms: list[int] = []
    want = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(rooms) if r >= sizes[i]), len(rooms))
        if k == len(rooms):
            rooms.append(capacity)
        rooms[k] -= sizes[i]
        want[i] = k
    assert got == want


def test_pack(spark):
    items = spark.createDataFrame([(i, n) for i, n in enumerate([5, 3, 3, 12, 0, 25, None, 10])] + [(0, 5)], "doc_id long, n_tokens int")
    windows = spark.createDataFrame([("w", 10), ("v", 4), ("none", None), (None, 3), ("zero", 0), ("w", 10)], "window_name string, capacity_tokens int")
    rows = P.pack(items, windows).collect()
    assert {r.window_name for r in rows} == {"w", "v"}
    for name, capacity in (("w", 10), ("v", 4)):
        mine = [r for r in rows if r.window_name == name]
        fill: dict = {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        assert max(fill.values()) <= capacity and sum(fill.values()) == 5 + 3 + 3 + 12 + 25 + 10 + 5
        assert all(len([r for r in mine if r.doc_id == d]) == 1 for d, n in ((1, 3), (2, 3)) if n <= capacity)
        cut = sorted((r.start_token, r.n_tokens) for r in mine if r.doc_id == 5)
        assert [a for a, _ in cut] == list(range(0, 25, capacity)) and sum(n for _, n in cut) == 25
    assert P.pack(items.where("false"), windows).count() == 0 and P.pack(items, windows.where("false")).count() == 0
    grouped = P.pack(spark.range(500).selectExpr("id as doc_id", "cast(id % 9 as int) as n_tokens"), windows, group_items=50)
    assert grouped.where("window_name = 'w'").selectExpr("sum(n_tokens)").first()[0] == sum(i % 9 for i in range(500))


def test_table_gives_every_label_its_own_id():
    auto = T.automaton(T.VOCABULARY)
    labels = sorted(auto.ids, key=auto.ids.get)[::37]
    assert all(auto.word(x) == (auto.ids[x],) for x in labels)
    assert len(auto._states) > len(labels) / 4 and set(auto._table.values()) <= set(range(len(auto._states)))
