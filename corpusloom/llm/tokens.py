"""Encoding texts with a public byte-level BPE vocabulary.

The merges are compiled once, gadget by gadget in their order, into an automaton over tokens. Its
states are the last token emitted; the gadget of a merge (u, v) says that from then on whatever ends
in a live u may no longer be followed by whatever starts with a live v. What remains are the arcs
between tokens that can stand side by side, and every word is the label of exactly one path.

That automaton is made deterministic over bytes: a state holds the beginnings of tokens that may
be under way, each with the token before it, and the one token with which the bytes read so far
end. Its transitions are kept in a table that is filled as states are reached; beginnings that no
token continues are pruned, so that a state says no more than the future can tell apart. A word is
encoded by one table step per byte, and its tokens are read back from the last. Decoding emits labels.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's words are cut before merging; a fixed value that belongs to the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept encoded in a worker, and states in the table; beyond it they start anew, which changes speed only.
MEMO_WORDS = 400_000
NEVER = 1 << 60


class Automaton:
    """The compiled merges of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.labels = {i: label for label, i in ranks.items()}
        self._begun = {label[:n] for label in ranks for n in range(1, len(label))}
        self._arcs: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.words = regex.compile(WORDS)
        self.parts: dict[int, tuple[int, int]] = {}
        self.gadgets: dict[tuple[int, int], int] = {}
        self._compile()
        self._forget()

    def _compile(self) -> None:
        """Adds the gadget of each merge; which two tokens it joins follows from the earlier ones."""
        for label, merged in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(label) < 2:
                continue
            pair = self._two_parts(label)
            if pair:
                self.parts[merged] = pair
                self.gadgets[pair] = merged

    def _two_parts(self, label: bytes) -> tuple[int, int] | None:
        """The two tokens left of `label` once all merges before its own are done."""
        pieces = [self.ids[label[i : i + 1]] for i in range(len(label))]
        gadgets = self.gadgets
        while len(pieces) > 2:
            found = [(m, i) for i in range(len(pieces) - 1) if (m := gadgets.get((pieces[i], pieces[i + 1]))) is not None]
            if not found:
                return None
            first, i = min(found)
            pieces[i : i + 2] = [first]
        return (pieces[0], pieces[1])

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens that once stood at an edge of `token`, each with the merge that ended it."""
        key = (token, right)
        if key not in self._edges:
            edge, until = [], NEVER
            while True:
                edge.append((token, until))
                if token not in self.parts:
                    break
                until, token = token, self.parts[token][right]
            self._edges[key] = edge
        return self._edges[key]

    def arc(self, before: int, after: int) -> bool:
        """Whether no gadget forbids `after` behind `before`."""
        key = (before, after)
        open_ = self._arcs.get(key)
        if open_ is None:
            open_ = True
            for u, u_ends in self._edge(before, True):
                for v, v_ends in self._edge(after, False):
                    merged = self.gadgets.get((u, v))
                    # merges run from the left: one that has the same rank ends u, but not yet v
                    if merged is not None and merged < u_ends and merged <= v_ends:
                        open_ = False
                        break
                if not open_:
                    break
            if len(self._arcs) > 4 * MEMO_WORDS:
                self._arcs.clear()
            self._arcs[key] = open_
        return open_

    def _forget(self) -> None:
        """An empty table: of each state the beginnings under way with the token before them, and the token it ends with."""
        self._table: dict[int, int] = {}
        self._states: list[tuple[tuple[bytes, int], ...]] = [((b"", -1),)]
        self._ends: list[int] = [-1]
        self._numbers = {self._states[0]: 0}

    def _reach(self, state: int, byte: int) -> int:
        """The state behind `state` and `byte`, entered into the table."""
        on = bytes((byte,))
        last, alive = -1, []
        for begun, before in self._states[state]:
            label = begun + on
            token = self.ids.get(label)
            if last < 0 and token is not None and (before < 0 or self.arc(before, token)):
                last = token
            if label in self._begun:
                alive.append((label, before))
        if last < 0:
            raise ValueError("the vocabulary has no token for some byte")
        alive.append((b"", last))
        key = tuple(alive)
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._states)
            self._states.append(key)
            self._ends.append(last)
        self._table[state << 8 | byte] = number
        return number

    def word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-split word."""
        if len(self._states) > MEMO_WORDS:
            self._forget()
        table, ends, state, path = self._table, self._ends, 0, []
        for byte in word:
            next_ = table.get(state << 8 | byte)
            state = self._reach(state, byte) if next_ is None else next_
            path.append(ends[state])
        out, at = [], len(word)
        while at:
            token = path[at - 1]
            out.append(token)
            at -= len(self.labels[token])
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens are ordinary text."""
        out: list[int] = []
        known = self._known
        for word in self.words.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = self.word(word.encode("utf-8", "replace"))
                if len(word) < 50:
                    if len(known) > MEMO_WORDS:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text whose labels are emitted along the arcs `ids`."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


#: A space before something that is no white space always begins a word, so that texts may be cut there.
_CUT = regex.compile(r" (?=\S)")


class _Memo(dict):
    """Pieces of texts with their ids; a missing piece is encoded by the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > MEMO_WORDS:
            self.clear()
        ids = tuple(self.automaton.encode(piece))
        if len(piece) < 200:
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=4)
def automaton(vocabulary: str = VOCABULARY) -> Automaton:
    """The automaton of a vocabulary file with lines of base64 token and rank."""
    with open(vocabulary, "rb") as lines:
        return Automaton({base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())})


@functools.lru_cache(maxsize=4)
def _memo(vocabulary: str) -> tuple[_Memo, _Memo]:
    auto = automaton(vocabulary)
    return _Memo(auto), _Memo(auto)


def pieces(text: str) -> tuple[str, list[str]]:
    """A text cut into its first piece and those that each begin with a dropped space."""
    if "  " in text or " \n" in text or not text.isascii():
        first, *rest = _CUT.split(text)
    else:
        first, *rest = text.split(" ")
        if not all(rest) or any(x[0].isspace() for x in rest):
            first, *rest = _CUT.split(text)
    return first, rest


class Encoder:
    """Encodes and measures texts by a memo over the automaton."""

    def __init__(self, vocabulary: str = VOCABULARY):
        auto = automaton(vocabulary)
        self.first = _Memo(auto)
        self.rest = _Spaced(auto)

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        first, rest = pieces(text)
        out = list(self.first[first])
        memo = self.rest
        for piece in rest:
            out += memo[piece]
        return out

    def length(self, text: str) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        first, rest = pieces(text)
        return len(self.first[first]) + sum(map(len, map(self.rest.__getitem__, rest)))


class _Spaced(_Memo):
    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > MEMO_WORDS:
            self.clear()
        ids = tuple(self.automaton.encode(" " + piece))
        if len(piece) < 200:
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, drop: bool = True) -> DataFrame:
    """df with the token ids of column `text` as array<int> in column `ids`.

    Null and empty texts give an empty list. Any other columns pass through unchanged;
    an existing column named like `ids` is replaced. `drop` leaves the text out.
    """
    keep = [c for c in df.columns if c != ids and not (drop and c == text)]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in source.dtypes if c != "__text"] + [f"`{ids}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                flat, offsets = array("i"), [0]
                for t in part.column(len(keep)).to_pylist():
                    if t:
                        flat.extend(encode(t))
                    offsets.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(flat), pa.int32()) if flat else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*keep, ids])

    return source.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", count: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without its text, but with the text's number of tokens (0 for null and empty texts)."""
    keep = [c for c in df.columns if c not in (count, text)]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in source.dtypes if c != "__text"] + [f"`{count}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = encoder(vocabulary).length
        for batch in batches:
            sizes = pa.array([length(t) if t else 0 for t in batch.column(len(keep)).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*keep, count])

    return source.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with column `text` decoded from the ids; a null or empty list gives an empty text."""
    keep = [c for c in df.columns if c not in (ids, text)]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))
    schema = ", ".join([f"`{c}` {t}" for c, t in source.dtypes if c != "__ids"] + [f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = automaton(vocabulary).decode
        for batch in batches:
            texts = pa.array([decode(x or []) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*keep, text])

    return source.mapInArrow(run, schema)
