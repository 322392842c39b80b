"""Near-duplicate records by an LSH forest of MinHash labels with exact verification.

Texts with equal sets of word sequences form a class; the search runs over classes. In every tree
a class has a label of min-hash bytes; the labels of a tree, sorted, are a prefix trie. Classes
that share a long prefix in some tree are compared first, on their whole sets. What is found says
how much is still missing: a pair of similarity s shares a prefix of d bytes in one of the trees
with a known probability, so that every pair found stands for one through that probability. The
prefixes are shortened byte by byte until the share found reaches the target. Places where more
than CROWD classes share a prefix are not compared all with all there; their classes are joined
exactly, on their rarest sequences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.sources.stage import discard, materialise

#: Bytes of a label, with which the search begins.
DEEPEST = 6
#: Classes that share a prefix and are still compared all with all.
CROWD = 500
#: Members of a class that are paired in one piece; larger classes are cut into blocks of about this size.
BLOCK = 1_000
_WORD = re.compile(r"[a-z0-9_]+", re.ASCII)
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x27D4EB2F165667C5)]
KNOWN_WORDS = 1_000_000


class _Words(dict):
    """64-bit hashes of words; emptied when it has grown large, which changes speed only."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def sequences(text: str | None, width: int, least: int) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of all `width` consecutive words; None below `least` words."""
    words = _WORD.findall(text.lower()) if text else []
    if len(words) < max(least, width):
        return None
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * _MIX[k % len(_MIX)]
        h ^= h >> np.uint64(29)
    return np.unique(h)


class Forest:
    """Labels of a set in every tree, and the depths between which prefixes are shortened."""

    def __init__(self, threshold: float, trees: int = 32, target: float = 0.999, seed: int = 5):
        self.threshold, self.trees, self.target = threshold, trees, target
        self.shallowest = DEEPEST
        while self.shallowest > 1 and self.met(threshold, self.shallowest) < target:
            self.shallowest -= 1
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**32, trees * DEEPEST, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, trees * DEEPEST, dtype=np.uint32)

    def met(self, similarity: float, depth: int) -> float:
        """Probability that two sets of a similarity share a prefix of `depth` bytes in some tree."""
        same = similarity + (1 - similarity) / 256  # unequal minima share their byte by chance
        return 1 - (1 - same**depth) ** self.trees

    def met_column(self, similarity: Column, depth: int) -> Column:
        return 1 - F.pow(1 - F.pow(similarity + (1 - similarity) / 256, F.lit(depth)), F.lit(self.trees))

    def labels(self, hashes: np.ndarray) -> np.ndarray:
        """One label per tree, its bytes from the highest down in a 64-bit number."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048, None] * self.a
            part += self.b
            part ^= part >> np.uint32(15)
            np.minimum(low, part.min(axis=0), out=low)
        low = (low * np.uint32(0x85EBCA6B)) >> np.uint32(24)
        paths = low.reshape(self.trees, DEEPEST).astype(np.uint64)
        out = np.zeros(self.trees, np.uint64)
        for k in range(DEEPEST):
            out |= paths[:, k] << np.uint64(56 - 8 * k)
        return out.astype(np.int64)


def prefix(label: str, depth: int) -> Column:
    """The first `depth` bytes of a label."""
    return F.shiftrightunsigned(label, 64 - 8 * depth)


def text_of(content: str = "content", instead: str = "retrieval_text") -> Column:
    """The compared text: `content`, or `instead` where content is null or blank."""
    return F.when(F.col(content).rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]"), F.col(content)).otherwise(F.col(instead))


def signed(texts: DataFrame, width: int, least: int, forest: Forest) -> DataFrame:
    """(id, text) as (id, class_id, paths), a label per tree; texts of too few words are left out by definition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, paths = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = sequences(text, width, least)
                if h is not None:
                    ids.append(i)
                    classes.append(xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63)
                    paths.append(forest.labels(h))
            flat = np.concatenate(paths) if paths else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * forest.trees, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(classes, pa.int64()), lists], names=["id", "class_id", "paths"])

    return texts.mapInArrow(run, "id string, class_id long, paths array<long>")


def _with_sequences(texts: DataFrame, width: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [np.empty(0, np.int64) if (h := sequences(t, width, least)) is None else h.view(np.int64) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets) if sets else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["class_id", "seqs"])

    return texts.mapInArrow(run, "class_id long, seqs array<long>")


def similar_classes(texts: DataFrame, tenths: int = 7, width: int = 3, least: int = 30, trees: int = 32, target: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id) and links (class_a, class_b, shared, total) of different classes.

    `texts` holds (id, text); exact repeats count once. Similarity is shared / total distinct sequences of `width`
    words and at least tenths/10 for every link; equal sets form one class. Texts of fewer than
    `least` words, null ones among them, are in neither result. Prefixes are shortened until the
    estimated share of the links that were found is `target`, and at most to the depth at which every
    link has that probability by itself; links within crowded places are all found.
    """
    forest = Forest(tenths / 10, trees, target)
    signed_ = materialise(signed(texts, width, least, forest), "neardup-signed")
    members = materialise(signed_.select("id", "class_id").distinct(), "neardup-members")
    classes = signed_.groupBy("class_id").agg(F.min("id").alias("id"), F.first("paths").alias("paths"))
    labels = classes.select("class_id", F.posexplode("paths").alias("tree", "label")).select(F.xxhash64("tree", prefix("label", forest.shallowest)).alias("place"), "label", "class_id")
    # most labels share no prefix with any other: they leave the trie before it is written
    trie = labels.withColumn("n", F.count("*").over(W.partitionBy("place"))).where("n > 1").select("place", "label", "class_id")
    trie = materialise(trie, "neardup-trie", bucket="place")
    first = materialise(classes.select("class_id", "id"), "neardup-classes")
    discard(signed_)

    links, tested, crowded = None, None, None
    for depth in range(DEEPEST, forest.shallowest - 1, -1):
        at = trie.select("place", prefix("label", depth).alias("prefix"), "class_id")
        met = at.groupBy("place", "prefix").agg(F.count("*").alias("n"), F.min("class_id").alias("class_a"), F.max("class_id").alias("class_b")).where("n > 1")
        two = met.where("n = 2").select("class_a", "class_b")
        many = at.join(met.where(F.col("n").between(3, CROWD)).select("place", "prefix"), ["place", "prefix"])
        more = many.alias("x").join(many.alias("y"), F.expr("x.place = y.place and x.prefix = y.prefix and x.class_id < y.class_id")).select(F.col("x.class_id").alias("class_a"), F.col("y.class_id").alias("class_b"))
        pairs = two.unionByName(more).distinct()
        pairs = materialise(pairs if tested is None else pairs.join(tested, ["class_a", "class_b"], "left_anti"), "neardup-pairs")
        found = _verified(pairs, first, texts, tenths, width, least)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        crowded = at.join(met.where(F.col("n") > CROWD).select("place", "prefix"), ["place", "prefix"]).select("class_id").distinct()
        told = links.agg(F.count("*").alias("n"), F.sum(1 / forest.met_column(F.col("shared") / F.col("total"), depth)).alias("all")).first()
        if told.n and told.n >= target * told.all:
            break
    crowded = materialise(crowded, "neardup-crowded")
    if not crowded.isEmpty():
        rest = _rare_pairs(crowded.join(first, "class_id"), texts, tenths, width, least).join(tested, ["class_a", "class_b"], "left_anti")
        links = links.unionByName(_verified(materialise(rest, "neardup-pairs"), first, texts, tenths, width, least))
    discard(trie)
    return members, links


def _sets(named: DataFrame, texts: DataFrame, width: int, least: int) -> DataFrame:
    """(class_id, seqs) of the classes `named` (class_id, id), from the text of their id."""
    return _with_sequences(named.join(texts, "id").dropDuplicates(["class_id"]).select("class_id", "text"), width, least)


def _verified(pairs: DataFrame, first: DataFrame, texts: DataFrame, tenths: int, width: int, least: int) -> DataFrame:
    """The pairs (class_a, class_b) that reach the threshold, with shared and total, from their whole sets."""
    named = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct().join(first, "class_id")
    sets = materialise(_sets(named, texts, width, least), "neardup-sets")
    both = pairs.join(sets.select(F.col("class_id").alias("class_a"), F.col("seqs").alias("a")), "class_a").join(sets.select(F.col("class_id").alias("class_b"), F.col("seqs").alias("b")), "class_b")
    shared = both.select("class_a", "class_b", F.size(F.array_intersect("a", "b")).alias("shared"), (F.size("a") + F.size("b")).alias("both"))
    links = materialise(shared.select("class_a", "class_b", "shared", (F.col("both") - F.col("shared")).alias("total")).where(F.col("shared") * 10 >= F.col("total") * tenths), "neardup-links")
    discard(sets)
    return links


def _rare_pairs(named: DataFrame, texts: DataFrame, tenths: int, width: int, least: int) -> DataFrame:
    """Pairs of the classes `named` among which all are that reach the threshold.

    Two sets can only be so similar if they share one of the rarest sequences of each: of n, the
    first n - ceil(n * tenths / 10) + 1 in the order of how many classes hold them.
    """
    held = materialise(_sets(named, texts, width, least).select("class_id", F.size("seqs").alias("n"), F.explode("seqs").alias("seq")), "neardup-held")
    common = held.groupBy("seq").agg(F.count("*").alias("held"))
    nth = F.row_number().over(W.partitionBy("class_id").orderBy("held", "seq"))
    rare = held.join(common.where("held > 1"), "seq", "left").withColumn("held", F.coalesce("held", F.lit(1))).withColumn("nth", nth)
    rare = materialise(rare.where(f"held > 1 and nth <= n - ceil(n * {tenths} / 10) + 1").select("seq", "class_id", "n"), "neardup-rare")
    like = f"x.seq = y.seq and x.class_id < y.class_id and least(x.n, y.n) * 10 >= greatest(x.n, y.n) * {tenths}"
    return rare.alias("x").join(rare.alias("y"), F.expr(like)).select(F.col("x.class_id").alias("class_a"), F.col("y.class_id").alias("class_b")).distinct()


def similar_pairs(texts: DataFrame, full: int | None = None, **how) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of different ids whose similarity reaches the threshold.

    All pairs come out. Classes of more than BLOCK members are cut into blocks, and every two blocks
    are paired on their own. With `full`, more than so many copies (ids of byte for byte equal
    texts) are paired with their first id only, and through that id with everything else.
    """
    members, links = similar_classes(texts, **how)
    ordered = lambda a, b: (F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))
    to_first = None
    if full is not None:
        copies = texts.groupBy("id").agg(F.sort_array(F.collect_set(F.sha2("text", 256))).alias("copy"))
        by = members.join(copies, "id")
        by = by.join(by.groupBy("class_id", "copy").agg(F.count("*").alias("n"), F.min("id").alias("first")), ["class_id", "copy"])
        to_first = by.where((F.col("n") > full) & (F.col("id") != F.col("first"))).select(*ordered("first", "id"))
        members = by.where((F.col("n") <= full) | (F.col("id") == F.col("first"))).select("id", "class_id")
    size = members.groupBy("class_id").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sized = members.join(size, "class_id").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    few, many = sized.where("n > 1 and blocks = 1"), sized.where("blocks > 1")
    equal = few.alias("a").join(few.alias("b"), F.expr("a.class_id = b.class_id and a.id < b.id")).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    one = many.select("class_id", F.col("id").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    other = many.select("class_id", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    within = one.join(other, ["class_id", "i", "j"]).where("i < j or x < y").select(*ordered("x", "y"))
    large = F.broadcast(size.withColumn("blocks", blocks).where("blocks > 1").select("class_id", "blocks"))  # one row per BLOCK ids at most
    cut = links.select("class_a", "class_b")
    for side in "ab":
        cut = cut.join(large.toDF(f"class_{side}", "blocks"), f"class_{side}", "left").withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    x = sized.select(F.col("class_id").alias("class_a"), F.col("block").alias("block_a"), F.col("id").alias("x"))
    y = sized.select(F.col("class_id").alias("class_b"), F.col("block").alias("block_b"), F.col("id").alias("y"))
    linked = cut.join(x, ["class_a", "block_a"]).join(y, ["class_b", "block_b"]).select(*ordered("x", "y"))
    pairs = equal.unionByName(within).unionByName(linked)
    return pairs if to_first is None else pairs.unionByName(to_first)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links) of every member.

    A group is a connected set of linked classes, named by its smallest class_id; a class without
    links is its own group. The smallest name spreads along links and along the names themselves
    (pointer jumping), so that rounds grow with the logarithm of a chain's length; each round is
    written to the shared folder.
    """
    both = links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).unionByName(links.select(F.col("class_b").alias("u"), F.col("class_a").alias("v")))
    both = materialise(both.distinct(), "groups-links")
    names = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("name"))
    names = materialise(names, "groups-names")
    while True:
        near = both.join(names.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("name").alias("near"))
        beyond = names.select(F.col("u").alias("name"), F.col("name").alias("beyond"))
        step = names.join(near, "u").join(beyond, "name", "left").select("u", F.least("name", "near", F.coalesce("beyond", "name")).alias("next"), F.col("name").alias("was"))
        step = materialise(step, "groups-names")
        moved = step.where("next <> was").limit(1).count()
        names = step.select("u", F.col("next").alias("name"))
        if not moved:
            break
    degree = both.groupBy("u").agg(F.count("*").alias("n"))
    named = names.join(degree, "u").select(F.col("u").alias("class_id"), "name", "n")
    return members.join(named, "class_id", "left").select("id", "class_id", F.coalesce("name", "class_id").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
