"""The k most similar vectors of every vector, by NN-descent, and greedy search in the graph.

The descent starts from cells: vectors go to the cells of their nearest pivots, and the nearest
within a cell are linked. Pivots grow with the root of the table, so that a start costs and finds
about as much of a large graph as of a small one. Then come rounds of joins: every vector's
neighbours, in either direction, are compared with each other, as far as one of the two links is
new; whoever is nearer than a known neighbour takes its place. The rounds end when hardly any list
changes, however many that takes. Cells only say where a comparison is made: a list is compared in
the cell where most of its members are at home, and each vector is sent once to every cell that
has it in a list.

Nodes are directions: vectors that differ in length only, or are equal, are one node, so that
copies cost no comparisons. Nodes are numbered in the order of their smallest ids, so that ties
are broken by number as they are by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.sources.stage import discard, materialise

#: Pivots, a random sample of the nodes: so many times the root of the nodes' number, but no more than one for so many nodes.
PIVOTS, CELL = 2, 64
#: Nearest pivots to whose cells a node goes.
PLACES = 3
#: Nodes that are compared in one task; cells of more are cut into parts, by another of their nodes' pivots as far as that goes.
PART = 16_384
#: Random trees by which a search enters a part of a cell, and nodes of a leaf.
TREES, LEAF = 4, 256
#: Similarities held at once.
BLOCK = 1 << 22
#: Neighbours kept in the graph beyond k, and new and old neighbours of a node that meet in a round.
SPARE, MEET = 6, 14
#: Decimals to which directions are told apart; vectors that agree have similarity 1 to nine decimals.
DECIMALS = 5
_LINK = "u long, u_cell long, v long, v_cell long, sim double"


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of a list column and their numbers: exactly `size` finite values, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
    at = np.nonzero(lengths == size)[0]
    if not len(at):
        return np.empty((0, size), np.float32), at
    flat = column.take(pa.array(at)).flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return np.ascontiguousarray(m[good]), at[good]


def _unit(m: np.ndarray, kind: type = np.float64) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True, initial=1e-300)  # no square over- or underflows
    m /= np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return m.astype(kind)


def _directions(m: np.ndarray) -> np.ndarray:
    """A hash of each vector's direction."""
    r = np.round(_unit(m), DECIMALS) + 0.0  # -0.0 as 0.0
    return np.fromiter((xxhash.xxh3_64_intdigest(row.tobytes()) - 2**63 for row in r), np.int64, len(m))


def _packed(m: np.ndarray) -> pa.Array:
    size = m.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(m))])


def _unpacked(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, size)


def _named(df: DataFrame, id_: str, vector: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, at = _matrix(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([pa.array(_directions(m), pa.int64()), batch.column(0).take(pa.array(at, pa.int64()))], names=["hash", "id"])

    return df.where(F.col(id_).isNotNull()).select(F.col(id_).cast("string"), vector).mapInArrow(run, "hash long, id string")


def _vectors(df: DataFrame, id_: str, vector: str, size: int, most: int | None = None) -> DataFrame:
    """Distinct directions of each batch with a packed vector; `most` keeps those with the lowest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, _ = _matrix(batch.column(0), size)
            h, first = np.unique(_directions(m), return_index=True)
            if most is not None:
                kept = ((h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)).astype(np.int64) < most
                h, first = h[kept], first[kept]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), _packed(m[first])], names=["hash", "vec"])

    return df.where(F.col(id_).isNotNull()).select(vector).mapInArrow(run, "hash long, vec binary")


def _nearest(m: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest pivots of each row, nearest first."""
    n, step = min(n, len(pivots)), max(1, BLOCK // len(pivots))
    out = [np.empty((0, n), np.int64)]
    for low in range(0, len(m), step):
        sims = _unit(m[low : low + step], np.float32) @ pivots.T
        best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def _leaves(m: np.ndarray, leaf: int, rng: np.random.Generator, led: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of m in the leaves of a random tree, and the rows of `led` that the same splits lead there.

    A node is split between two of its rows, and evenly where that is lopsided.
    """
    led = m[:0] if led is None else led
    todo = [(np.arange(len(m)), np.arange(len(led)))]
    while todo:
        at, also = todo.pop()
        if len(at) <= leaf:
            yield at, also
            continue
        a, b = rng.choice(len(at), 2, replace=False)
        across = m[at[a]] - m[at[b]]
        side = m[at] @ across
        right, bound = side > 0, 0.0
        if min(right.sum(), (~right).sum()) < 0.1 * len(at):
            order = np.argsort(side, kind="stable")
            right, bound = np.zeros(len(at), bool), side[order[len(at) // 2]]
            right[order[len(at) // 2 :]] = True
        beyond = led[also] @ across > bound
        todo += [(at[right], also[beyond]), (at[~right], also[~beyond])]


def _similarities(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows a and b of m in double precision."""
    norms, out = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64)), [np.empty(0)]
    for i in range(0, len(a), 4096):
        x, y = a[i : i + 4096], b[i : i + 4096]
        out.append(np.einsum("ij,ij->i", m[x].astype(np.float64), m[y].astype(np.float64)) / (norms[x] * norms[y]))
    return np.concatenate(out)


def _links(node: np.ndarray, cell: np.ndarray, u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"u": node[u], "u_cell": cell[u], "v": node[v], "v_cell": cell[v], "sim": sim})


class NeighbourGraph:
    """k nearest neighbours by cosine similarity of the usable vectors of a table.

    Rows with a null id, and vectors that are null, of another length, not finite or all zero take
    no part. Exact repeats count once; equal vectors under different ids have similarity 1, and so
    have vectors of one direction. Nearness is similarity in double precision rounded to nine
    decimals; among equals the smaller id is nearer. With k or fewer other vectors all are
    neighbours; an empty table gives none.
    """

    def __init__(self, df: DataFrame, id_: str = "symbol_id", vector: str = "embedding", size: int = 384, k: int = 10, rounds: int | None = None, enough: float = 0.0002, pivots: int | None = None):
        self.source, self.id, self.vector, self.size, self.k = df, id_, vector, size, k
        self.keep = k + SPARE
        self.changed: list[float] = []
        self._number()
        self._place(pivots)
        self.graph = self._start()
        while rounds is None or len(self.changed) < rounds:
            if not self._refine() or self.changed[-1] < enough:
                break

    def _number(self) -> None:
        """Numbers the ids in their order; a node has the smallest number of its ids."""
        named = _named(self.source, self.id, self.vector, self.size).distinct().repartitionByRange("id").sortWithinPartitions("id")
        named = materialise(named.withColumn("number", F.monotonically_increasing_id()), "knn-named")
        self.numbers = materialise(named.groupBy("hash").agg(F.min("number").alias("node")), "knn-numbers")
        self.n = self.numbers.count()
        self.members = materialise(named.join(self.numbers, "hash").select("node", "number", "id"), "knn-members")
        discard(named)

    def _place(self, pivots: int | None) -> None:
        """Every node with its vector and its nearest pivots."""
        size = self.size
        wanted = pivots or max(1, math.ceil(min(PIVOTS * math.sqrt(self.n), self.n / CELL)))
        share = min(1 << 30, math.ceil((wanted + 4 * math.sqrt(wanted)) / max(1, self.n) * (1 << 30)))
        rows = _vectors(self.source, self.id, self.vector, size, share).groupBy("hash").agg(F.first("vec").alias("vec")).orderBy("hash").limit(wanted).collect()
        if not rows:  # a table of few vectors
            rows = _vectors(self.source, self.id, self.vector, size).orderBy("hash").limit(1).collect()
        self.pivots = _unit(np.frombuffer(b"".join(bytes(r.vec) for r in rows), np.float32).reshape(-1, size), np.float32)
        shared = self.source.sparkSession.sparkContext.broadcast(self.pivots)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _nearest(_unpacked(batch.column(1), size), shared.value, PLACES).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.tolist(), pa.list_(pa.int32())), batch.column(1)], names=["node", "near", "vec"])

        once = _vectors(self.source, self.id, self.vector, size).join(self.numbers, "hash").dropDuplicates(["hash"]).select("node", "vec")
        self.nodes = materialise(once.mapInArrow(place, "node long, near array<int>, vec binary"), "knn-nodes", bucket="node")
        cells = self._cells(self.nodes)
        large = [r.pivot for r in cells.groupBy("pivot").count().where(F.col("count") > PART).collect()]
        counts = cells.where(F.col("pivot").isin(large)).groupBy("pivot", "other").agg(F.count("*").alias("n")).collect() if large else []
        self.parts = self._cut([(r.pivot, r.other, r.n) for r in counts])
        self.whole = not large

    def _cells(self, nodes: DataFrame, *columns: str) -> DataFrame:
        """(node, pivot, other) and `columns`: the cells of each of the nodes, and the nearest of its other pivots."""
        first, second = F.col("near")[0], F.coalesce(F.get("near", F.lit(1)), F.col("near")[0])
        return nodes.select("node", "near", *columns, F.explode("near").alias("pivot")).select("node", "pivot", F.when(F.col("pivot") == first, second).otherwise(first).alias("other"), *columns)

    def _cut(self, counts: list[tuple[int, int, int]]) -> DataFrame:
        """(pivot, other, first, n): the parts of a large cell to which its nodes that are near another pivot belong."""
        rows, at, last, room = [], -1, -1, 0
        for pivot, other, n in sorted(counts):
            if pivot != last or n > room:
                at, last, room = 0 if pivot != last else at + 1, pivot, PART
            several = math.ceil(n / PART)
            rows.append((pivot, other, pivot * 2**24 + at, several))
            at, room = at + several - 1, room - n if several == 1 else 0
        return self.source.sparkSession.createDataFrame(rows, "pivot int, other int, first long, n int")

    def _part(self, cells: DataFrame, name: str) -> DataFrame:
        """`cells` with the part to which the node belongs, in place of pivot and other."""
        whole = F.col("pivot").cast("long") * 2**24
        if self.whole:
            return cells.withColumn(name, whole).drop("pivot", "other")
        part = F.col("first") + F.pmod(F.xxhash64("node", "pivot"), F.col("n"))
        return cells.join(F.broadcast(self.parts), ["pivot", "other"], "left").withColumn(name, F.coalesce(part, whole)).drop("pivot", "other", "first", "n")

    def _placed(self, *columns: str) -> DataFrame:
        """The nodes with the part `own` of their nearest pivot's cell."""
        first = F.col("near")[0]
        return self._part(self.nodes.select("node", first.alias("pivot"), F.coalesce(F.get("near", F.lit(1)), first).alias("other"), *columns), "own")

    def _start(self) -> DataFrame:
        """Links every node to the nearest in each of its cells."""
        size, keep = self.size, self.keep
        places = self._part(self._cells(self._placed("near", "vec"), "own", "vec"), "cell")

        def compare(cell: pa.Table) -> pa.Table:
            node, own = cell["node"].to_numpy(), cell["own"].to_numpy()
            vectors = _unpacked(cell["vec"], size)
            single, n = _unit(vectors, np.float32), len(node)
            most, step, v = min(keep + 2, n), max(1, BLOCK // max(1, n)), [np.empty(0, np.int64)]
            for low in range(0, n, step):
                met = single[low : low + step] @ single.T  # single precision
                met[np.arange(len(met)), np.arange(low, low + len(met))] = -2
                v.append(np.argpartition(-met, most - 1, axis=1)[:, :most].ravel())
            u, v = np.repeat(np.arange(n), most), np.concatenate(v)
            u, v = u[u != v], v[u != v]
            return _links(node, own, u, v, _similarities(vectors, u, v))

        return materialise(self._top(places.groupBy("cell").applyInArrow(compare, _LINK).withColumn("fresh", F.lit(True))), "knn-graph")

    def _top(self, links: DataFrame) -> DataFrame:
        """The best neighbours of each node; a link that was known already stays known."""
        once = links.repartition("u").groupBy("u", "v").agg(*[F.first(c).alias(c) for c in ("u_cell", "v_cell", "sim")], F.min("fresh").alias("fresh"))
        by = W.partitionBy("u").orderBy(F.round("sim", 9).desc(), "v")
        return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= self.keep).select(*[x.split()[0] for x in _LINK.split(", ")], "fresh")

    def _both_ways(self, *columns: str) -> DataFrame:
        """(m, x, x_cell) and `columns`: the graph's links and, of those that lead to m, as many at most as meet in a round."""
        g = self.graph
        some = W.partitionBy("v").orderBy(F.col("fresh").desc(), F.xxhash64("u", "v"))
        back = g.withColumn("nth", F.row_number().over(some)).where(F.col("nth") <= 2 * MEET)
        ahead = g.select(F.col("u").alias("m"), F.col("v").alias("x"), F.col("v_cell").alias("x_cell"), *columns)
        return ahead.unionByName(back.select(F.col("v").alias("m"), F.col("u").alias("x"), F.col("u_cell").alias("x_cell"), *columns))

    def _refine(self) -> bool:
        """One round over the neighbours of neighbours; False if nothing was left to compare."""
        size, g = self.size, self.graph
        once = self._both_ways("fresh").repartition("m").groupBy("m", "x").agg(F.first("x_cell").alias("x_cell"), F.max("fresh").alias("fresh"))
        drawn = once.withColumn("nth", F.row_number().over(W.partitionBy("m", "fresh").orderBy(F.xxhash64("x", "m")))).where(F.col("nth") <= MEET)
        lists = drawn.groupBy("m").agg(F.mode("x_cell", True).alias("cell"), F.collect_list("x").alias("x"), F.collect_list("fresh").alias("fresh")).where(F.array_contains("fresh", True))
        lists = materialise(lists, "knn-lists")
        if lists.isEmpty():
            discard(lists)
            self.changed.append(0.0)
            return False
        wanted = lists.select("cell", F.explode("x").alias("node")).distinct()
        worst = g.groupBy(F.col("u").alias("node")).agg(F.min(F.round("sim", 9)).alias("worst"), F.count("*").alias("n")).select("node", F.when(F.col("n") == self.keep, F.col("worst")).otherwise(-2.0).alias("worst"))
        sent = self._placed("vec").select("node", "own", "vec").join(wanted.join(worst, "node").hint("shuffle_hash"), "node")

        def compare(lists: pa.Table, vectors: pa.Table) -> pa.Table:
            node, own, worst = (vectors[c].to_numpy() for c in ("node", "own", "worst"))
            order = np.argsort(node)
            node, own, worst = node[order], own[order], worst[order]
            packed = _unpacked(vectors["vec"], size)[order]
            single, n = np.concatenate([_unit(packed, np.float32), np.zeros((1, size), np.float32)]), len(node)
            bound = np.append(worst, 9.0) - 1e-6
            counts = np.array([len(x) for x in lists["x"].to_pylist()], np.int64)
            met = np.searchsorted(node, np.concatenate(lists["x"].to_numpy())) if len(counts) else np.empty(0, np.int64)
            new = np.concatenate(lists["fresh"].to_numpy()).astype(bool) if len(counts) else np.empty(0, bool)
            row, ends = np.repeat(np.arange(len(counts)), counts), np.concatenate([[0], np.cumsum(counts)])
            at = np.full((len(counts), 2 * MEET), n)
            fresh = np.zeros(at.shape, bool)
            nth = np.arange(len(met)) - ends[row]
            at[row, nth], fresh[row, nth] = met, new
            upper = np.triu(np.ones((2 * MEET, 2 * MEET), bool), 1)
            keys = []
            for low in range(0, len(at), 256):
                x, f = at[low : low + 256], fresh[low : low + 256]
                sims = np.matmul(single[x], single[x].transpose(0, 2, 1))
                better = (sims > bound[x][:, :, None]) | (sims > bound[x][:, None, :])
                r, i, j = np.nonzero(better & upper & (f[:, :, None] | f[:, None, :]) & (x < n)[:, :, None] & (x < n)[:, None, :])
                keys.append(np.minimum(x[r, i], x[r, j]) * n + np.maximum(x[r, i], x[r, j]))
            keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
            a, b = keys // max(1, n), keys % max(1, n)
            sim = _similarities(packed, a, b)
            u, v, sim = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim])
            near = np.round(sim, 9) >= worst[u]
            return _links(node, own, u[near], v[near], sim[near])

        found = materialise(lists.groupBy("cell").cogroup(sent.withColumnRenamed("cell", "at").groupBy("at")).applyInArrow(compare, _LINK), "knn-found")
        self.graph = materialise(self._top(g.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))), "knn-graph")
        discard(lists, found, g)
        self.changed.append(self.graph.where("fresh").count() / max(1, self.n * self.k))
        return True

    def _near(self) -> DataFrame:
        """(number, other, similarity, rank): the nearest of every id, by numbers."""
        few = self.members.withColumn("nth", F.row_number().over(W.partitionBy("node").orderBy("number"))).where(F.col("nth") <= self.k + 1).select("node", F.col("number").alias("other"))
        others = self.graph.select("u", F.col("v").alias("node"), F.round("sim", 9).alias("similarity")).join(few, "node").select("u", "other", "similarity")
        own = few.select(F.col("node").alias("u"), "other", F.lit(1.0).alias("similarity"))
        order = W.partitionBy("u").orderBy(F.col("similarity").desc(), "other")
        best = others.unionByName(own).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= self.k + 1)
        each = best.join(self.members.select(F.col("node").alias("u"), "number"), "u").where("number <> other")
        return each.withColumn("rank", F.row_number().over(W.partitionBy("u", "number").orderBy("nth"))).where(F.col("rank") <= self.k).select("number", "other", "similarity", "rank")

    def neighbours(self) -> DataFrame:
        """(id, neighbour, similarity, rank) of every id, copies included."""
        return self._with_ids(self._near(), number="id", other="neighbour").select("id", "neighbour", "similarity", "rank")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: of the two ids, one is among the nearest of the other."""
        pairs = materialise(self._near().select(F.least("number", "other").alias("a"), F.greatest("number", "other").alias("b")).distinct(), "knn-links")
        return self._with_ids(pairs, a="id_a", b="id_b").select("id_a", "id_b")

    def _with_ids(self, df: DataFrame, **names: str) -> DataFrame:
        for number, name in names.items():
            df = df.join(self.members.select(F.col("number").alias(number), F.col("id").alias(name)), number)
        return df

    def search(self, queries: DataFrame, k: int | None = None, beam: int | None = None, starts: int = 4) -> DataFrame:
        """(query_id, id, similarity, rank): the k nearest of each vector of `queries`, by greedy search.

        `queries` has the columns of the graph's table; its vectors need not be in the graph, unusable
        ones find nothing. Every search begins in the cells of its `starts` nearest pivots, at the leaves to
        which their random trees lead it (a graph of clusters has no ways between them), and keeps a
        list of the `beam` best nodes (2 k unless given); in a round, the neighbours, in either
        direction, of all that came into the list are compared, until no list gains a node. A row equal to
        the query is found as well. The queries' vectors are sent to the cells where candidates are,
        and each candidate's once to its own cell.
        """
        k, size = k or self.k, self.size
        beam = max(k, beam or 2 * k)
        spark = self.source.sparkSession
        none = "query_id string, id string, similarity double, rank int"
        if not len(self.pivots):
            return spark.createDataFrame([], none)
        shared = spark.sparkContext.broadcast(self.pivots)

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m, _ = _matrix(batch.column(0), size)
                q, first = np.unique(_directions(m), return_index=True)
                if len(q):
                    cells = _nearest(m[first], shared.value, starts)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), _packed(m[first]), pa.array(cells.tolist(), pa.list_(pa.int32()))], names=["q", "qvec", "homes"])

        def scored(asks: pa.Table, node: np.ndarray, row: np.ndarray, at: np.ndarray, m: np.ndarray, most: int | None = None) -> pa.Table:
            """Candidates (row of asks, row of m) with their similarities; of each ask only the `most` nearest."""
            q = _unit(_unpacked(asks["qvec"], size))
            sim = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", q[row[i : i + 4096]], m[at[i : i + 4096]]) for i in range(0, len(row), 4096))])
            if most is not None:
                order = np.lexsort((node[at], -np.round(sim, 9), row))
                row, at, sim = row[order], at[order], sim[order]
                near = np.arange(len(row)) - np.searchsorted(row, row) < most
                row, at, sim = row[near], at[near], sim[near]
            cell = asks["cell"][0].as_py() if len(asks) else 0
            return pa.table({"q": asks["q"].to_numpy()[row], "cell": np.full(len(row), cell, np.int64), "node": node[at], "sim": sim})

        def enter(asks: pa.Table, vectors: pa.Table) -> pa.Table:
            m, q = (_unit(_unpacked(t, size)) for t in (vectors["vec"], asks["qvec"]))
            keys = [np.empty(0, np.int64)]
            for tree in range(2 * TREES if len(asks) and len(vectors) else 0):
                for at, also in _leaves(m, LEAF, np.random.default_rng([tree, len(m)]), q):
                    keys.append((also[:, None] * len(m) + at).ravel())
            keys = np.unique(np.concatenate(keys))
            return scored(asks, vectors["node"].to_numpy(), keys // max(1, len(m)), keys % max(1, len(m)), m, beam)

        def step(asks: pa.Table, vectors: pa.Table) -> pa.Table:
            node = vectors["node"].to_numpy()
            order = np.argsort(node)
            lists = asks["nodes"].to_pylist()
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            at = np.searchsorted(node[order], np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64))
            return scored(asks, node[order], row, at, _unit(_unpacked(vectors["vec"], size)[order]))

        kind = "q long, cell long, node long, sim double"
        asked = materialise(queries.where(F.col(self.id).isNotNull()).select(self.vector).mapInArrow(begin, "q long, qvec binary, homes array<int>").dropDuplicates(["q"]), "knn-asked")
        ways = materialise(self._both_ways().withColumnRenamed("x_cell", "cell").dropDuplicates(["m", "x"]), "knn-ways")
        cut = self.parts.select(F.col("pivot").alias("home"), F.explode(F.expr("sequence(first, first + n - 1)")).alias("cell")).distinct()
        asks = asked.select("q", "qvec", F.explode("homes").alias("home")).join(F.broadcast(cut), "home", "left")
        asks = asks.select(F.coalesce("cell", F.col("home").cast("long") * 2**24).alias("cell"), "q", "qvec")
        sent = self._placed("vec").select(F.col("own").alias("at"), "node", "vec")
        new = asks.groupBy("cell").cogroup(sent.groupBy("at")).applyInArrow(enter, kind)
        seen, best, old = [], None, []
        by = W.partitionBy("q").orderBy(F.round("sim", 9).desc(), "node")
        while True:
            lists = new.withColumn("open", F.lit(True))
            lists = lists if best is None else lists.unionByName(best.withColumn("open", F.lit(False)))
            best = materialise(lists.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= beam).drop("nth"), "knn-best")
            discard(*old)
            seen = seen or [best.select("q", "node")]
            onward = best.where("open").select("q", F.col("node").alias("m")).join(ways, "m").select("q", F.col("x").alias("node"), "cell").distinct()
            known = seen[0]
            for more in seen[1:]:
                known = known.unionByName(more)
            wanted = materialise(onward.join(known, ["q", "node"], "left_anti"), "knn-wanted")
            if wanted.isEmpty():
                break
            old = [best] if len(seen) > 1 else []  # the first list is still read as seen
            seen.append(wanted.select("q", "node"))
            asks = wanted.groupBy("cell", "q").agg(F.collect_list("node").alias("nodes")).join(asked.select("q", "qvec"), "q")
            sent = self.nodes.select("node", "vec").join(wanted.select("node", F.col("cell").alias("at")).distinct(), "node")
            new = asks.groupBy("cell").cogroup(sent.groupBy("at")).applyInArrow(step, kind)
        few = self.members.withColumn("nth", F.row_number().over(W.partitionBy("node").orderBy("id"))).where(F.col("nth") <= k).select("node", "id")
        names = _named(queries, self.id, self.vector, size).distinct().select(F.col("hash").alias("q"), F.col("id").alias("query_id"))
        rank = W.partitionBy("q").orderBy(F.col("similarity").desc(), "id")
        near = best.join(few, "node").select("q", "id", F.round("sim", 9).alias("similarity")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        return near.join(names, "q").select("query_id", "id", "similarity", "rank")
