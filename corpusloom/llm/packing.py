"""Filling containers of fixed capacity with texts measured in tokens.

First-fit decreasing, run independently in randomised groups of documents. A tournament tree
over the free room of a group's containers finds the first that fits in logarithmic time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents per group: large enough that only a group's last containers stay partly empty.
GROUP_ITEMS = 8192
PLACED = "window_name string, capacity_tokens int, container string, doc_id long, piece int, start_token long, n_tokens int"


class Tournament:
    """Free room of containers in a complete binary tree; each node holds the most below it."""

    def __init__(self, containers: int, capacity: int):
        self.leaves = 1 << max(0, containers - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts `size` into the first container with enough room and returns its number."""
        most, node, leaves = self.most, 1, self.leaves
        while node < leaves:
            node *= 2
            if most[node] < size:
                node += 1
        place = node - leaves
        most[node] -= size
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            top = left if left > right else right
            if most[node] == top:
                break
            most[node] = top
        return place


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The container of each size; larger sizes are placed first, equal ones in the given order."""
    tree = Tournament(max(1, len(sizes)), capacity)
    out = [0] * len(sizes)
    for i in np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable").tolist():
        out[i] = tree.place(sizes[i])
    return out


def pack(items: DataFrame, windows: DataFrame, group_items: int = GROUP_ITEMS, seed: int = 11, n_items: int | None = None) -> DataFrame:
    """Places every item of `items` (doc_id, n_tokens) once per row of `windows` (window_name, capacity_tokens).

    An item above the capacity is cut into pieces of just that capacity and a rest; no other
    item is cut. Items of size null or 0 go, with size 0, into the first container of their
    group. Repeated rows are separate items. Windows without a name or a positive capacity take
    nothing; an empty side gives an empty result. `windows` is a list of container kinds and
    must stay below 1,000 rows. `n_items` is the number of items where the caller knows it, which
    saves measuring them twice; it decides only how many groups there are. Returns one row per piece: the container's name, the piece's
    number and first token, and its size.
    """
    kinds = windows.where("window_name is not null and capacity_tokens > 0").select("window_name", "capacity_tokens").distinct().limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 kinds of containers")
    items = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n_tokens"))
    if not kinds:
        return items.sparkSession.createDataFrame([], PLACED)
    groups = max(1, math.ceil((items.count() if n_items is None else n_items) / group_items))
    every = F.array(*[F.struct(F.lit(k.window_name).alias("window_name"), F.lit(k.capacity_tokens).cast("int").alias("capacity_tokens")) for k in sorted(kinds)])
    spread = items.withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).cast("int")).select("group", F.explode(every).alias("w"), "doc_id", "n_tokens").select("group", "w.*", "doc_id", "n_tokens")
    return spread.groupBy("group", "window_name", "capacity_tokens").applyInArrow(_fill, PLACED)


def _fill(key: tuple, rows: pa.Table) -> pa.Table:
    group, window, capacity = (x.as_py() for x in key)
    rows = rows.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
    sizes = rows["n_tokens"].to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.where(sizes > capacity, sizes // capacity, 0)
    rest = sizes - whole * capacity
    open_ = np.nonzero((rest > 0) | (sizes == 0))[0]
    places = np.asarray(first_fit_decreasing(rest[open_].tolist(), capacity), dtype=np.int64)
    used = int(places.max()) + 1 if len(places) else 0
    # whole pieces fill containers of their own, numbered behind the shared ones
    owner = np.repeat(np.arange(len(sizes)), whole)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    item = np.concatenate([open_, owner])
    piece = np.concatenate([whole[open_], number])
    size = np.concatenate([rest[open_], np.full(len(owner), capacity)])
    place = np.concatenate([places, used + np.arange(len(owner))])
    n = len(item)
    return pa.table({
        "window_name": pa.array([window] * n, pa.string()), "capacity_tokens": pa.array(np.full(n, capacity), pa.int32()),
        "container": pa.array([f"{group}-{p}" for p in place.tolist()], pa.string()), "doc_id": pa.array(rows["doc_id"].take(pa.array(item)).combine_chunks() if n else [], pa.int64()),
        "piece": pa.array(piece, pa.int32()), "start_token": pa.array(piece * capacity, pa.int64()), "n_tokens": pa.array(size, pa.int32()),
    })
