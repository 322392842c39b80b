"""The registry of repositories: keyed tables that are merged, changed and cut as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(history: DataFrame, key: str = "name", at: str = "indexed_at") -> DataFrame:
    """The latest row per key, late arrivals in their place; rows without a time are the oldest.

    Among rows of one time the larger row, compared column by column, is taken.
    """
    fields = [c for c, t in history.dtypes if not t.startswith("map") and c != key]
    order = F.struct(F.col(at).isNotNull(), F.col(at), *[F.col(c) for c in fields if c != at])
    return history.groupBy(key).agg(F.max_by(F.struct(*[c for c in history.columns if c != key]), order).alias("row")).select(key, "row.*")


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """base with the rows of updates in place of, or beside, its own; keys of updates must be unique.

    A null key never matches. Running it twice changes nothing.
    """
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


def register(base: DataFrame, names: DataFrame, key: str = "name", **reset: Column) -> DataFrame:
    """base with a fresh row for each of `names`, whose columns are those of `reset`, else null."""
    rows = names.select(F.col(key)).distinct().select(key, *[reset.get(c, F.lit(None)).cast(base.schema[c].dataType).alias(c) for c in base.columns if c != key])
    return upsert(base, rows, key)


def change(base: DataFrame, changes: DataFrame, key: str = "name") -> DataFrame:
    """base with the non-null values of `changes` (key and some of its columns, one row per key)."""
    extra = [c for c in changes.columns if c != key]
    unknown = set(extra) - set(base.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    both = base.join(changes.select(key, *[F.col(c).alias(f"__{c}") for c in extra]), key, "left")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in extra else F.col(c) for c in base.columns])


def without(df: DataFrame, names: DataFrame, key: str, name: str = "name") -> DataFrame:
    """df without the rows that belong to `names`; names that it lacks change nothing."""
    return df.join(names.select(F.col(name).alias(key)).distinct(), key, "left_anti")
