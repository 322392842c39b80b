"""Class-like symbols with their members, and export flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_members(symbols: DataFrame) -> DataFrame:
    """Class-like symbols with `members`: the bare names of the symbols whose parent they are.

    Parent and child are matched by name within a file; members keep source order. Symbols
    without members get an empty list. Exact repeats of a symbol count once.
    """
    children = symbols.where("parent_symbol is not null").select("repo", "file", F.col("parent_symbol").alias("symbol_name"), "start_line", F.col("symbol_name").alias("child")).distinct()
    tail = F.element_at(F.split("child", r"\."), -1)
    lists = children.groupBy("repo", "file", "symbol_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", tail.alias("name")))), lambda s: s["name"]).alias("members"))
    owners = symbols.where(F.col("symbol_type").isin("class", "struct", "trait", "interface"))
    return owners.join(lists, ["repo", "file", "symbol_name"], "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>")))


def with_export_flag(symbols: DataFrame) -> DataFrame:
    """symbols with `is_exported`: flagged already, or named (also by its part before the first dot)
    in its file's export list; the list is an array beside it, so nothing is shuffled."""
    base = F.substring_index("symbol_name", ".", 1)
    listed = F.coalesce(F.array_contains("exports", F.col("symbol_name")) | F.array_contains("exports", base), F.lit(False))
    return symbols.withColumn("is_exported", F.coalesce("exported", F.lit(False)) | listed)
