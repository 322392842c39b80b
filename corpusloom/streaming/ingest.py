"""Incremental ingest: files that arrive are parsed, enriched and merged by their chunk ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.symbols import symbols
from corpusloom.plans.ingest import enriched
from corpusloom.sources.tree import readable, watch


def follow(spark: SparkSession, root: str, repo: str, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes what is new below `root` and ends when nothing is left.

    A batch replaces the rows of the files that it holds. Batches are written to folders named by
    their number, so that a batch that is run again overwrites itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        enriched(symbols(readable(batch))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return watch(spark, root, repo).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The symbols of each file's last batch."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("repo", "file").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return rows.join(last, ["repo", "file", "batch"], "left_semi").drop("batch")
