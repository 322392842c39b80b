"""Tables that cut lineage: written where every executor can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where none is set, a session on one machine gets a new local folder (tests); on a cluster,
    whose executors could not all read that, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when the writing ends; the table stands in for them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    Later steps restart from the table, so that losing an executor costs no more than
    the tasks it ran. With `bucket`, the table is bucketed by that column, one bucket per shuffle
    partition, so that later joins on it move only their other side. `discard` deletes a table;
    what is left of a session's tables is deleted when its driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    with _shuffles_freed(spark):
        if bucket is None:
            df.write.parquet(path)
        else:
            n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"t{uuid.uuid4().hex}"
            df.repartition(n, bucket).write.bucketBy(n, bucket).sortBy(bucket).option("path", path).saveAsTable(table)
    out = spark.table(table) if bucket else spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialise` that nothing will read any more."""
    for df in tables:
        path = _tables.pop(df, None)
        if path is not None:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_written() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the cluster's own cleaning of that folder remains
            return
