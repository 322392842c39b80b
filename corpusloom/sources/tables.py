"""The given Parquet tables of a data folder, and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table `name` of the folder, reduced to `columns` if any are given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def evenly(df: DataFrame) -> DataFrame:
    """df spread over all cores, if its files give fewer partitions than there are cores.

    For work that costs far more than moving its rows; a table of many files stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def json_rows(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of JSON files that each hold one array of objects.

    Fields that an object lacks are null, those that the schema lacks are left out, an empty array
    gives no row, and a missing path is an error. An array is read by one task, so large collections
    belong into many files, or into JSON lines.
    """
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Writes df as JSON lines, a file per partition, in place of what was there; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
