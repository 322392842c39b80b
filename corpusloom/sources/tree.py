"""Repository trees as DataFrames of files, whole or as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import files as ff
from corpusloom.settings import Settings

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def _bare(path: Column) -> Column:
    """A path without the scheme of its file system."""
    return F.regexp_replace(path, r"^[a-z0-9+.-]+:/{0,2}(?=/)", "")


def _plain(folder: str) -> str:
    return folder.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"


def _relative(path: Column, root: str) -> Column:
    """The path below `root`."""
    return F.substring_index(_bare(path), _plain(root), -1)


def _kept(files: DataFrame, path: Column, root: str, settings: Settings, own: Sequence[str]) -> DataFrame:
    """The files that no rule leaves out, judged by their path; what lies in `own` folders goes first."""
    for folder in own:
        files = files.where(~F.startswith(_bare(path), F.lit(_plain(folder))))
    return files.where(ff.ignore_rule(_relative(path, root), settings.ignored).isNull())


def scan(spark: SparkSession, root: str, repo: str, settings: Settings = Settings(), own: Sequence[str] = ()) -> DataFrame:
    """(repo, file, length, content) of every file below `root` that no ignore rule matches.

    Files below the folders `own`, such as this library's output, are left out whatever the rules
    are. Rules are tested on the metadata of the files, so that Spark drops what they match from
    the list of files before any content is read; the size limit is pushed into the scan. An empty
    tree gives an empty table.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= settings.most_bytes)
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    named = _kept(found, address, root, settings, own).withColumn("file", _relative(F.col("path"), root))
    return named.select(F.lit(repo).alias("repo"), "file", "length", "content")


def readable(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The text files among `files`, with decoded `text` and `language`."""
    found = ff.disposition(F.col("file"), F.col("content"), F.col("length"), settings.ignored, settings.binary_suffixes, settings.most_bytes)
    text = files.where(found.isin("text", "empty")).withColumn("text", ff.decoded(F.col("content")))
    return text.withColumn("language", ff.language(F.col("file"), F.col("text")))


def watch(spark: SparkSession, root: str, repo: str, settings: Settings = Settings(), own: Sequence[str] = (), per_trigger: int = 10_000) -> DataFrame:
    """The same as a stream of files as they arrive below `root`."""
    found = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(root).where(F.col("length") <= settings.most_bytes)
    named = _kept(found, F.col("path"), root, settings, own).withColumn("file", _relative(F.col("path"), root))
    return named.select(F.lit(repo).alias("repo"), "file", "length", "content")
