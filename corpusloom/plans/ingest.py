"""From a tree of files to an index that can be searched."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as ft
from corpusloom.functions.rules import CANDIDATE_TYPES
from corpusloom.operators import registry, search
from corpusloom.operators.members import with_export_flag, with_members
from corpusloom.operators.symbols import symbols
from corpusloom.schema import REGISTRY
from corpusloom.settings import Settings
from corpusloom.sources.tree import readable, scan

Embed = Callable[..., DataFrame]


def enriched(found: DataFrame) -> DataFrame:
    """Symbols with keywords, description, related members and the candidate flag; what the file's exports name is exported."""
    found = with_export_flag(found).withColumn("exported", F.col("is_exported")).drop("is_exported")
    names = ("repo", "file", "symbol_name", "parent_symbol", "symbol_type", "signature", "content", "docstring", "imports")
    related = with_members(found).select("chunk_id", "members")
    s = found.join(related, "chunk_id", "left")
    c = {n: F.col(n) for n in names} | {"uses": ft.dependencies(F.col("content"), F.col("imports"))}
    clean = ft.clean_docstring(F.col("docstring"))
    kind = F.col("symbol_type")
    described = (
        F.when(kind.isin("function", "method"), ft.function_description(c))
        .when(kind.isin("class", "struct", "trait", "interface"), ft.class_description(c, F.coalesce("members", F.array().cast("array<string>"))))
        .when(kind == "enum", ft.enum_description(c))
        .when(kind == "chunk", ft.chunk_description(c))
        .otherwise(ft.retrieval_sentence(F.col("language"), kind, c["symbol_name"], c["parent_symbol"], c["file"]))
    )
    return s.select(*found.columns, F.col("members").alias("related_symbols"), ft.keywords(c["symbol_name"], c["signature"], clean, c["imports"]).alias("keywords"), described.alias("retrieval_text"), kind.isin(*CANDIDATE_TYPES).alias("embedding_candidate"))


def ingest(spark: SparkSession, root: str, repo: str, out: str, settings: Settings = Settings()) -> None:
    """Reads a tree and writes its symbols below `out`, in one folder per repository; `out` itself is never read as a part of the tree."""
    files = readable(scan(spark, root, repo, settings, own=(os.path.abspath(out) if "://" not in out else out,)), settings)
    _write(enriched(symbols(files)), f"{out}/symbols")


def index(spark: SparkSession, out: str, size: int = 384, embed: Embed = search.hashed_embedding, repo: str | None = None) -> None:
    """Embeds the candidates below `out`, of one repository or of all, and puts them in place of their repositories' part of the index.

    `embed` adds a column `embedding` of `size` numbers to a DataFrame from one of its text columns.
    """
    rows = spark.read.parquet(f"{out}/symbols").where("embedding_candidate and retrieval_text is not null")
    rows = rows.where(F.col("repo") == repo) if repo else rows
    kept = rows.select("chunk_id", "symbol_id", "repo", "symbol_name", "symbol_type", "file", "language", "signature", "keywords", "retrieval_text")
    _write(embed(kept, "retrieval_text", size=size), f"{out}/index")


def ask(spark: SparkSession, out: str, questions: DataFrame, k: int = 20, budget: int = 12_000, repo: str | None = None, size: int = 384, embed: Embed = search.hashed_embedding) -> DataFrame:
    """(question, prompt) for each of `questions` (question): k hits, one context under the budget.

    A repository of which nothing is indexed is a LookupError.
    """
    rows = spark.read.parquet(f"{out}/index")
    if repo:
        rows = rows.where(F.col("repo") == repo)
        if rows.isEmpty():
            raise LookupError(f"nothing is indexed of {repo}")
    asked = embed(questions.select(F.col("question").alias("chunk_id"), "question").distinct(), "question", size=size)
    hits = search.top_k(asked.select("chunk_id", "embedding"), rows.select("chunk_id", "embedding"), k, "chunk_id", "embedding")
    shown = hits.join(rows.drop("embedding"), hits["id"] == rows["chunk_id"]).withColumn("section", search.section(F.col("rank"), {c: F.col(c) for c in ("symbol_type", "symbol_name", "file", "language", "retrieval_text")}, F.col("score")))
    found = search.contexts(shown, budget=budget)
    return questions.select("question").distinct().join(found, F.col("question") == F.col("query_id"), "left").select("question", search.prompt(F.col("context"), F.col("question")).alias("prompt"))


def _write(df: DataFrame, path: str, by: str = "repo") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def registered(spark: SparkSession, out: str) -> DataFrame:
    """One row per repository below `out`; none where there is no registry, and files that cannot be read count as missing."""
    try:
        return spark.read.schema(REGISTRY).option("ignoreCorruptFiles", True).parquet(f"{out}/registry").select(REGISTRY.names)
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], REGISTRY)


def register(spark: SparkSession, out: str, repo: str, url: str | None = None, force: bool = False) -> None:
    """Registers a repository as `indexing`, with zero counts.

    One that is indexed already is a ValueError, unless `force` deletes it first; one whose
    indexing did not end may be registered again.
    """
    if not registered(spark, out).where((F.col("name") == repo) & (F.col("status") == "indexed")).isEmpty():
        if not force:
            raise ValueError(f"{repo} is indexed already")
        delete(spark, out, repo)
    fresh = spark.createDataFrame([(repo, url)], "name string, url string")
    zero = {c: F.lit(0) for c in ("symbol_count", "file_count", "embedding_count")}
    rows = registry.register(spark.createDataFrame([], REGISTRY), fresh, collection=F.lit(repo), status=F.lit("indexing"), **zero).drop("url")
    _write(rows.join(fresh, "name").select(REGISTRY.names).coalesce(1), f"{out}/registry", "name")


def finish(spark: SparkSession, out: str, repo: str, version: str = "1", model: str = "hashed words") -> None:
    """Registers a repository as `indexed`, with the counts of what is below `out`."""
    mine, name = F.col("repo") == repo, F.lit(repo).alias("name")
    found, indexed = spark.read.parquet(f"{out}/symbols").where(mine), spark.read.parquet(f"{out}/index").where(mine)
    languages = found.groupBy(name, F.coalesce("language", F.lit("unknown")).alias("language")).count()
    languages = languages.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("language", "count"))).alias("language_breakdown"))
    state = spark.createDataFrame([(repo, "indexed", version, model)], "name string, status string, index_version string, embedding_model string").withColumn("indexed_at", F.current_timestamp())
    for counts in (found.groupBy(name).agg(F.count("*").alias("symbol_count"), F.countDistinct("file").alias("file_count")), indexed.groupBy(name).agg(F.count("*").alias("embedding_count")), languages):
        state = state.join(counts, "name", "left")
    row = registry.change(registered(spark, out).where(F.col("name") == repo), state)
    _write(spark.createDataFrame(row.collect(), REGISTRY), f"{out}/registry", "name")  # a row, read before its file is replaced


def delete(spark: SparkSession, out: str, repo: str) -> None:
    """Removes a repository's symbols, its part of the index and its entry; what is missing changes nothing."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo)
    for part in (f"symbols/repo={name}", f"index/repo={name}", f"registry/name={name}"):
        path = jvm.org.apache.hadoop.fs.Path(f"{out}/{part}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
