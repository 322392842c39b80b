"""The registered queries of this subpackage; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.llm import credentials, docpairs, handwritten, neardup, packing, personal, syntax, tokens
from corpusloom.llm.neighbours import NeighbourGraph
from corpusloom.sources.tables import evenly, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Places of credentials in code."""
    return credentials.find(evenly(table(spark, folder, "code_symbol", "chunk_id", "language", "content"))).select("chunk_id", "start_at").distinct()


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Contents with their credentials replaced, offsets kept; rows that hold any."""
    return credentials.redacted(evenly(table(spark, folder, "code_symbol", "chunk_id", "language", "content"))).where("credentials > 0").dropDuplicates(["chunk_id"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that were not written by hand in their project."""
    return _not_by_hand(spark, folder).where("reason is not null").select("repo", "file").distinct()


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Number of files per repository, and why they are not hand-written (null: they are)."""
    return _not_by_hand(spark, folder).distinct().groupBy("repo", "reason").agg(F.count("*").alias("n_files"))


def _not_by_hand(spark: SparkSession, folder: str) -> DataFrame:
    files = evenly(table(spark, folder, "source_file", "repo", "file", "text", "language"))
    return handwritten.reasons(files, table(spark, folder, "third_party_lib"), "repo", "file")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks whose texts are at least 0.7 similar."""
    return neardup.similar_pairs(_chunk_texts(spark, folder)).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b")).distinct()


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk that takes part with its class of equal texts, its group of linked classes, and its class's links."""
    return neardup.groups(*neardup.similar_classes(_chunk_texts(spark, folder))).withColumnRenamed("id", "chunk_id")


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    return evenly(table(spark, folder, "code_symbol", "chunk_id", "content", "retrieval_text")).select(F.col("chunk_id").alias("id"), neardup.text_of().alias("text")).where("id is not null")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are not valid in their language."""
    return _problems(spark, folder).where("kind is not null").select("repo", "file").distinct()


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    once = _problems(spark, folder).groupBy("repo", "file", "language").agg(F.max("kind").alias("kind"))
    return once.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("kind").alias("n_invalid"), F.round(F.count("kind") / F.count("*"), 6).alias("rate"))


def _problems(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.problems(evenly(table(spark, folder, "source_file", "repo", "file", "text", "language")), "repo", "file")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of symbols of which one is among the 10 nearest of the other."""
    return NeighbourGraph(table(spark, folder, "indexed_dataset", "symbol_id", "embedding")).pairs().toDF("symbol_id_a", "symbol_id_b")


def p5_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest others of every symbol whose id's hash is divisible by 50, by greedy search in the graph."""
    rows = table(spark, folder, "indexed_dataset", "symbol_id", "embedding")
    found = NeighbourGraph(rows).search(rows.where("pmod(xxhash64(symbol_id), 50) = 0"), k=11).where("query_id <> id")
    order = W.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", F.col("id").alias("symbol_id"), "similarity", "rank")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and methods that have real documentation."""
    return docpairs.pairs(_symbols(spark, folder)).select("chunk_id").distinct()


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code, signature and clean description of every documented function or method."""
    return docpairs.pairs(_symbols(spark, folder)).dropDuplicates(["chunk_id"])


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    return evenly(table(spark, folder, "code_symbol", "chunk_id", "symbol_type", "symbol_name", "language", "signature", "content", "docstring"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_texts(evenly(table(spark, folder, "documents", "doc_id", "text")))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The md5 of every document decoded from its ids."""
    decoded = tokens.decode_ids(tokens.encode_texts(evenly(table(spark, folder, "documents", "doc_id", "text"))))
    return decoded.select("doc_id", F.md5("text").alias("text_md5"))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in containers of each context window's capacity."""
    documents = table(spark, folder, "documents", "doc_id", "text")
    return packing.pack(tokens.count_tokens(evenly(documents)), table(spark, folder, "context_window"), n_items=documents.count())


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal items in documents."""
    return personal.find(evenly(table(spark, folder, "documents", "doc_id", "text"))).distinct()


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with typed placeholders for personal items."""
    return personal.redacted(evenly(table(spark, folder, "documents", "doc_id", "text")))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)}


_SEQUENCES = """(select chunk_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s from (select chunk_id, regexp_extract_all(lower(t), '[a-z0-9_]+') as w
    from (select distinct chunk_id, case when regexp_matches(content, '\\S') then content else retrieval_text end as t from code_symbol)) where len(w) >= 30)"""
_USABLE = """(select distinct symbol_id, embedding::double[] as v from indexed_dataset where len(embedding) = 384 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_max(embedding::double[]) - list_min(embedding::double[]) + abs(list_max(embedding::double[])) > 0)"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a result at all; the others are tested on fixtures and by round trips."""
    return {
        "p3_found": f"""with s as materialized {_SEQUENCES}, n as (select chunk_id, count(*) as n from s group by all), both_ as (select a.chunk_id as x, b.chunk_id as y, count(*) as c from s a join s b on a.s = b.s and a.chunk_id < b.chunk_id group by all)
            select x as chunk_id_a, y as chunk_id_b from both_ join n as p on p.chunk_id = x join n as q on q.chunk_id = y where c * 10 >= (p.n + q.n - c) * 7""",
        "p5_found": f"""with u as materialized {_USABLE}, r as (select a.symbol_id as x, b.symbol_id as y, row_number() over (partition by a.symbol_id order by round(list_cosine_similarity(a.v, b.v), 9) desc, b.symbol_id) as k from u a, u b where a.symbol_id <> b.symbol_id)
            select distinct least(x, y) as symbol_id_a, greatest(x, y) as symbol_id_b from r where k <= 10""",
        "p7_roundtrip": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
    }
