"""Row types of the main tables."""

from pyspark.sql import types as T

SYMBOL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("repo", "file", "language", "symbol_type", "symbol_name", "parent_symbol")]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line")]
    + [T.StructField("content", T.StringType()), T.StructField("imports", T.ArrayType(T.StringType())), T.StructField("exports", T.ArrayType(T.StringType())), T.StructField("docstring", T.StringType()), T.StructField("chunk_id", T.StringType())]
    + [
        T.StructField(
            "metadata",
            T.StructType([T.StructField("is_async", T.BooleanType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("ast_parse_failure", T.BooleanType())]),
        )
    ]
    + [T.StructField("exported", T.BooleanType()), T.StructField("embedding_candidate", T.BooleanType()), T.StructField("signature", T.StringType()), T.StructField("symbol_id", T.StringType())]
)

REGISTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "url", "collection", "status")]
    + [T.StructField("indexed_at", T.TimestampType())]
    + [T.StructField(n, T.LongType()) for n in ("symbol_count", "file_count", "embedding_count")]
    + [T.StructField(n, T.StringType()) for n in ("index_version", "embedding_model")]
    + [T.StructField("language_breakdown", T.MapType(T.StringType(), T.LongType()))]
)
