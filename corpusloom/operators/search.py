"""Exact nearest vectors for a set of queries, context under a budget, and prompts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a block of queries and of a shard of the index; two of them are compared in one task.
QUERY_BLOCK, INDEX_SHARD = 2_000, 50_000
HEAD = "==== CONTEXT ====\nRetrieved from the indexed repositories:\n\n"
TAIL = "\n=================\n"
SYSTEM = "You answer questions about code. Use only the given context and say so if it does not suffice."
NO_CONTEXT = "Nothing in the index matches this question."


def top_k(queries: DataFrame, index: DataFrame, k: int, id_: str, vector: str, metric: str = "cosine", within: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best of `index` (id, vector) for each of `queries` (id, vector).

    With `within`, a column of both, each query is compared only with rows of its own value there; a
    null value equals none.

    metric: cosine (higher is nearer; pairs with a zero vector have no score and are left out) or l2
    (squared distance, lower is nearer). Scores are in double precision, rounded to six decimals;
    among equals the smaller id is nearer. Null vectors and vectors of another length than the
    query's take no part. Queries are cut into blocks and the index into shards; every pair of them
    gives its best k, which are then merged, so that no task sees more than one of each.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(metric)
    kind = dict(index.dtypes)[id_]
    n_queries, n_index = queries.count(), index.count()
    blocks, shards = max(1, math.ceil(n_queries / QUERY_BLOCK)), max(1, math.ceil(n_index / INDEX_SHARD), min(8, math.ceil(n_index / 500)))
    part = lambda n, salt: F.pmod(F.xxhash64(F.col(id_), F.lit(salt)), F.lit(n)).cast("int")
    own = [F.col(within).alias("own")] if within else []
    if within:
        queries, index = queries.where(F.col(within).isNotNull()), index.where(F.col(within).isNotNull())
    q = queries.where(F.col(vector).isNotNull()).select(*own, F.col(id_).alias("id"), F.col(vector).alias("vector"), part(blocks, 1).alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    x = index.where(F.col(vector).isNotNull()).select(*own, F.col(id_).alias("id"), F.col(vector).alias("vector"), part(shards, 2).alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compare(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, group in qs.groupby(qs["vector"].map(len)) if len(qs) else ():
            those = xs[xs["vector"].map(len) == size]
            if not len(those) or not size:
                continue
            a, b = (np.vstack(d["vector"]).astype(np.float64) for d in (group, those))
            ids = those["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            b, ids = b[order], ids[order]
            if metric == "cosine":
                scale = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(scale > 0, (a @ b.T) / scale, np.nan)
            else:
                score = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)
            score = np.round(score, 6)
            cost = np.where(np.isnan(score), np.inf, -score if metric == "cosine" else score)
            best = np.argsort(cost, axis=1, kind="stable")[:, :k]
            real = np.isfinite(np.take_along_axis(cost, best, 1))
            asked = np.repeat(group["id"].to_numpy()[:, None], best.shape[1], 1)
            out.append(pd.DataFrame({"query_id": asked[real], "id": ids[best][real], "score": np.take_along_axis(score, best, 1)[real]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    keys = ["own", "block", "shard"] if within else ["block", "shard"]
    near = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(compare, f"query_id {kind}, id {kind}, score double")
    best = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    rank = W.partitionBy("query_id").orderBy(best, "id")
    return near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def section(rank: Column, hit: dict[str, Column], distance: Column | None = None) -> Column:
    """One hit as text; missing fields are shown as Unknown, a missing distance as N/A."""
    known = lambda c: F.coalesce(hit[c], F.lit("Unknown"))
    far = F.lit("") if distance is None else F.concat(F.lit("Distance: "), F.when(distance.isNotNull(), F.format_string("%.6f", distance)).otherwise(F.lit("N/A")), F.lit("\n"))
    return F.concat(
        F.lit("Result "), rank.cast("string"), F.lit("\nType: "), known("symbol_type"), F.lit("\nName: "), known("symbol_name"), F.lit("\nFile: "), known("file"), F.lit("\nLanguage: "), known("language"), F.lit("\n"),
        far, F.lit("\n"), F.coalesce(hit["retrieval_text"], F.lit("")), F.lit("\n\n" + "-" * 60 + "\n"),
    )


def _running(sections: DataFrame, query: str, rank: str, text: str) -> DataFrame:
    run = W.partitionBy(query).orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    return sections.withColumn("used", F.sum(F.length(text)).over(run))


def within_budget(sections: DataFrame, query: str = "query_id", rank: str = "rank", text: str = "section", budget: int = 12_000) -> DataFrame:
    """The first sections of each query whose lengths together stay within the budget.

    It ends at the first that does not fit. Lengths are positive, so that this is where the
    running sum passes the budget.
    """
    return _running(sections, query, rank, text).where(F.col("used") <= budget)


def contexts(sections: DataFrame, query: str = "query_id", rank: str = "rank", text: str = "section", budget: int = 12_000) -> DataFrame:
    """(query, context): the sections within the budget joined in order; the body is empty where the first does not fit."""
    kept = F.collect_list(F.when(F.col("used") <= budget, F.struct(rank, text)))  # nulls are left out; the budget bounds the list
    body = F.array_join(F.transform(F.array_sort(kept), lambda s: s[text]), "\n")
    return _running(sections, query, rank, text).groupBy(query).agg(F.concat(F.lit(HEAD), body, F.lit(TAIL)).alias("context"))


def prompt(context: Column, question: Column, system: str = "") -> Column:
    """The prompt for a model; an empty system text means the default one."""
    return F.concat(F.lit((system or SYSTEM) + "\n\n"), F.coalesce(context, F.lit(NO_CONTEXT)), F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer:"))


def hashed_embedding(df: DataFrame, text: str, out: str = "embedding", size: int = 384) -> DataFrame:
    """df with a unit vector per text by hashing its words; null for null. No model is needed."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for batch in texts:
            rows = []
            for t in batch:
                if t is None:
                    rows.append(None)
                    continue
                v = np.zeros(size, np.float32)
                for w in t.lower().split():
                    h = xxhash.xxh3_64_intdigest(w)
                    v[h % size] += 1 if h >> 63 else -1
                n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
                rows.append((v / n if n else v).tolist())
            yield pd.Series(rows)

    return df.withColumn(out, embed(F.col(text)))
