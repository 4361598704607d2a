"""Reciprocal-rank fusion of ranked channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rank constant and channel weights.
RANK_K = 60
LEXICAL_WEIGHT = 1.25
DENSE_WEIGHT = 1.0
DIGITS = 9


def reciprocal(rank: Column, weight: float = 1.0, k: int = RANK_K) -> Column:
    return F.lit(float(weight)) / (F.lit(float(k)) + rank)


def fuse(
    lexical: DataFrame,
    dense: DataFrame,
    limit: int,
    k: int = RANK_K,
    lexical_weight: float = LEXICAL_WEIGHT,
    dense_weight: float = DENSE_WEIGHT,
) -> DataFrame:
    """Fused candidates per query; both inputs are already top-k bounded."""
    if lexical_weight <= 0 or dense_weight <= 0:
        raise ValueError("fusion weights must be greater than zero")
    columns = ["query_id", "chunk_id", "lexical_score", "lexical_rank", "score", "dense_rank"]
    long = lexical.select(
        "query_id", "chunk_id", "lexical_score", "lexical_rank",
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("dense_rank"),
    ).unionByName(
        dense.select(
            "query_id", "chunk_id", F.lit(None).cast("double").alias("lexical_score"),
            F.lit(None).cast("int").alias("lexical_rank"), "score", "dense_rank",
        )
    )
    merged = long.groupBy("query_id", "chunk_id").agg(*[F.max(c).alias(c) for c in columns[2:]])
    value = F.coalesce(reciprocal(F.col("lexical_rank"), lexical_weight, k), F.lit(0.0)) + F.coalesce(
        reciprocal(F.col("dense_rank"), dense_weight, k), F.lit(0.0)
    )
    merged = merged.withColumn("fusion_score", F.round(value, DIGITS))
    arrival = F.coalesce(F.col("lexical_rank"), F.lit(1_000_000) + F.col("dense_rank"))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("fusion_score"),
        F.coalesce("lexical_score", F.lit(0.0)).desc(),
        F.coalesce("score", F.lit(0.0)).desc(),
        arrival.asc(),
    )
    return merged.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= limit)


def multi_query(runs: DataFrame, k: int = RANK_K) -> DataFrame:
    """Fuse several formulations of a question.

    *runs* has query_id, variant, rank, chunk_id, score. Variant 0 is the primary
    wording. The rank map is bounded by the number of variants.
    """
    per_variant = runs.groupBy("query_id", "chunk_id", "variant").agg(
        F.min("rank").alias("rank"),
        F.sum(reciprocal(F.col("rank"), 1.0, k)).alias("rrf"),
        F.max("score").alias("score"),
    )
    return per_variant.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("rrf"), DIGITS).alias("rrf_score"),
        F.max("score").alias("score"),
        F.min(F.when(F.col("variant") == 0, F.col("rank"))).alias("primary_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "rank")))).alias("variant_ranks"),
    )


def fuse_reranked(groups: DataFrame, top_n: int, k: int = RANK_K) -> DataFrame:
    """Merge reranked groups by best score plus reciprocal rank."""
    fused = groups.groupBy("query_id", "chunk_id").agg(
        F.max("rerank_score").alias("rerank_score"),
        F.round(F.sum(reciprocal(F.col("rank"), 1.0, k)), DIGITS).alias("rrf_score"),
        F.min("arrival").alias("arrival"),
    )
    total = F.round(F.col("rerank_score") + F.col("rrf_score"), DIGITS)
    order = Window.partitionBy("query_id").orderBy(total.desc(), F.desc("rerank_score"), F.asc("arrival"))
    return fused.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top_n)
