"""Window-shaped candidate operators.

Every window here is partitioned by ``query_id`` (plus a finer key) over candidate
pools that a top-k has already bounded, so no partition can grow with the corpus.
Input order is explicit in an ordinal column (``ord`` unless named otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.functions.text import casefold, collapse_spaces

QUERY = "query_id"


def _w(*extra: str) -> Window:
    return Window.partitionBy(QUERY, *extra)


def rank_by(df: DataFrame, name: str, *order: Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(_w().orderBy(*order)))


def body_key(content_hash: Column | None = None) -> Column:
    body = casefold(collapse_spaces(F.col("page_content")))
    hashed = F.sha2(body, 256)
    if content_hash is None:
        return hashed
    return F.coalesce(F.nullif(F.trim(content_hash), F.lit("")), hashed)


def dedup_bodies(df: DataFrame, ordinal: str = "ord", issue_like: Column | None = None) -> DataFrame:
    """Best-ranked copy of each body with the references of its duplicates.

    Rows for which *issue_like* holds are only equal at the same source and locator.
    """
    key = body_key()
    if issue_like is not None:
        key = F.when(issue_like, F.concat_ws(":", "source_id", "locator", key)).otherwise(key)
    row = F.struct(*[F.col(c) for c in df.columns])
    grouped = (
        df.withColumn("_body", key)
        .groupBy(QUERY, "_body")
        .agg(
            F.min_by(row, F.col(ordinal)).alias("_row"),
            F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col("reference").alias("r")))).alias("_all"),
        )
    )
    others = F.array_distinct(
        F.transform(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), lambda item: item["r"])
    )
    return grouped.select("_row.*", F.array_join(others, "|").alias("duplicate_references"))


def preserve_candidates(
    df: DataFrame, limit: int, reserve: int = 4, per_query_reserve: int = 8, ordinal: str = "ord"
) -> DataFrame:
    """Primary window, then each formulation's window, then the rest; first seen wins.

    Needs ``primary_rank`` (null when absent) and ``variant_ranks`` (map).
    """
    tagged = df.select(
        "*",
        F.row_number().over(_w().orderBy(F.col("primary_rank").asc_nulls_last(), ordinal)).alias("_p"),
    )
    best = F.struct(
        F.when(F.col("primary_rank").isNotNull() & (F.col("_p") <= min(reserve, limit)), 0).otherwise(2).alias("c"),
        F.lit(0).alias("v"),
        F.when(F.col("primary_rank").isNotNull() & (F.col("_p") <= min(reserve, limit)), F.col("_p"))
        .otherwise(F.col(ordinal)).cast("bigint").alias("o"),
    )
    variants = df.select(QUERY, "chunk_id", ordinal, F.explode("variant_ranks").alias("v", "r"))
    variants = (
        variants.withColumn("rn", F.row_number().over(_w("v").orderBy("r", ordinal)))
        .where(F.col("rn") <= min(per_query_reserve, limit))
        .groupBy(QUERY, "chunk_id")
        .agg(F.min(F.struct(F.lit(1).alias("c"), F.col("v").cast("int").alias("v"), F.col("rn").cast("bigint").alias("o"))).alias("_v"))
    )
    placed = tagged.join(variants, [QUERY, "chunk_id"], "left").withColumn(
        "_place", F.least(best, F.coalesce("_v", best))
    )
    return rank_by(placed, "rn", F.col("_place").asc()).where(F.col("rn") <= limit).drop("_p", "_v", "_place")


def source_volume_discount(df: DataFrame, boosted: Column, strength: float, source: str = "source_id") -> DataFrame:
    """Score divided by 1 + strength * ln(candidates of the source)."""
    n = F.count(F.lit(1)).over(_w(source))
    return df.withColumn("source_candidates", n).withColumn(
        "retrieval_score", F.round(boosted / (1 + F.lit(strength) * F.log(n)), 9)
    )


def prefilter(
    df: DataFrame,
    weak: Column,
    structural: Column,
    max_fraction: float = 0.34,
    ordinal: str = "ord",
    minimum_pool: int = 8,
) -> DataFrame:
    """Tag rows KEEP or with the reason they leave the pool.

    Structural rows leave unconditionally; weak rows leave lowest score first, never
    more than the given share of the remaining pool, and only from large pools.
    """
    pool = F.count(F.lit(1)).over(_w())
    quality = F.count(F.when(structural.isNull(), 1)).over(_w())
    removable = structural.isNull() & weak & (pool >= minimum_pool)
    position = F.row_number().over(
        _w().orderBy(F.when(removable, 0).otherwise(1), F.coalesce("score", F.lit(0.0)), ordinal)
    )
    ceiling = F.floor(quality * F.lit(max_fraction))
    return df.withColumn(
        "verdict",
        F.coalesce(
            structural,
            F.when(removable & (position <= ceiling), F.lit("zero_overlap_low_dense")),
            F.lit("KEEP"),
        ),
    )


def threshold_with_exceptions(
    df: DataFrame, threshold: Column, bypass_row: Column, bypass_empty: bool = False, top_n: int = 10
) -> DataFrame:
    """Rows at or above the threshold, rows with their own bypass, or - when a query
    keeps nothing and the route allows it - its best *top_n* rows."""
    passed = (F.col("rerank_score") >= threshold) | bypass_row
    tagged = df.withColumn("_pass", passed)
    if not bypass_empty:
        return tagged.where("_pass").drop("_pass").withColumn("bypassed", F.lit(False))
    any_pass = F.max(F.col("_pass").cast("int")).over(_w())
    place = F.row_number().over(_w().orderBy(F.desc("rerank_score"), "ord"))
    return (
        tagged.withColumn("bypassed", any_pass == 0)
        .withColumn("_place", place)
        .where(F.col("_pass") | (F.col("bypassed") & (F.col("_place") <= top_n)))
        .drop("_pass", "_place")
    )


def preserve_non_empty(df: DataFrame, predicate: Column) -> DataFrame:
    """A filter that is ignored for a query it would empty."""
    kept = F.max(predicate.cast("int")).over(_w())
    return df.withColumn("bypassed", kept == 0).where(predicate | F.col("bypassed"))


def per_source_cap(df: DataFrame, cap: int, limit: int, score: str = "rerank_score", source: str = "source_id") -> DataFrame:
    """At most *cap* rows per source, best first, then at most *limit* per query."""
    capped = df.withColumn(
        "source_rank", F.row_number().over(_w(source).orderBy(F.desc(score), "ord"))
    ).where(F.col("source_rank") <= cap)
    return rank_by(capped, "rn", F.desc(score), F.asc("ord")).where(F.col("rn") <= limit)


def source_diverse(df: DataFrame, source: str = "source_id", ordinal: str = "ord", name: str = "rn") -> DataFrame:
    """First row of every source, then all other rows, both in input order."""
    nth = F.row_number().over(_w(source).orderBy(ordinal))
    return rank_by(df.withColumn("source_rank", nth), name, (F.col("source_rank") > 1).asc(), F.col(ordinal).asc())


def round_robin(df: DataFrame, family: Column, order: list[Column], family_order: list[Column], limit: int | None = None) -> DataFrame:
    """Alternate over families by depth. *family_order* ranks each family's first row."""
    tagged = df.withColumn("family", family)
    tagged = tagged.withColumn("depth", F.row_number().over(_w("family").orderBy(*order)))
    heads = tagged.where(F.col("depth") == 1)
    heads = heads.withColumn("family_rank", F.row_number().over(_w().orderBy(*family_order))).select(
        QUERY, "family", "family_rank"
    )
    merged = rank_by(tagged.join(heads, [QUERY, "family"]), "rn", F.col("depth").asc(), F.col("family_rank").asc())
    return merged if limit is None else merged.where(F.col("rn") <= limit)


def anchors_first(df: DataFrame, is_anchor: Column, anchor_score: Column, top_n: int, reserve: int = 3) -> DataFrame:
    """Best anchors lead the list and carry the full score."""
    place = F.row_number().over(_w().orderBy(is_anchor.desc(), anchor_score.desc(), F.asc("ord")))
    lead = is_anchor & (place <= min(reserve, top_n))
    ordered = df.withColumn("_lead", F.when(lead, place))
    ordered = rank_by(ordered, "rn", F.col("_lead").asc_nulls_last(), F.col("ord").asc())
    return (
        ordered.where(F.col("rn") <= top_n)
        .withColumn("rerank_score", F.when(is_anchor, F.lit(1.0)).otherwise(F.col("rerank_score")))
        .drop("_lead")
    )


def progressive_narrowing(df: DataFrame, anchor: Column, limit: int) -> DataFrame:
    """Anchored or query-reserved rows, one row per source type, then by score."""
    reserved = F.col("primary_rank").isNotNull() | (F.size("variant_ranks") > 0)
    query_rank = F.coalesce("primary_rank", F.array_min(F.map_values("variant_ranks")))
    order = [
        anchor.desc(),
        reserved.desc(),
        query_rank.asc_nulls_last(),
        F.coalesce("retrieval_score", F.lit(0.0)).desc(),
        F.coalesce("fusion_score", F.lit(0.0)).desc(),
        F.coalesce("lexical_score", F.lit(0.0)).desc(),
        F.coalesce("score", F.lit(0.0)).desc(),
        F.asc("ord"),
    ]
    ranked = rank_by(df, "_pos", *order)
    first_of_type = F.row_number().over(_w("source_type").orderBy("_pos")) == 1
    klass = F.when(anchor | reserved, 0).when(first_of_type, 1).otherwise(2)
    placed = rank_by(ranked.withColumn("_class", klass), "rn", F.asc("_class"), F.asc("_pos"))
    size = F.count(F.lit(1)).over(_w())
    return (
        placed.withColumn("_n", size)
        .withColumn("rn", F.when(F.col("_n") <= limit, F.row_number().over(_w().orderBy("ord"))).otherwise(F.col("rn")))
        .where(F.col("rn") <= limit)
        .drop("_pos", "_class", "_n")
    )


def centered_window(df: DataFrame, anchor: Column, n: int, family: str = "parent_id", ordinal: str = "chunk_ordinal") -> DataFrame:
    """A window of *n* siblings around the first anchor of each family, clamped."""
    w = _w(family)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(ordinal, "chunk_id")))
    placed = placed.withColumn("_size", F.count(F.lit(1)).over(w)).withColumn(
        "_a", F.min(F.when(anchor, F.col("_i"))).over(w)
    )
    start = F.greatest(F.lit(1), F.least(F.col("_a") - F.lit(n // 2), F.col("_size") - F.lit(n - 1)))
    return placed.where(F.col("_i").between(start, start + F.lit(n - 1))).drop("_i", "_size", "_a")


def context_quality(df: DataFrame, threshold: float = 0.25) -> DataFrame:
    relevance = F.coalesce(F.nullif("rerank_score", F.lit(0.0)), F.nullif("score", F.lit(0.0)), F.lit(0.0))
    agg = df.groupBy(QUERY).agg(
        F.max(relevance).alias("r"),
        F.max(F.coalesce("lexical_score", F.lit(0.0))).alias("x"),
        F.count(F.lit(1)).alias("n"),
    )
    enough = (F.col("r") >= threshold) | (F.col("x") > 0)
    completeness = F.least(F.lit(1.0), F.col("n") / 2 + F.least(F.col("x") / 4, F.lit(0.5)))
    return agg.select(
        QUERY,
        F.when(enough, "SUFFICIENT").otherwise("INSUFFICIENT").alias("quality"),
        F.bround(F.least("r", F.lit(1.0)), 3).alias("relevance"),
        F.bround(completeness, 3).alias("completeness"),
        F.when(enough, "").otherwise("LOW_RELEVANCE").alias("failure_reason"),
    )


def keep_latest_authoritative(df: DataFrame, entity: Column, keys: list[str] | None = None) -> DataFrame:
    """All chunks of the best (authority, freshness) version of each entity.

    The best version is a map-side combined maximum per entity, joined back on the
    entity; ties all stay. No window, so a hot entity is never sorted in one task.
    """
    scope = keys or []
    tagged = df.withColumn("_entity", entity).withColumn("_fresh", version_key())
    rank = F.struct(F.coalesce(F.nullif("authority", F.lit(0)), F.lit(0)).alias("a"), F.col("_fresh").alias("f"))
    tagged = tagged.withColumn("_rank", rank)
    best = tagged.groupBy(*scope, "_entity").agg(F.max("_rank").alias("_best"))
    # Spread one entity over several join keys; the small side is replicated instead.
    return salted_lookup(tagged, best, [*scope, "_entity"], F.xxhash64("chunk_id")).where(
        F.col("_rank") == F.col("_best")
    ).drop("_entity", "_fresh", "_rank", "_best")


def version_key() -> Column:
    """(observed_at, numbers of the version, version text) - ordered as tuples are."""
    version = F.coalesce("source_version", F.lit(""))
    numbers = F.transform(
        F.regexp_extract_all(version, F.lit(r"\d+"), 0), lambda part: part.cast("bigint")
    )
    return F.struct(F.coalesce("observed_at", F.lit("")).alias("o"), numbers.alias("n"), F.lower(version).alias("v"))


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """Join a per-key lookup to its rows without sending a hot key to one task.

    Every key of *small* is repeated *salts* times; *big* picks one copy by hash.
    """
    left = big.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def stratified_sample(df: DataFrame, strata: list[str], size: int, ordinal: str = "ord") -> DataFrame:
    """Round-robin over strata until *size* rows are taken.

    No stratum can contribute more than *size* rows, so a rank limit cuts each
    stratum before the final top-*size* ordering.
    """
    nth = F.row_number().over(Window.partitionBy(*strata).orderBy(ordinal))
    return (
        df.withColumn("rn", nth)
        .where(F.col("rn") <= size)
        .orderBy("rn", *[F.coalesce(F.col(s).cast("string"), F.lit("None")) for s in strata])
        .limit(size)
    )
