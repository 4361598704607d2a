"""Authorized scans, lookups and the row decoder over chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.functions.text import casefold, looks_repeated
from evidquarry.operators.phrases import found_in

# Order in which source families fill a bounded scan.
FAMILY_PRIORITY = {"PAGE": 0, "ATTACHMENT": 1, "ISSUE": 2, "CODE": 3}
RESERVED_KIND = "__vocabulary__"


def require_policy(project: str, policies: Sequence[str]) -> None:
    """Authorization is decided before a plan exists."""
    if f"project:{project}" not in policies:
        raise PermissionError("the project policy is required")


def reduced_policies(project: str, policies: Sequence[str]) -> list[str]:
    """Keep the project itself and its department, role and user scopes."""
    require_policy(project, policies)
    prefixes = (f"department:{project}:", f"role:{project}:", "user:")
    return list(dict.fromkeys(p for p in policies if p == f"project:{project}" or p.startswith(prefixes)))


def document_policies(project: str, policies: Sequence[str]) -> list[str]:
    """Scopes that may decide document visibility, sorted."""
    require_policy(project, policies)
    return sorted(
        {p for p in policies if p == f"project:{project}" or p.startswith(f"department:{project}:")}
    )


def policy_filter(policies: Sequence[str]) -> Column:
    if not policies:
        raise PermissionError("no access policy given")
    return F.col("access_policy_id").isin(*policies)


def authorized(project: str, policies: Sequence[str]) -> Column:
    """Null or blank scope is open; anything else must be the caller's."""
    allowed = reduced_policies(project, policies)
    in_project = F.coalesce("project_id", F.lit("")).isin("", project)
    in_policy = F.coalesce("access_policy_id", F.lit("")).isin("", *allowed)
    return in_project & in_policy


def scope_rows(df: DataFrame, column: str, project: str, document_only: bool = False) -> DataFrame:
    """The same scope reduction for a table of caller policies."""
    policy = F.col(column)
    keep = (policy == f"project:{project}") | policy.startswith(f"department:{project}:")
    if not document_only:
        keep = keep | policy.startswith(f"role:{project}:") | policy.startswith("user:")
    return df.where(keep)


def drop_reason(project: str, policies: Sequence[str], schema_version: str, threshold: float) -> Column:
    """Why a row cannot be decoded, or null; the first failing check wins."""
    found = F.coalesce("schema_version", F.lit(""))
    score = F.coalesce("score", F.lit(0.0))
    return (
        F.when(F.coalesce("record_kind", F.lit("")) == RESERVED_KIND, "reserved_record")
        .when((score != 0) & (score < threshold), "below_score_threshold")
        .when(F.coalesce("page_content", F.lit("")) == "", "empty_text_field")
        .when(~authorized(project, policies), "project_or_policy_mismatch")
        .when(
            found != schema_version,
            F.concat(
                F.lit(f"schema_version:expected={schema_version},found="),
                F.when(found == "", "absent").otherwise(found),
            ),
        )
    )


def decoded(df: DataFrame) -> DataFrame:
    """Field coercion: blank and missing values take the documented defaults."""
    defaults = {"source_type": "DOCUMENT", "title": "Untitled source", "language": "und", "doc_category": "narrative"}
    out = df
    for name, value in defaults.items():
        if name in df.columns:
            out = out.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value)))
    if "entity" in df.columns:
        out = out.withColumn("entity", casefold(F.coalesce("entity", F.lit(""))))
    if "parent_id" in df.columns:
        out = out.withColumn("parent_id", F.coalesce(F.nullif("parent_id", F.lit("")), "source_id"))
    return out


def bounded_scan(chunks: DataFrame, cap: int, families: Sequence[str] = ()) -> DataFrame:
    """Fill a bounded corpus one source family at a time; also say if it is cut.

    Reaching the cap exactly counts as truncated.
    """
    rows = chunks.where(F.col("source_type").isin(*families)) if families else chunks
    priority = F.coalesce(
        F.create_map(*[F.lit(v) for pair in FAMILY_PRIORITY.items() for v in pair])[F.col("source_type")],
        F.lit(99),
    )
    taken = rows.withColumn("priority", priority).orderBy("priority", "source_type", "ord").limit(cap)
    size = rows.limit(cap).agg(F.count(F.lit(1)).alias("n"))
    return taken.withColumn("truncated", size.scalar() >= cap)


def body_flags() -> tuple[Column, Column]:
    """What a body says about itself: a data class, a wire name."""
    return F.col("page_content").contains("data class "), F.lower("page_content").contains("wire name")


def structural_score(identifier: Column, times: Column, has_class: Column, has_wire_name: Column) -> Column:
    """Occurrences in the body (*times*) plus fixed bonuses for structural evidence."""
    in_path = F.rlike(
        F.upper("structure_path"),
        F.concat(F.lit(r"(?<![A-Z0-9_-])\Q"), F.upper(identifier), F.lit(r"\E(?![A-Z0-9_-])")),
    )
    return (
        times
        + F.when(in_path, 120).otherwise(0)
        + F.when(F.coalesce(has_class, F.lit(False)) & (times > 0), 80).otherwise(0)
        + F.when(F.coalesce(has_wire_name, F.lit(False)), 60).otherwise(0)
        + F.when(F.col("title").contains("EventType"), 50).otherwise(0)
    ).cast("double")


def anchor_score(identifier: Column) -> Column:
    """The same for rows that carry their body."""
    return structural_score(identifier, looks_repeated(F.lower("page_content"), F.lower(identifier)), *body_flags())


def exact_identifier_lookup(chunks: DataFrame, identifiers: DataFrame, fields: Sequence[str], k: int = 12) -> DataFrame:
    """Best *k* chunks per request holding an identifier in a field or anywhere in the body.

    Field matches are an equi join on the exploded field values. Body matches are substrings
    in any case, found and counted where the chunks are read; bodies do not travel. Chunks of a named issue (``issue_key``) come first,
    then current ones (``chunk_kind``), where the chunks have these columns, then by anchor score.
    """
    ids = identifiers.select("query_id", "identifier").distinct()
    known = [name for name in ("issue_key", "chunk_kind") if name in chunks.columns and name not in fields]
    plain = chunks.select("chunk_id", "page_content", "title", "structure_path", *fields, *known)
    keyed = plain.select("chunk_id", F.explode(F.array_distinct(F.array(*fields))).alias("identifier"))
    by_field = keyed.join(ids, "identifier").select("query_id", "identifier", "chunk_id", F.lit(0).cast("long").alias("times"))
    terms = ids.withColumn("needle_id", F.lower("identifier")).where("needle_id <> ''")
    asked_for = terms.select("needle_id", F.col("needle_id").alias("needle"))
    by_body = found_in(plain, "chunk_id", F.lower("page_content"), asked_for).join(terms, "needle_id").select(
        "query_id", "identifier", "chunk_id", "times"
    )
    pairs = by_field.unionByName(by_body).groupBy("query_id", "identifier", "chunk_id").agg(F.max("times").alias("times"))
    has_class, has_wire_name = body_flags()  # so that bodies need not travel
    base = plain.select("chunk_id", "title", "structure_path", has_class.alias("has_class"), has_wire_name.alias("has_wire_name"), *known)
    found = pairs.join(base, "chunk_id")
    issue = current = F.lit(False)
    if "issue_key" in base.columns:
        asked = ids.groupBy("query_id").agg(F.collect_set(F.upper("identifier")).alias("asked"))
        found = found.join(asked, "query_id")
        issue = F.coalesce(F.array_contains("asked", F.upper("issue_key")), issue)
    if "chunk_kind" in base.columns:
        current = F.coalesce(F.col("chunk_kind") == "CURRENT", current)
    scored = found.groupBy("query_id", "chunk_id").agg(
        F.max(structural_score(F.col("identifier"), F.col("times"), F.col("has_class"), F.col("has_wire_name"))).alias("anchor_score"), F.max(issue).alias("_issue"), F.max(current).alias("_current"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_issue"), F.desc("_current"), F.desc("anchor_score"), F.asc("chunk_id"))
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("_issue", "_current")


def siblings(chunks: DataFrame, hits: DataFrame, k: int, cap: int = 1000) -> DataFrame:
    """Chunks sharing a source or a parent with a hit of the same query, min(cap, k * k) each.

    The answer is ordered by source, ordinal and id. So of one source or parent only as many
    leading chunks as the limit can be in it: both sides are cut to those by a rank limit
    before the joins, and a source holding most chunks adds no more rows than any other.
    """
    limit = min(cap, k * k)
    place = ["source_id", "chunk_ordinal", "chunk_id"]

    def leading(key: str) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(key).orderBy(*place))
        kept = chunks.select("parent_id", *place).withColumn("rn", first).where(F.col("rn") <= limit).drop("rn")
        wanted = hits.select("query_id", key).where(F.col(key).isNotNull()).distinct()
        return kept.join(wanted, key).select("query_id", *place)

    found = leading("source_id").unionByName(leading("parent_id")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*place))
    return found.withColumn("rn", rank).where(F.col("rn") <= limit)


def complete_snapshots(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """Rows of each snapshot, or a refusal: beyond *cap* rows it is truncated and has no count."""
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(
        F.when(n <= cap, n).alias("n"),
        (n <= cap).alias("complete"),
        F.when(n > cap, "SNAPSHOT_TRUNCATED").otherwise("").alias("reason"),
    )


def population(chunks: DataFrame, entity: str, labels: Sequence[str]) -> DataFrame:
    """First registry chunk per entity key; keys come back sorted."""
    text = casefold(F.concat_ws(" ", "page_content", "title"))
    keep = F.col("doc_category").isin("entity-contract", "registry-table") & (F.col("entity_key") != "")
    if entity:
        keep = keep & casefold(F.col("entity")).isin("", entity.strip().lower())
    wanted = [label.strip().lower() for label in labels if label.strip()]
    if wanted:
        any_label = F.lit(False)
        for label in wanted:
            any_label = any_label | text.contains(label)
        keep = keep & any_label
    return (
        chunks.where(keep)
        .groupBy("entity_key")
        .agg(F.min_by("chunk_id", "ord").alias("chunk_id"), F.count(F.lit(1)).alias("members"))
        .orderBy("entity_key")
    )


def neighbor_pairs(pool: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adjacent chunks of the same parent and version: an equi join plus a band."""
    a = anchors.select(
        "query_id", "parent_id", "source_version",
        F.col("chunk_id").alias("anchor_id"), F.col("chunk_ordinal").alias("anchor_ordinal"),
    )
    b = pool.select("query_id", "parent_id", "source_version", "chunk_id", "chunk_ordinal")
    return a.join(b, ["query_id", "parent_id", "source_version"]).where(
        F.abs(F.col("chunk_ordinal") - F.col("anchor_ordinal")) == 1
    )
