"""Evidence facts, claim verification and the final output gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.functions import anchors, citations
from evidquarry.functions.answers import contains_identifier
from evidquarry.functions.markdown import LIST_MARK
from evidquarry.functions.text import casefold, collapse_spaces, first_present
from evidquarry.operators.ranking import salted_lookup, version_key

# Acceptance thresholds of the claim verifier and the topicality check.
THRESHOLD = 0.5
CROSS_LANGUAGE_THRESHOLD = 0.3
TOPICALITY = 0.10

FAILURES = (
    "PERMISSIONS_NOT_SATISFIED",
    "SOURCE_SCOPE_VIOLATION",
    "UNRESOLVED_SOURCE_CONFLICT",
    "FRESHNESS_NOT_VERIFIABLE",
    "REQUESTED_COVERAGE_INCOMPLETE",
    "INVALID_DERIVATION",
    "UNSUPPORTED_CLAIM",
)


def evidence_facts(chunks: DataFrame) -> DataFrame:
    """Stable fact rows: entity, field, normalized value and provenance."""
    source = first_present(F.col("source_id"), F.col("reference"), F.col("chunk_id").cast("string"))
    entity = first_present(F.col("entity_key"), F.col("parent_id"), source)
    value = first_present(F.col("normalized_value"), collapse_spaces(F.col("page_content")))
    nul = F.lit("\u0000")
    digest = F.sha2(
        F.concat(source, nul, F.coalesce("source_version", F.lit("")), nul, F.col("chunk_id").cast("string"), nul, F.coalesce(value, F.lit(""))),
        256,
    )
    return chunks.select(
        "chunk_id",
        F.concat(F.lit("fact:"), F.substring(digest, 1, 24)).alias("fact_id"),
        entity.alias("entity"),
        F.nullif("field_path", F.lit("")).alias("field_path"),
        casefold(F.coalesce(value, F.lit(""))).alias("value"),
        source.alias("source_id"),
        F.upper(first_present(F.col("source_type"), F.lit("DOCUMENT"))).alias("source_category"),
        F.coalesce("authority", F.lit(0)).alias("authority"),
        "source_version",
        "observed_at",
    )


def conflicts(facts: DataFrame) -> DataFrame:
    """Fields whose best-authority, newest facts still disagree.

    The best rank is a combined maximum per field; matching rows meet it through a
    salted lookup, so one hot field does not gather its facts in one task.
    """
    ranked = facts.where(F.col("field_path").isNotNull()).withColumn(
        "_rank", F.struct(F.col("authority").alias("a"), version_key().alias("f"))
    )
    best = ranked.groupBy("entity", "field_path").agg(F.max("_rank").alias("_best"))
    current = salted_lookup(ranked, best, ["entity", "field_path"], F.xxhash64("chunk_id")).where(
        F.col("_rank") == F.col("_best")
    )
    return (
        current.groupBy("entity", "field_path")
        .agg(F.count_distinct("value").alias("n_values"), F.count(F.lit(1)).alias("facts"))
        .where(F.col("n_values") > 1)
    )


def structured_fact_rows(facts: DataFrame) -> DataFrame:
    """One Markdown row per distinct (entity, field, value), first fact as source."""
    first = facts.where(F.col("field_path").isNotNull()).groupBy("entity", "field_path", "value").agg(
        F.min("chunk_id").alias("source")
    )
    return first.select(
        "entity", "field_path",
        F.concat(
            F.lit("| `"), "entity", F.lit("` | `"), "field_path", F.lit("` | "), "value",
            F.lit(" | [SOURCE "), F.col("source").cast("string"), F.lit("] |"),
        ).alias("row"),
    )


def bare_claim(text: Column, kind: Column) -> Column:
    """Claim text without its markers and, for list items, without the bullet."""
    plain = F.trim(F.regexp_replace(text, r"\s*\[SOURCE \d+\]", ""))
    return F.when(kind == "LIST_ITEM", F.regexp_replace(plain, LIST_MARK, "")).otherwise(plain)


def claim_sources(claims: DataFrame) -> DataFrame:
    """Markers of each claim: (claim columns, source number), out-of-range kept as null."""
    return claims.withColumn("cited", citations.mentioned(F.col("claim")))


def verified(claims: DataFrame, evidence: DataFrame, sources: int, score, keys: list[str]) -> DataFrame:
    """Verdict per claim from the evidence it cites.

    *claims*: keys, claim, kind, answer_language. *evidence*: group key, source number,
    page_content, language. *score(claim, evidence)* is any relevance Column; the best
    cited source counts. A claim cites a handful of sources, so its group is small.
    """
    tagged = claim_sources(claims).withColumn("plain", bare_claim(F.col("claim"), F.col("kind")))
    invalid = (F.size("cited") == 0) | F.exists("cited", lambda n: (n < 1) | (n > sources))
    bad = tagged.where(invalid).select(*keys, F.lit("MISSING_OR_INVALID_CITATION").alias("reason"), F.lit(None).cast("double").alias("score"))
    pairs = tagged.where(~invalid).withColumn("source", F.explode("cited")).join(evidence, [keys[0], "source"])
    grouped = pairs.groupBy(*keys, "plain", "answer_language").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "page_content"))), lambda e: e["page_content"]), "\n").alias("proof"),
        F.max(score(F.col("plain"), F.col("page_content"))).alias("score"),
        F.collect_set("language").alias("languages"),
    )
    known = F.filter("languages", lambda l: ~l.isin("", "und", "mixed"))
    cross = F.col("answer_language").isin("en", "es") & (F.size(known) > 0) & ~F.array_contains(known, F.col("answer_language"))
    floor = F.when(cross, CROSS_LANGUAGE_THRESHOLD).otherwise(THRESHOLD)
    reason = (
        F.when(~anchors.anchors_supported(F.col("plain"), F.col("proof")), "NUMERIC_OR_IDENTIFIER_ANCHOR_ABSENT")
        .when(~anchors.negation_supported(F.col("plain"), F.col("proof")), "NEGATION_UNSUPPORTED")
        .when(F.col("score") < floor, "SCORE_BELOW_THRESHOLD")
        .otherwise("SUPPORTED")
    )
    return bad.unionByName(grouped.select(*keys, reason.alias("reason"), F.round("score", 4).alias("score")))


def output_gate(checks: DataFrame) -> DataFrame:
    """First failing check in the fixed order; the input holds one boolean per check."""
    ok = (
        "permissions_ok", "scope_ok", "conflicts_ok", "freshness_ok", "coverage_ok", "derivations_ok", "claims_ok",
    )
    reason = F.when(~F.col(ok[0]), FAILURES[0])
    for name, failure in zip(ok[1:], FAILURES[1:]):
        reason = reason.when(~F.col(name), failure)
    return checks.withColumn("failure_reason", reason)


# Fixed value: how an answer marks a claim it derived, with its rule.
INFERENCE = r"(?i)^\s*(?:[-*]\s*)?Inference\s*\(([^)]+)\)\s*:"


def claim_support(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """The claims with the fact ids they cite, their type and rule, and whether each is supported.

    *facts* has the first key, source and fact_id. A claim cites a handful of sources.
    """
    number = F.explode_outer(citations.mentioned(F.col("claim"))).alias("source")
    cited = claims.select(*keys, number).join(facts.select(keys[0], "source", "fact_id"), [keys[0], "source"])
    ids = cited.groupBy(*keys).agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"))
    rule = F.nullif(F.trim(F.regexp_extract("claim", INFERENCE, 1)), F.lit(""))
    derived = F.col("claim").rlike(INFERENCE)
    held = F.size("fact_ids") > 0
    return claims.join(ids, keys, "left").withColumn("fact_ids", F.coalesce("fact_ids", F.array().cast("array<string>"))).select(
        *claims.columns, "fact_ids", F.when(derived, "DERIVED").otherwise("DIRECT").alias("claim_type"), rule.alias("derivation_rule"),
        held.alias("supported"), (~derived | (rule.isNotNull() & held)).alias("derivation_ok"))


def gate_checks(
    answers: DataFrame, support: DataFrame, facts: DataFrame, keys: list[str], required_policy: str,
    policies: tuple[str, ...] = (), categories: tuple[str, ...] = (),
) -> DataFrame:
    """The seven booleans of the output gate, from claims, facts and what was requested.

    *answers*: keys, answer, latest, all_items, expected (identifiers). *facts*: the first key,
    source, access_policy_id and the fact columns. Empty *categories* allow every source.
    An answer without facts or claims has nothing to fail on; conflicts are fields whose facts
    of the highest authority and newest version differ.
    """
    group = keys[0]
    allowed = F.coalesce("access_policy_id", F.lit("")).isin("", required_policy, *policies)
    scoped = F.col("source_category").isin("DOCUMENT", *categories) if categories else F.lit(True)
    dated = (F.coalesce("source_version", F.lit("")) != "") | (F.coalesce("observed_at", F.lit("")) != "")
    of_facts = facts.groupBy(group).agg(
        F.bool_and(allowed).alias("permissions_ok"), F.bool_and(scoped).alias("scope_ok"), F.bool_and(dated).alias("dated"))
    fields = [group, "entity", "field_path"]
    ranked = facts.where(F.col("field_path").isNotNull()).withColumn("_rank", F.struct(F.col("authority").alias("a"), version_key().alias("f")))
    best = ranked.groupBy(*fields).agg(F.max("_rank").alias("_best"))
    differing = (
        ranked.join(best, fields).where(F.col("_rank") == F.col("_best")).groupBy(*fields)
        .agg(F.count_distinct("value").alias("n")).where("n > 1").select(group).distinct().withColumn("conflict", F.lit(True)))
    of_claims = support.groupBy(*keys).agg(F.bool_and("derivation_ok").alias("derivations_ok"), F.bool_and("supported").alias("claims_ok"))
    joined = answers.join(of_facts, group, "left").join(differing, group, "left").join(of_claims, keys, "left")
    named = F.forall("expected", lambda name: contains_identifier(F.col("answer"), name))
    true = F.lit(True)
    return joined.select(
        *keys, F.coalesce("permissions_ok", true).alias("permissions_ok"), F.coalesce("scope_ok", true).alias("scope_ok"),
        F.col("conflict").isNull().alias("conflicts_ok"), (~F.col("latest") | F.coalesce("dated", true)).alias("freshness_ok"),
        (~F.col("all_items") | named).alias("coverage_ok"), F.coalesce("derivations_ok", true).alias("derivations_ok"),
        F.coalesce("claims_ok", true).alias("claims_ok"))


def greedy_budget(blocks: DataFrame, group: str, order: str, cost: str, frame_cost: int, budget: int) -> DataFrame:
    """Blocks that fit a token budget in order; the last one may be cut.

    Spending is a running sum within one bounded evidence list. A block is admitted
    while its frame still fits what the blocks before it left over.
    """
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col(cost) + F.lit(frame_cost)).over(before), F.lit(0))
    placed = blocks.withColumn("_left", F.lit(budget) - spent)
    fits = F.col("_left") > frame_cost
    cut = F.col(cost) + F.lit(frame_cost) > F.col("_left")
    return placed.where(fits).withColumn("truncated", cut).withColumn(
        "granted", F.when(cut, F.col("_left") - F.lit(frame_cost)).otherwise(F.col(cost))
    ).drop("_left")


def bounded_history(turns: DataFrame, budget: int) -> DataFrame:
    """Newest turns that fit the budget; the oldest kept one may be cut.

    Costs are at least one token, so no more than *budget* turns can ever be kept and
    a rank limit bounds each conversation before the running sum.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    ranked = turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= budget)
    cost = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(3)))
    before = newest.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(cost).over(before), F.lit(0))
    return (
        ranked.withColumn("_left", left)
        .where(F.col("_left") > 0)
        .withColumn("kept", F.when(cost <= F.col("_left"), F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), (F.col("_left") * 3).cast("int"))))
        .drop("_left", "_n")
    )


def clarified_scope(requested: Column, observed: Column) -> Column:
    """Requested source types that exist; empty when none do (no restriction)."""
    return F.when(F.size(observed) == 0, requested).otherwise(F.array_intersect(requested, observed))
