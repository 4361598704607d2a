"""Retrieval, generation and pairwise metrics with language and department splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.operators.ranks import cumulative_counts, median, nearest_rank, prefix_sums

DIGITS = 6
# Split labels, gates and tolerances of the metric definitions.
ALL = "ALL"
DIRECTIONS = (("en", "en"), ("es", "es"), ("en", "es"), ("es", "en"))
LENGTH_TOLERANCE = 1.25
BIAS_LIMIT = 0.20
MAX_FALSE_POSITIVE_RATE = 0.05
GOLD_FLOOR = 0.95
REGRESSION_LIMIT = 5.0
GENERATION_METRICS = (
    "grounding_acceptance_rate",
    "citation_precision",
    "refusal_precision",
    "out_of_scope_answer_rate",
    "refusal_reason_accuracy",
    "paraphrase_invariance_rate",
)


def ideal_dcg(gold_size: Column, k: int) -> Column:
    """Gain of a perfect list: min(gold, k) relevant rows from the top."""
    table = [0.0]
    from math import log2

    for index in range(k):
        table.append(table[-1] + 1 / log2(index + 2))
    return F.element_at(F.array(*[F.lit(v) for v in table]), F.least(gold_size, F.lit(k)).cast("int") + 1)


def case_metrics(hits: DataFrame, cases: DataFrame, top_k: int = 25, top_n: int = 8) -> DataFrame:
    """Per-case values; null where a case does not belong to a metric's population.

    *hits*: query_id, rank, rel, section, project_id, policy. One row per retrieved
    chunk, at most *top_k* per case.
    """
    rel = F.col("rel")
    in_n = F.col("rank") <= top_n
    seen = hits.where(F.col("rank") <= top_k).groupBy("query_id").agg(
        F.count(F.when(rel, 1)).alias("found_k"),
        F.count(F.when(rel & (F.col("rank") <= 25), 1)).alias("found_25"),
        F.count(F.when(rel & in_n, 1)).alias("found_n"),
        F.min(F.when(rel & in_n, F.col("rank"))).alias("first"),
        F.sum(F.when(rel & in_n, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.count_distinct(F.when(rel & in_n, F.col("section"))).alias("sections"),
        F.max((F.col("project_id") != "ALPHA").cast("int")).alias("foreign"),
    )
    joined = cases.join(seen, "query_id", "left")
    zero = F.lit(0)
    counted = F.col("answerable")
    resolved = counted & (F.col("gold_size") > 0)
    evidence = resolved & (F.col("role") == "answer_evidence")

    def got(name: str) -> Column:
        return F.coalesce(F.col(name), zero)

    return joined.select(
        "query_id", "query_language", "department", "answerable",
        resolved.alias("resolved"),
        evidence.alias("evidence"),
        F.when(resolved, got("found_k") / F.col("gold_size")).alias("recall"),
        F.when(resolved, F.least("gold_size", F.lit(top_k)) / F.col("gold_size")).alias("recall_ceiling"),
        F.when(resolved, (got("found_25") > 0).cast("double")).alias("candidate_hit"),
        F.when(resolved, (got("sections") > 0).cast("double")).alias("section_hit"),
        F.when(resolved, got("sections") / F.col("n_sections")).alias("section_recall"),
        F.when(evidence, got("found_n") / F.lit(top_n)).alias("precision"),
        F.when(evidence, (got("found_n") > 0).cast("double")).alias("hit_rate"),
        F.when(evidence, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(evidence, F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal_dcg(F.col("gold_size"), top_n)).alias("ndcg"),
        F.when(counted, got("foreign")).alias("leak"),
    )


RETRIEVAL_METRICS = (
    "candidate_hit", "section_hit", "section_recall", "precision", "recall", "hit_rate", "mrr", "ndcg",
)


def _mean(name: str) -> Column:
    return F.round(F.coalesce(F.avg(name), F.lit(0.0)), DIGITS).alias(name)


def retrieval_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("cases"),
        F.count(F.when(F.col("answerable"), 1)).alias("answerable_cases"),
        F.count(F.when(F.col("resolved"), 1)).alias("gold_resolved_cases"),
        F.count(F.when(F.col("evidence"), 1)).alias("answer_evidence_cases"),
        *[_mean(name) for name in (*RETRIEVAL_METRICS, "recall_ceiling")],
        F.coalesce(F.sum("leak"), F.lit(0)).alias("leakage"),
    ]


def retrieval_summary(case_rows: DataFrame) -> DataFrame:
    """Overall, language, department and department x language in one aggregation."""
    return _labelled(
        case_rows.groupingSets(
            [[], ["query_language"], ["department"], ["department", "query_language"]],
            "department", "query_language",
        ).agg(
            F.grouping("department").alias("_gd"), F.grouping("query_language").alias("_gl"),
            *retrieval_aggregates(),
        )
    )


def _labelled(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("department", F.when(F.col("_gd") == 1, ALL).otherwise(F.col("department")))
        .withColumn("query_language", F.when(F.col("_gl") == 1, ALL).otherwise(F.col("query_language")))
        .drop("_gd", "_gl")
    )


def language_gap(case_rows: DataFrame, metrics: tuple[str, ...] = RETRIEVAL_METRICS) -> DataFrame:
    """English minus Spanish per metric, and its size."""
    means = case_rows.agg(
        *[
            F.coalesce(F.avg(F.when(F.col("query_language") == lang, F.col(m))), F.lit(0.0)).alias(f"{m}_{lang}")
            for m in metrics for lang in ("en", "es")
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_en") - F.col(f"{m}_es")).alias("gap"))
            for m in metrics
        ]
    )
    return means.select(F.explode(rows).alias("r")).select(
        "r.metric", F.round("r.gap", DIGITS).alias("gap"), F.round(F.abs("r.gap"), DIGITS).alias("gap_abs")
    )


def flattened(summary: DataFrame, metrics: tuple[str, ...] = RETRIEVAL_METRICS) -> DataFrame:
    """``metric.slice`` rows of a summary."""
    label = (
        F.when((F.col("department") == ALL) & (F.col("query_language") == ALL), "overall")
        .when(F.col("department") == ALL, F.col("query_language"))
        .when(F.col("query_language") == ALL, F.concat(F.lit("department."), "department"))
        .otherwise(F.concat_ws(".", F.lit("department"), "department", "query_language"))
    )
    long = summary.withColumn("slice", label).unpivot(["slice"], list(metrics), "metric", "value")
    return long.select(F.concat_ws(".", "metric", "slice").alias("name"), "value")


def populations(summary: DataFrame, metrics: tuple[str, ...] = RETRIEVAL_METRICS) -> DataFrame:
    """Denominator behind each metric of a summary."""
    resolved = ("recall", "candidate_hit", "section_hit", "section_recall")
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col("gold_resolved_cases" if m in resolved else "answer_evidence_cases").alias("n"),
            )
            for m in metrics
        ]
    )
    return summary.select("department", "query_language", F.explode(rows).alias("r")).select(
        "department", "query_language", "r.metric", "r.n"
    )


# ---- generation -----------------------------------------------------------------

def generation_aggregates() -> list[Column]:
    yes, no = F.col("answerable"), ~F.col("answerable")
    refused = F.trim(F.coalesce("refusal_reason", F.lit(""))) != ""
    fallback = F.col("canonical_fallback_used")

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    def share(part: Column, whole: Column) -> Column:
        return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), DIGITS)

    reasoned = no & (F.coalesce("expected_refusal_reason", F.lit("")) != "")
    return [
        F.count(F.lit(1)).alias("cases"),
        n(yes).alias("answerable_cases"),
        F.sum("cited").alias("citation_count"),
        F.sum("uncited_claims_dropped").alias("uncited_claims_dropped"),
        n(refused).alias("refusal_cases"),
        n(reasoned).alias("refusal_reason_cases"),
        share(n(yes & F.col("grounding_accepted")), n(yes)).alias("grounding_acceptance_rate"),
        share(F.sum("valid_citation_count"), F.sum("cited")).alias("citation_precision"),
        share(n(no & refused), n(refused)).alias("refusal_precision"),
        share(n(no & ~refused), n(no)).alias("out_of_scope_answer_rate"),
        share(n(no & ~fallback & ~refused), n(no & ~fallback)).alias("out_of_scope_without_fallback"),
        n(fallback).alias("canonical_fallback_cases"),
        share(n(reasoned & F.col("refusal_reason").eqNullSafe(F.col("expected_refusal_reason"))), n(reasoned)).alias(
            "refusal_reason_accuracy"
        ),
    ]


def generation_summary(rows: DataFrame) -> DataFrame:
    return _labelled(
        rows.groupingSets(
            [[], ["query_language"], ["department"], ["department", "query_language"]],
            "department", "query_language",
        ).agg(
            F.grouping("department").alias("_gd"), F.grouping("query_language").alias("_gl"),
            *generation_aggregates(),
        )
    )


def fallback_reasons(rows: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif("canonical_fallback_reason", F.lit("")), F.lit("UNCLASSIFIED"))
    return rows.where("canonical_fallback_used").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def paraphrase_invariance(rows: DataFrame) -> DataFrame:
    """Groups whose formulations disagree; a missing reason is a value of its own."""
    signature = F.struct("answered", "grounding_accepted", "refusal_reason")
    grouped = (
        rows.where(F.coalesce("paraphrase_group", F.lit("")) != "")
        .groupBy("paraphrase_group")
        .agg(F.count_distinct(signature).alias("signatures"))
    )
    total = F.count(F.lit(1))
    divergent = F.count(F.when(F.col("signatures") > 1, 1))
    return grouped.agg(
        total.alias("groups"),
        divergent.alias("divergent"),
        F.round(F.coalesce((total - divergent) / F.nullif(total, F.lit(0)), F.lit(0.0)), DIGITS).alias("rate"),
    )


# ---- pairwise -------------------------------------------------------------------

def word_count(text: Column) -> Column:
    return F.greatest(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(1))


def reconciled(pairs: DataFrame) -> DataFrame:
    """Two presentation orders resolved to one outcome; disagreement is a tie plus bias."""
    first_byte = F.conv(F.substring(F.sha2(F.col("case_id").cast("string"), 256), 1, 2), 16, 10).cast("int")
    baseline_first = first_byte % 2 == 1

    def outcome(winner: Column, shown_first: Column) -> Column:
        return F.when(winner == "TIE", "TIE").when((winner == "RESPONSE_1") == shown_first, "BASELINE").otherwise(
            "CANDIDATE"
        )

    first = outcome(F.col("first_pass"), baseline_first)
    second = outcome(F.col("second_pass"), ~baseline_first)
    a, b = word_count(F.col("baseline_answer")), word_count(F.col("candidate_answer"))
    ratio = F.greatest(a, b) / F.least(a, b)
    return pairs.select(
        "case_id", "query_language",
        F.when(first != second, "TIE").otherwise(first).alias("outcome"),
        ((first != second) & (first != "TIE") & (second != "TIE")).alias("position_bias"),
        F.bround(ratio, 3).alias("length_ratio"),
        (ratio > LENGTH_TOLERANCE).alias("length_mismatch"),
    )


def pairwise_summary(results: DataFrame) -> DataFrame:
    """Win and tie rates over length-comparable pairs, or over all when none compare."""
    totals = results.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count(F.when(~F.col("length_mismatch"), 1)).alias("comparable"),
        F.avg(F.col("position_bias").cast("int")).alias("bias"),
        F.avg("length_ratio").alias("ratio"),
    ).agg(F.first(F.struct("pairs", "comparable", "bias", "ratio")).alias("t"))
    t = totals.scalar()
    scored = results.withColumn("_t", t).where(~F.col("length_mismatch") | (F.col("_t.comparable") == 0))
    supported = scored.where(F.col("query_language").isin("en", "es"))
    both = scored.withColumn("scope", F.lit("overall")).unionByName(
        supported.withColumn("scope", F.col("query_language"))
    )
    rates = [
        F.round(F.avg((F.col("outcome") == o).cast("int")), DIGITS).alias(name)
        for o, name in (("CANDIDATE", "candidate_win_rate"), ("BASELINE", "baseline_win_rate"), ("TIE", "tie_rate"))
    ]
    return both.groupBy("scope").agg(
        F.max("_t.pairs").alias("pairs"),
        F.max("_t.comparable").alias("comparable_pairs"),
        F.round(F.max("_t.bias"), DIGITS).alias("position_bias_rate"),
        F.bround(F.max("_t.ratio"), 3).alias("mean_length_ratio"),
        *rates,
        F.when(F.max("_t.bias") > BIAS_LIMIT, "UNRELIABLE_POSITION_BIAS").otherwise("OK").alias("verdict_reliability"),
    )


def metric_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means that skip NaN: overall, per language, and the gap when both exist."""

    def mean(m: str, lang: str | None = None) -> Column:
        value = F.nanvl(F.col(m), F.lit(None).cast("double"))
        return F.avg(value if lang is None else F.when(F.col("query_language") == lang, value))

    sums = rows.agg(*[mean(m, lang).alias(f"{m}|{lang}") for m in metrics for lang in (None, "en", "es")])
    entries = []
    for m in metrics:
        en, es = F.col(f"`{m}|en`"), F.col(f"`{m}|es`")
        values = {"overall": F.col(f"`{m}|None`"), "en": en, "es": es, "language_gap": en - es, "language_gap_abs": F.abs(en - es)}
        entries += [F.struct(F.lit(f"{m}.{k}").alias("name"), F.round(v, DIGITS).alias("value")) for k, v in values.items()]
    return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("value").isNotNull())


# ---- thresholds -----------------------------------------------------------------

def calibrated_threshold(rows: DataFrame, score: str = "max_rerank_score") -> DataFrame:
    """Lowest candidate threshold whose false-positive rate is acceptable.

    Instead of a threshold x negative cross product, negatives are counted per
    distinct score with distributed prefix sums.
    """
    candidates = rows.select(F.col(score).alias("t")).unionByName(
        rows.sparkSession.range(1).select(F.explode(F.array(F.lit(0.0), F.lit(0.35), F.lit(1.0))).alias("t"))
    ).distinct()
    tagged = candidates.select(F.col("t").alias("v"), F.lit(0).alias("neg")).unionByName(
        rows.where(~F.col("answerable")).select(F.col(score).alias("v"), F.lit(1).alias("neg"))
    )
    negatives = tagged.groupBy("v").agg(F.sum("neg").alias("neg"), F.max(1 - F.col("neg")).alias("cand"))
    counts = prefix_sums(negatives.withColumnRenamed("neg", "n"), "v", [])
    rate = F.when(F.col("total") == 0, F.lit(0.0)).otherwise((F.col("total") - F.col("below")) / F.col("total"))
    return counts.where((F.col("cand") == 1) & (rate <= MAX_FALSE_POSITIVE_RATE)).agg(
        F.coalesce(F.min("v"), F.lit(1.0)).alias("threshold")
    )


def separation(rows: DataFrame, expected: str, score: str) -> DataFrame:
    """Smallest positive and largest negative score."""
    return rows.agg(
        F.min(F.when(F.col(expected), F.col(score))).alias("positive_min"),
        F.max(F.when(~F.col(expected), F.col(score))).alias("negative_max"),
    )


def latency_summary(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Nearest-rank p50/p95, the true median and the share of near-zero gaps."""
    near_zero = F.sum(F.when(F.col(value) < 5, F.col("n")).otherwise(F.lit(0)))
    return cumulative_counts(df, value, group).groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.bround(near_zero / F.sum("n"), 3).alias("burst_share"),
        nearest_rank(value, 0.5).alias("p50"),
        nearest_rank(value, 0.95).alias("p95"),
        median(value).alias("median"),
    )
