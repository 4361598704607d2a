"""Joins and checks behind suite preflight, audits and regression gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidquarry.functions.text import casefold
from evidquarry.operators.metrics import DIGITS, REGRESSION_LIMIT
from evidquarry.operators.phrases import found_in

def contained_in(needles: DataFrame, haystack: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (needle_id, *key*): which text holds which phrase, ignoring case.

    *needles* has needle_id and needle; phrases of any length, empty ones are in every text.
    """
    folded = needles.select("needle_id", casefold(F.col("needle")).alias("needle"))
    return found_in(haystack, key, casefold(F.col(text)), folded).select("needle_id", key)


def resolution(cases: DataFrame, matches: DataFrame, floor: float) -> DataFrame:
    """Share of active answerable cases whose predicates find a chunk."""
    active = cases.where(F.col("answerable") & ~F.col("retired"))
    found = active.join(matches.select("case_id").distinct(), "case_id", "left_semi")
    total = active.agg(F.count(F.lit(1)).alias("answerable_cases"))
    resolved = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    rate = F.coalesce(resolved / F.nullif("answerable_cases", F.lit(0)), F.lit(0.0))
    return total.select(
        "answerable_cases",
        resolved.alias("resolved_gold_cases"),
        F.round(rate, DIGITS).alias("gold_resolution_rate"),
        (rate >= floor).alias("passed"),
    )


def regression_gate(rows: DataFrame) -> DataFrame:
    """Before/after rates by metric for all rows and per language, with the gate."""
    metrics = {
        "evidence_or_abstention_correct": F.lit(True),
        "gold_final_evidence_hit": F.col("answerable"),
        "verified_abstention": ~F.col("answerable"),
    }
    long = rows.select(
        "language",
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(keep, F.struct(F.lit(m).alias("metric"), F.col(f"baseline_{m}").alias("b"), F.col(f"staged_{m}").alias("s")))
                        for m, keep in metrics.items()
                    ]
                )
            )
        ).alias("m"),
    ).select("language", "m.*")
    before, after = F.avg(F.col("b").cast("int")), F.avg(F.col("s").cast("int"))
    grouped = long.groupingSets([["metric"], ["metric", "language"]], "metric", "language").agg(
        F.grouping("language").alias("_g"),
        F.count(F.lit(1)).alias("cases"),
        F.round(before, DIGITS).alias("baseline"),
        F.round(after, DIGITS).alias("staged"),
        F.round(100 * (before - after), DIGITS).alias("regression_points"),
    )
    named = grouped.withColumn("language", F.when(F.col("_g") == 1, "all").otherwise(F.col("language"))).drop("_g")
    return named.withColumn("passed", F.col("regression_points") <= REGRESSION_LIMIT)


def totals_check(items: DataFrame, group: str, declared: DataFrame) -> DataFrame:
    """Actual against declared counts per group; both sides must be complete."""
    actual = items.groupBy(F.col(group).alias("category")).agg(F.count(F.lit(1)).alias("actual"))
    return actual.join(declared, "category", "full_outer").select(
        "category",
        F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce("declared", F.lit(0)).alias("declared"),
        F.col("actual").eqNullSafe(F.col("declared")).alias("agrees"),
    )


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set equality through two anti differences."""
    extra = left.subtract(right).agg(F.count(F.lit(1)).alias("n"))
    missing = right.subtract(left).agg(F.count(F.lit(1)).alias("n")).scalar()
    return extra.select(
        F.col("n").alias("only_left"), missing.alias("only_right"), ((F.col("n") == 0) & (missing == 0)).alias("equal")
    )
