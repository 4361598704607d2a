"""Exact order statistics without sorting a whole group in one task.

Values are counted per distinct value, counts are summed over a bounded number of
value ranges, and only ranges - not rows - meet in a window. Duplicates of one value
collapse in the first, map-side combined aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGES, STEP = 256, 16


def cumulative_counts(df: DataFrame, value: str, group: list[str], ranges: int = RANGES) -> DataFrame:
    """Distinct values with ``below`` (rows with a smaller value), ``n`` and ``total``."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(counted, value, group, ranges)


def prefix_sums(counted: DataFrame, value: str, group: list[str], ranges: int = RANGES) -> DataFrame:
    """Rows of distinct values with weight ``n``; adds ``below`` (weight of the smaller ones) and ``total``."""
    # Range ends are approximate quantiles of the distinct values: outliers cannot put all
    # values into one range, and any ends give exact results.
    cuts = F.percentile_approx(value, [i / ranges for i in range(1, ranges)])
    span = counted.groupBy(*group).agg(cuts.alias("_cuts"), F.sum("n").alias("total"))
    # one cut in STEP is looked at first, then those up to the next; taken once, not per row
    coarse = F.filter("_cuts", lambda _c, i: i % STEP == STEP - 1)
    span = span.withColumn("_coarse", coarse)
    if group:
        placed = counted.join(span, group)
    else:
        one = span.agg(F.first(F.struct("_cuts", "_coarse", "total")).alias("s")).scalar()
        placed = counted.withColumn("_s", one).select(*counted.columns, "_s.*")
    whole = F.size(F.filter("_coarse", lambda c: c < F.col(value))) * STEP
    part = F.size(F.filter(F.slice("_cuts", whole + 1, STEP), lambda c: c < F.col(value)))
    placed = placed.withColumn("_slot", whole + part).drop("_cuts", "_coarse")
    sizes = placed.groupBy(*group, "_slot").agg(F.sum("n").alias("_size"))
    ahead = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(ahead), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*group, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, [*group, "_slot"])
        .select(*counted.columns, "total", (F.col("_before") + F.col("_within")).alias("below"))
    )


def at_index(value: str, index: Column) -> Column:
    """Aggregate over the counts of a group: the value at a zero-based index of its sorted rows."""
    return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(value)))


def nearest_rank(value: str, fraction: float) -> Column:
    """Percentile by index ``round((n - 1) * p)``, halves to even."""
    return at_index(value, F.bround((F.col("total") - 1) * F.lit(fraction), 0).cast("bigint"))


def median(value: str) -> Column:
    """Mean of the two middle values."""
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    return (at_index(value, low) + at_index(value, high)) / 2
