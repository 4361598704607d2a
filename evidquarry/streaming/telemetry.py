"""Stage telemetry: duration and item histograms over an event log or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Upper bounds of the duration and item histograms.
DURATION_BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 40.0, 60.0)
ITEM_BOUNDS = (0, 1, 2, 3, 5, 8, 10, 15, 25, 50, 100)


def bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """Smallest upper bound that holds the value, or +Inf."""
    out = F.when(value <= bounds[0], F.lit(str(bounds[0])))
    for bound in bounds[1:]:
        out = out.when(value <= bound, F.lit(str(bound)))
    return out.otherwise("+Inf")


def histogram(events: DataFrame, stage: str, value: Column, bounds: tuple[float, ...]) -> DataFrame:
    return events.groupBy(F.col(stage).alias("stage"), bucket(value, bounds).alias("le")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total")
    )


def windowed(events: DataFrame, stage: str, width: str, watermark: str | None = None) -> DataFrame:
    """Per-window counts and sums. The watermark is a Spark-side addition for streams."""
    source = events.withWatermark("ts", watermark) if watermark else events
    return source.groupBy(F.window("ts", width).alias("w"), F.col(stage).alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")
    ).select(F.col("w.start").alias("window_start"), "stage", "n", "total")
