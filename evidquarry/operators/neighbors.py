"""Neighbour expansion with per-source caps.

What the caps still allow depends on what was taken before, so the choice is a fold. It runs
over one sorted array of offers for each question, drawn from a pool that ranking has bounded
(at most 50 rows): every anchor in rank order, each followed by its adjacent chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FIELDS = ["ord", "chunk_id", "source_id", "parent_id", "source_version", "chunk_ordinal"]
TAKEN = "array<struct<chunk_id:bigint,source_id:string,neighbor_of:bigint>>"


def expand_neighbors(pool: DataFrame, top_n: int, per_anchor: int, per_source: int) -> DataFrame:
    """query_id, chunk_id, rn, neighbor_of (null for anchors) within the three caps."""

    def adjacent(anchor, row):
        return (
            (row.parent_id == anchor.parent_id)
            & (row.source_version == anchor.source_version)
            & (F.abs(row.chunk_ordinal - anchor.chunk_ordinal) == 1)
        )

    def offer(row, anchor_id):
        return F.struct(row.chunk_id.alias("chunk_id"), row.source_id.alias("source_id"), anchor_id.alias("neighbor_of"))

    def offers(rows):
        nobody = F.lit(None).cast("bigint")
        return F.flatten(F.transform(rows, lambda anchor: F.concat(
            F.array(offer(anchor, nobody)),
            F.transform(F.filter(rows, lambda row: adjacent(anchor, row)), lambda row: offer(row, anchor.chunk_id)),
        )))

    def fold(taken, made):
        room = F.size(taken) < top_n
        new = ~F.exists(taken, lambda t: t.chunk_id == made.chunk_id)
        source = F.size(F.filter(taken, lambda t: t.source_id == made.source_id)) < per_source
        siblings = F.size(F.filter(taken, lambda t: t.neighbor_of == made.neighbor_of)) < per_anchor
        fits = room & new & source & (made.neighbor_of.isNull() | siblings)
        return F.when(fits, F.concat(taken, F.array(made)).cast(TAKEN)).otherwise(taken)

    ordered = F.array_sort(F.collect_list(F.struct(*FIELDS)))
    chosen = pool.groupBy("query_id").agg(ordered.alias("rows")).select(
        "query_id", F.posexplode(F.aggregate(offers(F.col("rows")), F.array().cast(TAKEN), fold)).alias("place", "t"))
    return chosen.select("query_id", "t.chunk_id", (F.col("place") + 1).alias("rn"), "t.neighbor_of")
