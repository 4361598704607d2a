"""Scores and embeddings kept by content, so that a second run scores only what is new.

A value is stored under the digest of all it depends on (model, version and the texts). Values
and uses are appended as they come; eviction writes the rows that stay as the next generation
and switches the versioned table's pointer, so a reader never sees half of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidquarry.sources.versions import VersionedTable, present

_ROW = "digest string, score double, at bigint, used bigint"
_LOG = "generation int, batch string"


class ScoreStore:
    """A table (digest, score, stored at, last used) in the shared folder; time is the caller's."""

    def __init__(self, spark: SparkSession, root: str, model: str, version: str) -> None:
        self._spark, self._root, self._model, self._version = spark, root, model, version
        self._table = VersionedTable(spark, f"{root}/generations")
        if self._table.version is None:
            self._table.publish(spark.createDataFrame([], _ROW), "empty")

    def digest(self, *parts: Column) -> Column:
        separated = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
        return F.sha2(F.concat_ws("\u0000", F.lit(self._model), F.lit(self._version), *separated), 256)

    def _append(self, rows: DataFrame) -> None:
        """A batch in a folder of its own, seen once it is in the log."""
        batch = uuid.uuid4().hex
        rows.select("digest", "score", "at", "used").write.parquet(f"{self._root}/batches/{batch}")
        entry = self._spark.createDataFrame([(self._table.version, batch)], _LOG).coalesce(1)
        entry.write.mode("append").parquet(f"{self._root}/log")

    def rows(self) -> DataFrame:
        """One row a digest: its score, when it was stored and last used.

        The folders read are named one by one: two scans of one folder with different files
        count as equal to the planner, which would then read only one of them.
        """
        log = present(self._spark, f"{self._root}/log", _LOG)
        batches = [] if log is None else [r.batch for r in log.where(F.col("generation") == self._table.version).orderBy("batch").collect()]
        found = self._table.read()
        if batches:
            found = found.unionByName(self._spark.read.schema(_ROW).parquet(*(f"{self._root}/batches/{b}" for b in batches)))
        return found.groupBy("digest").agg(F.max("score").alias("score"), F.max("at").alias("at"), F.max("used").alias("used"))

    def scored(self, pairs: DataFrame, score: Column, now: int) -> DataFrame:
        """*pairs* (with a digest column) with score and hit; only digests not stored are scored.

        Equal pairs are scored once. What was scored, and the use of what was found, is appended
        before the result is read back, so the result does not score again.
        """
        known = self.rows().select("digest", F.col("score").alias("known"))
        fresh = pairs.dropDuplicates(["digest"]).join(known, "digest", "left_anti")
        new = fresh.select("digest", score.cast("double").alias("score"), F.lit(now).cast("bigint").alias("at"), F.lit(now).cast("bigint").alias("used"))
        touched = pairs.select("digest").distinct().join(known, "digest", "left_semi").select(
            "digest", F.lit(None).cast("double").alias("score"), F.lit(None).cast("bigint").alias("at"), F.lit(now).cast("bigint").alias("used"))
        self._append(new.unionByName(touched))
        stored = self.rows().select("digest", "score", (F.col("at") < now).alias("hit"))
        return pairs.join(stored, "digest")

    def evict(self, now: int, ttl: int | None = None, capacity: int | None = None) -> None:
        """Drop what was stored more than *ttl* ago, then all but the *capacity* last used rows."""
        kept = self.rows()
        if ttl is not None:
            kept = kept.where(F.col("at") >= now - ttl)
        if capacity is not None:
            kept = kept.orderBy(F.desc("used"), "digest").limit(capacity)
        self._table.publish(kept.select("digest", "score", "at", "used"), "evict")


def cached_frame(spark: SparkSession, root: str, key: str, load: Callable[[], DataFrame], now: int, ttl: int) -> tuple[DataFrame, bool]:
    """A corpus kept under its key until it expires: the frame, and whether it was still held."""
    held = VersionedTable(spark, f"{root}/{key}")
    if held.version is not None:
        frame = held.read()
        stored_at = frame.select(F.max("_stored_at")).first()[0]
        if stored_at is not None and now - stored_at < ttl:
            return frame.drop("_stored_at"), True
    held.publish(load().withColumn("_stored_at", F.lit(now).cast("bigint")))
    return held.read().drop("_stored_at"), False
