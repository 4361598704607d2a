"""Versioned tables: publish to a new folder, switch a pointer, roll back by checksum.

``root/data/version=N`` holds a version, ``root/manifest/version=N`` a row for each of its files
(rows and an order-free checksum), ``root/pointer/seq=N`` one row naming the version in force.
A pointer is a new folder that must not exist yet, so two writers cannot both take a place, and
readers see either the old version or the new one; nothing is renamed or overwritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_POINTER = "at int, version int, reason string, seq int"


def present(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table under a path, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark, self._root = spark, root

    def _pointers(self) -> list:
        """The pointer rows so far: one small row for each publish or rollback."""
        rows = present(self._spark, f"{self._root}/pointer", _POINTER)
        return [] if rows is None else rows.orderBy("seq").collect()

    def _point(self, version: int, reason: str) -> None:
        seq = max((p.seq for p in self._pointers()), default=0) + 1
        row = self._spark.createDataFrame([(seq, version, reason)], "at int, version int, reason string").coalesce(1)
        row.write.mode("errorifexists").parquet(f"{self._root}/pointer/seq={seq}")

    def _files(self, version: int) -> DataFrame:
        rows = self._spark.read.parquet(f"{self._root}/data/version={version}")
        digest = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        return rows.select(name.alias("file"), digest.alias("digest")).groupBy("file").agg(
            F.count(F.lit(1)).alias("rows"), F.bit_xor("digest").alias("checksum"))

    def publish(self, df: DataFrame, reason: str = "publish") -> int:
        """Write the next version with its manifest, then put it in force."""
        version = max((p.version for p in self._pointers()), default=0) + 1
        df.write.mode("errorifexists").parquet(f"{self._root}/data/version={version}")
        self._files(version).write.mode("errorifexists").parquet(f"{self._root}/manifest/version={version}")
        self._point(version, reason)
        return version

    @property
    def version(self) -> int | None:
        pointers = self._pointers()
        return pointers[-1].version if pointers else None

    def read(self, version: int | None = None) -> DataFrame:
        wanted = self.version if version is None else version
        if wanted is None:
            raise LookupError("nothing has been published")
        return self._spark.read.parquet(f"{self._root}/data/version={wanted}")

    def intact(self, version: int) -> bool:
        """Whether the files of a version are still those of its manifest."""
        kept = self._spark.read.parquet(f"{self._root}/manifest/version={version}")
        found = self._files(version)
        return kept.exceptAll(found).isEmpty() and found.exceptAll(kept).isEmpty()

    def roll_back(self, version: int) -> None:
        """Put an earlier version in force again, if its files are intact."""
        if version not in {p.version for p in self._pointers()}:
            raise LookupError(f"version {version} was never in force")
        if not self.intact(version):
            raise ValueError(f"version {version} differs from its manifest")
        self._point(version, "rollback")

    def history(self) -> DataFrame:
        return self._spark.createDataFrame([(p.seq, p.version, p.reason) for p in self._pointers()], "seq int, version int, reason string")
