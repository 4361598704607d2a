"""Helpers the training-data operators share: tables, shared-folder storage, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: the session's ``spark.checkpoint.dir``.

    A scratch folder is taken only where the setting is absent and the master is local.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder; Spark removes the files once the frame is gone."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_portions(column: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in portions of about *most* characters; nulls are empty texts.

    Texts become Python strings one portion at a time, never a whole batch at once.
    """
    start, texts, size = 0, [], 0
    for row in range(len(column)):
        texts.append(column[row].as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield start, texts
            start, texts, size = row + 1, [], 0
    if texts:
        yield start, texts


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables holding whole key groups, from batches of a partition sorted by *keys*.

    Each table carries as many complete groups as one batch brought; only the last,
    possibly unfinished group is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = batch.num_rows - 1
        start = last
        tail = [batch.column(k)[last] for k in keys]
        columns = [batch.column(k) for k in keys]
        lo, hi = 0, last  # first row of the group the batch ends with
        while lo < hi:
            mid = (lo + hi) // 2
            if all(c[mid] == t for c, t in zip(columns, tail, strict=True)):
                hi = mid
            else:
                lo = mid + 1
        start = lo
        if start == 0:
            same = held and all(held[-1].column(k)[held[-1].num_rows - 1] == t for k, t in zip(keys, tail, strict=True))
            if held and not same:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def joined_labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..count-1, the smallest node reachable over the given pairs."""
    label = np.arange(count)
    while True:
        least = np.minimum(label[left], label[right])
        if (least == label[left]).all() and (least == label[right]).all():
            return label
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        label = label[label]


def _with_least(links: DataFrame) -> DataFrame:
    """Each link (a, b) with m, the least of a and its partners."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return links.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the pairs (a, b): one row (id, component) per node.

    Alternating large-star and small-star joins: every round replaces a node's links by
    links to the smallest neighbour, keeps at most one row per link, and goes through a
    checkpoint. ``component`` is the smallest id reachable. Rows with null are dropped.
    """
    current = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            _with_least(both).where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        small = (
            _with_least(large)
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        current = cut(small)
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 1000003)).first()
        if seen == mark:
            break
        mark = seen
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
