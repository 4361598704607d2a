"""Dense cosine top-k: one query as a column expression, a batch as matrix passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.operators.best import SCHEMA, Best
from evidquarry.session import fits_within, shared_path

DIGITS = 6
# A block of query vectors travels to the tasks whole: 4096 x 1024 floats is 32 MB.
QUERIES_PER_PASS = 4096


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, value: acc + value)


def cosine(left: Column, right: Column) -> Column:
    return _dot(left, right) / F.sqrt(_dot(left, left) * _dot(right, right))


def similarity(left: Column, right: Column) -> Column:
    """Non-negative similarity, as an index reports ``max(0, 1 - distance)``."""
    return F.round(F.greatest(F.lit(0.0), cosine(left, right)), DIGITS)


def top_k(corpus: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Nearest *k* rows to the single vector held by *vector* (one row, one column).

    The vector enters as a scalar subquery; extra columns of *corpus* are kept.
    """
    extra = [c for c in corpus.columns if c != "embedding"]
    paired = corpus.withColumn("_query", vector.scalar())
    scored = paired.select(*extra, similarity(F.col("embedding"), F.col("_query")).alias("score"))
    return scored.orderBy(F.desc("score"), F.asc("chunk_id")).limit(k)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _local_top_k(query_ids: np.ndarray, matrix: np.ndarray, k: int):
    """Per-partition top-k for every query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(query_ids, k)
        for batch in batches:
            for start in range(0, batch.num_rows, best.portion):
                part = batch.slice(start, best.portion)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                cosines = _unit(flat.reshape(len(ids), -1)) @ matrix.T
                best.meet(ids, np.round(np.maximum(cosines, 0.0), DIGITS))
        yield best.rows()

    return run


def _block_top_k(corpus: DataFrame, block: DataFrame, k: int) -> DataFrame:
    rows = block.where(F.col("embedding").isNotNull()).select("query_id", "embedding").orderBy("query_id").collect()
    if not rows:
        return corpus.sparkSession.createDataFrame([], SCHEMA)
    matrix = _unit(np.array([row["embedding"] for row in rows], dtype=np.float64))
    stored = corpus.where(F.col("embedding").isNotNull()).select(F.col("chunk_id").cast("bigint"), "embedding")
    names = np.array([row["query_id"] for row in rows], dtype=np.int64)
    return stored.mapInArrow(_local_top_k(names, matrix, k), SCHEMA)


def batch_top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top *k* rows per query vector: query_id, chunk_id, score, dense_rank.

    A checked, bounded block of query vectors is sent to the tasks and every task
    returns only its own top-k, so the shuffle carries tasks x queries x k rows and
    never query-row pairs. More queries are cut into blocks that go one after the other:
    each block's rows are written before the next block is fetched, so the driver never
    holds more than one.
    """
    if fits_within(queries, QUERIES_PER_PASS):
        local = _block_top_k(corpus, queries, k)
    else:
        blocks = queries.count() * 2 // QUERIES_PER_PASS + 1
        slot = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        path = shared_path(corpus.sparkSession, "dense")
        for block in range(blocks):
            _block_top_k(corpus, queries.where(slot == block), k).write.mode("append").parquet(path)
        local = corpus.sparkSession.read.parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return local.withColumn("dense_rank", F.row_number().over(best)).where(F.col("dense_rank") <= k)
