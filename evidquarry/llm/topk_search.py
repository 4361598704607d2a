"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector is cut into segments; of each only the mean and the norm of the deviations from it
are kept. For segment means a, b and deviation norms s, t over w components, the inner
product of two segments is at most w*a*b + s*t, so the sum over segments bounds the score
from above (and the distance |q|^2 + |x|^2 - 2*score from below). Coarse segments are tried
first, survivors meet finer ones, and exact integer scores are computed for what is left.
The bar is each query's k-th best score so far in the task; ties stay in until ids decide.
A step meets at most ``SLICE`` queries with ``ROWS`` rows, so its memory has a fixed bound.

Queries go to the tasks in blocks of at most ``BLOCK_COMPONENTS`` components (16 MB). Each
block is one scan of the vectors, its task results are appended to a table in the shared
folder before the next block is fetched; the driver never holds more than one block, and no
pairs are shuffled, only k rows a query and task.

Defined results: vectors that are null, or hold a null or non-finite component, and rows
without an id take no part; vectors of different length do not meet; a row repeated among
the candidates takes as many places; a query repeated is answered once; queries without any
candidate and empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidquarry.llm.base import fresh_path, table

BLOCK_COMPONENTS = 2_000_000
SEGMENTS = (4, 16)
ROWS = 1024  # candidate rows a step
SLICE = 1024  # queries a step; a step holds at most ROWS * SLICE pairs (about 50 MB)
WARM = 32
EXACT = 2.0**52  # beyond this a double no longer adds integers exactly


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose inner products bound those of the vectors: scaled means, deviation norms."""
    cuts = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    means, norms = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = vectors[:, lo:hi]
        mean = part.mean(1)
        means.append(mean * np.sqrt(hi - lo))
        norms.append(np.sqrt(np.square(part - mean[:, None]).sum(1)))
    return np.stack(means + norms, axis=1)


class Best:
    """The best k (score, id) of a slice of queries of one length, kept while candidates stream by."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.real = vectors.astype(np.float64)
        self.largest = np.abs(self.real).max(initial=0)
        self.levels = [segment_statistics(self.real, s) for s in SEGMENTS if s < vectors.shape[1]]
        self.bar = np.full(len(ids), -np.inf)
        self.rows = np.empty((3, 0), np.int64)  # query position, score, id

    def meet(self, rows: Portion) -> None:
        shape = (len(self.ids), len(rows.ids))
        query, other = np.nonzero(np.ones(shape, bool))
        for own, theirs in zip(self.levels, rows.levels, strict=True):
            bound = self._products(own, theirs, query, other, shape)
            left = bound * (1 + 1e-9 * np.sign(bound)) + 1e-3 >= self.bar[query]
            query, other = query[left], other[left]
        keep = self.ids[query] != rows.ids[other]
        query, other = query[keep], other[keep]
        if self.largest * rows.largest * max(1, rows.real.shape[1]) < EXACT:
            score = self._products(self.real, rows.real, query, other, shape).astype(np.int64)
        else:
            score = np.array([(self.vectors[q] * rows.vectors[o]).sum() for q, o in zip(query, other, strict=True)], np.int64)
        keep = score >= self.bar[query]
        if not keep.any():
            return
        found = np.concatenate([self.rows, np.stack([query[keep], score[keep], rows.ids[other[keep]]])], axis=1)
        found = found[:, np.lexsort((found[2], -found[1], found[0]))]
        place = np.arange(found.shape[1]) - np.searchsorted(found[0], found[0])
        self.rows = found[:, place < self.k]
        full = found[:, place == self.k - 1]
        self.bar[full[0]] = full[1]

    @staticmethod
    def _products(left, right, query, other, shape) -> np.ndarray:
        if len(query) * 4 > shape[0] * shape[1]:
            return (left @ right.T)[query, other]
        parts = [np.einsum("ij,ij->i", left[query[i : i + 100_000]], right[other[i : i + 100_000]]) for i in range(0, len(query), 100_000)]
        return np.concatenate(parts) if parts else np.empty(0)


class Portion:
    """Candidate rows of one length with their statistics, met by every slice of the queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.real = vectors.astype(np.float64)
        self.largest = np.abs(self.real).max(initial=0)
        self.levels = [segment_statistics(self.real, s) for s in SEGMENTS if s < vectors.shape[1]]


def portions(ids: np.ndarray, vectors: np.ndarray, first: int) -> Iterator[Portion]:
    """Portions of at most ROWS rows; a small first one gives the bars a start."""
    at, size = 0, min(first, ROWS)
    while at < len(ids):
        yield Portion(ids[at : at + size], vectors[at : at + size])
        at, size = at + size, min(ROWS, 4 * size)


def _whole_vectors(rows: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    scaled = F.transform(vector_col, lambda x: F.floor(F.lit(factor) * x.cast("double")))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def exact_top_k(
    queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0,
) -> DataFrame:
    """Rows (query_id, rank, id, score): the k best candidates of each query but its own row."""
    spark = candidates.sparkSession
    asked = _whole_vectors(queries, id_col, vector_col, factor).distinct()
    rows = _whole_vectors(candidates, id_col, vector_col, factor)
    components = asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    blocks = -(-components // BLOCK_COMPONENTS)
    schema = "query_id long, id long, score long"
    path = fresh_path(spark, "topk")
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block).collect()
        by_length: dict[int, list] = {}
        for row in part:
            by_length.setdefault(len(row.v), []).append(row)
        packed = {n: (np.array([r.id for r in own], np.int64), np.array([r.v for r in own], np.int64).reshape(len(own), n)) for n, own in by_length.items()}
        sent = spark.sparkContext.broadcast(packed)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = {n: [Best(ids[i : i + SLICE], own[i : i + SLICE], k) for i in range(0, len(ids), SLICE)] for n, (ids, own) in sent.value.items()}
            met: set[int] = set()
            for batch in batches:
                lists = batch.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                for n in np.unique(lengths).tolist():
                    if n not in best:
                        continue
                    here = batch.filter(pa.array(lengths == n))
                    ids = here.column(0).to_numpy()
                    vectors = here.column(1).flatten().to_numpy().reshape(len(ids), n)
                    for portion in portions(ids, vectors, ROWS if n in met else WARM):
                        for own in best[n]:
                            own.meet(portion)
                    met.add(n)
            for own in (own for slices in best.values() for own in slices):
                query, score, other = own.rows
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[query]), pa.array(other), pa.array(score)], names=["query_id", "id", "score"])

        rows.mapInArrow(scan, schema).write.mode("append").parquet(path)
        sent.unpersist()
    found = spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows.where("vec_id % 50 = 0"), rows, 5)


QUERIES = {"op2_segment_topk": op2_segment_topk}
ORACLES = {
    "op2_segment_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
