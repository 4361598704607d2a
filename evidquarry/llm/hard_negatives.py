"""Hard negatives mined with Kronecker-packed products.

Method
------
Vectors become integer components floor(factor * x). For a portion of candidates a bias makes
every component non-negative; the same component of several candidates is then written into
separated fields of one wide integer. One multiplication by an anchor's (biased) component
serves all fields, and the sum over the components is one integer whose fields are the biased
inner products: fields are as wide as the largest possible sum, so none runs over into the
next. Exact scores come out by shift and mask, less the terms the biases added. The wide
integer is the 53 exact bits of a double (matrix products), else 63 bits, and where not even
two fields fit there, an integer of any length with ``WIDE_FIELDS`` fields.

Two scans for each block of anchors. The first keeps each anchor's best rows of its own label
(the positives), the second, for each positive, the best rows of another label whose score
lies in the asked share of the positive's. Tasks hand on at most that many rows an anchor or
positive; no pair of rows is shuffled. A block has at most ``BLOCK_COMPONENTS`` components
(16 MB); its rows are written to the shared folder before the next block is fetched, and a
step in a task meets at most ``SLICE`` anchors with ``ROWS`` candidates.

Defined results: rows without an id or label, with a null vector, or a null or non-finite
component take no part; vectors of different length do not meet; an equal anchor row counts
once, rows of one id that differ are anchors of their own; a row repeated among the candidates
takes as many places; rows with the anchor's id are never its candidates; anchors without a
positive, positives without a fitting row, and empty tables give no rows; scores past the range
of a long are held at its ends; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidquarry.llm.base import fresh_path, stored, table

BLOCK_COMPONENTS = 2_000_000
ROWS, SLICE = 1024, 512
WIDE_FIELDS = 8
LONG = np.iinfo(np.int64)


class Packed:
    """Candidates of one length, several to a wide integer, ready to be met by anchors."""

    def __init__(self, vectors: np.ndarray, most: int):
        """*most* is the largest biased component of the anchors."""
        self.rows, self.size = vectors.shape
        self.bias = -int(vectors.min(initial=0))
        span = int(vectors.max(initial=0)) + self.bias
        self.sums = (vectors.astype(object) if self.size * span >= 2**62 else vectors).sum(1)
        top = self.size * most * span
        self.width = max(1, top.bit_length())
        kind, self.fields = next(((k, bits // self.width) for k, bits in ((np.float64, 53), (np.int64, 63)) if bits // self.width >= 2), (object, WIDE_FIELDS))
        pad = -self.rows % self.fields
        biased = np.concatenate([vectors.astype(object if kind is object else np.int64) + self.bias, np.zeros((pad, self.size), np.int64)])
        biased = biased.reshape(self.fields, len(biased) // self.fields, self.size)  # field f holds the f-th stretch of rows
        packed = sum(biased[f] << (self.width * f) for f in range(self.fields))
        self.packed = packed.astype(kind)

    def scores(self, anchors: np.ndarray, bias: int) -> np.ndarray:
        """Exact inner products, one row for each of the anchors (biased by *bias*)."""
        product = anchors.astype(self.packed.dtype) @ self.packed.T
        if self.packed.dtype == np.float64:
            product = product.astype(np.int64)
        mask = (1 << self.width) - 1
        fields = [(product >> (self.width * f)) & mask for f in range(self.fields)]
        biased = np.concatenate(fields, axis=1)[:, : self.rows]
        if biased.dtype != object:
            own = anchors.sum(1) - self.size * bias
            return biased - (self.bias * own)[:, None] - (bias * self.sums)[None, :] - self.size * bias * self.bias
        own = anchors.astype(object).sum(1) - self.size * bias
        exact = biased - (self.bias * own)[:, None] - (bias * self.sums.astype(object))[None, :] - self.size * bias * self.bias
        return np.minimum(np.maximum(exact, int(LONG.min)), int(LONG.max)).astype(np.int64)


class Anchors:
    """A slice of anchors of one length: biased components, labels, and wanted score ranges."""

    def __init__(self, rows: list, positives: dict[int, list[tuple[int, int, int]]] | None, low: int, high: int):
        self.keys = np.array([r.key for r in rows], np.int64)
        self.ids = np.array([r.id for r in rows], np.int64)
        self.labels = np.array([r.label for r in rows], np.int64)
        vectors = np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v))
        self.bias = -int(vectors.min(initial=0))
        self.most = int(vectors.max(initial=0)) + self.bias
        self.biased = vectors.astype(object) + self.bias if self.most >= 2**62 else vectors + self.bias
        found = [(positives or {}).get(r.key, ()) for r in rows]
        self.places = max(map(len, found))
        self.low = np.full((self.places, len(rows)), LONG.max)
        self.high = np.full((self.places, len(rows)), LONG.min)
        for at, own in enumerate(found):
            for place, (_, _, score) in enumerate(own):
                self.low[place, at], self.high[place, at] = -(-low * score // 100), high * score // 100


class Kept:
    """The best k (score, id) of every slot, ties to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.bar = k, np.full(slots, LONG.min)
        self.rows = np.empty((3, 0), np.int64)  # slot, score, id

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        rows = np.concatenate([self.rows, np.stack([slot, score, ids])], axis=1)
        rows = rows[:, np.lexsort((rows[2], ~rows[1], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, place < self.k]
        last = rows[:, place == self.k - 1]
        self.bar[last[0]] = last[1]


def _scan(blocks: dict[int, list[Anchors]], k: int, negatives: bool):
    """The scan of one block: best rows of the own label, or of others within each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {n: [Kept(len(a.ids) * max(1, a.places), k) for a in own] for n, own in blocks.items()}
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for n in np.unique(lengths).tolist():
                if n not in blocks:
                    continue
                here = batch.filter(pa.array(lengths == n))
                ids, labels = here.column(0).to_numpy(), here.column(1).to_numpy()
                vectors = here.column(2).flatten().to_numpy().reshape(len(ids), n)
                most = max(a.most for a in blocks[n])
                for at in range(0, len(ids), ROWS):
                    packed = Packed(vectors[at : at + ROWS], most)
                    _meet(packed, ids[at : at + ROWS], labels[at : at + ROWS], blocks[n], kept[n], negatives)
        for n, own in blocks.items():
            for anchors, best in zip(own, kept[n], strict=True):
                slot, score, other = best.rows
                at, place = slot % len(anchors.ids), slot // len(anchors.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.keys[at]), pa.array(place), pa.array(other), pa.array(score)],
                    names=["key", "place", "id", "score"])

    return run


def _meet(packed: Packed, ids: np.ndarray, labels: np.ndarray, slices: list[Anchors], kept: list[Kept], negatives: bool) -> None:
    for anchors, best in zip(slices, kept, strict=True):
        score = packed.scores(anchors.biased, anchors.bias)
        alike = (anchors.labels[:, None] == labels[None, :]) & (anchors.ids[:, None] != ids[None, :])
        differ = anchors.labels[:, None] != labels[None, :]
        if not negatives:
            at, row = np.nonzero(alike & (score >= best.bar[:, None]))
            best.add(at, score[at, row], ids[row])
            continue
        for place in range(anchors.places):
            slots = slice(place * len(anchors.ids), (place + 1) * len(anchors.ids))
            least = np.maximum(anchors.low[place], best.bar[slots])
            at, row = np.nonzero(differ & (score >= least[:, None]) & (score <= anchors.high[place][:, None]))
            other = anchors.ids[at] != ids[row]
            at, row = at[other], row[other]
            best.add(at + slots.start, score[at, row], ids[row])


def _vectors(rows: DataFrame, id_col: str, label: Column, vector_col: str, factor: float) -> DataFrame:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vector_col, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long"))
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite & label.isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("v")).where("label is not null")


def mined(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, factor: float = 256.0,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    *anchor* says which rows are anchors. A negative's score is from *low* to *high* per cent
    of the positive's.
    """
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    whole = _vectors(rows, id_col, label, vector_col, factor)
    asked = _vectors(rows.where(anchor), id_col, label, vector_col, factor).distinct().withColumn("key", F.xxhash64("id", "label", "v"))
    components = asked.agg(F.sum(F.size("v") + 3)).first()[0] or 0
    blocks = -(-components // BLOCK_COMPONENTS)
    schema, path = "key long, place long, id long, score long", fresh_path(spark, "hard-negatives")
    out = "anchor_id long, anchor_key long, place long, positive_id long, positive_score long, id long, score long"
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    for block in range(blocks):
        by_length: dict[int, list] = {}
        for row in asked.where(F.pmod("key", F.lit(blocks)) == block).collect():
            by_length.setdefault(len(row.v), []).append(row)

        def sent(found, by_length=by_length):
            return spark.sparkContext.broadcast({
                n: [Anchors(own[i : i + SLICE], found, low, high) for i in range(0, len(own), SLICE)] for n, own in by_length.items()})

        first = sent(None)
        near = whole.mapInArrow(lambda batches, b=first: _scan(b.value, positives, False)(batches), schema)
        near = stored(near.withColumn("place", best("key").cast("long")).where(F.col("place") <= positives), "positives")
        found: dict[int, list] = {}
        for r in near.orderBy("key", "place").collect():  # at most *positives* for each anchor of the block
            found.setdefault(r.key, []).append((r.place, r.id, r.score))
        second = sent(found)
        far = whole.mapInArrow(lambda batches, b=second: _scan(b.value, negatives, True)(batches), schema)
        anchors = [(r.key, r.id, p - 1, i, s) for own in by_length.values() for r in own for p, i, s in found.get(r.key, ())]
        names = spark.createDataFrame(anchors, "key long, anchor_id long, place long, positive_id long, positive_score long")
        far.join(names, ["key", "place"]).selectExpr("anchor_id", "key AS anchor_key", "place", "positive_id", "positive_score", "id", "score").write.mode("append").parquet(path)
        first.unpersist()
        second.unpersist()
    hits = spark.read.schema(out).parquet(path) if blocks else spark.createDataFrame([], out)
    ranked = hits.withColumn("rank", best("anchor_id", "anchor_key", "place")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows, F.col("vec_id") % 50 == 0, label=label)


QUERIES = {"op12_kronecker_negatives": op12_kronecker_negatives}
ORACLES = {
    "op12_kronecker_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
}
