"""MinHash near-duplicate removal over HyperMinHash registers.

Method
------
1. One pass turns each text into its shingle set and keeps, per document, the set size, a
   128-bit set fingerprint and 128 registers: the top seven bits of a shingle hash choose
   the register, which stores the leading-zero count of the smallest remaining bits and the
   ten mantissa bits after the leading one (16 bits a register).
2. Documents with equal fingerprints form a class; its smallest id stands for it.
3. Registers, with empty ones borrowed from a fixed random sequence of others, are banded
   (21 bands of 6 at similarity 0.85, 25 of 5 at 0.8). Inside a bucket, pairs are compared on registers alone: the share of
   equal registers less the expected chance collisions estimates the Jaccard similarity;
   pairs five standard deviations or less below the threshold count as candidates. A bucket
   of many texts is cut into blocks, one task for each pair of blocks; a task hands on a
   label for each text, not the pairs.
4. Candidates that hang together form a cluster. Its texts are fetched once and every pair
   of the cluster is verified on full shingle sets (again in blocks).
5. Components of the verified links give each document the smallest id it is linked to.

Two texts at the threshold share no band with probability 5e-5; the chance falls steeply
above it.

Defined results: null or white-space-only texts have an empty set, are linked to nothing
and stay; a null id has a null component and stays; repeated ids are one node; empty tables
give empty results; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidquarry.llm.base import components, groups_of, joined_labels, stored, table
from evidquarry.llm.shingles import WIDTH, mixed, shingle_set

REGISTERS, MANTISSA = 128, 10
MISSED = 1e-4  # highest chance that two texts at the threshold share no band
EMPTY = np.uint16(0xFFFF)
DEVIATIONS = 5.0
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 512, 256, 400_000
COLUMNS = 4096
_PREFIX = int(math.log2(REGISTERS))
_BORROW = np.array([np.random.default_rng(7 + j).permutation(REGISTERS) for j in range(REGISTERS)]).T


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row for each sorted set of 64-bit hashes."""
    out = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    hashes = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    slot = (hashes >> np.uint64(64 - _PREFIX)).astype(np.int64)
    place = owner * REGISTERS + slot
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]  # sets are sorted: the first of a slot is its minimum
    rest = (hashes[first] << np.uint64(_PREFIX)) >> np.uint64(11)  # 53 bits, exact as a double
    exponent = np.frexp(rest.astype(np.float64))[1]
    zeros = (53 - exponent).astype(np.uint64)
    leading = ((rest << zeros) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out.reshape(-1)[place[first]] = ((zeros << np.uint64(MANTISSA)) | leading).astype(np.uint16)
    return out


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows): the most selective bands that miss a pair at the threshold at most MISSED of the time."""
    for rows in range(16, 1, -1):
        if (1 - similarity**rows) ** (REGISTERS // rows) <= MISSED:
            return REGISTERS // rows, rows
    return REGISTERS, 1


def band_keys(regs: np.ndarray, bands: int, width: int) -> np.ndarray:
    """Keys of all bands; an empty register takes the first filled one of its own sequence."""
    full = regs.copy()
    open_rows = np.flatnonzero((regs == EMPTY).any(1) & (regs != EMPTY).any(1))
    part, source = full[open_rows], regs[open_rows]
    for order in _BORROW:
        missing = part == EMPTY
        if not missing.any():
            break
        part = np.where(missing, source[:, order], part)
    full[open_rows] = part
    rows = full[:, : bands * width].reshape(len(full), bands, width).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2]).copy()
    for i in range(width):
        key = mixed(key + rows[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def chance_collisions(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Expected equal registers of two unrelated sets of these sizes."""
    ratio = large / np.maximum(small, 1)
    return 0.1699 * REGISTERS / 2.0**MANTISSA * 4 * ratio / (1 + ratio) ** 2


def _sketch(similarity: float):
    fewest = math.ceil(round(similarity / (1 - similarity), 9)) if similarity < 1 else 1 << 62
    bands, width = banding(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                regs = registers(sets)
                sizes = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    one = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                    two = np.array([np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], np.uint64)
                keys = band_keys(regs, bands, width)
                usable = sizes >= fewest  # smaller sets cannot differ and still reach the threshold
                offsets = np.concatenate(([0], np.cumsum(np.where(usable, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array(sizes),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[usable].reshape(-1))),
                ], names=["id", "n", "fp_a", "fp_b", "regs", "bands"])

    return run


def _labelled(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    label = joined_labels(len(ids), left, right)
    other = np.flatnonzero((label != np.arange(len(ids))) & (ids[label] != ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[label[other]])], names=["a", "b"])


def _alike_in_buckets(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["bucket", "lo", "hi"]):
            ids, sizes = (rows.column(c).to_numpy() for c in ("id", "n"))
            regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            bucket, lo, hi = (rows.column(c).to_numpy() for c in ("bucket", "lo", "hi"))
            new = np.ones(len(ids), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            group = np.cumsum(new)
            pairs, step = [], 1
            while True:
                here = np.flatnonzero(group[step:] == group[:-step]) if step < len(ids) else []
                if not len(here):
                    break
                for at in range(0, len(here), 8192):
                    i = here[at : at + 8192]
                    small, large = np.minimum(sizes[i], sizes[i + step]), np.maximum(sizes[i], sizes[i + step])
                    i = i[fit := small >= similarity * large - 1e-9]
                    small, large = small[fit], large[fit]
                    x, y = regs[i], regs[i + step]
                    filled = ((x != EMPTY) | (y != EMPTY)).sum(1)
                    equal = ((x == y) & (x != EMPTY)).sum(1)
                    estimate = (equal - chance_collisions(small, large)) / filled
                    i = i[estimate >= similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / filled)]
                    pairs.append(np.stack([i, i + step]))
                step += 1
            if pairs:
                yield _labelled(ids, *np.concatenate(pairs, axis=1))

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, as products of 0/1 matrices over column chunks."""
    count = len(sets)
    inter = np.zeros((count, count), np.int64)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = np.flatnonzero(times[column] > 1)
    renamed = np.cumsum(times > 1) - 1
    owner, column = owner[kept], renamed[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int((times > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((count, COLUMNS), np.float32)
        dense[owner[lo:hi], column[lo:hi] - start] = 1
        inter += (dense @ dense.T).astype(np.int64)
    np.fill_diagonal(inter, [len(s) for s in sets])
    return inter


def _verified(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["cluster", "lo", "hi"]):
            keys = np.stack([rows.column(c).to_numpy() for c in ("cluster", "lo", "hi")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for start, end in zip([0, *edges], [*edges, rows.num_rows], strict=True):
                if end - start < 2:
                    continue
                ids = rows.column("id").slice(start, end - start).to_numpy()
                sets = [shingle_set(t.as_py()) for t in rows.column("text").slice(start, end - start)]
                sizes = np.array([len(s) for s in sets])
                inter = shared_counts(sets)
                union = sizes[:, None] + sizes[None, :] - inter
                left, right = np.nonzero(np.triu((100 * inter >= per_cent * union) & (union > 0), 1))
                yield _labelled(ids, left, right)

    return run


def _blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Rows of one group over *blocks* blocks: each row goes to every pair its block is in."""
    return (
        rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
        .drop("own", "other", blocks)
        .repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 80) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) per input row.

    Documents whose shingle sets have 100 * intersection >= per_cent * union are linked;
    ``component_id`` is the smallest id reachable, ``kept`` marks the document with that id.
    """
    similarity = per_cent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = stored(
        texts.mapInArrow(_sketch(similarity), "id long, n long, fp_a long, fp_b long, regs binary, bands array<long>"),
        "sketches",
    )
    named = sketches.where("id is not null and n > 0")
    classes = stored(
        named.groupBy("n", "fp_a", "fp_b")
        .agg(F.count("*").alias("copies"), F.min(F.struct("id", "regs", "bands")).alias("rep"))
        .select("n", "fp_a", "fp_b", "copies", "rep.id", "rep.regs", "rep.bands"),
        "classes",
    )
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = (
        banded.join(shared, "bucket")
        .select("bucket", "id", F.ceil(F.col("members") / BUCKET_BLOCK).alias("blocks"))
        .join(classes.select("id", "n", "regs"), "id")
    )
    alike = _blocks(members, "bucket", "blocks").mapInArrow(_alike_in_buckets(similarity), "a long, b long")
    clusters = stored(components(alike).withColumnRenamed("component", "cluster"), "clusters")
    sizes = clusters.join(classes.select("id", "n"), "id").groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n") / CLUSTER_SHINGLES)).alias("blocks"))
    gathered = texts.join(clusters.join(sizes, "cluster"), "id")
    links = _blocks(gathered, "cluster", "blocks").mapInArrow(_verified(per_cent), "a long, b long")
    linked = components(links)
    answers = (
        classes.join(linked, "id", "left")
        .where("copies > 1 or component is not null")
        .select("n", "fp_a", "fp_b", F.coalesce("component", "id").alias("component_id"))
    )
    found = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return (
        sketches.select("id", "n", "fp_a", "fp_b")
        .join(answers, ["n", "fp_a", "fp_b"], "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"),
            F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"),
        )
    )


def op6_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), per_cent=85)


QUERIES = {"op6_hyperminhash_dedup": op6_hyperminhash_dedup}
ORACLES = {
    "op6_hyperminhash_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON s.doc_id = c.doc_id""",
}
