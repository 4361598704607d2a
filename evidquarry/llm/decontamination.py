"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so the similarity of the two whole sets
says nothing; what counts is containment, the share of the item's shingles that the
document has. The item's sketch is therefore probed against the whole document:

* Items fall into partitions by shingle count ([1, 2), [2, 4), [4, 8) ...). A partition
  with at most u shingles an item keeps the s = min(n, 2 * floor((1 - t) * u) + 2) smallest
  shingle hashes of each item (bottom-s MinHash).
* At containment t at most floor((1 - t) * n) shingles of the item are missing, so at least
  s - floor((1 - t) * n) of its sketch must occur: documents with fewer are ruled out without
  loss, and a document with that many is a candidate.
* Candidates are verified exactly: all shingles of the item against all of the document.

The sketches and item sets travel to the document scan in blocks of at most
``BLOCK_SHINGLES`` shingles (32 MB); a larger benchmark takes more passes. Documents are
never shuffled, and no document or item can become a hot key.

Defined results: null and empty texts contain nothing and are contained in nothing; an item
of fewer than five words is one shingle (its whole word sequence) and is found only in a
text of just those words; repeated items and documents each give their own rows; rows with
null ids take part and show a null id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidquarry.llm.base import fresh_path, stored, table
from evidquarry.llm.shingles import shingle_set

BLOCK_SHINGLES = 4_000_000
FILTER_BITS = 22


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
        ], names=["item", "n", "hashes"])


class Probe:
    """One block of items, ready to be looked up: sketch postings and full sets."""

    def __init__(self, items: list, sets: list[np.ndarray], missing_per_cent: int):
        self.items, self.sets = items, sets
        sizes = np.array([len(s) for s in sets], np.int64)
        upper = 2 ** np.ceil(np.log2(sizes + 1)).astype(np.int64) - 1  # most shingles in the item's partition
        keep = np.minimum(sizes, 2 * (missing_per_cent * upper // 100) + 2)
        self.need = keep - missing_per_cent * sizes // 100
        owner = np.repeat(np.arange(len(sets)), keep)
        hashes = np.concatenate([s[:k] for s, k in zip(sets, keep, strict=True)])
        order = np.argsort(hashes, kind="stable")
        self.owner = owner[order]
        self.keys, self.start = np.unique(hashes[order], return_index=True)
        self.stop = np.append(self.start[1:], len(order))
        self.may = np.zeros(1 << FILTER_BITS, bool)
        self.may[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def found(self, own: np.ndarray, least_per_cent: int) -> list[tuple[int, int]]:
        """(position of item, shared shingles) for every item contained in the set *own*."""
        some = own[self.may[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
        if not len(some):
            return []
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        at = at[self.keys[at] == some]
        if not len(at):
            return []
        owners = np.concatenate([self.owner[self.start[i] : self.stop[i]] for i in at])
        candidates, hits = np.unique(owners, return_counts=True)
        out = []
        for item in candidates[hits >= self.need[candidates]]:
            whole = self.sets[item]
            place = np.minimum(np.searchsorted(own, whole), len(own) - 1)
            shared = int((own[place] == whole).sum())
            if 100 * shared >= least_per_cent * len(whole):
                out.append((int(item), shared))
        return out


def _blocks(items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    """The shingle sets of the items, and into how many blocks they have to be dealt."""
    sets = stored(
        items.select(F.col(item_id).cast("long"), F.col(item_text))
        .mapInArrow(_item_sets, "item long, n long, hashes array<long>").where("n > 0"),
        "items",
    )
    total = sets.agg(F.sum("n")).first()[0] or 0
    return sets, -(-total // BLOCK_SHINGLES)


def _probe(sets: DataFrame, blocks: int, block: int, least_per_cent: int) -> Broadcast | None:
    """One block of items, sent to the tasks."""
    rows = sets.where(F.pmod(F.xxhash64("item", "hashes"), F.lit(blocks)) == block).collect()
    if not rows:
        return None
    return sets.sparkSession.sparkContext.broadcast(Probe(
        [r.item for r in rows], [np.array(r.hashes, np.int64).view(np.uint64) for r in rows], 100 - least_per_cent))


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
    item_id: str = "item_id", item_text: str = "text", least_per_cent: int = 80,
) -> DataFrame:
    """One row (doc, item, n_item, n_shared, containment) per item found in a document.

    More than one block of items: each block's rows are written and its items let go before
    the next one is fetched.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("text"))
    schema = "doc long, item long, n_item long, n_shared long"

    def found(probe: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = probe.value
            for batch in batches:
                out: list[tuple] = []
                for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                    own = shingle_set(text.as_py())
                    out += [(doc.as_py(), block.items[i], len(block.sets[i]), n) for i, n in block.found(own, least_per_cent)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["doc", "item", "n_item", "n_shared"])

        return texts.mapInArrow(scan, schema)

    sets, blocks = _blocks(items, item_id, item_text)
    probe = _probe(sets, blocks, 0, least_per_cent) if blocks == 1 else None
    if probe:
        result = found(probe)
    else:
        path = fresh_path(spark, "contained")
        spark.createDataFrame([], schema).write.parquet(path)
        for block in range(blocks):
            if probe := _probe(sets, blocks, block, least_per_cent):
                found(probe).write.mode("append").parquet(path)
                probe.destroy()
        result = spark.read.schema(schema).parquet(path)
    return result.select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_item", "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_items(
    docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least_per_cent: int = 80,
) -> DataFrame:
    """The rows of *docs* that contain no item; a filter in the scan, whatever the ids.

    More than one block of items: what a block leaves is written before the next one is fetched.
    """

    def cleaned(rows: DataFrame, probe: Broadcast) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(doc_text))
                yield batch.filter(pa.array([not probe.value.found(shingle_set(t.as_py()), least_per_cent) for t in texts], pa.bool_()))

        return rows.mapInArrow(clean, docs.schema)

    sets, blocks = _blocks(items, item_id, item_text)
    rows = docs
    for block in range(blocks):
        probe = _probe(sets, blocks, block, least_per_cent)
        if probe and blocks == 1:
            return cleaned(rows, probe)
        if probe:
            rows = stored(cleaned(rows, probe), "clean")
            probe.destroy()
    return rows


def op1_containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SETS = """SELECT {id}, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ \\x09-\\x0D]+') AS ws FROM {table})"""

QUERIES = {"op1_containment_decontamination": op1_containment_decontamination}
ORACLES = {
    "op1_containment_decontamination": f"""
WITH d AS (SELECT doc_id, unnest(sh) AS g FROM ({_SETS.format(id='doc_id', table='documents')})),
b AS (SELECT item_id, len(sh) AS n, unnest(sh) AS g FROM ({_SETS.format(id='item_id', table='benchmark')}))
SELECT doc_id, item_id, n::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / n AS containment
FROM d JOIN b ON d.g = b.g GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n""",
}
