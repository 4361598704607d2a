"""Many phrases looked for anywhere in many texts, in the scan of the texts.

The phrases go to the tasks in blocks of about ``BLOCK_CHARS`` characters; a task walks each
text once through an automaton of the block (phrases under three characters are asked for
directly) and hands on who holds what. Texts and their words are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evidquarry.session import shared_path

BLOCK_CHARS = 1_000_000  # of phrases sent to the tasks at once; about 100 MB as an automaton
SHORTEST = 3
ROWS = 512


class Finder:
    """The phrases of one block with their ids."""

    def __init__(self, pairs: list[tuple]):
        self.ids = defaultdict(list)
        for needle_id, needle in pairs:
            self.ids[needle].append(needle_id)
        self.short = [n for n in self.ids if len(n) < SHORTEST]
        self.automaton = ahocorasick.Automaton()
        for needle in self.ids:
            if len(needle) >= SHORTEST:
                self.automaton.add_word(needle, needle)
        if len(self.automaton):
            self.automaton.make_automaton()

    def held(self, text: str) -> set[str]:
        found = {needle for _, needle in self.automaton.iter(text)} if len(self.automaton) else set()
        return found | {n for n in self.short if n in text}


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None
        for whole in batches:
            finder = finder or Finder(sent.value)
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows, found, times = [], [], []
                for row, value in enumerate(batch.column(1)):
                    text = value.as_py()
                    if text is None:
                        continue
                    for needle in finder.held(text):
                        own = finder.ids[needle]
                        rows += [row] * len(own)
                        found += own
                        times += [text.count(needle)] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, sent_type(sent)), pa.array(times, pa.int64())],
                    names=["key", "needle_id", "times"])

    return run


def sent_type(sent) -> pa.DataType:
    return pa.string() if sent.value and isinstance(sent.value[0][0], str) else pa.int64()


def found_in(haystack: DataFrame, key: str, text: Column, needles: DataFrame) -> DataFrame:
    """Rows (*key*, needle_id, times): each needle a text holds and its occurrences side by side.

    *needles* has needle_id (a long or a string) and needle; both sides are compared as they
    are, so fold them first. An empty needle is in every text, a null one in none, and nothing
    is in a null text.
    """
    spark = haystack.sparkSession
    asked = needles.select("needle_id", "needle").where("needle_id is not null and needle is not null").distinct()
    kinds = {"key": haystack.schema[key].dataType.simpleString(), "needle_id": needles.schema["needle_id"].dataType.simpleString()}
    if kinds["needle_id"] != "string":
        asked, kinds["needle_id"] = asked.withColumn("needle_id", F.col("needle_id").cast("long")), "bigint"
    schema = f"key {kinds['key']}, needle_id {kinds['needle_id']}, times bigint"
    texts = haystack.select(F.col(key).alias("key"), text.alias("text"))
    size = asked.agg(F.sum(F.length("needle") + 1)).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)

    def scanned(block: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])
        return texts.mapInArrow(_scan(sent), schema)

    if not blocks:
        found = spark.createDataFrame([], schema)
    elif blocks == 1:
        found = scanned(asked)
    else:
        path = shared_path(spark, "phrases")
        for block in range(blocks):
            scanned(asked.where(F.pmod(F.xxhash64("needle_id"), F.lit(blocks)) == block)).write.mode("append").parquet(path)
        found = spark.read.schema(schema).parquet(path)
    return found.withColumnRenamed("key", key)
