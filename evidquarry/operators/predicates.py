"""Gold predicates: trees of all_of, any_of, equals and contains over chunk fields.

Trees become node rows. Leaves are looked up all at once: ``equals`` by a join on the folded
value, ``contains`` by one pass over the field's texts (and a second one over the texts with
all but letters and digits left out, which forgives punctuation). Inner nodes then hold for the
chunks that enough of their children hold for, level by level from the deepest up: the rarest
children name the chunks, so a child that holds nearly everywhere is not spread over all cases.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.functions.text import casefold
from evidquarry.operators.phrases import found_in
from evidquarry.session import shared_path

NODE = "case_id bigint, node bigint, parent bigint, depth int, needed int, field string, operation string, value string"


def _nodes(case: int, tree: dict) -> Iterator[tuple]:
    """Rows of a tree in preorder; *needed* children must hold (0: a leaf)."""
    todo, count = [(tree, None, 0)], 0
    while todo:
        item, parent, depth = todo.pop()
        own, count = count, count + 1
        for kind in ("all_of", "any_of"):
            if kind in item:
                children = item[kind] or []
                if not children:  # all of nothing holds everywhere, any of nothing nowhere
                    yield case, own, parent, depth, 0, None, "always" if kind == "all_of" else "never", None
                else:
                    yield case, own, parent, depth, len(children) if kind == "all_of" else 1, None, kind, None
                    todo += [(child, own, depth + 1) for child in reversed(children)]
                break
        else:
            operation = "equals" if "equals" in item else "contains"
            yield case, own, parent, depth, 0, str(item.get("field") or ""), operation, str(item.get(operation) or "")


def predicate_nodes(cases: DataFrame, case_id: str, tree: str) -> DataFrame:
    """Node rows of the JSON trees in column *tree*; a null or unreadable tree has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for case, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = json.loads(text) if text else None
                except ValueError:
                    found = None
                if isinstance(found, dict):
                    rows += _nodes(case, found)
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NODE.split(", ")])

    return cases.select(F.col(case_id).cast("bigint"), tree).mapInArrow(run, NODE)


def letters_and_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^a-z0-9]+", "")


def matching(chunks: DataFrame, nodes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows (case_id, *key*) of the chunks for which a case's whole tree holds.

    Leaves over other fields than *fields* hold nowhere. A missing field counts as empty.
    Equal leaves of all cases are one condition, looked up and stored once.
    """
    spark = chunks.sparkSession
    nodes = _stored(nodes, "predicates").withColumn("leaf", F.concat_ws(":", "case_id", "node"))
    leaves = nodes.where("needed = 0").withColumn("needle", casefold(F.coalesce("value", F.lit(""))))
    kinds = ["field", "operation", "needle"]
    conditions = _stored(leaves.groupBy(*kinds).agg(F.min("leaf").alias("what"), F.collect_set("leaf").alias("leaves")), "conditions")
    facts = _stored(_held(chunks, conditions, key, fields), "held")
    places = nodes.select("leaf", "case_id", F.col("node").alias("slot"), F.col("parent").alias("up"), "depth").distinct()
    places = places.join(conditions.select("what", F.explode("leaves").alias("leaf")), "leaf").drop("leaf").distinct()
    inner = nodes.where("needed > 0").select("case_id", F.col("node").alias("up"), F.col("parent").alias("above"), "needed").distinct()
    risen = spark.createDataFrame([], f"case_id bigint, up bigint, slot bigint, what string, {key} {chunks.schema[key].dataType.simpleString()}")
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, 0, -1):
        slots = places.where(F.col("depth") == depth).select("case_id", "up", "slot", "what").unionByName(risen.drop(key).distinct())
        known = facts.unionByName(risen.select("what", key).distinct())
        risen = _stored(_risen(slots, known, inner, key), "risen")
    roots = places.where("depth = 0 and up is null").join(facts, "what").select("case_id", key)
    return roots.unionByName(risen.where("up is null").select("case_id", key)).distinct()


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held(chunks: DataFrame, conditions: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows (what, *key*) of the chunks that each condition holds for."""
    spark = chunks.sparkSession
    asked = {(r.field, r.operation) for r in conditions.select("field", "operation").distinct().collect() if r.field in (*fields, None)}
    held = spark.createDataFrame([], f"what string, {key} {chunks.schema[key].dataType.simpleString()}")
    for field, operation in sorted(asked, key=str):
        wanted = conditions.where(F.col("field").eqNullSafe(F.lit(field)) & (F.col("operation") == operation)).select(F.col("what").alias("needle_id"), "needle")
        actual = casefold(F.coalesce(F.col(field).cast("string"), F.lit(""))) if field else F.lit("")
        if operation == "equals":
            found = chunks.select(key, actual.alias("needle")).join(wanted, "needle").select("needle_id", key)
        elif operation == "contains":
            wanted = wanted.where("needle <> ''")
            loose = wanted.withColumn("needle", letters_and_digits(F.col("needle"))).where("needle <> ''")
            found = found_in(chunks, key, actual, wanted).unionByName(found_in(chunks, key, letters_and_digits(actual), loose)).select("needle_id", key)
        elif operation == "always":
            found = found_in(chunks, key, actual, wanted).select("needle_id", key)
        else:
            continue
        held = held.unionByName(found.withColumnRenamed("needle_id", "what"))
    return held.distinct()


def _risen(slots: DataFrame, facts: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """The inner nodes that hold, as slots of their own parents: case_id, up, slot, what, *key*.

    *slots* (case_id, up, slot, what) are the children of one level, *facts* (what, *key*) where they hold.
    Where *needed* of m children must hold, one of any m - needed + 1 does: chunks come from as many
    of the rarest children, and only for these chunks the others are asked.
    """
    counts = facts.groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    sizes = slots.join(counts, "what").groupBy("case_id", "up", "slot").agg(F.sum("n").alias("n"))
    family = Window.partitionBy("case_id", "up")
    ranked = sizes.select("case_id", "up", "slot", F.row_number().over(family.orderBy("n", "slot")).alias("place"), F.count(F.lit(1)).over(family).alias("m"))
    children = slots.join(ranked, ["case_id", "up", "slot"]).join(inner, ["case_id", "up"]).withColumn("leads", F.col("place") <= F.col("m") - F.col("needed") + 1)
    children = _stored(children.drop("place", "m"), "children")
    parent = ["case_id", "up", "above", "needed"]
    first = _stored(children.where("leads").join(facts, "what").select(*parent, "slot", key).distinct(), "first")
    others = children.where("not leads").select("case_id", "up", F.col("above").alias("_above"), F.col("needed").alias("_needed"), "slot", F.col("what").alias("_what"))
    asked = first.select(*parent, F.col(key).alias("_key")).distinct().join(others, ["case_id", "up"]).where(
        F.col("above").eqNullSafe(F.col("_above")) & (F.col("needed") == F.col("_needed")))
    more = asked.join(facts, (F.col("_what") == F.col("what")) & F.col("_key").eqNullSafe(F.col(key))).select(*parent, "slot", key)
    counted = first.unionByName(more.distinct()).groupBy(*parent, key).agg(F.count(F.lit(1)).alias("n")).where("n >= needed")
    return counted.select(
        "case_id", F.col("above").alias("up"), F.col("up").alias("slot"), F.concat_ws(":", F.lit("inner"), "case_id", "up", "above").alias("what"), key).distinct()
