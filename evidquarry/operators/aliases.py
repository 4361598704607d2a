"""Alias classes: entity names, wire names and code symbols that mean one thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidquarry.functions.text import fold_accents
from evidquarry.session import shared_path


def alias_key(name: Column) -> Column:
    """The form under which spellings of one name meet: ``PosStart``, ``POS_START`` and ``pos-start``."""
    parted = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.regexp_replace(F.regexp_replace(fold_accents(parted), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def alias_classes(links: DataFrame) -> DataFrame:
    """Rows (alias, representative): each alias key with the smallest key it hangs together with.

    *links* has left and right, two names of one thing. Keys take the smallest representative of
    their neighbours, then that one's own, until nothing changes; every round is written to
    the shared folder. Names without letters or digits link nothing.
    """
    spark = links.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = shared_path(spark, "aliases")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pairs = links.select(alias_key(F.col("left")).alias("a"), alias_key(F.col("right")).alias("b")).where("a <> '' and b <> ''")
    pairs = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    current = stored(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("rep")))
    while True:
        near = pairs.join(current.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("rep").alias("near"))
        jumped = current.select(F.col("a").alias("rep"), F.col("rep").alias("far"))
        step = current.join(near, "a").join(jumped, "rep", "left").select("a", F.least("rep", "near", "far").alias("rep"), F.col("rep").alias("old"))
        step = stored(step)
        current = step.select("a", "rep")
        if step.where("rep <> old").isEmpty():
            return current.select(F.col("a").alias("alias"), F.col("rep").alias("representative"))


def same_things(asked: DataFrame, known: DataFrame, classes: DataFrame, asked_name: str, known_name: str) -> DataFrame:
    """Rows of *asked* and *known* whose names are aliases of each other, or spellings of one name."""

    def resolved(df: DataFrame, name: str) -> DataFrame:
        keyed = df.withColumn("alias", alias_key(F.col(name))).where("alias <> ''")
        return keyed.join(classes, "alias", "left").withColumn("thing", F.coalesce("representative", "alias")).drop("alias", "representative")

    return resolved(asked, asked_name).join(resolved(known, known_name), "thing")
