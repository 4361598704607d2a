"""The members of a population, read out of the evidence that enumerates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.functions import markdown as MD
from evidquarry.functions.text import casefold


def enumerable_blocks(evidence: DataFrame) -> DataFrame:
    """Rows (query_id, ord, block, heading, body, rows): enumerated lines below one heading.

    *evidence*: query_id, ord (rank), page_content, path. A document's lines are numbered in
    one row, so blocks are cut without a window over documents.
    """
    lines = evidence.select("query_id", "ord", "path", F.posexplode(MD.classified_lines(F.col("page_content"))).alias("pos", "l"))
    head = F.col("l.kind") == "HEADING"
    before = Window.partitionBy("query_id", "ord").orderBy("pos")  # one document's lines
    marked = lines.withColumn("block", F.sum(head.cast("int")).over(before))
    held = F.col("l.kind").isin("TABLE_ROW", "LIST_ITEM")
    grouped = marked.groupBy("query_id", "ord", "block").agg(
        F.first("path").alias("path"), F.max(F.when(head, F.col("l.text"))).alias("heading"),
        F.array_sort(F.collect_list(F.when(held, F.struct("pos", F.col("l.text").alias("text"))))).alias("lines"))
    rows = F.transform("lines", lambda r: r.text)
    return grouped.where(F.size("lines") > 0).select(
        "query_id", "ord", "block", casefold(F.concat_ws(" ", "path", "heading")).alias("heading"), casefold(F.array_join(rows, " ")).alias("body"), rows.alias("rows"))


def _at(label: Column) -> Column:
    return F.when(F.col("heading").contains(label), 2).when(F.col("body").contains(label), 1).otherwise(0)


def evidence_members(evidence: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows (query_id, place, member) of each question's enumerated population.

    *subjects*: query_id, place, labels (the forms of one concept; question order). A label's
    weight is ln(blocks / blocks that carry it). The first concept that any block carries
    decides which blocks qualify; if no block carries the very first one, there is no
    population. The best scoring blocks give the members in evidence order (heading matches count
    twice). Questions without concepts take the first enumerating document only if it ranks first.
    """
    blocks = enumerable_blocks(evidence)
    total = blocks.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.min("ord").alias("first_ord"))
    ranked = evidence.groupBy("query_id").agg(F.min("ord").alias("top"))
    labels = subjects.select("query_id", "place", F.explode("labels").alias("label")).withColumn("label", casefold(F.col("label"))).where("label <> ''")
    hits = blocks.drop("rows").join(labels, "query_id").withColumn("at", _at(F.col("label"))).where("at > 0").select("query_id", "ord", "block", "place", "label", "at")
    df = hits.groupBy("query_id", "place", "label").agg(F.count(F.lit(1)).alias("df"))
    lead = df.groupBy("query_id").agg(F.min("place").alias("place"))
    named = labels.groupBy("query_id").agg(F.min("place").alias("first_place"))
    lead = lead.join(named, "query_id").where(F.col("place") == F.col("first_place")).drop("first_place")
    weight = F.log(F.col("total") / F.col("df"))
    weights = df.join(lead, ["query_id", "place"]).join(total, "query_id").select(
        "query_id", "label", F.when(weight == 0, 1.0).otherwise(weight).alias("weight"))
    scores = hits.join(weights, ["query_id", "label"]).groupBy("query_id", "ord", "block").agg(F.round(F.sum(F.col("at") * F.col("weight")), 9).alias("score"))
    best = scores.groupBy("query_id").agg(F.max("score").alias("score"))
    by_subject = scores.join(best, ["query_id", "score"]).select("query_id", "ord", "block")
    bare = total.join(named.select("query_id"), "query_id", "left_anti").join(ranked, "query_id").where(F.col("first_ord") == F.col("top"))
    unasked = blocks.join(bare.select("query_id", F.col("top").alias("ord")), ["query_id", "ord"]).select("query_id", "ord", "block")
    chosen = blocks.join(by_subject.unionByName(unasked), ["query_id", "ord", "block"]).select(
        "query_id", "ord", "block", F.posexplode("rows").alias("row", "text")).withColumn("member", MD.member_label(F.col("text")))
    place = F.struct("ord", "block", "row")
    first = chosen.where("member <> ''").groupBy("query_id", "member").agg(F.min(place).alias("place"))
    order = Window.partitionBy("query_id").orderBy("place")  # the members of one population
    return first.withColumn("place", F.row_number().over(order)).select("query_id", "place", "member")
