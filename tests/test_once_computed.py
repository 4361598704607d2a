"""Values that many parts of an expression look at are computed once for each row."""

from pyspark.sql import functions as F

from evidquarry.functions import citations as C, markdown as MD
from evidquarry.operators import routing as RT


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pruning_looks_up_its_rejected_claims_once(spark):
    text = "One plain claim of words. A cited claim of words [SOURCE 1].\n| a | b |\n|---|---|\n| x y z w | q |\nLast one is short."
    lines = spark.createDataFrame([(text,)], "md string").select(MD.classified_lines(F.col("md")).alias("lines"))
    df = lines.select(MD.pruned(F.col("lines"), C.uncited_keys(F.col("lines"))).alias("p"))
    assert plan(df).count("array_distinct") == 1
    assert df.first().p == "A cited claim of words [SOURCE 1]."


def test_a_follow_up_reads_each_question_once(spark):
    df = spark.createDataFrame([("How many open bugs are there in jira?", "and how many are blocked?")], "q string, f string")
    first = df.select("f", RT.structured_query(F.col("q")).alias("s"))
    scope = F.struct(F.col("s.operation").alias("operation"), F.col("s.filters").alias("filters"), F.lit(20).alias("next_offset"))
    found = first.select(RT.continued_query(scope, F.col("f")).alias("s")).select("s.operation", "s.offset", "s.filters")
    assert plan(found).count("overview of jira") <= 2
    assert found.first() == ("COUNT", 0, {"issue_type": ["Bug"], "status": ["Blocked"]})
