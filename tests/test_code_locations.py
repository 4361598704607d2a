"""Code-location and feature-list answers with their verifier on small cases."""

from pyspark.sql import functions as F

from evidquarry.operators import code_locations as CL


def test_files_are_located_listed_and_verified(spark):
    schema = "query_id long, source int, title string, entity string, path string, page_content string"
    evidence = spark.createDataFrame([
        (1, 1, "t", "", "src/pos/PriceCheckScreen.kt", "see OtherThing.kt and docs/readme.md"), (1, 2, "t", "", None, "uses lib/pricecheckscreen.kt. and CheckPrices.kt,"),
        (1, 3, "t", "", "notes.md", None), (2, 1, "t", "", "a/Alpha.kt", ""), (2, 2, "t", "", "b/Beta.kt", "Alpha.kt"), (3, 1, "t", "", "a/Alpha.kt", "")], schema)
    asked = spark.createDataFrame([(1, "Which file has the price checks?"), (2, "where is alphabet or beta"), (3, "tell me about alpha"), (4, "where is alpha")], "query_id long, question string")
    found = CL.located(asked, evidence, (".kt",))
    got = {(r.query_id, r.place): (r.label, r.source, r.score) for r in found.collect()}
    assert got == {(1, 1): ("src/pos/PriceCheckScreen.kt", 1, 2), (1, 2): ("CheckPrices.kt", 2, 2),
                   (2, 1): ("a/Alpha.kt", 1, 1), (2, 2): ("b/Beta.kt", 2, 1), (2, 3): ("Alpha.kt", 2, 1)}
    answers = CL.location_answers(found)
    shown = {r.query_id: r.answer for r in answers.collect()}
    assert shown[1] == "### Matching files\n- `src/pos/PriceCheckScreen.kt` [SOURCE 1].\n- `CheckPrices.kt` [SOURCE 2]."
    one = CL.location_answers(found.where("query_id = 2 and place = 1")).first().answer
    assert one == "The matching file is `a/Alpha.kt` [SOURCE 1]."
    changed = answers.withColumn("answer", F.when(F.col("query_id") == 2, F.concat("answer", F.lit("\n- `C.kt` [SOURCE 3]."))).otherwise(F.concat(F.lit(" "), "answer", F.lit("\n"))))
    assert {r.query_id: r.verified for r in CL.verified(changed, answers).collect()} == {1: True, 2: False}


def test_feature_lists_name_every_document(spark):
    rows = spark.createDataFrame([(1, 1, "app1 - SpeedGauge Documentation", "app1"), (1, 2, "app1_", "app1"), (1, 3, "Plain", "app1"), (2, 1, "", "x")], "query_id long, source int, title string, entity string")
    assert {r.query_id: r.answer for r in CL.feature_inventory(rows).collect()} == {1: "- Speed Gauge [SOURCE 1].\n- Plain [SOURCE 3]."}
