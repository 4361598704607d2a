"""Queries keep the rows that their cross-check SQL leaves out."""

from evidquarry.plans import QUERIES, composites


def documents(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, text, "en", "src1", len(text)) for i, text in rows], schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_inventory_holds_titles_of_any_characters(spark, tmp_path):
    rows = [(8, "Événement général a"), (28, "evenement general b"), (38, "rev-2 (v1.0) c"), (58, "¿? … d"), (68, "plain title e"), (7, "no entity-contract f")]
    found = QUERIES["f17_feature_inventory"](spark, documents(spark, tmp_path, rows)).collect()
    assert {tuple(r) for r in found} == {
        ("app2", "evenement general", 8), ("app1", "evenement general", 28), ("app2", "rev 2 v1 0", 38), ("app1", "", 58), ("app2", "plain title", 68)}


def test_the_longest_title_wins_at_any_length(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "How does the Événement-général page work?"), (2, "the page of work")], "query_id int, question string")
    pool = spark.createDataFrame(
        [(1, 1, "the page"), (1, 2, "evenement general page"), (1, 3, "page general evenement"), (1, 4, "the general page"), (2, 5, "page work"), (2, 6, "work page")],
        "query_id int, chunk_id int, title string")
    monkeypatch.setattr(composites, "questions", lambda t: asked)
    monkeypatch.setattr(composites, "candidates", lambda t: pool)
    found = QUERIES["f15_title_affinity"]
    assert {tuple(r) for r in found(spark, "").collect()} == {(1, 2), (1, 4), (2, 5)}


def test_payload_and_labels_judge_every_row(spark, tmp_path):
    long = "x" * 500
    texts = [f'{{"a": "{long}"}}', f'["{long}"]', f'"{{{long}}}"', f'{long}"', f"  {long}", f"[{long}]  ", "short ", long]
    found = QUERIES["x23_looks_like_payload"](spark, documents(spark, tmp_path, list(enumerate(texts, 1)))).collect()
    # even ids over the limit are put in brackets by the query
    assert {r.doc_id: r.payload for r in found} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True}
    spark.createDataFrame([(1, 3, "Boxes"), (2, 4, "Sending"), (3, 5, "Brass")], "p_partkey int, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.p_partkey: r.labels for r in QUERIES["c15_population_labels"](spark, str(tmp_path)).collect()}
    rest = "|libraries|library"
    assert found == {
        1: "v2.3|boxes|box|libraries|library|events|event|sending|send|running|run",
        2: f"v2.4{rest}|boxes|box|events|event|sending|send|running|run",
        3: f"v2.5|brass|bras{rest}|boxes|box|events|event|sending|send|running|run"}
