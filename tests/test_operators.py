"""Operator semantics on small fixtures, and brute-force checks of sequential ones."""

import math
from bisect import bisect_left

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidquarry.functions import anchors, citations, language, markdown as MD, text as X
from evidquarry.operators import audits, best, dense, fusion, lexical, metrics, ranking, routing, scans, structured
from evidquarry.operators.neighbors import expand_neighbors
from evidquarry.operators.ranks import cumulative_counts, nearest_rank
from evidquarry.sources import files
from evidquarry.sources.cache import CorpusCache
from evidquarry.streaming import rate_limit


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("shift_summary", ["shift_summary", "shift", "summary"]),
        ("shiftSummary", ["shiftsummary", "shift", "summary"]),
        ("HTTPServer", ["httpserver", "http", "server"]),
        ("src/main/App.kt", ["src/main/app.kt", "src", "main", "app", "kt"]),
        ("v0.4", ["v0.4"]),
        ("plain words.", ["plain", "words."]),
    ],
)
def test_tokens(spark, value, expected):
    assert one(spark, X.tokens(F.lit(value))) == expected
    assert sorted(one(spark, F.transform(X.token_bag(F.lit(value)), F.lower))) == sorted(expected)
    assert one(spark, X.token_count(F.lit(value))) == len(expected)


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id bigint, page_content string")


def test_exact_identifier_ranks_first_and_zero_scores_pad(spark):
    frame = chunks(spark, [(0, "close the shift"), (1, "APP_CLOSE_SHIFT declares the shift"), (2, "weather report")])
    asked = spark.createDataFrame([(1, "APP_CLOSE_SHIFT_EVENT")], "query_id bigint, question string")
    rows = lexical.bm25_top_k(frame, asked, 3).orderBy("lexical_rank").collect()
    assert [r["chunk_id"] for r in rows] == [1, 0, 2]
    assert rows[2]["lexical_score"] == 0.0


def test_fusion_prefers_shared_rows(spark):
    lex = spark.createDataFrame([(1, 10, 2.0, 1), (1, 11, 1.0, 2)], "query_id bigint, chunk_id bigint, lexical_score double, lexical_rank int")
    den = spark.createDataFrame([(1, 10, 0.9, 1), (1, 12, 0.8, 2)], "query_id bigint, chunk_id bigint, score double, dense_rank int")
    got = fusion.fuse(lex, den, 10, k=10).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in got] == [10, 11, 12]
    with pytest.raises(ValueError):
        fusion.fuse(lex, den, 10, lexical_weight=0)


def test_batch_top_k_equals_single_scan(spark):
    rows = [(i, [float((i * 7 + d * 3) % 11 - 5) for d in range(8)]) for i in range(1, 60)]
    corpus = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").repartition(5)
    asked = corpus.where("chunk_id in (3, 20)").withColumnRenamed("chunk_id", "query_id")
    batch = dense.batch_top_k(corpus, asked, 6).where("query_id = 20").orderBy("dense_rank").select("chunk_id", "score").collect()
    single = dense.top_k(corpus, corpus.where("chunk_id = 20").select("embedding"), 6).collect()
    assert [tuple(r) for r in batch] == [tuple(r) for r in single]


def test_authorization_fails_closed():
    assert scans.reduced_policies("A", ["project:A", "project:B", "user:1", "role:A:x", "role:B:x"]) == ["project:A", "user:1", "role:A:x"]
    with pytest.raises(PermissionError):
        scans.reduced_policies("A", ["project:B"])
    with pytest.raises(PermissionError):
        scans.policy_filter([])


def issue(key, cloud, order, status="Open", labels="POS", kind="CURRENT", parent=""):
    return (f"issue:{key}", cloud, key, "t", status, "new", "High", labels, "Bug", "", parent, "u", "2024-01-01", kind, order)


ISSUE = (
    "source_id string, cloud_id string, issue_key string, title string, status string, status_category_key string, priority string, "
    "labels string, issue_type string, resolution string, parent_issue_key string, assignee string, issue_updated string, chunk_kind string, ord bigint"
)


def test_count_uses_the_last_observation_of_current_issues(spark):
    rows = [issue("T-1", "c", 1), issue("T-1", "c", 2, status="Done"), issue("T-2", "c", 3, labels="BOT"), issue("T-3", "c", 4, kind="CHANGELOG")]
    frame = spark.createDataFrame(rows, ISSUE)
    assert structured.count_issues(frame, {"labels": ("pos",)}).first()["total"] == 1
    assert {r["value"]: r["n"] for r in structured.distribution(frame, "status").collect()} == {"Done": 1, "Open": 1}
    assert structured.count_issues(frame, {"status": ("nothing",)}).first()["total"] == 0


def test_natural_key_order(spark):
    frame = spark.createDataFrame([("A-10",), ("A-9",), ("a-2",), ("zeta",)], "k string")
    assert [r["k"] for r in frame.orderBy(*structured.natural_order(F.col("k"))).collect()] == ["a-2", "A-9", "A-10", "zeta"]


def test_version_dedup_keeps_all_ties_and_spreads_hot_entities(spark):
    rows = [(i, "hot", 1, "V1.2", "") for i in range(50)] + [(100, "hot", 1, "V1.10", ""), (101, "hot", 1, "v1.10", ""), (102, "cold", 0, "", "")]
    frame = spark.createDataFrame(rows, "chunk_id bigint, e string, authority int, source_version string, observed_at string")
    kept = {r["chunk_id"] for r in ranking.keep_latest_authoritative(frame, F.col("e")).collect()}
    assert kept == {100, 101, 102}


def test_prefilter_ceiling(spark):
    rows = [(1, i, i, "narrative", 0.01 * i) for i in range(1, 11)]
    pool = spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, ord bigint, doc_category string, score double")
    got = ranking.prefilter(pool, F.col("score") < 0.3, F.lit(None).cast("string"))
    assert {r["chunk_id"] for r in got.where("verdict <> 'KEEP'").collect()} == {1, 2, 3}
    small = pool.where("chunk_id <= 7")
    assert ranking.prefilter(small, F.col("score") < 0.3, F.lit(None).cast("string")).where("verdict <> 'KEEP'").count() == 0


def test_case_metrics_short_list(spark):
    hits = spark.createDataFrame([(1, 1, True, 0, "ALPHA")], "query_id bigint, rank int, rel boolean, section int, project_id string")
    cases = spark.createDataFrame(
        [(1, "en", "d", True, "answer_evidence", 1, 1)],
        "query_id bigint, query_language string, department string, answerable boolean, role string, gold_size bigint, n_sections int",
    )
    row = metrics.case_metrics(hits, cases).first()
    assert row["precision"] == 1 / 8 and row["ndcg"] == 1.0 and row["leak"] == 0


def test_calibration(spark):
    rows = [(True, 0.9)] + [(False, i / 100) for i in range(100)]
    frame = spark.createDataFrame(rows, "answerable boolean, max_rerank_score double")
    assert metrics.calibrated_threshold(frame).first()["threshold"] == 0.95


def test_nearest_rank_matches_sorting(spark):
    values = [(i % 3, float((i * 37) % 101)) for i in range(500)]
    frame = spark.createDataFrame(values, "g int, v double")
    got = {r["g"]: r["p"] for r in cumulative_counts(frame, "v", ["g"], ranges=7).groupBy("g").agg(nearest_rank("v", 0.95).alias("p")).collect()}
    for group in range(3):
        ordered = sorted(v for g, v in values if g == group)
        assert got[group] == ordered[round((len(ordered) - 1) * 0.95)]


def test_line_kinds_and_pruning(spark):
    text = "# T\n| a | b |\n|---|---|\n| x | y |\n\n```\n| not | table |\n```\n- item one [SOURCE 1]\nA long enough sentence here. Another one without any proof."
    lines = spark.range(1).select(MD.classified_lines(F.lit(text)).alias("l")).select(
        F.transform("l", lambda x: x["kind"]).alias("k"), MD.pruned(F.col("l"), F.array(F.lit("| x | y |"))).alias("p")
    ).first()
    assert lines["k"] == [
        "HEADING", "TABLE_HEADER", "TABLE_SEPARATOR", "TABLE_ROW", "PROSE", "CODE", "CODE", "CODE", "LIST_ITEM", "PROSE",
    ]
    assert "| a | b |" not in lines["p"] and "| not | table |" in lines["p"]


def test_table_dialect_is_idempotent(spark):
    once = one(spark, MD.normalize_table_dialect(F.lit("x\na | b | c\nd | e | f\ny")))
    assert once.splitlines()[1:4] == ["| a | b | c |", "| --- | --- | --- |", "| d | e | f |"]
    assert one(spark, MD.normalize_table_dialect(F.lit(once))) == once


def test_anchors(spark):
    got = one(spark, anchors.numeric_anchors(F.lit("el 5 de mayo de 2026 costó 12.356 y 3,14")))
    assert set(got) == {"date:2026-05-05", "2026", "12356", "3.14"}
    assert not one(spark, anchors.anchors_supported(F.lit("costs 7"), F.lit("costs 8")))
    assert not one(spark, anchors.negation_supported(F.lit("never closed"), F.lit("it closed")))


def test_citations(spark):
    assert one(spark, citations.normalized(F.lit("Fact. [SOURCE 1, 2] Next."))) == "Fact [SOURCE 1] [SOURCE 2].Next."
    assert one(spark, citations.without_markers(F.lit("Fact [SOURCE 1]. Ok [SOURCE 2]."))) == "Fact. Ok."


def test_autocorrect(spark):
    assert one(spark, language.autocorrect(F.lit("wat is ACME como functiona?"))) == "what is ACME como funciona?"
    assert one(spark, language.detect(F.lit("cómo funciona el pago"))) == "es"


def brute_limit(rows, limit, window):
    logs, out = {}, {}
    for user, event, micros in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        log = [m for m in logs.get(user, []) if m > micros - window]
        out[event] = len(log) < limit
        logs[user] = log + [micros] if out[event] else log
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rows = [(i % 3, i, (i * i * 131) % 4_000) for i in range(300)]
    frame = spark.createDataFrame(rows, "user_id bigint, event_id bigint, m bigint").select("user_id", "event_id", F.timestamp_micros("m").alias("ts"))
    want = brute_limit(rows, 4, 100)
    got = {r["event_id"]: r["admitted"] for r in rate_limit.limited_batch(frame, 4, 100).collect()}
    assert got == want
    source = str(tmp_path / "in")
    frame.coalesce(1).write.parquet(source)
    stream = rate_limit.limited_stream(spark.readStream.schema(frame.schema).parquet(source), 4, 100)
    job = (
        stream.writeStream.format("memory").queryName("limited").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert job.awaitTermination(120)
    assert {r["event_id"]: r["admitted"] for r in spark.table("limited").collect()} == want


def test_neighbor_caps(spark):
    frame = pd.DataFrame(
        [(1, 10, 1, "s", "p", "1", 5), (1, 11, 2, "s", "p", "1", 9), (1, 12, 3, "s", "p", "1", 6), (1, 13, 4, "s", "p", "1", 4)],
        columns=["query_id", "chunk_id", "ord", "source_id", "parent_id", "source_version", "chunk_ordinal"],
    )
    pool = spark.createDataFrame(frame)
    picked = lambda *caps: [(r.chunk_id, r.neighbor_of) for r in expand_neighbors(pool, *caps).orderBy("rn").collect()]
    assert picked(4, 2, 3) == [(10, None), (12, 10), (13, 10)]
    assert picked(2, 2, 9) == [(10, None), (12, 10)]
    assert picked(4, 1, 9) == [(10, None), (12, 10), (11, None), (13, None)]


def test_phrases_of_any_length_are_found(spark):
    needles = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma"), (3, "one two three"), (4, "absent"), (5, None)], "needle_id long, needle string")
    texts = spark.createDataFrame([(1, "an ALPHA here"), (2, "x beta gamma"), (3, "so one two threes"), (4, None), (5, "")], "doc_id long, text string")
    found = audits.contained_in(needles, texts, "doc_id", "text").collect()
    assert sorted((r.needle_id, r.doc_id) for r in found) == [(1, 1), (2, 2), (3, 3)]


def test_catalog_files(spark, tmp_path):
    row = {c: "x" for c in files.CATALOG_COLUMNS} | {"lifecycle_state": "ACTIVE", "availability_scope": "NATIONAL", "effective_date": "2024-01-31"}
    rows = spark.createDataFrame([row | {"sku": "1"}, row | {"sku": "2"}]).select(*files.CATALOG_COLUMNS)
    assert files.catalog_report(rows).count() == 0
    root = str(tmp_path / "cat")
    files.publish(rows, root, "r1")
    assert spark.read.json(f"{root}/active").first()["release"] == "r1"
    files.rollback(spark, root, "r1", files.set_fingerprint(rows, "sku"))
    with pytest.raises(files.ContractError):
        files.rollback(spark, root, "r1", 0)
    with pytest.raises(files.ContractError):
        files.publish(rows, root, "../r2")
    assert files.read_catalog(spark, f"{root}/releases/r1/products").count() == 2


def test_corpus_cache_expires(spark):
    now = [0.0]
    cache = CorpusCache(10, 1, clock=lambda: now[0])
    first = cache.get("a", lambda: spark.range(1))
    assert cache.get("a", lambda: spark.range(2)) is first
    now[0] = 11.0
    assert cache.get("a", lambda: spark.range(2)).count() == 2
    cache.get("b", lambda: spark.range(3))
    assert len(cache) == 1

def test_rules_of_failures_languages_and_deltas(spark):
    for message in ("embedding token limit", "spent for the current month", "Quota", "resource_exhausted"):
        assert one(spark, routing.failure_class(F.lit(429), F.lit(message))) == "EMBEDDING_QUOTA_EXHAUSTED"
    assert one(spark, routing.failure_class(F.lit(429), F.lit("slow down"))) == "RATE_LIMITED"
    assert one(spark, language.detect(F.lit("overveiw describbe"))) == "en"
    assert one(spark, language.detect(F.lit("como functiona"))) == "es"
    assert one(spark, language.detect(F.lit("zzz"))) == "mixed"
    assert one(spark, language.settled(F.lit("mixed"), F.lit("en"))) == "en"
    assert one(spark, language.settled(F.lit("mixed"), F.lit(None).cast("string"))) == "es"


def test_order_statistics_hold_with_outliers_and_ties(spark):
    values = [1e15, -1e15, *[float(v % 3000) for v in range(9000)], *[7.0] * 500, None]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("c", None)], "g string, v double")
    found = {(r.g, r.v): (r.below, r.n, r.total) for r in cumulative_counts(frame, "v", ["g"]).collect()}
    plain = sorted(v for v in values if v is not None)
    expected = {("a", v): (bisect_left(plain, v), plain.count(v), len(plain)) for v in set(plain)}
    assert found == expected | {("b", 1.0): (0, 1, 1)}
    alone = cumulative_counts(frame.where("g = 'a'").select("v"), "v", []).collect()
    assert {(r.v, r.below, r.n) for r in alone} == {(v, below, n) for (_g, v), (below, n, _t) in expected.items()}


@pytest.mark.parametrize("pairs, cells, postings", [(500_000, 4_000_000, 20_000), (3, 4, 2)])
def test_in_scan_bm25_equals_brute_force(spark, monkeypatch, pairs, cells, postings):
    monkeypatch.setattr(lexical, "PAIRS_PER_PASS", pairs)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(best, "CELLS", cells)
    texts = ["the cat", "the the dog", "", None, "dog cat the", "the cat", "bird"] + ["the"] * 5
    asked = {1: "the dog", 2: "Cat cat", 3: "", 4: "unseen", 5: "bird the cat dog"}
    frame = chunks(spark, list(enumerate(texts)))
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, question string")
    bags = [(t or "").split() for t in texts]
    average = max(1.0, sum(map(len, bags)) / len(bags))
    want = set()
    for name, question in asked.items():
        terms = set(question.lower().split())
        scored = []
        for i, bag in enumerate(bags):
            if terms & set(bag):
                score = 0.0
                for term in terms & set(bag):
                    df, tf = sum(term in other for other in bags), bag.count(term)
                    score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / average))
                scored.append((-round(score, 6), i))
        want |= {(name, i, -s) for s, i in sorted(scored)[:3]}
    got = {tuple(r) for r in lexical.matching_top_k(frame, queries, 3).collect()}
    assert got == want
    assert lexical.matching_top_k(frame.limit(0), queries, 3).count() == 0
    assert lexical.matching_top_k(frame, queries.limit(0), 3).count() == 0


def test_siblings_keep_order_and_limit(spark):
    rows = [(i, f"s{i % 4 if i % 3 else 0}", f"p{i % 5}", i % 7) for i in range(60)]
    frame = spark.createDataFrame(rows, "chunk_id bigint, source_id string, parent_id string, chunk_ordinal int")
    hits = [(1, "s0", "p1"), (1, "s2", "p1"), (2, "s9", "p3"), (3, None, "p9")]
    got = scans.siblings(frame, spark.createDataFrame(hits, "query_id bigint, source_id string, parent_id string"), 3).collect()
    want = set()
    for name in (1, 2, 3):
        mine = {(s, o, i) for i, s, p, o in rows if any(q == name and (s == hs or p == hp) for q, hs, hp in hits)}
        want |= {(name, *row, n) for n, row in enumerate(sorted(mine)[:9], 1)}
    assert {(r["query_id"], r["source_id"], r["chunk_ordinal"], r["chunk_id"], r["rn"]) for r in got} == want


def test_a_truncated_snapshot_is_refused(spark):
    frame = spark.createDataFrame([("a",)] * 3 + [("b",)] * 4, "kind string")
    got = {tuple(r) for r in scans.complete_snapshots(frame, "kind", 3).collect()}
    assert got == {("a", 3, True, ""), ("b", None, False, "SNAPSHOT_TRUNCATED")}


@pytest.mark.parametrize(
    "question, section, event",
    [
        ("Show comment 3 of ABC-9", "COMMENT", "3"),
        ("registro de trabajo 12 de abc-9", "WORKLOG", "12"),
        ("evento histórico 4 del historial de ABC-9", "CHANGELOG", "4"),
        ("attachment 2 of ABC-9", "ATTACHMENT", None),
        ("criterios de aceptación de ABC-9", "ACCEPTANCE", None),
        ("which is the parent of ABC-9?", "RELATIONSHIP", None),
        ("custom field of ABC-9", "CUSTOM_FIELD", None),
        ("enlace remoto de ABC-9", "REMOTE_LINK", None),
        ("definition in ABC-9", "GLOSSARY", None),
        ("requirements of ABC-9", "DESCRIPTION", None),
        ("status of ABC-9", "CURRENT", None),
        ("why was the status of ABC-9 changed", "CHANGELOG", None),
        ("comment 1 of ABC-9 and ABC-10", None, None),
        ("comment 1", None, None),
    ],
)
def test_section_routes(spark, question, section, event):
    row = spark.range(1).select(routing.section_route(F.lit(question)).alias("s"), routing.section_event(F.lit(question)).alias("e")).first()
    assert (row["s"], row["e"]) == (section, event)


@pytest.mark.parametrize(
    "question, expected",
    [
        ("dame las opciones disponibles", True),
        ("List the supported drivers", True),
        ("every one of the screens", True),
        ("What are the payment methods?", True),
        ("Which flags remain?", True),
        ("which closing reports can fail", True),
        ("screens are supported", True),
        ("the registry", True),
        ("Explain the closing shift", False),
        ("list all callers of SHIFT_CLOSE_EVENT", False),
    ],
)
def test_inventory_questions(spark, question, expected):
    assert one(spark, routing.is_inventory(F.lit(question))) is expected
