"""Structured routing of issue questions and of what follows them."""

import pytest
from pyspark.sql import functions as F

from evidquarry.operators import routing as RT

QUESTIONS = [
    ("How many open bugs are in jira?", "COUNT", None, None, {"status_category_key": ["new"], "issue_type": ["Bug"]}),
    ("cuántas incidencias cerradas hay", "COUNT", None, None, {"status_category_key": ["done"]}),
    ("List all tickets with POS", "LIST", None, None, {"labels": ["POS"]}),
    ("list tickets", None, None, None, None),
    ("Show blocked issues of high priority", "LIST", None, None, {"status": ["Blocked"], "priority": ["High"]}),
    ("breakdown of issues by priority", "DISTRIBUTION", "priority", None, {}),
    ("jira status report", "DISTRIBUTION", "status", None, {}),
    ("Summarize the whole jira please", "OVERVIEW", None, None, {}),
    ("what about abc-12?", "DETAIL", None, None, {"issue_key": ["ABC-12"]}),
    ("subtasks of ABC-12", "DETAIL", None, None, {"issue_key": ["ABC-12"]}),
    ("how many comments does ABC-12 have", "SECTION_COUNT", None, "COMMENT", {"section_kind": ["COMMENT"], "issue_key": ["ABC-12"]}),
    ("Muestra los adjuntos de ABC-12", "SECTION", None, "ATTACHMENT", {"section_kind": ["ATTACHMENT"], "issue_key": ["ABC-12"]}),
    ("is ABC-12 in the github repository", None, None, None, None),
    ("ABC-12 implementation", None, None, None, None),
    ("resolved jira issues list", "LIST", None, None, {"fixed": ["AUTO"]}),
    ("anything pending for returns in jira", "LIST", None, None, {"status_category_key": ["new", "indeterminate"], "topic": ["returns"]}),
    ("how does printing work", None, None, None, None), ("", None, None, None, None), (None, None, None, None, None),
]


def test_issue_questions_become_typed_queries(spark):
    rows = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUESTIONS)], "i int, q string")
    got = {r.i: r.s for r in rows.select("i", RT.structured_query(F.col("q")).alias("s")).collect()}
    for i, (question, operation, group_by, section, filters) in enumerate(QUESTIONS):
        s = got[i]
        assert (s.operation, s.group_by, s.section_kind, s.filters) == (operation, group_by, section, filters), question


@pytest.mark.parametrize("question, operation, filters, offset", [
    ("show more", "LIST", {"labels": ["POS"], "status_category_key": ["new"]}, 20),
    ("Continúa...", "LIST", {"labels": ["POS"], "status_category_key": ["new"]}, 20),
    ("how many are blocked", "COUNT", {"labels": ["POS"], "status": ["Blocked"]}, 0),
    ("what about KIOSK?", "COUNT", {"labels": ["KIOSK"], "status_category_key": ["new"]}, 0),
    ("ABC-7 comments", "SECTION", {"section_kind": ["COMMENT"], "issue_key": ["ABC-7"]}, 0),
    ("thanks", None, None, 0),
])
def test_follow_ups_page_merge_swap_or_end(spark, question, operation, filters, offset):
    scope = "named_struct('operation', 'COUNT', 'filters', map('labels', array('POS'), 'status_category_key', array('new')), 'next_offset', 20)"
    row = spark.range(1).select(F.expr(scope).alias("s"), F.lit(question).alias("q")).select(RT.continued_query(F.col("s"), F.col("q")).alias("c")).first().c
    assert (row.operation, row.filters, row.offset) == (operation, filters, offset)


def test_failures_and_quality_by_rules(spark):
    rows = [(429, "monthly quota used"), (429, "slow down"), (None, "Rate limit hit"), (403, ""), (404, ""), (400, ""), (503, ""), (None, "deadline_exceeded"), (None, "temporary"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "s int, m string").coalesce(1).select(RT.failure_class(F.col("s"), F.col("m"))).collect()]
    assert got == ["EMBEDDING_QUOTA_EXHAUSTED", "RATE_LIMITED", "RATE_LIMITED", "PROVIDER_AUTH_FAILED", "INDEX_NOT_FOUND", "INVALID_PROVIDER_REQUEST", "PROVIDER_UNAVAILABLE",
                   "PROVIDER_TIMEOUT", "PROVIDER_CONNECTION_FAILED", "UNKNOWN_RETRIEVAL_FAILURE"]
    asked = spark.createDataFrame([("why",), ("please explain",), ("explain printing",), ("how does the printing flow start",)], "q string").coalesce(1)
    assert [r[0] for r in asked.select(RT.query_quality(F.col("q"))).collect()] == ["WEAK:TOO_SHORT", "WEAK:NO_TOPIC", "AMBIGUOUS:SINGLE_TOPIC", "GOOD:SUFFICIENT_TOPIC"]


def test_sections_fall_back_on_other_identities_and_keep_long_change_lists(spark):
    from evidquarry.operators import structured as S

    schema = "cloud_id string, issue_key string, section_kind string, event_id string, attachment_id string, locator string, source_id string, event_date string, chunk_ordinal int, page_content string, ord long"
    rows = [("c", "A-1", "COMMENT", "", None, "L1", "s", "2024", 0, "First half", 1), ("c", "A-1", "COMMENT", None, "", "L1", "s", "2024", 1, "Second half", 2),
            ("c", "A-1", "ATTACHMENT", None, "f1", "L1", "s", "2023", 0, "a", 3), ("c", "A-1", "ATTACHMENT", None, "f2", "L1", "s", "2023", 0, "b", 4), ("c", "A-1", "COMMENT", None, None, None, "s2", "2025", 0, "c", 5)]
    pieces = ["["] + [f'{{"field":"f{i}","fromString":"","toString":"{i}"}}' + ("," if i < 2999 else "") for i in range(3000)] + ["]"]
    rows += [("c", "A-2", "CHANGELOG", "e", None, None, "s", "2024", i, piece, 100 + i) for i, piece in enumerate(pieces)]
    rows += [("c", "A-3", "COMMENT", "e", None, None, "s", "2024", i, f"COMMENT {'h' * 9000}" if i == 0 else f"{i}", 5000 + i) for i in range(2500)]
    chunks = spark.createDataFrame(rows, schema)
    got = {(r.key, r.event_id): r.text for r in S.sections(chunks).collect()}
    assert got[("A-1", "L1")] == "First half\nSecond half" and set(got) == {("A-1", "L1"), ("A-1", "f1"), ("A-1", "f2"), ("A-1", "s2"), ("A-2", "e"), ("A-3", "e")}
    assert got[("A-2", "e")].startswith("f0: not set → 0\nf1: not set → 1\n") and len(got[("A-2", "e")]) == 4000
    assert got[("A-3", "e")] == "\n".join(str(i) for i in range(1, 2500))[:4000]
    page = S.section_page(chunks, 1, 2).collect()
    assert [(r.key, r.event_id, r.total) for r in page] == [("A-1", "f2", 6), ("A-1", "L1", 6)]


def test_a_truncated_snapshot_gives_no_total(spark):
    from evidquarry.operators import structured as S
    from evidquarry.sources.tables import Tables

    issues = Tables(spark, "/root/testdata/sf0.001").issues()
    exact = S.count_issues(issues).first()
    assert exact.complete and exact.total > 0 and exact.degradation == ""
    cut = S.count_issues(issues, cap=10).first()
    assert (cut.complete, cut.total, cut.degradation) == (False, None, "SNAPSHOT_TRUNCATED")
