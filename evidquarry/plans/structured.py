"""Registered queries: structured aggregates over issues and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidquarry.operators import structured as S
from evidquarry.plans.registry import ctes, query

DEDUP = (
    "uniq",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, source_id ORDER BY ord DESC) rn "
    "FROM issues) WHERE rn = 1",
)


def _dedup(where: str) -> tuple[str, str]:
    return (
        "uniq",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, source_id ORDER BY ord DESC) rn "
        f"FROM issues WHERE {where}) WHERE rn = 1",
    )


_LABELS = "list_filter(list_transform(string_split(labels, ','), lambda x: trim(x)), lambda x: x <> '')"
_CATEGORY = (
    "CASE WHEN status_category_key <> '' THEN status_category_key WHEN status = 'Open' THEN 'new' "
    "WHEN status = 'In Progress' THEN 'indeterminate' WHEN status = 'Done' THEN 'done' END"
)


@query("a1_count", ctes("issues", _dedup(
    f"list_contains({_LABELS}, 'POS') AND priority IN ('1-URGENT', '2-HIGH') AND {_CATEGORY} IN ('new', 'done')"
)) + "SELECT count(*) AS total, (SELECT max(issue_updated) FROM issues) AS snapshot_at, (SELECT count(*) FROM issues) <= 1000000 AS complete, '' AS degradation FROM uniq")
def a1_count(t):
    return S.count_issues(
        t.issues(),
        {"labels": ("pos",), "priority": ("1-urgent", "2-high"), "status_category_key": ("new", "done")},
    )


@query("a2_list", ctes("issues", _dedup("status = 'Open'")) + f"""
SELECT issue_key AS key, title AS summary, status, status_category_key, resolution, issue_type, priority,
  parent_issue_key, assignee, array_to_string({_LABELS}, '|') AS labels, issue_updated AS updated,
  (SELECT count(*) FROM uniq) AS total
FROM uniq ORDER BY lower(split_part(issue_key, '-', 1)), CAST(split_part(issue_key, '-', 2) AS BIGINT), lower(issue_key)
LIMIT 50 OFFSET 100""")
def a2_list(t):
    return S.list_page(t.issues(), {"status": ("open",)}, offset=100, limit=50)


@query("a3_distribution", ctes("issues", DEDUP) + """
SELECT coalesce(nullif(issue_type, ''), 'Unspecified') AS value, count(*) AS n FROM uniq GROUP BY 1""")
def a3_distribution(t):
    return S.distribution(t.issues(), "issue_type")


@query("a3_status_distribution", ctes("issues", DEDUP) + "SELECT status AS value, count(*) AS n FROM uniq GROUP BY 1")
def a3_status_distribution(t):
    return S.distribution(t.issues(), "status")


@query("a4_overview", ctes("issues", DEDUP) + f"""
SELECT 'statuses' AS facet, status AS value, count(*) AS n FROM uniq GROUP BY 2
UNION ALL SELECT 'issue_types', coalesce(nullif(issue_type, ''), 'Unspecified'), count(*) FROM uniq GROUP BY 2
UNION ALL SELECT 'priorities', priority, count(*) FROM uniq GROUP BY 2
UNION ALL SELECT 'labels', label, count(*) FROM (SELECT unnest({_LABELS}) AS label FROM uniq) GROUP BY 2
UNION ALL SELECT 'components', 'Unspecified', count(*) FROM uniq
UNION ALL SELECT CASE WHEN parent_issue_key <> '' THEN 'child_work_items' ELSE 'top_level_work_items' END, '', count(*)
  FROM uniq GROUP BY 1""")
def a4_overview(t):
    return S.overview(t.issues())


@query("a5_detail", ctes("issues", "sections", DEDUP, (
    "counts", "SELECT upper(issue_key) AS k, section_kind, count(DISTINCT event_id) AS n FROM sections GROUP BY 1, 2"
), ("shown", "SELECT k, string_agg(section_kind || '=' || n, ',' ORDER BY section_kind) AS s FROM counts GROUP BY 1"),
    ("kids", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, source_id ORDER BY ord DESC) r2 "
     "FROM issues WHERE parent_issue_key <> '') WHERE r2 = 1")) + """
SELECT issue_key, status, parent_issue_key, 'PARENT' AS row_role, coalesce(s, '') AS section_counts
FROM uniq LEFT JOIN shown ON upper(issue_key) = k
UNION ALL SELECT issue_key, status, parent_issue_key, 'CHILD', '' FROM kids
WHERE upper(parent_issue_key) IN (SELECT upper(issue_key) FROM issues)""")
def a5_detail(t):
    return S.detail(t.issues(), t.sections())


_SECTION_CTES = (
    "sections",
    ("parts", "SELECT cloud_id, issue_key, section_kind, event_id, trim(page_content, ' ' || chr(10)) AS body, "
     "min({'o': chunk_ordinal, 'i': ord}) AS pos_ FROM sections "
     "WHERE trim(page_content, ' ' || chr(10)) <> '' GROUP BY ALL"),
    ("bodies", "SELECT cloud_id, issue_key, section_kind, event_id, string_agg(body, chr(10) ORDER BY pos_, body) AS txt "
     "FROM parts GROUP BY ALL"),
    ("heads", "SELECT cloud_id, issue_key, section_kind, event_id, "
     "arg_min(event_date, {'o': chunk_ordinal, 'i': ord, 'd': event_date}) AS event_date, arg_min(event_date, {'i': ord, 'd': event_date}) AS sort_date, "
     "count(*) AS chunks FROM sections GROUP BY ALL"),
    ("stripped", "SELECT h.*, CASE WHEN upper(txt) LIKE section_kind || ' %' "
     "THEN trim(regexp_replace(txt, '^[^\n]*\n?', ''), ' ' || chr(10)) ELSE txt END AS body "
     "FROM heads h LEFT JOIN bodies USING (cloud_id, issue_key, section_kind, event_id)"),
)
_CHANGE = (
    "CASE WHEN section_kind = 'CHANGELOG' AND body LIKE '[%' AND instr(body, chr(10)) = 0 THEN "
    "array_to_string(list_transform(CAST(json(body) AS JSON[]), lambda c: (c->>'field') || ': ' || "
    "coalesce(nullif(c->>'fromString', ''), 'not set') || ' → ' || coalesce(nullif(c->>'toString', ''), 'not set')), "
    "chr(10)) ELSE body END"
)


@query("a6_section", ctes(*_SECTION_CTES) + f"""
SELECT issue_key AS key, section_kind AS kind, event_id, event_date, sort_date, chunks,
  substr({_CHANGE}, 1, 4000) AS text FROM stripped""")
def a6_section(t):
    return S.sections(t.sections())


@query("a6_section_page", ctes(*_SECTION_CTES, ("ordered", "SELECT *, row_number() OVER (ORDER BY issue_key, sort_date, event_id, section_kind) AS k, count(*) OVER () AS total FROM stripped")) + f"""
SELECT issue_key AS key, section_kind AS kind, event_id, event_date, sort_date, chunks, substr({_CHANGE}, 1, 4000) AS text, total FROM ordered WHERE k > 40 AND k <= 60""")
def a6_section_page(t):
    """The third page of all sections, by issue, date and event."""
    return S.section_page(t.sections(), offset=40, limit=20)


@query("a6_section_count", ctes("sections") + """
SELECT section_kind AS kind, count(DISTINCT (cloud_id, issue_key, event_id)) AS total,
  max(event_date) AS latest FROM sections GROUP BY 1""")
def a6_section_count(t):
    identity = F.struct("cloud_id", "issue_key", "event_id")
    return (
        t.sections().groupBy(F.col("section_kind").alias("kind"))
        .agg(F.count_distinct(identity).alias("total"), F.max("event_date").alias("latest"))
    )


@query("a7_freshness", ctes("issues") + "SELECT max(issue_updated) AS freshness FROM issues")
def a7_freshness(t):
    return S.freshness(t.issues().withColumn("event_date", F.lit("")))


@query("a8_fixed_rule", ctes("issues") + """
SELECT coalesce(string_agg(DISTINCT resolution, '|') FILTER (WHERE lower(resolution) = 'fixed'), '') AS matching,
  CASE WHEN count(DISTINCT resolution) FILTER (WHERE lower(resolution) = 'fixed') = 1 THEN 'RESOLUTION:Fixed'
  ELSE 'STATUS_CATEGORY:DONE' END AS rule FROM issues""")
def a8_fixed_rule(t):
    return S.resolve_fixed(t.issues())


@query("a9_topic_label", ctes("issues", ("f", f"""
  SELECT label, count(*) AS frequency, count(*) FILTER (WHERE lower(title) LIKE '%customer 3%') AS mentions
  FROM (SELECT title, unnest({_LABELS}) AS label FROM issues) GROUP BY 1"""), ("c", """
  SELECT *, round(mentions / sqrt(frequency), 6) AS score FROM f WHERE mentions >= 2
  AND frequency <= greatest(3, floor((SELECT count(*) FROM issues) * 0.8))"""), ("r", """
  SELECT *, row_number() OVER (ORDER BY score DESC, mentions DESC, frequency DESC, label DESC) AS rn,
  lead(score) OVER (ORDER BY score DESC, mentions DESC, frequency DESC, label DESC) AS runner_up FROM c""")) + f"""
SELECT label, score, frequency AS population, runner_up,
  (frequency > (SELECT count(*) FROM issues WHERE lower(title || ' ' || labels) LIKE '%customer 3%')
   AND coalesce(runner_up, 0) * 1.5 <= score) AS resolved FROM r WHERE rn = 1""")
def a9_topic_label(t):
    return S.topic_label_candidates(t.issues(), ("Customer 3",))


@query("j6_children", ctes("issues", ("kids", "SELECT * FROM (SELECT *, row_number() OVER "
    "(PARTITION BY cloud_id, source_id ORDER BY ord DESC) rn FROM issues WHERE parent_issue_key <> '') WHERE rn = 1")) + """
SELECT upper(parent_issue_key) AS parent, count(*) AS n, count(*) FILTER (WHERE status = 'Done') AS done FROM kids
WHERE upper(parent_issue_key) IN (SELECT upper(issue_key) FROM issues) GROUP BY 1""")
def j6_children(t):
    return (
        S.children(t.issues()).groupBy(F.upper("parent_issue_key").alias("parent"))
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "Done", 1)).alias("done"))
    )


@query("j7_section_counts", ctes("sections") + """
SELECT upper(issue_key) AS key, section_kind AS kind, count(DISTINCT event_id) AS n FROM sections GROUP BY 1, 2""")
def j7_section_counts(t):
    return S.section_counts(t.sections())


@query("p1_issue_row", ctes("issues") + f"""
SELECT issue_key AS key, title AS summary, status, status_category_key, resolution, issue_type, priority,
  parent_issue_key, assignee, array_to_string({_LABELS}, '|') AS labels, issue_updated AS updated FROM issues""")
def p1_issue_row(t):
    return S.issue_row(t.issues())


@query("f5_typed_filters", ctes("issues") + f"""
SELECT status, {_CATEGORY} AS category, count(*) AS n FROM issues
WHERE {_CATEGORY} IN ('new', 'indeterminate') AND issue_type IN ('Bug', 'Story')
  AND lower(title || ' ' || labels) LIKE '%low%' GROUP BY ALL""")
def f5_typed_filters(t):
    issues = t.issues()
    kept = issues.where(
        S.field_predicate(
            issues,
            {"status_category_key": ("NEW", "indeterminate"), "issue_type": ("bug", "story"), "topic": ("Löw",)},
        )
    )
    legacy = F.create_map(*[F.lit(v) for p in S.LEGACY_STATUS_CATEGORY.items() for v in p])
    category = F.coalesce(F.nullif("status_category_key", F.lit("")), legacy[F.lower("status")])
    return kept.groupBy("status", category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("f6_current_state", ctes("issues") + "SELECT chunk_kind, count(*) AS n FROM issues WHERE chunk_kind = 'CURRENT' GROUP BY 1")
def f6_current_state(t):
    return S.current_state(t.issues()).groupBy("chunk_kind").agg(F.count(F.lit(1)).alias("n"))


@query("l2_natural_sort", ctes("issues", DEDUP) + """
SELECT issue_key, status FROM uniq
ORDER BY lower(split_part(issue_key, '-', 1)) DESC, CAST(split_part(issue_key, '-', 2) AS BIGINT) DESC LIMIT 40""")
def l2_natural_sort(t):
    order = [c.desc() for c in S.natural_order(F.col("issue_key"))]
    return S.last_per_identity(t.issues()).orderBy(*order).limit(40).select("issue_key", "status")


@query("l3_paging", ctes("issues", DEDUP) + """
SELECT total, 25 AS page_size, CAST(ceil(total / 25.0) AS BIGINT) AS pages, 75 AS next_offset, 75 < total AS has_more
FROM (SELECT count(*) AS total FROM uniq)""")
def l3_paging(t):
    total = S.matched_issues(t.issues()).agg(F.count(F.lit(1)).alias("total"))
    return total.select(
        "total",
        F.lit(25).alias("page_size"),
        F.ceil(F.col("total") / 25).alias("pages"),
        F.lit(75).alias("next_offset"),
        (F.lit(75) < F.col("total")).alias("has_more"),
    )
