"""Registered queries: retrieval and generation metrics, pairwise results, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from evidquarry.operators import audits, metrics as M, predicates, ranking as R, ranks
from evidquarry.plans.registry import ctes, query
from evidquarry.plans.retrieval import DENSE_CTES, dense_top

# ---- one case per question vector; gold = vectors with the same label -----------

CASE_CTES = (
    "chunks",
    *DENSE_CTES,
    ("g", "SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY 1"),
    ("cs", "SELECT q.vec_id AS query_id, q.label, c.language AS query_language, 'dep' || (q.vec_id % 3) AS department, "
     "q.vec_id % 4 <> 3 AS answerable, CASE WHEN q.vec_id % 5 = 0 THEN 'navigation' ELSE 'answer_evidence' END AS role, "
     "g.n AS gold_size, 3 AS n_sections FROM embeddings q JOIN chunks c ON c.chunk_id = q.vec_id JOIN g USING (label) "
     "WHERE q.vec_id IN (SELECT item_id FROM benchmark)"),
    ("ht", "SELECT d.query_id, dense_rank - 1 AS rank, d.chunk_id, e.label = cs.label AS rel, d.chunk_id % 3 AS section, "
     "c.project_id FROM den d JOIN cs USING (query_id) JOIN embeddings e ON e.vec_id = d.chunk_id "
     "JOIN chunks c ON c.chunk_id = d.chunk_id WHERE d.chunk_id <> d.query_id"),
    ("pq", "SELECT query_id, count(*) FILTER (WHERE rel) AS fk, count(*) FILTER (WHERE rel AND rank <= 8) AS fn, "
     "min(rank) FILTER (WHERE rel AND rank <= 8) AS fst, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel AND rank <= 8), 0) AS dcg, "
     "count(DISTINCT section) FILTER (WHERE rel AND rank <= 8) AS sx, max(CASE WHEN project_id <> 'ALPHA' THEN 1 ELSE 0 END) AS fo "
     "FROM ht WHERE rank <= 25 GROUP BY 1"),
    ("idl", "SELECT i AS g, sum(1 / log2(i + 1)) OVER (ORDER BY i) AS d FROM range(1, 9) t(i)"),
    ("cm", "SELECT cs.query_id, query_language, department, answerable, answerable AND gold_size > 0 AS resolved, "
     "answerable AND gold_size > 0 AND role = 'answer_evidence' AS evidence, "
     "CASE WHEN answerable AND gold_size > 0 THEN fk / gold_size END AS recall, "
     "CASE WHEN answerable AND gold_size > 0 THEN least(gold_size, 25) / gold_size END AS recall_ceiling, "
     "CASE WHEN answerable AND gold_size > 0 THEN CAST(fk > 0 AS INT) END AS candidate_hit, "
     "CASE WHEN answerable AND gold_size > 0 THEN CAST(sx > 0 AS INT) END AS section_hit, "
     "CASE WHEN answerable AND gold_size > 0 THEN sx / n_sections END AS section_recall, "
     "CASE WHEN answerable AND gold_size > 0 AND role = 'answer_evidence' THEN fn / 8.0 END AS precision, "
     "CASE WHEN answerable AND gold_size > 0 AND role = 'answer_evidence' THEN CAST(fn > 0 AS INT) END AS hit_rate, "
     "CASE WHEN answerable AND gold_size > 0 AND role = 'answer_evidence' THEN coalesce(1.0 / fst, 0) END AS mrr, "
     "CASE WHEN answerable AND gold_size > 0 AND role = 'answer_evidence' THEN dcg / (SELECT d FROM idl WHERE g = least(gold_size, 8)) END AS ndcg, "
     "CASE WHEN answerable THEN fo END AS leak FROM cs LEFT JOIN pq USING (query_id)"),
)
_M = ("candidate_hit", "section_hit", "section_recall", "precision", "recall", "hit_rate", "mrr", "ndcg")
_MEANS = ", ".join(f"round(coalesce(avg({m}), 0), 6) AS {m}" for m in (*_M, "recall_ceiling"))
_AGGS = (
    "count(*) AS cases, count(*) FILTER (WHERE answerable) AS answerable_cases, "
    "count(*) FILTER (WHERE resolved) AS gold_resolved_cases, count(*) FILTER (WHERE evidence) AS answer_evidence_cases, "
    f"{_MEANS}, coalesce(sum(leak), 0) AS leakage"
)
_LABEL = (
    "CASE WHEN grouping(department) = 1 THEN 'ALL' ELSE department END AS department, "
    "CASE WHEN grouping(query_language) = 1 THEN 'ALL' ELSE query_language END AS query_language"
)
_SETS = "GROUP BY GROUPING SETS ((), (query_language), (department), (department, query_language))"
_SUMMARY = ("sm", f"SELECT {_LABEL}, {_AGGS} FROM cm {_SETS}")


def cases(t):
    vec = t.read("embeddings").select("vec_id", "label")
    sizes = vec.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("gold_size"))
    asked = vec.join(t.read("benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    langs = t.chunks().select(F.col("chunk_id").alias("vec_id"), F.col("language").alias("query_language"))
    return asked.join(sizes, "label").join(langs, "vec_id").select(
        F.col("vec_id").alias("query_id"), "label", "query_language",
        F.concat(F.lit("dep"), (F.col("vec_id") % 3).cast("string")).alias("department"),
        (F.col("vec_id") % 4 != 3).alias("answerable"),
        F.when(F.col("vec_id") % 5 == 0, "navigation").otherwise("answer_evidence").alias("role"),
        "gold_size", F.lit(3).alias("n_sections"),
    )


def hits(t):
    labels = t.read("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("chunk_label"))
    found = dense_top(t).where(F.col("chunk_id") != F.col("query_id"))
    return (
        found.join(cases(t).select("query_id", "label"), "query_id")
        .join(labels, "chunk_id")
        .join(t.chunks().select("chunk_id", "project_id"), "chunk_id")
        .select(
            "query_id", (F.col("dense_rank") - 1).alias("rank"), "chunk_id",
            (F.col("label") == F.col("chunk_label")).alias("rel"), (F.col("chunk_id") % 3).alias("section"), "project_id",
        )
    )


def case_rows(t):
    return M.case_metrics(hits(t), cases(t))


@query("a17_retrieval_case_metrics", ctes(*CASE_CTES) + """
SELECT query_id, query_language, department, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr,
  round(ndcg, 6) AS ndcg, round(section_recall, 6) AS section_recall FROM cm""")
def a17_retrieval_case_metrics(t):
    return case_rows(t).select(
        "query_id", "query_language", "department",
        *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg", "section_recall")],
    )


@query("a18_grouping_sets", ctes(*CASE_CTES, _SUMMARY) + "SELECT * FROM sm")
def a18_grouping_sets(t):
    return M.retrieval_summary(case_rows(t))


@query("a19_language_gap", ctes(*CASE_CTES, ("gp", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, coalesce(avg({m}) FILTER (WHERE query_language = 'en'), 0) - coalesce(avg({m}) "
    "FILTER (WHERE query_language = 'es'), 0) AS gap FROM cm" for m in _M))) + """
SELECT metric, round(gap, 6) AS gap, round(abs(gap), 6) AS gap_abs FROM gp""")
def a19_language_gap(t):
    return M.language_gap(case_rows(t))


_SLICE = """CASE WHEN department = 'ALL' AND query_language = 'ALL' THEN 'overall' WHEN department = 'ALL' THEN query_language
  WHEN query_language = 'ALL' THEN 'department.' || department ELSE 'department.' || department || '.' || query_language END"""


@query("p8_flatten_metrics", ctes(*CASE_CTES, _SUMMARY) + " UNION ALL ".join(
    f"SELECT '{m}.' || {_SLICE} AS name, {m} AS value FROM sm" for m in _M))
def p8_flatten_metrics(t):
    return M.flattened(M.retrieval_summary(case_rows(t)))


@query("c40_metric_populations", ctes(*CASE_CTES, _SUMMARY) + " UNION ALL ".join(
    f"SELECT department, query_language, '{m}' AS metric, "
    + ("gold_resolved_cases" if m in ("recall", "candidate_hit", "section_hit", "section_recall") else "answer_evidence_cases")
    + " AS n FROM sm" for m in _M))
def c40_metric_populations(t):
    return M.populations(M.retrieval_summary(case_rows(t)))


# ---- generation outcomes, one per assistant turn --------------------------------

_GEN = {
    "case_id": "conv_id * 100 + turn",
    "query_language": "CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'und' END",
    "department": "'dep' || CAST(conv_id % 4 AS STRING)",
    "answerable": "conv_id % 4 <> 0",
    "answered": "length(text) % 3 <> 0",
    "grounding_accepted": "length(text) % 3 <> 0 AND length(text) % 5 <> 0",
    "refusal_reason": "CASE WHEN length(text) % 3 = 0 THEN CASE WHEN turn % 4 = 1 THEN 'NO_ACCESS' ELSE 'INSUFFICIENT_EVIDENCE' END END",
    "expected_refusal_reason": "CASE WHEN conv_id % 8 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN conv_id % 8 = 4 THEN 'NO_ACCESS' ELSE '' END",
    "cited": "length(text) % 4",
    "valid_citation_count": "least(length(text) % 4, length(text) % 3)",
    "uncited_claims_dropped": "length(text) % 2",
    "canonical_fallback_used": "length(text) % 7 = 0",
    "canonical_fallback_reason": "CASE WHEN length(text) % 14 = 0 THEN '' ELSE 'TIMEOUT' END",
    "paraphrase_group": "CASE WHEN conv_id % 6 = 0 THEN '' ELSE 'g' || CAST(conv_id AS STRING) END",
    "text": "text",
}
_GEN_LIST = [f"{e} AS {c}" for c, e in _GEN.items()]
GEN_CTE = ("gen", "SELECT " + ", ".join(_GEN_LIST) + " FROM conversations WHERE role = 'assistant'")


def generations(t):
    return t.read("conversations").where("role = 'assistant'").selectExpr(*_GEN_LIST)


def _share(part: str, whole: str) -> str:
    return f"round(coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0), 6)"


def _n(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


_REF = "coalesce(refusal_reason, '') <> ''"


@query("a20_generation_metrics", ctes(GEN_CTE) + f"""
SELECT {_LABEL}, count(*) AS cases, {_n('answerable')} AS answerable_cases, sum(cited) AS citation_count,
  sum(uncited_claims_dropped) AS uncited_claims_dropped, {_n(_REF)} AS refusal_cases,
  {_n("NOT answerable AND expected_refusal_reason <> ''")} AS refusal_reason_cases,
  {_share(_n('answerable AND grounding_accepted'), _n('answerable'))} AS grounding_acceptance_rate,
  {_share('sum(valid_citation_count)', 'sum(cited)')} AS citation_precision,
  {_share(_n('NOT answerable AND ' + _REF), _n(_REF))} AS refusal_precision,
  {_share(_n('NOT answerable AND NOT (' + _REF + ')'), _n('NOT answerable'))} AS out_of_scope_answer_rate,
  {_share(_n('NOT answerable AND NOT canonical_fallback_used AND NOT (' + _REF + ')'), _n('NOT answerable AND NOT canonical_fallback_used'))} AS out_of_scope_without_fallback,
  {_n('canonical_fallback_used')} AS canonical_fallback_cases,
  {_share(_n("NOT answerable AND expected_refusal_reason <> '' AND refusal_reason IS NOT DISTINCT FROM expected_refusal_reason"), _n("NOT answerable AND expected_refusal_reason <> ''"))} AS refusal_reason_accuracy
FROM gen {_SETS}""")
def a20_generation_metrics(t):
    return M.generation_summary(generations(t))


@query("a20_fallback_reasons", ctes(GEN_CTE) + """
SELECT coalesce(nullif(canonical_fallback_reason, ''), 'UNCLASSIFIED') AS reason, count(*) AS n FROM gen WHERE canonical_fallback_used GROUP BY 1""")
def a20_fallback_reasons(t):
    return M.fallback_reasons(generations(t))


@query("a21_paraphrase_invariance", ctes(GEN_CTE, ("pg", """
SELECT paraphrase_group, count(DISTINCT (answered, grounding_accepted, coalesce(refusal_reason, '?'))) AS s FROM gen
WHERE paraphrase_group <> '' GROUP BY 1""")) + """
SELECT count(*) AS groups, count(*) FILTER (WHERE s > 1) AS divergent, round(1 - count(*) FILTER (WHERE s > 1) / count(*), 6) AS rate FROM pg""")
def a21_paraphrase_invariance(t):
    return M.paraphrase_invariance(generations(t))


@query("a25_metric_means", ctes(GEN_CTE, ("v", """
SELECT query_language, CASE WHEN length(text) % 11 <> 0 THEN (length(text) % 100) / 100.0 END AS faithfulness,
  (length(text) % 37) / 37.0 AS relevancy FROM gen"""), ("s", """
SELECT avg(faithfulness) fo, avg(faithfulness) FILTER (WHERE query_language = 'en') fe, avg(faithfulness) FILTER (WHERE query_language = 'es') fs,
  avg(relevancy) ro, avg(relevancy) FILTER (WHERE query_language = 'en') re, avg(relevancy) FILTER (WHERE query_language = 'es') rs FROM v""")) + """
SELECT unnest(['faithfulness.overall', 'faithfulness.en', 'faithfulness.es', 'faithfulness.language_gap', 'faithfulness.language_gap_abs',
  'relevancy.overall', 'relevancy.en', 'relevancy.es', 'relevancy.language_gap', 'relevancy.language_gap_abs']) AS name,
  unnest([round(fo, 6), round(fe, 6), round(fs, 6), round(fe - fs, 6), round(abs(fe - fs), 6),
  round(ro, 6), round(re, 6), round(rs, 6), round(re - rs, 6), round(abs(re - rs), 6)]) AS value FROM s""")
def a25_metric_means(t):
    size = F.length("text")
    rows = generations(t).select(
        "query_language",
        F.when(size % 11 == 0, F.lit(float("nan"))).otherwise((size % 100) / 100).alias("faithfulness"),
        ((size % 37) / 37).alias("relevancy"),
    )
    return M.metric_means(rows, ["faithfulness", "relevancy"])


# ---- pairwise results, one pair per document ------------------------------------

_PAIR = {
    "case_id": "doc_id",
    "query_language": "CASE WHEN lang IN ('en', 'es') THEN lang ELSE 'und' END",
    "baseline_answer": "text",
    "candidate_answer": "substr(text, 1, CAST(length(text) - length(text) * (doc_id % 5) / 10 AS INT))",
    "first_pass": "CASE doc_id % 3 WHEN 0 THEN 'RESPONSE_1' WHEN 1 THEN 'RESPONSE_2' ELSE 'TIE' END",
    "second_pass": "CASE doc_id % 4 WHEN 0 THEN 'RESPONSE_2' WHEN 1 THEN 'RESPONSE_1' WHEN 2 THEN 'RESPONSE_2' ELSE 'TIE' END",
}
_PAIR_LIST = [f"{e} AS {c}" for c, e in _PAIR.items()]
PAIR_CTES = (
    ("pr", "SELECT doc_id AS case_id, CASE WHEN lang IN ('en', 'es') THEN lang ELSE 'und' END AS query_language, text AS baseline_answer, "
     "substr(text, 1, CAST(floor(length(text) - length(text) * (doc_id % 5) / 10.0) AS INT)) AS candidate_answer, "
     + ", ".join(_PAIR_LIST[4:]) + " FROM documents"),
    ("ps", "SELECT *, contains('13579bdf', substr(sha256(CAST(case_id AS VARCHAR)), 2, 1)) AS bf, "
     "greatest(1, len(list_filter(string_split_regex(baseline_answer, '\\s+'), lambda w: w <> ''))) AS wa, "
     "greatest(1, len(list_filter(string_split_regex(candidate_answer, '\\s+'), lambda w: w <> ''))) AS wb FROM pr"),
    ("po", "SELECT *, CASE WHEN first_pass = 'TIE' THEN 'TIE' WHEN (first_pass = 'RESPONSE_1') = bf THEN 'BASELINE' ELSE 'CANDIDATE' END AS f, "
     "CASE WHEN second_pass = 'TIE' THEN 'TIE' WHEN (second_pass = 'RESPONSE_1') = (NOT bf) THEN 'BASELINE' ELSE 'CANDIDATE' END AS s, "
     "CAST(greatest(wa, wb) AS DOUBLE) / least(wa, wb) AS ratio FROM ps"),
    ("rc", "SELECT case_id, query_language, CASE WHEN f <> s THEN 'TIE' ELSE f END AS outcome, f <> s AND f <> 'TIE' AND s <> 'TIE' AS position_bias, "
     "CAST(round_even(ratio, 3) AS DOUBLE) AS length_ratio, ratio > 1.25 AS length_mismatch FROM po"),
)


def pairs(t):
    df = t.read("documents").selectExpr(*_PAIR_LIST[:3], "doc_id", *_PAIR_LIST[4:])
    size = F.floor(F.length("baseline_answer") - F.length("baseline_answer") * (F.col("doc_id") % 5) / 10).cast("int")
    return df.withColumn("candidate_answer", F.substring("baseline_answer", F.lit(1), size)).drop("doc_id")


@query("a24_order_debiasing", ctes(*PAIR_CTES) + "SELECT * FROM rc")
def a24_order_debiasing(t):
    return M.reconciled(pairs(t))


@query("a23_pairwise_summary", ctes(*PAIR_CTES, ("sc", "SELECT * FROM rc WHERE NOT length_mismatch"), ("bo", """
SELECT 'overall' AS scope, outcome FROM sc UNION ALL SELECT query_language, outcome FROM sc WHERE query_language IN ('en', 'es')""")) + """
SELECT scope, (SELECT count(*) FROM rc) AS pairs, (SELECT count(*) FROM sc) AS comparable_pairs,
  (SELECT round(avg(CAST(position_bias AS INT)), 6) FROM rc) AS position_bias_rate,
  (SELECT CAST(round_even(avg(length_ratio), 3) AS DOUBLE) FROM rc) AS mean_length_ratio,
  round(avg(CAST(outcome = 'CANDIDATE' AS INT)), 6) AS candidate_win_rate, round(avg(CAST(outcome = 'BASELINE' AS INT)), 6) AS baseline_win_rate,
  round(avg(CAST(outcome = 'TIE' AS INT)), 6) AS tie_rate,
  CASE WHEN (SELECT avg(CAST(position_bias AS INT)) FROM rc) > 0.2 THEN 'UNRELIABLE_POSITION_BIAS' ELSE 'OK' END AS verdict_reliability
FROM bo GROUP BY 1""")
def a23_pairwise_summary(t):
    return M.pairwise_summary(M.reconciled(pairs(t)))


@query("x57_presentation_order", """
SELECT doc_id AS case_id, contains('13579bdf', substr(sha256(CAST(doc_id AS VARCHAR)), 2, 1)) AS baseline_first FROM documents""")
def x57_presentation_order(t):
    byte = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2), 16, 10).cast("int")
    return t.read("documents").select(F.col("doc_id").alias("case_id"), (byte % 2 == 1).alias("baseline_first"))


# ---- suite preflight ------------------------------------------------------------

NEEDLE = "text"
_PRE = (
    ("nd", f"SELECT item_id AS needle_id, {NEEDLE} AS needle FROM benchmark"),
    ("mt", "SELECT needle_id AS case_id, doc_id FROM nd, documents WHERE contains(replace(lower(text), 'ß', 'ss'), replace(lower(needle), 'ß', 'ss'))"),
    ("ca", "SELECT item_id AS case_id, item_id % 6 <> 0 AS answerable, item_id % 9 = 1 AS retired FROM benchmark"),
)


def _needles(t):
    return t.read("benchmark").selectExpr("item_id AS needle_id", f"{NEEDLE} AS needle")


def _matches(t):
    return audits.contained_in(_needles(t), t.read("documents"), "doc_id", "text").withColumnRenamed("needle_id", "case_id")


def _suite(t):
    return t.read("benchmark").selectExpr("item_id AS case_id", "item_id % 6 <> 0 AS answerable", "item_id % 9 = 1 AS retired")


@query("j8_case_predicate_join", ctes(*_PRE) + "SELECT case_id, doc_id FROM mt")
def j8_case_predicate_join(t):
    return _matches(t)


# a case's chunk holds its whole text in English, or has its reference, or its title in any punctuation
_JSON_TREE = """'{"any_of": [{"all_of": [' || to_json(named_struct('field', 'page_content', 'contains', text)) || ', {"field": "language", "equals": "EN"}]}, '
  || to_json(named_struct('field', 'reference', 'equals', 'SRC' || (item_id % 20) || '#' || (item_id * 3))) || ', '
  || to_json(named_struct('field', 'title', 'contains', '[' || split_part(text, ' ', 1) || '] -- ' || split_part(text, ' ', 2))) || ']}'"""
_FOLDED = "replace(lower({0}), 'ß', 'ss')"
_LOOSE = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^a-z0-9]+', '', 'g')"


@query("f10_gold_predicates", ctes("chunks", ("hit", f"""
SELECT item_id AS case_id, chunk_id, language FROM benchmark b JOIN chunks c ON
  (b.text <> '' AND (contains({_FOLDED.format('page_content')}, {_FOLDED.format('b.text')})
     OR ({_LOOSE.format('b.text')} <> '' AND contains({_LOOSE.format('page_content')}, {_LOOSE.format('b.text')}))) AND lower(language) = 'en')
  OR lower(reference) = 'src' || (item_id % 20) || '#' || (item_id * 3)
  OR contains({_LOOSE.format('title')}, {_LOOSE.format("split_part(b.text, ' ', 1) || split_part(b.text, ' ', 2)")})""")) + """
SELECT case_id, count(*) AS gold, min(chunk_id) AS first_gold FROM hit GROUP BY 1""")
def f10_gold_predicates(t):
    """Gold chunks by trees of all_of, any_of, equals and contains."""
    trees = t.read("benchmark").selectExpr("item_id", f"{_JSON_TREE} AS tree")
    nodes = predicates.predicate_nodes(trees, "item_id", "tree")
    found = predicates.matching(t.chunks(), nodes, "chunk_id", ("page_content", "language", "reference", "title"))
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("gold"), F.min("chunk_id").alias("first_gold"))


@query("f18_active_cases", ctes(*_PRE) + "SELECT answerable, retired, count(*) AS n FROM ca WHERE answerable AND NOT retired GROUP BY 1, 2")
def f18_active_cases(t):
    return _suite(t).where(F.col("answerable") & ~F.col("retired")).groupBy("answerable", "retired").agg(F.count(F.lit(1)).alias("n"))


@query("a22_gold_resolution", ctes(*_PRE, ("ac", "SELECT * FROM ca WHERE answerable AND NOT retired"), ("x", """
SELECT count(*) AS answerable_cases, (SELECT count(*) FROM ac WHERE case_id IN (SELECT case_id FROM mt)) AS resolved_gold_cases FROM ac""")) + """
SELECT *, round(resolved_gold_cases / answerable_cases, 6) AS gold_resolution_rate, resolved_gold_cases / answerable_cases >= 0.95 AS passed FROM x""")
def a22_gold_resolution(t):
    return audits.resolution(_suite(t), _matches(t), M.GOLD_FLOOR)


@query("j13_unresolved_triage", ctes("chunks", ("v", """
SELECT item_id AS case_id, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 40) WHEN item_id % 3 = 1 THEN 'P' || item_id
  ELSE 'missing-' || item_id END AS value FROM benchmark"""), ("f", """
SELECT DISTINCT value, field FROM (SELECT source_id AS value, 'source_id' AS field FROM chunks UNION ALL SELECT parent_id, 'parent_id' FROM chunks
UNION ALL SELECT entity_key, 'entity_key' FROM chunks)""")) + """
SELECT case_id, v.value, coalesce(string_agg(field, '|' ORDER BY field), '') AS fields,
  CASE WHEN count(field) > 0 THEN 'REPOINTABLE' ELSE 'ABSENT_FROM_CORPUS' END AS verdict FROM v LEFT JOIN f USING (value) GROUP BY 1, 2""")
def j13_unresolved_triage(t):
    wanted = t.read("benchmark").selectExpr(
        "item_id AS case_id",
        "CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 40) WHEN item_id % 3 = 1 THEN 'P' || item_id ELSE 'missing-' || item_id END AS value",
    )
    fields = ["source_id", "parent_id", "entity_key"]
    manifest = t.chunks().select("chunk_id", *fields).unpivot(["chunk_id"], fields, "field", "value")
    present = manifest.select("value", "field").distinct()
    found = wanted.join(present, "value", "left").groupBy("case_id", "value").agg(
        F.array_join(F.array_sort(F.collect_set("field")), "|").alias("fields"), F.count("field").alias("_n")
    )
    return found.withColumn(
        "verdict", F.when(F.col("_n") > 0, "REPOINTABLE").otherwise("ABSENT_FROM_CORPUS")
    ).drop("_n")


# ---- thresholds and latency -----------------------------------------------------

_SCORED = ("sd", "SELECT l.quality = 1 AS answerable, (d.n_chars % 997) / 1000.0 AS s FROM labels l JOIN documents d USING (doc_id)")


def _scored(t):
    return t.read("labels").join(t.read("documents").select("doc_id", "n_chars"), "doc_id").select(
        (F.col("quality") == 1).alias("answerable"), ((F.col("n_chars") % 997) / 1000).alias("max_rerank_score")
    )


@query("a34_threshold_calibration", ctes(_SCORED, ("c", "SELECT DISTINCT CAST(s AS DOUBLE) AS t FROM sd UNION SELECT unnest([0.0, 0.35, 1.0])")) + """
SELECT coalesce(min(t), 1.0) AS threshold FROM c WHERE (SELECT count(*) FROM sd WHERE NOT answerable AND s >= t)
  <= 0.05 * (SELECT count(*) FROM sd WHERE NOT answerable)""")
def a34_threshold_calibration(t):
    return M.calibrated_threshold(_scored(t))


@query("j17_threshold_rates", ctes(_SCORED, ("th", "SELECT unnest([0.1, 0.35, 0.6, 0.9]) AS t")) + """
SELECT CAST(t AS DOUBLE) AS threshold, (SELECT round(avg(CASE WHEN s >= t THEN 1.0 ELSE 0.0 END), 6) FROM sd WHERE NOT answerable) AS false_positive_rate FROM th""")
def j17_threshold_rates(t):
    negatives = _scored(t).where(~F.col("answerable"))
    grid = (0.1, 0.35, 0.6, 0.9)
    rates = negatives.agg(*[F.avg((F.col("max_rerank_score") >= v).cast("int")).alias(f"t{i}") for i, v in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(v).alias("threshold"), F.round(f"t{i}", 6).alias("false_positive_rate")) for i, v in enumerate(grid)])
    return rates.select(F.explode(rows).alias("r")).select("r.*")


@query("a34_score_separation", ctes(_SCORED) + """
SELECT CAST(min(s) FILTER (WHERE answerable) AS DOUBLE) AS positive_min, CAST(max(s) FILTER (WHERE NOT answerable) AS DOUBLE) AS negative_max FROM sd""")
def a34_score_separation(t):
    return M.separation(_scored(t), "answerable", "max_rerank_score")


@query("a31_latency_percentiles", ctes(("o", """
SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL""")) + """
SELECT event_type, max(n) AS n, CAST(round_even(avg(CAST(value < 5 AS INT)), 3) AS DOUBLE) AS burst_share,
  max(value) FILTER (WHERE i = round_even((n - 1) * 0.5, 0)) AS p50, max(value) FILTER (WHERE i = round_even((n - 1) * 0.95, 0)) AS p95,
  round(median(value), 9) AS median FROM o GROUP BY 1""")
def a31_latency_percentiles(t):
    out = M.latency_summary(t.read("events").where(F.col("value").isNotNull()), "value", ["event_type"])
    return out.withColumn("median", F.round("median", 9))


# ---- audits ---------------------------------------------------------------------

_APP = {
    "case_id": "doc_id",
    "language": "CASE WHEN lang = 'es' THEN 'es' ELSE 'en' END",
    "answerable": "doc_id % 4 <> 0",
    "baseline_gold_final_evidence_hit": "doc_id % 4 <> 0 AND doc_id % 3 <> 0",
    "staged_gold_final_evidence_hit": "doc_id % 4 <> 0 AND doc_id % 5 <> 0",
    "baseline_verified_abstention": "doc_id % 4 = 0 AND doc_id % 7 <> 0",
    "staged_verified_abstention": "doc_id % 4 = 0 AND doc_id % 3 <> 0",
    "baseline_evidence_or_abstention_correct": "CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 <> 0 ELSE doc_id % 7 <> 0 END",
    "staged_evidence_or_abstention_correct": "CASE WHEN doc_id % 4 <> 0 THEN doc_id % 5 <> 0 ELSE doc_id % 3 <> 0 END",
}
_APP_LIST = [f"{e} AS {c}" for c, e in _APP.items()]


@query("a28_regression_gate", ctes(("ap", "SELECT " + ", ".join(_APP_LIST) + " FROM documents"), ("lg", " UNION ALL ".join(
    f"SELECT language, '{m}' AS metric, baseline_{m} AS b, staged_{m} AS s FROM ap WHERE {w}" for m, w in (
        ("evidence_or_abstention_correct", "true"), ("gold_final_evidence_hit", "answerable"), ("verified_abstention", "NOT answerable"))))) + """
SELECT metric, CASE WHEN grouping(language) = 1 THEN 'all' ELSE language END AS language, count(*) AS cases,
  round(avg(CAST(b AS INT)), 6) AS baseline, round(avg(CAST(s AS INT)), 6) AS staged,
  round(100 * (avg(CAST(b AS INT)) - avg(CAST(s AS INT))), 6) AS regression_points,
  round(100 * (avg(CAST(b AS INT)) - avg(CAST(s AS INT))), 6) <= 5 AS passed FROM lg GROUP BY GROUPING SETS ((metric), (metric, language))""")
def a28_regression_gate(t):
    return audits.regression_gate(t.read("documents").selectExpr(*_APP_LIST))


@query("j10_total_outer_match", """
SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NULL) AS unmatched_staged, count(*) FILTER (WHERE l.k IS NULL) AS unmatched_baseline
FROM orders FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o_orderkey = l.k""")
def j10_total_outer_match(t):
    staged = t.read("lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    joined = t.read("orders").select("o_orderkey").join(staged, F.col("o_orderkey") == F.col("k"), "full_outer")
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("o_orderkey").isNull(), 1)).alias("unmatched_staged"),
        F.count(F.when(F.col("k").isNull(), 1)).alias("unmatched_baseline"),
    )


_REF_SQL = ("rf", "SELECT conv_id, turn, 'src' || (conv_id % 20) AS source_id, 'L' || ((conv_id + turn) % 45) AS locator FROM conversations WHERE role = 'assistant'")


def _references(t):
    return t.read("conversations").where("role = 'assistant'").selectExpr(
        "conv_id", "turn", "'src' || (conv_id % 20) AS source_id", "'L' || ((conv_id + turn) % 45) AS locator"
    )


@query("j11_multi_key_resolution", ctes("chunks", _REF_SQL, ("k", "SELECT source_id, locator, count(*) AS n FROM chunks GROUP BY 1, 2")) + """
SELECT conv_id, turn, coalesce(n, 0) AS matches, n IS NULL AS unresolved FROM rf LEFT JOIN k USING (source_id, locator)""")
def j11_multi_key_resolution(t):
    keyed = t.chunks().groupBy("source_id", "locator").agg(F.count(F.lit(1)).alias("n"))
    return _references(t).join(keyed, ["source_id", "locator"], "left").select(
        "conv_id", "turn", F.coalesce("n", F.lit(0)).alias("matches"), F.col("n").isNull().alias("unresolved")
    )


@query("j12_citation_identity", ctes("chunks", _REF_SQL) + """
SELECT count(*) AS citations, count(*) FILTER (WHERE k.source_id IS NULL) AS invalid,
  round(1 - count(*) FILTER (WHERE k.source_id IS NULL) / count(*), 6) AS correctness
FROM rf LEFT JOIN (SELECT DISTINCT source_id, locator FROM chunks) k USING (source_id, locator)""")
def j12_citation_identity(t):
    known = t.chunks().select("source_id", "locator").distinct().withColumn("known", F.lit(True))
    joined = _references(t).join(known, ["source_id", "locator"], "left")
    invalid = F.count(F.when(F.col("known").isNull(), 1))
    return joined.agg(
        F.count(F.lit(1)).alias("citations"), invalid.alias("invalid"),
        F.round(1 - invalid / F.count(F.lit(1)), 6).alias("correctness"),
    )


_AUD = "(turn + conv_id) % 3 <> 0 AS candidate_hit, (turn * conv_id) % 4 <> 0 AS final_hit, conv_id % 4 <> 0 AS answerable, conv_id % 13 = 0 AS foreign_policy"


@query("a26_retrieval_audit", ctes(("au", f"SELECT conv_id, turn, {_AUD}, CASE WHEN length(text) % 3 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'ANSWERED' END AS status FROM conversations WHERE role = 'assistant'")) + """
SELECT status, count(*) AS cases, round(avg(CAST(candidate_hit AS INT)) FILTER (WHERE answerable), 6) AS candidate_recall,
  round(avg(CAST(final_hit AS INT)) FILTER (WHERE answerable), 6) AS final_recall, count(*) FILTER (WHERE foreign_policy) AS unauthorized FROM au GROUP BY 1""")
def a26_retrieval_audit(t):
    rows = t.read("conversations").where("role = 'assistant'").selectExpr(
        *_AUD.split(", "), "CASE WHEN length(text) % 3 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'ANSWERED' END AS status"
    )
    return rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("cases"),
        F.round(F.avg(F.when(F.col("answerable"), F.col("candidate_hit").cast("int"))), 6).alias("candidate_recall"),
        F.round(F.avg(F.when(F.col("answerable"), F.col("final_hit").cast("int"))), 6).alias("final_recall"),
        F.count(F.when(F.col("foreign_policy"), 1)).alias("unauthorized"),
    )


@query("a27_status_audit", ctes("issues", ("an", """
SELECT source_id, cloud_id, title, status, priority, 'The status of ''' || title || ''' is ''' || CASE WHEN ord % 9 = 0 THEN 'Open' ELSE status END || '''' ||
  CASE WHEN ord % 4 = 0 THEN '.' ELSE ' with ' || lower(priority) || ' priority.' END AS answer FROM issues""")) + """
SELECT count(*) AS cases, sum(CAST(ok AS INT)) AS correct, round(avg(CAST(ok AS INT)), 6) AS accuracy, count(DISTINCT (cloud_id, source_id)) AS distinct_issues
FROM (SELECT *, answer IN ('The status of ''' || title || ''' is ''' || status || '''.',
  'The status of ''' || title || ''' is ''' || status || ''' with ' || lower(priority) || ' priority.') AS ok FROM an)""")
def a27_status_audit(t):
    base = F.concat(F.lit("The status of '"), "title", F.lit("' is '"))
    tail = F.concat(F.lit("' with "), F.lower("priority"), F.lit(" priority."))
    said = F.when(F.col("ord") % 9 == 0, "Open").otherwise(F.col("status"))
    answer = F.concat(base, said, F.when(F.col("ord") % 4 == 0, F.lit("'.")).otherwise(tail))
    ok = answer.isin(F.concat(base, "status", F.lit("'.")), F.concat(base, "status", tail))
    return t.issues().select("cloud_id", "source_id", ok.cast("int").alias("ok")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("ok").alias("correct"), F.round(F.avg("ok"), 6).alias("accuracy"),
        F.count_distinct(F.struct("cloud_id", "source_id")).alias("distinct_issues"),
    )


@query("j9_reviewed_reference_join", ctes(("rv", "SELECT doc_id, quality, doc_id % 31 = 0 AS bad_hash FROM labels WHERE doc_id % 2 = 0")) + """
SELECT CASE WHEN rv.doc_id IS NULL THEN 'UNREVIEWED' WHEN bad_hash THEN 'HASH_MISMATCH' ELSE 'REVIEWED' END AS reference_status, count(*) AS n,
  coalesce(sum(quality), 0) AS quality FROM documents LEFT JOIN rv USING (doc_id) GROUP BY 1""")
def j9_reviewed_reference_join(t):
    reviewed = t.read("labels").where("doc_id % 2 = 0")
    good = F.sha2("text", 256)
    docs = t.read("documents").select("doc_id", good.alias("question_sha256"))
    signed = reviewed.join(docs, "doc_id").select(
        "doc_id", "quality",
        F.when(F.col("doc_id") % 31 == 0, F.lit("stale")).otherwise(F.col("question_sha256")).alias("signed_sha256"),
    )
    status = (
        F.when(F.col("signed_sha256").isNull(), "UNREVIEWED")
        .when(F.col("signed_sha256") != F.col("question_sha256"), "HASH_MISMATCH").otherwise("REVIEWED")
    )
    return docs.join(signed, "doc_id", "left").groupBy(status.alias("reference_status")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("quality")
    )


@query("j14_review_binding", ctes(("rs", "SELECT conv_id, turn, sha256(text) AS h, text FROM conversations WHERE role = 'assistant'"), ("rw", """
SELECT conv_id, turn, CASE WHEN length(text) % 17 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h, length(text) % 6 <> 0 AS good FROM rs""")) + """
SELECT count(*) AS reviewed, count(*) FILTER (WHERE rs.h <> rw.h) AS changed, count(*) FILTER (WHERE rs.h = rw.h AND good) AS correct
FROM rs JOIN rw USING (conv_id, turn)""")
def j14_review_binding(t):
    rows = t.read("conversations").where("role = 'assistant'").select("conv_id", "turn", "text", F.sha2("text", 256).alias("h"))
    size = F.length("text")
    reviews = rows.select(
        "conv_id", "turn",
        F.when(size % 17 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("h")).alias("rh"),
        (size % 6 != 0).alias("good"),
    )
    return rows.join(reviews, ["conv_id", "turn"]).agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count(F.when(F.col("h") != F.col("rh"), 1)).alias("changed"),
        F.count(F.when((F.col("h") == F.col("rh")) & F.col("good"), 1)).alias("correct"),
    )


@query("u6_set_equality", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left,
  (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_right,
  NOT EXISTS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AND NOT EXISTS (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AS equal""")
def u6_set_equality(t):
    return audits.same_set(t.read("documents").select("doc_id"), t.read("labels").select("doc_id"))


@query("u5_missing_members", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u5_missing_members(t):
    return t.read("documents").select("doc_id").join(t.read("labels").select("doc_id"), "doc_id", "left_anti")


@query("a29_catalog_totals", """
SELECT category, coalesce(a, 0) AS actual, coalesce(d, 0) AS declared, a IS NOT DISTINCT FROM d AS agrees FROM
(SELECT p_brand AS category, count(*) AS a FROM part GROUP BY 1) FULL OUTER JOIN
(SELECT p_brand AS category, count(*) + CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END AS d FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1) USING (category)""")
def a29_catalog_totals(t):
    part = t.read("part")
    declared = part.where(F.col("p_brand") != "Brand#3").groupBy(F.col("p_brand").alias("category")).agg(
        (F.count(F.lit(1)) + F.when(F.first("p_brand") == "Brand#2", 1).otherwise(0)).alias("declared")
    )
    return audits.totals_check(part, "p_brand", declared)


# ---- sampling and sweeps --------------------------------------------------------

@query("w13_stratified_sample", ctes("chunks", ("n", """
SELECT chunk_id, source_type, language, row_number() OVER (PARTITION BY source_type, language ORDER BY ord) AS rn FROM chunks""")) + """
SELECT chunk_id, source_type, language, rn FROM n ORDER BY rn, source_type, language LIMIT 100""")
def w13_stratified_sample(t):
    return R.stratified_sample(t.chunks(), ["source_type", "language"], 100).select("chunk_id", "source_type", "language", "rn")


_SWEEP_T, _SWEEP_N = (0.0, 0.1, 0.2, 0.4), (8, 16, 25)


@query("w14_rerank_sweep", ctes("chunks", *DENSE_CTES, ("gr", "SELECT t.t AS threshold, n.n AS top_n FROM (SELECT unnest([0.0, 0.1, 0.2, 0.4]) AS t) t, (SELECT unnest([8, 16, 25]) AS n) n"), ("cp", """
SELECT CAST(threshold AS DOUBLE) AS threshold, top_n, query_id, den.chunk_id, score, row_number() OVER (PARTITION BY threshold, top_n, query_id, source_id ORDER BY score DESC, dense_rank) AS sr, dense_rank
FROM den JOIN chunks ON den.chunk_id = chunks.chunk_id, gr WHERE dense_rank <= 25 AND score >= threshold"""), ("rk", """
SELECT *, row_number() OVER (PARTITION BY threshold, top_n, query_id ORDER BY score DESC, dense_rank) AS rn FROM cp WHERE sr <= 6""")) + """
SELECT threshold, top_n, count(*) AS selected, count(DISTINCT query_id) AS queries, round(avg(score), 6) AS mean_score FROM rk WHERE rn <= top_n GROUP BY 1, 2""")
def w14_rerank_sweep(t):
    grid = F.array(*[F.struct(F.lit(a).alias("threshold"), F.lit(b).alias("top_n")) for a in _SWEEP_T for b in _SWEEP_N])
    scored = dense_top(t).where(F.col("dense_rank") <= 25).join(t.chunks().select("chunk_id", "source_id"), "chunk_id")
    cells = scored.withColumn("g", F.explode(grid)).select("*", "g.*").where(F.col("score") >= F.col("threshold"))
    order = [F.desc("score"), F.asc("dense_rank")]
    per_source = Window.partitionBy("threshold", "top_n", "query_id", "source_id").orderBy(*order)
    capped = cells.withColumn("sr", F.row_number().over(per_source)).where(F.col("sr") <= 6)
    kept = capped.withColumn("rn", F.row_number().over(Window.partitionBy("threshold", "top_n", "query_id").orderBy(*order)))
    return kept.where(F.col("rn") <= F.col("top_n")).groupBy("threshold", "top_n").agg(
        F.count(F.lit(1)).alias("selected"), F.count_distinct("query_id").alias("queries"), F.round(F.avg("score"), 6).alias("mean_score")
    )


@query("w19_duplicate_questions", """
SELECT count(*) AS groups, sum(n - 1) AS reused, max(n) AS largest FROM (SELECT sha256(text) AS q, count(*) AS n FROM documents GROUP BY 1)""")
def w19_duplicate_questions(t):
    # one measured answer per distinct question: a combined count, not a window over copies
    grouped = t.read("documents").groupBy(F.sha2("text", 256).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(
        F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("reused"), F.max("n").alias("largest")
    )


@query("c37_candidate_rehydration", ctes("chunks", *DENSE_CTES, ("n", "SELECT query_id, count(*) AS total FROM den GROUP BY 1")) + """
SELECT query_id, den.chunk_id, source_id, round((total - (dense_rank - 1)) / total, 9) AS retrieval_score, chunks.chunk_id IS NULL AS missing
FROM den JOIN n USING (query_id) LEFT JOIN chunks ON den.chunk_id = chunks.chunk_id""")
def c37_candidate_rehydration(t):
    recorded = dense_top(t).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dense_rank", "chunk_id"))), lambda e: e["chunk_id"]).alias("ids")
    )
    rows = recorded.select("query_id", F.size("ids").alias("total"), F.posexplode("ids").alias("pos", "chunk_id"))
    known = t.chunks().select("chunk_id", "source_id")
    return rows.join(known, "chunk_id", "left").select(
        "query_id", "chunk_id", "source_id",
        F.round((F.col("total") - F.col("pos")) / F.col("total"), 9).alias("retrieval_score"),
        F.col("source_id").isNull().alias("missing"),
    )


@query("c41_direction_coverage", ctes(("d", "SELECT CASE doc_id % 2 WHEN 0 THEN 'en' ELSE 'es' END AS ql, lang AS tl FROM documents"), ("r", """
SELECT * FROM (VALUES ('en', 'en'), ('es', 'es'), ('en', 'es'), ('es', 'en')) v(ql, tl)""")) + """
SELECT r.ql AS query_language, r.tl AS target_language, count(d.ql) AS cases, count(d.ql) = 0 AS missing FROM r LEFT JOIN d ON r.ql = d.ql AND r.tl = d.tl GROUP BY 1, 2""")
def c41_direction_coverage(t):
    seen = t.read("documents").select(
        F.when(F.col("doc_id") % 2 == 0, "en").otherwise("es").alias("query_language"), F.col("lang").alias("target_language")
    )
    counted = seen.groupBy("query_language", "target_language").agg(F.count(F.lit(1)).alias("cases"))
    required = reduce(
        lambda a, b: a.unionByName(b),
        [t.spark.range(1).select(F.lit(a).alias("query_language"), F.lit(b).alias("target_language")) for a, b in M.DIRECTIONS],
    )
    joined = required.join(counted, ["query_language", "target_language"], "left")
    return joined.select(
        "query_language", "target_language", F.coalesce("cases", F.lit(0)).alias("cases"), F.col("cases").isNull().alias("missing")
    )
