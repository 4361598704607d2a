"""Registered queries: evidence gates, answers, budgets and conversation history."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from evidquarry.functions import citations as C, markdown as MD, text as X
from evidquarry.operators import gates, ranking as R
from evidquarry.plans.registry import ctes, query
from evidquarry.plans.retrieval import FUSE_CTES, candidates, sql_tokens
from evidquarry.plans.text import _ANS, _PARTS, _SENTENCES, ANSWER, PART_MD, answers, exploded_lines

# ---- facts and conflicts --------------------------------------------------------

_FIELD = "CASE WHEN doc_category = 'narrative' THEN '' ELSE doc_category END"
_NORM = "CASE WHEN chunk_id % 2 = 0 THEN '' ELSE 'Value' || CAST(chunk_id % 4 AS STRING) END"
_SPACED = "trim(regexp_replace(page_content, '\\s+', ' ', 'g'))"
FACT_CTES = (
    "chunks",
    ("fc", f"""SELECT chunk_id, 'fact:' || substr(sha256(encode(source_id || chr(0) || source_version || chr(0) || chunk_id || chr(0) || v)), 1, 24) AS fact_id,
  coalesce(nullif(entity_key, ''), parent_id) AS entity, nullif(f, '') AS field_path, replace(lower(v), 'ß', 'ss') AS value, source_id, upper(source_type) AS source_category,
  authority, source_version, observed_at FROM (SELECT *, {_FIELD} AS f, coalesce(nullif({_NORM}, ''), {_SPACED}) AS v FROM chunks)"""),
)


def facts(t):
    chunks = t.chunks().withColumn("field_path", F.expr(_FIELD)).withColumn("normalized_value", F.expr(_NORM))
    return gates.evidence_facts(chunks)


@query("p4_evidence_facts", ctes(*FACT_CTES) + "SELECT chunk_id, fact_id, entity, coalesce(field_path, '') AS field_path, sha256(value) AS value_digest, source_category FROM fc")
def p4_evidence_facts(t):
    return facts(t).select(
        "chunk_id", "fact_id", "entity", F.coalesce("field_path", F.lit("")).alias("field_path"),
        F.sha2("value", 256).alias("value_digest"), "source_category",
    )


@query("p3_evidence_envelope", ctes("chunks") + """
SELECT chunk_id, source_id, source_type, coalesce(nullif(project_id, ''), 'ALPHA') AS project_id, title, reference, locator,
  coalesce(nullif(observed_at, ''), source_version) AS as_of FROM chunks""")
def p3_evidence_envelope(t):
    return t.chunks().select(
        "chunk_id", "source_id", "source_type", X.first_present(F.col("project_id"), F.lit("ALPHA")).alias("project_id"),
        "title", "reference", "locator", X.first_present(F.col("observed_at"), F.col("source_version")).alias("as_of"),
    )


@query("a35_conflicts", ctes(*FACT_CTES, ("rk", "SELECT *, rank() OVER (PARTITION BY source_id, field_path ORDER BY authority DESC) AS r FROM fc WHERE field_path IS NOT NULL")) + """
SELECT source_id AS entity, field_path, count(DISTINCT value) AS n_values, count(*) AS facts FROM rk WHERE r = 1 GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def a35_conflicts(t):
    # one version for all, so that facts tie at the newest one
    same = facts(t).withColumn("entity", F.col("source_id")).withColumn("source_version", F.lit("1")).withColumn("observed_at", F.lit(""))
    return gates.conflicts(same)


@query("p5_structured_fact_rows", ctes(*FACT_CTES) + """
SELECT entity, field_path, '| `' || entity || '` | `' || field_path || '` | ' || value || ' | [SOURCE ' || min(chunk_id) || '] |' AS row
FROM fc WHERE field_path IS NOT NULL GROUP BY entity, field_path, value""")
def p5_structured_fact_rows(t):
    return gates.structured_fact_rows(facts(t))


def _claims(t):
    lines = answers(t).select("conv_id", "turn", MD.classified_lines(F.col("answer")).alias("lines"))
    return lines.select("conv_id", "turn", F.posexplode(MD.material_claims(F.col("lines"))).alias("pos", "c")).select(
        "conv_id", "turn", "pos", F.col("c.text").alias("claim"), F.col("c.kind").alias("kind"), F.lit("en").alias("answer_language")
    )


def overlap_score(claim, evidence):
    """Stand-in scorer: share of distinct claim tokens found in the evidence."""
    asked = F.array_distinct(X.tokens(claim))
    return F.size(F.array_intersect(asked, X.tokens(evidence))) / F.greatest(F.size(asked), F.lit(1))


_EVI = ("ev", "SELECT conv_id, turn // 2 + 1 AS source, text AS page_content, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'de' END AS language FROM conversations WHERE role = 'user'")


@query("c10_claim_verification", ctes(_ANS, *_SENTENCES, _EVI, ("cm", f"""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) - 1 AS pos, trim(regexp_replace(s, '\\s*\\[SOURCE \\d+\\]', '', 'g')) AS plain,
  list_distinct(list_transform(regexp_extract_all(s, '\\[SOURCE (\\d+)\\]', 1), lambda n: CAST(n AS BIGINT))) AS cited FROM cl"""), ("pa", f"""
SELECT cm.conv_id, turn, pos, plain, string_agg(page_content, chr(10) ORDER BY source) AS proof, max(len(list_intersect(list_distinct({sql_tokens('plain')}), {sql_tokens('page_content')}))
  / greatest(1, len(list_distinct({sql_tokens('plain')})))) AS score, max(language) AS language FROM cm JOIN ev ON ev.conv_id = cm.conv_id AND list_contains(cited, ev.source)
  WHERE len(cited) > 0 AND list_max(cited) <= 4 GROUP BY 1, 2, 3, 4""")) + """
SELECT conv_id, turn, pos, 'MISSING_OR_INVALID_CITATION' AS reason, NULL AS score FROM cm WHERE len(cited) = 0 OR list_max(cited) > 4
UNION ALL SELECT conv_id, turn, pos, CASE
  WHEN regexp_matches(lower(plain), '(^|[^\\p{L}\\p{N}_])(no|not|never|none|without|zero|0|ni|nunca|sin|tampoco|cero)($|[^\\p{L}\\p{N}_])')
   AND NOT regexp_matches(lower(proof), '(^|[^\\p{L}\\p{N}_])(no|not|never|none|without|zero|0|ni|nunca|sin|tampoco|cero)($|[^\\p{L}\\p{N}_])') THEN 'NEGATION_UNSUPPORTED'
  WHEN score < CASE WHEN language = 'de' THEN 0.3 ELSE 0.5 END THEN 'SCORE_BELOW_THRESHOLD' ELSE 'SUPPORTED' END, round(score, 4) FROM pa""")
def c10_claim_verification(t):
    evidence = t.read("conversations").where("role = 'user'").select(
        "conv_id", (F.floor(F.col("turn") / 2) + 1).alias("source"), F.col("text").alias("page_content"),
        F.when(F.col("conv_id") % 2 == 0, "en").otherwise("de").alias("language"),
    )
    return gates.verified(_claims(t), evidence, 4, overlap_score, ["conv_id", "turn", "pos"])


@query("a37_case_evaluators", ctes(_ANS, ("x", """
SELECT *, list_distinct(list_transform(regexp_extract_all(answer, '\\[SOURCE (\\d+)\\]', 1), lambda n: CAST(n AS BIGINT))) AS m FROM an""")) + """
SELECT count(*) AS cases, sum(CAST(len(m) > 0 AND list_max(m) <= 4 AS INT)) AS citation_validity,
  sum(CAST(NOT regexp_matches(lower(answer), '[¿¡áéíóúñ]') AND NOT regexp_matches(lower(answer), '(^|[^a-záéíóúñüß])(el|la|los|las|que|para)($|[^a-záéíóúñüß])') AS INT)) AS requested_language,
  sum(CAST(trim(answer) <> '' AS INT)) AS response_completeness, round(sum(len(list_intersect(m, [1, 2])) / 2.0), 6) AS source_coverage,
  sum(CAST(length(answer) % 500 <= 250 AS INT)) AS latency_budget FROM x""")
def a37_case_evaluators(t):
    marks = C.mentioned(F.col("answer"))
    expected = F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))
    spanish = F.col("answer").rlike(r"(?iu)[¿¡áéíóúñ]") | F.col("answer").rlike(r"(?iu)(?U)\b(?:el|la|los|las|que|para)\b")
    valid = (F.size(marks) > 0) & F.forall(marks, lambda n: n.between(1, 4))

    def total(condition):
        return F.sum(condition.cast("int"))

    return answers(t).agg(
        F.count(F.lit(1)).alias("cases"),
        total(valid).alias("citation_validity"),
        total(~spanish).alias("requested_language"),
        total(F.trim("answer") != "").alias("response_completeness"),
        F.round(F.sum(F.size(F.array_intersect(marks, expected)) / F.size(expected)), 6).alias("source_coverage"),
        total(F.length("answer") % 500 <= 250).alias("latency_budget"),
    )


# ---- budgets and history --------------------------------------------------------

@query("w9_evidence_budget", ctes(*FUSE_CTES, ("b", "SELECT query_id, ord, greatest(1, CAST(ceil(octet_length(encode(page_content)) / 3.0) AS BIGINT)) AS cost FROM cand"), ("r", """
SELECT *, 6000 - coalesce(sum(cost + 90) OVER (PARTITION BY query_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM b""")) + """
SELECT query_id, ord AS rn, cost + 90 > remaining AS truncated, CASE WHEN cost + 90 > remaining THEN remaining - 90 ELSE cost END AS granted FROM r WHERE remaining > 90""")
def w9_evidence_budget(t):
    blocks = candidates(t).select("query_id", "ord", X.estimated_tokens(F.col("page_content")).alias("cost"))
    return gates.greedy_budget(blocks, "query_id", "ord", "cost", 90, 6000).select(
        "query_id", F.col("ord").alias("rn"), "truncated", "granted"
    )


@query("w10_bounded_history", ctes(("c", "SELECT *, greatest(1, CAST(ceil(octet_length(encode(text)) / 3.0) AS BIGINT)) AS cost FROM conversations"), ("r", """
SELECT *, 400 - coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM c""")) + """
SELECT conv_id, turn, role, CASE WHEN cost <= remaining THEN text ELSE substr(text, 1, CAST(remaining * 3 AS INT)) END AS kept FROM r WHERE remaining > 0""")
def w10_bounded_history(t):
    return gates.bounded_history(t.read("conversations"), 400).select("conv_id", "turn", "role", "kept")


_DELTA_END = """cur + CASE WHEN length(answer) - cur <= 32 THEN length(answer) - cur
  ELSE 32 + coalesce(nullif(length(regexp_extract(substr(answer, cur + 33), '^[^ \\n]*[ \\n]')), 0), 0) END"""


@query("x24_answer_deltas", ctes(_ANS, ("d", f"""
SELECT conv_id, turn, answer, 0 AS pos, 0 AS cur, {_DELTA_END.replace('cur', '0')} AS nxt FROM an WHERE answer <> ''
UNION ALL SELECT conv_id, turn, answer, pos + 1, nxt, {_DELTA_END.replace('cur', 'nxt')} FROM d WHERE nxt < length(answer)""")).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT conv_id, turn, pos, substr(answer, cur + 1, nxt - cur) AS delta FROM d""")
def x24_answer_deltas(t):
    """Readable stream pieces of 32 characters and the rest of the word; a tail without a break is cut at 32."""
    piece = F.regexp_extract_all("answer", F.lit(r"(?s).{32}[^ \n]*[ \n]|.{1,32}"), 0)
    return answers(t).select("conv_id", "turn", F.posexplode(piece).alias("pos", "delta"))


# ---- populations and tables -----------------------------------------------------

@query("a32_label_idf", ctes("chunks", ("l", "SELECT unnest(['the', 'que', 'und', 'zzz']) AS label"), ("n", """
SELECT label, count(*) FILTER (WHERE contains(lower(page_content || ' ' || title), label)) AS df, count(*) AS n FROM l, chunks GROUP BY 1""")) + """
SELECT label, df, CASE WHEN df = 0 THEN 0.0 ELSE round(ln(n / df), 6) END AS weight FROM n""")
def a32_label_idf(t):
    labels = ("the", "que", "und", "zzz")
    text = F.lower(F.concat_ws(" ", "page_content", "title"))
    counts = t.chunks().agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(text.contains(w), 1)).alias(w) for w in labels])
    rows = F.array(*[F.struct(F.lit(w).alias("label"), F.col(w).alias("df")) for w in labels])
    return counts.select("n", F.explode(rows).alias("r")).select(
        "r.label", "r.df", F.when(F.col("r.df") == 0, 0.0).otherwise(F.round(F.log(F.col("n") / F.col("r.df")), 6)).alias("weight")
    )


@query("j15_member_rows", """
SELECT label, min(p_partkey) AS source, count(*) AS n FROM (SELECT p_partkey, 'brand' AS label FROM part UNION ALL SELECT p_partkey, 'size' FROM part) GROUP BY 1""")
def j15_member_rows(t):
    rows = exploded_lines(t).where(F.col("kind") == "TABLE_ROW").withColumn("label", MD.member_label(F.col("line")))
    wanted = t.spark.range(1).select(F.explode(F.array(F.lit("brand"), F.lit("size"), F.lit("colour"))).alias("label"))
    return rows.join(wanted, "label").groupBy("label").agg(F.min("p_partkey").alias("source"), F.count(F.lit(1)).alias("n"))


@query("c19_single_record_table", """
SELECT p_partkey, unnest(['Field', 'Value', 'Note']) AS attribute, unnest(['size', CAST(p_size AS VARCHAR), 'big']) AS value FROM part""")
def c19_single_record_table(t):
    row = exploded_lines(t).where((F.col("kind") == "TABLE_ROW") & F.col("line").contains("| size |"))
    paired = F.arrays_zip(MD.cells(F.col("header")).alias("attribute"), MD.cells(F.col("line")).alias("value"))
    return row.select("p_partkey", F.inline(paired))


@query("c33_strip_source_column", """
SELECT p_partkey, '| Field | Value |' || chr(10) || '|---|---|' || chr(10) || '| size | ' || p_size || ' |' AS visible FROM part""")
def c33_strip_source_column(t):
    table = F.concat(F.lit("| Field | Value | Source |\n|---|---|---|\n| size | "), F.col("p_size").cast("string"), F.lit(" | [SOURCE 1] |"))
    lines = F.split(table, "\n")

    def drop_last(line):
        parts = MD.cells(line)
        kept = F.slice(parts, 1, F.size(parts) - 1)
        rule = F.concat(F.lit("|"), F.array_join(kept, "|"), F.lit("|"))
        shown = F.concat(F.lit("| "), F.array_join(kept, " | "), F.lit(" |"))
        return F.when(line.rlike(MD.SEPARATOR), rule).otherwise(shown)

    source_last = F.lower(F.element_at(MD.cells(F.element_at(lines, 1)), -1)) == "source"
    visible = F.when(source_last, F.array_join(F.transform(lines, drop_last), "\n")).otherwise(table)
    return t.read("part").select("p_partkey", visible.alias("visible"))


@query("c29_highest_rerank_score", ctes(("x", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE (length(text) % 100) / 100.0 END AS s FROM conversations")) + """
SELECT conv_id, coalesce(CAST(max(s) AS DOUBLE), 0) AS highest, array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE s IS NULL) > 0 THEN 'LEXICAL_RETRIEVAL_FALLBACK' END,
  CASE WHEN conv_id % 2 = 0 THEN 'GROUNDING_REPAIR' END], lambda r: r IS NOT NULL), '|') AS reasons FROM x GROUP BY 1""")
def c29_highest_rerank_score(t):
    rows = t.read("conversations").select("conv_id", F.when(F.col("turn") % 3 != 0, (F.length("text") % 100) / 100).alias("s"))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max("s"), F.lit(0.0)).alias("highest"), F.count(F.when(F.col("s").isNull(), 1)).alias("_missing")
    ).select(
        "conv_id", "highest",
        F.array_join(F.array_compact(F.array(
            F.when(F.col("_missing") > 0, "LEXICAL_RETRIEVAL_FALLBACK"), F.when(F.col("conv_id") % 2 == 0, "GROUNDING_REPAIR")
        )), "|").alias("reasons"),
    )


@query("c23_route_quote", ctes("chunks", ("sg", """
SELECT chunk_id, source_id, unnest(string_split(regexp_replace(regexp_replace(page_content, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))) AS s FROM chunks WHERE doc_category = 'registry-table'"""), ("sc", """
SELECT source_id, chunk_id, trim(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' -*') AS seg FROM sg"""), ("st", """
SELECT *, CAST(contains(replace(lower(seg), 'ß', 'ss'), 'tion') AS INT) + CAST(contains(replace(lower(seg), 'ß', 'ss'), 'the') AS INT) AS score FROM sc WHERE len(regexp_extract_all(seg, '[\\p{L}\\p{N}_]+')) >= 4""")) + """
SELECT source_id, arg_max(seg, {'s': score, 'c': -chunk_id, 't': encode(seg)}) AS quote, max(score) AS score FROM st WHERE score > 0 GROUP BY 1""")
def c23_route_quote(t):
    rows = t.chunks().where(F.col("doc_category") == "registry-table")
    parts = rows.select("source_id", "chunk_id", F.explode(F.split("page_content", r"(?<=[.!?])\s+|\n+")).alias("s"))
    seg = F.regexp_replace(X.collapse_spaces(F.col("s")), r"^[ \-*]+|[ \-*]+$", "")
    folded = X.casefold(F.col("seg"))
    scored = parts.select("source_id", "chunk_id", seg.alias("seg")).where(
        F.regexp_count("seg", F.lit(r"(?U)\w+")) >= 4
    ).withColumn("score", folded.contains("tion").cast("int") + folded.contains("the").cast("int"))
    best = F.struct(F.col("score"), (-F.col("chunk_id")).alias("c"), F.col("seg").alias("t"))
    return scored.where(F.col("score") > 0).groupBy("source_id").agg(
        F.max_by("seg", best).alias("quote"), F.max("score").alias("score")
    )


@query("c42_expected_terms", f"""
WITH q AS (SELECT conv_id, turn + 1 AS turn, list_distinct({sql_tokens('text')}) AS ts FROM conversations WHERE role = 'user' AND text IS NOT NULL),
a AS (SELECT conv_id, turn, lower(text) AS said FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT conv_id, turn, len(ts) AS expected, len(list_filter(ts, lambda w: contains(said, w))) AS present FROM a JOIN q USING (conv_id, turn)""")
def c42_expected_terms(t):
    """How many of a question's terms its answer shows, numbers in any writing."""
    from evidquarry.functions.anchors import NUMBER, canonical_number

    turns = t.read("conversations").where("text IS NOT NULL")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.array_distinct(X.tokens(F.col("text"))).alias("terms"))
    said = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).withColumn("shown", F.lower("text")).withColumn(
        "numbers", F.transform(F.regexp_extract_all("text", F.lit(NUMBER), 0), canonical_number))
    found = F.filter("terms", lambda w: F.col("shown").contains(w) | F.array_contains("numbers", canonical_number(w)))
    return said.select("conv_id", "turn", F.size("terms").alias("expected"), F.size(found).alias("present"))


# Lines of an overview that only report measurements.
_COUNTED = r"\b(?:source\s+files?|nonblank\s+(?:kotlin\s+)?lines?|declared\s+symbols?|symbols?|tests?\s+(?:discovered|found))\b"
_METRICS = (
    r"\b\d[\d,.]*\b.*" + _COUNTED,
    _COUNTED + r".*\b\d[\d,.]*\b",
    r"\b(?:lifecycle\s+status|maturity\s+signal|observed\s+implementation\s+footprint)\b",
    r"\|.*\b\d[\d,.]*\b",
    r":\s*\d[\d,.]*\s*$",
)
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_PART_SIGNALS = ("pv", """SELECT p_partkey, md || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'Lifecycle status: stable' WHEN 1
  THEN 'Symbols: v' || p_size || ' of x1' ELSE 'Tests found in rev. 2.x' END AS md FROM pm JOIN part USING (p_partkey)""")


@query("f14_overview_metric_lines", ctes(_PARTS, _PART_SIGNALS) + f"""
SELECT p_partkey, coalesce(nullif(trim(array_to_string(list_filter(string_split(md, chr(10)),
  lambda l: NOT regexp_matches(l, '{"|".join(_METRICS)}|(^|[^\\w.])\\d+([.,]\\d+)*([^\\w.]|$)', 'i')), chr(10)), ' ' || chr(10)), ''), md) AS overview FROM pv""".replace("\\\\", "\\"))
def f14_overview_metric_lines(t):
    """Lines that carry measurements leave an overview unless nothing would be left."""
    metric = "(?i)(?U)" + "|".join((*_METRICS, r"(?<![\w.])\d+(?:[.,]\d+)*(?![\w.])"))
    lines = F.filter(F.split("md", _LINE_ENDS), lambda l: ~l.rlike(metric))
    kept = F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")
    signal = F.when(F.col("p_partkey") % 3 == 0, "Lifecycle status: stable").when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit("Symbols: v"), F.col("p_size").cast("string"), F.lit(" of x1"))
    ).otherwise("Tests found in rev. 2.x")
    parts = t.read("part").selectExpr("p_partkey", "p_size", f"{PART_MD} AS md").withColumn("md", F.concat("md", F.lit("\n"), signal))
    return parts.select("p_partkey", F.coalesce(F.nullif(kept, F.lit("")), F.col("md")).alias("overview"))


@query("f13_low_information", ctes("chunks", ("w", f"SELECT doc_category, authority, {sql_tokens('page_content')} AS ws FROM chunks")) + """
SELECT doc_category, count(*) AS n, count(*) FILTER (WHERE len(ws) < 20 OR len(list_distinct(ws)) < 0.5 * len(ws) OR authority <= 0) AS dropped FROM w GROUP BY 1""")
def f13_low_information(t):
    """Chunks of few or repeating words, or without authority, carry too little to be kept."""
    words = X.tokens(F.col("page_content"))
    rows = t.chunks().select("doc_category", "authority", words.alias("ws"))
    low = (F.size("ws") < 20) | (F.size(F.array_distinct("ws")) < 0.5 * F.size("ws")) | (F.col("authority") <= 0)
    return rows.groupBy("doc_category").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(low, 1)).alias("dropped"))


@query("f16_entity_scope", ctes(*FUSE_CTES, ("w", "SELECT *, 'app' || query_id % 3 AS wanted FROM cand")) + """
SELECT query_id, CASE WHEN entity = '' THEN 'KEPT_UNSCOPED' WHEN entity = wanted THEN 'KEPT_ENTITY' ELSE 'OTHER_ENTITY' END AS decision, count(*) AS n FROM w GROUP BY 1, 2""")
def f16_entity_scope(t):
    wanted = F.concat(F.lit("app"), (F.col("query_id") % 3).cast("string"))
    decision = F.when(F.col("entity") == "", "KEPT_UNSCOPED").when(F.col("entity") == wanted, "KEPT_ENTITY").otherwise("OTHER_ENTITY")
    return candidates(t).groupBy("query_id", decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("f17_feature_inventory", ctes("chunks") + """
SELECT entity, array_to_string(regexp_extract_all(replace(strip_accents(lower(title)), 'ß', 'ss'), '[a-z0-9]+'), ' ') AS title_key,
  min(ord) AS first_ord FROM chunks WHERE entity <> '' AND doc_category = 'entity-contract' GROUP BY 1, 2""")
def f17_feature_inventory(t):
    rows = t.chunks().where((F.col("entity") != "") & (F.col("doc_category") == "entity-contract"))
    key = F.array_join(X.normalized_words(F.col("title")), " ")
    return rows.groupBy("entity", key.alias("title_key")).agg(F.min("ord").alias("first_ord"))


@query("w17_requirement_pinning", ctes(*FUSE_CTES, ("rq", "SELECT unnest(['PAGE', 'CODE', 'ISSUE']) AS need"), ("pin", """
SELECT query_id, chunk_id, 0 AS c, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY ord) AS r FROM cand WHERE source_type IN (SELECT need FROM rq)) WHERE r = 1"""), ("al", """
SELECT query_id, chunk_id, min({'c': c, 'o': ord}) AS p FROM (SELECT * FROM pin UNION ALL SELECT query_id, chunk_id, 1, ord FROM cand) GROUP BY 1, 2""")) + """
SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rn FROM al) WHERE rn <= 8""")
def w17_requirement_pinning(t):
    pool = candidates(t)
    nth = F.row_number().over(Window.partitionBy("query_id", "source_type").orderBy("ord"))
    pinned = (nth == 1) & F.col("source_type").isin("PAGE", "CODE", "ISSUE")
    placed = pool.withColumn("_c", F.when(pinned, 0).otherwise(1))
    return R.rank_by(placed, "rn", F.asc("_c"), F.asc("ord")).where(F.col("rn") <= 8).select("query_id", "chunk_id", "rn")


@query("c7_cross_language_flags", ctes(*FUSE_CTES) + """
SELECT language, count(*) FILTER (WHERE language <> ql) AS cross_language, count(*) AS n FROM (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'en' ELSE 'es' END AS ql FROM cand) GROUP BY 1""")
def c7_cross_language_flags(t):
    asked = F.when(F.col("query_id") % 2 == 0, "en").otherwise("es")
    known = ~F.col("language").isin("", "und")
    return candidates(t).groupBy("language").agg(
        F.count(F.when(known & (F.col("language") != asked), 1)).alias("cross_language"), F.count(F.lit(1)).alias("n")
    )
