"""Registered queries: text, table, citation, anchor, language and JSON functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from evidquarry.functions import anchors as A, citations as C, jsontext as J, language as L, markdown as MD, text as X
from evidquarry.operators import lexical
from evidquarry.plans.registry import ctes, query
from evidquarry.plans.retrieval import sql_tokens

NL = "chr(10)"
# Markdown derived from each part row: heading, prose, table, sometimes a fence, a list
# item and a closing paragraph.
PART_MD = f"""('# ' || p_name || {NL} || 'Intro for ' || p_brand || ' parts today.' || {NL} || '| Field | Value | Note |' || {NL}
 || '|---|---|---|' || {NL} || '| brand | ' || p_brand || ' | - |' || {NL} || '| size | ' || CAST(p_size AS STRING) || ' | big |' || {NL}
 || CASE WHEN p_partkey % 3 = 0 THEN '```' || {NL} || 'code | x | y' || {NL} || '- not an item' || {NL} || '```' || {NL} ELSE '' END
 || CASE WHEN p_partkey % 4 = 0 THEN 'a | b | c' || {NL} || 'd | ' || p_type || ' | f' || {NL} ELSE '' END
 || '- type ' || p_type || ' [SOURCE ' || CAST(p_partkey % 4 + 1 AS STRING) || ']' || {NL}
 || 'The part ' || p_name || ' costs more today [SOURCE 1]. Short one. It is a very plain part.')"""
ANSWER = "replace(text, '. ', ' [SOURCE ' || CAST(turn % 5 + 1 AS STRING) || ']. ')"


def parts_md(t):
    return t.read("part").selectExpr("p_partkey", f"{PART_MD} AS md")


def answers(t):
    return t.read("conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", f"{ANSWER} AS answer")


_PARTS = ("pm", f"SELECT p_partkey, {PART_MD} AS md FROM part")
_ANS = ("an", f"SELECT conv_id, turn, {ANSWER} AS answer FROM conversations WHERE role = 'assistant'")
_SEP_SQL = "regexp_full_match(line, '\\s*\\|?[\\s:|-]*-{2,}[\\s:|-]*\\|?\\s*')"
_LINES = (
    ("ln", "SELECT p_partkey, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM pm"),
    ("l1", f"SELECT *, starts_with(line, '```') AS fm, {_SEP_SQL} AS sp FROM ln"),
    ("l2", "SELECT *, fm OR sum(CAST(fm AS INT)) OVER (PARTITION BY p_partkey ORDER BY i) % 2 = 1 AS code FROM l1"),
    ("l3", "SELECT *, NOT code AND NOT sp AND contains(line, '|') AS pipe FROM l2"),
    ("l4", "SELECT *, pipe AND coalesce(lead(sp AND NOT code) OVER (PARTITION BY p_partkey ORDER BY i), false) AS hd, "
     "max(CASE WHEN NOT pipe THEN i END) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS brk FROM l3"),
    ("l5", "SELECT a.*, b.sp AND c.pipe AS body, c.line AS hline FROM l4 a LEFT JOIN l3 b ON a.p_partkey = b.p_partkey AND b.i = a.brk "
     "LEFT JOIN l3 c ON a.p_partkey = c.p_partkey AND c.i = a.brk - 1"),
    ("kd", "SELECT p_partkey, i, line, CASE WHEN code THEN 'CODE' WHEN hd THEN 'TABLE_HEADER' WHEN sp THEN 'TABLE_SEPARATOR' "
     "WHEN pipe AND coalesce(body, false) THEN 'TABLE_ROW' WHEN regexp_matches(line, '^#{1,6}\\s') THEN 'HEADING' "
     "WHEN regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s') THEN 'LIST_ITEM' ELSE 'PROSE' END AS kind, "
     "CASE WHEN pipe AND NOT hd AND coalesce(body, false) THEN hline ELSE '' END AS header FROM l5"),
)


def exploded_lines(t):
    return parts_md(t).select("p_partkey", F.posexplode(MD.classified_lines(F.col("md"))).alias("pos", "l")).select(
        "p_partkey", (F.col("pos") + 1).alias("i"), F.col("l.text").alias("line"), "l.kind", "l.header"
    )


@query("x33_line_kinds", ctes(_PARTS, *_LINES) + "SELECT p_partkey, i, line, kind, header FROM kd")
def x33_line_kinds(t):
    return exploded_lines(t)


@query("a36_answer_shape", ctes(_PARTS, *_LINES) + """
SELECT kind, count(*) AS n, count(DISTINCT p_partkey) AS texts FROM kd GROUP BY 1""")
def a36_answer_shape(t):
    return exploded_lines(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_partkey").alias("texts"))


@query("x30_table_dialect", ctes(_PARTS) + f"""
SELECT p_partkey, replace(md, 'a | b | c' || {NL} || 'd | ' || p_type || ' | f' || {NL}, '| a | b | c |' || {NL} || '| --- | --- | --- |' || {NL}
  || '| d | ' || p_type || ' | f |' || {NL}) AS canonical FROM pm JOIN part USING (p_partkey)
WHERE p_partkey % 4 <> 0 OR p_partkey % 3 = 0
UNION ALL SELECT p_partkey, md FROM pm WHERE p_partkey % 4 = 0 AND p_partkey % 3 <> 0""")
def x30_table_dialect(t):
    return parts_md(t).select("p_partkey", MD.normalize_table_dialect(F.col("md")).alias("canonical"))


@query("x31_linearize_tables", f"""
SELECT p_partkey, '# ' || p_name || {NL} || 'Intro for ' || p_brand || ' parts today.' || {NL} || 'brand — Value: ' || p_brand || '.' || {NL}
 || 'size — Value: ' || p_size || '; Note: big.' || {NL}
 || CASE WHEN p_partkey % 3 = 0 THEN '```' || {NL} || 'code | x | y' || {NL} || '- not an item' || {NL} || '```' || {NL} ELSE '' END
 || CASE WHEN p_partkey % 4 = 0 THEN 'a | b | c' || {NL} || 'd | ' || p_type || ' | f' || {NL} ELSE '' END
 || '- type ' || p_type || ' [SOURCE ' || (p_partkey % 4 + 1) || ']' || {NL}
 || 'The part ' || p_name || ' costs more today [SOURCE 1]. Short one. It is a very plain part.' AS linear, true AS has_table FROM part""")
def x31_linearize_tables(t):
    return parts_md(t).select(
        "p_partkey", MD.linearize_tables(F.col("md")).alias("linear"), MD.contains_table(F.col("md")).alias("has_table")
    )


@query("x32_linearize_row", ctes(_PARTS, *_LINES, ("rw", """
SELECT p_partkey, i, list_transform(string_split(trim(header, '|'), '|'), lambda c: trim(c)) AS h,
  list_transform(string_split(trim(line, '|'), '|'), lambda c: trim(c)) AS v FROM kd WHERE kind = 'TABLE_ROW'""")) + """
SELECT p_partkey, i, v[1] || ' — ' || array_to_string(list_filter([CASE WHEN v[2] NOT IN ('', '-') THEN h[2] || ': ' || v[2] END,
  CASE WHEN v[3] NOT IN ('', '-') THEN h[3] || ': ' || v[3] END], lambda x: x IS NOT NULL), '; ') || '.' AS sentence FROM rw""")
def x32_linearize_row(t):
    rows = exploded_lines(t).where(F.col("kind") == "TABLE_ROW")
    return rows.select("p_partkey", "i", MD.linearized_row(F.col("header"), F.col("line")).alias("sentence"))


@query("x20_member_labels", ctes(_PARTS, *_LINES) + """
SELECT p_partkey, i, CASE WHEN kind = 'LIST_ITEM' THEN '' ELSE trim(string_split(trim(line, '|'), '|')[1]) END AS label,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(trim(line), '|'), '^\\s*-\\s+', ''), '|'), lambda c: trim(trim(c), '`*_ ')), lambda c: c <> ''), ' — ') AS row_text
FROM kd WHERE kind IN ('TABLE_ROW', 'LIST_ITEM')""")
def x20_member_labels(t):
    rows = exploded_lines(t).where(F.col("kind").isin("TABLE_ROW", "LIST_ITEM"))
    return rows.select(
        "p_partkey", "i", MD.member_label(F.col("line")).alias("label"), MD.row_text(F.col("line")).alias("row_text")
    )


_SENTENCES = (
    ("sl", "SELECT conv_id, turn, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM an"),
    ("se", "SELECT conv_id, turn, i, unnest(string_split(regexp_replace(trim(line), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, "
     "generate_subscripts(string_split(regexp_replace(trim(line), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS j FROM sl"),
    ("cl", "SELECT * FROM se WHERE len(regexp_extract_all(s, '[\\p{L}\\p{N}_]+')) >= 4"),
)


def answer_claims(t):
    lines = MD.classified_lines(F.col("answer"))
    return answers(t).select("conv_id", "turn", "answer", lines.alias("lines"))


@query("x34_material_claims", ctes(_ANS, *_SENTENCES) + """
SELECT conv_id, turn, s AS claim, contains(s, '[SOURCE ') AS cited FROM cl""")
def x34_material_claims(t):
    return answer_claims(t).select("conv_id", "turn", F.explode(MD.material_claims(F.col("lines"))).alias("c")).select(
        "conv_id", "turn", F.col("c.text").alias("claim"), F.col("c.text").rlike(C.MARKER).alias("cited")
    )


@query("x35_drop_uncited_claims", ctes(_ANS, *_SENTENCES, ("bad", """
SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS k FROM cl WHERE NOT contains(s, '[SOURCE ')"""), ("kp", """
SELECT se.conv_id, se.turn, i, j, s FROM se LEFT JOIN bad ON se.conv_id = bad.conv_id AND se.turn = bad.turn
  AND lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) = k WHERE k IS NULL AND s <> ''"""), ("li", """
SELECT sl.conv_id, sl.turn, sl.i, coalesce(string_agg(s, ' ' ORDER BY j), '') AS line FROM sl LEFT JOIN kp USING (conv_id, turn, i) GROUP BY 1, 2, 3""")) + """
SELECT conv_id, turn, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS pruned FROM li GROUP BY 1, 2""")
def x35_drop_uncited_claims(t):
    return answer_claims(t).select(
        "conv_id", "turn", MD.pruned(F.col("lines"), C.uncited_keys(F.col("lines"))).alias("pruned")
    )


_MENTION = "list_distinct(list_transform(regexp_extract_all(answer, '\\[SOURCE (\\d+)\\]', 1), lambda n: CAST(n AS BIGINT)))"


@query("x36_citation_failures", ctes(_ANS, *_SENTENCES, ("un", "SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (WHERE NOT contains(s, '[SOURCE ')) AS bare FROM cl GROUP BY 1, 2")) + f"""
SELECT conv_id, turn, CASE WHEN len({_MENTION}) = 0 THEN 'NO_MARKERS' WHEN list_max({_MENTION}) > 4 THEN 'OUT_OF_RANGE'
  WHEN turn % 3 = 0 THEN 'MISMATCH' WHEN coalesce(claims, 0) = 0 OR bare > 0 THEN 'UNCITED_SENTENCE' ELSE 'VALID' END AS verdict
FROM an LEFT JOIN un USING (conv_id, turn)""")
def x36_citation_failures(t):
    marks = C.mentioned(F.col("answer"))
    declared = F.when(F.col("turn") % 3 == 0, F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).otherwise(marks)
    verdict = C.failure_reason(F.col("answer"), declared, F.lit(4), F.col("lines"))
    return answer_claims(t).select("conv_id", "turn", F.coalesce(verdict, F.lit("VALID")).alias("verdict"))


@query("x36_normalized_citations", ctes(_ANS) + """
SELECT conv_id, turn, regexp_replace(replace(answer, '.', '. [SOURCE 7]'), '([.!?])\\s*((\\[SOURCE \\d+\\]\\s*)*\\[SOURCE \\d+\\])\\s*', ' \\2\\1', 'g') AS normalized,
  trim(regexp_replace(regexp_replace(regexp_replace(answer, '\\s*\\[SOURCE\\s+\\d+\\]', '', 'g'), '[ \\t]+([.,;:!?])', '\\1', 'g'), '[,;:]+([.!?])', '\\1', 'g'), ' ' || chr(10)) AS visible FROM an""")
def x36_normalized_citations(t):
    moved = F.replace("answer", F.lit("."), F.lit(". [SOURCE 7]"))
    return answers(t).select(
        "conv_id", "turn", C.normalized(moved).alias("normalized"), C.without_markers(F.col("answer")).alias("visible")
    )


# ---- tokens, words, identifiers -------------------------------------------------

@query("x1_tokens", f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens, len({sql_tokens('text')}) AS n FROM documents")
def x1_tokens(t):
    found = X.tokens(F.col("text"))
    return t.read("documents").select("doc_id", F.array_join(found, " ").alias("tokens"), F.size(found).alias("n"))


_CAMEL = "('poS' || replace(p_name, ' ', 'HTTPServer') || '_' || upper(p_type) || '.v' || CAST(p_size AS STRING) || ' ' || p_brand)"


@query("x2_subtokens", f"SELECT p_partkey, array_to_string({sql_tokens(_CAMEL)}, ' ') AS tokens FROM part")
def x2_subtokens(t):
    return t.read("part").selectExpr("p_partkey", f"{_CAMEL} AS v").select(
        "p_partkey", F.array_join(X.tokens(F.col("v")), " ").alias("tokens")
    )


_FOLD = "replace(strip_accents(lower({})), 'ß', 'ss')"


@query("x3_normalized_words", f"""
SELECT doc_id, array_to_string(regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]+'), ' ') AS words FROM documents""")
def x3_normalized_words(t):
    return t.read("documents").select("doc_id", F.array_join(X.normalized_words(F.col("text")), " ").alias("words"))


@query("x4_accent_fold", f"SELECT doc_id, sha256({_FOLD.format('text')}) AS digest FROM documents")
def x4_accent_fold(t):
    return t.read("documents").select("doc_id", F.sha2(X.fold_accents(F.col("text")), 256).alias("digest"))


_RAW = "CASE p_partkey % 4 WHEN 0 THEN '[\"' || p_brand || '\", \" ' || p_type || '\"]' WHEN 1 THEN p_brand || ', ' || p_type || ',' WHEN 2 THEN '' ELSE p_name END"


@query("x5_list_values", f"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_brand || '|' || p_type WHEN 2 THEN '' ELSE p_name END AS vals,
  CASE p_partkey % 4 WHEN 0 THEN p_brand || '| ' || p_type WHEN 2 THEN '' ELSE {_RAW} END AS fields FROM part""")
def x5_list_values(t):
    raw = t.read("part").selectExpr("p_partkey", f"{_RAW} AS v")
    return raw.select(
        "p_partkey", F.array_join(X.parse_values(F.col("v")), "|").alias("vals"), F.array_join(X.list_field(F.col("v")), "|").alias("fields")
    )


@query("x6_normalized_values", """
SELECT p_partkey, lower(p_brand) || CASE WHEN lower(p_type) <> lower(p_brand) THEN '|' || lower(p_type) ELSE '' END AS vals,
  '.' || lower(p_type) || '|.kt' AS exts FROM part""")
def x6_normalized_values(t):
    items = F.array(F.concat(F.lit(" "), "p_brand"), F.upper("p_brand"), F.col("p_type"), F.lit(""))
    exts = F.array(F.col("p_type"), F.lit(".kt"), F.lit("KT"))
    return t.read("part").select(
        "p_partkey", F.array_join(X.normalized_values(items), "|").alias("vals"), F.array_join(X.extensions(exts), "|").alias("exts")
    )


_IDS = "('See ' || upper(replace(p_name, ' ', '_')) || ' and API_' || upper(p_type) || ' v1.' || CAST(p_size AS STRING) || ' or `' || p_brand || '` in ' || upper(replace(p_name, ' ', '_')) || ' PLAIN')"


@query("x7_member_identifiers", """
SELECT p_partkey, upper(replace(p_name, ' ', '_')) || '|API_' || upper(p_type) AS members,
  'v1.' || p_size || '|' || p_brand AS forced FROM part WHERE contains(p_name, ' ')
UNION ALL SELECT p_partkey, 'API_' || upper(p_type), 'v1.' || p_size || '|' || p_brand FROM part WHERE NOT contains(p_name, ' ')""")
def x7_member_identifiers(t):
    return t.read("part").selectExpr("p_partkey", f"{_IDS} AS v").select(
        "p_partkey", F.array_join(X.member_identifiers(F.col("v")), "|").alias("members"),
        F.array_join(X.forced_anchor_tokens(F.col("v")), "|").alias("forced"),
    )


@query("x8_exact_identifier_tokens", """
SELECT p_partkey, (CASE WHEN contains(p_name, ' ') THEN upper(replace(p_name, ' ', '_')) || '|' ELSE '' END) || 'API_' || upper(p_type) || '|v1.' || p_size || '|' || p_brand AS ids FROM part""")
def x8_exact_identifier_tokens(t):
    return t.read("part").selectExpr("p_partkey", f"{_IDS} AS v").select(
        "p_partkey", F.array_join(X.exact_identifier_tokens(F.col("v")), "|").alias("ids")
    )


@query("x9_exact_term_ratio", """
SELECT doc_id, round(len(list_filter(ts, lambda x: contains(lower(text), x))) / len(ts), 6) AS ratio FROM
(SELECT doc_id, text, list_distinct(['a1-2', 'the', source] || CASE WHEN doc_id % 2 = 0 THEN ['kt.x'] ELSE [] END) AS ts FROM documents)""")
def x9_exact_term_ratio(t):
    asked = F.concat_ws(" ", F.lit("Where is A1-2 or"), F.col("source"), F.lit("'the'"))
    asked = F.when(F.col("doc_id") % 2 == 0, F.concat(asked, F.lit(" kt.x"))).otherwise(asked)
    terms = X.exact_terms(asked)
    return t.read("documents").select("doc_id", F.round(X.exact_term_ratio(terms, F.col("text")), 6).alias("ratio"))


@query("x17_anchor_score", """
SELECT chunk_id, CAST((length(page_content) - length(replace(upper(page_content), upper(language), ''))) / length(language) AS DOUBLE) +
  CASE WHEN language = 'en' THEN 120 ELSE 0 END AS score FROM (SELECT doc_id AS chunk_id, text AS page_content, lang AS language FROM documents)""")
def x17_anchor_score(t):
    from evidquarry.operators.scans import anchor_score

    rows = t.read("documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("page_content"), F.lit("").alias("title"), "lang",
        F.when(F.col("lang") == "en", "Guide / EN").otherwise("Guide").alias("structure_path"),
    )
    return rows.select("chunk_id", anchor_score(F.col("lang")).alias("score"))


@query("x18_estimated_tokens", """
SELECT lang, sum(greatest(1, CAST(ceil(octet_length(encode(text)) / 3.0) AS BIGINT))) AS tokens FROM documents GROUP BY 1""")
def x18_estimated_tokens(t):
    return t.read("documents").groupBy("lang").agg(F.sum(X.estimated_tokens(F.col("text"))).alias("tokens"))


@query("x19_sanitize_evidence", "SELECT doc_id, sha256(substr(text, 1, 16000)) AS digest, length(substr(text, 1, 16000)) AS n FROM documents")
def x19_sanitize_evidence(t):
    dirty = F.concat(F.substring("text", 1, 5), F.lit("\u0001\u0007"), F.expr("substring(text, 6)"))
    clean = X.sanitize_evidence(dirty)
    return t.read("documents").select("doc_id", F.sha2(clean, 256).alias("digest"), F.length(clean).alias("n"))


@query("x26_collection_name", """
SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9_-]+', '-', 'g'), '-') || '-' || trim(regexp_replace(lower(p_brand), '[^a-z0-9_-]+', '-', 'g'), '-')
  || '-' || substr(sha256(p_brand), 1, 12) AS name FROM part""")
def x26_collection_name(t):
    return t.read("part").select("p_partkey", X.collection_name(F.col("p_name"), F.col("p_brand")).alias("name"))


@query("x56_digests", """
SELECT doc_id, substr(sha256(text), 1, 16) AS d16, substr(sha256(source || chr(1) || doc_id || chr(1) || lower(text)), 1, 24) AS d24, sha256(text) AS d64 FROM documents""")
def x56_digests(t):
    joined = F.concat_ws("\u0001", "source", F.col("doc_id").cast("string"), F.lower("text"))
    return t.read("documents").select(
        "doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("d16"), F.substring(F.sha2(joined, 256), 1, 24).alias("d24"),
        F.sha2("text", 256).alias("d64"),
    )


@query("x53_logistic", "SELECT event_id, round(1 / (1 + exp(-(value / 50 - 1))), 9) AS score FROM events")
def x53_logistic(t):
    logit = F.col("value") / 50 - 1
    safe = F.when(F.isnan("value"), F.raise_error(F.lit("a score cannot be NaN"))).otherwise(1 / (1 + F.exp(-logit)))
    return t.read("events").select("event_id", F.round(safe.cast("double"), 9).alias("score"))


@query("x54_ideal_dcg", "SELECT p_size, round(sum(1 / log2(i + 1)), 9) AS idcg FROM (SELECT DISTINCT p_size FROM part), range(1, 9) r(i) WHERE i <= p_size GROUP BY 1")
def x54_ideal_dcg(t):
    from evidquarry.operators.metrics import ideal_dcg

    return t.read("part").select("p_size").distinct().where("p_size >= 1").select(
        "p_size", F.round(ideal_dcg(F.col("p_size"), 8), 9).alias("idcg")
    )


@query("x55_freshness_key", """
SELECT source, max({'o': '', 'n': [CAST(doc_id % 4 AS BIGINT), CAST(doc_id % 12 AS BIGINT)], 'v': 'v' || doc_id % 4 || '.' || doc_id % 12}).v AS newest FROM documents GROUP BY 1""")
def x55_freshness_key(t):
    from evidquarry.operators.ranking import version_key

    rows = t.chunks().withColumn("observed_at", F.lit(""))
    return rows.groupBy(F.col("source_id").alias("source")).agg(F.max(version_key()).alias("m")).select("source", F.col("m.v").alias("newest"))


# ---- anchors --------------------------------------------------------------------

_SAID = """('Placed ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ', due ' || CAST(o_orderkey % 31 + 1 AS STRING) || ' de ' ||
 CASE o_orderkey % 4 WHEN 0 THEN 'febrero' WHEN 1 THEN 'mayo' WHEN 2 THEN 'septiembre' ELSE 'December' END || ' de ' || CAST(1990 + o_orderkey % 30 AS STRING) ||
 ' total 12,' || CAST(100 + o_orderkey % 900 AS STRING) || ' and 3.' || CAST(o_custkey % 50 AS STRING) || ' units')"""
_MONTH = "CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 9 ELSE 12 END"
_DUE = f"TRY_CAST((1990 + o_orderkey % 30) || '-' || lpad(CAST({_MONTH} AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0') AS DATE)"


@query("x50_date_number_anchors", f"""
SELECT o_orderkey, array_to_string(list_sort(list_distinct(['date:' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CAST(year(o_orderdate) AS VARCHAR),
  '12' || (100 + o_orderkey % 900), '3.' || (o_custkey % 50)] || CASE WHEN {_DUE} IS NULL THEN [CAST(o_orderkey % 31 + 1 AS VARCHAR), CAST(1990 + o_orderkey % 30 AS VARCHAR)]
  ELSE ['date:' || {_DUE}, CAST(1990 + o_orderkey % 30 AS VARCHAR)] END)), '|') AS anchors FROM orders""")
def x50_date_number_anchors(t):
    return t.read("orders").selectExpr("o_orderkey", f"{_SAID} AS said").select(
        "o_orderkey", F.array_join(F.array_sort(A.numeric_anchors(F.col("said"))), "|").alias("anchors")
    )


@query("x51_canonical_number", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_partkey AS VARCHAR) || '.' || (l_suppkey % 90 + 10)
  ELSE CAST(l_partkey AS VARCHAR) || CASE WHEN l_partkey < 1000 THEN '' ELSE '.' END || CAST(100 + l_suppkey % 900 AS VARCHAR) END AS canonical FROM lineitem""")
def x51_canonical_number(t):
    said = F.when(
        F.col("l_linenumber") % 2 == 0, F.concat_ws(",", F.col("l_partkey").cast("string"), (100 + F.col("l_suppkey") % 900).cast("string"))
    ).otherwise(F.concat_ws(",", F.col("l_partkey").cast("string"), (F.col("l_suppkey") % 90 + 10).cast("string")))
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", A.canonical_number(said).alias("canonical")
    )


@query("x52_anchor_and_negation_support", """
SELECT o_orderkey, (o_custkey % 50 = o_orderkey % 50) AS anchored, (o_orderstatus <> 'F' OR o_orderkey % 3 = 0) AS negated FROM orders""")
def x52_anchor_and_negation_support(t):
    claim = F.concat(F.lit("Priced 3."), (F.col("o_custkey") % 50 + 1).cast("string"), F.when(F.col("o_orderstatus") == "F", " and never open").otherwise(""))
    proof = F.concat(F.lit("It was 3."), (F.col("o_orderkey") % 50 + 1).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " sin pagar").otherwise(""))
    return t.read("orders").select(
        "o_orderkey", A.anchors_supported(claim, proof).alias("anchored"), A.negation_supported(claim, proof).alias("negated")
    )


# ---- language -------------------------------------------------------------------

def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = f"regexp_extract_all({_FOLD.format('text')}, '\\p{{L}}+')"
_EVID = ("ev", f"""SELECT *, len(list_filter({_WORDS}, lambda w: list_contains({_sql_list(L.ENGLISH_WORDS)}, w))) AS e,
  len(list_filter({_WORDS}, lambda w: list_contains({_sql_list(L.SPANISH_WORDS)}, w))) + CASE WHEN regexp_matches(lower(text), '[áéíóúüñ¿¡]') THEN 2 ELSE 0 END AS s
  FROM documents""")


@query("x13_language_evidence", ctes(_EVID) + """
SELECT doc_id, e AS english, s AS spanish, CASE WHEN s > e THEN 'es' WHEN e > s THEN 'en' ELSE 'mixed' END AS detected FROM ev""")
def x13_language_evidence(t):
    found = t.read("documents").select("doc_id", L.evidence(F.col("text")).alias("ev"))
    return found.select("doc_id", "ev.english", "ev.spanish", L.language_of(F.col("ev")).alias("detected"))


_TYPO = """CASE o_orderkey % 7 WHEN 0 THEN 'wat is the statuss of ' WHEN 1 THEN 'Explian ' WHEN 2 THEN 'teh overveiw for ' WHEN 3 THEN 'como funtiona '
 WHEN 4 THEN 'DESCRBE ' WHEN 5 THEN 'describe the last ' ELSE 'Difference betwen ' END || o_orderpriority"""
_FIXED = """CASE o_orderkey % 7 WHEN 0 THEN 'what is the statuss of ' WHEN 1 THEN 'Explain ' WHEN 2 THEN 'the overview for ' WHEN 3 THEN 'como funciona '
 WHEN 4 THEN 'DESCRBE ' WHEN 5 THEN 'describe the last ' ELSE 'Difference between ' END || o_orderpriority"""


@query("x11_autocorrect", f"SELECT o_orderkey, {_FIXED} AS corrected FROM orders")
def x11_autocorrect(t):
    return t.read("orders").selectExpr("o_orderkey", f"{_TYPO} AS q").select("o_orderkey", L.autocorrect(F.col("q")).alias("corrected"))


@query("x10_edit_distance", """
SELECT a, b, a <> b AND damerau_levenshtein(a, b) = 1 AS within_one, levenshtein(upper(a), upper(b)) <= 1 AS at_most_one FROM
(SELECT DISTINCT split_part(p_name, ' ', 1) AS a, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) || 's'
  WHEN 1 THEN substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 1), 3) ELSE lower(p_type) END AS b FROM part)""")
def x10_edit_distance(t):
    first = "split_part(p_name, ' ', 1)"
    pairs = t.read("part").selectExpr(
        f"{first} AS a",
        f"CASE p_partkey % 3 WHEN 0 THEN {first} || 's' WHEN 1 THEN substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr({first}, 3) ELSE lower(p_type) END AS b",
    ).distinct()
    return pairs.select(
        "a", "b", L.within_one_edit(F.col("a"), F.col("b")).alias("within_one"), L.at_most_one_edit(F.col("a"), F.col("b")).alias("at_most_one")
    )


_LEXICON = _sql_list(L.LEXICON)
_SHORT = "CASE f " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.SHORT_MISSPELLINGS.items()) + " END"
# User questions with repaired words, and the evidence in them.
_REPAIRED = (
    ("pc", """SELECT conv_id, turn, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (
  SELECT conv_id, turn, regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+') AS p FROM conversations WHERE role = 'user')"""),
    ("wf", f"SELECT w, {_FOLD.format('w')} AS f FROM (SELECT DISTINCT w FROM pc)"),
    ("wn", f"""SELECT *, {_SHORT} AS short, list_filter({_sql_list(L.CORRECTION_TARGETS)}, lambda x: damerau_levenshtein(f, x) = 1) AS near,
  NOT regexp_matches(w, '^\\p{{L}}') OR (length(w) < {L.MIN_CORRECTABLE} AND {_SHORT} IS NULL) OR upper(w) = w OR regexp_matches(substr(w, 2), '\\p{{Lu}}')
  OR list_contains({_LEXICON}, f) OR list_contains({_sql_list(L.NEVER_CORRECT)}, f)
  OR (f LIKE '%s' AND list_contains({_LEXICON}, f[:-2])) OR list_contains({_LEXICON}, f || 's') AS fixed FROM wf"""),
    ("wb", "SELECT w, f, fixed, coalesce(short, CASE WHEN len(near) = 1 THEN near[1] END) AS best FROM wn"),
    ("wc", """SELECT w, CASE WHEN fixed OR best IS NULL OR best = f THEN w WHEN regexp_matches(w, '^\\p{Lu}') THEN upper(best[1]) || best[2:] ELSE best END AS c FROM wb"""),
    ("uq", "SELECT conv_id, turn, string_agg(c, '' ORDER BY i) AS text FROM pc JOIN wc USING (w) GROUP BY 1, 2"),
    ("u", _EVID[1].replace("FROM documents", "FROM uq")),
)


@query("x13_response_language", ctes(*_REPAIRED, ("d", """
SELECT conv_id, turn, CASE WHEN s > e THEN 'es' WHEN e > s THEN 'en' ELSE 'mixed' END AS d FROM u"""), ("p", """
SELECT *, lag(d) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM d""")) + """
SELECT conv_id, turn, CASE WHEN d <> 'mixed' THEN d WHEN prev IN ('en', 'es') THEN prev ELSE 'es' END AS language FROM p""")
def x13_response_language(t):
    """The language a turn is answered in: its own, else that of the user's turn before, else the default."""
    users = t.read("conversations").where("role = 'user' AND text <> ''").select("conv_id", "turn", L.detect(F.col("text")).alias("d"))
    before = F.lag("d").over(Window.partitionBy("conv_id").orderBy("turn"))
    return users.withColumn("prev", before).select("conv_id", "turn", L.settled(F.col("d"), F.col("prev")).alias("language"))


@query("c31_latest_user_language", ctes(*_REPAIRED) + """
SELECT conv_id, arg_max(CASE WHEN s > e THEN 'es' ELSE 'en' END, turn) AS language FROM u WHERE s <> e GROUP BY 1""")
def c31_latest_user_language(t):
    users = t.read("conversations").where("role = 'user'").select("conv_id", "turn", L.detect(F.col("text")).alias("d"))
    return users.where(F.col("d") != "mixed").groupBy("conv_id").agg(F.max_by("d", "turn").alias("language"))


# ---- JSON -----------------------------------------------------------------------

_BROKEN = """CASE event_id % 5 WHEN 0 THEN replace(props, '"k"', 'k') WHEN 1 THEN replace(props, '}', ', "t": True,}') WHEN 2 THEN props || ' ' || props
 WHEN 3 THEN props || ' // note' ELSE props END"""


@query("x61_json_repairs", """
SELECT event_id, CASE event_id % 5 WHEN 1 THEN replace(props, '}', ', "t": true}') WHEN 2 THEN '[' || replace(props || ' ' || props, '} {', '},{') || ']'
  WHEN 3 THEN props || ' ' ELSE props END AS repaired, CASE event_id % 5 WHEN 0 THEN 'unquoted_keys' WHEN 1 THEN 'python_literals|trailing_commas'
  WHEN 2 THEN 'concatenated_objects' WHEN 3 THEN 'comments' ELSE '' END AS repairs FROM events""")
def x61_json_repairs(t):
    fixed = t.read("events").selectExpr("event_id", f"{_BROKEN} AS v").select("event_id", J.repaired(F.col("v")).alias("r"))
    return fixed.select("event_id", F.col("r.text").alias("repaired"), F.array_join("r.repairs", "|").alias("repairs"))


@query("x60_json_unwrap", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def x60_json_unwrap(t):
    once = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    wrapped = F.when(F.col("event_id") % 2 == 0, once).otherwise(F.col("props"))
    plain = J.unwrapped(wrapped)
    return t.read("events").select("event_id", F.get_json_object(plain, "$.k").cast("bigint").alias("k"))


@query("x64_fenced_payload", "SELECT event_id, props || chr(10) AS payload FROM events")
def x64_fenced_payload(t):
    message = F.concat(F.lit("format this json\n```json\n"), "props", F.lit("\n```"))
    return t.read("events").select("event_id", J.fenced_payload(message).alias("payload"))


@query("x23_looks_like_payload", """
SELECT doc_id, length(m) <= 400 OR (m LIKE '{%' AND m LIKE '%}') OR (m LIKE '[%' AND m LIKE '%]')
  OR (m LIKE '"%"' AND (contains(m, '{') OR contains(m, '['))) AS payload
FROM (SELECT doc_id, trim(CASE WHEN doc_id % 2 = 0 AND n_chars > 400 THEN '[' || text || ']' ELSE text END) AS m FROM documents)""")
def x23_looks_like_payload(t):
    rows = t.read("documents")
    message = F.when((F.col("doc_id") % 2 == 0) & (F.col("n_chars") > 400), F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    return rows.select("doc_id", J.looks_like_payload(message, 400).alias("payload"))


@query("x65_changelog_lines", """
SELECT l_orderkey, l_linenumber, l_partkey, 'status: ' || l_returnflag || ' → ' || l_linestatus AS line FROM lineitem WHERE l_linenumber % 4 = 2""")
def x65_changelog_lines(t):
    from evidquarry.operators.structured import render_changelog

    body = F.concat(
        F.lit('[{"field":"status","fromString":"'), "l_returnflag", F.lit('","toString":"'), "l_linestatus", F.lit('"}]')
    )
    return t.read("lineitem").where("l_linenumber % 4 = 2").select(
        "l_orderkey", "l_linenumber", "l_partkey", render_changelog(body).alias("line")
    )
