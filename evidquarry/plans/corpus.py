"""Registered queries: readers, suite builders, catalog checks and event streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from evidquarry.functions import text as X
from evidquarry.operators import suites as SU
from evidquarry.operators.ranks import cumulative_counts
from evidquarry.plans.registry import ctes, query
from evidquarry.session import shared_path
from evidquarry.sources import files
from evidquarry.sources.html import text_lines
from evidquarry.streaming import rate_limit, telemetry

_BLOCK = "</?(br|div|h1|h2|h3|h4|h5|h6|li|p|pre|td|th|tr)(\\s[^>]*)?/?>"


@query("s19_html_text_lines", f"""
SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(replace(html, '"</p>"', '"' || chr(1) || '/p>"'), '<!--.*?-->|<![^>]*>', '', 'gs'), '{_BLOCK}', chr(10), 'gi'), '</?[A-Za-z][^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), chr(1), '<'), chr(10)),
  lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS lines FROM pages""")
def s19_html_text_lines(t):
    return t.read("pages").select("page_id", F.array_join(text_lines(F.col("html")), "\n").alias("lines"))


@query("s14_manifest_scan", ctes("chunks") + """
SELECT chunk_id, source_id, locator, title, doc_category, entity_key, parent_id FROM chunks WHERE project_id = 'ALPHA'""")
def s14_manifest_scan(t):
    return t.chunks().where(F.col("project_id") == "ALPHA").select(
        "chunk_id", "source_id", "locator", "title", "doc_category", "entity_key", "parent_id"
    )


@query("s15_snapshot_fingerprint", """
SELECT count(*) AS record_count, bit_xor(v) AS xor_digest, CAST(sum(v) AS BIGINT) AS sum_digest FROM
(SELECT CAST('0x' || substr(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 12) AS BIGINT) AS v FROM events)""")
def s15_snapshot_fingerprint(t):
    return SU.set_digest(SU.row_fingerprints(t.read("events"), ["event_id", "event_type", "user_id"]))


@query("s13_vocabulary_merge", """
SELECT item, CAST(row_number() OVER (ORDER BY first) AS INT) AS position FROM (SELECT item, min(p_partkey * 10 + pos) AS first FROM
(SELECT p_partkey, lower(p_brand) AS item, 0 AS pos FROM part UNION ALL SELECT p_partkey, lower(p_type), 1 FROM part) GROUP BY 1)""")
def s13_vocabulary_merge(t):
    record = F.to_json(F.struct(F.array("p_brand", "p_type").alias("entities")))
    rows = t.read("part").select("p_partkey", record.alias("record"))
    items = rows.select(
        "p_partkey",
        F.posexplode(X.normalized_values(F.from_json("record", "entities array<string>")["entities"])).alias("pos", "item"),
    )
    # ordered distinct union: the first sighting of an item decides its place
    first = items.groupBy("item").agg(F.min(F.col("p_partkey") * 10 + F.col("pos")).alias("first"))
    places = cumulative_counts(first, "first", []).select("first", (F.col("below") + 1).cast("int").alias("position"))
    return first.join(places, "first").select("item", "position")


@query("c32_intent_terms", """
SELECT p_partkey, upper(p_type) AS intent, lower(p_brand) || '|' || lower(p_name) AS terms FROM part""")
def c32_intent_terms(t):
    raw = F.concat(F.lit('{"'), F.lower("p_type"), F.lit('": ["'), "p_brand", F.lit('", " '), F.upper("p_name"), F.lit('", ""]}'))
    parsed = F.from_json(raw, "map<string,array<string>>")
    clean = F.transform_values(parsed, lambda _k, v: X.normalized_values(v))
    return t.read("part").select("p_partkey", F.explode(clean).alias("k", "v")).select(
        "p_partkey", F.upper("k").alias("intent"), F.array_join("v", "|").alias("terms")
    )


# ---- suites ---------------------------------------------------------------------

_HEADS = "'# ' || p_brand || chr(10) || 'intro' || chr(10) || '## ' || p_type || chr(10) || 'body' || chr(10) || '### ' || p_name || chr(10) || 'deep' || chr(10) || '## Next' || chr(10) || 'end'"


@query("s22_heading_paths", """
SELECT p_partkey, i - 1 AS line_no, CASE WHEN i <= 2 THEN p_brand WHEN i <= 4 THEN p_brand || ' > ' || p_type WHEN i <= 6 THEN p_brand || ' > ' || p_type || ' > ' || p_name
  ELSE p_brand || ' > Next' END AS path FROM part, range(1, 9) r(i)""")
def s22_heading_paths(t):
    return t.read("part").selectExpr("p_partkey", f"{_HEADS} AS md").select(
        "p_partkey", F.posexplode(SU.heading_paths(F.col("md"))).alias("line_no", "path")
    )


_INDEX = """'## [QUESTION-' || upper(p_type) || '] Group' || chr(10) || 'Equivalent questions:' || chr(10) || '- "Where is ' || p_name || '?"' || chr(10) || '- "How big is it?"' || chr(10)
 || 'Routes: [SEC-' || CAST(p_size AS STRING) || '], [SEC-7]' || chr(10) || chr(10) || '## [QUESTION-OUT-OF-SCOPE] Other' || chr(10) || 'Equivalent questions:' || chr(10)
 || '- "Who is ' || p_brand || '?"' || chr(10) || 'Routes: [SEC-0]'"""


@query("s23_question_index", """
SELECT p_partkey, 'QUESTION-' || upper(p_type) AS group_id, CASE WHEN p_size = 7 THEN 'SEC-7' ELSE 'SEC-' || p_size || '|SEC-7' END AS sections, 'Where is ' || p_name || '?' AS question, true AS answerable FROM part
UNION ALL SELECT p_partkey, 'QUESTION-' || upper(p_type), CASE WHEN p_size = 7 THEN 'SEC-7' ELSE 'SEC-' || p_size || '|SEC-7' END, 'How big is it?', true FROM part
UNION ALL SELECT p_partkey, 'QUESTION-OUT-OF-SCOPE', 'SEC-0', 'Who is ' || p_brand || '?', false FROM part""")
def s23_question_index(t):
    rows = t.read("part").selectExpr("p_partkey", f"{_INDEX} AS md")
    return SU.question_index(rows, "p_partkey", "md").withColumn("sections", F.array_join("sections", "|"))


@query("s8_canonical_question_lookup", """
SELECT asked, p_partkey, 'QUESTION-' || upper(p_type) AS group_id FROM (SELECT lower(p_name) AS asked, p_partkey, p_type, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part) WHERE k <= 24""")
def s8_canonical_question_lookup(t):
    """Every part name asked about in other words and case, looked up among the indexed questions, 24 each."""
    fold = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9à-ÿ]+"), 0), " ")
    asked = t.read("part").select(F.lower("p_name").alias("asked")).distinct().withColumn("key", fold(F.concat(F.lit("WHERE is, "), F.upper("asked"))))
    rows = SU.question_index(t.read("part").selectExpr("p_partkey", f"{_INDEX} AS md"), "p_partkey", "md").withColumn("key", fold(F.col("question")))
    nth = F.row_number().over(Window.partitionBy("asked").orderBy("p_partkey"))
    return rows.join(asked, "key").withColumn("k", nth).where("k <= 24").select("asked", "p_partkey", "group_id")


@query("r12_route_directive", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'SEC-' || p_size || CASE WHEN p_size = 7 THEN '' ELSE '|SEC-7' END ELSE 'SEC-0' END AS tokens,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'INSUFFICIENT_EVIDENCE' END AS refusal FROM part""")
def r12_route_directive(t):
    rows = SU.question_index(t.read("part").selectExpr("p_partkey", f"{_INDEX} AS md"), "p_partkey", "md")
    wanted = F.when(F.col("p_partkey") % 2 == 0, F.lit("How big is it?"))
    hit = rows.where(F.when(wanted.isNotNull(), F.col("question") == wanted).otherwise(~F.col("answerable")))
    return hit.select(
        "p_partkey", F.array_join(F.slice("sections", 1, 12), "|").alias("tokens"),
        F.when(F.col("answerable"), "").otherwise("INSUFFICIENT_EVIDENCE").alias("refusal"),
    )


_REG = "'| `' || upper(replace(p_name, ' ', '_')) || '_EVENT` | `' || replace(p_name, ' ', '_') || '` | ' || CAST(100 + p_size AS STRING) || ' | 1,' || CAST(p_size % 10 AS STRING) || ' |'"


@query("s24_registry_rows", f"""
SELECT wire_name, arg_min(constant, p_partkey) AS constant, arg_min(event_id, p_partkey) AS event_id, arg_min(version, p_partkey) AS version FROM
(SELECT p_partkey, replace(p_name, ' ', '_') AS wire_name, upper(replace(p_name, ' ', '_')) || '_EVENT' AS constant, CAST(100 + p_size AS VARCHAR) AS event_id, '1.' || p_size % 10 AS version FROM part) GROUP BY 1""")
def s24_registry_rows(t):
    return SU.registry_entries(t.read("part").selectExpr("p_partkey", f"{_REG} AS row"), "row", "p_partkey")


@query("x25_infer_category", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'registry-table' WHEN 1 THEN 'workflow' ELSE 'narrative' END AS category FROM part""")
def x25_infer_category(t):
    kind = F.col("p_partkey") % 3
    doc = F.when(kind == 0, F.concat(F.lit("# t\n| a | b |\n| c | "), "p_name", F.lit(" |"))).when(
        kind == 1, F.concat(F.lit("# t\n1. go "), "p_name", F.lit("\ntext"))
    ).otherwise(F.concat(F.lit("# t\nplain "), "p_name"))
    return t.read("part").select("p_partkey", SU.category(doc).alias("category"))


@query("c34_suite_expansion", ctes("chunks") + """
SELECT source_id, lang AS language, dep AS department, count(*) AS cases FROM chunks, (SELECT unnest(['en', 'es']) AS lang), (SELECT unnest(['ops', 'sales', 'it']) AS dep) GROUP BY 1, 2, 3""")
def c34_suite_expansion(t):
    per_source = t.chunks().groupBy("source_id").agg(F.count(F.lit(1)).alias("cases"))
    langs = F.explode(F.array(F.lit("en"), F.lit("es")))
    deps = F.explode(F.array(F.lit("ops"), F.lit("sales"), F.lit("it")))
    return per_source.withColumn("language", langs).withColumn("department", deps)


@query("c35_issue_suite", ctes("sections", ("e", """
SELECT section_kind, source_id, event_id, min(ord) AS o, arg_min(issue_key, ord) AS issue_key, count(*) AS gold FROM sections GROUP BY 1, 2, 3"""), ("s", """
SELECT *, row_number() OVER (PARTITION BY section_kind ORDER BY o, source_id, event_id) AS slot FROM e""")) + """
SELECT lower(section_kind) || '-' || (slot - 1) || '-' || language AS case_id, section_kind, issue_key, event_id, language, gold
FROM s, (SELECT unnest(['en', 'es']) AS language) WHERE slot <= 2""")
def c35_issue_suite(t):
    return SU.issue_suite(t.sections())


@query("c36_generation_sample", ctes("chunks", ("p", """
SELECT chunk_id AS case_id, ord, language AS query_language, source_id AS section, row_number() OVER (PARTITION BY language, source_id ORDER BY ord) AS rn FROM chunks WHERE chunk_id % 10 <> 0"""), ("u", """
SELECT case_id, ord, query_language, section, rn, CASE WHEN rn <= 4 THEN 1 END AS reserved FROM p WHERE rn <= 504
UNION ALL SELECT chunk_id, ord, language, source_id, 0, 0 FROM chunks WHERE chunk_id % 10 = 0""")) + """
SELECT case_id, reserved AS lane FROM u WHERE reserved IS NOT NULL UNION ALL
SELECT case_id, 2 FROM (SELECT *, row_number() OVER (ORDER BY rn, query_language, section, ord) AS k FROM u WHERE reserved IS NULL)
WHERE k <= 500 - (SELECT count(*) FROM u WHERE reserved IS NOT NULL)""")
def c36_generation_sample(t):
    cases = t.chunks().select(
        F.col("chunk_id").alias("case_id"), "ord", (F.col("chunk_id") % 10 != 0).alias("answerable"),
        F.col("language").alias("query_language"), F.col("source_id").alias("section"),
    )
    return SU.generation_sample(cases, 500)


@query("c39_standardized_examples", """
SELECT conv_id, turn, CASE WHEN role < 'und' THEN role || '|und' ELSE 'und|' || role END AS tags, sha256('{"answerable":' || CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"case_id":"c' || conv_id || '-' || turn || '","language":"und","persona":"' || role || '"}') AS content_hash
FROM conversations""")
def c39_standardized_examples(t):
    case_id = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    canonical = F.to_json(F.struct(
        (F.col("conv_id") % 2 == 0).alias("answerable"), case_id.alias("case_id"), F.lit("und").alias("language"), F.col("role").alias("persona")
    ))
    tags = F.array_sort(F.array_distinct(F.array(F.lit("und"), F.col("role"), F.lit("und"))))
    return t.read("conversations").select(
        "conv_id", "turn", F.array_join(tags, "|").alias("tags"), F.sha2(canonical, 256).alias("content_hash")
    )


# ---- files ----------------------------------------------------------------------

@query("s16_jsonl_round_trip", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s16_jsonl_round_trip(t):
    path = shared_path(t.spark, "jsonl")
    files.write_ndjson(t.read("events").select("event_id", "event_type", "value"), path)
    rows = files.read_jsonl(t.spark, path, "event_id bigint, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s20_ndjson_lines", """SELECT event_id, '{"type":"' || event_type || '","user":' || user_id || '}' AS line FROM events""")
def s20_ndjson_lines(t):
    return t.read("events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("line"))


_CATALOG = {
    "sku": "'S' || CAST(p_partkey - p_partkey % 500 * CAST(p_partkey % 500 = 499 AS INT) AS STRING)",
    "brand": "p_brand", "category_code": "p_type", "lifecycle_state": "CASE WHEN p_partkey % 50 = 1 THEN 'retired' ELSE 'active' END",
    "effective_date": "CASE WHEN p_partkey % 40 = 2 THEN '2024-13-01' ELSE '2024-02-29' END",
    "availability_scope": "CASE WHEN p_partkey % 30 = 3 THEN 'regional' ELSE 'national' END", "regions": "CASE WHEN p_partkey % 60 = 3 THEN 'N|S' ELSE ' ' END",
}


def _catalog(t):
    other = [c for c in files.CATALOG_COLUMNS if c not in _CATALOG]
    rows = t.read("part").selectExpr("p_partkey", "p_name", *[f"{e} AS {c}" for c, e in _CATALOG.items()])
    blank = F.when((F.col("p_partkey") % 70 == 4), "").otherwise(F.col("p_name"))
    return rows.select(*_CATALOG, *[blank.alias(c) for c in other])


_CAT_SQL = ("ca", "SELECT 'S' || (p_partkey - p_partkey % 500 * CAST(p_partkey % 500 = 499 AS INT)) AS sku, CASE WHEN p_partkey % 70 = 4 THEN 'MISSING_FIELDS' "
            "WHEN p_partkey % 50 = 1 THEN 'INACTIVE' WHEN p_partkey % 40 = 2 THEN 'BAD_DATE' WHEN p_partkey % 30 = 3 AND p_partkey % 60 <> 3 THEN 'REGION_REQUIRED' END AS violation FROM part")


@query("s17_catalog_contract", ctes(_CAT_SQL) + """
SELECT violation, count(*) AS n FROM (SELECT violation FROM ca WHERE violation IS NOT NULL
UNION ALL SELECT 'CONFLICTING_SKU' FROM ca GROUP BY sku HAVING count(*) > 1) GROUP BY 1""")
def s17_catalog_contract(t):
    return files.catalog_report(_catalog(t))


@query("s18_catalog_markdown", """
SELECT 'S' || p_partkey AS sku, '## ' || p_name || chr(10) || chr(10) || '- section_id: `product:S' || p_partkey || '`' || chr(10) || '- translation_of: `product:S' || p_partkey || ':es`' || chr(10) ||
 '- sku: `S' || p_partkey || '`' || chr(10) || '- brand: ' || p_brand || chr(10) || '- category_code: `' || p_type || '`' || chr(10) || '- category: ' || p_name || chr(10) || '- effective_date: `2024-02-29`' AS value FROM part""")
def s18_catalog_markdown(t):
    names = [c for c in files.CATALOG_COLUMNS if c.startswith(("name", "category_e"))]
    rows = t.read("part").select(
        F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category_code"),
        F.lit("2024-02-29").alias("effective_date"), *[F.col("p_name").alias(c) for c in names],
    )
    return files.catalog_markdown(rows, "en")


@query("a30_key_set_hash", """
SELECT block, count(*) AS n, sha256(string_agg(k, chr(10) ORDER BY k) || chr(10)) AS digest FROM
(SELECT CAST((p_partkey - p_partkey % 1000) / 1000 AS BIGINT) AS block, 'S' || p_partkey AS k FROM part) GROUP BY 1""")
def a30_key_set_hash(t):
    """Sorted-set digests over fixed blocks of at most 1000 keys, so no group can grow."""
    keyed = t.read("part").select(
        F.expr("p_partkey div 1000").alias("block"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("k")
    )
    joined = F.concat(F.array_join(F.array_sort(F.collect_list("k")), "\n"), F.lit("\n"))
    return keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sha2(joined, 256).alias("digest"))


# ---- event streams --------------------------------------------------------------

@query("t3_rate_limit", None)
def t3_rate_limit(t):
    """Sliding-log admission per user over the whole event log."""
    return rate_limit.limited_batch(t.read("events"), limit=1, window=3_600_000_000)


_LE = "CASE " + " ".join(f"WHEN value / 10 <= {b} THEN '{b}'" for b in telemetry.DURATION_BOUNDS) + " ELSE '+Inf' END"


@query("t8_duration_histogram", f"SELECT event_type AS stage, {_LE} AS le, count(*) AS n, round(sum(value / 10), 6) AS total FROM events GROUP BY 1, 2")
def t8_duration_histogram(t):
    return telemetry.histogram(t.read("events"), "event_type", F.col("value") / 10, telemetry.DURATION_BOUNDS)


@query("t8_stage_windows", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS stage, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def t8_stage_windows(t):
    return telemetry.windowed(t.read("events"), "event_type", "1 hour")


@query("a33_usage_rollup", "SELECT user_id, count(*) AS calls, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS tokens FROM events GROUP BY 1")
def a33_usage_rollup(t):
    return t.read("events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("tokens")
    )
