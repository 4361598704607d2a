"""Registered queries: routing of questions about issue rows, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidquarry.functions.text import bound, fold_accents
from evidquarry.operators import routing as RT
from evidquarry.plans.registry import ctes, query
from evidquarry.sources.tables import ISSUE_COLUMNS

# ---- questions about issue rows: everything asked for is in the row, the SQL reads its columns --

_CATEGORY = "CASE o_orderstatus WHEN 'F' THEN '{done}' WHEN 'O' THEN '{new}' ELSE '{active}' END"
_TYPES = "CASE issue_type WHEN 'Bug' THEN '{bug}' WHEN 'Task' THEN '{task}' WHEN 'Story' THEN '{story}' ELSE '' END"
_LABELLED = "CASE WHEN labels LIKE '%POS' THEN '{label} POS' ELSE '' END"
_EN_WORDS = (_CATEGORY.format(done="closed", new="open", active="active"), _TYPES.format(bug="bugs", task="tasks", story="stories"), _LABELLED.format(label=" with"))
_ES_WORDS = (_CATEGORY.format(done="cerradas", new="abiertas", active="activas"), _TYPES.format(bug="errores", task="tareas", story="historias"), _LABELLED.format(label=" con"))


def _asked(words: tuple, count: str, listing: str, spread: str, overview: str, section_count: str, section: str, detail: str) -> str:
    category, types, label = words
    row = {"cat": f"' || {category} || '", "type": f"' || {types} || '", "lab": f"' || {label} || '", "key": "' || issue_key || '"}
    shown = [f"'{part.format(**row)}'" for part in (count, listing, spread, overview, section_count, section, detail)]
    return ("CASE priority WHEN '1-URGENT' THEN {} WHEN '2-HIGH' THEN {} WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus <> 'P' THEN {} ELSE {} END "
            "WHEN '4-NOT SPECIFIED' THEN {} ELSE CASE WHEN o_orderstatus = 'F' THEN {} ELSE {} END END").format(*shown)


_QUESTION = "CASE WHEN o_orderkey % 2 = 0 THEN " + _asked(
    _EN_WORDS, "How many {cat} {type} tickets{lab} are there?", "List all {cat} {type} issues{lab}", "Show the breakdown of {cat} tickets by type{lab}",
    "Please summarize the whole jira", "How many comments does {key} have?", "Show the history of {key}", "What about {key}?",
) + " ELSE " + _asked(
    _ES_WORDS, "Cuántas incidencias {cat} de {type}{lab} hay", "Lista todas las incidencias {cat} de {type}{lab}", "Desglose de incidencias {cat} por tipo{lab}",
    "Dame un resumen general de jira", "Cuántos comentarios tiene {key}", "Muestra los cambios de {key}", "Háblame de {key}",
) + " END"
_ROW = ("o_orderkey", "o_orderstatus", f"{ISSUE_COLUMNS['issue_key']} AS issue_key", f"{ISSUE_COLUMNS['labels']} AS labels", f"{ISSUE_COLUMNS['issue_type']} AS issue_type", "o_orderpriority AS priority")
_OPERATION = ("CASE priority WHEN '1-URGENT' THEN 'COUNT' WHEN '2-HIGH' THEN 'LIST' WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus <> 'P' THEN 'DISTRIBUTION' ELSE 'OVERVIEW' END "
              "WHEN '4-NOT SPECIFIED' THEN 'SECTION_COUNT' ELSE CASE WHEN o_orderstatus = 'F' THEN 'SECTION' ELSE 'DETAIL' END END")
_FILTERED = "priority IN ('1-URGENT', '2-HIGH') OR (priority = '3-MEDIUM' AND o_orderstatus <> 'P')"
_KEYED = "priority IN ('4-NOT SPECIFIED', '5-LOW')"
_ISSUES = ("iq", f"SELECT *, {_OPERATION} AS op, {_FILTERED} AS fl, {_KEYED} AS ky FROM (SELECT {', '.join(_ROW)} FROM orders)")


def issue_questions(t):
    return t.read("orders").selectExpr(*_ROW).selectExpr("*", f"{_QUESTION} AS q")


@query("r1_structured_operation", ctes(_ISSUES) + """
SELECT o_orderkey, op AS operation, CASE WHEN op = 'DISTRIBUTION' THEN 'issue_type' ELSE '' END AS group_by,
  CASE op WHEN 'SECTION_COUNT' THEN 'COMMENT' WHEN 'SECTION' THEN 'CHANGELOG' ELSE '' END AS section FROM iq""")
def r1_structured_operation(t):
    found = issue_questions(t).select("o_orderkey", RT.structured_query(F.col("q")).alias("s"))
    shown = lambda name: F.coalesce(f"s.{name}", F.lit(""))
    return found.select("o_orderkey", shown("operation").alias("operation"), shown("group_by").alias("group_by"), shown("section_kind").alias("section"))


@query("r2_structured_filters", ctes(_ISSUES) + """
SELECT o_orderkey, CASE WHEN fl THEN CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'new' ELSE 'indeterminate' END ELSE '' END AS category,
  CASE WHEN fl AND priority <> '3-MEDIUM' THEN issue_type ELSE '' END AS issue_type, CASE WHEN ky THEN upper(issue_key) ELSE '' END AS issue_key,
  CASE WHEN fl AND labels LIKE '%POS' THEN 'POS' ELSE '' END AS labels FROM iq""")
def r2_structured_filters(t):
    found = issue_questions(t).select("o_orderkey", RT.structured_query(F.col("q"))["filters"].alias("f"))
    shown = lambda key: F.coalesce(F.array_join(F.col("f")[key], "|"), F.lit(""))
    return found.select(
        "o_orderkey", shown("status_category_key").alias("category"), shown("issue_type").alias("issue_type"), shown("issue_key").alias("issue_key"), shown("labels").alias("labels"))


@query("r3_follow_up_merge", ctes(_ISSUES) + """
SELECT o_orderkey, CASE WHEN labels LIKE '%POS' THEN op WHEN o_orderstatus = 'F' THEN 'COUNT' WHEN op IN ('COUNT', 'LIST', 'DISTRIBUTION') THEN 'LIST' WHEN op = 'SECTION_COUNT' THEN 'SECTION' ELSE op END AS operation,
  CASE WHEN labels NOT LIKE '%POS' AND o_orderstatus <> 'F' THEN 20 ELSE 0 END AS "offset",
  array_to_string(list_sort(list_filter([
    CASE WHEN ky THEN 'issue_key=' || upper(issue_key) END,
    CASE WHEN fl AND priority <> '3-MEDIUM' AND issue_type <> '' THEN 'issue_type=' || issue_type END,
    CASE WHEN labels LIKE '%POS' THEN 'labels=KIOSK' END,
    CASE op WHEN 'SECTION_COUNT' THEN 'section_kind=COMMENT' WHEN 'SECTION' THEN 'section_kind=CHANGELOG' END,
    CASE WHEN labels NOT LIKE '%POS' AND o_orderstatus = 'F' THEN 'status=Blocked' END,
    CASE WHEN fl AND NOT (labels NOT LIKE '%POS' AND o_orderstatus = 'F') THEN 'status_category_key=' || CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'new' ELSE 'indeterminate' END END], lambda x: x IS NOT NULL)), ';') AS merged FROM iq""")
def r3_follow_up_merge(t):
    """What follows an issue question: other labels where the row has one, blocked ones where it is done, else the next page."""
    scope = bound(RT.structured_query(F.col("q")), lambda first: F.struct(
        first["operation"].alias("operation"), first["filters"].alias("filters"), F.lit(RT.PAGE_SIZE).alias("next_offset")))
    asked = F.when(F.col("labels").endswith("POS"), "what about KIOSK?").when(F.col("o_orderstatus") == "F", "and how many are blocked?").otherwise("show more")
    found = issue_questions(t).select("o_orderkey", asked.alias("asked"), scope.alias("scope")).select("o_orderkey", RT.continued_query(F.col("scope"), F.col("asked")).alias("s"))
    entries = F.array_sort(F.transform(F.map_entries("s.filters"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))))
    return found.select("o_orderkey", "s.operation", "s.offset", F.array_join(entries, ";").alias("merged"))


# ---- questions about documents: their titles, asked about as their kind of source suggests ------

_ABOUT = """CASE source_type WHEN 'PAGE' THEN 'Give me all the ' || topic || ' fields' WHEN 'ISSUE' THEN 'How do I fix open bugs in ' || topic
  WHEN 'CODE' THEN 'Which classes implement ' || topic ELSE CASE WHEN chunk_id % 3 = 0 THEN 'compare ' || topic || ' with the latest' WHEN chunk_id % 3 = 1 THEN topic ELSE 'please explain' END END"""
_TOPICS = ("dq", f"SELECT chunk_id, {_ABOUT} AS q FROM (SELECT *, replace(strip_accents(lower(title)), 'ß', 'ss') AS topic FROM chunks)")
_WORDS = "array_to_string(regexp_extract_all(lower(q), '[a-z0-9]+'), ' ')"


def topic_questions(t):
    return t.chunks().select("chunk_id", "source_type", fold_accents(F.col("title")).alias("topic")).selectExpr("chunk_id", f"{_ABOUT} AS q")


_INTENT_SQL = f"""CASE WHEN regexp_matches({_WORDS}, '(?i){RT.DELIVERY}') THEN 'DELIVERY' WHEN regexp_matches({_WORDS}, '(?i){RT.CROSS_SOURCE}') THEN 'CROSS_SOURCE'
  WHEN regexp_matches({_WORDS}, '(?i){RT.IMPLEMENTATION}') THEN 'IMPLEMENTATION' ELSE 'CODE_ASSISTED' END"""
_INVENTORY_SQL = " OR ".join(f"regexp_matches(trim(regexp_replace(q, '\\s+', ' ', 'g')), '(?i){pattern}')" for pattern in RT.INVENTORY)


# how a question names each section kind of the table, in two languages
_ASKED = """'{show} ' || CASE section_kind WHEN 'COMMENT' THEN '{comment} ' || substr(event_id, 3)
  WHEN 'CHANGELOG' THEN '{changelog} ' || substr(event_id, 3) WHEN 'ATTACHMENT' THEN '{attachment}' ELSE '{description}' END"""
_EN = _ASKED.format(show="Show the", comment="comment", changelog="changelog, event", attachment="attachment", description="description")
_ES = _ASKED.format(show="Muestra el", comment="Comentario", changelog="historial, evento histórico", attachment="archivo adjunto", description="comportamiento")


@query("r4_section_route", ctes("sections") + """
SELECT ord, section_kind AS section, upper(issue_key) AS issue_key, CASE WHEN section_kind IN ('COMMENT', 'CHANGELOG') THEN substr(event_id, 3) ELSE '' END AS event
FROM sections""")
def r4_section_route(t):
    asked = t.sections().selectExpr("ord", f"CASE WHEN chunk_ordinal % 2 = 0 THEN {_EN} || ' of ' || lower(issue_key) ELSE {_ES} || ' de ' || issue_key END AS q")
    return asked.select(
        "ord", RT.section_route(F.col("q")).alias("section"), RT.issue_keys(F.col("q"))[0].alias("issue_key"),
        F.coalesce(RT.section_event(F.col("q")), F.lit("")).alias("event"),
    )


@query("r5_source_intent", ctes("chunks", _TOPICS) + f"""
SELECT chunk_id, intent, CASE WHEN intent = 'DELIVERY' THEN 'ISSUE' ELSE 'PAGE|CODE' END AS scope FROM (SELECT chunk_id, {_INTENT_SQL} AS intent FROM dq)""")
def r5_source_intent(t):
    intent = RT.source_intent(F.col("q"))
    return topic_questions(t).select("chunk_id", intent.alias("intent"), F.array_join(RT.intent_scope(intent), "|").alias("scope"))


@query("r6_inventory_intent", ctes("chunks", _TOPICS) + f"""
SELECT chunk_id, {_INVENTORY_SQL} AS inventory, regexp_matches(q, '(?i){RT.PROCEDURAL}') AS procedural FROM dq""")
def r6_inventory_intent(t):
    return topic_questions(t).select(
        "chunk_id", RT.is_inventory(F.col("q")).alias("inventory"), RT.has(F.col("q"), RT.PROCEDURAL).alias("procedural")
    )


@query("x16_query_quality", ctes("chunks", _TOPICS, ("w", "SELECT chunk_id, regexp_extract_all(lower(q), '[a-z0-9]+') AS ws FROM dq"), ("n", f"""
SELECT chunk_id, len(ws) AS n, len(list_filter(ws, lambda x: x NOT IN ({", ".join(repr(w) for w in RT.GENERIC_WORDS)}))) AS tn FROM w""")) + """
SELECT chunk_id, CASE WHEN n < 2 THEN 'WEAK:TOO_SHORT' WHEN tn = 0 THEN 'WEAK:NO_TOPIC' WHEN tn = 1 AND n <= 4 THEN 'AMBIGUOUS:SINGLE_TOPIC' ELSE 'GOOD:SUFFICIENT_TOPIC' END AS quality FROM n""")
def x16_query_quality(t):
    return topic_questions(t).select("chunk_id", RT.query_quality(F.col("q")).alias("quality"))


@query("x15_terminology_variant", ctes(_ISSUES) + """
SELECT o_orderkey, CASE WHEN priority = '2-HIGH' THEN 'check the ' || o_orderstatus || ' order priority priority priorities prioritized prioridad prioridades prioritario prioritarios'
  WHEN priority = '1-URGENT' THEN 'check ' || issue_key ELSE '' END AS variant FROM iq""")
def x15_terminology_variant(t):
    """Look-ups of an issue, of its order's priority, or neither, as its priority says."""
    asked = F.when(F.col("priority") == "2-HIGH", F.concat(F.lit("look up the  "), "o_orderstatus", F.lit(" order priority"))).when(
        F.col("priority") == "1-URGENT", F.concat(F.lit("Inspect "), "issue_key")).otherwise(F.concat(F.lit("tell me of "), "issue_key"))
    return issue_questions(t).select("o_orderkey", RT.terminology_variant(asked).alias("variant"))


@query("r7_catalog_request", """
SELECT conv_id, turn, regexp_matches(q, '(?i)""" + RT.PRODUCT_CATALOG + """') AS requested FROM
(SELECT conv_id, turn, text || CASE WHEN strip_accents(lower(text)) LIKE '%the %' THEN ' Give me ALL the products now' ELSE '' END AS q FROM conversations WHERE role = 'user' AND text IS NOT NULL)""")
def r7_catalog_request(t):
    """User turns, those in English (by an article) with a request for the catalog appended."""
    wants = F.when(fold_accents(F.col("text")).contains("the "), " Give me ALL the products now").otherwise("")
    rows = t.read("conversations").where("role = 'user' AND text IS NOT NULL")
    return rows.select("conv_id", "turn", RT.has(F.concat("text", wants), RT.PRODUCT_CATALOG).alias("requested"))


@query("r8_source_authority", ctes("chunks", ("ty", "SELECT parent_id, list_sort(list_distinct(list(source_type))) AS types FROM chunks GROUP BY 1")) + """
SELECT parent_id, len(list_filter(types, lambda x: x NOT IN ('PAGE', 'CODE'))) = 0 AS implementation, types = ['ISSUE'] AS delivery,
  list_contains(types, 'PAGE') AND list_contains(types, 'CODE') AS cross_source FROM ty""")
def r8_source_authority(t):
    types = t.chunks().groupBy("parent_id").agg(F.collect_set("source_type").alias("types"))
    return types.select(
        "parent_id",
        RT.source_authority(F.lit("IMPLEMENTATION"), F.col("types")).alias("implementation"),
        RT.source_authority(F.lit("DELIVERY"), F.col("types")).alias("delivery"),
        RT.source_authority(F.lit("CROSS_SOURCE"), F.col("types")).alias("cross_source"),
    )


@query("r15_scope_narrowing", ctes("chunks", ("ty", "SELECT project_id, list_distinct(list(source_type)) AS types FROM chunks GROUP BY 1")) + """
SELECT project_id, array_to_string(list_filter(['PAGE', 'WIKI', 'CODE'], lambda x: list_contains(types, x)), '|') AS scope FROM ty""")
def r15_scope_narrowing(t):
    from evidquarry.operators.gates import clarified_scope

    wanted = F.array(F.lit("PAGE"), F.lit("WIKI"), F.lit("CODE"))
    seen = t.chunks().groupBy("project_id").agg(F.collect_set("source_type").alias("types"))
    return seen.select("project_id", F.array_join(clarified_scope(wanted, F.col("types")), "|").alias("scope"))


@query("t6_failure_classes", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'RATE_LIMITED' WHEN 1 THEN 'PROVIDER_AUTH_FAILED' WHEN 2 THEN 'PROVIDER_UNAVAILABLE'
  WHEN 3 THEN 'PROVIDER_TIMEOUT' WHEN 4 THEN 'EMBEDDING_QUOTA_EXHAUSTED' ELSE 'UNKNOWN_RETRIEVAL_FAILURE' END AS failure FROM events""")
def t6_failure_classes(t):
    code = F.col("event_id") % 6
    wordings = ("monthly quota used up", "embedding token limit reached", "none left in the current month", "RESOURCE_EXHAUSTED")
    spent = F.element_at(F.array(*[F.lit(w) for w in wordings]), (F.floor(F.col("event_id") / 6) % 4 + 1).cast("int"))
    status = F.when(code.isin(0, 4), 429).when(code == 1, 403).when(code == 2, 503)
    message = F.when(code == 3, "ReadTimeout after 5s").when(code == 4, spent).otherwise("failed")
    return t.read("events").select("event_id", RT.failure_class(status, message).alias("failure"))
