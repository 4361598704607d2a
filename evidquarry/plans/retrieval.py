"""Registered queries: scans, lexical and dense ranking, fusion, candidate windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from evidquarry.functions.text import tokens
from evidquarry.operators import dense, fusion, lexical, ranking as R, scans
from evidquarry.operators.neighbors import expand_neighbors
from evidquarry.plans.registry import ctes, query
from evidquarry.sources.tables import CALLER_POLICIES, PROJECT

POOL = 50


# ---- portable pieces of the cross-check SQL -------------------------------------

def sql_tokens(value: str) -> str:
    part = (
        "list_filter(string_split_regex(regexp_replace(regexp_replace(tk, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
        "'([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[ _./:#-]+'), "
        "lambda p: length(p) >= 2 AND NOT regexp_full_match(p, '[0-9]+'))"
    )
    return (
        f"flatten(list_transform(regexp_extract_all({value}, '[A-Za-z0-9][A-Za-z0-9_./:#-]*'), lambda tk: "
        f"list_concat([lower(tk)], list_transform([{part}], lambda ps: CASE WHEN len(ps) >= 2 "
        "THEN list_transform(ps, lambda x: lower(x)) ELSE [] END)[1])))"
    )


SEARCHABLE = (
    "concat_ws(' ', page_content, title, title, reference, reference, reference, locator, locator)"
)
LEX_CTES = (
    "chunks",
    ("toks", f"SELECT chunk_id, {sql_tokens(SEARCHABLE)} AS tk FROM chunks"),
    ("post", "SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(tk) AS length, "
     "unnest(tk) AS term FROM toks) GROUP BY ALL"),
    ("dfs", "SELECT term, count(*) AS df FROM post GROUP BY 1"),
    ("q", "SELECT item_id AS query_id, text AS question FROM benchmark"),
    ("qt", f"SELECT DISTINCT query_id, unnest({sql_tokens('question')}) AS term FROM q"),
    ("st", "SELECT count(*) AS n, greatest(avg(len(tk)), 1) AS al FROM toks"),
    ("sc", "SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / "
     "(tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS lexical_score "
     "FROM qt JOIN post USING (term) JOIN dfs USING (term), st GROUP BY ALL"),
    ("lex", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, "
     f"chunk_id) AS lexical_rank FROM sc) WHERE lexical_rank <= {POOL}"),
)
COSINE = "round(greatest(0, list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 6)"
DENSE_CTES = (
    ("dsc", f"SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {COSINE.format(a='a.embedding', b='b.embedding')} "
     "AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)"),
    ("den", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) "
     f"AS dense_rank FROM dsc) WHERE dense_rank <= {POOL}"),
)
CHUNK_META = (
    "page_content, language, source_id, source_type, project_id, access_policy_id, authority, source_version, "
    "observed_at, parent_id, chunk_ordinal, doc_category, entity_key, entity, title, reference, locator"
)
FUSE_CTES = (
    *LEX_CTES,
    *DENSE_CTES,
    ("fu", "SELECT query_id, chunk_id, lexical_score, lexical_rank, score, dense_rank, round(coalesce(1.25 / (60 + "
     "lexical_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0), 9) AS fusion_score "
     "FROM lex FULL OUTER JOIN den USING (query_id, chunk_id)"),
    ("fused", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, "
     "coalesce(lexical_score, 0) DESC, coalesce(score, 0) DESC, coalesce(lexical_rank, 1000000 + dense_rank)) AS ord "
     f"FROM fu) WHERE ord <= {POOL}"),
    ("cand", f"SELECT fused.*, {CHUNK_META} FROM fused JOIN (SELECT * EXCLUDE (ord) FROM chunks) USING (chunk_id)"),
)
# the stand-in relevance score: share of question terms present, through a logistic
RERANK_CTES = (
    *FUSE_CTES,
    ("qs", "SELECT query_id, list(term) AS terms FROM qt GROUP BY 1"),
    ("dt", "SELECT chunk_id, list_distinct(tk) AS dterms FROM toks"),
    ("rr", "SELECT cand.*, round(1 / (1 + exp(-(8.0 * len(list_intersect(terms, dterms)) / len(terms) - 4))), 6) "
     "AS rerank_score FROM cand JOIN qs USING (query_id) JOIN dt USING (chunk_id)"),
)


# ---- shared plan pieces ---------------------------------------------------------

def questions(t):
    return t.read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(t):
    return t.read("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def lexical_top(t, k: int = POOL):
    return lexical.bm25_top_k(t.chunks(), questions(t), k)


def dense_top(t, k: int = POOL):
    asked = vectors(t).withColumnRenamed("chunk_id", "query_id").join(
        questions(t).select("query_id"), "query_id", "left_semi"
    )
    return dense.batch_top_k(vectors(t), asked, k)


def fused(t, k: int = POOL):
    return fusion.fuse(lexical_top(t, k), dense_top(t, k), k).withColumnRenamed("fused_rank", "ord")


def candidates(t, k: int = POOL):
    """The bounded hybrid pool of every question, with the chunk columns."""
    return fused(t, k).join(t.chunks().drop("ord"), "chunk_id")


def with_variants(df):
    ranks = F.filter(
        F.array(
            F.struct(F.lit(0).alias("k"), F.col("lexical_rank").alias("v")),
            F.struct(F.lit(1).alias("k"), F.col("dense_rank").alias("v")),
        ),
        lambda e: e["v"].isNotNull(),
    )
    return df.withColumn("primary_rank", F.col("lexical_rank")).withColumn("variant_ranks", F.map_from_entries(ranks))


def token_overlap_scores(pool, asked):
    """Offline stand-in for a cross-encoder: question-term overlap, as a probability.

    Only the bounded pool is tokenized: its rows carry the searchable columns. They are
    spread over all cores first, and an aggregate keeps the score from being computed anew
    wherever later filters and windows look at it.
    """
    terms = asked.select("query_id", F.array_distinct(tokens(F.col("question"))).alias("_terms"))
    lanes = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.size(F.array_intersect("_terms", lexical.searchable_terms(pool))) / F.size("_terms")
    row = F.struct(*[c for c in pool.columns if c not in ("query_id", "chunk_id")])
    scored = pool.join(terms, "query_id").repartition(lanes, "query_id", "chunk_id").groupBy("query_id", "chunk_id").agg(
        F.first(row).alias("_row"), F.max(share).alias("_share")
    )
    logit = F.lit(8.0) * F.col("_share") - F.lit(4.0)
    return scored.select("query_id", "chunk_id", "_row.*", F.round(1 / (1 + F.exp(-logit)), 6).alias("rerank_score"))


def reranked(t):
    return token_overlap_scores(candidates(t), questions(t))


# ---- scans ----------------------------------------------------------------------

@query("s1_vector_top_k", f"""
SELECT b.vec_id AS chunk_id, {COSINE.format(a='a.embedding', b='b.embedding')} AS score
FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, chunk_id LIMIT 25""")
def s1_vector_top_k(t):
    wanted = vectors(t).where(F.col("chunk_id") == 0).select("embedding")
    return dense.top_k(vectors(t), wanted, 25)


@query("s1_batch_vector_top_k", ctes(*DENSE_CTES) + "SELECT query_id, chunk_id, score, dense_rank FROM den")
def s1_batch(t):
    return dense_top(t).select("query_id", "chunk_id", "score", "dense_rank")


_AUTH_SQL = "project_id IN ('', 'ALPHA') AND access_policy_id IN ('', 'project:ALPHA', 'department:ALPHA:ops', 'user:42')"


@query("s2_scoped_dense", ctes("chunks") + f"""
SELECT b.vec_id AS chunk_id, source_type, {COSINE.format(a='a.embedding', b='b.embedding')} AS score
FROM embeddings a, embeddings b JOIN chunks ON chunk_id = b.vec_id
WHERE a.vec_id = 1 AND source_type IN ('PAGE', 'CODE') AND {_AUTH_SQL} AND schema_version = '4'
ORDER BY score DESC, chunk_id LIMIT 25""")
def s2_scoped_dense(t):
    wanted = vectors(t).where(F.col("chunk_id") == 1).select("embedding")
    scope = t.chunks().where(
        F.col("source_type").isin("PAGE", "CODE") & scans.authorized(PROJECT, CALLER_POLICIES)
        & (F.col("schema_version") == "4")
    ).select("chunk_id", "source_type")
    return dense.top_k(vectors(t).join(scope, "chunk_id"), wanted, 25)


@query("s3_bounded_scan", ctes("chunks", ("taken", """
SELECT *, CASE source_type WHEN 'PAGE' THEN 0 WHEN 'ATTACHMENT' THEN 1 WHEN 'ISSUE' THEN 2 ELSE 3 END AS priority
FROM chunks ORDER BY priority, source_type, ord LIMIT 400""")) + """
SELECT source_type, count(*) AS n, max(chunk_id) AS last_id, (SELECT count(*) FROM taken) >= 400 AS truncated
FROM taken GROUP BY 1""")
def s3_bounded_scan(t):
    return scans.bounded_scan(t.chunks(), 400).groupBy("source_type", "truncated").agg(
        F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("last_id")
    )


@query("s5_complete_snapshot", ctes("chunks") + f"""
SELECT source_type, CASE WHEN count(*) <= 100 THEN count(*) END AS n, count(*) <= 100 AS complete,
  CASE WHEN count(*) > 100 THEN 'SNAPSHOT_TRUNCATED' ELSE '' END AS reason FROM chunks WHERE {_AUTH_SQL} GROUP BY 1""")
def s5_complete_snapshot(t):
    return scans.complete_snapshots(t.chunks().where(scans.authorized(PROJECT, CALLER_POLICIES)), "source_type", 100)


_DECODE = f"""CASE WHEN length(page_content) = 0 THEN 'empty_text_field'
  WHEN NOT ({_AUTH_SQL}) THEN 'project_or_policy_mismatch'
  WHEN schema_version <> '4' THEN 'schema_version:expected=4,found=' ||
    CASE WHEN schema_version = '' THEN 'absent' ELSE schema_version END
  ELSE 'ACCEPTED' END"""


@query("s12_row_decoder", ctes("chunks") + f"""
SELECT CASE WHEN authority = 1 AND chunk_ordinal = 3 THEN 'below_score_threshold' ELSE {_DECODE} END AS reason,
  count(*) AS n FROM chunks GROUP BY 1""")
def s12_row_decoder(t):
    rows = scans.decoded(t.chunks()).withColumn(
        "score", F.when((F.col("authority") == 1) & (F.col("chunk_ordinal") == 3), 0.05).otherwise(0.0)
    ).withColumn("record_kind", F.lit(""))
    reason = scans.drop_reason(PROJECT, CALLER_POLICIES, "4", 0.2)
    return rows.groupBy(F.coalesce(reason, F.lit("ACCEPTED")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("s6_exact_identifier_lookup", ctes("chunks", ("want", """
SELECT item_id AS query_id, 'src' || (item_id % 20) || '#' || (item_id * 3) AS identifier FROM benchmark
UNION SELECT item_id, 'E' || (item_id % 97) FROM benchmark"""), ("found", """
SELECT query_id, identifier, chunk_id FROM want JOIN chunks ON identifier IN (reference, entity_key)
UNION SELECT query_id, identifier, chunk_id FROM want JOIN chunks ON contains(lower(page_content), lower(identifier))"""), ("scored", """
SELECT query_id, chunk_id, max(CAST((length(page_content) - length(replace(lower(page_content), lower(identifier), '')))
  / length(identifier) AS DOUBLE) + CASE WHEN upper(locator || ' ' || entity_key) LIKE '%' || upper(identifier)
  AND regexp_matches(upper(locator || ' ' || entity_key), '(^|[^A-Z0-9_-])' || upper(identifier) || '($|[^A-Z0-9_-])')
  THEN 120 ELSE 0 END) AS anchor_score FROM found JOIN chunks USING (chunk_id) GROUP BY ALL""")) + """
SELECT * FROM (SELECT query_id, chunk_id, anchor_score, row_number() OVER (PARTITION BY query_id
  ORDER BY anchor_score DESC, chunk_id) AS rn FROM scored) WHERE rn <= 12""")
def s6_exact_identifier_lookup(t):
    bench = t.read("benchmark")
    want = bench.selectExpr(
        "item_id AS query_id",
        "explode(array('src' || (item_id % 20) || '#' || (item_id * 3), 'E' || (item_id % 97))) AS identifier",
    )
    chunks = t.chunks().withColumn("structure_path", F.concat_ws(" ", "locator", "entity_key"))
    return scans.exact_identifier_lookup(chunks, want, ["reference", "entity_key"])


@query("s7_structure_lookup", ctes("chunks", ("want", "SELECT item_id AS query_id, 'L' || (item_id % 40) AS identifier FROM benchmark"),
    ("hit", "SELECT query_id, chunk_id, 120.0 + CAST((length(page_content) - length(replace(upper(page_content), identifier, ''))) "
     "/ length(identifier) AS DOUBLE) AS anchor_score FROM want JOIN chunks ON locator = identifier")) + """
SELECT * FROM (SELECT query_id, chunk_id, anchor_score, row_number() OVER (PARTITION BY query_id
  ORDER BY anchor_score DESC, chunk_id) AS rn FROM hit) WHERE rn <= 12""")
def s7_structure_lookup(t):
    want = t.read("benchmark").selectExpr("item_id AS query_id", "'L' || (item_id % 40) AS identifier")
    chunks = t.chunks().withColumn("structure_path", F.concat_ws(" / ", "title", "locator"))
    # path ids are whole words, so exploding the path makes the lookup an equi join
    paths = chunks.select("chunk_id", F.explode(F.array_distinct(F.split(F.upper("structure_path"), r"[^A-Z0-9_-]+"))).alias("identifier"))
    hit = paths.join(want, "identifier").join(chunks.select("chunk_id", "page_content", "title", "structure_path"), "chunk_id")
    scored = hit.withColumn("anchor_score", scans.anchor_score(F.col("identifier")))
    order = Window.partitionBy("query_id").orderBy(F.desc("anchor_score"), F.asc("chunk_id"))
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= 12).select(
        "query_id", "chunk_id", "anchor_score", "rn"
    )


@query("s10_siblings", ctes(*FUSE_CTES, ("hits", "SELECT * FROM cand WHERE ord <= 3"), ("m", """
SELECT DISTINCT h.query_id, c.chunk_id, c.source_id, c.chunk_ordinal FROM hits h JOIN chunks c
  ON c.source_id = h.source_id OR c.parent_id = h.parent_id""")) + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_id, chunk_ordinal, chunk_id) AS rn FROM m)
WHERE rn <= 9""")
def s10_siblings(t):
    return scans.siblings(t.chunks(), candidates(t).where(F.col("ord") <= 3), 3)


@query("s11_population", ctes("chunks") + """
SELECT entity_key, arg_min(chunk_id, ord) AS chunk_id, count(*) AS members FROM chunks
WHERE doc_category IN ('entity-contract', 'registry-table') AND entity_key <> '' AND lower(entity) IN ('', 'app1')
  AND (lower(page_content || ' ' || title) LIKE '%the%' OR lower(page_content || ' ' || title) LIKE '%que%') GROUP BY 1""")
def s11_population(t):
    return scans.population(t.chunks(), "app1", ("the", "que"))


@query("s9_issue_section_lookup", ctes("sections") + """
SELECT issue_key, event_id, chunk_ordinal FROM sections WHERE issue_key = 'ALPHA-12' AND section_kind = 'COMMENT'
ORDER BY ord LIMIT 64""")
def s9_issue_section_lookup(t):
    kept = t.sections().where((F.col("issue_key") == "ALPHA-12") & (F.col("section_kind") == "COMMENT"))
    return kept.orderBy("ord").limit(64).select("issue_key", "event_id", "chunk_ordinal")


# ---- policy filters -------------------------------------------------------------

@query("f1_policy_filter", ctes("chunks") + """
SELECT access_policy_id, count(*) AS n FROM chunks WHERE access_policy_id IN ('project:ALPHA', 'user:42') GROUP BY 1""")
def f1_policy_filter(t):
    return t.chunks().where(scans.policy_filter(["project:ALPHA", "user:42"])).groupBy("access_policy_id").agg(
        F.count(F.lit(1)).alias("n")
    )


def _policy_rows(t):
    return t.chunks().select("chunk_id", F.explode(F.array("access_policy_id", F.concat(F.lit("role:"), "project_id", F.lit(":r")))).alias("policy"))


_POLICY_SQL = "(SELECT chunk_id, unnest([access_policy_id, 'role:' || project_id || ':r']) AS policy FROM chunks)"


@query("f2_scope_reduction", ctes("chunks") + f"""
SELECT policy, count(*) AS n FROM {_POLICY_SQL} WHERE policy = 'project:ALPHA' OR starts_with(policy, 'department:ALPHA:')
  OR starts_with(policy, 'role:ALPHA:') OR starts_with(policy, 'user:') GROUP BY 1""")
def f2_scope_reduction(t):
    return scans.scope_rows(_policy_rows(t), "policy", PROJECT).groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


@query("f3_document_scope", ctes("chunks") + f"""
SELECT policy, count(*) AS n FROM {_POLICY_SQL} WHERE policy = 'project:ALPHA' OR starts_with(policy, 'department:ALPHA:')
GROUP BY 1""")
def f3_document_scope(t):
    return scans.scope_rows(_policy_rows(t), "policy", PROJECT, document_only=True).groupBy("policy").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("f4_candidate_authorization", ctes("chunks") + f"SELECT chunk_id FROM chunks WHERE {_AUTH_SQL}")
def f4_candidate_authorization(t):
    return t.chunks().where(scans.authorized(PROJECT, CALLER_POLICIES)).select("chunk_id")


# ---- lexical --------------------------------------------------------------------

@query("p6_searchable_text", ctes("chunks") + f"SELECT chunk_id, {SEARCHABLE} AS searchable FROM chunks")
def p6_searchable_text(t):
    chunks = t.chunks()
    return chunks.select("chunk_id", lexical.searchable_text(chunks).alias("searchable"))


@query("a10_term_index", ctes(*LEX_CTES[:4]) + """
SELECT term, df, (SELECT sum(tf) FROM post p WHERE p.term = dfs.term) AS cf FROM dfs""")
def a10_term_index(t):
    rows = lexical.postings(lexical.prepared(t.chunks()))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("j1_postings_join", ctes(*LEX_CTES[:6]) + """
SELECT term, count(*) AS hits, sum(tf) AS tf, max(df) AS df FROM post JOIN dfs USING (term)
WHERE term IN (SELECT term FROM qt) GROUP BY 1""")
def j1_postings_join(t):
    hits = lexical.postings(lexical.prepared(t.chunks()), lexical.query_terms(questions(t)))
    # folded to one row per term before the join: a frequent term is never one hot key
    folded = hits.groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.sum("tf").alias("tf"))
    return folded.join(lexical.document_frequency(hits), "term")


@query("a11_bm25_top_k", ctes(*LEX_CTES) + "SELECT query_id, chunk_id, lexical_score, lexical_rank FROM lex")
def a11_bm25_top_k(t):
    return lexical_top(t)


@query("l4_bm25_order", ctes(*LEX_CTES) + "SELECT query_id, lexical_rank, chunk_id FROM lex WHERE lexical_rank <= 10")
def l4_bm25_order(t):
    return lexical_top(t, 10).select("query_id", "lexical_rank", "chunk_id")


@query("w12_max_normalise", ctes(*LEX_CTES) + """
SELECT query_id, chunk_id, round(lexical_score / max(lexical_score) OVER (PARTITION BY query_id), 6) AS score FROM lex""")
def w12_max_normalise(t):
    return lexical.max_normalised(lexical_top(t)).select("query_id", "chunk_id", "score")


@query("a12_rare_terms", ctes(*LEX_CTES[:5], ("th", "SELECT quantile_disc(df, 0.1) AS v FROM dfs"), ("w", f"""
SELECT query_id, unnest(tk) AS term, generate_subscripts(tk, 1) AS pos FROM (SELECT query_id, {sql_tokens('question')} AS tk FROM q)"""),
    ("u", "SELECT query_id, term, min(pos) AS pos FROM w WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY 1, 2")) + """
SELECT * FROM (SELECT query_id, term, df, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn
FROM u JOIN dfs USING (term) WHERE df <= (SELECT v FROM th)) WHERE rn <= 5""")
def a12_rare_terms(t):
    return lexical.rare_query_terms(t.chunks(), questions(t))


# ---- fusion ---------------------------------------------------------------------

@query("a13_rrf", ctes(*FUSE_CTES) + "SELECT query_id, chunk_id, fusion_score, ord AS rn FROM fused")
def a13_rrf(t):
    return fused(t).select("query_id", "chunk_id", "fusion_score", F.col("ord").alias("rn"))


@query("j2_full_outer_identity", ctes(*FUSE_CTES) + """
SELECT query_id, count(*) AS n, count(lexical_rank) AS lexical, count(dense_rank) AS dense,
  count(*) FILTER (WHERE lexical_rank IS NOT NULL AND dense_rank IS NOT NULL) AS both FROM fu GROUP BY 1""")
def j2_full_outer_identity(t):
    joined = lexical_top(t).join(dense_top(t), ["query_id", "chunk_id"], "full_outer")
    both = F.col("lexical_rank").isNotNull() & F.col("dense_rank").isNotNull()
    return joined.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("lexical_rank").alias("lexical"),
        F.count("dense_rank").alias("dense"), F.count(F.when(both, 1)).alias("both"),
    )


@query("w1_channel_rank", ctes(*LEX_CTES, *DENSE_CTES) + """
SELECT 'lexical' AS channel, query_id, chunk_id, lexical_rank AS rank FROM lex
UNION ALL SELECT 'dense', query_id, chunk_id, dense_rank FROM den""")
def w1_channel_rank(t):
    return lexical_top(t).select(
        F.lit("lexical").alias("channel"), "query_id", "chunk_id", F.col("lexical_rank").alias("rank")
    ).unionByName(dense_top(t).select(F.lit("dense").alias("channel"), "query_id", "chunk_id", F.col("dense_rank").alias("rank")))


@query("l1_fused_order", ctes(*FUSE_CTES) + """
SELECT query_id, ord AS rn, chunk_id, coalesce(lexical_score, 0) AS lexical_score, coalesce(score, 0) AS score
FROM fused WHERE ord <= 12""")
def l1_fused_order(t):
    return fused(t).where(F.col("ord") <= 12).select(
        "query_id", F.col("ord").alias("rn"), "chunk_id",
        F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


@query("a14_multi_query_fusion", ctes(*FUSE_CTES) + """
SELECT query_id, chunk_id, round(coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0), 9) AS rrf_score,
  coalesce(score, 0) AS score, lexical_rank AS primary_rank,
  array_to_string(list_filter(['0=' || lexical_rank, '1=' || dense_rank], lambda x: x IS NOT NULL), ',') AS ranks FROM fu""")
def a14_multi_query_fusion(t):
    runs = lexical_top(t).select(
        "query_id", F.lit(0).alias("variant"), F.col("lexical_rank").alias("rank"), "chunk_id", F.lit(0.0).alias("score")
    ).unionByName(
        dense_top(t).select("query_id", F.lit(1).alias("variant"), F.col("dense_rank").alias("rank"), "chunk_id", "score")
    )
    shown = F.transform(
        F.map_entries("variant_ranks"),
        lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")),
    )
    return fusion.multi_query(runs).withColumn("ranks", F.array_join(shown, ",")).drop("variant_ranks")


# ---- candidate windows ----------------------------------------------------------

_BODY = "replace(lower(trim(regexp_replace(page_content, '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query("w2_body_dedup", ctes(*FUSE_CTES, ("g", f"""
SELECT query_id, CASE WHEN source_type = 'ISSUE' THEN source_id || ':' || locator || ':' || {_BODY} ELSE {_BODY} END AS body,
  list(reference ORDER BY ord) AS refs, arg_min(chunk_id, ord) AS chunk_id, min(ord) AS ord FROM cand GROUP BY 1, 2""")) + """
SELECT query_id, ord, chunk_id, coalesce(array_to_string(refs[2:], '|'), '') AS duplicate_references FROM g""")
def w2_body_dedup(t):
    pool = candidates(t)
    return R.dedup_bodies(pool, issue_like=F.col("source_type") == "ISSUE").select(
        "query_id", "ord", "chunk_id", "duplicate_references"
    )


_FRESH = ("{'o': observed_at, 'n': list_transform(regexp_extract_all(source_version, '\\d+'), lambda x: CAST(x AS BIGINT)), "
          "'v': lower(source_version)}")
_ENTITY = "coalesce(nullif(entity_key, ''), parent_id)"


@query("w3_authoritative_versions", ctes("chunks", ("r", f"""
SELECT chunk_id, {_ENTITY} AS entity, rank() OVER (PARTITION BY {_ENTITY} ORDER BY authority DESC, {_FRESH} DESC) AS rk
FROM chunks""")) + "SELECT entity, chunk_id FROM r WHERE rk = 1")
def w3_authoritative_versions(t):
    entity = F.coalesce(F.nullif("entity_key", F.lit("")), "parent_id")
    kept = R.keep_latest_authoritative(t.chunks(), entity)
    return kept.select(entity.alias("entity"), "chunk_id")


_EXACT_TERMS_SQL = "list_slice(list_sort(terms), 1, 6)"


@query("w11_source_volume_discount", ctes(*FUSE_CTES) + """
SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id, source_id) AS source_candidates,
  round(fusion_score / (1 + 0.15 * ln(count(*) OVER (PARTITION BY query_id, source_id))), 9) AS retrieval_score FROM cand""")
def w11_source_volume_discount(t):
    return R.source_volume_discount(candidates(t), F.col("fusion_score"), 0.15).select(
        "query_id", "chunk_id", "source_candidates", "retrieval_score"
    )


_WEAK_SQL = "coalesce(score, 0) < 0.30 AND lexical_rank IS NULL"


@query("f7_prefilter", ctes(*FUSE_CTES, ("p", f"""
SELECT *, count(*) OVER (PARTITION BY query_id) AS pool,
  count(*) FILTER (WHERE doc_category <> 'index') OVER (PARTITION BY query_id) AS quality,
  (doc_category <> 'index' AND {_WEAK_SQL}) AS weak FROM cand"""), ("s", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN weak AND pool >= 8 THEN 0 ELSE 1 END,
  coalesce(score, 0), ord) AS pos FROM p""")) + """
SELECT query_id, chunk_id, CASE WHEN doc_category = 'index' THEN 'index'
  WHEN weak AND pool >= 8 AND pos <= floor(quality * 0.34) THEN 'zero_overlap_low_dense' ELSE 'KEEP' END AS verdict FROM s""")
def f7_prefilter(t):
    structural = F.when(F.col("doc_category") == "index", F.lit("index"))
    weak = (F.coalesce("score", F.lit(0.0)) < 0.30) & F.col("lexical_rank").isNull()
    return R.prefilter(candidates(t), weak, structural).select("query_id", "chunk_id", "verdict")


@query("c3_threshold_rerank", ctes(*RERANK_CTES, ("capped", """
SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY rerank_score DESC, ord) AS sr FROM rr WHERE rerank_score >= 0.6""")) + """
SELECT * FROM (SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, ord) AS rn
FROM capped WHERE sr <= 2) WHERE rn <= 12""")
def c3_threshold_rerank(t):
    passed = R.threshold_with_exceptions(reranked(t), F.lit(0.6), F.lit(False))
    return R.per_source_cap(passed, cap=2, limit=12).select("query_id", "chunk_id", "rerank_score", "rn")


_CROSS = "CASE WHEN language IN ('de', 'fr') THEN least(0.9, 0.7) ELSE 0.9 END"


@query("f8_threshold_exceptions", ctes(*RERANK_CTES, ("p", f"""
SELECT *, (rerank_score >= {_CROSS} OR (source_type = 'CODE' AND rerank_score >= 0.85)) AS ok FROM rr"""), ("b", """
SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok,
  row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, ord) AS pl FROM p""")) + """
SELECT query_id, chunk_id, NOT any_ok AS bypassed FROM b WHERE ok OR (NOT any_ok AND pl <= 5)""")
def f8_threshold_exceptions(t):
    threshold = F.when(F.col("language").isin("de", "fr"), F.least(F.lit(0.9), F.lit(0.7))).otherwise(F.lit(0.9))
    code = (F.col("source_type") == "CODE") & (F.col("rerank_score") >= 0.85)
    kept = R.threshold_with_exceptions(reranked(t), threshold, code, bypass_empty=True, top_n=5)
    return kept.select("query_id", "chunk_id", "bypassed")


@query("f9_preserve_non_empty", ctes(*RERANK_CTES, ("b", """
SELECT *, bool_or(rerank_score >= 0.93) OVER (PARTITION BY query_id) AS any_ok FROM rr""")) + """
SELECT query_id, chunk_id, NOT any_ok AS bypassed FROM b WHERE rerank_score >= 0.93 OR NOT any_ok""")
def f9_preserve_non_empty(t):
    return R.preserve_non_empty(reranked(t), F.col("rerank_score") >= 0.93).select("query_id", "chunk_id", "bypassed")


@query("w4_source_cap", ctes(*RERANK_CTES, ("capped", """
SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY rerank_score DESC, ord) AS sr FROM rr""")) + """
SELECT * FROM (SELECT query_id, chunk_id, sr AS source_rank, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, ord) AS rn
FROM capped WHERE sr <= 3) WHERE rn <= 16""")
def w4_source_cap(t):
    return R.per_source_cap(reranked(t), cap=3, limit=16).select("query_id", "chunk_id", "source_rank", "rn")


@query("w5_source_diverse", ctes(*FUSE_CTES, ("n", """
SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY ord) AS sr FROM cand""")) + """
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sr > 1, ord) AS rn FROM n""")
def w5_source_diverse(t):
    return R.source_diverse(candidates(t)).select("query_id", "chunk_id", "rn")


@query("l7_final_evidence_order", ctes(*FUSE_CTES, ("n", """
SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY ord) AS sr FROM cand"""), ("r", """
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 2 = 0 THEN false ELSE sr > 1 END, ord) AS rn FROM n""")) + """
SELECT query_id, chunk_id, rn FROM r WHERE rn <= 12""")
def l7_final_evidence_order(t):
    enumeration = F.col("query_id") % 2 == 0
    nth = F.row_number().over(Window.partitionBy("query_id", "source_id").orderBy("ord"))
    late = F.when(enumeration, F.lit(False)).otherwise(F.col("_nth") > 1)
    return R.rank_by(candidates(t).withColumn("_nth", nth), "rn", late.asc(), F.col("ord").asc()).where(
        F.col("rn") <= 12
    ).select("query_id", "chunk_id", "rn")


@query("w6_round_robin_families", ctes(*FUSE_CTES, ("d", """
SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY fusion_score DESC, coalesce(lexical_score, 0) DESC,
  coalesce(score, 0) DESC, ord) AS depth FROM cand"""), ("h", """
SELECT query_id, source_type, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, coalesce(lexical_score, 0) DESC,
  coalesce(score, 0) DESC, ord) AS fr FROM d WHERE depth = 1"""), ("m", """
SELECT d.query_id, chunk_id, source_type, row_number() OVER (PARTITION BY d.query_id ORDER BY depth, fr) AS rn
FROM d JOIN h USING (query_id, source_type)""")) + "SELECT query_id, chunk_id, source_type AS family, rn FROM m WHERE rn <= 16")
def w6_round_robin_families(t):
    order = [
        F.desc("fusion_score"), F.coalesce("lexical_score", F.lit(0.0)).desc(),
        F.coalesce("score", F.lit(0.0)).desc(), F.asc("ord"),
    ]
    return R.round_robin(candidates(t), F.col("source_type"), order, order, limit=16).select(
        "query_id", "chunk_id", "family", "rn"
    )


@query("w6_overview_buckets", ctes(*FUSE_CTES, ("n", """
SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY ord) AS sr,
  CASE WHEN entity <> '' THEN 'entity:' || entity ELSE 'category:' || doc_category END AS topic FROM cand"""), ("o", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sr > 1, ord) AS dv FROM n"""), ("d", """
SELECT *, row_number() OVER (PARTITION BY query_id, topic ORDER BY dv) AS depth, min(dv) OVER (PARTITION BY query_id, topic) AS head FROM o""")) + """
SELECT query_id, chunk_id, topic AS family, row_number() OVER (PARTITION BY query_id ORDER BY depth, head) AS rn FROM d""")
def w6_overview_buckets(t):
    topic = F.when(F.col("entity") != "", F.concat(F.lit("entity:"), "entity")).otherwise(
        F.concat(F.lit("category:"), "doc_category")
    )
    diverse = R.source_diverse(candidates(t), name="dv")
    return R.round_robin(diverse, topic, [F.asc("dv")], [F.asc("dv")]).select("query_id", "chunk_id", "family", "rn")


_VARIANT_CTES = (
    ("pr", "SELECT query_id, chunk_id, 0 AS c, 0 AS v, rn AS o FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
     "ORDER BY lexical_rank, ord) AS rn FROM cand WHERE lexical_rank IS NOT NULL) WHERE rn <= 4"),
    ("va", "SELECT query_id, chunk_id, 1 AS c, v, rn AS o FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY r, ord) AS rn "
     "FROM (SELECT query_id, chunk_id, ord, 0 AS v, lexical_rank AS r FROM cand WHERE lexical_rank IS NOT NULL "
     "UNION ALL SELECT query_id, chunk_id, ord, 1, dense_rank FROM cand WHERE dense_rank IS NOT NULL)) WHERE rn <= 8"),
    ("al", "SELECT query_id, chunk_id, min({'c': c, 'v': v, 'o': o}) AS place FROM (SELECT * FROM pr UNION ALL SELECT * FROM va "
     "UNION ALL SELECT query_id, chunk_id, 2, 0, ord FROM cand) GROUP BY 1, 2"),
)


@query("w7_preserve_primary", ctes(*FUSE_CTES, *_VARIANT_CTES) + """
SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rn FROM al) WHERE rn <= 20""")
def w7_preserve_primary(t):
    return R.preserve_candidates(with_variants(candidates(t)), limit=20).select("query_id", "chunk_id", "rn")


@query("w8_parent_window", ctes(*FUSE_CTES, ("fam", """
SELECT cand.query_id, chunks.chunk_id, chunks.parent_id, chunks.chunk_ordinal, bool_or(cand.chunk_id = chunks.chunk_id) AS anchor
FROM cand JOIN chunks ON cand.parent_id = chunks.parent_id WHERE cand.ord <= 3 GROUP BY ALL"""), ("i", """
SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY chunk_ordinal, chunk_id) AS i,
  count(*) OVER (PARTITION BY query_id, parent_id) AS size FROM fam"""), ("a", """
SELECT *, min(CASE WHEN anchor THEN i END) OVER (PARTITION BY query_id, parent_id) AS a FROM i""")) + """
SELECT query_id, parent_id, chunk_id FROM a
WHERE i BETWEEN greatest(1, least(a - 2, size - 3)) AND greatest(1, least(a - 2, size - 3)) + 3""")
def w8_parent_window(t):
    anchors = candidates(t).where(F.col("ord") <= 3).select(
        "query_id", "parent_id", F.col("chunk_id").alias("anchor_id")
    )
    family = anchors.join(t.chunks().select("parent_id", "chunk_id", "chunk_ordinal"), "parent_id")
    family = family.groupBy("query_id", "parent_id", "chunk_id", "chunk_ordinal").agg(
        F.max(F.col("anchor_id") == F.col("chunk_id")).alias("anchor")
    )
    return R.centered_window(family, F.col("anchor"), 4).select("query_id", "parent_id", "chunk_id")


_ANCHOR_SQL = "chunk_id % 9 = 0"


@query("w15_anchor_preservation", ctes(*RERANK_CTES, ("p", f"""
SELECT *, {_ANCHOR_SQL} AS an, row_number() OVER (PARTITION BY query_id ORDER BY ({_ANCHOR_SQL}) DESC, chunk_id % 50 DESC, ord) AS pl FROM rr"""), ("o", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN an AND pl <= 3 THEN pl END NULLS LAST, ord) AS rn FROM p""")) + """
SELECT query_id, chunk_id, rn, CASE WHEN an THEN 1.0 ELSE rerank_score END AS rerank_score FROM o WHERE rn <= 12""")
def w15_anchor_preservation(t):
    kept = R.anchors_first(reranked(t), F.col("chunk_id") % 9 == 0, F.col("chunk_id") % 50, top_n=12)
    return kept.select("query_id", "chunk_id", "rn", "rerank_score")


@query("w16_progressive_narrowing", ctes(*FUSE_CTES, ("k", f"""
SELECT *, {_ANCHOR_SQL} AS an, (lexical_rank <= 6 OR dense_rank <= 6) AS rv FROM cand"""), ("p", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY an DESC, coalesce(rv, false) DESC,
  CASE WHEN rv THEN coalesce(CASE WHEN lexical_rank <= 6 THEN lexical_rank END, dense_rank) END NULLS LAST,
  fusion_score DESC, coalesce(lexical_score, 0) DESC, coalesce(score, 0) DESC, ord) AS pos FROM k"""), ("c", """
SELECT *, CASE WHEN an OR coalesce(rv, false) THEN 0 WHEN row_number() OVER (PARTITION BY query_id, source_type ORDER BY pos) = 1 THEN 1
  ELSE 2 END AS cl FROM p"""), ("r", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cl, pos) AS rn FROM c")) + """
SELECT query_id, chunk_id, rn FROM r WHERE rn <= 16""")
def w16_progressive_narrowing(t):
    pool = with_variants(candidates(t)).withColumn(
        "variant_ranks", F.map_filter("variant_ranks", lambda k, v: v <= 6)
    ).withColumn("primary_rank", F.when(F.col("lexical_rank") <= 6, F.col("lexical_rank")))
    pool = pool.withColumn("retrieval_score", F.lit(0.0))
    return R.progressive_narrowing(pool, F.col("chunk_id") % 9 == 0, 16).select("query_id", "chunk_id", "rn")


@query("w18_language_preference", ctes(*FUSE_CTES) + """
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN language = 'en' THEN 0
  WHEN language = 'fr' THEN 1 ELSE 2 END, ord) AS rn FROM cand""")
def w18_language_preference(t):
    place = F.when(F.col("language") == "en", 0).when(F.col("language") == "fr", 1).otherwise(2)
    return R.rank_by(candidates(t), "rn", place.asc(), F.col("ord").asc()).select("query_id", "chunk_id", "rn")


@query("a15_fused_rerank", ctes(*RERANK_CTES, ("g", """
SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id, source_type ORDER BY rerank_score DESC, ord) AS rank, ord FROM rr
UNION ALL SELECT query_id, chunk_id, round(rerank_score / 2, 6), row_number() OVER (PARTITION BY query_id ORDER BY ord), 1000 + ord FROM rr"""), ("f", """
SELECT query_id, chunk_id, max(rerank_score) AS rerank_score, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, min(ord) AS arrival FROM g GROUP BY 1, 2""")) + """
SELECT * FROM (SELECT query_id, chunk_id, rerank_score, rrf_score, row_number() OVER (PARTITION BY query_id
  ORDER BY round(rerank_score + rrf_score, 9) DESC, rerank_score DESC, arrival) AS rn FROM f) WHERE rn <= 12""")
def a15_fused_rerank(t):
    pool = reranked(t).select("query_id", "chunk_id", "source_type", "rerank_score", "ord")
    by_type = Window.partitionBy("query_id", "source_type").orderBy(F.desc("rerank_score"), "ord")
    first = pool.select("query_id", "chunk_id", "rerank_score", F.row_number().over(by_type).alias("rank"), F.col("ord").alias("arrival"))
    second = pool.select(
        "query_id", "chunk_id", F.round(F.col("rerank_score") / 2, 6).alias("rerank_score"),
        F.row_number().over(Window.partitionBy("query_id").orderBy("ord")).alias("rank"), (F.col("ord") + 1000).alias("arrival"),
    )
    return fusion.fuse_reranked(first.unionByName(second), 12).drop("arrival")


@query("a16_context_quality", ctes(*RERANK_CTES, ("top", "SELECT * FROM rr WHERE ord <= 12")) + """
SELECT query_id, CASE WHEN max(rerank_score) >= 0.25 OR max(coalesce(lexical_score, 0)) > 0 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS quality, CAST(round_even(least(max(rerank_score), 1.0), 3) AS DOUBLE) AS relevance,
  CAST(round_even(least(1.0, count(*) / 2.0 + least(max(coalesce(lexical_score, 0)) / 4, 0.5)), 3) AS DOUBLE) AS completeness,
  CASE WHEN max(rerank_score) >= 0.25 OR max(coalesce(lexical_score, 0)) > 0 THEN '' ELSE 'LOW_RELEVANCE' END AS failure_reason FROM top GROUP BY 1""")
def a16_context_quality(t):
    return R.context_quality(reranked(t).where(F.col("ord") <= 12))


@query("c4_cross_source_rerank", ctes(*RERANK_CTES, ("f", """
SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY rerank_score DESC, ord) AS rn0 FROM rr
WHERE source_type IN ('PAGE', 'CODE')""")) + """
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rn0, source_type DESC) AS rn FROM f""")
def c4_cross_source_rerank(t):
    pool = reranked(t).where(F.col("source_type").isin("PAGE", "CODE"))
    nth = F.row_number().over(Window.partitionBy("query_id", "source_type").orderBy(F.desc("rerank_score"), "ord"))
    return R.rank_by(pool.withColumn("depth", nth), "rn", F.asc("depth"), F.desc("source_type")).select(
        "query_id", "chunk_id", "rn"
    )


@query("c5_code_slots", ctes(*RERANK_CTES, ("s", """
SELECT query_id, chunk_id, ord, rerank_score, source_type = 'CODE' AS code,
  row_number() OVER (PARTITION BY query_id, source_type = 'CODE' ORDER BY ord) AS slot,
  row_number() OVER (PARTITION BY query_id, source_type = 'CODE' ORDER BY rerank_score DESC, ord) AS better FROM rr""")) + """
SELECT a.query_id, a.ord AS rn, CASE WHEN a.code THEN b.chunk_id ELSE a.chunk_id END AS chunk_id
FROM s a JOIN s b ON a.query_id = b.query_id AND a.code = b.code AND a.slot = b.better""")
def c5_code_slots(t):
    code = F.col("source_type") == "CODE"
    pool = reranked(t).select("query_id", "chunk_id", "ord", "rerank_score", code.alias("code"))
    w = Window.partitionBy("query_id", "code")
    slots = pool.select("query_id", "code", "chunk_id", "ord", F.row_number().over(w.orderBy("ord")).alias("slot"))
    better = pool.select(
        "query_id", "code", F.col("chunk_id").alias("better_id"),
        F.row_number().over(w.orderBy(F.desc("rerank_score"), "ord")).alias("slot"),
    )
    placed = slots.join(better, ["query_id", "code", "slot"])
    return placed.select(
        "query_id", F.col("ord").alias("rn"),
        F.when(F.col("code"), F.col("better_id")).otherwise(F.col("chunk_id")).alias("chunk_id"),
    )


@query("c8_source_document_dedup", ctes(*FUSE_CTES) + """
SELECT query_id, source_type, source_id, arg_min(chunk_id, ord) AS chunk_id, min(ord) AS ord FROM cand
GROUP BY query_id, source_type, source_id, CASE WHEN source_type = 'ISSUE' THEN locator ELSE '' END""")
def c8_source_document_dedup(t):
    locator = F.when(F.col("source_type") == "ISSUE", F.col("locator")).otherwise(F.lit(""))
    return candidates(t).groupBy("query_id", "source_type", "source_id", locator.alias("l")).agg(
        F.min_by("chunk_id", "ord").alias("chunk_id"), F.min("ord").alias("ord")
    ).drop("l")


@query("c9_cheap_score_order", ctes(*FUSE_CTES) + f"""
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY ({_ANCHOR_SQL}) DESC, fusion_score DESC,
  coalesce(lexical_score, 0) DESC, coalesce(score, 0) DESC, ord) AS rn FROM cand""")
def c9_cheap_score_order(t):
    order = [
        (F.col("chunk_id") % 9 == 0).desc(), F.desc("fusion_score"), F.coalesce("lexical_score", F.lit(0.0)).desc(),
        F.coalesce("score", F.lit(0.0)).desc(), F.asc("ord"),
    ]
    return R.rank_by(candidates(t), "rn", *order).select("query_id", "chunk_id", "rn")


@query("j3_requests_by_scope", """
SELECT item_id AS query_id, unnest(['PAGE', 'CODE', 'PAGE,CODE']) AS scope FROM benchmark""")
def j3_requests_by_scope(t):
    scopes = F.array(*[F.lit(s) for s in ("PAGE", "CODE", "PAGE,CODE", "PAGE")])
    return questions(t).select("query_id", F.explode(F.array_distinct(scopes)).alias("scope"))


@query("j4_siblings_by_parent", ctes(*FUSE_CTES) + """
SELECT query_id, cand.parent_id, count(DISTINCT chunks.chunk_id) AS siblings FROM cand JOIN chunks ON cand.parent_id = chunks.parent_id
WHERE cand.ord <= 5 GROUP BY 1, 2""")
def j4_siblings_by_parent(t):
    parents = candidates(t).where(F.col("ord") <= 5).select("query_id", "parent_id").distinct()
    sizes = t.chunks().join(parents.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("siblings")
    )
    return parents.join(sizes, "parent_id").select("query_id", "parent_id", "siblings")


@query("j5_neighbor_join", ctes(*FUSE_CTES) + """
SELECT a.query_id, a.chunk_id AS anchor_id, b.chunk_id AS chunk_id FROM cand a JOIN cand b ON a.query_id = b.query_id
  AND a.parent_id = b.parent_id AND a.language = b.language AND abs(a.chunk_ordinal - b.chunk_ordinal) = 1 WHERE a.ord <= 12""")
def j5_neighbor_join(t):
    pool = candidates(t).withColumn("source_version", F.col("language"))  # editions that neighbours can share
    return scans.neighbor_pairs(pool, pool.where(F.col("ord") <= 12)).select("query_id", "anchor_id", "chunk_id")


@query("j5_neighbor_expand", None)
def j5_neighbor_expand(t):
    """Sequential caps: checked against a direct computation in the tests."""
    return expand_neighbors(candidates(t).withColumn("source_version", F.col("language")), 16, 2, 3)


@query("u2_union_precedence", ctes(*FUSE_CTES, ("u", """
SELECT query_id, chunk_id, 0 AS c, ord AS o FROM cand WHERE source_type = 'PAGE'
UNION ALL SELECT query_id, chunk_id, 1, lexical_rank FROM cand WHERE lexical_rank <= 10 UNION ALL SELECT query_id, chunk_id, 2, ord FROM cand""")) + """
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rn FROM (
SELECT query_id, chunk_id, min({'c': c, 'o': o}) AS place FROM u GROUP BY 1, 2)""")
def u2_union_precedence(t):
    pool = candidates(t)
    parts = [
        pool.where(F.col("source_type") == "PAGE").select("query_id", "chunk_id", F.struct(F.lit(0).alias("c"), F.col("ord").alias("o")).alias("p")),
        pool.where(F.col("lexical_rank") <= 10).select("query_id", "chunk_id", F.struct(F.lit(1).alias("c"), F.col("lexical_rank").alias("o")).alias("p")),
        pool.select("query_id", "chunk_id", F.struct(F.lit(2).alias("c"), F.col("ord").alias("o")).alias("p")),
    ]
    merged = reduce(lambda a, b: a.unionByName(b), parts).groupBy("query_id", "chunk_id").agg(F.min("p").alias("p"))
    return R.rank_by(merged, "rn", F.asc("p")).select("query_id", "chunk_id", "rn")


@query("c2_hybrid_retrieve", ctes(*FUSE_CTES, ("au", f"SELECT * FROM cand WHERE {_AUTH_SQL} AND doc_category <> 'index'"), ("dd", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {_BODY} ORDER BY ord) AS b FROM au) WHERE b = 1"""), ("vs", f"""
SELECT * FROM (SELECT *, rank() OVER (PARTITION BY query_id, {_ENTITY} ORDER BY authority DESC, {_FRESH} DESC) AS rk FROM dd) WHERE rk = 1"""), ("ds", """
SELECT *, round(fusion_score / (1 + 0.15 * ln(count(*) OVER (PARTITION BY query_id, source_id))), 9) AS rs FROM vs""")) + """
SELECT * FROM (SELECT query_id, chunk_id, rs AS retrieval_score, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, ord) AS rn FROM ds)
WHERE rn <= 20""")
def c2_hybrid_retrieve(t):
    pool = candidates(t).where(scans.authorized(PROJECT, CALLER_POLICIES) & (F.col("doc_category") != "index"))
    pool = R.dedup_bodies(pool)
    entity = F.coalesce(F.nullif("entity_key", F.lit("")), "parent_id")
    pool = R.keep_latest_authoritative(pool, entity, ["query_id"])
    pool = R.source_volume_discount(pool, F.col("fusion_score"), 0.15)
    return R.rank_by(pool, "rn", F.desc("retrieval_score"), F.asc("ord")).where(F.col("rn") <= 20).select(
        "query_id", "chunk_id", "retrieval_score", "rn"
    )
