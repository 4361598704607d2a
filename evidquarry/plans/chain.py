"""Registered query: the whole retrieval chain in one plan."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from evidquarry.operators import fusion, lexical, ranking as R, scans
from evidquarry.plans.registry import ctes, query
from evidquarry.plans.retrieval import _AUTH_SQL, _BODY, CHUNK_META, DENSE_CTES, LEX_CTES, POOL, dense_top, questions, sql_tokens
from evidquarry.session import shared_path
from evidquarry.sources.tables import CALLER_POLICIES, PROJECT

KEPT, EXACT = 20, 3

_CHAIN = (
    *LEX_CTES, *DENSE_CTES,
    ("q2", "SELECT query_id, substr(question, length(question) // 2 + 1) AS question FROM q"),
    ("qt2", f"SELECT DISTINCT query_id, unnest({sql_tokens('question')}) AS term FROM q2"),
    ("sc2", "SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS lexical_score "
     "FROM qt2 JOIN post USING (term) JOIN dfs USING (term), st GROUP BY ALL"),
    ("lex2", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) AS lexical_rank FROM sc2) WHERE lexical_rank <= {POOL}"),
    ("rn", "SELECT query_id, chunk_id, 0 AS v, lexical_rank AS r, 0.0 AS s FROM lex UNION ALL SELECT query_id, chunk_id, 1, lexical_rank, 0.0 FROM lex2 "
     "UNION ALL SELECT query_id, chunk_id, 2, dense_rank, score FROM den"),
    ("mq", "SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS rrf, max(s) AS score, min(r) FILTER (WHERE v = 0) AS pr FROM rn GROUP BY 1, 2"),
    ("od", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, score DESC, chunk_id) AS ord FROM mq) WHERE ord <= {POOL}"),
    ("pl", f"SELECT od.*, {CHUNK_META} FROM od JOIN (SELECT * EXCLUDE (ord) FROM chunks) USING (chunk_id) WHERE {_AUTH_SQL} AND doc_category <> 'index'"),
    ("dd", f"SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY query_id, {_BODY} ORDER BY ord) = 1"),
    ("pw", "SELECT *, score < 0.30 AND pr IS NULL AS weak, count(*) OVER (PARTITION BY query_id) AS pool FROM dd"),
    ("ps", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN weak AND pool >= 8 THEN 0 ELSE 1 END, score, ord) AS pos FROM pw"),
    ("kp", "SELECT * FROM ps WHERE NOT (weak AND pool >= 8 AND pos <= floor(pool * 0.34))"),
    ("al", f"""SELECT query_id, chunk_id, min(place) AS place FROM (
      SELECT query_id, chunk_id, {{'c': 0, 'v': 0, 'o': k}} AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pr, ord) AS k FROM kp WHERE pr IS NOT NULL) WHERE k <= 4
      UNION ALL SELECT query_id, chunk_id, {{'c': 1, 'v': v, 'o': k}} FROM (SELECT kp.query_id, kp.chunk_id, v, row_number() OVER (PARTITION BY kp.query_id, v ORDER BY r, ord) AS k FROM kp JOIN rn USING (query_id, chunk_id)) WHERE k <= 8
      UNION ALL SELECT query_id, chunk_id, {{'c': 2, 'v': 0, 'o': ord}} FROM kp) GROUP BY 1, 2"""),
    ("pv", f"SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM al) WHERE k <= {KEPT}"),
    ("want", "SELECT item_id AS query_id, 'src' || (item_id % 20) || '#' || (item_id * 3) AS identifier FROM benchmark UNION SELECT item_id, 'E' || (item_id % 97) FROM benchmark"),
    ("ac", f"SELECT * FROM chunks WHERE {_AUTH_SQL}"),
    ("fo", "SELECT query_id, identifier, chunk_id FROM want JOIN ac ON identifier IN (reference, entity_key) OR contains(lower(page_content), lower(identifier))"),
    ("sx", """SELECT query_id, chunk_id, max(CAST((length(page_content) - length(replace(lower(page_content), lower(identifier), ''))) / length(identifier) AS DOUBLE)
      + CASE WHEN regexp_matches(upper(locator || ' ' || entity_key), '(^|[^A-Z0-9_-])' || upper(identifier) || '($|[^A-Z0-9_-])') THEN 120 ELSE 0 END) AS a FROM fo JOIN ac USING (chunk_id) GROUP BY ALL"""),
    ("ex", f"SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, chunk_id) AS k FROM sx) WHERE k <= {EXACT}"),
    ("un", "SELECT query_id, chunk_id, min({'l': lane, 'k': k}) AS p FROM (SELECT query_id, chunk_id, 0 AS lane, k FROM ex UNION ALL SELECT query_id, chunk_id, 1, k FROM pv) GROUP BY 1, 2"),
)


@query("c2_full_chain", ctes(*_CHAIN) + f"""
SELECT * FROM (SELECT query_id, chunk_id, p.l AS lane, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rn FROM un) WHERE rn <= {KEPT}""")
def c2_full_chain(t):
    """Two wordings and the dense channel fused, authorized, deduplicated, weak ones removed, each
    wording's best preserved, and exact identifier matches put in front."""
    wordings = questions(t).select("query_id", F.lit(0).alias("variant"), "question").unionByName(
        questions(t).selectExpr("query_id", "1 AS variant", "substring(question, length(question) DIV 2 + 1) AS question"))
    ranked = lexical.wordings_top_k(t.chunks(), wordings, POOL, 2)
    runs = ranked.select("query_id", "variant", F.col("lexical_rank").alias("rank"), "chunk_id", F.lit(0.0).alias("score")).unionByName(
        dense_top(t).select("query_id", F.lit(2).alias("variant"), F.col("dense_rank").alias("rank"), "chunk_id", "score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.desc("score"), "chunk_id")
    fused = fusion.multi_query(runs).withColumn("ord", F.row_number().over(best)).where(F.col("ord") <= POOL)
    path = shared_path(t.spark, "fused")  # so that the pool is known to be small where the texts join it
    fused.write.parquet(path)
    fused = t.spark.read.schema(fused.schema).parquet(path)
    allowed = t.chunks().drop("ord").where(scans.authorized(PROJECT, CALLER_POLICIES))
    pool = R.dedup_bodies(fused.join(allowed.where("doc_category <> 'index'"), "chunk_id"))
    weak = (F.col("score") < 0.30) & F.col("primary_rank").isNull()
    path = shared_path(t.spark, "chain")  # read twice below
    R.prefilter(pool, weak, F.lit(None).cast("string")).where("verdict = 'KEEP'").select("query_id", "chunk_id", "ord", "primary_rank", "variant_ranks").write.parquet(path)
    preserved = R.preserve_candidates(t.spark.read.parquet(path), limit=KEPT).select("query_id", "chunk_id", F.lit(1).alias("lane"), F.col("rn").alias("k"))
    named = t.read("benchmark").selectExpr("item_id AS query_id", "explode(array('src' || (item_id % 20) || '#' || (item_id * 3), 'E' || (item_id % 97))) AS identifier")
    paths = allowed.withColumn("structure_path", F.concat_ws(" ", "locator", "entity_key"))
    exact = scans.exact_identifier_lookup(paths, named, ["reference", "entity_key"], EXACT).select("query_id", "chunk_id", F.lit(0).alias("lane"), F.col("rn").alias("k"))
    merged = exact.unionByName(preserved).groupBy("query_id", "chunk_id").agg(F.min(F.struct("lane", "k")).alias("p"))
    return R.rank_by(merged, "rn", F.asc("p")).where(F.col("rn") <= KEPT).select("query_id", "chunk_id", F.col("p.lane").alias("lane"), "rn")
