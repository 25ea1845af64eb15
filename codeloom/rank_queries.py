"""Queries over vectors, fusion, ranking and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as X
from codeloom.operators import graph as G
from codeloom.operators import lexical as L
from codeloom.operators import rank as K
from codeloom.operators import resolve as S
from codeloom.operators import traverse as T
from codeloom.operators import vector as V
from codeloom.text_queries import _BM, search_scores
from codeloom.text_queries import ORACLES as _TEXT_SQL
from codeloom.views import SQL_VIEWS, Corpus

_W = "WITH RECURSIVE " + SQL_VIEWS
POOL = 40
OWNER = "GrammarIndex"


def _vectors(c: Corpus) -> DataFrame:
    return c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(c: Corpus) -> DataFrame:
    v = _vectors(c).where(F.col("id") % 20 == 0)
    return v.select(F.col("id").alias("query_id"), "vector", F.lit(None).cast("string").alias("group"))


def _top(c: Corpus) -> DataFrame:
    return V.top_cosine(_queries(c), _vectors(c).withColumn("group", F.lit(None).cast("string")), 10)


def _doc_links(c: Corpus) -> DataFrame:
    """Vectors of label 0 stand for documents, the others for code: the three nearest above the floor."""
    docs = _vectors(c).where("label = 0").select(F.col("id").alias("query_id"), "vector", F.lit("docs").alias("group"))
    code = _vectors(c).withColumn("group", F.when(F.col("label") == 0, "docs").otherwise("code"))
    return V.top_cosine(docs, code, 3, floor=0.35).select(F.col("query_id").alias("doc_id"), F.col("id").alias("code_id"), "score")


def _lexical(c: Corpus) -> DataFrame:
    return L.top(search_scores(c), POOL)


def _dense(c: Corpus) -> DataFrame:
    first = _vectors(c).where("id = 1").select(F.col("id").alias("query_id"), "vector", F.lit(None).cast("string").alias("group"))
    return V.top_cosine(first, _vectors(c).withColumn("group", F.lit(None).cast("string")), POOL).select("id", "score")


def _fused(c: Corpus) -> DataFrame:
    return K.fuse(_lexical(c), _dense(c)).select("id", F.round("score", 6).alias("score"))


def _pool(c: Corpus) -> DataFrame:
    """Every chunk that the text search finds, with what the ranking stages look at."""
    scored = search_scores(c)
    more = c.chunks_with("fqn", "file_path", "line_start", "content", "content_type", "is_definition", "is_test", "subwords")
    return scored.join(more, "id")


def _reranked(c: Corpus) -> DataFrame:
    return K.rerank(_pool(c), ["rebuild", "index", "token", "cache"], docs_intent=True, config_intent=True).select("id", F.round("score", 6).alias("score"))


def _owned(c: Corpus) -> DataFrame:
    """Two concepts, so that uses are weighed down, and members of one type, which gain."""
    return K.rerank(_pool(c), ["index", "token"], owner=OWNER).select("id", F.round("score", 6).alias("score"))


def _cohere(c: Corpus) -> DataFrame:
    rows = search_scores(c).withColumn("score", F.round("score", 6)).join(c.chunks_with("file_path", "line_start"), "id")
    return K.cohere(rows).select("id", "file_path", F.round("score", 6).alias("score"), "file_matches")


def _normalised(c: Corpus) -> DataFrame:
    return K.normalise_scores(search_scores(c)).select("id", F.round("score", 5).alias("score"))


def _confidence(c: Corpus) -> DataFrame:
    words = F.coalesce("subwords", F.array().cast("array<string>"))
    score = K.confidence(["rebuild", "index", "token", "cache"], words, F.lit(0.3), F.col("is_definition"), F.lower(X.leaf(F.coalesce("fqn", F.lit("")))) == "index")
    rows = c.chunks_with("subwords", "is_definition", "fqn").select("id", F.round(score, 6).alias("confidence"))
    return rows.withColumn("band", K.band(F.col("confidence")))


def _passes(c: Corpus) -> DataFrame:
    """Declared-rules, documentation and configuration passes in order, each on the maximum of its time."""
    pool = _pool(c)
    pool = K.add_pass(pool, F.lower(F.coalesce("content", F.lit(""))).contains("override"), 1.5)
    pool = K.lift_pass(pool, F.col("content_type") == "docs", 0.3)
    pool = K.add_pass(pool, F.col("content_type") == "config", 0.75)
    return K.demote_tests(pool.withColumn("is_test", F.coalesce("is_test", F.lit(False)))).select("id", F.round("score", 5).alias("score"))


def _savings(c: Corpus) -> DataFrame:
    return K.token_savings(_pool(c), c.table("files").select("file_path", "size").distinct())


def _references(c: Corpus) -> DataFrame:
    files = c.symbols_with("file_path").select(F.col("id").alias("source_symbol_id"), "file_path")
    raw = c.edges.where("not resolved and target_raw is not null and target_raw <> ''").join(files, "source_symbol_id")
    return S.resolve_references(c.symbols_with("fqn", "name", "conventional_fqn", "file_path"), raw.select("id", F.col("target_raw").alias("raw"), "file_path"))


def _related(c: Corpus) -> DataFrame:
    """Relatedness of each called pair: packages, shared types, calls, blended with a cosine of zero."""
    s = c.symbols_with("fqn", "file_path")
    pairs = c.resolved_edges.where("edge_type = 'CALLS' and source_symbol_id <> target_symbol_id").select("source_symbol_id", "target_symbol_id").distinct()
    a = s.select(F.col("id").alias("source_symbol_id"), F.col("file_path").alias("ap"))
    b = s.select(F.col("id").alias("target_symbol_id"), F.col("file_path").alias("bp"))
    package = P.package_overlap(F.col("ap"), F.col("bp"))
    semantic = 0.2 * package + 0.6 * F.lit(1.0)
    both = pairs.join(a, "source_symbol_id").join(b, "target_symbol_id")
    return both.select("source_symbol_id", "target_symbol_id", F.round(package, 6).alias("package"), F.round(0.8 * semantic, 6).alias("score"))


def _abstain(c: Corpus) -> DataFrame:
    return c.spark.createDataFrame([(bool(K.insufficient(_lexical(c), 4, 0.25)),)], "abstain boolean")


def _trim(c: Corpus) -> DataFrame:
    pool = _lexical(c)
    rows = pool.join(c.chunks_of(pool, "content"), "id")
    return K.budget_trim(rows, X.estimated_tokens(F.col("content")), [F.round("score", 9).desc(), F.col("id")], 1200).select("id")


def _session_rank(c: Corpus) -> DataFrame:
    from codeloom.operators import ops

    weights = ops.session_weights(c.table("sessions"), F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return K.rerank(_pool(c), [], weights=weights).select("id", F.round("score", 6).alias("score"))


def _query(run):
    return lambda spark, sf_dir: run(Corpus(spark, sf_dir))


QUERIES = {
    "h5_vector_top": _query(_top),
    "s26_doc_links": _query(_doc_links),
    "s26_mentions": _query(lambda c: S.mentions(c.table("documents").select(F.col("doc_id").alias("document"), "text"), c.symbols_with("name"))),
    "s20_normalised": _query(lambda c: _vectors(c).select("id", F.round(V.norm(V.normalised(F.col("vector"))), 6).alias("length"), F.round(F.element_at(V.normalised(F.col("vector")), 1), 6).alias("first"))),
    "h11_fusion": _query(_fused),
    "a10_normalised_scores": _query(_normalised),
    "a9_file_coherence": _query(_cohere),
    "h28_confidence": _query(_confidence),
    "h15_h17_passes": _query(_passes),
    "h30_rerank": _query(_reranked),
    "h30_owner_and_uses": _query(_owned),
    "h30_session_rank": _query(_session_rank),
    "h24_abstain": _query(_abstain),
    "a18_budget_trim": _query(_trim),
    "a20_token_savings": _query(_savings),
    "s18_references": _query(_references),
    "r1_candidates": _query(lambda c: S.candidates(c.symbols_with("fqn", "name"), "buildIndex")),
    "r2_resolve": _query(lambda c: S.resolve(c.symbols, "record_span")[1]),
    "r4_candidate_ranking": _query(lambda c: S.ranked_candidates(c.symbols.where("name = '__init__'"), "GrammarIndex.__init__(Node)", c.symbols)),
    "r5_unique_leafs": _query(lambda c: S.unique_leafs(c.symbols_with("name"))),
    "g3_overloads": _query(lambda c: S.overloads(c.symbols_with("name", "kind", "parent_symbol_id"))),
    "v4_related": _query(_related),
    "v3_call_proximity": _query(
        lambda c: T.reach_by_root(
            c.resolved_edges.where("edge_type = 'CALLS'").select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b")),
            c.symbols_with("kind").where(F.col("id") % 20 == 0).select(F.col("id").alias("root")), 3,
        ).where("root <> node").select("root", "node", F.round(1 / F.col("depth"), 6).alias("proximity"))
    ),
    "v2_arity": _query(lambda c: c.symbols_with("fqn").select("id", G.arity(F.col("fqn")).alias("arity"))),
}

_COS = """
WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT id, label, e, sqrt(list_dot_product(e, e)) AS l FROM v)"""
_NORMAL = """
, m AS (SELECT count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd FROM {src})"""
_POOL_SQL = ", pool AS (SELECT sc.id, sc.score, k.fqn, k.file_path, k.line_start, k.content, k.content_type, k.is_definition, k.is_test FROM sc JOIN chk k ON k.id = sc.id)"

def _rerank_sql(terms: list[str], owner: str | None, intents: bool) -> str:
    """The factors for some concepts; uses are only weighed down for three of them or fewer."""
    words = ", ".join(f"('{t}')" for t in terms)
    text = _BM + _POOL_SQL + f", qq(t) AS (VALUES {words}), fc AS (" + _TEXT_SQL["s3_s8_file_classes"] + r"""
), lf AS (SELECT p.*, coalesce(is_definition, false) AS d, lower(regexp_extract(regexp_replace(coalesce(fqn, ''), '\(.*$', ''), '([^.:]*)$', 1)) AS leaf, lower(coalesce(p.content, '')) AS low, '/' || lower(p.file_path) AS lp FROM pool p
), pr AS (SELECT DISTINCT leaf FROM lf WHERE d AND leaf IN (SELECT t FROM q)
), rr AS (SELECT lf.*, fc.role, fc.non_canonical, fc.doc_tier, fc.config_tier, EXISTS (SELECT 1 FROM pr WHERE contains(lf.low, pr.leaf)) AS uses, EXISTS (SELECT 1 FROM q WHERE contains(lower(coalesce(lf.fqn, '')), q.t)) AS named
  FROM lf JOIN fc ON fc.file_path = lf.file_path)
SELECT id, round(score * CASE WHEN d AND leaf IN (SELECT t FROM q) THEN 1.5 WHEN d AND named THEN 1.2 ELSE 1 END * CASE WHEN NOT d AND uses THEN 0.85 ELSE 1 END
  * CASE WHEN content_type = 'docs' THEN 1.2 * CASE doc_tier WHEN 'project' THEN 1.35 WHEN 'third_party' THEN 0.35 WHEN 'generated' THEN 0.6 ELSE 1 END ELSE 1 END
  * CASE WHEN content_type = 'config' THEN CASE WHEN config_tier = 'primary' THEN 1.35 WHEN config_tier IN ('test','sample','generated') THEN 0.7 ELSE 1 END ELSE 1 END
  * CASE WHEN list_has_any(string_split(lower(file_path), '/'), ['rebuild', 'index', 'token', 'cache']) THEN 1.15 ELSE 1 END * CASE WHEN coalesce(is_test, false) THEN 0.5 ELSE 1 END * CASE WHEN non_canonical THEN 0.25 ELSE 1 END
  * CASE WHEN role IN ('model','dto','assembler','exception') AND NOT d THEN 0.6 ELSE 1 END * CASE WHEN role = 'infra' THEN 0.35 ELSE 1 END
  * CASE WHEN regexp_matches(lp, '\.min\.(js|css)$') OR contains(lp, '/dist/') THEN 0.2 ELSE 1 END * CASE WHEN regexp_matches(lp, '/(node_modules|vendor|bower_components)/') THEN 0.5 ELSE 1 END
  * CASE WHEN ends_with(lp, '.d.ts') THEN 0.7 ELSE 1 END, 6) AS score FROM rr"""
    text = text.replace("FROM q WHERE contains(lower(coalesce(lf.fqn", "FROM qq AS q WHERE contains(lower(coalesce(lf.fqn").replace("leaf IN (SELECT t FROM q)", "leaf IN (SELECT t FROM qq)")
    text = text.replace("['rebuild', 'index', 'token', 'cache'])", "[" + ", ".join(f"'{t}'" for t in terms) + "])")
    if len(terms) > 3:
        text = text.replace("WHEN NOT d AND uses THEN 0.85", "WHEN false THEN 0.85")
    if owner:
        own = r"lower(regexp_extract(regexp_replace(regexp_replace(coalesce(fqn, ''), '^.*::', ''), '\(.*$', ''), '([^.]+)\.[^.]+$', 1))"
        text = text.replace("SELECT id, round(score * ", f"SELECT id, round(score * CASE WHEN d AND {own} = '{owner.lower()}' THEN 1.5 ELSE 1 END * ")
    if not intents:
        text = text.replace("WHEN content_type = 'docs' THEN 1.2", "WHEN false THEN 1.2").replace("WHEN content_type = 'config' THEN CASE", "WHEN false THEN CASE")
    return text


ORACLES = {
    "h5_vector_top": _COS + """
SELECT query_id, id, score FROM (SELECT q.id AS query_id, c.id, greatest(0, least(1, round(list_dot_product(q.e, c.e) / (q.l * c.l), 6))) AS score,
  row_number() OVER (PARTITION BY q.id ORDER BY greatest(0, least(1, round(list_dot_product(q.e, c.e) / (q.l * c.l), 6))) DESC, c.id) AS rn
  FROM n q JOIN n c ON c.id <> q.id WHERE q.id % 20 = 0) WHERE rn <= 10""",
    "s26_doc_links": _COS + """
SELECT doc_id, code_id, score FROM (SELECT q.id AS doc_id, c.id AS code_id, round(list_dot_product(q.e, c.e) / (q.l * c.l), 6) AS score,
  row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.e, c.e) / (q.l * c.l), 6) DESC, c.id) AS rn
  FROM n q JOIN n c ON c.label <> 0 WHERE q.label = 0 AND round(list_dot_product(q.e, c.e) / (q.l * c.l), 6) >= 0.35) WHERE rn <= 3""",
    "s26_mentions": _W + r"""
, m AS (SELECT DISTINCT doc_id AS document, unnest(list_concat(list_transform(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_.]*)(\(\))?`', 1), lambda x: regexp_extract(x, '([^.]*)$', 1)), regexp_extract_all(text, '\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b|\b[a-z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b'))) AS name FROM documents
), u AS (SELECT name, min(id) AS id FROM sym GROUP BY 1 HAVING count(*) = 1)
SELECT DISTINCT document, u.id AS symbol_id FROM m JOIN u USING (name)""",
    "s20_normalised": _COS + " SELECT id, CASE WHEN l > 0 THEN 1.0 ELSE 0.0 END AS length, round(e[1] / l, 6) AS first FROM n",
    "a10_normalised_scores": _BM + _NORMAL.format(src="sc") + " SELECT id, round(least(1, greatest(0, ((score - mean) / sd + 3) / 6)), 5) AS score FROM sc, m",
    "a9_file_coherence": _BM + """
, r AS (SELECT sc.id, round(sc.score, 6) AS score, k.file_path, k.line_start FROM sc JOIN chk k ON k.id = sc.id
), b AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, coalesce(line_start, 0), id) AS rn, max(score) OVER (PARTITION BY file_path) AS top, count(*) OVER (PARTITION BY file_path) AS c FROM r)
SELECT id, file_path, round(top + 0.05 * log2(1 + c), 6) AS score, c AS file_matches FROM b WHERE rn = 1""",
    "h15_h17_passes": _BM + _POOL_SQL + """
, p1 AS (SELECT *, score + CASE WHEN contains(lower(coalesce(content, '')), 'override') THEN 1.5 * (SELECT max(score) FROM pool) ELSE 0 END AS s1 FROM pool
), p2 AS (SELECT *, CASE WHEN content_type = 'docs' THEN greatest(s1, 0.3 * (SELECT max(s1) FROM p1)) ELSE s1 END AS s2 FROM p1
), p3 AS (SELECT *, s2 + CASE WHEN content_type = 'config' THEN 0.75 * (SELECT max(s2) FROM p2) ELSE 0 END AS s3 FROM p2)
SELECT id, round(CASE WHEN coalesce(is_test, false) THEN s3 * 0.5 ELSE s3 END, 5) AS score FROM p3""",
    "h11_fusion": _BM + """
, lx AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS r FROM (SELECT id, score FROM sc ORDER BY round(score, 9) DESC, id LIMIT 40)
), v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS l FROM v
), dn AS (SELECT c.id, greatest(0, least(1, round(list_dot_product(q.e, c.e) / (q.l * c.l), 6))) AS s FROM n q JOIN n c ON c.id <> q.id WHERE q.id = 1
), dx AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM (SELECT id, s FROM dn ORDER BY s DESC, id LIMIT 40)
), bl AS (SELECT coalesce(a.id, b.id) AS id, 0.5 * coalesce(1.0 / (60 + b.r + 1), 0) + 0.5 * coalesce(1.0 / (60 + a.r + 1), 0) AS score FROM lx a FULL JOIN dx b ON a.id = b.id
), m AS (SELECT avg(score) AS mean, stddev_pop(score) AS sd FROM bl)
SELECT id, round(least(1, greatest(0, ((score - mean) / sd + 3) / 6)), 6) AS score FROM bl, m""",
    "a20_token_savings": _BM + _POOL_SQL + """
SELECT CAST((SELECT sum(length(content) // 4) FROM pool) AS BIGINT) AS returned, CAST((SELECT sum(size // 4) FROM (SELECT DISTINCT file_path, size FROM files) f WHERE f.file_path IN (SELECT file_path FROM pool)) AS BIGINT) AS full,
  CAST((SELECT sum(size // 4) FROM (SELECT DISTINCT file_path, size FROM files) f WHERE f.file_path IN (SELECT file_path FROM pool)) - (SELECT sum(length(content) // 4) FROM pool) AS BIGINT) AS saved""",
    "s18_references": _W + r"""
, rf AS (SELECT e.id, e.target_raw AS raw, s.file_path, regexp_extract(regexp_replace(e.target_raw, '\(.*$', ''), '([^.:]*)$', 1) AS leaf FROM edg e JOIN sym s ON s.id = e.source_symbol_id WHERE NOT e.resolved AND e.target_raw IS NOT NULL AND e.target_raw <> ''
), c1 AS (SELECT fqn AS k, count(*) AS n, min(id) AS t FROM sym WHERE fqn IS NOT NULL GROUP BY 1), c2 AS (SELECT conventional_fqn AS k, count(*) AS n, min(id) AS t FROM sym WHERE conventional_fqn IS NOT NULL GROUP BY 1
), c3 AS (SELECT name AS k, file_path AS f, count(*) AS n, min(id) AS t FROM sym GROUP BY 1, 2), c4 AS (SELECT name AS k, count(*) AS n, min(id) AS t FROM sym GROUP BY 1
), j AS (SELECT rf.id, coalesce(c1.n, c2.n, c3.n, c4.n, 0) AS n, CASE WHEN c1.n IS NOT NULL THEN 'exact' WHEN c2.n IS NOT NULL THEN 'conventional' WHEN c3.n IS NOT NULL THEN 'same_file' ELSE 'fallback' END AS tr,
  CASE WHEN c1.n IS NOT NULL THEN c1.t WHEN c2.n IS NOT NULL THEN c2.t WHEN c3.n IS NOT NULL THEN c3.t ELSE c4.t END AS t
  FROM rf LEFT JOIN c1 ON c1.k = rf.raw LEFT JOIN c2 ON c2.k = rf.raw LEFT JOIN c3 ON c3.k = rf.leaf AND c3.f = rf.file_path LEFT JOIN c4 ON c4.k = rf.leaf)
SELECT id, CASE WHEN n = 0 THEN 'no_match' WHEN n > 1 THEN 'ambiguous' ELSE tr END AS tier, CASE WHEN n = 1 THEN t END AS target, n FROM j""",
    "h28_confidence": _W + r"""
, w AS (SELECT id, coalesce(subwords, []) AS s, is_definition AS d, lower(regexp_extract(regexp_replace(coalesce(fqn, ''), '\(.*$', ''), '([^.:]*)$', 1)) = 'index' AS x FROM chk
), q(t) AS (VALUES ('rebuild'), ('index'), ('token'), ('cache')
), o AS (SELECT w.id, w.d, w.x, sum(CASE WHEN list_contains(s, t) OR len(list_filter(s, lambda v: length(v) >= 4 AND (starts_with(v, t) OR starts_with(t, v)) AND abs(length(v) - length(t)) <= 3)) > 0 THEN 1 ELSE 0 END) / 4.0 AS ov FROM w, q GROUP BY ALL
), b AS (SELECT id, d, x, 0.5 * ov + 0.5 * 0.3 + CASE WHEN d THEN 0.1 ELSE 0 END AS sc FROM o
), f AS (SELECT id, round(least(1, greatest(0, CASE WHEN x THEN greatest(sc, CASE WHEN d THEN 0.85 ELSE 0.75 END) ELSE sc END)), 6) AS confidence FROM b)
SELECT id, confidence, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM f""",
    "h30_rerank": _rerank_sql(["rebuild", "index", "token", "cache"], None, True),
    "h30_owner_and_uses": _rerank_sql(["index", "token"], OWNER, False),
    "h24_abstain": _BM + """
, t AS (SELECT round(score, 9) AS s, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM sc
), five AS (SELECT s, r FROM t WHERE r <= 5)
SELECT (SELECT max(s) FROM five) / (SELECT s FROM five ORDER BY s LIMIT 1 OFFSET 2) <= 1.05 AND 4 >= 3 AND 0.25 <= 0.5 AS abstain""",
    "h30_session_rank": _BM + _POOL_SQL + ", fc AS (" + _TEXT_SQL["s3_s8_file_classes"] + r"""
), sw AS (SELECT file_path, max(coalesce(weight_score, CASE event_type WHEN 'WRITE' THEN 1.0 WHEN 'READ' THEN 0.7 ELSE 0.0 END) * exp(-0.1 * (epoch_us(TIMESTAMP '2026-01-01 00:00:00') - epoch_us(event_time)) / 3600000000.0)) AS w FROM sessions
  WHERE file_path IS NOT NULL AND event_time IS NOT NULL AND event_time <= TIMESTAMP '2026-01-01 00:00:00' AND (ttl_expires_at IS NULL OR ttl_expires_at > TIMESTAMP '2026-01-01 00:00:00') GROUP BY 1)
SELECT p.id, round(p.score * CASE WHEN coalesce(p.is_definition, false) THEN 1.2 ELSE 1 END * CASE WHEN coalesce(p.is_test, false) THEN 0.5 ELSE 1 END * CASE WHEN fc.non_canonical THEN 0.25 ELSE 1 END
  * CASE WHEN fc.role IN ('model','dto','assembler','exception') AND NOT coalesce(p.is_definition, false) THEN 0.6 ELSE 1 END * CASE WHEN fc.role = 'infra' THEN 0.35 ELSE 1 END
  * CASE WHEN regexp_matches('/' || lower(p.file_path), '\.min\.(js|css)$') OR contains('/' || lower(p.file_path), '/dist/') THEN 0.2 ELSE 1 END * CASE WHEN regexp_matches('/' || lower(p.file_path), '/(node_modules|vendor|bower_components)/') THEN 0.5 ELSE 1 END
  * CASE WHEN ends_with(lower(p.file_path), '.d.ts') THEN 0.7 ELSE 1 END * coalesce(sw.w, 1), 6) AS score FROM pool p JOIN fc ON fc.file_path = p.file_path LEFT JOIN sw ON sw.file_path = p.file_path""",
    "a18_budget_trim": _BM + """
, t AS (SELECT id, round(score, 9) AS s FROM sc ORDER BY round(score, 9) DESC, id LIMIT 40
), r AS (SELECT t.id, sum(length(k.content) // 4) OVER (ORDER BY t.s DESC, t.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM t JOIN chk k ON k.id = t.id)
SELECT id FROM r WHERE run <= 1200""",
    "r1_candidates": _W + r"""
, w AS (SELECT id, fqn, name, regexp_extract(regexp_replace(fqn, '\(.*$', ''), '([^.:]*)$', 1) AS leaf, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '[_\-]+'), lambda x: x <> '') AS p FROM sym
), st AS (SELECT id, CASE WHEN fqn = 'buildIndex' OR name = 'buildIndex' OR lower(leaf) = 'buildindex' THEN 1 WHEN ends_with(lower(fqn), 'buildindex') THEN 2 WHEN contains(lower(fqn), 'buildindex') THEN 3
  WHEN list_has_any(p, ['build', 'index']) THEN 4 WHEN levenshtein(lower(name), 'buildindex') <= 2 THEN 5 END AS k FROM w)
SELECT id, CASE k WHEN 1 THEN 'exact' WHEN 2 THEN 'suffix' WHEN 3 THEN 'substring' WHEN 4 THEN 'subword' ELSE 'edits' END AS stage FROM st WHERE k = (SELECT min(k) FROM st)""",
    "r2_resolve": _W + r"""
, k AS (SELECT *, CASE WHEN fqn = 'record_span' THEN 1 WHEN conventional_fqn = 'record_span' THEN 2 WHEN name = 'record_span' THEN 3 END AS st FROM sym
)
SELECT id, fqn, array_to_string(list_filter([CASE WHEN NOT coalesce(regexp_matches(declared_rules, '(?i)deprecated'), false) THEN 'current' END, CASE WHEN NOT is_test THEN 'production' END], lambda x: x IS NOT NULL), ',') AS evidence
FROM k WHERE st = (SELECT min(st) FROM k)""",
    "r4_candidate_ranking": _W + r"""
, k AS (SELECT s.*, EXISTS (SELECT 1 FROM sym o WHERE o.id = s.parent_symbol_id AND o.name = 'GrammarIndex') AS i, regexp_extract(fqn, '\(([^()]*)\)$', 1) AS ps, regexp_matches(fqn, '\([^()]*\)$') AS has FROM sym s WHERE name = '__init__')
SELECT id, fqn, array_to_string(list_filter([CASE WHEN i THEN 'parent' END, CASE WHEN ps = 'Node' THEN 'types' END, CASE WHEN has AND trim(ps) <> '' AND NOT contains(ps, ',') THEN 'signature' END,
  CASE WHEN NOT coalesce(regexp_matches(declared_rules, '(?i)deprecated'), false) THEN 'current' END, CASE WHEN NOT is_test THEN 'production' END], lambda x: x IS NOT NULL), ',') AS evidence FROM k""",
    "r5_unique_leafs": _W + "SELECT name, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM sym GROUP BY 1",
    "g3_overloads": _W + "SELECT parent_symbol_id, name, count(*) AS n, min(id) AS first, max(id) AS last FROM sym WHERE parent_symbol_id IS NOT NULL AND kind IN ('function','method','constructor') GROUP BY 1, 2 HAVING count(*) > 1",
    "v4_related": _W + """
, pk AS (SELECT id, list_distinct(list_filter(d[coalesce(list_max(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN d[i] IN ('src','source','java','kotlin','scala','groovy') THEN i ELSE 0 END)), 0) + 1 :], lambda x: x <> '')) AS g
  FROM (SELECT id, string_split(file_path, '/')[1:-2] AS d FROM sym)
), pr AS (SELECT DISTINCT source_symbol_id AS s, target_symbol_id AS t FROM res WHERE edge_type = 'CALLS' AND source_symbol_id <> target_symbol_id
), o AS (SELECT s, t, CASE WHEN len(a.g) + len(b.g) = 0 THEN 1.0 ELSE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) END AS p FROM pr JOIN pk a ON a.id = s JOIN pk b ON b.id = t)
SELECT s AS source_symbol_id, t AS target_symbol_id, round(p, 6) AS package, round(0.8 * (0.2 * p + 0.6), 6) AS score FROM o""",
    "v3_call_proximity": _W + """
, c AS (SELECT DISTINCT source_symbol_id AS a, target_symbol_id AS b FROM res WHERE edge_type = 'CALLS'
), w(root, node, depth) AS (SELECT s.id, c.b, 1 FROM sym s JOIN c ON c.a = s.id WHERE s.id % 20 = 0 UNION SELECT w.root, c.b, w.depth + 1 FROM w JOIN c ON c.a = w.node WHERE w.depth < 3)
SELECT root, node, round(1 / min(depth), 6) AS proximity FROM w WHERE root <> node GROUP BY 1, 2""",
    "v2_arity": _W + r"""
SELECT id, CAST(CASE WHEN regexp_matches(fqn, '\([^()]*\)$') THEN CASE WHEN trim(regexp_extract(fqn, '\(([^()]*)\)$', 1)) = '' THEN 0
  ELSE len(string_split(regexp_replace(regexp_replace(regexp_extract(fqn, '\(([^()]*)\)$', 1), '[<\[][^<>\[\]]*[>\]]', '', 'g'), '[<\[][^<>\[\]]*[>\]]', '', 'g'), ',')) END END AS INTEGER) AS arity FROM sym""",
}
