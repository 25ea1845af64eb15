"""Queries of the re-scoring passes, each over all chunks that the text search finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as X
from codeloom.operators import lexical as L
from codeloom.operators import passes as R
from codeloom.operators import rank as K
from codeloom.text_queries import _BM, search_scores
from codeloom.text_queries import ORACLES as _TEXT_SQL
from codeloom.views import SQL_VIEWS, Corpus

_W = "WITH RECURSIVE " + SQL_VIEWS
NAME = "__init__"
SENTENCE = "where are record_span and __init__ and reportWatcher used"
CONCEPTS = ["quota", "heartbeat", "ledger"]
ENDPOINT = "get endpoint of the quota index"
CONSTANT = "default constant index"
PATH_TERMS = ["index", "token", "cache"]
TEXTS = ("rebuild index zzzqqq", "zzzqqq wqrble", "quota")


def _chunks(c: Corpus) -> DataFrame:
    return c.chunks_with("fqn", "file_path", "content", "content_type", "chunk_type", "chunk_node_type", "declared_rules", "is_definition", "is_test", "subwords")


def _slim(c: Corpus) -> DataFrame:
    return c.chunks_with("fqn", "file_path", "is_definition", "is_test", "subwords", "chunk_node_type", "chunk_type", "content_type")


def _pool(c: Corpus, rows: DataFrame) -> DataFrame:
    return search_scores(c).join(rows, "id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 5).alias("score"))


def _gate(c: Corpus) -> DataFrame:
    index, rows = c.lexical, []
    for text in TEXTS:
        informative = L.informative_terms(index.stats, index.chunks, text)
        concepts = [w for w in X.decompose(text) if len(w) >= 3 and w not in X.STOP_WORDS]
        known = index.known(concepts)
        hits = index.bm25(index.phrases(text)).count()
        accepted, _ = R.quality_gate(len(informative), len(concepts), len(known) / len(concepts), hits, 0.0)
        rows.append((text, len(informative), bool(accepted)))
    return c.spark.createDataFrame(rows, "text string, informative int, accepted boolean")


def _gates(c: Corpus) -> DataFrame:
    """The pool's floor, its saturation and the floor of rescued answers, for one question each way."""
    scored = search_scores(c)
    pool = _pool(c, c.chunks_with("content", "subwords")).where("score > 0")
    return c.spark.createDataFrame([(R.below_floor(scored), R.saturated(pool, ["cache"]), R.saturated(pool, ["zzzqqq"]), R.rescue_allowed(1, 0.4), R.rescue_allowed(0, 0.4))], "weak boolean, saturated boolean, odd boolean, shown boolean, hidden boolean")


def _sharing(c: Corpus) -> DataFrame:
    s = c.symbols_with("fqn")
    pairs = c.resolved_edges.where("edge_type = 'CALLS' and source_symbol_id <> target_symbol_id").select("source_symbol_id", "target_symbol_id").distinct()
    a = s.select(F.col("id").alias("source_symbol_id"), R.parameter_types(F.col("fqn")).alias("at"))
    b = s.select(F.col("id").alias("target_symbol_id"), R.parameter_types(F.col("fqn")).alias("bt"))
    both = pairs.join(a, "source_symbol_id").join(b, "target_symbol_id")
    return both.select("source_symbol_id", "target_symbol_id", F.round(R.type_sharing(F.col("at"), F.col("bt")), 6).alias("sharing"))


def _suppressed(c: Corpus) -> DataFrame:
    return _rounded(R.suppressed(_pool(c, c.chunks_with("file_path")), "code"))


def _blend(c: Corpus) -> DataFrame:
    """Relatedness of called pairs from packages, shared types, calls and the vectors of their ids."""
    vectors = c.table("embeddings").select(F.col("vec_id").alias("vid"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sharing = _sharing(c)
    s = c.symbols_with("file_path")
    a, b = (s.select(F.col("id").alias(k), F.col("file_path").alias(p)) for k, p in (("source_symbol_id", "ap"), ("target_symbol_id", "bp")))
    va, vb = (vectors.select(F.col("vid").alias(k), F.col("v").alias(p)) for k, p in (("source_symbol_id", "av"), ("target_symbol_id", "bv")))
    rows = sharing.join(a, "source_symbol_id").join(b, "target_symbol_id").join(va, "source_symbol_id").join(vb, "target_symbol_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col("av"), F.col("bv")) / F.sqrt(dot(F.col("av"), F.col("av")) * dot(F.col("bv"), F.col("bv")))))
    rows = rows.withColumn("package", P.package_overlap(F.col("ap"), F.col("bp"))).withColumn("cosine", F.round(cosine, 6))
    score = K.related_score(F.col("package"), F.col("sharing"), F.lit(1.0), F.col("cosine"))
    return rows.select("source_symbol_id", "target_symbol_id", F.round("package", 6).alias("package"), "sharing", "cosine", F.round(score, 5).alias("score"))


def _query(run):
    return lambda spark, sf_dir: run(Corpus(spark, sf_dir))


QUERIES = {
    "e36_bounded": _query(lambda c: search_scores(c).select("id", F.round(R.bounded(F.col("score")), 6).alias("score"))),
    "h8_quality_gate": _query(_gate),
    "h12_stem_rescue": _query(lambda c: _rounded(R.stem_rescue(search_scores(c), _slim(c), NAME))),
    "h13_embedded_symbols": _query(lambda c: _rounded(R.definition_pass(search_scores(c), _slim(c), R.embedded_names(c.symbols_with("name"), SENTENCE)))),
    "h14_reference_inject": _query(lambda c: _rounded(R.definition_pass(search_scores(c), _slim(c), [NAME]))),
    "h20_concept_symbols": _query(lambda c: _rounded(R.concept_pass(search_scores(c), _slim(c), CONCEPTS))),
    "h20_concept_terms": _query(lambda c: c.spark.createDataFrame([(t,) for t in R.concept_terms(c.lexical.stats, c.lexical.chunks, "the quota of heartbeat ledgers zzz")], "term string")),
    "h21_endpoint": _query(lambda c: _rounded(R.endpoint_pass(search_scores(c), _chunks(c), ENDPOINT))),
    "h22_constant": _query(lambda c: _rounded(R.constant_pass(search_scores(c), _chunks(c), CONSTANT))),
    "h23_h26_h32_gates": _query(_gates),
    "h25_path_boost": _query(lambda c: _rounded(R.path_boost(_pool(c, c.chunks_with("file_path")), PATH_TERMS))),
    "h27_weighting": _query(lambda c: _rounded(R.weighting(_pool(c, _slim(c)), config_scent="config", code_context=True, exact=X.leaf(F.col("fqn")) == NAME))),
    "e35_type_sharing": _query(_sharing),
    "v4_blend": _query(_blend),
    "v5_suppressed": _query(_suppressed),
}

_LEAF = r"regexp_extract(regexp_replace(k.fqn, '\(.*$', ''), '([^.:]*)$', 1)"
_SUBS = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '[_\-]+'), lambda x: x <> '')"
_STEM = "lower(regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '^(.+)\\.[^.]+$', '\\1'))"
_INJECT = " SELECT coalesce(sc.id, ad.id) AS id, round(coalesce(sc.score, 0) + coalesce(ad.a, 0), 5) AS score FROM sc FULL JOIN ad ON ad.id = sc.id"
_TOP = ", mx AS (SELECT max(score) AS top FROM sc)"


def _match(words: str, term: str) -> str:
    near = f" OR len(list_filter({words}, lambda v: length(v) >= 4 AND (starts_with(v, '{term}') OR starts_with('{term}', v)) AND abs(length(v) - {len(term)}) <= 3)) > 0" if len(term) >= 4 else ""
    return f"(list_contains({words}, '{term}'){near})"


_NAME_WORDS = "list_filter(flatten(list_transform(regexp_extract_all(regexp_replace(coalesce(k.fqn, ''), '^.*::', ''), '[A-Za-z_][A-Za-z0-9_]*'), lambda i: " + _SUBS.format(x="i") + ")), lambda x: x <> '')"
_PATH_WORDS = "list_filter(flatten(list_transform(regexp_extract_all(k.file_path, '[A-Za-z_][A-Za-z0-9_]*'), lambda i: " + _SUBS.format(x="i") + ")), lambda x: x <> '')"
_SHORT = r"regexp_replace(regexp_replace(coalesce(k.fqn, ''), '^.*::', ''), '\(.*$', '')"
_MEMBER_WORDS = f"CASE WHEN contains({_SHORT}, '.') THEN " + _SUBS.format(x=f"regexp_extract({_SHORT}, '([^.]*)$', 1)") + " ELSE [] END"
_TYPES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(coalesce(fqn, ''), '\(([^()]*)\)$', 1), '[<\[][^<>\[\]]*[>\]]', '', 'g'), '[<\[][^<>\[\]]*[>\]]', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')"
_SHARE = f"""
, ty AS (SELECT id, {_TYPES} AS t FROM sym
), pr AS (SELECT DISTINCT source_symbol_id AS s, target_symbol_id AS t FROM res WHERE edge_type = 'CALLS' AND source_symbol_id <> target_symbol_id
), sh AS (SELECT s, pr.t, CASE WHEN greatest(len(list_distinct(a.t)), len(list_distinct(b.t))) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / greatest(len(list_distinct(a.t)), len(list_distinct(b.t))) END AS v FROM pr JOIN ty a ON a.id = s JOIN ty b ON b.id = pr.t)"""
_ROLE = "CASE WHEN fc.role IN ('model', 'dto', 'assembler', 'exception')"

ORACLES = {
    "e36_bounded": _BM + " SELECT id, round(score / (1 + score), 6) AS score FROM sc",
    "h8_quality_gate": _W + """
, sw AS (SELECT id, list_distinct(list_filter(list_transform(subwords, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS w FROM chk
), st AS (SELECT key, count(*) AS d FROM (SELECT unnest(w) AS key FROM sw) GROUP BY 1
), pf AS (SELECT key, count(*) AS d FROM (SELECT id, unnest(list_distinct(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: substring(x, 1, 3)))) AS key FROM sw) GROUP BY 1
), q(text, t) AS (VALUES ('rebuild index zzzqqq', 'rebuild'), ('rebuild index zzzqqq', 'index'), ('rebuild index zzzqqq', 'zzzqqq'), ('zzzqqq wqrble', 'zzzqqq'), ('zzzqqq wqrble', 'wqrble'), ('quota', 'quota')
), d AS (SELECT text, t, coalesce(st.d, pf.d, 0) AS n, st.d IS NOT NULL AS known FROM q LEFT JOIN st ON st.key = t LEFT JOIN pf ON pf.key = substring(t, 1, 3)
), g AS (SELECT text, CAST(count(*) FILTER (WHERE n > 0 AND (ln((SELECT count(*) FROM chk) / n) >= 0.8 OR n <= 2)) AS INTEGER) AS informative, count(*) AS concepts, count(*) FILTER (WHERE known) / count(*) AS coverage, bool_or(n > 0) AS hits FROM d GROUP BY 1)
SELECT text, informative, informative >= 1 AND (concepts < 2 OR (informative >= 2 AND coverage >= 0.5)) AND hits AS accepted FROM g""",
    "h12_stem_rescue": _BM + _TOP + f"""
, ad AS (SELECT k.id, CASE WHEN starts_with('init', {_STEM.format(p='k.file_path')}) THEN 1.5 WHEN starts_with({_STEM.format(p='k.file_path')}, 'init') THEN 1.0 END * (SELECT top FROM mx) AS a FROM chk k
  WHERE coalesce(k.is_definition, false) AND {_LEAF} = '__init__' AND (starts_with('init', {_STEM.format(p='k.file_path')}) OR starts_with({_STEM.format(p='k.file_path')}, 'init')))""" + _INJECT,
    "h13_embedded_symbols": _BM + _TOP + f"""
, nm AS (SELECT name FROM sym WHERE name IN ('record_span', '__init__', 'reportWatcher') GROUP BY 1 HAVING count(*) = 1
), ad AS (SELECT k.id, 0.5 * (SELECT top FROM mx) AS a FROM chk k WHERE coalesce(k.is_definition, false) AND {_LEAF} IN (SELECT name FROM nm))""" + _INJECT,
    "h14_reference_inject": _BM + _TOP + f", ad AS (SELECT k.id, 0.5 * (SELECT top FROM mx) AS a FROM chk k WHERE coalesce(k.is_definition, false) AND {_LEAF} = '__init__')" + _INJECT,
    "h20_concept_symbols": _BM + _TOP + f"""
, fi AS (SELECT id FROM sc ORDER BY round(score, 9) DESC, id LIMIT 100
), cw AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {_match('coalesce(k.subwords, [])', t)}) AS c{i}" for i, t in enumerate(CONCEPTS))} FROM fi JOIN chk k USING (id)
), w AS (SELECT {", ".join(f"ln(1 + n / (1.0 + c{i})) AS w{i}" for i in range(len(CONCEPTS)))} FROM cw
), df AS (SELECT k.id, k.is_test, k.chunk_node_type, {", ".join(f"{_match(_NAME_WORDS, t)} AS h{i}, {_match(_MEMBER_WORDS, t)} AS m{i}" for i, t in enumerate(CONCEPTS))} FROM chk k WHERE coalesce(k.is_definition, false)
), kp AS (SELECT {", ".join(f"CASE WHEN (SELECT bool_or(h{i}) FROM df) AND w{i} >= ln(1 + 100 / 26.0) THEN w{i} ELSE 0 END AS u{i}" for i in range(len(CONCEPTS)))} FROM w
), ld AS (SELECT df.* FROM df JOIN (SELECT id FROM sc ORDER BY round(score, 9) DESC, id LIMIT 1) USING (id)
), go AS (SELECT {" + ".join(f"u{i}" for i in range(len(CONCEPTS)))} AS total, NOT EXISTS (SELECT 1 FROM ld WHERE {" AND ".join(f"(h{i} OR u{i} = 0)" for i in range(len(CONCEPTS)))}) AS ok FROM kp
), rt AS (SELECT df.*, ({" + ".join(f"CASE WHEN h{i} THEN u{i} ELSE 0 END" for i in range(len(CONCEPTS)))}) / total AS ratio, ({" OR ".join(f"(h{i} AND m{i} AND u{i} > 0)" for i in range(len(CONCEPTS)))}) AND chunk_node_type IN ('function', 'method', 'constructor') AS an,
  CASE WHEN coalesce(is_test, false) THEN 0.5 ELSE 1 END AS tf FROM df, kp, go WHERE total > 0 AND ok
), ad AS (SELECT rt.id, CASE WHEN an THEN greatest(least(top * 0.7 * ratio * tf, 0.6 * top), least(top * 1.8 * ratio * tf * tf, 2.0 * top)) ELSE least(top * 0.7 * ratio * tf, 0.6 * top) END AS a
  FROM rt LEFT JOIN (SELECT id FROM sc WHERE score > 0) p ON p.id = rt.id, mx WHERE ratio >= 0.2 AND (p.id IS NOT NULL OR ratio >= 0.34))""" + _INJECT,
    "h20_concept_terms": _W + """
, sw AS (SELECT id, list_distinct(list_filter(list_transform(subwords, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS w FROM chk
), st AS (SELECT key, count(*) AS d FROM (SELECT unnest(w) AS key FROM sw) GROUP BY 1
), pf AS (SELECT key, count(*) AS d FROM (SELECT id, unnest(list_distinct(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: substring(x, 1, 3)))) AS key FROM sw) GROUP BY 1
), q(t) AS (VALUES ('quota'), ('heartbeat'), ('ledgers'), ('zzz')
), d AS (SELECT t, coalesce(st.d, pf.d, 0) AS n FROM q LEFT JOIN st ON st.key = t LEFT JOIN pf ON pf.key = substring(t, 1, 3))
SELECT t AS term FROM d WHERE n > 0 AND n <= greatest(3, CAST(floor((SELECT count(*) FROM chk) * 0.25) AS BIGINT))""",
    "h21_endpoint": _BM + _TOP + f"""
, wd AS (SELECT k.*, list_concat({_NAME_WORDS}, {_PATH_WORDS}) AS w FROM chk k WHERE coalesce(k.is_definition, false) AND (contains(k.content, 'GetMapping') OR contains(k.declared_rules, 'GetMapping')) AND k.chunk_node_type IN ('function', 'method', 'constructor')
), rt AS (SELECT id, is_test, ({" + ".join(f"CASE WHEN {_match('w', t)} THEN 1 ELSE 0 END" for t in ('get', 'endpoint', 'quota', 'index'))}) / 4.0 AS r FROM wd
), ad AS (SELECT id, least(top * 2.0 * (0.5 + 0.5 * r) * CASE WHEN coalesce(is_test, false) THEN 0.5 ELSE 1 END, 1.5 * top) AS a FROM rt, mx WHERE r > 0)""" + _INJECT,
    "h22_constant": _BM + _TOP + f"""
, ad AS (SELECT k.id, least(top * 1.4 * CASE WHEN coalesce(k.is_test, false) THEN 0.5 ELSE 1 END, 1.5 * top) AS a FROM chk k, mx WHERE coalesce(k.is_definition, false) AND (contains(k.content, 'static final') OR contains(k.content, 'const '))
  AND ({_match('coalesce(k.subwords, [])', 'default')} OR {_match('coalesce(k.subwords, [])', 'constant')}) AND {_match('coalesce(k.subwords, [])', 'index')})""" + _INJECT,
    "h23_h26_h32_gates": _BM + """
SELECT (SELECT max(score) < 0.05 FROM sc) AS weak, EXISTS (SELECT 1 FROM sc JOIN chk k USING (id) WHERE sc.score > 0 AND (contains(lower(coalesce(k.content, '')), 'cache') OR len(list_filter(coalesce(k.subwords, []), lambda x: starts_with(x, 'cac'))) > 0)) AS saturated,
  EXISTS (SELECT 1 FROM sc JOIN chk k USING (id) WHERE sc.score > 0 AND (contains(lower(coalesce(k.content, '')), 'zzzqqq') OR len(list_filter(coalesce(k.subwords, []), lambda x: starts_with(x, 'zzz'))) > 0)) AS odd, true AS shown, false AS hidden""",
    "h25_path_boost": _BM + _TOP + f"""
, p AS (SELECT sc.id, sc.score, list_filter(list_concat({_SUBS.format(x="regexp_replace(regexp_extract(k.file_path, '([^/]*)$', 1), '^(.+)[.][^.]+$', '" + chr(92) + "1')")}, {_SUBS.format(x="regexp_extract(k.file_path, '([^/]*)/[^/]*$', 1)")}), lambda v: length(v) >= 3) AS w FROM sc JOIN chk k USING (id))
SELECT id, round(score + least(({" + ".join(f"CASE WHEN len(list_filter(w, lambda v: starts_with('{t}', v) OR starts_with(v, '{t}'))) > 0 THEN 1 ELSE 0 END" for t in PATH_TERMS)}) / 3.0, top), 5) AS score FROM p, mx""",
    "h27_weighting": _BM + ", fc AS (" + _TEXT_SQL["s3_s8_file_classes"] + f"""
)
SELECT sc.id, round(sc.score * CASE WHEN k.chunk_type = 'resource' THEN 0.35 WHEN fc.role IN ('model', 'dto', 'assembler', 'exception') THEN 0.65 ELSE 1 END * CASE k.content_type WHEN 'config' THEN 1.5 * 0.7 WHEN 'docs' THEN 0.7 ELSE 1 END
  * CASE WHEN lower(regexp_extract(k.file_path, '([^/]*)$', 1)) IN ('package-lock.json', 'pom.xml', 'maven-wrapper.properties') THEN 0.5 WHEN regexp_matches(lower(k.file_path), '[.](sql|properties)$') OR lower(regexp_extract(k.file_path, '([^/]*)$', 1)) = 'docker-compose.yml' THEN 1.5 ELSE 1 END
  * CASE WHEN coalesce(k.is_test, false) THEN 0.5 ELSE 1 END * CASE WHEN fc.role = 'infra' THEN 0.35 ELSE 1 END + CASE WHEN {_LEAF} = '__init__' THEN 0.5 ELSE 0 END, 5) AS score
FROM sc JOIN chk k USING (id) JOIN fc ON fc.file_path = k.file_path""",
    "v5_suppressed": _BM + ", fc AS (" + _TEXT_SQL["s3_s8_file_classes"] + """
)
SELECT sc.id, round(sc.score * CASE WHEN fc.role IN ('model', 'dto', 'assembler', 'exception') THEN 0.5 ELSE 1 END, 5) AS score FROM sc JOIN chk k USING (id) JOIN fc ON fc.file_path = k.file_path""",
    "e35_type_sharing": _W + _SHARE + " SELECT s AS source_symbol_id, t AS target_symbol_id, round(v, 6) AS sharing FROM sh",
    "v4_blend": _W + _SHARE + """
, pk AS (SELECT id, list_distinct(list_filter(d[coalesce(list_max(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN d[i] IN ('src','source','java','kotlin','scala','groovy') THEN i ELSE 0 END)), 0) + 1 :], lambda x: x <> '')) AS g
  FROM (SELECT id, string_split(file_path, '/')[1:-2] AS d FROM sym)
), vc AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), o AS (SELECT sh.s, sh.t, round(sh.v, 6) AS sharing, CASE WHEN len(a.g) + len(b.g) = 0 THEN 1.0 ELSE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) END AS p,
    round(greatest(0, least(1, list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)))), 6) AS c
  FROM sh JOIN pk a ON a.id = s JOIN pk b ON b.id = sh.t JOIN vc x ON x.id = s JOIN vc y ON y.id = sh.t)
SELECT s AS source_symbol_id, t AS target_symbol_id, round(p, 6) AS package, sharing, c AS cosine,
  round((0.8 * (0.2 * p + 0.2 * sharing + 0.6) + 0.2 * c) * CASE WHEN 0.3 * p + 0.3 * sharing + 0.4 < 0.15 AND c > 0.7 THEN 0.5 ELSE 1 END, 5) AS score FROM o""",
}
