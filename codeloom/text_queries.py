"""Queries over paths, text and full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import redact as R
from codeloom.functions import text as X
from codeloom.operators import lexical as L
from codeloom.operators.common import keep_latest
from codeloom.views import SQL_VIEWS, Corpus

_W = "WITH RECURSIVE " + SQL_VIEWS
SEARCH_TEXT = "rebuild index token cache"
PREFIX_TEXT = "rebuildingQuotas of auditing"
INFORMATIVE_TEXT = "the rebuildIndexes of an audit zzz quota"


def _file_classes(c: Corpus) -> DataFrame:
    defs = c.table("code_chunks").where("is_definition").groupBy(F.col("file_path").alias("f")).agg(F.count("*").alias("defs"))
    files = c.table("files").select("file_path").distinct().join(defs, F.col("file_path") == F.col("f"), "left")
    p = F.col("file_path")
    return files.select(
        "file_path", P.language(p).alias("language"), P.content_axis(p).alias("axis"), P.file_role(p).alias("role"), P.is_test(p).alias("is_test"),
        P.is_non_canonical(p).alias("non_canonical"), P.path_class(p, F.col("defs")).alias("path_class"), P.doc_tier(p).alias("doc_tier"), P.config_tier(p).alias("config_tier"),
    )


def _names(c: Corpus) -> DataFrame:
    s = c.symbols_with("name", "fqn")
    return s.select("id", F.array_join(X.subwords(F.col("name")), " ").alias("subwords"), X.leaf(F.col("fqn")).alias("leaf"), F.levenshtein("name", F.lit("record_span")).alias("distance"),
                    X.concept_match(X.subwords(F.col("name")), "indexes").alias("concept"))


def _tokens(c: Corpus) -> DataFrame:
    d = c.table("documents").where("text is not null")
    return d.select("doc_id", F.size(X.tokens(F.col("text"))).alias("tokens"), F.size(F.array_distinct(X.tokens(F.col("text")))).alias("distinct_tokens"), X.estimated_tokens(F.col("text")).alias("estimate"),
                    X.occurrences(F.col("text"), "the").alias("the"))


def search_scores(c: Corpus) -> DataFrame:
    return c.lexical.bm25(X.full_text_words(SEARCH_TEXT))


def _bm25(c: Corpus) -> DataFrame:
    return search_scores(c).select("id", F.round("score", 6).alias("score"))


def _phrases(c: Corpus) -> DataFrame:
    """Words and sub-words of a query; those that no chunk has as a sub-word stand as prefixes."""
    index = c.lexical
    return index.bm25(index.phrases(PREFIX_TEXT)).select("id", F.round("score", 6).alias("score"))


def _postings(c: Corpus) -> DataFrame:
    return c.lexical.postings.where(F.col("term").isin(*X.full_text_words(SEARCH_TEXT))).select("term", "id", F.round("f", 6).alias("f"), "size")


def _settle(c: Corpus, found: DataFrame) -> DataFrame:
    return keep_latest(found, c.versions, "id")


def _informative(c: Corpus) -> DataFrame:
    index = c.lexical
    terms = L.informative_terms(index.stats, index.chunks, INFORMATIVE_TEXT)
    return c.spark.createDataFrame([(t,) for t in terms], "term string")


def _redacted(c: Corpus) -> DataFrame:
    r = R.redact(F.col("content"))
    found = c.rows.select("id", "updated_at", r.alias("r")).where("r.count > 0").select("id", "updated_at", F.col("r.count").alias("n"), F.md5("r.redacted").alias("digest"))
    return _settle(c, found)


def _redaction_counts(c: Corpus) -> DataFrame:
    counted = _settle(c, c.rows.select("id", "updated_at", *R.redaction_counts(F.col("content"))))
    return counted.agg(*[F.sum(n).alias(n) for n in R.PATTERNS])


def _query(run):
    return lambda spark, sf_dir: run(Corpus(spark, sf_dir))


QUERIES = {
    "s3_s8_file_classes": _query(_file_classes),
    "e25_names": _query(_names),
    "e24_tokens": _query(_tokens),
    "s23_corpus_stats": _query(lambda c: L.corpus_stats(c.chunks_with("language", "subwords"))),
    "j1_postings": _query(_postings),
    "h3_bm25": _query(_bm25),
    "h3_prefix_terms": _query(_phrases),
    "h3_bm25_top": _query(lambda c: L.top(search_scores(c), 50).select("id", F.round("score", 6).alias("score"))),
    "h4_match_counts": _query(lambda c: c.lexical.match_counts(["quota", "audit"])),
    "h7_informative_terms": _query(_informative),
    "x1_literal": _query(lambda c: L.scan_literal(c.rows, "index", c.versions)),
    "x2_all_tokens": _query(lambda c: L.scan_tokens(c.rows, ["index", "token", "the"], True, c.versions)),
    "x2_any_token": _query(lambda c: L.scan_tokens(c.rows, ["heartbeat", "quota audit"], False, c.versions)),
    "x3_regex": _query(lambda c: L.scan_regex(c.rows, "[a-z]+_(?:index|token)\\(", c.versions)),
    "x5_enumerate": _query(lambda c: L.enumerate_kinds(c.rows, ["class"], c.versions)),
    "x5_enumerate_named": _query(lambda c: L.enumerate_named(c.rows, "INDEX", c.versions)),
    "e37_redacted": _query(_redacted),
    "e37_redaction_counts": _query(_redaction_counts),
}


def _l(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(pairs: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_ROOTED = "len(list_filter(range(1, len(p) + 1), lambda i: ({extra}) OR (p[i] IN {roots} AND NOT list_has_any(p[1:i-1], {block})))) > 0"
_IS_TEST = (
    f"(regexp_matches(lower(stem), '{P.TEST_NAMES}') OR regexp_matches(lower(base), '{P.TEST_INFIXES}') OR (ext IN ('.java', '.kt', '.swift') AND regexp_matches(stem, '{P.TEST_CLASSES}')) OR "
    + _ROOTED.format(extra=f"p[i] IN {_l(P.TEST_ROOTS_ALWAYS)} OR (p[i] = 'test' AND i > 1 AND coalesce(p[i-1], '') = 'src')", roots=_l(P.TEST_ROOTS), block=_list(P.MAIN_SEGMENTS)) + ")"
)
_SIDE = (
    f"(regexp_matches(lower(stem), '{P.SIDE_NAMES}') OR regexp_matches(lower(base), '{P.SIDE_INFIXES}') OR (ext IN ('.java', '.kt', '.swift') AND regexp_matches(stem, '{P.SIDE_CLASSES}')) OR "
    + _ROOTED.format(extra="false", roots=_l(P.SIDE_ROOTS), block=_list(P.SOURCE_SEGMENTS)) + ")"
)
_AXIS = f"CASE WHEN ext IN {_l(P.DOCS_EXTENSIONS)} THEN 'docs' WHEN ext IN {_l(P.CONFIG_EXTENSIONS)} OR starts_with(lower(base), '.env') OR lower(base) = 'environment' THEN 'config' ELSE 'code' END"
_FIELDS = """concat_ws(' ')"""

def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


#: The match expression of PREFIX_TEXT: its words, then its sub-words, those that no chunk has as prefixes.
_PHRASE_SQL = """
, tok AS (
  SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+') AS c1, regexp_extract_all(lower(coalesce(array_to_string(subwords, ' '), '')), '[a-z0-9]+') AS c2,
    regexp_extract_all(lower(coalesce(fqn_rel, '')), '[a-z0-9]+') AS c3, regexp_extract_all(lower(coalesce(path_rel, '')), '[a-z0-9]+') AS c4,
    regexp_extract_all(lower(coalesce(declared_rules, '')), '[a-z0-9]+') AS c5, regexp_extract_all(lower(coalesce(content_type, '')), '[a-z0-9]+') AS c6 FROM chk
), sz AS (SELECT *, len(c1) + len(c2) + len(c3) + len(c4) + len(c5) + len(c6) AS d FROM tok
), kn AS (SELECT DISTINCT lower(trim(w)) AS w FROM (SELECT unnest(subwords) AS w FROM chk) WHERE w IS NOT NULL AND trim(w) <> ''
), q(t, pre) AS (
  SELECT t, false FROM (VALUES ('rebuildingquotas'), ('of'), ('auditing')) v(t)
  UNION ALL SELECT CASE WHEN t IN (SELECT w FROM kn) OR length(t) < 3 THEN t ELSE substring(t, 1, 3) END, NOT (t IN (SELECT w FROM kn) OR length(t) < 3) FROM (VALUES ('rebuilding'), ('quotas'), ('of'), ('auditing')) v(t)
), u AS (SELECT t, pre, count(*) AS m FROM q GROUP BY 1, 2
), f AS (
  SELECT id, t, pre, m, d, len(list_filter(c1, lambda x: CASE WHEN pre THEN starts_with(x, t) ELSE x = t END)) * 1.0 + len(list_filter(c2, lambda x: CASE WHEN pre THEN starts_with(x, t) ELSE x = t END)) * 0.6
    + len(list_filter(c3, lambda x: CASE WHEN pre THEN starts_with(x, t) ELSE x = t END)) * 0.5 + len(list_filter(c4, lambda x: CASE WHEN pre THEN starts_with(x, t) ELSE x = t END)) * 0.2
    + len(list_filter(c5, lambda x: CASE WHEN pre THEN starts_with(x, t) ELSE x = t END)) * 0.4 + len(list_filter(c6, lambda x: CASE WHEN pre THEN starts_with(x, t) ELSE x = t END)) * 1.0 AS f FROM sz, u
), st AS (SELECT t, pre, count(*) FILTER (WHERE f > 0) AS n FROM f GROUP BY 1, 2
), g AS (SELECT count(*) AS total, avg(d) AS a FROM sz)
SELECT id, round(sum(CASE WHEN f > 0 THEN m * CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a)) ELSE 0 END), 6) AS score
FROM f JOIN st USING (t, pre), g GROUP BY 1 HAVING max(f) > 0"""
_BM = _W + """
, tok AS (
  SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+') AS c1, regexp_extract_all(lower(coalesce(array_to_string(subwords, ' '), '')), '[a-z0-9]+') AS c2,
    regexp_extract_all(lower(coalesce(fqn_rel, '')), '[a-z0-9]+') AS c3, regexp_extract_all(lower(coalesce(path_rel, '')), '[a-z0-9]+') AS c4,
    regexp_extract_all(lower(coalesce(declared_rules, '')), '[a-z0-9]+') AS c5, regexp_extract_all(lower(coalesce(content_type, '')), '[a-z0-9]+') AS c6 FROM chk
), sz AS (SELECT *, len(c1) + len(c2) + len(c3) + len(c4) + len(c5) + len(c6) AS d FROM tok
), q(t) AS (VALUES ('rebuild'), ('index'), ('token'), ('cache')
), f AS (
  SELECT id, t, d, len(list_filter(c1, lambda x: x = t)) * 1.0 + len(list_filter(c2, lambda x: x = t)) * 0.6 + len(list_filter(c3, lambda x: x = t)) * 0.5
    + len(list_filter(c4, lambda x: x = t)) * 0.2 + len(list_filter(c5, lambda x: x = t)) * 0.4 + len(list_filter(c6, lambda x: x = t)) * 1.0 AS f FROM sz, q
), st AS (SELECT t, count(*) FILTER (WHERE f > 0) AS n FROM f GROUP BY 1
), g AS (SELECT count(*) AS total, avg(d) AS a FROM sz
), sc AS (
  SELECT id, sum(CASE WHEN f > 0 THEN CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a)) ELSE 0 END) AS score
  FROM f JOIN st USING (t), g GROUP BY 1 HAVING max(f) > 0
)"""
_LINES = _W + r"""
, ln AS (SELECT id, coalesce(line_start, 1) + i - 1 AS line_no, rtrim(l[i], chr(13)) AS line FROM (SELECT id, line_start, string_split(content, chr(10)) AS l FROM chk WHERE content IS NOT NULL) x, unnest(range(1, len(l) + 1)) AS u(i))"""

ORACLES = {
    "s3_s8_file_classes": f"""
WITH d AS (SELECT file_path AS f, count(*) AS defs FROM code_chunks WHERE is_definition GROUP BY 1
), x AS (SELECT DISTINCT file_path FROM files
), y AS (SELECT file_path, string_split(file_path, '/') AS p, regexp_extract(file_path, '([^/]*)$', 1) AS base FROM x
), z AS (SELECT *, lower(regexp_extract(base, '^.+(\\.[^.]+)$', 1)) AS ext, regexp_replace(base, '^(.+)\\.[^.]+$', '\\1') AS stem, list_transform(p, lambda v: lower(v)) AS lp FROM y
), w AS (SELECT *, list_concat(string_split_regex(lower(stem), '[._\\-]+'), flatten(list_transform(p, lambda v: string_split_regex(v, '[._\\-]+')))) AS ws FROM z)
SELECT file_path, coalesce({_case(P.LANGUAGES, "substring(ext, 2)")}, {_case(P.NAMED_LANGUAGES, "lower(base)")}) AS language, {_AXIS} AS axis,
  CASE WHEN list_has_any(p, {_list(P.ANALYSIS_SEGMENTS)}) THEN 'analysis' WHEN {_AXIS} = 'docs' THEN 'docs'
    WHEN regexp_matches(lower(base), '{P.INFRA_PREFIXES}') OR regexp_matches(lower(stem), '{P.INFRA_TAILS}') OR ext = '.sh' THEN 'infra'
    WHEN ext NOT IN {_l(P.CODE_EXTENSIONS)} AND list_has_any(p, {_list(P.INFRA_SEGMENTS)}) THEN 'infra' WHEN lower(base) IN {_l(P.INFRA_NAMES)} THEN 'infra'
    {" ".join(f"WHEN list_has_any(ws, {_list(v)}) THEN '{r}'" for r, v in P.ROLE_WORDS)} WHEN ext IN {_l(P.ROLE_CONFIG)} THEN 'config' ELSE 'code' END AS role,
  {_IS_TEST} AS is_test, {_SIDE} AS non_canonical,
  CASE WHEN {_IS_TEST} THEN 'test' WHEN {_SIDE} THEN 'non_canonical' WHEN ends_with(lower(base), '.d.ts') THEN 'dts' WHEN base IN {_l(P.BARRELS)} AND coalesce(d.defs, 0) = 0 THEN 'barrel' ELSE 'canonical' END AS path_class,
  CASE WHEN list_has_any(lp, {_list(P.DOC_THIRD_PARTY)}) THEN 'third_party' WHEN lower(base) IN {_l(P.DOC_GENERATED_NAMES)} OR list_has_any(lp, {_list(P.DOC_GENERATED)}) THEN 'generated'
    WHEN list_contains(lp, 'src') THEN 'nested' WHEN lower(base) IN {_l(P.DOC_ROOT_NAMES)} OR list_has_any(lp, ['docs', 'doc']) THEN 'project' ELSE 'other' END AS doc_tier,
  CASE WHEN list_has_any(lp, {_list(P.CONFIG_GENERATED)}) THEN 'generated' WHEN contains(lower(file_path), 'test/resources') THEN 'test' WHEN list_has_any(lp, {_list(P.CONFIG_SAMPLES)}) THEN 'sample'
    WHEN regexp_matches(lower(base), '^(application|bootstrap)') THEN 'primary' WHEN contains(lower(file_path), '/src/main/resources/') AND contains(lower(file_path), '/config/') THEN 'primary' ELSE 'other' END AS config_tier
FROM w LEFT JOIN d ON d.f = w.file_path""",
    "e25_names": _W + r"""
, s AS (SELECT id, fqn, name, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '[_\-]+'), lambda x: x <> '') AS w FROM sym)
SELECT id, array_to_string(w, ' ') AS subwords, regexp_extract(regexp_replace(fqn, '\(.*$', ''), '([^.:]*)$', 1) AS leaf, CAST(levenshtein(name, 'record_span') AS INTEGER) AS distance,
  list_contains(w, 'indexes') OR len(list_filter(w, lambda x: length(x) >= 4 AND (starts_with(x, 'indexes') OR starts_with('indexes', x)) AND abs(length(x) - 7) <= 3)) > 0 AS concept FROM s""",
    "e24_tokens": """
SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_tokens, length(text) // 4 AS estimate, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS INTEGER) AS the
FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*') AS t FROM documents WHERE text IS NOT NULL)""",
    "s23_corpus_stats": _W + """
, t AS (SELECT coalesce(language, 'unknown') AS language, list_distinct(list_filter(list_transform(subwords, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS w FROM chk)
SELECT 'token' AS section, key, language, count(*) AS doc_count FROM (SELECT language, unnest(w) AS key FROM t) GROUP BY ALL
UNION ALL SELECT 'prefix', key, language, count(*) FROM (SELECT language, unnest(list_distinct(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: substring(x, 1, 3)))) AS key FROM t) GROUP BY ALL""",
    "h3_bm25": _BM + " SELECT id, round(score, 6) AS score FROM sc",
    "h3_bm25_top": _BM + " SELECT id, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, id LIMIT 50",
    "j1_postings": _BM + " SELECT t AS term, id, round(f, 6) AS f, d AS size FROM f WHERE f > 0",
    "h3_prefix_terms": _W + _PHRASE_SQL,
    "h7_informative_terms": _W + """
, sw AS (SELECT id, list_distinct(list_filter(list_transform(subwords, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS w FROM chk
), st AS (SELECT key, count(*) AS d FROM (SELECT unnest(w) AS key FROM sw) GROUP BY 1
), pf AS (SELECT key, sum(1) AS d FROM (SELECT id, unnest(list_distinct(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: substring(x, 1, 3)))) AS key FROM sw) GROUP BY 1
), q(t) AS (VALUES ('rebuild'), ('indexes'), ('audit'), ('zzz'), ('quota')
), d AS (SELECT t, coalesce(st.d, pf.d, 0) AS n FROM q LEFT JOIN st ON st.key = t LEFT JOIN pf ON pf.key = substring(t, 1, 3))
SELECT t AS term FROM d WHERE n > 0 AND (ln((SELECT count(*) FROM chk) / n) >= 0.8 OR n <= 2)""",
    "h4_match_counts": _W + """
, tok AS (SELECT id, is_test, regexp_extract_all(lower(concat_ws(' ', content, array_to_string(subwords, ' '), fqn_rel, path_rel, declared_rules, content_type)), '[a-z0-9]+') AS w FROM chk)
SELECT coalesce(is_test, false) AS is_test, count(*) AS n FROM tok WHERE list_contains(w, 'quota') OR list_contains(w, 'audit') GROUP BY 1""",
    "x1_literal": _LINES + " SELECT id, line_no, CAST((length(line) - length(replace(line, 'index', ''))) // 5 AS INTEGER) AS n FROM ln WHERE contains(line, 'index')",
    "x2_all_tokens": _LINES + " SELECT id, line_no FROM ln WHERE contains(line, 'index') AND contains(line, 'token') AND contains(line, 'the')",
    "x2_any_token": _LINES + " SELECT id, line_no FROM ln WHERE contains(line, 'heartbeat') OR contains(line, 'quota audit')",
    "x3_regex": _LINES + r" SELECT id, line_no, CAST(len(regexp_extract_all(line, '[a-z]+_(?:index|token)\(')) AS INTEGER) AS n FROM ln WHERE regexp_matches(line, '[a-z]+_(?:index|token)\(')",
    "x5_enumerate": _W + "SELECT id, fqn, file_path, line_start FROM chk WHERE is_definition AND chunk_node_type = 'class'",
    "x5_enumerate_named": _W + "SELECT id, fqn, file_path, line_start FROM chk WHERE ends_with(lower(fqn), 'index')",
    "e37_redaction_counts": _W + " SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(content, '{_quoted(p)}'))) AS BIGINT) AS {name}" for name, p in R.PATTERNS.items()) + " FROM chk",
}
