"""Queries over sessions, audit, freshness, coverage, chunking and the star tables' relational shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import chunking as C
from codeloom.operators import ops as O
from codeloom.operators.common import keep_latest, latest_rows
from codeloom.views import SQL_VIEWS, Corpus

_W = "WITH RECURSIVE " + SQL_VIEWS
NOW = "2025-03-01 00:00:00"


def _texts(c: Corpus) -> DataFrame:
    return c.table("documents").select(F.col("doc_id").alias("item"), "text")


def _now():
    return F.to_timestamp(F.lit(NOW))


def _events(c: Corpus) -> DataFrame:
    e = c.table("events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("query_type"), F.col("user_id"), "value")


def _current(c: Corpus) -> DataFrame:
    """The tree as a later walk would see it: files whose code was never kept are gone, grown ones changed."""
    kept = c.table("code_chunks").select("file_path").distinct()
    files = c.table("files").join(kept, "file_path", "left_semi")
    return files.select("file_path", F.when(F.col("size") > 3000, F.sha2(F.col("file_path"), 256)).otherwise(F.col("checksum")).alias("checksum"))


def _freshness(c: Corpus) -> DataFrame:
    return O.freshness(c.table("files").select("file_path", "checksum"), _current(c))


def _refreshed(c: Corpus) -> DataFrame:
    rows = c.chunks_with("file_path", "line_start")
    changes = _freshness(c)
    return O.refreshed(rows, rows.join(changes.where("status = 'modified'"), "file_path", "left_semi").select(*rows.columns), changes)


def _lines(c: Corpus) -> DataFrame:
    """id, updated_at, file_path, language, line_no, line of code, repeats too."""
    rows = c.rows.where("content_type = 'code'")
    split = rows.select("id", "updated_at", "file_path", "language", "line_start", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return split.select("id", "updated_at", "file_path", "language", (F.coalesce("line_start", F.lit(1)) + F.col("at")).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def _held(c: Corpus, found: DataFrame) -> DataFrame:
    return keep_latest(found, c.versions, "id")


def _imports(c: Corpus) -> DataFrame:
    return _held(c, C.import_lines(_lines(c), "id", "updated_at")).drop("id")


def _rationale(c: Corpus) -> DataFrame:
    marked = _held(c, _lines(c).where(F.col("line").rlike(C.RATIONALE)).select("id", "updated_at", "file_path", "line_no", "line"))
    return C.rationale(marked, c.symbols_with("file_path", "line_start", "line_end"))


def _embed_sizes(c: Corpus) -> DataFrame:
    return _held(c, C.embed_text(c.rows, "updated_at").select("id", "updated_at", F.char_length("text").alias("size"), F.md5("text").alias("digest")))


def _slices(c: Corpus) -> DataFrame:
    return _held(c, C.source_slice(c.rows, "updated_at").select("id", "updated_at", F.md5("slice").alias("digest")))


def _small_chunks(c: Corpus) -> DataFrame:
    rows = latest_rows(c.rows.withColumn("size", F.char_length("content")), "id", ["file_path", "line_start", "line_end", "size"])
    return rows.where("line_start is not null and line_end is not null").select("file_path", "line_start", "line_end", "size")


def _anchored(c: Corpus) -> DataFrame:
    rows = latest_rows(c.rows.withColumn("size", F.char_length("content")), "id", ["file_path", "line_start", "line_end", "size", "is_definition"])
    return C.anchored(rows)


def _digest(c: Corpus) -> DataFrame:
    counts = {t: c.table(t).count() for t in ("symbols", "edges", "code_chunks", "files")}
    return c.spark.createDataFrame([(O.generation_digest("corpus", counts, ("1",)),)], "digest string")


def _nation_trade(c: Corpus) -> DataFrame:
    """Who sells to whom, in hundredths of a cent: the star tables as a graph, aggregated before it is
    joined to nations."""
    line = c.table("lineitem").select("l_orderkey", "l_suppkey", (F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))).alias("v"))
    order = c.table("orders").select("o_orderkey", "o_custkey")
    by = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.sum("v").alias("v"))
    cust = c.table("customer").select("c_custkey", F.col("c_nationkey").alias("buyer"))
    supp = c.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("seller"))
    pairs = by.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return pairs.groupBy("seller", "buyer").agg(F.sum("v").alias("value"))


def _hierarchy(c: Corpus) -> DataFrame:
    """customers below nations below regions, with their depth."""
    r = c.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = c.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    k = c.table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    from codeloom.operators.hierarchy import build_forest

    return build_forest(r.unionByName(n).unionByName(k), "id", "parent", "name").positions().select("id", "root_id", "depth")


def _index(c: Corpus) -> DataFrame:
    """The full index: every relation of the corpus rebuilt for this state of its tables."""
    return c.spark.createDataFrame(sorted(c.build().items()), "relation string, row_count long")


def _query(run):
    return lambda spark, sf_dir: run(Corpus(spark, sf_dir))


QUERIES = {
    "m2_session_weights": _query(lambda c: O.session_weights(c.table("sessions"), _now()).select("file_path", F.round("weight", 6).alias("weight"))),
    "m2_suffix_weights": _query(
        lambda c: O.suffix_weights(
            c.chunks_with("path_rel").select(F.col("path_rel").alias("file_path")).distinct(),
            O.session_weights(c.table("sessions"), _now()).select(F.regexp_replace("file_path", "^[^/]+/", "").alias("file_path"), "weight").groupBy("file_path").agg(F.max("weight").alias("weight")),
        ).select("file_path", F.round("weight", 6).alias("weight"))
    ),
    "m3_audit_page": _query(lambda c: O.audit_page(_events(c), "click", 50, 100).select("id", "timestamp", "user_id")),
    "m5_latency_percentiles": _query(lambda c: O.latency_percentiles(_events(c), ["query_type"], "value", "id")),
    "m5_last_latencies": _query(lambda c: O.last_n(_events(c), ["user_id"], [F.desc("timestamp"), F.desc("id")], 3).select("user_id", "id", "value")),
    "m4_freshness": _query(_freshness),
    "s22_refreshed": _query(_refreshed),
    "g32_coverage": _query(lambda c: O.coverage(c.table("files"), c.chunks_with("file_path"), c.symbols_with("file_path"))),
    "g32_scope_coverage": _query(lambda c: O.scope_coverage(O.coverage(c.table("files"), c.chunks_with("file_path"), c.symbols_with("file_path")))),
    "s25_digest": _query(_digest),
    "s27_unusable": _query(lambda c: O.unusable(c.symbols_with("file_path", "line_start", "line_end"), c.symbols_with("file_path", "line_end").where("file_path is not null").groupBy("file_path").agg(F.max("line_end").alias("lines")))),
    "s12_lock_excerpts": _query(lambda c: C.lock_excerpts(c.table("documents").select(F.concat_ws("/", F.coalesce("repo", F.lit("r")), F.when(F.col("doc_id") % 3 == 0, "yarn.lock").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".md")))).alias("file_path"), "text", "doc_id"), "doc_id").select("doc_id", F.md5("excerpt").alias("digest"))),
    "s27_merged_ranges": _query(lambda c: O.merged_ranges(c.symbols_with("file_path", "line_start", "line_end"))),
    "s10_heading_chunks": _query(lambda c: C.heading_chunks(_texts(c))),
    "s11_line_blocks": _query(lambda c: C.line_blocks(_texts(c), 20)),
    "s9_coalesced": _query(lambda c: C.coalesced(_small_chunks(c), 750)),
    "s9_anchored": _query(_anchored),
    "s11_paragraphs": _query(lambda c: C.paragraphs(_texts(c), 20)),
    "s21_index": _query(_index),
    "s15_imports": _query(_imports),
    "s16_rationale": _query(_rationale),
    "s32_slice": _query(_slices),
    "s19_embed_text": _query(_embed_sizes),
    "m7_stats": _query(lambda c: c.chunks_with("language", "content_type").groupBy("language", "content_type").agg(F.count("*").alias("chunks"))),
    "j4_nation_trade": _query(_nation_trade),
    "j10_region_tree": _query(_hierarchy),
}

_WEIGHTS = f"""
sw AS (
  SELECT file_path, max(coalesce(weight_score, CASE event_type WHEN 'WRITE' THEN 1.0 WHEN 'READ' THEN 0.7 ELSE 0.0 END) * exp(-0.1 * (epoch_us(TIMESTAMP '{NOW}') - epoch_us(event_time)) / 3600000000.0)) AS weight
  FROM sessions WHERE file_path IS NOT NULL AND event_time IS NOT NULL AND event_time <= TIMESTAMP '{NOW}' AND (ttl_expires_at IS NULL OR ttl_expires_at > TIMESTAMP '{NOW}') GROUP BY 1
)"""
_FRESH = """
, cur AS (SELECT f.file_path, CASE WHEN f.size > 3000 THEN sha256(f.file_path) ELSE f.checksum END AS checksum FROM files f WHERE f.file_path IN (SELECT file_path FROM code_chunks)
), fr AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.file_path IS NULL THEN 'deleted' WHEN a.file_path IS NULL THEN 'new' WHEN a.checksum IS DISTINCT FROM b.checksum THEN 'modified' END AS status
  FROM files a FULL JOIN cur b ON a.file_path = b.file_path)"""
_COV = """
, cov AS (SELECT f.file_path, CASE WHEN f.parse_failed THEN 'parse_failed' WHEN c.n IS NULL AND s.n IS NULL THEN 'missing' ELSE 'ok' END AS status, coalesce(c.n, 0) AS chunks, coalesce(s.n, 0) AS symbols
  FROM files f LEFT JOIN (SELECT file_path, count(*) AS n FROM chk GROUP BY 1) c ON c.file_path = f.file_path LEFT JOIN (SELECT file_path, count(*) AS n FROM sym GROUP BY 1) s ON s.file_path = f.file_path)"""

ORACLES = {
    "m2_session_weights": "WITH " + _WEIGHTS + " SELECT file_path, round(weight, 6) AS weight FROM sw",
    "m2_suffix_weights": _W + "," + _WEIGHTS + """
, b AS (SELECT regexp_replace(file_path, '^[^/]+/', '') AS p, max(weight) AS w FROM sw GROUP BY 1)
SELECT x.path_rel AS file_path, round(max(b.w), 6) AS weight FROM (SELECT DISTINCT path_rel FROM chk) x JOIN b ON x.path_rel = b.p OR ends_with(x.path_rel, '/' || b.p) GROUP BY 1""",
    "m3_audit_page": "SELECT event_id AS id, ts AS timestamp, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100",
    "m5_latency_percentiles": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type AS query_type, max(n) AS n, max(CASE WHEN i = least(n * 50 // 100, n - 1) THEN value END) AS p50, max(CASE WHEN i = least(n * 95 // 100, n - 1) THEN value END) AS p95, max(CASE WHEN i = least(n * 99 // 100, n - 1) THEN value END) AS p99 FROM r GROUP BY 1""",
    "m5_last_latencies": "SELECT user_id, event_id AS id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3",
    "m4_freshness": _W + _FRESH + " SELECT file_path, status FROM fr WHERE status IS NOT NULL",
    "s22_refreshed": _W + _FRESH + """
SELECT id, file_path, line_start FROM chk WHERE file_path NOT IN (SELECT file_path FROM fr WHERE status IS NOT NULL)
UNION ALL SELECT id, file_path, line_start FROM chk WHERE file_path IN (SELECT file_path FROM fr WHERE status = 'modified')""",
    "g32_coverage": _W + _COV + " SELECT * FROM cov",
    "g32_scope_coverage": _W + _COV + """
SELECT string_split(file_path, '/')[1] AS scope, count(*) AS files, CASE WHEN count(*) FILTER (WHERE status = 'missing') > 0 THEN 'missing' WHEN count(*) FILTER (WHERE status = 'parse_failed') > 0 THEN 'parse_failed' ELSE 'ok' END AS worst FROM cov GROUP BY 1""",
    "s27_unusable": _W + """
, n AS (SELECT file_path, max(line_end) AS lines FROM sym WHERE file_path IS NOT NULL GROUP BY 1
), l AS (SELECT DISTINCT file_path, i FROM sym, unnest(range(line_start, line_end + 1)) AS u(i) WHERE file_path IS NOT NULL AND line_start IS NOT NULL AND line_end >= line_start
), c AS (SELECT file_path, count(*) AS covered FROM l GROUP BY 1)
SELECT n.file_path, coalesce(c.covered, 0) AS covered, coalesce(c.covered, 0) >= 0.8 * n.lines AS unusable FROM n LEFT JOIN c ON c.file_path = n.file_path""",
    "s12_lock_excerpts": "SELECT doc_id, md5(substring(text, 1, 2000)) AS digest FROM documents WHERE doc_id % 3 = 0",
    "s27_merged_ranges": _W + """
, r AS (SELECT file_path, line_start, line_end, max(line_end) OVER (PARTITION BY file_path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sym WHERE file_path IS NOT NULL AND line_start IS NOT NULL AND line_end >= line_start
), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR line_start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM r)
SELECT file_path, min(line_start) AS line_start, max(line_end) AS line_end FROM g GROUP BY file_path, isl""",
    "s10_heading_chunks": r"""
WITH l AS (SELECT doc_id AS item, i AS no, rtrim(x[i], chr(13)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) t, unnest(range(1, len(x) + 1)) AS u(i)
), m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*(?:```|~~~)') THEN 1 ELSE 0 END) OVER w % 2 = 1 AS fenced, lead(line) OVER (PARTITION BY item ORDER BY no) AS nxt FROM l WINDOW w AS (PARTITION BY item ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), h AS (SELECT *, (regexp_matches(line, '^#{1,6}\s+\S|^={1,6}\s+\S') OR (regexp_matches(line, '\S') AND coalesce(regexp_matches(nxt, '^(?:={3,}|-{3,})\s*$'), false) AND NOT regexp_matches(line, '^\s*(?:[-*+>|]|\d+\.)'))) AND NOT fenced AS head FROM m
), s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY item ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h
), b AS (SELECT *, (no - min(no) OVER (PARTITION BY item, section)) // 100 AS block FROM s)
SELECT item, CAST(min(no) AS INTEGER) AS line_start, CAST(max(no) AS INTEGER) AS line_end, first(CASE WHEN head THEN trim(regexp_replace(line, '^[#=]+', '')) END ORDER BY no) AS heading FROM b GROUP BY item, section, block""",
    "s11_line_blocks": """
SELECT doc_id AS item, CAST(i AS INTEGER) AS line_start, CAST(least(i + 19, n) AS INTEGER) AS line_end FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL) t, unnest(range(1, n + 1, 20)) AS u(i)""",
    "s9_anchored": _W + """
, pc AS (SELECT id, file_path, line_start, line_end, length(content) AS size, coalesce(is_definition, false) AS d FROM chk WHERE file_path IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL
), en AS (SELECT l.id, a.id AS anchor, a.size AS asize, row_number() OVER (PARTITION BY l.id ORDER BY a.line_end - a.line_start, a.id) AS rn FROM pc l JOIN pc a ON a.d AND NOT l.d AND a.file_path = l.file_path AND l.line_start BETWEEN a.line_start AND a.line_end
), hd AS (SELECT l.*, en.anchor, en.asize, sum(l.size) OVER (PARTITION BY en.anchor ORDER BY l.line_start, l.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM pc l LEFT JOIN en ON en.id = l.id AND en.rn = 1 WHERE NOT l.d
), tk AS (SELECT anchor, count(*) AS n, max(line_end) AS le, min(line_start) AS ls FROM hd WHERE anchor IS NOT NULL AND asize + run <= 750 GROUP BY 1
), o AS (SELECT file_path, line_start, line_end, size FROM hd WHERE anchor IS NULL OR NOT coalesce(asize + run <= 750, true)
), g AS (SELECT *, CASE WHEN line_start > lag(line_end) OVER (PARTITION BY file_path ORDER BY line_start, line_end) + 2 THEN 1 ELSE 0 END AS gap FROM o
), r AS (SELECT *, sum(gap) OVER (PARTITION BY file_path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rn FROM g
), t AS (SELECT *, (sum(size) OVER (PARTITION BY file_path, rn ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) // 750 AS piece FROM r)
SELECT p.file_path, least(p.line_start, tk.ls) AS line_start, greatest(p.line_end, tk.le) AS line_end, p.id AS anchor, 1 + coalesce(tk.n, 0) AS n FROM pc p LEFT JOIN tk ON tk.anchor = p.id WHERE p.d
UNION ALL SELECT file_path, min(line_start), max(line_end), NULL, count(*) FROM t GROUP BY file_path, rn, piece""",
    "s11_paragraphs": r"""
WITH d AS (SELECT doc_id AS item, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), x AS (SELECT item, i AS no FROM d, unnest(range(1, len(l) + 1)) AS u(i) WHERE len(l) > 20 AND regexp_matches(l[i], '\S')
), y AS (SELECT *, CASE WHEN no > lag(no) OVER (PARTITION BY item ORDER BY no) + 1 THEN 1 ELSE 0 END AS f FROM x
), z AS (SELECT *, sum(f) OVER (PARTITION BY item ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM y
), b AS (SELECT *, (no - min(no) OVER (PARTITION BY item, r)) // 20 AS k FROM z)
SELECT item, 1 AS line_start, CAST(len(l) AS INTEGER) AS line_end FROM d WHERE len(l) <= 20
UNION ALL SELECT item, CAST(min(no) AS INTEGER), CAST(max(no) AS INTEGER) FROM b GROUP BY item, r, k""",
    "s9_coalesced": _W + """
, c AS (SELECT file_path, line_start, line_end, length(content) AS size FROM chk WHERE line_start IS NOT NULL AND line_end IS NOT NULL
), r AS (SELECT *, CASE WHEN line_start > lag(line_end) OVER w + 2 THEN 1 ELSE 0 END AS gap FROM c WINDOW w AS (PARTITION BY file_path ORDER BY line_start, line_end)
), q AS (SELECT *, sum(gap) OVER (PARTITION BY file_path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r
), p AS (SELECT *, (sum(size) OVER (PARTITION BY file_path, run ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) // 750 AS piece FROM q)
SELECT file_path, min(line_start) AS line_start, max(line_end) AS line_end, count(*) AS n FROM p GROUP BY file_path, run, piece""",
    "s21_index": _W + """
, w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(concat_ws(' ', content, array_to_string(subwords, ' '), fqn_rel, path_rel, declared_rules, content_type)), '[a-z0-9]+')) AS t FROM chk
), t AS (SELECT coalesce(language, 'unknown') AS language, list_distinct(list_filter(list_transform(subwords, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')) AS w FROM chk
), st AS (SELECT DISTINCT 'token' AS s, language, unnest(w) AS k FROM t UNION ALL SELECT DISTINCT 'prefix', language, unnest(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: substring(x, 1, 3))) FROM t)
SELECT 'symbols' AS relation, count(*) AS row_count FROM sym UNION ALL SELECT 'edges', count(*) FROM edg UNION ALL SELECT 'resolved_edges', count(*) FROM res UNION ALL SELECT 'chunks', count(*) FROM chk
UNION ALL SELECT 'postings', count(*) FROM w UNION ALL SELECT 'subword_stats', count(*) FROM st""",
    "s25_digest": "SELECT substr(sha256('corpus|code_chunks=' || (SELECT count(*) FROM code_chunks) || '|edges=' || (SELECT count(*) FROM edges) || '|files=' || (SELECT count(*) FROM files) || '|symbols=' || (SELECT count(*) FROM symbols) || '|1'), 1, 32) AS digest",
    "s16_rationale": _W + r"""
, ln AS (SELECT DISTINCT id, file_path, coalesce(line_start, 1) + i - 1 AS line_no, rtrim(l[i], chr(13)) AS line FROM (SELECT id, file_path, line_start, string_split(content, chr(10)) AS l FROM chk WHERE content IS NOT NULL AND content_type = 'code') x, unnest(range(1, len(l) + 1)) AS u(i)
), mk AS (SELECT file_path, line_no, lower(regexp_extract(line, '(?i)(?:#|//|/?\*|--)\s*(note|why|hack|todo|fixme|adr)\b[:\s-]*(.*)$', 1)) AS kind, trim(regexp_extract(line, '(?i)(?:#|//|/?\*|--)\s*(note|why|hack|todo|fixme|adr)\b[:\s-]*(.*)$', 2)) AS text FROM ln
), hit AS (SELECT * FROM mk WHERE kind <> ''
), sp AS (SELECT h.file_path, h.line_no, s.id, row_number() OVER (PARTITION BY h.file_path, h.line_no ORDER BY s.line_end - s.line_start, s.id) AS rn FROM (SELECT DISTINCT file_path, line_no FROM hit) h JOIN sym s ON s.file_path = h.file_path AND h.line_no BETWEEN s.line_start AND s.line_end)
SELECT h.file_path, h.line_no, h.kind, h.text, sp.id AS symbol_id FROM hit h LEFT JOIN sp ON sp.file_path = h.file_path AND sp.line_no = h.line_no AND sp.rn = 1""",
    "s19_embed_text": _W + r"""
, p AS (SELECT id, substring(coalesce(content, ''), 1, 2000) AS body, trim(concat_ws(' ', replace(regexp_replace(path_rel, '\.[^./]+$', ''), '/', '.'), regexp_replace(coalesce(fqn_rel, ''), '^.*::', ''))) AS head FROM chk
), x AS (SELECT id, CASE WHEN 2000 - length(body) - 1 > 0 THEN substring(head, 1, 2000 - length(body) - 1) || chr(10) || body ELSE body END AS text FROM p)
SELECT id, CAST(length(text) AS INTEGER) AS size, md5(text) AS digest FROM x""",
    "s15_imports": _W + r"""
, ln AS (SELECT file_path, language, coalesce(line_start, 1) + i - 1 AS line_no, rtrim(l[i], chr(13)) AS line FROM (SELECT file_path, language, line_start, string_split(content, chr(10)) AS l FROM chk WHERE content IS NOT NULL AND content_type = 'code') x, unnest(range(1, len(l) + 1)) AS u(i)
), m AS (SELECT file_path, line_no, CASE WHEN language = 'python' THEN coalesce(nullif(regexp_extract(line, '^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))', 1), ''), nullif(regexp_extract(line, '^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))', 2), ''))
  WHEN language = 'java' THEN nullif(regexp_extract(line, '^\s*import\s+(?:static\s+)?([\w.*]+)\s*;', 1), '')
  WHEN language IN ('javascript','typescript') THEN nullif(regexp_extract(line, '^\s*(?:import\s.*?from\s+|import\s+|export\s.*?from\s+)["'']([^"'']+)["'']', 1), '')
  WHEN language = 'go' THEN nullif(regexp_extract(line, '^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', 1), '') END AS module FROM ln)
SELECT file_path, line_no, module FROM m WHERE module IS NOT NULL""",
    "s32_slice": _W + "SELECT id, md5(array_to_string(string_split(content, chr(10))[1:greatest(line_end - line_start + 1, 1)], chr(10))) AS digest FROM chk",
    "m7_stats": _W + "SELECT language, content_type, count(*) AS chunks FROM chk GROUP BY ALL",
    "j4_nation_trade": """
SELECT s_nationkey AS seller, c_nationkey AS buyer, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "j10_region_tree": """
SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS root_id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
