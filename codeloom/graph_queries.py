"""Queries over graph statics, with SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.views import SQL_VIEWS, Corpus

_W = "WITH RECURSIVE " + SQL_VIEWS
_USE = "('CALLS','INHERITS','IMPLEMENTS','REFERENCES','USAGE','CALL_REFERENCE')"


def _query(run):
    return lambda spark, sf_dir: run(Corpus(spark, sf_dir))


def _dead(c: Corpus) -> DataFrame:
    return G.dead_code(c.symbols_with("fqn", "name", "kind", "is_test", "is_entry_point", "parent_symbol_id", "importance"), c.edges).drop("importance", "is_test")


def _entry(c: Corpus) -> DataFrame:
    return G.entry_points(c.symbols, c.resolved_edges, configured=("run_*", "*Handler"))


def _enclosing(c: Corpus) -> DataFrame:
    """The chunk that each call line lies in: the smallest one of the caller's file."""
    caller = c.symbols_with("file_path").select(F.col("id").alias("source_symbol_id"), "file_path")
    points = c.resolved_edges.where("edge_type = 'CALLS'").select(F.col("id").alias("edge_id"), "source_symbol_id", F.get("source_range", F.lit(0)).alias("line"))
    points = points.join(caller, "source_symbol_id").select("edge_id", "file_path", "line")
    spans = c.chunks_with("file_path", "line_start", "line_end").withColumnRenamed("id", "span_id")
    return G.smallest_enclosing(points, spans, ["edge_id"]).select("edge_id", F.col("span_id").alias("chunk_id"))


QUERIES = {
    "g27_degrees": _query(lambda c: G.degrees(c.resolved_edges)),
    "a19_importance": _query(lambda c: G.importance(c.symbols_with("name", "file_path", "visibility", "is_test"), c.resolved_edges)),
    "g21_edge_stats": _query(lambda c: G.edge_stats(c.edges)),
    "g30_graph_schema": _query(lambda c: G.graph_schema(c.symbols_with("kind", "language"), c.edges)),
    "g30_unresolved_top": _query(lambda c: G.unresolved_targets(c.edges, 50)),
    "g22_tests_edges": _query(lambda c: G.tests_edges(c.symbols_with("is_test"), c.resolved_edges)),
    "g23_interface_dispatch": _query(lambda c: G.dispatch_edges(c.symbols_with("fqn", "name", "kind", "parent_symbol_id"), c.resolved_edges)),
    "g24_edge_validation": _query(lambda c: G.validated_edges(c.symbols_with("name", "file_path", "line_start", "line_end"), c.edges, c.hot_targets)),
    "g25_entry_points": _query(_entry),
    "g26_canonical_names": _query(lambda c: G.canonical_names(c.symbols_with("fqn", "canonical_fqn", "conventional_fqn"))),
    "g29_dead_code": _query(_dead),
    "g28_connected": _query(
        lambda c: G.symbol_search(c.symbols, c.resolved_edges, qualified_pattern=".*(Index|Cache)[A-Za-z]*", edge_types=("CALLS",), connected=10, exclude_entry_points=False).select("id", "degree", F.array_join("connected", " ").alias("connected"))
    ),
    "g28_symbol_search": _query(lambda c: G.symbol_search(c.symbols, c.resolved_edges, text="index", kinds=("function", "method"), min_degree=1, max_degree=40)),
    "g31_outline": _query(lambda c: G.outline(c.symbols, "pending-index-difisu/src/core/tracing.py")),
    "g15_hotspots": _query(lambda c: G.hotspots(c.symbols_with("fqn", "importance", "is_test"), c.resolved_edges, 25)),
    "g19_isolated": _query(lambda c: G.isolated(c.symbols_with("fqn"), c.resolved_edges)),
    "g20_packages": _query(lambda c: G.packages(c.symbols_with("file_path", "is_test"))),
    "g33_implementations": _query(lambda c: G.implementations(c.symbols_with("kind"), c.resolved_edges)),
    "j6_enclosing_chunk": _query(_enclosing),
    "a13_neighbours_top": _query(
        lambda c: G.top_per_group(
            c.resolved_edges.groupBy(F.col("source_symbol_id").alias("symbol_id"), F.col("target_symbol_id").alias("neighbour")).agg(F.count("*").alias("n")),
            ["symbol_id"], [F.desc("n"), F.asc("neighbour")], 10,
        )
    ),
    "s33_trust_labels": _query(
        lambda c: c.edges.groupBy("edge_type", G.confidence(F.col("resolution_tier"), F.col("resolved")).alias("label")).agg(F.count("*").alias("n"))
    ),
}

ORACLES = {
    "g27_degrees": _W + """
SELECT symbol_id, edge_type, CAST(sum(i) AS BIGINT) AS in_count, CAST(sum(o) AS BIGINT) AS out_count FROM (
  SELECT source_symbol_id AS symbol_id, edge_type, 0 AS i, 1 AS o FROM res UNION ALL SELECT target_symbol_id, edge_type, 1, 0 FROM res
) GROUP BY ALL""",
    "a19_importance": _W + """
, uses AS (SELECT target_symbol_id AS t, count(*) AS n FROM res WHERE edge_type IN ('CALLS','USAGE') GROUP BY 1
), spread AS (SELECT name, count(DISTINCT file_path) AS files FROM sym GROUP BY 1)
SELECT s.id, round(sqrt(coalesce(u.n, 0)) * CASE WHEN visibility IN ('private','package','internal') THEN 0.1 ELSE 1.0 END * CASE WHEN files >= 5 THEN 0.1 ELSE 1.0 END
  * CASE WHEN length(s.name) >= 8 AND (contains(s.name, '_') OR regexp_matches(s.name, '[a-z0-9][A-Z]')) THEN 10.0 ELSE 1.0 END * CASE WHEN is_test THEN 0.1 ELSE 1.0 END, 6) AS importance
FROM sym s LEFT JOIN uses u ON u.t = s.id LEFT JOIN spread p ON p.name = s.name""",
    "g21_edge_stats": _W + """
SELECT edge_type, count(*) AS total, count(*) FILTER (WHERE resolved AND target_symbol_id IS NOT NULL) AS resolved,
  round(count(*) FILTER (WHERE resolved AND target_symbol_id IS NOT NULL) / count(*), 4) AS ratio FROM edg GROUP BY 1""",
    "g30_graph_schema": _W + """
SELECT 'label' AS section, kind AS key, count(*) AS n FROM sym GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM sym GROUP BY 2
UNION ALL SELECT 'edge_type', edge_type, count(*) FROM edg GROUP BY 2 UNION ALL SELECT 'tier', resolution_tier, count(*) FROM edg GROUP BY 2
UNION ALL SELECT 'property', k, count(*) FROM (SELECT unnest(map_keys(properties)) AS k FROM edg) GROUP BY 2""",
    "g30_unresolved_top": _W + """
SELECT target_raw, count(*) AS n FROM edg WHERE NOT resolved AND target_raw IS NOT NULL AND target_raw <> '' GROUP BY 1 ORDER BY n DESC, target_raw LIMIT 50""",
    "g22_tests_edges": _W + f"""
SELECT DISTINCT e.source_symbol_id, e.target_symbol_id FROM res e JOIN sym s ON s.id = e.source_symbol_id JOIN sym t ON t.id = e.target_symbol_id
WHERE e.edge_type IN {_USE} AND s.is_test AND NOT t.is_test AND e.source_symbol_id <> e.target_symbol_id""",
    "g23_interface_dispatch": _W + r"""
, ar AS (
  SELECT id, name, kind, parent_symbol_id, CASE WHEN regexp_matches(fqn, '\([^()]*\)$') THEN
    CASE WHEN trim(regexp_extract(fqn, '\(([^()]*)\)$', 1)) = '' THEN 0
      ELSE len(string_split(regexp_replace(regexp_replace(regexp_extract(fqn, '\(([^()]*)\)$', 1), '[<\[][^<>\[\]]*[>\]]', '', 'g'), '[<\[][^<>\[\]]*[>\]]', '', 'g'), ',')) END END AS n FROM sym
), sub AS (
  SELECT DISTINCT target_symbol_id AS base, source_symbol_id AS s FROM res WHERE edge_type IN ('IMPLEMENTS','INHERITS')
), clo AS (
  SELECT base AS root, s FROM sub UNION SELECT c.root, b.s FROM clo c JOIN sub b ON b.base = c.s
), calls AS (SELECT DISTINCT source_symbol_id, target_symbol_id FROM res WHERE edge_type = 'CALLS')
SELECT DISTINCT c.source_symbol_id, m.id AS target_symbol_id FROM calls c JOIN ar d ON d.id = c.target_symbol_id JOIN sym p ON p.id = d.parent_symbol_id AND p.kind = 'interface'
JOIN clo k ON k.root = p.id AND k.s <> p.id JOIN ar m ON m.parent_symbol_id = k.s AND m.kind IN ('method','constructor') AND m.name = d.name AND (m.n IS NULL OR d.n IS NULL OR m.n = d.n)
WHERE m.id <> c.source_symbol_id AND NOT EXISTS (SELECT 1 FROM calls x WHERE x.source_symbol_id = c.source_symbol_id AND x.target_symbol_id = m.id)""",
    "g24_edge_validation": _W + """
, j AS (
  SELECT e.id, e.source_symbol_id, e.target_symbol_id, e.resolution_tier, e.source_range[1] AS line, s.line_start AS s0, s.line_end AS s1, s.name AS sname, s.file_path AS sfile, t.name AS tname, t.file_path AS tfile
  FROM edg e LEFT JOIN sym s ON s.id = e.source_symbol_id LEFT JOIN sym t ON t.id = e.target_symbol_id
), r AS (
  SELECT *, CASE WHEN source_symbol_id = target_symbol_id AND NOT coalesce(line BETWEEN s0 AND s1, false) THEN 1
    WHEN line IS NOT NULL AND s0 IS NOT NULL AND s1 IS NOT NULL AND NOT coalesce(line BETWEEN s0 AND s1, false) THEN 2
    WHEN source_symbol_id <> target_symbol_id AND sname = tname AND sfile = tfile THEN 3 END AS rule FROM j
)
SELECT id, rule AS dropped_by FROM r WHERE rule IS NOT NULL
UNION ALL SELECT id, 4 FROM r WHERE rule IS NULL AND resolution_tier IN ('range','fallback') AND EXISTS (
  SELECT 1 FROM r b WHERE b.rule IS NULL AND b.source_symbol_id = r.source_symbol_id AND b.tname = r.tname AND b.resolution_tier IN ('exact','conventional','same_file'))""",
    "g25_entry_points": _W + r"""
, bases AS (SELECT DISTINCT source_symbol_id AS sub, target_symbol_id AS base FROM res WHERE edge_type IN ('INHERITS','IMPLEMENTS')
), ovr AS (SELECT DISTINCT m.id FROM sym m JOIN bases b ON b.sub = m.parent_symbol_id JOIN sym o ON o.parent_symbol_id = b.base AND o.name = m.name WHERE m.kind = 'method')
SELECT * FROM (SELECT s.id, CASE WHEN is_test THEN 'test' WHEN name IN ('main','__main__') AND kind IN ('function','method') THEN 'main'
  WHEN kind = 'constructor' OR (name IN ('__init__','__new__') AND parent_symbol_id IS NOT NULL) THEN 'constructor' WHEN o.id IS NOT NULL THEN 'override'
  WHEN parent_symbol_id IS NULL AND visibility = 'public' THEN 'exported'
  WHEN regexp_matches(declared_rules, '(?i)@(?:app\.(?:route|get|post|put|patch|delete|websocket)|router\.|blueprint\.|(?:get|post|put|delete|patch|head|options|request)mapping|path|route|handler|endpoint|(?:rest)?controller|pytest\.fixture|fixture|bean|eventlistener|scheduled|commandlinerunner|applicationrunner|(?:before|after)each|main)') THEN 'annotation'
  WHEN name GLOB 'run_*' OR name GLOB '*Handler' OR fqn GLOB 'run_*' OR fqn GLOB '*Handler' THEN 'configured' END AS reason
FROM sym s LEFT JOIN ovr o ON o.id = s.id) WHERE reason IS NOT NULL""",
    "g26_canonical_names": _W + "SELECT id, coalesce(canonical_fqn, conventional_fqn, fqn) AS canonical FROM sym",
    "g29_dead_code": _W + f"""
, inc AS (
  SELECT e.target_symbol_id AS t, count(*) FILTER (WHERE NOT s.is_test AND coalesce(e.resolution_tier, '') NOT IN ('ambiguous','fallback')) AS proven,
    count(*) FILTER (WHERE NOT s.is_test AND coalesce(e.resolution_tier, '') IN ('ambiguous','fallback')) AS low_confidence, count(*) FILTER (WHERE s.is_test) AS test_usage
  FROM res e JOIN sym s ON s.id = e.source_symbol_id WHERE e.edge_type IN {_USE} GROUP BY 1
), words AS (
  SELECT word, count(*) AS n FROM (SELECT id, unnest(list_distinct(regexp_extract_all(target_raw, '[A-Za-z0-9_]+'))) AS word FROM edg
    WHERE NOT resolved AND target_raw IS NOT NULL AND target_raw <> '' AND edge_type IN {_USE}) GROUP BY 1
)
SELECT s.id, s.fqn, s.kind, CASE WHEN coalesce(low_confidence, 0) > 0 THEN 'low' WHEN coalesce(test_usage, 0) > 0 OR coalesce(w.n, 0) > 0 THEN 'medium' ELSE 'high' END AS confidence,
  coalesce(low_confidence, 0) AS low_confidence, coalesce(test_usage, 0) AS test_usage, coalesce(w.n, 0) AS unresolved
FROM sym s LEFT JOIN sym p ON p.id = s.parent_symbol_id LEFT JOIN inc ON inc.t = s.id LEFT JOIN words w ON w.word = s.name
WHERE s.kind IN ('function','method','constructor') AND NOT s.is_test AND NOT s.is_entry_point AND coalesce(p.kind, '') <> 'interface' AND coalesce(proven, 0) = 0""",
    "g28_connected": _W + """
, sel AS (SELECT id FROM sym WHERE regexp_full_match(fqn, '.*(Index|Cache)[A-Za-z]*')
), u AS (SELECT source_symbol_id AS a, target_symbol_id AS b FROM res WHERE edge_type = 'CALLS'
), dg AS (SELECT m, count(*) AS d FROM (SELECT a AS m FROM u UNION ALL SELECT b FROM u) GROUP BY 1
), e AS (SELECT me, other, count(*) AS n FROM (SELECT a AS me, b AS other FROM u WHERE a <> b UNION ALL SELECT b, a FROM u WHERE a <> b) WHERE me IN (SELECT id FROM sel) GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY me ORDER BY n DESC, other) AS k FROM e
), c AS (SELECT r.me, array_to_string(list(s.fqn ORDER BY r.n DESC, r.other), ' ') AS connected FROM r JOIN sym s ON s.id = r.other WHERE r.k <= 10 GROUP BY 1)
SELECT sel.id, coalesce(dg.d, 0) AS degree, c.connected FROM sel LEFT JOIN dg ON dg.m = sel.id LEFT JOIN c ON c.me = sel.id""",
    "g28_symbol_search": _W + f"""
, d AS (SELECT id, count(*) AS degree FROM (SELECT source_symbol_id AS id FROM res WHERE edge_type IN {_USE} UNION ALL SELECT target_symbol_id FROM res WHERE edge_type IN {_USE}) GROUP BY 1)
SELECT s.id, s.fqn, s.kind, coalesce(d.degree, 0) AS degree, s.importance FROM sym s LEFT JOIN d ON d.id = s.id
WHERE (contains(lower(name), 'index') OR contains(lower(fqn), 'index') OR contains(lower(coalesce(docstring, '')), 'index')) AND kind IN ('function','method')
  AND NOT is_entry_point AND coalesce(d.degree, 0) BETWEEN 1 AND 40""",
    "g31_outline": _W + "SELECT id, name, kind, line_start, line_end, visibility FROM sym WHERE file_path = 'pending-index-difisu/src/core/tracing.py'",
    "g15_hotspots": _W + """
, d AS (SELECT id, count(*) AS degree FROM (SELECT source_symbol_id AS id FROM res UNION ALL SELECT target_symbol_id FROM res) GROUP BY 1)
SELECT s.id, s.fqn, s.importance, d.degree FROM sym s JOIN d ON d.id = s.id WHERE NOT s.is_test ORDER BY s.importance DESC, d.degree DESC, s.fqn LIMIT 25""",
    "g19_isolated": _W + "SELECT id, fqn FROM sym WHERE id NOT IN (SELECT source_symbol_id FROM res UNION SELECT target_symbol_id FROM res)",
    "g20_packages": _W + r"SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS package, count(DISTINCT file_path) AS files, count(*) AS symbols, count(*) FILTER (WHERE is_test) AS tests FROM sym GROUP BY 1",
    "g33_implementations": _W + """
, sub AS (SELECT DISTINCT target_symbol_id AS base, source_symbol_id AS s FROM res WHERE edge_type IN ('IMPLEMENTS','INHERITS')
), clo AS (SELECT base AS root, s FROM sub UNION SELECT c.root, b.s FROM clo c JOIN sub b ON b.base = c.s)
SELECT c.root AS interface_id, c.s AS type_id, EXISTS (SELECT 1 FROM sub x WHERE x.base = c.root AND x.s = c.s) AS direct
FROM clo c JOIN sym i ON i.id = c.root AND i.kind = 'interface' JOIN sym t ON t.id = c.s AND t.kind IN ('class','interface','enum','type_alias') WHERE c.root <> c.s""",
    "j6_enclosing_chunk": _W + """
SELECT edge_id, chunk_id FROM (
  SELECT e.id AS edge_id, k.id AS chunk_id, row_number() OVER (PARTITION BY e.id ORDER BY k.line_end - k.line_start, k.id) AS rn
  FROM res e JOIN sym s ON s.id = e.source_symbol_id JOIN chk k ON k.file_path = s.file_path AND e.source_range[1] BETWEEN k.line_start AND k.line_end WHERE e.edge_type = 'CALLS'
) WHERE rn = 1""",
    "a13_neighbours_top": _W + """
SELECT symbol_id, neighbour, n FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY n DESC, neighbour) AS rn FROM (
  SELECT source_symbol_id AS symbol_id, target_symbol_id AS neighbour, count(*) AS n FROM res GROUP BY 1, 2)) WHERE rn <= 10""",
    "s33_trust_labels": _W + """
SELECT edge_type, CASE WHEN NOT resolved THEN 'UNRESOLVED' WHEN resolution_tier IN ('exact','conventional','import') THEN 'EXTRACTED'
  WHEN resolution_tier IN ('fallback','ambiguous') THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS label, count(*) AS n FROM edg GROUP BY ALL""",
}
