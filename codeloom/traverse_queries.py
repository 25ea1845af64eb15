"""Queries over traversals, with SQL where SQL can state them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import traverse as T
from codeloom.views import SQL_VIEWS, Corpus

_W = "WITH RECURSIVE " + SQL_VIEWS
#: The symbol, and the file, that the questions are about: parameters of the tools.
ROOT_NAME = "record_span"
_ROOT = f"(SELECT min(id) AS id FROM sym WHERE name = '{ROOT_NAME}')"
_ROOT_FILE = f"(SELECT file_path FROM sym WHERE id = (SELECT min(id) FROM sym WHERE name = '{ROOT_NAME}'))"


def _root(c: Corpus) -> DataFrame:
    return c.symbols_with("name").where(F.col("name") == ROOT_NAME).agg(F.min("id").alias("node"))


def _root_file(c: Corpus) -> DataFrame:
    return c.symbols_with("name", "file_path").where(F.col("name") == ROOT_NAME).agg(F.min_by("file_path", "id").alias("node"))


def _types(c: Corpus) -> DataFrame:
    return c.symbols_with("kind").where(F.col("kind").isin(*G.TYPE_KINDS)).select(F.col("id").alias("root"))


def _path(c: Corpus) -> DataFrame:
    """From the root's most distant direct caller's file to the root: two ids that the tables give."""
    ends = c.resolved_edges.where("edge_type = 'CALLS'").agg(F.max("source_symbol_id").alias("s")).first()
    root = _root(c).first()["node"]
    if ends["s"] is None or root is None:
        return T.shortest_path(c.symbols_with("parent_symbol_id"), c.resolved_edges, 0, 0)
    return T.shortest_path(c.symbols_with("parent_symbol_id"), c.resolved_edges, int(ends["s"]), int(root), undirected=True)


def _distance(c: Corpus) -> DataFrame:
    return _path(c).agg(F.count("*").alias("hops"))


def _impact(c: Corpus, **more) -> DataFrame:
    changed = _root_file(c).withColumnRenamed("node", "file_path")
    return T.impact(c.symbols_with("file_path", "kind", "is_test"), c.resolved_edges, changed, **more)


def _changes(c: Corpus) -> DataFrame:
    """Tests that a change reaches: what detect_changes answers for scope ``tests``."""
    return _impact(c).where("is_test").select("id", "distance")


def _explain(c: Corpus) -> DataFrame:
    root = _root(c).first()["node"]
    return T.explain(c.symbols_with("parent_symbol_id"), c.edges, int(root) if root is not None else -1)


def _ego(c: Corpus) -> DataFrame:
    root = _root(c).first()["node"]
    return T.ego_graph(c.symbols_with("parent_symbol_id"), c.edges, int(root) if root is not None else -1)


def _parents(c: Corpus) -> DataFrame:
    return T.impact_parents(c.symbols, c.resolved_edges, _impact(c))


def _calls(c: Corpus) -> DataFrame:
    return c.resolved_edges.where(F.col("edge_type").isin("CALLS", "INHERITS")).select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b"))


def _community_sql(rounds: int) -> str:
    sql = _W + """
, b AS MATERIALIZED (SELECT source_symbol_id AS a, target_symbol_id AS b FROM res WHERE edge_type IN ('CALLS','INHERITS') AND source_symbol_id <> target_symbol_id
  UNION SELECT target_symbol_id, source_symbol_id FROM res WHERE edge_type IN ('CALLS','INHERITS') AND source_symbol_id <> target_symbol_id
), l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS label FROM b)"""
    for k in range(rounds):
        sql += f"""
, l{k + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT a AS node, label, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS rn FROM (
  SELECT b.a, l.label, count(*) AS n FROM b JOIN l{k} l ON l.node = b.b GROUP BY 1, 2)) WHERE rn = 1)"""
    return sql + f"\nSELECT node, label AS community FROM l{rounds}"


def _query(run):
    return lambda spark, sf_dir: run(Corpus(spark, sf_dir))


QUERIES = {
    "g1_callers": _query(lambda c: T.callers(c.edges, _root(c)).withColumnRenamed("node", "id")),
    "g2_callees": _query(lambda c: T.callees(c.edges, _root(c))),
    "g5_subtypes": _query(lambda c: T.subtypes(c.symbols_with("fqn"), c.edges, _types(c))),
    "g6_ancestors": _query(lambda c: T.ancestors(c.symbols_with("kind"), c.edges, _types(c))),
    "g7_bases": _query(lambda c: c.edges.where("edge_type in ('INHERITS', 'IMPLEMENTS')").select("source_symbol_id", "edge_type", F.coalesce(F.col("target_symbol_id").cast("string"), "target_raw").alias("base"))),
    "g8_importers": _query(lambda c: T.importers(c.modules, _root_file(c)).select(F.col("node").alias("path"), "depth")),
    "g8_imports": _query(lambda c: T.imports(c.modules, _root_file(c)).select(F.col("node").alias("path"), "depth")),
    "g9_shortest_path": _query(_path),
    "g9_distance": _query(_distance),
    "g10_neighbourhood": _query(lambda c: T.neighbourhood(c.symbols_with("kind"), c.edges, _root(c))),
    "g12_explain": _query(_explain),
    "g12_ego_graph": _query(_ego),
    "g10_bounded": _query(lambda c: T.neighbourhood(c.symbols_with("kind"), c.edges, _root(c), fan_out=5, most=200)),
    "g13_parents": _query(_parents),
    "g13_impact": _query(_impact),
    "g13_impact_closure": _query(lambda c: _impact(c, fixpoint=True)),
    "g14_changed_tests": _query(_changes),
    "g16_communities": _query(lambda c: T.communities(_calls(c))),
    "g17_import_components": _query(lambda c: T.strong_components(c.modules.where("resolved").select(F.col("source_path").alias("a"), F.col("target_path").alias("b")))),
    "g18_import_cycles": _query(lambda c: T.module_cycles(c.modules)),
    "s17_module_edges": _query(lambda c: c.modules),
}

_MODULES = """
, mods AS (
  SELECT a.file_path AS source_path, b.file_path AS target_path, CASE WHEN b.file_path IS NULL THEN coalesce(e.target_raw, '') END AS target_raw,
    bool_or(e.resolved AND b.file_path IS NOT NULL) AS resolved
  FROM edg e JOIN sym a ON a.id = e.source_symbol_id LEFT JOIN sym b ON b.id = e.target_symbol_id WHERE e.edge_type = 'IMPORTS' GROUP BY ALL
)"""
_IMPACT = f"""
, seed AS (SELECT id FROM sym WHERE file_path = {_ROOT_FILE}
), up AS (SELECT DISTINCT target_symbol_id AS a, source_symbol_id AS b FROM res WHERE edge_type IN ('CALLS','INHERITS')
), fan AS (SELECT target_symbol_id AS t, count(*) AS n FROM res WHERE edge_type IN ('CALLS','INHERITS') GROUP BY 1
)"""
_RISK = """
SELECT s.id, d.distance, CASE WHEN s.is_test THEN 'low' WHEN s.kind IN ('class','interface','enum','type_alias') OR coalesce(f.n, 0) >= 5 THEN 'high'
  WHEN coalesce(f.n, 0) >= 1 THEN 'medium' ELSE 'low' END AS risk, s.is_test
FROM d JOIN sym s ON s.id = d.node LEFT JOIN fan f ON f.t = s.id"""
_BOUNDED = """
, w(node, depth) AS (SELECT id, 0 FROM seed UNION SELECT up.b, w.depth + 1 FROM w JOIN up ON up.a = w.node WHERE w.depth < 3
), d AS (SELECT node, min(depth) AS distance FROM w GROUP BY 1)"""

ORACLES = {
    "g1_callers": _W + f"""
, c AS (SELECT DISTINCT target_symbol_id AS a, source_symbol_id AS b FROM edg WHERE edge_type = 'CALLS' AND target_symbol_id IS NOT NULL
), w(node, depth) AS (SELECT b, 1 FROM c WHERE a = {_ROOT} UNION SELECT c.b, w.depth + 1 FROM w JOIN c ON c.a = w.node WHERE w.depth < 5)
SELECT node AS id, min(depth) AS depth FROM w GROUP BY 1""",
    "g2_callees": _W + f"""
, c AS (SELECT DISTINCT 's:' || source_symbol_id AS a, CASE WHEN resolved AND target_symbol_id IS NOT NULL THEN 's:' || target_symbol_id ELSE 'u:' || coalesce(target_raw, '') END AS b FROM edg WHERE edge_type = 'CALLS'
), w(node, depth) AS (SELECT b, 1 FROM c WHERE a = 's:' || {_ROOT} UNION SELECT c.b, w.depth + 1 FROM w JOIN c ON c.a = w.node WHERE w.depth < 5)
SELECT node AS callee, min(depth) AS depth FROM w GROUP BY 1""",
    "g6_ancestors": _W + """
, c AS (SELECT DISTINCT source_symbol_id AS a, target_symbol_id AS b FROM edg WHERE edge_type = 'INHERITS' AND target_symbol_id IS NOT NULL
), w(root, node, depth) AS (SELECT s.id, c.b, 1 FROM sym s JOIN c ON c.a = s.id WHERE s.kind IN ('class','interface','enum','type_alias')
  UNION SELECT w.root, c.b, w.depth + 1 FROM w JOIN c ON c.a = w.node WHERE w.depth < 5)
SELECT root, node AS id, min(depth) AS depth FROM w JOIN sym k ON k.id = w.node AND k.kind = 'class' WHERE root <> node GROUP BY 1, 2""",
    "g7_bases": _W + "SELECT source_symbol_id, edge_type, coalesce(CAST(target_symbol_id AS VARCHAR), target_raw) AS base FROM edg WHERE edge_type IN ('INHERITS','IMPLEMENTS')",
    "g8_importers": _W + _MODULES + f"""
, w(node, depth) AS (SELECT source_path, 1 FROM mods WHERE target_path = {_ROOT_FILE} UNION SELECT m.source_path, w.depth + 1 FROM w JOIN mods m ON m.target_path = w.node WHERE w.depth < 5)
SELECT node AS path, min(depth) AS depth FROM w GROUP BY 1""",
    "g8_imports": _W + _MODULES + f"""
, w(node, depth) AS (SELECT target_path, 1 FROM mods WHERE source_path = {_ROOT_FILE} AND resolved AND target_path IS NOT NULL
  UNION SELECT m.target_path, w.depth + 1 FROM w JOIN mods m ON m.source_path = w.node AND m.resolved AND m.target_path IS NOT NULL WHERE w.depth < 5)
SELECT node AS path, min(depth) AS depth FROM w GROUP BY 1""",
    "g9_distance": _W + f"""
, l AS (SELECT source_symbol_id AS a, target_symbol_id AS b FROM res WHERE edge_type IN ('CALLS','INHERITS') UNION SELECT target_symbol_id, source_symbol_id FROM res WHERE edge_type IN ('CALLS','INHERITS')
  UNION SELECT p.id, s.id FROM sym s JOIN sym p ON p.id = s.parent_symbol_id UNION SELECT s.id, p.id FROM sym s JOIN sym p ON p.id = s.parent_symbol_id
), w(node, depth) AS (SELECT max(source_symbol_id), 0 FROM res WHERE edge_type = 'CALLS' UNION SELECT l.b, w.depth + 1 FROM w JOIN l ON l.a = w.node WHERE w.depth < 6)
SELECT coalesce(min(depth), 0) AS hops FROM w WHERE node = {_ROOT}""",
    "g10_neighbourhood": _W + f"""
, l AS (SELECT source_symbol_id AS a, target_symbol_id AS b FROM res WHERE edge_type IN ('CALLS','INHERITS') UNION SELECT target_symbol_id, source_symbol_id FROM res WHERE edge_type IN ('CALLS','INHERITS')
), w(node, depth) AS (SELECT id, 0 FROM {_ROOT} UNION SELECT l.b, w.depth + 1 FROM w JOIN l ON l.a = w.node WHERE w.depth < 2
), x AS (SELECT source_symbol_id AS s, count(*) AS n FROM edg WHERE NOT resolved AND edge_type IN ('CALLS','INHERITS') GROUP BY 1)
SELECT s.id, min(w.depth) AS distance, coalesce(any_value(x.n), 0) AS external FROM w JOIN sym s ON s.id = w.node LEFT JOIN x ON x.s = s.id GROUP BY s.id""",
    "g12_explain": _W + f"""
SELECT DISTINCT 'incoming' AS section, source_symbol_id AS other_id, edge_type AS relation FROM res WHERE edge_type IN ('CALLS','INHERITS') AND target_symbol_id = {_ROOT}
UNION SELECT 'outgoing', target_symbol_id, edge_type FROM res WHERE edge_type IN ('CALLS','INHERITS') AND source_symbol_id = {_ROOT}
UNION SELECT 'members', id, 'CONTAINS' FROM sym WHERE parent_symbol_id = {_ROOT}
UNION SELECT 'container', parent_symbol_id, 'CONTAINS' FROM sym WHERE id = {_ROOT} AND parent_symbol_id IS NOT NULL""",
    "g12_ego_graph": _W + f"""
, l AS (SELECT target_symbol_id AS a, 'incoming' AS section, source_symbol_id AS b, edge_type AS relation FROM res WHERE edge_type IN ('CALLS','INHERITS') AND source_symbol_id <> target_symbol_id
  UNION SELECT source_symbol_id, 'outgoing', target_symbol_id, edge_type FROM res WHERE edge_type IN ('CALLS','INHERITS') AND source_symbol_id <> target_symbol_id
  UNION SELECT parent_symbol_id, 'members', id, 'CONTAINS' FROM sym WHERE parent_symbol_id <> id UNION SELECT id, 'container', parent_symbol_id, 'CONTAINS' FROM sym WHERE parent_symbol_id <> id
), n AS (SELECT {_ROOT} AS node, 0 AS depth UNION SELECT b, 1 FROM l WHERE a = {_ROOT} AND b <> {_ROOT})
SELECT n.depth + 1 AS level, n.node AS node_id, l.section, l.b AS other_id, l.relation FROM n JOIN l ON l.a = n.node""",
    "g10_bounded": _W + f"""
, l0 AS (SELECT source_symbol_id AS a, target_symbol_id AS b FROM res WHERE edge_type IN ('CALLS','INHERITS') UNION SELECT target_symbol_id, source_symbol_id FROM res WHERE edge_type IN ('CALLS','INHERITS')
), l AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS k FROM l0) WHERE k <= 5
), w(node, depth) AS (SELECT id, 0 FROM {_ROOT} UNION SELECT l.b, w.depth + 1 FROM w JOIN l ON l.a = w.node WHERE w.depth < 2
), x AS (SELECT source_symbol_id AS s, count(*) AS n FROM edg WHERE NOT resolved AND edge_type IN ('CALLS','INHERITS') GROUP BY 1)
SELECT s.id, min(w.depth) AS distance, coalesce(any_value(x.n), 0) AS external FROM w JOIN sym s ON s.id = w.node LEFT JOIN x ON x.s = s.id GROUP BY s.id ORDER BY distance, s.id LIMIT 200""",
    "g13_parents": _W + _IMPACT + _BOUNDED + """
, r AS (SELECT s.id, d.distance FROM d JOIN sym s ON s.id = d.node)
SELECT r.id, min(p.id) AS parent_id FROM r JOIN up ON up.b = r.id JOIN r p ON p.id = up.a AND p.distance = r.distance - 1 WHERE r.distance > 0 GROUP BY r.id""",
    "g13_impact": _W + _IMPACT + _BOUNDED + _RISK,
    # the closure: no shortest distance in these graphs is longer than the bound, which only ends the walk
    "g13_impact_closure": _W + _IMPACT + """
, w(node, depth) AS (SELECT id, 0 FROM seed UNION SELECT up.b, w.depth + 1 FROM w JOIN up ON up.a = w.node WHERE w.depth < 40
), d AS (SELECT node, min(depth) AS distance FROM w GROUP BY 1)""" + _RISK,
    "g5_subtypes": _W + """
, dn AS (SELECT DISTINCT e.target_symbol_id AS a, e.source_symbol_id AS b, s.fqn FROM edg e JOIN sym s ON s.id = e.source_symbol_id WHERE e.edge_type IN ('INHERITS','IMPLEMENTS') AND e.target_symbol_id IS NOT NULL
), w(root, node, depth, lead) AS (
  SELECT s.id, dn.b, 1, dn.fqn FROM sym s JOIN dn ON dn.a = s.id WHERE s.kind IN ('class','interface','enum','type_alias')
  UNION SELECT w.root, dn.b, w.depth + 1, w.lead || '>' || dn.fqn FROM w JOIN dn ON dn.a = w.node WHERE w.depth < 5
), m AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2)
SELECT w.root, w.node AS id, m.depth, min(w.lead) AS path FROM w JOIN m ON m.root = w.root AND m.node = w.node AND m.depth = w.depth GROUP BY 1, 2, 3""",
    "g18_import_cycles": _W + _MODULES + """
, l AS MATERIALIZED (SELECT DISTINCT source_path AS a, target_path AS b FROM mods WHERE resolved AND target_path IS NOT NULL
), w(f, last, p) AS (SELECT a, b, [a, b] FROM l WHERE a < b UNION ALL SELECT w.f, l.b, list_append(w.p, l.b) FROM w JOIN l ON l.a = w.last WHERE l.b > w.f AND NOT list_contains(w.p, l.b))
SELECT array_to_string(p, ' > ') AS members, CAST(len(p) AS INTEGER) AS length FROM w WHERE EXISTS (SELECT 1 FROM l WHERE l.a = w.last AND l.b = w.f)
UNION ALL SELECT a, 1 FROM l WHERE a = b""",
    "g14_changed_tests": _W + _IMPACT + _BOUNDED + " SELECT s.id, d.distance FROM d JOIN sym s ON s.id = d.node WHERE s.is_test",
    "g16_communities": _community_sql(10),
    "s17_module_edges": _W + _MODULES + " SELECT source_path, target_path, target_raw, resolved FROM mods",
    "g17_import_components": _W + _MODULES + """
, l AS MATERIALIZED (SELECT DISTINCT source_path AS a, target_path AS b FROM mods WHERE resolved
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1""",
}
