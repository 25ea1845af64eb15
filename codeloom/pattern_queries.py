"""Pattern queries over the code graph, each with the SQL that it means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.pattern.builder import build
from codeloom.plans.pattern.graph_views import NODE_PROPERTIES, PatternGraph
from codeloom.views import SQL_VIEWS, Corpus

_W = "WITH RECURSIVE " + SQL_VIEWS

TEXTS = {
    "c1_match_where": "MATCH (f:Function) WHERE f.name STARTS WITH 'r' AND f.name =~ '.*[aeiou]d.*' AND NOT f.line_start > 40 RETURN f.id AS id, f.name AS name",
    "c2_labels_properties": "MATCH (n:Class|Interface {visibility: 'public'}) RETURN id(n) AS id, labels(n) AS label",
    "c3_hop_count": "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN b.id AS id, count(*) AS calls, count(DISTINCT a.file_path) AS files",
    "c3_inbound": "MATCH (b:Method)<-[:CALLS|USAGE]-(a:Method) RETURN a.id AS src, b.id AS tgt",
    "c4_undirected": "MATCH (a:Class)-[:INHERITS]-(b:Class) RETURN a.id AS a, b.id AS b",
    "c6_edge_variable": "MATCH (a:Function)-[r:CALLS {tier: 'exact'}]->(b:Function) RETURN type(r) AS type, r.tier AS tier, r.via AS via, min(r.line) AS line, count(*) AS n",
    "c7_cycle_pattern": "MATCH (a)-[:CALLS]->(b)-[:CALLS]->(a) RETURN a.id AS a, b.id AS b",
    "c8_comma_patterns": "MATCH (a:Class)-[:CONTAINS]->(m:Method), (m)-[:CALLS]->(f:Function) RETURN a.id AS a, m.id AS m, f.id AS f",
    "c10_variable_length": "MATCH (a:Class)-[:INHERITS*1..3]->(b:Class) RETURN a.id AS a, b.id AS b",
    "c11_optional": "MATCH (f:Interface) OPTIONAL MATCH (f)<-[r:IMPLEMENTS]-(c:Class) RETURN f.id AS f, r.id AS r, c.id AS c",
    "c13_exists_anti": "MATCH (f:Function|Method|Constructor) WHERE NOT EXISTS { (f)<-[:CALLS|USAGE|CALL_REFERENCE|REFERENCES|IMPLEMENTS|INHERITS]-(src) WHERE src.is_test = 0 } AND NOT EXISTS { (:Interface)-[:CONTAINS]->(f) } AND f.is_entry_point = 0 AND f.is_test = 0 RETURN f.fqn AS fqn",
    "c13_exists_value": "MATCH (f:Class) RETURN f.id AS id, EXISTS { (f)-[:CONTAINS]->(:Method) } AS has_methods, CASE WHEN EXISTS { (f)-[:INHERITS]->() } OR f.is_test = 1 THEN 'a' ELSE 'b' END AS tag",
    "c14_with_having": "MATCH (a:Method)-[:CALLS]->(b) WITH b, count(*) AS n, max(a.importance) AS top WHERE n >= 3 RETURN b.id AS id, n, top",
    "c16_unwind": "MATCH (f:Enum) WITH collect(f.id) AS ids UNWIND ids AS i RETURN i, i * 2 AS twice, 7 / 2 AS whole",
    "c17_distinct": "MATCH (f:Function)-[:CALLS]->(g:Method) RETURN DISTINCT f.file_path AS a, g.file_path AS b",
    "c18_order_limit": "MATCH (f:Function) RETURN f.id AS id, f.importance AS importance ORDER BY importance DESC, id SKIP 5 LIMIT 20",
    "c20_union": "MATCH (f:Function) WHERE f.is_test = 1 RETURN f.name AS name UNION MATCH (c:Class) RETURN c.name AS name",
    "c20_union_all": "MATCH (f:Enum) RETURN f.visibility AS v UNION ALL MATCH (c:Interface) RETURN c.visibility AS v",
    "c24_whole_node": "MATCH (f:Constructor) RETURN f AS node",
    "c25_file_imports": "MATCH (a:File)-[:IMPORTS]->(b:File) RETURN a.fqn AS a, b.fqn AS b",
    "c25_unresolved": "MATCH (f)-[r:CALLS]->(u:Unresolved) RETURN u.name AS raw, count(*) AS n, min(r.resolved) AS resolved",
    "c25_modules": "MATCH (m:Module) RETURN m.id AS id, m.fqn AS path",
    "e_scalars": "MATCH (f:Field) RETURN f.id AS id, coalesce(f.canonical_fqn, f.fqn) AS c, toLower(f.name) AS lo, toUpper(f.name) AS up, size(f.name) AS n, substring(f.name, 1, 3) AS s, replace(f.name, 'a', 'A') AS r, trim('  x ') AS t, toString(f.line_start) AS l, basename(f.file_path) AS base, f.line_end - f.line_start AS span, f.line_start % 7 AS m",
    "e_predicates": "MATCH (f:Variable) WHERE f.name CONTAINS 'e' XOR f.is_test = 1 OR f.visibility IN ['private', 'public'] RETURN f.id AS id, f.name ENDS WITH 'r' AS r, f.canonical_fqn IS NULL AS missing, f:Variable AS is_variable",
    "e_aggregates": "MATCH (f:Function) RETURN f.language AS label, count(*) AS n, sum(f.line_start) AS s, avg(f.line_start) AS a, min(f.name) AS lo, max(f.name) AS hi, collect(DISTINCT f.visibility) AS v".replace("f.language", "f.kind"),
}


def pattern_graph(c: Corpus) -> PatternGraph:
    """The graph with the columns that patterns can address; texts are not read."""
    return PatternGraph(c.symbols_with(*[p for p in NODE_PROPERTIES if p not in ("id", "label")], "parent_symbol_id"), c.edges, c.modules, c.hot_targets)


def graph(spark: SparkSession, sf_dir: str) -> PatternGraph:
    c = Corpus(spark, sf_dir)
    return pattern_graph(c)


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(text, graph(spark, sf_dir))

    return run


QUERIES = {name: _query(text) for name, text in TEXTS.items()}

_USE = "('CALLS','USAGE','CALL_REFERENCE','REFERENCES','IMPLEMENTS','INHERITS')"
# every stored edge with a target, whether marked resolved or not, is a step of a fixed pattern
_E = "(SELECT * FROM edg WHERE target_symbol_id IS NOT NULL)"

ORACLES = {
    "c24_whole_node": _W + """SELECT '{"id":' || id || ',"label":"Constructor","name":"' || name || '","kind":"constructor","fqn":"' || fqn || '","file_path":"' || file_path || '"' || coalesce(',"line_start":' || line_start, '') || coalesce(',"line_end":' || line_end, '') || '}' AS node FROM sym WHERE kind = 'constructor'""",
    "c1_match_where": _W + "SELECT id, name FROM sym WHERE kind = 'function' AND starts_with(name, 'r') AND regexp_full_match(name, '.*[aeiou]d.*') AND NOT line_start > 40",
    "c2_labels_properties": _W + "SELECT id, CASE kind WHEN 'class' THEN 'Class' ELSE 'Interface' END AS label FROM sym WHERE kind IN ('class','interface') AND visibility = 'public'",
    "c3_hop_count": _W + f"SELECT b.id, count(*) AS calls, count(DISTINCT a.file_path) AS files FROM {_E} e JOIN sym a ON a.id = e.source_symbol_id JOIN sym b ON b.id = e.target_symbol_id WHERE e.edge_type = 'CALLS' AND a.kind = 'function' AND b.kind = 'function' GROUP BY 1",
    "c3_inbound": _W + f"SELECT a.id AS src, b.id AS tgt FROM {_E} e JOIN sym a ON a.id = e.source_symbol_id JOIN sym b ON b.id = e.target_symbol_id WHERE e.edge_type IN ('CALLS','USAGE') AND a.kind = 'method' AND b.kind = 'method'",
    "c4_undirected": _W + f"""
SELECT a.id AS a, b.id AS b FROM (SELECT source_symbol_id AS s, target_symbol_id AS t FROM {_E} WHERE edge_type = 'INHERITS'
  UNION ALL SELECT target_symbol_id, source_symbol_id FROM {_E} WHERE edge_type = 'INHERITS' AND source_symbol_id <> target_symbol_id) e
JOIN sym a ON a.id = e.s JOIN sym b ON b.id = e.t WHERE a.kind = 'class' AND b.kind = 'class'""",
    "c6_edge_variable": _W + f"SELECT 'CALLS' AS type, 'exact' AS tier, e.properties['via'] AS via, min(e.source_range[1]) AS line, count(*) AS n FROM {_E} e JOIN sym a ON a.id = e.source_symbol_id JOIN sym b ON b.id = e.target_symbol_id WHERE e.edge_type = 'CALLS' AND e.resolution_tier = 'exact' AND a.kind = 'function' AND b.kind = 'function' GROUP BY 3",
    "c7_cycle_pattern": _W + f"SELECT a.source_symbol_id AS a, a.target_symbol_id AS b FROM {_E} a JOIN {_E} b ON b.source_symbol_id = a.target_symbol_id AND b.target_symbol_id = a.source_symbol_id JOIN sym s ON s.id = a.source_symbol_id JOIN sym t ON t.id = a.target_symbol_id WHERE a.edge_type = 'CALLS' AND b.edge_type = 'CALLS'",
    "c8_comma_patterns": _W + f"SELECT p.id AS a, m.id AS m, f.id AS f FROM sym m JOIN sym p ON p.id = m.parent_symbol_id AND p.kind = 'class' JOIN {_E} e ON e.source_symbol_id = m.id AND e.edge_type = 'CALLS' JOIN sym f ON f.id = e.target_symbol_id AND f.kind = 'function' WHERE m.kind = 'method'",
    "c10_variable_length": _W + """
, i AS (SELECT DISTINCT source_symbol_id AS s, target_symbol_id AS t FROM res WHERE edge_type = 'INHERITS'
), w(s, t, n) AS (SELECT i.s, i.t, 1 FROM i JOIN sym a ON a.id = i.s AND a.kind = 'class' UNION SELECT w.s, i.t, w.n + 1 FROM w JOIN i ON i.s = w.t WHERE w.n < 3)
SELECT w.s AS a, w.t AS b FROM w JOIN sym b ON b.id = w.t AND b.kind = 'class'""",
    "c11_optional": _W + f"SELECT f.id AS f, e.id AS r, c.id AS c FROM sym f LEFT JOIN {_E} e ON e.target_symbol_id = f.id AND e.edge_type = 'IMPLEMENTS' LEFT JOIN sym c ON c.id = e.source_symbol_id AND c.kind = 'class' WHERE f.kind = 'interface'",
    "c13_exists_anti": _W + f"""
SELECT fqn FROM sym f WHERE kind IN ('function','method','constructor') AND NOT is_entry_point AND NOT is_test
  AND NOT EXISTS (SELECT 1 FROM {_E} e JOIN sym s ON s.id = e.source_symbol_id WHERE e.target_symbol_id = f.id AND e.edge_type IN {_USE} AND NOT s.is_test)
  AND NOT EXISTS (SELECT 1 FROM sym p WHERE p.id = f.parent_symbol_id AND p.kind = 'interface')""",
    "c13_exists_value": _W + f"""
SELECT f.id, CAST(EXISTS (SELECT 1 FROM sym m WHERE m.parent_symbol_id = f.id AND m.kind = 'method') AS INTEGER) AS has_methods,
  CASE WHEN EXISTS (SELECT 1 FROM {_E} e JOIN sym t ON t.id = e.target_symbol_id WHERE e.source_symbol_id = f.id AND e.edge_type = 'INHERITS') OR is_test THEN 'a' ELSE 'b' END AS tag
FROM sym f WHERE kind = 'class'""",
    "c14_with_having": _W + f"SELECT b.id, count(*) AS n, max(a.importance) AS top FROM {_E} e JOIN sym a ON a.id = e.source_symbol_id AND a.kind = 'method' JOIN sym b ON b.id = e.target_symbol_id WHERE e.edge_type = 'CALLS' GROUP BY 1 HAVING count(*) >= 3",
    "c16_unwind": _W + "SELECT id AS i, id * 2 AS twice, CAST(3 AS BIGINT) AS whole FROM sym WHERE kind = 'enum'",
    "c17_distinct": _W + f"SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM {_E} e JOIN sym a ON a.id = e.source_symbol_id AND a.kind = 'function' JOIN sym b ON b.id = e.target_symbol_id AND b.kind = 'method' WHERE e.edge_type = 'CALLS'",
    "c18_order_limit": _W + "SELECT id, importance FROM sym WHERE kind = 'function' ORDER BY importance DESC NULLS LAST, id LIMIT 20 OFFSET 5",
    "c20_union": _W + "SELECT name FROM sym WHERE kind = 'function' AND is_test UNION SELECT name FROM sym WHERE kind = 'class'",
    "c20_union_all": _W + "SELECT visibility AS v FROM sym WHERE kind = 'enum' UNION ALL SELECT visibility FROM sym WHERE kind = 'interface'",
    "c25_file_imports": _W + "SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM edg e JOIN sym a ON a.id = e.source_symbol_id JOIN sym b ON b.id = e.target_symbol_id WHERE e.edge_type = 'IMPORTS'",
    "c25_unresolved": _W + "SELECT target_raw AS raw, count(*) AS n, 0 AS resolved FROM edg e JOIN sym s ON s.id = e.source_symbol_id WHERE e.edge_type = 'CALLS' AND target_symbol_id IS NULL AND NOT resolved AND target_raw IS NOT NULL AND target_raw <> '' GROUP BY 1",
    "c25_modules": _W + r"SELECT -(1000000000 + row_number() OVER (ORDER BY path)) AS id, path FROM (SELECT DISTINCT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS path FROM sym WHERE file_path IS NOT NULL)",
    "e_scalars": _W + r"SELECT id, coalesce(canonical_fqn, fqn) AS c, lower(name) AS lo, upper(name) AS up, CAST(length(name) AS INTEGER) AS n, substring(name, 2, 3) AS s, replace(name, 'a', 'A') AS r, 'x' AS t, CAST(line_start AS VARCHAR) AS l, regexp_extract(file_path, '([^/]*)$', 1) AS base, line_end - line_start AS span, line_start % 7 AS m FROM sym WHERE kind = 'field'",
    "e_predicates": _W + "SELECT id, CAST(ends_with(name, 'r') AS INTEGER) AS r, CAST(canonical_fqn IS NULL AS INTEGER) AS missing, 1 AS is_variable FROM sym WHERE kind = 'variable' AND (contains(name, 'e') <> is_test OR visibility IN ('private','public'))",
    "e_aggregates": _W + "SELECT kind AS label, count(*) AS n, CAST(sum(line_start) AS BIGINT) AS s, avg(line_start) AS a, min(name) AS lo, max(name) AS hi, list_sort(list(DISTINCT visibility), 'ASC', 'NULLS FIRST') AS v FROM sym WHERE kind = 'function' GROUP BY 1",
}
