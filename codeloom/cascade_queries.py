"""Queries of the resolution cascades, with the whole cascades as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import cascade as R
from codeloom.operators import chunking as C
from codeloom.operators.common import keep_latest
from codeloom.operators.graph import arity
from codeloom.ops_queries import ORACLES as _OPS_SQL
from codeloom.ops_queries import _lines
from codeloom.views import SQL_VIEWS, Corpus

_W = "WITH RECURSIVE " + SQL_VIEWS
ALIASES = (("@app/*", "src/*"),)


def _references(c: Corpus) -> DataFrame:
    """What edges write where they write it, and every resolved call again as a member expression, with
    the arity of its target."""
    s = c.symbols_with("fqn", "name", "file_path", "parent_symbol_id")
    line = F.get("source_range", F.lit(0)).alias("line")
    src = s.select(F.col("id").alias("source_symbol_id"), "file_path")
    plain = c.edges.where("target_raw is not null and target_raw <> ''").select("id", F.col("target_raw").alias("raw"), "source_symbol_id", line, F.lit(None).cast("int").alias("args"), F.lit(False).alias("receiver"), F.col("edge_type").isin("INHERITS", "IMPLEMENTS").alias("type_only"))
    # types with one of their subtypes, which may not declare the member itself, and the members of both
    bases = c.resolved_edges.where("edge_type = 'INHERITS'").groupBy(F.col("target_symbol_id").alias("base")).agg(F.min("source_symbol_id").alias("sub"))
    below = bases.join(s.select(F.col("id").alias("sub"), F.struct(F.col("name").alias("name")).alias("sub_type")), "sub").select("base", "sub_type")
    owner = s.where("name is not null").select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("pname")).join(below, F.col("parent_symbol_id") == F.col("base"), "left").drop("base")
    members = s.where("parent_symbol_id is not null").select(F.col("id").alias("target_symbol_id"), F.col("name").alias("tname"), "parent_symbol_id", arity(F.col("fqn")).alias("args")).join(owner, "parent_symbol_id").drop("parent_symbol_id")
    calls = c.resolved_edges.where("edge_type = 'CALLS'").select("id", "source_symbol_id", "target_symbol_id", line).join(members, "target_symbol_id")
    again = F.struct((-F.col("id")).alias("id"), F.concat("pname", F.lit("."), "tname").alias("raw"))
    inherited = F.struct((-F.col("id") - 10_000_000_000).alias("id"), F.concat("sub_type.name", F.lit("."), "tname").alias("raw"))
    each = calls.select(F.explode(F.when(F.col("sub_type").isNull(), F.array(again)).otherwise(F.array(again, inherited))).alias("ref"), "source_symbol_id", "line", "args")
    both = plain.unionByName(each.select("ref.id", "ref.raw", "source_symbol_id", "line", "args", F.lit(True).alias("receiver"), F.lit(False).alias("type_only")))
    return both.join(src, "source_symbol_id").drop("source_symbol_id")


def _cascade(c: Corpus) -> DataFrame:
    symbols = c.symbols_with("fqn", "name", "kind", "conventional_fqn", "file_path", "parent_symbol_id", "line_start", "line_end")
    return R.resolve_cascade(symbols, _references(c), c.resolved_edges)


def _imports(c: Corpus) -> DataFrame:
    found = keep_latest(C.import_lines(_lines(c), "id", "updated_at"), c.versions, "id")
    each = found.groupBy("file_path", "module").agg(F.min("line_no").alias("line_no"))
    rows = each.select(F.concat_ws("\t", "file_path", "module").alias("id"), F.col("file_path").alias("source_path"), F.col("module").alias("raw"))
    return R.resolve_imports(rows, c.symbols_with("name", "kind", "file_path", "conventional_fqn"), c.table("code_chunks").select("file_path").distinct(), ALIASES).drop("id")


def _members(c: Corpus) -> DataFrame:
    s = c.symbols_with("fqn", "name", "kind", "parent_symbol_id")
    kinds = s.where("kind in ('interface', 'class')").select(F.col("id").alias("p"))
    members = s.where("kind = 'method'").join(kinds, F.col("parent_symbol_id") == F.col("p"), "left_semi")
    return R.member_implementations(s, c.resolved_edges, members.select("id"))


def _query(run):
    return lambda spark, sf_dir: run(Corpus(spark, sf_dir))


QUERIES = {
    "s18_cascade": _query(_cascade),
    "s17_import_cascade": _query(_imports),
    "s33_refined_edges": _query(lambda c: R.refined_edges(c.edges, c.symbols_with("kind", "line_start", "line_end"))),
    "g33_member_implementations": _query(_members),
    "g34_adjacency": _query(lambda c: c.adjacency.groupBy("a").agg(F.count("*").alias("degree"), F.min("b").alias("least"), F.max("b").alias("greatest"))),
}

_ARITY = r"CAST(CASE WHEN regexp_matches(fqn, '\([^()]*\)$') THEN CASE WHEN trim(regexp_extract(fqn, '\(([^()]*)\)$', 1)) = '' THEN 0 ELSE len(string_split(regexp_replace(regexp_replace(regexp_extract(fqn, '\(([^()]*)\)$', 1), '[<\[][^<>\[\]]*[>\]]', '', 'g'), '[<\[][^<>\[\]]*[>\]]', '', 'g'), ',')) END END AS INTEGER)"
_TYPES = r"array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(coalesce(fqn, ''), '\(([^()]*)\)$', 1), '[<\[][^<>\[\]]*[>\]]', '', 'g'), '[<\[][^<>\[\]]*[>\]]', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> ''), ',')"
_KINDS = "('class', 'interface', 'enum', 'type_alias')"

ORACLES = {
    "s18_cascade": _W + rf"""
, sy AS (SELECT s.id, s.fqn, s.name, s.kind, s.file_path, s.line_start, s.line_end, regexp_replace(s.conventional_fqn, '\(.*$', '') AS conv, p.name AS parent, s.ar FROM (SELECT *, {_ARITY} AS ar FROM sym) s LEFT JOIN sym p ON p.id = s.parent_symbol_id
), bs AS (SELECT target_symbol_id AS base, min(source_symbol_id) AS sub FROM res WHERE edge_type = 'INHERITS' GROUP BY 1
), cl AS (SELECT e.id, a.file_path, e.source_range[1] AS line, t.name, t.parent, (SELECT id FROM sym WHERE sym.id = (SELECT parent_symbol_id FROM sym z WHERE z.id = t.id)) AS pid, t.ar FROM res e JOIN sym a ON a.id = e.source_symbol_id JOIN sy t ON t.id = e.target_symbol_id WHERE e.edge_type = 'CALLS' AND t.parent IS NOT NULL
), rf AS (
  SELECT e.id, e.target_raw AS raw, a.file_path, e.source_range[1] AS line, NULL::INTEGER AS args, false AS rc, e.edge_type IN ('INHERITS', 'IMPLEMENTS') AS ty FROM edg e JOIN sym a ON a.id = e.source_symbol_id WHERE e.target_raw IS NOT NULL AND e.target_raw <> ''
  UNION ALL SELECT -id, parent || '.' || name, file_path, line, ar, true, false FROM cl
  UNION ALL SELECT -cl.id - 10000000000, z.name || '.' || cl.name, cl.file_path, line, ar, true, false FROM cl JOIN bs ON bs.base = cl.pid JOIN sym z ON z.id = bs.sub
), rx AS (SELECT *, regexp_replace(raw, '\(.*$', '') AS stripped, regexp_extract(regexp_replace(regexp_replace(raw, '^.*::', ''), '\(.*$', ''), '([^.]*)$', 1) AS leaf,
    CASE WHEN contains(regexp_replace(regexp_replace(raw, '^.*::', ''), '\(.*$', ''), '.') THEN regexp_extract(regexp_replace(regexp_replace(raw, '^.*::', ''), '\(.*$', ''), '([^.]*)\.[^.]*$', 1) END AS owner FROM rf
), up AS (SELECT DISTINCT x.name AS a, y.name AS b FROM res e JOIN sym x ON x.id = e.source_symbol_id JOIN sym y ON y.id = e.target_symbol_id WHERE e.edge_type IN ('INHERITS', 'IMPLEMENTS') AND x.name <> y.name
), lv(root, node, depth) AS (SELECT DISTINCT owner, b, 1 FROM rx JOIN up ON up.a = rx.owner WHERE rc UNION SELECT lv.root, up.b, lv.depth + 1 FROM lv JOIN up ON up.a = lv.node WHERE lv.depth < 5
), ln AS (SELECT root, node, min(depth) AS depth FROM lv WHERE root <> node GROUP BY 1, 2
), nm AS (SELECT DISTINCT name, ar FROM sy WHERE ar IS NOT NULL
), cd AS (SELECT rx.id AS rid, sy.*, rx.raw, rx.stripped, rx.owner, rx.rc, rx.ty, rx.line, rx.file_path AS rf, rx.args, rx.args IS NOT NULL AND EXISTS (SELECT 1 FROM nm WHERE nm.name = rx.leaf AND nm.ar = rx.args) AS nar FROM rx JOIN sy ON sy.name = rx.leaf
), ca AS (SELECT * FROM cd WHERE NOT nar OR ar IS NULL OR ar = args
), ab AS (SELECT rid, id, depth, min(depth) OVER (PARTITION BY rid) AS least FROM (SELECT cd.rid, cd.id, cd.ar, cd.args, cd.nar, ln.depth FROM cd JOIN ln ON ln.root = cd.owner AND ln.node = cd.parent WHERE cd.rc)
), st AS (
  SELECT rid, 1 AS k, 'exact' AS tier, id FROM cd WHERE fqn = raw UNION ALL SELECT rid, 2, 'conventional', id FROM ca WHERE conv = stripped UNION ALL SELECT rid, 3, 'conventional', id FROM ca WHERE parent = owner
  UNION ALL SELECT ab.rid, 4, 'type_infer', ab.id FROM ab JOIN ca ON ca.rid = ab.rid AND ca.id = ab.id WHERE depth = least
  UNION ALL SELECT rid, 5, 'same_file', id FROM ca WHERE NOT (rc AND owner IS NOT NULL) AND file_path = rf
  UNION ALL SELECT rid, 6, 'range', id FROM ca WHERE NOT (rc AND owner IS NOT NULL) AND line BETWEEN line_start AND line_end
), fs AS (SELECT rid, k, any_value(tier) AS tier, count(*) AS n, min(id) AS id FROM st GROUP BY 1, 2
), ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k) AS rn FROM fs) WHERE rn = 1
), al AS (SELECT rid, count(*) AS n, min(id) AS id, count(*) FILTER (WHERE kind IN {_KINDS}) AS tn, min(id) FILTER (WHERE kind IN {_KINDS}) AS tid FROM ca GROUP BY 1)
SELECT rx.id, CASE WHEN ft.n > 1 THEN 'ambiguous' WHEN ft.n = 1 THEN ft.tier WHEN NOT (rx.rc AND rx.owner IS NOT NULL) AND al.n = 1 THEN 'fallback' WHEN rx.ty AND al.tn = 1 THEN 'fallback' WHEN coalesce(al.n, 0) > 0 THEN 'ambiguous' ELSE 'no_match' END AS tier,
  CASE WHEN ft.n > 1 THEN NULL WHEN ft.n = 1 THEN ft.id WHEN NOT (rx.rc AND rx.owner IS NOT NULL) AND al.n = 1 THEN al.id WHEN rx.ty AND al.tn = 1 THEN al.tid END AS target,
  CAST(CASE WHEN ft.n IS NOT NULL THEN ft.n WHEN NOT (rx.rc AND rx.owner IS NOT NULL) AND al.n = 1 THEN 1 WHEN rx.ty AND al.tn = 1 THEN 1 ELSE coalesce(al.n, 0) END AS BIGINT) AS n
FROM rx LEFT JOIN ft ON ft.rid = rx.id LEFT JOIN al ON al.rid = rx.id""",
    "s17_import_cascade": "WITH im AS (" + _OPS_SQL["s15_imports"] + f"""
), """ + SQL_VIEWS + r"""
, i AS (SELECT DISTINCT file_path AS src, module AS raw, string_split(file_path, '/')[1] AS repo, regexp_matches(file_path, '\.(ts|tsx|js|jsx|mjs)$') AS script FROM im
), fl AS (SELECT DISTINCT file_path AS f, string_split(file_path, '/')[1] AS repo FROM code_chunks WHERE file_path IS NOT NULL
), bs AS (SELECT *, CASE WHEN starts_with(raw, '.') THEN array_to_string(list_append(list_filter(string_split(regexp_replace(src, '/?[^/]*$', ''), '/'), lambda x, k: k <= len(string_split(regexp_replace(src, '/?[^/]*$', ''), '/')) - length(regexp_extract(raw, '^(?:\./)*((?:\.\./)*)', 1)) // 3), regexp_replace(raw, '^(\.\.?/)+', '')), '/')
    WHEN starts_with(raw, '@app/') THEN repo || '/src/' || substring(raw, 6) END AS base FROM i WHERE script
), en(k, e) AS (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.d.ts'), (4, '.js'), (5, '.jsx'), (6, '/index.ts'), (7, '/index.tsx'), (8, '/index.d.ts'), (9, '/index.js'), (10, '/index.jsx')
), sp AS (SELECT src, raw, first(f ORDER BY k) AS t FROM bs, en JOIN fl ON fl.f = bs.base || en.e AND fl.repo = bs.repo WHERE base IS NOT NULL GROUP BY 1, 2
), py AS (SELECT f, repo, string_split(regexp_replace(regexp_replace(f, '\.py$', ''), '/__init__$', ''), '/') AS p FROM fl WHERE ends_with(f, '.py')
), md AS (SELECT repo, array_to_string(p[n:], '.') AS key, min(f) AS t FROM py, unnest(range(1, len(p) + 1)) AS u(n) GROUP BY 1, 2
), cv AS (SELECT string_split(file_path, '/')[1] AS repo, conventional_fqn AS key, min(file_path) AS t FROM sym WHERE conventional_fqn IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2
), tp AS (SELECT string_split(file_path, '/')[1] AS repo, name AS key, min(file_path) AS t FROM sym WHERE kind IN ('class', 'interface', 'enum', 'type_alias') AND file_path IS NOT NULL GROUP BY 1, 2 HAVING min(file_path) = max(file_path))
SELECT i.src AS source_path, i.raw, CASE WHEN i.script THEN sp.t ELSE coalesce(cv.t, m0.t, m1.t, tp.t) END AS target_path,
  CASE WHEN i.script THEN CASE WHEN sp.t IS NOT NULL THEN 'path' ELSE 'external' END WHEN cv.t IS NOT NULL THEN 'conventional' WHEN coalesce(m0.t, m1.t) IS NOT NULL THEN 'module' WHEN tp.t IS NOT NULL THEN 'type' ELSE 'external' END AS how
FROM i LEFT JOIN sp ON sp.src = i.src AND sp.raw = i.raw LEFT JOIN cv ON cv.repo = i.repo AND cv.key = i.raw LEFT JOIN md m0 ON m0.repo = i.repo AND m0.key = i.raw
LEFT JOIN md m1 ON contains(i.raw, '.') AND m1.repo = i.repo AND m1.key = regexp_replace(i.raw, '\.[^.]*$', '') LEFT JOIN tp ON tp.repo = i.repo AND tp.key = regexp_extract(i.raw, '([^.]*)$', 1)""",
    "s33_refined_edges": _W + """
SELECT e.id, CASE WHEN e.edge_type = 'INHERITS' AND s.kind = 'class' AND t.kind = 'interface' THEN 'IMPLEMENTS' WHEN e.edge_type = 'CALL_REFERENCE' AND coalesce(t.kind, '') NOT IN ('function', 'method', 'constructor') THEN 'USAGE' ELSE e.edge_type END AS edge_type,
  CASE WHEN e.resolution_tier = 'exact' AND e.properties['via'] IN ('import', 'type_infer') THEN e.properties['via'] ELSE e.resolution_tier END AS resolution_tier
FROM res e LEFT JOIN sym s ON s.id = e.source_symbol_id LEFT JOIN sym t ON t.id = e.target_symbol_id
WHERE e.source_symbol_id <> e.target_symbol_id OR coalesce(e.source_range[1] BETWEEN s.line_start AND s.line_end, false)""",
    "g33_member_implementations": _W + f"""
, mt AS (SELECT id, name, parent_symbol_id AS owner, {_TYPES} AS ty FROM sym WHERE parent_symbol_id IS NOT NULL AND kind IN ('method', 'function', 'constructor')
), ak AS (SELECT mt.* FROM mt JOIN sym p ON p.id = mt.owner AND p.kind IN ('interface', 'class') JOIN sym m ON m.id = mt.id AND m.kind = 'method'
), bl(root, sub) AS (SELECT DISTINCT owner, e.source_symbol_id FROM ak JOIN res e ON e.target_symbol_id = ak.owner AND e.edge_type IN ('INHERITS', 'IMPLEMENTS') UNION SELECT bl.root, e.source_symbol_id FROM bl JOIN res e ON e.target_symbol_id = bl.sub AND e.edge_type IN ('INHERITS', 'IMPLEMENTS')
), pr AS (SELECT ak.id AS m, ak.name, ak.ty, bl.sub AS t FROM ak JOIN bl ON bl.root = ak.owner AND bl.sub <> bl.root JOIN sym k ON k.id = bl.sub AND k.kind IN {_KINDS}
), dc AS (SELECT pr.m, pr.t, first(o.id ORDER BY o.ty <> pr.ty, o.id) AS o FROM pr JOIN mt o ON o.owner = pr.t AND o.name = pr.name AND o.id <> pr.m GROUP BY 1, 2
), lk AS (SELECT pr.* FROM pr LEFT JOIN dc ON dc.m = pr.m AND dc.t = pr.t WHERE dc.o IS NULL
), av(root, node, depth) AS (SELECT DISTINCT t, e.target_symbol_id, 1 FROM lk JOIN res e ON e.source_symbol_id = lk.t AND e.edge_type IN ('INHERITS', 'IMPLEMENTS') AND e.source_symbol_id <> e.target_symbol_id
  UNION SELECT av.root, e.target_symbol_id, av.depth + 1 FROM av JOIN res e ON e.source_symbol_id = av.node AND e.edge_type IN ('INHERITS', 'IMPLEMENTS') WHERE av.depth < 5
), an AS (SELECT root, node, min(depth) AS depth FROM av WHERE root <> node GROUP BY 1, 2
), ih AS (SELECT lk.m, lk.t, first(o.id ORDER BY an.depth, o.ty <> lk.ty, o.id) AS o FROM lk JOIN an ON an.root = lk.t JOIN mt o ON o.owner = an.node AND o.name = lk.name AND o.id <> lk.m GROUP BY 1, 2)
SELECT pr.m AS member_id, pr.t AS type_id, coalesce(dc.o, ih.o) AS implementation_id, CASE WHEN dc.o IS NOT NULL THEN 'declared' WHEN ih.o IS NOT NULL THEN 'inherited' ELSE 'none' END AS how
FROM pr LEFT JOIN dc ON dc.m = pr.m AND dc.t = pr.t LEFT JOIN ih ON ih.m = pr.m AND ih.t = pr.t""",
    "g34_adjacency": _W + """
, l AS (SELECT DISTINCT source_symbol_id AS a, target_symbol_id AS b, edge_type FROM res WHERE source_symbol_id <> target_symbol_id)
SELECT a, count(*) AS degree, min(b) AS least, max(b) AS greatest FROM l GROUP BY 1""",
}
