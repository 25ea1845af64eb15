"""Queries over pages, mappings, carried state and payloads, with SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import ops as O
from codeloom.ops_queries import _COV, _FRESH, _freshness
from codeloom.sources.sinks import as_json, relative_paths
from codeloom.views import SQL_VIEWS, Corpus

_W = "WITH RECURSIVE " + SQL_VIEWS


def _query(run):
    return lambda spark, sf_dir: run(Corpus(spark, sf_dir))


def _carried(c: Corpus) -> DataFrame:
    """Coverage after a run over the modified files, of which only first lines are kept anew."""
    files, chunks, symbols = c.table("files"), c.chunks_with("file_path", "line_start"), c.symbols_with("file_path")
    changes = _freshness(c)
    modified = files.join(changes.where("status = 'modified'"), "file_path", "left_semi")
    return O.carried_coverage(O.coverage(files, chunks, symbols), O.coverage(modified, chunks.where("line_start = 1"), symbols), changes.where("status = 'deleted'"))


def _page(c: Corpus) -> DataFrame:
    rows = c.symbols_with("fqn", "kind").where("kind = 'class'").select("id", "fqn")
    page, total = G.page_with_total(rows, [F.asc_nulls_last("fqn"), F.asc("id")], 50, 10)
    return page.withColumn("total", F.lit(total).cast("long"))


def _payloads(c: Corpus) -> DataFrame:
    rows = c.symbols_with("fqn", "kind", "file_path").where("fqn is not null and kind is not null and file_path is not null")
    return as_json(relative_paths(rows.select("id", "fqn", "kind", "file_path"), "repo"))


def _distances(c: Corpus) -> DataFrame:
    """Edit distance between the names of a symbol and its parent."""
    rows = c.symbols_with("name", "parent_symbol_id")
    parents = rows.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return rows.join(parents, F.col("parent_symbol_id") == F.col("parent")).select("id", F.levenshtein("name", "parent_name").cast("long").alias("distance"))


QUERIES = {
    "g4_call_pages": _query(lambda c: G.call_pages(c.resolved_edges, 20, 5)),
    "g11_chunk_symbols": _query(lambda c: G.chunk_symbols(c.chunks_with("fqn", "file_path", "line_start"), c.symbols_with("fqn", "name", "file_path", "line_start", "line_end"))),
    "s24_carried_coverage": _query(_carried),
    "a17_symbol_page": _query(_page),
    "s31_payloads": _query(_payloads),
    "e30_name_distance": _query(_distances),
}

ORACLES = {
    "g4_call_pages": _W + """
, p AS (SELECT symbol_id, direction, neighbour, count(*) AS calls FROM (
  SELECT source_symbol_id AS symbol_id, 'callees' AS direction, target_symbol_id AS neighbour FROM res WHERE edge_type = 'CALLS' AND source_symbol_id IS NOT NULL
  UNION ALL SELECT target_symbol_id, 'callers', source_symbol_id FROM res WHERE edge_type = 'CALLS' AND source_symbol_id IS NOT NULL) GROUP BY 1, 2, 3)
SELECT symbol_id, direction, neighbour, calls, total FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol_id, direction ORDER BY calls DESC, neighbour) AS rn, count(*) OVER (PARTITION BY symbol_id, direction) AS total FROM p) WHERE rn BETWEEN 6 AND 25""",
    "g11_chunk_symbols": _W + r"""
, n AS (SELECT file_path AS f, name, min(id) AS s FROM sym WHERE name IS NOT NULL GROUP BY 1, 2
), w AS (
  SELECT k.id, 1 AS way, min(s.id) AS s FROM chk k JOIN sym s ON s.fqn = k.fqn GROUP BY 1
  UNION ALL SELECT id, 2, s FROM (SELECT k.id, s.id AS s, row_number() OVER (PARTITION BY k.id ORDER BY s.line_end - s.line_start, s.id) AS rn FROM chk k JOIN sym s ON s.file_path = k.file_path AND k.line_start BETWEEN s.line_start AND s.line_end) WHERE rn = 1
  UNION ALL SELECT k.id, 3, n.s FROM chk k JOIN n ON n.f = k.file_path AND n.name = regexp_extract(regexp_replace(k.fqn, '\(.*$', ''), '([^.:]*)$', 1)
  UNION ALL SELECT k.id, 4, n.s FROM chk k JOIN n ON n.f = k.file_path AND n.name = regexp_replace(regexp_extract(k.file_path, '[^/]*$'), '^(.+)\.[^.]+$', '\1')
)
SELECT id AS chunk_id, s AS symbol_id, ['fqn', 'span', 'name', 'stem'][way] AS how FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY way, s) AS rn FROM w) WHERE rn = 1""",
    "s24_carried_coverage": _W + _FRESH + _COV + """
, ncov AS (SELECT f.file_path, CASE WHEN f.parse_failed THEN 'parse_failed' WHEN c.n IS NULL AND s.n IS NULL THEN 'missing' ELSE 'ok' END AS status, coalesce(c.n, 0) AS chunks, coalesce(s.n, 0) AS symbols
  FROM files f LEFT JOIN (SELECT file_path, count(*) AS n FROM chk WHERE line_start = 1 GROUP BY 1) c ON c.file_path = f.file_path LEFT JOIN (SELECT file_path, count(*) AS n FROM sym GROUP BY 1) s ON s.file_path = f.file_path
  WHERE f.file_path IN (SELECT file_path FROM fr WHERE status = 'modified'))
SELECT * FROM cov WHERE file_path NOT IN (SELECT file_path FROM fr WHERE status IN ('modified', 'deleted')) UNION ALL SELECT * FROM ncov""",
    "a17_symbol_page": _W + " SELECT id, fqn, count(*) OVER () AS total FROM sym WHERE kind = 'class' ORDER BY fqn NULLS LAST, id LIMIT 50 OFFSET 10",
    "s31_payloads": _W + """
SELECT CAST(to_json({'id': id, 'fqn': fqn, 'kind': kind, 'file_path': regexp_replace(file_path, '^repo/', '')}) AS VARCHAR) AS json FROM sym WHERE fqn IS NOT NULL AND kind IS NOT NULL AND file_path IS NOT NULL""",
    "e30_name_distance": _W + " SELECT a.id, levenshtein(a.name, b.name) AS distance FROM sym a JOIN sym b ON a.parent_symbol_id = b.id",
}
