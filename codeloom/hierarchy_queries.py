"""Queries over the parent-child links of ``symbols`` (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.common import latest_rows
from codeloom.operators.hierarchy import Forest, build_forest
from codeloom.sources.tables import load


def symbol_forest(spark: SparkSession, sf_dir: str, paths: bool = True) -> Forest:
    rows = latest_rows(load(spark, sf_dir, "symbols"), "id", ["parent_symbol_id", "name"] if paths else ["parent_symbol_id"])
    return build_forest(rows, "id", "parent_symbol_id", "name" if paths else "id", paths)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = symbol_forest(spark, sf_dir, paths=False).nodes.where("parent_id is not null")
    return nodes.select(F.col("id").alias("symbol_id"), "root_id", "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = symbol_forest(spark, sf_dir).positions()
    return rows.select(F.col("id").alias("symbol_id"), "root_id", "depth", "path")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_forest(spark, sf_dir).descendants()


def p4_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_forest(spark, sf_dir).circles().select("root_id", F.col("id").alias("symbol_id"))


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p4_circles": p4_circles}

_FOREST = """
WITH RECURSIVE held AS (
  SELECT id, parent_symbol_id AS parent_id, name FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM symbols WHERE id IS NOT NULL
  ) WHERE rn = 1
), tree AS (
  SELECT h.id, h.id AS root_id, 0 AS depth, coalesce(h.name, CAST(h.id AS VARCHAR)) AS path, [h.id] AS ids
  FROM held h WHERE h.parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM held p WHERE p.id = h.parent_id)
  UNION ALL
  SELECT h.id, t.root_id, t.depth + 1, t.path || '/' || coalesce(h.name, CAST(h.id AS VARCHAR)), list_append(t.ids, h.id)
  FROM tree t JOIN held h ON h.parent_id = t.id
), lost AS (
  SELECT h.id, h.parent_id FROM held h WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.id = h.id)
), walk AS (
  SELECT id, parent_id AS cur FROM lost
  UNION
  SELECT w.id, l.parent_id FROM walk w JOIN lost l ON l.id = w.cur
), ring AS (
  SELECT id FROM walk WHERE cur = id
), circle AS (
  SELECT w.id, min(w.cur) AS root_id FROM walk w JOIN ring r ON r.id = w.cur GROUP BY w.id
)
"""

ORACLES = {
    "p4_found": _FOREST
    + """SELECT h.id AS symbol_id, coalesce(t.root_id, c.root_id) AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth
FROM held h LEFT JOIN tree t ON t.id = h.id LEFT JOIN circle c ON c.id = h.id WHERE h.parent_id IS NOT NULL""",
    "p4_paths": _FOREST
    + """SELECT h.id AS symbol_id, coalesce(t.root_id, c.root_id) AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, t.path AS path
FROM held h LEFT JOIN tree t ON t.id = h.id LEFT JOIN circle c ON c.id = h.id""",
    "p4_descendants": _FOREST
    + """SELECT a.anc AS ancestor_id, a.id AS descendant_id, CAST(a.depth - a.pos + 1 AS INTEGER) AS distance FROM (
  SELECT id, depth, unnest(ids) AS anc, generate_subscripts(ids, 1) AS pos FROM tree
) a WHERE a.anc <> a.id""",
    "p4_circles": _FOREST + """SELECT c.root_id, r.id AS symbol_id FROM ring r JOIN circle c ON c.id = r.id""",
}
