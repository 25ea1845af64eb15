"""The relations of an indexed corpus, each with one row per key, as every operator expects them.

symbols   one row per id, the newest; null is_test and is_entry_point are false
edges     one row per (source, target, type), and per (source, type, raw target) where unresolved
chunks    one row per id, the newest
modules   file to file: one row per pair of files that an IMPORTS edge joins
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.common import HEAVY_ROWS, HEAVY_SHARE, few, keep_latest, latest_rows, lookup_join, path_exists, settled_rows, table_state, work_folder
from codeloom.operators.lexical import corpus_stats
from codeloom.operators.postings import LexicalIndex
from codeloom.sources.tables import load

SYMBOL_COLUMNS = (
    "id fqn name kind file_path line_start line_end column_start column_end docstring declared_rules language conventional_fqn canonical_fqn "
    "parent_symbol_id visibility is_test is_entry_point entry_point_reason importance"
).split()
EDGE_COLUMNS = "id source_symbol_id target_symbol_id edge_type source_range target_range resolution_tier resolved target_raw properties".split()
CHUNK_COLUMNS = (
    "id fqn fqn_rel path_rel file_path line_start line_end content language is_definition chunk_type chunk_node_type subwords declared_rules content_type is_test"
).split()


#: What the ranking passes look for in the text of a definition.
DEFINITION_MARKS = ("static final", "const ", "GetMapping", "PostMapping", "PutMapping", "PatchMapping", "DeleteMapping")


def clean_symbols(raw: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _flagged(latest_rows(raw, "id", columns or SYMBOL_COLUMNS))


def settled_symbols(raw: DataFrame) -> DataFrame:
    """As ``clean_symbols``; symbols that stand once are not shuffled."""
    return _flagged(settled_rows(raw, "id", SYMBOL_COLUMNS))


def _flagged(rows: DataFrame) -> DataFrame:
    for flag in ("is_test", "is_entry_point"):
        if flag in rows.columns:
            rows = rows.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return rows


def clean_edges(raw: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Of edges that state the same, the one with the least id. Combined before the shuffle, so a
    symbol that is the target of a third of all rows does not gather them."""
    same = [
        F.col("source_symbol_id").alias("_s"),
        F.col("target_symbol_id").alias("_t"),
        F.col("edge_type").alias("_e"),
        F.when(F.col("target_symbol_id").isNull(), F.coalesce("target_raw", F.lit(""))).alias("_r"),
    ]
    # what is stated is the key itself; only the rest has to be carried along with the least id
    stated = {"source_symbol_id": "_s", "target_symbol_id": "_t", "edge_type": "_e"}
    wanted = columns or EDGE_COLUMNS
    rest = [c for c in wanted if c not in stated and c != "id"]
    kept = raw.where("id is not null").groupBy(*same).agg(F.min("id").alias("_id"), F.min_by(F.struct(*rest), "id").alias("_held"))
    out = kept.select(*[F.col("_id").alias("id") if c == "id" else F.col(stated[c]).alias(c) if c in stated else F.col("_held")[c].alias(c) for c in wanted])
    return out.withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def settled_edges(raw: DataFrame, columns: list[str]) -> DataFrame:
    """As ``clean_edges``; edges that are stated once are not shuffled. A hash says which may be stated
    again: others that share it are only compared with them."""
    said = F.xxhash64("source_symbol_id", "target_symbol_id", "edge_type", F.when(F.col("target_symbol_id").isNull(), F.coalesce("target_raw", F.lit(""))))
    rows = raw.where("id is not null")
    again = few(rows.groupBy(said.alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))
    once = rows.join(again, said == F.col("_h"), "left_anti").select(*columns).withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    return once.unionByName(clean_edges(rows.join(again, said == F.col("_h"), "left_semi"), columns))


@dataclass(frozen=True)
class Corpus:
    """The relations of one directory of tables; each is planned when first asked for."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def settled(self, name: str, table: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A clean relation of this state of its table: settled once, then read column by column.

        What newest rows cost - an aggregation over all rows - is paid when a table has changed, not
        by every question."""
        path = f"{work_folder(self.spark)}/{name}-{table_state(self.spark, f'{self.sf_dir}/{table}.parquet')}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def symbols_with(self, *columns: str) -> DataFrame:
        """Only the named columns, so that only they are read."""
        return self.symbols.select("id", *[c for c in columns if c != "id"])

    @cached_property
    def symbols(self) -> DataFrame:
        return self.settled("symbols", "symbols", lambda: settled_symbols(self.table("symbols")))

    @cached_property
    def edges(self) -> DataFrame:
        """Without the ranges of targets, which no operator reads."""
        return self.settled("edges", "edges", lambda: settled_edges(self.table("edges"), [c for c in EDGE_COLUMNS if c != "target_range"]))

    @cached_property
    def resolved_edges(self) -> DataFrame:
        """Those that lead to a symbol, with what the graph operators look at."""
        lean = ["id", "source_symbol_id", "target_symbol_id", "edge_type", "source_range", "resolution_tier", "resolved"]
        return self.edges.where("resolved and target_symbol_id is not null").select(*lean)

    @cached_property
    def hot_targets(self) -> list[int]:
        """Symbols that so many edges lead to that a join by target would put them into one task: at most
        1 / HEAVY_SHARE, settled with the edges."""
        counts = self.resolved_edges.groupBy("target_symbol_id").agg(F.count("*").alias("n"))
        total = self.resolved_edges.agg(F.count("*").alias("total"))
        hot = counts.crossJoin(F.broadcast(total)).where((F.col("n") >= HEAVY_ROWS) & (F.col("n") >= F.col("total") * HEAVY_SHARE))  # one row
        return [r["target_symbol_id"] for r in self.settled("hot_targets", "edges", lambda: hot.select("target_symbol_id", "n")).collect()]

    @cached_property
    def adjacency(self) -> DataFrame:
        """a, b, edge_type of resolved edges between different symbols, laid out by source: the snapshot
        that walks read. A new state of the edges has a snapshot of its own."""
        links = self.resolved_edges.where("source_symbol_id <> target_symbol_id").select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b"), "edge_type").distinct()
        return self.settled("adjacency", "edges", lambda: links.repartitionByRange("a", "b").sortWithinPartitions("a", "b"))

    @cached_property
    def chunks(self) -> DataFrame:
        return latest_rows(self.table("code_chunks"), "id", CHUNK_COLUMNS)

    def chunks_with(self, *columns: str) -> DataFrame:
        return latest_rows(self.table("code_chunks"), "id", ["id", *[c for c in columns if c != "id"]])

    @cached_property
    def rows(self) -> DataFrame:
        """The chunks as they are written, repeats too: what reads texts works on these where they
        lie and drops what it found in old rows by ``versions``."""
        return self.table("code_chunks").where("id is not null")

    @cached_property
    def versions(self) -> DataFrame:
        return self.rows.select("id", "updated_at")

    def chunks_of(self, ids: DataFrame, *columns: str) -> DataFrame:
        """The holding rows of a pool of ids (id; bounded by the top-k that made it)."""
        near = self.table("code_chunks").join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")
        return latest_rows(near, "id", ["id", *[c for c in columns or CHUNK_COLUMNS if c != "id"]])

    @cached_property
    def definitions(self) -> DataFrame:
        """Definition chunks without their texts; content holds only the marks that the ranking passes
        look for."""
        marks = [F.when(F.col("content").contains(m), m) for m in DEFINITION_MARKS]
        slim = ["id", "updated_at", "fqn", "file_path", "chunk_type", "chunk_node_type", "content_type", "declared_rules", "is_definition", "is_test", "subwords", "language"]
        rows = self.rows.where("is_definition").select(*slim, F.concat_ws(" ", *marks).alias("content"))
        return self.settled("definitions", "code_chunks", lambda: keep_latest(rows, self.versions, "id"))

    @cached_property
    def lexical(self) -> LexicalIndex:
        """The inverted index of this state of the table; written when first asked for."""
        table = f"{self.sf_dir}/code_chunks.parquet"
        path = f"{work_folder(self.spark)}/lexical-{table_state(self.spark, table)}"
        if not path_exists(self.spark, f"{path}/facts/_SUCCESS"):
            LexicalIndex.write(self.table("code_chunks"), corpus_stats(self.chunks_with("language", "subwords")), path)
        return LexicalIndex.read(self.spark, path)

    def build(self) -> dict[str, int]:
        """Settles every relation and writes the index; their numbers of rows."""
        return {"symbols": self.symbols.count(), "edges": self.edges.count(), "resolved_edges": self.resolved_edges.count(), "chunks": self.lexical.chunks, "postings": self.lexical.postings.count(), "subword_stats": self.lexical.stats.count()}

    @cached_property
    def modules(self) -> DataFrame:
        """source_path, target_path, resolved, target_raw of imports between files."""
        files = self.symbols_with("file_path")
        src = files.select(F.col("id").alias("source_symbol_id"), F.col("file_path").alias("source_path"))
        dst = files.select(F.col("id").alias("target_symbol_id"), F.col("file_path").alias("target_path"))
        imports = self.edges.where("edge_type = 'IMPORTS'").select("source_symbol_id", "target_symbol_id", "target_raw", "resolved")
        both = lookup_join(imports.join(src, "source_symbol_id"), dst.withColumnRenamed("target_symbol_id", "_to"), "target_symbol_id", "_to", self.hot_targets, "left")
        return both.groupBy("source_path", "target_path", F.when(F.col("target_path").isNull(), F.coalesce("target_raw", F.lit(""))).alias("target_raw")).agg(
            F.bool_or(F.col("resolved") & F.col("target_path").isNotNull()).alias("resolved")
        )


#: SQL of the same relations, for the queries' SQL.
SQL_VIEWS = """
sym AS (
  SELECT id, fqn, name, kind, file_path, line_start, line_end, docstring, declared_rules, language, conventional_fqn, canonical_fqn, parent_symbol_id,
    visibility, coalesce(is_test, false) AS is_test, coalesce(is_entry_point, false) AS is_entry_point, entry_point_reason, importance
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1
), edg AS (
  SELECT id, source_symbol_id, target_symbol_id, edge_type, source_range, resolution_tier, coalesce(resolved, false) AS resolved, target_raw, properties
  FROM (
    SELECT *, row_number() OVER (PARTITION BY source_symbol_id, target_symbol_id, edge_type,
      CASE WHEN target_symbol_id IS NULL THEN coalesce(target_raw, '') END ORDER BY id) AS rn FROM edges WHERE id IS NOT NULL
  ) WHERE rn = 1
), res AS (
  SELECT * FROM edg WHERE resolved AND target_symbol_id IS NOT NULL
), chk AS (
  SELECT id, fqn, fqn_rel, path_rel, file_path, line_start, line_end, content, language, is_definition, chunk_type, chunk_node_type, subwords, declared_rules, content_type, is_test
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM code_chunks WHERE id IS NOT NULL) WHERE rn = 1
)"""
