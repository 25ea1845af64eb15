"""The virtual nodes and edges that patterns are matched against."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.common import cut

#: Labels by the stored kind.
LABELS = {
    "function": "Function", "method": "Method", "class": "Class", "interface": "Interface", "enum": "Enum", "constructor": "Constructor",
    "field": "Field", "variable": "Variable", "import": "Import", "type_alias": "TypeAlias",
}
SYNTHETIC = ("File", "Module", "Unresolved")
NODE_PROPERTIES = (
    "id label name kind fqn canonical_fqn conventional_fqn file_path line_start line_end importance is_entry_point is_test visibility"
).split()
EDGE_COLUMNS = "id source target type resolved tier".split()
STORED_TYPES = ("CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "REFERENCES", "USAGE", "CALL_REFERENCE", "TESTS")
_NODE_TYPES = dict(
    id="bigint", label="string", name="string", kind="string", fqn="string", canonical_fqn="string", conventional_fqn="string", file_path="string",
    line_start="int", line_end="int", importance="double", is_entry_point="int", is_test="int", visibility="string",
)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Consecutive numbers from 1 by order of ``key``, without a single task: rows are ranged by
    key, numbered within each range and shifted by the sizes of the ranges before it."""
    ranged = cut(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row per range
    shift, before = F.lit(0), 0
    for part in sorted(sizes):
        shift = F.when(F.col("_part") == part, F.lit(before)).otherwise(shift)
        before += sizes[part]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn(name, within + shift).drop("_part")


@dataclass(frozen=True)
class PatternGraph:
    """symbols, edges (clean) and modules of a corpus as labelled nodes and typed edges."""

    symbols: DataFrame
    edges: DataFrame
    modules: DataFrame
    hot: Sequence[int] = ()  # nodes that very many edges lead to

    def _shaped(self, df: DataFrame, **columns) -> DataFrame:
        return df.select(*[columns.get(p, F.lit(None)).cast(t).alias(p) for p, t in _NODE_TYPES.items()])

    def _symbols(self, labels: Iterable[str] | None) -> DataFrame:
        rows = self.symbols
        if labels is not None:
            kinds = [k for k, v in LABELS.items() if v in set(labels)]
            rows = rows.where(F.col("kind").isin(*kinds))
        pairs = [F.lit(x) for kv in LABELS.items() for x in kv]
        names = {c: F.col(c) for c in NODE_PROPERTIES if c in rows.columns}
        return self._shaped(rows, **{**names, "label": F.create_map(*pairs)[F.col("kind")]})

    def _files(self) -> DataFrame:
        rows = self.symbols.where("file_path is not null").groupBy("file_path").agg(F.min("id").alias("low"))
        name = F.element_at(F.split("file_path", "/"), -1)
        return self._shaped(rows, id=-F.col("low"), label=F.lit("File"), name=name, kind=F.lit("file"), fqn=F.col("file_path"), file_path=F.col("file_path"))

    def _modules(self) -> DataFrame:
        folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
        rows = numbered(self.symbols.where("file_path is not null").select(folder.alias("folder")).distinct(), "folder", "n")
        name = F.element_at(F.split("folder", "/"), -1)
        return self._shaped(rows, id=-(F.lit(1_000_000_000) + F.col("n")), label=F.lit("Module"), name=name, kind=F.lit("module"), fqn=F.col("folder"), file_path=F.col("folder"))

    def _raw_names(self) -> DataFrame:
        raw = self.edges.where("not resolved and target_raw is not null and target_raw <> ''").select("target_raw").distinct()
        return numbered(raw, "target_raw", "n").withColumn("uid", -(F.lit(3_000_000_000) + F.col("n")))

    def _unresolved(self) -> DataFrame:
        return self._shaped(self._raw_names(), id=F.col("uid"), label=F.lit("Unresolved"), name=F.col("target_raw"), kind=F.lit("unresolved"), fqn=F.col("target_raw"))

    def nodes(self, labels: Iterable[str] | None) -> DataFrame:
        """Nodes of the labels; of all, the symbols first, if None. Branches not asked for are not built."""
        wanted = None if labels is None else set(labels)
        parts = []
        if wanted is None or wanted - set(SYNTHETIC):
            parts.append(self._symbols(wanted))
        for label, build in (("File", self._files), ("Module", self._modules), ("Unresolved", self._unresolved)):
            if wanted is None or label in wanted:
                parts.append(build())
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def links(self, types: Iterable[str] | None, unresolved: bool, files: bool) -> DataFrame:
        """id, source, target, type, resolved, tier, line, properties of the edges of the types.

        Unresolved targets and imports between files are only built where a pattern can meet them."""
        wanted = set(types) if types is not None else {*STORED_TYPES, "CONTAINS"}
        line = F.get("source_range", F.lit(0))
        parts = []
        stored = self.edges
        if types is not None:
            stored = stored.where(F.col("edge_type").isin(*sorted(wanted)))
        columns = ["id", F.col("source_symbol_id").alias("source"), "target", F.col("edge_type").alias("type"), F.col("resolved").cast("int").alias("resolved"), F.col("resolution_tier").alias("tier"), line.alias("line"), "properties"]
        if wanted & set(STORED_TYPES):
            known = stored.where("target_symbol_id is not null").withColumn("target", F.col("target_symbol_id"))
            parts.append(known.select(*columns))
            if unresolved:
                names = self._raw_names().select(F.col("target_raw").alias("r"), F.col("uid").alias("target"))
                open_ = stored.where("target_symbol_id is null and not resolved").join(names, F.col("target_raw") == F.col("r"))
                parts.append(open_.select(*columns))
        empty = F.lit(None).cast("map<string,string>").alias("properties")
        if "CONTAINS" in wanted:
            inside = self.symbols.where("parent_symbol_id is not null")
            parts.append(
                inside.select(
                    (-(F.lit(1_000_000_000) + F.col("id"))).alias("id"), F.col("parent_symbol_id").alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("type"),
                    F.lit(1).alias("resolved"), F.lit("exact").alias("tier"), F.lit(None).cast("int").alias("line"), empty,
                )
            )
        if files and "IMPORTS" in wanted:
            ids = self._files().select(F.col("id").alias("fid"), F.col("file_path").alias("f"))
            pairs = self.modules.where("target_path is not null").select("source_path", "target_path").distinct()
            met = pairs.join(ids, F.col("source_path") == F.col("f")).drop("f").withColumnRenamed("fid", "source").join(ids, F.col("target_path") == F.col("f")).withColumnRenamed("fid", "target")
            parts.append(
                met.select(
                    F.lit(None).cast("bigint").alias("id"), "source", "target", F.lit("IMPORTS").alias("type"), F.lit(1).alias("resolved"), F.lit("exact").alias("tier"),
                    F.lit(None).cast("int").alias("line"), empty,
                )
            )
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def steps(self, types: Iterable[str] | None) -> DataFrame:
        """source, target of the stored, resolved edges that a path of variable length takes."""
        rows = self.edges.where("target_symbol_id is not null and resolved")
        if types is not None:
            rows = rows.where(F.col("edge_type").isin(*types))
        return rows.select(F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target")).distinct()
