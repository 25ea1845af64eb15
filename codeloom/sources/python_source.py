"""Python sources to symbols, edges and chunks: the adapter that needs no grammar library."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "fqn string, name string, kind string, file_path string, line_start int, line_end int, docstring string, declared_rules string, parent_fqn string, visibility string, content string"
REFERENCES = "source_fqn string, target_raw string, edge_type string, file_path string, line int, column int"


def module_name(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


class _Walker(ast.NodeVisitor):
    """Declarations with their full names, and what each of them calls, extends, imports and uses."""

    def __init__(self, path: str, text: str) -> None:
        self.path, self.lines = path, text.split("\n")
        self.symbols: list[tuple] = []
        self.references: list[tuple] = []
        self.stack: list[tuple[str, str]] = []
        self.imports: dict[str, str] = {}

    def name_of(self, node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return self.imports.get(node.id, node.id)
        if isinstance(node, ast.Attribute):
            base = self.name_of(node.value)
            return f"{base}.{node.attr}" if base else node.attr
        return None

    def here(self) -> str:
        return self.stack[-1][0] if self.stack else f"{self.path}::<module>"

    def refer(self, target: str | None, kind: str, node: ast.AST) -> None:
        if target:
            self.references.append((self.here(), target, kind, self.path, node.lineno, node.col_offset))

    def declare(self, node, kind: str) -> None:
        parent = self.stack[-1] if self.stack else None
        chain = f"{parent[0].split('::', 1)[1]}.{node.name}" if parent else node.name
        fqn = f"{self.path}::{chain}"
        begin = min([node.lineno, *[d.lineno for d in node.decorator_list]])
        rules = ", ".join("@" + ast.unparse(d) for d in node.decorator_list) or None
        visibility = "private" if node.name.startswith("_") and not node.name.startswith("__") else "public"
        body = "\n".join(self.lines[begin - 1 : node.end_lineno])
        self.symbols.append((fqn, node.name, kind, self.path, node.lineno, node.end_lineno, ast.get_docstring(node), rules, parent[0] if parent else None, visibility, body))
        self.stack.append((fqn, kind))
        for d in node.decorator_list:
            self.refer(self.name_of(d.func if isinstance(d, ast.Call) else d), "USAGE", d)
        for base in getattr(node, "bases", []):
            self.refer(self.name_of(base), "INHERITS", base)
        for child in node.body:
            self.visit(child)
        self.stack.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.declare(node, "class")

    def visit_FunctionDef(self, node) -> None:
        inside = self.stack and self.stack[-1][1] == "class"
        self.declare(node, "constructor" if inside and node.name == "__init__" else "method" if inside else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.refer(a.name, "IMPORTS", node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        if node.level:
            folder = self.path.split("/")[: -node.level]
            base = ".".join([*folder, node.module] if node.module else folder)
        for a in node.names:
            self.imports[a.asname or a.name] = f"{base}.{a.name}"
        self.refer(base, "IMPORTS", node)

    def visit_Call(self, node: ast.Call) -> None:
        self.refer(self.name_of(node.func), "CALLS", node)
        for arg in [*node.args, *[k.value for k in node.keywords]]:
            if isinstance(arg, ast.Name | ast.Attribute):
                self.refer(self.name_of(arg), "CALL_REFERENCE", arg)
        self.generic_visit(node)


def parse(path: str, text: str) -> tuple[list[tuple], list[tuple]] | None:
    """(symbols, references) of a module; None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    walker = _Walker(path, text)
    for node in tree.body:
        walker.visit(node)
    return walker.symbols, walker.references


def _rows(which: int, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                got = parse(path, text or "")
                rows += got[which] if got else []
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def symbol_id(fqn: Column) -> Column:
    """A hash of the full name that is never negative: the pattern graph numbers its own nodes below zero."""
    return F.shiftrightunsigned(F.xxhash64(fqn), 1)


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files (file_path, content); files that do not parse give none. Ids are hashes
    of the full names, so partitions need not agree on numbers."""
    rows = files.where("file_path like '%.py'").select("file_path", "content").mapInArrow(_rows(0, SYMBOLS), SYMBOLS)
    conventional = F.concat(F.regexp_replace(F.regexp_replace("file_path", r"(?:/__init__)?\.py$", ""), "/", "."), F.lit("."), F.substring_index("fqn", "::", -1))
    return rows.select(symbol_id(F.col("fqn")).alias("id"), "*", conventional.alias("conventional_fqn"), F.when(F.col("parent_fqn").isNotNull(), symbol_id(F.col("parent_fqn"))).alias("parent_symbol_id"))


def python_references(files: DataFrame) -> DataFrame:
    """Raw references of Python files, to be resolved over all files."""
    return files.where("file_path like '%.py'").select("file_path", "content").mapInArrow(_rows(1, REFERENCES), REFERENCES)


def index_python(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of Python files: references resolved by the tiers of the resolver."""
    from codeloom.operators.resolve import resolve_references

    symbols = python_symbols(files)
    refs = python_references(files).withColumn("id", F.shiftrightunsigned(F.xxhash64("source_fqn", "target_raw", "edge_type", "line", "column"), 1))
    found = resolve_references(symbols.select("id", "fqn", "name", "conventional_fqn", "file_path"), refs.select("id", F.col("target_raw").alias("raw"), "file_path"))
    edges = refs.join(found.select(F.col("id").alias("rid"), "tier", "target"), F.col("id") == F.col("rid")).select(
        "id", symbol_id(F.col("source_fqn")).alias("source_symbol_id"), F.col("target").alias("target_symbol_id"), "edge_type", F.array("line", "column").alias("source_range"),
        F.lit(None).cast("array<int>").alias("target_range"), F.when(F.col("target").isNotNull(), F.col("tier")).otherwise(F.lit("ambiguous")).alias("resolution_tier"),
        F.col("target").isNotNull().alias("resolved"), "target_raw", F.create_map().cast("map<string,string>").alias("properties"),
    )
    return symbols, edges
