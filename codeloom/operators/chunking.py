"""Texts to chunks, and what lines say: headings, blocks, imports, rationale, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import smallest_enclosing

MAX_LINES = 100
#: Comment markers of a rationale and their kinds.
RATIONALE = r"(?i)(?:#|//|/?\*|--)\s*(note|why|hack|todo|fixme|adr)\b[:\s-]*(.*)$"
#: Import forms by language; the first group that matches is what is imported.
IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",
    "javascript": r"""^\s*(?:import\s.*?from\s+|import\s+|export\s.*?from\s+)["']([^"']+)["']""",
    "go": r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$""",
}
IMPORTS["typescript"] = IMPORTS["javascript"]
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "go.sum", "gemfile.lock", "composer.lock")
LOCK_EXCERPT = 2_000
EMBED_BUDGET = 2_000


def text_lines(texts: DataFrame) -> DataFrame:
    """item, no (from 1), line of texts (item, text)."""
    rows = texts.where("text is not null").select("item", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select("item", (F.col("at") + 1).alias("no"), F.regexp_replace("line", "\r$", "").alias("line"))


def _in_fence(lines: DataFrame) -> Column:
    w = Window.partitionBy("item").orderBy("no")
    return (F.sum(F.when(F.col("line").rlike(r"^\s*(?:```|~~~)"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2) == 1


def heading_chunks(texts: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """item, line_start, line_end, heading: sections of prose, of at most ``max_lines`` lines.

    A section begins at a heading (#, =, or a line underlined with = or -) outside of code fences.
    The windows run within one text each, so a task holds the lines of a text, not of a table."""
    lines = text_lines(texts)
    w = Window.partitionBy("item").orderBy("no")
    marked = lines.withColumn("fenced", _in_fence(lines)).withColumn("next", F.lead("line").over(w))
    atx = F.col("line").rlike(r"^#{1,6}\s+\S|^={1,6}\s+\S")
    setext = F.col("line").rlike(r"\S") & F.coalesce(F.col("next").rlike(r"^(?:={3,}|-{3,})\s*$"), F.lit(False)) & ~F.col("line").rlike(r"^\s*(?:[-*+>|]|\d+\.)")
    headed = marked.withColumn("head", (atx | setext) & ~F.col("fenced"))
    section = headed.withColumn("section", F.sum(F.col("head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.min("no").over(Window.partitionBy("item", "section"))
    block = section.withColumn("block", F.floor((F.col("no") - begin) / max_lines))
    return block.groupBy("item", "section", "block").agg(
        F.min("no").alias("line_start"), F.max("no").alias("line_end"), F.min_by(F.when(F.col("head"), F.trim(F.regexp_replace("line", "^[#=]+", ""))), "no").alias("heading")
    ).select("item", "line_start", "line_end", "heading")


def line_blocks(texts: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """item, line_start, line_end: blocks of ``max_lines`` lines, one for a short text; without windows."""
    n = F.size(F.split("text", "\n"))
    starts = texts.where("text is not null").select("item", n.alias("n"), F.explode(F.sequence(F.lit(1), n, F.lit(max_lines))).alias("line_start"))
    return starts.select("item", "line_start", F.least(F.col("line_start") + max_lines - 1, F.col("n")).alias("line_end"))


def coalesced(chunks: DataFrame, max_chars: int) -> DataFrame:
    """file_path, line_start, line_end, n: neighbouring small chunks of a file joined up to ``max_chars``.

    chunks: file_path, line_start, line_end, size. A gap of more than a line, or a full piece, begins
    the next; pieces are cut by running sizes, an islands problem within each file."""
    w = Window.partitionBy("file_path").orderBy("line_start", "line_end")
    gap = F.col("line_start") > F.lag("line_end").over(w) + 2
    runs = chunks.withColumn("_run", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("size").over(Window.partitionBy("file_path", "_run").orderBy("line_start", "line_end").rowsBetween(Window.unboundedPreceding, 0))
    pieces = runs.withColumn("_piece", F.floor((total - 1) / max_chars))
    return pieces.groupBy("file_path", "_run", "_piece").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.count("*").alias("n")).select("file_path", "line_start", "line_end", "n")


def anchored(pieces: DataFrame, max_chars: int = 750) -> DataFrame:
    """file_path, line_start, line_end, anchor, n: definitions with the small pieces that they take in, and
    the runs of what is left.

    pieces: id, file_path, line_start, line_end, size, is_definition. A piece that is no definition goes
    to the smallest definition around its first line while that, in order of lines, holds ``max_chars``;
    what finds no room, or stands outside of all, is joined with its neighbours. Rows without lines
    are left out."""
    rows = pieces.where("file_path is not null and line_start is not null and line_end is not null")
    anchors = rows.where("is_definition")
    leaves = rows.where("not coalesce(is_definition, false)")
    spans = anchors.select("file_path", "line_start", "line_end", F.col("id").alias("span_id"))
    near = smallest_enclosing(leaves.select("file_path", F.col("line_start").alias("line"), "id"), spans, ["id"])
    held = leaves.join(near.select(F.col("id").alias("lid"), F.col("span_id").alias("anchor")), F.col("id") == F.col("lid"), "left").drop("lid")
    held = held.join(anchors.select(F.col("id").alias("aid"), F.col("size").alias("asize")), F.col("anchor") == F.col("aid"), "left")
    run = F.sum("size").over(Window.partitionBy("anchor").orderBy("line_start", "id").rowsBetween(Window.unboundedPreceding, 0))
    inside = held.where("anchor is not null").withColumn("fits", F.col("asize") + run <= max_chars)
    taken = inside.where("fits").groupBy("anchor").agg(F.count("*").alias("n"), F.max("line_end").alias("leaf_end"), F.min("line_start").alias("leaf_start"))
    whole = anchors.join(taken, F.col("id") == F.col("anchor"), "left").select(
        "file_path", F.least("line_start", "leaf_start").alias("line_start"), F.greatest("line_end", "leaf_end").alias("line_end"), F.col("id").alias("anchor"), (1 + F.coalesce("n", F.lit(0))).alias("n")
    )
    columns = ["file_path", "line_start", "line_end", "size"]
    orphans = coalesced(held.where("anchor is null").select(*columns).unionByName(inside.where("not fits").select(*columns)), max_chars)
    return whole.unionByName(orphans.select("file_path", "line_start", "line_end", F.lit(None).cast("long").alias("anchor"), "n"))


def paragraphs(texts: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """item, line_start, line_end: a text of at most ``max_lines`` lines whole, a longer one by blocks
    between blank lines, of at most as many lines. Windows run within one text."""
    n = F.size(F.split("text", "\n"))
    short = texts.where("text is not null").where(n <= max_lines).select("item", F.lit(1).alias("line_start"), n.alias("line_end"))
    lines = text_lines(texts.where(n > max_lines)).where(F.col("line").rlike(r"\S"))
    w = Window.partitionBy("item").orderBy("no")
    runs = lines.withColumn("run", F.sum(F.when(F.col("no") > F.lag("no").over(w) + 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.min("no").over(Window.partitionBy("item", "run"))
    block = runs.withColumn("block", F.floor((F.col("no") - begin) / max_lines))
    return short.unionByName(block.groupBy("item", "run", "block").agg(F.min("no").alias("line_start"), F.max("no").alias("line_end")).select("item", "line_start", "line_end"))


def import_lines(lines: DataFrame, *carried: str) -> DataFrame:
    """file_path, line_no, module of import statements. lines: file_path, language, line_no, line and
    what is carried along."""
    found = F.lit(None).cast("string")
    for language, pattern in IMPORTS.items():
        groups = 2 if language == "python" else 1
        hit = F.coalesce(*[F.nullif(F.regexp_extract("line", pattern, g + 1), F.lit("")) for g in range(groups)])
        found = F.when(F.col("language") == language, hit).otherwise(found)
    return lines.select(*carried, "file_path", "line_no", found.alias("module")).where("module is not null")


def rationale(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, line_no, kind, text, symbol_id of rationale comments, at the smallest symbol around them.

    lines: file_path, line_no, line."""
    marks = lines.select("file_path", "line_no", F.lower(F.regexp_extract("line", RATIONALE, 1)).alias("kind"), F.trim(F.regexp_extract("line", RATIONALE, 2)).alias("text")).where("kind <> ''")
    spans = symbols.select("file_path", "line_start", "line_end", F.col("id").alias("span_id"))
    points = marks.select("file_path", F.col("line_no").alias("line")).distinct()
    near = smallest_enclosing(points, spans, [])
    return marks.join(near.select(F.col("file_path").alias("f"), F.col("line").alias("l"), F.col("span_id").alias("symbol_id")), (F.col("file_path") == F.col("f")) & (F.col("line_no") == F.col("l")), "left").drop("f", "l")


def source_slice(chunks: DataFrame, *carried: str) -> DataFrame:
    """id, slice: the content's own lines line_start..line_end, counted from its first line."""
    n = F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(1))
    return chunks.select("id", *carried, F.array_join(F.slice(F.split("content", "\n"), 1, n), "\n").alias("slice"))


def lock_excerpts(texts: DataFrame, *carried: str) -> DataFrame:
    """file_path, excerpt: the bounded first part of lock files, which are indexed by an excerpt only
    (file_path, text)."""
    name = F.lower(F.element_at(F.split("file_path", "/"), -1))
    return texts.where(name.isin(*LOCKFILES)).select(*carried, "file_path", F.substring("text", 1, LOCK_EXCERPT).alias("excerpt"))


def embed_text(chunks: DataFrame, *carried: str) -> DataFrame:
    """id, text: module and name on one line, then the content, which wins within the budget."""
    module = F.regexp_replace(F.regexp_replace("path_rel", r"\.[^./]+$", ""), "/", ".")
    chain = F.regexp_replace(F.coalesce("fqn_rel", F.lit("")), r"^.*::", "")
    head = F.trim(F.concat_ws(" ", module, chain))
    body = F.substring(F.coalesce("content", F.lit("")), 1, EMBED_BUDGET)
    room = F.lit(EMBED_BUDGET) - F.char_length(body) - 1
    return chunks.select("id", *carried, F.when(room > 0, F.concat(F.substr(head, F.lit(1), room), F.lit("\n"), body)).otherwise(body).alias("text"))
