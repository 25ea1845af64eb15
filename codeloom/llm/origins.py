"""Generated, minified, vendored and data files among sources (problem 1)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.attributes import DEFAULT_RULES, attribute_rules, declared_kinds, glob_regex, parse_attributes
from codeloom.operators.common import cut, keep_latest

#: A numbered sequence of at least this many steps marks machine-written code.
LEAST_STEPS = 3
#: Share of a file's code that must be literals, or dense lines, for it to be data or minified.
DATA_SHARE = 0.6
DENSE_SHARE = 0.5
#: Share of a file's text that must stand in vendored files for it to be a copy of one.
COPY_SHARE = 0.8
#: A pattern is mined if the lower bound (95 %) of the share of its files that show the evidence is
#: at least this, in at least MINED_REPOS repositories. Lines of headers are shared more widely than
#: paths, so they have to be surer.
MINED_BOUND = 0.5
HEADER_BOUND = 0.8
MINED_REPOS = 2
#: Characters from which equal texts in several repositories count as taken from elsewhere, and
#: from which a chunk can show that a file is a copy (shorter ones are alike by chance).
SHARED_SIZE = 200
COPIED_SIZE = 40

_COMMENT = re.compile(r"\s*(?://|#|/\*|\*|\"\"\"|'''|<!--)")
_BLOCK = re.compile(r"\s*(/\*|\"\"\"|'''|<!--)")
_CLOSES = {"/*": "*/", '"""': '"""', "'''": "'''", "<!--": "-->"}
_IMPORT = re.compile(r"\s*(?:import|from|package|use|require)\b")
_MARKS = re.compile(r"^\s*(?://+|#+|/?\*+!?|\"\"\"|'''|<!--|--)?\s*")
_GENERATED = re.compile(
    r"^\W*(?:(?:this )?(?:code|file|source|class|module)?\s*(?:is |was |has been )?(?:auto-?\s?|automatically )?generated (?:by|from)\b"
    r"|@generated\b|<auto-?generated\b|auto-?\s?generated (?:file|code|source)\b\W+(?:do not|don't|please)|automatically (?:produced|generated|created)\b"
    r"|(?:this|the) (?:file|code|source|module) (?:was|is|has been) (?:\w+ ){0,2}(?:created|generated|produced|written) (?:automatically|by)\b"
    r"|diese datei (?:wurde|ist|wird) .*(?:erzeugt|generiert|erstellt)|ce fichier (?:a été|est) .*(?:généré|produit|créé)|este archivo (?:fue|ha sido|es) .*(?:generado|creado)"
    r"|do not (?:edit|modify) (?:this|by hand|manually)|do not edit\W*$)",
    re.I,
)
#: A header that names the project a file comes from; the first group that matches is the name.
_PROJECT = re.compile(
    r"^\W*(?:([\w-]+) v?\d+(?:\.\d+)+ - upstream copy|part of the ([\w-]+) (?:distribution|project|library)|([\w-]+) v\d+(?:\.\d+)+\W*$"
    r"|(?:copyright )?\(c\)\s*\d{4}(?:[-,]\s*\d{4})? (?:the )?([\w-]+) (?:authors|contributors|developers|project)"
    r"|copyright (?:\(c\) )?\d{4}(?:[-,]\s*\d{4})? (?:the )?([\w-]+) (?:authors|contributors|developers|project)"
    r"|spdx-license-identifier:\s*([\w-]+)-terms)",
    re.I,
)
_NUMBERED = re.compile(
    r"(?<!\w)(?!(?:u?int|float|sha|utf|base|complex|md)\d)[A-Za-z$][A-Za-z_$]*?_?(\d{1,4})(?=_*(?:[A-Z_]{4,})?(?![\w.]))|\w\[(\d{1,4})\]"
)
_LITERALS = re.compile(r"^[\s\[\](){},;:+\-.\dxXa-fA-FeE_\"']+$")
_HAS_VALUES = re.compile(r"\d.*\d|[\"']")
_ENCODED = re.compile(r"^\s*[bru]?[\"'][A-Za-z0-9+/=_\-]{32,}[\"']\s*[+,)\];]*\s*$")
_PUNCTUATION = re.compile(r"[;,{}()=]")
_HEADER_WORD = re.compile(r"[^\W_]+(?:[-_./@][^\W_]+)*")
_NAME_LIKE = re.compile(r"[\d\-_./@]")


def header_of(text: str) -> list[str]:
    """The comment lines, without marks, before the first line of code: line comments, and block
    comments and docstrings up to their ends."""
    out = []
    closing, at = "", 0  # closing: the mark that ends an open block
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if closing:
            begin = 0
        elif line.strip():
            if not _COMMENT.match(line):
                break
            opened = _BLOCK.match(line)
            closing, begin = (_CLOSES[opened.group(1)], opened.end()) if opened else ("", 0)
        else:
            begin = 0
        out.append(_MARKS.sub("", line, count=1).rstrip(" \r*/->"))
        if closing:
            stop = line.find(closing, begin)
            if stop >= 0:
                rest = line[stop + len(closing) :].strip()
                closing = ""
                if rest and not _COMMENT.match(rest):
                    break
        at = end + 1
    return out


def header_signs(header: list[str]) -> list[str]:
    """The forms of a header's lines: words in order, those like names, numbers or paths left open."""
    out = {}
    for line in header:
        words = ["*" if _NAME_LIKE.search(w) else w for w in _HEADER_WORD.findall(line.lower())]
        if sum(w != "*" for w in words) >= 2:
            out[" ".join(words)] = None
    return list(out)


def chunk_evidence(text: str) -> tuple[int, int, int, int]:
    """(characters of code, steps of numbered sequences, characters of literals, of dense lines)."""
    total = steps = literal = dense = 0
    last: dict[int, int] = {}
    at = 0
    for line in text.split("\n"):
        if not line.strip() or _COMMENT.match(line) or _IMPORT.match(line):
            continue
        at += 1
        size = len(line)
        total += size
        if any(c.isdigit() for c in line):
            numbers = {int(a or b) for a, b in _NUMBERED.findall(line)}
            if any(at - last.get(k - 1, -99) <= 8 for k in numbers):
                steps += 1
            for k in numbers:
                last[k] = at
        if (_LITERALS.match(line) and _HAS_VALUES.search(line)) or _ENCODED.match(line):
            literal += size
        if size >= 150 and sum(map(str.isspace, line)) < 0.09 * size and len(_PUNCTUATION.findall(line)) > 0.12 * size:
            dense += size
    return total, steps, literal, dense


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["chunk", "updated_at", "file_path", "line_start", "total", "steps", "literal", "dense", "generated", "project", "print", "size", "signs"]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    for batch in batches:
        rows = []
        for text in batch.column("content").to_pylist():
            text = text or ""
            header = header_of(text)
            project = next((next(g for g in m.groups() if g) for m in map(_PROJECT.match, header) if m), None)
            squeezed = " ".join(text.split())
            rows.append(
                (*chunk_evidence(text), any(map(_GENERATED.match, header)), project and project.lower(), xxhash.xxh3_64_intdigest(squeezed) - (1 << 63), len(squeezed), header_signs(header))
            )
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names[:4]], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names
        )


_FEATURES = (
    "chunk long, updated_at timestamp, file_path string, line_start int, total long, steps long, literal long, dense long, "
    "generated boolean, project string, print long, size long, signs array<string>"
)


def _globs(path):
    """Patterns that could stand in an attribute file for the path: directories by name, pairs of
    directories, the directory itself, and name endings."""
    parts = F.split(path, "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    name = F.element_at(parts, -1)
    ending = F.regexp_extract(name, r"([._-][A-Za-z0-9]+\.[A-Za-z0-9]+)$", 1)
    hashed = F.regexp_replace(name, r"[0-9a-f]{8,}", "HASH")
    return F.array_distinct(
        F.concat(
            F.transform(inner, lambda x: F.concat(F.lit("**/"), x, F.lit("/**"))),
            F.transform(F.arrays_zip(F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))).alias("a"), F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0))).alias("b")),
                        lambda x: F.concat(F.lit("**/"), x["a"], F.lit("/"), x["b"], F.lit("/**"))),
            F.array(F.concat(F.array_join(inner, "/"), F.lit("/*"))),
            F.when(ending != "", F.array(F.concat(F.lit("*"), ending))).otherwise(F.array().cast("array<string>")),
            F.when(hashed.contains("HASH"), F.array(F.concat(F.array_join(inner, "/"), F.lit("/*HASH*")))).otherwise(F.array().cast("array<string>")),
        )
    )


#: What tells forms of header lines from globs among patterns.
_HEADER = "header: "


def _patterns(files: DataFrame):
    globs = _globs(F.col("file_path"))
    return F.concat(globs, F.transform("signs", lambda x: F.concat(F.lit(_HEADER), x))) if "signs" in files.columns else globs


def mined_patterns(files: DataFrame) -> DataFrame:
    """glob, kind, files, shown, repos of the patterns equivalent to a declaration.

    files: file_path, repo, made (generated, minified or data by its content or declaration),
    taken (vendored), signs (forms of its header's lines; may be left out). Patterns are globs of
    paths, and forms of header lines. A pattern is kept for a kind if the Wilson lower bound of the
    share of its files that show the kind reaches MINED_BOUND (HEADER_BOUND for headers) in at
    least MINED_REPOS repositories.
    """
    at = files.select("repo", "made", "taken", F.explode(_patterns(files)).alias("glob"))
    by_repo = at.groupBy("glob", "repo").agg(F.count("*").alias("n"), F.count_if("made").alias("k_generated"), F.count_if("taken").alias("k_vendored"))
    counts = by_repo.groupBy("glob").agg(*[F.sum(c).alias(c) for c in ("n", "k_generated", "k_vendored")], F.count("repo").alias("repos"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").cast("double").alias("k")) for k in ("generated", "vendored")])
    each = counts.where(F.col("repos") >= MINED_REPOS).select("glob", "n", "repos", F.inline(kinds))
    z = 1.96
    p = F.col("k") / F.col("n")
    bound = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    least = F.when(F.col("glob").startswith(_HEADER), HEADER_BOUND).otherwise(MINED_BOUND)
    return each.where(bound >= least).select("glob", "kind", F.col("n").alias("files"), F.col("k").cast("long").alias("shown"), "repos")


def file_origins(chunks: DataFrame, shared_size: int = SHARED_SIZE, copied_size: int = COPIED_SIZE) -> DataFrame:
    """file_path, origin, reason for every source file; origin is null for hand-written ones.

    chunks: id, updated_at, file_path, line_start, content, content_type. Origins: ``generated``,
    ``minified``, ``data``, ``vendored``. What attribute files declare holds, also that a file is
    hand-written. Declarations, usual paths of that kind and evidence from content - a header that
    says so, numbered sequences of names, dense lines, literals, a header that names another
    project, the same text in several repositories - label files, and patterns are mined from them:
    globs, and forms of header lines. A file that meets a pattern is decided by it; only where no
    pattern speaks does its own evidence decide, and at last whether it is an exact copy of what is
    vendored. shared_size, copied_size: characters from which equal files, and equal chunks, count
    as evidence. Null contents are empty ones; chunks with null paths belong to no file; of ids
    that come again the newest row holds.
    """
    code = chunks.where("content_type = 'code' and id is not null and file_path is not null")
    narrow = code.select(
        F.col("id").alias("chunk"), F.col("updated_at").cast("timestamp").alias("updated_at"), "file_path",
        F.col("line_start").cast("int").alias("line_start"), "content",
    )
    versions = chunks.select(F.col("id").alias("chunk"), F.col("updated_at").cast("timestamp").alias("updated_at"))
    parts = cut(keep_latest(narrow.mapInArrow(_features, _FEATURES), versions, "chunk"))
    first = lambda c: F.min_by(c, F.struct(F.coalesce("line_start", F.lit(1 << 30)), "chunk"))
    repo = F.split("file_path", "/")[0]
    files = parts.groupBy("file_path").agg(
        *[F.sum(c).alias(c) for c in ("total", "steps", "literal", "dense", "size")], F.bit_xor("print").alias("mark"), first("generated").alias("says_generated"), first("project").alias("project"), first("signs").alias("signs"),
    )
    files = files.withColumn("repo", F.lower(repo)).withColumn(
        "shown",
        F.when((F.col("total") > 0) & (F.col("dense") >= DENSE_SHARE * F.col("total")), "minified")
        .when((F.col("total") > 0) & (F.col("literal") >= DATA_SHARE * F.col("total")), "data")
        .when(F.col("says_generated") | (F.col("steps") >= LEAST_STEPS), "generated"),
    )
    foreign = F.col("project").isNotNull() & (F.col("project") != F.col("repo"))
    own = F.col("project").isNotNull() & (F.col("project") == F.col("repo"))
    files = files.select("file_path", "repo", "shown", foreign.alias("foreign"), own.alias("own"), "mark", "size", "signs")

    stated = declared_kinds(files.select("file_path"), attribute_rules(chunks))
    stated = stated.groupBy("file_path").pivot("kind", ["generated", "vendored"]).agg(F.first("state"))
    stated = stated.withColumnsRenamed({"generated": "said_generated", "vendored": "said_vendored", "file_path": "p"})
    files = cut(files.join(stated, F.col("file_path") == F.col("p"), "left").drop("p"))

    # the same text in several repositories was taken from somewhere: evidence for patterns, not a verdict
    again = files.where(F.col("size") >= shared_size).groupBy("mark", "size", "repo").agg(F.lit(1).alias("one")).groupBy(F.col("mark").alias("m"), F.col("size").alias("z")).agg(F.sum("one").alias("n")).where("n > 1")
    met = files.join(again, (F.col("mark") == F.col("m")) & (F.col("size") == F.col("z")), "left")
    below = F.expr("substring(file_path, locate('/', file_path) + 1)")
    default = {k: "|".join(glob_regex(g) for g, kind, on in parse_attributes(DEFAULT_RULES) if kind == k and on) for k in ("generated", "vendored")}
    usual = {k: below.rlike(default[k]) for k in default}
    seen = met.select(
        "file_path", "repo", "signs", F.coalesce("said_generated", F.col("shown").isNotNull() | usual["generated"]).alias("made"),
        F.coalesce("said_vendored", F.col("foreign") | (~F.col("own") & (F.col("m").isNotNull() | usual["vendored"]))).alias("taken"),
    )
    mined = mined_patterns(seen)
    header = F.col("glob").startswith(_HEADER)
    met_by = [
        F.bool_or((F.col("kind") == k) & (header if by == "header" else ~header)).alias(f"{by}_{k}") for k in ("generated", "vendored") for by in ("path", "header")
    ]
    hits = files.select("file_path", F.explode(_patterns(files)).alias("glob")).join(mined.select("glob", "kind"), "glob").groupBy(F.col("file_path").alias("p")).agg(*met_by)
    known = files.join(hits, F.col("file_path") == F.col("p"), "left").drop("p", "signs")
    by = {c: F.coalesce(c, F.lit(False)) for c in ("path_generated", "header_generated", "path_vendored", "header_vendored")}
    generated_path = by["path_generated"] | usual["generated"]
    vendored_path = by["path_vendored"] | usual["vendored"]
    known = cut(
        known.select(
            "file_path",
            F.when(F.col("said_vendored"), "declared").when(F.col("said_vendored") == False, None)  # noqa: E712
            .when(~F.col("own") & vendored_path, "path pattern").when(~F.col("own") & by["header_vendored"], "header pattern").when(F.col("foreign"), "header of another project").alias("vendored"),
            F.when(F.col("said_generated"), "declared").when(F.col("said_generated") == False, None)  # noqa: E712
            .when(generated_path, "path pattern").when(by["header_generated"], "header pattern").when(F.col("shown").isNotNull(), "content").alias("made"),
            F.when(F.col("said_generated") == False, None).otherwise(F.col("shown")).alias("shown"),  # noqa: E712
            (F.col("own") | F.coalesce(~F.col("said_vendored"), F.lit(False))).alias("kept"),
        )
    )

    prints = parts.where(F.col("size") >= copied_size).select("file_path", "print", "size")
    taken = known.where("vendored is not null").select(F.col("file_path").alias("v"))
    there = prints.join(taken, F.col("file_path") == F.col("v"), "left_semi").select(F.col("print").alias("q")).distinct()
    suspects = prints.join(there, F.col("print") == F.col("q"), "left")
    copies = (
        suspects.groupBy(F.col("file_path").alias("c"))
        .agg((F.sum(F.when(F.col("q").isNotNull(), F.col("size")).otherwise(0)) >= COPY_SHARE * F.sum("size")).alias("copy"))
        .where("copy")
    )
    final = known.join(copies, F.col("file_path") == F.col("c"), "left")
    is_copy = F.coalesce("copy", F.lit(False)) & ~F.col("kept")
    origin = (
        F.when(F.col("vendored").isNotNull() | is_copy, "vendored")
        .when(F.col("made").isNotNull(), F.coalesce("shown", F.lit("generated")))
    )
    reason = F.coalesce("vendored", F.when(is_copy, "copy of a vendored file"), "made")
    return final.select("file_path", origin.alias("origin"), F.when(origin.isNotNull(), reason).alias("reason"))
