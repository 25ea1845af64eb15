"""A source tree as a table: discovery, ignore rules, size cap, checksums."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P

#: Directories that are never indexed.
EXCLUDED = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", "target", ".idea", ".vscode", ".gradle",
)
MAX_BYTES = 1_000_000
IGNORE_FILES = (".gitignore",)


@dataclass(frozen=True)
class IgnoreRule:
    folder: str
    line: int
    pattern: re.Pattern
    negated: bool
    folders_only: bool


def parse_ignore(folder: str, text: str) -> list[IgnoreRule]:
    """The rules of an ignore file that lies in ``folder`` (relative, without slashes at its ends)."""
    out = []
    for n, line in enumerate(text.splitlines()):
        rule = line.rstrip("\n")
        rule = re.sub(r"(?<!\\)\s+$", "", rule)
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        rule = rule[1:] if negated else rule
        rule = rule[1:] if rule.startswith(("\\#", "\\!")) else rule
        folders_only = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        rule = rule.lstrip("/")
        body, at = "", 0
        while at < len(rule):
            if rule.startswith("**/", at):
                body, at = body + "(?:[^/]+/)*", at + 3
            elif rule.startswith("/**", at) and at + 3 == len(rule):
                body, at = body + "/.+", at + 3
            elif rule[at] == "*":
                body, at = body + "[^/]*", at + 1
                while rule.startswith("*", at):
                    body, at = body[:-5] + ".*", at + 1
            elif rule[at] == "?":
                body, at = body + "[^/]", at + 1
            elif rule[at] == "[" and "]" in rule[at + 1 :]:
                end = rule.index("]", at + 1)
                body, at = body + rule[at : end + 1].replace("[!", "[^"), end + 1
            else:
                body, at = body + re.escape(rule[at]), at + 1
        try:
            pattern = re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z")
        except re.error:
            continue
        out.append(IgnoreRule(folder, n, pattern, negated, folders_only))
    return out


def is_ignored(path: str, rules: list[IgnoreRule]) -> bool:
    """Whether the rules, parents before nested ones, ignore a file. What lies under an ignored
    folder stays ignored, even if a deeper rule takes it in again."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        part, is_folder = "/".join(parts[:k]), k < len(parts)
        state = False
        for r in rules:
            if r.folder and not part.startswith(r.folder + "/"):
                continue
            if r.folders_only and not is_folder:
                continue
            if r.pattern.match(part[len(r.folder) + 1 :] if r.folder else part):
                state = not r.negated
        if state:
            return True
    return False


def ignore_files(spark: SparkSession, root: str) -> DataFrame:
    """folder, text of the ignore files below ``root``, at any depth.

    Spark's readers pass over hidden files, so these are listed by name; their texts are read on the
    executors."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(top).toUri().getPath().rstrip("/")
    found, walk = [], fs.listFiles(top, True)
    while walk.hasNext():
        path = walk.next().getPath()
        if path.getName() in IGNORE_FILES:
            found.append((path.toUri().getPath()[len(prefix) :].strip("/").rpartition("/")[0], re.sub(r"^file:/+", "file:///", path.toString())))
    listed = spark.createDataFrame(found, "folder string, uri string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs

        for batch in batches:
            texts = []
            for uri in batch["uri"]:
                system, path = arrow_fs.FileSystem.from_uri(uri)
                with system.open_input_stream(path) as file:
                    texts.append(file.read().decode("utf-8", "replace"))
            yield pd.DataFrame({"folder": batch["folder"], "text": texts})

    return listed.mapInPandas(read, "folder string, text string")


def ignored_paths(paths: DataFrame, ignores: DataFrame) -> DataFrame:
    """file_path of the paths that the ignore files (folder, text) leave out.

    A path only meets the files of the folders above it, by a join on the folder."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    met = paths.select("file_path", F.posexplode(above).alias("depth", "at")).join(ignores, F.col("at") == F.col("folder"))
    by = met.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("depth", "folder", "text"))).alias("files"))

    @F.pandas_udf("boolean")
    def ignored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, files in batches:
            yield pd.Series([is_ignored(n, [r for f in fs for r in _rules(f["folder"], f["text"])]) for n, fs in zip(names, files, strict=True)])

    return by.where(ignored("file_path", "files")).select("file_path")


@lru_cache(maxsize=10_000)
def _rules(folder: str, text: str) -> tuple[IgnoreRule, ...]:
    return tuple(parse_ignore(folder, text))


def discover(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, extra_extensions: tuple[str, ...] = ()) -> DataFrame:
    """file_path, content, size, modified, checksum, language, content_type of the files to index.

    Paths are relative to ``root``. Excluded folders, ignored files, files above the size cap and
    unknown types are left out; contents that are not UTF-8 are decoded with replacements. Listing
    and reading are Spark's; a path meets the ignore rules of the folders above it in a join."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(re.sub(r"^file:/+", "/", base)) + "/", "")
    files = raw.withColumn("file_path", path)
    hidden = F.arrays_overlap(P.parts(F.col("file_path")), F.array(*[F.lit(x) for x in EXCLUDED]))
    files = files.where(~hidden & (F.col("length") <= max_bytes))
    known = P.language(F.col("file_path")).isNotNull() | (P.content_axis(F.col("file_path")) != "code")
    if extra_extensions:
        known = known | P.suffix(F.col("file_path")).isin(*extra_extensions)
    kept = files.where(known)
    out = ignored_paths(kept.select("file_path"), ignore_files(spark, base))
    kept = kept.join(out, "file_path", "left_anti")
    return kept.select(
        "file_path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("checksum"),
        P.language(F.col("file_path")).alias("language"), P.content_axis(F.col("file_path")).alias("content_type"),
    )
