"""Repository attribute files: rules, globs and their precedence by directory, as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_NAMES = (".gitattributes",)
#: Attribute names and the kind of file that they declare.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored"}

#: Rules that hold in every repository unless it says otherwise.
DEFAULT_RULES = """
vendor/** linguist-vendored
**/vendor/** linguist-vendored
**/_vendor/** linguist-vendored
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/third_party/** linguist-vendored
**/thirdparty/** linguist-vendored
*.min.js linguist-generated
*.min.css linguist-generated
*.bundle.js linguist-generated
*_pb2.py linguist-generated
*.pb.go linguist-generated
*_generated.* linguist-generated
"""


def glob_regex(glob: str) -> str:
    """A regular expression for paths below the rule's directory that the glob matches.

    As in attribute files: a glob without a slash matches a name at any depth, one with a slash is
    anchored; ** crosses directories, * and ? do not; a directory alone matches nothing below it.
    """
    anchored = "/" in glob.strip("/") or glob.startswith("/")
    body, at = "", 0
    glob = glob.lstrip("/")
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            body, at = body + "(?:[^/]+/)*", at + 3
        elif glob.startswith("**", at):
            body, at = body + ".*", at + 2
        elif c == "*":
            body, at = body + "[^/]*", at + 1
        elif c == "?":
            body, at = body + "[^/]", at + 1
        elif c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inner = glob[at + 1 : end]
            body += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            at = end + 1
        elif c == "\\" and at + 1 < len(glob):
            body, at = body + re.escape(glob[at + 1]), at + 2
        else:
            body, at = body + re.escape(c), at + 1
    return ("^" if anchored else "^(?:.*/)?") + body + "$"


def parse_attributes(text: str) -> list[tuple[str, str, bool | None]]:
    """(glob, kind, value) in order; value None takes a declaration back to unspecified."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith('"'):
            glob, _, rest = line[1:].partition('"')
        else:
            glob, _, rest = line.partition(" ") if " " in line else line.partition("\t")
        for word in rest.split():
            name, _, value = word.lstrip("-!").partition("=")
            kind = ATTRIBUTES.get(name)
            if kind:
                state = None if word[0] == "!" else not (word[0] == "-" or value.lower() in ("false", "0", "no", "off"))
                out.append((glob, kind, state))
    return out


_RULES = "dir string, pattern string, kind string, state boolean, unset boolean, line_no int"


def attribute_rules(files: DataFrame) -> DataFrame:
    """dir, pattern, kind, state, unset, line_no of every rule in attribute files.

    files: file_path, line_start, content, where a long file may be several rows; its rules are
    numbered by line. Other files give no rows.
    """
    names = "|".join(re.escape(n) for n in FILE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                where = row["file_path"].rpartition("/")[0]
                for n, line in enumerate((row["content"] or "").splitlines()):
                    for glob, kind, state in parse_attributes(line):
                        rows.append((where, glob_regex(glob), kind, bool(state), state is None, (row["line_start"] or 1) + n))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["dir", "pattern", "kind", "state", "unset", "line_no"]
            )

    own = files.where(F.col("file_path").rlike(f"(^|/)(?:{names})$")).select("file_path", "line_start", "content")
    return own.mapInArrow(run, _RULES)


def declared_kinds(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """file_path, kind, state: what the rules declare of each path, null states left out.

    A rule reaches paths below its directory. For each kind the rule of the deepest directory
    holds, in it the last line; a rule that unsets leaves the kind undeclared. Joined by
    directory, so a path meets only the rules of its own ancestors.
    """
    parts = F.split("file_path", "/")
    ups = paths.select(
        "file_path",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "dir"),
    )
    below = F.when(F.col("dir") == "", F.col("file_path")).otherwise(F.expr("substring(file_path, length(dir) + 2)"))
    met = ups.join(rules, "dir").where(F.rlike(below, F.col("pattern")))
    last = met.groupBy("file_path", "kind").agg(F.max_by(F.struct("state", "unset"), F.struct("depth", "line_no")).alias("r"))
    return last.where("not r.unset").select("file_path", "kind", F.col("r.state").alias("state"))
