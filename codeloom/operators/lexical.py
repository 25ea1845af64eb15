"""Full text: corpus statistics, exhaustive scans, enumeration; ranked search is in ``postings``."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.common import keep_latest

IDF_FLOOR = 0.8


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """section (token, prefix), key, language, doc_count: chunks that hold a sub-word, or one that
    begins with three letters."""
    clean = F.filter(F.transform(F.coalesce("subwords", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    base = chunks.select(F.coalesce("language", F.lit("unknown")).alias("language"), F.array_distinct(clean).alias("terms"))
    prefixes = F.array_distinct(F.transform(F.filter("terms", lambda t: F.char_length(t) >= 3), lambda t: F.substring(t, 1, 3)))
    both = base.select("language", F.lit("token").alias("section"), F.explode("terms").alias("key")).unionByName(
        base.select("language", F.lit("prefix").alias("section"), F.explode(prefixes).alias("key"))
    )
    return both.groupBy("section", "key", "language").agg(F.count("*").alias("doc_count"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best, ties by id."""
    return scored.orderBy(F.round("score", 9).desc(), "id").limit(k)


def informative_terms(stats: DataFrame, total: int, query: str) -> list[str]:
    """Sub-words of a query that tell chunks apart: not general, known, and rare enough."""
    words = [w for w in X.decompose(query) if len(w) >= 3 and w not in X.STOP_WORDS]
    if not words or not total:
        return []
    rows = stats.where(F.col("key").isin(*words, *[w[:3] for w in words])).groupBy("section", "key").agg(F.sum("doc_count").alias("d")).collect()
    seen = {(r["section"], r["key"]): r["d"] for r in rows}
    out = []
    for w in words:
        docs = seen.get(("token", w)) or seen.get(("prefix", w[:3]), 0)
        if docs > 0 and (math.log(total / docs) >= IDF_FLOOR or docs <= 2):
            out.append(w)
    return out


def lines(rows: DataFrame) -> DataFrame:
    """id, updated_at, line_no, line of every line of every row."""
    split = rows.where("content is not null").select("id", "updated_at", "line_start", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return split.select("id", "updated_at", (F.coalesce("line_start", F.lit(1)) + F.col("at")).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def _held(found: DataFrame, versions: DataFrame) -> DataFrame:
    """What was found in holding rows; texts have been searched where they lie, and only findings
    meet the versions."""
    return keep_latest(found, versions, "id")


def scan_literal(rows: DataFrame, needle: str, versions: DataFrame, ignore_case: bool = False) -> DataFrame:
    """id, line_no, n: lines that hold the needle and how often.

    rows: id, updated_at, line_start, content; versions: id, updated_at of all rows of the table. Texts
    without the needle are dropped at the scan, before they are split."""
    probe = needle.lower() if ignore_case else needle
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    kept = rows.where(fold(F.col("content")).contains(probe)) if needle else rows.where("false")
    found = lines(kept).withColumn("n", X.occurrences(fold(F.col("line")), probe))
    return _held(found.where("n > 0").select("id", "updated_at", "line_no", "n"), versions)


def scan_tokens(rows: DataFrame, needles: Sequence[str], every: bool, versions: DataFrame) -> DataFrame:
    """id, line_no of lines that hold every, or any, of the needles; rows and versions as above."""
    holds = [F.col("line").contains(n) for n in needles]
    test = F.lit(every)
    near = F.lit(every)
    for n, h in zip(needles, holds, strict=True):
        test = (test & h) if every else (test | h)
        inside = F.col("content").contains(n)
        near = (near & inside) if every else (near | inside)
    return _held(lines(rows.where(near)).where(test).select("id", "updated_at", "line_no"), versions)


def scan_regex(rows: DataFrame, pattern: str, versions: DataFrame) -> DataFrame:
    """id, line_no, n: lines with a match and how many. The pattern is checked by the caller.

    A text is split only if the pattern finds something in it, with ^ and $ at every line; a pattern
    that looks at a text's own ends or switches modes is looked for in every line."""
    whole = rows if re.search(r"\\[AzZG]|\(\?[a-zA-Z-]*[sm-]", pattern) else rows.where(F.col("content").rlike(f"(?m)(?:{pattern})"))
    return _held(lines(whole).where(F.col("line").rlike(pattern)).select("id", "updated_at", "line_no", F.regexp_count("line", F.lit(pattern)).alias("n")), versions)


def enumerate_kinds(rows: DataFrame, node_types: Sequence[str], versions: DataFrame) -> DataFrame:
    """Definition chunks of the node types, all of them, with the exact count as their number of rows."""
    return _held(rows.where(F.col("is_definition") & F.col("chunk_node_type").isin(*node_types)).select("id", "updated_at", "fqn", "file_path", "line_start"), versions)


def enumerate_named(rows: DataFrame, target: str, versions: DataFrame) -> DataFrame:
    """Chunks whose name ends with the target, in any letter case."""
    return _held(rows.where(F.lower("fqn").endswith(target.lower())).select("id", "updated_at", "fqn", "file_path", "line_start"), versions)
