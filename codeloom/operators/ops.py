"""Operations around the index: sessions, audit, freshness, metrics, coverage, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decay per hour, and weights of events that state none.
DECAY = 0.1
DEFAULT_WEIGHTS = {"WRITE": 1.0, "READ": 0.7}
SEVERITY = ("ok", "modified", "new", "deleted", "parse_failed", "missing")


def session_weights(sessions: DataFrame, now: Column) -> DataFrame:
    """file_path, weight: the greatest decayed weight of a file's live events at ``now``.

    Rows written twice count once; events after ``now`` and expired ones do not count; a null
    weight is the default of its type; rows without a path are left out."""
    base = F.coalesce("weight_score", *[F.when(F.col("event_type") == k, F.lit(v)) for k, v in DEFAULT_WEIGHTS.items()], F.lit(0.0))
    hours = (F.unix_micros(now) - F.unix_micros(F.col("event_time").cast("timestamp"))) / 3_600_000_000
    live = sessions.where("file_path is not null and event_time is not null").where((F.col("event_time").cast("timestamp") <= now) & (F.col("ttl_expires_at").isNull() | (F.col("ttl_expires_at").cast("timestamp") > now)))
    return live.groupBy("file_path").agg(F.max(base * F.exp(-DECAY * hours)).alias("weight"))


def suffix_weights(paths: DataFrame, weights: DataFrame) -> DataFrame:
    """file_path, weight of paths that end with a weighted path: by all tails of the path, so that a
    suffix match is an equi-join."""
    parts = F.split("file_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    met = paths.select("file_path", F.explode(tails).alias("tail")).join(weights.select(F.col("file_path").alias("tail"), "weight"), "tail")
    return met.groupBy("file_path").agg(F.max("weight").alias("weight"))


def audit_page(entries: DataFrame, query_type: str | None, limit: int, offset: int = 0) -> DataFrame:
    """One page of the audit log, newest first (a page is the feature)."""
    rows = entries if query_type is None else entries.where(F.col("query_type") == query_type)
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).offset(offset).limit(limit)


def latency_percentiles(rows: DataFrame, group: Sequence[str], value: str, order: str, percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Percentiles by position int(n * p / 100) of the sorted values, exact.

    Positions come from a histogram of distinct values with running counts, so a group that holds
    most rows is aggregated before it is ordered."""
    hist = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy(*group)))
    at = lambda p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1)
    return run.groupBy(*group).agg(F.max("total").alias("n"), *[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{p}") for p in percents])


def last_n(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The newest n rows of each group: a sliding window of latencies."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def freshness(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """file_path, status of what is not the same in both: modified, deleted or new.

    Both: file_path, checksum. Null checksums are compared as values."""
    a = indexed.select("file_path", F.col("checksum").alias("old"), F.lit(1).alias("in_old"))
    b = current.select(F.col("file_path").alias("p"), F.col("checksum").alias("new"), F.lit(1).alias("in_new"))
    both = a.join(b, F.col("file_path") == F.col("p"), "full")
    status = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "new").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select(F.coalesce("file_path", "p").alias("file_path"), status.alias("status")).where("status is not null")


def refreshed(rows: DataFrame, changed_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The relation after an incremental run: rows of changed and deleted files replaced by new ones."""
    return rows.join(changes.select("file_path"), "file_path", "left_anti").unionByName(changed_rows)


def coverage(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, status, chunks, symbols of every file: parse_failed, missing (nothing was kept) or ok."""
    c = chunks.groupBy(F.col("file_path").alias("cp")).agg(F.count("*").alias("chunks"))
    s = symbols.groupBy(F.col("file_path").alias("sp")).agg(F.count("*").alias("symbols"))
    rows = files.join(c, F.col("file_path") == F.col("cp"), "left").join(s, F.col("file_path") == F.col("sp"), "left")
    status = F.when(F.col("parse_failed"), "parse_failed").when(F.col("chunks").isNull() & F.col("symbols").isNull(), "missing").otherwise("ok")
    return rows.select("file_path", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("symbols", F.lit(0)).alias("symbols"))


def carried_coverage(covered: DataFrame, processed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Coverage after an incremental run: rows of files that it left alone are carried forward, those
    of processed files replaced, and those of deleted ones dropped."""
    gone = processed.select("file_path").unionByName(deleted.select("file_path"))
    return covered.join(gone, "file_path", "left_anti").unionByName(processed)


def scope_coverage(covered: DataFrame) -> DataFrame:
    """scope, files, worst: the most severe status below the first directory."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    return covered.groupBy(F.split("file_path", "/")[0].alias("scope")).agg(F.count("*").alias("files"), F.max_by("status", rank).alias("worst"))


def generation_digest(root: str, counts: dict[str, int], versions: Sequence[str]) -> str:
    """32 hexadecimal digits of a SHA-256 over the root, the tables' counts and the versions."""
    import hashlib

    text = "|".join([root, *(f"{k}={counts[k]}" for k in sorted(counts)), *versions])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _merge(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("line_start", "line_end")
    reach = F.max("line_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("line_start") > reach + 1), 1).otherwise(0))
    islands = fresh.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")).drop("_island")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """file_path, line_start, line_end of ranges that overlap or touch, merged.

    ranges: file_path, line_start, line_end; empty and null ones are left out. Ranges are merged
    by thousands of lines first, so a file with very many of them is not one sorted group: the
    second pass orders merged pieces only."""
    clean = ranges.where("file_path is not null and line_start is not null and line_end >= line_start").select("file_path", "line_start", "line_end")
    binned = clean.withColumn("_bin", F.floor(F.col("line_start") / 1000))
    return _merge(_merge(binned, ["file_path", "_bin"]).drop("_bin"), ["file_path"])


def unusable(ranges: DataFrame, files: DataFrame, share: float = 0.8) -> DataFrame:
    """file_path, covered, unusable: lines in merged error ranges against the file's lines (files:
    file_path, lines)."""
    covered = merged_ranges(ranges).groupBy("file_path").agg(F.sum(F.col("line_end") - F.col("line_start") + 1).alias("covered"))
    rows = files.join(covered, "file_path", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return rows.select("file_path", "covered", (F.col("covered") >= share * F.col("lines")).alias("unusable"))
