"""Where results go: tables by generation, an append-only audit log, JSON and metric text."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "timestamp timestamp, query_type string, query_summary string, result_count int, duration_ms int, redacted_count int"


def write_relation(df: DataFrame, path: str, buckets: Sequence[str] = (), files: int | None = None) -> None:
    """Overwrites a relation as Parquet; ranges of ``buckets`` keep neighbours in a file, so that
    readers prune by statistics."""
    out = df
    if buckets:
        out = (df.repartitionByRange(files, *buckets) if files else df.repartitionByRange(*buckets)).sortWithinPartitions(*buckets)
    out.write.mode("overwrite").parquet(path)


def append_audit(spark: SparkSession, path: str, entries: Sequence[tuple]) -> None:
    """Appends audit entries; earlier ones are never touched."""
    spark.createDataFrame(list(entries), AUDIT).write.mode("append").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, without null fields."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def relative_paths(df: DataFrame, root: str, column: str = "file_path") -> DataFrame:
    """The column relative to ``root`` where it lies below it."""
    lead = root.rstrip("/") + "/"
    return df.withColumn(column, F.when(F.col(column).startswith(lead), F.expr(f"substring({column}, {len(lead) + 1})")).otherwise(F.col(column)))


def compact(payload: Any) -> Any:
    """A payload without empty values, as it is sent."""
    if isinstance(payload, dict):
        return {k: compact(v) for k, v in payload.items() if v not in (None, "", [], {})}
    return [compact(v) for v in payload] if isinstance(payload, list) else payload


def prometheus(metrics: dict[str, float], prefix: str = "codeloom") -> str:
    """Metrics as text of the common exposition format."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v}\n" for k, v in sorted(metrics.items()))


def human(metrics: dict[str, float]) -> str:
    width = max(map(len, metrics), default=0)
    return "\n".join(f"{k.ljust(width)}  {v:,}" for k, v in sorted(metrics.items()))
