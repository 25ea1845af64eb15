"""Queries that run a stream over a table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.common import is_file
from codeloom.streaming import refresh as R
from codeloom.views import Corpus


def _stream(c: Corpus, table: str) -> DataFrame:
    path = f"{c.sf_dir}/{table}.parquet"
    reader = c.spark.readStream.schema(c.table(table).schema)
    if is_file(c.spark, path):  # a file stream watches folders: of this one, only the table's file
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(c.sf_dir)
    return reader.parquet(path)


def _windows(c: Corpus) -> DataFrame:
    counted = R.drain(R.event_windows(_stream(c, "events"), "1 hour", late="0 seconds"), "windows", "append")
    return counted.select("start", "event_type", "n", F.round("total", 2).alias("total"))


def _sessions(c: Corpus) -> DataFrame:
    return R.drain(R.event_sessions(_stream(c, "events"), "30 minutes", late="0 seconds"), "sessions", "append")


def _weights(c: Corpus) -> DataFrame:
    """The newest weight that the stream has given each file."""
    rows = R.drain(R.session_weight_stream(_stream(c, "sessions")), "weights", "update")
    return rows.groupBy("file_path").agg(F.round(F.max_by("weight", F.struct("epoch", "us")), 6).alias("weight"))


def _refresh(c: Corpus) -> DataFrame:
    """The files relation after its rows have come as changes in several batches: every file first with
    another checksum, then as it is, the large ones at last deleted, each with its time."""
    out = R.stream_folder(c.spark, "refresh")
    files = c.table("files").where("file_path is not null")
    rows = files.select("file_path", F.lit("0").alias("checksum"), "size", F.lit(1).alias("changed_at"), F.lit(False).alias("deleted"))
    rows = rows.unionByName(files.select("file_path", "checksum", "size", F.lit(2).alias("changed_at"), F.lit(False).alias("deleted")))
    rows = rows.unionByName(files.where("size > 20000").select("file_path", "checksum", "size", F.lit(3).alias("changed_at"), F.lit(True).alias("deleted")))
    third = F.pmod(F.xxhash64("file_path", "changed_at"), F.lit(3))
    for k in range(3):  # three appends, so that the stream runs over several batches and changes of a file meet in one or more
        part = rows.where("changed_at = 1" if k == 0 else (F.col("changed_at") > 1) & ((third == 0) if k == 1 else (third > 0) | (F.col("changed_at") == 3)))
        part.write.mode("append").parquet(f"{out}/changes")
        stream = R.file_stream(c.spark, f"{out}/changes", rows.schema, files_per_batch=1_000)
        R.incremental_upsert(stream, f"{out}/table", f"{out}/log").awaitTermination()
    return R.read_current(c.spark, f"{out}/table", "file_path string, checksum string, size long").select("file_path", "checksum", "size")


def _query(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(Corpus(spark, sf_dir))

    return query


QUERIES = {
    "st_event_windows": _query(_windows),
    "st_event_sessions": _query(_sessions),
    "st_session_weights": _query(_weights),
    "st_refreshed_files": _query(_refresh),
}

_LAST = "(SELECT max(ts) FROM events)"
ORACLES = {
    # a window is final once the watermark, the greatest time seen, has passed its end
    "st_event_windows": f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_LAST}",
    "st_event_sessions": f"""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_LAST}""",
    "st_session_weights": """
WITH s AS (SELECT file_path, event_time, coalesce(weight_score, CASE event_type WHEN 'WRITE' THEN 1.0 WHEN 'READ' THEN 0.7 ELSE 0.0 END) AS w, max(event_time) OVER (PARTITION BY file_path) AS last
  FROM sessions WHERE file_path IS NOT NULL AND event_time IS NOT NULL)
SELECT file_path, round(max(w * exp(-0.1 * (epoch_us(last) - epoch_us(event_time)) / 3600000000.0)), 6) AS weight FROM s GROUP BY 1""",
    "st_refreshed_files": "SELECT file_path, checksum, size FROM files WHERE file_path IS NOT NULL AND NOT coalesce(size > 20000, false)",
}
