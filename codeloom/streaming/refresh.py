"""Streams around the index: refresh of changed files, session weights with expiry, event windows."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from codeloom.operators.common import shared_folder
from codeloom.operators.ops import DECAY, DEFAULT_WEIGHTS


#: Buckets of files by path: a batch rewrites those that it touches.
BUCKETS = 64


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream below the one that all executors see."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema: Any, files_per_batch: int = 64) -> DataFrame:
    """Parquet files as they appear below ``path``: the change feed in place of polling a tree."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def newest_changes(batch: DataFrame, order: str = "changed_at") -> DataFrame:
    """Of several changes of a file within a batch the rows of the newest; without the column all of a
    file's rows are one change. A deletion and contents of one time are contents."""
    if order not in batch.columns:
        return batch
    last = batch.groupBy(F.col("file_path").alias("_f")).agg(F.max(order).alias("_t"))
    return batch.join(last, F.col("file_path").eqNullSafe(F.col("_f")) & F.col(order).eqNullSafe(F.col("_t"))).drop("_f", "_t")


def incremental_upsert(
    changes: DataFrame, table_path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, interval: str | None = None, order: str = "changed_at", buckets: int = BUCKETS,
) -> StreamingQuery:
    """Replaces rows of changed files in a table of generations, batch by batch.

    changes: file_path, deleted, ``order`` (when the change was made; may be left out) and the columns
    of the relation. Rows lie in buckets of their path. A batch writes the buckets that it touches
    anew and then a manifest that names the generation of every bucket: a file of its own under
    the batch's number that is renamed into place, so readers see one state or the next. A batch
    that runs again finds its manifest and does nothing. ``interval`` debounces; without one the
    stream takes what is there and ends. Rows without a path are left out."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch in manifests(spark, table_path):
            return
        columns = [c for c in batch.columns if c not in ("deleted", order)]
        bucket = F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")
        change = newest_changes(batch.where("file_path is not null"), order).withColumn("bucket", bucket).persist()
        try:
            touched = sorted(r["bucket"] for r in change.select("bucket").distinct().collect())  # at most the buckets
            state = current_state(spark, table_path)
            new = change.where("not coalesce(deleted, false)").select(*columns, "bucket")
            old = _rows_of(spark, table_path, {b: g for b, g in state.items() if b in set(touched)})
            if old is not None:
                kept = old.withColumn("bucket", bucket).join(change.select("file_path").distinct(), "file_path", "left_anti")
                new = kept.select(*columns, "bucket").unionByName(new)
            if touched:
                new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/generation={epoch}")
            written = {r["bucket"] for r in new.select("bucket").distinct().collect()} if touched else set()
            after = {b: g for b, g in state.items() if b not in set(touched)} | {b: epoch for b in written}
            _write_manifest(spark, table_path, epoch, after)
        finally:
            change.unpersist()
        if on_batch:
            on_batch(batch, epoch)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _folder(spark: SparkSession, path: str) -> tuple[Any, Any]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def manifests(spark: SparkSession, table_path: str) -> list[int]:
    """The numbers of the states that the table has had; none if there is no table."""
    system, root = _folder(spark, f"{table_path}/manifests")
    if not system.exists(root):
        return []
    return sorted(int(f.getPath().getName()) for f in system.listStatus(root) if f.getPath().getName().isdigit())


def _write_manifest(spark: SparkSession, table_path: str, epoch: int, state: dict[int, int]) -> None:
    system, root = _folder(spark, f"{table_path}/manifests")
    system.mkdirs(root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft = path(root, f".{epoch}-{uuid.uuid4().hex}")
    out = system.create(draft, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    if not system.rename(draft, path(root, str(epoch))):
        raise OSError(f"the manifest {epoch} of {table_path} could not be put in place")


def current_state(spark: SparkSession, table_path: str) -> dict[int, int]:
    """bucket to generation of the newest manifest; errors other than a missing table are raised."""
    known = manifests(spark, table_path)
    if not known:
        return {}
    system, file = _folder(spark, f"{table_path}/manifests/{known[-1]}")
    stream = system.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(b): g for b, g in json.loads(text).items()}


def current_generation(spark: SparkSession, table_path: str) -> int | None:
    known = manifests(spark, table_path)
    return known[-1] if known else None


def _rows_of(spark: SparkSession, table_path: str, state: dict[int, int]) -> DataFrame | None:
    paths = [f"{table_path}/generation={g}/bucket={b}" for b, g in sorted(state.items())]
    return spark.read.parquet(*paths) if paths else None


def read_current(spark: SparkSession, table_path: str, schema: Any = None) -> DataFrame:
    """The rows of the newest state; an empty table needs its schema."""
    rows = _rows_of(spark, table_path, current_state(spark, table_path))
    if rows is not None:
        return rows
    if schema is None:
        raise FileNotFoundError(f"{table_path} has no rows")
    return spark.createDataFrame([], schema)


def session_weight_stream(sessions: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """file_path, weight, event_time: the running decayed weight of every file, expiring by watermark.

    The state of a file is its best weight and when it was measured; an event replaces it if it
    weighs more than what is left of it. Events later than the watermark are dropped; a file
    without events for the time to live loses its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    minutes = float(pd.Timedelta(ttl).total_seconds() / 60)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        weight, at = state.get if state.exists else (0.0, 0)
        for pdf in batches:
            for w, t in sorted(zip(pdf["w"], pdf["us"], strict=True), key=lambda x: x[1]):
                left = weight * math.exp(-DECAY * max(0, t - at) / 3.6e9) if at else 0.0
                weight, at = max(w, left), max(t, at)
        state.update((weight, at))
        state.setTimeoutTimestamp(max(int(at / 1000 + minutes * 60_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"file_path": [key[0]], "weight": [weight], "us": [at]})

    base = F.coalesce("weight_score", *[F.when(F.col("event_type") == k, F.lit(v)) for k, v in DEFAULT_WEIGHTS.items()], F.lit(0.0))
    rows = (
        sessions.where("file_path is not null and event_time is not null").withColumn("event_time", F.col("event_time").cast("timestamp"))
        .withWatermark("event_time", ttl).select("file_path", "event_time", base.alias("w"), F.unix_micros("event_time").alias("us"))
    )
    return rows.groupBy("file_path").applyInPandasWithState(fold, "file_path string, weight double, us long", "weight double, us long", "update", GroupStateTimeout.EventTimeTimeout)


def event_windows(events: DataFrame, window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total: tumbling or sliding counts with a watermark; an offer beyond the
    index's own needs."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: sessions by a gap of inactivity."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and reads what it wrote: for queries and tests.

    Append mode writes files to a shared folder; the last windows stay in the state, as they may
    still grow."""
    spark = stream.sparkSession
    out = stream_folder(spark, name)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/data")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/data/batch={epoch}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("batch")
