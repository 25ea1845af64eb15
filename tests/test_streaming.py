from datetime import datetime, timedelta

import pytest

from codeloom.streaming import refresh as R

T0 = datetime(2025, 1, 1)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_windows_drop_late_events_and_keep_open_ones(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "ts timestamp, event_type string, value double"
    write(spark, [(T0 + timedelta(minutes=m), "a", 1.0) for m in (1, 5, 11, 35)], schema, path)
    stream = R.file_stream(spark, path, spark.read.parquet(path).schema)
    rows = R.drain(R.event_windows(stream, "10 minutes", late="0 seconds"), "w").collect()
    assert sorted((r["start"].minute, r["n"]) for r in rows) == [(0, 2), (10, 1)]


def test_upserts_replace_changed_files_by_generation(spark, tmp_path):
    path, table, log = (str(tmp_path / x) for x in ("in", "table", "log"))
    schema = "file_path string, v int, deleted boolean"
    write(spark, [("a", 1, False), ("b", 1, False), ("b", 2, False)], schema, path)
    stream = R.file_stream(spark, path, spark.read.parquet(path).schema)
    R.incremental_upsert(stream, table, log).awaitTermination()
    assert sorted((r["file_path"], r["v"]) for r in R.read_current(spark, table).collect()) == [("a", 1), ("b", 1), ("b", 2)]
    write(spark, [("b", 9, False), ("a", None, True)], schema, path)
    R.incremental_upsert(stream, table, log).awaitTermination()
    assert [(r["file_path"], r["v"]) for r in R.read_current(spark, table).collect()] == [("b", 9)]
    write(spark, [("b", None, True)], schema, path)
    R.incremental_upsert(stream, table, log).awaitTermination()
    assert R.read_current(spark, table, "file_path string, v int").count() == 0 and R.manifests(spark, table) == [0, 1, 2]
    assert R.current_generation(spark, str(tmp_path / "none")) is None


def test_the_newest_change_of_a_batch_holds(spark, tmp_path):
    path, table, log = (str(tmp_path / x) for x in ("in", "table", "log"))
    rows = [("a", 1, 1, False), ("a", None, 2, True), ("b", None, 1, True), ("b", 2, 2, False), ("b", 3, 2, False), ("c", 1, 1, False), ("c", 5, 3, False), ("c", 4, 2, False), (None, 1, 1, False)]
    write(spark, rows, "file_path string, v int, changed_at int, deleted boolean", path)
    stream = R.file_stream(spark, path, spark.read.parquet(path).schema)
    R.incremental_upsert(stream, table, log).awaitTermination()
    assert sorted((r["file_path"], r["v"]) for r in R.read_current(spark, table).collect()) == [("b", 2), ("b", 3), ("c", 5)]


def test_only_touched_buckets_are_written_and_errors_are_not_swallowed(spark, tmp_path):
    path, table, log = (str(tmp_path / x) for x in ("in", "table", "log"))
    schema = "file_path string, v int, deleted boolean"
    write(spark, [(f"f{k}", k, False) for k in range(200)], schema, path)
    stream = R.file_stream(spark, path, spark.read.parquet(path).schema)
    R.incremental_upsert(stream, table, log).awaitTermination()
    write(spark, [("f7", 70, False)], schema, path)
    R.incremental_upsert(stream, table, log).awaitTermination()
    state = R.current_state(spark, table)
    assert sum(g == 1 for g in state.values()) == 1 and R.read_current(spark, table).count() == 200
    (tmp_path / "table" / "manifests" / "9").write_text("{broken")
    (tmp_path / "table" / "manifests" / ".9.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        R.current_state(spark, table)


def test_session_weights_decay_in_state(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "file_path string, event_type string, event_time timestamp, weight_score double"
    write(spark, [("f", "WRITE", T0, 1.0), ("f", "READ", T0 + timedelta(hours=1), 0.2), ("g", "READ", T0, None), (None, "READ", T0, 1.0)], schema, path)
    stream = R.file_stream(spark, path, spark.read.parquet(path).schema)
    got = {r["file_path"]: round(r["weight"], 4) for r in R.drain(R.session_weight_stream(stream), "s", "update").collect()}
    assert got == {"f": round(2.718281828459045**-0.1, 4), "g": 0.7}
