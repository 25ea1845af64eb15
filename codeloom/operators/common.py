"""Building blocks shared by the operators: lineage cuts, late duplicates, heavy join keys."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of all rows is heavy. At most 1 / HEAVY_SHARE keys can be,
#: which bounds what ``lookup_join`` broadcasts.
HEAVY_SHARE = 1 / 200
#: Below this number of rows per key no key is treated as heavy.
HEAVY_ROWS = 20_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
    and the session runs on one machine a temporary folder is used. Lost executors do not lose it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; an error where a cluster names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return tempfile.mkdtemp(prefix="codeloom-checkpoint-")


def laid_down(df: DataFrame) -> DataFrame:
    """As ``cut``, written as columns: many rows of a few numbers take a fraction of a checkpoint's room."""
    path = f"{work_folder(df.sparkSession)}/laid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_WORK: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _WORK:
        _WORK[app] = f"{shared_folder(spark).rstrip('/')}/codeloom-{app}"
    return _WORK[app]


def table_state(spark: SparkSession, path: str) -> str:
    """A digest of the files of a table: their names, sizes and times of change."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if system.exists(root):
        walk = system.listFiles(root, True)
        while walk.hasNext():
            f = walk.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:24]


def path_exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root))


def is_file(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(root) and system.getFileStatus(root).isFile())


def latest_rows(df: DataFrame, key: str, columns: Sequence[str], version: str = "updated_at") -> DataFrame:
    """One row per non-null ``key``: that with the greatest ``version`` (null versions are oldest).

    The aggregation combines before it shuffles, so an id that is written very often does not
    gather its rows in one task. Rows that tie are taken to be identical, and one of them is
    returned whole. An empty table gives an empty table.
    """
    held = F.max_by(F.struct(*columns), F.struct(F.col(version).isNotNull(), F.col(version)))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(held.alias("_held"))
        .select(key, *[F.col("_held")[c].alias(c) for c in columns if c != key])
    )


#: Repeated keys that are broadcast at most; beyond, they are joined by a shuffle.
FEW_KEYS = 2_000_000


def few(keys: DataFrame) -> DataFrame:
    """``keys`` for a broadcast join if a count shows that they are few, else as they are."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def settled_rows(df: DataFrame, key: str, columns: Sequence[str], version: str = "updated_at") -> DataFrame:
    """As ``latest_rows``, for tables in which few keys come again: rows of keys that stand once stay
    where they lie, and only those of repeated keys are shuffled."""
    rows = df.where(F.col(key).isNotNull())
    again = few(rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k"))
    once = rows.join(again, F.col(key) == F.col("_k"), "left_anti")
    held = latest_rows(rows.join(again, F.col(key) == F.col("_k"), "left_semi"), key, columns, version)
    return once.select(key, *[c for c in columns if c != key]).unionByName(held)


def keep_latest(results: DataFrame, source: DataFrame, key: str, version: str = "updated_at") -> DataFrame:
    """Of per-row ``results`` that still carry ``key`` and ``version``, those of the holding row.

    Lets an operator process every row of a wide table where it lies and shuffle only its small
    results together with (key, version) pairs, instead of shuffling the texts to find the
    newest. Equal results of identical rows become one row.
    """
    last = (
        source.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_k"))
        .agg(F.max(version).alias("_v"))
    )
    joined = results.join(last, (F.col(key) == F.col("_k")) & F.col(version).eqNullSafe(F.col("_v")), "left_semi")
    return joined.drop(version).distinct()


def heavy_keys(df: DataFrame, key: Column, rows: int | None = None) -> list:
    """The values of ``key`` that hold at least HEAVY_SHARE of the rows: at most 1 / HEAVY_SHARE."""
    counts = df.where(key.isNotNull()).groupBy(key.alias("_k")).agg(F.count("*").alias("_n"))
    if rows is None:
        rows = df.count()
    least = max(HEAVY_ROWS, int(rows * HEAVY_SHARE))
    if rows < least:
        return []
    return [r["_k"] for r in counts.where(F.col("_n") >= least).collect()]


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, heavy: list, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right``, unique on ``right_key``, without a task per heavy key.

    Rows of ``left`` under one of the ``heavy`` keys (see ``heavy_keys``; a bounded list) meet
    their few partner rows by broadcast where they lie; all others by a shuffled join. Rows without
    a key, which may be most, meet nothing and are never shuffled.
    """
    on = lambda a, b: a[left_key] == b[right_key]
    keyed = left.where(left[left_key].isNotNull())
    is_heavy = keyed[left_key].isin(heavy) if heavy else None
    light = keyed.where(~is_heavy) if heavy else keyed
    out = light.join(right, on(light, right), how)
    if heavy:
        dense = keyed.where(is_heavy)
        few = F.broadcast(right.where(right[right_key].isin(heavy)))
        out = out.unionByName(dense.join(few, on(dense, few), how))
    if how == "left":
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]
        out = out.unionByName(left.where(left[left_key].isNull()).select("*", *missing))
    return out
