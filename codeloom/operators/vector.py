"""Exact cosine search: a stated set of queries, in blocks, against every row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a block of query vectors: what one pass over the corpus carries to each task.
BLOCK_FLOATS = 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a.cast("array<double>"), lambda x: x / size)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]: negative ones and those of zero vectors are 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / size))).otherwise(0.0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def top_cosine(queries: DataFrame, corpus: DataFrame, k: int, floor: float = 0.0, digits: int = 6) -> DataFrame:
    """query_id, id, score: for every query the k rows of greatest cosine above the floor, ties by id.

    queries: query_id, vector, group; corpus: id, vector, group. Rows of the query's own group and
    the query itself are left out (a null group is nobody's). The queries are carried to the corpus
    in blocks of bounded size; each batch of rows is one matrix product and keeps its own k best,
    so what is shuffled is k rows per query and batch. Rows without a vector or with another
    length than the queries are skipped.
    """
    spark = queries.sparkSession
    usable = queries.where("vector is not null and query_id is not null").select("query_id", "vector", F.col("group").cast("string").alias("group"))
    facts = usable.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    total, dim = facts["n"] or 0, facts["dim"] or 1
    blocks = max(1, math.ceil(total * dim / BLOCK_FLOATS))
    rows = corpus.where(F.col("vector").isNotNull() & (F.size("vector") == dim)).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("group").cast("string").alias("group"))
    parts = []
    for b in range(blocks):
        mine = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        ids = mine["query_id"].to_numpy(np.int64)
        m = np.stack([np.asarray(v, np.float64) for v in mine["vector"]]) if len(mine) else np.zeros((0, dim))
        size = np.linalg.norm(m, axis=1, keepdims=True)
        groups = np.array([g if g is not None else f"\0q{i}" for i, g in zip(ids, mine["group"], strict=True)], object)
        shared = spark.sparkContext.broadcast((ids, np.divide(m, size, out=np.zeros_like(m), where=size > 0), groups))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, qm, qgroups = shared.value
            for batch in batches:
                cids = batch.column("id").to_numpy(zero_copy_only=False)
                sims = np.clip(np.round(qm @ _matrix(batch.column("vector")).T, digits), 0, 1) if len(qids) and len(cids) else np.zeros((len(qids), len(cids)))
                cgroups = np.array([g if g is not None else f"\0c{i}" for i, g in zip(cids, batch.column("group").to_pylist(), strict=True)], object)
                out_q, out_c, out_s = [], [], []
                for i in range(len(qids)):
                    ok = (sims[i] >= floor) & (cids != qids[i]) & (cgroups != qgroups[i])
                    at = np.flatnonzero(ok)
                    best = at[np.lexsort((cids[at], -sims[i][at]))[:k]]
                    out_q += [qids[i]] * len(best)
                    out_c += cids[best].tolist()
                    out_s += sims[i][best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_c, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "id", "score"])

        parts.append(rows.mapInArrow(run, "query_id long, id long, score double"))
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "score")
