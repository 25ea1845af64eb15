"""Frequencies of terms over records (problem 7) and their distinctiveness (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.common import cut, lookup_join

#: Other spellings of a language in the index, by the spelling that holds.
LANGUAGE_SPELLINGS = {
    "py": "python", "golang": "go", "js": "javascript", "ts": "typescript", "md": "markdown",
    "yml": "yaml", "sh": "shell", "bash": "shell", "docker": "dockerfile",
}
RARE_RECORDS = 2
COMMON_SHARE = 0.2


def clean_language(column):
    """The spelling that holds, or ``unknown`` for null and blank ones."""
    low = F.ltrim(F.lower(F.trim(column)), F.lit("."))
    pairs = [F.lit(x) for kv in LANGUAGE_SPELLINGS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[low], F.nullif(low, F.lit("")), F.lit("unknown"))


def _flat_terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Record numbers and term codes of a batch's cleaned terms, and the terms by code.

    Cleaned is trimmed and lower-cased; null and empty terms are left out. Only distinct
    spellings are cleaned, not every occurrence.
    """
    lists = batch.column("terms")
    record = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    words = pc.dictionary_encode(pc.list_flatten(lists))
    clean = pc.utf8_lower(pc.utf8_trim_whitespace(words.dictionary))
    merged = pc.dictionary_encode(clean)
    to_clean = pc.fill_null(merged.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = np.append(pc.fill_null(pc.equal(merged.dictionary, ""), True).to_numpy(zero_copy_only=False), True)
    raw = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.append(to_clean, -1)[raw]
    keep = ~empty[code]
    return record[keep], code[keep], merged.dictionary


def _per_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        record, code, terms = _flat_terms(batch)
        pairs, n = np.unique(record * max(1, len(terms)) + code, return_counts=True)
        rec, term = np.divmod(pairs, max(1, len(terms)))
        size = np.bincount(record, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("record").take(pa.array(rec)),
                terms.take(pa.array(term)),
                pa.array(n.astype(np.int64)),
                pa.array(size[rec].astype(np.int64)),
            ],
            names=["record", "term", "n", "record_size"],
        )


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last-seen counters: the terms of a batch ordered by (language, term, record), so a term is
    met in a new record exactly where the record differs from the last one seen for it. A record
    lies in one batch, so the partial counts of all batches add up."""
    for batch in batches:
        record, code, terms = _flat_terms(batch)
        tongues = pc.dictionary_encode(batch.column("language"))
        tongue = tongues.indices.to_numpy(zero_copy_only=False).astype(np.int64)[record]
        key = tongue * max(1, len(terms)) + code
        order = np.lexsort((record, key))
        key, record = key[order], record[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        fresh = first.copy()
        fresh[1:] |= record[1:] != record[:-1]
        at = np.flatnonzero(first)
        records = np.add.reduceat(fresh.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        occurrences = np.diff(np.append(at, len(key)))
        lang, term = np.divmod(key[at], max(1, len(terms)))
        # one row per language with a null term: the number of its records
        seen = np.bincount(tongues.indices.to_numpy(zero_copy_only=False), minlength=len(tongues.dictionary))
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([terms.take(pa.array(term)), pa.nulls(len(seen), pa.string())]),
                pa.concat_arrays([tongues.dictionary.take(pa.array(lang)), tongues.dictionary]),
                pa.array(np.append(occurrences, np.zeros(len(seen))).astype(np.int64)),
                pa.array(np.append(records, seen).astype(np.int64)),
            ],
            names=["term", "language", "occurrences", "records"],
        )


def term_frequencies(records: DataFrame) -> DataFrame:
    """term, language, occurrences, records, language_records, mark of ``records``.

    records: record (unique), language (not null), terms (array of strings). Null arrays count as
    records without terms; null, blank and differently spelt terms are cleaned away. mark is
    ``rare`` for terms of at most RARE_RECORDS records of their language, else ``common`` for
    those of at least COMMON_SHARE of them, else null. An empty table gives an empty one.

    Every batch is counted where it lies; what is shuffled is one row per term and batch.
    """
    narrow = records.select("record", "language", F.col("terms").cast("array<string>").alias("terms"))
    parts = narrow.mapInArrow(_counters, "term string, language string, occurrences long, records long")
    counts = parts.groupBy("language", "term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )
    counts = cut(counts)
    sizes = counts.where("term is null").select(F.col("language").alias("l"), F.col("records").alias("language_records"))
    # one row per language: the planner broadcasts it if its measured size allows
    terms = counts.where("term is not null").join(sizes, F.col("language") == F.col("l")).drop("l")
    mark = F.when(F.col("records") <= RARE_RECORDS, "rare").when(
        F.col("records") >= COMMON_SHARE * F.col("language_records"), "common"
    )
    return terms.withColumn("mark", mark)


def reconcile(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """``frequencies`` with stated_records, the record count that ``stats`` states for the term.

    stats: token, language, doc_count, shard. Rows written twice count once, spellings are merged
    and shards added; where a shard's count is null the statement is incomplete and the counted
    number stands in. A term that only ``stats`` knows has zero occurrences and records.
    """
    stated = (
        stats.select("token", "language", "doc_count", "shard")
        .distinct()
        .select(F.lower(F.trim("token")).alias("t"), clean_language(F.col("language")).alias("l"), "doc_count")
        .where("t <> ''")
        .groupBy("t", "l")
        .agg(F.sum("doc_count").alias("s"), F.max(F.col("doc_count").isNull()).alias("partial"))
    )
    both = frequencies.join(stated, (F.col("term") == F.col("t")) & (F.col("language") == F.col("l")), "full")
    return both.select(
        F.coalesce("term", "t").alias("term"),
        F.coalesce("language", "l").alias("language"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        F.coalesce("records", F.lit(0)).alias("records"),
        F.when(F.col("partial") | F.col("s").isNull(), F.coalesce("records", F.lit(0))).otherwise(F.col("s")).alias("stated_records"),
        "mark",
    )


def distinctive_terms(records: DataFrame, at_least: int = 1) -> DataFrame:
    """record, term, n, doc_count, score for every term that stands ``at_least`` times in a record.

    score is the adjusted residual of correspondence analysis: with row total r, column total c
    and grand total N, expected e = r * c / N, (n - e) / sqrt(e * (1 - r / N) * (1 - c / N)).
    It is null where that variance is zero (one record, or one term, is all there is). Common
    terms are expected in every record and score low; terms that few records share and repeat
    score high. Terms are cleaned as in ``term_frequencies``; records without terms give no rows.
    """
    narrow = records.select("record", F.col("terms").cast("array<string>").alias("terms"))
    record_type = narrow.schema["record"].dataType.simpleString()
    cells = narrow.mapInArrow(_per_record, f"record {record_type}, term string, n long, record_size long")
    columns = cut(cells.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("doc_count")))
    sums = columns.agg(F.sum("total").alias("n"), F.sum("doc_count").alias("cells")).first()
    grand, filled = sums["n"] or 0, sums["cells"] or 0
    # terms of at least a 200th of all cells: at most 200
    heavy = [r["term"] for r in columns.where(F.col("doc_count") * 200 >= max(filled, 200 * 100)).select("term").collect()]
    named = columns.select(F.col("term").alias("t"), "total", "doc_count")
    met = lookup_join(cells.where(F.col("n") >= at_least), named, "term", "t", heavy)
    expected = F.col("record_size") * F.col("total") / F.lit(float(grand or 1))
    variance = expected * (1 - F.col("record_size") / F.lit(float(grand or 1))) * (1 - F.col("total") / F.lit(float(grand or 1)))
    score = F.when(variance > 0, (F.col("n") - expected) / F.sqrt(variance))
    return met.select("record", "term", "n", "doc_count", score.alias("score"))
