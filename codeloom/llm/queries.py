"""Queries of the training-data operators over the tables of a corpus directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.docs import documented_functions
from codeloom.llm.leaks import MIN_WORDS, leaked_items
from codeloom.llm.levels import reading_levels
from codeloom.llm.mixing import Mixture, mix
from codeloom.llm.origins import file_origins
from codeloom.llm.sql import ORACLES
from codeloom.llm.secrets import find_secrets
from codeloom.llm.splitting import LIMIT, OVERLAP, split_oversized
from codeloom.llm.terms import clean_language, distinctive_terms, reconcile, term_frequencies
from codeloom.operators.common import keep_latest, settled_rows
from codeloom.sources.tables import load

__all__ = ["ORACLES", "QUERIES"]


def _term_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled_rows(load(spark, sf_dir, "code_chunks"), "id", ["language", "subwords"])
    return rows.select(F.col("id").alias("record"), clean_language(F.col("language")).alias("language"), F.col("subwords").alias("terms"))


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = (
        load(spark, sf_dir, "symbols").groupBy(F.col("file_path").alias("f")).agg(F.coalesce(F.bool_or("is_test"), F.lit(False)).alias("is_test"))
    )
    files = file_origins(load(spark, sf_dir, "code_chunks"))
    joined = files.join(tests, F.col("file_path") == F.col("f"), "left")
    return joined.select("file_path", "origin", "reason", F.coalesce("is_test", F.lit(False)).alias("is_test"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_origins(load(spark, sf_dir, "code_chunks")).where("origin is not null").select("file_path").distinct()


def _documented(spark: SparkSession, sf_dir: str, with_code: bool) -> DataFrame:
    pairs = documented_functions(load(spark, sf_dir, "symbols"), load(spark, sf_dir, "code_chunks"), with_code)
    return pairs.withColumnsRenamed({"symbol": "symbol_id", "chunk": "chunk_id"})


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documented(spark, sf_dir, True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documented(spark, sf_dir, False).where("own and symbol_id is not null").select("symbol_id", "chunk_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive_terms(_term_records(spark, sf_dir), at_least=3)
    return scored.where("doc_count between 2 and 8").select(F.col("record").alias("chunk_id"), F.col("term").alias("token"))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive_terms(_term_records(spark, sf_dir))
    return scored.select(
        F.col("record").alias("chunk_id"), F.col("term").alias("token"), "n", "doc_count", F.round("score", 4).alias("score")
    )


def _secrets(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    chunks = load(spark, sf_dir, "code_chunks").where("id is not null").select(F.col("id").alias("chunk"), "updated_at", "content")
    return keep_latest(find_secrets(chunks, with_text), chunks.select("chunk", "updated_at"), "chunk").withColumnRenamed("chunk", "chunk_id")


def p5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets(spark, sf_dir, True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _secrets(spark, sf_dir, False).select("chunk_id", F.explode("places").alias("p"))
    return places.select("chunk_id", F.col("p.line_no").alias("line_no")).distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "code_chunks")
    last = chunks.where("id is not null").groupBy(F.col("id").alias("k")).agg(F.max("updated_at").alias("v"))
    large = chunks.where(F.char_length("content") > LIMIT).select("id", "updated_at", "content", "chunk_type", "line_start")
    held = large.join(last, (F.col("id") == F.col("k")) & F.col("updated_at").eqNullSafe(F.col("v")), "left_semi")
    held = held.dropDuplicates(["id"])
    items = held.select(F.col("id").alias("item"), "content", F.col("chunk_type").alias("kind"), "line_start")
    return split_oversized(items).withColumnRenamed("item", "chunk_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).select("chunk_id", "cut_kind").distinct()


def p6_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of every large chunk: within the limit, no more shared than allowed,
    together the whole text."""
    pieces = p6_pieces(spark, sf_dir).select("chunk_id", "piece_no", "pieces", "begin", F.char_length("content").alias("n"), "content")
    shared = F.lag(F.col("begin") + F.col("n")).over(Window.partitionBy("chunk_id").orderBy("piece_no")) - F.col("begin")
    rows = pieces.withColumn("shared", F.coalesce(shared, F.lit(0))).withColumn("own", F.expr("substring(content, shared + 1)"))
    by = rows.groupBy("chunk_id").agg(
        F.max(F.col("begin") + F.col("n")).alias("size"), (F.max("n") <= LIMIT).alias("within"), ((F.min("shared") >= 0) & (F.max("shared") <= OVERLAP)).alias("shares"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")).alias("rebuilt"),
    )
    return by


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = term_frequencies(_term_records(spark, sf_dir))
    return reconcile(counted, load(spark, sf_dir, "subword_stats")).withColumnRenamed("term", "token")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_terms(spark, sf_dir).where("mark is not null").select("token", "language", "mark")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), "text")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "eval_items").select(F.col("item_id").alias("item"), "text")
    return leaked_items(_texts(spark, sf_dir), items).withColumnsRenamed({"document": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where(F.col("words") >= MIN_WORDS).select("doc_id", "item_id").distinct()


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    documents = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), "source", "text")
    return mix(documents, load(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).documents.withColumnRenamed("document", "doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "level_labels").select(F.col("doc_id").alias("document"), "band", "rater")
    return reading_levels(_texts(spark, sf_dir), labels).withColumnRenamed("document", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where(F.col("band").isin("entry", "expert")).select("doc_id", "band").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_files": p1_files,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p5_found": p5_found,
    "p5_secrets": p5_secrets,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_cover": p6_cover,
    "p7_found": p7_found,
    "p7_terms": p7_terms,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mixture": p9_mixture,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
}
