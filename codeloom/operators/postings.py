"""An inverted index of the chunks: postings by term, written once per state of the table.

Searches read the few row groups that hold their terms instead of the corpus. A posting carries
what scoring and scoping look at, so a search joins nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.common import few

#: Weights of the fields; the last one is indexed without a weight of its own.
FIELD_WEIGHTS = {"content": 1.0, "subwords": 0.6, "fqn_rel": 0.5, "path_rel": 0.2, "declared_rules": 0.4, "content_type": 1.0}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: What a search may be narrowed by.
SCOPES = ("is_test", "content_type", "language")


def fields(chunks: DataFrame) -> dict[str, Column]:
    """The words of every field that the table has."""
    out = {}
    for name in FIELD_WEIGHTS:
        if name in chunks.columns:
            column = F.concat_ws(" ", name) if name == "subwords" else F.coalesce(name, F.lit(""))
            out[name] = X.words(column)
    return out


def sizes(rows: DataFrame) -> DataFrame:
    """id, updated_at, size: words over all fields of every row."""
    return rows.select("id", "updated_at", sum((F.size(w) for w in fields(rows).values()), F.lit(0)).alias("size"))


def repeats(rows: DataFrame) -> DataFrame:
    """id, version, copies of the ids that stand in more than one row: the newest version and how
    many identical rows hold it. Few against the table, and the texts stay where they lie."""
    versions = rows.groupBy("id", "updated_at").agg(F.count("*").alias("copies"))
    newest = F.max_by(F.struct("updated_at", "copies"), F.struct(F.col("updated_at").isNotNull(), "updated_at"))
    by = versions.groupBy(F.col("id").alias("rid")).agg(newest.alias("last"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    return few(by.select("rid", F.col("last.updated_at").alias("version"), F.col("last.copies").alias("copies")))


def _weighted(weight: float):
    return lambda x: F.struct(x.alias("term"), F.lit(weight).alias("w"))


def postings(rows: DataFrame) -> DataFrame:
    """term, id, f (weighted frequency), size, is_test, content_type, language.

    rows: chunks with updated_at; of ids that come again the newest row holds. Words are counted
    within each row before anything is shuffled. Null fields have no words; rows without an id are
    left out."""
    rows = rows.where("id is not null")
    words = fields(rows)
    row = ["id", "updated_at", "size", *SCOPES]
    scopes = [F.coalesce("is_test", F.lit(False)).alias("is_test"), *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in SCOPES[1:]]]
    split = rows.select("id", "updated_at", *scopes, *[w.alias(f"_{n}") for n, w in words.items()])
    size = sum((F.size(f"_{n}") for n in words), F.lit(0))
    tagged = F.concat(*[F.transform(f"_{n}", _weighted(FIELD_WEIGHTS[n])) for n in words])
    sized = split.select("id", "updated_at", size.alias("size"), *SCOPES, tagged.alias("_all"))
    counted = sized.select(*row, F.inline("_all")).groupBy(*row, "term").agg(F.sum("w").alias("f"))
    again = repeats(rows)
    met = counted.join(again, F.col("id") == F.col("rid"), "left")
    held = met.where(F.col("rid").isNull() | F.col("updated_at").eqNullSafe(F.col("version")))
    return held.select("term", "id", (F.col("f") / F.coalesce("copies", F.lit(1))).alias("f"), "size", *SCOPES)


@dataclass(frozen=True)
class LexicalIndex:
    """The postings of one state of a table of chunks, with its number of chunks and their mean size."""

    postings: DataFrame
    stats: DataFrame
    chunks: int
    average: float

    @classmethod
    def write(cls, rows: DataFrame, stats: DataFrame, path: str) -> None:
        """Postings in order of terms, so that a search skips all row groups but few; a term that
        most chunks hold spreads over several files. The facts come last: they say it is whole."""
        spark = rows.sparkSession
        postings(rows).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        stats.repartitionByRange("section", "key").sortWithinPartitions("section", "key").write.mode("overwrite").parquet(f"{path}/stats")
        again = repeats(rows)
        held = sizes(rows.where("id is not null")).join(again, F.col("id") == F.col("rid"), "left").where(F.col("rid").isNull() | F.col("updated_at").eqNullSafe(F.col("version")))
        facts = held.agg(F.sum(1 / F.coalesce("copies", F.lit(1))).alias("n"), F.sum(F.col("size") / F.coalesce("copies", F.lit(1))).alias("words")).first()
        n = round(facts["n"] or 0)
        spark.createDataFrame([(n, (facts["words"] or 0.0) / max(1, n))], "chunks long, average double").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LexicalIndex:
        facts = spark.read.schema("chunks long, average double").parquet(f"{path}/facts").first()
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), facts["chunks"], facts["average"])

    @cached_property
    def vocabulary(self) -> DataFrame:
        """key, doc_count of sub-words over all languages."""
        return self.stats.where("section = 'token'").groupBy("key").agg(F.sum("doc_count").alias("doc_count"))

    def known(self, words: Sequence[str]) -> set[str]:
        """Which of the (few) words are sub-words of the corpus."""
        return {r["key"] for r in self.stats.where((F.col("section") == "token") & F.col("key").isin(*words)).select("key").distinct().collect()} if words else set()

    def phrases(self, query: str) -> list[str]:
        """What a query asks the index for: its words, then its sub-words; a sub-word that the
        corpus does not know stands as its first three letters with a star."""
        parts = X.decompose(query)
        known = self.known(parts)
        return X.full_text_words(query) + [w if w in known or len(w) < 3 else f"{w[:3]}*" for w in parts]

    def frequencies(self, phrases: Sequence[str], where: Column | None = None) -> DataFrame:
        """id, size, is_test, f0, f1, ... of the chunks that hold one of the (distinct) phrases."""
        tests = [F.col("term").startswith(p[:-1]) if p.endswith("*") else F.col("term") == p for p in phrases]
        ranges = [(F.col("term") >= p[:-1]) & (F.col("term") < p[:-1] + "￿") if p.endswith("*") else F.col("term") == p for p in phrases]
        if not phrases:
            return self.postings.select("id", "size", "is_test").where("false")
        near = ranges[0]
        for r in ranges[1:]:
            near = near | r
        rows = self.postings.where(near if where is None else near & where)
        return rows.groupBy("id", "size", "is_test").agg(*[F.sum(F.when(t, F.col("f")).otherwise(0.0)).alias(f"f{k}") for k, t in enumerate(tests)])

    def bm25(self, phrases: Sequence[str], where: Column | None = None) -> DataFrame:
        """id, score of every chunk that holds one of the phrases; the greater, the better.

        A phrase that stands twice counts twice. where narrows the chunks that are reported, not
        those that the frequencies are taken from."""
        unique = list(dict.fromkeys(phrases))
        rows = self.frequencies(unique)
        if not unique:
            return rows.select("id", F.lit(0.0).alias("score"))
        facts = rows.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(unique))]).first()
        score = F.lit(0.0)
        for k, phrase in enumerate(unique):
            holders = facts[f"n{k}"]
            idf = F.log(F.lit((self.chunks - holders + 0.5) / (holders + 0.5)))
            weight = F.when(idf > 0, idf).otherwise(LEAST_IDF)
            f = F.col(f"f{k}")
            score = score + list(phrases).count(phrase) * weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.lit(float(self.average or 1.0))))
        kept = rows if where is None else self.frequencies(unique, where)
        return kept.select("id", score.alias("score"))

    def match_counts(self, phrases: Sequence[str], where: Column | None = None) -> DataFrame:
        """is_test, n: chunks that hold one of the phrases, tests apart."""
        return self.frequencies(list(dict.fromkeys(phrases)), where).groupBy("is_test").agg(F.count("*").alias("n"))
