"""Mixing sources to target weights (problem 9): soft membership, then projected least squares."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.common import cut

TOKENIZER = os.environ.get("CODELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labelled documents that the membership classifier is fitted on, at most, per source.
MAX_LABELLED = 400
#: Words of those documents that it knows, at most: those that most of them hold.
MAX_VOCABULARY = 200_000
#: Share of all tokens below which a round's changes count as none.
TOLERANCE = 1e-4
#: More rounds than any mixture takes; reaching it is an error, not a result.
MAX_ROUNDS = 1_000
#: Buckets of document hashes by which the fractions of rates are rounded.
BUCKETS = 4096


@lru_cache(maxsize=1)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_WORDS = re.compile(r"[^\W\d_]+|\d+(?=\.\d)|[#`>*|-]{1,3}(?=\s)|https?")


@dataclass
class Membership:
    """Multinomial naive Bayes over the words and marks of a text."""

    sources: list[str]
    vocabulary: dict[str, int]
    log_probability: np.ndarray
    prior: np.ndarray

    def posterior(self, text: str) -> list[float]:
        get = self.vocabulary.get
        ids = [k for k in map(get, set(_WORDS.findall(text.lower()))) if k is not None]
        scores = self.prior + (self.log_probability[ids].sum(0) if ids else 0.0)
        p = np.exp(scores - scores.max())
        return (p / p.sum()).tolist()


def text_words(text: str) -> list[str]:
    return sorted(set(_WORDS.findall(text.lower())))


def fit_membership(sources: list[str], rows: list[tuple[str, str]]) -> Membership:
    """The classifier of labelled texts at hand."""
    per: dict[str, int] = {}
    held: dict[tuple[str, str], int] = {}
    for source, text in rows:
        per[source] = per.get(source, 0) + 1
        for w in text_words(text):
            held[w, source] = held.get((w, source), 0) + 1
    return membership_of(sources, per, [(w, s, n) for (w, s), n in held.items()])


def membership_of(sources: list[str], per_source: dict[str, int], held: list[tuple[str, str, int]]) -> Membership:
    """The classifier of (word, source, texts that hold the word)."""
    vocabulary = {w: k for k, w in enumerate(sorted({w for w, _, _ in held}))}
    per = np.array([float(per_source.get(s, 0)) for s in sources])
    counts = np.zeros((max(1, len(vocabulary)), len(sources)))
    for w, s, n in held:
        counts[vocabulary[w], sources.index(s)] = n
    smooth = (counts + 0.5) / (per + 1)
    # a source without a single labelled document can't be told from the others: no document is its
    prior = np.where(per > 0, np.log(np.maximum(per, 1) / max(1.0, per.sum())), -1e9)
    return Membership(sources, vocabulary, np.log(smooth), prior)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [text_words(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])


def memberships(documents: DataFrame, sources: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """document, tokens, label, membership array<double> (by position in ``sources``).

    documents: document, source, text. A stated source of the targets, in any letter case and with
    blanks around it, is taken as it stands; for other documents a classifier fitted on the stated
    ones gives the posterior of each source. Null texts have no tokens.
    """
    clean = F.lower(F.trim("source"))
    named = documents.select("document", "text", F.when(clean.isin(sources), clean).alias("label"))
    ranked = named.where("label is not null and text is not null").withColumn("h", F.xxhash64("document", F.lit(7)))
    sizes = {r["label"]: r["n"] for r in ranked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # the MAX_LABELLED smallest hashes of each source; twice the share that they should be is looked at
    share = F.lit(0.0)
    for s, n in sizes.items():
        share = F.when(F.col("label") == s, F.lit(min(1.0, 2 * MAX_LABELLED / n))).otherwise(share)
    few = ranked.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1_000_003)), "document"))
    sample = few.withColumn("place", place).where(F.col("place") <= MAX_LABELLED).select("label", "text")
    words = cut(sample.mapInArrow(_word_rows, "label string, words array<string>"))
    per = {r["label"]: r["n"] for r in words.groupBy("label").agg(F.count("*").alias("n")).collect()}
    held = words.select("label", F.explode("words").alias("word")).groupBy("word", "label").agg(F.count("*").alias("n"))
    known = held.groupBy("word").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "word").limit(MAX_VOCABULARY)
    rows = [tuple(r) for r in held.join(known, "word", "left_semi").select("word", "label", "n").collect()]
    shared = documents.sparkSession.sparkContext.broadcast(membership_of(sources, per, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        encoding = _encoding(tokenizer)
        one = {s: [float(k == n) for k in range(len(sources))] for n, s in enumerate(sources)}
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            tokens = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
            member = [one[lb] if lb else model.posterior(t or "") for t, lb in zip(texts, labels, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("document"), pa.array(tokens, pa.int64()), batch.column("label"), pa.array(member, pa.list_(pa.float64()))],
                names=["document", "tokens", "label", "membership"],
            )

    kind = documents.schema["document"].dataType.simpleString()
    return named.mapInArrow(run, f"document {kind}, tokens long, label string, membership array<double>")


@dataclass
class Mixture:
    """documents: document, source, tokens, rate, copies; report: shares by source; rounds: of the
    fit, until nothing moved any more."""

    documents: DataFrame
    report: DataFrame
    rounds: int = 0


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> Mixture:
    """A mixture as large as all documents, whose shares follow the targets as the caps allow.

    targets: source, weight, max_repeats (a small table: one row per source; its number is what
    the driver holds). Rates are fitted by lazily projected gradient steps on the squared
    differences between expected and wanted tokens per source, with a common lift that keeps the
    total: what a capped source cannot give is spread over the others. Each round is one
    aggregation over the documents; what the driver sees are as many numbers as sources. A rate is
    then rounded to whole copies by document hash, so that each source's tokens stay exact up to
    one bucket. Sources without a target get no copies; a target without documents stays short.
    """
    spark = documents.sparkSession
    wanted = {}
    for r in targets.where("source is not null and weight > 0").collect():
        wanted[r["source"].strip().lower()] = (float(r["weight"]), int(r["max_repeats"] if r["max_repeats"] is not None else 1))
    sources = sorted(wanted)
    if not sources:
        empty = documents.select("document", F.col("source"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("rate"), F.lit(0).alias("copies")).limit(0)
        return Mixture(empty, spark.createDataFrame([], "source string, weight double, max_repeats int, available long, tokens long, share double, reached boolean"))
    state = cut(memberships(documents, sources, tokenizer))
    n = len(sources)
    weight = np.array([wanted[s][0] for s in sources])
    weight = weight / weight.sum()
    caps = [float(wanted[s][1]) for s in sources]
    at = [F.col("membership")[k] for k in range(n)]
    cap = sum((a * F.lit(c) for a, c in zip(at, caps, strict=True)), F.lit(0.0))
    first = state.agg(F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * a).alias(f"v{k}") for k, a in enumerate(at)]).first()
    total = float(first["all"] or 0)
    available = np.array([float(first[f"v{k}"] or 0) for k in range(n)])
    z = np.minimum(np.divide(weight * total, available, out=np.zeros(n), where=available > 0), caps)
    lift = 0.0

    def rate(z: np.ndarray):
        dot = sum((a * F.lit(float(v)) for a, v in zip(at, z, strict=True)), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(dot, cap))

    most = np.array(caps) * 1.5  # a capped source would grow for ever: it stays a little above its cap
    rounds = 0
    while total > 0:
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError("the rates of the mixture did not settle")
        drawn = rate(z) * F.col("tokens")
        got = state.agg(*[F.sum(drawn * a).alias(f"a{k}") for k, a in enumerate(at)]).first()
        expected = np.array([float(got[f"a{k}"] or 0) for k in range(n)])
        free = (available > 0) & (z < most) & (expected < np.array(caps) * available * (1 - 1e-9))
        missing = total - expected.sum()
        lift += missing / max(1, int(free.sum()))
        goal = np.maximum(weight * total + lift, 0)
        step = np.divide(goal - expected, available, out=np.zeros(n), where=available > 0)
        moved = np.clip(z + step, 0, most) - z
        settled = np.abs(moved * available).max(initial=0) < TOLERANCE * total
        if settled and (abs(missing) < TOLERANCE * total or not free.any()):
            break
        z = z + moved

    best = F.array_position("membership", F.array_max("membership")).cast("int") - 1
    names = F.array(*[F.lit(s) for s in sources])
    drawn = state.select(
        "document", "tokens", names[best].alias("source"), rate(z).alias("rate"), F.pmod(F.xxhash64("document", F.lit(1)), F.lit(BUCKETS)).cast("int").alias("bucket")
    ).withColumn("part", F.col("rate") - F.floor("rate"))
    sums = (
        drawn.where("part > 0")
        .groupBy("source", "bucket")
        .agg(F.sum("tokens").cast("double").alias("t"), F.sum(F.col("tokens") * F.col("part")).alias("e"))
        .collect()  # at most sources x BUCKETS rows
    )
    limit = F.lit(0)
    for s in sources:
        own = sorted((r["bucket"], r["t"], r["e"]) for r in sums if r["source"] == s)
        due, taken, upto = sum(e for _, _, e in own), 0.0, 0
        for b, t, _ in own:
            if abs(taken + t - due) > abs(taken - due):
                break
            taken, upto = taken + t, b + 1
        limit = F.when(F.col("source") == s, F.lit(upto)).otherwise(limit)
    whole = drawn.withColumn("copies", (F.floor("rate") + F.when((F.col("part") > 0) & (F.col("bucket") < limit), 1).otherwise(0)).cast("int"))
    whole = whole.select("document", "source", "tokens", "rate", "copies")
    facts = spark.createDataFrame([(s, float(w), int(wanted[s][1])) for s, w in zip(sources, weight, strict=True)], "s string, weight double, max_repeats int")
    by = whole.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    joined = facts.join(by, F.col("s") == F.col("source"), "left")
    out = joined.crossJoin(F.broadcast(by.agg(F.sum("tokens").alias("sum"))))  # one row
    share = F.coalesce(F.col("tokens"), F.lit(0)) / F.col("sum")
    report = out.select(
        F.col("s").alias("source"), "weight", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        share.alias("share"), (F.abs(share - F.col("weight")) < 0.005).alias("reached"),
    )
    return Mixture(whole.where("copies > 0"), report, rounds)
