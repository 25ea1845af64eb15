"""Reading level of documents (problem 10): one smoothed unigram language model per level."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ("entry", "general", "technical", "expert")
#: Rated documents that the models are fitted on, at most: those with the smallest hashes.
MAX_RATED = 4_000
#: Pseudo-count that every word of the vocabulary has in every model.
SMOOTHING = 0.1

#: Function words that tell the languages of the collection apart.
FUNCTION_WORDS = {
    "en": "the a an of and is are to in it its this that with you for each every by on as at or not be can before after within under".split(),
    "de": "der die das ein eine einer eines dem den des und ist im bei jeder jede jedes dieser diese dieses für ohne nach vor über während mit nicht".split(),
    "es": "el la los las un una este esta cada del de en según durante antes después sin para por y se no con al".split(),
    "fr": "le la les un une ce cet cette chaque des du de à pour pendant après avant sans selon et est dans avec ne pas au".split(),
}

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>")
_LINK = re.compile(r"\[([^\[\]]{0,300})\]\([^()\s]{0,500}\)|(?:https?|ftp)://\S+")
_BULLET = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+")
_QUOTE = re.compile(r"[ \t]*(?:>[ \t]?)+")
_DROP = re.compile(
    r"[ \t]*(?:#{1,6}[ \t]|=+\s*$|-{3,}\s*$|\||at [\w.$]+ ?\(|\[?\d{1,4}[:\-/.]\d\d\b|[\[(]?(?:INFO|WARN|ERROR|DEBUG|TRACE)\b|`[^`]*`\s*$|See\s*\.?\s*$)"
)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]*[A-ZÀ-Þ0-9])|(?<=[.!?])\s*\Z")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CODE = re.compile(r"[{}=;<>]|\w\(|_\w|[a-z][A-Z]")


def prose_sentences(text: str) -> list[list[str]]:
    """Lower-case words of every sentence of the running text.

    Code blocks, headings, tables, log and trace lines, links and tags are left out; wrapped lines
    are joined; a list item is a sentence of its own. Sentences of fewer than three words are not
    counted.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("­", "").replace("​", "")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "://" in text or "](" in text:
        text = _LINK.sub(lambda m: m.group(1) or " ", text)
    blocks: list[str] = []
    open_block = False
    for line in text.split("\n"):
        if ">" in line:
            m = _QUOTE.match(line)
            line = line[m.end() :] if m else line
        if not line.strip() or _DROP.match(line):
            open_block = False
            continue
        m = _BULLET.match(line)
        if m:
            blocks.append(line[m.end() :])
            open_block = True
        elif open_block:
            blocks[-1] += " " + line.strip()
        else:
            blocks.append(line.strip())
            open_block = True
    out = []
    for block in blocks:
        for part in _SENTENCE.split(block):
            words = _WORDS.findall(part.lower()) if part else []
            if len(words) >= 3 and len(_CODE.findall(part)) * 4 <= len(words):
                out.append(words)
    return out


_TONGUES = {w: [t for t, ws in FUNCTION_WORDS.items() if w in ws] for ws in FUNCTION_WORDS.values() for w in ws}


def is_english(words: list[str]) -> bool:
    """Whether a sentence has more function words of English than of any other language."""
    seen: Counter[str] = Counter()
    for w in words:
        for t in _TONGUES.get(w, ()):
            seen[t] += 1
    best = max((n for t, n in seen.items() if t != "en"), default=0)
    return seen["en"] > best


def english_body(text: str | None) -> list[list[str]]:
    """The English sentences of a document whose body is mostly English, else nothing."""
    if not text:
        return []
    sentences = prose_sentences(text)
    english = [s for s in sentences if is_english(s)]
    return english if len(english) * 2 > len(sentences) else []


@dataclass
class LevelModels:
    vocabulary: dict[str, int]
    log_probability: np.ndarray  # word x band; the last row is for unknown words and is zero

    def scores(self, sentences: list[list[str]]) -> np.ndarray:
        """Log likelihood of every sentence under every band; words seen in no rated text count for none."""
        unknown = len(self.vocabulary)
        flat = np.array([self.vocabulary.get(w, unknown) for s in sentences for w in s])
        begins = np.concatenate(([0], np.cumsum([len(s) for s in sentences])[:-1]))
        return np.add.reduceat(self.log_probability[flat], begins, axis=0)


def fit_models(rated: Iterable[tuple[str, list[list[str]]]]) -> LevelModels:
    """Models from (band, sentences) of rated documents, by word counts of whole documents.

    A rating holds for most sentences of its document, not for each, and some ratings are wrong;
    that blurs the models a little but leaves every sentence likeliest under its own level.
    """
    counts = Counter((band, w) for band, sentences in rated for s in sentences for w in s)
    return models_of((band, w, n) for (band, w), n in counts.items())


def models_of(counts: Iterable[tuple[str, str, int]]) -> LevelModels:
    """Models from (band, word, occurrences)."""
    vocabulary: dict[str, int] = {}
    cells = [(vocabulary.setdefault(w, len(vocabulary)), BANDS.index(band), n) for band, w, n in counts]
    if not cells:
        return LevelModels({}, np.zeros((1, len(BANDS))))
    words, bands, n = np.array(cells).T
    table = np.zeros((len(vocabulary), len(BANDS)))
    np.add.at(table, (words, bands), n)
    table = np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * len(vocabulary)))
    return LevelModels(vocabulary, np.vstack([table, np.zeros(len(BANDS))]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, word, n of the English sentences of each batch of band, text."""
    for batch in batches:
        counts: Counter[tuple[str, str]] = Counter()
        for band, text in zip(batch.column("band").to_pylist(), batch.column("text")):
            counts.update((band, w) for s in english_body(text.as_py()) for w in s)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["band", "word", "n"],
        )


def agreed_ratings(labels: DataFrame) -> DataFrame:
    """document, band: the band most raters gave; documents without a clear one are left out."""
    votes = (
        labels.where(F.col("band").isin(*BANDS)).select("document", "rater", "band").distinct()
        .groupBy("document", "band").agg(F.count("*").alias("n"))
    )
    by_band = votes.groupBy("document").agg(F.max(F.struct("n", "band")).alias("top"), F.sum("n").alias("all"))
    return by_band.where(F.col("top.n") * 2 > F.col("all")).select("document", F.col("top.band").alias("band"))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """document, band, sentences, share, margin for every document whose body is English prose.

    documents: document (unique), text; labels: document, band, rater. band is the level of most
    of its sentences (of equally many, the one likelier by the whole text), share their part, and
    margin the mean log-likelihood lead per sentence over the other bands. Null, empty,
    placeholder and log texts and other languages give no rows. Without any usable rating there
    is no model and no row.
    """
    documents = documents.select("document", "text")
    agreed = agreed_ratings(labels)
    chosen = agreed.orderBy(F.xxhash64("document"), "document").limit(MAX_RATED)
    # at most MAX_RATED rows are broadcast, and only their vocabulary comes to the driver
    counts = (
        documents.join(F.broadcast(chosen), "document").select("band", "text")
        .mapInArrow(_count_words, "band string, word string, n long")
        .groupBy("band", "word").agg(F.sum("n").alias("n"))
    )
    models = models_of((r["band"], r["word"], r["n"]) for r in sorted(counts.collect()))
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column("text")
            row, band, sentences, share, margin = [], [], [], [], []
            for n in range(batch.num_rows if fitted.vocabulary else 0):
                body = english_body(texts[n].as_py())
                if not body:
                    continue
                scores = fitted.scores(body)
                votes = np.bincount(scores.argmax(1), minlength=len(BANDS))
                total = scores.sum(0)
                best = max(range(len(BANDS)), key=lambda k: (votes[k], total[k]))
                row.append(n)
                band.append(BANDS[best])
                sentences.append(len(body))
                share.append(float(votes[best]) / len(body))
                margin.append(float(total[best] - np.delete(total, best).max()) / len(body))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("document").take(pa.array(row, pa.int64())),
                    pa.array(band, pa.string()),
                    pa.array(sentences, pa.int32()),
                    pa.array(share, pa.float64()),
                    pa.array(margin, pa.float64()),
                ],
                names=["document", "band", "sentences", "share", "margin"],
            )

    kind = documents.schema["document"].dataType.simpleString()
    return documents.mapInArrow(
        run, f"document {kind}, band string, sentences int, share double, margin double"
    )
