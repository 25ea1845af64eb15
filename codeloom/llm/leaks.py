"""Evaluation passages inside a corpus (problem 8): rare seeds join, Smith-Waterman aligns."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.common import cut, few

#: Words of a seed. 20 words with two of them changed keep at least MIN_SEEDS whole ones.
SEED = 5
MIN_WORDS = 20
#: One word in so many may be changed, left out or put in.
PER_CHANGE = 10
MIN_SEEDS = (MIN_WORDS - SEED + 1) - SEED * (MIN_WORDS // PER_CHANGE)
#: A line that this many items share is an instruction, not part of a passage.
BOILERPLATE_ITEMS = 4
#: The filter of seeds that goes to the corpus: bits per seed, and its size at most (32 MB).
FILTER_BITS, FILTER_LOG2 = 16, 28
#: Pairs of equal seeds of one document and item that are looked at one by one; where there are
#: more (texts of one word, say) every diagonal is aligned instead.
MANY_HITS = 1_000_000
#: Words whose hashes are kept.
_KEPT = 500_000
MATCH, CHANGE = 1, -1

_INLINE = re.compile(r"</?(?:b|i|em|strong|code|span|u|a|mark|sub|sup|tt|small|font)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"<[/!a-zA-Z][^<>]{0,400}>")
_PREFIX = re.compile(r"^[ \t]*(?:(?:[>|#*+;%~\-]+|//+|\d{1,4}[.):|]|\[\d+\])[ \t]*)+", re.M)
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\r?\n[ \t]*(?=[^\W\d_])")
_WORDS = re.compile(r"[^\W_]+")
_APOSTROPHES = str.maketrans("", "", "'’ʼ`*")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, markup, line prefixes, breaks and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if any(unicodedata.category(c) == "Cf" for c in set(text)):
            text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    if "&" in text:
        text = html.unescape(text).replace("\xa0", " ").replace("\xad", "")
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    text = _PREFIX.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    if "-\n" in text or not text.isascii():
        text = _BROKEN.sub("", text)
    return _WORDS.findall(text.translate(_APOSTROPHES).lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASH = _Hashes()
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SEED)], dtype=np.uint64)


def word_codes(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))


def seeds_of(codes: np.ndarray) -> np.ndarray:
    """A hash of every SEED neighbouring words."""
    n = len(codes) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SEED):
        out += codes[k : k + n] * _MULTIPLIERS[k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def needed_seeds(words: int) -> int:
    """The seeds that every leak of a passage of so many words keeps whole."""
    least = min(MIN_WORDS, words)
    return max(1, (least - SEED + 1) - SEED * (least // PER_CHANGE))


def _needed(words: Column) -> Column:
    """``needed_seeds`` as an expression."""
    least = F.least(words, F.lit(MIN_WORDS))
    return F.greatest(F.lit(1), least - SEED + 1 - SEED * F.floor(least / PER_CHANGE))


def _aligned(a: np.ndarray, b: np.ndarray, top: int, bottom: int, low: int, high: int) -> list[tuple[int, int]]:
    """Smith-Waterman over a[top:bottom] and the diagonals low to high of ``b``: steps of the best
    local alignment as (position in a or -1, in b or -1).

    Only the directions are kept, a byte for each cell of the band."""
    width = high - low + 1
    begin = top + low
    wide = np.zeros(bottom - top + width, np.uint64)
    real = np.zeros(len(wide), bool)
    first, last = max(0, begin), min(len(b), begin + len(wide))
    if first < last:
        wide[first - begin : last - begin] = b[first:last]
        real[first - begin : last - begin] = True
    slope = -CHANGE * np.arange(width, dtype=np.int32)
    ways = np.zeros((bottom - top, width), np.int8)
    above = np.zeros(width + 1, np.int32)
    best, at = 0, (0, 0)
    for i in range(bottom - top):
        across = above[:-1] + np.where((wide[i : i + width] == a[top + i]) & real[i : i + width], MATCH, CHANGE)
        down = above[1:] + CHANGE
        row = np.maximum(np.maximum(across, down), 0)
        row = np.maximum.accumulate(row + slope) - slope
        ways[i] = np.where(row == 0, 0, np.where(row == across, 1, np.where(row == down, 2, 3)))
        above[:-1] = row
        peak = int(row.argmax())
        if row[peak] > best:
            best, at = int(row[peak]), (i, peak)
    steps = []
    i, k = at
    while best and i >= 0 and 0 <= k < width and ways[i, k]:
        way = ways[i, k]
        if way == 1:
            steps.append((top + i, begin + i + k))
            i -= 1
        elif way == 2:
            steps.append((top + i, -1))
            i, k = i - 1, k + 1
        else:
            steps.append((-1, begin + i + k))
            k -= 1
    steps.reverse()
    return _extended(steps, len(a), len(b))


def _extended(steps: list[tuple[int, int]], n: int, m: int) -> list[tuple[int, int]]:
    """The steps with word pairs added at both ends: an alignment stops before a changed word that
    is near its end, and a stretch may go on beyond it."""
    whole = [s for s in steps if s[0] >= 0 and s[1] >= 0]
    if not whole:
        return steps
    (i, j), (k, l) = whole[0], whole[-1]
    before = [(i - d, j - d) for d in range(min(i, j, MIN_WORDS), 0, -1)]
    after = [(k + d, l + d) for d in range(1, min(n - 1 - k, m - 1 - l, MIN_WORDS) + 1)]
    return before + steps[steps.index(whole[0]) : len(steps) - steps[::-1].index(whole[-1])] + after


def _stretch(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]], least: int) -> tuple[int, int] | None:
    """(words, changed) of the longest stretch of at least ``least`` words of ``a``, whole at both
    ends, in which at most one word in ten is changed, left out or put in.

    With the value words - 10 x changes before every step, a stretch is good if the value does not
    fall over it; the first good begin for an end stands among the falling minima of the values."""
    if not steps:
        return None
    word = np.array([x >= 0 for x, _ in steps], np.int64)
    changed = np.array([x < 0 or y < 0 or a[x] != b[y] for x, y in steps], np.int64)
    words, changes = np.concatenate(([0], word.cumsum())), np.concatenate(([0], changed.cumsum()))
    value = words - PER_CHANGE * changes
    begins = np.flatnonzero(changed == 0)
    if not len(begins):
        return None
    ends = begins + 1
    falls = np.minimum.accumulate(value[begins])
    low = begins[np.concatenate(([True], falls[1:] < falls[:-1]))]
    first = np.searchsorted(-value[low], -value[ends], side="left")
    ok = first < len(low)
    begin, end = low[np.minimum(first, len(low) - 1)], ends
    length, edits = words[end] - words[begin], changes[end] - changes[begin]
    ok &= (begin < end) & (length >= least)
    if not ok.any():
        return None
    at = int(np.where(ok, length * (len(steps) + 1) - edits, -1).argmax())
    return int(length[at]), int(edits[at])


def _bands(spots: np.ndarray, places: np.ndarray, slack: int, reach: int) -> Iterator[tuple[int, int, int, int]]:
    """(top, bottom, low, high): rows and diagonals in which equal seeds lie together.

    The seeds of one leak differ by no more diagonals than words were put in or left out, and
    stand no further apart than a stretch without a whole seed can be."""
    diagonal = spots - places
    order = np.argsort(diagonal, kind="stable")
    for near in np.split(order, np.flatnonzero(np.diff(diagonal[order]) > slack) + 1):
        near = near[np.argsort(spots[near], kind="stable")]
        for part in np.split(near, np.flatnonzero(np.diff(spots[near]) > reach) + 1):
            yield int(places[part].min()), int(places[part].max()), int(diagonal[part].min()), int(diagonal[part].max())


def best_leak(passage: np.ndarray, codes: np.ndarray) -> tuple[int, int] | None:
    """(words, changed) of the longest stretch of the passage in the document's codes, if any."""
    n = len(passage)
    least, need = min(MIN_WORDS, n), needed_seeds(n)
    own, theirs = seeds_of(passage), seeds_of(codes)
    if not len(own) or not len(theirs):
        return None
    order = np.argsort(own, kind="stable")
    low, high = np.searchsorted(own[order], theirs, "left"), np.searchsorted(own[order], theirs, "right")
    span = high - low
    hit = np.flatnonzero(span)
    if not len(hit):
        return None
    slack, reach = max(2, n // PER_CHANGE), max(MIN_WORDS, n // 2)
    if span.sum() > MANY_HITS:
        bands = iter([(0, n - 1, int(hit[0]) - n, int(hit[-1]))])
    else:
        span = span[hit]
        where = np.repeat(low[hit] - np.concatenate(([0], span.cumsum()[:-1])), span) + np.arange(span.sum())
        spots, places = np.repeat(hit, span), order[where]
        if len(np.unique(places)) < need:
            return None
        bands = _bands(spots, places, slack, reach)
    best = None
    for top, bottom, left, right in bands:
        top, bottom = max(0, top - reach), min(n, bottom + SEED + reach)
        left, right = left - slack, right + slack
        # wide bands are aligned in parts that overlap by all the diagonals one leak can need
        for part in range(left, max(left + 1, right - 2 * slack + 1), 2 * slack):
            got = _best_in(passage, codes, (top, bottom, part, min(right, part + 4 * slack)), least, need)
            if got is not None:
                best = max(best or (0, 0), got, key=lambda x: (x[0], -x[1]))
    return best


def _best_in(passage: np.ndarray, codes: np.ndarray, band: tuple[int, int, int, int], least: int, need: int) -> tuple[int, int] | None:
    region = codes
    while True:
        steps = _aligned(passage, region, *band)
        same = [y for x, y in steps if x >= 0 and y >= 0 and passage[x] == region[y]]
        if len(same) < need + SEED - 1:
            return None
        got = _stretch(passage, region, steps, least)
        if got is not None:
            return got
        region = region.copy()
        region[same] = ~region[same]  # aligned, but not a leak: look elsewhere


def build_index(passages: list[tuple[object, str]]) -> list[tuple[object, np.ndarray]]:
    return [(item, codes) for item, codes in ((i, word_codes(t)) for i, t in passages) if len(codes) >= SEED]


def find_leaks(index: list[tuple[object, np.ndarray]], text: str) -> list[tuple[object, int, int]]:
    """(item, words, changed) of every item of which ``text`` contains a stretch; the operator's
    check of one pair, without its join."""
    codes = word_codes(text)
    got = ((item, best_leak(passage, codes)) for item, passage in index)
    return [(item, *leak) for item, leak in got if leak is not None]


def passages_of(items: DataFrame, shared_by: int | None = BOILERPLATE_ITEMS) -> DataFrame:
    """item, text: items without the lines that ``shared_by`` or more of them share (None: whole).

    An item that has no line of its own keeps all its lines: a passage that several suites hold
    is no instruction."""
    rows = items.where("item is not null and text is not null").select("item", "text")
    if shared_by is None:
        return rows
    lines = rows.select("item", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line")).withColumn("bare", F.lower(F.trim("line")))
    shared = lines.where("bare <> ''").groupBy("bare").agg(F.count_distinct("item").alias("n")).where(F.col("n") >= shared_by)
    marked = lines.join(shared.select(F.col("bare").alias("b")), F.col("bare") == F.col("b"), "left")
    by = marked.groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("no", "line", F.col("b").isNotNull().alias("common")))).alias("all"),
        F.bool_or(F.col("b").isNull() & (F.col("bare") != "")).alias("own"),
    )
    kept = F.filter("all", lambda x: ~F.col("own") | ~x["common"])
    return by.select("item", F.concat_ws("\n", F.transform(kept, lambda x: x["line"])).alias("text"))


def _coded(key: str, keep):
    """A function over batches of (key, text): key, words, codes and the kept seeds of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, words, coded, seeds = [], [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                codes = word_codes(text) if text else None
                kept = keep(seeds_of(codes)) if codes is not None and len(codes) >= SEED else None
                if kept is not None:
                    row.append(n)
                    words.append(len(codes))
                    coded.append(codes.tobytes())
                    seeds.append(kept.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(row, pa.int64())), pa.array(words, pa.int32()), pa.array(coded, pa.binary()), pa.array(seeds, pa.list_(pa.int64())),
                ],
                names=[key, "words", "codes", "seeds"],
            )

    return run


def _slots(seeds: np.ndarray, log2: int) -> np.ndarray:
    return seeds >> np.uint64(64 - log2)


def _seed_filter(places: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the slots that seeds fall into, and the logarithm of their number.

    As large as the seeds ask for and never beyond 2**FILTER_LOG2 bits: a fuller filter lets more
    seeds pass, and none is lost. The executors build it in pieces of 4 KB."""
    log2 = min(FILTER_LOG2, max(15, int(places.count() * FILTER_BITS).bit_length()))
    slot = F.shiftrightunsigned("seed", 64 - log2)
    pieces = places.groupBy(F.shiftright(slot, 15).alias("piece")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros(1 << (log2 - 3), np.uint8)
    for r in pieces.collect():  # at most 2**(FILTER_LOG2 - 15) pieces
        bits[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits, log2


def _align_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, got = [], []
        for n, (passage, codes) in enumerate(zip(batch.column("passage").to_pylist(), batch.column("codes").to_pylist(), strict=True)):
            leak = best_leak(np.frombuffer(passage, np.uint64), np.frombuffer(codes, np.uint64))
            if leak is not None:
                row.append(n)
                got.append(leak)
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("document").take(take), batch.column("item").take(take), *[pa.array([g[k] for g in got], pa.int32()) for k in (0, 1)]],
            names=["document", "item", "words", "changed"],
        )


def leaked_items(documents: DataFrame, items: DataFrame, shared_by: int | None = BOILERPLATE_ITEMS) -> DataFrame:
    """document, item, words, changed for every document with a stretch of an item's passage.

    documents: document (unique), text; items: item (unique), text. A stretch is MIN_WORDS or more
    consecutive words of the passage (all of a shorter one), the first and the last of them whole,
    of which at most one in ten is changed, left out or put in. Null ids and texts, and texts of
    fewer than SEED words, give no rows. shared_by: see ``passages_of``.

    One pass over the corpus, whatever the number of items, keeps the documents with enough seeds
    in a filter of bounded size. Of every two neighbouring seeds of a passage the rarer one in
    the corpus is joined to them: 20 words hold three of these without a common word, so two
    changes leave one whole (passages under 20 words join all of theirs). Pairs that share as many
    seeds as a leak keeps are aligned.
    """
    kind = documents.schema["document"].dataType.simpleString()
    item_kind = items.schema["item"].dataType.simpleString()
    columns = "words int, codes binary, seeds array<bigint>"
    passages = cut(passages_of(items, shared_by).mapInArrow(_coded("item", lambda s: s), f"item {item_kind}, {columns}"))
    places = passages.select("item", "words", F.posexplode("seeds").alias("place", "seed"))
    bits, log2 = _seed_filter(places.select("seed").distinct())
    sizes = [needed_seeds(r["words"]) for r in passages.select(F.least("words", F.lit(MIN_WORDS)).alias("words")).distinct().collect()]
    shared, enough = documents.sparkSession.sparkContext.broadcast(bits), min(sizes, default=1)

    def passing(seeds: np.ndarray) -> np.ndarray | None:
        slot = _slots(seeds, log2)
        known = (shared.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
        return np.unique(seeds[known.astype(bool)]) if int(known.sum()) >= enough else None

    texts = documents.where("document is not null").select("document", "text")
    near = cut(texts.mapInArrow(_coded("document", passing), f"document {kind}, {columns}"))
    met = near.select("document", F.explode("seeds").alias("seed"))
    rarity = met.groupBy("seed").agg(F.count("*").alias("documents"))
    slot = F.when(F.col("words") < MIN_WORDS, F.col("place")).otherwise(F.floor(F.col("place") / 2))
    rated = places.join(rarity.withColumnRenamed("seed", "r"), F.col("seed") == F.col("r"), "left")
    probes = rated.groupBy("item", slot.alias("slot")).agg(F.min_by("seed", F.struct(F.coalesce("documents", F.lit(0)), "place")).alias("seed"))
    pairs = met.join(probes.select("item", "seed").distinct(), "seed").select("document", "item").distinct()
    # a pair needs as many seeds as any leak keeps; a seed may stand several times in a passage
    often = places.groupBy("item", "seed").agg(F.count("*").alias("c")).groupBy("item").agg(F.max("c").alias("often"))
    facts = passages.join(often, "item").select("item", "often", F.col("seeds").alias("own"), _needed(F.col("words")).alias("need"))
    close = pairs.join(near.select("document", "seeds"), "document").join(facts, "item").where(F.size(F.array_intersect("own", "seeds")) * F.col("often") >= F.col("need"))
    close = few(close.select("document", "item"))
    both = near.select("document", "codes").join(close, "document").join(passages.select("item", F.col("codes").alias("passage")), "item")
    return both.mapInArrow(_align_pairs, f"document {kind}, item {item_kind}, words int, changed int")
