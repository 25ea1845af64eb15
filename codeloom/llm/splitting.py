"""Splitting oversized items at natural boundaries (problem 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT = 2_000
OVERLAP = 200

#: A rule gives a boundary before the line that it matches. Stronger boundaries first.
_LINE_RULES = {
    "ast": [
        (9, re.compile(r"(?:export |public |private |protected |static |async |abstract )*(?:def|class|func|function|interface|enum|type)\b|@\w")),
        (6, re.compile(r"\s{2,8}(?:(?:export |public |private |protected |static |async |abstract )*(?:def|class|func|function)\b|/\*\*|@\w)")),
    ],
    "resource": [(9, re.compile(r"\[|---|[A-Za-z_\"'][^:=\s]*\s*[:=]"))],
    "infra": [(9, re.compile(r"FROM\b|(?:RUN|COPY|ENV|ARG|ADD|CMD|ENTRYPOINT|LABEL|USER|WORKDIR|EXPOSE)\b"))],
    "raw_text": [(9, re.compile(r"#{1,6} |=+\s|(?:---|\*\*\*|___)\s*$")), (5, re.compile(r"\s*(?:[-*+]|\d+[.)]) |```"))],
}
_AFTER_BLANK = 7
_ANY_LINE = 2
_SENTENCE = re.compile(r"(?<=[.!?;])[ \t]+|(?<=[{};,])(?=\S)|(?<=[\])])(?=\S)")
_WORD = re.compile(r"\s+")


def _boundaries(text: str, kind: str) -> tuple[list[int], list[int]]:
    """Offsets where a piece may begin and how strong each is, for cuts between lines."""
    rules = _LINE_RULES.get(kind, _LINE_RULES["raw_text"])
    at, strength = [], []
    begin, blank = 0, False
    for line in _lf_lines(text):
        bare = line.strip()
        if begin and bare:
            power = next((p for p, rule in rules if rule.match(line)), _ANY_LINE)
            if blank:
                power = max(power, _AFTER_BLANK) + (power > _ANY_LINE)
            elif power == _ANY_LINE and kind == "ast":
                power = 4 - min(2, (len(line) - len(line.lstrip())) // 4)
            at.append(begin)
            strength.append(power)
        blank = not bare
        begin += len(line)
    return at, strength


def _lf_lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _inside(text: str, low: int, high: int, target: int) -> int:
    """The best cut in (low, high] of a stretch without line ends: after a sentence or a mark near
    the target, else at white space, else at the target itself."""
    for rule in (_SENTENCE, _WORD):
        best = None
        for m in rule.finditer(text, low + 1, high):
            if best is None or abs(m.end() - target) < abs(best - target):
                best = m.end()
        if best is not None and low < best <= high:
            return best
    return min(max(target, low + 1), high)


def split_points(text: str, kind: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) offsets of pieces of at most ``limit`` characters that cover ``text``.

    The least number of pieces gives equal-length targets; each is snapped to the strongest line
    boundary near it, or inside a line if there is none within reach. If a piece would still
    exceed the limit, the number of pieces grows by one and the targets are placed anew. A piece
    begins up to ``overlap`` characters before the end of the last one, at a line start if one is
    within reach, else at white space; it shares nothing where neither is.
    """
    size = len(text)
    if size <= limit:
        return [(0, size)]
    at, strength = _boundaries(text, kind)
    room = limit - overlap
    count = 1 + -(-(size - limit) // room)
    while True:
        cuts = _snapped(text, at, strength, count, room, limit)
        if cuts is not None:
            break
        count += 1
    pieces, end_before = [], 0
    for end in [*cuts, size]:
        begin = _overlap_begin(text, at, end_before, pieces[-1][0] if pieces else 0, overlap) if pieces else 0
        begin = max(begin, end - limit)
        pieces.append((begin, end))
        end_before = end
    return pieces


def _snapped(text: str, at: list[int], strength: list[int], count: int, room: int, limit: int) -> list[int] | None:
    size, cuts, last, k = len(text), [], 0, 0
    for i in range(1, count):
        left = count - i
        # from here the rest must fit: no earlier than size - left * room, no later than last + room
        low, high = max(last + 1, size - left * room), last + (room if cuts else limit)
        high = min(high, size - 1)
        if low > high:
            return None
        target = min(max(last + (size - last) // (left + 1), low), high)
        reach = max(room // 3, 1)
        best, best_score = None, None
        while k < len(at) and at[k] < low:
            k += 1
        j = k
        while j < len(at) and at[j] <= high:
            gap = abs(at[j] - target)
            score = strength[j] - 8.0 * gap / reach
            if best is None or score > best_score:
                best, best_score = at[j], score
            j += 1
        cut = best if best is not None else _inside(text, low - 1, high, target)
        cuts.append(cut)
        last = cut
    return cuts if size - last <= room else None


def _overlap_begin(text: str, at: list[int], end: int, floor: int, overlap: int) -> int:
    """Where the piece after ``end`` begins: at most ``overlap`` before it and after ``floor``."""
    from bisect import bisect_left

    low = max(end - overlap, floor + 1, 0)
    i = bisect_left(at, low)
    if i < len(at) and at[i] < end:
        return at[i]
    m = _WORD.search(text, low, end)
    return m.end() if m and m.end() < end else end


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("item", "piece_no", "pieces", "line_start", "line_end", "begin", "cut_kind", "content")}
            for row in batch.to_pylist():
                text = row["content"]
                parts = split_points(text, row["kind"] or "raw_text", limit, overlap)
                long_line = any(len(x[:-1] if x.endswith("\r") else x) > limit for x in text.split("\n"))
                first, line, pos = row["line_start"] or 1, 0, 0
                for no, (begin, end) in enumerate(parts):
                    line += text.count("\n", pos, begin)
                    pos = begin
                    last = line + text.count("\n", begin, max(begin, end - 1))
                    for c, v in zip(out, (row["item"], no, len(parts), first + line, first + last, begin, "inside_line" if long_line else "between_lines", text[begin:end]), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["item"], batch.schema.field("item").type),
                    *[pa.array(out[c], pa.int32()) for c in ("piece_no", "pieces", "line_start", "line_end", "begin")],
                    pa.array(out["cut_kind"], pa.string()),
                    pa.array(out["content"], pa.string()),
                ],
                names=list(out),
            )

    return run


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """item, piece_no, pieces, line_start, line_end, begin, cut_kind, content of oversized items.

    items: item, content, kind, line_start. Items of at most ``limit`` code points and null
    contents give no rows. Lines are counted from the item's line_start (1 if null); a line end
    belongs to its line. cut_kind is ``inside_line`` if a line alone exceeds the limit (line ends
    not counted), else ``between_lines``. Text between ``begin`` of a piece and that of the next
    is never lost, so the pieces rebuild the content exactly.
    """
    import pyspark.sql.functions as F

    large = items.where(F.char_length("content") > limit)
    kind = large.schema["item"].dataType.simpleString()
    return large.select("item", "content", "kind", F.col("line_start").cast("int").alias("line_start")).mapInArrow(
        _pieces(limit, overlap),
        f"item {kind}, piece_no int, pieces int, line_start int, line_end int, begin int, cut_kind string, content string",
    )
