"""Credentials in source and configuration (problem 5): a CRF labels tokens, Viterbi spans mask them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from codeloom.llm.crf import Crf, train
from codeloom.llm.secret_lines import _REACH, Forms, all_lines, contexts, described, follower, lex, read_lines, spelled, start, step
from codeloom.llm.secret_training import labelled_texts

_PEM_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_CONTINUES = re.compile(r"[+\\]\s*$")
#: Contexts of tokens, and lines as the features see them, whose results are kept; beyond, they are
#: worked out anew.
_MEMO = 200_000
_UNKNOWN: list[int] = []


@lru_cache(maxsize=1)
def secret_model() -> Crf:
    """The model fitted on the labelled lines; the same in every process that fits it."""
    return fit(labelled_texts())


def fit(texts: list[tuple[str, list[tuple[int, int]]]]) -> Crf:
    """A model of (text, spans of secret characters)."""
    sequences, labels = [], []
    for text, spans in texts:
        for line in read_lines(text):
            if not line.tokens:
                continue
            sequences.append(line.features)
            labels.append(
                [
                    int(any(a < line.offset + t.begin + len(t.text) and line.offset + t.begin < b for a, b in spans) and t.kind not in ("mark", "op"))
                    for t in line.tokens
                ]
            )
    return train(sequences, labels)


class _Known(dict):
    """A state within a line; to a token and what follows it, its score and the next state."""

    def __init__(self, state: tuple) -> None:
        super().__init__()
        self.state = state


class Labeller:
    """The model with what it has worked out so far: lines that look the same to all features have
    the same labels, so most lines are only looked up, and the tokens of others mostly follow
    states that are known. Every line is labelled, whatever it holds."""

    def __init__(self, model: Crf) -> None:
        self.model, self.forms = model, Forms()
        self.kinds: list[tuple] = []  # of forms.kinds, by number
        self.following: list[str] = []
        self.scores: dict[tuple, tuple[float, ...]] = {}
        self.states: dict[tuple, _Known] = {}
        self.steps = 0
        self.lines: dict[tuple, list[int] | None] = {}

    def _score(self, context: tuple) -> tuple[float, ...]:
        score = self.scores.get(context)
        if score is None:
            score = self.model.score(spelled(context))
            if len(self.scores) < _MEMO:
                self.scores[context] = score
        return score

    def _learn(self, known: _Known, token: int, following: str) -> tuple[tuple[float, ...], _Known]:
        # on a line within reach, what a name tells holds to its end, so places don't matter
        context, state = step(known.state, self.kinds[token], following, 0)
        after = self.states.get(state)
        if after is None:
            after = self.states[state] = _Known(state)
        known[token, following] = found = self._score(context), after
        self.steps += 1
        return found

    def _short(self, tokens: list[int], before: str) -> list[int]:
        """The labels of the tokens of a line that is shorter than a name's reach."""
        if self.steps >= _MEMO:
            self.states, self.steps = {}, 0
        if len(self.kinds) < len(self.forms.kinds):
            new = list(self.forms.kinds)[len(self.kinds) :]
            self.kinds += new
            self.following += map(follower, new)
        state = start(before)
        known = self.states.get(state)
        if known is None:
            known = self.states[state] = _Known(state)
        following = [self.following[t] for t in tokens[1:]]
        following.append("$")
        out = []
        for key in zip(tokens, following):
            found = known.get(key)
            if found is None:
                found = self._learn(known, *key)
            score, known = found
            out.append(score)
        return self.model.path(out)

    def labels(self, line: str, before: str) -> list[int] | None:
        """A label for each token of the line; None if none is a secret's."""
        if len(line) >= _REACH:
            tokens = lex(line)
            got = self.model.path(map(self._score, contexts([described(t) for t in tokens], before, [t.begin for t in tokens])))
            return got if any(got) else None
        numbers = self.forms.of(line)
        key = (before, numbers)
        result = self.lines.get(key, _UNKNOWN)
        if result is _UNKNOWN:
            got = self._short(self.forms.tokens(numbers), before)
            result = got if any(got) else None
            if len(self.lines) < _MEMO:
                self.lines[key] = result
        return result


#: The labeller of this process, by the model's broadcast: tasks of one process share what is kept.
_OWN: dict[int, Labeller] = {}


def _own_labeller(shared: Broadcast) -> Labeller:
    key = id(shared.value)  # a process reads a broadcast once, and the labeller keeps it
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Labeller(shared.value)
    return _OWN[key]


def secret_spans(text: str, model: Crf | Labeller) -> list[tuple[int, int, int]]:
    """(line number, begin, end) of the literal characters of every secret in ``text``.

    A private key runs from the line after its BEGIN mark to its END mark, and its place is the
    line of the mark. The later parts of a literal that is joined over lines have no place of
    their own; the line number is then that of the first part.
    """
    labeller = model if isinstance(model, Labeller) else Labeller(model)
    out: list[tuple[int, int, int]] = []
    closed_at = -1
    for line_no, offset, line, before in all_lines(text):
        labels = labeller.labels(line, before)
        if labels is None:
            continue
        for token, label in zip(lex(line), labels, strict=True):
            begin = offset + token.begin
            if not label or begin < closed_at:
                continue
            if token.kind == "pem":
                if "BEGIN" not in token.text:
                    continue
                end = _PEM_END.search(text, begin)
                stop = end.start() if end else len(text)
                out.append((line_no, begin + len(token.text), stop))
                closed_at = end.end() if end else len(text)
                continue
            number = line_no
            if out and out[-1][0] < number and _CONTINUES.search(text[out[-1][2] : begin].split("\n")[0].strip("\"'` ")) and text.count("\n", out[-1][2], begin) == 1:
                number = out[-1][0]
            out.append((number, begin, begin + len(token.text)))
    return out


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with the characters of the spans as asterisks; white space and escapes of line ends
    stay, so every line keeps its place and length."""
    out, at = [], 0
    for _, begin, end in sorted(spans, key=lambda s: s[1]):
        out.append(text[at:begin])
        out.append(re.sub(r"\\n|\s|.", lambda m: m.group() if m.group() == "\\n" or m.group().isspace() else "*", text[max(begin, at) : end], flags=re.S))
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """chunk, updated_at, places, redacted: a row for every row that holds a secret.

    chunks: chunk, updated_at, content. places are line_no (from 1 within the content, split at
    LF), begin and end (offsets of the literal characters); redacted is the whole content with all
    its secrets masked (null without ``with_text``). Null and empty contents give no rows.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(secret_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _own_labeller(shared)
        place = pa.struct([("line_no", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            row, places, clean = [], [], []
            for n, text in enumerate(batch.column("content").to_pylist()):
                spans = secret_spans(text, labeller) if text else []
                if spans:
                    row.append(n)
                    places.append([dict(zip(("line_no", "begin", "end"), s, strict=True)) for s in spans])
                    clean.append(masked(text, spans) if with_text else None)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk").take(take), batch.column("updated_at").take(take), pa.array(places, pa.list_(place)), pa.array(clean, pa.string())],
                names=["chunk", "updated_at", "places", "redacted"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    return chunks.select("chunk", "updated_at", "content").mapInArrow(
        run, f"chunk {kinds['chunk']}, updated_at {kinds['updated_at']}, places array<struct<line_no:int,begin:int,end:int>>, redacted string"
    )
