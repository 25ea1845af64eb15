"""A linear-chain conditional random field over sparse binary features, in numpy."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """Weights of features by label, of transitions, and of labels that begin a sequence."""

    table: dict[str, tuple[float, ...]]
    transitions: list[list[float]]
    begin: list[float]

    def score(self, features: list[str]) -> tuple[float, ...]:
        """A token's score by label; features never seen weigh nothing."""
        rows = [w for w in map(self.table.get, features) if w is not None]
        return tuple(map(sum, zip(*rows, strict=True))) if rows else (0.0,) * len(self.begin)

    def viterbi(self, sequence: list[list[str]]) -> list[int]:
        """The likeliest labels of a sequence of tokens' features."""
        return self.path(map(self.score, sequence))

    def path(self, scores: Iterable[tuple[float, ...]]) -> list[int]:
        """The likeliest labels of a sequence of tokens' scores."""
        if len(self.begin) == 2:
            return self._path_of_two(scores)
        states = range(len(self.begin))
        into = [[row[y] for row in self.transitions] for y in states]
        best: list[float] = []
        back: list[tuple[int, ...]] = []
        for score in scores:
            if not best:
                best = [b + s for b, s in zip(self.begin, score, strict=True)]
                continue
            step, pointers = [], []
            for y in states:
                ways = [b + t for b, t in zip(best, into[y])]
                top = max(ways)
                step.append(top + score[y])
                pointers.append(ways.index(top))
            best = step
            back.append(tuple(pointers))
        if not best:
            return []
        labels = [max(states, key=best.__getitem__)]
        for pointers in reversed(back):
            labels.append(pointers[labels[-1]])
        return labels[::-1]


    def _path_of_two(self, scores: Iterable[tuple[float, ...]]) -> list[int]:
        """``path`` for two labels, without inner loops."""
        (t00, t01), (t10, t11) = self.transitions
        back = []
        no = yes = None
        for s0, s1 in scores:
            if no is None:
                no, yes = self.begin[0] + s0, self.begin[1] + s1
                continue
            from_no, from_yes = no + t01, yes + t11
            stay, leave = no + t00, yes + t10
            left, held = leave > stay, from_yes > from_no
            back.append((left, held))
            no, yes = (leave if left else stay) + s0, (from_yes if held else from_no) + s1
        if no is None:
            return []
        at = yes > no
        out = [int(at)]
        for step in reversed(back):
            at = step[at]
            out.append(int(at))
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def train(sequences: list[list[list[str]]], labels: list[list[int]], states: int = 2, rounds: int = 200, l2: float = 1e-4, rate: float = 0.3) -> Crf:
    """Weights of greatest likelihood (with an L2 penalty) by full-batch Adam; deterministic."""
    index: dict[str, int] = {}
    flat: list[int] = []
    seen: dict[tuple[str, ...], int] = {}
    # sequences that look the same are one with a weight
    alike: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
    for sequence, gold_labels in zip(sequences, labels, strict=True):
        key = (tuple(seen.setdefault(tuple(features), len(seen)) for features in sequence), tuple(gold_labels))
        alike[key] = alike.get(key, 0) + 1
    unique = sorted(alike, key=lambda k: -len(k[0]))
    weight = np.array([float(alike[k]) for k in unique])
    labels = [list(k[1]) for k in unique]
    rows = np.array([r for k in unique for r in k[0]])
    for features in seen:
        flat += [index.setdefault(f, len(index)) for f in features]
    sizes = [len(features) for features in seen]
    ids, counts = np.array(flat), np.array(sizes)
    starts = np.concatenate(([0], counts.cumsum()[:-1]))
    lengths = np.array([len(k[0]) for k in unique])
    n, longest, total_weight = len(unique), int(lengths.max()), weight.sum()
    going = [int((lengths > t).sum()) for t in range(longest)]  # the longest come first
    where = np.full((n, longest), -1)
    where[np.arange(longest)[None, :] < lengths[:, None]] = np.arange(len(rows))
    mask = where >= 0
    log_weight = np.log(weight)
    gold = np.zeros((n, longest, states))
    for i, y in enumerate(labels):
        gold[i, np.arange(len(y)), y] = 1
    gold_pairs = np.einsum("n,nta,ntb->ab", weight, gold[:, :-1] * mask[:, 1:, None], gold[:, 1:])
    params = [np.zeros((len(index), states)), np.zeros((states, states)), np.zeros(states)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for k in range(1, rounds + 1):
        weights, trans, begin = params
        token_scores = np.add.reduceat(weights[ids], starts, axis=0)[rows]
        scores = np.where(mask[:, :, None], token_scores[where], 0.0)
        forward = np.zeros((n, longest, states))
        forward[:, 0] = begin + scores[:, 0]
        for t in range(1, longest):
            m = going[t]
            forward[:m, t] = _logsum(forward[:m, t - 1, :, None] + trans, 1) + scores[:m, t]
        backward = np.zeros((n, longest, states))
        for t in range(longest - 2, -1, -1):
            m = going[t + 1]
            backward[:m, t] = _logsum(trans + (scores[:m, t + 1] + backward[:m, t + 1])[:, None, :], 2)
        total = _logsum(forward[np.arange(n), lengths - 1], 1)
        marginal = np.exp(np.where(mask[:, :, None], forward + backward - total[:, None, None], -np.inf))
        pairs = np.zeros((states, states))
        for t in range(longest - 1):
            m = going[t + 1]
            pairs += np.exp(forward[:m, t, :, None] + trans + (scores[:m, t + 1] + backward[:m, t + 1])[:, None, :] - total[:m, None, None] + log_weight[:m, None, None]).sum(0)
        surplus = ((marginal - gold) * weight[:, None, None])[mask]
        by_row = [np.bincount(rows, surplus[:, y], len(seen)) for y in range(states)]
        grads = [
            np.stack([np.bincount(ids, np.repeat(by_row[y], counts), len(index)) for y in range(states)], 1),
            pairs - gold_pairs,
            ((marginal[:, 0] - gold[:, 0]) * weight[:, None]).sum(0),
        ]
        for p, g, moment in zip(params, grads, moments, strict=True):
            g = g / total_weight + l2 * p
            moment[0] = 0.9 * moment[0] + 0.1 * g
            moment[1] = 0.99 * moment[1] + 0.01 * g * g
            p -= rate * (moment[0] / (1 - 0.9**k)) / (np.sqrt(moment[1] / (1 - 0.99**k)) + 1e-8)
    weights, trans, begin = params
    return Crf({f: tuple(weights[k].tolist()) for f, k in index.items()}, trans.tolist(), begin.tolist())
