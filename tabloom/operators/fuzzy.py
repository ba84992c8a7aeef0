"""Similarity of texts by longest common subsequence, as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=65536)
def ratio(a: str, b: str) -> float:
    """200 * lcs / (len(a) + len(b)); 100 for two empty texts. Bits of one integer hold a row of the table."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@lru_cache(maxsize=4096)
def _letters(text: str) -> dict[int, None]:
    """For str.translate: leaves out the letters of the text."""
    return dict.fromkeys(map(ord, text))


def _common(a: str, b: str) -> int:
    """No common subsequence is longer: the letters of `a` that `b` has, at most as many as `b` has in all."""
    return min(len(b), len(a) - len(a.translate(_letters(b))))


def _ratio(a: str, b: str, least: float = 0.0) -> float:
    """The ratio; 0 stands for what can't reach `least`."""
    if a and b and 200.0 * _common(a, b) / (len(a) + len(b)) < least:
        return 0.0
    return ratio(a, b)


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter text with a stretch of its length in the longer one, stretches cut off at the ends included; 0 stands for what can't reach `least`."""
    if len(a) == len(b):
        return max(_partial(a, b, least), _partial(b, a, least))
    return _partial(a, b, least) if len(a) < len(b) else _partial(b, a, least)


def _partial(short: str, long: str, least: float) -> float:
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    c = min(_common(long, short), n - 1)  # a stretch of fewer letters has no more in common than it has
    if 200.0 * c / (n + c) < least:
        return 0.0
    for end in range(1, len(long) + n):
        best = max(best, ratio(short, long[max(0, end - n) : end]))
    return best


def token_ratio(a: str, b: str, of=ratio, least: float = 0.0) -> float:
    """The best of sorted words and of shared words against each text's own words; 100 if one holds all words of the other. 0 stands for what can't reach `least`."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (of is partial_ratio or x <= y or y <= x):
        return 100.0
    near = _ratio if of is ratio else of
    both, left, right = (" ".join(sorted(w)) for w in (shared, x - y, y - x))
    scores = [near(" ".join(sorted(a.split())), " ".join(sorted(b.split())), least), near(f"{both} {left}".strip(), f"{both} {right}".strip(), least)]
    if both:
        scores += [near(both, f"{both} {left}", least), near(both, f"{both} {right}", least)]
    return max(scores)


def weighted_ratio(a: str, b: str, least: float = 0.0) -> float:
    """0 to 100: the best of whole, word and, where one text is 1.5 times as long or more, partial similarity, each with its weight.

    A score below `least` need not be worked out: a lower one may stand for it. Letters in common bound each part from above, so that most pairs need no subsequence.
    """
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    scale = 1.0 if times < 1.5 else 0.9 if times <= 8 else 0.6
    best = _ratio(a, b, least)
    need = lambda weight: max(best, least) / weight - 1e-9  # noqa: E731 - a little less than is needed: the division rounds
    if times >= 1.5 and scale * 100.0 >= max(best, least):
        best = max(best, scale * partial_ratio(a, b, need(scale)))
    weight = 0.95 * scale
    if weight * 100.0 >= max(best, least):
        best = max(best, weight * token_ratio(a, b, ratio if times < 1.5 else partial_ratio, need(weight)))
    return best


def best_term(title: Column, terms: list[str], threshold: float = 90.0) -> Column:
    """struct(term, score) of the best of a short list of terms by weighted ratio at or above the threshold, the first on a tie; else null.

    Equal titles of a task are scored once as long as they are among the last 65,536 different ones; a term is scored as far as it can beat those before it.
    """
    kind = T.StructType().add("term", "string").add("score", "double")
    low = [t.lower() for t in terms]

    def best(x: str) -> tuple[str | None, float | None]:
        k, most = -1, threshold
        for i, t in enumerate(low):
            score = weighted_ratio(x, t, most)
            if score > most or (k < 0 and score >= most):
                k, most = i, score
        return (terms[k], most) if k >= 0 else (None, None)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = lru_cache(maxsize=65536)(best)
        for s in batches:
            yield pd.DataFrame([(None, None) if x is None else known(x.lower()) for x in s], columns=["term", "score"])

    return run.asNondeterministic()(title)  # a filter on the score would be moved below and score all once more


def match_lists(reference: list[str], candidate: list[str], threshold: float = 85.0) -> list[tuple[int, int, float]] | None:
    """Each reference text takes the best unused candidate at or above the threshold; null with fewer than two."""
    free, out = dict(enumerate(candidate)), []
    for r, x in enumerate(reference):
        scored = [(ratio(x.lower(), y.lower()), -c) for c, y in free.items()]
        if scored and max(scored)[0] >= threshold:
            score, c = max(scored)
            out.append((r, -c, score))
            del free[-c]
    return out if len(out) >= 2 else None


def suggestions(asked: Column, labels: list[str], most: int = 5, above: float = 50.0) -> Column:
    """array of struct(label, score): the best labels by ratio over `above`, best first, ties in the labels' order; empty for null."""
    low = [x.lower() for x in labels]

    @F.pandas_udf("array<struct<label:string,score:double>>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            scored = sorted(((-ratio(x.lower(), y), i) for i, y in enumerate(low)) if x else [])
            out.append([{"label": labels[i], "score": -v} for v, i in scored[:most] if -v > above])
        return pd.Series(out, dtype=object)

    return run(asked)
