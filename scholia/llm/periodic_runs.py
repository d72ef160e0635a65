"""Runs of repeated words inside a document, by seed and extend along diagonals.

A run is a maximal stretch of words with smallest period q and at least ``max(6, 4 * q)``
words. Along its lag q at least ``max(6, 4 * q) - q`` consecutive words agree with the word
q further on; this is the overlap a run guarantees. Lags are taken in classes: one index of
k-grams serves the lags above k / 3 up to k, for k = 5, 15, 45, ..., and the least overlap
guaranteed in a class is k or more, so every run holds two equal k-grams at its lag. As
the k-gram is no shorter than the period, no equal one lies between these two: were there
one, the stretch would have a smaller period. Only neighbouring occurrences are therefore
enumerated, one pair an occurrence and never all pairs of a frequent k-gram, and a stretch
found this way has its lag as smallest period.

Pairs are extended both ways word by word. A table of the furthest word covered on each lag
skips the pairs that lie in a stretch already extended. K-grams are named exactly, by
pairing the names of shorter ones, so there is no hash to verify. The indexes end when no
k-gram of a size repeats: longer ones cannot either.

Work stays inside a document and needs about 60 bytes a word of it; many short documents
share the arrays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import text_udf

#: Fewest words of a run, and fewest repetitions of its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words that are searched together when documents are short.
BLOCK_WORDS = 200_000
#: Words compared at once when a pair is extended; doubled as long as they agree.
FIRST_STEP = 16

SCHEMA = ("struct<n_words: bigint, n_runs: bigint, start: bigint, length: bigint, period: bigint, "
          "runs: string, kept: string>")


def least_overlap(least_words: int, least_times: int) -> int:
    """Agreeing words that every run guarantees along its period, and periods up to it."""
    k = 1
    while all(max(least_words, least_times * q) - q >= k + 1 for q in range(1, k + 2)):
        k += 1
    return k


def classes(longest: int, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int]]:
    """(k, greatest lag served by smaller k) until the lags of ``longest`` words are served.

    For lags in (low, k] the overlap ``max(least_words, least_times * q) - q`` is k at least.
    """
    found, low, k = [], 0, least_overlap(least_words, least_times)
    while low * least_times < longest:
        found.append((k, low))
        low, k = k, max(k + 1, (least_times - 1) * k)
    return found


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dense names of pairs of names."""
    _, names = np.unique(left * (np.int64(right.max()) + 1) + right, return_inverse=True)
    return names.astype(np.int64, copy=False)


def _names(names: np.ndarray, size: int, wanted: int) -> np.ndarray:
    """Names of the ``wanted``-grams at every place, from those of ``size``-grams.

    A gram that reaches beyond the end has a name of its own, as has each gram that holds
    a separator.
    """
    while size < wanted:
        step = min(size, wanted - size)
        inner = _paired(names[:-step], names[step:]) if len(names) > step else names[:0]
        names = np.concatenate([inner, len(names) + np.arange(len(names) - len(inner))])
        size += step
    return names


def _stretch(words: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The maximal places [start, end) around ``at`` whose word agrees with the one ``lag`` on."""
    end, step = at, FIRST_STEP
    while end + lag < high:
        stop = min(end + step, high - lag)
        same = words[end:stop] == words[end + lag:stop + lag]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = stop, 2 * step
    start, step = at, FIRST_STEP
    while start > low:
        first = max(low, start - step)
        same = words[first:start] == words[first + lag:start + lag]
        if not same.all():
            start -= int(same[::-1].argmin())
            break
        start, step = first, 2 * step
    return start, end


def runs_of(words: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in documents laid end to end.

    ``words`` are word numbers from 0, ``bounds`` the first place of each document and the
    end. The last word of each document is a separator that occurs nowhere else.
    """
    found: list[tuple[int, int, int]] = []
    # documents that still matter: where each begins, and a dense copy of their names
    first_of, sizes, names, size = bounds[:-1], np.diff(bounds), words, 1
    for k, low in classes(int(sizes.max(initial=0)), least_words, least_times):
        names, size = _names(names, size, k), k
        order = np.argsort(names, kind="stable")
        again = np.flatnonzero(names[order[1:]] == names[order[:-1]])
        here, there = order[again], order[again + 1]
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, here, side="right")
        own = there < ends[doc]
        here, doc, lag = here[own], doc[own], (there - here)[own]
        near = (lag > low) & (lag <= k)
        place = here[near] + (first_of - (ends - sizes))[doc[near]]
        found += _extended(words, place, lag[near], first_of[doc[near]], (first_of + sizes)[doc[near]], max(least_words, 1), least_times)
        # a document without a repeated k-gram has no longer ones; a short one no longer runs
        keep = np.zeros(len(sizes), bool)
        keep[doc] = True
        keep &= sizes > least_times * k
        if not keep.any():
            break
        names = names[np.repeat(keep, sizes)]
        first_of, sizes = first_of[keep], sizes[keep]
    return found


def _extended(words: np.ndarray, place: np.ndarray, lag: np.ndarray, low: np.ndarray, high: np.ndarray, least_words: int, least_times: int) -> list[tuple[int, int, int]]:
    """Runs that hold a pair of places ``lag`` apart; every stretch is extended once."""
    found: list[tuple[int, int, int]] = []
    order = np.lexsort((place, lag))
    place, lag, low, high = place[order], lag[order], low[order], high[order]
    covered: dict[int, int] = {}
    at = 0
    while at < len(place):
        p, q = int(place[at]), int(lag[at])
        if p < covered.get(q, 0):
            # on to the next pair of this lag that is not covered, or to the next lag
            last = int(np.searchsorted(lag, q, side="right"))
            at += int(np.searchsorted(place[at:last], covered[q]))
            continue
        start, end = _stretch(words, p, q, int(low[at]), int(high[at]))
        covered[q] = end
        if end - start + q >= max(least_words, least_times * q):
            found.append((start, end - start + q, q))
        at += 1
    return found


class Finder:
    """Runs of texts, texts of a block together."""

    def __init__(self, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES, block_words: int = BLOCK_WORDS):
        self.least = least_words, least_times
        self.block_words = block_words

    def of_texts(self, texts: list[str | None]) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        block: list[list[bytes]] = []
        held = 0
        for text in texts:
            # bytes.split knows exactly the blanks U+0020 and U+0009 to U+000D
            block.append((text or "").encode().split())
            held += len(block[-1])
            if held >= self.block_words:
                out += self._block(block)
                block, held = [], 0
        return out + self._block(block)

    def _block(self, docs: list[list[bytes]]) -> list[dict[str, Any]]:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        # a separator a document, itself a word that occurs once
        sizes = np.array([len(d) for d in docs], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        words = np.empty(int(bounds[-1]), np.int64)
        for at, doc in zip(bounds, docs, strict=False):
            words[at:at + len(doc)] = np.fromiter(map(numbers.__getitem__, doc), np.int64, len(doc))
        words[bounds[1:] - 1] = len(numbers) + np.arange(len(docs))
        found = runs_of(words, bounds, *self.least) if len(docs) else []
        by_doc: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        for start, length, period in found:
            doc = int(np.searchsorted(bounds, start, side="right")) - 1
            by_doc[doc].append((start - int(bounds[doc]), length, period))
        return [self._result(doc, sorted(runs, key=lambda r: (r[0], r[2]))) for doc, runs in zip(docs, by_doc, strict=True)]

    @staticmethod
    def _result(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict[str, Any]:
        top: tuple[Any, ...] = (None, None, None)
        if runs:
            gone = np.zeros(len(words), bool)
            for start, length, period in runs:
                gone[start + period:start + length] = True
            words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            n = len(gone)
            top = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        else:
            n = len(words)
        return {"n_words": n, "n_runs": len(runs), "start": top[0], "length": top[1], "period": top[2],
                "runs": "".join("%d,%d,%d\n" % run for run in runs), "kept": b" ".join(words).decode()}


def runs_column(text: Column | str, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> Column:
    """struct(n_words, n_runs, start, length, period, runs, kept) of a text.

    ``start``, ``length`` and ``period`` are those of the longest run (then the first, then
    the one of smallest period) and null without a run; ``runs`` has a line
    ``start,length,period`` a run, by start and period; ``kept`` holds the words outside of
    every repetition, joined by a blank. A null text is empty: no words, no runs.
    """
    def make() -> Callable[[list], list]:
        return Finder(least_words, least_times).of_texts
    return text_udf(make, SCHEMA)(text)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "runs") -> DataFrame:
    """``docs`` with one more column (or ``out`` replaced), see :func:`runs_column`.

    Every row is judged alone: null ids, repeated ids and repeated rows stay as they are, an
    empty table gives an empty result, no other column is read. Map-only.
    """
    return docs.withColumn(out, runs_column(F.col(text_col).cast("string")))


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every run cut down to its first period; texts without a run stay as
    they are, white space included. All columns are kept, nulls stay null."""
    found = runs_column(F.col(text_col).cast("string"))
    name = "runs"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, found)
    return rows.withColumn(text_col, F.when(F.col(f"{name}.n_runs") > 0, F.col(f"{name}.kept")).otherwise(F.col(text_col))).drop(name)
