"""Substring dedup: words covered by a window of words that also starts earlier go.

Every window of consecutive words is assigned to an anchor, the smallest hash among the
short runs of words inside it, so equal windows have equal anchors. Consecutive windows
with one anchor form a passage. Anchors that occur once cannot belong to a repeated
window; a broadcast bitmap of the others, of bounded size, leaves few passages to compare.

Passages are the reference shards: all with one anchor meet in one task in document order,
where a suffix automaton of the earlier ones gives the longest match that ends at each
word. Windows that are not matched are the first of their kind. A document then loses
every word of its repeated windows but the first ones. Broadcasting the automata of the
whole corpus instead would read every document once per shard, which grows with the
square of the corpus; here a shard only meets the documents that share an anchor with it.

Equal passages of one task are sent once, with their earliest place. The windows of an
anchor with very many occurrences are compared one by one, dealt out by their own content.

Null and empty texts have no words. Rows with a null id come first. Rows that share an id
are ordered by a hash of the text; identical rows count as one document, and all of them
get its result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scholia.functions.scale import cut
from scholia.llm.common import SLICE_ROWS, once, to_arrow
from scholia.llm.repeats import HashFilter, hash_filter
from scholia.llm.suffix_automaton import SuffixAutomaton

WINDOW = 20
#: Occurrences from which the windows of an anchor are compared one by one.
HOT_ANCHOR = 10_000
#: Bytes of passages a task gathers before it sends them on.
GATHER_BYTES = 48 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
PASSAGE = "anchor bigint, words binary, doc bigint, mark bigint, start int"


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= _ODD
        out += hashes[k:k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def passages(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each passage of a text."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = run_hashes(word_hashes(words), window // 2)
    inside = window - window // 2 + 1
    at = np.lib.stride_tricks.sliding_window_view(runs, inside).argmin(axis=1)
    at += np.arange(n)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    return starts, np.diff(starts, append=n), runs[at[starts]]


def candidates(words: list[bytes], repeated: HashFilter, hot: HashFilter, window: int = WINDOW) -> Iterator[tuple[int, int, int | None]]:
    """(first window, number of windows, anchor) of passages that may hold a repeated
    window. Passages of a hot anchor come window by window, without the anchor."""
    starts, sizes, anchors = passages(words, window)
    if len(starts):
        maybe = np.flatnonzero(repeated.holds(anchors))
        many = hot.holds(anchors[maybe]).tolist()
        for start, size, anchor, split in zip(starts[maybe].tolist(), sizes[maybe].tolist(), anchors[maybe].view(np.int64).tolist(), many, strict=True):
            if split:
                for k in range(size):
                    yield start + k, 1, None
            else:
                yield start, size, anchor


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("mark"))


def _anchor_counts(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                texts = batch.column(0).slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist()
                found = [passages(words_of(t), window)[2] for t in texts]
                anchors, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n, pa.int64())], ["anchor", "n"])
    return rows.select("text").mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))


def _filters(data: tuple[Any, Any]) -> tuple[HashFilter, HashFilter]:
    return tuple(once(d, "filter", lambda h: HashFilter(h["bitmap"])) for d in data)


def _candidate_rows(rows: DataFrame, data: tuple[Any, Any], window: int) -> DataFrame:
    """Passages to compare; equal ones of a task once, with their earliest place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = _filters(data)
        first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        size = 0

        def send() -> pa.RecordBatch:
            keys, places = list(zip(*first, strict=True)), list(zip(*first.values(), strict=True))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*keys, *places], kinds, strict=True)], ["anchor", "words", "doc", "mark", "start"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts, docs, marks = part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
                for text, doc, mark in zip(texts, docs, marks, strict=True):
                    words = words_of(text)
                    for start, n, anchor in candidates(words, repeated, hot, window):
                        passage = b" ".join(words[start:start + n + window - 1])
                        if anchor is None:
                            anchor = xxh64_intdigest(passage) - (1 << 63)
                        place, known = (doc, mark, start), first.get((anchor, passage))
                        if known is None:
                            first[anchor, passage] = place
                            size += len(passage) + 160
                        elif place < known:
                            first[anchor, passage] = place
                    if size > GATHER_BYTES:
                        yield send()
                        first.clear()
                        size = 0
        if first:
            yield send()

    return rows.select("text", "doc", "mark").mapInArrow(run, PASSAGE)


class Shard:
    """The passages of one anchor in document order: which windows are new?"""

    def __init__(self, window: int):
        self.window = window
        self.seen: set[bytes] = set()
        self.alone: list[bytes] | None = None
        self.automaton: SuffixAutomaton | None = None
        self.number: dict[bytes, int] = {}

    def new_windows(self, passage: bytes) -> list[tuple[int, int]]:
        """(first, number) of runs of windows that no earlier window equals."""
        if passage in self.seen:
            return []
        self.seen.add(passage)
        words = passage.split(b" ")
        n = len(words) - self.window + 1
        if self.automaton is None:
            # a window can only repeat inside one passage if few words come again and again
            if self.alone is None and len(set(words)) >= n:
                self.alone = words
                return [(0, n)]
            self.automaton = SuffixAutomaton()
            if self.alone is not None:
                self._matches(self.alone)
        fresh = [i for i, length in enumerate(self._matches(words)) if i >= self.window - 1 and length < self.window]
        runs: list[tuple[int, int]] = []
        for i in fresh:
            start = i - self.window + 1
            if runs and sum(runs[-1]) == start:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((start, 1))
        return runs

    def _matches(self, words: list[bytes]) -> list[int]:
        """Length of the longest earlier run that ends like the passage at each word."""
        auto, out = self.automaton, []
        assert auto is not None
        state = length = last = 0
        for word in words:
            number = self.number.setdefault(word, len(self.number))
            state, length = auto.step(state, length, number)
            out.append(length)
            last = auto.extend(last, number)
            while length and auto.long[auto.link[state]] >= length:
                state = auto.link[state]  # the state was split while the text grew
        return out


def _first_windows(found: DataFrame, window: int) -> DataFrame:
    """doc, mark, start, n: runs of windows whose words start nowhere earlier."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, Shard(window)
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for anchor, passage, doc, mark, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != current:
                    current, shard = anchor, Shard(window)
                out += [(doc, mark, start + first, n) for first, n in shard.new_windows(passage)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)],
                                                 ["doc", "mark", "start", "n"])

    ordered = found.repartition("anchor").sortWithinPartitions("anchor", "doc", "mark", "start")
    return ordered.mapInArrow(run, "doc bigint, mark bigint, start int, n int")


def _removal(data: tuple[Any, Any], window: int) -> Callable[..., Column]:
    schema = "struct<n_words:bigint,spans:array<bigint>,kept:string>"
    kind = to_arrow(schema)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        repeated, hot = _filters(data)
        for texts, firsts in batches:
            out = []
            for text, first in zip(texts.cast(pa.binary()).to_pylist(), firsts.to_pylist(), strict=True):
                words = words_of(text)
                starts = np.zeros(len(words) + 1, bool)
                for start, n, _ in candidates(words, repeated, hot, window):
                    starts[start:start + n] = True
                for f in first or ():
                    starts[f["start"]:f["start"] + f["n"]] = False
                spans: list[int] = []
                for s in np.flatnonzero(starts).tolist():
                    if spans and spans[-1] >= s:
                        spans[-1] = s + window
                    else:
                        spans += [s, s + window]
                kept, at = [], 0
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    kept += words[at:a]
                    at = b
                out.append({"n_words": len(words), "spans": spans, "kept": b" ".join([*kept, *words[at:]]).decode()})
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, end, ...), kept (words joined by a blank)."""
    rows = _rows(df, id_col, text_col)
    counts = cut(_anchor_counts(rows, window).where("n > 1"))
    n = counts.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") >= hot_anchor).alias("hot")).first()
    data = (hash_filter(counts, "anchor", n["all"]), hash_filter(counts.where(F.col("n") >= hot_anchor), "anchor", n["hot"]))
    firsts = _first_windows(_candidate_rows(rows, data, window), window)
    by_doc = firsts.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n")).alias("firsts"))
    removal = _removal(data, window)
    found = rows.join(by_doc.hint("shuffle_hash"), ["doc", "mark"], "left").select("doc_id", removal("text", "firsts").alias("r"))
    n_removed = F.aggregate("r.spans", F.lit(0).cast("bigint"), lambda total, x: x - total)
    return found.select("doc_id", "r.n_words", n_removed.alias("n_removed"), "r.spans", "r.kept")
