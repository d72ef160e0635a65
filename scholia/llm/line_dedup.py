"""Line dedup by winnowing: later repeats of runs of lines, and of long lines, go.

Lines are compared without white space at their ends; blank ones are skipped and stay.
A run counts from ``window`` lines on, a single line from ``long_line`` bytes on. From the
hashes of each window of lines the smallest is selected, so every run of that length has
a selected position; long lines are selected too. Positions whose hash occurs once are
dropped by a bitmap of bounded size. The others are joined on their hash in document
order, with the lines next to them: a position is extended to the left and the right as
far as earlier ones go along, and where the extension reaches the length of a window its
lines are a repeat. The first place of every run and long line stays.

Equal neighbourhoods of one task are sent once with their earliest place. A hash with
very many positions is dealt out by the lines around it.

Null and empty texts have no lines; a null stays null. Rows with a null id come first,
rows that share an id are ordered by a hash of the text, identical rows get one result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from scholia.functions.scale import cut
from scholia.llm.common import SLICE_ROWS, once, to_arrow
from scholia.llm.repeats import HashFilter, hash_filter

WINDOW = 3
LONG_LINE = 60
#: Positions from which a hash is dealt out by the lines around it.
HOT_HASH = 500
#: Bytes of neighbourhoods a task gathers before it sends them on.
GATHER_BYTES = 48 << 20
ENDS = b" \t\r\f\v"
DIGEST = 16
#: Keeps the hash of a long line apart from that of the same line in a window.
_ALONE = np.uint64(0x5851F42D4C957F2D)

PLACE = "hash bigint, around binary, alone boolean, doc bigint, mark bigint, start int"


class Lines:
    """The lines of a text that are not blank: their numbers, digests and sizes."""

    def __init__(self, text: bytes | None):
        self.all = text.split(b"\n") if text else []
        trimmed = [line.strip(ENDS) for line in self.all]
        self.numbers = [i for i, line in enumerate(trimmed) if line]
        self.sizes = np.fromiter((len(trimmed[i]) for i in self.numbers), np.int64, len(self.numbers))
        self.digests = b"".join([xxh3_128_digest(trimmed[i]) for i in self.numbers])
        self.hashes = np.frombuffer(self.digests, np.uint64)[::2]

    def selected(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and hash of each selected position."""
        n = len(self.hashes) - window + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.lib.stride_tricks.sliding_window_view(self.hashes, window).argmin(axis=1) + np.arange(n)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        return starts, np.diff(starts, append=n), self.hashes[at[starts]]

    def long(self, long_line: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.sizes >= long_line)
        return at, self.hashes[at] ^ _ALONE

    def around(self, start: int, n: int) -> bytes:
        return self.digests[start * DIGEST:(start + n) * DIGEST]

    def candidates(self, repeated: HashFilter, hot: HashFilter, window: int, long_line: int) -> Iterator[tuple[int, int, int | None, bool]]:
        """(first line, number of windows, hash, whether it is a long line) of positions
        whose hash may be repeated; a hot hash is left out and its windows come singly."""
        at, alone = self.long(long_line)
        found = np.flatnonzero(repeated.holds(alone)) if len(at) else at
        for line, h in zip(at[found].tolist(), alone[found].view(np.int64).tolist(), strict=True):
            yield line, 1, h, True
        starts, sizes, hashes = self.selected(window)
        found = np.flatnonzero(repeated.holds(hashes)) if len(starts) else starts
        split = hot.holds(hashes[found]).tolist() if len(found) else []
        for start, size, h, many in zip(starts[found].tolist(), sizes[found].tolist(), hashes[found].view(np.int64).tolist(), split, strict=True):
            if many:
                yield from ((start + k, 1, None, False) for k in range(size))
            else:
                yield start, size, h, False


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.withColumns({"__doc": F.coalesce(F.col(id_col), F.lit(-(1 << 63))), "__mark": F.xxhash64(F.col(text_col).cast("string"))})


def _texts(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col("__doc").alias("doc"), F.col("__mark").alias("mark"))


def _hash_counts(texts: DataFrame, window: int, long_line: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                found = []
                for text in batch.column(0).slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist():
                    lines = Lines(text)
                    found += [lines.selected(window)[2], lines.long(long_line)[1]]
                hashes, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], ["hash", "n"])
    return texts.select("text").mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def _filters(data: tuple[Any, Any]) -> tuple[HashFilter, HashFilter]:
    return tuple(once(d, "filter", lambda h: HashFilter(h["bitmap"])) for d in data)


def _neighbourhoods(texts: DataFrame, data: tuple[Any, Any], window: int, long_line: int) -> DataFrame:
    """Positions with the lines around them; equal ones of a task once, earliest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = _filters(data)
        first: dict[tuple[int, bytes, bool], tuple[int, int, int]] = {}
        size = 0

        def send() -> pa.RecordBatch:
            columns = [*zip(*first, strict=True), *zip(*first.values(), strict=True)]
            kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hash", "around", "alone", "doc", "mark", "start"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for text, doc, mark in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lines = Lines(text)
                    for start, n, h, alone in lines.candidates(repeated, hot, window, long_line):
                        around = lines.around(start, n if alone else n + window - 1)
                        if h is None:
                            h = int.from_bytes(xxh3_128_digest(around)[:8], "little", signed=True)
                        key, place = (h, around, alone), (doc, mark, start)
                        known = first.get(key)
                        if known is None:
                            size += len(around) + 160
                        if known is None or place < known:
                            first[key] = place
                if size > GATHER_BYTES:
                    yield send()
                    first.clear()
                    size = 0
        if first:
            yield send()

    return texts.mapInArrow(run, PLACE)


class Position:
    """What earlier positions with one hash have around them."""

    def __init__(self, window: int):
        self.window = window
        self.seen: set[bytes] = set()

    def new_windows(self, around: bytes, alone: bool) -> list[tuple[int, int]]:
        """(first, number) of runs of windows that no earlier neighbourhood has.

        Every window holds the position; so one that an earlier neighbourhood also has is
        the position extended by some lines to the left and the rest to the right.
        """
        reach = (1 if alone else self.window) * DIGEST
        runs: list[tuple[int, int]] = []
        for k in range((len(around) - reach) // DIGEST + 1):
            lines = around[k * DIGEST:k * DIGEST + reach]
            if lines in self.seen:
                continue
            self.seen.add(lines)
            if runs and sum(runs[-1]) == k:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((k, 1))
        return runs


def _first_places(found: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position = None, Position(window)
        for batch in batches:
            out: list[tuple[int, int, bool, int, int]] = []
            for h, around, alone, doc, mark, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, alone) != current:
                    current, position = (h, alone), Position(window)
                out += [(doc, mark, alone, start + first, n) for first, n in position.new_windows(around, alone)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "mark", "alone", "start", "n"])

    ordered = found.repartition("hash").sortWithinPartitions("hash", "alone", "doc", "mark", "start")
    return ordered.mapInArrow(run, "doc bigint, mark bigint, alone boolean, start int, n int")


def _removal(data: tuple[Any, Any], window: int, long_line: int) -> Callable[..., Column]:
    schema = "struct<n_lines:bigint,removed:array<int>,kept:string>"
    kind = to_arrow(schema)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        repeated, hot = _filters(data)
        for texts, firsts in batches:
            out = []
            for text, first in zip(texts.cast(pa.binary()).to_pylist(), firsts.to_pylist(), strict=True):
                lines = Lines(text)
                starts = {True: np.zeros(len(lines.numbers), bool), False: np.zeros(len(lines.numbers), bool)}
                for start, n, _, alone in lines.candidates(repeated, hot, window, long_line):
                    starts[alone][start:start + n] = True
                for f in first or ():
                    starts[f["alone"]][f["start"]:f["start"] + f["n"]] = False
                gone = starts[True]
                for start in np.flatnonzero(starts[False]).tolist():
                    gone[start:start + window] = True
                removed = [lines.numbers[i] for i in np.flatnonzero(gone).tolist()]
                drop = set(removed)
                kept = b"\n".join([line for i, line in enumerate(lines.all) if i not in drop]).decode() if removed else None
                out.append({"n_lines": len(lines.all), "removed": removed, "kept": kept})
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()


def remove_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_line: int = LONG_LINE,
                 hot_hash: int = HOT_HASH, out: str = "__lines") -> DataFrame:
    """``df`` without the repeated lines in its text, and a struct ``out`` that says so:
    n_lines (of the whole text), removed (line numbers from 0), kept (null: unchanged)."""
    rows = _rows(df, id_col, text_col)
    texts = _texts(rows, text_col)
    counts = cut(_hash_counts(texts, window, long_line).where("n > 1"))
    n = counts.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") >= hot_hash).alias("hot")).first()
    data = (hash_filter(counts, "hash", n["all"]), hash_filter(counts.where(F.col("n") >= hot_hash), "hash", n["hot"]))
    firsts = _first_places(_neighbourhoods(texts, data, window, long_line), window)
    by_doc = firsts.groupBy(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("alone", "start", "n")).alias("__firsts"))
    found = rows.join(by_doc.hint("shuffle_hash"), ["__doc", "__mark"], "left")
    removal = _removal(data, window, long_line)(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "__firsts")
    columns = [F.col(c) for c in df.columns if c != text_col]
    done = found.withColumn(out, removal)
    return done.select(*columns, F.coalesce(f"{out}.kept", F.col(text_col)).alias(text_col), out).select(*df.columns, out)
