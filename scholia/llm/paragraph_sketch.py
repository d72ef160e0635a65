"""Document fingerprints by invertible Bloom lookup sketches of paragraph pieces.

A text is cut into paragraphs, these into sentences and long sentences into pieces. The
digests of the pieces (the second of two equal ones counts as another digest) are added to
the cells of a small table: a count, the exclusive-or of the digests and that of their
checks. Subtracting the tables of two versions leaves the digests that differ, and peeling
recovers them one after the other from cells that hold a single one. If that gets stuck,
both tables are made anew with more cells.

A fingerprint is the table of the smallest size as text, so equal texts have equal ones.
Likeness is one minus the share of differing digests among all digests of both versions;
it is 1 for two texts without pieces. Nulls are empty texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from xxhash import xxh64_intdigest

from scholia.llm.common import SLICE_ROWS, to_arrow

#: Most characters of a piece before its stop.
PIECE = 32
#: Hash functions; each has a part of the table of its own, of ``CELLS`` cells at first.
PARTS = 3
CELLS = 8
#: Factor of the number of cells after a failure.
GROWTH = 4
#: Texts compared at once.
GROUP = 128
#: Ranges of ids for each shuffle partition when rows are put next to each other.
RANGES = 4

_PIECES = regex.compile(r"[^\n.!?]{1,%d}[.!?]*\n?|[.!?\n]+" % PIECE).findall
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def digests(text: str | None) -> np.ndarray:
    """Digests of the pieces of a text, all different, in ascending order."""
    if not text:
        return np.empty(0, np.uint64)
    pieces = _PIECES(text)
    found = np.sort(np.fromiter(map(xxh64_intdigest, pieces), np.uint64, len(pieces)))
    new = np.concatenate(([True], found[1:] != found[:-1]))
    if not new.all():
        at = np.arange(len(found))
        again = at - np.maximum.accumulate(np.where(new, at, 0))
        found = np.sort(np.where(again > 0, _mix(found + again.astype(np.uint64) * _ODD, 77), found))
    return found


class Tables:
    """Sketches of several digest sets, one after the other in flat arrays."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        size = n * PARTS * cells
        self.count = np.zeros(size, np.int64)
        self.keys = np.zeros(size, np.uint64)
        self.checks = np.zeros(size, np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        """Add digests to the sketches of ``owner`` (sign 1) or take them out (sign -1)."""
        check = _mix(keys, 5)
        for part in range(PARTS):
            place = (_mix(keys, 1000 + part) & np.uint64(self.cells - 1)).astype(np.int64)
            place += (owner * PARTS + part) * self.cells
            np.add.at(self.count, place, sign)
            np.bitwise_xor.at(self.keys, place, keys)
            np.bitwise_xor.at(self.checks, place, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign of what the sketches hold, and which owners are solved."""
        owners, found, signs = [], [], []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[_mix(self.keys[pure], 5) == self.checks[pure]]
            if not len(pure):
                break
            owner, key, sign = pure // (PARTS * self.cells), self.keys[pure], self.count[pure]
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            once = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
            owner, key, sign = owner[once], key[once], sign[once]
            self.add(owner, key, -sign)
            owners.append(owner)
            found.append(key)
            signs.append(sign)
        left = ((self.count != 0) | (self.keys != 0)).reshape(self.n, -1).any(axis=1)
        join = [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((owners, np.int64), (found, np.uint64), (signs, np.int64))]
        return join[0], join[1], join[2], ~left

    def text(self, i: int) -> str:
        """The sketch as text."""
        part = slice(i * PARTS * self.cells, (i + 1) * PARTS * self.cells)
        raw = self.count[part].astype("<i4").tobytes() + self.keys[part].astype("<u8").tobytes() + self.checks[part].astype("<u4").tobytes()
        return base64.b64encode(raw).decode()


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.empty(0, np.uint64)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    tables = Tables(len(sets), CELLS)
    tables.add(*_flat(sets), 1)
    return [tables.text(i) for i in range(len(sets))]


def differences(old: list[np.ndarray], new: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests only in the old and only in the new version.

    Pairs whose sketches cannot be peeled are tried again with more cells, until all are.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64),) * 2] * len(old)
    open_ = np.arange(len(old))
    while len(open_):
        tables = Tables(len(open_), cells)
        tables.add(*_flat([old[i] for i in open_]), 1)
        tables.add(*_flat([new[i] for i in open_]), -1)
        owner, key, sign, solved = tables.peel()
        order = np.argsort(owner, kind="stable")
        owner, key, sign = owner[order], key[order], sign[order]
        bounds = np.searchsorted(owner, np.arange(len(open_) + 1))
        for k in np.flatnonzero(solved).tolist():
            mine = slice(bounds[k], bounds[k + 1])
            out[open_[k]] = key[mine][sign[mine] > 0], key[mine][sign[mine] < 0]
        open_ = open_[~solved]
        cells *= GROWTH
    return out


def likeness(old: list[np.ndarray], new: list[np.ndarray]) -> list[float]:
    pairs = zip(old, new, differences(old, new), strict=True)
    return [1.0 - (len(a) + len(b)) / (len(x) + len(y)) if len(x) + len(y) else 1.0 for x, y, (a, b) in pairs]


def compare(text: Column | str, others: Column) -> Column:
    """Struct of the fingerprint of a text and, for each text of an array, its
    fingerprint and its likeness to the text."""
    schema = "struct<fingerprint:string,others:array<struct<fingerprint:string,near:double>>>"
    kind = to_arrow(schema)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, rivals in batches:
            out = []
            for at in range(0, len(texts), GROUP):
                own = [digests(t) for t in texts.slice(at, GROUP).to_pylist()]
                more = [[digests(t) for t in row or ()] for row in rivals.slice(at, GROUP).to_pylist()]
                flat = [s for row in more for s in row]
                near = iter(zip(fingerprints(flat), likeness([own[i] for i, row in enumerate(more) for _ in row], flat), strict=True))
                for mark, row in zip(fingerprints(own), more, strict=True):
                    out.append({"fingerprint": mark, "others": [dict(zip(("fingerprint", "near"), next(near), strict=True)) for _ in row]})
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()(text, others)


def changed(old: Column | str, new: Column | str) -> Column:
    """Struct of the digests that went and came between two text columns."""
    schema = "struct<went:array<bigint>,came:array<bigint>>"
    kind = to_arrow(schema)

    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(before), SLICE_ROWS):
            a, b = ([digests(t) for t in x.slice(at, SLICE_ROWS).to_pylist()] for x in (before, after))
            out += [{"went": np.sort(x.view(np.int64)), "came": np.sort(y.view(np.int64))} for x, y in differences(a, b)]
        return pa.array(out, kind)
    return F.arrow_udf(run, schema).asNondeterministic()(old, new)


def _range_of(value: Column, bounds: list[float], low: int, high: int) -> Column:
    """Number of bounds below a value, by a tree of comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value <= F.lit(int(bounds[middle])), _range_of(value, bounds, low, middle)).otherwise(_range_of(value, bounds, middle + 1, high))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: the text of the row with the next id; the first after the last.

    Rows are dealt into ranges of ids, and the first row of a range is also sent to the
    range before, so no task sees more than a range. Null ids come first, rows that share
    an id are ordered by a hash of their text.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     F.coalesce(F.col(id_col), F.lit(-(1 << 63))).alias("__order"))
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = rows.select("__order")
    bounds = sorted(set(order.approxQuantile("__order", [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    dealt = rows.withColumn("__range", _range_of(F.col("__order"), bounds, 0, len(bounds)))
    firsts = sorted((r["__range"], r.first) for r in dealt.groupBy("__range").agg(F.min("__order").alias("first")).collect())
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    copies = df.sparkSession.createDataFrame(before, "__order bigint, __before int")
    placed = dealt.join(F.broadcast(copies), "__order", "left")
    twice = F.array(F.struct(F.col("__range").alias("at"), F.lit(False).alias("copy")), F.struct(F.col("__before").alias("at"), F.lit(True).alias("copy")))
    sent = placed.select("doc_id", "text", "__order", F.explode(F.filter(twice, lambda p: p.at.isNotNull())).alias("__p"))
    nearby = W.partitionBy("__p.at").orderBy("__p.copy", "__order", F.xxhash64("text"))
    return sent.withColumn("next_text", F.lead("text").over(nearby)).where(~F.col("__p.copy")).select("doc_id", "text", "next_text")


def edited_text(text: str = "text", next_text: str = "next_text") -> Column:
    """The text with its last quarter replaced by the beginning of the next one."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n - quarter), F.left(next_text, quarter))
