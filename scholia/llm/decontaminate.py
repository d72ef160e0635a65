"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are the runs of letters, digits and non-ASCII characters of a text whose A-Z are
lower-cased. The automaton accepts every run of consecutive words of every item. Reading
a document keeps the longest run that ends at the current word; wherever it has the
length of a window, its words are hit and the items of the window are noted. Items
shorter than a window count as one window if their words occur as a whole.

Documents are read once per shard of items, and a shard has a bounded number of words.
Null and empty texts have no words and are clean; null items hit nothing; repeated
rows get the same result; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.scale import cut
from scholia.llm.common import once, share, text_udf
from scholia.llm.suffix_automaton import SuffixAutomaton

WINDOW = 10
#: Words of items in one automaton: about two states a word, some hundred bytes a state.
SHARD_WORDS = 200_000
#: A document with a larger share of hit words is dropped by :func:`clean`.
MAX_COVERAGE = 0.5

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = regex.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Spans are (start, end, start, end, ...): of words, and the same ones of bytes of the text.
HITS = "struct<n_words:bigint,spans:array<bigint>,bytes:array<bigint>,items:array<string>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_KEPT).split() if text else []


class ItemAutomaton(SuffixAutomaton):
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int = WINDOW):
        super().__init__()
        self.window = window
        self.word_id: dict[bytes, int] = {}
        ends: list[tuple[str, list[int]]] = []
        for item, text in items:
            words = words_of(text)
            last, path = 0, []
            for word in words:
                last = self.extend(last, self.word_id.setdefault(word, len(self.word_id)))
                path.append(last)
            if words:
                ends.append((item, path))
        del self.out
        self._note(ends)

    def _note(self, ends: list[tuple[str, list[int]]]) -> None:
        """For each state: the state of its window, the items there, and short items."""
        n = self.window
        order = sorted(range(1, len(self.long)), key=self.long.__getitem__)
        self.at_window = [0] * len(self.long)
        for s in order:
            if self.long[s] >= n:
                self.at_window[s] = s if self.long[self.link[s]] < n else self.at_window[self.link[s]]
        found: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for item, path in ends:
            if len(path) < n:
                whole.setdefault(path[-1], set()).add(item)
            for s in path[n - 1:]:
                found.setdefault(self.at_window[s], set()).add(item)
        self.items = {s: frozenset(x) for s, x in found.items()}
        #: Short items that end at a state: their longest length and all of them.
        self.short: dict[int, tuple[int, frozenset[str]]] = {}
        for s in order:
            above = self.short.get(self.link[s])
            if s in whole:
                self.short[s] = (self.long[s], frozenset(whole[s]) | (above[1] if above else frozenset()))
            elif above:
                self.short[s] = above

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words (end exclusive), and the items that occur."""
        step, long, link, n, short = self.next.get, self.long, self.link, self.window, self.short
        state = length = 0
        spans: list[tuple[int, int]] = []
        places: set[int] = set()
        items: set[str] = set()
        for i, word in enumerate(map(self.word_id.get, words)):
            if word is None:
                state = length = 0
                continue
            to = step(state << 32 | word)
            while to is None and state:
                state = link[state]
                length = long[state]
                to = step(state << 32 | word)
            if to is None:
                state = length = 0
                continue
            state, length = to, length + 1
            if length >= n:
                places.add(self.at_window[state])
                start = i + 1 - length
            elif state in short:
                if length < long[state]:
                    if link[state] not in short:
                        continue
                    size, seen = short[link[state]]
                else:
                    size, seen = short[state]
                items |= seen
                start = i + 1 - size
            else:
                continue
            if short and length >= n:
                at = state if length >= long[state] else link[state]
                if at in short:
                    items |= short[at][1]
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, i + 1))
        for place in places:
            items |= self.items[place]
        return spans, items


def _pieces(item: str, text: bytes | None, most: int, window: int) -> Iterator[tuple[str, bytes | None]]:
    """An item of very many words as overlapping pieces with the same windows."""
    words, most = words_of(text), max(most, 2 * window)
    if len(words) <= most:
        yield item, text
        return
    for at in range(0, len(words) - window + 1, most - window + 1):
        yield item, b" ".join(words[at:at + most])


def _shards(benchmark: DataFrame, id_col: str, text_col: str, shard_words: int) -> Iterator[tuple[list[tuple[str, str | None]], int]]:
    """Items in shards of about ``shard_words`` words; one shard at a time on the driver."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // (6 * shard_words)))
    placed = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for k in range(n):
        yield [(r.item, r.text) for r in placed.where(F.col("shard") == k).select("item", "text").distinct().collect()], n


def _hit_column(data: Any, window: int, shard_words: int) -> Callable[..., Column]:
    def make() -> Callable[[list], list]:
        def build(holder: dict[str, Any]) -> ItemAutomaton:
            parts = (p for item, text in holder["items"] for p in _pieces(item, text.encode() if text else None, shard_words, window))
            return ItemAutomaton(parts, window)
        automaton = once(data, f"automaton{window}", build)

        def work(texts: list) -> list:
            out = []
            for text in texts:
                words = words_of(text)
                spans, items = automaton.hits(words)
                places = [m.span() for m in _WORD.finditer(text)] if spans else []
                out.append({"n_words": len(words), "spans": [x for s in spans for x in s], "items": sorted(items),
                            "bytes": [x for a, b in spans for x in (places[a][0], places[b - 1][1])]})
            return out
        return work
    return text_udf(make, HITS, utf8=True)


def _join_spans(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and out[-1] >= start:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _join_bytes(a: dict[str, Any], b: dict[str, Any]) -> list[int]:
    """The bytes of the joined spans of words."""
    place = dict(zip([*a["spans"][::2], *b["spans"][::2]], [*a["bytes"][::2], *b["bytes"][::2]]))
    end = dict(zip([*a["spans"][1::2], *b["spans"][1::2]], [*a["bytes"][1::2], *b["bytes"][1::2]]))
    joined = _join_spans(a["spans"], b["spans"])
    return [x for s, e in zip(joined[::2], joined[1::2]) for x in (place[s], end[e])]


def _merge(left: str, right: str) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [{"n_words": x["n_words"], "spans": _join_spans(x["spans"], y["spans"]), "bytes": _join_bytes(x, y), "items": sorted({*x["items"], *y["items"]})}
                for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.array(rows, a.type)
    return F.arrow_udf(run, HITS)(left, right)


def with_hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "__hits", item_col: str = "item_id",
              item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``df`` with a struct of n_words, spans (start, end, start, end, ...) and items.

    With several shards the documents are written to the shared folder between passes,
    so that a worker holds one automaton at a time.
    """
    found = df
    for k, (items, n) in enumerate(_shards(benchmark, item_col, item_text, shard_words)):
        size = sum(len(i) + 4 * len(t or "") for i, t in items)
        data = share(df.sparkSession, {"items": items}, size)
        hits = _hit_column(data, window, shard_words)(F.coalesce(F.col(text_col), F.lit("")))
        found = found.withColumn(out, hits) if k == 0 else found.withColumn("__more", hits).withColumn(out, _merge(out, "__more")).drop("__more")
        if n > 1:
            found = cut(found)
    return found


def n_hit(hits: str = "__hits") -> Column:
    """Number of hit words of the struct that :func:`with_hits` adds."""
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("bigint"), lambda sum_, x: x - sum_)


def without(text: Column | str, hits: str = "__hits") -> Column:
    """The text without the bytes of the hit spans; what stands between words stays."""
    raw, cuts = (F.col(text) if isinstance(text, str) else text).cast("binary"), F.col(f"{hits}.bytes")
    bounds = F.concat(F.array(F.lit(0).cast("bigint")), cuts, F.array(F.octet_length(raw).cast("bigint")))
    pieces = F.transform(F.sequence(F.lit(0), (F.size(cuts) / 2).cast("int")), lambda i: F.substring(
        raw, (F.get(bounds, (2 * i).cast("int")) + 1).cast("int"), (F.get(bounds, (2 * i + 1).cast("int")) - F.get(bounds, (2 * i).cast("int"))).cast("int")).cast("string"))
    return F.array_join(pieces, "")


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", max_coverage: float = MAX_COVERAGE, **options: Any) -> DataFrame:
    """Documents without the hit spans; those with too large a share of hits are dropped.

    The columns are those of ``df``. Documents without a hit stay as they are.
    """
    found = with_hits(df, benchmark, text_col, **options)
    kept = found.where(n_hit() <= F.lit(max_coverage) * F.col("__hits.n_words"))
    return kept.withColumn(text_col, F.when(F.size("__hits.spans") > 0, without(text_col)).otherwise(F.col(text_col))).select(*df.columns)


def decontamination_report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: Any) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans for every row of ``df``."""
    found = with_hits(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    return found.select("doc_id", "__hits.n_words", n_hit().alias("n_hit"), "__hits.items", "__hits.spans")
