"""Token counts without a pre-token shuffle: two lookups inside the map task.

The first tier is a broadcast table of the token counts of frequent words, found by
bounded frequency summaries over all texts; the second one is a worker cache that fills
itself from the tokenizer library. Neither changes a count, they only save encoding.

A word here is what stands between white space, in lower case, so one or more pre-tokens.
Texts with characters from U+0250 on go through the library's own normaliser and
pre-tokeniser first, since those follow its version of Unicode; their pre-tokens are
looked up in the same cache. Nulls count like empty texts: 0 bytes, 0 tokens.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholia.llm.common import Generations, once, share, text_udf

TOKEN_LIMIT = 2048
#: Words of the broadcast table; what a task may report to it; what its summary holds.
TABLE_WORDS = 32_768
TASK_WORDS = 4_096
SUMMARY_WORDS = 65_536
#: Words a worker keeps in the second tier; longer ones are counted each time.
CACHE_WORDS = 400_000
LONG_WORD = 64
#: Bytes of a vocabulary file that may be broadcast.
VOCABULARY_BYTES = 64 << 20

#: Characters for which ``str.lower`` and ``str.split`` agree with the library's rules.
PLAIN = regex.compile(r"[^\x00-\x1b\x20-ɏ]").search


def split_plain(text: str) -> list[str]:
    return text.lower().split()


def word_tokenizer(vocabulary: str) -> Tokenizer:
    """The library's tokenizer for single words. Special tokens are cut out of the texts
    before, in the very case they are written in; what becomes one by lower-casing is
    ordinary text."""
    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    return tokenizer


class FrequentWords:
    """Summary of bounded size: when it is full, counts below the median leave it."""

    def __init__(self, limit: int = SUMMARY_WORDS):
        self.counts: Counter[str] = Counter()
        self.limit = limit

    def add(self, words: list[str]) -> None:
        self.counts.update(words)
        if len(self.counts) > 2 * self.limit:
            low = sorted(self.counts.values())[len(self.counts) - self.limit]
            self.counts = Counter({w: n - low for w, n in self.counts.items() if n > low})

    def top(self, n: int) -> list[tuple[str, int]]:
        return self.counts.most_common(n)


def frequent_words(df: DataFrame, text_col: str = "text", table_words: int = TABLE_WORDS, task_words: int = TASK_WORDS) -> list[str]:
    """At most ``table_words`` words, the most frequent ones by the summaries of all tasks.

    Each task reads all of its texts and reports ``task_words`` words at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = FrequentWords()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and not PLAIN(text):
                    summary.add([w for w in split_plain(text) if len(w) <= LONG_WORD])
        top = summary.top(task_words)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    seen = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    table = seen.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_words)
    return [r.word for r in table.select("word").collect()]


class Counts:
    """Word to token count: the broadcast table, then what the worker has met lately."""

    def __init__(self, holder: dict[str, Any]):
        words, counts = holder["words"].split("\n"), array("I", holder["counts"])
        self.table = dict(zip(words, counts, strict=True)) if counts else {}
        self.tokenizer = word_tokenizer(holder["vocabulary"])
        self.met = Generations(CACHE_WORDS)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def _words(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        if not PLAIN(text):
            return split_plain(text)
        text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def of_texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; words that are met for the first time are encoded together."""
        parts = [self.added.split(t) if t and self.added is not None else [t or ""] for t in texts]
        words = [[w for part in own for w in self._words(part)] if len(own) > 1 else self._words(own[0]) for own in parts]
        different = set().union(*words)
        known = {w: self.table[w] for w in different if w in self.table}
        met, missing = self.met.look_up(different - known.keys())
        encoded = self.tokenizer.encode_batch(missing, add_special_tokens=False) if missing else []
        new = {w: len(e.ids) for w, e in zip(missing, encoded, strict=True)}
        self.met.keep({w: n for w, n in new.items() if len(w) <= LONG_WORD})
        known |= met | new
        return [sum(map(known.__getitem__, own)) + len(part) - 1 for own, part in zip(words, parts, strict=True)]


class TokenCounter:
    """Column function that counts tokens by one vocabulary file of the tokenizers library."""

    def __init__(self, spark: SparkSession, vocabulary_path: str, words: list[str]):
        with open(vocabulary_path, encoding="utf-8") as file:
            vocabulary = file.read()
        counts = array("I", [len(e.ids) for e in word_tokenizer(vocabulary).encode_batch(words, add_special_tokens=False)])
        data = {"vocabulary": vocabulary, "words": "\n".join(words), "counts": counts.tobytes()}
        size = len(vocabulary) + 4 * len(words) + len(data["words"])
        self.data = share(spark, data, size, VOCABULARY_BYTES)

    def n_tokens(self, text: Column | str) -> Column:
        data = self.data

        def make() -> Callable[[list], list]:
            counts = once(data, "table", Counts)
            return counts.of_texts
        return text_udf(make, "bigint")(text)


def token_counts(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; other columns are ignored.

    Repeated rows stay repeated, an empty table gives an empty result.
    """
    counter = TokenCounter(df.sparkSession, vocabulary_path, frequent_words(df, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), counter.n_tokens(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
