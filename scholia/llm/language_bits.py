"""Language of a text by n-grams whose languages stand in a bit-sliced Bloom filter.

Every slot of the filter is a row of bits, one a language. An n-gram sets the bits of its
languages in a few slots; the slots of an n-gram of a text, combined by AND, give all the
languages that hold it at once. The number of n-grams with the bit of a language, less the
false positives that the share of set bits predicts, is what decides.

N-grams are windows of letters in lower case, where anything else counts as one border
character at either end. A language holds an n-gram when it is at least ``SHARE`` times as
frequent there as in the language that uses it most, so that foreign sentences inside
texts of a language do not fill its bits.

Learning reads a bounded sample: about ``PER_LANGUAGE`` different texts of each language,
drawn by a hash of the text. The filter has ``SLOTS`` rows however much is learned, so its
broadcast has a fixed size; counting and filling are done on the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.scale import cut
from scholia.llm.common import once, share, text_udf

#: Different texts of each language to learn from.
PER_LANGUAGE = 4_000
#: Letters of a window.
SIZES = (3, 4)
#: Rows of the filter, and the rows an n-gram sets.
SLOTS, PROBES = 1 << 20, 2
#: How frequent an n-gram must be in a language, next to the one that uses it most; and
#: how often it must occur there.
SHARE, LEAST = 0.3, 2
#: Characters looked at in one go; longer texts are cut there, windows are not.
BLOCK_CHARS = 1 << 19
UNDETERMINED = "und"
_WORD = 63
_GRAINS = 1 << 20


def letter_table() -> np.ndarray:
    """Lower-case letter of every code point; 0 for all that is no letter. Made by the driver
    and broadcast, so that a worker keeps one however many tasks it runs."""
    lower = (chr(i).lower() if chr(i).isalpha() else "\0" for i in range(0x110000))
    return np.fromiter((ord(c[0]) for c in lower), np.uint32, 0x110000)


def letters_of(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the key reaches every bit of the hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(letters: np.ndarray, inner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of ``size`` letters.

    ``letters`` begins and ends with a border. A window begins one place before each
    position in ``inner`` and holds letters but for its two ends.
    """
    inside = letters != 0
    good = inner.copy()
    for k in range(1, size - 2):
        good[:-k] &= inside[k:]
        good[-k:] = False
    good &= inside
    at = np.flatnonzero(good)
    at = at[at + size - 2 < len(letters)]
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + letters[at - 1 + k]
    return at, _mixed(h)


def pieces(texts: list[str], block: int = BLOCK_CHARS, overlap: int = max(SIZES)) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in blocks: (characters, which places are a window's second,
    first place of each part, text of each part). A long text has several parts."""
    held: list[str] = []
    flags: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    for n, text in enumerate(texts):
        for at in range(0, len(text), block):
            # the character before, and those after that windows of this part reach
            part = text[max(0, at - 1):at + block + overlap]
            lead = min(at, 1)
            own = np.zeros(len(part) + 2, bool)
            own[1 + lead:1 + lead + min(block, len(text) - at)] = True
            held.append(f"\n{part}\n")
            flags.append(own)
            owners.append(n)
            size += len(own)
            if size >= block:
                yield _laid(held, flags, owners)
                held, flags, owners, size = [], [], [], 0
    if held:
        yield _laid(held, flags, owners)


def _laid(held: list[str], flags: list[np.ndarray], owners: list[int]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(f) for f in flags[:-1])])
    return "".join(held), np.concatenate(flags), starts, np.array(owners)


# ---- learning --------------------------------------------------------------

class Model:
    """What was learned: languages, most frequent first, and the filter (broadcast)."""

    def __init__(self, languages: list[str], shared: Any, filled: list[float]):
        self.languages, self.shared, self.filled = languages, shared, filled


def training_sample(rows: DataFrame, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> tuple[DataFrame, list[str]]:
    """(lang, text): about ``per_language`` different texts of each language, and the
    languages by number of rows, then by name. Rows without text or language are left out."""
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = sorted(((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    spark = rows.sparkSession
    shares = spark.createDataFrame([(lang, i, min(_GRAINS, -(-per_language * _GRAINS // n))) for i, (lang, n) in enumerate(sizes)], "lang string, language int, grains bigint")
    drawn = (rows.join(F.broadcast(shares), "lang").withColumn("key", F.xxhash64("text"))
             .where(F.pmod("key", F.lit(_GRAINS)) < F.col("grains")).select("language", "text", "key"))
    return cut(drawn.dropDuplicates(["language", "key"]).select("language", "text")), [lang for lang, _ in sizes]


def _counted(batches: Iterator[pa.RecordBatch], shared: Any) -> Iterator[pa.RecordBatch]:
    """(language, gram, n) of the texts of every batch."""
    table = once(shared, "letter_table", _letters)
    for batch in batches:
        language = np.array(batch.column(0).to_pylist(), np.int64)
        for text, own, starts, owners in pieces(batch.column(1).to_pylist()):
            letters = letters_of(text, table)
            of_place = language[owners]
            for size in SIZES:
                at, h = gram_hashes(letters, own, size)
                lang = of_place[np.searchsorted(starts, at, side="right") - 1]
                order = np.lexsort((h, lang))
                lang, h = lang[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
                n = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(lang[new].astype(np.int32)), pa.array(h[new].view(np.int64)), pa.array(n.astype(np.int64))], ["language", "gram", "n"])


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, slots: int = SLOTS, share_of_most: float = SHARE) -> Model:
    """Filter of the languages in ``rows(text, lang)``; without any row one that holds none.

    ``slots`` is a power of two. The filter takes 8 * slots bytes for every 63 languages.
    """
    spark = rows.sparkSession
    sample, languages = training_sample(rows, text_col, lang_col, per_language)
    letters = letter_table().tobytes()
    lookup = share(spark, {"letters": letters}, len(letters))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, lookup)
    seen = sample.mapInArrow(counted, "language int, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    seen = cut(seen)
    totals = seen.groupBy("language").agg(F.sum("n").alias("total"))
    rates = seen.join(F.broadcast(totals), "language").select("language", "gram", "n", (F.col("n") / F.col("total")).alias("rate"))
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    held = rates.join(most, "gram").where((F.col("rate") >= share_of_most * F.col("most")) & (F.col("n") >= LEAST))
    # both halves of the hash give a slot
    probes = [F.shiftrightunsigned("gram", (32 * k) % 64).bitwiseAND(F.lit(slots - 1)) for k in range(PROBES)]
    bits = (held.select(F.explode(F.array(*probes)).alias("slot"), F.floor(F.col("language") / _WORD).cast("int").alias("word"),
                        F.expr(f"shiftleft(1L, language % {_WORD})").alias("bit"))
            .groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")))
    words = max(1, -(-len(languages) // _WORD))
    table = np.zeros((words, slots), np.uint64)
    found = bits.toPandas()
    table[found["word"].to_numpy(np.int64), found["slot"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    filled = [float(((table[i // _WORD] >> np.uint64(i % _WORD)) & np.uint64(1)).mean()) for i in range(len(languages))]
    return Model(languages, share(
        spark, {"table": table.tobytes(), "slots": slots, "languages": languages, "filled": filled, "letters": letters}, table.nbytes + len(letters)), filled)


def _letters(holder: dict[str, Any]) -> np.ndarray:
    return np.frombuffer(holder["letters"], np.uint32)


# ---- prediction ------------------------------------------------------------

class Scorer:
    """Counts n-grams by language and takes off what the filter lets through by chance."""

    def __init__(self, holder: dict[str, Any]):
        self.languages, self.slots = holder["languages"], holder["slots"]
        self.letters = _letters(holder)
        self.table = np.frombuffer(holder["table"], np.uint64).reshape(-1, self.slots)
        self.chance = np.array(holder["filled"], float) ** PROBES

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """N-grams of each text and language, n-grams of each text, and whether it has a letter."""
        hits = np.zeros((len(texts), len(self.languages)))
        total, letter = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for text, own, starts, owners in pieces(texts):
            letters = letters_of(text, self.letters)
            np.logical_or.at(letter, owners, np.logical_or.reduceat(letters != 0, starts))
            for size in SIZES:
                at, h = gram_hashes(letters, own, size)
                ends = np.append(np.searchsorted(at, starts), len(at))
                some = np.flatnonzero(np.diff(ends))
                if not len(some):
                    continue
                np.add.at(total, owners, np.diff(ends))
                slot = [((h >> np.uint64((32 * k) % 64)) & np.uint64(self.slots - 1)).astype(np.int64) for k in range(PROBES)]
                for word, rows in enumerate(self.table):
                    bits = rows[slot[0]]
                    for s in slot[1:]:
                        bits &= rows[s]
                    for i in range(word * _WORD, min(len(self.languages), (word + 1) * _WORD)):
                        set_ = ((bits >> np.uint64(i % _WORD)) & np.uint64(1)).astype(np.int32)
                        np.add.at(hits[:, i], owners[some], np.add.reduceat(set_, ends[some]))
        return hits, total, letter

    def of_texts(self, texts: list[str | None]) -> list[dict[str, Any]]:
        hits, total, letter = self.counts([t or "" for t in texts])
        real = np.maximum(0, (hits - total[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9))
        out = []
        for own, has in zip(real, letter, strict=True):
            if not has or not self.languages:
                out.append({"lang": UNDETERMINED, "score": 0.0})
                continue
            best = int(own.argmax())
            out.append({"lang": self.languages[best], "score": float(own[best] / own.sum()) if own.sum() > 0 else 0.0})
        return out


def predict_column(model: Model, text: Column | str) -> Column:
    """struct(lang, score) of a text.

    ``und`` and 0 for a null or empty text, one without a letter, or when nothing was
    learned. A text with letters but no known n-gram gets the most frequent language and 0.
    The score is the share of the language in the corrected counts of all; ties go to the
    language with more rows.
    """
    shared = model.shared

    def make() -> Callable[[list], list]:
        return once(shared, "scorer", Scorer).of_texts
    return text_udf(make, "struct<lang: string, score: double>")(text)


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a column ``out`` (added or replaced), see :func:`predict_column`.
    Rows are judged alone, so repeated rows and ids stay; an empty table stays empty."""
    return docs.withColumn(out, predict_column(model, F.col(text_col).cast("string")))
