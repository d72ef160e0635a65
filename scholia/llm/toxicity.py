"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer (an Aho-Corasick automaton) marks words as insults, threats, targets,
negations or reported speech. The marks of a clause run through one transducer for each
rule: an insult or threat carries its weight; one after a negation, one in reported
speech and one that is aimed at a target is put into a class of its own. A document is
scored by the weights of its matched clauses in each class, not by single words.

What is an insult is learned from labelled rows: words and word beginnings that occur in
toxic texts and hardly in others, chosen one after the other so that each one explains
toxic texts the earlier ones do not (words that only come along with copies of a text do
not get in). The influence of the classes is learned by logistic regression. Both use a
bounded sample of the labelled rows and nothing but their texts.

Nulls score like the empty text, which has no clause. Rows keep their number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import once, share, text_udf
from scholia.llm.labelled import labelled_sample, logistic

#: Lengths of word beginnings that may become an entry.
BEGINNINGS = (4, 5, 6, 7)
#: Share of toxic texts among those with an entry; toxic texts an entry must explain.
PRECISION = 0.95
LEAST_TEXTS, LEAST_SHARE = 3, 0.004
#: How many entries should explain a toxic text, entries to choose from, entries chosen.
COVER = 3
CANDIDATES = 20_000
ENTRIES = 1_000
#: Words after a negation that it still reaches; words between a target and an insult.
NEGATED_WORDS = 3
TARGET_WORDS = 5

TARGETS = ["you", "your", "they", "them", "he", "she", "him", "her", "du", "dich", "ihr", "er", "sie", "tu", "toi", "vous", "il", "elle", "ils", "tú", "usted", "él", "ella", "ellos"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "wasn't", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "ningún", "tampoco"]
REPORTS = ["said", "says", "called", "calls", "wrote", "quoted", "reported", "claims", "sagte", "sagt", "nannte", "schrieb", "dit", "disait", "appelle", "écrit", "dijo", "dice", "llamó", "escribió"]
THREATS = ["kill", "murder", "hurt", "destroy", "strangle", "töten", "umbringen", "verletzen", "tuer", "frapper", "détruire", "matar", "golpear", "destruir"]

WORD = regex.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = regex.compile(r"[^.!?;:|\n]+")
QUOTES = regex.compile(r"[\"“”„«»]")
#: Classes of matched patterns; the features are their weights, the strongest clause and the weight per word.
PLAIN, AIMED, NEGATED, REPORTED, THREAT = range(5)
FEATURES = 7


def entries_of(text: str, beginnings: tuple[int, ...] = BEGINNINGS) -> set[str]:
    """The words of a text (with an end mark) and their beginnings."""
    words = set(WORD.findall(text.lower()))
    out = {w + "$" for w in words if len(w) > 2}
    for n in beginnings:
        out |= {w[:n] for w in words if len(w) >= n}
    return out


@dataclass
class Lexicon:
    """Weights of words ("word$") and word beginnings that are insults."""

    weights: dict[str, float] = field(default_factory=dict)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry.rstrip("$"), (len(entry.rstrip("$")), entry.endswith("$"), weight, False))
        for word in THREATS:
            if word not in machine:
                machine.add_word(word, (len(word), True, 1.0, True))
        machine.make_automaton()
        return machine


class Grammar:
    """The composed transducers: from a text to the weights of its clauses."""

    def __init__(self, weights: dict[str, float]):
        self.machine = Lexicon(weights).automaton()
        self.marks = {w: mark for words, mark in ((TARGETS, AIMED), (NEGATIONS, NEGATED), (REPORTS, REPORTED)) for w in words}

    def lexical(self, text: str) -> dict[int, tuple[float, bool]]:
        """Weight of the insult or threat that starts at a place, the longest one there."""
        found: dict[int, tuple[int, float, bool]] = {}
        for end, (size, whole, weight, threat) in self.machine.iter(text):
            start = end + 1 - size
            if start and text[start - 1].isalpha() or whole and text[end + 1:end + 2].isalpha():
                continue
            if start not in found or found[start][0] < size:
                found[start] = size, weight, threat
        return {start: (weight, threat) for start, (_, weight, threat) in found.items()}

    def clause(self, text: str, start: int, insults: dict[int, tuple[float, bool]]) -> np.ndarray:
        """Weights of one clause by class."""
        words = [(start + m.start(), m.group()) for m in WORD.finditer(text)]
        marks = [self.marks.get(w) for _, w in words]
        targets = [i for i, m in enumerate(marks) if m == AIMED]
        quoted = bool(QUOTES.search(text))
        out = np.zeros(5)
        negated = reported = 0
        for i, (place, _) in enumerate(words):
            if marks[i] == NEGATED:
                negated = NEGATED_WORDS + 1
            elif marks[i] == REPORTED:
                reported = 1
            if place in insults:
                weight, threat = insults[place]
                if negated:
                    kind = NEGATED
                elif reported or quoted:
                    kind = REPORTED
                elif threat:
                    kind = THREAT
                else:
                    kind = AIMED if any(abs(i - t) <= TARGET_WORDS for t in targets) else PLAIN
                out[kind] += weight
            negated = max(0, negated - 1)
        return out

    def features(self, text: str | None) -> tuple[list[float], int]:
        """Features of a text, and the number of its matched clauses."""
        if not text:
            return [0.0] * FEATURES, 0
        text = text.lower()
        insults = self.lexical(text)
        if not insults:
            return [0.0] * FEATURES, 0
        total, strongest, matched, places = np.zeros(5), 0.0, 0, sorted(insults)
        at = 0
        for m in CLAUSE.finditer(text):
            while at < len(places) and places[at] < m.start():
                at += 1
            if at < len(places) and places[at] < m.end():
                weights = self.clause(m.group(), m.start(), insults)
                if weights.sum() > 0:
                    total += weights
                    strongest = max(strongest, weights.sum())
                    matched += 1
        words = text.count(" ") + text.count("\n") + 1
        return [*np.log1p(total).tolist(), math.log1p(strongest), math.log1p(100 * total.sum() / words)], matched


def _entry_counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(entries_of(text))
        names = sorted({*toxic, *clean})
        for at in range(0, len(names), 10_000):
            part = names[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[e] for e in part], pa.int64()), pa.array([clean[e] for e in part], pa.int64())],
                                             ["entry", "toxic", "clean"])
    seen = sample.select("text", "label").mapInArrow(run, "entry string, toxic bigint, clean bigint")
    return seen.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(names: list[str], texts: list[list[int]], worth: list[float], least: int, cover: int = COVER, most: int = ENTRIES) -> list[int]:
    """Entries one after the other, each the one that explains most texts that are in need.

    A text is in need until ``cover`` of its entries are chosen. Ties go to the longer and
    then to the smaller entry.
    """
    if not names or not texts:
        return []
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    entry_of = np.concatenate([np.asarray(t, np.int64) for t in texts]) if len(text_of) else np.empty(0, np.int64)
    rank = np.empty(len(names))
    rank[sorted(range(len(names)), key=lambda i: (len(names[i]), worth[i], names[i]))] = np.arange(len(names)) / (len(names) + 1)
    need = np.full(len(texts), cover)
    chosen: list[int] = []
    left = np.ones(len(names), bool)
    while len(chosen) < most:
        gain = np.bincount(entry_of[need[text_of] > 0], minlength=len(names)) * left
        best = int(np.argmax(gain + rank * left))
        if gain[best] < least:
            break
        chosen.append(best)
        left[best] = False
        need[text_of[entry_of == best]] -= 1
        # beginnings of a chosen entry and entries that start with it say nothing new
        stem = names[best].rstrip("$")
        left &= ~np.array([n.rstrip("$").startswith(stem) or stem.startswith(n.rstrip("$")) for n in names])
    return chosen


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries and their log odds from a bounded sample (text, label)."""
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * n_toxic))
    share = (F.col("toxic") + 0.0) / (F.col("toxic") + F.col("clean") * (n_toxic / max(1, n_clean)))
    rows = _entry_counts(sample).where((F.col("toxic") >= least) & (share >= PRECISION)).orderBy(F.desc("toxic"), "entry").limit(CANDIDATES).collect()
    names = [r.entry for r in rows]
    worth = [math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + 0.5) / (n_clean + 1)) for r in rows]
    number = sample.sparkSession.sparkContext.broadcast({n: i for i, n in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            held = [sorted(known[e] for e in entries_of(t) if e in known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], ["entries"])

    toxic = sample.where("label = 1").select("text").mapInArrow(run, "entries array<int>")
    texts = [list(r.entries) for r in toxic.where("size(entries) > 0").collect()]
    return {names[i]: max(0.1, worth[i]) for i in choose(names, texts, worth, least)}


@dataclass
class Model:
    weights: dict[str, float]
    influence: list[float]


def _features(sample: DataFrame, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    grammar = sample.sparkSession.sparkContext.broadcast({"weights": weights})

    def make() -> Callable[[list], list]:
        rules = once(grammar, "grammar", lambda h: Grammar(h["weights"]))
        return lambda texts: [rules.features(t)[0] for t in texts]
    rows = sample.select("label", text_udf(make, "array<double>")("text").alias("x")).collect()
    return np.array([r.x for r in rows], float).reshape(-1, FEATURES), np.array([r.label for r in rows], float)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", **columns: str) -> Model:
    """Lexicon and influence of the classes from a bounded sample of the labelled rows.

    Without labelled rows of both classes nothing is an insult and every text scores low.
    """
    sample, sizes = labelled_sample(docs, labels, label, **columns)
    drawn = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(drawn) < 2:
        return Model({}, [*[0.0] * FEATURES, -4.0])
    weights = learn_lexicon(sample, drawn[1], drawn[0])
    x, y = _features(sample, weights)
    # the classes count as often as in all labelled rows
    weight = np.where(y == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    influence = logistic(np.hstack([x, np.ones((len(x), 1))]), y, weight / weight.mean())
    return Model(weights, influence.tolist())


class Scorer:
    """Column function: struct of score (0 to 1) and clauses (number of matched ones)."""

    def __init__(self, spark: SparkSession, model: Model):
        self.influence = model.influence
        self.data = share(spark, {"weights": model.weights}, 80 * len(model.weights))

    def score(self, text: Column | str) -> Column:
        data, influence = self.data, self.influence

        def make() -> Callable[[list], list]:
            rules = once(data, "grammar", lambda h: Grammar(h["weights"]))

            def one(text: str | None) -> dict:
                x, clauses = rules.features(text)
                z = sum(a * b for a, b in zip(influence, [*x, 1.0], strict=True))
                return {"score": 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), "clauses": clauses}
            return lambda texts: [one(t) for t in texts]
        return text_udf(make, "struct<score:double,clauses:int>")(text)


def score_documents(df: DataFrame, model: Model, text_col: str = "text", out: str = "__toxicity") -> DataFrame:
    """``df`` with a struct ``out`` of score and clauses."""
    return df.withColumn(out, Scorer(df.sparkSession, model).score(F.coalesce(F.col(text_col), F.lit(""))))


def reject(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below ``limit``, with their columns as they are."""
    return score_documents(df, model, text_col).where(F.col("__toxicity.score") < limit).select(*df.columns)
