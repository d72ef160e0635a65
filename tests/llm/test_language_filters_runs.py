"""Language identification, filter audit and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import filter_audit, language_bits, periodic_runs, queries
from scholia.llm.labelled import fold
from tests.llm.conftest import DOCS

BIG = "/root/testdata/sf0.1"


# ---- languages -------------------------------------------------------------

def test_language_on_the_held_out_fold(spark):
    rows = queries.op11_language_id(spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = rows.agg(F.count(F.lit(1)), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert n > 2000 and right / n > 0.995


LETTERS = language_bits.letter_table()


def plain_grams(text, size):
    """Windows of letters with one border at either end, by definition."""
    letters = "\0" + "".join(c.lower()[0] if c.isalpha() else "\0" for c in text) + "\0"
    found = []
    for i in range(1, len(letters)):
        window = letters[i - 1:i - 1 + size]
        if len(window) == size and all(c != "\0" for c in window[1:-1]):
            found.append(window)
    return found


@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_windows_of_blocks(block):
    random.seed(block)
    texts = ["".join(random.choice("abÉß 1.\n日\0") for _ in range(random.randrange(90))) for _ in range(40)] + ["", "x", "ab" * 200]
    for size in language_bits.SIZES:
        got = [Counter() for _ in texts]
        for text, own, starts, owners in language_bits.pieces(texts, block):
            at, h = language_bits.gram_hashes(language_bits.letters_of(text, LETTERS), own, size)
            for a, x in zip(at, h.tolist(), strict=True):
                got[owners[np.searchsorted(starts, a, side="right") - 1]][x] += 1
        want = [Counter(plain_grams(t, size)) for t in texts]
        assert [sorted(g.values()) for g in got] == [sorted(w.values()) for w in want]


def test_filter_gives_all_languages_of_an_ngram(spark):
    """The popcounts equal those of exact sets once chance is taken off."""
    texts = {"xx": "abcabc aab abba cab " * 3, "yy": "xyz xyzzy zyx yyxz " * 3, "zz": "abcabc xyz mnop ponm " * 3}
    rows = spark.createDataFrame([(lang, t + str(i)) for lang, t in texts.items() for i in range(5)], "lang string, text string")
    model = language_bits.learn(rows, share_of_most=0.0)
    scorer = language_bits.Scorer({**model.shared.value})
    exact = {lang: {g for size in language_bits.SIZES for g, n in Counter(plain_grams(t, size) * 5).items() if n >= language_bits.LEAST} for lang, t in texts.items()}
    sample = ["abcabc", "xyz mnop", "cab zyx", "qqq"]
    hits, total, letter = scorer.counts(sample)
    for t, own, n in zip(sample, hits, total, strict=True):
        grams = [g for size in language_bits.SIZES for g in plain_grams(t, size)]
        assert n == len(grams)
        for lang, k in zip(model.languages, own, strict=True):
            assert k >= sum(g in exact[lang] for g in grams)
            assert k <= sum(g in exact[lang] for g in grams) + 1
    assert letter.all() and [x["lang"] for x in scorer.of_texts(["mnop", "yyxz", "aab"])] == ["zz", "yy", "xx"]


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(3)
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    own = {f"l{i:03d}": ["".join(rng.sample(alphabet[4 * i:4 * i + 6], 3)) for _ in range(5)] for i in range(70)}
    rows = spark.createDataFrame([(lang, " ".join(rng.choices(words, k=30))) for lang, words in own.items() for _ in range(3)], "lang string, text string")
    model = language_bits.learn(rows)
    assert len(model.languages) == 70
    found = language_bits.predict(rows, model, out="p")
    assert found.where("p.lang = lang").count() > 0.95 * rows.count()


def test_languages_of_edge_rows(spark, edges, empty):
    taught = spark.createDataFrame([("en", "one word same text here other third no id control"), ("en", "the end of it"), ("fr", "été où ça"), (None, "nothing"), ("de", None)],
                                   "lang string, text string")
    for rows in (taught, taught.limit(0)):
        model = language_bits.learn(rows)
        got = language_bits.predict(edges, model, out="language")
        assert got.count() == edges.count() and set(edges.columns) < set(got.columns)
        for r in got.collect():
            assert 0 <= r.language.score <= 1
            if r.text is None or not any(c.isalpha() for c in r.text) or not model.languages:
                assert tuple(r.language) == ("und", 0.0)
            else:
                assert r.language.lang in model.languages
        assert language_bits.predict(empty, model).count() == 0
    assert language_bits.learn(taught).languages == ["en", "fr"]
    clash = language_bits.predict(edges.withColumn("language", F.lit(1)), language_bits.learn(taught))
    assert clash.columns.count("language") == 1


def test_sample_of_texts_is_bounded(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), F.concat(F.lit("text "), F.least("id", F.lit(2000))).alias("text"))
    sample, languages = language_bits.training_sample(rows, "text", "lang", 100)
    assert languages == ["b", "a"] and 100 < sample.count() < 300 and sample.distinct().count() == sample.count()


# ---- filters ---------------------------------------------------------------

def plain_audit(docs, labels):
    """The same table by applying every order to every document."""
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))

    def fails(doc, text):
        text = text or ""
        words = text.encode().split()
        return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                "D": any(c in "#$%&*|" for c in text), "E": doc is not None and first[text] < doc}
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    table, shapley = {}, Counter()
    facts = [(part or "", doc, fails(doc, text)) for doc, text, part in docs]
    for part in {p for p, _, _ in facts}:
        for order in map("".join, permutations("ABCDE")):
            left = [(doc, f) for p, doc, f in facts if p == part]
            gone = []
            for step, name in enumerate(order, 1):
                hit = [(doc, f) for doc, f in left if f[name]]
                left = [(doc, f) for doc, f in left if not f[name]]
                redundant = sum(f[name] for _, f in gone)
                gone += hit
                alone = sum(f[name] and sum(f.values()) == 1 for p, _, f in facts if p == part)
                shapley[part, name] += len(hit)
                table[part, order, step] = [len(left), len(hit), redundant, alone, sum(d in good for d, _ in hit), sum(d in bad for d, _ in hit)]
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in table.items())


def test_audit_against_every_order(spark):
    rng = random.Random(5)
    bodies = ["", "a b c", "UP CASE " * 60, " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i}" for i in range(120)) + " #", "x " * 150, None, " ".join(f"v{i % 85}" for i in range(105)),
              "the same " * 60 + "|"]
    docs = [(rng.randrange(150) if rng.random() < 0.95 else None, rng.choice(bodies), rng.choice(["en", "fr", None, ""])) for _ in range(200)]
    labels = [(rng.randrange(160) if rng.random() < 0.9 else None, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(5).withColumns({c: F.lit("x") for c in ("row", "part", "id", "n", "mark", "filter")})
    got = filter_audit.filter_audit(table, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs, labels)


def test_relations_hold_the_failing_ids(spark):
    docs = [(1, "a", "en"), (2, "a", "en"), (3, "B|", None)]
    relations = filter_audit.store_relations(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int"))
    sizes = {name: relations.failing(name).count() for name in (*"ABCDE", "quality", "toxic")}
    assert sizes == {"A": 3, "B": 0, "C": 1, "D": 1, "E": 1, "quality": 1, "toxic": 0}


def test_audit_of_edge_rows(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = filter_audit.filter_audit(edges.withColumn("lang", F.lit(None)), none).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert all(r.kept + r.removed <= edges.count() and r.good_lost == r.toxic_lost == 0 for r in rows)
    assert filter_audit.filter_audit(empty.withColumn("lang", F.lit("en")), none).count() == 0


# ---- runs ------------------------------------------------------------------

def plain_runs(words, least_words=6, least_times=4):
    found = []
    for q in range(1, len(words) // least_times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            own = words[i:j + q]
            if j > i and len(own) >= max(least_words, least_times * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                found.append((i, len(own), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_result(words):
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (len(found), *top, "".join("%d,%d,%d\n" % r for r in found), " ".join(w for i, w in enumerate(words) if i not in gone))


def periodic_texts(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, rng.choice([4, 40])))]
            words += unit * rng.randrange(1, 8)
            words = words[:len(words) - rng.randrange(3)]
        texts.append([rng.choice("ab") for _ in range(rng.randrange(70))] if rng.random() < 0.3 else words)
    return texts


@pytest.mark.parametrize("block", [1, 60, 10**6])
def test_runs_against_all_lags(block):
    docs = periodic_texts(block, 500)
    got = periodic_runs.Finder(block_words=block).of_texts([" ".join(d) for d in docs])
    assert [(r["n_runs"], r["start"], r["length"], r["period"], r["runs"], r["kept"]) for r in got] == [plain_result(d) for d in docs]


@pytest.mark.parametrize(("least_words", "least_times"), [(3, 2), (6, 3), (1, 5), (20, 4)])
def test_runs_of_other_lengths(least_words, least_times):
    docs = periodic_texts(least_words, 300)
    got = periodic_runs.Finder(least_words, least_times).of_texts([" ".join(d) for d in docs])
    assert [r["runs"] for r in got] == ["".join("%d,%d,%d\n" % x for x in plain_runs(d, least_words, least_times)) for d in docs]


def test_every_lag_has_a_class():
    served = {}
    for k, low in periodic_runs.classes(5000):
        for q in range(low + 1, k + 1):
            assert max(6, 4 * q) - q >= k >= q
            served[q] = k
    assert set(range(1, 1250)) <= set(served)


def test_long_period_and_long_text():
    unit = [f"w{i}" for i in range(5000)]
    r, s = periodic_runs.Finder().of_texts([" ".join(["x", *unit * 4, *unit[:17], "y"]), "ha " * 300_000])
    assert (r["n_runs"], r["start"], r["length"], r["period"]) == (1, 1, 20_017, 5000)
    assert r["kept"] == " ".join(["x", *unit, "y"]) and (s["runs"], s["kept"]) == ("0,300000,1\n", "ha")


def test_runs_query(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    planted = 0
    for r in queries.op13_periodic_runs(spark, data).collect():
        words, h = texts[r.doc_id].encode().split(), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], planted + 1
        runs, start, length, period, listed, kept = plain_result([w.decode() for w in words])
        assert (r.n_runs, r.start, r.length, r.period) == (runs, start, length, period)
        assert r.exponent_milli == (1000 * length // period if runs else None)
        assert (r.runs_sha256, r.collapsed_sha256) == (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    assert planted > 5


def test_runs_of_edge_rows(spark, edges, empty):
    rows = periodic_runs.periodic_runs(edges, out="found").collect()
    assert len(rows) == edges.count()
    by_id = {r.doc_id: r.found for r in rows}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_words == 0 and by_id[1].kept == "" and by_id[1].start is None
    assert (by_id[8].runs, by_id[8].kept) == ("0,30000,1\n", "word")
    assert periodic_runs.periodic_runs(empty).count() == 0
    cut = periodic_runs.collapse(edges.withColumn("runs", F.lit(1)))
    assert cut.columns == [*edges.columns, "runs"]
    assert {r.text for r in cut.collect() if r.doc_id in (1, 2, 3, 8)} == {None, "", " \n\t ", "word"}
    odd = spark.createDataFrame([(None, "a b c"), (-7, "q " * 50)], DOCS)
    assert queries.repeated_tails(odd).where("doc_id is null").first().text == "a b c"


def test_held_out_fold_of_null_ids(spark):
    assert spark.createDataFrame([(None,)], "doc_id bigint").select(fold("doc_id", 4)).first()[0] == 0
