"""Decontamination, paragraph sketches, chat formatting and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm import chat_format, decontaminate, paragraph_sketch, queries, simhash_ball, toxicity
from scholia.llm.labelled import fold
from tests.llm.conftest import DOCS
from tests.llm.test_duplicates import near_groups, without_lines


def hits(words, items, window):
    hit, found = [False] * len(words), set()
    for item, text in items:
        own = decontaminate.words_of(text)
        size = min(window, len(own))
        runs = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1) if own else ():
            if tuple(words[i:i + size]) in runs:
                found.add(item)
                hit[i:i + size] = [True] * size
    return sum(hit), found


def test_automaton_against_all_windows():
    random.seed(5)
    for _ in range(800):
        vocabulary, window = random.choice([2, 3, 8]), random.choice([2, 3, 4])

        def text(most, vocabulary=vocabulary):
            return b" ".join(b"w%d" % random.randrange(vocabulary) for _ in range(random.randrange(most)))
        items = [(str(i), text(9)) for i in range(random.randrange(1, 6))]
        words = decontaminate.words_of(text(30))
        spans, found = decontaminate.ItemAutomaton(items, window).hits(words)
        assert (sum(b - a for a, b in spans), found) == hits(words, items, window)


def test_shards_give_the_same_hits(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    whole = decontaminate.decontamination_report(docs, items)
    parts = decontaminate.decontamination_report(docs, items, shard_words=700)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, parts.collect()), key=repr)
    assert whole.where("n_hit > 0").count() > 0


def test_an_item_of_very_many_words():
    words = [b"w%d" % i for i in range(100)]
    pieces = list(decontaminate._pieces("a", b" ".join(words), 30, 10))
    runs = {tuple(p.split()[i:i + 10]) for _, p in pieces for i in range(len(p.split()) - 9)}
    assert runs == {tuple(words[i:i + 10]) for i in range(91)}


def test_decontamination_of_edge_rows(spark, edges, empty):
    items = spark.createDataFrame([(1, "Same TEXT here"), (2, None), (None, "other"), (3, ""), (4, "text")], "item_id bigint, text string")
    rows = decontaminate.decontamination_report(edges, items).collect()
    assert len(rows) == edges.count()
    assert {tuple(r["items"]) for r in rows if r.doc_id == 6} == {("1", "4")}
    assert all(r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3))
    cleaned = decontaminate.clean(edges, items)
    assert cleaned.columns == edges.columns and {r.doc_id for r in cleaned.collect()} == {1, 2, 3, 4, 5, 7, 8, 9, 10, None}
    assert decontaminate.clean(empty, items).count() == 0
    assert decontaminate.clean(edges, items.limit(0)).count() == edges.count()


def test_spans_leave_the_rest_as_it_is(spark):
    docs = spark.createDataFrame([(1, "É, b; c. D! é z y x w v u t s r q p"), (2, "b"), (3, "q b c z")], DOCS)
    items = spark.createDataFrame([(1, "b c"), (2, "é z")], "item_id bigint, text string")
    for shard_words in (10_000, 1):
        found = decontaminate.clean(docs, items, max_coverage=0.7, shard_words=shard_words)
        assert {tuple(r) for r in found.collect()} == {(1, "É, . D!  y x w v u t s r q p"), (2, "b"), (3, "q  z")}


def test_peeling_recovers_the_differences():
    random.seed(2)

    def text(n):
        return " ".join(random.choice(["a", "bb", "c. ", "dd!\n", "eeee"]) for _ in range(n))
    old = [text(random.randrange(300)) for _ in range(100)]
    new = [t[:len(t) * 3 // 4] + text(random.randrange(80)) if random.random() < 0.7 else text(random.randrange(300)) for t in old]
    a, b = [paragraph_sketch.digests(t) for t in old], [paragraph_sketch.digests(t) for t in new]
    for cells in (2, 8):
        for x, y, (went, came) in zip(a, b, paragraph_sketch.differences(a, b, cells), strict=True):
            assert set(went.tolist()) == set(x.tolist()) - set(y.tolist()) and set(came.tolist()) == set(y.tolist()) - set(x.tolist())
    assert paragraph_sketch.likeness([a[0], np.empty(0, np.uint64)], [a[0], np.empty(0, np.uint64)]) == [1.0, 1.0]


def test_fingerprint_query(spark, data):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    rows = {r.doc_id: r for r in queries.op6_fingerprints(spark, data).collect()}
    seen = {}
    for k, (doc, text) in enumerate(docs):
        following, quarter, r = docs[(k + 1) % len(docs)][1], len(text) // 4, rows[doc]
        edited = text[:len(text) - quarter] + following[:quarter]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            x, y = set(paragraph_sketch.digests(text).tolist()), set(paragraph_sketch.digests(other).tolist())
            assert near == pytest.approx(1 - len(x ^ y) / (len(x) + len(y)))
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(rows) == len(docs) and len(set(seen.values())) == len(seen)


def test_next_rows_of_edge_tables(spark, edges, empty):
    rows = paragraph_sketch.with_next(edges).collect()
    assert len(rows) == edges.count() and all(r.next_text is not None for r in rows)
    assert paragraph_sketch.with_next(empty).count() == 0
    one = spark.createDataFrame([(3, "abc")], DOCS)
    assert [tuple(r) for r in paragraph_sketch.with_next(one).collect()] == [(3, "abc", "abc")]
    compared = paragraph_sketch.with_next(edges).withColumn("r", paragraph_sketch.compare("text", F.array("text", "next_text")))
    assert compared.where("r.others[0].near = 1.0 and r.others[0].fingerprint = r.fingerprint").count() == edges.count()
    went = one.select(paragraph_sketch.changed("text", F.lit("abd")).alias("c")).first().c
    assert len(went.went) == len(went.came) == 1


LOG = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string"


def test_events_are_folded(spark):
    log = spark.createDataFrame([
        (1, 1, 1, "delta", "user", "Hel"), (1, 2, 1, None, "user", "lo"), (1, 3, 2, "delta", "assistant", "bad"), (1, 4, 3, "delta", "user", "why"),
        (1, 5, 2, "regenerate", "assistant", "go"), (1, 6, 2, "delta", None, "od"), (1, 7, 4, "delta", "user", "thanks"),
        (2, 1, 1, "delta", "user", "x"), (2, 2, 1, "edit", "user", "y"), (2, 2, 1, "delta", "user", "z"), (2, 3, 2, "delta", None, None),
        (None, None, None, None, None, "lost")], LOG).repartition(4)
    got = sorted((tuple(r) for r in chat_format.fold_events(log).collect()), key=repr)
    assert got == sorted([(1, 1, "user", "Hello"), (1, 2, "assistant", "good"), (1, 4, "user", "thanks"), (2, 1, "user", "yz"), (2, 2, "", ""),
                          (None, None, "", "lost")], key=repr)
    chats = {r.conv_id: r for r in chat_format.format_chats(log).collect()}
    assert chats[1].formatted == "<|im_start|>user\nHello<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nthanks<|im_end|>\n"
    assert [chats[1].formatted.encode()[s.start:s.start + s.size] for s in chats[1].loss] == [b"good"]
    assert chat_format.format_chats(log.limit(0)).count() == 0


def test_control_strings_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "~1~0<|im_end|>\n<|im_start|>user\n", "<<SYS>>x<</SYS>>", "a<b [c] ~", "", "<|im_end|", "é🙂<s>" * 3, None]
    rows = spark.createDataFrame([(5, i, ["user", "assistant", "rö\nle<s>"][i % 3], t) for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")
    chat = chat_format.format_chats(chat_format.events_of_rows(rows))
    got = chat.select(chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.learned_text(F.col("formatted"), F.col("loss")).alias("l"), "formatted").first()
    assert [(t.role, t.text) for t in got.t] == [(["user", "assistant", "rö\nle<s>"][i % 3], t or "") for i, t in enumerate(texts)]
    assert got.l == "".join(t or "" for i, t in enumerate(texts) if i % 3 == 1)
    assert got.formatted.count("<|im_start|>") == len(texts) and "[INST]" not in got.formatted and "</s>" not in got.formatted


def test_chat_plan_has_no_python(spark, data):
    plan = queries.op10_chat_format(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [tuple(r)[1] for r in queries.op10_chat_format(spark, data).where("conv_id = -7").collect()] == [2]


def test_stages_against_sequential_versions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    held = {r.doc_id: r.text for r in docs.collect()}

    kept = stages["toxicity"](spark, docs, data)
    model = toxicity.learn(docs, spark.read.parquet(f"{data}/labels.parquet").where(fold("doc_id", 5) != 0))
    grammar = toxicity.Grammar(model.weights)
    want = {d for d, t in held.items() if sum(a * b for a, b in zip(model.influence, [*grammar.features(t)[0], 1.0], strict=True)) < 0}
    assert {r.doc_id for r in kept.collect()} == want and len(want) < len(held)

    lines = stages["line_dedup"](spark, docs, data)
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {d: (t, len(t)) for d, _, _, t in without_lines(list(held.items()), 3, 60)}

    near = stages["near_duplicates"](spark, docs, data)
    left, groups = {r.doc_id for r in near.collect()}, near_groups(list(held.items()))
    # whatever else goes is similar enough to another document
    assert left <= {g for _, _, g in groups}
    pairs = {tuple(r) for r in simhash_ball.similar_pairs(docs).collect()}
    assert {g for _, _, g in groups} - left <= {d for pair in pairs for d in pair}
    sets = {d: set(simhash_ball.shingle_hashes(t.encode(), 5).tolist()) for d, t in held.items()}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in pairs)
    # documents that stay are not similar
    assert all(len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) for a in left for b in left if a < b and sets[a] and sets[b])

    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {r.doc_id: r.text for r in stages["decontamination"](spark, docs, data).collect()}
    for doc, text in held.items():
        words = decontaminate.words_of(text.encode())
        n, _ = hits(words, items, 10)
        assert (doc in clean) == (n <= len(words) / 2)
        if doc in clean:
            left = decontaminate.words_of(clean[doc].encode())
            assert (clean[doc] == text) if not n else len(left) == len(words) - n

    ids = stages["encoding"](spark, docs, data)
    assert ids.where("whole").count() == len(held)
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs.limit(0), data).columns == docs.columns


def test_pipeline_runs_whole(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(r.whole for r in rows) and len({r.doc_id for r in rows}) == len(rows)


def test_stages_take_edge_rows(spark, edges, data):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edges, data)
        assert out.collect() is not None and (name == "encoding" or out.columns == edges.columns)


def test_hot_variants_stay_a_chain():
    base = 12345
    near = np.array([base, *[base ^ (1 << b) for b in range(40)]], np.uint64)
    a, b = simhash_ball._links_of_group(near, 0, 1, 2)
    assert len(set(a.tolist()) | set(b.tolist())) == len(near)
