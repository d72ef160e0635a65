import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from scholia.functions import scale
from scholia.operators import evaluation, lexical, neighbours, ranking, vectors
from scholia.plans.views import Tables
from scholia.sources import sinks


def chunk_df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id bigint, text string")


TEXTS = ["red apples and green pears", "green green grass of home", "the quick brown fox", "apples apples apples", "home is where the fox is", "", "x y"]


def test_in_place_scoring_equals_the_shuffled_join(spark, monkeypatch):
    chunks = chunk_df(spark, TEXTS * 30)
    queries = spark.createDataFrame([(1, "green apples green"), (2, "the fox at home"), (3, "zzz"), (4, "")], "query_id bigint, query string")
    fast = rows(lexical.bm25_topk(chunks, queries, 7))
    monkeypatch.setattr(lexical, "SCORE_CELLS", 8)
    small_blocks = rows(lexical.bm25_topk(chunks, queries, 7))
    monkeypatch.setattr(lexical, "QUERY_TERMS", 0)
    joined = rows(lexical.bm25_topk(chunks, queries, 7))
    assert fast == joined == small_blocks and len(fast) == 14


def test_repeated_query_term_counts_twice(spark):
    chunks = chunk_df(spark, TEXTS)
    q = spark.createDataFrame([(1, "fox"), (2, "fox fox")], "query_id bigint, query string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.bm25_topk(chunks, q).collect()}
    assert abs(got[(2, 2)] - 2 * got[(1, 2)]) < 1e-5


def test_append_and_delete_equal_rebuild(spark):
    a, b = chunk_df(spark, TEXTS[:4]), spark.createDataFrame([(9, TEXTS[4]), (10, "red red fox")], "chunk_id bigint, text string")
    full = lexical.doc_freq(a.union(b))
    assert rows(lexical.merge_df(lexical.doc_freq(a), lexical.doc_freq(b))) == rows(full)
    assert rows(lexical.subtract_df(full, lexical.doc_freq(b))) == rows(lexical.doc_freq(a))
    assert rows(lexical.merge_stats(lexical.corpus_stats(a), lexical.corpus_stats(b))) == rows(lexical.corpus_stats(a.union(b)))


def random_vectors(n, dim=8, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_knn_blocks_equal_broadcast(spark, monkeypatch):
    m = random_vectors(120)
    m[30:60] = m[0]  # a quarter of all rows are copies: ties go to the lower id
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item_id bigint, ivec array<double>")
    queries = items.select(F.col("item_id").alias("query_id"), F.col("ivec").alias("qvec"))
    one = rows(vectors.knn_topk(queries, items, 5, skip_self=True))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 50)
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 30)
    two = rows(vectors.knn_topk(queries, items, 5, skip_self=True))
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -9)
    want = sorted(((q, int(i), float(s[q, i]), r + 1) for q in range(len(m)) for r, i in enumerate(np.lexsort((np.arange(len(m)), -s[q]))[:5])), key=repr)
    assert one == two
    assert [(q, i, r) for q, i, _, r in one] == [(q, i, r) for q, i, _, r in want]


def sequential_leaders(vecs, bar):
    leaders, out = [], {}
    for i, v in enumerate(vecs):
        hit = next((l for l in leaders if round(float(vecs[l] @ v), 6) >= bar), None)
        out[i] = i if hit is None else hit
        if hit is None:
            leaders.append(i)
    return out


def test_leaders_equal_the_sequential_fold(spark):
    m = random_vectors(200, 4, 7)
    m[100:150] = m[3]  # hot group of copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")
    want = sequential_leaders(m, 0.85)
    for few in (7, 4096):
        got = {r["id"]: r["leader_id"] for r in vectors.near_dup_leaders(df, 0.85, greedy_rows=few).collect()}
        assert got == want


def test_leaders_in_another_order_and_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 23)
    m = random_vectors(120, 3, 8)
    places = np.random.default_rng(2).permutation(120)
    df = spark.createDataFrame([(i, int(places[i]), v.tolist()) for i, v in enumerate(m)], "id bigint, arrival bigint, vec array<double>")
    by_place = np.argsort(places)
    want = {int(by_place[a]): int(by_place[b]) for a, b in sequential_leaders(m[by_place], 0.9).items()}
    for few in (5, 4096):
        assert {r["id"]: r["leader_id"] for r in vectors.near_dup_leaders(df, 0.9, order="arrival", greedy_rows=few).collect()} == want


def test_a_chain_of_neighbours(spark):
    """Each row is near the next one only: every other row leads."""
    angles = np.arange(40) * 0.5
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))] + [0.0] * i + [0.6] + [0.0] * (39 - i)) for i, a in enumerate(angles)], "id bigint, vec array<double>")
    m = np.array([r["vec"] for r in df.orderBy("id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {r["id"]: r["leader_id"] for r in vectors.near_dup_leaders(df, 0.55, greedy_rows=2).collect()}
    assert got == sequential_leaders(m, 0.55)


def test_leaders_stay_on_the_cluster(spark, monkeypatch):
    """Neither vectors nor leaders come to the driver: only counts and bounds do."""
    from pyspark.sql import DataFrame
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("pulled to the driver"))
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("pulled to the driver"))
    m = random_vectors(60, 4, 9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")
    vectors.near_dup_leaders(df, 0.85, greedy_rows=5)


def test_leader_is_not_transitive(spark):
    a, b, c = [1.0, 0.0], [0.87, 0.49], [0.52, 0.85]  # a~b, b~c, not a~c
    df = spark.createDataFrame([(0, a), (1, b), (2, c)], "id bigint, vec array<double>")
    assert rows(vectors.near_dup_leaders(df, 0.85)) == [(0, 0), (1, 0), (2, 2)]


def test_known_leaders_come_first(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0])], "id bigint, vec array<double>")
    known = spark.createDataFrame([(1, [0.99, 0.14])], "id bigint, vec array<double>")
    assert rows(vectors.near_dup_leaders(df, 0.85, known=known)) == [(5, 1), (6, 6)]


def test_embedders_agree(spark):
    df = spark.createDataFrame([(1, "one two two three"), (2, "")], "id int, text string")
    both = vectors.embed_hashed(df).withColumn("jvm", vectors.hashed_vector("text")).collect()
    for r in both:
        assert np.allclose(r["embedding"], r["jvm"])
    assert abs(sum(x * x for x in both[0]["embedding"]) - 1) < 1e-9


def test_pluggable_model(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id int, text string")
    got = rows(vectors.embed_batch(df, lambda: (lambda texts: np.array([[len(t), 1.0] for t in texts]))).select("id", "embedding"))
    assert got == [(1, [2.0, 1.0]), (2, [4.0, 1.0])]


def test_cosine_of_zero_vector(spark):
    assert spark.sql("select array(0.0D,0.0D) a, array(1.0D,0.0D) b").select(vectors.cosine("a", "b")).first()[0] == 0.0


def test_rrf_text_identity(spark):
    lists = spark.createDataFrame([(1, 0, 1, 2, "t", 10), (1, 0, 2, 2, "u", 11), (1, 1, 1, 1, "t", 12), (1, 0, 3, 2, "t", 13)],
                                  "query_id bigint, list_no int, rank int, weight int, text string, chunk_id bigint")
    got = rows(ranking.rrf(lists))
    assert got[0][0:2] == (1, 1) and got[0][3:] == ("t", 10)
    assert abs(got[0][2] - (2 / 61 + 1 / 61 + 2 / 63)) < 1e-6


def test_sibling_expansion_order_and_limit(spark):
    chunks = spark.createDataFrame([(1, 100, 0, 3, "a"), (2, 100, 1, 3, "b"), (3, 100, 2, 3, "c"), (4, 200, 0, 4, "d"), (5, 300, 0, 1, "e")],
                                   "chunk_id bigint, parent_id bigint, sibling_index bigint, sibling_count bigint, text string")
    res = spark.createDataFrame([(1, 1, 0.9, "c", 3), (1, 2, 0.8, "d", 4), (1, 3, 0.7, "a", 1), (1, 4, 0.6, "e", 5)],
                                "query_id bigint, rank int, score double, text string, chunk_id bigint")
    got = [(r["text"], r["expanded"], r["score"]) for r in ranking.sibling_expand(res, chunks, limit=4).orderBy("rank").collect()]
    assert got == [("c", 0, 0.9), ("b", 1, 0.855), ("d", 0, 0.8), ("a", 0, 0.7)]


def test_conflict_best_can_win_and_tie(spark):
    items = spark.createDataFrame([(1, "a", "t", 8, 0.5, 0), (1, "b", "t", 7, 0.5, 0), (1, "c", "t", 4, 0.5, 0), (1, "d", None, None, 0.1, None)],
                                  "q int, name string, topic string, specificity int, score double, stars int")
    got = {r["name"]: (r["decision"], r["topic"]) for r in ranking.conflict_resolve(items, ["q"]).collect()}
    assert got == {"a": ("winner", "t"), "b": ("conflict", "t"), "c": ("suppressed", "t"), "d": ("winner", "d")}


def test_decompose(spark):
    t = spark.createDataFrame([(1, "build service with retries and logging")], "query_id int, query string")
    got = [r["part"] for r in ranking.decompose(t).orderBy("pos").collect()]
    assert got[:4] == ["build service with retries and logging", "build service", "retries", "logging"]
    assert "build service with retries" in got and len(got) <= 8


def test_concepts(spark):
    t = spark.createDataFrame([(1, "how to use error handling in async python web code")], "query_id int, query string")
    assert {r["concept"] for r in ranking.concepts(t).collect()} == {"use", "error", "handling", "async", "python", "web", "code"}
    two = spark.createDataFrame([(1, "error handling for the python")], "query_id int, query string")
    assert {r["concept"] for r in ranking.concepts(two).collect()} == {"error handling", "python"}


def test_route(spark):
    cat = spark.createDataFrame([("py", ["async", "web scraping"], ["java"], ["py"]), ("jv", ["class"], [], ["java"]), ("any", ["async"], [], [])],
                                "name string, keywords array<string>, anti_keywords array<string>, languages array<string>")
    tasks = spark.createDataFrame([(1, "Async web scraping", "py"), (2, "a class with async", "java"), (3, "nothing", None)], "task_id int, task string, language string")
    got = rows(ranking.route(tasks, cat, [("py", "any", "py first")]))
    assert got == [(1, "py", "any", None, "py first"), (2, "jv", "any", None, None)]


def test_keyword_fallback(spark):
    cat = spark.createDataFrame([("alpha", "tools for parsing", ["json parser"]), ("beta", "about parsing", None), ("gamma", "x", ["zip"])], "name string, description string, keywords array<string>")
    q = spark.createDataFrame([(1, "fast json reading"), (2, "unzip files"), (3, "json")], "query_id int, query string")
    res = spark.createDataFrame([(3, "alpha", 0.9)], "query_id int, name string, score double")
    assert rows(ranking.keyword_fallback(q, res, cat)) == [(1, "alpha"), (2, "gamma")]


def test_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 11, 3), (2, 20, 1)], "query_id int, item_id int, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 12), (2, 21)], "query_id int, item_id int")
    qs = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert evaluation.mrr_at_k(run, rel, qs).first()[0] == round(0.5 / 3, 6)
    assert evaluation.recall_at_k(run, rel).first()[0] == 0.25
    ideal = 1 + 1 / np.log2(3)
    assert evaluation.ndcg_at_k(run, rel, qs).first()[0] == round(1 / np.log2(3) / ideal / 3, 6)
    raw = evaluation.ndcg_at_k(run, rel, qs, dedup=False).first()[0]
    assert raw == round((1 / np.log2(3) + 1 / 2) / ideal / 3, 6)


def test_judgements_anchor_numbers(spark):
    df = spark.createDataFrame([(1, "intro\n1. PASS - fine\n11. FAIL - no\n3. pass — ok", 3)], "eval_id int, reply string, expected int")
    got = [(r["n"], r["ok"], r["reason"]) for r in evaluation.parse_judgements(df).orderBy("n").collect()]
    assert got == [(1, True, "fine"), (2, False, evaluation.MISSING_REASON), (3, True, "ok")]


def test_tier_badge(spark):
    c = spark.createDataFrame([(1, "bronze", True), (1, "gold", True), (1, "platinum", False), (2, "bronze", False), (2, "silver", True)], "item_id int, tier string, ok boolean")
    assert rows(evaluation.tier_badge(c)) == [(1, "gold"), (2, None)]


def test_judgements_of_short_passages(spark, tmp_path):
    from scholia.plans.views import Tables
    spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta"), (2, "x beta gamma y"), (3, "xab cdy"), (4, None), (5, "ab")], "doc_id bigint, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta theta"), (2, "beta gamma y"), (3, "ab cd"), (4, "ab"), (5, None)], "item_id bigint, text string") \
        .write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in Tables(spark, str(tmp_path)).v_qrels.collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 3), (4, 5)}


def test_lines_of_a_very_long_document_keep_their_numbers(spark):
    from scholia.functions.text import chunk_number, document_of
    from scholia.streaming.jobs import chunk_lines
    docs = spark.createDataFrame([(1, "a\n" * 150_000), (2, "b")], "doc_id bigint, text string")
    rows = chunk_lines(docs)
    assert rows.select("chunk_id").distinct().count() == 150_001
    assert rows.where(document_of("chunk_id") != F.col("doc_id")).count() == 0
    with pytest.raises(Exception, match="2\\^27"):
        docs.select(chunk_number("doc_id", F.lit(1 << 27))).collect()


def test_vectors_without_length_lead_themselves(spark):
    v = vectors.embed_hashed(spark.createDataFrame([(1, "!!"), (2, "??"), (3, "red fox"), (4, "red fox")], "chunk_id bigint, text string"))
    rows = v.selectExpr("chunk_id AS id", "embedding AS vec").unionByName(spark.createDataFrame([(5, None)], "id bigint, vec array<double>"))
    assert {tuple(r) for r in vectors.near_dup_leaders(rows).collect()} == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 5)}


def test_known_leaders_by_arrival(spark):
    one = [1.0, 0.0]
    known = spark.createDataFrame([(9, one, 0), (5, [0.99, 0.1], 1)], "id bigint, vec array<double>, seq int")
    rows = spark.createDataFrame([(1, one)], "id bigint, vec array<double>")
    assert vectors.near_dup_leaders(rows, 0.9, known=known).first()["leader_id"] == 9
    assert vectors.near_dup_leaders(rows, 0.9, known=known, greedy_rows=1).first()["leader_id"] == 9


def test_missing_vectors_are_no_hits(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id bigint, qvec array<double>")
    i = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [None, 1.0])], "item_id bigint, ivec array<double>")
    assert [tuple(r)[:2] for r in vectors.knn_topk(q, i, 3).collect()] == [(1, 7)]


def test_cache_takes_the_smallest_text_of_a_key(spark):
    items = spark.createDataFrame([("k", "zebra fox"), ("k", "apple pie")], "key string, text string")
    empty = spark.createDataFrame([], "key string, embedding array<double>")
    got = vectors.fill_cache(items, empty, "key", "text").first()["embedding"]
    assert got == vectors.embed_hashed(items.where("text = 'apple pie'")).first()["embedding"]


# ---- neighbours from an index ----------------------------------------------

def found_of(spark, items, queries, k=10, target=neighbours.TARGET):
    signatures = neighbours.fit(items, k, target)
    index = neighbours.build(items, signatures)
    assert index.count() == items.where("ivec is not null").count()
    return signatures, neighbours.search(index, queries, signatures, k, skip_self=True)


def test_recall_on_the_embeddings(spark):
    """Vectors without structure: recall holds, at the price of probing most buckets."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    items = table.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("ivec"))
    queries = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    signatures, found = found_of(spark, items, queries)
    assert neighbours.recall(found, vectors.knn_topk(queries, items, 10, skip_self=True)) >= 0.9


def test_recall_and_probes_on_clustered_vectors(spark, monkeypatch):
    """Vectors in groups: the same recall from a small part of the buckets."""
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 16)
    monkeypatch.setattr(neighbours, "PIECE_ROWS", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 32))
    m = centres[rng.integers(0, 150, 6000)] + 0.25 * rng.normal(size=(6000, 32))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item_id bigint, ivec array<double>").cache()
    queries = items.where("item_id % 20 = 0").selectExpr("item_id AS query_id", "ivec AS qvec")
    signatures, found = found_of(spark, items, queries)
    exact = vectors.knn_topk(queries, items, 10, skip_self=True)
    assert neighbours.recall(found, exact) >= 0.9
    assert signatures.probes <= 0.25 * 2 ** signatures.bits
    # scores are exact: what both have in common is scored alike
    both = found.join(exact.withColumnRenamed("score", "want"), ["query_id", "item_id"])
    assert both.where("score <> want").count() == 0


def test_probe_order_is_nearest_first():
    s = neighbours.Signatures(neighbours._planes(8, 5, 1), 1, 1.0)
    q = random_vectors(20, 8, 3)
    order = s.probe_order(q, 32)
    assert (order[:, 0] == s.buckets(q)).all() and all(len(set(r)) == 32 for r in order.tolist())
    margin = (q @ s.planes) ** 2
    cost = np.array([[sum(margin[i, b] for b in range(5) if (own[0] ^ x) >> b & 1) for x in own] for i, own in enumerate(order)])
    assert (np.diff(cost, axis=1) >= -1e-12).all()


def test_index_of_odd_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, ivec array<double>")
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0])], "item_id bigint, ivec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (9, None)], "query_id bigint, qvec array<double>")
    assert neighbours.search(neighbours.build(none, neighbours.fit(none)), queries, neighbours.fit(none)).count() == 0
    signatures = neighbours.fit(odd)
    got = neighbours.search(neighbours.build(odd, signatures), queries, signatures, 3)
    assert sorted((r.query_id, r.item_id, r.score) for r in got.collect()) == [(1, 1, 1.0), (1, 4, 0.0)]


def test_recommend_scores_a_missing_vector_with_zero(spark):
    profiles = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, qvec array<double>")
    catalog = spark.createDataFrame([(1, "Up", [1.0, 0.1]), (2, "None", None), (3, "Down", [-1.0, 0.0]), (4, "Have", [1.0, 0.0])], "item_id bigint, name string, ivec array<double>")
    installed = spark.createDataFrame([(1, "HAVE"), (1, "have"), (1, "elsewhere")], "query_id bigint, name string")
    got = [(r.item_id, r.rank) for r in vectors.recommend(profiles, catalog, installed, 5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]


# ---- stored index ----------------------------------------------------------

@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two runs of an index, and all their chunks."""
    from scholia.sources import sinks
    path = str(tmp_path_factory.mktemp("index"))
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 25), p=np.arange(60, 0, -1) / 1830)) for _ in range(900)] + TEXTS
    chunks = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, chunk_id bigint, text string")
    sinks.write_index(chunks.where("chunk_id < 600"), path)
    sinks.write_index(chunks.where("chunk_id >= 600"), path)
    return chunks, sinks.read_index(spark, path)


def test_search_of_the_stored_index(spark, stored):
    chunks, index = stored
    queries = spark.createDataFrame([(1, "w1 w2 w2 w59"), (2, "w58"), (3, "the fox at home"), (4, "zzz"), (5, ""), (6, " ".join(f"w{i}" for i in range(60)))], "query_id bigint, query string")
    for k in (3, 20):
        want = rows(lexical.bm25_topk(chunks, queries, k))
        assert rows(lexical.bm25_index_topk(index, queries, k)) == want
        assert rows(lexical.bm25_lookup_topk(index, queries, k)) == want


def test_blocks_without_a_hit_are_skipped(spark, monkeypatch, tmp_path):
    """The chunks of one block are far better than all others: only its postings are scored."""
    from scholia.sources import sinks
    monkeypatch.setattr(sinks, "BLOCK_CHUNKS", 10)
    texts = ["red " * 30] * 30 + ["red " + "x" * 5 + " filler words here and there"] * 970
    chunks = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, chunk_id bigint, text string")
    sinks.write_index(chunks, str(tmp_path / "i"))
    index = sinks.read_index(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame([(1, "red")], "query_id bigint, query string")
    got = lexical.bm25_lookup_topk(index, queries, 5)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [r.chunk_id for r in lexical.bm25_topk(chunks, queries, 5).orderBy("rank").collect()]
    assert index["bounds"].where("term = 'red'").select("block").distinct().count() > 50


def test_hybrid_search_from_the_index_equals_the_chunks(spark, stored):
    chunks, index = stored
    full = chunks.selectExpr("chunk_id", "text", "chunk_id div 3 AS parent_id", "chunk_id % 3 AS sibling_index", "3 AS sibling_count")
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "quick brown fox")], "query_id bigint, query string")
    assert rows(ranking.hybrid_search(full, queries, index=index)) == rows(ranking.hybrid_search(full, queries))


def test_coverage_by_the_stored_index(spark, stored):
    chunks, index = stored
    names = spark.createDataFrame([("fox",), ("Fox!",), ("w1 w2",), ("zzz",), ("",), (None,), ("w0",)], "name string")
    best = {r.query_id: r.score for r in lexical.bm25_topk(chunks, names.where("name is not null").selectExpr("name AS query", "hash(name) AS query_id").selectExpr("cast(query_id AS bigint) AS query_id", "query"), 1).collect()}
    hashed = {r.name: r.h for r in names.where("name is not null").selectExpr("name", "cast(hash(name) AS bigint) AS h").collect()}
    got = {r.name: r.covered for r in lexical.covered(names, index, 2.0).collect()}
    assert got == {n: int(best.get(h, 0) >= 2.0) for n, h in hashed.items()} and 0 < sum(got.values()) < len(got)
    assert {r.covered for r in lexical.covered(names, None).collect()} == {None}


def test_route_forms_candidates_by_text(spark):
    """Three names a task of all those with a keyword, against a loop over all pairs."""
    import random
    rnd = random.Random(5)
    words = ["ant", "bee", "cat", "dog", "eel", "fox"]
    catalog = [(f"n{i}", rnd.sample(words, 2), rnd.sample(words, 1), rnd.choice([["py"], ["go", "ts"], []])) for i in range(12)]
    tasks = [(i % 40, " ".join(rnd.sample(words, 3)).upper(), rnd.choice(["py", "ts", "", None])) for i in range(60)]
    best = {}
    for task, text, lang in tasks:
        for name, kw, anti, langs in catalog:
            hits = sum(k in text.lower() for k in kw)
            score = hits * 2.0 - 3.0 * sum(a in text.lower() for a in anti) + (0.0 if not lang else 3.0 if lang in langs else -5.0 if langs else 0.0)
            if hits and score > 0:
                best.setdefault(task, []).append((-score, name))
    want = {t: tuple(([n for _, n in sorted(v)] + [None] * 3)[:3]) for t, v in best.items()}
    out = ranking.route(spark.createDataFrame(tasks, "task_id int, task string, language string"),
                        spark.createDataFrame(catalog, "name string, keywords array<string>, anti_keywords array<string>, languages array<string>"))
    assert {r.task_id: (r.primary, r.secondary, r.third) for r in out.collect()} == want
    import re
    assert not re.search(r"hashpartitioning\(task#\d+, name#", out._jdf.queryExecution().executedPlan().toString())


def test_no_score_is_shuffled(spark):
    import re
    chunks = spark.createDataFrame([(i, f"red fox {i % 3} owl owl") for i in range(40)], "chunk_id bigint, text string")
    queries = spark.createDataFrame([(1, "red owl"), (2, "fox 11")], "query_id bigint, query string")
    got = lexical.bm25_scores(lexical.postings(chunks), lexical.doc_freq(chunks), lexical.corpus_stats(chunks), queries)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id#", got._jdf.queryExecution().executedPlan().toString())
    assert got.count() == 80


def test_an_index_is_written_without_sorting_all_postings(spark, tmp_path):
    rows_ = [("s", 1, "red fox fox"), ("s", 1, "red fox fox"), ("s", 2, "blue"), ("s", None, "red"), ("s", None, "red owl")]
    chunks = spark.createDataFrame(rows_, "source string, chunk_id bigint, text string")
    sinks.write_index(chunks, f"{tmp_path}/i")
    index = sinks.read_index(spark, f"{tmp_path}/i")
    assert rows(index["postings"].select("chunk_id", "term", "tf")) == rows(lexical.postings(chunks).select("chunk_id", "term", "tf"))
    bounds = lexical.posting_bounds(index["postings"])
    assert "SortAggregate" not in bounds._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r.best) for r in bounds.where("term = 'fox'").collect()] == [(4, 3)]
    texts = chunks.select("chunk_id", "text")
    plan = ranking.with_chunks(spark.createDataFrame([(1, 2)], "query_id bigint, chunk_id bigint"), texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_a_task_returns_k_rows_a_query_however_many_batches_it_reads(spark):
    rows = spark.createDataFrame([(n, 2, ["aa", f"b{n % 7}"], [1 + n % 5, 1]) for n in range(60)], "chunk_id long, len long, ts array<string>, tfs array<long>")
    weighted = pd.DataFrame({"query_id": [1, 1, 2], "term": ["aa", "b3", "aa"], "avg_len": 2.0, "weight": [1.0, 0.5, 1.0]})
    vecs = spark.createDataFrame([(n, [1.0, float(n % 9)]) for n in range(60)], "item_id long, ivec array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, qvec array<double>")
    whole = sorted(map(tuple, lexical._score_in_place(rows.coalesce(1), weighted, 60).collect()), key=lambda r: (r[0], -r[2], r[1]))
    want = [r for q in (1, 2) for r in [w for w in whole if w[0] == q][:4]]
    near = sorted(map(tuple, vectors.knn_topk(asked, vecs, 4).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got = lexical._score_in_place(rows.coalesce(1), weighted, 4).collect()
        again = sorted(map(tuple, vectors.knn_topk(asked, vecs.coalesce(1), 4).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=lambda r: (r[0], -r[2], r[1])) == want
    assert again == near


def test_best_of_task_holds_a_bounded_number_of_rows(monkeypatch):
    monkeypatch.setattr(scale, "KEPT_ROWS", 10)
    parts = [pd.DataFrame({"query_id": [1, 1, 2], "item_id": [3 * n, 3 * n + 1, 3 * n + 2], "score": [n % 4, 1.0, n % 3]}) for n in range(30)]
    [got] = scale.best_of_task(iter(parts), 2, "item_id")
    every = pd.concat(parts).sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
    assert got.values.tolist() == every.groupby("query_id").head(2).values.tolist()
    assert list(scale.best_of_task(iter([]), 2, "item_id")) == []


def test_hits_with_their_chunks_and_relevant_documents_are_made_once(spark, data):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "chunk_id long, text string")
    hits = spark.createDataFrame([(7, 2, 1), (8, 2, 1), (8, 3, 2)], "query_id long, chunk_id long, rank int")
    found = ranking.with_chunks(hits, chunks)
    assert rows(found) == [(7, 2, 1, "b"), (8, 2, 1, "b"), (8, 3, 2, "c")]
    qrels = Tables(spark, data).v_qrels
    for df in (found, qrels):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_relevant_documents_hold_the_passage(spark, tmp_path):
    spark.createDataFrame([(1, "xx one two three four five six yy"), (2, "two"), (3, None), (4, ""), (5, "Zwei. drei; vier")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "axx one two three four five six yyb two"), (2, "one two three four five six"), (3, None), (3, "two"), (3, "two"), (4, "Zwei. drei; vier"), (5, "zwei drei vier")],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(Tables(spark, str(tmp_path)).v_qrels) == [(1, 1), (2, 1), (2, 2), (2, 3), (2, 3), (5, 4)]


def test_graph_append_equals_sequential(spark):
    rnd = random.Random(5)
    names = ["a", "b", "c\x1f", "d\x1e", "", "e\x1e1", "f", "g"]
    kinds = ["see-also", "applies-to", "extends", "implements"]
    items = [(rnd.choice(names), rnd.choice(names), rnd.choice(kinds)) for _ in range(30)]
    results = [(q, rnd.choice([None, 1, 2, 3, 4]) if q < 20 else n, name, 1.0) for q in range(40) for n, name in enumerate(rnd.sample(names, 3))]
    results += [(None, 1, "a", 0.5), (None, 2, "b", 0.5)]
    want = [(q, n, s, "result", None) for q, _, n, s in results]
    for query in {r[0] for r in results}:
        own = {n for q, _, n, _ in results if q == query}
        found = {}
        for _, rank, name, _ in (r for r in results if r[0] == query):
            first = {}
            for at, (s, d, t) in enumerate(items):
                if name in (s, d) and s != d:
                    first.setdefault(d if s == name else s, (at, t))
            for other, (at, t) in first.items():
                # without a query no name counts as present
                if t in kinds[:3] and (query is None or other not in own):
                    place = (-1 if rank is None else rank, at, t)
                    found[other] = min(place, found.get(other, place))
        want += [(query, n, 0.0, "graph", p[2]) for n, p in found.items()]
    df = spark.createDataFrame(results, "query_id bigint, rank int, name string, score double")
    edges = spark.createDataFrame([(s, d, t, n) for n, (s, d, t) in enumerate(items)], "src string, dst string, type string, ord bigint")
    assert rows(ranking.graph_append(df, edges)) == sorted(want, key=repr)
    # neighbours do not travel one by one
    plan = ranking.graph_append(df.where("query_id >= 20"), edges)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression [query_id")


def test_auto_conflict_lists_what_it_rejects(spark):
    """The best wins; all others of the topic are listed in order, the suppressed ones too."""
    items = spark.createDataFrame([(1, "a", "t", 8, 0.5, 0), (1, "c", "t", 7, 0.5, 3), (1, "b", "t", 7, 0.5, 9), (1, "d", "t", 2, 0.9, 0), (1, "e", "u", 5, 0.5, 0)],
                                  "q int, name string, topic string, specificity int, score double, stars int")
    got = ranking.auto_conflict(ranking.conflict_resolve(items, ["q"]), ["q"]).collect()
    assert [r.asDict() for r in got] == [{"q": 1, "topic": "t", "chosen": "a", "decision": "auto-conflict", "reason": "auto-resolved: highest specificity (8)",
                                          "rejected_names": ["b", "c", "d"], "rejected": 3, "rejected_specificity": 16}]


def test_every_vector_is_a_query_of_the_exact_searches(spark, tmp_path):
    from scholia import plans
    m = random_vectors(30)
    spark.createDataFrame([(i + 1, v.tolist(), 0) for i, v in enumerate(m)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    queries = plans.load()[0]
    found = queries["knn_topk"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["rank"]) for r in found) == [(q, n) for q in range(1, 31) for n in range(1, 11)]
    assert {r["query_id"] for r in queries["knn_threshold"](spark, str(tmp_path)).collect()} == set(range(1, 31))


def test_nearest_finds_exact_scores_among_many(monkeypatch):
    """Groups, copies, own ids that come twice, vectors without length: as a full sort in double precision."""
    monkeypatch.setattr(vectors, "GROUP", 8)
    monkeypatch.setattr(vectors, "SCORE_CELLS", 1500)
    m = random_vectors(400, 16)
    m[100:140], m[7] = m[3], 0
    ids = np.arange(400) * 3
    ids[399] = ids[5]
    got = vectors._nearest(ids[:50], m[:50], ids, m, 6, True)
    for n, part in got.groupby("query_id"):
        s = np.where(ids == n, -9, np.round(m @ m[n // 3], 6))
        first = np.lexsort((ids, -s))[:6]
        assert part["item_id"].tolist() == ids[first].tolist() and np.allclose(part["score"], s[first], atol=1e-9)
    assert got["query_id"].nunique() == 50


def test_an_index_is_made_where_the_chunks_are(spark, tmp_path, monkeypatch):
    """Counts, postings and bounds without a shuffle, also in several runs a task and with repeated ids."""
    monkeypatch.setattr(lexical, "RUN_ROWS", 40)
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{j}" for j in rng.integers(0, 30, rng.integers(0, 12)))) for i in range(300)]
    chunks = spark.createDataFrame(texts, "chunk_id bigint, text string")
    flat = lambda df: rows(df.select("chunk_id", "len", F.explode(F.arrays_zip("ts", "tfs")).alias("p")).select("chunk_id", "len", "p.ts", "p.tfs"))
    made = lexical.stored_counts(chunks)
    assert flat(made) == flat(lexical.forward_counts(lexical.postings(chunks)))
    twice = chunks.union(chunks.where("chunk_id % 7 = 0")).union(spark.createDataFrame([(None, "w1 w2"), (None, "w2")], "chunk_id bigint, text string"))
    plain = lambda df: [r[:1] + r[2:] for r in flat(df)]  # the length of a repeated id is that of any of its rows
    assert plain(lexical.stored_counts(twice)) == plain(lexical.forward_counts(lexical.postings(twice)))
    made.withColumn("block", F.floor(F.col("chunk_id") / 20)).orderBy("chunk_id").coalesce(2).write.parquet(f"{tmp_path}/forward")
    forward = spark.read.parquet(f"{tmp_path}/forward")
    posting = lexical.run_postings(forward)
    assert rows(posting.drop("block")) == rows(lexical.postings(chunks).select("chunk_id", "term", "tf", "len"))
    bounds = lexical.run_bounds(forward)
    worth = "term", "block", "tf", "len", F.round(F.col("best.tf") / F.sqrt("best.len"), 9)
    assert rows(bounds.select(*worth)) == rows(lexical.posting_bounds(posting).select(*worth))
    for made in (made, posting, bounds):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().replace("RoundRobinPartitioning", "")
