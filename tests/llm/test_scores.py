"""Learned scores: held-out accuracy, clause rules and edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import quality_ranking, queries, toxicity
from scholia.llm.labelled import fold, labelled_sample

BIG = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = query(spark, BIG).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    good, bad = rows.score[rows.y == 1].to_numpy(), rows.score[rows.y == 0].to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    return auc, (rows.predicted == rows.y).mean()


def test_toxicity_on_the_held_out_fold(spark):
    auc, accuracy = held_out(spark, queries.op3_toxicity, "toxic")
    assert auc > 0.93 and accuracy > 0.97


def test_quality_on_the_held_out_fold(spark):
    auc, accuracy = held_out(spark, queries.op4_quality, "quality")
    assert auc > 0.99 and accuracy > 0.98


def test_rules_of_a_clause():
    grammar = toxicity.Grammar({"idiot$": 2.0, "lowe": 3.0})

    def classes(text):
        return grammar.features(text)[0][:5]
    assert np.expm1(classes("an idiot."))[toxicity.PLAIN] == pytest.approx(2)
    assert np.expm1(classes("You Idiot!"))[toxicity.AIMED] == pytest.approx(2)
    assert np.expm1(classes("this is not an idiot"))[toxicity.NEGATED] == pytest.approx(2)
    assert np.expm1(classes("not one two three four idiot"))[toxicity.NEGATED] == 0
    assert np.expm1(classes("he said: well. she said idiot"))[toxicity.REPORTED] == pytest.approx(2)
    assert np.expm1(classes("loweiqua"))[toxicity.PLAIN] == pytest.approx(3)
    assert np.expm1(classes("i kill it"))[toxicity.THREAT] == pytest.approx(1)
    assert grammar.features("idiotic slowe") == ([0.0] * toxicity.FEATURES, 0)
    assert grammar.features("idiot, idiot. fine. idiot")[1] == 2


def test_entries_explain_texts_that_earlier_ones_do_not():
    names = ["bad$", "copy$", "worse$"]
    texts = [[0, 1], [0, 1], [0, 1], [0], [2], [2], [2]]
    assert sorted(toxicity.choose(names, texts, [5.0, 5.0, 5.0], 3, cover=1)) == [0, 2]
    assert toxicity.choose([], [], [], 3) == []


def test_pairs_and_threshold():
    rng = np.random.default_rng(0)
    pairs = quality_ranking.rank_pairs(rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (20, 3)))
    assert pairs.shape == (60 * quality_ranking.RIVALS, 3) and pairs.mean() > 0
    r = quality_ranking.Ranking([0.0], [1.0], [1.0, 0.0], 0.25)
    assert r.score(np.array([[0.25]]))[0] == pytest.approx(quality_ranking.CUT)


def test_edge_rows_and_missing_labels(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    odd = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (5, 0, 0), (6, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 0)], none.schema)
    for labels in (none, odd):
        model, ranking = toxicity.learn(edges, labels), quality_ranking.learn(edges, labels)
        scored = toxicity.score_documents(edges, model)
        assert scored.where("__toxicity.score between 0 and 1").count() == edges.count()
        assert toxicity.reject(edges, model).columns == edges.columns
        assert toxicity.reject(empty, model).count() == 0
        ranked = edges.select(quality_ranking.score_column(ranking, F.coalesce("text", F.lit(""))).alias("s"))
        assert ranked.where("s between 0 and 1").count() == edges.count()
        assert quality_ranking.keep_good(edges, ranking).columns == edges.columns
    assert toxicity.learn(empty, none).weights == {}


def test_sample_is_bounded_and_counts_a_text_once(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.least("id", F.lit(3000))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("y"))
    sample, sizes = labelled_sample(docs, labels, "y", per_class=300)
    assert sizes == {0: 2000, 1: 2000}
    assert 400 < sample.count() < 800 and sample.select("text").distinct().count() == sample.count()


def test_fold_of_ids(spark):
    import zlib
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id bigint").select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r.f == (zlib.crc32(str(r.doc_id).encode()) % 5 if r.doc_id is not None else 0) for r in rows)
