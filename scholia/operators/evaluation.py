"""Retrieval metrics, judged evals and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("bronze", "silver", "gold", "platinum")


def best_ranks(run: DataFrame) -> DataFrame:
    """Retrieved ids without repeats, ranks closed up per query.

    ``run`` holds a bounded list per query.
    """
    from pyspark.sql import Window as W
    firsts = run.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    w = W.partitionBy("query_id").orderBy("rank", "item_id")
    return firsts.withColumn("rank", F.row_number().over(w))


def _hits(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return run.where(F.col("rank") <= k).join(qrels.distinct(), ["query_id", "item_id"], "left_semi")


def mrr_at_k(run: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    first = _hits(run, qrels, k).groupBy("query_id").agg(F.min("rank").alias("r"))
    return (queries.select("query_id").join(first, "query_id", "left")
            .agg(F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr")))


def recall_at_k(run: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Queries without relevant rows are left out."""
    rel = qrels.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    got = _hits(run, qrels, k).groupBy("query_id").agg(F.countDistinct("item_id").alias("h"))
    return (rel.join(got, "query_id", "left")
            .agg(F.round(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")), 6).alias("recall")))


def ndcg_at_k(run: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 5, dedup: bool = True) -> DataFrame:
    """Queries whose ideal is 0 add 0; the mean is over all queries."""
    listed = best_ranks(run) if dedup else run
    gain = _hits(listed, qrels, k).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    rel = qrels.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0),
                        lambda s, r: s + 1 / F.log2(r + 1.0))
    return (queries.select("query_id").join(rel, "query_id", "left").join(gain, "query_id", "left")
            .agg(F.round(F.avg(F.when(F.col("n") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0)), 6).alias("ndcg")))


def pass_rate(judgements: DataFrame) -> DataFrame:
    """One row from ``(eval_id, variant, ok)``: totals per variant, fully passed
    evals, rates to 3 digits, delta of with over baseline."""
    per_eval = judgements.groupBy("variant", "eval_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("p"))
    per = per_eval.groupBy("variant").agg(
        F.sum("n").alias("total"), F.sum("p").alias("passed"),
        F.count_if(F.col("n") == F.col("p")).alias("full"))

    def of(variant: str, col: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("variant") == variant, F.col(col))), F.lit(0))
    out = per.agg(of("with", "passed").alias("passed"), of("with", "total").alias("total"),
                  of("with", "full").alias("evals_passed"),
                  of("baseline", "passed").alias("b_passed"), of("baseline", "total").alias("b_total"))
    rate = F.round(F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0), 3)
    base = F.round(F.when(F.col("b_total") > 0, F.col("b_passed") / F.col("b_total")).otherwise(0.0), 3)
    return out.select("passed", "total", "evals_passed", "b_passed", "b_total",
                      rate.alias("pass_rate"), base.alias("baseline_rate"),
                      F.round(rate - base, 3).alias("delta"))


MISSING_REASON = "judge did not return a result for this expectation"


def parse_judgements(replies: DataFrame) -> DataFrame:
    """(eval_id, n, ok, reason) from ``(eval_id, reply, expected)``; a number
    without a verdict line fails."""
    lines = F.regexp_extract_all("reply", F.lit(r"(?im)^(\d+\.\s*(?:PASS|FAIL)\s*[—–-]?\s*.+)$"), 1)
    return (replies.select("eval_id", F.explode(F.sequence(F.lit(1), "expected")).alias("n"), lines.alias("ls"))
            .withColumn("line", F.get(F.filter("ls", lambda s: F.startswith(s, F.concat(F.col("n").cast("string"), F.lit(".")))), F.lit(0)))
            .select("eval_id", "n",
                    F.coalesce(F.upper(F.regexp_extract("line", r"(?i)^\d+\.\s*(PASS|FAIL)", 1)) == "PASS", F.lit(False)).alias("ok"),
                    F.coalesce(F.trim(F.regexp_extract("line", r"(?i)^\d+\.\s*(?:PASS|FAIL)\s*[—–-]?\s*(.+)$", 1)),
                               F.lit(MISSING_REASON)).alias("reason")))


def tier_badge(checks: DataFrame) -> DataFrame:
    """Highest tier per item such that it and every lower tier have only passes.

    A tier without checks counts as passed.
    """
    ok = [F.coalesce(F.min(F.when(F.col("tier") == t, F.col("ok").cast("int"))), F.lit(1)).alias(f"ok{i}") for i, t in enumerate(TIERS)]
    flags = checks.groupBy("item_id").agg(*ok)
    badge = F.lit(None).cast("string")
    for i in range(len(TIERS) - 1, -1, -1):
        held = F.lit(True)
        for j in range(i + 1):
            held = held & (F.col(f"ok{j}") == 1)
        badge = F.coalesce(badge, F.when(held, TIERS[i]))
    return flags.select("item_id", badge.alias("badge"))


def row_checks(rows: DataFrame, id_col: str, predicates: list[tuple[str, str, str, Column]]) -> DataFrame:
    """One finding per row and failed predicate: (id, check, tier, severity)."""
    listed = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(t).alias("tier"), F.lit(s).alias("severity"),
                                F.coalesce(p, F.lit(False)).alias("ok")) for n, t, s, p in predicates])
    return rows.select(F.col(id_col).alias("row_id"), F.inline(listed))
