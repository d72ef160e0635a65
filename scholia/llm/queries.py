"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import (bpe_transducer, chat_format, decontaminate, filter_audit, language_bits, line_dedup, paragraph_sketch, periodic_runs, quality_ranking,
                         simhash_ball, substring_dedup, token_counts, toxicity)
from scholia.llm.common import documents, session
from scholia.llm.labelled import fold

RANKS = "byte_bpe_multi_50k.tiktoken"
VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(col: Column | str) -> Column:
    return F.sha2(F.col(col).cast("binary") if isinstance(col, str) else col.cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again, digest both."""
    rows = bpe_transducer.encode_decode(documents(session(spark), sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), _sha("decoded").alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and whether they are over the limit."""
    return token_counts.token_counts(documents(session(spark), sf_dir), public_tokenizers.path(VOCABULARY))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; learned without the held-out fold."""
    docs, held_out = documents(session(spark), sf_dir), fold("doc_id", 5) == 0
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "__toxicity.score", (F.col("__toxicity.score") >= 0.5).cast("int").alias("predicted"),
                         "__toxicity.clauses")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; learned without the held-out fold."""
    docs, held_out = documents(session(spark), sf_dir), fold("doc_id", 4) == 2
    ranking = quality_ranking.learn(docs, _table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", quality_ranking.score_column(ranking, F.coalesce("text", F.lit(""))).alias("score"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_ranking.CUT).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    rows = decontaminate.decontamination_report(documents(session(spark), sf_dir), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       _sha(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited version, and how near they are."""
    rows = paragraph_sketch.with_next(documents(session(spark), sf_dir)).withColumn("edited", paragraph_sketch.edited_text())
    found = rows.withColumn("r", paragraph_sketch.compare("text", F.array("edited", "next_text")))
    return found.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), _sha("edited").alias("edited_sha256"), F.col("r.fingerprint").alias("fingerprint"),
                        F.col("r.others")[0].fingerprint.alias("edited_fingerprint"), F.col("r.others")[0].near.alias("near_edited"),
                        F.col("r.others")[1].near.alias("near_next"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no earlier window covers."""
    rows = substring_dedup.remove_repeats(documents(session(spark), sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", _sha("kept").alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    rows = simhash_ball.near_duplicates(documents(session(spark), sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that are no later repeat."""
    rows = line_dedup.remove_lines(documents(session(spark), sf_dir).select("doc_id", "text"), out="r")
    return rows.select("doc_id", "r.n_lines", F.size("r.removed").cast("bigint").alias("n_removed"), _sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what can be read back from the output."""
    rows = _table(session(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = chat_format.format_chats(chat_format.events_of_rows(rows.unionByName(extra)))
    read = chats.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.learned_text(F.col("formatted"), F.col("loss")).alias("learned"),
                        F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), _sha(whole).alias("turns_sha256"),
                       F.char_length("learned").cast("bigint").alias("loss_chars"), _sha("learned").alias("loss_sha256"), "formatted_chars")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learned without the held-out fold."""
    docs, held_out = documents(session(spark), sf_dir), fold("doc_id", 4) == 2
    model = language_bits.learn(docs.where(~held_out))
    rows = language_bits.predict(docs.select("doc_id", "text"), model, out="found")
    return rows.select("doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by language."""
    return filter_audit.filter_audit(documents(session(spark), sf_dir), _table(spark, sf_dir, "labels"))


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts (null: empty) with a run in about a tenth of them: with h the crc32 of the id
    as text and g = h / 10, where h is divisible by 10 the words from a = g % n on repeat the
    p = 1 + (n - a) / (3 + g % 8) words at a. Other texts stay as they are."""
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(1)).alias("h"))
    edited = F.pmod("h", F.lit(10)) == 0
    words = F.when(edited, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("w", words).withColumn("n", F.size("w").cast("bigint")).withColumn("g", F.floor(F.col("h") / 10).cast("bigint"))
    rows = rows.withColumn("a", F.expr("int(if(n > 0, g % n, 0))"))
    rows = rows.withColumn("p", F.expr("int(1 + floor((n - a) / (3 + g % 8)))"))
    tail = F.array_join(F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    return rows.select(id_col, F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document."""
    rows = periodic_runs.periodic_runs(repeated_tails(documents(session(spark), sf_dir))).select("doc_id", "runs.*")
    return rows.select("doc_id", "n_runs", "start", "length", "period", F.floor(F.col("length") * 1000 / F.col("period")).cast("bigint").alias("exponent_milli"),
                       _sha("runs").alias("runs_sha256"), _sha("kept").alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_token_counts, op3_toxicity, op4_quality, op5_decontamination, op6_fingerprints, op7_substring_dedup, op8_simhash,
                            op9_line_dedup, op10_chat_format, op11_language_id, op12_filter_audit, op13_periodic_runs)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM i),
o AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT o.doc_id, o.k, o.n, i.item FROM o JOIN i ON o.win = i.win AND o.n = i.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS rn FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM r WHERE rn > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS w FROM documents),
l AS (SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS p FROM d),
t AS (SELECT doc_id, p, line, regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') AS s FROM l),
f AS (SELECT doc_id, p, s, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM t WHERE s <> ''),
alone AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS rn FROM f WHERE strlen(s) >= 60) WHERE rn > 1),
runs AS (SELECT doc_id, k, s || chr(10) || lead(s, 1) OVER x || chr(10) || lead(s, 2) OVER x AS win FROM f WINDOW x AS (PARTITION BY doc_id ORDER BY k)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS rn FROM runs WHERE win IS NOT NULL) WHERE rn > 1),
gone AS (SELECT DISTINCT f.doc_id, f.p FROM (SELECT doc_id, k FROM alone UNION SELECT doc_id, unnest([k, k + 1, k + 2]) FROM again) g JOIN f USING (doc_id, k)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_lines, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_filter_audit": r"""
WITH RECURSIVE orders AS (SELECT '' AS o, 0 AS n UNION ALL SELECT o || f, n + 1 FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
        CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END,
        CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END) AS fails FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT o AS filter_order, unnest(range(1, 6))::INT AS step FROM orders WHERE n = 5),
r AS (SELECT c.part, filter_order, step, filter_order[step] AS f, n, good, bad, fails, contains(fails, filter_order[step]) AS hit,
        len(list_filter(string_split(left(filter_order, step - 1), ''), lambda g: g <> '' AND contains(fails, g))) > 0 AS earlier FROM c, s),
a AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT earlier), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (hit AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (hit AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (hit AND NOT earlier), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM a""",
    "op10_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
      length(text) + (length(text) - length(replace(text, '~', '')))
      + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|</?s>|<</?SYS>>|\[/?INST\]')) AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + length(role) + length('<|im_start|>' || '<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
