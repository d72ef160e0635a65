"""Lexical, vector, ranking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions.text import document_of, records, tokens
from scholia.operators import evaluation, lexical, neighbours, ranking, vectors
from scholia.plans.registry import query
from scholia.plans.views import LEADER_FOLD, kws, sibling_sql, toks


# ---- lexical ---------------------------------------------------------------

@query("tokenize", f"SELECT doc_id, len({toks('text')})::BIGINT AS n_tokens, md5(array_to_string({toks('text')}, ' ')) AS tokens_md5 FROM documents")
def _(t):
    ts = tokens("text")
    return t.documents.select("doc_id", F.size(ts).cast("bigint").alias("n_tokens"), F.md5(F.array_join(ts, " ")).alias("tokens_md5"))


@query("term_freq", "SELECT chunk_id, term, tf, len FROM o_post JOIN o_len USING (chunk_id)")
def _(t):
    return lexical.postings(t.v_chunks)


@query("doc_freq", "SELECT term, df FROM o_df")
def _(t):
    return lexical.doc_freq(t.v_chunks)


@query("corpus_stats", "SELECT n_docs, total_len, round(avg_len, 6) AS avg_len FROM o_stats")
def _(t):
    return lexical.corpus_stats(t.v_chunks).withColumn("avg_len", F.round("avg_len", 6))


@query("idf", "SELECT term, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM o_df, o_stats")
def _(t):
    out = lexical.idf(lexical.doc_freq(t.v_chunks), lexical.corpus_stats(t.v_chunks))
    return out.withColumn("idf", F.round("idf", 6))


@query("bm25_scores", "SELECT qv // 10 AS query_id, chunk_id, score FROM o_bm25_v WHERE qv % 10 = 0")
def _(t):
    c = t.v_chunks
    return lexical.bm25_scores(lexical.postings(c), lexical.doc_freq(c), lexical.corpus_stats(c), t.v_queries)


@query("index_write", """
SELECT 'postings' AS part, term, df AS n, sum(tf)::BIGINT AS total, min(len) AS least, max(len) AS most FROM o_post JOIN o_len USING (chunk_id) JOIN o_df USING (term) GROUP BY term, df
UNION ALL SELECT 'df', term, df, df, df, df FROM o_df
UNION ALL SELECT 'stats', NULL, n_docs, total_len, n_docs, total_len FROM o_stats
UNION ALL SELECT 'chunks', name, count(*), sum(length(text))::BIGINT, min(chunk_id), max(chunk_id) FROM v_chunks GROUP BY name""")
def _(t):
    """What was stored, read back: postings and counts of every term, totals, chunks by source."""
    i = t.index
    post = i["postings"].groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("total"), F.min("len").alias("least"), F.max("len").alias("most"))
    df = i["df"].select("term", *[F.col("df").alias(c) for c in ("n", "total", "least", "most")])
    stats = i["stats"].select(F.lit(None).cast("string").alias("term"), F.col("n_docs").alias("n"), F.col("total_len").alias("total"), F.col("n_docs").alias("least"), F.col("total_len").alias("most"))
    chunks = i["chunks"].groupBy(F.col("source").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("total"), F.min("chunk_id").alias("least"), F.max("chunk_id").alias("most"))
    out = None
    for part, rows in (("postings", post), ("df", df), ("stats", stats), ("chunks", chunks)):
        rows = rows.withColumn("part", F.lit(part))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("bm25_topk", "SELECT qv // 10 AS query_id, chunk_id, score, rank FROM o_bm25_top WHERE qv % 10 = 0")
def bm25_topk(t):
    return lexical.bm25_index_topk(t.index, t.v_queries)


@query("index_lookup", "SELECT qv // 10 AS query_id, chunk_id, score, rank FROM o_bm25_top WHERE qv % 200 = 0")
def _(t):
    """Few queries, those with an id divisible by 20: only their terms are read."""
    return lexical.bm25_lookup_topk(t.index, t.v_queries.where("query_id % 20 = 0"))


@query("index_add", """
SELECT term, df, n_docs, total_len FROM o_df, o_stats""")
def _(t):
    """English chunks are the index, all other languages arrive later."""
    c = t.v_chunks
    old, new = c.where("type = 'en'"), c.where("type <> 'en'")
    df = lexical.merge_df(lexical.doc_freq(old), lexical.doc_freq(new))
    stats = lexical.merge_stats(lexical.corpus_stats(old), lexical.corpus_stats(new))
    return df.join(F.broadcast(stats)).select("term", "df", "n_docs", "total_len")


@query("index_coverage", """
WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT role FROM conversations UNION SELECT DISTINCT lower(o_orderpriority) FROM orders
           UNION SELECT term FROM o_df),
q AS (SELECT name, term, count(*) AS qtf FROM (SELECT name, unnest(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS term FROM n) GROUP BY ALL),
s AS (SELECT name, chunk_id, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
      FROM q JOIN o_df USING (term) JOIN o_post USING (term) JOIN o_len USING (chunk_id), o_stats GROUP BY ALL)
SELECT n.name, CASE WHEN max(score) >= 0.5 THEN 1 ELSE 0 END AS covered FROM n LEFT JOIN s USING (name) GROUP BY n.name""")
def _(t):
    names = (t.part.select(F.col("p_name").alias("name"))
             .union(t.conversations.select("role"))
             .union(t.orders.select(F.lower("o_orderpriority")))
             .union(t.index["df"].select("term")).distinct())
    return lexical.covered(names, t.index)


# ---- vectors ---------------------------------------------------------------

@query("embed_batch", f"""
WITH b AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c
           FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(round(max(c / n), 6), 0.0) AS top, coalesce(round(sum((b + 1) * c / n), 6), 0.0) AS weighted
FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def _(t):
    v = vectors.embed_hashed(t.documents.select("doc_id", "text"))
    return v.select("doc_id", F.round(F.array_max("embedding"), 6).alias("top"),
                    F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("weighted"))


@query("cosine_pairs", """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    e = t.embeddings
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(vectors.cosine("embedding", "other"), 6).alias("score"))


@query("knn_topk", "SELECT * FROM o_knn WHERE rank <= 10")
def _(t):
    return vectors.knn_topk(t.v_vec_all_queries, t.v_vec, 10, skip_self=True)


@query("knn_threshold", "SELECT * FROM o_knn WHERE rank <= 10 AND score >= 0.3")
def _(t):
    return vectors.knn_threshold(t.v_vec_all_queries, t.v_vec, 10, 0.3, skip_self=True)


@query("near_dup_leaders", f"{LEADER_FOLD} SELECT id, leader_id FROM leaders")
def _(t):
    docs = vectors.embed_hashed(t.documents.select(F.col("doc_id").alias("id"), "text"), out="vec").select("id", "vec")
    return vectors.near_dup_leaders(docs, 0.85)


@query("embedding_cache_fill", """
SELECT DISTINCT p_name AS name FROM part""")
def _(t):
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    cache = vectors.embed_hashed(t.part.where("p_type = 'PROMO'").select(F.col("p_name").alias("name")).distinct(), "name")
    return vectors.fill_cache(names, cache, "name", "name").select("name")


@query("knn_candidates")
def _(t):
    """Neighbours from the signature index; knn_topk is the exact answer to the same queries and all others."""
    signatures = neighbours.fit(t.v_vec)
    return neighbours.search(neighbours.build(t.v_vec, signatures), t.v_vec_queries, signatures, 10, skip_self=True)


@query("recommend", """
WITH inst AS (SELECT DISTINCT user_id AS query_id, json_extract(props, '$.k')::BIGINT AS item_id FROM events WHERE event_type = 'purchase'),
used AS (SELECT query_id, count(*) AS used FROM inst GROUP BY query_id),
prof AS (SELECT DISTINCT user_id AS query_id FROM events),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, CASE WHEN b.label = 3 THEN 0.0 ELSE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) END AS score
      FROM embeddings a JOIN prof p ON p.query_id = a.vec_id, embeddings b)
SELECT query_id, item_id, score, rank FROM (
  SELECT s.*, coalesce(used, 0) AS used, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.item_id) AS rank
  FROM s LEFT JOIN used USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM inst i WHERE i.query_id = s.query_id AND i.item_id = s.item_id))
WHERE rank <= greatest(0, 32 - used)""")
def _(t):
    """A profile per user with a vector; a tenth of the catalog has none, names differ in case."""
    ev = t.events
    installed = (ev.where("event_type = 'purchase'")
                 .select(F.col("user_id").alias("query_id"), F.concat(F.lit("ITEM-"), F.get_json_object("props", "$.k")).alias("name")))
    profiles = (t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
                .join(ev.select(F.col("user_id").alias("query_id")).distinct(), "query_id", "left_semi"))
    catalog = t.embeddings.select(F.col("vec_id").alias("item_id"), F.concat(F.lit("Item-"), F.col("vec_id").cast("string")).alias("name"),
                                  F.when(F.col("label") != 3, F.col("embedding")).alias("ivec"))
    return vectors.recommend(profiles, catalog, installed)


@query("best_per_name", """
WITH h AS (SELECT qv // 10 AS query_id, name, score, rank, text FROM o_bm25_top JOIN v_chunks USING (chunk_id) WHERE qv % 10 = 0),
b AS (SELECT query_id, name, max(score) AS score, arg_min(trim(left(replace(text, chr(10), ' '), 60)), rank) AS snippet FROM h GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM b) WHERE rank <= 8""")
def _(t):
    hits = lexical.bm25_index_topk(t.index, t.v_queries)
    return vectors.best_per_name(ranking.with_chunks(hits, t.v_chunks.select("chunk_id", "name", "text")))


@query("relevance_split", """
WITH p AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT CASE WHEN lower(d.lang) = 'en' THEN round(list_cosine_similarity(e.embedding::DOUBLE[], p.q), 6) END AS score
      FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id, p)
SELECT count(*) FILTER (score >= 0.05) AS relevant, count(*) FILTER (score < 0.05) AS irrelevant, count(*) FILTER (score IS NULL) AS unscored FROM s""")
def _(t):
    e = t.embeddings
    profile = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = (t.documents.select("doc_id", "lang").join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
              .join(F.broadcast(profile))
              .select(F.when(F.col("lang") == "en", F.round(vectors.cosine("embedding", "q"), 6)).alias("score")))
    return vectors.relevance_split(scored, 0.05)


# ---- ranking chain ---------------------------------------------------------

@query("keywords", f"SELECT query_id, (i - 1)::BIGINT AS pos, k[i] AS keyword FROM (SELECT query_id, k, unnest(range(1, len(k) + 1)) AS i FROM (SELECT query_id, {kws('query')} AS k FROM v_queries))")
def _(t):
    return ranking.query_keywords(t.v_queries).withColumn("pos", F.col("pos").cast("bigint"))


@query("query_expand", "SELECT query_id, v AS variant, query FROM o_variants")
def _(t):
    return ranking.expand(t.v_queries)


@query("rrf", "SELECT * FROM o_rrf")
def _(t):
    return ranking.rrf(ranking.leg_lists(t.v_chunks, t.v_queries, index=t.index))


@query("rerank", "SELECT * FROM o_rerank")
def _(t):
    return ranking.rerank(ranking.rrf(ranking.leg_lists(t.v_chunks, t.v_queries, index=t.index)), t.v_queries)


@query("sibling_expand", sibling_sql("o_rerank", ""))
def _(t):
    ranked = ranking.rerank(ranking.rrf(ranking.leg_lists(t.v_chunks, t.v_queries, index=t.index)), t.v_queries)
    return ranking.sibling_expand(ranked, t.v_chunks, limit=None)


@query("threshold_limit", """
SELECT query_id, chunk_id, score, rank FROM (
  SELECT qv // 10 AS query_id, chunk_id, score, row_number() OVER (PARTITION BY qv ORDER BY rank) AS rank FROM o_bm25_top WHERE qv % 10 = 0 AND score >= 30)
WHERE rank <= 5""")
def _(t):
    return ranking.threshold_limit(lexical.bm25_index_topk(t.index, t.v_queries), 30, 5)


@query("display_scores", "SELECT qv // 10 AS query_id, chunk_id, rank, floor(100.0 / rank + 0.5)::BIGINT AS display_score FROM o_bm25_top WHERE qv % 10 = 0")
def _(t):
    return ranking.display_scores(lexical.bm25_index_topk(t.index, t.v_queries)).drop("score")


@query("hybrid_search", f"SELECT *, floor(100.0 / rank + 0.5)::BIGINT AS display_score FROM ({sibling_sql('o_rerank', 'WHERE pos <= 5')})")
def hybrid_search(t):
    return ranking.hybrid_search(t.v_chunks, t.v_queries, index=t.index)


RESULTS_SQL = "(SELECT qv // 10 AS query_id, rank, score, chunk_id, parent_id, sibling_index, name, type, text FROM o_bm25_top JOIN v_chunks USING (chunk_id) WHERE qv % 10 = 0)"


def results(t):
    """BM25 hits with their chunk columns."""
    return ranking.with_chunks(lexical.bm25_index_topk(t.index, t.v_queries),
                               t.v_chunks.select("chunk_id", "parent_id", "sibling_index", "name", "type", "text"))


@query("fingerprint_dedup", """
SELECT doc_id, name, type FROM (
  SELECT doc_id, source AS name, lang AS type, row_number() OVER (PARTITION BY source, lang, left(text, 60) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def _(t):
    d = t.documents.select("doc_id", F.col("source").alias("name"), F.col("lang").alias("type"), "text")
    return ranking.fingerprint_dedup(d, order="doc_id").select("doc_id", "name", "type")


SECTION_SQL = "CASE type WHEN 'en' THEN 'framework' WHEN 'fr' THEN 'summary' WHEN 'de' THEN 'case_studies' ELSE 'notes' END"


def sections(df):
    """The language stands for the section type: four floors, all used."""
    kind = (F.when(F.col("type") == "en", "framework").when(F.col("type") == "fr", "summary")
            .when(F.col("type") == "de", "case_studies").otherwise("notes"))
    return df.withColumn("type", kind)


@query("type_floors", f"""
SELECT query_id, chunk_id, type FROM (SELECT query_id, chunk_id, {SECTION_SQL} AS type, score / 100 AS score FROM {RESULTS_SQL})
WHERE score >= CASE type WHEN 'framework' THEN 0.27 WHEN 'summary' THEN 0.38 WHEN 'case_studies' THEN 0.40 ELSE 0.35 END""")
def _(t):
    r = sections(results(t)).withColumn("score", F.col("score") / 100)
    return ranking.type_floors(r).select("query_id", "chunk_id", "type")


@query("best_per_group", f"""
SELECT query_id, name, chunk_id, type, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY CASE WHEN type = 'framework' THEN 0 ELSE 1 END, score DESC, rank) AS rn
  FROM (SELECT query_id, name, chunk_id, rank, score, {SECTION_SQL} AS type FROM {RESULTS_SQL})) WHERE rn = 1""")
def _(t):
    return ranking.best_per_group(sections(results(t))).select("query_id", "name", "chunk_id", "type", "score")


# competing items: sources of the hits, topic by language, specificity by source
CONFLICT_SQL = f"""
items AS (SELECT query_id, name, max(score) / 50 AS score, arg_min(type, rank) AS topic, (substr(name, 4)::INT % 5)::INT AS specificity, count(*)::INT AS stars FROM {RESULTS_SQL} GROUP BY ALL),
it AS (SELECT query_id, name, score, topic, specificity, stars FROM items),
b AS (SELECT *, first_value(name) OVER w AS best_name, first_value(specificity) OVER w AS bs, first_value(score) OVER w AS bsc
      FROM it WINDOW w AS (PARTITION BY query_id, topic ORDER BY specificity DESC, score DESC, stars DESC, name)),
r AS (SELECT *, CASE WHEN name = best_name THEN 'best' WHEN bs - specificity >= 2 OR round(bsc - score, 6) >= 0.2 THEN 'suppressed' ELSE 'contender' END AS role FROM b),
f AS (SELECT *, max(CASE WHEN role = 'suppressed' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, topic) AS beat,
             max(CASE WHEN role = 'contender' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, topic) AS tied FROM r)"""


def competing(t):
    r = results(t).groupBy("query_id", "name").agg(
        (F.max("score") / 50).alias("score"), F.min_by("type", "rank").alias("topic"),
        F.count(F.lit(1)).cast("int").alias("stars"))
    return r.withColumn("specificity", F.substring("name", 4, 9).cast("int") % 5)


@query("conflict_resolve", f"""
WITH {CONFLICT_SQL}
SELECT query_id, topic, name, specificity, score,
       CASE role WHEN 'best' THEN CASE WHEN beat = 1 OR tied = 0 THEN 'winner' ELSE 'conflict' END WHEN 'suppressed' THEN 'suppressed' ELSE 'conflict' END AS decision,
       CASE WHEN role = 'suppressed' THEN CASE WHEN bs - specificity >= 2 THEN 'more specific (' || bs || ' vs ' || specificity || ')' ELSE 'higher relevance' END END AS reason,
       tied AS in_conflict, best_name FROM f""")
def _(t):
    return ranking.conflict_resolve(competing(t), ["query_id"]).drop("stars")


@query("auto_conflict", f"""
WITH {CONFLICT_SQL}
SELECT query_id, topic, best_name AS chosen, 'auto-conflict' AS decision, 'auto-resolved: highest specificity (' || any_value(bs) || ')' AS reason,
       string_agg(name, ',' ORDER BY specificity DESC, score DESC, stars DESC, name) FILTER (name <> best_name) AS rejected_names, count(*) FILTER (name <> best_name) AS rejected,
       coalesce(sum(specificity) FILTER (name <> best_name), 0)::BIGINT AS rejected_specificity
FROM f WHERE tied = 1 GROUP BY query_id, topic, best_name""")
def _(t):
    chosen = ranking.auto_conflict(ranking.conflict_resolve(competing(t), ["query_id"]), ["query_id"])
    return chosen.withColumn("rejected_names", F.array_join("rejected_names", ","))


TIER_SQL = "CASE type WHEN 'fr' THEN 'gap' WHEN 'de' THEN 'team' ELSE 'niche' END"


@query("priority_merge", f"""
WITH h AS (SELECT query_id, {TIER_SQL} AS tier, rank AS pos, chunk_id AS item FROM {RESULTS_SQL})
SELECT query_id, tier, pos, item FROM h WHERE tier <> 'niche' OR (SELECT count(*) FROM h s WHERE s.query_id = h.query_id AND s.tier <> 'niche') < 2""")
def _(t):
    tier = F.when(F.col("type") == "fr", "gap").when(F.col("type") == "de", "team").otherwise("niche")
    return ranking.priority_merge(results(t).select("query_id", tier.alias("tier"), F.col("rank").alias("pos"), F.col("chunk_id").alias("item")))


@query("source_filter", f"SELECT query_id, chunk_id, rank FROM {RESULTS_SQL} WHERE type <> 'en'")
def _(t):
    r = results(t).withColumn("node_kind", F.when(F.col("type") != "en", "knowledge").otherwise("skill"))
    return ranking.source_filter(r, "knowledge").select("query_id", "chunk_id", "rank")


@query("group_results", f"""
WITH g AS (SELECT query_id, name, parent_id::VARCHAR AS title, min(rank) AS fr, count(*) AS bullets, string_agg(trim(text), chr(10) ORDER BY rank) AS body FROM {RESULTS_SQL} GROUP BY ALL)
SELECT query_id, name, title, bullets, body, row_number() OVER (PARTITION BY query_id ORDER BY fr) AS idx FROM g""")
def _(t):
    return ranking.group_results(results(t).withColumn("title", F.col("parent_id").cast("string")))


@query("majority_type", f"""
WITH c AS (SELECT query_id, name AS source_type, count(*) AS n, min(rank) AS f FROM {RESULTS_SQL} GROUP BY ALL)
SELECT query_id, source_type, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""")
def _(t):
    return ranking.majority_type(results(t).withColumn("source_type", F.col("name")))


@query("concepts", f"""
WITH w AS (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i, kw FROM (SELECT query_id, string_split_regex(lower(query), '\\s+') AS ws, {kws('query')} AS kw FROM v_queries)),
m AS (SELECT query_id, i, ws[i] AS word, list_contains(kw, ws[i]) AS ok FROM w),
r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY i) AS run FROM m),
g AS (SELECT query_id, run, string_agg(word, ' ' ORDER BY i) AS phrase, count(*) AS n FROM r WHERE ok GROUP BY query_id, run)
SELECT DISTINCT query_id, concept FROM (
  SELECT query_id, phrase AS concept FROM g WHERE n <= 2
  UNION ALL SELECT query_id, unnest(string_split(phrase, ' ')) FROM g WHERE n > 2)""")
def _(t):
    return ranking.concepts(t.v_queries)


@query("query_decompose", """
WITH t AS (SELECT l_orderkey AS query_id, list_sort(list(DISTINCT p_name)) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
q AS (SELECT query_id, array_to_string(names, ' and ') AS task, CASE WHEN len(names) > 1 THEN names[1:5] ELSE [] END AS parts FROM t),
w AS (SELECT *, string_split(task, ' ') AS ws FROM q),
p AS (SELECT *, [array_to_string(ws[4 * i + 1:4 * i + 4], ' ') FOR i IN range(0, (len(ws) + 3) // 4) IF len(ws[4 * i + 1:4 * i + 4]) >= 2] AS phrases FROM w),
a AS (SELECT query_id, list_concat([task], parts, phrases) AS l FROM p),
x AS (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS i FROM a),
d AS (SELECT query_id, l[i] AS part, min(i) AS i FROM x GROUP BY ALL),
r AS (SELECT query_id, part, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS pos FROM d)
SELECT query_id, pos, part FROM r WHERE pos < 8""")
def _(t):
    tasks = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")) \
        .groupBy(F.col("o_orderkey").alias("query_id")).agg(F.array_join(F.array_sort(F.collect_set("p_name")), " and ").alias("query"))
    return ranking.decompose(tasks).withColumn("pos", F.col("pos").cast("bigint"))


@query("item_rank", f"""
WITH q AS (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) > 3)) AS ws FROM v_queries),
s AS (SELECT h.query_id, h.chunk_id, h.rank, len(list_filter(ws, lambda w: contains(lower(h.text), w))) + CASE WHEN h.type = 'en' THEN 0.5 ELSE 0 END AS score
      FROM {RESULTS_SQL} h JOIN q USING (query_id))
SELECT query_id, chunk_id, score::DOUBLE AS score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS pos FROM s) WHERE pos <= 3""")
def _(t):
    from scholia.operators.chunking import item_rank
    items = results(t).withColumn("label", F.when(F.col("type") == "en", F.col("name")))
    words = t.v_queries.select("query_id", F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 3)).alias("words"))
    return item_rank(items.withColumnRenamed("text", "body"), words, order="rank").select("query_id", "chunk_id", "score", "pos")


# ---- evaluation ------------------------------------------------------------

def run_of(t):
    return lexical.bm25_index_topk(t.index, t.v_queries).select(
        "query_id", document_of("chunk_id").alias("item_id"), "rank")


@query("mrr_at_k", """
WITH f AS (SELECT query_id, min(rank) AS r FROM o_run JOIN v_qrels USING (query_id, item_id) WHERE rank <= 5 GROUP BY query_id)
SELECT round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM v_queries LEFT JOIN f USING (query_id)""")
def _(t):
    return evaluation.mrr_at_k(run_of(t), t.v_qrels, t.v_queries)


@query("recall_at_k", """
WITH h AS (SELECT query_id, count(DISTINCT item_id) AS h FROM o_run JOIN v_qrels USING (query_id, item_id) WHERE rank <= 5 GROUP BY query_id),
n AS (SELECT query_id, count(*) AS n FROM v_qrels GROUP BY query_id)
SELECT round(avg(coalesce(h, 0) / n), 6) AS recall FROM n LEFT JOIN h USING (query_id)""")
def _(t):
    return evaluation.recall_at_k(run_of(t), t.v_qrels)


@query("ndcg_at_k", """
WITH d AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), item_id) AS rank FROM o_run GROUP BY query_id, item_id),
g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM d JOIN v_qrels USING (query_id, item_id) WHERE rank <= 5 GROUP BY query_id),
n AS (SELECT query_id, least(5, count(*)) AS n FROM v_qrels GROUP BY query_id),
i AS (SELECT query_id, sum(1 / log2(r + 1)) AS idcg FROM (SELECT query_id, unnest(range(1, n + 1)) AS r FROM n) GROUP BY query_id)
SELECT round(avg(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END), 6) AS ndcg FROM v_queries LEFT JOIN i USING (query_id) LEFT JOIN g USING (query_id)""")
def _(t):
    return evaluation.ndcg_at_k(run_of(t), t.v_qrels, t.v_queries)


@query("eval_passrate", """
WITH j AS (SELECT d.source AS eval_id, 'with' AS variant, quality = 1 AS ok FROM labels JOIN documents d USING (doc_id)
           UNION ALL SELECT d.source, 'baseline', toxic = 0 FROM labels JOIN documents d USING (doc_id)),
e AS (SELECT variant, eval_id, count(*) AS n, count(*) FILTER (ok) AS p FROM j GROUP BY ALL),
v AS (SELECT variant, sum(n)::BIGINT AS total, sum(p)::BIGINT AS passed, count(*) FILTER (n = p) AS full_n FROM e GROUP BY variant)
SELECT w.passed, w.total, w.full_n AS evals_passed, b.passed AS b_passed, b.total AS b_total,
       round(w.passed / w.total, 3) AS pass_rate, round(b.passed / b.total, 3) AS baseline_rate,
       round(round(w.passed / w.total, 3) - round(b.passed / b.total, 3), 3) AS delta
FROM (SELECT * FROM v WHERE variant = 'with') w, (SELECT * FROM v WHERE variant = 'baseline') b""")
def _(t):
    lab = t.labels.join(t.documents.select("doc_id", F.col("source").alias("eval_id")), "doc_id")
    j = (lab.select("eval_id", F.lit("with").alias("variant"), (F.col("quality") == 1).alias("ok"))
         .unionByName(lab.select("eval_id", F.lit("baseline").alias("variant"), (F.col("toxic") == 0).alias("ok"))))
    return evaluation.pass_rate(j)


@query("parse_judgements", """
SELECT l_orderkey AS eval_id, n::INT AS n, coalesce(ok, false) AS ok, coalesce(reason, 'judge did not return a result for this expectation') AS reason
FROM (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS n FROM lineitem GROUP BY l_orderkey)
LEFT JOIN (SELECT l_orderkey, l_linenumber AS n, arg_min(l_returnflag = 'N', l_returnflag || l_partkey) AS ok, arg_min('part ' || l_partkey, l_returnflag || l_partkey) AS reason
           FROM lineitem GROUP BY ALL) USING (l_orderkey, n)""")
def _(t):
    """A reply per order: one verdict line per item; gaps in the numbering fail."""
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(". "),
                    F.when(F.col("l_returnflag") == "N", "PASS").otherwise("FAIL"), F.lit(" - part "), F.col("l_partkey").cast("string"))
    key = F.concat("l_returnflag", F.col("l_partkey").cast("string"))
    firsts = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min_by(line, key).alias("line"))
    replies = firsts.groupBy(F.col("l_orderkey").alias("eval_id")).agg(
        F.concat_ws("\n", F.lit("Verdict"), F.array_sort(F.collect_list("line"))).alias("reply"), F.max("l_linenumber").alias("expected"))
    return evaluation.parse_judgements(replies)


CHECK_SQL = """
SELECT doc_id, unnest([{'tier': 'bronze', 'ok': n_chars >= 100}, {'tier': 'bronze', 'ok': lang IN ('en', 'fr', 'de', 'es')},
  {'tier': 'silver', 'ok': contains(text, chr(10))}, {'tier': 'gold', 'ok': n_chars <= 5000}, {'tier': 'platinum', 'ok': regexp_matches(text, '^[A-Z]')}]) AS c FROM documents"""


@query("tier_badge", f"""
WITH c AS (SELECT doc_id, c.tier AS tier, bool_and(c.ok) AS ok FROM ({CHECK_SQL}) GROUP BY ALL),
p AS (SELECT doc_id, bool_and(ok) FILTER (tier = 'bronze') AS b, bool_and(ok) FILTER (tier = 'silver') AS s, bool_and(ok) FILTER (tier = 'gold') AS g, bool_and(ok) FILTER (tier = 'platinum') AS p FROM c GROUP BY doc_id)
SELECT doc_id AS item_id, CASE WHEN b AND s AND g AND p THEN 'platinum' WHEN b AND s AND g THEN 'gold' WHEN b AND s THEN 'silver' WHEN b THEN 'bronze' END AS badge FROM p""")
def _(t):
    checks = t.documents.select(F.col("doc_id").alias("item_id"), F.inline(records(["tier", "ok"], [
        ("bronze", F.col("n_chars") >= 100), ("bronze", F.col("lang").isin("en", "fr", "de", "es")),
        ("silver", F.contains("text", F.lit("\n"))), ("gold", F.col("n_chars") <= 5000),
        ("platinum", F.col("text").rlike("^[A-Z]"))])))
    return evaluation.tier_badge(checks)


@query("row_checks", """
SELECT doc_id AS row_id, c.name AS "check", c.tier AS tier, c.severity AS severity, c.ok AS ok FROM (
  SELECT doc_id, unnest([{'name': 'length', 'tier': 'bronze', 'severity': 'error', 'ok': n_chars BETWEEN 50 AND 20000},
    {'name': 'starts-upper', 'tier': 'silver', 'severity': 'warn', 'ok': regexp_matches(text, '^[A-Z]')},
    {'name': 'required', 'tier': 'bronze', 'severity': 'error', 'ok': coalesce(lang, '') <> '' AND coalesce(source, '') <> ''},
    {'name': 'source-name', 'tier': 'gold', 'severity': 'warn', 'ok': regexp_matches(source, '^[a-z0-9-]+$')},
    {'name': 'has-lines', 'tier': 'gold', 'severity': 'info', 'ok': len(string_split(text, chr(10))) >= 3}]) AS c FROM documents)""")
def _(t):
    return evaluation.row_checks(t.documents, "doc_id", [
        ("length", "bronze", "error", F.col("n_chars").between(50, 20000)),
        ("starts-upper", "silver", "warn", F.col("text").rlike("^[A-Z]")),
        ("required", "bronze", "error", (F.coalesce("lang", F.lit("")) != "") & (F.coalesce("source", F.lit("")) != "")),
        ("source-name", "gold", "warn", F.col("source").rlike("^[a-z0-9-]+$")),
        ("has-lines", "gold", "info", F.size(F.split("text", "\n")) >= 3)])
