"""Derived views over the supplied tables: Spark side and DuckDB side.

Every view reads its whole base table. The DuckDB text is written on its own, from
the base tables, so that a comparison checks the operators and the views.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.scale import broadcast_within, cut, number_rows, scratch_path, spread
from scholia.functions.text import chunk_number, contained_in, lines
from scholia.sources.sinks import read_index, write_index


#: First words of passages that may be a list in the plan; candidates that may be broadcast.
FIRST_WORDS = 10_000
CANDIDATES = 500_000

#: Where the index of a table was stored, by session, folder and state of the table.
_STORED: dict[tuple, str] = {}


class Tables:
    """Base tables and derived views of one data folder; everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(df) if name in ("documents", "pages") else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)

    @cached_property
    def v_chunks(self) -> DataFrame:
        """One row per non-blank line. Numbered inside the row: no shuffle."""
        return (self.documents.select("doc_id", "lang", "source", lines("text").alias("ls"))
                .select("doc_id", "lang", "source", F.size("ls").cast("bigint").alias("n"), F.posexplode("ls").alias("pos", "text"))
                .select(chunk_number("doc_id", "pos").alias("chunk_id"),
                        F.col("doc_id").alias("parent_id"), F.col("pos").cast("bigint").alias("sibling_index"),
                        F.col("n").alias("sibling_count"), "text",
                        F.col("source").alias("name"), F.col("lang").alias("type")))

    @cached_property
    def index(self) -> dict[str, DataFrame]:
        """The stored index of the chunks, written once a session and state of the table."""
        state = self.documents.agg(F.max("_metadata.file_modification_time"), F.sum("_metadata.file_size"), F.count(F.lit(1))).first()
        key = (self.spark.sparkContext.applicationId, self.dir, tuple(state))
        if key not in _STORED:
            path = scratch_path(self.spark, "index")
            write_index(self.v_chunks.withColumnRenamed("name", "source"), path)
            _STORED[key] = path
        return read_index(self.spark, _STORED[key])

    @cached_property
    def v_queries(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), F.regexp_replace("text", "\n", " ").alias("query"))

    @cached_property
    def v_qrels(self) -> DataFrame:
        """(query_id, item_id): documents that hold the whole passage.

        A passage found in a text carries its inner words whole, so the first five of
        them, or as many as there are, are looked up by equality and the few candidates
        are verified. Passages without inner words are looked up by their characters. An
        empty passage is in no document.
        """
        def words(col):
            return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
        need = (self.benchmark.where("text is not null").select("item_id", F.col("text").alias("passage"), words("text").alias("ts"))
                .withColumn("n", F.least(F.greatest(F.size("ts") - 2, F.lit(0)), F.lit(5))))
        keys = need.where("n > 0").select("item_id", "passage", "n", F.array_join(F.slice("ts", F.lit(2), F.col("n")), " ").alias("key"))
        starts = F.sequence(F.lit(1), F.size("ts") - F.col("n") + 1)
        first = [r[0] for r in keys.select(F.split("key", " ")[0]).distinct().limit(FIRST_WORDS + 1).collect()]
        if len(first) <= FIRST_WORDS:
            # words are only put together where a passage may start
            starts = F.filter(starts, lambda i: F.get("ts", i - 1).isin(first))
        docs = (self.documents.select("doc_id", words("text").alias("ts")).join(F.broadcast(keys.select("n").distinct()), F.size("ts") >= F.col("n"))
                .select("doc_id", "n", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("ts", i, F.col("n")), " ")))).alias("key")))
        texts = self.documents.select("doc_id", "text")
        met = cut(docs.join(keys, ["key", "n"]).select("doc_id", "item_id", "passage").distinct())
        by_words = (texts.join(broadcast_within(met, CANDIDATES), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id"))
        short = need.where("n = 0").select("item_id", "passage")
        held = contained_in(short, texts, "passage", "text")
        by_chars = short.join(held, "passage").join(texts, "text").select("item_id", "doc_id")
        # read more than once by a metric, and small
        return cut(by_words.unionByName(by_chars)
                   .select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item_id")))

    @cached_property
    def v_vec(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("ivec"), "label")

    @cached_property
    def v_vec_all_queries(self) -> DataFrame:
        """Every vector as a query of the exact searches."""
        return self.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))

    @cached_property
    def v_vec_queries(self) -> DataFrame:
        """The stated query set of the signature index: ids divisible by 20, against all rows."""
        return self.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


BASE = ("region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations").split()

# DuckDB side. o_ views are helper relations of the oracle only.
ORACLE_VIEWS: dict[str, str] = {}

ORACLE_VIEWS["v_lines"] = """
SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: length(s) > 0) AS ls
FROM documents"""
ORACLE_VIEWS["v_chunks"] = """
SELECT doc_id * 134217728 + i - 1 AS chunk_id, doc_id AS parent_id, (i - 1)::BIGINT AS sibling_index, len(ls)::BIGINT AS sibling_count,
       ls[i] AS text, source AS name, lang AS type
FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM v_lines)"""
ORACLE_VIEWS["v_queries"] = "SELECT item_id AS query_id, replace(text, chr(10), ' ') AS query FROM benchmark"
ORACLE_VIEWS["v_qrels"] = "SELECT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> ''"

STOP_SQL = ("['" + "','".join(__import__("scholia.functions.text", fromlist=["STOPWORDS"]).STOPWORDS) + "']")


def toks(col: str) -> str:
    return f"list_filter(string_split_regex(lower({col}), '[^a-z0-9]+'), lambda t: length(t) >= 2)"


def kws(col: str) -> str:
    return f"list_filter(string_split_regex(lower({col}), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains({STOP_SQL}, t))"


ORACLE_VIEWS["o_tok"] = f"SELECT chunk_id, unnest({toks('text')}) AS term FROM v_chunks"
ORACLE_VIEWS["o_post"] = "SELECT chunk_id, term, count(*) AS tf FROM o_tok GROUP BY ALL"
ORACLE_VIEWS["o_len"] = f"SELECT chunk_id, len({toks('text')})::BIGINT AS len FROM v_chunks"
ORACLE_VIEWS["o_df"] = "SELECT term, count(*) AS df FROM o_post GROUP BY term"
ORACLE_VIEWS["o_stats"] = "SELECT count(*) AS n_docs, sum(len)::BIGINT AS total_len, sum(len) / count(*) AS avg_len FROM o_len"
ORACLE_VIEWS["o_variants"] = f"""
SELECT query_id * 10 + v AS qv, query_id, v, CASE v WHEN 0 THEN query WHEN 1 THEN kw WHEN 2 THEN 'best practices for ' || kw ELSE 'how to ' || kw END AS query
FROM (SELECT query_id, query, array_to_string({kws('query')}, ' ') AS kw FROM v_queries), (SELECT unnest([0, 1, 2, 3]) AS v)
WHERE v = 0 OR (kw <> '' AND query <> CASE v WHEN 1 THEN kw WHEN 2 THEN 'best practices for ' || kw ELSE 'how to ' || kw END)"""
ORACLE_VIEWS["o_qterms"] = f"SELECT qv, term, count(*) AS qtf FROM (SELECT qv, unnest({toks('query')}) AS term FROM o_variants) GROUP BY ALL"
ORACLE_VIEWS["o_bm25_v"] = """
SELECT qv, chunk_id, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
FROM o_qterms JOIN o_df USING (term) JOIN o_post USING (term) JOIN o_len USING (chunk_id), o_stats
GROUP BY qv, chunk_id HAVING score > 0"""
ORACLE_VIEWS["o_bm25_top"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qv ORDER BY score DESC, chunk_id) AS rank FROM o_bm25_v) WHERE rank <= 20"""
ORACLE_VIEWS["o_cvec"] = "SELECT chunk_id, b, count(*)::DOUBLE AS c FROM (SELECT chunk_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b FROM o_tok) GROUP BY ALL"
ORACLE_VIEWS["o_qvec"] = f"""
SELECT qv, b, count(*)::DOUBLE AS c FROM (SELECT qv, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b
  FROM (SELECT qv, unnest({toks('query')}) AS term FROM o_variants)) GROUP BY ALL"""
ORACLE_VIEWS["o_vec_top"] = """
SELECT * FROM (SELECT qv, chunk_id, score, row_number() OVER (PARTITION BY qv ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT v.qv, k.chunk_id, coalesce(round(d.dot / (qn.n * cn.n), 6), 0.0) AS score
  FROM o_variants v CROSS JOIN v_chunks k
  LEFT JOIN (SELECT qv, chunk_id, sum(q.c * d.c) AS dot FROM o_qvec q JOIN o_cvec d USING (b) GROUP BY ALL) d ON d.qv = v.qv AND d.chunk_id = k.chunk_id
  LEFT JOIN (SELECT qv, sqrt(sum(c * c)) AS n FROM o_qvec GROUP BY qv) qn ON qn.qv = v.qv
  LEFT JOIN (SELECT chunk_id, sqrt(sum(c * c)) AS n FROM o_cvec GROUP BY chunk_id) cn ON cn.chunk_id = k.chunk_id)) WHERE rank <= 20"""
ORACLE_VIEWS["o_lists"] = """
SELECT l.qv // 10 AS query_id, (l.qv % 10) * 2 + leg AS list_no, rank, CASE WHEN l.qv % 10 = 0 THEN 2 ELSE 1 END AS weight, text, chunk_id
FROM (SELECT qv, chunk_id, rank, 1 AS leg FROM o_bm25_top UNION ALL SELECT qv, chunk_id, rank, 0 FROM o_vec_top) l JOIN v_chunks USING (chunk_id)"""
ORACLE_VIEWS["o_lists_lex"] = "SELECT * FROM o_lists WHERE list_no % 2 = 1"


def rrf_sql(lists: str) -> str:
    return f"""
SELECT query_id, rank, score, text, chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS rank FROM (
    SELECT query_id, text, round(sum(weight / (60.0 + rank)), 6) AS score, min(list_no * 1000 + rank) AS f, arg_min(chunk_id, list_no * 1000 + rank) AS chunk_id
    FROM {lists} GROUP BY query_id, text)) WHERE rank <= 20"""


ORACLE_VIEWS["o_rrf"] = rrf_sql("o_lists")
ORACLE_VIEWS["o_rerank"] = f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank, score, text, chunk_id FROM (
  SELECT query_id, r0, text, chunk_id, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, ts)) / len(w) ELSE 0 END, 6) AS score
  FROM (SELECT r.query_id, r.rank AS r0, r.text, r.chunk_id, list_distinct({kws('q.query')}) AS w, {toks('r.text')} AS ts
        FROM o_rrf r JOIN v_queries q USING (query_id))) WHERE score >= 0.5"""


def sibling_sql(results: str, limit: str) -> str:
    return f"""
SELECT query_id, pos AS rank, score, text, chunk_id, expanded FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, expanded, sibling_index, chunk_id) AS pos FROM (
    SELECT query_id, text, rank, -1 AS sibling_index, chunk_id, score, 0 AS expanded FROM {results}
    UNION ALL
    SELECT query_id, text, rank, sibling_index, chunk_id, score, 1 FROM (
      SELECT e.query_id, c.text, e.rank, c.sibling_index, c.chunk_id, e.score,
             row_number() OVER (PARTITION BY e.query_id, c.text ORDER BY e.rank, c.sibling_index, c.chunk_id) AS rn
      FROM (SELECT query_id, parent_id, min(rank) AS rank, round(arg_min(score, rank) * 0.95, 6) AS score
            FROM {results} JOIN v_chunks USING (chunk_id) WHERE sibling_count > 1
            GROUP BY query_id, parent_id HAVING count(*) / min(sibling_count) >= 0.5) e
      JOIN v_chunks c USING (parent_id)
      WHERE NOT EXISTS (SELECT 1 FROM {results} r WHERE r.query_id = e.query_id AND r.text = c.text))
    WHERE rn = 1)) {limit}"""


ORACLE_VIEWS["o_run"] = "SELECT qv // 10 AS query_id, chunk_id // 134217728 AS item_id, rank FROM o_bm25_top WHERE qv % 10 = 0"
ORACLE_VIEWS["o_knn"] = """
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""

# leaders among the documents, by a fold over a list: one step a document in id order
ORACLE_VIEWS["o_dvec"] = f"""
SELECT doc_id, list(coalesce(c, 0.0) ORDER BY k) AS v FROM (SELECT doc_id, unnest(range(0, 64)) AS k FROM documents)
LEFT JOIN (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS k, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL) USING (doc_id, k)
GROUP BY doc_id"""
ORACLE_VIEWS["o_dnum"] = "SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, v FROM o_dvec WHERE list_sum(v) > 0"
ORACLE_VIEWS["o_dnear"] = """
SELECT b.r, list(a.r ORDER BY a.r) AS nb FROM o_dnum a JOIN o_dnum b ON a.r < b.r AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.85 GROUP BY b.r"""
LEADER_FOLD = """
WITH RECURSIVE fold(r, leads) AS (
  SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT fold.r + 1, CASE WHEN list_has_any(leads, coalesce(nb, [])) THEN leads ELSE list_append(leads, fold.r + 1) END
  FROM fold LEFT JOIN o_dnear n ON n.r = fold.r + 1 WHERE fold.r < (SELECT count(*) FROM o_dnum)),
last AS (SELECT leads FROM fold ORDER BY r DESC LIMIT 1),
joined AS (SELECT d.r, coalesce(list_min(list_intersect(nb, leads)), d.r) AS lead FROM last, o_dnum d LEFT JOIN o_dnear n USING (r)),
leaders AS (SELECT a.doc_id AS id, b.doc_id AS leader_id FROM joined JOIN o_dnum a USING (r) JOIN o_dnum b ON b.r = lead
            UNION ALL SELECT doc_id, doc_id FROM o_dvec WHERE list_sum(v) = 0)"""

# ---- markdown made from the documents --------------------------------------

MD_LINE = """
CASE WHEN {i} % 7 = 6 THEN concat('- Never ', {prev})
     WHEN {i} % 6 = 1 THEN concat('## ', {x}) WHEN {i} % 6 = 2 THEN concat('- ', {x}) WHEN {i} % 6 = 3 THEN concat('  ', {x})
     WHEN {i} % 6 = 4 THEN concat('1. ', {x}) WHEN {i} % 6 = 5 THEN concat('**Note** ', {x}) ELSE {x} END"""


def _v_md(self) -> DataFrame:
    """One markdown file per document: every line takes a role from its place."""
    line = MD_LINE.format(i="i", x="x", prev="ls[i - 1]")
    return (self.documents.select("doc_id", "lang", "source", lines("text").alias("ls"))
            .selectExpr("doc_id", "concat('docs/', source, '/', doc_id, '.md') AS path",
                        f"""concat('---\\nname: doc-', doc_id, '\\ntags: [', source, ', ', lang, ']\\n',
                            CASE WHEN lang = 'en' THEN concat('description: "Notes of ', source, '"') ELSE concat('description: >\\n  Notes of\\n  ', source) END,
                            '\\n---\\n', array_join(transform(ls, (x, i) -> {line}), '\\n')) AS content"""))


def _v_guides(self) -> DataFrame:
    """A longer guide per document with code, decision and rule blocks."""
    return (self.documents.select("doc_id", "lang", "source", "text", lines("text").alias("ls"))
            .selectExpr("doc_id", "concat('specs/', source, '/', CASE WHEN lang = 'es' THEN 'template-' ELSE 'g' END, doc_id, '.md') AS path",
                        """concat('### Guide ', source, '\\n', text, '\\n', repeat('-', 24), '\\nGOAL: ', coalesce(get(ls, 0), ''), '\\nDELIVERS: ', coalesce(get(ls, 1), 'none'),
                           '\\nin time\\n## Decision\\nService ', source, ' MUST handle ', lang, '\\n\\n## Context\\n',
                           CASE WHEN lang = 'de' THEN 'GET /v1/items\\n' ELSE '' END,
                           '```ts\\nimport { A', doc_id, ', B } from "lib"\\ncall()\\n```\\n') AS content"""))


Tables.v_md = cached_property(_v_md)
Tables.v_md.__set_name__(Tables, "v_md")
Tables.v_guides = cached_property(_v_guides)
Tables.v_guides.__set_name__(Tables, "v_guides")

# line roles by arithmetic, then sections and chunks without any markdown parsing
ORACLE_VIEWS["o_mdl"] = f"""
SELECT doc_id, source, lang, i, n, x, prev, CASE WHEN i % 7 = 6 THEN 'never' WHEN i % 6 = 1 THEN 'header' WHEN i % 6 = 3 THEN 'cont' ELSE 'open' END AS kind,
       CASE WHEN i % 7 = 6 THEN 'Never ' || prev WHEN i % 6 = 5 THEN '**Note** ' || x ELSE x END AS piece,
       {MD_LINE.format(i='i', x='x', prev='prev')} AS raw
FROM (SELECT doc_id, source, lang, i, len(ls) AS n, ls[i + 1] AS x, ls[i] AS prev FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM v_lines))"""
ORACLE_VIEWS["o_mds"] = "SELECT *, sum(CASE WHEN kind = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM o_mdl"
ORACLE_VIEWS["o_mdsec"] = """
SELECT doc_id, sec::BIGINT AS pos, 'doc-' || doc_id AS doc_name, any_value(n) AS n,
       CASE WHEN any_value(n) = 1 THEN 'doc-' || doc_id WHEN sec = 0 THEN 'summary' ELSE trim(max(x) FILTER (kind = 'header')) END AS header,
       CASE WHEN any_value(n) > 1 AND sec = 0 THEN 'summary' ELSE 'content' END AS base_kind,
       trim(string_agg(raw, chr(10) ORDER BY i) FILTER (kind <> 'header'), ' ' || chr(10)) AS text
FROM o_mds GROUP BY doc_id, sec HAVING count(*) FILTER (kind <> 'header') > 0"""
ORACLE_VIEWS["o_atomic"] = """
SELECT doc_id, sec, c, string_agg(piece, ' ' ORDER BY i) AS text FROM (
  SELECT *, sum(CASE WHEN kind = 'cont' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sec ORDER BY i) AS c FROM o_mds WHERE kind <> 'header')
GROUP BY doc_id, sec, c"""
NEG = "['never', 'not', 'don''t', 'instead', 'but', 'however', 'avoid', 'do not']"
ORACLE_VIEWS["o_guard"] = f"""
SELECT doc_id, sec, list_reduce(cs, lambda acc, x: CASE
  WHEN len(list_filter({NEG}, lambda w: starts_with(ltrim(lower(x[1])), w))) > 0
   AND list_has_any(regexp_extract_all(lower(acc[-1]), '\\b[a-z]{{4,}}\\b'), regexp_extract_all(lower(x[1]), '\\b[a-z]{{4,}}\\b'))
  THEN list_concat(acc[:-2], [acc[-1] || chr(10) || x[1]]) ELSE list_concat(acc, x) END) AS cs
FROM (SELECT doc_id, sec, list([text] ORDER BY c) AS cs FROM o_atomic GROUP BY doc_id, sec)"""
ORACLE_VIEWS["o_md_chunks"] = """
SELECT s.doc_id, pos AS section_pos, left(sha256(doc_name || '::' || header), 12) AS parent_id, header AS parent_title,
       CASE WHEN base_kind = 'summary' OR n = 1 THEN base_kind WHEN regexp_matches(lower(header), 'principle|rule') THEN 'framework' WHEN regexp_matches(lower(header), 'anti|avoid|pitfall') THEN 'pitfalls'
            WHEN regexp_matches(lower(header), 'example|case') THEN 'case_studies' ELSE 'content' END AS section,
       len(cs)::BIGINT AS sibling_count, unnest(range(0, len(cs)))::BIGINT AS sibling_index, unnest(cs) AS text
FROM o_mdsec s JOIN o_guard g ON g.doc_id = s.doc_id AND g.sec = s.pos"""
ORACLE_VIEWS["v_guides"] = """
SELECT doc_id, '### Guide ' || source || chr(10) || d.text || chr(10) || repeat('-', 24) || chr(10) || 'GOAL: ' || ls[1] || chr(10) || 'DELIVERS: ' || coalesce(ls[2], 'none')
  || chr(10) || 'in time' || chr(10) || '## Decision' || chr(10) || 'Service ' || source || ' MUST handle ' || lang || chr(10) || chr(10) || '## Context' || chr(10)
  || CASE WHEN lang = 'de' THEN 'GET /v1/items' || chr(10) ELSE '' END || '```ts' || chr(10) || 'import { A' || doc_id || ', B } from "lib"' || chr(10) || 'call()' || chr(10) || '```' || chr(10) AS content
FROM documents d JOIN v_lines USING (doc_id, source, lang)"""

# ---- knowledge graph, code and sessions made from the trade tables ----------

LIB = "concat('lib', {} + 1000)"
EDGE_CASE = ("CASE {} % 8 WHEN 0 THEN 'implements' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'extends' WHEN 3 THEN 'applies-to' "
             "WHEN 4 THEN 'see-also' WHEN 5 THEN 'inspired-by' WHEN 6 THEN 'supersedes' ELSE 'depends-on' END")
CUTOFF_DATE = "2001-06-01"
CACHE_NOW = "2024-03-20 00:00:00"


def _view(fn):
    prop = cached_property(fn)
    prop.__set_name__(Tables, fn.__name__)
    setattr(Tables, fn.__name__, prop)
    return fn


@_view
def v_nodes(t) -> DataFrame:
    """Parts are notes and decisions, brands are components."""
    parts = t.part.selectExpr(
        "concat('p', p_partkey) AS id", "CASE WHEN p_type = 'PROMO' THEN 'decision' ELSE 'note' END AS type", "p_name AS title",
        "concat(split(p_name, ' '), array(lower(p_type), lower(p_brand))) AS tags",
        "CASE WHEN p_size < 13 THEN '' ELSE concat(p_brand, ' ', p_type) END AS body")
    brands = t.part.select("p_brand").distinct().selectExpr(
        "concat('b', substring(p_brand, 7)) AS id", "'component' AS type", "p_brand AS title", "cast(array() AS array<string>) AS tags", "'' AS body")
    return parts.unionByName(brands)


@_view
def v_edges(t) -> DataFrame:
    """Parts on adjacent lines of one order, and large parts with their brand."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    nxt = li.selectExpr("l_orderkey", "l_linenumber - 1 AS l_linenumber", "l_partkey AS other")
    bought = (li.join(nxt, ["l_orderkey", "l_linenumber"]).where("l_partkey <> other")
              .groupBy("l_partkey", "other").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_shipdate").alias("d"))
              .selectExpr("concat('p', l_partkey) AS src", "concat('p', other) AS dst", EDGE_CASE.format("q") + " AS type", "1.0D AS weight",
                          "date_format(d, 'yyyy-MM-dd') AS created", "named_struct('a', l_partkey, 'b', other, 'c', 0) AS ord"))
    brand = t.part.where("p_size >= 40").selectExpr(
        "concat('p', p_partkey) AS src", "concat('b', substring(p_brand, 7)) AS dst", "'applies-to' AS type", "1.0D AS weight", "'1995-01-01' AS created",
        "named_struct('a', p_partkey, 'b', cast(9223372036854775807 AS bigint), 'c', cast(substring(p_brand, 7) AS int)) AS ord")
    return bought.unionByName(brand)


@_view
def v_links(t) -> DataFrame:
    n = t.pages.agg(F.count(F.lit(1)).alias("n"))
    return (t.pages.select("page_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).join(F.broadcast(n))
            .selectExpr("page_id AS src", "(page_id * 7 + k) % n AS dst").where("src <> dst").distinct())


@_view
def v_lineage(t) -> DataFrame:
    """Each order continues the one before it of the same customer. Orders are
    numbered in parts, so a customer with a third of all orders is no hot group."""
    o = number_rows(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    before = o.select("o_custkey", (F.col("n") + 1).alias("n"), F.col("o_orderkey").alias("parent"))
    return o.join(before, ["o_custkey", "n"]).select(F.col("o_orderkey").alias("child"), "parent")


@_view
def v_files(t) -> DataFrame:
    """One source file per order, one import per line item."""
    lang = ("CASE l_orderkey % 6 WHEN 0 THEN concat('import { Api', l_linenumber, \" } from '\", lib, \"';\") WHEN 1 THEN concat('from ', lib, ' import Api', l_linenumber) "
            "WHEN 2 THEN concat('import \"example.org/acme/', lib, '\"') WHEN 3 THEN concat('use ', lib, '::{Api', l_linenumber, '};') "
            "WHEN 4 THEN concat('import com.acme.', lib, '.Api', l_linenumber, ';') ELSE concat(\"require '\", lib, \"'\") END")
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{LIB.format('l_partkey')} AS lib").selectExpr("*", f"{lang} AS line")
    body = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "line"))), lambda s: s["line"]), "\n").alias("body"),
                                          F.min("l_partkey").alias("first"))
    top = "CASE o_orderpriority WHEN '1-URGENT' THEN 'build/' WHEN '2-HIGH' THEN 'docs/' ELSE '' END"
    return (t.orders.join(body, F.col("o_orderkey") == F.col("l_orderkey"))
            .selectExpr("o_orderkey AS file_id", "element_at(array('ts', 'py', 'go', 'rs', 'java', 'rb'), cast(o_orderkey % 6 + 1 AS int)) AS ext", "body", "first", f"{top} AS top")
            .selectExpr("file_id", "ext", "concat(top, 'src/m', file_id % 97, '/f', file_id, '.', ext) AS path",
                        f"concat(body, '\\n', {LIB.format('first')}, '.make.thing(1);\\n') AS content"))


@_view
def v_releases(t) -> DataFrame:
    last = t.lineitem.groupBy("l_partkey").agg(F.max("l_shipdate").alias("d"))
    return t.part.join(last, F.col("p_partkey") == F.col("l_partkey")).selectExpr(
        "'npm' AS ecosystem", f"{LIB.format('p_partkey')} AS name", "concat('1.', p_size, '.0') AS version", "date_format(d, 'yyyy-MM-dd') AS publish_date")


@_view
def v_cache(t) -> DataFrame:
    p = t.part.where("p_size <= 25").selectExpr(f"{LIB.format('p_partkey')} AS name", "p_partkey", "p_type")
    return t.v_releases.join(p, "name").selectExpr(
        "concat(ecosystem, ':', name, '@', version) AS key", "CASE WHEN p_type <> 'PROMO' THEN publish_date END AS publish_date",
        f"timestamp'{CACHE_NOW}' - make_interval(0, 0, 0, 0, cast(p_partkey % 48 AS int)) AS checked_at")


@_view
def v_manifests(t) -> DataFrame:
    """One manifest per customer with the parts bought; some files are cut off."""
    bought = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
              .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
              .selectExpr("o_custkey", f"{LIB.format('p_partkey')} AS lib", "concat('1.', p_size, '.0') AS v"))
    listed = bought.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("lib", "v"))).alias("ds"))
    npm = "concat('{\"name\": \"proj', c_custkey, '\", \"dependencies\": {', array_join(transform(ds, d -> concat('\"', d.lib, '\": \"^', d.v, '\"')), ', '), '}, \"devDependencies\": {\"local-x\": \"workspace:*\"}}')"
    pip = "concat('# pinned\\n', array_join(transform(ds, d -> concat(d.lib, '==', d.v)), '\\n'), '\\n-r base.txt\\n')"
    broken = "c_acctbal < -800 AND c_custkey % 2 = 0"
    return (t.customer.join(listed, F.col("c_custkey") == F.col("o_custkey"))
            .selectExpr("c_custkey AS project", "CASE WHEN c_custkey % 2 = 0 THEN 'package.json' ELSE 'requirements.txt' END AS path",
                        f"CASE WHEN {broken} THEN left({npm}, 20) WHEN c_custkey % 2 = 0 THEN {npm} ELSE {pip} END AS content"))


@_view
def v_decisions(t) -> DataFrame:
    x, y = LIB.format("p_partkey"), LIB.format("p_partkey + 1")
    return t.part.selectExpr(
        "p_partkey AS decision_id", "p_name AS title",
        f"CASE p_partkey % 4 WHEN 0 THEN concat('Do not use ', {x}, '.') WHEN 1 THEN concat('Prefer ', {y}, ' over ', {x}) WHEN 2 THEN concat('We replaced ', {x}, ' with ', {y}) "
        f"ELSE concat('Decided against ', {x}, '. Avoid ', {x}, ' in every api.') END AS text")


@_view
def v_edits(t) -> DataFrame:
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    return (t.events.join(F.broadcast(n)).selectExpr("event_id", "ts", "concat('src/api/u', user_id, '.ts') AS path", f"{LIB.format('event_id % n')} AS lib")
            .selectExpr("event_id", "ts", "path", "concat('import { make } from \\'', lib, '\\';\\nconst a = ', lib, '.make(1);') AS code"))


@_view
def v_scope(t) -> DataFrame:
    from scholia.operators.rules import scope_map
    know = t.v_decisions.selectExpr("concat('d', decision_id) AS id", "text", "'knowledge-graph' AS source", "'decision' AS type")
    gaps = t.v_releases.where(F.col("publish_date") > CUTOFF_DATE)
    return scope_map(know, gaps)


@_view
def v_usage(t) -> DataFrame:
    return t.events.selectExpr("concat('u', user_id, '/', event_type) AS name", "ts")


@_view
def v_installed(t) -> DataFrame:
    used = t.events.select("user_id", "event_type").distinct().selectExpr(
        "concat('u', user_id, '/', event_type) AS name", "timestamp'2023-12-01 00:00:00' + make_interval(0, 0, 0, cast(user_id * 7 % 110 AS int)) AS installed_at")
    idle = t.nation.selectExpr("concat('x', n_nationkey) AS name", "timestamp'2023-12-01 00:00:00' + make_interval(0, 0, 0, n_nationkey * 5) AS installed_at")
    return used.unionByName(idle)


@_view
def v_sessions(t) -> DataFrame:
    c = t.conversations
    user, asst = F.col("role") == "user", F.col("role") == "assistant"
    long_words = F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), 1))))
    g = c.groupBy("conv_id").agg(F.min_by("text", F.when(user, F.col("turn"))).alias("goal"), F.max_by("text", F.when(asst, F.col("turn"))).alias("progress"),
                                 F.max_by("text", F.when(user, F.col("turn"))).alias("pending_tasks"),
                                 F.array_sort(long_words).alias("skills"), F.array_sort(F.collect_set("role")).alias("tags"))
    return g.select(F.col("conv_id").alias("session_id"),
                    F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(conv_id % 60 AS int))"), "yyyy-MM-dd HH:mm:ss").alias("ts"),
                    F.concat(F.lit("b"), (F.col("conv_id") % 7).cast("string")).alias("branch"),
                    F.coalesce("goal", F.lit("")).alias("goal"), F.coalesce("progress", F.lit("")).alias("progress"),
                    F.coalesce("pending_tasks", F.lit("")).alias("pending_tasks"), "skills", "tags")


@_view
def v_sessions_xml(t) -> DataFrame:
    return t.v_sessions.selectExpr("session_id", """concat('<session_handoff>\\n  <timestamp>', ts, '</timestamp>\\n  <branch>', branch, '</branch>\\n  <goal>\\n', goal, '\\n</goal>\\n',
        CASE WHEN progress = '' THEN '' ELSE concat('  <progress>', progress, '</progress>\\n') END, '  <pending_tasks>', pending_tasks, '</pending_tasks>\\n',
        array_join(transform(skills, s -> concat('  <skill id="', s, '"/>')), '\\n'), '\\n</session_handoff>') AS content""")


@_view
def v_catalog(t) -> DataFrame:
    """One row per part name."""
    return (t.part.groupBy("p_name").agg(F.min("p_size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("p_brand").alias("b"), F.max(F.lower("p_type")).alias("ty"))
            .selectExpr("p_name AS name", "concat('Library of ', p_name) AS description", "split(p_name, ' ') AS keywords", "array(split(p_name, ' ')[1] || 'y', 'medium') AS anti_keywords",
                        "CASE WHEN s % 2 = 0 THEN array('py', 'ts') ELSE array('go') END AS languages", "CASE WHEN s % 3 = 0 THEN NULL ELSE array('dev', lower(ty)) END AS roles",
                        "split(p_name, ' ')[1] AS topic", "cast(s % 10 AS int) AS specificity", "n AS stars"))


@_view
def v_tasks(t) -> DataFrame:
    """A task per order: the names of its parts, a language by its status."""
    return (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey")
            .agg(F.array_join(F.array_sort(F.collect_set("p_name")), " and ").alias("task"), F.max("p_type").alias("ty"))
            .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .selectExpr("o_orderkey AS task_id", "concat(task, ' of ', lower(ty)) AS task", "CASE o_orderstatus WHEN 'F' THEN 'py' WHEN 'O' THEN 'ts' END AS language"))


D = {  # the same relations for DuckDB
    "v_nodes": """
SELECT 'p' || p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'decision' ELSE 'note' END AS type, p_name AS title,
  replace(p_name, ' ', ',') || ',' || lower(p_type) || ',' || lower(p_brand) AS tags, CASE WHEN p_size < 13 THEN '' ELSE p_brand || ' ' || p_type END AS body FROM part
UNION ALL SELECT DISTINCT 'b' || substr(p_brand, 7), 'component', p_brand, '', '' FROM part""",
    "v_edges": f"""
SELECT 'p' || a AS src, 'p' || b AS dst, {EDGE_CASE.format('q')} AS type, 1.0::DOUBLE AS weight, strftime(d, '%Y-%m-%d') AS created, {{'a': a::BIGINT, 'b': b::BIGINT, 'c': 0::INT}} AS ord
FROM (SELECT x.l_partkey AS a, y.l_partkey AS b, floor(min(x.l_quantity))::INT AS q, min(x.l_shipdate) AS d FROM lineitem x JOIN lineitem y
      ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber - 1 AND x.l_partkey <> y.l_partkey GROUP BY ALL)
UNION ALL SELECT 'p' || p_partkey, 'b' || substr(p_brand, 7), 'applies-to', 1.0, '1995-01-01', {{'a': p_partkey::BIGINT, 'b': 9223372036854775807::BIGINT, 'c': substr(p_brand, 7)::INT}} FROM part WHERE p_size >= 40""",
    "o_both": "SELECT src AS node, dst AS nb, type, ord, src, dst FROM v_edges UNION ALL SELECT dst, src, type, ord, src, dst FROM v_edges",
    "v_links": "SELECT DISTINCT page_id AS src, (page_id * 7 + k) % (SELECT count(*) FROM pages) AS dst FROM pages, (SELECT unnest([1, 2, 3]) AS k) WHERE page_id <> (page_id * 7 + k) % (SELECT count(*) FROM pages)",
    "v_lineage": "SELECT * FROM (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders) WHERE parent IS NOT NULL",
    "o_imp": "SELECT l_orderkey AS file_id, l_orderkey % 6 AS lk, l_linenumber, l_partkey, 'lib' || (l_partkey + 1000) AS lib FROM lineitem",
    "v_files": """
SELECT f.file_id, ext, CASE o_orderpriority WHEN '1-URGENT' THEN 'build/' WHEN '2-HIGH' THEN 'docs/' ELSE '' END || 'src/m' || (f.file_id % 97) || '/f' || f.file_id || '.' || ext AS path,
  body || chr(10) || 'lib' || (first + 1000) || '.make.thing(1);' || chr(10) AS content
FROM (SELECT file_id, ['ts', 'py', 'go', 'rs', 'java', 'rb'][any_value(lk) + 1] AS ext, min(l_partkey) AS first, string_agg(CASE lk WHEN 0 THEN 'import { Api' || l_linenumber || ' } from ''' || lib || ''';'
   WHEN 1 THEN 'from ' || lib || ' import Api' || l_linenumber WHEN 2 THEN 'import "example.org/acme/' || lib || '"' WHEN 3 THEN 'use ' || lib || '::{Api' || l_linenumber || '};'
   WHEN 4 THEN 'import com.acme.' || lib || '.Api' || l_linenumber || ';' ELSE 'require ''' || lib || '''' END, chr(10) ORDER BY l_linenumber, l_partkey) AS body FROM o_imp GROUP BY file_id) f
JOIN orders ON o_orderkey = f.file_id""",
    "o_modules": "SELECT DISTINCT file_id, lk, CASE lk WHEN 2 THEN 'example.org/acme/' || lib WHEN 4 THEN 'com.acme.' || lib ELSE lib END AS module, lib, l_partkey FROM o_imp",
    "v_releases": "SELECT 'npm' AS ecosystem, 'lib' || (p_partkey + 1000) AS name, '1.' || p_size || '.0' AS version, strftime(max(l_shipdate), '%Y-%m-%d') AS publish_date, p_partkey FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_size",
    "v_cache": f"SELECT ecosystem || ':' || name || '@' || version AS key, CASE WHEN p_type <> 'PROMO' THEN publish_date END AS publish_date, TIMESTAMP '{CACHE_NOW}' - to_hours((p_partkey % 48)::INT) AS checked_at FROM v_releases JOIN part USING (p_partkey) WHERE p_size <= 25",
    "v_deps": """
SELECT DISTINCT o_custkey AS project, CASE WHEN o_custkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, 'lib' || (l_partkey + 1000) AS name, '1.' || p_size || '.0' AS version
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON c_custkey = o_custkey WHERE NOT (c_acctbal < -800 AND c_custkey % 2 = 0)""",
    "v_decisions": """
SELECT p_partkey AS decision_id, p_name AS title, 'lib' || (p_partkey + 1000) AS x, 'lib' || (p_partkey + 1001) AS y,
  CASE p_partkey % 4 WHEN 0 THEN 'Do not use lib' || (p_partkey + 1000) || '.' WHEN 1 THEN 'Prefer lib' || (p_partkey + 1001) || ' over lib' || (p_partkey + 1000)
  WHEN 2 THEN 'We replaced lib' || (p_partkey + 1000) || ' with lib' || (p_partkey + 1001) ELSE 'Decided against lib' || (p_partkey + 1000) || '. Avoid lib' || (p_partkey + 1000) || ' in every api.' END AS text
FROM part""",
    "o_edits": "SELECT event_id, event_id % (SELECT count(*) FROM part) AS pk, 'lib' || (event_id % (SELECT count(*) FROM part) + 1000) AS lib FROM events",
    "o_scope_hits": f"""
SELECT event_id, 'gap:' || name AS id, 5 AS strength FROM o_edits JOIN v_releases ON lib = name WHERE publish_date > '{CUTOFF_DATE}'
UNION ALL
SELECT event_id, 'd' || decision_id, 3 FROM o_edits JOIN v_decisions ON contains('import {{ make }} from ''' || lib || ''';' || chr(10) || 'const a = ' || lib || '.make(1);', x) WHERE decision_id % 4 = 3""",
    "v_usage": "SELECT 'u' || user_id || '/' || event_type AS name, ts FROM events",
    "v_installed": """
SELECT DISTINCT 'u' || user_id || '/' || event_type AS name, TIMESTAMP '2023-12-01' + to_days((user_id * 7 % 110)::INT) AS installed_at FROM events
UNION ALL SELECT 'x' || n_nationkey, TIMESTAMP '2023-12-01' + to_days(n_nationkey * 5) FROM nation""",
    "v_sessions": """
SELECT conv_id AS session_id, strftime(TIMESTAMP '2024-01-01' + to_days((conv_id % 60)::INT), '%Y-%m-%d %H:%M:%S') AS ts, 'b' || (conv_id % 7) AS branch,
  coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS goal, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS progress,
  coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS pending_tasks, list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{8,}'))))) AS skills,
  list_sort(list_distinct(list(role))) AS tags FROM conversations GROUP BY conv_id""",
    "v_catalog": """
SELECT p_name AS name, string_split(p_name, ' ') AS keywords, [string_split(p_name, ' ')[2] || 'y', 'medium'] AS anti_keywords, CASE WHEN min(p_size) % 2 = 0 THEN ['py', 'ts'] ELSE ['go'] END AS languages,
  CASE WHEN min(p_size) % 3 = 0 THEN NULL ELSE ['dev', max(lower(p_type))] END AS roles, string_split(p_name, ' ')[2] AS topic, (min(p_size) % 10)::INT AS specificity, count(*) AS stars, 'Library of ' || p_name AS description FROM part GROUP BY p_name""",
    "v_tasks": """
SELECT o_orderkey AS task_id, string_agg(DISTINCT p_name, ' and ' ORDER BY p_name) || ' of ' || lower(max(p_type)) AS task, CASE o_orderstatus WHEN 'F' THEN 'py' WHEN 'O' THEN 'ts' END AS language
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus""",
}
ORACLE_VIEWS.update(D)
