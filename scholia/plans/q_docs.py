"""Sources and document preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.text import lines
from scholia.operators import chunking as ck
from scholia.operators import lexical
from scholia.plans.registry import query
from scholia.sources import records as src

AS_OF = "2024-03-20 00:00:00"


# ---- sources ---------------------------------------------------------------

@query("corpus_scan", """
SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, length(text) AS chars, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents WHERE length(trim(text)) > 0""")
def _(t):
    return t.documents.where(F.length(F.trim("text")) > 0).select(
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.length("text").cast("bigint").alias("chars"), F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))


JSON_LINE = "CASE event_type WHEN 'error' THEN left(props, length(props) - 1) WHEN 'view' THEN '   ' ELSE props END"


@query("jsonl_tolerant", """
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, 0 AS corrupt FROM events WHERE event_type NOT IN ('error', 'view')
UNION ALL SELECT event_id, NULL, 1 FROM events WHERE event_type = 'error'""")
def _(t):
    lines_df = t.events.selectExpr("event_id", f"{JSON_LINE} AS line").where("length(trim(line)) > 0")
    good, bad = src.parse_json_lines(lines_df, "line", T.StructType([T.StructField("k", T.LongType())]), keep=("event_id",))
    return (good.withColumn("corrupt", F.lit(0))
            .unionByName(bad.select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit(1).alias("corrupt"))))


@query("path_filter", """
SELECT path FROM v_files WHERE NOT regexp_matches(path, '(^|/)(build|vendor|dist)/') AND ext IN ('ts', 'py', 'go', 'rs')""")
def _(t):
    return src.path_filter(t.v_files, extensions=["ts", "py", "go", "rs"]).select("path")


@query("snapshot_diff", """
WITH o AS (SELECT doc_id, n_chars AS m FROM documents WHERE lang <> 'de'),
n AS (SELECT doc_id, n_chars + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS m FROM documents WHERE lang <> 'es')
SELECT 'docs/' || coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN n.m IS NULL THEN 'removed' WHEN o.m IS NULL THEN 'added' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE n.m IS NULL OR o.m IS NULL OR o.m < n.m""")
def _(t):
    """Before: no German files yet; after: Spanish ones gone, French ones touched."""
    d = t.documents.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), "n_chars", "lang")
    old = d.where("lang <> 'de'").select("path", F.col("n_chars").alias("mtime"))
    new = d.where("lang <> 'es'").select("path", (F.col("n_chars") + F.when(F.col("lang") == "fr", 1).otherwise(0)).alias("mtime"))
    return src.snapshot_diff(old, new)


@query("thread_documents", """
WITH c AS (SELECT conv_id, string_agg('**' || role || ':**' || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS said, arg_min(text, turn) AS body,
                  arg_max(text, turn) FILTER (role = 'assistant') AS answer, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || '**Discussion #' || conv_id || '** — General' || chr(10) || '**Created:** unknown' || chr(10) || chr(10) || body
  || CASE WHEN answer IS NULL THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || '## Accepted Answer (by assistant)' || chr(10) || chr(10) || answer END
  || chr(10) || chr(10) || '---' || chr(10) || '## Comments' || chr(10) || chr(10) || said || chr(10) AS document FROM c""")
def _(t):
    conv = t.conversations
    heads = conv.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("body"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer")).select(
        "conv_id", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("string").alias("created"), "body", F.lit("assistant").alias("answer_by"), "answer")
    comments = conv.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("author"), F.col("text").alias("body"))
    return src.thread_documents(heads, comments, "conv_id")


@query("flatten_properties", """
SELECT event_id, 'Kind' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 'Score', value::VARCHAR FROM events
UNION ALL SELECT event_id, 'Owner', 'user ' || user_id || ', ' || user_id FROM events UNION ALL SELECT event_id, 'Done', CASE WHEN value > 50 THEN 'Yes' ELSE 'No' END FROM events
UNION ALL SELECT event_id, 'Number', 'EV' || event_id FROM events UNION ALL SELECT event_id, 'Tags', event_type || ', k' || json_extract(props, '$.k') FROM events""")
def _(t):
    bag = F.to_json(F.expr("""named_struct(
        'Name', named_struct('type', 'title', 'title', array(named_struct('plain_text', event_type))),
        'Kind', named_struct('type', 'select', 'select', named_struct('name', event_type)),
        'Score', named_struct('type', 'number', 'number', value),
        'Owner', named_struct('type', 'people', 'people', array(named_struct('name', concat('user ', user_id), 'id', 'x'), named_struct('name', cast(null as string), 'id', cast(user_id as string)))),
        'Done', named_struct('type', 'checkbox', 'checkbox', value > 50),
        'Empty', named_struct('type', 'url', 'url', cast(null as string)),
        'Number', named_struct('type', 'unique_id', 'unique_id', named_struct('prefix', 'EV', 'number', event_id)),
        'Tags', named_struct('type', 'multi_select', 'multi_select', array(named_struct('name', event_type), named_struct('name', concat('k', get_json_object(props, '$.k'))))))"""))
    return src.flatten_properties(t.events.select("event_id", bag.alias("bag")), "event_id", "bag")


@query("section_split", """
SELECT doc_id, 0::BIGINT AS pos, left('Guide ' || source, 80) AS title, md5(trim('### Guide ' || source || chr(10) || text, ' ' || chr(10))) AS section_md5 FROM documents
UNION ALL
SELECT doc_id, 1::BIGINT, 'Decision', md5(trim(string_split(content, repeat('-', 24) || chr(10))[2], ' ' || chr(10))) FROM v_guides""")
def _(t):
    return src.section_split(t.v_guides, "doc_id").select("doc_id", "pos", "title", F.md5("section").alias("section_md5"))


def clean_sql(col: str) -> str:
    out = col
    for tag in ("script", "style", "nav", "footer", "header"):
        out = f"regexp_replace({out}, '<{tag}(.|\\n)*?</{tag}>', '', 'gi')"
    return f"regexp_replace({out}, '<!--(.|\\n)*?-->', '', 'g')"


@query("html_clean", f"SELECT page_id, {clean_sql('html')} AS content FROM pages")
def _(t):
    return t.pages.select("page_id", src.html_clean(F.col("html")).alias("content"))


@query("strip_tags", f"SELECT page_id, trim(regexp_replace({clean_sql('html')}, '</?[a-z_]+>', '', 'g')) AS content FROM pages")
def _(t):
    return t.pages.select("page_id", ck.strip_tags(src.html_clean(F.col("html"))).alias("content"))


@query("page_links", r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS origin, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS h FROM pages),
l AS (SELECT DISTINCT page_id, origin, CASE WHEN regexp_matches(h, '^[a-zA-Z]+://') THEN h WHEN h LIKE '//%' THEN regexp_extract(origin, '^([a-zA-Z]+:)', 1) || h WHEN h LIKE '/%' THEN origin || h ELSE origin || '/' || h END AS link FROM h)
SELECT page_id, link FROM l
WHERE lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]+)', 1)) = lower(regexp_extract(origin, '^[a-zA-Z]+://([^/?#:]+)', 1)) AND NOT contains(link, '#')
  AND NOT regexp_matches(regexp_extract(link, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1), '(?i)\.(png|jpg|gif|svg|css|js|ico|woff|ttf|eot)$')""")
def _(t):
    return src.page_links(t.pages)


@query("url_facets", r"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT -s_suppkey - 1, 'http://172.' || (s_suppkey % 60) || '.0.1/s/' || s_suppkey || '/' FROM supplier
           UNION ALL SELECT -100000000 - c_custkey, 'https://192.' || CASE WHEN c_acctbal > 0 THEN '168' ELSE '169' END || '.1.1/a/../' || c_custkey FROM customer),
p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path FROM u),
s AS (SELECT *, replace(regexp_replace(regexp_replace(substr(path, 2), '^/', ''), '/$', ''), '/', '-') AS slug FROM p)
SELECT page_id, host, CASE WHEN page_id < 0 AND page_id > -100000000 AND (-page_id - 1) % 60 BETWEEN 16 AND 31 THEN 1 WHEN host LIKE '192.168.%' THEN 1 ELSE 0 END AS is_private,
  CASE WHEN slug = '' THEN 'index' WHEN contains(slug, '..') THEN 'page-' || left(md5(url), 8) ELSE slug END || '.md' AS file_name FROM s""")
def _(t):
    urls = (t.pages.select("page_id", "url")
            .union(t.supplier.selectExpr("-s_suppkey - 1", "concat('http://172.', s_suppkey % 60, '.0.1/s/', s_suppkey, '/')"))
            .union(t.customer.selectExpr("-100000000 - c_custkey", "concat('https://192.', CASE WHEN c_acctbal > 0 THEN '168' ELSE '169' END, '.1.1/a/../', c_custkey)")))
    return src.url_facets(urls)


@query("source_stats", r"""
WITH r AS (SELECT d.source AS name FROM labels JOIN documents d USING (doc_id) WHERE toxic = 1 UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT s_name FROM supplier),
c AS (SELECT name, count(*) AS n, max(parent_id) AS last FROM v_chunks GROUP BY name)
SELECT r.name, coalesce(any_value(c.n), 0) AS chunk_count, any_value(c.last) AS indexed_at,
  CASE WHEN NOT regexp_matches(r.name, '^[a-zA-Z0-9._-]+$') THEN 'bad-name' WHEN count(*) > 1 THEN 'duplicate' ELSE 'ok' END AS status
FROM r LEFT JOIN c USING (name) GROUP BY r.name""")
def _(t):
    registry = (t.labels.where("toxic = 1").join(t.documents.select("doc_id", "source"), "doc_id").select(F.col("source").alias("name"))
                .union(t.nation.select(F.lower("n_name"))).union(t.supplier.select("s_name")))
    return src.source_stats(t.v_chunks.select("name", F.col("parent_id").alias("indexed_at")), registry)


@query("catalog_merge", """
WITH c AS (SELECT p_name AS name, min(p_brand) AS description, 0 AS n FROM part WHERE p_type = 'PROMO' GROUP BY 1
  UNION ALL SELECT p_name, min(p_brand), 1 FROM part WHERE p_type IN ('SMALL', 'LARGE') GROUP BY 1 UNION ALL SELECT s_name, 'supplier', 2 FROM supplier UNION ALL SELECT p_name, 'part', 3 FROM part GROUP BY 1)
SELECT name, arg_min(description, n) AS description, min(n) AS catalog_no FROM c GROUP BY name""")
def _(t):
    p = t.part
    def by(cond):
        return p.where(cond).groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("description"))
    return src.catalog_merge([by("p_type = 'PROMO'"), by("p_type IN ('SMALL', 'LARGE')"),
                              t.supplier.select(F.col("s_name").alias("name"), F.lit("supplier").alias("description")),
                              p.select(F.col("p_name").alias("name"), F.lit("part").alias("description")).distinct()], ["name"])


@query("ttl_cache_split", f"""
SELECT r.key, CASE WHEN c.key IS NULL OR TIMESTAMP '{AS_OF}' - c.checked_at >= INTERVAL 24 HOURS THEN 'miss' WHEN c.publish_date IS NULL THEN 'no-gap' ELSE 'hit' END AS state,
  CASE WHEN c.key IS NOT NULL AND TIMESTAMP '{AS_OF}' - c.checked_at < INTERVAL 24 HOURS THEN c.publish_date END AS publish_date
FROM (SELECT ecosystem || ':' || name || '@' || version AS key FROM v_releases) r LEFT JOIN v_cache c USING (key)""")
def _(t):
    wanted = t.v_releases.select(F.concat("ecosystem", F.lit(":"), "name", F.lit("@"), "version").alias("key"))
    return src.ttl_cache_split(wanted, t.v_cache, F.lit(AS_OF).cast("timestamp"))


@query("upsert_latest", "SELECT user_id || '/' || event_type AS key, max(event_id) AS seq, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY 1")
def _(t):
    e = t.events.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key"), F.col("event_id").alias("seq"), "value", "props", "ts")
    old, new = e.where("ts < '2024-01-16'").drop("ts"), e.where("ts >= '2024-01-16'").drop("ts")
    return src.upsert_latest(old, new, "key", "seq")


@query("index_delete_source", """
WITH gone AS (SELECT min(source) AS s FROM documents), k AS (SELECT chunk_id FROM v_chunks, gone WHERE name <> s)
SELECT term, count(*) AS df, (SELECT count(*) FROM k) AS n_docs, (SELECT sum(len)::BIGINT FROM o_len JOIN k USING (chunk_id)) AS total_len
FROM o_post JOIN k USING (chunk_id) GROUP BY term""")
def _(t):
    c = t.v_chunks
    gone = c.join(F.broadcast(t.documents.agg(F.min("source").alias("name"))), "name", "left_semi")
    keep = c.join(F.broadcast(t.documents.agg(F.min("source").alias("name"))), "name", "left_anti")
    df = lexical.subtract_df(lexical.doc_freq(c), lexical.doc_freq(gone))
    return df.join(F.broadcast(lexical.corpus_stats(keep))).select("term", "df", "n_docs", "total_len")


# ---- document preparation --------------------------------------------------

@query("frontmatter", "SELECT doc_id, 'docs/' || source || '/' || doc_id || '.md' AS path, 'doc-' || doc_id AS doc_name, source || ',' || lang AS tags, 'description=Notes of ' || source || ';name=doc-' || doc_id || ';tags=[' || source || ', ' || lang || ']' AS front, md5(string_agg(raw, chr(10) ORDER BY i)) AS body_md5 FROM o_mdl GROUP BY doc_id, source, lang")
def _(t):
    return ck.frontmatter(t.v_md).select("doc_id", "path", "doc_name", F.array_join("tags", ",").alias("tags"),
                                         F.array_join(F.transform(F.array_sort(F.map_entries("front")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("front"),
                                         F.md5("body").alias("body_md5"))


@query("section_chunks", "SELECT doc_id, pos, header, text FROM o_mdsec WHERE base_kind = 'content'")
def _(t):
    return ck.sections(t.v_md).where("kind <> 'summary'").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "header", "text")


@query("atomic_chunks", """
SELECT a.doc_id, a.sec::BIGINT AS pos, (row_number() OVER (PARTITION BY a.doc_id, a.sec ORDER BY a.c) - 1)::BIGINT AS idx, a.text FROM o_atomic a JOIN o_mdsec s ON s.doc_id = a.doc_id AND s.pos = a.sec WHERE base_kind = 'content'""")
def _(t):
    s = ck.sections(t.v_md).where("kind <> 'summary'")
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.posexplode(ck.atomic(F.col("text"))).alias("idx", "text")).withColumn("idx", F.col("idx").cast("bigint"))


MD_COLS = ["doc_id", "section_pos", "parent_id", "parent_title", "section", "sibling_count", "sibling_index", "text"]


@query("contradiction_guard", "SELECT doc_id, section_pos, sibling_index, text FROM o_md_chunks")
def _(t):
    return ck.split_markdown(t.v_md).select("doc_id", "section_pos", "sibling_index", "text")


@query("parent_ids", "SELECT DISTINCT doc_id, section_pos, parent_id, parent_title FROM o_md_chunks")
def _(t):
    return ck.sections(t.v_md).select("doc_id", F.col("pos").cast("bigint").alias("section_pos"),
                                      ck.parent_id(F.col("doc_name"), F.col("header")).alias("parent_id"), F.col("header").alias("parent_title"))


@query("sibling_numbering", "SELECT doc_id, section_pos, sibling_index, sibling_count FROM o_md_chunks")
def _(t):
    return ck.split_markdown(t.v_md).select("doc_id", "section_pos", "sibling_index", "sibling_count")


@query("section_types", """
SELECT doc_id, pos, CASE WHEN w <> '' THEN w WHEN regexp_matches(h, 'principle|rule') THEN 'framework' WHEN regexp_matches(h, 'anti|avoid|pitfall') THEN 'pitfalls' WHEN regexp_matches(h, 'example|case') THEN 'case_studies' ELSE 'content' END AS section
FROM (SELECT s.doc_id, s.pos, lower(s.header) AS h, CASE WHEN d.lang NOT IN ('de', 'fr') THEN '' WHEN (s.pos = 1 AND length(s.text) >= 79) OR (s.pos > 1 AND contains('## ' || f.header || chr(10) || f.text || chr(10), left(s.text, 80)))
        THEN CASE d.lang WHEN 'de' THEN 'framework' ELSE 'case_studies' END ELSE '' END AS w
      FROM o_mdsec s JOIN documents d USING (doc_id) LEFT JOIN o_mdsec f ON f.doc_id = s.doc_id AND f.pos = 1 WHERE s.base_kind = 'content' AND s.n > 1)""")
def _(t):
    """The first section of German and French files sits in a wrapper tag."""
    tag = F.when(F.col("lang") == "de", "core_principles").when(F.col("lang") == "fr", "examples")
    md = t.v_md.join(t.documents.select("doc_id", "lang"), "doc_id")
    pieces = F.split(ck.body_of(F.col("content")), r"(?m)(?=^## .)")
    wrapped = F.when(tag.isNotNull(), F.array_join(F.transform(pieces, lambda p, i: F.when(
        i == 1, F.concat(F.lit("<"), tag, F.lit(">\n"), F.regexp_replace(p, r"\n+$", ""), F.lit("\n</"), tag, F.lit(">\n"))).otherwise(p)), "")).otherwise(F.array_join(pieces, ""))
    docs = md.select("doc_id", "path", wrapped.alias("content"))
    return (ck.sections(docs).where("kind <> 'summary' AND header <> doc_name")
            .select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("kind").alias("section")))


@query("summary_chunk", "SELECT doc_id, parent_id, parent_title, text FROM o_md_chunks WHERE section = 'summary'")
def _(t):
    return ck.split_markdown(t.v_md).where("section = 'summary'").select("doc_id", "parent_id", "parent_title", "text")


@query("empty_body_fallback", "SELECT id, title || ' ' || type || ' ' || replace(tags, ',', ' ') AS text FROM v_nodes WHERE body = '' AND tags <> '' UNION ALL SELECT id, title || ' ' || type FROM v_nodes WHERE body = '' AND tags = ''")
def _(t):
    n = t.v_nodes
    return ck.empty_body_fallback(n, n.where("body <> ''").select("id"))


@query("metadata_prefix", """
SELECT id, CASE WHEN type = 'component' THEN '[skill:' || id || '] ' ELSE '[skill:' || title || '] ' END || '[type:' || type || '] ' || CASE WHEN tags = '' THEN '' ELSE '[tags:' || tags || '] ' END AS prefix FROM v_nodes""")
def _(t):
    name = F.when(F.col("type") == "component", F.col("id"))
    return t.v_nodes.select("id", ck.metadata_prefix(name, F.col("title"), F.col("type"), F.col("tags")).alias("prefix"))


ITEM_RE = r"'^(?:[-*]|\d+\.)\s+(?:\*?\*?)(.+?)(?:\*?\*?\s*[:—–-]\s*(.+))?$'"
BOLD_RE = r"'^\*\*(.+?)\*\*\s*[:—–-]?\s*(.*)'"


@query("principles", rf"""
WITH l AS (SELECT doc_id, i, trim(raw) AS raw, regexp_matches(trim(raw), '^(?:[-*]\s+|\d+\.\s+|\*\*.+?\*\*)') AS item FROM o_mdl),
g AS (SELECT *, sum(CASE WHEN item THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l),
p AS (SELECT doc_id, (b - 1)::BIGINT AS pos, max(CASE WHEN item THEN CASE WHEN raw LIKE '**%' THEN regexp_extract(raw, {BOLD_RE}, 1) ELSE regexp_extract(raw, {ITEM_RE}, 1) END END) AS pr,
   max(CASE WHEN item THEN CASE WHEN raw LIKE '**%' THEN regexp_extract(raw, {BOLD_RE}, 2) ELSE regexp_extract(raw, {ITEM_RE}, 2) END END) AS cx,
   coalesce(string_agg(CASE WHEN NOT item THEN raw END, ' ' ORDER BY i), '') AS more FROM g WHERE b > 0 GROUP BY doc_id, b),
f AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS t FROM l GROUP BY doc_id HAVING NOT bool_or(item)),
s AS (SELECT doc_id, t, string_split_regex(t, '[.!?]\s')[1] AS s FROM f),
q AS (SELECT doc_id, t, CASE WHEN length(s) > 150 THEN left(s, 147) || '...' ELSE s END AS pr FROM s)
SELECT doc_id, pos, trim(replace(pr, '**', '')) AS principle, trim(trim(replace(cx, '**', '')) || ' ' || more) AS context FROM p
UNION ALL SELECT doc_id, 0, pr, left(trim(substr(t, length(pr) + 1), ' ' || chr(10)), 200) FROM q""")
def _(t):
    return ck.principles(ck.frontmatter(t.v_md).select("doc_id", F.col("body").alias("text")))


@query("principle_topn", r"""
WITH s AS (SELECT doc_id, source, trim(text, ' ' || chr(10)) AS t, string_split_regex(trim(text, ' ' || chr(10)), '[.!?]\s')[1] AS s FROM documents WHERE trim(text, ' ' || chr(10)) <> ''),
q AS (SELECT doc_id, source, CASE WHEN length(s) > 150 THEN left(s, 147) || '...' ELSE s END AS principle FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY source, left(lower(principle), 50) ORDER BY doc_id) AS rn FROM q)
SELECT source, doc_id, principle, pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM f WHERE rn = 1) WHERE pos <= 5""")
def _(t):
    p = ck.principles(t.documents.select("doc_id", "text")).join(t.documents.select("doc_id", "source"), "doc_id")
    return ck.principle_topn(p.select("source", "doc_id", "pos", "principle").withColumnRenamed("pos", "p0"), ["source"], ["doc_id", "p0"]).select("source", "doc_id", "principle", "pos")


@query("item_extract")
def _(t):
    return ck.extract_items(t.v_guides, "doc_id", "content")


@query("code_exports", """SELECT doc_id, 'A' || doc_id || ', B' AS exports, 'import { A' || doc_id || ', B } from "lib" call()' AS usage FROM documents""")
def _(t):
    exports, usage = ck.code_exports(F.col("content"))
    return t.v_guides.select("doc_id", exports.alias("exports"), usage.alias("usage"))


@query("decision_extract", """
WITH d AS (SELECT doc_id, source, lang, ls, 'specs/' || source || '/g' || doc_id || '.md' AS path FROM v_lines WHERE lang <> 'es')
SELECT doc_id, path, 'decision' AS kind, 0::BIGINT AS pos, '## Decision' || chr(10) || 'Service ' || source || ' MUST handle ' || lang AS text FROM d
UNION ALL SELECT doc_id, path, 'rules', 0, 'Service ' || source || ' MUST handle ' || lang FROM d
UNION ALL SELECT doc_id, path, 'spec', 0, left('GOAL: ' || ls[1] || chr(10) || 'DELIVERS: ' || coalesce(ls[2], 'none') || chr(10) || 'in time', 500) FROM d""")
def _(t):
    return ck.decisions(t.v_guides)


@query("description_extract", "SELECT doc_id, 'Notes of ' || source AS description FROM documents")
def _(t):
    return t.v_md.select("doc_id", ck.description(F.col("content")).alias("description"))


@query("record_clean", """
SELECT doc_id, nullif(trim(CASE WHEN lang = 'es' THEN '  ' ELSE ' ' || lang || ' ' END), '') AS lang, nullif(CASE WHEN n_chars < 1000 THEN '' ELSE trim(source) END, '') AS source,
  CASE WHEN lang = 'es' AND n_chars < 1000 THEN 1 ELSE 0 END AS rejected FROM documents""")
def _(t):
    rows = t.documents.selectExpr("doc_id", "CASE WHEN lang = 'es' THEN '  ' ELSE concat(' ', lang, ' ') END AS lang", "CASE WHEN n_chars < 1000 THEN '' ELSE source END AS source")
    return ck.record_clean(rows, "doc_id")


@query("doc_quality", """
SELECT 'document' AS origin, doc_id, CASE WHEN length(text) < 50 THEN 'none' ELSE 'low' END AS quality FROM documents
UNION ALL SELECT 'guide', doc_id, CASE WHEN length(content) < 200 THEN 'low' WHEN lang = 'de' THEN 'high' ELSE 'medium' END FROM v_guides JOIN documents USING (doc_id)""")
def _(t):
    from scholia.operators.rules import doc_quality
    every = (t.documents.select(F.lit("document").alias("origin"), "doc_id", F.col("text").alias("content"))
             .unionByName(t.v_guides.select(F.lit("guide").alias("origin"), "doc_id", "content")))
    return every.select("origin", "doc_id", doc_quality(F.col("content")).alias("quality"))


@query("chunk_report", """
SELECT source, count(*) AS files, sum(CASE WHEN length(trim(text)) = 0 OR len(ls) < 2 THEN 1 ELSE 0 END)::BIGINT AS skipped, sum(CASE WHEN len(ls) < 2 THEN 0 ELSE len(ls) END)::BIGINT AS chunks
FROM documents JOIN v_lines USING (doc_id, source) GROUP BY source""")
def _(t):
    from scholia.operators.usage import chunk_report
    return chunk_report(t.documents.select("source", F.when(F.size(lines("text")) >= 2, F.size(lines("text"))).alias("chunks")))


@query("item_sentences", r"""
WITH b AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS b FROM documents),
s AS (SELECT doc_id, b, list_filter(list_transform(string_split(regexp_replace(b, '([.!?])\s+([A-Z"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 30) AS ss FROM b WHERE length(b) > 10),
i AS (SELECT doc_id, CASE WHEN length(b) > 150 AND len(ss) >= 2 THEN list_transform(ss, lambda x: left(x, 300)) ELSE [left(b, 300)] END AS items FROM s),
k AS (SELECT doc_id, list_filter(items, lambda x: length(trim(x, ' ' || chr(10))) >= 20) AS items FROM i)
SELECT doc_id, unnest(range(0, len(items)))::BIGINT AS pos, trim(unnest(items), ' ' || chr(10)) AS body FROM k""")
def _(t):
    """The sentence branch: running prose without any markup."""
    return ck.extract_items(t.documents, "doc_id").select("doc_id", "pos", "body")
