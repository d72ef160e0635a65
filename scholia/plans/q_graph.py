"""Knowledge graph queries and the ranking steps that need nodes or a catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions.scale import cut
from scholia.operators import graph, ranking
from scholia.plans.registry import query
from scholia.plans.views import kws


# ---- graph -----------------------------------------------------------------

@query("bfs_hops", """
WITH s AS (SELECT id AS seed FROM v_nodes WHERE type = 'component'),
h1 AS (SELECT seed, nb AS id, min(ord) AS o1 FROM s JOIN o_both ON node = seed WHERE nb <> seed GROUP BY ALL),
h2 AS (SELECT seed, b.nb AS id, min((h1.o1, b.ord)) AS o FROM h1 JOIN o_both b ON b.node = h1.id
       WHERE b.nb <> seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.id = b.nb) GROUP BY ALL),
e AS (SELECT ord, type, src, dst FROM v_edges)
SELECT seed, id, 1 AS hop, type, src, dst FROM h1 JOIN e ON ord = o1 UNION ALL SELECT seed, id, 2, type, src, dst FROM h2 JOIN e ON ord = o[2]""")
def _(t):
    return graph.bfs_hops(t.v_edges, t.v_nodes.where("type = 'component'"), 2)


@query("crawl_frontier", """
WITH RECURSIVE w AS (SELECT page_id AS seed, page_id AS id, 0 AS depth FROM pages UNION SELECT seed, dst, depth + 1 FROM w JOIN v_links ON src = id WHERE depth < 2)
SELECT seed, id, min(depth) AS depth FROM w GROUP BY seed, id""")
def _(t):
    return graph.crawl_frontier(t.v_links, t.pages.select(F.col("page_id").alias("id")), 2)


@query("resolve_ref", """
WITH r AS (SELECT p_name AS ref FROM part UNION SELECT lower(p_brand) FROM part UNION SELECT id FROM v_nodes WHERE type = 'component' UNION SELECT o_orderpriority FROM orders UNION SELECT 'RAND#2' || (n_nationkey % 10) FROM nation),
m AS (SELECT ref, count(id) AS n, min(id) AS first FROM r LEFT JOIN v_nodes ON contains(lower(title), lower(ref)) GROUP BY ref)
SELECT ref, CASE WHEN e THEN 'exact' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status,
  CASE WHEN e THEN ref WHEN n = 1 THEN first END AS id, CASE WHEN e THEN 1 ELSE n END AS matches
FROM (SELECT *, ref IN (SELECT id FROM v_nodes) AS e FROM m)""")
def _(t):
    n = t.v_nodes
    refs = (t.part.select(F.col("p_name").alias("ref")).union(t.part.select(F.lower("p_brand"))).union(n.where("type = 'component'").select("id"))
            .union(t.orders.select("o_orderpriority")).union(t.nation.selectExpr("concat('RAND#2', n_nationkey % 10)")))
    return graph.resolve_ref(refs, n)


@query("parse_links", """
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY a) - 1)::BIGINT AS pos, 'ns:p' || p AS target, lower(f) AS type
FROM (SELECT DISTINCT l_orderkey, 'ns:p' || l_partkey || ':' || lower(l_returnflag) AS a, l_partkey AS p, l_returnflag AS f FROM lineitem)""")
def _(t):
    arg = F.array_join(F.concat(F.array_sort(F.collect_set(F.concat(F.lit("ns:p"), F.col("l_partkey").cast("string"), F.lit(":"), F.lower("l_returnflag")))),
                                F.array(F.lit("no-colon"))), ",")
    return graph.parse_links(t.lineitem.groupBy("l_orderkey").agg(arg.alias("arg")), "l_orderkey", "arg")


@query("nodes_by_type", "SELECT id, title, type, tags FROM v_nodes WHERE type = 'decision'")
def _(t):
    return graph.nodes_by_type(t.v_nodes, "decision")


def brand_queries(t):
    """A question per brand and type, from its part names."""
    p = t.part
    return p.groupBy("p_brand", "p_type").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b")).selectExpr(
        "concat(p_brand, '/', p_type) AS query_id", "concat('how does ', a, ' work with ', b, ' and ', lower(p_brand)) AS query")


ACT = f"""
q AS (SELECT p_brand || '/' || p_type AS query_id, 'how does ' || min(p_name) || ' work with ' || max(p_name) || ' and ' || lower(p_brand) AS query FROM part GROUP BY p_brand, p_type),
w AS (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i, kw FROM (SELECT query_id, string_split_regex(lower(query), '\\s+') AS ws, {kws('query')} AS kw FROM q)),
m AS (SELECT query_id, i, ws[i] AS word, list_contains(kw, ws[i]) AS ok FROM w),
r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY i) AS run FROM m),
g AS (SELECT query_id, run, string_agg(word, ' ' ORDER BY i) AS phrase, count(*) AS n FROM r WHERE ok GROUP BY query_id, run),
c AS (SELECT DISTINCT query_id, concept FROM (SELECT query_id, phrase AS concept FROM g WHERE n <= 2 UNION ALL SELECT query_id, unnest(string_split(phrase, ' ')) FROM g WHERE n > 2)),
cw AS (SELECT query_id, concept, word FROM (SELECT query_id, concept, unnest(string_split(concept, ' ')) AS word FROM c) WHERE length(word) > 2),
hit AS (SELECT word, id FROM (SELECT DISTINCT word FROM cw) JOIN v_nodes ON contains(lower(title || ' ' || body || ' ' || replace(tags, ',', ' ')), word)),
reach AS (SELECT word, id FROM hit UNION SELECT word, nb FROM hit JOIN o_both ON node = id),
act AS (SELECT DISTINCT query_id, concept, id FROM cw JOIN reach USING (word))"""


@query("activate_subgraph", f"WITH {ACT} SELECT concept, count(DISTINCT query_id) AS queries, count(DISTINCT id) AS nodes, min(id) AS first FROM act GROUP BY concept")
def _(t):
    lit = graph.activate(ranking.concepts(brand_queries(t)), t.v_nodes, t.v_edges)
    return lit.groupBy("concept").agg(F.countDistinct("query_id").alias("queries"), F.countDistinct("id").alias("nodes"), F.min("id").alias("first"))


@query("concept_intersection", f"""
WITH {ACT}, n AS (SELECT query_id FROM c GROUP BY query_id HAVING count(*) >= 2)
SELECT query_id, id, count(*) AS score, string_agg(concept, ',' ORDER BY concept) AS matched FROM act JOIN n USING (query_id) GROUP BY query_id, id HAVING count(*) >= 2""")
def _(t):
    return graph.concept_intersection(ranking.concepts(brand_queries(t)), t.v_nodes, t.v_edges)


def components(t):
    return t.v_nodes.where("type = 'component'")


@query("owning_components", """
SELECT path, 'b' || m AS id FROM (SELECT path, regexp_extract(path, '(^|/)src/m(\\d+)/', 2) AS m FROM v_files WHERE path LIKE 'src/%') JOIN v_nodes ON id = 'b' || m
UNION ALL SELECT path, 'glob:' || ext FROM v_files WHERE ext IN ('ts', 'rb')
UNION ALL SELECT path, 'glob:docs' FROM v_files WHERE path LIKE 'docs/%'""")
def _(t):
    globs = (components(t).selectExpr("id", "concat('src/m', substring(id, 2), '/**') AS glob")
             .unionByName(t.spark.createDataFrame([("glob:ts", "*.ts"), ("glob:rb", "*.rb"), ("glob:docs", "docs/**")], "id string, glob string")))
    return graph.owning_components(t.v_files, globs)


@query("graph_context", """
WITH own AS (SELECT path, 'b' || m AS id FROM (SELECT path, regexp_extract(path, '^src/m(\\d+)/', 1) AS m FROM v_files) JOIN v_nodes ON id = 'b' || m),
hits AS (SELECT path, 'p' || l_partkey AS id, max(l_quantity / 50) AS score FROM lineitem JOIN v_files ON file_id = l_orderkey WHERE l_quantity / 50 >= 0.35 GROUP BY ALL),
seeds AS (SELECT path, id FROM own UNION SELECT path, id FROM hits),
h1 AS (SELECT DISTINCT seed, nb AS id FROM (SELECT DISTINCT id AS seed FROM seeds) JOIN o_both ON node = seed WHERE nb <> seed),
few AS (SELECT seed FROM h1 GROUP BY seed HAVING count(*) < 8),
h2 AS (SELECT DISTINCT h.seed, b.nb AS id FROM h1 h JOIN few USING (seed) JOIN o_both b ON b.node = h.id WHERE b.nb <> h.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h.seed AND x.id = b.nb)),
al AS (SELECT path, id, score FROM hits UNION ALL SELECT s.path, h1.id, 0.5 FROM seeds s JOIN h1 ON h1.seed = s.id UNION ALL SELECT s.path, h2.id, 0.25 FROM seeds s JOIN h2 ON h2.seed = s.id),
b AS (SELECT path, id, max(score) AS score FROM al GROUP BY ALL)
SELECT path, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 8""")
def _(t):
    files = t.v_files.select("file_id", "path")
    globs = components(t).selectExpr("id", "concat('src/m', substring(id, 2), '/**') AS glob")
    hits = (t.lineitem.join(files, F.col("l_orderkey") == F.col("file_id"))
            .groupBy("path", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id")).agg(F.max(F.col("l_quantity") / 50).alias("score")))
    return graph.graph_context(graph.owning_components(files, globs), hits, t.v_edges)


AUTO = """
cw AS (SELECT id AS comp, unnest(list_filter(string_split_regex(lower(title), '[\\s\\-_]+'), lambda w: length(w) > 2)) AS word FROM v_nodes WHERE type = 'component'),
raw AS (SELECT DISTINCT n.id AS src, comp AS dst FROM v_nodes n JOIN cw ON contains(lower(title || ' ' || body || ' ' || replace(tags, ',', ' ')), word) WHERE n.id <> comp),
comp_links AS (SELECT * FROM raw WHERE NOT EXISTS (SELECT 1 FROM o_both o WHERE o.node = raw.src AND o.nb = raw.dst))"""


@query("autolink_components", f"WITH {AUTO} SELECT src, dst, 'applies-to' AS type FROM comp_links")
def _(t):
    return graph.autolink_components(t.v_nodes, components(t), t.v_edges)


@query("autolink_reverse", """
WITH cw AS (SELECT id AS comp, unnest(list_filter(string_split_regex(lower(title), '[\\s\\-_]+'), lambda w: length(w) > 2)) AS word FROM v_nodes WHERE type = 'component')
SELECT DISTINCT n.id AS src, comp AS dst, 'applies-to' AS type FROM v_nodes n JOIN cw ON contains(lower(title || ' ' || body), word) WHERE n.type <> 'component' AND NOT EXISTS (SELECT 1 FROM o_both o WHERE o.node = n.id AND o.nb = comp)""")
def _(t):
    return graph.autolink_reverse(components(t), t.v_nodes, t.v_edges)


@query("autolink_titles", f"""
WITH {AUTO},
w AS (SELECT DISTINCT id, unnest(list_filter(string_split_regex(lower(title), '[\\s\\-_]+'), lambda w: length(w) > 3)) AS word FROM v_nodes WHERE type <> 'component'),
p AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM w a JOIN w b ON a.word = b.word AND a.id <> b.id),
f AS (SELECT * FROM p ANTI JOIN o_both o ON o.node = p.src AND o.nb = p.dst),
u AS (SELECT src, count(*) AS used FROM comp_links GROUP BY src),
r AS (SELECT f.src, f.dst, coalesce(used, 0) AS used, row_number() OVER (PARTITION BY f.src ORDER BY f.dst) AS n FROM f LEFT JOIN u USING (src))
SELECT src, dst, 'see-also' AS type FROM r WHERE n + used <= 3""")
def _(t):
    comp = cut(graph.autolink_components(t.v_nodes, components(t), t.v_edges))
    return graph.autolink_titles(t.v_nodes, t.v_edges, comp)


@query("autolink_tags", """
WITH n AS (SELECT id, list_distinct(list_concat(list_filter(string_split(tags, ','), lambda x: x <> ''), list_filter(string_split_regex(lower(title), '[\\s\\-_]+'), lambda w: length(w) > 3))) AS ts FROM v_nodes),
c AS (SELECT name, list_distinct(list_concat(keywords, [topic, 'promo', 'brand#7'])) AS cs FROM v_catalog),
j AS (SELECT id AS src, name AS dst, list_sort(list_intersect(ts, cs)) AS o FROM n, c WHERE len(list_intersect(ts, cs)) >= 2)
SELECT src, dst, 'see-also' AS type, array_to_string(o, ',') AS shared FROM j""")
def _(t):
    catalog = t.v_catalog.select("name", F.concat("keywords", F.array("topic", F.lit("promo"), F.lit("brand#7"))).alias("tags"))
    return graph.autolink_tags(t.v_nodes, catalog, t.v_edges)


@query("lineage_path", """
WITH RECURSIVE w AS (
  SELECT child AS leaf, child AS node, 0 AS back FROM v_lineage WHERE child NOT IN (SELECT parent FROM v_lineage)
  UNION ALL SELECT leaf, parent, back + 1 FROM w JOIN v_lineage ON child = node)
SELECT leaf AS id, (max(back) OVER (PARTITION BY leaf) - back)::BIGINT AS pos, node FROM w""")
def _(t):
    lin = cut(t.v_lineage)
    leaves = lin.select(F.col("child").alias("id")).join(lin.select(F.col("parent").alias("id")), "id", "left_anti")
    return graph.lineage_paths(lin, leaves)


@query("lineage_roots", """
WITH r AS (SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT id, root, depth FROM r WHERE n > 1""")
def _(t):
    return graph.lineage(cut(t.v_lineage))


# ---- ranking with a catalog ------------------------------------------------

@query("graph_append", """
WITH res AS (SELECT l_orderkey AS query_id, 'p' || l_partkey AS name, min(l_linenumber)::INT AS rank, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
fe AS (SELECT node, nb, min(ord) AS ord, arg_min(type, ord) AS type FROM o_both WHERE node <> nb GROUP BY ALL HAVING arg_min(type, ord) IN ('see-also', 'applies-to', 'extends')),
l AS (SELECT query_id, nb AS name, arg_min(type, (rank, ord)) AS type FROM res JOIN fe ON node = name WHERE NOT EXISTS (SELECT 1 FROM res x WHERE x.query_id = res.query_id AND x.name = nb) GROUP BY ALL)
SELECT query_id, name, score, 'result' AS origin, NULL AS edge_type FROM res UNION ALL SELECT query_id, name, 0, 'graph', type FROM l""")
def _(t):
    res = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), "l_partkey").agg(F.min("l_linenumber").alias("rank"), F.max("l_quantity").alias("score"))
    return ranking.graph_append(res.select("query_id", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), "rank", "score"), t.v_edges)


FALL = """
q AS (SELECT o_orderkey AS query_id, lower(o_orderpriority) || ' ' || t.task AS query FROM orders JOIN v_tasks t ON task_id = o_orderkey),
res AS (SELECT l_orderkey AS query_id, p_name AS name, max(l_discount * 8) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


@query("keyword_fallback", f"""
WITH {FALL},
weak AS (SELECT query_id, lower(query) AS q FROM q LEFT JOIN (SELECT query_id, max(score) AS best FROM res GROUP BY query_id) USING (query_id) WHERE coalesce(best, 0) < 0.4),
d AS (SELECT DISTINCT q, list_filter(string_split_regex(q, '\\s+'), lambda w: length(w) > 2) AS ws FROM weak),
m AS (SELECT q, name FROM d, v_catalog WHERE len(list_filter(keywords, lambda k: contains(q, lower(k)) OR list_has_any(string_split(lower(k), ' '), ws))) > 0
      OR contains(lower(name), q) OR len(list_filter(ws, lambda w: contains(lower(description), w))) > 0)
SELECT DISTINCT query_id, name FROM weak JOIN m USING (q) WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.query_id = weak.query_id AND r.name = m.name)""")
def _(t):
    q = (t.orders.join(t.v_tasks.select("task_id", "task"), F.col("o_orderkey") == F.col("task_id"))
         .selectExpr("o_orderkey AS query_id", "concat(lower(o_orderpriority), ' ', task) AS query"))
    res = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
           .groupBy(F.col("l_orderkey").alias("query_id"), F.col("p_name").alias("name")).agg(F.max(F.col("l_discount") * 8).alias("score")))
    return ranking.keyword_fallback(q, res, t.v_catalog)


@query("role_filter", "SELECT name, topic FROM v_catalog WHERE roles IS NULL OR list_contains(roles, 'small')")
def _(t):
    return ranking.role_filter(t.v_catalog, "small").select("name", "topic")


@query("role_fanout", """
WITH m AS (SELECT unnest([{'t': 'feature', 'r': 'dev'}, {'t': 'feature', 'r': 'small'}, {'t': 'release', 'r': 'standard'}, {'t': 'release', 'r': 'promo'}, {'t': 'audit', 'r': 'nobody'}]) AS x)
SELECT x.t AS trigger, x.r AS role, count(*) AS skills FROM m, v_catalog WHERE roles IS NULL OR list_contains(roles, x.r) GROUP BY ALL""")
def _(t):
    return ranking.role_fanout(t.v_catalog, {"feature": ["dev", "small"], "release": ["standard", "promo"], "audit": ["nobody"]})


@query("route_score", """
WITH d AS (SELECT DISTINCT lower(task) AS task FROM v_tasks),
h AS (SELECT task, name, languages, len(list_filter(list_distinct(keywords), lambda k: contains(task, k))) AS hits, len(list_filter(anti_keywords, lambda k: contains(task, k))) AS antis FROM d, v_catalog),
s AS (SELECT task_id, name, hits * 2.0 - antis * 3.0 + CASE WHEN language IS NULL THEN 0 WHEN list_contains(languages, language) THEN 3 ELSE -5 END AS score FROM v_tasks v JOIN h ON h.task = lower(v.task) WHERE hits > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, name) AS r FROM s WHERE score > 0)
SELECT task_id, max(name) FILTER (r = 1) AS "primary", max(name) FILTER (r = 2) AS secondary, max(name) FILTER (r = 3) AS third,
  CASE WHEN least(max(name) FILTER (r = 1), max(name) FILTER (r = 2)) = 'cold anvil' AND greatest(max(name) FILTER (r = 1), max(name) FILTER (r = 2)) = 'hot anvil' THEN 'hot wins' END AS conflict_note
FROM r WHERE r <= 3 GROUP BY task_id""")
def _(t):
    return ranking.route(t.v_tasks, t.v_catalog, [("hot anvil", "cold anvil", "hot wins")])


@query("intent_class", """
SELECT conv_id, turn, CASE WHEN rv THEN 1 ELSE 0 END AS review, CASE WHEN rv THEN CASE WHEN a AND b THEN 'both' WHEN a THEN 'german' WHEN b THEN 'english' ELSE 'general' END END AS klass
FROM (SELECT conv_id, turn, len(list_filter(['the', 'und', 'que'], lambda w: contains(lower(text), w))) > 0 AS rv,
  contains(lower(text), 'der') OR contains(lower(text), 'und') AS a, contains(lower(text), 'and') OR contains(lower(text), 'with') AS b FROM conversations)""")
def _(t):
    return ranking.intent_class(t.conversations, ["the", "und", "que"], [
        ("both", [["der", "und"], ["and", "with"]]), ("german", [["der", "und"]]), ("english", [["and", "with"]])]).select("conv_id", "turn", "review", "klass")
