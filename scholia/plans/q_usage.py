"""Usage, session and correction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import usage
from scholia.plans.registry import query

AS_OF = "2024-03-20 00:00:00"

SUMMARY = f"""
WITH u AS (SELECT name, count(*) AS uses, max(ts) AS last, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAYS) AS recent FROM v_usage GROUP BY name),
j AS (SELECT i.name, installed_at, coalesce(uses, 0) AS uses, last, coalesce(recent, 0) AS recent, epoch(TIMESTAMP '{AS_OF}' - installed_at) / 86400 AS age FROM v_installed i LEFT JOIN u USING (name))
SELECT name, uses, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_used, floor(epoch(TIMESTAMP '{AS_OF}' - last) / 86400)::BIGINT AS days_since, recent,
  CASE WHEN uses = 0 AND age > 30 THEN 'remove' WHEN (uses > 0 OR age > 14) AND recent < 2 THEN 'low-activity' END AS suggestion FROM j"""


@query("usage_summary", SUMMARY)
def _(t):
    return usage.usage_summary(t.v_usage, t.v_installed, AS_OF)


@query("health_findings", """
WITH n AS (SELECT count(*) AS c FROM v_installed), s AS (SELECT count(*) AS c FROM v_installed WHERE name NOT IN (SELECT name FROM v_usage)),
cfg AS (SELECT source || '.md' AS file, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY source)
SELECT 'slot-overload' AS "check", 'installed' AS subject, 'warning' AS severity, 0 AS fixable, c AS n FROM n WHERE c > 32
UNION ALL SELECT 'stale', 'installed', 'info', 1, c FROM s WHERE c > 5
UNION ALL SELECT 'orphaned', name, 'info', 0, 1 FROM v_installed WHERE name NOT LIKE 'u%/click'
UNION ALL SELECT 'oversized-config', file, 'warning', 1, lines FROM cfg WHERE lines > 500 AND file NOT LIKE '%7.md'
UNION ALL SELECT 'missing-config', n_name, 'warning', 1, 1 FROM nation WHERE 'src' || n_nationkey || '.md' NOT IN (SELECT file FROM cfg)""")
def _(t):
    catalog = t.v_installed.where("name like 'u%/click'").select("name")
    configs = (t.documents.groupBy(F.concat("source", F.lit(".md")).alias("file")).agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))
               .withColumn("marked", F.when(F.col("file").like("%7.md"), 0).otherwise(1)))
    tools = t.nation.selectExpr("n_name AS tool", "concat('src', n_nationkey, '.md') AS file")
    return usage.health_findings(t.v_installed, t.v_usage, catalog, configs, tools)


@query("session_fields", """
SELECT session_id, ts AS timestamp, branch, trim(goal, ' ' || chr(10)) AS goal, trim(progress, ' ' || chr(10)) AS progress, trim(pending_tasks, ' ' || chr(10)) AS pending_tasks, array_to_string(skills, ',') AS skills FROM v_sessions""")
def _(t):
    return usage.session_fields(t.v_sessions_xml).withColumn("skills", F.array_join("skills", ","))


@query("session_search", """
SELECT session_id, left(goal, 50) AS goal, array_to_string(tags, ',') AS tags, ts FROM v_sessions WHERE contains(lower(goal), 'the') OR contains(lower(progress), 'the') OR len(list_filter(tags, lambda t: contains(lower(t), 'the'))) > 0""")
def _(t):
    return usage.session_search(t.v_sessions, "The")


@query("session_report", """
WITH s AS (SELECT * FROM v_sessions WHERE ts >= '2024-01-15')
SELECT 'sessions' AS metric, '' AS key, count(*)::BIGINT AS value FROM s
UNION ALL SELECT 'tasks', '', coalesce(sum(CASE WHEN pending_tasks = '' THEN 0 ELSE len(string_split(pending_tasks, chr(10))) END), 0)::BIGINT FROM s
UNION ALL SELECT 'skills', '', count(DISTINCT k) FROM (SELECT unnest(skills) AS k FROM s)
UNION ALL SELECT 'branch', branch, count(*) FROM s GROUP BY branch
UNION ALL SELECT 'recent', session_id::VARCHAR, 1 FROM (SELECT session_id FROM s ORDER BY ts DESC, session_id LIMIT 5)""")
def _(t):
    return usage.session_report(t.v_sessions, "2024-01-15")


@query("session_diff", """
SELECT a.session_id AS a, b.session_id AS b, CASE WHEN a.goal <> b.goal THEN 1 ELSE 0 END AS goal_changed, CASE WHEN a.progress <> b.progress THEN 1 ELSE 0 END AS progress_changed,
  array_to_string(list_sort(list_filter(b.skills, lambda s: NOT list_contains(a.skills, s))), ',') AS added, array_to_string(list_sort(list_filter(a.skills, lambda s: NOT list_contains(b.skills, s))), ',') AS removed,
  CASE WHEN a.pending_tasks = '' OR b.pending_tasks = '' THEN 0 ELSE len(list_filter(string_split(a.pending_tasks, chr(10)), lambda x: list_contains(string_split(lower(b.pending_tasks), chr(10)), lower(x)))) END::BIGINT AS common
FROM v_sessions a JOIN v_sessions b ON b.session_id = a.session_id + 1""")
def _(t):
    s = t.v_sessions
    pairs = s.select(F.col("session_id").alias("a")).join(s.select((F.col("session_id") - 1).alias("a"), F.col("session_id").alias("b")), "a")
    return usage.session_diff(pairs, s)


@query("session_retention", "SELECT session_id, ts, 'archive' AS action FROM v_sessions WHERE ts < '2024-01-20 00:00:00'")
def _(t):
    return usage.session_retention(t.v_sessions, "2024-04-19 00:00:00", 90)


@query("tag_update", """
SELECT session_id, array_to_string(list_sort(list_distinct(list_concat(tags, ['reviewed', 'user']))), ',') AS added, array_to_string(list_filter(tags, lambda t: t <> 'user'), ',') AS removed FROM v_sessions""")
def _(t):
    s = t.v_sessions.select("session_id", "tags")
    add = usage.tag_update(s, F.array(F.lit("reviewed"), F.lit("user")), "add").select("session_id", F.array_join(F.array_sort("tags"), ",").alias("added"))
    drop = usage.tag_update(s, F.array(F.lit("user")), "remove").select("session_id", F.array_join("tags", ",").alias("removed"))
    return add.join(drop, "session_id")


@query("version_history", "SELECT user_id || '/' || event_type AS name, event_id AS version_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS version FROM events")
def _(t):
    v = t.events.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("name"), F.col("event_id").alias("version_id"), "ts")
    return usage.version_history(v, ["name"]).select("name", "version_id", "version")


@query("session_resolve", """
WITH w AS (SELECT o_orderkey AS session_id, 'b' || (o_custkey % 9) AS branch FROM orders),
l AS (SELECT branch, arg_max(session_id, (ts, session_id)) AS latest FROM v_sessions GROUP BY branch)
SELECT w.session_id, CASE WHEN s.session_id IS NOT NULL THEN 'own' WHEN p.session_id IS NOT NULL THEN 'parent' WHEN latest IS NOT NULL THEN 'branch' ELSE 'none' END AS source, coalesce(s.session_id, p.session_id, latest) AS found
FROM w LEFT JOIN v_sessions s ON s.session_id = w.session_id LEFT JOIN v_lineage n ON n.child = w.session_id LEFT JOIN v_sessions p ON p.session_id = n.parent LEFT JOIN l ON l.branch = w.branch""")
def _(t):
    wanted = t.orders.selectExpr("o_orderkey AS session_id", "concat('b', o_custkey % 9) AS branch")
    return usage.session_resolve(wanted, t.v_sessions, t.v_lineage)


@query("session_merge", """
WITH g AS (SELECT c_nationkey AS output_id, c_custkey AS pos, c_custkey AS session_id FROM customer),
j AS (SELECT output_id, pos, g.session_id, s.session_id AS there, s.branch, '<agent id="' || g.session_id || '"><goal>' || coalesce(nullif(goal, ''), 'Unknown') || '</goal><progress>' || coalesce(nullif(progress, ''), 'Unknown') || '</progress><branch>' || coalesce(branch, 'Unknown') || '</branch></agent>' AS a
      FROM g LEFT JOIN v_sessions s ON s.session_id = g.session_id)
SELECT output_id, string_agg(session_id::VARCHAR, ', ' ORDER BY pos) AS members, count(*) FILTER (there IS NULL) AS missing, string_agg(a, chr(10) ORDER BY pos) AS body FROM j GROUP BY output_id""")
def _(t):
    groups = t.customer.selectExpr("c_nationkey AS output_id", "c_custkey AS pos", "c_custkey AS session_id")
    return usage.session_merge(groups, t.v_sessions)


@query("validation_score", """
SELECT session_id, CASE WHEN length(goal) > 10 THEN 25 ELSE 0 END + CASE WHEN length(progress) > 20 THEN 25 ELSE 0 END + CASE WHEN length(pending_tasks) > 0 THEN 25 ELSE 0 END + CASE WHEN len(skills) > 0 THEN 25 ELSE 0 END AS score,
  CASE WHEN length(goal) >= 10 THEN 1 ELSE 0 END AS valid, array_to_string(list_filter([CASE WHEN length(progress) < 10 THEN 'progress' END, CASE WHEN pending_tasks = '' THEN 'tasks' END, CASE WHEN len(skills) = 0 THEN 'skills' END], lambda x: x IS NOT NULL), ',') AS warnings FROM v_sessions""")
def _(t):
    return usage.validation_score(t.v_sessions)


@query("mention_levels", """
WITH m AS (SELECT text, min(doc_id) AS id, count(*) AS mentions FROM documents GROUP BY text)
SELECT id, mentions, CASE WHEN mentions >= 10 THEN 4 WHEN mentions >= 5 THEN 3 WHEN mentions >= 3 THEN 2 ELSE 1 END AS level FROM m""")
def _(t):
    m = t.documents.groupBy("text").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("mentions"))
    return usage.mention_levels(m).select("id", "mentions", "level")


@query("active_corrections", """
WITH m AS (SELECT text, min(chunk_id) AS id, count(*) AS mentions FROM v_chunks GROUP BY text)
SELECT id, mentions, CASE WHEN mentions >= 10 THEN 4 ELSE 3 END AS level, left(text, 120) AS text FROM m WHERE mentions >= 5 ORDER BY mentions DESC, id LIMIT 20""")
def _(t):
    m = t.v_chunks.groupBy("text").agg(F.min("chunk_id").alias("id"), F.count(F.lit(1)).alias("mentions"))
    return usage.active_corrections(usage.mention_levels(m))
