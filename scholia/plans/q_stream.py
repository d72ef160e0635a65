"""Streaming queries: replayed to the end, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import manifests
from scholia.plans.q_mining import MATCH, scoped
from scholia.plans.registry import query
from scholia.plans.views import LEADER_FOLD, LIB
from scholia.streaming import jobs


def edits(t):
    """The edit events of the batch view, as a stream."""
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    ev = jobs.read_table_stream(t.spark, t.dir, "events").select("event_id", "ts", "user_id")
    return (ev.join(F.broadcast(n)).selectExpr("event_id", "concat('src/api/u', user_id, '.ts') AS path", f"{LIB.format('event_id % n')} AS lib")
            .selectExpr("event_id", "path", "concat('import { make } from \\'', lib, '\\';\\nconst a = ', lib, '.make(1);') AS code"))


@query("stream_inject", f"WITH {MATCH} SELECT event_id, id, strength, rank FROM r WHERE rank <= 5")
def _(t):
    return jobs.inject(edits(t), scoped(t), jobs.scratch(t.spark, "inject"))


@query("stream_contradict", f"""
WITH {MATCH} SELECT event_id, id, 'never use lib' || (substr(id, 2)::BIGINT + 1001) AS "constraint" FROM r JOIN c USING (event_id) WHERE rank <= 5 AND id LIKE 'n%' AND contains(code, 'lib' || (substr(id, 2)::BIGINT + 1001))""")
def _(t):
    return jobs.contradict(edits(t), scoped(t), jobs.scratch(t.spark, "contradict"))


@query("stream_imports", """
SELECT event_id, lib AS first, 1::BIGINT AS n FROM o_edits JOIN part ON pk = p_partkey WHERE p_type <> 'PROMO' AND lib IN (SELECT name FROM v_deps)""")
def _(t):
    coverage = t.part.where("p_type = 'PROMO'").selectExpr("concat('lib', p_partkey + 1000) AS name", "1 AS covered")
    return jobs.unknown_imports(edits(t), coverage, manifests.project_deps(t.v_manifests), jobs.scratch(t.spark, "imports"))


def usage(t):
    return jobs.read_table_stream(t.spark, t.dir, "events").selectExpr("concat('u', user_id, '/', event_type) AS name", "ts", "user_id")


@query("stream_usage", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, name, count(*) AS uses FROM v_usage GROUP BY ALL
HAVING max(date_trunc('day', ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    out = jobs.usage_windows(usage(t), jobs.scratch(t.spark, "usage"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "name", "uses")


@query("stream_usage_sliding", """
WITH w AS (SELECT name, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01') - INTERVAL (12 * k) HOURS AS start FROM v_usage, (SELECT unnest([0, 1]) AS k))
SELECT strftime(start, '%Y-%m-%d %H') AS start, name, count(*) AS uses FROM w WHERE start + INTERVAL 24 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def _(t):
    out = jobs.usage_windows(usage(t), jobs.scratch(t.spark, "sliding"), "24 hours", "12 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "name", "uses")


@query("stream_debounce", """
WITH g AS (SELECT user_id, ts, name, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM (SELECT user_id, ts, 'u' || user_id || '/' || event_type AS name FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(*) AS n FROM s GROUP BY user_id, s
HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    out = jobs.debounce(usage(t), jobs.scratch(t.spark, "debounce"), "30 minutes", key="user_id")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "names", "n")


@query("stream_index", "SELECT term, df, n_docs, total_len FROM o_df, o_stats")
def _(t):
    docs = jobs.read_table_stream(t.spark, t.dir, "documents").select("doc_id", "text")
    df, stats = jobs.index_stream(docs, jobs.scratch(t.spark, "index"))
    return df.join(F.broadcast(stats)).select("term", "df", "n_docs", "total_len")


@query("stream_near_dup", f"""{LEADER_FOLD},
m AS (SELECT leader_id, count(*) AS mentions FROM leaders GROUP BY leader_id)
SELECT leader_id, mentions, CASE WHEN mentions >= 10 THEN 4 WHEN mentions >= 5 THEN 3 WHEN mentions >= 3 THEN 2 ELSE 1 END AS level FROM m""")
def _(t):
    """The documents in three parts, by id."""
    out = jobs.scratch(t.spark, "near-dup")
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    return jobs.in_parts(docs, out, "id", 3, lambda stream: jobs.near_dup(stream, out))


@query("stream_ttl_cache", """
WITH a AS (SELECT 'npm:' || lib || '@1.' || p_size || '.0' AS key, lib, p_type, ts, row_number() OVER (PARTITION BY lib ORDER BY ts) AS n FROM o_edits JOIN events USING (event_id) JOIN part ON pk = p_partkey),
l AS (SELECT key, any_value(lib) AS lib, any_value(p_type) AS ty, list([epoch_us(ts)] ORDER BY n) AS ticks FROM a GROUP BY key),
m AS (SELECT key, lib, ty, list_transform(ticks, lambda x: x[1]) AS ticks, list_reduce(ticks, lambda acc, x: CASE WHEN x[1] - acc[-1] < 86400000000 THEN acc ELSE list_concat(acc, x) END) AS loads FROM l),
s AS (SELECT key, lib, ty, unnest(ticks) AS us, unnest(range(1, len(ticks) + 1)) AS n, ticks, loads FROM m),
w AS (SELECT key, us, CASE WHEN ty <> 'PROMO' THEN publish_date END AS publish_date, list_contains(loads, us) AND (n = 1 OR ticks[n - 1] <> us) AS miss FROM s LEFT JOIN v_releases r ON r.name = lib)
SELECT key, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN miss THEN 'miss' WHEN publish_date IS NULL THEN 'no-gap' ELSE 'hit' END AS state, publish_date FROM w""")
def _(t):
    """Requests in three parts by time; a part of the releases has no date."""
    sizes = t.part.selectExpr("concat('lib', p_partkey + 1000) AS lib", "p_size")
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    asked = (t.events.join(F.broadcast(n)).selectExpr("ts", f"{LIB.format('event_id % n')} AS lib")
             .join(sizes, "lib").selectExpr("concat('npm:', lib, '@1.', p_size, '.0') AS key", "cast(ts AS timestamp) AS ts"))
    dated = t.part.where("p_type <> 'PROMO'").selectExpr("concat('lib', p_partkey + 1000) AS name")
    rel = t.v_releases.join(dated, "name").selectExpr("concat(ecosystem, ':', name, '@', version) AS key", "publish_date")
    out = jobs.scratch(t.spark, "ttl")
    got = jobs.in_parts(asked, out, "ts", 3, lambda stream: jobs.ttl_cache(stream, rel, out))
    return got.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "state", "publish_date")
