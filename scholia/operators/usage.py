"""Usage, health and session analytics. Ages are measured against a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.scale import number_rows

SLOT_LIMIT = 32
STALE_LIMIT = 5


def usage_summary(usage: DataFrame, installed: DataFrame, as_of: str) -> DataFrame:
    """(name, uses, last_used, days_since, recent, suggestion, pos) per installed name."""
    now = F.lit(as_of).cast("timestamp")
    counted = usage.groupBy("name").agg(F.count(F.lit(1)).alias("uses"), F.max(F.col("ts").cast("timestamp")).alias("last"),
                                        F.count_if(F.col("ts") >= now - F.expr("interval 60 days")).alias("recent"))
    age = (now.cast("double") - F.col("installed_at").cast("double")) / 86400
    since = F.floor((now.cast("double") - F.col("last").cast("double")) / 86400)
    rows = installed.join(counted, "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0))).withColumn("recent", F.coalesce("recent", F.lit(0)))
    old = F.coalesce(age > 14, F.lit(False))
    suggestion = (F.when((F.col("uses") == 0) & F.coalesce(age > 30, F.lit(False)), "remove")
                  .when(((F.col("uses") > 0) | old) & (F.col("recent") < 2), "low-activity"))
    return rows.select("name", "uses", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_used"), since.cast("bigint").alias("days_since"),
                       "recent", suggestion.alias("suggestion"))


def healthy_first(summary: DataFrame) -> DataFrame:
    """Report order: healthy rows first, then by uses."""
    return summary.orderBy(F.col("suggestion").isNotNull(), F.desc("uses"), "name")


def health_findings(installed: DataFrame, usage: DataFrame, catalog: DataFrame, configs: DataFrame, tools: DataFrame) -> DataFrame:
    """(check, subject, severity, fixable, n): the union of five checks.

    ``configs(file, lines, marked)`` are the configuration files found, ``tools(tool,
    file)`` the tools in use with the file each one needs.
    """
    def finding(df: DataFrame, check: str, subject: Column, severity: str, fixable: int, n: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), subject.alias("subject"), F.lit(severity).alias("severity"),
                         F.lit(fixable).alias("fixable"), n.cast("bigint").alias("n"))
    slots = installed.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLOT_LIMIT)
    used = usage.select(F.lower("name").alias("lname")).distinct()
    stale = (installed.withColumn("lname", F.lower("name")).join(used, "lname", "left_anti")
             .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STALE_LIMIT))
    orphans = installed.join(catalog.select("name").distinct(), "name", "left_anti")
    big = configs.where("lines > 500 and marked = 1")
    missing = tools.join(configs.select("file"), "file", "left_anti")
    all_of = F.lit("installed")
    return (finding(slots, "slot-overload", all_of, "warning", 0, F.col("n"))
            .unionByName(finding(stale, "stale", all_of, "info", 1, F.col("n")))
            .unionByName(finding(orphans, "orphaned", F.col("name"), "info", 0, F.lit(1)))
            .unionByName(finding(big, "oversized-config", F.col("file"), "warning", 1, F.col("lines")))
            .unionByName(finding(missing, "missing-config", F.col("tool"), "warning", 1, F.lit(1))))


# ---- sessions --------------------------------------------------------------

def session_field(content: Column, tag: str) -> Column:
    return F.regexp_replace(F.regexp_extract(content, rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"^\s+|\s+$", "")


def session_fields(files: DataFrame) -> DataFrame:
    c = F.col("content")
    return files.select("session_id", *[session_field(c, t).alias(t) for t in ("timestamp", "branch", "goal", "progress", "pending_tasks")],
                        F.regexp_extract_all(c, F.lit("<skill id=\"([^\"]+)\""), 1).alias("skills"))


def session_search(sessions: DataFrame, needle: str) -> DataFrame:
    n = F.lit(needle.lower())
    hit = F.contains(F.lower("goal"), n) | F.contains(F.lower("progress"), n) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), n))
    return sessions.where(hit).select("session_id", F.left("goal", F.lit(50)).alias("goal"), F.array_join("tags", ",").alias("tags"), "ts")


def session_report(sessions: DataFrame, since: str, recent: int = 5) -> DataFrame:
    """(metric, key, value): totals, sessions per branch and the most recent ones."""
    s = sessions.where(F.col("ts") >= F.lit(since))
    lines = F.when(F.length("pending_tasks") > 0, F.size(F.split("pending_tasks", "\n"))).otherwise(0)
    totals = s.agg(F.count(F.lit(1)).alias("a"), F.coalesce(F.sum(lines), F.lit(0)).alias("b"))
    skills = s.select(F.explode("skills").alias("x")).agg(F.countDistinct("x").alias("c"))
    branch = s.groupBy(F.coalesce(F.nullif("branch", F.lit("")), F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("value"))
    last = s.orderBy(F.desc("ts"), "session_id").limit(recent)

    def row(df, metric, key, value):
        return df.select(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("bigint").alias("value"))
    blank = F.lit("")
    return (row(totals, "sessions", blank, F.col("a")).unionByName(row(totals, "tasks", blank, F.col("b")))
            .unionByName(row(skills, "skills", blank, F.col("c"))).unionByName(row(branch, "branch", F.col("key"), F.col("value")))
            .unionByName(row(last, "recent", F.col("session_id"), F.lit(1))))


def session_diff(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """(a, b, goal_changed, progress_changed, added, removed, common) for session pairs."""
    def side(p):
        return sessions.select(F.col("session_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("goal", "progress", "pending_tasks", "skills")])
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    low = F.transform(F.split(F.lower("b_pending_tasks"), "\n"), lambda t: t)
    both = (F.length("a_pending_tasks") > 0) & (F.length("b_pending_tasks") > 0)
    common = F.when(both, F.size(F.filter(F.split("a_pending_tasks", "\n"), lambda t: F.array_contains(low, F.lower(t))))).otherwise(0)
    return j.select("a", "b", (F.col("a_goal") != F.col("b_goal")).cast("int").alias("goal_changed"),
                    (F.col("a_progress") != F.col("b_progress")).cast("int").alias("progress_changed"),
                    F.array_join(F.array_sort(F.array_except("b_skills", "a_skills")), ",").alias("added"),
                    F.array_join(F.array_sort(F.array_except("a_skills", "b_skills")), ",").alias("removed"), common.cast("bigint").alias("common"))


def session_retention(sessions: DataFrame, as_of: str, days: int = 90, archive: bool = True) -> DataFrame:
    """Plan: sessions older than ``days`` with the action to take."""
    old = F.col("ts") < F.date_format(F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"), "yyyy-MM-dd HH:mm:ss")
    return sessions.where(old).select("session_id", "ts", F.lit("archive" if archive else "delete").alias("action"))


def apply_retention(sessions: DataFrame, plan: DataFrame, keep_path: str, archive_path: str) -> None:
    """Write the archived sessions below a folder of this plan, then the rest.

    A run that is repeated replaces its own folder, so nothing is archived twice.
    """
    old = plan.where("action = 'archive'").select("session_id")
    run = plan.agg(F.coalesce(F.sum(F.xxhash64("session_id", "action").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("run")).first().run
    sessions.join(old, "session_id", "left_semi").write.mode("overwrite").parquet(f"{archive_path}/run={run}")
    sessions.join(plan.select("session_id"), "session_id", "left_anti").write.mode("overwrite").parquet(keep_path)


def tag_update(tagged: DataFrame, change: Column, action: str) -> DataFrame:
    """Add keeps distinct tags of both, remove takes the given ones away."""
    now = F.array_union("tags", change) if action == "add" else F.array_except("tags", change)
    return tagged.withColumn("tags", now)


def version_history(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Versions newest first, numbered from 1 per key; a hot key is numbered in parts."""
    return number_rows(versions, keys, [F.desc("ts"), F.desc("version_id")], "version")


def session_resolve(wanted: DataFrame, sessions: DataFrame, lineage: DataFrame) -> DataFrame:
    """(session_id, source, found): own session, parent by lineage, or latest on the branch."""
    own = sessions.select(F.col("session_id"), F.col("session_id").alias("own"))
    parent = (lineage.join(sessions.select(F.col("session_id").alias("parent")), "parent", "left_semi")
              .groupBy(F.col("child").alias("session_id")).agg(F.min("parent").alias("parent")))
    latest = sessions.groupBy("branch").agg(F.max_by("session_id", F.struct("ts", "session_id")).alias("latest"))
    found = wanted.join(own, "session_id", "left").join(parent, "session_id", "left").join(latest, "branch", "left")
    return found.select("session_id", F.when(F.col("own").isNotNull(), "own").when(F.col("parent").isNotNull(), "parent")
                        .when(F.col("latest").isNotNull(), "branch").otherwise("none").alias("source"),
                        F.coalesce("own", "parent", "latest").alias("found"))


def session_merge(groups: DataFrame, sessions: DataFrame) -> DataFrame:
    """(output_id, members, missing, body) of ``groups(output_id, pos, session_id)``.

    A missing member is reported; the caller treats it as an error.
    """
    j = groups.join(sessions.select("session_id", "goal", "progress", "branch", F.lit(1).alias("there")), "session_id", "left")
    unknown = F.lit("Unknown")
    agent = F.concat(F.lit("<agent id=\""), F.col("session_id").cast("string"), F.lit("\"><goal>"), F.coalesce(F.nullif("goal", F.lit("")), unknown),
                     F.lit("</goal><progress>"), F.coalesce(F.nullif("progress", F.lit("")), unknown), F.lit("</progress><branch>"), F.coalesce("branch", unknown), F.lit("</branch></agent>"))
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col("session_id").cast("string").alias("s"), agent.alias("t"))))
    return (j.withColumn("gone", F.col("there").isNull().cast("int")).groupBy("output_id").agg(listed.alias("l"), F.sum("gone").alias("missing"))
            .select("output_id", F.array_join(F.transform("l", lambda x: x["s"]), ", ").alias("members"), "missing",
                    F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("body")))


def validation_score(sessions: DataFrame) -> DataFrame:
    """25 points each for goal, progress, tasks and skills, with errors and warnings."""
    has_tasks, has_skills = F.length("pending_tasks") > 0, F.size("skills") > 0
    score = (F.when(F.length("goal") > 10, 25).otherwise(0) + F.when(F.length("progress") > 20, 25).otherwise(0)
             + F.when(has_tasks, 25).otherwise(0) + F.when(has_skills, 25).otherwise(0))
    warnings = F.array_compact(F.array(F.when(F.length("progress") < 10, "progress"), F.when(~has_tasks, "tasks"), F.when(~has_skills, "skills")))
    return sessions.select("session_id", score.cast("bigint").alias("score"), (F.length("goal") >= 10).cast("int").alias("valid"), F.array_join(warnings, ",").alias("warnings"))


# ---- corrections -----------------------------------------------------------

def level_of(mentions: Column) -> Column:
    return F.when(mentions >= 10, 4).when(mentions >= 5, 3).when(mentions >= 3, 2).otherwise(1)


def mention_levels(corrections: DataFrame) -> DataFrame:
    return corrections.withColumn("level", level_of(F.col("mentions")))


def active_corrections(leveled: DataFrame, top: int = 20, least: int = 3) -> DataFrame:
    """Rows at level 3 or more, most mentioned first, text cut to 120 characters."""
    return (leveled.where(F.col("level") >= least).orderBy(F.desc("mentions"), "id").limit(top)
            .select("id", "mentions", "level", F.left("text", F.lit(120)).alias("text")))


def chunk_report(parsed: DataFrame) -> DataFrame:
    """(source, files, skipped, chunks) of ``parsed(source, chunks)``; null chunks = skipped."""
    return parsed.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("chunks").isNull()).alias("skipped"),
                                        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
