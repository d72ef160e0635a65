"""Rule scans, content classification, prohibitions and the scope map."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions.scale import cut, hot_join, salted_join
from scholia.functions.text import STOPWORDS, contained_in, glob_matches, glob_regex, literal_array
from scholia.operators.mining import identifiers, imports

# An ASCII word boundary; the JVM's own \b follows Unicode letters.
BEFORE_WORD = r"(?<![A-Za-z0-9_])"
AFTER_WORD = r"(?![A-Za-z0-9_])"
EITHER = rf"(?:(?<=[A-Za-z0-9_]){AFTER_WORD}|{BEFORE_WORD}(?=[A-Za-z0-9_]))"


def ascii_boundaries(pattern: str) -> str:
    """Replace each word boundary: cheap one-sided tests where the neighbour in the
    pattern shows which side the word is on."""
    def one(m: re.Match) -> str:
        follower = pattern[m.end():m.end() + 1]
        if follower.isalnum() or follower == "(":
            return BEFORE_WORD
        return AFTER_WORD if follower in ("", "|", ")") else EITHER
    return re.sub(r"\\b", one, pattern)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(ascii_boundaries(pattern)))


# ---- documentation quality -------------------------------------------------

def doc_quality(content: Column) -> Column:
    signals = (count_of(content, r"(?s)```.*?```") + count_of(content, r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\s+\/")
               + count_of(content, r"(?i)\bimport\s+|require\s*\("))
    size = F.length(F.coalesce(content, F.lit("")))
    return (F.when(size < 50, "none").when(size < 200, "low").when(signals >= 3, "high")
            .when(signals >= 1, "medium").otherwise("low"))


# ---- content types ---------------------------------------------------------

# Fixed values: (type, weight, pattern), in tie order.
CONTENT_RULES = [
    ("framework-docs", 2, r"(?s)```.*?```"),
    ("framework-docs", 3, r"(?i)\bimport\s+|require\s*\("),
    ("framework-docs", 2, r"(?i)\b(npm|yarn|pnpm)\s+(install|add|run)"),
    ("framework-docs", 1, r"(?i)\b(config|configuration|setup|getting.started)\b"),
    ("api-reference", 3, r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\s+\/"),
    ("api-reference", 2, r"(?i)\/api\/"),
    ("api-reference", 1, r"(?i)\b(endpoint|request|response|header|status.code)\b"),
    ("api-reference", 1, r"\b(200|201|400|401|403|404|500)\b"),
    ("release-notes", 4, r"(?m)^#{1,3}\s*v?\d+\.\d+"),
    ("release-notes", 3, r"(?i)\b(breaking|deprecated|removed)\b"),
    ("release-notes", 2, r"(?i)\b(added|fixed|changed|updated)\b"),
    ("release-notes", 2, r"(?i)\bchangelog\b"),
    ("spec", 4, r"(?i)\b(requirement|acceptance.criteria|user.story)\b"),
    ("spec", 2, r"(?i)\b(shall|must|should)\b"),
    ("spec", 4, r"(?i)given.*when.*then"),
    ("spec", 1, r"(?i)\b(feature|scenario|priority)\b"),
    ("team-decision", 5, r"(?i)##\s*(Context|Decision|Consequences)"),
    ("team-decision", 4, r"(?i)\bStatus:\s*(Accepted|Proposed|Deprecated)"),
    ("team-decision", 3, r"(?i)\b(ADR|architecture.decision)\b"),
    ("tutorial", 3, r"(?i)\bstep\s+\d+"),
    ("tutorial", 4, r"(?im)^#{1,3}\s*step\s+\d+"),
    ("tutorial", 1, r"(?i)\b(first|next|then|finally|let's)\b"),
    ("sdd-spec", 5, r"\b(GOAL|DELIVERS|NOT.DOING|ASSUMPTIONS)\b"),
    ("sdd-spec", 3, r"(?i)\b(requirement|acceptance.criteria|user.story)\b"),
    ("sdd-spec", 4, r"(?m)^#{1,3}\s*Task\s+\d+"),
    ("sdd-spec", 2, r"- \[ \]"),
    ("sdd-spec", 2, r"(?i)\b(implementation.plan|design.doc|architecture)\b"),
    ("sdd-spec", 2, r"(?i)\b(spec|specification|roadmap|milestone)\b"),
    ("sdd-spec", 3, r"(?i)\b(constitution|steering|constraints)\b"),
    ("sdd-spec", 4, r"\b(STATE|REQUIREMENTS|ROADMAP|PROJECT)\.md\b"),
    ("api-spec", 6, r"(?i)\bopenapi:\s*[\"']?3\."),
    ("api-spec", 6, r"(?i)\bswagger:\s*[\"']?2\."),
    ("api-spec", 6, r"(?i)\basyncapi:\s*[\"']?[23]\."),
    ("api-spec", 4, r"(?m)\bpaths:\s*$"),
    ("api-spec", 3, r"(?m)\bschemas?:\s*$"),
    ("api-spec", 3, r"(?i)\b(operationId|requestBody|responses):"),
    ("api-spec", 6, r"(?m)^type\s+(Query|Mutation|Subscription)\s*\{"),
    ("api-spec", 3, r"(?m)^(input|enum|interface|union)\s+\w+"),
    ("api-spec", 5, r"(?m)^service\s+\w+\s*\{"),
    ("api-spec", 3, r"(?m)^message\s+\w+\s*\{"),
    ("bdd-spec", 6, r"(?m)^Feature:\s+"),
    ("bdd-spec", 5, r"(?m)^\s*Scenario(?:\s+Outline)?:\s+"),
    ("bdd-spec", 3, r"(?m)^\s*Given\s+"),
    ("bdd-spec", 3, r"(?m)^\s*When\s+"),
    ("bdd-spec", 3, r"(?m)^\s*Then\s+"),
    ("bdd-spec", 1, r"(?m)^\s*And\s+"),
    ("bdd-spec", 4, r"(?m)^\s*Background:"),
    ("bdd-spec", 4, r"(?m)^\s*Examples:"),
    ("architecture", 6, r"(?i)\bworkspace\s*\{"),
    ("architecture", 5, r"(?i)\b(softwareSystem|container|component|person)\s+"),
    ("architecture", 4, r"(?i)\b(deploymentEnvironment|infrastructureNode)\b"),
    ("architecture", 5, r"(?i)\b(System.Context|Container|Component|Dynamic|Deployment)\s+(Diagram|View)"),
    ("architecture", 3, r"(?i)\b(arc42|architecture.overview|building.block)"),
    ("architecture", 3, r"(?i)\b(quality.requirements|runtime.view|deployment.view)\b"),
    ("project-docs", 1, r"(?s)```.*?```"),
    ("project-docs", 1, r"(?i)\bimport\s+|require\s*\("),
    ("project-docs", 4, r"(?i)\b(acceptance.criteria|user.stor(?:y|ies))\b"),
    ("project-docs", 3, r"(?i)##\s*(Context|Decision|Consequences)"),
    ("project-docs", 3, r"(?i)\b(implementation.plan|design.doc|technical.design)\b"),
    ("project-docs", 2, r"(?i)\b(sprint|backlog|epic|milestone)\b"),
    ("project-docs", 2, r"\b(TODO|FIXME|HACK|NOTE):"),
    ("project-docs", 1, r"(?i)\b(refactor|deprecate|migrate|upgrade)\b"),
    ("pkm", 4, r"\[\[([^\]]+)\]\]"),
    ("pkm", 5, r"\(\(([a-f0-9-]+)\)\)"),
    ("pkm", 3, r"(?m)^tags:\s*\["),
    ("pkm", 4, r"(?m)^aliases:\s*\["),
    ("pkm", 5, r"(?m)^cssclass:"),
    ("pkm", 4, r"(?m)^publish:\s*(true|false)"),
    ("pkm", 2, r"(?m)^date:\s*\d{4}-\d{2}-\d{2}"),
    ("pkm", 1, r"#[a-zA-Z][\w/-]+"),
    ("pkm", 3, r"(?m)^\s*- \[\["),
    ("pkm", 4, r"\^[a-f0-9]{6}"),
    ("framework-docs", -5, r"(?i)\b(acceptance.criteria|user.stor(?:y|ies))\b"),
    ("framework-docs", -4, r"(?i)##\s*(Context|Decision|Consequences)"),
    ("framework-docs", -4, r"(?i)\bStatus:\s*(Accepted|Proposed|Deprecated)"),
    ("framework-docs", -3, r"(?i)\b(sprint|backlog|epic|kanban)\b"),
    ("framework-docs", -3, r"(?i)\b(implementation.plan|design.doc|technical.design)\b"),
]
# Folder names that say what they hold.
DIR_SIGNALS = {".obsidian": "pkm", ".logseq": "pkm", ".foam": "pkm", ".specify": "sdd-spec", ".planning": "sdd-spec",
               ".gsd": "sdd-spec", ".kiro": "sdd-spec", "docs": "project-docs", "doc": "project-docs"}
DIR_BONUS = 100
CONTENT_TYPES = list(dict.fromkeys(t for t, _, _ in CONTENT_RULES))


def content_type(files: DataFrame, folder: Column, entries: DataFrame | None = None, min_score: int = 5) -> DataFrame:
    """(folder, type, score, confidence): weighted pattern counts per folder.

    Every rule is evaluated in the row of its file and only numbers are summed per
    folder, so no folder is ever gathered. ``entries(folder, name)`` adds the bonus
    for telling child folders.
    """
    text = F.col("content")
    sums = []
    for kind in CONTENT_TYPES:
        total = F.lit(0)
        for _, weight, pattern in [r for r in CONTENT_RULES if r[0] == kind]:
            total = total + count_of(text, pattern) * weight
        sums.append(F.sum(total).alias(kind))
    per = files.where(F.length(F.trim("content")) > 0).groupBy(folder.alias("folder")).agg(*sums)
    own = F.regexp_extract("folder", r"([^/]*)/*$", 1)
    bonus = {k: F.lit(0) for k in CONTENT_TYPES}
    for name, kind in DIR_SIGNALS.items():
        bonus[kind] = bonus[kind] + F.when(own == name, DIR_BONUS).otherwise(0)
    if entries is not None:
        named = entries.groupBy("folder").agg(F.collect_set(F.when(F.col("name").isin(*DIR_SIGNALS), F.col("name"))).alias("kids"))
        per = per.join(named, "folder", "left")
        for name, kind in DIR_SIGNALS.items():
            bonus[kind] = bonus[kind] + F.when(F.array_contains("kids", name), DIR_BONUS).otherwise(0)
    listed = F.array_sort(F.array(*[F.struct((-F.greatest(F.lit(0), F.col(f"`{k}`") + bonus[k])).alias("neg"), F.lit(i).alias("i"), F.lit(k).alias("kind"))
                                    for i, k in enumerate(CONTENT_TYPES)]))
    ranked = per.select("folder", listed.alias("s")).select(
        "folder", F.col("s")[0]["kind"].alias("best"), (-F.col("s")[0]["neg"]).alias("score"), (-F.col("s")[1]["neg"]).alias("second"))
    low = F.col("score") < min_score
    return ranked.select("folder", F.when(low, "wiki").otherwise(F.col("best")).alias("type"), "score",
                         F.when(low, "low").when(F.col("score") >= F.col("second") * 2, "high").otherwise("medium").alias("confidence"))


# ---- line rules ------------------------------------------------------------

def line_rules(files: DataFrame, id_col: str, rules: list[dict], text_col: str = "content",
               ruleset: Column | None = None, skip_comments: bool = False) -> DataFrame:
    """(id, line, rule_id, severity): one finding per matching line and rule.

    ``rules`` are dicts with ruleset, rule_id, pattern, severity. Every line is
    tested on its own inside the row of its file.
    """
    numbered = F.transform(F.split(F.col(text_col), "\n"), lambda s, i: F.struct((i + 1).alias("line"), s.alias("text")))
    base = files.select(F.col(id_col), (ruleset if ruleset is not None else F.lit(None).cast("string")).alias("_set"), F.explode(numbered).alias("l"))
    if skip_comments:
        base = base.where(~F.ltrim(F.col("l.text")).rlike(r"^(//|\*|#)"))
    tested = []
    for r in rules:
        hit = F.col("l.text").rlike(ascii_boundaries(r["pattern"]))
        if ruleset is not None:
            hit = hit & (F.col("_set") == r["ruleset"])
        tested.append(F.when(hit, F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"))))
    return (base.select(id_col, F.col("l.line").cast("bigint").alias("line"), F.explode(F.array_compact(F.array(*tested))).alias("f"))
            .select(id_col, "line", "f.rule_id", "f.severity"))


def compliance_rollup(files: DataFrame, id_col: str, findings: DataFrame, ruleset: Column, known: list[str]) -> DataFrame:
    """One row per ruleset: matched and audited files, violations, healthy files and
    their share; rulesets without rules have no audited file."""
    count = findings.groupBy(id_col).agg(F.count(F.lit(1)).alias("v"))
    rows = files.select(id_col, ruleset.alias("ruleset")).where("ruleset is not null").join(count, id_col, "left")
    has = F.col("ruleset").isin(*known)
    return (rows.groupBy("ruleset").agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(has).alias("audited"),
        F.sum(F.when(has, F.coalesce("v", F.lit(0))).otherwise(0)).alias("violations"),
        F.count_if(has & F.col("v").isNull()).alias("healthy"))
        .withColumn("share", F.round(F.when(F.col("audited") > 0, F.col("healthy") * 100.0 / F.col("audited")).otherwise(0.0), 1)))


def worst_files(findings: DataFrame, id_col: str, top: int = 5) -> DataFrame:
    return findings.groupBy(id_col).agg(F.count(F.lit(1)).alias("violations")).orderBy(F.desc("violations"), id_col).limit(top)


# ---- prohibitions ----------------------------------------------------------

# Sentence forms that prohibit something, the target in group 1.
PROHIBITIONS = [
    ("do-not-use", r"(?i)(?:do\s+not|don't|never|avoid)\s+(?:use|using)\s+['\"`]?([^'\"`.,;\n]+)"),
    ("deprecated", r"(?i)deprecated:?\s+['\"`]?([^'\"`.,;\n]+)"),
    ("is-deprecated", r"(?i)(['\"`]?[A-Z][\w.]*['\"`]?)\s+is\s+deprecated"),
    ("prefer-over", r"(?i)prefer\s+\S+\s+over\s+['\"`]?([^'\"`.,;\n]+)"),
    ("replaced-with", r"(?i)replaced?\s+['\"`]?([^'\"`.,;\n]+?)['\"`]?\s+with\s"),
    ("decided-against", r"(?i)decided\s+against\s+['\"`]?([^'\"`.,;\n]+)"),
    ("instead-of", r"(?i)(?:decided|agreed|chose|chosen|use)\s+\S+\s+instead\s+of\s+['\"`]?([^'\"`.,;\n]+)"),
    ("must-not", r"(?i)(?:must|should)\s+not\s+(?:use|import|call|reference)\s+['\"`]?([^'\"`.,;\n]+)"),
]


def prohibitions(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, family, target) with targets of 2 to 100 characters."""
    def family(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 1),
                           lambda s: F.struct(F.lit(name).alias("family"), F.trim(s).alias("target")))
    found = [family(name, pattern) for name, pattern in PROHIBITIONS]
    return (texts.select(F.col(id_col), F.explode(F.concat(*found)).alias("p")).select(id_col, "p.family", "p.target")
            .where(F.length("target").between(2, 100)))


def segments(text: Column) -> Column:
    """Lower-case parts of a name of two or more characters."""
    spaced = F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"))
    return F.array_distinct(F.filter(F.split(spaced, r"[\s./:@-]+"), lambda s: F.length(s) >= 2))


def decision_violations(files: DataFrame, decisions: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(file_id, identifier, decision_id): code names that a decision prohibits.

    A name meets a target when they share one part of four or more characters or
    two shorter ones. Parts are joined by equality; the part of a name used in a
    third of all files is salted by file. The first name of a file wins per target.
    ``candidates(identifier, decision_id)`` narrows the pairs to retrieved ones.
    """
    names = identifiers(files)
    left = names.select("file_id", "pos", "identifier", F.explode(segments(F.col("identifier"))).alias("seg"))
    right = (prohibitions(decisions, "decision_id").select("decision_id", "target", F.explode(segments(F.col("target"))).alias("seg")).distinct())
    met = (salted_join(left, right, "seg", "file_id")
           .groupBy("file_id", "pos", "identifier", "decision_id", "target")
           .agg(F.count_if(F.length("seg") >= 4).alias("long"), F.count_if(F.length("seg") < 4).alias("short"))
           .where("long >= 1 or short >= 2"))
    if candidates is not None:
        met = met.join(candidates, ["identifier", "decision_id"], "left_semi")
    first = met.groupBy("file_id", "decision_id", "target").agg(F.min_by("identifier", "pos").alias("identifier"))
    # a decision has a head, so this side is as long as the decisions and is not broadcast
    head = decisions.select("decision_id", F.left("text", F.lit(50)).alias("head")).hint("merge")
    return first.join(head, "decision_id").groupBy("file_id", "identifier", "head").agg(F.min("decision_id").alias("decision_id")).select(
        "file_id", "identifier", "decision_id")


# ---- scope map -------------------------------------------------------------

# Extra stop words, terms that stand for folders, packages known by name.
SCOPE_STOPWORDS = (*STOPWORDS, "all", "use", "that", "this", "each", "every", "any", "some", "such")
TERM_GLOBS = {
    "api": "**/api/**", "admin": "**/admin/**", "auth": "**/auth/**", "middleware": "**/middleware/**", "config": "**/config/**",
    "migration": "**/migrations/**", "test": "**/test*/**", "route": "**/routes/**", "controller": "**/controllers/**",
    "model": "**/models/**", "service": "**/services/**", "component": "**/components/**", "hook": "**/hooks/**",
    "util": "**/utils/**", "helper": "**/helpers/**", "schema": "**/schema*/**", "handler": "**/handlers/**",
    "worker": "**/workers/**", "job": "**/jobs/**", "plugin": "**/plugins/**", "endpoint": "**/api/**",
}
KNOWN_PACKAGES = (
    "stripe", "express", "next", "react", "supabase", "prisma", "drizzle", "zod", "joi", "lodash", "axios", "fastify", "hono", "trpc", "graphql",
    "apollo", "sequelize", "mongoose", "redis", "bullmq", "kafkajs", "socket.io", "passport", "jest", "vitest", "playwright", "cypress",
    "tailwindcss", "webpack", "vite", "esbuild", "turborepo", "pino", "winston", "sentry", "datadog", "knex",
)
# A quoted package name, and phrases that forbid what follows them.
QUOTED = "['\"](@[\\w-]+/[\\w.-]+|[\\w][\\w.-]*)['\"`]"
SCOPE_PROHIBITION = r"(?i)((?:do not use|don't use|never use|avoid|deprecated|prefer\s+\S+\s+over)\s+\S+)"
# What each kind of match is worth, the least sum, matches kept.
STRENGTH_IMPORT, STRENGTH_FUNCTION, STRENGTH_TERM, STRENGTH_FILE = 4, 3, 2, 1
MIN_TEAM, MIN_GAP, MAX_MATCHES = 3, 1, 5
#: Terms up to this length are looked up whole: numbered names share their first characters.
WHOLE = 32


def _texts(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def scope_keywords(text: Column) -> tuple[Column, Column, Column]:
    """(code terms, file globs, import triggers) of a rule text."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9@/._-]+"), lambda w: F.length(w) > 0)
    terms = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*SCOPE_STOPWORDS)))
    table = F.create_map(*[F.lit(x) for kv in TERM_GLOBS.items() for x in kv])
    globs = F.array_distinct(F.array_compact(F.transform(words, lambda w: F.coalesce(
        F.try_element_at(table, w), F.try_element_at(table, F.regexp_replace(w, "s$", ""))))))
    triggers = F.array_distinct(F.concat(F.filter(words, lambda w: w.isin(*KNOWN_PACKAGES)),
                                         F.regexp_extract_all(text, F.lit(QUOTED), 1)))
    return terms, globs, triggers


def scope_from_knowledge(items: DataFrame) -> DataFrame:
    """Scope rows of ``items(id, text, source, type)``."""
    terms, globs, triggers = scope_keywords(F.col("text"))
    code = F.regexp_replace(F.regexp_extract("text", r"(?s)```[\w]*\n(.*?)```", 1), r"^\s+|\s+$", "")
    return items.select("id", "source", "type", terms.alias("code_terms"), globs.alias("file_patterns"), triggers.alias("import_triggers"),
                        F.array().cast("array<string>").alias("function_patterns"), F.lit(None).cast("string").alias("correction"), F.left("text", F.lit(200)).alias("constraint"),
                        F.when(F.length(code) > 0, code).alias("example"))


def scope_from_gaps(gaps: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Scope rows of late dependencies; ``docs(name, content)`` enrich the correction."""
    from scholia.operators.chunking import enrich_correction
    thin = F.concat("name", F.lit("@"), F.coalesce("version", F.lit("latest")), F.lit(" (published "), F.coalesce("publish_date", F.lit("unknown")), F.lit("). Post-training."))
    rows = gaps
    text = thin
    if docs is not None:
        rows = gaps.join(docs.groupBy("name").agg(F.min("content").alias("_doc")), "name", "left")
        text = F.when(F.col("_doc").isNotNull(), enrich_correction(thin, F.col("_doc"))).otherwise(thin)
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    return rows.select(F.concat(F.lit("gap:"), "name").alias("id"), F.lit("gap-detector").alias("source"), F.lit("post-training").alias("type"),
                       empty.alias("code_terms"), F.array(F.lit("**")).alias("file_patterns"), F.array("name").alias("import_triggers"),
                       empty.alias("function_patterns"), text.alias("correction"), none.alias("constraint"), none.alias("example"))


def scope_map(knowledge: DataFrame, gaps: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    return scope_from_knowledge(knowledge).unionByName(scope_from_gaps(gaps, docs))


def function_matches(edits: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (event_id, pattern): edits in whose code a function pattern, a regular
    expression without regard to case, is found. A pattern that is no regular expression
    matches nothing.

    A pattern is looked up under the longest plain word it cannot match without, and only
    edits with a word that contains it are tried; one without such a word is tried on all.
    """
    p = patterns.select("pattern").where("pattern is not null").distinct().withColumn("word", _needed_word(F.col("pattern")))
    runs = edits.select("event_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("code"), F.lit(r"(\w{3,})"), 1))).alias("run"))
    worded = p.where("word <> ''")
    inside = contained_in(worded, runs, "word", "run", WHOLE).join(worded, "word").select("run", "pattern")
    free = p.where("word = ''").agg(F.collect_list("pattern").alias("free"))
    asked = (hot_join(runs, inside, "run", "event_id").select("event_id", "pattern").distinct()
             .unionByName(edits.select("event_id").join(F.broadcast(free)).select("event_id", F.explode("free").alias("pattern"))))

    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, re.Pattern | None] = {}
        for code, pattern in batches:
            for text in set(pattern) - known.keys():
                try:
                    known[text] = re.compile(text, re.IGNORECASE)
                except re.error:
                    known[text] = None
            yield pd.Series([known[p] is not None and known[p].search(c) is not None for c, p in zip(code, pattern, strict=True)], dtype=bool)

    search.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    rows = asked.join(edits.select("event_id", F.coalesce("code", F.lit("")).alias("code")), "event_id")
    return rows.where(F.pandas_udf(search, "boolean")("code", "pattern")).select("event_id", "pattern").distinct()


def _needed_word(pattern: Column) -> Column:
    """The longest run of letters, digits and underscores that every match contains, in
    lower case; empty where alternatives, classes or escapes leave none that is certain."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"\\[A-Za-z0-9]", " "), r"\\.", " "), r"\[[^\]]*\]", " ")
    # the character before a quantifier may be missing
    runs = F.regexp_extract_all(F.regexp_replace(bare, r"\w[*?{]", " "), F.lit(r"(\w{3,})"), 1)
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), F.lower(r).alias("r"))))["r"]
    return F.when(bare.rlike("[|(]") | pattern.rlike(r"\\[xucpPkN0]"), "").otherwise(F.coalesce(longest, F.lit("")))


def scope_match(edits: DataFrame, scope: DataFrame, top: int = MAX_MATCHES) -> DataFrame:
    """(event_id, id, strength, rank) of ``edits(event_id, path, code)``.

    An item is worth what it shares with an edit: import, function pattern, code term, path.
    Candidates come from look-ups by equality, one for each kind: imports with triggers,
    distinct code tokens with terms, words of the code with those of function patterns,
    paths with the reverse index of globs. A path alone is enough only for an item of the
    gap detector with a narrower glob than ``**``; such items of one glob are equal but for
    their id, so only the first ``top`` of them can be among an edit's matches. No edit
    meets an item it shares nothing with.
    """
    # read by every look-up, so it is made once
    scope = cut(scope.select("id", "type", "code_terms", "file_patterns", "import_triggers", "function_patterns"))
    imp = imports(edits.select(F.col("event_id"), "path", F.col("code").alias("content")), keep=("event_id",))
    parts = F.split(F.lower("module"), "/")
    offered = imp.select("event_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("key")).distinct()
    triggers = scope.select("id", F.explode("import_triggers").alias("t")).select("id", F.lower("t").alias("key")).distinct()
    by_import = hot_join(offered, triggers, "key", "event_id").select("event_id", "id")

    tokens = edits.select("event_id", F.explode(F.array_distinct(F.split(F.lower("code"), r"\s+"))).alias("token")).where("token <> ''")
    terms = scope.select("id", F.explode("code_terms").alias("t")).select("id", F.lower("t").alias("term")).distinct()
    pairs = contained_in(terms, tokens, "term", "token", WHOLE).join(terms, "term").select("token", "id").distinct()
    by_term = hot_join(tokens, pairs, "token", "event_id").select("event_id", "id")

    calls = scope.select("id", F.explode("function_patterns").alias("pattern"))
    # read twice by the join, which counts its keys
    by_function = hot_join(cut(function_matches(edits, calls)), calls, "pattern", "event_id").select("event_id", "id")

    only_any = (F.size("file_patterns") == 0) | (F.col("file_patterns") == F.array(F.lit("**")))
    gap = F.col("type") == "post-training"
    w_glob = W.partitionBy("glob").orderBy("id")
    gap_globs = (scope.where(gap & ~only_any).select("id", F.explode("file_patterns").alias("glob")).distinct()
                 .withColumn("n", F.row_number().over(w_glob)).where(F.col("n") <= top).drop("n"))
    placed = edits.select("event_id", "path")
    by_path = (salted_join(placed, glob_matches(placed, gap_globs), "path", "event_id").join(gap_globs, "glob").select("event_id", "id"))

    kinds = (("imp", by_import), ("term", by_term), ("call", by_function), ("file", by_path))
    found = None
    for kind, rows in kinds:
        rows = rows.select("event_id", "id", F.lit(kind).alias("kind"))
        found = rows if found is None else found.unionByName(rows)
    found = found.groupBy("event_id", "id").agg(*[F.max((F.col("kind") == kind).cast("int")).alias(kind) for kind, _ in kinds])
    seen = (found.join(placed, "event_id").join(scope.select("id", "type", "file_patterns"), "id"))
    seen = seen.withColumn("file", F.exists("file_patterns", lambda g: F.rlike(F.col("path"), glob_regex(g))))
    strength = (F.col("imp") * STRENGTH_IMPORT + F.col("call") * STRENGTH_FUNCTION + F.col("term") * STRENGTH_TERM
                + F.when(F.col("file"), STRENGTH_FILE).otherwise(0))
    scored = seen.withColumn("strength", F.when(gap & only_any & (F.col("imp") == 0), 0).otherwise(strength))
    kept = scored.where(F.col("strength") >= F.when(gap, MIN_GAP).otherwise(MIN_TEAM))
    w = W.partitionBy("event_id").orderBy(F.desc("strength"), F.asc("id"))
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("event_id", "id", "strength", "rank")


def scope_contradictions(edits: DataFrame, matched: DataFrame, scope: DataFrame) -> DataFrame:
    """(event_id, id, constraint): prohibited terms of matched items found in the code."""
    rows = (matched.select("event_id", "id").join(scope.select("id", "constraint").where("constraint is not null"), "id")
            .join(edits.select("event_id", F.lower("code").alias("code")), "event_id"))
    hits = F.filter(F.regexp_extract_all("constraint", F.lit(SCOPE_PROHIBITION), 1), lambda s: (
        F.length(F.regexp_replace(F.lower(F.regexp_extract(s, r"(?s)(\S+)$", 1)), "[.,;:!?]", "")) > 0)
        & F.contains(F.col("code"), F.regexp_replace(F.lower(F.regexp_extract(s, r"(?s)(\S+)$", 1)), "[.,;:!?]", "")))
    return (rows.select("event_id", "id", hits.alias("h")).where(F.size("h") > 0)
            .select("event_id", "id", F.array_join("h", "; ").alias("constraint")))


# ---- value frequency and context windows -----------------------------------

# The allowed spacing scale.
SPACING_SCALE = (4, 8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 36, 40, 48, 56, 64, 80, 96, 112, 128)


def value_frequency(values: DataFrame, over: int = 3) -> DataFrame:
    """(file_id, value, n, first_pos, finding) of ``values(file_id, value, pos)``: used
    once, or more than ``over`` times. Counted map-side, no window."""
    counted = values.groupBy("file_id", "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return counted.withColumn("finding", F.when(F.col("n") == 1, "one-off").when(F.col("n") > over, "over-used")).where("finding is not null")


def off_scale(values: DataFrame, scale: tuple[int, ...] = SPACING_SCALE) -> DataFrame:
    """Numeric values that are not on the scale, with the nearest allowed one (the
    smaller on a tie)."""
    v = F.col("value")
    nearest = F.array_min(F.transform(F.array(*[F.lit(s) for s in scale]), lambda s: F.struct(F.abs(s - v).alias("d"), s.alias("s"))))["s"]
    return values.where((v != 0) & ~v.isin(*[float(s) for s in scale])).withColumn("nearest", nearest)


def context_window(files: DataFrame, id_col: str, trigger: str, pauses: list[str], text_col: str = "content") -> DataFrame:
    """(id, line): trigger lines without a pausing token in lines n-9 .. n+10.

    The lines of a file stay in its row, so no window over lines is needed.
    """
    ls = F.split(F.col(text_col), "\n")
    with_lines = files.select(F.col(id_col), ls.alias("ls"))
    calm = lambda s: F.exists(literal_array(pauses), lambda p: F.contains(s, p))
    hits = F.filter(F.transform("ls", lambda s, i: F.when(s.rlike(trigger), i + 1)), lambda n: n.isNotNull())
    kept = F.filter(hits, lambda n: ~F.exists(F.slice(F.col("ls"), F.greatest(n - 9, F.lit(1)), n + 10 - F.greatest(n - 9, F.lit(1)) + 1), calm))
    return with_lines.select(id_col, F.explode(kept).alias("line")).withColumn("line", F.col("line").cast("bigint"))


def durations(files: DataFrame, id_col: str, text_col: str = "content", slow: int = 500, fast: int = 100) -> DataFrame:
    """(id, line, ms, finding) for every ``s`` / ``ms`` token that is too slow or too fast."""
    numbered = F.transform(F.split(F.col(text_col), "\n"), lambda s, i: F.struct((i + 1).alias("line"), s.alias("text")))
    toks = files.select(F.col(id_col), F.explode(numbered).alias("l")).select(
        id_col, F.col("l.line").cast("bigint").alias("line"), F.explode(F.regexp_extract_all("l.text", F.lit(r"(\d+(?:\.\d+)?(?:ms|s))(?![A-Za-z0-9_])"), 1)).alias("tok"))
    ms = F.when(F.endswith("tok", F.lit("ms")), F.regexp_extract("tok", r"^([\d.]+)", 1).cast("double")).otherwise(F.regexp_extract("tok", r"^([\d.]+)", 1).cast("double") * 1000)
    return (toks.select(id_col, "line", ms.alias("ms"))
            .withColumn("finding", F.when(F.col("ms") > slow, "too-slow").when((F.col("ms") < fast) & (F.col("ms") > 0), "too-fast"))
            .where("finding is not null"))


def has_but_lacks(files: DataFrame, id_col: str, has: str, lacks: str, text_col: str = "content") -> DataFrame:
    """Files that match one pattern and never mention the other text."""
    return files.where(F.col(text_col).rlike(has) & ~F.contains(F.col(text_col), F.lit(lacks))).select(id_col)
