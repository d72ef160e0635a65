"""Code, dependency and document mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import manifests, mining, rules
from scholia.plans.registry import query
from scholia.plans.views import CUTOFF_DATE


@query("language_of", "SELECT file_id, CASE ext WHEN 'ts' THEN 'js' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'rb' THEN 'ruby' ELSE ext END AS language FROM v_files")
def _(t):
    return t.v_files.select("file_id", mining.language_of(F.col("path")).alias("language"))


@query("imports", "SELECT DISTINCT file_id, CASE lk WHEN 0 THEN 'js' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' WHEN 4 THEN 'java' ELSE 'ruby' END AS language, module FROM o_modules")
def _(t):
    return mining.imports(t.v_files)


@query("manifest_deps", "SELECT project, ecosystem, name, version FROM v_deps")
def _(t):
    return manifests.project_deps(t.v_manifests)


@query("import_classify", """
WITH c AS (SELECT DISTINCT module AS name FROM o_modules),
cov AS (SELECT 'lib' || (p_partkey + 1000) AS name FROM part WHERE p_type = 'PROMO'),
d AS (SELECT DISTINCT name FROM v_deps)
SELECT m.file_id, m.module, CASE WHEN m.module IN (SELECT name FROM cov) THEN 'known' WHEN m.module IN (SELECT name FROM d) THEN 'unknown' ELSE 'skipped' END AS status FROM (SELECT DISTINCT file_id, module FROM o_modules) m""")
def _(t):
    coverage = t.part.where("p_type = 'PROMO'").selectExpr("concat('lib', p_partkey + 1000) AS name", "1 AS covered")
    return mining.import_classify(mining.imports(t.v_files), coverage, manifests.project_deps(t.v_manifests))


@query("post_cutoff_deps", f"SELECT project, d.ecosystem, d.name, d.version, publish_date FROM v_deps d JOIN v_releases r USING (name, version) WHERE d.ecosystem = 'npm' AND publish_date > '{CUTOFF_DATE}'")
def _(t):
    return mining.post_cutoff(manifests.project_deps(t.v_manifests), t.v_releases, CUTOFF_DATE).select("project", "ecosystem", "name", "version", "publish_date")


@query("gap_summary", f"""
SELECT count(*) AS total_deps, count(publish_date) AS dated_deps, count(*) FILTER (publish_date > '{CUTOFF_DATE}') AS post_cutoff, string_agg(DISTINCT d.ecosystem, ',' ORDER BY d.ecosystem) AS ecosystems
FROM v_deps d LEFT JOIN v_releases r ON r.name = d.name AND r.version = d.version AND d.ecosystem = r.ecosystem""")
def _(t):
    return mining.gap_summary(manifests.project_deps(t.v_manifests), t.v_releases, CUTOFF_DATE)


AFFECTED = f"""
SELECT m.file_id, m.path, m.dep, string_agg(DISTINCT api, ',' ORDER BY api) AS apis FROM (
  SELECT i.file_id, f.path, lib AS dep, unnest(CASE lk WHEN 0 THEN ['Api' || l_linenumber] WHEN 1 THEN ['Api' || l_linenumber] WHEN 3 THEN ['Api' || l_linenumber]
     WHEN 4 THEN [lib] ELSE [lib] END) AS api
  FROM o_imp i JOIN v_files f USING (file_id) JOIN v_releases r ON r.name = lib WHERE publish_date > '{CUTOFF_DATE}' AND lk <> 2 AND lib <> 'lib1007') m GROUP BY ALL"""


def gaps(t):
    return t.v_releases.where(F.col("publish_date") > CUTOFF_DATE)


def affected(t):
    own = t.part.where("p_partkey = 7").selectExpr("concat('LIB', p_partkey + 1000) AS name")
    return mining.affected_files(t.v_files, gaps(t), own)


@query("affected_files", AFFECTED.replace("WHEN 4 THEN [lib]", "WHEN 4 THEN ['Api' || l_linenumber]"))
def _(t):
    return affected(t).withColumn("apis", F.array_join("apis", ","))


@query("api_names", """
SELECT DISTINCT file_id, module, CASE lk WHEN 0 THEN 'Api' || l_linenumber WHEN 1 THEN 'Api' || l_linenumber WHEN 3 THEN 'Api' || l_linenumber WHEN 4 THEN 'Api' || l_linenumber WHEN 2 THEN CASE WHEN first = l_partkey THEN 'make' ELSE module END ELSE module END AS api
FROM (SELECT *, min(l_partkey) OVER (PARTITION BY file_id) AS first, CASE lk WHEN 2 THEN 'example.org/acme/' || lib WHEN 4 THEN 'com.acme.' || lib ELSE lib END AS module FROM o_imp)""")
def _(t):
    imp = mining.imports(t.v_files)
    return (imp.join(t.v_files.select("file_id", "content"), "file_id")
            .select("file_id", "module", F.explode(mining.api_names(F.col("content"), F.col("module"), F.col("language"))).alias("api")))


@query("api_totals", f"""
WITH a AS ({AFFECTED.replace("WHEN 4 THEN [lib]", "WHEN 4 THEN ['Api' || l_linenumber]")})
SELECT dep, 0 AS icon, count(*) AS files, sum(len(string_split(apis, ',')))::BIGINT AS apis FROM a GROUP BY dep""")
def _(t):
    return mining.api_totals(affected(t))


@query("uncaptured_docs", """
WITH f AS (SELECT doc_id % 50 AS project, CASE lang WHEN 'en' THEN 'docs/' || doc_id || '.md' WHEN 'fr' THEN 'specs/' || doc_id || '.txt' WHEN 'de' THEN 'adrs/' || doc_id || '.py' ELSE 'ADR.md' END AS path, lang FROM documents),
s AS (SELECT DISTINCT d.doc_id % 50 AS project, 'docs' AS name FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1)
SELECT project, 'docs' AS path, 'directory' AS type, count(*) AS files FROM f WHERE lang = 'en' AND project NOT IN (SELECT project FROM s) GROUP BY project
UNION ALL SELECT project, 'specs', 'directory', count(*) FROM f WHERE lang = 'fr' GROUP BY project UNION ALL SELECT DISTINCT project, 'ADR.md', 'file', 1 FROM f WHERE lang = 'es'""")
def _(t):
    files = t.documents.selectExpr("doc_id % 50 AS project", "CASE lang WHEN 'en' THEN concat('docs/', doc_id, '.md') WHEN 'fr' THEN concat('specs/', doc_id, '.txt') WHEN 'de' THEN concat('adrs/', doc_id, '.py') ELSE 'ADR.md' END AS path")
    sources = t.labels.where("toxic = 1").join(t.documents.select("doc_id"), "doc_id").selectExpr("doc_id % 50 AS project", "'docs' AS name").distinct()
    return mining.uncaptured_docs(files, sources)


@query("resolution_plan", """
SELECT d.ecosystem, d.name, d.version, CASE WHEN p_type = 'SMALL' THEN 'docs' WHEN d.ecosystem = 'npm' AND p_type = 'LARGE' THEN 'releases' ELSE 'manual' END AS source,
  CASE WHEN p_type = 'SMALL' OR (d.ecosystem = 'npm' AND p_type = 'LARGE') THEN 1 ELSE 0 END AS resolved,
  CASE WHEN p_type = 'SMALL' THEN NULL WHEN d.ecosystem = 'npm' AND p_type = 'LARGE' THEN 'acme/' || d.name WHEN d.ecosystem = 'npm' THEN 'https://www.npmjs.com/package/' || d.name ELSE 'https://pypi.org/project/' || d.name || '/' END AS target
FROM (SELECT DISTINCT ecosystem, name, version FROM v_deps) d JOIN part ON d.name = 'lib' || (p_partkey + 1000)""")
def _(t):
    deps = manifests.project_deps(t.v_manifests).select("ecosystem", "name", "version").distinct()
    lib = t.part.selectExpr("concat('lib', p_partkey + 1000) AS name", "p_type")
    return mining.resolution_plan(deps, lib.where("p_type = 'SMALL'"), lib.where("p_type = 'LARGE'").selectExpr("name", "concat('acme/', name) AS repo"))


def _duck(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


CONTENT_SQL = (
    "WITH f AS (SELECT 'specs/' || source AS folder, v.content FROM v_guides v JOIN documents USING (doc_id)),\n"
    "s AS (SELECT folder, " + ", ".join(
        "sum(" + " + ".join(f"{w} * len(regexp_extract_all(content, {_duck(p)}))" for k, w, p in rules.CONTENT_RULES if k == kind) + f') AS "{kind}"'
        for kind in rules.CONTENT_TYPES) + " FROM f GROUP BY folder),\n"
    "u AS (SELECT folder, unnest([" + ", ".join(f"{{'i': {i}, 'k': '{k}', 's': greatest(0, \"{k}\")}}" for i, k in enumerate(rules.CONTENT_TYPES)) + "]) AS x FROM s),\n"
    "r AS (SELECT folder, x.k AS k, x.s AS s, row_number() OVER (PARTITION BY folder ORDER BY x.s DESC, x.i) AS r FROM u),\n"
    "b AS (SELECT folder, max(k) FILTER (r = 1) AS best, max(s) FILTER (r = 1) AS score, max(s) FILTER (r = 2) AS second FROM r GROUP BY folder)\n"
    "SELECT folder, CASE WHEN score < 5 THEN 'wiki' ELSE best END AS type, score::BIGINT AS score, CASE WHEN score < 5 THEN 'low' WHEN score >= second * 2 THEN 'high' ELSE 'medium' END AS confidence FROM b")


@query("content_type", CONTENT_SQL)
def _(t):
    files = t.v_guides.join(t.documents.select("doc_id", "source"), "doc_id")
    return rules.content_type(files, F.concat(F.lit("specs/"), F.col("source")))


# Rules of our own, in the regex subset both engines share.
RULES = [
    {"ruleset": "en", "rule_id": "passive", "pattern": r"(^|[^a-z])(was|were) [a-z]+ed([^a-z]|$)", "severity": "warn"},
    {"ruleset": "en", "rule_id": "shout", "pattern": r"!!", "severity": "error"},
    {"ruleset": "en", "rule_id": "long-line", "pattern": r"^.{400,}", "severity": "info"},
    {"ruleset": "fr", "rule_id": "que-que", "pattern": r"que[a-z]* que", "severity": "info"},
    {"ruleset": "fr", "rule_id": "digits", "pattern": r"[0-9]{2,}", "severity": "warn"},
    {"ruleset": "de", "rule_id": "und-der", "pattern": r"und (der|die|das)", "severity": "info"},
    {"ruleset": "de", "rule_id": "at-sign", "pattern": r"@", "severity": "error"},
    {"ruleset": "de", "rule_id": "question", "pattern": r"\?", "severity": "warn"},
]
RULES_SQL = "(SELECT unnest([" + ", ".join(
    f"{{'s': '{r['ruleset']}', 'id': '{r['rule_id']}', 'p': {_duck(r['pattern'])}, 'v': '{r['severity']}'}}" for r in RULES) + "]) AS r)"
FOUND = f"""
SELECT doc_id, i::BIGINT AS line, r.id AS rule_id, r.v AS severity FROM (
  SELECT doc_id, lang, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) d, {RULES_SQL}
WHERE lang = r.s AND regexp_matches(l[i], r.p)"""


def findings(t):
    return rules.line_rules(t.documents, "doc_id", RULES, "text", ruleset=F.col("lang"))


@query("line_rules", FOUND)
def _(t):
    return findings(t)


@query("compliance_rollup", f"""
WITH f AS ({FOUND}), c AS (SELECT doc_id, count(*) AS v FROM f GROUP BY doc_id)
SELECT lang AS ruleset, count(*) AS matched, count(*) FILTER (lang <> 'es') AS audited, coalesce(sum(v), 0)::BIGINT AS violations, count(*) FILTER (lang <> 'es' AND v IS NULL) AS healthy,
  CASE WHEN lang = 'es' THEN 0.0 ELSE round(count(*) FILTER (v IS NULL) * 100.0::DOUBLE / count(*), 1) END AS share FROM documents LEFT JOIN c USING (doc_id) GROUP BY lang""")
def _(t):
    return rules.compliance_rollup(t.documents, "doc_id", findings(t), F.col("lang"), ["en", "fr", "de"])


@query("worst_files", f"WITH f AS ({FOUND}) SELECT doc_id, count(*) AS violations FROM f GROUP BY doc_id ORDER BY violations DESC, doc_id LIMIT 5")
def _(t):
    return rules.worst_files(findings(t), "doc_id")


@query("prohibitions", """
SELECT decision_id, CASE decision_id % 4 WHEN 0 THEN 'do-not-use' WHEN 1 THEN 'prefer-over' WHEN 2 THEN 'replaced-with' ELSE 'decided-against' END AS family, x AS target FROM v_decisions""")
def _(t):
    return rules.prohibitions(t.v_decisions, "decision_id")


@query("identifiers", """
SELECT DISTINCT file_id, module AS identifier FROM o_modules
UNION SELECT file_id, 'lib' || (min(l_partkey) + 1000) || '.make.thing' FROM o_imp GROUP BY file_id""")
def _(t):
    return mining.identifiers(t.v_files).select("file_id", "identifier")


@query("decision_violations", """
WITH m AS (SELECT file_id, decision_id, min(module) AS identifier FROM o_modules JOIN v_decisions ON lib = x GROUP BY ALL)
SELECT file_id, identifier, decision_id FROM m""")
def _(t):
    return rules.decision_violations(t.v_files, t.v_decisions)


@query("scope_keywords", """
SELECT decision_id, array_to_string(list_sort(CASE decision_id % 4 WHEN 0 THEN [x || '.'] WHEN 1 THEN ['prefer', y, 'over', x] WHEN 2 THEN ['replaced', x, y] ELSE list_distinct(['decided', 'against', x || '.', 'avoid', x, 'api.']) END), ',') AS terms,
  '' AS globs, '' AS triggers FROM v_decisions""")
def _(t):
    terms, globs, triggers = rules.scope_keywords(F.col("text"))
    return t.v_decisions.select("decision_id", F.array_join(F.array_sort(terms), ",").alias("terms"), F.array_join(F.array_sort(globs), ",").alias("globs"),
                                F.array_join(F.array_sort(triggers), ",").alias("triggers"))


@query("scope_map_build", f"""
SELECT 'd' || decision_id AS id, 'decision' AS type, '' AS globs, '' AS triggers, NULL AS correction, text AS "constraint" FROM v_decisions
UNION ALL SELECT 'gap:' || name, 'post-training', '**', name, name || '@' || version || ' (published ' || publish_date || '). Post-training.', NULL FROM v_releases WHERE publish_date > '{CUTOFF_DATE}'""")
def _(t):
    return t.v_scope.select("id", "type", F.array_join("file_patterns", ",").alias("globs"), F.array_join("import_triggers", ",").alias("triggers"), "correction", "constraint")


SCOPE_NOTE = "Use the api of '"


def scoped(t):
    """The scope map, one rule per promoted part that names the api folder, one rule per
    large part with nothing but a function pattern, and late items bound to a user's file."""
    notes = t.part.where("p_type = 'PROMO'").selectExpr(
        "concat('n', p_partkey) AS id", "concat('The api must wrap lib', p_partkey + 1000, ' and never use lib', p_partkey + 1001, ' today') AS text", "'knowledge-graph' AS source", "'note' AS type")
    none, null = "cast(array() AS array<string>)", "cast(null AS string)"
    pattern = F.concat(F.lit("LIB"), (F.col("p_partkey") + 1000).cast("string"), F.lit(r"\.make\s*[(]"))
    calls = (t.part.where("p_type = 'LARGE'").withColumn("p", F.array(pattern))
             .selectExpr("concat('f', p_partkey) AS id", "'knowledge-graph' AS source", "'note' AS type", f"{none} AS code_terms", f"{none} AS file_patterns", f"{none} AS import_triggers",
                         "p AS function_patterns", f"{null} AS correction", "'wrap it' AS `constraint`", f"{null} AS example"))
    files = t.nation.selectExpr(
        "concat('gap:u', n_nationkey) AS id", "'gap-detector' AS source", "'post-training' AS type", f"{none} AS code_terms",
        "array(concat('**/api/u', n_nationkey, '.*')) AS file_patterns", f"{none} AS import_triggers", f"{none} AS function_patterns", "'late' AS correction", f"{null} AS `constraint`", f"{null} AS example")
    return t.v_scope.unionByName(rules.scope_from_knowledge(notes)).unionByName(calls).unionByName(files)


MATCH = f"""
c AS (SELECT event_id, 'import {{ make }} from ''' || lib || ''';' || chr(10) || 'const a = ' || lib || '.make(1);' AS code, pk, lib FROM o_edits),
h AS (SELECT event_id, 'gap:' || name AS id, 5 AS strength FROM c JOIN v_releases ON lib = name WHERE publish_date > '{CUTOFF_DATE}'
  UNION ALL SELECT event_id, 'n' || p.p_partkey, 3 FROM c JOIN part p ON p.p_type = 'PROMO' AND (contains(code, 'lib' || (p.p_partkey + 1000)) OR contains(code, 'lib' || (p.p_partkey + 1001)))
  UNION ALL SELECT event_id, 'f' || p.p_partkey, 3 FROM c JOIN part p ON p.p_type = 'LARGE' AND contains(code, 'lib' || (p.p_partkey + 1000) || '.make(')
  UNION ALL SELECT event_id, 'gap:u' || n_nationkey, 1 FROM events JOIN nation ON user_id = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY strength DESC, id) AS rank FROM h)"""


@query("scope_match", f"WITH {MATCH} SELECT event_id, id, strength, rank FROM r WHERE rank <= 5")
def _(t):
    return rules.scope_match(t.v_edits, scoped(t))


@query("scope_contradictions", f"""
WITH {MATCH} SELECT event_id, id, 'never use lib' || (substr(id, 2)::BIGINT + 1001) AS "constraint" FROM r JOIN c USING (event_id) WHERE rank <= 5 AND id LIKE 'n%' AND contains(code, 'lib' || (substr(id, 2)::BIGINT + 1001))""")
def _(t):
    s = scoped(t)
    return rules.scope_contradictions(t.v_edits, rules.scope_match(t.v_edits, s), s)


@query("project_profile", """
SELECT c_custkey AS project, CASE WHEN c_custkey % 2 = 0 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'go,typescript' ELSE 'go' END ELSE 'go,python' END AS languages,
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'Express,React' ELSE '' END ELSE CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Django' ELSE '' END END AS frameworks FROM customer""")
def _(t):
    c = t.customer
    npm = "CASE WHEN c_mktsegment = 'BUILDING' THEN '{\"dependencies\": {\"express\": \"1\", \"react/dom\": \"2\", \"vuex\": \"3\"}, \"devDependencies\": {\"typescript\": \"5\"}}' ELSE '{\"dependencies\": {\"express\": \"1\"}}' END"
    pip = "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Django==4' ELSE 'numpy' END"
    even = "c_custkey % 2 = 0"
    files = (c.selectExpr("c_custkey AS project", f"CASE WHEN {even} THEN 'web/package.json' ELSE 'requirements.txt' END AS path", f"CASE WHEN {even} THEN {npm} ELSE {pip} END AS content")
             .unionByName(c.selectExpr("c_custkey AS project", "'cmd/main.go' AS path", "'package main' AS content"))
             .unionByName(c.selectExpr("c_custkey AS project", "'deep/er/lib.rs' AS path", "'' AS content")))
    return mining.project_profile(files)


RELATED = [("ECONOMY", "guide-economy", ()), ("ECONOMY", "guide-safety", ("lib1001", "lib1003")), ("PROMO", "guide-economy", ()), ("PROMO", "STANDARD", ()),
           ("STANDARD", "guide-standard", ()), ("LARGE", "guide-large", ("lib1002",)), ("LARGE", "guide-more", ())]


@query("related_items", """
WITH r AS (SELECT unnest([{'n': 0, 'w': 'ECONOMY', 'i': 'guide-economy', 'g': NULL}, {'n': 1, 'w': 'ECONOMY', 'i': 'guide-safety', 'g': ['lib1001', 'lib1003']}, {'n': 2, 'w': 'PROMO', 'i': 'guide-economy', 'g': NULL},
  {'n': 3, 'w': 'PROMO', 'i': 'STANDARD', 'g': NULL}, {'n': 4, 'w': 'STANDARD', 'i': 'guide-standard', 'g': NULL}, {'n': 5, 'w': 'LARGE', 'i': 'guide-large', 'g': ['lib1002']}, {'n': 6, 'w': 'LARGE', 'i': 'guide-more', 'g': NULL}]) AS r),
b AS (SELECT DISTINCT o_custkey AS project, p_type AS item, 'lib' || (p_partkey + 1000) AS lib FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
d AS (SELECT DISTINCT project, item FROM b),
m AS (SELECT project, r.i AS item, min(r.n) AS n FROM d, r WHERE r.w = d.item AND (r.g IS NULL OR EXISTS (SELECT 1 FROM b WHERE b.project = d.project AND list_contains(r.g, b.lib))) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n) AS pos FROM m WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.project = m.project AND d.item = m.item))
SELECT project, item, pos FROM f WHERE pos <= 3""")
def _(t):
    b = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
         .selectExpr("o_custkey AS project", "p_type AS item", "concat('lib', p_partkey + 1000) AS name").distinct())
    return mining.related_items(b.select("project", "item").distinct(), b.select("project", "name"), RELATED)


@query("value_frequency_rules", """
SELECT l_orderkey AS file_id, l_returnflag AS value, count(*) AS n, min(l_linenumber) AS first_pos, CASE WHEN count(*) = 1 THEN 'one-off' ELSE 'over-used' END AS finding
FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(*) = 1 OR count(*) > 3""")
def _(t):
    return rules.value_frequency(t.lineitem.selectExpr("l_orderkey AS file_id", "l_returnflag AS value", "l_linenumber AS pos"))


SCALE_SQL = "[" + ", ".join(str(s) for s in rules.SPACING_SCALE) + "]"


@query("off_scale_values", f"""
SELECT l_orderkey AS file_id, l_quantity AS value, l_linenumber AS pos, l_partkey, (SELECT s FROM (SELECT unnest({SCALE_SQL}) AS s) ORDER BY abs(s - l_quantity), s LIMIT 1) AS nearest
FROM lineitem WHERE l_quantity <> 0 AND NOT list_contains({SCALE_SQL}, l_quantity::INT)""")
def _(t):
    return rules.off_scale(t.lineitem.selectExpr("l_orderkey AS file_id", "l_quantity AS value", "l_linenumber AS pos", "l_partkey"))


@query("context_window_rules", """
WITH l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)
SELECT doc_id, i::BIGINT AS line FROM x WHERE regexp_matches(ls[i], '(^|[^a-z])the [a-z]+ing([^a-z]|$)')
  AND len(list_filter(ls[greatest(i - 9, 1):i + 10], lambda s: contains(s, 'tion with') OR contains(s, '!!'))) = 0""")
def _(t):
    return rules.context_window(t.documents, "doc_id", r"(^|[^a-z])the [a-z]+ing([^a-z]|$)", ["tion with", "!!"], "text")


@query("durations", """
SELECT l_orderkey, l_linenumber, l_partkey, ms, CASE WHEN ms > 500 THEN 'too-slow' ELSE 'too-fast' END AS finding FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN l_quantity * 20 ELSE l_quantity * 1000 / 20 END AS ms FROM lineitem) WHERE ms > 500 OR (ms < 100 AND ms > 0)""")
def _(t):
    css = t.lineitem.selectExpr("struct(l_orderkey, l_linenumber, l_partkey) AS k", "CASE WHEN l_returnflag = 'A' THEN concat('transition: all ', cast(l_quantity * 20 AS int), 'ms ease') ELSE concat('transition: top ', l_quantity / 20, 's') END AS content")
    return rules.durations(css, "k").select("k.l_orderkey", "k.l_linenumber", "k.l_partkey", F.round("ms", 6).alias("ms"), "finding")


@query("has_but_lacks", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(was|were) [a-z]+') AND NOT contains(text, 'with')")
def _(t):
    return rules.has_but_lacks(t.documents, "doc_id", r"(was|were) [a-z]+", "with", "text")
