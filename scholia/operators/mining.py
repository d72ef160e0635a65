"""Imports, dependencies and the files they affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.scale import salted_join

# File extension -> language.
LANGUAGES = {
    ".js": "js", ".mjs": "js", ".cjs": "js", ".ts": "js", ".tsx": "js", ".jsx": "js",
    ".py": "python", ".pyw": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".rb": "ruby", ".php": "php", ".cs": "csharp",
    ".swift": "swift", ".dart": "dart",
}

# Import statements per language, package name in group 1.
_JVM = [r"(?m)^import\s+(?:static\s+)?([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)"]
IMPORT_PATTERNS = {
    "js": [r"(?s)import\s+(?:type\s+)?.*?\sfrom\s+['\"]([^'\"./][^'\"]*)['\"]",
           r"require\s*\(\s*['\"]([^'\"./][^'\"]*)['\"]\s*\)",
           r"import\s*\(\s*['\"]([^'\"./][^'\"]*)['\"]\s*\)"],
    "python": [r"(?m)^import\s+([a-zA-Z_]\w*)", r"(?m)^from\s+([a-zA-Z_]\w*)"],
    "go": [r"import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", r"\t\"([^\"]+)\""],
    "rust": [r"(?m)^use\s+([a-zA-Z_]\w*)::", r"(?m)^extern\s+crate\s+([a-zA-Z_]\w*)"],
    "java": _JVM,
    "kotlin": _JVM,
    "ruby": [r"require\s+['\"]([^'\"./][^'\"]*)['\"]"],
    "php": [r"(?m)^use\s+([A-Z]\w*\\[A-Z]\w*)"],
    "csharp": [r"(?m)^using\s+(?:static\s+)?([A-Z]\w*(?:\.\w+)*)"],
    "swift": [r"(?m)^import\s+(?:struct\s+|class\s+|enum\s+|protocol\s+|func\s+|var\s+|let\s+|typealias\s+)?(\w+)"],
    "dart": [r"import\s+['\"]package:([^/'\"]+)"],
}

# Packages that only hold icons.
ICON_LIBRARIES = (
    "lucide-react", "lucide-vue", "lucide-svelte", "lucide", "@heroicons/react", "@heroicons/vue", "react-icons",
    "@phosphor-icons/react", "@phosphor-icons/vue", "@tabler/icons-react", "@tabler/icons-vue", "@radix-ui/react-icons",
    "ionicons", "@mdi/js", "@mdi/react", "feather-icons", "react-feather",
)
CUTOFF = "2025-05-01"

# Where documentation lives, and manual addresses per ecosystem.
DOC_DIRS = ("docs", "decisions", "specs", "adrs", "architecture")
DOC_FILES = ("ARCHITECTURE.md", "CONVENTIONS.md", "DECISIONS.md", "ADR.md")
MANUAL_URLS = {
    "npm": "https://www.npmjs.com/package/%s", "pypi": "https://pypi.org/project/%s/", "crates": "https://docs.rs/%s",
    "go": "https://pkg.go.dev/%s", "rubygems": "https://rubygems.org/gems/%s", "maven": "https://search.maven.org/artifact/%s",
}


def _switch(on: Column, cases: dict[str, Column], default: Column | None = None) -> Column:
    out = None
    for value, result in cases.items():
        out = F.when(on == value, result) if out is None else out.when(on == value, result)
    return out if default is None else out.otherwise(default)


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return _switch(ext, {k: F.lit(v) for k, v in LANGUAGES.items()})


def package_name(raw: Column, language: Column) -> Column:
    """Top-level package of an imported module."""
    js_parts = F.split(raw, "/")
    js = F.when(F.startswith(raw, F.lit("@")) & (F.size(js_parts) >= 2), F.array_join(F.slice(js_parts, 1, 2), "/")).when(
        F.startswith(raw, F.lit("@")), raw).otherwise(js_parts[0])
    go = F.array_join(F.slice(F.split(raw, "/"), 1, 3), "/")
    jvm = F.array_join(F.slice(F.split(raw, r"\."), 1, 3), ".")
    php = F.lower(F.array_join(F.slice(F.split(raw, r"\\"), 1, 2), "/"))
    return _switch(language, {"js": js, "go": go, "java": jvm, "kotlin": jvm, "php": php}, raw)


def import_list(code: Column, language: Column) -> Column:
    """Distinct packages of one source text, in order of the patterns."""
    found = _switch(language, {
        lang: F.concat(*[F.regexp_extract_all(code, F.lit(p), 1) for p in patterns])
        for lang, patterns in IMPORT_PATTERNS.items()}, F.array().cast("array<string>"))
    return F.array_distinct(F.transform(found, lambda m: package_name(m, language)))


def imports(files: DataFrame, keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(keep..., language, module), distinct per file: no shuffle."""
    lang = language_of(F.col("path"))
    return (files.select(*keep, "content", lang.alias("language"))
            .select(*keep, "language", F.explode(import_list(F.col("content"), F.col("language"))).alias("module")))


def identifiers(files: DataFrame) -> DataFrame:
    """(file_id, pos, identifier): imported packages, then dotted calls; distinct."""
    calls = F.regexp_extract_all("content", F.lit(r"((?:(?<![A-Za-z0-9_])[a-zA-Z_]|(?<=[A-Za-z0-9_])\$)\w*(?:\.[a-zA-Z_$]\w*)+)\s*\("), 1)
    lang = language_of(F.col("path"))
    return (files.select("file_id", "content", lang.alias("language"))
            .select("file_id", F.posexplode(F.array_distinct(F.concat(import_list(F.col("content"), F.col("language")), calls))).alias("pos", "identifier")))


def normalised(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_/]+", "-")


# ---- API names -------------------------------------------------------------

def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def _names(lists: Column, alias_last: bool = False) -> Column:
    """Names of comma lists, ``x as y`` resolved."""
    each = F.flatten(F.transform(lists, lambda s: F.split(s, ",")))
    parts = F.transform(each, lambda n: F.split(F.regexp_replace(n, r"^\s+|\s+$", ""), r"\s+as\s+"))
    picked = F.transform(parts, lambda p: F.regexp_replace(F.element_at(p, -1 if alias_last else 1), r"^\s+|\s+$", ""))
    return F.filter(picked, lambda n: F.length(n) > 0)


def api_names(code: Column, module: Column, language: Column) -> Column:
    """Names a file takes from a module; the module itself when there are none."""
    m = _escape(module)

    def every(*pattern) -> Column:
        return F.regexp_extract_all(code, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pattern]), 1)
    js = F.concat(_names(every(r"(?s)import\s*\{([^}]+)\}\s*from\s*['\"]", m, r"(?:/[^'\"]*)?['\"]")),
                  every(r"import\s+(\w+)\s+from\s*['\"]", m, r"['\"]"),
                  _names(every(r"\{([^}]+)\}\s*=\s*require\s*\(\s*['\"]", m, r"['\"]")))
    python = _names(every(r"from\s+", m, r"(?:\.\S+)?\s+import\s+([^\n]+)"))
    go = every(_escape(F.element_at(F.split(module, "/"), -1)), r"\.(\w+)")
    rust = F.concat(F.filter(F.transform(F.flatten(F.transform(every(r"(?s)use\s+", m, r"(?:::\w+)*::\{([^}]+)\}"), lambda s: F.split(s, ","))), lambda s: F.trim(s)),
                             lambda n: F.length(n) > 0),
                    every(r"use\s+", m, r"(?:::\w+)*::(\w+)\s*;"))
    jvm = F.transform(every(r"(?m)import\s+(?:static\s+)?", m, r"\.([\w.]+)"), lambda s: F.element_at(F.split(s, r"\."), -1))
    php_single = F.transform(F.regexp_extract_all(code, F.lit(r"(use\s+[\w\\]+\\\w+(?:\s+as\s+\w+)?\s*;)"), 1),
                             lambda s: F.coalesce(F.nullif(F.regexp_extract(s, r"\s+as\s+(\w+)\s*;", 1), F.lit("")),
                                                  F.regexp_extract(s, r"\\(\w+)(?:\s+as\s+\w+)?\s*;", 1)))
    php = F.concat(php_single, _names(F.regexp_extract_all(code, F.lit(r"use\s+[\w\\]+\\\{([^}]+)\}"), 1), alias_last=True))
    found = F.array_distinct(_switch(language, {"js": js, "python": python, "go": go, "rust": rust, "java": jvm, "kotlin": jvm, "php": php},
                                     F.array().cast("array<string>")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(module))


# ---- gaps ------------------------------------------------------------------

def import_classify(imported: DataFrame, coverage: DataFrame | None, deps: DataFrame, key: str = "file_id") -> DataFrame:
    """known: covered by the index; unknown: declared but not covered; else skipped.
    Without an index everything is skipped. ``node:`` names are removed."""
    named = imported.where(~F.startswith("module", F.lit("node:")))
    if coverage is None:
        return named.select(key, "module", F.lit("skipped").alias("status"))
    declared = deps.select(F.col("name").alias("module")).distinct().withColumn("declared", F.lit(1))
    known = coverage.where("covered = 1").select(F.col("name").alias("module")).distinct().withColumn("known", F.lit(1))
    return (named.join(known, "module", "left").join(declared, "module", "left")
            .select(key, "module", F.when(F.col("known") == 1, "known").when(F.col("declared") == 1, "unknown").otherwise("skipped").alias("status")))


def post_cutoff(deps: DataFrame, releases: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Dependencies whose exact version was published after the cutoff."""
    return (deps.join(releases, ["ecosystem", "name", "version"])
            .where(F.col("publish_date") > F.lit(cutoff)))


def gap_summary(deps: DataFrame, releases: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """One row: dependencies, checked ones, post-cutoff ones, ecosystems."""
    dated = deps.join(releases, ["ecosystem", "name", "version"], "left")
    return dated.agg(F.count(F.lit(1)).alias("total_deps"), F.count("publish_date").alias("dated_deps"),
                     F.count_if(F.col("publish_date") > F.lit(cutoff)).alias("post_cutoff"),
                     F.array_join(F.array_sort(F.collect_set("ecosystem")), ",").alias("ecosystems"))


def affected_files(files: DataFrame, gaps: DataFrame, self_names: DataFrame | None = None) -> DataFrame:
    """(file_id, path, dep, apis): files that import a dependency released late.

    A dependency is found under its normalised name, a Maven one also under its
    artifact and group; Java and Kotlin imports also try their last segment, PHP
    imports the dependency names that hold their first segment. The first key that
    hits wins. A package imported by a third of all files is salted by file.
    """
    g = gaps.select(F.col("name").alias("dep"), normalised(F.col("name")).alias("norm"))
    if self_names is not None:
        g = g.join(self_names.select(normalised(F.col("name")).alias("norm")), "norm", "left_anti")
    has = F.contains("dep", F.lit(":"))
    keys = g.select("dep", F.explode(F.array_distinct(F.when(has, F.array(
        F.col("norm"), normalised(F.element_at(F.split("dep", ":"), 2)), normalised(F.element_at(F.split("dep", ":"), 1)))).otherwise(F.array("norm")))).alias("key"))
    keys = keys.where("key <> ''").groupBy("key").agg(F.max("dep").alias("dep"))
    imp = imports(files)
    norm = normalised(F.col("module"))
    jvm = F.col("language").isin("java", "kotlin") & F.contains("module", F.lit("."))
    tries = imp.select("file_id", "language", "module", F.posexplode(
        F.when(jvm, F.array(norm, normalised(F.element_at(F.split("module", r"\."), -1)))).otherwise(F.array(norm))).alias("prio", "key"))
    matched = salted_join(tries, keys, "key", "file_id").select("file_id", "language", "module", "prio", "dep")
    php = imp.where("language = 'php'").withColumn("seg", F.split(norm, "-")[0])
    from scholia.functions.text import contained_in
    within = contained_in(php, keys, "seg", "key").join(keys, "key").groupBy("seg").agg(F.min_by("dep", "key").alias("dep"))
    matched = matched.unionByName(php.join(within, "seg").select("file_id", "language", "module", F.lit(9).alias("prio"), "dep"))
    best = matched.groupBy("file_id", "language", "module").agg(F.min_by("dep", "prio").alias("dep"))
    with_code = best.join(files.select("file_id", "path", "content"), "file_id")
    taken = with_code.select("file_id", "path", "dep", F.explode(api_names(F.col("content"), F.col("module"), F.col("language"))).alias("api"))
    return taken.groupBy("file_id", "path", "dep").agg(F.array_sort(F.collect_set("api")).alias("apis"))


def api_totals(affected: DataFrame) -> DataFrame:
    """Per dependency: files, APIs, and whether it is an icon library."""
    icons = [n.lower().replace("/", "-").replace("_", "-") for n in ICON_LIBRARIES]
    icon = normalised(F.col("dep")).isin(*icons)
    return (affected.select("dep", icon.cast("int").alias("icon"), F.size("apis").cast("bigint").alias("n"))
            .groupBy("dep", "icon").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("apis")))


def uncaptured_docs(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(project, path, type, files): known documentation folders and files that are
    not registered as a source. ``files(project, path)``; only direct children count."""
    parts = F.split("path", "/")
    found = files.select("project", parts[0].alias("top"), F.size(parts).alias("depth"), "path")
    dirs = (found.where((F.col("depth") == 2) & F.col("top").isin(*DOC_DIRS) & F.lower("path").rlike(r"\.(md|mdx|txt)$"))
            .groupBy("project", F.col("top").alias("path")).agg(F.count(F.lit(1)).alias("files")).withColumn("type", F.lit("directory")))
    single = (found.where((F.col("depth") == 1) & F.col("top").isin(*DOC_FILES))
              .groupBy("project", F.col("top").alias("path")).agg(F.lit(1).cast("bigint").alias("files")).withColumn("type", F.lit("file")))
    return (dirs.unionByName(single).join(sources.select("project", F.col("name").alias("path")), ["project", "path"], "left_anti"))


def resolution_plan(deps: DataFrame, indexed_docs: DataFrame, repos: DataFrame) -> DataFrame:
    """First way to document a dependency: docs index, release notes (npm with a known
    repository), else a manual address."""
    docs = indexed_docs.select("name").distinct().withColumn("docs", F.lit(1))
    repo = repos.groupBy("name").agg(F.min("repo").alias("repo"))
    manual = _switch(F.col("ecosystem"), {
        k: F.concat(F.lit(v.split("%s")[0]), F.replace(F.col("name"), F.lit(":"), F.lit("/")) if k == "maven" else F.col("name"), F.lit(v.split("%s")[1]))
        for k, v in MANUAL_URLS.items()}, F.lit("<docs-url>"))
    notes = (F.col("ecosystem") == "npm") & F.col("repo").isNotNull()
    return (deps.join(docs, "name", "left").join(repo, "name", "left")
            .select("ecosystem", "name", "version",
                    F.when(F.col("docs") == 1, "docs").when(notes, "releases").otherwise("manual").alias("source"),
                    ((F.col("docs") == 1) | notes).eqNullSafe(True).cast("int").alias("resolved"),
                    F.when(F.col("docs") == 1, F.lit(None)).when(notes, F.col("repo")).otherwise(manual).alias("target")))


# ---- project profile -------------------------------------------------------

# Signals for languages and frameworks.
FILE_SIGNALS = {"go.mod": "go", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "kotlin",
                "pyproject.toml": "python", "requirements.txt": "python", "composer.json": "php"}
EXT_SIGNALS = {".kt": "kotlin", ".kts": "kotlin", ".java": "java", ".py": "python", ".ts": "typescript", ".tsx": "typescript",
               ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".rs": "rust", ".go": "go", ".rb": "ruby",
               ".swift": "swift", ".dart": "dart", ".cs": "csharp", ".php": "php"}
_WEB = {"express": "Express", "next": "Next.js", "react": "React", "vue": "Vue", "@nestjs": "NestJS", "@sveltejs/kit": "SvelteKit", "svelte": "Svelte"}
FRAMEWORK_SIGNALS = {
    "python": {"fastapi": "FastAPI", "django": "Django", "flask": "Flask", "pytest": "testing"},
    "javascript": _WEB, "typescript": _WEB,
    "java": {"springframework": "Spring Boot", "micronaut": "Micronaut"},
    "kotlin": {"springframework": "Spring Boot", "ktor": "Ktor"},
    "php": {"laravel/framework": "Laravel", "symfony/": "Symfony", "cakephp/cakephp": "CakePHP"},
}
TEXT_MANIFESTS = ("requirements.txt", "pyproject.toml", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json")


def project_profile(files: DataFrame, signals: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(project, languages, frameworks) from ``files(project, path, content)``: names,
    extensions and manifests at the root or one folder down."""
    table = signals or FRAMEWORK_SIGNALS
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    near = files.where(F.size(F.split("path", "/")) <= 2).select("project", base.alias("base"), "content")
    by_name = _switch(F.col("base"), {k: F.lit(v) for k, v in FILE_SIGNALS.items()})
    by_ext = _switch(F.lower(F.regexp_extract("base", r"(\.[^.]+)$", 1)), {k: F.lit(v) for k, v in EXT_SIGNALS.items()})
    npm_keys = F.concat(F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>")), F.array().cast("array<string>")),
                        F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", "$.devDependencies"), "map<string,string>")), F.array().cast("array<string>")))
    is_pkg = F.col("base") == "package.json"
    ts = F.when(is_pkg & F.array_contains(npm_keys, "typescript"), F.lit("typescript"))
    langs = near.select("project", F.explode(F.array_distinct(F.array_compact(F.array(by_name, by_ext, ts)))).alias("language")).distinct()

    def web_hit(sig: str) -> Column:
        return is_pkg & F.exists(npm_keys, lambda k: (k == sig) | F.startswith(k, F.lit(sig + "/")))

    def text_hit(sig: str) -> Column:
        return F.col("base").isin(*TEXT_MANIFESTS) & F.contains(F.lower("content"), F.lit(sig.lower()))
    options = []
    for lang, sigs in table.items():
        for sig, label in sigs.items():
            hit = web_hit(sig) if lang in ("javascript", "typescript") else text_hit(sig)
            options.append(F.when(hit, F.struct(F.lit(lang).alias("language"), F.lit(label).alias("framework"))))
    hits = near.select("project", F.explode(F.array_compact(F.array(*options))).alias("h")).select("project", "h.language", "h.framework").distinct()
    kept = hits.join(langs, ["project", "language"], "left_semi").groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("framework")), ",").alias("frameworks"))
    return (langs.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
            .join(kept, "project", "left").select("project", "languages", F.coalesce("frameworks", F.lit("")).alias("frameworks")))


def related_items(detected: DataFrame, deps: DataFrame, rules: list[tuple[str, str, tuple[str, ...]]], top: int = 3) -> DataFrame:
    """(project, item, pos): suggestions of ``rules(item, suggestion, gate deps)`` in
    rule order, gated ones only when the project has one of the gate dependencies,
    without what is already detected, first ``top``."""
    from pyspark.sql import Window as W
    listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("when_item"), F.lit(s).alias("item"),
                                (F.array(*[F.lit(d) for d in g]) if g else F.array().cast("array<string>")).alias("gate"))
                       for n, (i, s, g) in enumerate(rules)])
    mine = detected.select("project", "item", F.explode(listed).alias("r")).where(F.col("r.when_item") == F.col("item")).select(
        "project", F.col("r.n").alias("n"), F.col("r.item").alias("item"), F.col("r.gate").alias("gate"))
    free = mine.where(F.size("gate") == 0).select("project", "n", "item")
    gated = (mine.where(F.size("gate") > 0).select("project", "n", "item", F.explode("gate").alias("name"))
             .join(deps.select("project", "name").distinct(), ["project", "name"], "left_semi").select("project", "n", "item"))
    fresh = (free.unionByName(gated).groupBy("project", "item").agg(F.min("n").alias("n"))
             .join(detected.select("project", "item"), ["project", "item"], "left_anti"))
    w = W.partitionBy("project").orderBy("n")
    return fresh.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top).select("project", "item", "pos")
