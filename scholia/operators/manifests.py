"""Dependency manifests of fourteen formats as one corpus job.

Each format is a column expression from file text to an array of (name, version).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<struct<name:string,version:string>>"
UNRESOLVABLE = r"^(workspace:|git\+|git:|file:|https?:|npm:|link:|\*)"
TO_NEXT_TABLE = r"(?=\n\[[a-zA-Z]|\z)"


def _dep(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _or_latest(version: Column) -> Column:
    return F.when(F.length(version) > 0, version).otherwise(F.lit("latest"))


def _bare(version: Column) -> Column:
    return F.regexp_replace(version, r"^[\^~>=<]*", "")


def _all(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), group)


def _first_per_name(deps: Column) -> Column:
    names = F.transform(deps, lambda d: d["name"])
    return F.filter(deps, lambda d, i: F.array_position(names, d["name"]) == i + 1)


def _json_entries(content: Column, first: str, second: str) -> Column:
    """Entries of two JSON maps; the second overrides the first."""
    def entries(path):
        return F.coalesce(F.map_entries(F.from_json(F.get_json_object(content, path), "map<string,string>")),
                          F.array().cast("array<struct<key:string,value:string>>"))
    a, b = entries(first), entries(second)
    later = F.transform(b, lambda e: e["key"])
    return F.concat(F.filter(a, lambda e: ~F.array_contains(later, e["key"])), b)


def package_json(c: Column) -> Column:
    kept = F.filter(_json_entries(c, "$.dependencies", "$.devDependencies"),
                    lambda e: (F.length(e["value"]) > 0) & ~e["value"].rlike(UNRESOLVABLE))
    return F.transform(kept, lambda e: _dep(e["key"], _bare(e["value"])))


def composer_json(c: Column) -> Column:
    kept = F.filter(_json_entries(c, "$.require", "$.require-dev"), lambda e: (e["key"] != "php") & ~F.startswith(e["key"], F.lit("ext-")))
    return F.transform(kept, lambda e: _dep(e["key"], _bare(e["value"])))


def requirements_txt(c: Column) -> Column:
    rx = r"^([a-zA-Z0-9_-]+)\s*[=~><!]*=?\s*([\d.]*)"
    rows = F.filter(F.transform(F.split(c, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
                    lambda s: (F.length(s) > 0) & ~F.startswith(s, F.lit("#")) & ~F.startswith(s, F.lit("-")) & s.rlike(rx))
    return F.transform(rows, lambda s: _dep(F.regexp_extract(s, rx, 1), _or_latest(F.regexp_extract(s, rx, 2))))


def pyproject_toml(c: Column) -> Column:
    rx = r"^([a-zA-Z0-9_-]+)\s*[><=~!]*\s*([\d.]*)"

    def listed(text: Column) -> Column:
        items = F.filter(_all(text, r"\"([^\"]+)\""), lambda s: s.rlike(rx))
        return F.transform(items, lambda s: _dep(F.regexp_extract(s, rx, 1), _or_latest(F.regexp_extract(s, rx, 2))))
    project = listed(F.regexp_extract(c, r"(?s)\[project\].*?dependencies\s*=\s*\[(.*?)\]", 1))
    blocks = _all(c, r"(?s)\[project\.optional-dependencies\]\s*\n(.*?)" + TO_NEXT_TABLE)
    optional = F.flatten(F.transform(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?s)\w+\s*=\s*\[(.*?)\]"), 1))), listed))
    line = r"^([a-zA-Z0-9_-]+)\s*=\s*\"([^\"]+)\""
    poetry = F.transform(F.filter(F.split(F.regexp_extract(c, r"(?s)\[tool\.poetry\.dependencies\]\n(.*?)" + TO_NEXT_TABLE, 1), "\n"),
                                  lambda s: s.rlike(line) & (F.regexp_extract(s, line, 1) != "python")),
                         lambda s: _dep(F.regexp_extract(s, line, 1), _bare(F.regexp_extract(s, line, 2))))
    return _first_per_name(F.concat(project, optional, poetry))


def pom_xml(c: Column) -> Column:
    block = r"(<dependency>\s*<groupId>[^<]+</groupId>\s*<artifactId>[^<]+</artifactId>\s*(?:<version>[^<]+</version>)?)"
    return F.transform(_all(c, block), lambda s: _dep(
        F.concat(F.regexp_extract(s, "<groupId>([^<]+)<", 1), F.lit(":"), F.regexp_extract(s, "<artifactId>([^<]+)<", 1)),
        _or_latest(F.regexp_extract(s, "<version>([^<]+)<", 1))))


def build_gradle(c: Column) -> Column:
    rx = r"(?:implementation|api|compileOnly|runtimeOnly|testImplementation)\s+['\"]([^:]+:[^:]+:[^'\"]+)['\"]"
    return F.transform(_all(c, rx), lambda s: _dep(F.regexp_extract(s, "^([^:]+:[^:]+):", 1), F.regexp_extract(s, "^[^:]+:[^:]+:(.+)$", 1)))


def _table(c: Column, name: str) -> Column:
    return F.split(F.regexp_extract(c, rf"(?s)(?:^|\n)\[{name}\]\s*?\n(.*?)(?=\n\[\w+\]\s*(?:\n|\z)|\z)", 1), "\n")


def version_catalog(c: Column) -> Column:
    pair = r"^\s*([a-zA-Z0-9_-]+)\s*=\s*\"([^\"]+)\""
    versions = F.transform(F.filter(_table(c, "versions"), lambda s: s.rlike(pair)),
                           lambda s: F.struct(F.regexp_extract(s, pair, 1).alias("key"), F.regexp_extract(s, pair, 2).alias("value")))
    lib = r"^\s*[a-zA-Z0-9_-]+\s*=\s*\{(.+)\}\s*$"
    module = r"module\s*=\s*\"([^\"]+)\""
    rows = F.filter(F.transform(_table(c, "libraries"), lambda s: F.regexp_extract(s, lib, 1)), lambda v: v.rlike(module))

    def version(v: Column) -> Column:
        ref = F.regexp_extract(v, r"version\.ref\s*=\s*\"([^\"]+)\"", 1)
        named = F.filter(versions, lambda e: e["key"] == ref)
        literal = F.regexp_extract(v, r"(?<!\.)version\s*=\s*\"([^\"]+)\"", 1)
        return F.when((F.length(ref) > 0) & (F.size(named) > 0), F.element_at(named, -1)["value"]).otherwise(_or_latest(literal))
    return F.transform(rows, lambda v: _dep(F.regexp_extract(v, module, 1), version(v)))


def cargo_toml(c: Column) -> Column:
    plain = r"^([a-zA-Z0-9_-]+)\s*=\s*\"([^\"]+)\""
    table = r"^([a-zA-Z0-9_-]+)\s*=\s*\{.*version\s*=\s*\"([^\"]+)\""
    blocks = _all(c, r"(?s)\[(?:dev-|build-)?dependencies\]\n(.*?)" + TO_NEXT_TABLE)
    rows = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), lambda s: s.rlike(plain) | s.rlike(table))
    return F.transform(rows, lambda s: _dep(F.regexp_extract(s, r"^([a-zA-Z0-9_-]+)", 1), F.regexp_replace(
        F.when(s.rlike(plain), F.regexp_extract(s, plain, 2)).otherwise(F.regexp_extract(s, table, 2)), r"^[\^~]", "")))


def gemfile(c: Column) -> Column:
    rx = r"(gem\s+['\"][^'\"]+['\"](?:\s*,\s*['\"][^'\"]+['\"])?)"
    return F.transform(_all(c, rx), lambda s: _dep(
        F.regexp_extract(s, r"^gem\s+['\"]([^'\"]+)", 1),
        F.regexp_replace(_or_latest(F.regexp_extract(s, r",\s*['\"]([^'\"]+)", 1)), r"[~>=<\s]", "")))


def go_mod(c: Column) -> Column:
    rx = r"^(\S+)\s+(v[\d.]+)"
    block = F.filter(F.flatten(F.transform(_all(c, r"(?s)require\s+\((.*?)\)"), lambda b: F.transform(F.split(b, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")))),
                     lambda s: s.rlike(rx))
    single = _all(c, r"(?m)^require\s+(\S+\s+v[\d.]+)")
    return _first_per_name(F.transform(F.concat(block, single), lambda s: _dep(F.regexp_extract(s, rx, 1), F.regexp_extract(s, rx, 2))))


def _attributes(c: Column, element: str) -> Column:
    return F.transform(_all(c, rf"(<{element}\s+Include=\"[^\"]+\"\s+Version=\"[^\"]+\")"), lambda s: _dep(
        F.regexp_extract(s, "Include=\"([^\"]+)\"", 1), F.regexp_extract(s, "Version=\"([^\"]+)\"", 1)))


def csproj(c: Column) -> Column:
    return _attributes(c, "PackageReference")


def packages_props(c: Column) -> Column:
    return _attributes(c, "PackageVersion")


def pubspec_yaml(c: Column) -> Column:
    rx = r"^\s{2}(\w[\w-]*?):\s*[\^~]?([\d.]+)"
    blocks = _all(c, r"(?s)(?:dev_)?dependencies:\n(.*?)(?=\n\w|\n\z|\z)")
    rows = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), lambda s: s.rlike(rx))
    return F.transform(rows, lambda s: _dep(F.regexp_extract(s, rx, 1), F.regexp_extract(s, rx, 2)))


def package_swift(c: Column) -> Column:
    rx = r"(?s)(\.package\s*\(\s*url:\s*\"[^\"]+\".*?from:\s*\"[^\"]+\")"
    return F.transform(_all(c, rx), lambda s: _dep(
        F.element_at(F.split(F.regexp_replace(F.regexp_extract(s, r"url:\s*\"([^\"]+)\"", 1), r"\.git$", ""), "/"), -1),
        F.regexp_extract(s, r"(?s).*from:\s*\"([^\"]+)\"", 1)))


# Manifest file name -> ecosystem and format.
FORMATS = {
    "package.json": ("npm", package_json), "requirements.txt": ("pypi", requirements_txt), "pyproject.toml": ("pypi", pyproject_toml),
    "pom.xml": ("maven", pom_xml), "build.gradle": ("maven", build_gradle), "build.gradle.kts": ("maven", build_gradle),
    "Cargo.toml": ("crates", cargo_toml), "Gemfile": ("rubygems", gemfile), "go.mod": ("go", go_mod),
    "composer.json": ("packagist", composer_json), "pubspec.yaml": ("dart", pubspec_yaml), "libs.versions.toml": ("maven", version_catalog),
    "Package.swift": ("swift", package_swift), "Directory.Packages.props": ("nuget", packages_props), "Directory.Build.props": ("nuget", packages_props),
}


def manifest_deps(files: DataFrame, keep: tuple[str, ...] = ("project",)) -> DataFrame:
    """(keep..., path, ecosystem, name, version) of every manifest; broken files yield
    nothing. Each row is parsed on its own, without a shuffle."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    is_csproj = F.endswith(base, F.lit(".csproj"))
    content = F.col("content")
    eco, deps = F.when(is_csproj, F.lit("nuget")), F.when(is_csproj, csproj(content))
    for name, (ecosystem, parse) in FORMATS.items():
        eco, deps = eco.when(base == name, F.lit(ecosystem)), deps.when(base == name, parse(content))
    return (files.select(*keep, "path", eco.alias("ecosystem"), deps.alias("deps")).where("ecosystem is not null")
            .select(*keep, "path", "ecosystem", F.inline("deps")).where("name is not null and name <> ''"))


def project_deps(files: DataFrame) -> DataFrame:
    """(project, ecosystem, name, version): the manifest nearest to the root wins."""
    every = manifest_deps(files)
    return (every.groupBy("project", "ecosystem", "name")
            .agg(F.min(F.struct(F.size(F.split("path", "/")).alias("d"), "path", "version")).alias("m"))
            .select("project", "ecosystem", "name", F.col("m.version").alias("version")))
