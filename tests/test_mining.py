import pytest
from conftest import rows
from pyspark.sql import functions as F

from scholia.operators import manifests, mining, rules

MANIFESTS = [
    ("package.json", '{"name": "me", "dependencies": {"a": "^1.0.0", "b": "workspace:*", "@s/c": ">=2"}, "devDependencies": {"a": "~3.1", "d": "file:x"}}',
     {("npm", "a", "3.1"), ("npm", "@s/c", "2")}),
    ("requirements.txt", "# c\n-r x.txt\nflask==2.0.1\nnumpy>=1.2\nrequests\n  pandas ~= 1.1 ; py\n", {("pypi", "flask", "2.0.1"), ("pypi", "numpy", "1.2"), ("pypi", "requests", "latest"), ("pypi", "pandas", "1.1")}),
    ("pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "django>=4.0",\n  "httpx",\n]\n[project.optional-dependencies]\ntest = ["pytest>=7", "django>=1"]\n\n[tool.poetry.dependencies]\npython = "^3.9"\nrich = "^13.1"\n',
     {("pypi", "django", "4.0"), ("pypi", "httpx", "latest"), ("pypi", "pytest", "7"), ("pypi", "rich", "13.1")}),
    ("pom.xml", "<dependency>\n<groupId>g</groupId>\n<artifactId>a</artifactId>\n<version>1</version></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId></dependency>",
     {("maven", "g:a", "1"), ("maven", "h:b", "latest")}),
    ("build.gradle", "implementation 'g:a:1.2'\ntestImplementation \"h:b:3\"\nclasspath 'no:no:1'", {("maven", "g:a", "1.2"), ("maven", "h:b", "3")}),
    ("build.gradle.kts", "api \"g:a:1.2\"", {("maven", "g:a", "1.2")}),
    ("libs.versions.toml", '[versions]\nkt = "1.9"\n\n[libraries]\na = { module = "g:a", version.ref = "kt" }\nb = { module = "g:b", version = "2.0" }\nc = { module = "g:c" }\n\n[plugins]\nz = { module = "no:no" }\n',
     {("maven", "g:a", "1.9"), ("maven", "g:b", "2.0"), ("maven", "g:c", "latest")}),
    ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "^1.0"\ntokio = { features = ["full"], version = "1.2" }\n\n[dev-dependencies]\nrand = "~0.8"\n', {("crates", "serde", "1.0"), ("crates", "tokio", "1.2"), ("crates", "rand", "0.8")}),
    ("Gemfile", "gem 'rails', '~> 7.0'\ngem \"puma\"\n", {("rubygems", "rails", "7.0"), ("rubygems", "puma", "latest")}),
    ("go.mod", "module m\nrequire (\n\tx.org/a v1.2.3\n\tx.org/b v0.1.0 // indirect\n)\nrequire x.org/c v2.0.0\nrequire x.org/a v9.0.0\n", {("go", "x.org/a", "v1.2.3"), ("go", "x.org/b", "v0.1.0"), ("go", "x.org/c", "v2.0.0")}),
    ("App.csproj", '<PackageReference Include="N.J" Version="13.0" />', {("nuget", "N.J", "13.0")}),
    ("composer.json", '{"require": {"php": ">=8", "ext-json": "*", "v/p": "^2.0"}, "require-dev": {"v/q": "1.0"}}', {("packagist", "v/p", "2.0"), ("packagist", "v/q", "1.0")}),
    ("pubspec.yaml", "name: x\ndependencies:\n  http: ^0.13.4\n  path: 1.8.0\ndev_dependencies:\n  test: ~1.2\n", {("dart", "http", "0.13.4"), ("dart", "path", "1.8.0"), ("dart", "test", "1.2")}),
    ("Package.swift", '.package(url: "https://h/u/Alamofire.git", from: "5.6"),\n.package(\n url: "https://h/u/Kit",\n from: "1.0")', {("swift", "Alamofire", "5.6"), ("swift", "Kit", "1.0")}),
    ("Directory.Packages.props", '<PackageVersion Include="N.J" Version="13.0.3" />', {("nuget", "N.J", "13.0.3")}),
    ("package-lock.json", "{}", set()),
]


def test_all_manifest_formats(spark):
    df = spark.createDataFrame([(n, p, c) for n, (p, c, _) in enumerate(MANIFESTS)] + [(99, "package.json", '{"dependencies": {"a"')], "project int, path string, content string")
    got = {}
    for r in manifests.manifest_deps(df).collect():
        got.setdefault(r["project"], set()).add((r["ecosystem"], r["name"], r["version"]))
    for n, (path, _, want) in enumerate(MANIFESTS):
        assert got.get(n, set()) == want, path
    assert 99 not in got


def test_root_manifest_wins(spark):
    df = spark.createDataFrame([(1, "sub/requirements.txt", "a==2"), (1, "requirements.txt", "a==1")], "project int, path string, content string")
    assert rows(manifests.project_deps(df)) == [(1, "pypi", "a", "1")]


IMPORTS = [
    ("a.ts", "import {\n x,\n y } from 'react-dom/client';\nimport type { T } from \"@s/p/q\";\nconst z = require('lodash/fp');\nawait import('dyn');\nimport r from './rel';", {"react-dom", "@s/p", "lodash", "dyn"}),
    ("a.py", "import os.path\nfrom typing_x import A\n  import indented\n", {"os", "typing_x"}),
    ("a.go", 'import "fmt"\nimport (\n\t"github.com/u/r/pkg"\n)', {"fmt", "github.com/u/r"}),
    ("a.rs", "use serde::Deserialize;\nextern crate rand;\nuse crate_only;", {"serde", "rand"}),
    ("A.java", "import com.google.gson.Gson;\nimport static org.junit.Assert.assertTrue;", {"com.google.gson", "org.junit.Assert"}),
    ("A.kt", "import io.ktor.server.Netty", {"io.ktor.server"}),
    ("a.rb", "require 'dry/types'\nrequire_relative 'x'\nrequire './y'", {"dry/types"}),
    ("a.php", "use Illuminate\\Support\\Str;", {"illuminate/support"}),
    ("a.cs", "using static System.Math;\nusing Newtonsoft.Json;", {"System.Math", "Newtonsoft.Json"}),
    ("a.swift", "import struct Foundation.Date\nimport UIKit", {"Foundation", "UIKit"}),
    ("a.dart", "import 'package:flutter/material.dart';\nimport 'dart:io';", {"flutter"}),
    ("a.txt", "import x", set()),
]


def test_all_import_languages(spark):
    df = spark.createDataFrame([(n, p, c) for n, (p, c, _) in enumerate(IMPORTS)], "file_id int, path string, content string")
    got = {}
    for r in mining.imports(df).collect():
        got.setdefault(r["file_id"], set()).add(r["module"])
    for n, (path, _, want) in enumerate(IMPORTS):
        assert got.get(n, set()) == want, path


API = [
    ("js", "next", "import { cacheLife, after as later } from 'next/cache';\nimport Next from 'next';\nconst { a, b } = require('next')", ["cacheLife", "after", "Next", "a", "b"]),
    ("python", "flask", "from flask.views import View, x as y\nfrom flask import Flask", ["View", "x", "Flask"]),
    ("go", "h.org/u/mux", "mux.NewRouter()\nmux.Vars(r)", ["NewRouter", "Vars"]),
    ("rust", "tokio", "use tokio::sync::{Mutex, mpsc};\nuse tokio::time::Instant;", ["Mutex", "mpsc", "Instant"]),
    ("java", "com.google.gson", "import com.google.gson.reflect.TypeToken;", ["TypeToken"]),
    ("php", "a/b", "use A\\B\\Str;\nuse A\\B\\Arr as Helper;\nuse A\\{One, Two as Deux};", ["Str", "Helper", "One", "Deux"]),
    ("ruby", "dry", "require 'dry'", ["dry"]),
]


def test_api_names(spark):
    df = spark.createDataFrame([(n, l, m, c) for n, (l, m, c, _) in enumerate(API)], "n int, l string, m string, c string")
    got = {r["n"]: r["a"] for r in df.select("n", mining.api_names(F.col("c"), F.col("m"), F.col("l")).alias("a")).collect()}
    for n, (lang, _, _, want) in enumerate(API):
        assert got[n] == want, lang


def test_affected_files_keys(spark):
    files = spark.createDataFrame([
        (1, "A.java", "import com.google.gson.Gson;"), (2, "b.py", "from typing_inspection import x"), (3, "c.php", "use Laravel\\Framework\\Str;"),
        (4, "d.ts", "import { me } from 'self-pkg';"), (5, "e.kt", "import org.acme.okio.Buffer")], "file_id int, path string, content string")
    gaps = spark.createDataFrame([("com.google.code.gson:gson",), ("typing-inspection",), ("laravel/framework",), ("self-pkg",), ("com.square:okio",)], "name string")
    got = {(r["file_id"], r["dep"], tuple(r["apis"])) for r in mining.affected_files(files, gaps, spark.createDataFrame([("Self_Pkg",)], "name string")).collect()}
    assert got == {(1, "com.google.code.gson:gson", ("Gson",)), (2, "typing-inspection", ("x",)), (3, "laravel/framework", ("Str",)), (5, "com.square:okio", ("Buffer",))}


def test_classify_without_index(spark):
    imp = spark.createDataFrame([(1, "a"), (1, "node:fs")], "file_id int, module string")
    assert rows(mining.import_classify(imp, None, None)) == [(1, "a", "skipped")]


def test_icons_apart(spark):
    a = spark.createDataFrame([("lucide-react", ["X", "Y"]), ("next", ["z"])], "dep string, apis array<string>")
    assert rows(mining.api_totals(a)) == [("lucide-react", 1, 1, 2), ("next", 0, 1, 1)]


PROHIBITED = [
    ("Please do not use moment.js here", "do-not-use", "moment"), ("Deprecated: old client", "deprecated", "old client"),
    ("LegacyApi is deprecated now", "is-deprecated", "LegacyApi"), ("prefer zod over joi, always", "prefer-over", "joi"),
    ("We replaced `redis` with valkey", "replaced-with", "redis"), ("decided against GraphQL.", "decided-against", "GraphQL"),
    ("we chose fetch instead of axios", "instead-of", "axios"), ("You should not import lodash", "must-not", "lodash"),
]


def test_prohibition_families(spark):
    df = spark.createDataFrame([(n, t) for n, (t, _, _) in enumerate(PROHIBITED)], "id int, text string")
    got = {(r["id"], r["family"], r["target"]) for r in rules.prohibitions(df, "id").collect()}
    for n, (_, family, target) in enumerate(PROHIBITED):
        assert (n, family, target) in got


def test_violation_by_segments(spark):
    files = spark.createDataFrame([(1, "a.ts", "stripe.charges.create(x)"), (2, "b.ts", "db.run(1)")], "file_id int, path string, content string")
    dec = spark.createDataFrame([(7, "Do not use the Charges API"), (8, "avoid using db run")], "decision_id int, text string")
    assert rows(rules.decision_violations(files, dec)) == [(1, "stripe.charges.create", 7), (2, "db.run", 8)]


def test_scope_keywords(spark):
    df = spark.createDataFrame([("All endpoints must use 'zod' and Stripe in the admin middleware",)], "t string")
    terms, globs, triggers = rules.scope_keywords(F.col("t"))
    r = df.select(terms.alias("a"), globs.alias("b"), triggers.alias("c")).first()
    assert r["a"] == ["endpoints", "zod", "stripe", "admin", "middleware"]
    assert set(r["b"]) == {"**/api/**", "**/admin/**", "**/middleware/**"} and set(r["c"]) == {"stripe", "zod"}


def test_scope_match_strengths(spark):
    know = spark.createDataFrame([("k1", "the api rejects widgets", "s", "note"), ("k2", "widgets are fine", "s", "note"), ("k3", "import 'next' early", "s", "note")], "id string, text string, source string, type string")
    gaps = spark.createDataFrame([("next", "15", "2025-06-01")], "name string, version string, publish_date string")
    scope = rules.scope_map(know, gaps)
    edits = spark.createDataFrame([(1, "src/api/x.ts", "import { a } from 'next/cache';\nnew Widgets()"), (2, "lib/x.ts", "widgets()")], "event_id bigint, path string, code string")
    got = rows(rules.scope_match(edits, scope))
    # k3: import 4 + terms ("next", "import") 2, gap: import 4 + path 1, k1: term 2 + path 1
    assert got == [(1, "gap:next", 5, 2), (1, "k1", 3, 3), (1, "k3", 6, 1)]


SCOPE = "id string, type string, code_terms array<string>, file_patterns array<string>, import_triggers array<string>, function_patterns array<string>"


def test_scope_items_met_by_one_kind_only(spark):
    gap = "post-training"
    scope = spark.createDataFrame([
        ("call", "note", [], [], [], [r"fetch\w*\s*\(", "(broken"]), ("anycall", "note", [], [], [], [r"^\s*(async|await)\b"]), ("term", "note", ["fetch"], [], [], []),
        ("termfile", "note", ["fetch"], ["**/api/**"], [], []), ("file", "note", [], ["src/**"], [], []),
        ("gapfile", gap, [], ["src/api/*.ts"], ["zzz"], []), ("gapany", gap, [], ["**"], ["zzz"], []), ("gapnone", gap, ["fetch"], [], [], []),
        *[(f"many{i}", gap, [], ["*/api/*"], [], []) for i in range(9)]], SCOPE)
    edits = spark.createDataFrame([(1, "src/api/a.ts", "let x = FetchAll\n (1)"), (2, "lib/x.py", "  await y"), (3, None, "fetch"), (4, "src/api/b.ts", None)],
                                  "event_id bigint, path string, code string")
    got = rows(rules.scope_match(edits, scope, 20))
    many = [(1, f"many{i}", 1) for i in range(9)]
    assert sorted(r[:3] for r in got if r[0] == 1) == sorted([(1, "call", 3), (1, "termfile", 3), (1, "gapfile", 1), *many])
    assert [r[:3] for r in got if r[0] in (2, 3)] == [(2, "anycall", 3)]
    assert {r[1] for r in got if r[0] == 4} == {"gapfile", *(f"many{i}" for i in range(9))}
    best = rows(rules.scope_match(edits, scope))
    assert sorted((r[3], r[1]) for r in best if r[0] == 1) == [(1, "call"), (2, "termfile"), (3, "gapfile"), (4, "many0"), (5, "many1")]


def test_function_patterns_are_looked_up_under_a_word_they_need(spark):
    import re
    from scholia.operators.rules import _needed_word, function_matches
    patterns = [r"use[A-Z]\w+State", r"foo?bar\(", "colou?red", "a|b", "(x", r"\bmake\s*\(", "x{2,}yz", "é+", "log_error", ".", "make.*thing", "ma*ke", r"log_error\s*[(|]", r"[\]a]bcd"]
    codes = ["const s = useMyState()", "fobar(1)", "colored", "b", "MAKE\n(1)", "xxyz", "éé", "log_ERROR", "", "make the thing", "mke", "zz", "log_error (", "abcd"]
    df = spark.createDataFrame(list(enumerate(codes)), "event_id bigint, code string")
    ps = spark.createDataFrame([(p,) for p in patterns], "pattern string")

    def found(p, c):
        try:
            return re.search(p, c, re.I) is not None
        except re.error:
            return False
    assert rows(function_matches(df, ps)) == sorted(((i, p) for i, c in enumerate(codes) for p in patterns if found(p, c)), key=repr)
    words = {r.pattern: r.w for r in ps.select("pattern", _needed_word(F.col("pattern")).alias("w")).collect()}
    assert words["log_error"] == words[r"log_error\s*[(|]"] == "log_error" and words["a|b"] == "" and words["colou?red"] in ("colo", "red")


def test_globs_by_their_rarest_segment(spark):
    import re
    from scholia.functions.text import glob_matches
    paths = ["src/api/a.ts", "src/b.py", "top.ts", "a/test1/x/y.js", "deep/src/api/z", "we[ird]/a+b.c", r"x.E\Ey", ""]
    globs = ["src/**", "**/api/**", "*.ts", "**/test*/**", "**", "*", "we[ird]/*", "?op.ts", "*/*", "src/api/a.ts", "nothere/**", r"x.E\E?", "", "**/*.p?"]

    def pattern(glob):
        return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|\*|\?|[^*?]+", glob))
    p = spark.createDataFrame([(x,) for x in [*paths, None, "src/b.py"]], "path string")
    g = spark.createDataFrame([(x,) for x in [*globs, None, "*"]], "glob string")
    assert rows(glob_matches(p, g)) == sorted(((x, y) for x in paths for y in globs if re.fullmatch(pattern(y), x)), key=repr)
    by_name = rows(glob_matches(p, g, by_name=True))
    assert by_name == sorted(((x, y) for x in paths for y in globs if re.fullmatch(pattern(y), x if "/" in y else x.rsplit("/", 1)[-1])), key=repr)


def test_scope_contradictions(spark):
    scope = spark.createDataFrame([("a", "prefer zod over Joi. Also avoid lodash!", None)], "id string, constraint string, example string")
    edits = spark.createDataFrame([(1, "import joi; lodash.map()")], "event_id bigint, code string")
    matched = spark.createDataFrame([(1, "a")], "event_id bigint, id string")
    assert rows(rules.scope_contradictions(edits, matched, scope)) == [(1, "a", "prefer zod over Joi.; avoid lodash!")]


@pytest.mark.parametrize("text,want", [("short", "none"), ("x" * 100, "low"), ("y " * 150, "low"), ("y " * 150 + "GET /a", "medium"), ("y " * 150 + "GET /a\n```\nc\n```\nimport z", "high")])
def test_doc_quality(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(rules.doc_quality(F.col("t"))).first()[0] == want


def test_content_type(spark):
    files = spark.createDataFrame([
        ("a", "Feature: login\n  Scenario: ok\n    Given x\n    When y\n    Then z"), ("b", "nothing to see"), ("c/.obsidian", "[[link]] text"),
        ("d", "openapi: 3.0\npaths:\nschemas:\n")], "folder string, content string")
    got = {r["folder"]: (r["type"], r["confidence"]) for r in rules.content_type(files, F.col("folder")).collect()}
    assert got["a"][0] == "bdd-spec" and got["b"] == ("wiki", "low") and got["c/.obsidian"] == ("pkm", "high") and got["d"] == ("api-spec", "high")


def test_ascii_word_boundary(spark):
    df = spark.createDataFrame([("füra ra x",)], "t string")
    assert df.select(rules.count_of(F.col("t"), r"\bra\b")).first()[0] == 2  # ASCII: the letter ü ends a word


def test_line_rules_skip_comments(spark):
    files = spark.createDataFrame([(1, "// bad\nbad and bad\ngood")], "id int, content string")
    r = [{"ruleset": "x", "rule_id": "r", "pattern": r"\bbad\b", "severity": "w"}]
    assert rows(rules.line_rules(files, "id", r)) == [(1, 1, "r", "w"), (1, 2, "r", "w")]
    assert rows(rules.line_rules(files, "id", r, skip_comments=True)) == [(1, 2, "r", "w")]


def test_context_window_edges(spark):
    def file(gap):
        return "\n".join(["infinite"] + [""] * gap + ["paused"])
    df = spark.createDataFrame([(n, file(n)) for n in (8, 9, 10, 11)] + [(100, "paused\n" + "\n" * 8 + "infinite"), (101, "paused\n" + "\n" * 9 + "infinite")], "id int, content string")
    # forward 10 lines, backward 9 lines count as near
    assert rows(rules.context_window(df, "id", "infinite", ["paused"])) == [(10, 1), (101, 11), (11, 1)]


def test_durations_and_scale(spark):
    df = spark.createDataFrame([(1, "transition: a 0.7s\nx 50ms y 200ms")], "id int, content string")
    assert rows(rules.durations(df, "id")) == [(1, 1, 700.0, "too-slow"), (1, 2, 50.0, "too-fast")]
    v = spark.createDataFrame([(1, 13), (1, 16), (1, 0), (1, 200)], "file_id int, value int")
    assert [(r["value"], r["nearest"]) for r in rules.off_scale(v).orderBy("value").collect()] == [(13, 12), (200, 128)]


def test_uncaptured_docs(spark):
    files = spark.createDataFrame([(1, "docs/a.md"), (1, "docs/b.py"), (1, "docs/sub/c.md"), (1, "ADR.md"), (1, "specs/x.txt"), (1, "src/a.md")], "project int, path string")
    src = spark.createDataFrame([(1, "specs")], "project int, name string")
    assert rows(mining.uncaptured_docs(files, src).select("path", "type", "files")) == [("ADR.md", "file", 1), ("docs", "directory", 1)]


def test_identifiers_start_at_a_script_boundary(spark):
    files = spark.createDataFrame([(1, "a.js", "$.ajax(1); $foo.bar(2); x$y.z(3); foo.bar(4)")], "file_id int, path string, content string")
    got = [r.identifier for r in mining.identifiers(files).collect()]
    assert got == ["foo.bar", "x$y.z"] or "$.ajax" not in got and "$foo.bar" not in got


def test_numbered_terms_are_not_looked_up_under_their_shared_first_characters(spark, monkeypatch):
    asked = []

    def spy(needles, haystacks, needle, haystack, gram=6):
        asked.append((needle, [r[0][:gram] for r in needles.select(needle).distinct().collect()]))
        return contained_in(needles, haystacks, needle, haystack, gram)
    from scholia.functions.text import contained_in
    monkeypatch.setattr(rules, "contained_in", spy)
    edits = spark.createDataFrame([(n, "src/a.ts", f"x = library{n:05d}.make(1)") for n in range(40)], "event_id long, path string, code string")
    notes = spark.createDataFrame([(f"n{n}", f"Never use library{n:05d} today", "k", "note") for n in range(40)], "id string, text string, source string, type string")
    calls = rules.scope_from_knowledge(notes).withColumn("id", F.concat(F.lit("f"), "id")).withColumn("code_terms", F.array().cast("array<string>")) \
        .withColumn("function_patterns", F.array(F.concat(F.regexp_extract("constraint", "(library[0-9]+)", 1), F.lit("[.]make"))))
    got = rules.scope_match(edits, calls)
    assert {(r[0], r[1]) for r in got.collect()} == {(n, f"fn{n}") for n in range(40)}
    rules.scope_match(edits, rules.scope_from_knowledge(notes)).collect()
    assert {n for n, _ in asked} == {"term", "word"}
    for _, keys in asked:
        assert len(set(keys)) == len(keys)
