import random
import re

from conftest import rows
from pyspark.sql import functions as F

from scholia.operators import chunking as ck


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first()[0]


def test_atomic_chunks(spark):
    text = "- first\n  more of first\n\n* second\n1. third\n\ttabbed\n**Bold** head\nplain\n  - nested bullet\n   glued"
    assert one(spark, text, ck.atomic) == ["first more of first", "second", "third tabbed", "**Bold** head", "plain", "nested bullet glued"]


def test_blank_line_does_not_close_a_chunk(spark):
    assert one(spark, "- a\n\n   \n  b", ck.atomic) == ["a b"]


def sequential_atomic(body):
    out, cur = [], None
    for line in body.split("\n"):
        t = line.lstrip()
        opens = re.match(r"[-*] |\d+\.\s|\*\*[^*]+\*\*", t)
        if opens:
            if cur is not None:
                out.append(cur)
            cur = re.sub(r"^\d+\.\s+", "", re.sub(r"^[-*]\s+", "", t))
        elif t and cur is not None and (line.startswith("  ") or line.startswith("\t")):
            cur += " " + t
        elif t:
            if cur is not None:
                out.append(cur)
            cur = t
    return out + ([cur] if cur is not None else [])


def test_atomic_equals_line_by_line(spark):
    rnd = random.Random(3)
    pieces = ["- ab", "* cd", "12. ef", "**x** y", "plain", "  cont", "\tcont2", "", "   ", "    - deep", "  3. num", "-nospace", "**open"]
    texts = ["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))).strip() for _ in range(300)]
    texts = [t for t in texts if t]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ck.atomic(F.col("t")).alias("r"))
    for i, got in ((r["i"], r["r"]) for r in df.collect()):
        assert got == sequential_atomic(texts[i]), texts[i]


def sequential_guard(chunks):
    neg = ["never", "not", "don't", "instead", "but", "however", "avoid", "do not"]
    words = lambda s: set(re.findall(r"(?<![a-z0-9_])[a-z]{4,}(?![a-z0-9_])", s.lower()))
    out = []
    for c in chunks:
        if out and any(c.lower().lstrip().startswith(n) for n in neg) and words(out[-1]) & words(c):
            out[-1] += "\n" + c
        else:
            out.append(c)
    return out


def test_guard_equals_left_fold(spark):
    rnd = random.Random(5)
    vocab = ["alpha", "bravo", "delta", "echo", "not", "abc"]
    cases = [[" ".join([rnd.choice(["never", "but", "use", "keep", "Avoid"])] + rnd.choices(vocab, k=2)) for _ in range(rnd.randint(1, 7))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c array<string>").select("i", ck.contradiction_guard(F.col("c")).alias("r"))
    for r in df.collect():
        assert r["r"] == sequential_guard(cases[r["i"]])


def test_guard_chain_of_three(spark):
    got = spark.createDataFrame([(["Keep functions small", "But never functions huge", "However huge rewrites wait", "Not related"],)], "c array<string>").select(
        ck.contradiction_guard(F.col("c")).alias("r")).first()[0]
    assert got == ["Keep functions small\nBut never functions huge\nHowever huge rewrites wait", "Not related"]


MD = """---
name: guide
tags: [a, b]
---
Intro <note>text</note>

## Core Principle
- keep it small
- never keep it large

## Empty

## Anti patterns
<examples>
plain line in examples
</examples>
"""


def test_split_markdown(spark):
    docs = spark.createDataFrame([(1, "x.md", MD), (2, "y.md", "only\n- body"), (3, "z.md", "---\nname: q\n---\n")], "doc_id bigint, path string, content string")
    got = rows(ck.split_markdown(docs).select("doc_id", "parent_title", "section", "sibling_index", "sibling_count", "text"))
    assert got == [
        (1, "Anti patterns", "pitfalls", 0, 1, "plain line in examples"),
        (1, "Core Principle", "framework", 0, 1, "keep it small\nnever keep it large"),
        (1, "summary", "summary", 0, 1, "Intro text"),
        (2, "y.md", "content", 0, 2, "only"), (2, "y.md", "content", 1, 2, "body")]


def test_wrapper_tag_wins(spark):
    long = "words " * 30
    md = f"# t\n<core_principles>\n## Pitfall list\n{long}\n</core_principles>\n"
    docs = spark.createDataFrame([(1, "x.md", md)], "doc_id bigint, path string, content string")
    assert [r["kind"] for r in ck.sections(docs).collect() if r["header"] == "Pitfall list"] == ["framework"]


def test_principles(spark):
    text = "lead in\n- **Name things** - short and clear\n  and honest\n2. Second: with context\n\nstray\n**Third** rest of it"
    got = rows(ck.principles(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert got == [(1, 0, "Name things", "short and clear and honest"), (1, 1, "Second", "with context"), (1, 2, "Third", "rest of it")]


def test_principle_fallback(spark):
    text = "x" * 200 + ". tail words"
    r = ck.principles(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r["principle"] == "x" * 147 + "..." and r["context"].endswith("tail words")


def test_extract_items(spark):
    text = ("# Title\nbody of the heading block here\n\n- **Bold one** - explains the first thing well\n- **Bold two** - explains the second thing\n\n"
            "- plain bullet that is long enough\n- short\n\n"
            + "This is a sentence that is long enough to count. Another sentence follows here with very many different words. And a third one closes the whole paragraph nicely.")
    got = [(r["label"], r["body"]) for r in ck.extract_items(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("pos").collect()]
    assert got[0] == ("Title", "body of the heading block here")
    assert ("Bold one", "explains the first thing well") in got and ("Bold two", "explains the second thing") in got
    assert (None, "plain bullet that is long enough") in got and len([g for g in got if g[1].startswith(("This is", "Another", "And a"))]) == 3


def test_description(spark):
    assert one(spark, "---\ndescription: 'Quoted'\n---\n", ck.description) == "Quoted"
    assert one(spark, "---\ndescription: >\n  two\n  lines\nname: x\n", ck.description) == "two lines"
    assert one(spark, "---\nname: x\n---\n", ck.description) is None


def test_decisions_and_specs(spark):
    text = "## Context\nwhy\n## Decision\nWe SHALL do it\n## Other\nGOAL: win\nDELIVERS: a\nb\n\nNOT DOING: c"
    docs = spark.createDataFrame([(1, "adr/one.md", text), (2, "adr/template.md", text)], "doc_id int, path string, content string")
    got = {(r["kind"], r["text"]) for r in ck.decisions(docs).collect()}
    assert got == {("decision", "## Decision\nWe SHALL do it"), ("rules", "We SHALL do it"), ("spec", "GOAL: win\nDELIVERS: a\nb")}


def test_metadata_prefix(spark):
    df = spark.createDataFrame([("n", "t", "k", ["a", "b"]), (None, "t", None, []), (None, None, None, None)], "n string, t string, k string, g array<string>")
    got = [r[0] for r in df.select(ck.metadata_prefix(F.col("n"), F.col("t"), F.col("k"), F.col("g"))).collect()]
    assert got == ["[skill:n] [type:k] [tags:a,b] ", "[skill:t] ", ""]


def test_record_clean(spark):
    df = ck.record_clean(spark.createDataFrame([(1, " a ", ""), (2, " ", None)], "id int, x string, y string"), "id")
    assert rows(df) == [(1, "a", None, 0), (2, None, None, 1)]


def test_items_after_bold_blocks_without_a_label(spark):
    loose = "- ** not a label, just stars in a long line\n- and a plain bullet that is long enough"
    text = "# Title\nbody of the heading block here\n\n" + loose
    rows = ck.extract_items(spark.createDataFrame([(1, text), (2, loose)], "id int, text string"), "id").collect()
    assert [(r["label"], r["body"]) for r in rows if r["id"] == 1][0] == ("Title", "body of the heading block here")
    long = "# Title\n" + "x" * 299 + "\n" + "y" * 40
    assert ck.extract_items(spark.createDataFrame([(1, long)], "id int, text string"), "id").first()["body"] == "x" * 299


def test_dash_with_a_tab_is_no_bullet(spark):
    assert one(spark, "-\tfoo\n- bar\n* baz", lambda c: ck.atomic(c)) == ["-\tfoo", "bar", "baz"]


def test_repeated_frontmatter_keys(spark):
    assert one(spark, "---\na: 1\nb: 2\na: 3\n---\nx", ck.front_map) == {"a": "3", "b": "2"}
    folded = "---\nname: 'x y'\ndescription: >\n  two\n  lines\nlong: a\n  b\nnote\nempty:\nname: \"z\"\n---\nbody"
    assert one(spark, folded, ck.front_map) == {"name": "z", "description": "two lines", "long": "a b", "empty": ""}
    assert one(spark, "no block", ck.front_map) == {}
    many = "---\n" + "\n".join(f"k{i % 700}: {i}" for i in range(20_000)) + "\n---\n"
    assert one(spark, many, ck.front_map)["k5"] == str(max(i for i in range(20_000) if i % 700 == 5))


def test_records_of_empty_lists_are_rejected(spark):
    rows = spark.createDataFrame([(1, " ", []), (2, "", ["x"]), (3, None, None)], "id int, a string, l array<string>")
    assert {r["id"]: r["rejected"] for r in ck.record_clean(rows, "id").collect()} == {1: 1, 2: 0, 3: 1}


def test_a_text_without_lines_has_a_guide_too(spark, tmp_path):
    """Blank documents: an empty goal, and none of the queries over the guides fails."""
    from scholia import plans
    from scholia.plans.views import Tables
    docs = [(1, "", "en", "src1", 0), (2, " \n  ", "de", "src2", 4), (3, "one\ntwo", "en", "src1", 7), (4, None, "en", "src1", None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    guides = {r["doc_id"]: r["content"] for r in Tables(spark, str(tmp_path)).v_guides.collect()}
    assert "\nGOAL: \nDELIVERS: none\n" in guides[1] and "\nGOAL: \nDELIVERS: none\n" in guides[2]
    assert "\nGOAL: one\nDELIVERS: two\n" in guides[3] and guides[4] is None
    queries = plans.load()[0]
    got = {name: {r[0] for r in queries[name](spark, str(tmp_path)).collect()} for name in ("content_type", "code_exports", "decision_extract", "item_extract", "section_split")}
    assert got.pop("content_type") == {"specs/src1", "specs/src2"}
    assert got == {"code_exports": {1, 2, 3, 4}, "decision_extract": {1, 2, 3}, "item_extract": {1, 2, 3}, "section_split": {1, 2, 3}}
    assert queries["doc_quality"](spark, str(tmp_path)).count() == 8
