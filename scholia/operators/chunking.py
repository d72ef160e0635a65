"""Document preparation: frontmatter, sections, atomic chunks, principles.

Everything that belongs to one document is cut inside its row with regular
expressions and array functions, so a corpus is chunked without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Words that open a sentence negating the one before it.
NEGATION_WORDS = ("never", "not", "don't", "instead", "but", "however", "avoid", "do not")
# Wrapper tag -> section type.
TAG_SECTIONS = {"core_principles": "framework", "anti_patterns": "pitfalls", "examples": "case_studies"}

FRONT = r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)"


# ---- frontmatter -----------------------------------------------------------

def front_block(content: Column) -> Column:
    return F.regexp_extract(content, FRONT, 1)


def body_of(content: Column) -> Column:
    return F.regexp_replace(content, FRONT, "")


def front_value(content: Column, key: str) -> Column:
    """Value of one flat key; null when the key is absent."""
    got = F.regexp_extract(front_block(content), rf"(?m)^{key}:[ \t]*(.*)$", 1)
    return F.when(F.length(got) > 0, F.trim(F.regexp_replace(got, "^[\"']|[\"']$", "")))


def front_map(content: Column) -> Column:
    """Flat frontmatter keys as a map of strings; the last value of a repeated key.

    Indented lines belong to the key before them and are folded into one line, quotes
    around a value are taken off.
    """
    folded = F.regexp_replace(front_block(content), r"\n[ \t]+(?=\S)", " ")
    rows = F.filter(F.split(folded, "\n"), lambda s: s.rlike(r"^[A-Za-z_][\w-]*:"))

    def value(line: Column) -> Column:
        text = F.trim(F.regexp_replace(F.regexp_extract(line, r"^[\w-]+:(.*)$", 1), r"^\s*[>|][+-]?(?:\s|$)", ""))
        return F.regexp_replace(text, "^[\"']|[\"']$", "")
    # sorted by key and place, the last row of each key stays
    placed = F.array_sort(F.transform(rows, lambda s, i: F.struct(F.regexp_extract(s, r"^([\w-]+):", 1).alias("key"), i.alias("i"), value(s).alias("value"))))
    last = F.array_compact(F.zip_with(placed, F.slice(placed, F.lit(2), F.size(placed)), lambda x, following: F.when(
        following.isNull() | (following["key"] != x["key"]), x)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))


def inline_list(value: Column) -> Column:
    """``[a, b]`` as an array."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def frontmatter(docs: DataFrame) -> DataFrame:
    """(doc_id, path, doc_name, tags, front, body) of ``docs(doc_id, path, content)``."""
    c = F.col("content")
    return docs.select("doc_id", "path", F.coalesce(front_value(c, "name"), F.col("path")).alias("doc_name"),
                       inline_list(front_value(c, "tags")).alias("tags"), front_map(c).alias("front"), body_of(c).alias("body"))


# ---- sections --------------------------------------------------------------

def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"</?[a-z_]+>", ""))


def trim_all(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parent_id(doc_name: Column, header: Column) -> Column:
    return F.left(F.sha2(F.concat(doc_name, F.lit("::"), header), 256), F.lit(12))


def header_type(header: Column) -> Column:
    h = F.lower(header)
    return (F.when(h.rlike("principle|rule"), "framework").when(h.rlike("anti|avoid|pitfall"), "pitfalls")
            .when(h.rlike("example|case"), "case_studies").otherwise("content"))


def wrapper_type(body: Column, section: Column) -> Column:
    """Type given by a wrapper tag whose content holds the section's first 80 characters."""
    head = F.left(section, F.lit(80))
    out = F.lit(None).cast("string")
    for tag, kind in reversed(TAG_SECTIONS.items()):
        start, end = F.instr(body, f"<{tag}>"), F.instr(body, f"</{tag}>")
        inner = F.substring(body, start + len(tag) + 2, F.greatest(end - start - len(tag) - 2, F.lit(0)))
        out = F.when((start > 0) & (end > 0) & F.contains(inner, head), kind).otherwise(out)
    return out


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_name, pos, header, kind, text): the summary before the first
    header, one row per non-empty ``## `` section, or the whole body without headers."""
    d = frontmatter(docs)
    pieces = F.split("body", r"(?m)(?=^## .)")
    cut = d.select("doc_id", "path", "doc_name", "body", F.posexplode(pieces).alias("pos", "raw"))
    is_section = F.col("raw").rlike(r"^## .")
    header = F.trim(F.regexp_extract("raw", r"^## ([^\n]+)", 1))
    raw = F.when(is_section, F.regexp_replace("raw", r"^## [^\n]*(?:\n|$)", "")).otherwise(F.col("raw"))
    has_headers = F.col("body").rlike(r"(?m)^## .")
    kind = (F.when(~has_headers, "content").when(~is_section, "summary")
            .otherwise(F.coalesce(wrapper_type(F.col("body"), F.col("sec")), header_type(F.col("head")))))
    return (cut.withColumn("head", F.when(is_section, header).when(has_headers, "summary").otherwise(F.col("doc_name")))
            .withColumn("sec", trim_all(raw)).withColumn("text", trim_all(strip_tags(F.col("sec"))))
            .where(F.length("text") > 0)
            .select("doc_id", "path", "doc_name", "pos", F.col("head").alias("header"), kind.alias("kind"), "text"))


# ---- atomic chunks ---------------------------------------------------------

def atomic(text: Column) -> Column:
    """Bullets, numbered items, bold-headed and plain lines as separate chunks.

    Blank lines go first; an indented plain line is glued to the line before it;
    what is left is one chunk per line without its list marker.
    """
    dense = F.regexp_replace(text, r"\n[ \t\r]*(?=\n|$)", "")
    glued = F.regexp_replace(dense, r"\n(?:  |\t)\s*(?![-*] |\d+\.\s|\*\*[^*]+\*\*)(?=\S)", " ")
    rows = F.transform(F.split(glued, "\n"), lambda s: F.regexp_replace(s, r"^\s+", ""))
    clean = F.transform(rows, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[-*] \s*", ""), r"^\d+\.\s+", ""))
    return F.filter(clean, lambda s: F.length(s) > 0)


def _negates(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"^\s+", "")
    out = F.lit(False)
    for w in NEGATION_WORDS:
        out = out | F.startswith(low, F.lit(w))
    return out


def _long_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9_])([a-z]{4,})(?![a-z0-9_])"), 1)


def contradiction_guard(chunks: Column) -> Column:
    """Left fold: a chunk that opens with a negation and shares a long word with
    everything accumulated before it joins the previous chunk."""
    def step(acc: Column, nxt: Column) -> Column:
        last = F.element_at(acc, -1)
        merge = (F.size(acc) > 0) & _negates(nxt) & F.arrays_overlap(_long_words(last), _long_words(nxt))
        return (F.when(merge, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit("\n"), nxt))))
                .otherwise(F.concat(acc, F.array(nxt))))
    return F.aggregate(chunks, F.array().cast("array<string>"),
                       lambda acc, nxt: F.when(F.size(acc) == 0, F.array(nxt)).otherwise(step(acc, nxt)))


def split_markdown(docs: DataFrame) -> DataFrame:
    """The full chunk table of ``docs(doc_id, path, content)``."""
    s = sections(docs)
    chunks = F.when(F.col("kind") == "summary", F.array("text")).otherwise(contradiction_guard(atomic(F.col("text"))))
    listed = s.withColumn("cs", chunks)
    return listed.select(
        "doc_id", "path", "doc_name", F.col("pos").cast("bigint").alias("section_pos"),
        parent_id(F.col("doc_name"), F.col("header")).alias("parent_id"), F.col("header").alias("parent_title"),
        F.col("kind").alias("section"), F.size("cs").cast("bigint").alias("sibling_count"),
        F.posexplode("cs").alias("sibling_index", "text")).withColumn("sibling_index", F.col("sibling_index").cast("bigint"))


def empty_body_fallback(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes without chunks are indexed by title, type and tags."""
    return (nodes.join(chunks.select("id").distinct(), "id", "left_anti")
            .select("id", F.array_join(F.filter(F.concat(F.array("title", "type"), F.coalesce("tags", F.array().cast("array<string>"))),
                                                lambda v: v.isNotNull() & (F.length(v) > 0)), " ").alias("text")))


def metadata_prefix(name: Column, title: Column, kind: Column, tags: Column) -> Column:
    """``[skill:..] [type:..] [tags:..] `` with missing parts left out."""
    label = F.coalesce(F.when(F.length(name) > 0, name), F.when(F.length(title) > 0, title))
    parts = F.concat_ws(
        " ", F.when(label.isNotNull(), F.concat(F.lit("[skill:"), label, F.lit("]"))),
        F.when(F.length(kind) > 0, F.concat(F.lit("[type:"), kind, F.lit("]"))),
        F.when(F.size(tags) > 0, F.concat(F.lit("[tags:"), F.array_join(tags, ","), F.lit("]"))))
    return F.when(F.length(parts) > 0, F.concat(parts, F.lit(" "))).otherwise(F.lit(""))


# ---- principles ------------------------------------------------------------

_MARK = r"(?:[-*]\s+|\d+\.\s+|\*\*.+?\*\*)"


def _item(line: Column) -> Column:
    """(principle, context) of an item line."""
    bold = r"^\*\*(.+?)\*\*\s*[:—–-]?\s*(.*)"
    listed = r"^(?:[-*]|\d+\.)\s+(?:\*?\*?)(.+?)(?:\*?\*?\s*[:—–-]\s*(.+))?$"
    is_bold = line.rlike(r"^\*\*.+?\*\*")
    principle = F.when(is_bold, F.regexp_extract(line, bold, 1)).otherwise(F.regexp_extract(line, listed, 1))
    context = F.when(is_bold, F.regexp_extract(line, bold, 2)).otherwise(F.regexp_extract(line, listed, 2))
    return F.struct(F.trim(F.regexp_replace(principle, r"\*\*", "")).alias("principle"),
                    F.trim(F.regexp_replace(context, r"\*\*", "")).alias("context"))


def principles(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, principle, context).

    Item lines open a principle; following plain lines extend its context until a
    blank line. A text without items yields its first sentence (150 characters)
    and the next 200 characters.
    """
    lines = F.transform(F.split(F.col(text_col), "\n"), trim_all)
    # a separator in front of every item and a stop at every blank line
    tagged = F.array_join(F.transform(lines, lambda s: F.when(s.rlike("^" + _MARK), F.concat(F.lit("\u0001\u0002"), s))
                                      .when(F.length(s) == 0, F.lit("\u0001")).otherwise(s)), "\n")
    blocks = F.filter(F.split(tagged, "\u0001"), lambda b: F.startswith(b, F.lit("\u0002")))
    items = F.transform(blocks, lambda b: F.struct(
        _item(F.regexp_extract(b, "^\u0002([^\\n]*)", 1)).alias("head"),
        F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(b, "^\u0002[^\\n]*\\n?", ""), "\n", " ")), r"\s+$", "").alias("more")))
    trimmed = trim_all(F.col(text_col))
    sentence = F.get(F.split(trimmed, r"[.!?]\s"), F.lit(0))
    short = F.when(F.length(sentence) > 150, F.concat(F.left(sentence, F.lit(147)), F.lit("..."))).otherwise(sentence)
    rest = F.left(trim_all(F.substring(trimmed, F.length(short) + 1, F.length(trimmed))), F.lit(200))
    base = texts.withColumn("_items", items)
    found = F.transform("_items", lambda i: F.struct(
        i["head"]["principle"].alias("principle"), F.trim(F.concat_ws(" ", i["head"]["context"], i["more"])).alias("context")))
    fallback = F.when(F.length(trimmed) > 0, F.array(F.struct(short.alias("principle"), rest.alias("context")))).otherwise(
        F.array().cast("array<struct<principle:string,context:string>>"))
    out = base.select(F.col(id_col), F.posexplode(F.when(F.size("_items") > 0, found).otherwise(fallback)).alias("pos", "p"))
    return out.select(id_col, F.col("pos").cast("bigint").alias("pos"), "p.principle", "p.context")


def principle_topn(found: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """First n principles per query, repeated ones (first 50 characters) skipped."""
    rest = [c for c in found.columns if c not in keys]
    first = (found.groupBy(*keys, F.left(F.lower("principle"), F.lit(50)).alias("_k"))
             .agg(F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("m"))
             .select(*keys, *[F.col(f"m.{c}") for c in rest]))
    w = W.partitionBy(*keys).orderBy(*order)
    return first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


# ---- items for context building --------------------------------------------

# Item bodies that are never guidance.
REJECT = (r"^#+ ", r"^<[a-z]", r"^```", r"^[-─═]{3,}", r"^You are (an? |the )", r"^You help (developers|teams|users)",
          r"^(name|description|origin|version|tags|author):\s+\S", r"^\[!\[", r"^!\[")


def extract_items(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, label, body): blocks cut at headings and blank lines; heading blocks
    and bold bullets carry a label, plain bullets and sentences do not. A block of bold
    bullets without a labelled item is passed over once an earlier block gave one."""
    text = trim_all(F.regexp_replace(F.col(text_col), FRONT, ""))
    blocks = F.filter(F.transform(F.split(text, r"\n(?=#{1,3} )|(?<=\n)\n(?=\S)|\n{3,}"), trim_all), lambda b: F.length(b) > 10)

    def item(label: Column, body: Column) -> Column:
        return F.struct(label.cast("string").alias("label"), body.cast("string").alias("body"))
    none = F.lit(None)
    bold_re = r"(?m)^(?:-|\d+\.)\s+\*\*([^*]+)\*\*\s*[—–:-]?\s*((?s:.*?))(?=\n(?:-|\d+\.)\s+\*\*|\n#{1,3} |$)"

    def cut(b: Column) -> Column:
        heading = F.array(item(F.trim(F.regexp_replace(F.regexp_extract(b, r"^#{1,3}\s+([^\n]+)\n", 1), r"^\*+|\*+$", "")),
                               F.left(trim_all(F.regexp_replace(b, r"^#{1,3}\s+[^\n]+\n", "")), F.lit(300))))
        bold = F.filter(F.transform(F.regexp_extract_all(b, F.lit("(" + bold_re + ")"), 1), lambda m: item(
            F.trim(F.regexp_extract(m, r"\*\*([^*]+)\*\*", 1)),
            F.left(F.trim(F.regexp_replace(F.regexp_replace(m, r"^(?:-|\d+\.)\s+\*\*[^*]+\*\*\s*[—–:-]?\s*", ""), "\n", " ")), F.lit(250)))),
            lambda i: (F.length(i["label"]) > 0) & (F.length(i["body"]) > 0))
        plain = F.transform(F.filter(F.transform(F.split(b, r"\n(?=- )"), lambda p: trim_all(F.regexp_replace(p, "^- ", ""))),
                                     lambda p: F.length(p) > 15), lambda p: item(none, F.left(p, F.lit(250))))
        sentences = F.filter(F.transform(F.split(b, r"(?<=[.!?])\s+(?=[A-Z\"'])"), trim_all),
                             lambda s: (F.length(s) > 30) & ~s.rlike(r"^!?\[!?\["))
        prose = F.when((F.length(b) > 150) & (F.size(sentences) >= 2),
                       F.transform(sentences, lambda s: item(none, F.left(s, F.lit(300))))).otherwise(
            F.array(item(none, F.left(b, F.lit(300)))))
        nothing = F.array().cast("array<struct<label:string,body:string>>")
        is_bold = b.rlike(r"^- \*\*") | b.rlike(r"^\d+\.\s+\*\*")
        titled = b.rlike(r"^#{1,3}\s+[^\n]+\n")
        items = (F.when(titled, heading).when(is_bold & (F.size(bold) > 0), bold)
                 .when(b.rlike("^- "), plain).when(b.rlike(r"^#{1,3} |^```|^<[a-z]"), nothing).otherwise(prose))
        return F.struct(items.alias("items"), (~titled & is_bold & (F.size(bold) == 0)).alias("loose"))

    # a bold block without a labelled item only counts as long as nothing was found before
    found = F.transform(blocks, cut)
    first = F.array_position(F.transform(found, lambda f: F.size(f["items"]) > 0), True)
    found = F.flatten(F.transform(F.filter(found, lambda f, i: ~(f["loose"] & (first > 0) & (i >= first))), lambda f: f["items"]))
    cleaned = F.transform(found, lambda i: F.struct(i["label"].alias("label"), trim_all(F.regexp_replace(F.regexp_replace(
        trim_all(i["body"]), r"(?i)^You should generate:\s*", ""), r"(?i)^Actions:\s*", "")).alias("body")))
    kept = F.filter(cleaned, lambda i: (F.length(i["body"]) >= 20) & ~i["body"].rlike("|".join(REJECT)))
    return texts.select(F.col(id_col), F.posexplode(kept).alias("pos", "i")).select(
        id_col, F.col("pos").cast("bigint").alias("pos"), "i.label", "i.body")


def item_rank(items: DataFrame, words: DataFrame, top: int = 3, order: str = "seq") -> DataFrame:
    """Top items per query: number of query words contained, + 0.5 when labelled."""
    text = F.lower(F.concat(F.coalesce("label", F.lit("")), F.lit(" "), F.col("body")))
    hits = F.size(F.filter("words", lambda w: F.contains(text, w)))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(order))
    return (items.join(words, "query_id")
            .withColumn("score", hits + F.when(F.col("label").isNotNull(), 0.5).otherwise(0.0))
            .withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top))


# ---- extraction from documents ---------------------------------------------

def first_code_block(content: Column) -> Column:
    return trim_all(F.left(F.regexp_extract(content, r"(?s)```\w*\n(.*?)```", 1), F.lit(200)))


def code_exports(content: Column) -> tuple[Column, Column]:
    """(exports, usage): import lists joined (150), first three code lines joined (150)."""
    lists = F.transform(F.regexp_extract_all(content, F.lit(r"import\s+\{([^}]+)\}"), 1), lambda s: F.trim(s))
    exports = F.left(F.array_join(lists, ", "), F.lit(150))
    usage = F.left(F.array_join(F.slice(F.split(first_code_block(content), "\n"), 1, 3), " "), F.lit(150))
    return exports, usage


def enrich_correction(thin: Column, content: Column) -> Column:
    exports, usage = code_exports(content)
    hit = (F.length(exports) > 0) | (F.length(usage) > 0)
    parts = F.concat_ws(" | ", thin, F.when(F.length(exports) > 0, F.concat(F.lit("Key exports: "), exports)),
                        F.when(F.length(usage) > 0, F.concat(F.lit("Usage: "), usage)),
                        F.lit("If unsure, call lookup with a specific question."))
    return F.when(hit, parts).otherwise(thin)


def decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, path, kind, pos, text) of three kinds: up to three decision sections,
    the first ten MUST / SHOULD / SHALL lines, and a GOAL / DELIVERS note."""
    base = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    real = docs.where(~base.rlike("template|example|sample"))
    c = F.col("content")
    adr = F.slice(F.regexp_extract_all(c, F.lit(r"(?is)(##\s*Decision.*?(?=\n##\s|$))"), 1), 1, 3)
    adr_items = F.transform(adr, lambda s, i: F.struct(F.lit("decision").alias("kind"), i.cast("bigint").alias("pos"), F.left(trim_all(s), F.lit(500)).alias("text")))
    rules = F.slice(F.regexp_extract_all(c, F.lit(r"(?m)^(.*\b(?:MUST|SHOULD|SHALL)\b.*)$"), 1), 1, 10)
    rule_items = F.when(F.size(rules) > 0, F.array(F.struct(F.lit("rules").alias("kind"), F.lit(0).cast("bigint").alias("pos"), F.left(F.array_join(rules, "\n"), F.lit(500)).alias("text"))))
    goal = F.regexp_extract(c, r"(?m)^(GOAL:.*)$", 1)
    delivers = F.regexp_extract(c, r"(?m)^(DELIVERS:(?s:.*?))(?=\n(?:NOT DOING|ASSUMPTIONS|##|$))", 1)
    spec_items = F.when(F.length(goal) > 0, F.array(F.struct(F.lit("spec").alias("kind"), F.lit(0).cast("bigint").alias("pos"), F.left(F.concat(goal, F.lit("\n"), delivers), F.lit(500)).alias("text"))))
    nothing = F.array().cast("array<struct<kind:string,pos:bigint,text:string>>")
    every = F.concat(adr_items, F.coalesce(rule_items, nothing), F.coalesce(spec_items, nothing))
    return real.select("doc_id", "path", F.inline(every))


def description(content: Column) -> Column:
    """Inline ``description: x``, else the folded block joined by blanks (200)."""
    inline = F.trim(F.regexp_extract(content, r"(?m)^description:[ \t]+(?!>)(.+)$", 1))
    block = F.regexp_extract(content, r"(?m)^description:[ \t]*>[ \t]*\n((?:[ \t]+[^\n]*\n?)+)", 1)
    folded = F.left(F.array_join(F.filter(F.transform(F.split(block, "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0), " "), F.lit(200))
    unquoted = F.regexp_replace(inline, "^[\"'](.*)[\"']$", "$1")
    return F.coalesce(F.when(F.length(unquoted) > 0, unquoted), F.when(F.length(folded) > 0, folded))


def record_clean(rows: DataFrame, id_col: str) -> DataFrame:
    """Trim every string, empty strings and lists become null; ``rejected`` marks rows with nothing left."""
    fields = [f for f in rows.schema.fields if f.name != id_col]

    def clean(name: str, kind: str) -> Column:
        if kind == "string":
            return F.nullif(F.trim(F.col(name)), F.lit(""))
        return F.when(F.size(name) > 0, F.col(name)) if kind.startswith("array") else F.col(name)
    cleaned = [clean(f.name, f.dataType.simpleString()).alias(f.name) for f in fields]
    out = rows.select(id_col, *cleaned)
    empty = F.lit(True)
    for f in fields:
        empty = empty & F.col(f.name).isNull()
    return out.withColumn("rejected", empty.cast("int"))
