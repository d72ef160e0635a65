"""Column builders for text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.scale import has_at_most, salted_join

# needle lists up to this many rows are broadcast
NEEDLES = 200_000
#: Bits of the bitmap of a longer list, at most.
MOST_BITS = 1 << 26

# The stop list of the query expander.
STOPWORDS = (
    "a", "an", "the", "in", "on", "at", "to", "for", "of", "and", "or", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "shall", "should", "may", "might", "must", "can", "could", "not", "no", "nor", "so", "yet", "both", "with",
    "about", "from", "up", "down", "out", "how", "what", "when", "where", "who", "why", "which", "by", "as", "if", "then", "than", "too", "very",
    "just", "more", "also", "its", "it",
)


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of [a-z0-9] with at least two characters."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def keywords(text: Column | str) -> Column:
    """Tokens without stop words; repeats are kept."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS))


def lines(text: Column | str) -> Column:
    """Trimmed non-blank lines in order."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(col, "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def words_of(name: Column, longer_than: int) -> Column:
    """Words of a title: split on blanks, hyphens, underscores; lower-case."""
    return F.filter(F.split(F.lower(name), r"[\s\-_]+"), lambda w: F.length(w) > longer_than)


def joined(values: Column, sep: str = ",") -> Column:
    """A sorted distinct array as one string, for comparable output."""
    return F.array_join(F.array_sort(F.array_distinct(values)), sep)


def glob_tokens(glob: Column) -> Column:
    """A path glob cut into wildcards and the literal text between them."""
    return F.regexp_extract_all(glob, F.lit(r"(\*\*|\*|\?|[^*?]+)"), 1)


def glob_regex(glob: Column) -> Column:
    """Regex text for a path glob: ``**`` crosses folders, ``*`` and ``?`` stay inside one.
    Literal text is quoted as a whole."""
    def piece(token: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), F.replace(token, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        return F.when(token == "**", ".*").when(token == "*", "[^/]*").when(token == "?", "[^/]").otherwise(quoted)
    return F.concat(F.lit("^"), F.array_join(F.transform(glob_tokens(glob), piece), ""), F.lit("$"))


def glob_matches(paths: DataFrame, globs: DataFrame, by_name: bool = False) -> DataFrame:
    """Distinct (path, glob) pairs that match, from ``paths(path)`` and ``globs(glob)``;
    with ``by_name`` a glob without a slash is held against the base name.

    A reverse index: a glob is looked up under the rarest of its literal segments, a path
    under each segment it has, so a glob without a leading folder meets no more paths than
    one with it. A glob whose literal text is only part of a segment (``test*``) is looked
    up under the segments that contain the text, and one without any literal text, of which
    there are few different ones, is tried on every path in its row. What meets is verified.
    """
    g = globs.select("glob").where("glob is not null").distinct().withColumn("rx", glob_regex(F.col("glob")))
    whole = F.filter(F.split("glob", "/"), lambda s: (s != "") & ~s.rlike(r"[*?]"))
    parts = F.filter(F.split("glob", r"[/*?]+"), lambda s: s != "")
    g = g.withColumn("whole", F.array_distinct(whole)).withColumn("part", F.array_max(F.transform(parts, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"])
    p = paths.select("path").where("path is not null").distinct()
    held = p.select("path", F.explode(F.array_distinct(F.filter(F.split("path", "/"), lambda s: s != ""))).alias("key"))

    def matches(glob: Column, rx: Column) -> Column:
        name = F.regexp_extract("path", r"([^/]*)$", 1)
        return F.rlike(F.when(F.contains(glob, F.lit("/")), F.col("path")).otherwise(name) if by_name else F.col("path"), rx)

    # a segment that no path has cannot match, so its glob drops out here
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    wanted = g.where(F.size("whole") > 0).select("glob", "rx", F.size("whole").alias("need"), F.explode("whole").alias("key"))
    rarest = (wanted.join(counts, "key").groupBy("glob", "rx", "need").agg(F.min(F.struct("n", "key")).alias("m"), F.count(F.lit(1)).alias("has"))
              .where("has = need").select("glob", "rx", F.col("m.key").alias("key")))
    by_part = g.where((F.size("whole") == 0) & F.col("part").isNotNull())
    inside = contained_in(by_part, counts, "part", "key").join(by_part.select("glob", "rx", "part"), "part").select("glob", "rx", "key")
    met = salted_join(held, rarest.unionByName(inside), "key", "path").where(matches(F.col("glob"), F.col("rx"))).select("path", "glob").distinct()

    free = g.where(F.col("part").isNull()).agg(F.collect_list(F.struct("glob", "rx")).alias("free"))
    always = p.join(F.broadcast(free)).select("path", F.explode(F.filter("free", lambda f: matches(f["glob"], f["rx"]))).alias("f"))
    return met.unionByName(always.select("path", F.col("f.glob").alias("glob")))


def contained_in(needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str,
                 gram: int = 6) -> DataFrame:
    """Distinct (needle, haystack) pairs where the needle is a substring.

    An equi-join instead of a nested loop: every needle is looked up under its
    first ``min(length, gram)`` characters, every haystack offers the pieces of the
    lengths in use, and a long needle is verified afterwards. Both sides are made
    distinct first, so a hot value costs one row, not one per document. A needle
    list of known small size is broadcast, then no piece is shuffled; of a longer list
    a bitmap is, so that nearly all pieces without a needle stay where they are.
    """
    left = (needles.select(F.col(needle).alias("_n")).where(F.length("_n") > 0).distinct()
            .withColumn("_key", F.left(F.col("_n"), F.lit(gram))))
    sizes = [r[0] for r in left.select(F.length("_key")).distinct().collect()]
    if not sizes:
        return left.select(F.col("_n").alias(needle), F.lit(None).cast("string").alias(haystack)).limit(0)
    pieces = ("flatten(transform(array({s}), n -> transform(sequence(1, greatest(length(_h) - n + 1, 1)), "
              "i -> substring(_h, i, n))))").format(s=", ".join(str(n) for n in sorted(sizes)))
    right = (haystacks.select(F.col(haystack).alias("_h")).where(F.length("_h") > 0).distinct()
             .withColumn("_key", F.explode(F.array_distinct(F.expr(pieces)))))
    if has_at_most(left, NEEDLES):
        left = F.broadcast(left)
    else:
        right = _marked(right, left, "_key")
    return (right.join(left, "_key").where(F.contains("_h", "_n"))
            .select(F.col("_n").alias(needle), F.col("_h").alias(haystack)))


def _marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is marked in a bitmap of the keys: all that are among them, and few
    others. It has eight bits a key or more up to MOST_BITS in all, and is broadcast as words of 64."""
    bits = min(MOST_BITS, 1 << max(10, (8 * keys.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    words = (keys.select(place.alias("_b")).groupBy(F.shiftright("_b", 6).alias("_w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 AS int))")).alias("_m")))
    return (rows.withColumn("_b", place).withColumn("_w", F.shiftright("_b", 6)).join(F.broadcast(words), "_w")
            .where("shiftright(_m, cast(_b & 63 AS int)) & 1 = 1").drop("_b", "_w", "_m"))


def phrases_in_texts(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """Like :func:`contained_in` for longer texts: a needle without blanks lies in one
    blank-separated token, so it is matched against the distinct tokens first."""
    one_word = ~F.col(needle).rlike(r"\s")
    tokens_of = (texts.select(F.col(text).alias("_t")).distinct()
                 .select("_t", F.explode(F.array_distinct(F.split("_t", r"\s+"))).alias("_w")).where("_w <> ''"))
    words = contained_in(needles.where(one_word), tokens_of, needle, "_w")
    by_word = tokens_of.join(words, "_w").select(F.col(needle), F.col("_t").alias(text)).distinct()
    return by_word.unionByName(contained_in(needles.where(~one_word), texts, needle, text))


#: Bits of a chunk number that count the lines of one document.
LINE_BITS = 27


def chunk_number(doc_id: Column | str, pos: Column | str) -> Column:
    """One number for a line of a document; a document with more lines fails the job."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    fits = F.when(pos < (1 << LINE_BITS), pos).otherwise(F.raise_error(F.lit("a document has more than 2^27 lines")).cast("int"))
    return (F.col(doc_id) if isinstance(doc_id, str) else doc_id) * F.lit(1 << LINE_BITS) + fits


def document_of(chunk_id: Column | str) -> Column:
    return F.shiftright(chunk_id, LINE_BITS)


def records(names: list[str], rows: list[tuple]) -> Column:
    """An array of equally named structs, for ``inline``."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)
    return F.array(*[F.struct(*[lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
