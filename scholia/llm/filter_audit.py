"""Which filter of a chain removes what, in every order: an audit from failing-id relations.

One table of row keys is stored for each filter: the rows that fail it. Labels are stored
the same way: the rows that hold one. Everything else is a join of these relations:

* the rows of a filter that are left after a prefix (a set of filters applied before) are
  its relation left-anti joined with the relations of that prefix; these it removes,
* its other rows are redundant there; those left after all others fail it alone,
* the labels lost are the relation left-semi joined with that of the label,
* the survivors are the rows that no filter of the prefix has removed.

What a filter removes depends on the set before it, not on its order, so 2^(n-1) prefixes
a filter are enough for all n! orders. A row meets its prefixes after the one shuffle by
row key, where both sides of the anti-join lie, so nothing else is shuffled but counts.

Row keys are made here, one a row, because ids may be null or repeated.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions.scale import scratch_path

#: A null part is reported under this name.
NO_PART = ""
_WORD_BREAK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _WORD_BREAK), lambda w: w != "")


def short(text: Column, least: int = 100) -> Column:
    """Under ``least`` words."""
    return F.size(words_of(text)) < least


def repetitive(text: Column, percent: int = 80) -> Column:
    """Fewer different words than ``percent`` in a hundred."""
    words = words_of(text)
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * percent


def shouting(text: Column, percent: int = 10) -> Column:
    """More capitals A to Z than ``percent`` in a hundred characters."""
    return F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") * 100 > F.char_length(text).cast("bigint") * percent


def marked_up(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Filters that look at one text, by the letter they have in an order. E looks at the table.
TEXT_FILTERS = {"A": short, "B": repetitive, "C": shouting, "D": marked_up}
DUPLICATE = "E"
FILTERS = "ABCDE"


@dataclass
class Relations:
    """Row keys as tables: ``rows(row, part)``, and ``marks(row, part, mark)`` with one
    partition of files for each filter and label."""

    rows: DataFrame
    marks: DataFrame

    def failing(self, name: str) -> DataFrame:
        """The failing-id relation of a filter, or the relation of a label."""
        return self.marks.where(F.col("mark") == name).select("row", "part")


def _failing_texts(text: Column) -> Column:
    """Names of the filters that a text fails."""
    named = [F.when(fails(text), F.lit(name)) for name, fails in TEXT_FILTERS.items()]
    return F.filter(F.array(*named), lambda name: name.isNotNull())


def store_relations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                    label_cols: tuple[str, ...] = ("quality", "toxic")) -> Relations:
    """Read the texts once and store all relations in the shared folder.

    A null text is empty, a null part is ``NO_PART``. A row is a duplicate when a smaller id
    has the same text (by SHA-256); rows with a null id are none and make none. A label
    counts for an id when any row of ``labels`` has a 1 for it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = scratch_path(spark, "filter-rows")
    (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit(NO_PART)).alias("part"), text.alias("text"))
     .select(F.monotonically_increasing_id().alias("row"), "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _failing_texts(F.col("text")).alias("fails"))
     .write.parquet(path))
    rows = spark.read.parquet(path)

    # the first row of a text is the one that does not fail; no text is gathered in one task
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"))
    later = rows.where("id is not null").select("row", "part", "id", "digest").join(first, ["digest", "id"], "left_anti")
    marks = (rows.select("row", "part", F.explode("fails").alias("mark"))
             .unionByName(later.select("row", "part", F.lit(DUPLICATE).alias("mark"))))
    for label in label_cols:
        holders = labels.where(F.col(label) == 1).select(F.col(id_col).alias("id")).where("id is not null").distinct()
        marks = marks.unionByName(rows.select("row", "part", "id").join(holders, "id", "left_semi").select("row", "part", F.lit(label).alias("mark")))
    stored = scratch_path(spark, "filter-relations")
    marks.write.partitionBy("mark").parquet(stored)
    return Relations(rows.select("row", "part"), spark.read.schema("row bigint, part string, mark string").parquet(stored))


def prefixes(name: str, filters: str = FILTERS) -> list[str]:
    """All sets of other filters, each written in alphabetical order."""
    others = sorted(set(filters) - {name})
    return ["".join(c) for k in range(len(others) + 1) for c in combinations(others, k)]


def removed_after(relations: Relations, filters: str = FILTERS, label_cols: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """(part, filter, prefix, what, n): rows a filter removes after a prefix, of all rows
    (``what`` is ``all``) and of those that hold a label. Combinations without rows are absent."""
    mine, theirs = relations.marks.where(F.col("mark").isin(*filters)), relations.marks.where(F.col("mark").isin(*filters))
    labelled = [mine.join(relations.failing(label).select("row"), "row", "left_semi").withColumn("what", F.lit(label)) for label in label_cols]
    asked = mine.withColumn("what", F.lit("all"))
    for rows in labelled:
        asked = asked.unionByName(rows)
    by_filter = F.create_map(*[x for name in filters for x in (F.lit(name), F.array(*[F.lit(p) for p in prefixes(name, filters)]))])
    # dealt out by row first; the prefixes are made behind that shuffle
    before = asked.repartition("row").select("row", "part", F.col("mark").alias("filter"), "what", F.explode(by_filter[F.col("mark")]).alias("prefix"))
    gone = theirs.select("row", F.col("mark").alias("earlier")).repartition("row")
    left = before.join(gone, (before["row"] == gone["row"]) & F.contains(before["prefix"], gone["earlier"]), "left_anti")
    return left.groupBy("part", "filter", "prefix", "what").agg(F.count(F.lit(1)).alias("n"))


def audit(relations: Relations, filters: str = FILTERS, label_cols: tuple[str, ...] = ("quality", "toxic"), lost: tuple[str, ...] = ("good_lost", "toxic_lost")) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    part, filter_order, step, kept, removed, redundant, unique_fails, one column of ``lost``
    per label, shapley (rows the step's filter removes, summed over all orders).
    """
    n, names = len(filters), ("removed", *lost)
    counts = removed_after(relations, filters, label_cols).groupBy("part", "filter", "prefix").agg(
        *[F.coalesce(F.max(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(name) for what, name in zip(("all", *label_cols), names, strict=True)])
    # a filter has 2^(n-1) prefixes at most, so the map has a bound
    orders_with = F.factorial(F.length("prefix")) * F.factorial(F.lit(n - 1) - F.length("prefix"))
    cells = counts.groupBy("part", "filter").agg(F.map_from_entries(F.collect_list(F.struct("prefix", F.struct(*names)))).alias("cells"),
                                                 F.sum(F.col("removed") * orders_with).alias("shapley"))
    orders = " ".join("".join(p) for p in permutations(filters))
    steps = (relations.rows.groupBy("part").agg(F.count(F.lit(1)).alias("docs"))
             .select("part", "docs", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
             .withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
             .withColumn("prefix", _sorted(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
             .withColumn("others", _sorted(F.regexp_replace("filter_order", F.col("filter"), F.lit("")))))
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in names])
    found = steps.join(cells, ["part", "filter"], "left").select(
        "*", *[F.coalesce(F.col("cells")[F.col(key)], none).alias(as_) for key, as_ in (("prefix", "here"), ("others", "alone"))],
        F.coalesce(F.col("cells")[F.lit("")], none).alias("first"))
    so_far = W.partitionBy("part", "filter_order").orderBy("step")
    return found.select(
        "part", "filter_order", "step", (F.col("docs") - F.sum("here.removed").over(so_far)).alias("kept"), F.col("here.removed").alias("removed"),
        (F.col("first.removed") - F.col("here.removed")).alias("redundant"), F.col("alone.removed").alias("unique_fails"),
        *[F.col(f"here.{c}").alias(c) for c in lost], F.coalesce("shapley", F.lit(0)).alias("shapley"))


def _sorted(letters: Column) -> Column:
    return F.array_join(F.array_sort(F.split(letters, "")), "")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the five filters by part of the documents, see :func:`audit`.

    Repeated rows are rows of their own, other columns are ignored, an empty table has no
    parts and gives an empty result.
    """
    return audit(store_relations(docs, labels, id_col, text_col, part_col))
