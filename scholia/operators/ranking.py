"""Query expansion, rank fusion, re-ranking, sibling expansion, conflict resolution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions.scale import broadcast_within, cut, dealt, hot_join
from scholia.functions.text import NEEDLES, contained_in, keywords, literal_array, phrases_in_texts, records, tokens
from scholia.operators import lexical, vectors

# Fixed values of the search chain.
RRF_K = 60
ORIGINAL_WEIGHT = 2
EXPANDED_WEIGHT = 1
CANDIDATES = 20
MIN_SCORE = 0.5
LIMIT = 5
GRAPH_EDGE_TYPES = ("see-also", "applies-to", "extends")
PRINCIPLED = ("framework", "core_principles", "pitfalls", "anti_patterns", "content", "guidelines")
SCORE_FLOORS = {
    "framework": 0.27, "core_principles": 0.27, "pitfalls": 0.27, "anti_patterns": 0.27,
    "content": 0.29, "guidelines": 0.29,
    "summary": 0.38, "overview": 0.38,
    "case_studies": 0.40, "examples": 0.40, "strengths_to_praise": 0.40,
}
DEFAULT_FLOOR = 0.35

#: Hits that may be broadcast to the chunks; more are joined in a shuffle.
HITS = 500_000
#: Neighbours of a name that travel in one text, and what stands between them.
PACKED = 256
SEPARATOR = "\x1f"


# ---- query side ------------------------------------------------------------

def query_keywords(queries: DataFrame) -> DataFrame:
    """One row per keyword occurrence: (query_id, pos, keyword)."""
    return queries.select("query_id", F.posexplode(keywords("query")).alias("pos", "keyword"))


def expand(queries: DataFrame) -> DataFrame:
    """(query_id, variant, query): variant 0 is the query itself, 1..3 the rewrites
    that differ from it; a query without keywords keeps only variant 0."""
    base = queries.select("query_id", "query", F.array_join(keywords("query"), " ").alias("kw"))
    options = records(["variant", "text"], [
        (0, F.col("query")), (1, F.col("kw")),
        (2, F.concat(F.lit("best practices for "), "kw")), (3, F.concat(F.lit("how to "), "kw"))])
    return (base.select("query_id", "query", "kw", F.inline(options))
            .where("variant = 0 or (kw <> '' and text <> query)")
            .select("query_id", "variant", F.col("text").alias("query")))


def decompose(tasks: DataFrame, cap: int = 8) -> DataFrame:
    """(query_id, pos, part): the task, its parts, its word phrases; distinct, first 8."""
    t = F.col("query")
    parts = F.slice(F.filter(F.transform(F.split(t, r"(?i)\s+(?:and|with|using|via|plus|,)\s+"), lambda s: F.trim(s)),
                             lambda p: (F.length(p) > 4) & (p != t)), 1, 5)
    phrases = F.regexp_extract_all(t, F.lit("(?i)((?:[a-z]+ ){1,3}[a-z]+)"), 1)
    every = F.slice(F.array_distinct(F.concat(F.array(t), parts, phrases)), 1, cap)
    return tasks.select("query_id", F.posexplode(every).alias("pos", "part"))


def concepts(queries: DataFrame) -> DataFrame:
    """(query_id, concept): runs of adjacent keyword words of the raw query. Runs of
    one or two words stay together, longer runs are split; distinct per query.

    The runs are cut inside the row: non-keywords become a separator.
    """
    words = F.split(F.lower("query"), r"\s+")
    known = keywords("query")
    marked = F.array_join(F.transform(words, lambda w: F.when(F.array_contains(known, w), w).otherwise(F.lit("\n"))), " ")
    runs = F.filter(F.transform(F.split(marked, r"\s*\n\s*"), lambda s: F.trim(s)), lambda r: F.length(r) > 0)
    split = F.flatten(F.transform(runs, lambda r: F.when(F.size(F.split(r, " ")) <= 2, F.array(r)).otherwise(F.split(r, " "))))
    return queries.select("query_id", F.explode(F.array_distinct(split)).alias("concept"))


# ---- fusion ----------------------------------------------------------------

def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``lists(query_id, list_no, rank, weight, text, chunk_id)``.

    ``rank`` starts at 1. Identity is the text; the chunk shown is the one of the
    first list, and best rank in it, that had the text.
    """
    fused = lists.groupBy("query_id", "text").agg(
        F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 6).alias("score"),
        F.min(F.struct("list_no", "rank", "chunk_id")).alias("first"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("first.list_no"), F.asc("first.rank"))
    return (fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= CANDIDATES)
            .select("query_id", "rank", "score", "text", F.col("first.chunk_id").alias("chunk_id")))


def overlap_score(query: Column, text: Column) -> Column:
    """Offline default scorer: share of the query's distinct keywords found in the text."""
    wanted = F.array_distinct(keywords(query))
    hit = F.size(F.array_intersect(wanted, tokens(text)))
    return F.round(F.when(F.size(wanted) > 0, hit / F.size(wanted)).otherwise(F.lit(0.0)), 6)


def model_score(load_model: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """A pluggable cross-encoder as a column function of (query, text)."""
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load_model()
        for query, text in batches:
            yield pd.Series(model(query.tolist(), text.tolist()), index=query.index, dtype=float)
    return run


def rerank(candidates: DataFrame, queries: DataFrame, min_score: float = MIN_SCORE,
           scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """Replace the score of each candidate, keep those at or above the threshold."""
    scored = (candidates.withColumnRenamed("rank", "rank0").drop("score")
              .join(queries.select("query_id", "query"), "query_id")
              .withColumn("score", scorer(F.col("query"), F.col("text"))).drop("query")
              .where(F.col("score") >= min_score))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank0"))
    return scored.withColumn("rank", F.row_number().over(w)).drop("rank0")


def sibling_expand(results: DataFrame, chunks: DataFrame, limit: int | None = LIMIT,
                   share: float = 0.5) -> DataFrame:
    """Insert the missing siblings of a section when at least ``share`` of it was hit.

    ``results(query_id, rank, score, text, chunk_id)``. Siblings follow the first
    hit of their section in sibling order with 0.95 of its score; texts already
    present are skipped; the limit applies afterwards. Results hold a bounded
    number of rows per query, so the text check runs on a small array per query.
    """
    results = cut(results)
    meta = (chunks.select("chunk_id", "parent_id", "sibling_index", "sibling_count")
            .join(broadcast_within(results.select("chunk_id").distinct(), HITS), "chunk_id", "left_semi"))
    hits = results.join(meta, "chunk_id", "left")
    grouped = (hits.where("parent_id is not null and sibling_count > 1")
               .groupBy("query_id", "parent_id")
               .agg(F.count(F.lit(1)).alias("n"), F.min("sibling_count").alias("total"),
                    F.min(F.struct("rank", "score")).alias("lead")))
    expanded = grouped.where(F.col("n") / F.col("total") >= share).select(
        "query_id", "parent_id", F.col("lead.rank").alias("rank"),
        F.round(F.col("lead.score") * 0.95, 6).alias("score"))
    pool = chunks.select("parent_id", "chunk_id", "text", "sibling_index").join(broadcast_within(cut(expanded), HITS), "parent_id")
    fresh = pool.join(results.select("query_id", "text"), ["query_id", "text"], "left_anti")
    # a text met twice among the inserted rows is kept once, at its first place
    fresh = (fresh.groupBy("query_id", "text")
             .agg(F.min(F.struct("rank", "sibling_index", "chunk_id", "score")).alias("m"))
             .select("query_id", "text", "m.*").withColumn("expanded", F.lit(1)))
    both = (results.select("query_id", "text", "rank", F.lit(-1).alias("sibling_index"),
                           "chunk_id", "score", F.lit(0).alias("expanded"))
            .unionByName(fresh))
    w = W.partitionBy("query_id").orderBy("rank", "expanded", "sibling_index", "chunk_id")
    out = both.withColumn("pos", F.row_number().over(w))
    if limit is not None:
        out = out.where(F.col("pos") <= limit)
    return out.select("query_id", F.col("pos").alias("rank"), "score", "text", "chunk_id", "expanded")


def threshold_limit(results: DataFrame, min_score: float = MIN_SCORE, limit: int = LIMIT) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("rank")
    return (results.where(F.col("score") >= min_score)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit))


def display_scores(results: DataFrame) -> DataFrame:
    """round(100 / rank) unless a display score is already set."""
    shown = F.round(F.lit(100.0) / F.col("rank")).cast("bigint")
    if "display_score" in results.columns:
        shown = F.coalesce("display_score", shown)
    return results.withColumn("display_score", shown)


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunk; they are few, so they travel and no text is shuffled.
    Made once, as a query may read them several times and each would read all chunks."""
    found = chunks.join(broadcast_within(cut(hits), HITS), "chunk_id")
    return cut(found.select(*hits.columns, *[c for c in chunks.columns if c not in hits.columns]))


def leg_lists(chunks: DataFrame, queries: DataFrame, chunk_vectors: DataFrame | None = None,
              use_vectors: bool = True, k: int = CANDIDATES, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Ranked lists of every query variant: vector leg 2v, lexical leg 2v + 1.

    Variants are numbered 10 * query_id + variant so that all queries and variants
    run through each leg together. With a stored ``index`` (``sinks.read_index``) postings
    and vectors come from there, else both are made from the chunks. The hits are few, so
    they travel to the chunks and no text is shuffled.
    """
    variants = expand(queries).withColumn("qv", F.col("query_id") * 10 + F.col("variant"))
    asked = variants.select(F.col("qv").alias("query_id"), "query")
    lex = (lexical.bm25_index_topk(index, asked, k) if index else lexical.bm25_topk(chunks, asked, k)).select("query_id", "chunk_id", "rank", F.lit(1).alias("leg"))
    legs = lex
    if use_vectors:
        if chunk_vectors is None and index:
            chunk_vectors = index["vectors"]
        if chunk_vectors is None:
            chunk_vectors = vectors.embed_hashed(chunks.select("chunk_id", "text")).select("chunk_id", "embedding")
        near = vectors.knn_topk(
            vectors.embed_hashed(asked, "query", "qvec").select("query_id", "qvec"),
            chunk_vectors.select(F.col("chunk_id").alias("item_id"), F.col("embedding").alias("ivec")), k)
        legs = legs.unionByName(near.select("query_id", F.col("item_id").alias("chunk_id"), "rank", F.lit(0).alias("leg")))
    variant = F.pmod(F.col("query_id"), F.lit(10))
    return (chunks.select("chunk_id", "text").join(broadcast_within(cut(legs), HITS), "chunk_id")
            .select(F.floor(F.col("query_id") / 10).cast("bigint").alias("query_id"),
                    (variant * 2 + F.col("leg")).alias("list_no"), "rank",
                    F.when(variant == 0, ORIGINAL_WEIGHT).otherwise(EXPANDED_WEIGHT).alias("weight"),
                    "text", "chunk_id"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, min_score: float = MIN_SCORE, limit: int = LIMIT,
                  chunk_vectors: DataFrame | None = None, scorer=overlap_score, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """The whole chain for many queries: expand, two legs, fuse, re-rank, floor,
    siblings, limit, display."""
    fused = rrf(leg_lists(chunks, queries, chunk_vectors, index=index))
    ranked = rerank(fused, queries, min_score, scorer)
    return display_scores(sibling_expand(ranked, chunks, limit))


def graph_append(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Append 1-hop neighbours over three edge types not already present, score 0.

    ``results(query_id, rank, name, score)``, ranks are whole numbers. Each neighbour once per
    query, at its first discovery: result rank, then edge order.

    The neighbours of a name travel to its queries as packed texts of bounded size and are
    taken apart where a query is, beside its own names. The edge order decides only where
    names of one rank bring a neighbour by different types; it is looked up for those.
    """
    def code(name: str, kind: Column) -> Column:
        return F.concat(kind, F.replace(F.replace(F.col(name), F.lit("\x1e"), F.lit("\x1e0")), F.lit("\x1f"), F.lit("\x1e1")))
    # the traversal fixes one edge per (node, neighbour) first: the earliest
    both = (edges.select(F.col("src").alias("name"), F.col("dst").alias("neighbour"), "type", "ord")
            .unionByName(edges.select(F.col("dst").alias("name"), F.col("src").alias("neighbour"), "type", "ord")))
    first_edge = (both.join(results.select("name").distinct(), "name", "left_semi")
                  .where("name <> neighbour")
                  .groupBy("name", "neighbour").agg(F.min_by("type", "ord").alias("type"), F.min("ord").alias("ord"))
                  .where(F.col("type").isin(*GRAPH_EDGE_TYPES)))
    types = F.array(*[F.lit(t) for t in GRAPH_EDGE_TYPES])
    piece = F.floor((F.row_number().over(W.partitionBy("name").orderBy("neighbour")) - 1) / PACKED)
    near = cut(first_edge.withColumn("piece", piece).groupBy("name", "piece")
               .agg(F.array_sort(F.collect_list(F.struct(code("neighbour", F.array_position(types, F.col("type")).cast("string")).alias("p"), "ord"))).alias("held"))
               .select("name", F.array_join("held.p", SEPARATOR).alias("packed"), F.col("held.ord").alias("ords")))
    degree = near.agg(F.sum(F.size("ords")) / F.count_distinct("name")).first()[0] or 0
    # a name without a rank is found first
    ranked = results.where("name is not null").select("query_id", F.coalesce(F.col("rank").cast("bigint"), F.lit(-(1 << 50))).alias("rank"), "name")
    own = F.when(F.col("query_id").isNotNull(), code("name", F.lit("0")))
    sent = ranked.join(near.select("name", "packed"), "name", "left").select("query_id", "rank", F.concat_ws(SEPARATOR, own, "packed").alias("packed"))
    rows = (dealt(sent, int(ranked.count() * (degree + 1)), "query_id")
            .select("query_id", "rank", F.explode(F.split("packed", SEPARATOR, -1)).alias("p")).where("p <> ''"))
    kind = F.left("p", F.lit(1)).cast("int")
    place = [F.when(kind == 0, -(1 << 54)).otherwise(F.col("rank") * 4 + k) for k in (kind, 4 - kind)]
    # the least rank with the first and with the last of its types
    found = (rows.groupBy("query_id", F.substring("p", 2, (1 << 31) - 1).alias("p")).agg(F.min(place[0]).alias("low"), F.min(place[1]).alias("high"))
             .where(F.col("low") > -(1 << 54)).withColumns({"low": F.pmod("low", F.lit(4)).cast("int"), "high": (4 - F.pmod("high", F.lit(4))).cast("int")}))
    open_ = found.where("low <> high").select(F.col("query_id").alias("q"), "p")
    at = F.array_position(F.transform(F.split("packed", SEPARATOR, -1), lambda x: F.substring(x, 2, (1 << 31) - 1)), F.col("p")).cast("int")
    told = (ranked.join(open_, F.col("query_id").eqNullSafe(F.col("q"))).join(near, "name").withColumn("at", at).where("at > 0")
            .groupBy("query_id", "p").agg(F.min(F.struct("rank", F.get("ords", F.col("at") - 1).alias("ord"), F.left(F.get(F.split("packed", SEPARATOR, -1), F.col("at") - 1), F.lit(1)).cast("int").alias("low"))).alias("m"))
            .select("query_id", "p", F.col("m.low").alias("low")))
    linked = found.where("low = high").select("query_id", "p", "low").unionByName(told)
    name = F.replace(F.replace(F.col("p"), F.lit("\x1e1"), F.lit("\x1f")), F.lit("\x1e0"), F.lit("\x1e"))
    return (results.select("query_id", "name", "score", F.lit("result").alias("origin"), F.lit(None).cast("string").alias("edge_type"))
            .unionByName(linked.select("query_id", name.alias("name"), F.lit(0.0).alias("score"), F.lit("graph").alias("origin"),
                                       F.get(types, F.col("low") - 1).alias("edge_type"))))


# ---- grouping and filters --------------------------------------------------

def fingerprint_dedup(results: DataFrame, keys: list[str] | None = None, order: str = "rank") -> DataFrame:
    """First row per (name, type, first 60 characters); pre-aggregated map-side."""
    keys = (keys or []) + ["name", "type"]
    rest = [c for c in results.columns if c not in keys]
    return (results.groupBy(*keys, F.left("text", F.lit(60)).alias("_fp"))
            .agg(F.min(F.struct(F.col(order).alias("_o"), *rest)).alias("m"))
            .select(*keys, *[F.col(f"m.{c}") for c in rest]))


def floor_of(kind: Column) -> Column:
    out = F.lit(DEFAULT_FLOOR)
    for name, floor in SCORE_FLOORS.items():
        out = F.when(kind == name, F.lit(floor)).otherwise(out)
    return out


def type_floors(results: DataFrame) -> DataFrame:
    return results.where(F.col("score") >= floor_of(F.col("type")))


def best_per_group(results: DataFrame) -> DataFrame:
    """One chunk per (query, name): principled types first, then score, then order."""
    rest = [c for c in results.columns if c not in ("query_id", "name")]
    principled = F.col("type").isin(*PRINCIPLED).cast("int")
    return (results.groupBy("query_id", "name")
            .agg(F.min(F.struct((-principled).alias("_p"), (-F.col("score")).alias("_s"), F.col("rank").alias("_r"), *rest)).alias("m"))
            .select("query_id", "name", *[F.col(f"m.{c}") for c in rest]))


def conflict_resolve(items: DataFrame, keys: list[str]) -> DataFrame:
    """Resolve items competing for one topic.

    ``items(*keys, name, topic?, specificity?, score?, stars?)``. Per topic the
    order is specificity, score, stars, name. A runner-up two specificity points or
    0.2 score behind is suppressed, any other opens one conflict for the topic. The
    best is a winner when it beat someone or no conflict names it.
    Only the best row per topic is shuffled back to its rivals: no sorted group.
    """
    full = items.select(
        *keys, "name",
        F.coalesce(F.col("topic"), F.col("name"), F.lit("unknown")).alias("topic"),
        F.coalesce(F.col("specificity"), F.lit(5)).alias("specificity"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("stars"), F.lit(0)).alias("stars"))
    order = F.struct((-F.col("specificity")).alias("a"), (-F.col("score")).alias("b"), (-F.col("stars")).alias("c"), F.col("name").alias("best_name"))
    best = full.groupBy(*keys, "topic").agg(F.min(order).alias("o")).select(
        *keys, "topic", F.col("o.best_name").alias("best_name"),
        (-F.col("o.a")).alias("best_spec"), (-F.col("o.b")).alias("best_score"))
    compared = full.join(best, [*keys, "topic"])
    is_best = F.col("name") == F.col("best_name")
    clear_spec = F.col("best_spec") - F.col("specificity") >= 2
    clear_score = F.round(F.col("best_score") - F.col("score"), 6) >= 0.2
    compared = compared.withColumn("role", F.when(is_best, "best").when(clear_spec | clear_score, "suppressed").otherwise("contender"))
    flags = compared.groupBy(*keys, "topic").agg(
        F.max((F.col("role") == "suppressed").cast("int")).alias("beat"),
        F.max((F.col("role") == "contender").cast("int")).alias("tied"))
    reason = (F.when(clear_spec, F.concat(F.lit("more specific ("), F.col("best_spec").cast("int"), F.lit(" vs "), F.col("specificity").cast("int"), F.lit(")")))
              .otherwise(F.lit("higher relevance")))
    return (compared.join(flags, [*keys, "topic"])
            .select(*keys, "topic", "name", "specificity", "score", "stars",
                    F.when(F.col("role") == "best",
                           F.when((F.col("beat") == 1) | (F.col("tied") == 0), "winner").otherwise("conflict"))
                    .when(F.col("role") == "suppressed", "suppressed").otherwise("conflict").alias("decision"),
                    F.when(F.col("role") == "suppressed", reason).alias("reason"),
                    F.col("tied").alias("in_conflict"), "best_name"))


def auto_conflict(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Unattended mode: the top option of each conflict wins, the rest are listed as rejected.

    One row per conflict of :func:`conflict_resolve`: ``chosen``, its ``decision`` and
    ``reason``, and ``rejected_names``, all other options of the topic in the order of the
    options, also those that were suppressed; with their number and specificity.
    """
    other = F.col("name") != F.col("best_name")
    option = F.struct((-F.col("specificity")).alias("a"), (-F.col("score")).alias("b"), (-F.col("stars")).alias("c"), "name")
    return (resolved.where("in_conflict = 1").groupBy(*keys, "topic", F.col("best_name").alias("chosen"))
            .agg(F.count_if(other).alias("rejected"),
                 F.sum(F.when(other, F.col("specificity")).otherwise(0)).cast("bigint").alias("rejected_specificity"),
                 F.array_sort(F.collect_list(F.when(other, option)))["name"].alias("rejected_names"),
                 F.max(F.when(~other, F.col("specificity"))).alias("_top"))
            .select(*keys, "topic", "chosen", F.lit("auto-conflict").alias("decision"),
                    F.concat(F.lit("auto-resolved: highest specificity ("), F.col("_top").cast("int"), F.lit(")")).alias("reason"),
                    "rejected_names", "rejected", "rejected_specificity"))


def priority_merge(tiers: DataFrame, enough: int = 2) -> DataFrame:
    """``tiers(query_id, tier, pos, item)`` with tiers gap, team, niche: niche rows
    survive only where the other two hold fewer than ``enough``."""
    strong = (tiers.where("tier <> 'niche'").groupBy("query_id")
              .agg(F.count(F.lit(1)).alias("strong")))
    return (tiers.join(strong, "query_id", "left")
            .where((F.col("tier") != "niche") | (F.coalesce("strong", F.lit(0)) < enough))
            .drop("strong"))


def source_filter(results: DataFrame, source: str = "all") -> DataFrame:
    if source == "knowledge":
        return results.where("node_kind = 'knowledge'")
    if source in ("skills", "expert"):
        return results.where("coalesce(node_kind, '') <> 'knowledge'")
    return results


def role_filter(catalog: DataFrame, role: str) -> DataFrame:
    """Rows open to every role (null list) or to this one."""
    return catalog.where(F.col("roles").isNull() | F.array_contains("roles", F.lit(role)))


def role_fanout(catalog: DataFrame, triggers: dict[str, list[str]]) -> DataFrame:
    """(trigger, role, skills): rows per role for each trigger's role list."""
    pairs = [(t, r) for t, roles in triggers.items() for r in roles]
    wanted = F.explode(F.array(*[F.struct(F.lit(t).alias("trigger"), F.lit(r).alias("role")) for t, r in pairs]))
    return (catalog.select("name", "roles", wanted.alias("w"))
            .where(F.col("roles").isNull() | F.array_contains("roles", F.col("w.role")))
            .groupBy(F.col("w.trigger").alias("trigger"), F.col("w.role").alias("role"))
            .agg(F.count(F.lit(1)).alias("skills")))


def keyword_fallback(queries: DataFrame, results: DataFrame, catalog: DataFrame,
                     threshold: float = 0.4) -> DataFrame:
    """Catalog rows for queries whose best hit is weak, minus names already returned.

    A row matches when a trigger keyword is contained in the query or shares a word
    with it, its name contains the query, or its description contains a query word.
    Rows without keywords never match. All three containment tests run as equi-joins
    on text pieces over distinct values, not as a nested loop; joins on a word are salted
    by query, since a word may be in every query.
    """
    best = results.groupBy("query_id").agg(F.max("score").alias("best"))
    # read by every test, so it is made once
    weak = cut(queries.join(best, "query_id", "left")
               .where(F.coalesce("best", F.lit(0.0)) < threshold)
               .select("query_id", F.lower("query").alias("q")))
    usable = catalog.where(F.col("keywords").isNotNull() & (F.size("keywords") > 0))
    trig = usable.select("name", F.explode("keywords").alias("k")).select("name", F.lower("k").alias("k"))
    words = weak.select("query_id", F.explode(F.array_distinct(F.filter(F.split("q", r"\s+"), lambda w: F.length(w) > 2))).alias("w"))

    in_query = phrases_in_texts(trig, weak, "k", "q")
    a = trig.join(in_query, "k").join(weak, "q").select("query_id", "name")
    trig_words = trig.select("name", F.explode(F.split("k", r"\s+")).alias("w"))
    b = hot_join(words, trig_words, "w", "query_id").select("query_id", "name").distinct()
    names = usable.select("name", F.lower("name").alias("ln"))
    c = weak.join(contained_in(weak, names, "q", "ln"), "q").join(names, "ln").select("query_id", "name")
    desc = usable.select("name", F.lower(F.coalesce("description", F.lit(""))).alias("d"))
    held = phrases_in_texts(words, desc, "w", "d").join(desc, "d").select("w", "name").distinct()
    d = hot_join(words, held, "w", "query_id").select("query_id", "name").distinct()
    found = a.unionByName(b).unionByName(c).unionByName(d).distinct()
    return found.join(results.select("query_id", "name").distinct(), ["query_id", "name"], "left_anti")


def group_results(results: DataFrame) -> DataFrame:
    """Hits grouped by source and section title in first-seen order, numbered 1..n.

    ``results(query_id, rank, name, title, text)`` hold a bounded list per query.
    """
    kept = results.where(F.length(F.trim("text")) > 0)
    groups = kept.groupBy("query_id", "name", "title").agg(
        F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("bullets"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.trim("text").alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    w = W.partitionBy("query_id").orderBy("first_rank")
    return groups.withColumn("idx", F.row_number().over(w)).drop("first_rank")


def majority_type(results: DataFrame) -> DataFrame:
    """Most frequent source type per query; ties go to the one seen first."""
    counted = (results.where("source_type is not null").groupBy("query_id", "source_type")
               .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")))
    return counted.groupBy("query_id").agg(
        F.min(F.struct((-F.col("n")).alias("c"), "first", "source_type")).alias("m")).select(
        "query_id", F.col("m.source_type").alias("source_type"), (-F.col("m.c")).alias("n"))


def route(tasks: DataFrame, catalog: DataFrame, conflicts: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Primary, secondary and third catalog row per task.

    +2 per contained keyword, -3 per contained anti-keyword, +3 for a language match,
    -5 for a mismatch; needs a positive score and one keyword hit. Keywords meet task
    texts through an equi-join on pieces of distinct texts, so only rows with a
    keyword hit are ever formed. They are formed, scored and cut to three for each
    different text and language, in the task that has the words of the text: no
    candidate is shuffled, and a row of ``tasks`` meets three names at most.
    """
    t = tasks.select("task_id", F.lower("task").alias("task"), F.coalesce("language", F.lit("")).alias("language"))
    kw = catalog.select("name", F.explode("keywords").alias("k"), F.lit(1).alias("hit"))
    anti = catalog.select("name", F.explode("anti_keywords").alias("k"), F.lit(0).alias("hit"))
    marks = kw.unionByName(anti)
    texts = t.select("task", "language").distinct()
    words = phrases_in_texts(marks.select("k"), texts, "k", "task").repartition("task")
    hits = (words.join(broadcast_within(marks, NEEDLES), "k").groupBy("task", "name")
            .agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("anti")).where("hits > 0"))
    bonus = (F.when((F.col("language") != "") & F.array_contains("languages", F.col("language")), 3.0)
             .when((F.col("language") != "") & (F.size("languages") > 0), -5.0).otherwise(0.0))
    scored = (hits.join(broadcast_within(catalog.select("name", "languages"), NEEDLES), "name").join(texts.repartition("task"), "task")
              .withColumn("score", F.col("hits") * 2.0 - F.col("anti") * 3.0 + bonus)
              .where("score > 0"))
    w = W.partitionBy("task", "language").orderBy(F.desc("score"), F.asc("name"))
    top = (scored.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("task", "language")
           .agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "name")).alias("top")))
    best = (t.join(top, ["task", "language"]).groupBy("task_id")
            .agg(F.array_sort(F.flatten(F.collect_list("top"))).alias("top")))

    def at(n):
        return F.get(F.col("top"), F.lit(n - 1))["name"]
    out = best.select("task_id", at(1).alias("primary"), at(2).alias("secondary"), at(3).alias("third"))
    note = F.lit(None).cast("string")
    for a, b, text in conflicts or []:
        hit = ((F.col("primary") == a) & (F.col("secondary") == b)) | ((F.col("primary") == b) & (F.col("secondary") == a))
        note = F.when(hit, F.lit(text)).otherwise(note)
    return out.withColumn("conflict_note", note)


def any_word(text: Column, words: list[str]) -> Column:
    return F.exists(literal_array(words), lambda w: F.contains(text, w))


def intent_class(texts: DataFrame, review_words: list[str], classes: list[tuple[str, list[list[str]]]],
                 default: str = "general", text_col: str = "text") -> DataFrame:
    """Review intent and first matching class; a class needs a hit in each of its groups."""
    t = F.lower(F.col(text_col))
    chosen = F.lit(default)
    for name, groups in reversed(classes):
        ok = F.lit(True)
        for words in groups:
            ok = ok & any_word(t, words)
        chosen = F.when(ok, F.lit(name)).otherwise(chosen)
    review = any_word(t, review_words)
    return texts.withColumn("review", review.cast("int")).withColumn("klass", F.when(review, chosen))
