"""Typed knowledge graph: traversal, reference resolution, automatic linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from scholia.functions.scale import broadcast_within, cut, dealt, has_at_most, hot_join, salted_join
from scholia.functions.text import contained_in, glob_matches, words_of

# The closed set of edge types.
EDGE_TYPES = ("implements", "contradicts", "extends", "applies-to", "see-also", "inspired-by", "supersedes", "depends-on")


#: Concepts of all queries that may be broadcast; concepts in one number.
PAIRS = 200_000
BITS = 60


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, neighbour, type, ord, src, dst) for each direction of an edge."""
    fwd = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "type", "ord", "src", "dst")
    return fwd.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "type", "ord", "src", "dst"))


def valid_edges(edges: DataFrame) -> DataFrame:
    """Split marker for an append: type known, weight and date defaulted."""
    return (edges.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
            .withColumn("accepted", F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False))))


def append_edges(edges: DataFrame, path: str, rejects: str) -> None:
    """Append accepted edges as JSON lines; the others go to a reject folder."""
    marked = valid_edges(edges)
    marked.where("accepted").drop("accepted").write.mode("append").json(path)
    marked.where("not accepted").drop("accepted").write.mode("append").json(rejects)


# ---- traversal -------------------------------------------------------------

def _walk(step: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Breadth-first from many seeds at once: (seed, id, hop, path, type, src, dst).

    ``path`` is the list of edge orders that led here, so its order is the queue
    order of a breadth-first search. Edges of a hub node are salted by neighbour.
    """
    seen = seeds.select(F.col("id").alias("seed"), F.col("id")).distinct()
    frontier = seen.select("seed", F.col("id").alias("node"), F.array().cast(T.ArrayType(step.schema["ord"].dataType)).alias("path"))
    found = None
    for hop in range(1, hops + 1):
        reached = (salted_join(step, frontier, "node", "neighbour")
                   .groupBy("seed", F.col("neighbour").alias("id"))
                   .agg(F.min(F.struct(F.concat("path", F.array("ord")).alias("path"), "type", "src", "dst")).alias("m"))
                   .join(seen, ["seed", "id"], "left_anti")
                   .select("seed", "id", F.lit(hop).alias("hop"), "m.path", "m.type", "m.src", "m.dst"))
        if hop < hops:
            reached = cut(reached)
            seen = seen.unionByName(reached.select("seed", "id"))
            frontier = reached.select("seed", F.col("id").alias("node"), "path")
        found = reached if found is None else found.unionByName(reached)
    return found


def bfs_hops(edges: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """Undirected; each node once per seed at its least hop with the first edge."""
    return _walk(both_ways(edges), seeds, max_hops).drop("path")


def crawl_frontier(links: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, id, depth) over directed links, each page at its least depth."""
    step = links.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"),
                        F.lit(0).cast("bigint").alias("ord"), F.lit("link").alias("type"), "src", "dst")
    walked = _walk(step, seeds, depth).select("seed", "id", F.col("hop").alias("depth"))
    return walked.unionByName(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct())


def lineage(parents: DataFrame) -> DataFrame:
    """(id, root, depth) for every child and parent by pointer doubling.

    Round k settles every node up to depth 2^k, so the number of rounds is the
    logarithm of the longest chain. A round that settles nothing leaves only nodes
    on or above a cycle; they have no root and are left out.
    """
    up = parents.select(F.col("child").alias("id"), F.col("parent").alias("jump")).distinct()
    open_ = cut(up.withColumn("len", F.lit(1).cast("bigint")))
    roots = cut(open_.select(F.col("jump").alias("id")).distinct().join(open_.select("id"), "id", "left_anti"))
    target = roots.select(F.col("id").alias("jump"))
    done = roots.select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"))
    jumps = open_
    while True:
        hit = cut(open_.join(target, "jump", "left_semi").select("id", F.col("jump").alias("root"), F.col("len").alias("depth")))
        if hit.isEmpty():
            return done
        done = done.unionByName(hit)
        rest = open_.join(target, "jump", "left_anti")
        nxt = jumps.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("len").alias("len2"))
        # a jump target that is already settled keeps its own jump to the root
        doubled = cut(rest.join(nxt, "jump").select("id", F.col("jump2").alias("jump"), (F.col("len") + F.col("len2")).alias("len")))
        jumps = cut(doubled.unionByName(jumps.join(doubled.select("id"), "id", "left_anti")))
        open_ = doubled


def lineage_paths(parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, pos, node): root-to-node chain of each wanted id, root at pos 0.

    Grows the covered part of every chain by doubling: logarithmic rounds, one row
    per chain member.
    """
    placed = cut(lineage(parents))
    jumps = cut(parents.select(F.col("child").alias("node"), F.col("parent").alias("jump")).distinct())
    # an id whose chain ends in a cycle has no path
    have = wanted.join(placed, "id", "left_semi").select("id", F.col("id").alias("node"), F.lit(0).cast("bigint").alias("back"))
    span = 1
    while True:
        more = have.join(jumps, "node").select("id", F.col("jump").alias("node"), (F.col("back") + span).alias("back"))
        more = cut(more)
        if more.isEmpty():
            break
        have = cut(have.unionByName(more))
        nxt = jumps.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"))
        jumps = cut(jumps.join(nxt, "jump").select("node", F.col("jump2").alias("jump")))
        span *= 2
    depth = placed.select("id", "depth")
    return have.join(depth, "id").select("id", (F.col("depth") - F.col("back")).alias("pos"), "node")


# ---- references ------------------------------------------------------------

def resolve_ref(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, status, id, matches): exact id, else unique title substring, else none
    or ambiguous. Titles are compared as distinct values."""
    r = refs.select("ref").distinct()
    exact = r.join(nodes.select(F.col("id").alias("ref")), "ref", "left_semi").withColumn("exact", F.lit(1))
    lowered = r.select("ref", F.lower("ref").alias("n"))
    titles = nodes.select("id", F.lower(F.coalesce("title", F.lit(""))).alias("t"))
    pairs = contained_in(lowered, titles, "n", "t")
    per_title = titles.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    hits = (lowered.join(pairs.join(per_title, "t"), "n").groupBy("ref")
            .agg(F.sum("c").alias("matches"), F.min("first").alias("first")))
    return (r.join(exact, "ref", "left").join(hits, "ref", "left")
            .select("ref",
                    F.when(F.col("exact") == 1, "exact").when(F.col("matches") == 1, "unique")
                    .when(F.col("matches") > 1, "ambiguous").otherwise("none").alias("status"),
                    F.when(F.col("exact") == 1, F.col("ref")).when(F.col("matches") == 1, F.col("first")).alias("id"),
                    F.when(F.col("exact") == 1, 1).otherwise(F.coalesce("matches", F.lit(0))).cast("bigint").alias("matches")))


def parse_links(rows: DataFrame, id_col: str, arg: str) -> DataFrame:
    """(id, pos, target, type) of ``a:type,b:type``; split on the last colon."""
    parts = F.filter(F.split(arg, ","), lambda p: F.contains(p, F.lit(":")))
    return (rows.select(id_col, F.posexplode(parts).alias("pos", "p"))
            .select(id_col, F.col("pos").cast("bigint").alias("pos"),
                    F.trim(F.regexp_extract("p", r"(?s)^(.*):([^:]*)$", 1)).alias("target"),
                    F.trim(F.regexp_extract("p", r"(?s)^(.*):([^:]*)$", 2)).alias("type")))


def nodes_by_type(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    out = nodes.select("id", "title", "type", F.array_join("tags", ",").alias("tags"))
    return out.where(F.col("type") == kind) if kind else out


# ---- text meets nodes ------------------------------------------------------

def node_text(with_tags: bool = True) -> Column:
    parts = [F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))]
    if with_tags:
        parts.append(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    return F.lower(F.concat_ws(" ", *parts))


def words_in_nodes(words: DataFrame, nodes: DataFrame, with_tags: bool = True) -> DataFrame:
    """Distinct (word, id) where the word is a substring of the node's text.

    A word has no blanks, so it lies inside one blank-separated token: the match is
    made between distinct words and distinct tokens, then spread to the nodes.
    """
    tokens = nodes.select("id", F.explode(F.array_distinct(F.split(node_text(with_tags), r"\s+"))).alias("token")).where("token <> ''")
    pairs = contained_in(words, tokens, "word", "token")
    return salted_join(tokens, pairs, "token", "id").select("word", "id").distinct()


def reached(concepts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (concept, id) of ``concepts(concept)``: nodes holding a concept word of more
    than two letters, plus their direct neighbours. Work is done once per distinct word."""
    words = concepts.select("concept").distinct().select("concept", F.explode(F.split("concept", r"\s+")).alias("word")).where("length(word) > 2")
    hit = cut(words_in_nodes(words.select("word").distinct(), nodes))
    step = cut(both_ways(edges).select("node", "neighbour").distinct())
    near = hot_join(step, hit.withColumnRenamed("id", "node"), "node", "neighbour").select("word", F.col("neighbour").alias("id"))
    return words.join(hit.unionByName(near), "word").select("concept", "id").distinct()


def activate(concepts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, concept, id): the nodes that each concept of a query reaches."""
    pairs = cut(concepts.select("query_id", "concept").distinct())
    lit = reached(pairs, nodes, edges)
    # few pairs travel to the nodes, so that what is reached is neither shuffled again nor sorted
    met = lit.join(F.broadcast(pairs), "concept") if has_at_most(pairs, PAIRS) else salted_join(lit, pairs, "concept", "id")
    return met.select("query_id", "concept", "id")


def concept_intersection(concepts: DataFrame, nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, id, score, matched): nodes activated by at least two concepts.

    The concepts of a query are numbered in their order, and what a node is activated by is a
    set of bits. The concepts travel to the nodes: what reaches a node is in one task before
    it meets the queries, so no activation is shuffled or sorted, and the nodes are dealt
    into so many tasks that each of them counts a bounded number. Concepts beyond PAIRS rows
    are joined in a shuffle.
    """
    many = concepts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).select("query_id")
    pairs = cut(concepts.join(many, "query_id", "left_semi").select("query_id", "concept").distinct())
    numbered = cut(pairs.withColumn("no", F.row_number().over(W.partitionBy("query_id").orderBy("concept")) - 1))
    reach = cut(reached(pairs, nodes, edges))
    asked = numbered.groupBy("concept").agg(F.count(F.lit(1)).alias("q"))
    rows = reach.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).join(asked, "concept").agg(F.sum(F.col("n") * F.col("q"))).first()[0] or 0
    met = (dealt(reach, rows, "id").join(F.broadcast(numbered), "concept") if has_at_most(numbered, PAIRS)
           else salted_join(reach, numbered, "concept", "id"))
    words = range((numbered.agg(F.max("no")).first()[0] or 0) // BITS + 1)
    bits = [F.bit_or(F.when(F.floor(F.col("no") / BITS) == b, F.expr(f"shiftleft(1L, no % {BITS})")).otherwise(F.lit(0).cast("bigint"))).alias(f"b{b}") for b in words]
    found = met.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("score"), *bits).where(F.col("score") >= least)
    own = numbered.groupBy("query_id").agg(F.array_sort(F.collect_list("concept")).alias("own"))
    matched = F.expr(f"filter(own, (c, i) -> (shiftright(array({', '.join(f'b{b}' for b in words)})[cast(i div {BITS} as int)], i % {BITS}) & 1L) = 1L)")
    return found.join(broadcast_within(own, PAIRS), "query_id").select("query_id", "id", "score", F.array_join(matched, ",").alias("matched"))


def owning_components(files: DataFrame, components: DataFrame) -> DataFrame:
    """(path, id) of ``components(id, glob)``."""
    return glob_matches(files, components, by_name=True).join(components, "glob").select("path", "id").distinct()


def graph_context(owners: DataFrame, hits: DataFrame, edges: DataFrame, limit: int = 8, min_score: float = 0.35) -> DataFrame:
    """Top nodes per file from ``owners(path, id)`` and ``hits(path, id, score)``.

    Neighbours of every seed score 0.5 at hop 1 and 0.25 at hop 2, a semantic hit
    keeps its own score, the best score per node wins. A node outside the first
    ``limit`` of a seed's neighbours cannot enter the file's first ``limit``, so
    each seed is cut to that many before it meets the files, and hop 2 is walked
    only from seeds with fewer direct neighbours. What a seed brings travels to its
    files as one row, and is taken apart where a file is.
    """
    good = cut(hits.where(F.col("score") >= min_score).select("path", "id", "score"))
    seeds = cut(owners.select("path", "id").unionByName(good.select("path", "id")).distinct())
    distinct = seeds.select("id").distinct()
    step = cut(both_ways(edges).select("node", "neighbour").distinct())
    hop1 = cut(hot_join(step, distinct.withColumnRenamed("id", "node"), "node", "neighbour")
               .where("node <> neighbour").select(F.col("node").alias("seed"), F.col("neighbour").alias("id")).distinct())
    few = hop1.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit).select("seed")
    thin = hop1.join(few, "seed", "left_semi")
    hop2 = (hot_join(step, thin.select("seed", F.col("id").alias("node")), "node", "neighbour")
            .select("seed", F.col("neighbour").alias("id")).where("seed <> id").distinct()
            .join(thin, ["seed", "id"], "left_anti"))
    reach = hop1.withColumn("score", F.lit(0.5)).unionByName(hop2.withColumn("score", F.lit(0.25)))
    ws = W.partitionBy("seed").orderBy(F.desc("score"), F.asc("id"))
    near = reach.withColumn("r", F.row_number().over(ws)).where(F.col("r") <= limit).drop("r")
    brought = near.groupBy("seed").agg(F.collect_list(F.struct("score", "id")).alias("near"))
    sent = (good.select("path", F.array(F.struct("score", "id")).alias("near"))
            .unionByName(seeds.withColumnRenamed("id", "seed").join(brought, "seed").select("path", "near")))
    every = sent.repartition("path").select("path", F.inline("near"))
    best = every.groupBy("path", "id").agg(F.max("score").alias("score"))
    w = W.partitionBy("path").orderBy(F.desc("score"), F.asc("id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


# ---- automatic links -------------------------------------------------------

def pair_key(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def without_existing(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop links whose ends are already joined in either direction."""
    known = edges.select(*pair_key("src", "dst")).distinct()
    return (links.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})
            .join(known, ["lo", "hi"], "left_anti").drop("lo", "hi"))


def autolink_components(new_nodes: DataFrame, components: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, type): a new node applies to every component whose name word
    (over two letters) occurs in its title, content or tags."""
    words = components.select(F.col("id").alias("comp"), F.explode(F.array_distinct(words_of(F.col("title"), 2))).alias("word"))
    hit = words_in_nodes(words.select("word").distinct(), new_nodes)
    links = (salted_join(hit, words, "word", "id").where("id <> comp")
             .select(F.col("id").alias("src"), F.col("comp").alias("dst")).distinct())
    return without_existing(links, edges).withColumn("type", F.lit("applies-to"))


def autolink_reverse(components: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A new component is linked from every note whose title or body names it."""
    words = components.select(F.col("id").alias("comp"), F.explode(F.array_distinct(words_of(F.col("title"), 2))).alias("word"))
    hit = words_in_nodes(words.select("word").distinct(), nodes.where("type <> 'component'"), with_tags=False)
    links = (salted_join(hit, words, "word", "id").where("id <> comp")
             .select(F.col("id").alias("src"), F.col("comp").alias("dst")).distinct())
    return without_existing(links, edges).withColumn("type", F.lit("applies-to"))


def autolink_titles(nodes: DataFrame, edges: DataFrame, component_links: DataFrame, cap: int = 3) -> DataFrame:
    """(src, dst, type): see-also between notes sharing a title word of more than
    three letters, in id order, until a node has ``cap`` links, component links
    counted.

    Only itself and already linked nodes can be skipped, so among the nodes of a
    word the first ``cap + 1 + degree`` are enough: a word shared by a third of
    all nodes never pairs them with each other.
    """
    notes = nodes.where("type <> 'component'")
    words = notes.select("id", F.explode(F.array_distinct(words_of(F.col("title"), 3))).alias("word"))
    degree = both_ways(edges).groupBy(F.col("node").alias("id")).agg(F.countDistinct("neighbour").alias("deg"))
    used = component_links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("used"))
    asking = (words.join(degree, "id", "left").join(used, "id", "left")
              .select("id", "word", (F.lit(cap + 1) + F.coalesce("deg", F.lit(0))).alias("need"), F.coalesce("used", F.lit(0)).alias("used"))
              .where(F.col("used") < cap))
    most = asking.agg(F.max("need")).first()[0] or 0
    w = W.partitionBy("word").orderBy("id")
    firsts = (words.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
              .select("word", F.col("id").alias("dst"), "r"))
    pairs = (salted_join(asking, firsts, "word", "id").where("r <= need and id <> dst")
             .select(F.col("id").alias("src"), "dst", "used").distinct())
    fresh = without_existing(pairs, edges)
    wn = W.partitionBy("src").orderBy("dst")
    return (fresh.withColumn("n", F.row_number().over(wn)).where(F.col("n") + F.col("used") <= cap)
            .select("src", "dst", F.lit("see-also").alias("type")))


def overlapping(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """(id, name, shared): rows of ``left(id, tags)`` and ``right(name, tags)`` that share at
    least ``least`` different tags; ids and names are unique.

    A join with a prefix filter: tags are put in one order, the rarest first, and each row
    offers all but its ``least - 1`` most frequent ones. Rows that share enough tags share one
    that both offer, and a tag that everybody has is offered by nobody who has others. A pair
    is formed under the first tag that both offer only, then verified on the whole sets.
    """
    def exploded(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct("tags")).alias("tag")).where("tag is not null")
    a, b = exploded(left, "id"), exploded(right, "name")
    counts = a.select("tag").unionByName(b.select("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))

    def offered(rows: DataFrame, key: str, out: str) -> DataFrame:
        sets = (salted_join(rows, counts, "tag", key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "tag"))).alias("s"))
                .where(F.size("s") >= least).select(key, F.transform("s", lambda x: x["tag"]).alias(out)))
        return sets.withColumn(f"{out}_offers", F.slice(out, F.lit(1), F.size(out) - (least - 1))).withColumn("tag", F.explode(f"{out}_offers"))
    met = offered(a, "id", "ts").join(offered(b, "name", "cs"), "tag")
    shared = F.array_intersect("ts", "cs")
    return (met.where((F.get(F.array_intersect("ts_offers", "cs_offers"), F.lit(0)) == F.col("tag")) & (F.size(shared) >= least))
            .select("id", "name", F.array_sort(shared).alias("shared")))


def autolink_tags(nodes: DataFrame, catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, type, shared): node and catalog row sharing at least two tags; the long
    words of a node's title count as its tags."""
    tags = F.concat(F.coalesce("tags", F.array().cast("array<string>")), words_of(F.col("title"), 3))
    links = overlapping(nodes.select("id", tags.alias("tags")), catalog.select("name", "tags")).select(
        F.col("id").alias("src"), F.col("name").alias("dst"), F.array_join("shared", ",").alias("shared"))
    return without_existing(links, edges).select("src", "dst", F.lit("see-also").alias("type"), "shared")
