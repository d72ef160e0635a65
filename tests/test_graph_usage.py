import random

from conftest import rows
from pyspark.sql import functions as F

from scholia.functions.scale import broadcast_within, has_at_most, hot_join, number_rows, salted_join
from scholia.functions.text import contained_in, phrases_in_texts
from scholia.operators import graph, usage

EDGE = "src string, dst string, type string, weight double, created string, ord bigint"


def edges(spark, items):
    return spark.createDataFrame([(s, d, t, 1.0, "2024-01-01", n) for n, (s, d, t) in enumerate(items)], EDGE)


def sequential_bfs(items, start, hops):
    seen, queue, out = {start}, [(start, 0)], []
    while queue:
        node, hop = queue.pop(0)
        if hop >= hops:
            continue
        for s, d, t in items:
            if node in (s, d):
                other = d if s == node else s
                if other not in seen:
                    seen.add(other)
                    out.append((start, other, hop + 1, t, s, d))
                    queue.append((other, hop + 1))
    return out


def test_bfs_equals_queue(spark):
    rnd = random.Random(2)
    items = [(rnd.choice("abcdefghij"), rnd.choice("abcdefghij"), rnd.choice(graph.EDGE_TYPES)) for _ in range(25)]
    df = edges(spark, items)
    for hops in (1, 2, 3):
        got = rows(graph.bfs_hops(df, spark.createDataFrame([("a",), ("d",)], "id string"), hops))
        want = sorted(sequential_bfs(items, "a", hops) + sequential_bfs(items, "d", hops), key=repr)
        assert got == want


def test_two_shortest_paths_take_the_first_edge(spark):
    df = edges(spark, [("s", "x", "extends"), ("s", "y", "see-also"), ("y", "z", "implements"), ("x", "z", "supersedes")])
    got = {r["id"]: r["type"] for r in graph.bfs_hops(df, spark.createDataFrame([("s",)], "id string")).collect()}
    assert got["z"] == "supersedes"


def test_lineage_long_chain_and_cycle(spark):
    chain = [(i + 1, i) for i in range(37)] + [(50, 10), (100, 101), (101, 100)]
    df = spark.createDataFrame(chain, "child bigint, parent bigint")
    got = {r["id"]: (r["root"], r["depth"]) for r in graph.lineage(df).collect()}
    assert got[37] == (0, 37) and got[50] == (0, 11) and got[0] == (0, 0) and 100 not in got
    clean = df.where("child < 100")
    path = [r["node"] for r in graph.lineage_paths(clean, spark.createDataFrame([(50,)], "id bigint")).orderBy("pos").collect()]
    assert path == list(range(11)) + [50]


def test_crawl_least_depth(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 5)], "src bigint, dst bigint")
    assert rows(graph.crawl_frontier(links, spark.createDataFrame([(1,)], "id bigint"), 2)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 5, 2)]


def test_parse_links(spark):
    df = spark.createDataFrame([(1, "a:b:see-also,plain, c : extends")], "id int, arg string")
    assert [(r["target"], r["type"]) for r in graph.parse_links(df, "id", "arg").orderBy("pos").collect()] == [("a:b", "see-also"), ("c", "extends")]


def test_contained_in_equals_brute_force(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    needles = list({word(rnd.randint(1, 9)).strip() for _ in range(60)} - {""})
    hays = list({word(rnd.randint(1, 14)) for _ in range(80)})
    n, h = spark.createDataFrame([(x,) for x in needles], "n string"), spark.createDataFrame([(x,) for x in hays], "h string")
    want = sorted(((a, b) for a in needles for b in hays if a in b), key=repr)
    assert rows(contained_in(n, h, "n", "h")) == want
    assert rows(phrases_in_texts(n, h, "n", "h")) == want


NODES = "id string, type string, title string, tags array<string>, body string"


def test_autolink(spark):
    nodes = spark.createDataFrame([
        ("c1", "component", "Auth Service", [], ""), ("c2", "component", "Billing", [], ""), ("n1", "note", "Login tokens", ["authz"], "x"),
        ("n2", "note", "Login flow", [], "the billing page"), ("n3", "note", "Login errors", [], ""), ("n4", "note", "Login retries", [], ""), ("n5", "note", "Login limits", [], "")], NODES)
    comps = nodes.where("type = 'component'")
    none = edges(spark, [("n5", "n1", "see-also")])
    assert rows(graph.autolink_components(nodes.where("type <> 'component'"), comps, none).select("src", "dst")) == [("n1", "c1"), ("n2", "c2")]
    assert rows(graph.autolink_reverse(comps, nodes, none).select("src", "dst")) == [("n2", "c2")]
    comp = graph.autolink_components(nodes.where("type <> 'component'"), comps, none)
    got = rows(graph.autolink_titles(nodes, none, comp).select("src", "dst"))
    # n1 and n2 hold one component link each, n5 is already joined with n1
    assert [d for s, d in got if s == "n1"] == ["n2", "n3"] and [d for s, d in got if s == "n2"] == ["n1", "n3"]
    assert [d for s, d in got if s == "n5"] == ["n2", "n3", "n4"] and [d for s, d in got if s == "n3"] == ["n1", "n2", "n4"]


def test_resolve_ref(spark):
    nodes = spark.createDataFrame([("n1", "note", "Alpha One", [], ""), ("n2", "note", "Alpha Two", [], "")], NODES)
    refs = spark.createDataFrame([("n1",), ("alpha",), ("TWO",), ("zzz",)], "ref string")
    got = {r["ref"]: (r["status"], r["id"], r["matches"]) for r in graph.resolve_ref(refs, nodes).collect()}
    assert got == {"n1": ("exact", "n1", 1), "alpha": ("ambiguous", None, 2), "TWO": ("unique", "n2", 1), "zzz": ("none", None, 0)}


def test_glob_owners(spark):
    files = spark.createDataFrame([("src/api/a.ts",), ("src/b.py",), ("top.ts",)], "path string")
    globs = spark.createDataFrame([("x", "src/**"), ("y", "*.ts"), ("z", "**/api/*"), ("w", "src/?.py")], "id string, glob string")
    assert rows(graph.owning_components(files, globs)) == [("src/api/a.ts", "x"), ("src/api/a.ts", "y"), ("src/api/a.ts", "z"), ("src/b.py", "w"), ("src/b.py", "x"), ("top.ts", "y")]


def test_edge_append_rejects_unknown_types(spark, tmp_path):
    bad = spark.createDataFrame([("a", "b", "extends", None, "2024-01-01", 1), ("a", "c", "likes", 1.0, "2024-01-01", 2)], EDGE)
    graph.append_edges(bad, f"{tmp_path}/edges", f"{tmp_path}/rejects")
    graph.append_edges(bad, f"{tmp_path}/edges", f"{tmp_path}/rejects")
    good = spark.read.json(f"{tmp_path}/edges").collect()
    assert [(r["dst"], r["weight"]) for r in good] == [("b", 1.0)] * 2 and spark.read.json(f"{tmp_path}/rejects").count() == 2


def test_number_rows_with_a_hot_key(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "id")
    got = number_rows(df, ["k"], [F.desc("id")])
    want = df.selectExpr("k", "id", "row_number() OVER (PARTITION BY k ORDER BY id DESC) AS n")
    assert rows(got.select("k", "id", F.col("n").cast("int"))) == rows(want)


def test_usage_summary_rules(spark):
    use = spark.sql("select 'a' name, timestamp'2024-03-01 00:00:00' ts union all select 'a', timestamp'2024-03-02 00:00:00' union all select 'b', timestamp'2023-01-01 00:00:00'")
    inst = spark.sql("""select 'a' name, timestamp'2023-01-01 00:00:00' installed_at union all select 'b', timestamp'2024-03-19 00:00:00' union all select 'c', timestamp'2024-01-01 00:00:00'
                        union all select 'd', timestamp'2024-03-01 00:00:00' union all select 'e', timestamp'2024-03-15 00:00:00'""")
    got = {r["name"]: (r["suggestion"], r["days_since"]) for r in usage.usage_summary(use, inst, "2024-03-20 00:00:00").collect()}
    assert got == {"a": (None, 18), "b": ("low-activity", 444), "c": ("remove", None), "d": ("low-activity", None), "e": (None, None)}
    assert [r["name"] for r in usage.healthy_first(usage.usage_summary(use, inst, "2024-03-20 00:00:00")).collect()][:2] == ["a", "e"]


def test_levels(spark):
    got = [r["level"] for r in usage.mention_levels(spark.createDataFrame([(1,), (3,), (5,), (10,)], "mentions int")).orderBy("mentions").collect()]
    assert got == [1, 2, 3, 4]


def test_retention_moves_rows(spark, tmp_path):
    s = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-03-01 00:00:00")], "session_id bigint, ts string")
    plan = usage.session_retention(s, "2024-04-15 00:00:00", 90)
    usage.apply_retention(s, plan, f"{tmp_path}/keep", f"{tmp_path}/old")
    assert rows(spark.read.parquet(f"{tmp_path}/keep").select("session_id")) == [(2,)] and rows(spark.read.parquet(f"{tmp_path}/old").select("session_id")) == [(1,)]


def test_session_merge_reports_missing(spark):
    s = spark.createDataFrame([(1, "g", "", "main")], "session_id bigint, goal string, progress string, branch string")
    g = spark.createDataFrame([("out", 0, 2), ("out", 1, 1)], "output_id string, pos int, session_id bigint")
    r = usage.session_merge(g, s).first()
    assert r["members"] == "2, 1" and r["missing"] == 1 and "<progress>Unknown</progress><branch>main</branch>" in r["body"]


def test_salted_join_with_a_hot_key(spark):
    big = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 40) END AS k", "id")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, v int")
    want = rows(big.join(small, "k").select("k", "id", "v"))
    for salts in (1, 2, 32):
        assert rows(salted_join(big, small, "k", "id", salts).select("k", "id", "v")) == want
    assert rows(salted_join(big, small.select("k").distinct(), "k", "id", 8, "left_semi").select("k", "id")) == rows(big.join(small, "k", "left_semi"))


def test_broadcast_only_within_the_checked_size(spark):
    df = spark.range(10)
    assert has_at_most(df, 10) and not has_at_most(df, 9)
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan(broadcast_within(df, 10))
    assert "ResolvedHint" not in plan(broadcast_within(df, 9))


def test_overlapping_sets_against_all_pairs(spark):
    import random
    rng = random.Random(6)
    tags = [f"t{i}" for i in range(12)]
    left = [(f"n{i}", [*rng.choices(tags, k=rng.randrange(6)), "all", *(["most"] if i % 4 else [])]) for i in range(70)] + [("e", []), ("null", None), ("gap", [None, "all", "t1"])]
    right = [(f"c{i}", [*rng.choices(tags, k=rng.randrange(6)), "all"]) for i in range(50)]
    a = spark.createDataFrame(left, "id string, tags array<string>")
    b = spark.createDataFrame(right, "name string, tags array<string>")
    for least in (1, 2, 3):
        want = sorted((x, y, tuple(sorted(set(s or []) & set(t) - {None}))) for x, s in left for y, t in right if len(set(s or []) & set(t) - {None}) >= least)
        got = sorted((r.id, r.name, tuple(r.shared)) for r in graph.overlapping(a, b, least).collect())
        assert got == want


def test_a_tag_of_every_row_forms_no_pairs(spark):
    n = 400
    a = spark.range(n).selectExpr("concat('n', id) AS id", "array('all', concat('a', id)) AS tags")
    b = spark.range(n).selectExpr("concat('c', id) AS name", "array('all', concat('b', id), concat('a', id div 200)) AS tags")
    assert {(r.id, len(r.shared)) for r in graph.overlapping(a, b).collect()} == {("n0", 2), ("n1", 2)}


def test_a_side_that_is_large_with_its_repeats_is_not_broadcast(spark, tmp_path):
    spark.range(200_000).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/small")
    big, small = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("x")), spark.read.parquet(f"{tmp_path}/small")
    joined = salted_join(big, small, "k", "x", salts=32)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 10


def test_tags_of_every_catalog_row_link(spark, data):
    from scholia import plans
    shared = {r.shared for r in plans.load()[0]["autolink_tags"](spark, data).select("shared").distinct().collect()}
    assert any("promo" in s.split(",") for s in shared)


def test_concept_intersection_shuffles_no_activation_and_takes_many_concepts(spark):
    import re
    names = [f"word{n:03d}" for n in range(130)]
    concepts = spark.createDataFrame([(1, c) for c in names] + [(2, names[0]), (2, names[129]), (3, names[5]), (None, names[0]), (None, names[1])], "query_id long, concept string")
    nodes = spark.createDataFrame([("a", " ".join(names[::3])), ("b", names[1]), ("c", f"{names[0]} {names[129]}"), ("d", "none"), (None, f"{names[0]} {names[129]}")], "id string, title string") \
        .selectExpr("id", "'note' AS type", "title", "cast(array() AS array<string>) AS tags", "'' AS body")
    edges = spark.createDataFrame([("b", "d"), ("c", "d")], "src string, dst string").selectExpr("src", "dst", "'see-also' AS type", "1L AS ord")
    got = graph.concept_intersection(concepts, nodes, edges)
    ends = f"{names[0]},{names[129]}"
    reached = [("a", 44, ",".join(names[::3])), ("c", 2, ends), (None, 2, ends), ("d", 3, f"{names[0]},{names[1]},{names[129]}")]
    both = [("a", 2, ends), ("c", 2, ends), ("d", 2, ends), (None, 2, ends)]
    assert rows(got) == sorted([(1, *r) for r in reached] + [(2, *r) for r in both], key=repr)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", got._jdf.queryExecution().executedPlan().toString())


def test_context_sends_a_seed_in_one_row(spark):
    rnd = random.Random(9)
    items = [(rnd.choice("abcdefghijklmnop"), rnd.choice("abcdefghijklmnop"), "see-also") for _ in range(40)]
    owners = [(f"f{i}", rnd.choice("abcdefghijklmnop")) for i in range(6)]
    hits = [(f"f{rnd.randrange(9)}", rnd.choice("abcdefghijklmnop"), rnd.choice([0.2, 0.35, 0.5, 0.9])) for _ in range(20)]
    hits += [(None, "a", 0.9), ("f1", None, 0.8)]
    near = lambda x: {b for a, b in [*[(s, d) for s, d, _ in items], *[(d, s) for s, d, _ in items]] if a == x and b != x}
    best = {}
    for path, seed, score in [*[(p, i, None) for p, i in owners], *[h for h in hits if h[2] >= 0.35]]:
        found = [(seed, score)] if score else []
        if seed:
            one = near(seed)
            found += [(x, 0.5) for x in one] + [(x, 0.25) for y in one for x in near(y) - one - {seed}]
        for i, s in found:
            best[path, i] = max(s, best.get((path, i), 0))
    want = []
    for path in {p for p, _ in best}:
        order = sorted(((i, s) for (p, i), s in best.items() if p == path), key=lambda x: (-x[1], x[0] or ""))
        want += [(path, i, s, n + 1) for n, (i, s) in enumerate(order[:8])]
    got = graph.graph_context(spark.createDataFrame(owners, "path string, id string"), spark.createDataFrame(hits, "path string, id string, score double"), edges(spark, items))
    assert rows(got.select("path", "id", "score", "rank")) == sorted(want, key=repr)
    # two shuffles by file, of its own rows and of what the seeds bring; no row for each node that a seed brings
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("RepartitionByExpression [path")


def test_only_hot_keys_are_repeated(spark):
    """Inner and semi join as without salt; what the small side has for other keys comes once."""
    big = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id % 40) END AS k", "id")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4), (None, 5)], "k string, v int")
    for bound in (100, 10_000):
        joined = hot_join(big, small, "k", "id", hot_rows=bound)
        assert rows(joined.select("k", "id", "v")) == rows(big.join(small, "k").select("k", "id", "v"))
        assert rows(hot_join(big, small.select("k").distinct(), "k", "id", "left_semi", bound).select("k", "id")) == rows(big.join(small, "k", "left_semi"))
        assert ("_salt" in joined._jdf.queryExecution().optimizedPlan().toString()) == (bound == 100)


def test_pieces_without_a_needle_stay_where_they_are(spark, monkeypatch):
    """A needle list that is too long for a broadcast: the pieces pass a bitmap of the needles first."""
    from scholia.functions import text
    monkeypatch.setattr(text, "NEEDLES", 10)
    n = spark.range(600).selectExpr("concat('lib', id * 7) AS n")
    h = spark.range(400).selectExpr("concat('import lib', id, '.make;') AS h")
    want = sorted({(f"lib{i * 7}", f"import lib{j}.make;") for i in range(600) for j in range(400) if f"lib{i * 7}" in f"import lib{j}.make;"}, key=repr)
    for gram in (6, 32):
        assert rows(contained_in(n, h, "n", "h", gram)) == want
    pieces = spark.range(100_000).selectExpr("concat('x', id) AS _key")
    keys = spark.range(0, 100_000, 100).selectExpr("concat('x', id) AS _key")
    kept = text._marked(pieces, keys, "_key")
    assert kept.join(keys, "_key", "left_semi").count() == 1000 and kept.count() < 20_000


def test_few_concepts_travel_to_what_they_reach(spark):
    nodes = spark.createDataFrame([("a", "red fox", "", []), ("b", "owl", "", [])], "id string, title string, body string, tags array<string>")
    edges = spark.createDataFrame([("a", "b", "extends", 1)], "src string, dst string, type string, ord int")
    lit = graph.activate(spark.createDataFrame([(1, "red"), (1, "red"), (2, "owl")], "query_id int, concept string"), nodes, edges)
    assert rows(lit) == [(1, "red", "a"), (1, "red", "b"), (2, "owl", "a"), (2, "owl", "b")]
    assert "BroadcastHashJoin [concept#" in lit._jdf.queryExecution().executedPlan().toString()
