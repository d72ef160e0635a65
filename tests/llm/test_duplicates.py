"""Substring, line and near-duplicate operators against sequential versions."""

import random

import pytest
import xxhash

from scholia.llm import components, line_dedup, queries, simhash_ball, substring_dedup
from tests.llm.conftest import DOCS


def without_repeats(docs, window):
    seen, out = set(), []
    for doc, text in sorted(docs):
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out)


def mixed_texts(seed, vocabulary, n=80):
    random.seed(seed)
    pool = [[f"w{random.randrange(vocabulary)}" for _ in range(random.randrange(60))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(random.randrange(4)):
            passage = random.choice(pool)
            at = random.randrange(len(passage) + 1)
            words += passage[at:at + random.randrange(60)] + [f"u{random.randrange(vocabulary * 3)}" for _ in range(random.randrange(20))]
        docs.append((i, " ".join(words if random.random() > 0.1 else ["ha"] * random.randrange(90))))
    return docs


@pytest.mark.parametrize(("vocabulary", "window", "hot"), [(2, 4, 3), (4, 6, 10**9), (30, 20, 3), (30, 20, 10**9)])
def test_substrings_against_a_sequential_version(spark, vocabulary, window, hot):
    docs = mixed_texts(vocabulary + window, vocabulary)
    found = substring_dedup.remove_repeats(spark.createDataFrame(docs, DOCS).repartition(4), window=window, hot_anchor=hot)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()) == without_repeats(docs, window)


def test_substrings_of_edge_rows(spark, edges, empty):
    found = substring_dedup.remove_repeats(edges).collect()
    assert len(found) == edges.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_words == 0
    assert (by_id[8].n_words, by_id[8].n_removed) == (30_000, 29_999)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_shard_keeps_only_first_windows():
    shard = substring_dedup.Shard(3)
    assert shard.new_windows(b"a b c d e") == [(0, 3)]
    assert shard.new_windows(b"a b c d e") == []
    assert shard.new_windows(b"x b c d y") == [(0, 1), (2, 1)]
    assert shard.new_windows(b"z z z z z") == [(0, 1)]


def without_lines(docs, window, long_line):
    lines_seen, runs_seen, out = set(), set(), []
    for doc, text in sorted(docs):
        lines = text.split("\n") if text else []
        held = [(i, s) for i, s in enumerate(line.strip(" \t\r\f\v") for line in lines) if s]
        gone = set()
        for i, s in held:
            if len(s.encode()) >= long_line:
                gone |= {i} if s in lines_seen else set()
                lines_seen.add(s)
        for k in range(len(held) - window + 1):
            key = tuple(s for _, s in held[k:k + window])
            gone |= {i for i, _ in held[k:k + window]} if key in runs_seen else set()
            runs_seen.add(key)
        out.append((doc, len(lines), sorted(gone), "\n".join(line for i, line in enumerate(lines) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("vocabulary", "window", "hot"), [(3, 5, 3), (10, 3, 10**9), (40, 2, 3)])
def test_lines_against_a_sequential_version(spark, vocabulary, window, hot):
    random.seed(vocabulary)
    pool = [f"x{i} " + "y" * random.randrange(12) for i in range(vocabulary)] + ["", " "]
    docs = [(i, "\n".join(random.choice(pool) + random.choice(["", " ", "\t"]) for _ in range(random.randrange(12)))) for i in range(90)]
    found = line_dedup.remove_lines(spark.createDataFrame(docs, DOCS).repartition(4), window=window, long_line=12, hot_hash=hot, out="l")
    assert sorted((r.doc_id, r.l.n_lines, sorted(r.l.removed), r.text) for r in found.collect()) == without_lines(docs, window, 12)


def test_lines_of_edge_rows(spark, edges, empty):
    found = line_dedup.remove_lines(edges)
    assert found.columns == [*edges.columns, "__lines"]
    rows = found.collect()
    assert len(rows) == edges.count()
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert sorted(r.text for r in rows if r.doc_id == 6) == ["same text here"] * 2
    assert line_dedup.remove_lines(empty).count() == 0


def near_groups(docs, radius=4):
    prints = [(d, simhash_ball.majority_bits(simhash_ball.shingle_hashes(t.encode() if t else None))) for d, t in docs]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, f"{p:016x}", min(groups[find(i)])) for i, (d, p) in enumerate(prints))


def test_near_duplicates_against_all_pairs(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op8_simhash(spark, data).collect()) == near_groups(docs)


@pytest.mark.parametrize("group_variants", [1 << 20, 1 << 14])
def test_ball_links_connect_all_near_fingerprints(spark, group_variants):
    random.seed(11)
    prints = {random.getrandbits(64) for _ in range(150)}
    for base in list(prints)[:60]:
        for _ in range(3):
            flipped = base
            for bit in random.sample(range(64), random.randrange(1, 6)):
                flipped ^= 1 << bit
            prints.add(flipped)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash_ball.ball_links(spark.createDataFrame([(v,) for v in signed.values()], "fp bigint"), "fp", 4, group_variants)
    root = {v: v for v in signed.values()}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 4 and find(signed[a]) != find(signed[b]):
                x, y = find(signed[a]), find(signed[b])
                root[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in components.components(links).collect()}
    want = {v: find(v) for v in root}
    many = {r for r in want.values() if list(want.values()).count(r) > 1}
    assert found == {v: r for v, r in want.items() if r in many}


def test_similar_pairs_against_all_pairs(spark):
    random.seed(21)
    docs = []
    for i in range(60):
        words = [f"w{random.randrange(5000)}" for _ in range(random.randrange(4, 300))]
        docs.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            changed = [w if random.random() > 0.01 * k * k else "new" for w in words]
            docs.append((10 * i + k, " ".join(changed)))
    docs += [(1000, docs[0][1]), (1001, None), (1002, ""), (None, docs[0][1])]
    found = {tuple(r) for r in simhash_ball.similar_pairs(spark.createDataFrame(docs, DOCS)).collect()}
    first = {}
    for d, t in docs:
        if d is not None and t:
            first[t] = min(d, first.get(t, d))
    sets = {d: set(simhash_ball.shingle_hashes(t.encode(), 5).tolist()) for t, d in first.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert found <= want and len(found) >= 0.9 * len(want) and len(want) > 40


def test_views_follow_the_number_of_texts():
    bits = [simhash_ball.bits_for(n) for n in (100, 10**5, 10**7, 10**9)]
    assert bits == sorted(bits) and bits[0] == simhash_ball.LEAST_BITS and bits[-1] <= 64
    assert simhash_ball.views_for(30, 0.95) < simhash_ball.views_for(30, 0.8) < simhash_ball.views_for(40, 0.8)


def test_fingerprint_of_short_texts():
    def value(text):
        return simhash_ball.majority_bits(simhash_ball.shingle_hashes(text))
    assert value(None) == value(b"") == value(b" \n") == 0
    assert value(b"One  two") == xxhash.xxh64_intdigest(b"one two", 42) == value(b"one two")
    assert len(simhash_ball.shingle_hashes(b"a b c d e f")) == 3


def test_long_chain_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (None, 3)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in components.components(chain).collect()} == {(i, 0) for i in range(301)}


def test_near_duplicates_of_edge_rows(spark, edges, empty):
    rows = simhash_ball.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    group = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert group[1] == group[2] == group[3] == 1 and group[4] == group[5] == 4 and group[6] == 6
    kept = simhash_ball.keep_one(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and ids.count(None) == 2 and 2 not in ids and 5 not in ids
    assert simhash_ball.near_duplicates(empty).count() == simhash_ball.keep_one(empty).count() == 0


def all_similar(docs):
    """All pairs of a similarity of 0.8, and the smallest id of each component of them."""
    sets = [(d, frozenset(simhash_ball.shingle_hashes(t.encode(), 5).tolist())) for d, t in sorted(docs)]
    pairs = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            shared = len(x & y)
            if shared >= 0.8 * (len(x) + len(y) - shared):
                pairs.add((b, a))
    root = {d: d for d, _ in sets}
    for b, a in sorted(pairs) * 2:
        x, y = a, b
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    return pairs, {d for d in root if root[d] == d}


def test_similar_pairs_of_one_template(spark):
    random.seed(31)
    template, docs = [f"w{i}" for i in range(104)], []
    for i in range(1000):
        words = list(template)
        for k in range(2):
            for at in random.sample(range(104), 2):
                words[at] = f"u{i}x{k}x{at}"
            docs.append((2 * i + k, " ".join(words)))
    random.shuffle(docs)
    pairs, kept = all_similar(docs)
    table = spark.createDataFrame(docs, DOCS).repartition(4)
    assert {tuple(r) for r in simhash_ball.similar_pairs(table).collect()} == pairs and len(pairs) > 900
    left = {r.doc_id for r in simhash_ball.keep_one(table).collect()}
    assert left == kept and len(left) > 50


def test_groups_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash_ball, "HEAVY", 4)
    monkeypatch.setattr(simhash_ball, "GROUP_TOKENS", 64)
    random.seed(32)
    base, docs = [f"w{i}" for i in range(60)], []
    for i in range(300):
        words = list(base)
        for _ in range(random.randrange(3)):
            words[random.randrange(60)] = f"u{random.randrange(20)}"
        docs.append((i, " ".join(words[random.randrange(6):])))
    pairs, kept = all_similar(docs)
    table = spark.createDataFrame(docs, DOCS).repartition(4)
    assert {r.doc_id for r in simhash_ball.keep_one(table).collect()} == kept and len(pairs) > 1000


def test_one_dominating_word_makes_no_copy(spark):
    random.seed(33)
    docs = [(i, "word " * 1000 + " ".join(f"d{i}x{k}" for k in range(200))) for i in range(6)]
    docs.append((6, docs[2][1].replace("d2x100", "new")))
    prints = {simhash_ball.majority_bits(simhash_ball.shingle_hashes(t.encode())) for _, t in docs}
    assert len(prints) == 1
    table = spark.createDataFrame(docs, DOCS)
    assert {r.doc_id for r in simhash_ball.keep_one(table).collect()} == set(range(6)) == all_similar(docs)[1]


def test_short_texts_with_one_word_more(spark):
    docs = []
    for i in range(150):
        words = [f"v{i}x{k}" for k in range(8 + i % 20)]
        docs += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words, "more"])), (3 * i + 2, " ".join(["x", *words[1:]]))]
    pairs, kept = all_similar(docs)
    table = spark.createDataFrame(docs, DOCS).repartition(4)
    assert {tuple(r) for r in simhash_ball.similar_pairs(table).collect()} == pairs and len(pairs) >= 150
    assert {r.doc_id for r in simhash_ball.keep_one(table).collect()} == kept


def test_rows_that_share_an_id_keep_their_texts(spark):
    docs = [(1, "one text"), (1, "another text"), (1, "one text"), (2, "third text"), (2, "Another  text"), (3, "third text"), (None, "one text")]
    kept = simhash_ball.keep_one(spark.createDataFrame(docs, DOCS).repartition(3))
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == [(0, "one text"), (1, "another text"), (1, "one text"), (2, "third text")]
