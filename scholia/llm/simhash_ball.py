"""SimHash near duplicates by meeting in the middle of the Hamming ball.

Two fingerprints within radius 2r share a variant within r of both. Every distinct
fingerprint emits all its variants within r; equal variants are brought together and the
fingerprints behind them are linked. The shuffle is on the leading bits of a variant: one
row stands for all variants of a fingerprint with the same leading bits, and the rest of
the flips is made where they are compared. The number of leading bits follows the number
of fingerprints so that a group always has about the same number of variants.

Fingerprints are 64-bit sums of the signs of XXH64 (seed 42) of word shingles. A text with
fewer words than a shingle is one shingle; one without words has the fingerprint zero.
Nulls are texts without words. Rows with a null id join the group of their text but
never name a component unless no other row does. Repeated rows share a component.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scholia.functions.scale import broadcast_within, cut
from scholia.llm.common import SLICE_ROWS, share, text_udf
from scholia.llm.components import components

SHINGLE = 4
RADIUS = 4
BITS = 64
#: Variants that one group of leading bits should have (8 bytes each while it is worked on).
GROUP_VARIANTS = 1 << 20
SEED = 42
#: Near copies in a pipeline: words of a shingle and Jaccard similarity.
PAIR_SHINGLE = 5
SIMILARITY = 0.8
#: Sizes of views of :func:`bits_for` and :func:`views_for`.
RECALL = 0.97
PAIR_RADIUS = 2
LEAST_BITS = 24
#: Unrelated texts that a text may meet in a view.
CHANCE_PAIRS = 8
#: Leading bits of a shingle by which it is counted (a byte each in the table).
COUNT_BITS = 22
#: A shingle of so many more texts than usual is heavy.
HEAVY = 256
#: Rare shingles of one group that is sorted at once.
GROUP_TOKENS = 1 << 16
#: Ids of documents that are sent to all tasks; more of them are joined by a shuffle.
SENT_IDS = 1_000_000


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the words of a text, A-Z in lower case."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1:] - 1).tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: Column | str, size: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer."""
    def make() -> Callable[[list], list]:
        def signed(value: int) -> int:
            return value - (1 << BITS) if value >> (BITS - 1) else value
        return lambda texts: [signed(majority_bits(shingle_hashes(t, size))) for t in texts]
    return text_udf(make, "bigint", utf8=True)(text)


def flips(bits: int, most: int) -> list[int]:
    """All numbers of ``bits`` bits with at most ``most`` of them set."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def leading_bits(n: int, radius: int, group_variants: int = GROUP_VARIANTS, bits: int = BITS) -> int:
    """Leading bits for ``n`` fingerprints: about ``group_variants`` variants in a group."""
    variants = n * len(flips(bits, radius))
    return min(40, max(1, math.ceil(math.log2(max(2, variants / group_variants)))))


def _meetings(prints: np.ndarray, group: int, bits: int, lead: int, radius: int, following: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of fingerprints that share a variant with the leading bits ``group``.

    Of the fingerprints with one variant each meets so many ``following`` ones.
    """
    rest = bits - lead
    used = np.bitwise_count((prints >> np.uint64(rest)) ^ np.uint64(group))
    low = prints & np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for k in range(radius + 1):
        own = np.flatnonzero(used == k)
        masks = np.array(flips(rest, radius - k), np.uint64)
        variants.append((low[own][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own.astype(np.int32), len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    del variants, owners
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    met = [np.empty(0, np.int64)]
    for step in range(1, following + 1):
        same = np.flatnonzero(variant[step:] == variant[:-step])
        if not len(same):
            break
        a, b = owner[same].astype(np.int64), owner[same + step].astype(np.int64)
        met.append(np.minimum(a, b) * len(prints) + np.maximum(a, b))
    pairs = np.unique(np.concatenate(met))
    a, b = pairs // max(1, len(prints)), pairs % max(1, len(prints))
    near = np.bitwise_count(prints[a] ^ prints[b]) <= 2 * radius
    return a[near], b[near]


def _links_of_group(prints: np.ndarray, group: int, lead: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among the fingerprints that can reach the leading bits ``group``."""
    prints = np.unique(prints)
    a, b = _meetings(prints, group, BITS, lead, radius)
    return prints[a].view(np.int64), prints[b].view(np.int64)


def ball_links(prints: DataFrame, col: str = "fp", radius: int = RADIUS, group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """a, b: links that connect all distinct values of ``col`` within ``radius`` bits.

    Of several fingerprints with a common variant, each is linked with the next one, so a
    crowded variant gives a chain and not all pairs; values that are near each other always
    end up connected. ``radius`` is even. ``col`` should hold distinct values.
    """
    half = radius // 2
    lead = leading_bits(prints.count(), half, group_variants)
    reach = F.array(*[F.lit(m).cast("bigint") for m in flips(lead, half)])
    led = prints.select(F.col(col).alias("fp")).withColumn("top", F.shiftrightunsigned("fp", BITS - lead))
    rows = led.select("fp", F.explode(F.transform(reach, lambda m: m.bitwiseXOR(F.col("top")))).alias("lead"))

    def link(group: pa.Table) -> pa.Table:
        x, y = _links_of_group(group["fp"].to_numpy().view(np.uint64), group["lead"][0].as_py(), lead, half)
        return pa.table({"a": x, "b": y})

    return rows.groupBy("lead").applyInArrow(link, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed 64-bit), component_id (smallest id reachable) for every row."""
    rows = cut(df.select(F.col(id_col).alias("doc_id"), fingerprint(F.coalesce(F.col(text_col), F.lit("")), size).alias("fp")))
    first = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = cut(components(ball_links(first, "fp", radius)))
    smallest = roots.join(first, roots.node == first.fp).groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    copies = first.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    named = linked.unionByName(copies)
    return rows.join(named, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


# ---- near copies of a given similarity -----------------------------------

def bits_for(n: int, radius: int = PAIR_RADIUS) -> int:
    """Bits of a view: a text then meets few of ``n`` unrelated texts, however many there are."""
    bits = LEAST_BITS
    while bits < BITS - 1 and sum(math.comb(bits, k) for k in range(radius + 1)) / 2.0 ** bits * n > CHANCE_PAIRS:
        bits += 1
    return bits


def views_for(bits: int, similarity: float, recall: float = RECALL, radius: int = PAIR_RADIUS) -> int:
    """Views that a pair of this similarity needs to meet in one of them so often."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meet = sum(math.comb(bits, k) * differ ** k * (1 - differ) ** (bits - k) for k in range(radius + 1))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(meet, 0.999))))


def _shingles(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def _name(held: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles; zero for the empty one."""
    return int(np.uint64(xxh64_intdigest(held.tobytes(), SEED)).view(np.int64)) if len(held) else 0


def common_shingles(texts: DataFrame, size: int = PAIR_SHINGLE, every: int = 1) -> tuple[bytes, int]:
    """How common shingles are, as a byte (a logarithm) for each value of their leading bits,
    and the byte from which on one counts as heavy. One in ``every`` texts is counted.

    The table only orders shingles, so that rare ones are compared; no result depends on it.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).cast(pa.binary()).slice(at, SLICE_ROWS).to_pylist():
                    np.add.at(table, _shingles(text, size) >> np.uint64(BITS - COUNT_BITS), 1)
        for chunk in range(0, len(table), 1 << 16):
            at = np.flatnonzero(table[chunk:chunk + (1 << 16)])
            if len(at):
                n = np.minimum(table[chunk + at], 0xFFFF).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "at": [at.astype(np.uint16).tobytes()], "n": [n.tobytes()]}, schema)

    def add(group: pa.Table) -> pa.Table:
        table = np.zeros(1 << 16, np.int64)
        for at, n in zip(group["at"].to_pylist(), group["n"].to_pylist(), strict=True):
            table[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
        return pa.table({"chunk": [group["chunk"][0].as_py()], "level": [_level(table).tobytes()], "total": [int(table.sum())]})

    schema = pa.schema([("chunk", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])
    counted = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")
    chunks = counted.mapInArrow(count, "chunk bigint, at binary, n binary").groupBy("chunk").applyInArrow(add, "chunk bigint, level binary, total bigint").collect()
    table = np.zeros(1 << COUNT_BITS, np.uint8)
    for row in chunks:
        table[row.chunk:row.chunk + (1 << 16)] = np.frombuffer(row.level, np.uint8)
    usual = sum(row.total for row in chunks) / len(table)
    return table.tobytes(), int(_level(np.array([4 * usual + HEAVY / every]))[0])


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(8 * np.log2(1 + counts))).astype(np.uint8)


def rare_shingles(held: np.ndarray, table: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a set and their levels: so many that two sets with this
    similarity have one of them in common, since fewer than these can be missing."""
    take = len(held) - math.ceil(similarity * len(held) - 1e-9) + 1
    levels = table[held >> np.uint64(BITS - COUNT_BITS)]
    order = np.argsort(levels, kind="stable")[:take]
    return held[order], levels[order]


def _repeated(group: pa.Table) -> pa.Table:
    """Rows whose shingle several sets have, each set once."""
    rows = group.select(["token", "key", "size", "pos"])
    token, key = rows["token"].to_numpy(), rows["key"].to_numpy()
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    order, token = order[new], token[new]
    same = token[1:] == token[:-1]
    several = np.zeros(len(order), bool)
    several[1:] |= same
    several[:-1] |= same
    return rows.take(order[several])


class Similar:
    """The texts of a table, those with equal sets of shingles as one, and which sets are similar.

    Every set gives its rarest shingles, as many as can be missing in a similar set and one
    more. So two sets of the wanted similarity share one of them, whatever their sizes are.
    Sets that share one, and could be similar by their sizes and by the place of that
    shingle in both, are verified on their whole sets. No pair is lost on the way.
    Nulls are texts without words; rows without an id take no part.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, size: int, similarity: float):
        self.size, self.similarity = size, similarity
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text.alias("text"))
        n_bytes = self.texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        every = max(1, min(8, n_bytes >> 23))
        table, heavy = common_shingles(self.texts, size, every)
        shared = share(df.sparkSession, {"table": table}, len(table))

        def make() -> Callable[[list], list]:
            table = np.frombuffer(shared.value["table"], np.uint8)

            def one(text: bytes | None) -> dict:
                held = _shingles(text, size)
                if not len(held):
                    return {"key": 0, "size": 0, "light": 0, "tokens": []}
                tokens, levels = rare_shingles(held, table, similarity)
                return {"key": _name(held), "size": len(held), "light": int((levels < heavy).sum()), "tokens": tokens.view(np.int64)}
            return lambda texts: [one(t) for t in texts]

        sets = text_udf(make, "struct<key: bigint, size: int, light: int, tokens: array<bigint>>", utf8=True)
        #: doc_id, text_key, key (of the set), size, light, tokens for every row with an id
        self.rows = cut(self.texts.select("doc_id", F.xxhash64("text").alias("text_key"), sets("text").alias("s")).select("doc_id", "text_key", "s.*"))
        self.live = self._live()

    def _live(self) -> DataFrame:
        """token, key, size, pos: the rare shingles that several sets may have.

        Heavy ones, which copies have, skip the sorting in groups and meet by joins that AQE splits.
        """
        total = self.rows.agg(F.sum(F.col("light").cast("bigint"))).first()[0] or 0
        lead = min(40, max(1, math.ceil(math.log2(max(2, total / GROUP_TOKENS)))))
        each = self.rows.select("key", "size", "light", F.posexplode("tokens").alias("pos", "token"))
        light = each.where("pos < light").select("token", "key", "size", "pos", F.shiftrightunsigned("token", BITS - lead).alias("lead"))
        repeated = light.groupBy("lead").applyInArrow(_repeated, "token bigint, key bigint, size int, pos int")
        heavy = each.where("pos >= light").select("token", "key", "size", "pos").distinct()
        return cut(repeated.unionByName(heavy))

    def _fits(self, x: str, y: str) -> Column:
        left = F.least(*[F.col(f"{s}.size") - F.col(f"{s}.pos") for s in (x, y)])
        return left >= F.lit(self.similarity / (1 + self.similarity)) * (F.col(f"{x}.size") + F.col(f"{y}.size")) - F.lit(1e-6)

    def _met(self, x: DataFrame, y: DataFrame, where: Column) -> DataFrame:
        met = x.alias("x").join(y.alias("y"), "token").where(where & self._fits("x", "y"))
        return met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs of sets (a, b; materialised) that are similar, by their whole sets."""
        size = self.size

        def make() -> Callable[[list], list]:
            def one(text: bytes | None) -> dict:
                held = _shingles(text, size)
                return {"key": _name(held), "held": held.view(np.int64)}
            return lambda texts: [one(t) for t in texts]

        whole = text_udf(make, "struct<key: bigint, held: array<bigint>>", utf8=True)
        needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        ids = cut(self.rows.join(broadcast_within(cut(needed), SENT_IDS), "key").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
        held = self.texts.join(broadcast_within(ids, SENT_IDS), "doc_id", "left_semi").select(whole("text").alias("s")).select("s.*")
        sets = cut(held.groupBy("key").agg(F.first("held").alias("held")))
        both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("held").alias("x")), "a")
                .join(sets.select(F.col("key").alias("b"), F.col("held").alias("y")), "b"))
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= F.lit(self.similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")

    def pairs(self) -> DataFrame:
        """a, b: all pairs of similar sets."""
        return self.similar(cut(self._met(self.live, self.live, F.col("x.key") < F.col("y.key"))))

    def groups(self) -> DataFrame:
        """node, root: the components of all pairs of similar sets, without making all pairs.

        The sets of a shingle are compared with the first of them, which brings copies into
        one part; then only sets of different parts are compared with each other.
        """
        first = self.live.groupBy("token").agg(F.min(F.struct("key", "size", "pos")).alias("f")).select("token", "f.*")
        tried = cut(self._met(self.live, first, F.col("x.key") != F.col("y.key")))
        links = cut(self.similar(tried))
        parts = cut(components(links))
        held = self.live.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("root", "key")).drop("root")
        mixed = held.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token")
        rest = cut(held.join(mixed, "token", "left_semi"))
        met = cut(self._met(rest, rest, F.col("x.part") < F.col("y.part")).join(tried, ["a", "b"], "left_anti"))
        return cut(components(links.unionByName(self.similar(met))))


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PAIR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: smallest ids of different texts with a Jaccard similarity of word shingles.

    All such pairs of different sets of shingles; of different texts with one set the first
    is paired with each other one. Texts without words and rows without an id take no part.
    """
    found = Similar(df, id_col, text_col, size, similarity)
    texts = cut(found.rows.where("size > 0").groupBy("key", "text_key").agg(F.min("doc_id").alias("doc_id")))
    first = texts.groupBy("key").agg(F.min("doc_id").alias("first"))
    pairs = found.pairs().join(first.select(F.col("key").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("key").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    equal = texts.join(first, "key").select(F.col("first").alias("x"), F.col("doc_id").alias("y"))
    return pairs.unionByName(equal).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PAIR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The first row of every group of ``df`` by id (and text key); all columns as they are.

    Groups are the components of all pairs with a Jaccard similarity of word shingles, and
    texts without words. Rows that share an id are apart unless their texts are near copies;
    of equal rows one stays. Rows without an id stay.
    """
    found = Similar(df, id_col, text_col, size, similarity)
    named = found.rows.join(found.groups().withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    each = cut(named.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")))
    first = each.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    told = each.join(first, "root").withColumn("stays", F.struct("doc_id", "text_key") == F.col("first")).where("n > 1 or not stays")
    told = cut(told.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), "stays"))
    keyed = df.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = (F.col(id_col) == F.col("__id")) & (F.col("__key") == F.col("__text"))
    once = keyed.join(broadcast_within(told.drop("stays"), SENT_IDS), same, "left_anti")
    twice = keyed.join(broadcast_within(told.where("stays").drop("stays"), SENT_IDS), same, "left_semi")
    return once.unionByName(twice.dropDuplicates([id_col, "__key"])).drop("__key")
