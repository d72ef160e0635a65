"""Nearest neighbours from an index: random-projection signatures, several probes, exact scores.

Every vector lies in the bucket of the signs of a few random projections. A query looks
into the buckets that differ from its own where its projections are closest to zero, and
scores what lies there exactly. How many buckets that takes for a wanted recall depends on
how the vectors lie, so it is measured: on a bounded sample of the items, against brute
force. Where neighbours are near, a few buckets hold them; where vectors have no structure,
the measured number is most of the buckets, and the search says so instead of missing them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions.scale import cut
from scholia.operators import vectors

#: Items of a bucket to aim for, and most bits of a signature.
BUCKET_ROWS, MOST_BITS = 256, 24
#: Items that the fit may draw, and how many of them it takes as queries.
SAMPLE_ITEMS, SAMPLE_QUERIES = 4096, 256
#: Recall the fit asks for on its sample.
TARGET = 0.95
#: Rows of a bucket that one task holds; larger buckets are cut into pieces.
PIECE_ROWS = 16_384
#: Projections, closest to zero first, that probes may flip.
FLIPS = 12

COMPLETE = "{0} is not null and not exists({0}, v -> v is null)"


@dataclass(frozen=True)
class Signatures:
    """Planes of the projections, and the number of buckets a query looks into."""

    planes: np.ndarray
    probes: int
    #: Share of the sample's true neighbours found with so many probes.
    sample_recall: float

    @property
    def bits(self) -> int:
        return self.planes.shape[1]

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(unit), np.int64)
        return ((unit @ self.planes > 0) @ (1 << np.arange(self.bits, dtype=np.int64))).astype(np.int64)

    def probe_order(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """Buckets of each row, nearest first: flipping a bit costs its squared projection."""
        if not self.bits:
            return np.zeros((len(unit), 1), np.int64)
        margin = unit @ self.planes
        n = min(self.bits, FLIPS)
        loose = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :n]
        subsets = np.arange(1 << n)
        chosen = ((subsets[:, None] >> np.arange(n)) & 1).astype(float)
        cost = np.take_along_axis(margin, loose, axis=1) ** 2 @ chosen.T
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        flips = np.take_along_axis((1 << loose.astype(np.int64)) @ chosen.T.astype(np.int64), best, axis=1)
        return self.buckets(unit)[:, None] ^ flips


def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    """Random directions, orthogonal in groups of ``dim``."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.hstack(groups)[:, :bits] if bits else np.zeros((dim, 0))


def fit(items: DataFrame, k: int = 10, target: float = TARGET, seed: int = 0) -> Signatures:
    """Signatures for ``items(item_id, ivec)``.

    Bits follow the number of items, so that a bucket holds about BUCKET_ROWS of them.
    At most SAMPLE_ITEMS vectors, drawn by a hash of the id, come to the driver; with bits
    for a sample of that size it finds the share of buckets that holds ``target`` of the
    true ``k`` neighbours. In the whole table neighbours are nearer than in a sample of it.
    """
    usable = items.where(COMPLETE.format("ivec"))
    n, dim = usable.agg(F.count(F.lit(1)), F.max(F.size("ivec"))).first()
    if not n:
        return Signatures(np.zeros((1, 0)), 1, 1.0)
    grains = 1 << 20
    share = max(1, int(min(1.0, SAMPLE_ITEMS / n) * grains))
    drawn = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(grains)) < share).select("ivec").limit(2 * SAMPLE_ITEMS).toPandas()
    bits = int(min(MOST_BITS, max(0, round(np.log2(n / BUCKET_ROWS)))))
    whole = Signatures(_planes(dim, bits, seed), 1, 1.0)
    unit = vectors._unit(vectors._matrix(drawn["ivec"])) if len(drawn) else np.zeros((0, dim))
    if bits == 0 or len(unit) <= k:
        return Signatures(whole.planes, 1 << min(bits, FLIPS), 1.0)
    asked = unit[:SAMPLE_QUERIES]
    scores = asked @ unit.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    # place of each true neighbour's bucket in the order of the query's probes
    order = whole.probe_order(asked, 1 << min(bits, FLIPS))
    held = whole.buckets(unit)[true]
    place = np.full(held.shape, order.shape[1])
    for at in range(order.shape[1] - 1, -1, -1):
        place[held == order[:, at, None]] = at
    found = np.cumsum(np.bincount(place.ravel(), minlength=order.shape[1] + 1)[:-1]) / place.size
    enough = np.flatnonzero(found >= target)
    probes = int(enough[0]) + 1 if len(enough) else order.shape[1]
    return Signatures(whole.planes, probes, float(found[probes - 1]))


def build(items: DataFrame, signatures: Signatures) -> DataFrame:
    """The index: (bucket, item_id, ivec) of every item. Rows without a whole vector are no
    hits of any search and are left out. Write it partitioned by bucket to keep it."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = vectors._arrow_unit(pa.table(batch), "ivec")
            buckets = signatures.buckets(unit) if len(unit) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), *batch.columns], ["bucket", "item_id", "ivec"])
    whole = items.where(COMPLETE.format("ivec")).select("item_id", F.col("ivec").cast("array<double>").alias("ivec"))
    return whole.mapInArrow(sign, "bucket bigint, item_id bigint, ivec array<double>")


def search(index: DataFrame, queries: DataFrame, signatures: Signatures, k: int = 10, skip_self: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank): the k best items in the probed buckets.

    A bucket and the queries that probe it meet in one task, or in several where the bucket
    holds more than PIECE_ROWS items; each returns k rows a query. No pair table is made.
    """
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                order = signatures.probe_order(vectors._arrow_unit(pa.table(batch), "qvec"), signatures.probes)
                rows = np.repeat(np.arange(len(batch)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel()), *(c.take(pa.array(rows)) for c in batch.columns)], ["bucket", "query_id", "qvec"])
    asked = (queries.where(COMPLETE.format("qvec")).select("query_id", F.col("qvec").cast("array<double>").alias("qvec"))
             .mapInArrow(probe, "bucket bigint, query_id bigint, qvec array<double>"))
    pieces = cut(index.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).alias("pieces")))
    left = asked.join(pieces, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), "query_id", "qvec")
    right = index.join(pieces, "bucket").select("bucket", F.pmod(F.xxhash64("item_id"), F.col("pieces")).alias("piece"), "item_id", "ivec")

    def cell(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs) or "ivec" not in theirs or "qvec" not in mine:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        ids, qids = theirs["item_id"].to_numpy(), mine["query_id"].to_numpy()
        q, i = vectors._unit(np.vstack(mine["qvec"].to_numpy())), vectors._unit(np.vstack(theirs["ivec"].to_numpy()))
        step = max(1, vectors.SCORE_CELLS // len(ids))
        return pd.concat([vectors._best_rows(qids[at:at + step], np.round(q[at:at + step] @ i.T, 6), ids, k, skip_self) for at in range(0, len(q), step)], ignore_index=True)

    partial = left.groupBy("bucket", "piece").cogroup(right.groupBy("bucket", "piece")).applyInPandas(cell, "query_id bigint, item_id bigint, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, item_id) pairs that were found; 1 when there are none."""
    wanted = exact.select("query_id", "item_id").distinct()
    n = wanted.count()
    return wanted.join(found.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi").count() / n if n else 1.0
