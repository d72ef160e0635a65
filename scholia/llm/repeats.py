"""Which hashes occur more than once: counted on the cluster, told to every task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: sixteen for each hash, but within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
BITS_PER_HASH = 16
REGION = 1 << 16


class HashFilter:
    """Bitmap of hashes. A hash that was put in is always found; a few others are too."""

    def __init__(self, bitmap: bytes):
        self.bits = np.frombuffer(bitmap, np.uint8)
        self.mask = np.uint64(len(bitmap) * 8 - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def hash_filter(hashes: DataFrame, col: str, n: int) -> Broadcast:
    """Broadcast bitmap (a dictionary with key ``bitmap``) of ``n`` hashes in a long column.

    The bitmap has a bound, however many hashes there are: beyond it more other hashes
    pass, which costs work downstream and changes no result. Its regions are built on the
    cluster; the driver only puts them in a row.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, n * BITS_PER_HASH)))))
    at = hashes.select(F.col(col).bitwiseAND(F.lit(bits - 1)).alias("at"))
    placed = at.select(F.shiftright("at", 16).alias("region"), F.col("at").bitwiseAND(F.lit(REGION - 1)).cast("int").alias("bit"))

    def build(group: pa.Table) -> pa.Table:
        marks = np.zeros(REGION, np.uint8)
        marks[group["bit"].to_numpy()] = 1
        return pa.table({"region": group["region"][:1], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    whole = bytearray(bits // 8)
    for row in placed.groupBy("region").applyInArrow(build, "region bigint, bits binary").toLocalIterator():
        whole[row.region * REGION // 8:(row.region + 1) * REGION // 8] = row.bits
    return hashes.sparkSession.sparkContext.broadcast({"bitmap": bytes(whole)})
