"""Helpers that keep a plan safe at scale: lineage cuts, size checks, salting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Planned bytes of a repeated side, with its repeats, that may still be broadcast; files are
#: compressed, so the rows can take many times that.
REPEATED_BYTES = 1 << 19


#: Rows that one task may count or sort without a spill.
PART_ROWS = 1 << 20
#: Rows of one key that need no salt.
HOT_ROWS = 1 << 17
#: Rows of best hits that a task holds before it cuts them, at least.
KEPT_ROWS = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master, as in tests, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="scholia-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage.

    Used between rounds of an iterative job and for a table read more than once.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    base = shared_dir(spark)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan over all tasks when its files yield fewer splits than that.

    For CPU-bound work on a few small files. A large table already has more splits
    than tasks and is returned as it is. Call it on a plain scan only.
    """
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= tasks else scan.repartition(tasks)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys in so many partitions that each makes about PART_ROWS of ``rows`` rows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // PART_ROWS)), *keys)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` holds at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when the side provably has at most ``rows`` rows."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table, from its files; what an ``explode`` repeats is not in it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def salted_join(big: DataFrame, small: DataFrame, key: str, spread_by: str,
                salts: int | None = None, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` where single keys of ``big`` may be hot.

    Rows of ``big`` are spread over ``salts`` buckets by ``spread_by``; each row
    of ``small`` is repeated once per bucket. Only for inner and left_semi joins.
    The planner does not count the repeats, so a side that would be large with them
    is told not to be broadcast.
    """
    salts = salts or salt_count(big.sparkSession)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if planned_bytes(small) * salts > REPEATED_BYTES:
        right = right.hint("merge")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def hot_join(big: DataFrame, small: DataFrame, key: str, spread_by: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The :func:`salted_join` for a ``big`` that is cheap to read twice.

    Keys with more than ``hot_rows`` rows of ``big`` are counted first. Only what ``small``
    has for these is repeated; all other keys are joined as they are.
    """
    hot = cut(big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull() & (F.col("_n") > hot_rows)).select(key, F.lit(True).alias("_hot")))
    salts = salt_count(big.sparkSession)
    large = planned_bytes(small) * salts > REPEATED_BYTES
    if hot.isEmpty():
        return big.join(small.hint("merge") if large else small, key, how)
    left = (big.join(F.broadcast(hot), key, "left")
            .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(0).cast("int")).drop("_hot"))
    right = (small.join(F.broadcast(hot), key, "left")
             .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot"))
    return left.join(right.hint("merge") if large else right, [key, "_salt"], how).drop("_salt")


def salt_count(spark: SparkSession) -> int:
    """Buckets for a key that may hold a third of all rows: enough to leave about one
    percent per bucket, few enough to repeat the small side; AQE splits what is left."""
    return min(32, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3))


def number_rows(df: DataFrame, keys: list[str], order: list, out: str = "n") -> DataFrame:
    """Number the rows of each key from 1, also where one key holds a third of them.

    Rows are range-partitioned on key and order, so a hot key covers many partitions;
    each partition numbers its own rows and adds the counts of the partitions before.
    """
    ranged = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    own = ranged.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*order)))
    return (own.join(offsets, [*keys, "_p"]).withColumn(out, F.col("_n") + F.col("_off"))
            .drop("_p", "_n", "_off"))


def best_of_task(found: Iterable[pd.DataFrame], k: int, tie: str) -> Iterator[pd.DataFrame]:
    """The ``k`` best rows of each query over all batches of a task, ties by ``tie``.

    A task returns so many rows a query however many batches it reads, so what is sorted and
    shuffled after it grows with the tasks and not with the rows. It holds twice that at most.
    """
    kept, rows, bound = [], 0, KEPT_ROWS

    def first(parts: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(parts, ignore_index=True)
        query, score = every["query_id"].to_numpy(), every["score"].to_numpy()
        order = np.lexsort((every[tie].to_numpy(), -score, query))
        query = query[order]
        return every.iloc[order[np.arange(len(query)) - np.searchsorted(query, query) < k]]

    for part in found:
        kept.append(part)
        rows += len(part)
        if rows > bound:
            kept = [first(kept)]
            rows = len(kept[0])
            bound = max(KEPT_ROWS, 2 * rows)
    if kept:
        yield first(kept)
