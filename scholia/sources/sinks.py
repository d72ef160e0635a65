"""Persisted index: chunks, postings, vectors and statistics as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import lexical, vectors

TABLES = ("chunks", "postings", "forward", "bounds", "tops", "vectors", "df", "stats")
#: Chunks of a block of postings, at most.
BLOCK_CHUNKS = 256


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def complete_runs(spark: SparkSession, path: str) -> DataFrame:
    """Finished runs since the last full build; a run counts once its stats exist."""
    stats = spark.read.parquet(f"{path}/stats")
    base = stats.where("is_base = 1").agg(F.max("run").alias("base"))
    return stats.join(F.broadcast(base)).where("run >= base").select("run")


def write_index(chunks: DataFrame, path: str, clear_first: bool = False) -> int:
    """Write ``chunks(source, chunk_id, text)`` as a new run; returns its number.

    A full build starts a new base, an append adds a run with its own counts. Every
    table is a folder per run; statistics come last, so a broken run is never read
    and its number is written over by the next attempt.
    """
    spark = chunks.sparkSession
    fresh = not _exists(spark, f"{path}/stats")
    last = None if fresh else spark.read.parquet(f"{path}/stats").agg(F.max("run")).first()[0]
    run = 0 if last is None else int(last) + 1
    is_base = 1 if clear_first or fresh else 0

    def put(df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{table}/run={run}")
    chunks.write.mode("overwrite").option("compression", "zstd").partitionBy("source").parquet(f"{path}/chunks/run={run}")
    stored = spark.read.parquet(f"{path}/chunks/run={run}").select("source", "chunk_id", "text")
    # neighbours share a block, so a block is in one task; blocks of different runs differ
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    block = F.lit(run << 48) + F.shiftleft(F.spark_partition_id().cast("bigint"), 28) + F.floor(place / BLOCK_CHUNKS)
    put(lexical.stored_counts(stored.select("chunk_id", "text")).withColumn("block", block), "forward")
    counts = spark.read.parquet(f"{path}/forward/run={run}")
    # in runs by term, so that a reader of few terms passes over most pages; a hot term is in many files
    put(lexical.run_postings(counts), "postings")
    posting = spark.read.parquet(f"{path}/postings/run={run}")
    put(lexical.run_bounds(counts), "bounds")
    put(lexical.posting_tops(spark.read.parquet(f"{path}/bounds/run={run}")), "tops")
    put(vectors.embed_hashed(stored.select("chunk_id", "text")).select("chunk_id", "embedding"), "vectors")
    put(posting.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    put(lexical.corpus_stats(stored).withColumn("is_base", F.lit(is_base)), "stats")
    return run


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Chunks, postings and vectors of all live runs; counts added up over runs."""
    runs = complete_runs(spark, path)

    def live(table: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{table}").join(runs, "run", "left_semi").drop("run")
    stats = (live("stats").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
             .withColumn("avg_len", F.col("total_len") / F.col("n_docs")))
    return {"chunks": live("chunks"), "postings": live("postings"), "forward": live("forward"), "bounds": live("bounds"), "tops": live("tops"), "vectors": live("vectors"),
            "df": live("df").groupBy("term").agg(F.sum("df").alias("df")), "stats": stats}
