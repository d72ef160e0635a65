"""Inverted index and many-query BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions.scale import best_of_task, broadcast_within, cut, has_at_most, salted_join
from scholia.functions.text import tokens

K1 = 1.5
B = 0.75
TOP_K = 20
QUERY_TERMS = 200_000
SCORE_CELLS = 4_000_000
#: Postings that a task sorts at once.
RUN_ROWS = 1 << 20


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, term, tf, len). The words of a chunk travel in one row; they are counted where
    the chunk is, and whoever groups the result by chunk needs no shuffle of its own."""
    base = chunks.select(F.col(id_col).alias("chunk_id"), tokens(text_col).alias("ts")).repartition("chunk_id")
    return (base.select("chunk_id", F.size("ts").cast("bigint").alias("len"),
                        F.explode("ts").alias("term"))
            .groupBy("chunk_id", "term")
            .agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len")))


def doc_stats(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_id"),
                         F.size(tokens(text_col)).cast("bigint").alias("len"))


def doc_freq(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): chunks that hold the term, partially counted in each task."""
    return (chunks.select(F.explode(F.array_distinct(tokens(text_col))).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def corpus_stats(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_docs, total_len, avg_len."""
    return (chunks.select(F.size(tokens(text_col)).cast("bigint").alias("len"))
            .agg(F.count(F.lit(1)).alias("n_docs"),
                 F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))
            .withColumn("avg_len", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs"))
                        .otherwise(F.lit(0.0))))


def idf_expr(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """df with its inverse document frequency; ``stats`` is one row by construction."""
    return (df.join(F.broadcast(stats.select("n_docs")))
            .select("term", "df", idf_expr(F.col("n_docs"), F.col("df")).alias("idf")))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a term repeated in a query counts each time."""
    return (queries.select("query_id", F.explode(tokens("query")).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def bm25_scores(posting: DataFrame, df: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) for every chunk with a positive score.

    The idf joins the small side (query terms), which travels to the postings: these are
    brought together by chunk, a task scores its chunks against all queries, and no score is
    shuffled. A term set beyond QUERY_TERMS rows is joined in a shuffle on the term, salted by
    chunk, so that a term found in a third of all chunks does not land in one task; there
    scores are summed map-side before the last exchange.
    """
    weighted = query_terms(queries).join(df, "term").join(F.broadcast(stats)).select(
        "query_id", "term", "avg_len",
        (F.col("qtf") * idf_expr(F.col("n_docs"), F.col("df"))).alias("weight"))
    weighted = cut(weighted)
    if has_at_most(weighted, QUERY_TERMS):
        scores = _score_in_place(forward_counts(posting), weighted.toPandas(), None)
        return scores.select("query_id", "chunk_id", F.round("score", 6).alias("score")).where("score > 0")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.col("avg_len"))
    part = F.col("weight") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)
    return (salted_join(posting, weighted, "term", "chunk_id")
            .groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
            .where("score > 0"))


def top_k(scores: DataFrame, k: int = TOP_K, by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """First k rows per query; the window limit is applied before the shuffle."""
    w = W.partitionBy(by).orderBy(F.desc("score"), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, chunk_id, score, rank): the first k chunks of every query.

    The weighted query terms are small, so they travel and the corpus stays: each
    task scores the chunks it already holds against all queries and keeps k per
    query. No posting is shuffled and a hot term costs nothing extra. A term set
    beyond QUERY_TERMS rows takes the shuffled join of :func:`bm25_scores` instead.
    """
    terms = query_terms(queries)
    if not has_at_most(terms, QUERY_TERMS):
        scores = bm25_scores(postings(chunks), doc_freq(chunks), corpus_stats(chunks), queries)
        return top_k(scores, k)
    vocabulary = terms.select("term").distinct()
    found = (chunks.select(F.explode(F.array_distinct(tokens("text"))).alias("term"))
             .join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    weighted = (terms.join(found, "term").join(F.broadcast(corpus_stats(chunks)))
                .select("query_id", "term", "avg_len", (F.col("qtf") * idf_expr(F.col("n_docs"), F.col("df"))).alias("weight")).toPandas())
    rows = chunks.select("chunk_id", tokens("text").alias("ts")).withColumn("len", F.size("ts").cast("bigint"))
    partial = _score_in_place(rows, weighted, k)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gain(tf: Column, length: Column, avg_len: Column) -> Column:
    """What a term frequency is worth in a chunk of a length, before the weight of the term."""
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / avg_len))


def posting_bounds(posting: DataFrame) -> DataFrame:
    """(term, block, tf, len, best): no posting of the block is worth more than ``tf`` in
    ``len``, whatever the average length of the chunks becomes; ``best`` is one of them."""
    # both in one number: a struct would be aggregated by sorting all postings
    pair = F.shiftleft(F.col("tf"), 32) + F.col("len")
    found = posting.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("len").alias("len"),
                                                 F.max_by(pair, F.col("tf") / F.sqrt(F.greatest("len", F.lit(1)))).alias("best"))
    return found.withColumn("best", F.struct(F.shiftright("best", 32).alias("tf"), F.col("best").bitwiseAND(0xFFFFFFFF).alias("len")))


def posting_tops(bounds: DataFrame, k: int = TOP_K) -> DataFrame:
    """(term, best): good postings of ``k`` different chunks, as (tf, len), of every term
    found in so many blocks. The least of them is a lower bound for the k-th score of any
    query with the term."""
    order = [F.desc(F.col("best.tf") / F.sqrt(F.greatest("best.len", F.lit(1)))), F.asc("block")]
    first = bounds.withColumn("_r", F.row_number().over(W.partitionBy("term").orderBy(*order))).where(F.col("_r") <= k)
    return first.groupBy("term").agg(F.collect_list("best").alias("best")).where(F.size("best") == k)


def index_terms(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, term, avg_len, weight) of the query terms that the index holds."""
    return query_terms(queries).join(index["df"], "term").join(F.broadcast(index["stats"])).select(
        "query_id", "term", "avg_len", (F.col("qtf") * idf_expr(F.col("n_docs"), F.col("df"))).alias("weight"))


def bm25_index_topk(index: dict[str, DataFrame], queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The result of :func:`bm25_topk` for many queries, from stored term counts.

    No text is read or cut: the counts of every chunk are stored in its row, so the terms
    travel to them as in :func:`bm25_topk`. A term set beyond QUERY_TERMS rows takes the
    shuffled join with the postings.
    """
    terms = cut(index_terms(index, queries))
    if not has_at_most(terms, QUERY_TERMS):
        return bm25_lookup_topk(index, queries, k)
    return top_k(_score_in_place(index["forward"].select("chunk_id", "len", "ts", "tfs"), terms.toPandas(), k), k)


def forward_counts(posting: DataFrame) -> DataFrame:
    """(chunk_id, len, ts, tfs): the postings of a chunk in its own row."""
    return (posting.groupBy("chunk_id").agg(F.first("len").alias("len"), F.collect_list(F.struct("term", "tf")).alias("p"))
            .select("chunk_id", "len", F.col("p.term").alias("ts"), F.col("p.tf").alias("tfs")))


def stored_counts(chunks: DataFrame) -> DataFrame:
    """The :func:`forward_counts` of ``chunks(chunk_id, text)``, counted where a chunk is, so
    that neither texts nor words are shuffled. Rows that share an id are one chunk; only
    these are brought together."""
    base = chunks.select("chunk_id", tokens("text").alias("ts"), F.size(tokens("text")).cast("bigint").alias("len"))
    schema = f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, len bigint, ts array<string>, tfs array<bigint>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts = batch.column("ts")
            words = ts.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(batch)), ts.value_lengths().to_numpy(zero_copy_only=False))
            cell, tf = np.unique(row * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
            starts = np.searchsorted(cell, np.arange(len(batch) + 1) * len(words.dictionary)).astype(np.int32)
            terms = words.dictionary.take(pa.array(cell % max(1, len(words.dictionary))))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("len"), pa.ListArray.from_arrays(starts, terms),
                                              pa.ListArray.from_arrays(starts, pa.array(tf, pa.int64()))], ["chunk_id", "len", "ts", "tfs"])

    def counted(rows: DataFrame) -> DataFrame:
        return rows.where("len > 0").mapInArrow(count, schema)
    repeated = cut(chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("chunk_id").alias("_id")))
    if repeated.isEmpty():
        return counted(base)
    same, few = F.col("chunk_id").eqNullSafe(F.col("_id")), broadcast_within(repeated, QUERY_TERMS)
    return counted(base.join(few, same, "left_anti")).unionByName(forward_counts(postings(chunks.join(few, same, "left_semi"))))


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Array, dict[str, np.ndarray]]]:
    """The postings of rows ``(chunk_id, len, ts, tfs, block)`` in runs of about RUN_ROWS,
    each by term and block: its rows, their terms in order, and by posting row, term and numbers.
    The rows of a block are neighbours and are kept together."""
    def run(table: pa.Table) -> tuple[pa.Array, dict[str, np.ndarray]]:
        ts, tfs = table["ts"].combine_chunks(), table["tfs"].combine_chunks()
        words = ts.flatten().dictionary_encode()
        by_term = pc.sort_indices(words.dictionary)
        place = np.empty(len(by_term), np.int64)
        place[by_term.to_numpy()] = np.arange(len(by_term))
        row = np.repeat(np.arange(len(table)), ts.value_lengths().to_numpy(zero_copy_only=False))
        term, block = place[words.indices.to_numpy()], table["block"].to_numpy()[row]
        order = np.lexsort((block, term))
        row = row[order]
        return words.dictionary.take(by_term), {"row": row, "term": term[order], "block": block[order], "tf": tfs.flatten().to_numpy()[order], "len": table["len"].to_numpy()[row]}

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch.column("ts").flatten())
        if rows >= RUN_ROWS:
            table = pa.Table.from_batches(held)
            block = table["block"].to_numpy()
            whole = int(np.argmax(block == block[-1]))
            if whole:
                yield table.slice(0, whole), *run(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                rows = sum(len(b.column("ts").flatten()) for b in held)
    if rows:
        table = pa.Table.from_batches(held)
        yield table, *run(table)


def run_postings(forward: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, len, block) of stored counts with their block. A task writes them
    in runs by term and block: no posting is shuffled and a hot term is in many files."""
    kind = forward.schema["chunk_id"].dataType.simpleString()

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, terms, p in _sorted_runs(batches):
            out = pa.table([table["chunk_id"].combine_chunks().take(pa.array(p["row"])), terms.take(pa.array(p["term"])), p["tf"], p["len"], p["block"]],
                           names=["chunk_id", "term", "tf", "len", "block"])
            yield from out.to_batches(max_chunksize=1 << 16)
    return (forward.select("chunk_id", "len", "ts", "tfs", "block")
            .mapInArrow(spread_out, f"chunk_id {kind}, term string, tf bigint, len bigint, block bigint"))


def run_bounds(forward: DataFrame) -> DataFrame:
    """The :func:`posting_bounds` of the :func:`run_postings`, made where a block is. A block
    that a reader of the files cuts in two has a row for either part; what is added up or
    taken from them remains a bound."""
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, terms, p in _sorted_runs(batches):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(p["term"]) != 0) | (np.diff(p["block"]) != 0)]))
            worth = p["tf"] / np.sqrt(np.maximum(p["len"], 1))
            top = np.flatnonzero(worth == np.repeat(np.maximum.reduceat(worth, new), np.diff(np.append(new, len(worth)))))
            best = top[np.searchsorted(top, new)]
            pair = pa.StructArray.from_arrays([pa.array(p["tf"][best]), pa.array(p["len"][best])], ["tf", "len"])
            out = pa.table([terms.take(pa.array(p["term"][new])), p["block"][new], np.maximum.reduceat(p["tf"], new), np.minimum.reduceat(p["len"], new), pair],
                           names=["term", "block", "tf", "len", "best"])
            yield from out.to_batches(max_chunksize=1 << 16)
    return (forward.select("chunk_id", "len", "ts", "tfs", "block")
            .mapInArrow(bound, "term string, block bigint, tf bigint, len bigint, best struct<tf: bigint, len: bigint>"))


def bm25_lookup_topk(index: dict[str, DataFrame], queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The result of :func:`bm25_topk` for few queries: only their terms' postings are read.

    Blocks of chunks that cannot hold a hit are skipped: the best postings of a term give a
    score that k chunks reach for certain, the bounds of a block the most that a chunk in it
    can reach over all terms of the query. Only postings of the other blocks are scored.
    """
    terms = broadcast_within(cut(index_terms(index, queries)), QUERY_TERMS)

    def worth(tf: Column, length: Column) -> Column:
        return F.col("weight") * gain(tf, length, F.col("avg_len"))
    reached = (index["tops"].join(terms, "term").where(F.size("best") >= k)
               .select("query_id", F.array_min(F.transform("best", lambda b: worth(b["tf"], b["len"]))).alias("least"))
               .groupBy("query_id").agg(F.max("least").alias("least")))
    live = (index["bounds"].drop("best").join(terms, "term").groupBy("query_id", "block").agg(F.sum(worth(F.col("tf"), F.col("len"))).alias("most"))
            .join(reached, "query_id", "left").where(F.col("most") >= F.coalesce("least", F.lit(0.0)) - 1e-6).select("query_id", "block"))
    scores = (index["postings"].join(terms, "term").join(live, ["query_id", "block"])
              .groupBy("query_id", "chunk_id").agg(F.round(F.sum(worth(F.col("tf"), F.col("len"))), 6).alias("score")).where("score > 0"))
    return top_k(scores, k)


def _score_in_place(rows: DataFrame, weighted: pd.DataFrame, k: int | None) -> DataFrame:
    """(query_id, chunk_id, score), k a query and task, of ``rows(chunk_id, len, ts)``; with
    a column ``tfs`` the terms are different ones and these are their counts. Without ``k``
    all positive scores, not rounded."""
    schema = "query_id bigint, chunk_id bigint, score double"
    spark = rows.sparkSession
    if not len(weighted):
        return spark.createDataFrame([], schema)
    weighted = weighted.sort_values("term", kind="stable")
    vocabulary, starts = np.unique(weighted["term"].to_numpy(dtype=object).astype(str), return_index=True)
    query_ids, query_no = np.unique(weighted["query_id"].to_numpy(), return_inverse=True)
    shared = spark.sparkContext.broadcast((vocabulary, np.append(starts, len(weighted)), query_ids, query_no,
                                           weighted["weight"].to_numpy(), float(weighted["avg_len"].iloc[0])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, first, qids, qno, weight, avg_len = shared.value
        index = pd.Index(words)
        step = max(1, SCORE_CELLS // len(qids))
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at:at + step]
                rows = np.repeat(np.arange(len(part)), part["ts"].map(len).to_numpy())
                if not len(rows):
                    continue
                term = index.get_indexer(np.concatenate(part["ts"].to_numpy()))
                keep = term >= 0
                if "tfs" in part:
                    row, term, tf = rows[keep], term[keep], np.concatenate(part["tfs"].to_numpy())[keep]
                else:
                    cell, tf = np.unique(rows[keep] * len(words) + term[keep], return_counts=True)
                    row, term = cell // len(words), cell % len(words)
                length = part["len"].to_numpy()[row]
                gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))
                # one entry per posting and query that asks for its term
                asks = first[term + 1] - first[term]
                entry = np.repeat(np.arange(len(term)), asks)
                slot = np.arange(len(entry)) - np.repeat(np.cumsum(asks) - asks, asks) + first[term][entry]
                scores = np.bincount(qno[slot] * len(part) + row[entry], weights=gain[entry] * weight[slot],
                                     minlength=len(qids) * len(part)).reshape(len(qids), len(part))
                if k is None:
                    q, c = np.nonzero(scores > 0)
                    yield pd.DataFrame({"query_id": qids[q], "chunk_id": part["chunk_id"].to_numpy()[c], "score": scores[q, c]})
                    continue
                yield best_per_query(qids, np.round(scores, 6), part["chunk_id"].to_numpy(), k)

    if k is None:
        return rows.mapInPandas(run, schema)
    return rows.mapInPandas(lambda batches: best_of_task(run(batches), k, "chunk_id"), schema)


def best_per_query(query_ids: np.ndarray, scores: np.ndarray, item_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best positive scores of each row of a matrix, ties by item id."""
    least = np.zeros((len(scores), 1))
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    row, col = np.nonzero((scores >= least) & (scores > 0))
    order = np.lexsort((item_ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col = row[keep], col[keep]
    return pd.DataFrame({"query_id": query_ids[row], "chunk_id": item_ids[col], "score": scores[row, col]})


def merge_df(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Document frequencies after appending chunks, without a rebuild."""
    return old.unionByName(delta).groupBy("term").agg(F.sum("df").alias("df"))


def merge_stats(old: DataFrame, delta: DataFrame) -> DataFrame:
    return (old.unionByName(delta)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
            .withColumn("avg_len", F.col("total_len") / F.col("n_docs")))


def subtract_df(old: DataFrame, removed: DataFrame) -> DataFrame:
    """Document frequencies after dropping chunks; terms that reach zero vanish."""
    gone = removed.select("term", (-F.col("df")).alias("df"))
    return (old.unionByName(gone).groupBy("term").agg(F.sum("df").alias("df"))
            .where("df > 0"))


def covered(names: DataFrame, index: dict[str, DataFrame] | None, threshold: float = 0.5) -> DataFrame:
    """(name, covered): whether the best hit for the name in a stored index reaches the
    threshold; null without an index.

    One hit a name is asked for, so blocks of postings that cannot hold a better one are
    skipped and no name meets every chunk that shares a word with it.
    """
    asked = names.select(F.col("name").alias("query")).where("query is not null").distinct()
    if index is None:
        return asked.select(F.col("query").alias("name"), F.lit(None).cast("int").alias("covered"))
    # names with the same terms are asked once; the term list is the query
    terms = asked.withColumn("key", F.array_join(F.array_sort(tokens("query")), " "))
    best = (_best_score(index, terms.select("key").distinct()).select("key", "best"))
    return (terms.join(best, "key", "left")
            .select(F.col("query").alias("name"), (F.coalesce("best", F.lit(0.0)) >= threshold).cast("int").alias("covered")))


def _best_score(index: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """(key, best): the best score of each query text."""
    asked = keys.select(F.xxhash64("key").alias("query_id"), "key")
    hits = bm25_lookup_topk(index, asked.select("query_id", F.col("key").alias("query")), 1)
    return asked.join(hits.select("query_id", F.col("score").alias("best")), "query_id")
