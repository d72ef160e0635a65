"""Embedding, exact nearest neighbours and leader clustering."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions.scale import best_of_task, cut
from scholia.functions.text import tokens

DIM = 64
QUERY_BLOCK = 4096
ITEM_BLOCK = 65536
#: Scores that a task holds at once.
SCORE_CELLS = 4_000_000
#: Items whose best score stands for them when a lower bound of the k-th best is looked for.
GROUP = 64
#: Undecided rows that one task may settle alone.
GREEDY_ROWS = 4096


# ---- embedding -------------------------------------------------------------

def hashed_vector(text: Column | str, dim: int = DIM) -> Column:
    """Offline default embedder: hashed term counts, L2-normalised, in the JVM."""
    buckets = F.transform(tokens(text), lambda t: F.conv(F.left(F.md5(t), F.lit(8)), 16, 10).cast("bigint") % dim)
    counted = F.aggregate(buckets, F.array_repeat(F.lit(0).cast("double"), dim),
                          lambda acc, b: F.transform(acc, lambda v, i: v + (i == b).cast("double")))
    return normalised(counted)


def normalised(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return F.transform(vec, lambda v: F.when(norm > 0, v / norm).otherwise(F.lit(0.0)))


def embed_hashed(df: DataFrame, text_col: str = "text", out: str = "embedding", dim: int = DIM) -> DataFrame:
    """The same vectors as :func:`hashed_vector`, one Arrow batch at a time.

    The JVM tokenises; a task hashes every different token of a batch once and counts the
    buckets of the batch together, instead of touching all ``dim`` slots once per token. A
    null text has no tokens.
    """
    def bucket(token: str) -> int:
        return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % dim

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            words = batch.flatten().dictionary_encode()
            hashed = np.fromiter(map(bucket, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            cells = np.repeat(np.arange(len(batch)), sizes) * dim + hashed[words.indices.to_numpy()]
            rows = np.bincount(cells, minlength=len(batch) * dim).astype(float).reshape(len(batch), dim)
            yield pa.ListArray.from_arrays(np.arange(0, (len(batch) + 1) * dim, dim, dtype=np.int32), _unit(rows).ravel())

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(count, "array<double>")(tokens(text_col)))


def embed_batch(df: DataFrame, load_model: Callable[[], Callable[[list[str]], np.ndarray]],
                text_col: str = "text", out: str = "embedding", batch: int = 32) -> DataFrame:
    """Embed with a pluggable model, loaded once per Python worker.

    ``load_model`` returns a function from a list of texts to a matrix of rows.
    """
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for series in batches:
            rows = []
            for at in range(0, len(series), batch):
                rows.extend(np.asarray(model(series.iloc[at:at + batch].tolist()), dtype=float))
            yield pd.Series(rows, index=series.index)

    return df.withColumn(out, run(F.col(text_col)))


def fill_cache(items: DataFrame, cache: DataFrame, key: str, text_col: str, dim: int = DIM) -> DataFrame:
    """Embed only keys that are not cached (the smallest text of a key); returns the merged cache."""
    missing = items.join(cache.select(key), key, "left_anti").groupBy(key).agg(F.min(text_col).alias("_text"))
    return cache.select(key, "embedding").unionByName(
        embed_hashed(missing, "_text", dim=dim).select(key, "embedding"))


# ---- similarity ------------------------------------------------------------

def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, v) -> s + v)")


def cosine(a: str, b: str) -> Column:
    """0 when either norm is 0; null when either vector is missing."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).when(norms == 0, 0.0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.asarray(col.tolist(), dtype=np.float64) if len(col) else np.zeros((0, 0))


def _best_rows(query_ids: np.ndarray, scores: np.ndarray, item_ids: np.ndarray, k: int, skip_self: bool) -> pd.DataFrame:
    """Top k per query row of a score matrix, ties by item id."""
    if skip_self:
        scores = np.where(item_ids[None, :] == query_ids[:, None], -np.inf, scores)
    if scores.shape[1] > k:
        bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        row, col = np.nonzero((scores >= bar) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    score = scores[row, col]
    order = np.lexsort((item_ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return pd.DataFrame({"query_id": query_ids[row[keep]], "item_id": item_ids[col[keep]], "score": score[keep]})


def _nearest(query_ids: np.ndarray, queries: np.ndarray, item_ids: np.ndarray, items: np.ndarray, k: int, skip_self: bool) -> pd.DataFrame:
    """The k nearest items of each query, ties by item id; rows of the matrices are unit rows.

    Products in single precision find what can be among the k best within their error, a few
    more than k a query; scores are made from these in double precision. The k-th of the best
    of GROUP items each is a lower bound for the k-th best, so no row of scores is sorted.
    """
    if not len(queries) or not len(items):
        return pd.DataFrame({"query_id": query_ids[:0], "item_id": item_ids[:0], "score": np.zeros(0)})
    single, n = np.ascontiguousarray(items.T, dtype=np.float32), len(items)
    error = 2 * (1.2e-7 * (items.shape[1] + 4) + 1e-6)
    groups = n // GROUP
    by_id = np.argsort(item_ids, kind="stable")
    step, out = max(1, SCORE_CELLS // n), []
    for at in range(0, len(queries), step):
        ids, mine = query_ids[at:at + step], queries[at:at + step]
        scores = mine.astype(np.float32) @ single
        if skip_self:
            low, high = (np.searchsorted(item_ids, ids, side, sorter=by_id) for side in ("left", "right"))
            own = np.repeat(np.arange(len(ids)), high - low)
            scores[own, by_id[np.arange(len(own)) - np.repeat(np.cumsum(high - low) - high, high - low)]] = -np.inf
        least = np.full((len(ids), 1), -np.inf, np.float32)
        if groups >= 2 * k:
            best = scores[:, :groups * GROUP].reshape(len(ids), GROUP, groups).max(axis=1)
            least = np.partition(best, groups - k, axis=1)[:, groups - k, None]
        elif n > k:
            least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        row, col = np.nonzero((scores >= least - np.float32(error)) & (scores > -np.inf))
        score = np.round(np.einsum("ij,ij->i", mine[row], items[col]), 6)
        order = np.lexsort((item_ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append(pd.DataFrame({"query_id": ids[row[keep]], "item_id": item_ids[col[keep]], "score": score[keep]}))
    return pd.concat(out, ignore_index=True)


def knn_topk(queries: DataFrame, items: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """Exact top k by cosine: (query_id, item_id, score, rank).

    ``queries(query_id, qvec)``, ``items(item_id, ivec)``, both ids BIGINT. No pair
    table is built: each task multiplies a block of items with a block of queries
    and emits only its k best per query. Up to QUERY_BLOCK queries are shipped
    once to every task and the items are not shuffled at all; beyond that both
    sides are cut into blocks of bounded size. Missing vectors are no hits and find none.
    """
    spark = items.sparkSession
    complete = "{0} is not null and not exists({0}, v -> v is null)"
    queries, items = queries.where(complete.format("qvec")), items.where(complete.format("ivec"))
    schema = "query_id bigint, item_id bigint, score double"
    found = queries.limit(QUERY_BLOCK + 1).count()
    if found <= QUERY_BLOCK:
        rows = queries.select("query_id", "qvec").toPandas()
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), _unit(_matrix(rows["qvec"]))))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, qmat = shared.value
            for pdf in batches:
                if len(pdf) and len(qids):
                    yield _nearest(qids, qmat, pdf["item_id"].to_numpy(), _unit(_matrix(pdf["ivec"])), k, skip_self)

        partial = items.select("item_id", "ivec").mapInPandas(lambda batches: best_of_task(scan(batches), k, "item_id"), schema)
    else:
        partial = _knn_blocks(queries, items, k, skip_self, schema)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _knn_blocks(queries: DataFrame, items: DataFrame, k: int, skip_self: bool, schema: str) -> DataFrame:
    """Blocks of at most about ITEM_BLOCK rows of either side meet in cells, of which there
    are some for every core; a cell holds its two blocks and SCORE_CELLS scores."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    iblocks = _blocks_of(items, ITEM_BLOCK)
    qblocks = max(_blocks_of(queries, ITEM_BLOCK), -(-2 * cores // iblocks))

    def side(df: DataFrame, id_col: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))))
    q = side(queries.select("query_id", "qvec"), "query_id", "_q", qblocks, "_i", iblocks)
    i = side(items.select("item_id", "ivec"), "item_id", "_i", iblocks, "_q", qblocks)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        # a side without rows in this cell comes without its columns
        if "qvec" not in left.column_names or "ivec" not in right.column_names:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query_id", "item_id", "score"])
        found = _nearest(left["query_id"].to_numpy(), _arrow_unit(left, "qvec"), right["item_id"].to_numpy(), _arrow_unit(right, "ivec"), k, skip_self)
        return pa.Table.from_pandas(found, preserve_index=False)

    return (q.groupBy("_q", "_i").cogroup(i.groupBy("_q", "_i"))
            .applyInArrow(cell, schema))


def knn_threshold(queries: DataFrame, items: DataFrame, limit: int, min_score: float,
                  skip_self: bool = False) -> DataFrame:
    """Vector-only search: the first ``limit`` hits, then the score floor."""
    return knn_topk(queries, items, limit, skip_self).where(F.col("score") >= min_score)


# ---- leader clustering -----------------------------------------------------

#: Place in the order that is later than every known leader's.
_NOW = 1 << 62


def _arrow_unit(table: pa.Table, col: str = "vec") -> np.ndarray:
    """The vectors of an Arrow column as unit rows of a matrix."""
    vec = table[col].combine_chunks()
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return _unit(flat.reshape(len(vec), -1)) if len(vec) else np.zeros((0, 0))


def _blocks_of(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def first_near(rows: DataFrame, leaders: DataFrame, min_score: float) -> DataFrame:
    """(pos, m): for every row near an earlier leader the first such one, ``m(seq, pos, id)``.

    Both sides are ``(seq, pos, id, vec)`` and are cut into blocks of ITEM_BLOCK rows that
    meet in cells on the cluster. A cell multiplies two bounded matrices and returns one
    row at most for each of its rows, so no pair table exists however dense the neighbours
    are, and no vector comes to the driver. The result is cut off from both sides, so that
    it can be joined with them again.
    """
    left_n, right_n = _blocks_of(rows, ITEM_BLOCK), _blocks_of(leaders, ITEM_BLOCK)

    def side(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return (df.select("seq", "pos", "id", "vec", F.pmod(F.xxhash64("pos"), F.lit(n)).alias(own))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))))

    names = ["pos", "lseq", "lpos", "lid"]

    def cell(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        # a side without rows in this cell comes without its columns
        if not {"vec"} <= set(mine.column_names) & set(theirs.column_names) or not len(mine) or not len(theirs):
            return pa.table([pa.array([], pa.int64())] * len(names), names=names)
        theirs = theirs.sort_by([("seq", "ascending"), ("pos", "ascending")])
        a, b = _arrow_unit(mine), _arrow_unit(theirs)
        hit, first = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        earlier = np.searchsorted(_places(theirs), _places(mine), side="left")
        step = max(1, SCORE_CELLS // len(b))
        for at in range(0, len(a), step):
            near = np.round(a[at:at + step] @ b.T, 6) >= min_score
            near &= np.arange(len(b)) < earlier[at:at + step, None]
            hit[at:at + step], first[at:at + step] = near.any(axis=1), near.argmax(axis=1)
        found = theirs.select(["seq", "pos", "id"]).take(first[hit])
        return pa.table([mine["pos"].filter(pa.array(hit)), *found.columns], names=names)

    cells = side(rows, "_l", left_n, "_r", right_n).groupBy("_l", "_r").cogroup(side(leaders, "_r", right_n, "_l", left_n).groupBy("_l", "_r"))
    return cut(cells.applyInArrow(cell, "pos bigint, lseq bigint, lpos bigint, lid bigint")
               .groupBy("pos").agg(F.min(F.struct(F.col("lseq").alias("seq"), F.col("lpos").alias("pos"), F.col("lid").alias("id"))).alias("m")))


def _places(table: pa.Table) -> np.ndarray:
    """Sortable (seq, pos) of a table."""
    out = np.empty(len(table), dtype=[("seq", np.int64), ("pos", np.int64)])
    out["seq"], out["pos"] = table["seq"].to_numpy(), table["pos"].to_numpy()
    return out


def _lead_alone(rows: DataFrame, min_score: float) -> DataFrame:
    """Leaders among a bounded number of rows, taken one after the other in one task."""
    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        mat = _arrow_unit(table)
        open_, leads = np.ones(len(table), bool), np.zeros(len(table), bool)
        for n in range(len(table)):
            if open_[n]:
                leads[n] = True
                open_[n:] &= np.round(mat[n:] @ mat[n], 6) < min_score
        return table.filter(pa.array(leads)).drop_columns(["_all"])
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(pick, rows.schema)


def _independent(rows: DataFrame, min_score: float, greedy_rows: int) -> DataFrame:
    """The rows that lead when ``rows`` are taken in order of ``pos``.

    In rounds: a row without an undecided earlier neighbour leads, and the neighbours of
    leaders are decided. The rounds follow the longest chain of neighbours in order; what
    is left is taken in one task once it is no more than ``greedy_rows`` rows.
    """
    found, open_ = [], rows
    while open_.count() > greedy_rows:
        lead = cut(open_.join(first_near(open_, open_, min_score).select("pos"), "pos", "left_anti").select(*rows.columns))
        found.append(lead)
        decided = first_near(open_, lead, min_score).select("pos").unionByName(lead.select("pos"))
        open_ = cut(open_.join(decided, "pos", "left_anti").select(*rows.columns))
    out = _lead_alone(open_, min_score)
    for lead in found:
        out = out.unionByName(lead)
    return cut(out)


def near_dup_leaders(items: DataFrame, min_score: float = 0.85, known: DataFrame | None = None, order: str = "id",
                     greedy_rows: int = GREEDY_ROWS) -> DataFrame:
    """(id, leader_id): each row, in the order of ``order`` (a number of its own for every
    id), joins the first earlier leader within ``min_score`` cosine, else becomes a leader
    whose vector never moves.

    Equal vectors always share their leader, so copies are collapsed first. The rest is
    decided in prefixes of the order that grow fourfold: what no earlier leader has taken
    gives the leaders of the prefix (:func:`_independent`), which are then offered to all
    that is undecided. So dense groups of near copies are gone before they can meet
    themselves, and the number of prefixes grows with the logarithm of the rows.

    ``known(id, vec)``: leaders of earlier runs, tried first, in id order; with a column
    ``seq`` (say the batch they arrived in) in the order of seq and id, or of seq and
    ``order`` if they have that column. A row with a null vector or one without length
    resembles nothing, not even another one, and leads itself.
    """
    alone = F.coalesce(~F.exists("vec", lambda v: v != 0), F.lit(True))
    rows = cut(items.select("id", "vec", F.col(order).cast("bigint").alias("pos")))
    source, lonely = rows.where(~alone), rows.where(alone).select("id", F.col("id").alias("leader_id"))
    todo = cut(source.groupBy("vec").agg(F.min(F.struct("pos", "id")).alias("m"))
               .select(F.lit(_NOW).alias("seq"), "m.pos", "m.id", "vec"))
    settled, columns = [], todo.columns

    def offer(leaders: DataFrame) -> None:
        nonlocal todo
        near = first_near(todo, leaders, min_score).select("pos", F.col("m.id").alias("leader_id"))
        settled.append(todo.join(near, "pos").select("vec", "leader_id"))
        todo = todo.join(near, "pos", "left_anti").select(*columns)

    if known is not None:
        place = order if order in known.columns else "id"
        earlier = known if "seq" in known.columns else known.withColumn("seq", F.lit(0))
        offer(cut(earlier.where(F.exists("vec", lambda v: v != 0))
                  .select(F.col("seq").cast("bigint").alias("seq"), F.col(place).cast("bigint").alias("pos"), "id", "vec")))
    size = greedy_rows
    while left := todo.count():
        block = todo
        if left > size:
            # a little less than size, as the bound is an estimate
            bound = todo.agg(F.percentile_approx("pos", 0.9 * size / left, 10_000)).first()[0]
            block = todo.where(F.col("pos") <= bound)
        leaders = _independent(block, min_score, greedy_rows)
        settled.append(leaders.select("vec", F.col("id").alias("leader_id")))
        todo = todo.join(leaders.select("pos"), "pos", "left_anti").select(*columns)
        offer(leaders)
        todo = cut(todo)
        size *= 4
    out = lonely
    if settled:
        decided = settled[0]
        for piece in settled[1:]:
            decided = decided.unionByName(piece)
        out = source.join(decided, "vec").select("id", "leader_id").unionByName(lonely)
    return out


def mentions(assigned: DataFrame) -> DataFrame:
    """(leader_id, mentions) of a clustering."""
    return assigned.groupBy("leader_id").agg(F.count(F.lit(1)).alias("mentions"))


# ---- recommendation --------------------------------------------------------

def recommend(profiles: DataFrame, catalog: DataFrame, installed: DataFrame, limit: int = 32) -> DataFrame:
    """Best items per profile that are not installed, at most the free slots.

    ``profiles(query_id, qvec)``, ``catalog(item_id, name, ivec)``, ``installed(query_id,
    name)``; names are compared without regard to case. An item without a vector scores 0.
    With ``used`` installed names there are ``limit - used`` slots. Names are unique in the
    catalog, so at most ``used`` of the first ``limit`` neighbours are hidden and those suffice.
    """
    mine = installed.select("query_id", F.lower("name").alias("name")).distinct()
    used = mine.groupBy("query_id").agg(F.count(F.lit(1)).alias("used"))
    # a vector without length has the cosine 0 with everything
    whole = F.col("ivec").isNotNull() & ~F.exists("ivec", lambda v: v.isNull())
    known = catalog.select("item_id", F.lower("name").alias("name"), F.when(whole, F.col("ivec")).alias("ivec"))
    dim = F.broadcast(known.agg(F.coalesce(F.max(F.size("ivec")), F.lit(1)).alias("dim")))
    filled = known.join(dim).withColumn("ivec", F.coalesce("ivec", F.transform(F.sequence(F.lit(1), F.greatest("dim", F.lit(1))), lambda i: i.cast("double") * 0)))
    hits = knn_topk(profiles, filled.select("item_id", "ivec"), limit).drop("rank").join(known.select("item_id", "name"), "item_id")
    free = hits.join(mine, ["query_id", "name"], "left_anti").join(used, "query_id", "left")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return (free.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.greatest(F.lit(0), F.lit(limit) - F.coalesce("used", F.lit(0))))
            .select("query_id", "item_id", "score", "rank"))


def best_per_name(hits: DataFrame, k: int = 8, snippet: int = 60) -> DataFrame:
    """Best score and its snippet per (query, name), then the k best names."""
    best = hits.groupBy("query_id", "name").agg(
        F.max("score").alias("score"),
        F.min_by(F.trim(F.left(F.regexp_replace("text", "\n", " "), F.lit(snippet))),
                 F.struct(-F.col("score"), F.col("rank"))).alias("snippet"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("name"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def relevance_split(scored: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Rows above / below the threshold and rows without a score."""
    s = F.col("score")
    return scored.agg(F.count_if(s >= threshold).alias("relevant"),
                      F.count_if(s < threshold).alias("irrelevant"),
                      F.count_if(s.isNull()).alias("unscored"))
