"""Exact top-k inner products of quantised vectors, block at a time.

Candidates lie in document-range blocks with a forward index (the block's matrix) and each term's least and largest weight.
A query's bound for a block is the sum over its terms of the larger of weight x least and weight x largest. Each query
visits blocks by falling bound and stops once the bound falls below its k-th score.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import written

#: Rows of a block, rows of a group of either side on average (a task holds one of each, about 64 x 65,536 numbers), and queries
#: that are scored together.
BLOCK, GROUP, QUERIES = 128, 65_536, 4096


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, v (floor(scale x component) as doubles, exact whole numbers). Null vectors, and vectors with a null or
    non-finite component, are left out."""
    x = F.col(f"`{vector}`")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False)) & F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k best (query, candidate, score) of one group of candidates, other than the query's own row."""
    for at in range(QUERIES, len(q), QUERIES):
        yield from search(q_ids[at:at + QUERIES], q[at:at + QUERIES], ids, m, k)
    q_ids, q = q_ids[:QUERIES], q[:QUERIES]
    starts = np.arange(0, len(ids), BLOCK)
    least, most = np.minimum.reduceat(m, starts, axis=0), np.maximum.reduceat(m, starts, axis=0)
    bounds = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth = np.full(len(q), -np.inf)
    best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    for turn in range(len(starts)):
        block = order[:, turn]
        go = np.flatnonzero(bounds[np.arange(len(q)), block] >= kth)  # equal scores may have smaller ids
        if not len(go):
            break
        for b in np.unique(block[go]):  # queries whose next block this is are scored together
            rows = go[block[go] == b]
            lo, hi = starts[b], min(starts[b] + BLOCK, len(ids))
            scores = q[rows] @ m[lo:hi].T
            scores[ids[None, lo:hi] == q_ids[rows, None]] = -np.inf
            better = (scores >= kth[rows, None]).any(axis=1)
            rows, scores = rows[better], scores[better]
            all_s = np.concatenate([best_s[rows], scores], axis=1)
            all_i = np.concatenate([best_i[rows], np.broadcast_to(ids[lo:hi], scores.shape)], axis=1)
            top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best_s[rows], best_i[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
        kth[go] = best_s[go, k - 1]
    for i, j in zip(*np.nonzero(np.isfinite(best_s)), strict=True):
        yield int(q_ids[i]), int(best_i[i, j]), float(best_s[i, j])


def top_k(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every row whose id is divisible by ``every``.

    Ties go to the smaller id; a query with fewer candidates returns them all. The query's own id is no candidate. Shorter
    vectors count as zero in missing places. Null ids and unusable vectors take no part; rows that repeat an id are searched
    and asked once, by their least vector; an empty table gives no rows; other columns are not read.

    Groups of queries meet groups of candidates, each pair in a cogroup of its own: a candidate moves once per group of queries,
    nothing is broadcast, memory is that of one group of each. A limited window keeps the k best.
    """
    rows = written(quantised(df, key, vector, scale).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    n, width, asked = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(F.col("id") % every == 0)).first()
    if not width:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # small tables are spread too
    groups = max(-(-n // GROUP), min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // QUERIES)))
    q_groups = max(1, -(-asked // GROUP))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # ranges of ids make the groups: blocks are ranges of documents
    docs = rows.withColumn("d", F.pmod(F.xxhash64(F.floor(F.col("id") / BLOCK)), F.lit(groups))).withColumn("q", each(q_groups))
    asks = rows.where(F.col("id") % every == 0).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(q_groups))).withColumn("d", each(groups))
    cell = (F.col("q") * groups + F.col("d")).cast("int").alias("cell")
    asks, docs = (x.select(cell, "id", "v").repartition(2 * groups * q_groups, "cell").groupBy("cell") for x in (asks, docs))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id", kind="stable")
        q_ids, ids = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        got = search(q_ids, _matrix(left["v"], width), ids, _matrix(right["v"], width), k) if len(q_ids) and len(ids) else ()
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype("int64")
    scored = asks.cogroup(docs).applyInPandas(run, "query_id long, vec_id long, score long")
    # each task keeps its k best per query before the shuffle
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
