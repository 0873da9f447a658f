"""Unions, overlaps and memberships of ranked lists."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rankspark.functions.hashing import hash_order
from rankspark.schema import flag


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distractors(everything: DataFrame, targets: DataFrame, known: DataFrame, key: str, seed) -> DataFrame:
    """Keys that are neither targets nor known, with their place in the hash order of ``seed``."""
    left = everything.select(key).distinct().join(targets, key, "left_anti").join(known, key, "left_anti")
    return left.withColumn("place", hash_order(seed, key))


def topk_jaccard(a: DataFrame, b: DataFrame, k: int, query="query_id", candidate="candidate",
                 rank="rank") -> DataFrame:
    """U4: overlap of two top-k lists per query. Lists are at most k long."""
    def lists(df, s):
        return df.where(F.col(rank) <= k).groupBy(query).agg(
            F.collect_set(candidate).alias("_l" + s), F.min_by(candidate, rank).alias("_t" + s))
    j = lists(a, "a").join(lists(b, "b"), query, "full_outer")
    empty = F.array().cast("array<string>")
    la, lb = F.coalesce("_la", empty), F.coalesce("_lb", empty)
    inter, union = F.size(F.array_intersect(la, lb)), F.size(F.array_union(la, lb))
    return j.select(query, (inter / union).alias("jaccard"), flag(inter == union).alias("identical"),
                    flag(~F.col("_ta").eqNullSafe(F.col("_tb"))).alias("top1_differs"))


def mode_membership(lists: DataFrame, mode="mode", query="query_id", candidate="candidate") -> DataFrame:
    """The sorted set of lists that hold a candidate."""
    return (lists.select(query, candidate, mode).distinct().groupBy(query, candidate)
            .agg(F.array_join(F.array_sort(F.collect_list(mode)), "+").alias("membership")))


def merge_methods(lists: DataFrame, methods: Sequence[str], query="query_id", candidate="candidate",
                  method="method") -> DataFrame:
    """One row per (query, candidate): list flags, best rank and score per list, largest label."""
    of = lambda m, c: F.when(F.col(method) == m, F.col(c))
    return lists.groupBy(query, candidate).agg(
        *[flag(F.max(F.col(method) == m)).alias("in_" + m) for m in methods],
        *[F.min(of(m, "rank")).alias("rank_" + m) for m in methods],
        *[F.max_by(of(m, "score"), F.when(F.col(method) == m, -F.col("rank"))).alias("score_" + m) for m in methods],
        F.max("label").alias("label"))


def pool_coverage(ranked: DataFrame, ranks: Sequence[str], ks=(10, 20, 50), query="query_id",
                  label="label") -> DataFrame:
    """T4: size of the union of top-k lists and whether it holds a positive. All ranks stand in one row, so the
    union needs no join: a row is in the pool when its best rank is within k."""
    best = F.least(*[F.col(r) for r in ranks]) if len(ranks) > 1 else F.col(ranks[0])
    per = ranked.withColumn("_b", best).groupBy(query).agg(
        F.sum(label).alias("_p"),
        *[F.sum(flag(F.col("_b") <= k)).alias(f"_n{k}") for k in ks],
        *[F.max(flag((F.col("_b") <= k) & (F.col(label) == 1))).alias(f"_h{k}") for k in ks]).where("_p > 0")
    cells = per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_n{k}").alias("n"),
                                                    F.col(f"_h{k}").alias("h")) for k in ks])).alias("e"))
    return cells.groupBy(F.col("e.k").alias("k")).agg(F.count("*").alias("queries"), F.avg("e.n").alias("mean_pool"),
                                                      F.avg("e.h").alias("possible_hit"))
