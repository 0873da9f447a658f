"""Candidate generators without fitted models."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.functions.hashing import hash_int
from rankspark.operators.ranking import md5_bucket_row_number


def propose_random(queries: DataFrame, vocab: DataFrame, k: int, seed, query="query_id", context="context",
                   candidate="candidate") -> DataFrame:
    """K distinct hash-drawn candidates of the query's context, of the whole vocabulary when it has none."""
    pools = vocab.select(F.concat(F.lit("c|"), context).alias("_pool"), candidate).distinct().unionByName(
        vocab.select(F.lit("all").alias("_pool"), candidate).distinct())
    seats = md5_bucket_row_number(pools, seed, [candidate], "_p", within=["_pool"], digits=2)
    size = pools.groupBy("_pool").agg(F.count("*").alias("_n"))
    own = F.concat(F.lit("c|"), F.col(context))
    have = size.select(F.col("_pool").alias("_have"))
    q = queries.join(have, own == F.col("_have"), "left").withColumn(
        "_pool", F.when(F.col("_have").isNotNull(), own).otherwise(F.lit("all"))).join(size, "_pool")
    places = F.least(F.lit(k), F.col("_n")).cast("int")
    w = (q.withColumn("rank", F.explode(F.sequence(F.lit(1), places)))
         .withColumn("_p", F.pmod(hash_int(F.concat_ws("|", F.lit(str(seed)), query)) + F.col("rank") - 1, F.col("_n")) + 1))
    return w.join(seats, ["_pool", "_p"]).select(query, candidate, "rank",
                                                 F.when(F.col("_pool") == "all", 1).otherwise(0).alias("fallback"))


def propose_frequency(queries: DataFrame, positives: DataFrame, k: int, levels: Sequence[tuple[str, Sequence[str]]],
                      query="query_id", candidate="candidate") -> DataFrame:
    """R2: the k most frequent candidates at the first level that knows the query's key.

    Lists are cut once per key, not per query; a query only picks one of the lists.
    """
    q = queries
    picked, level = F.lit(None), F.lit(None).cast("string")
    lists = []
    for name, keys in levels:
        keys = list(keys)
        c = positives.groupBy(*keys, candidate).agg(F.count("*").alias("_n"))
        if keys:
            w = Window.partitionBy(*keys).orderBy(F.desc("_n"), candidate)
            top = c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        else:
            top = c.orderBy(F.desc("_n"), candidate).limit(k).withColumn(
                "_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_n"), candidate)))
        agg = F.array_sort(F.collect_list(F.struct(F.col("_r").alias("rank"), F.col(candidate).alias("c"),
                                                   F.col("_n").alias("n")))).alias(f"_l_{name}")
        if keys:
            q = q.join(top.groupBy(*keys).agg(agg), keys, "left")
        else:
            q = q.withColumn(f"_l_{name}", top.agg(agg).scalar())
        lists.append((name, F.col(f"_l_{name}")))
    picked = F.coalesce(*[c for _, c in lists])
    for name, c in reversed(lists):
        level = F.when(c.isNotNull(), name).otherwise(level)
    return (q.select(query, level.alias("level"), F.explode(picked).alias("_e"))
            .select(query, F.col("_e.c").alias(candidate), F.col("_e.rank").alias("rank"), F.col("_e.n").alias("n"),
                    "level", F.when(F.col("level") == levels[0][0], 0).otherwise(1).alias("fallback")))


def two_stage(log_freq, model, weight: float = 0.3) -> Column:
    """0.3 * log frequency / 10 + 0.7 * model score."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.lit(weight) * c(log_freq) / F.lit(10.0) + F.lit(1.0 - weight) * c(model)


def baseline_summary(q: DataFrame, method="method", random_hit="random_hit10") -> DataFrame:
    """Coverage, fallback share, recovery, MRR and enrichment over random, per baseline."""
    return q.groupBy(method).agg(
        F.count("*").alias("n"), F.avg("covered").alias("coverage"), F.avg("fallback").alias("fallback_rate"),
        *[F.avg(c).alias(c) for c in ("hit1", "hit5", "hit10", "mrr")],
        (F.avg("hit10") / F.avg(random_hit)).alias("enrichment10"))
