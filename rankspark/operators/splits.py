"""Splits and leakage audits. Members are chosen by hash order, so they depend on no row order."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.functions.hashing import hash_fold, hash_order
from rankspark.operators.ranking import md5_bucket_row_number
from rankspark.schema import flag
from rankspark.session import broadcast_when_small, cut_lineage


def split_values(values: DataFrame, column: str, fraction: float, seed) -> DataFrame:
    """Distinct values with side train / test: the first int(fraction * n) in hash order train, never none nor all."""
    v = values.select(column).where(F.col(column).isNotNull()).distinct()
    n = v.agg(F.count("*"))
    t = md5_bucket_row_number(v, seed, [column], "_i").withColumn("_n", n.scalar())
    cut = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * fraction)))
    return t.select(column, F.when(F.col("_i") <= cut, "train").otherwise("test").alias("side"))


def group_split(df: DataFrame, key: str, fraction: float = 0.7, seed=0, label="label") -> DataFrame:
    """L1: whole positive-support groups to train or test; groups without a positive belong to neither."""
    sides, _ = broadcast_when_small(split_values(df.where(F.col(label) == 1), key, fraction, seed))
    return df.join(sides, key)


def held_flags(df: DataFrame, column: str, sides: DataFrame, strict: bool = False, exclude_test_queries: bool = False,
               query="query_id", label="label") -> DataFrame:
    """``df`` with booleans in_train and in_test, in one pass: the side of each value is joined once, whether a query holds a
    held-out positive is a window over its rows. A table clustered by query needs no other exchange."""
    s = df.join(sides.select(column, F.col("side").alias("_side")), column, "left")
    held = F.coalesce(F.col("_side") == "test", F.lit(False))
    whole = F.max((F.col(label) == 1) & held).over(Window.partitionBy(query))
    s = s.withColumn("_held", held).withColumn("_asked", F.coalesce(whole, F.lit(False)))
    if strict:
        train, test = F.coalesce(F.col("_side") == "train", F.lit(False)), F.col("_asked") & F.col("_held")
    else:
        train, test = ~F.col("_held"), F.col("_asked") & ((F.col(label) != 1) | F.col("_held"))
    if exclude_test_queries:
        train = train & ~F.col("_asked")
    return s.withColumns({"in_train": train, "in_test": test}).drop("_side", "_held", "_asked")


def value_sides(df: DataFrame, column: str, fraction: float, seed, strict: bool = False, label="label") -> DataFrame:
    """value, side. Positive-support values are divided; ``strict`` also divides those that only occur in negatives."""
    support = cut_lineage(df.groupBy(column).agg(F.max((F.col(label) == 1).cast("int")).alias("positive")))
    sides = split_values(support.where("positive = 1"), column, fraction, seed)
    if not strict:
        return sides
    rest = support.where("coalesce(positive, 0) = 0")
    n = rest.agg(F.count("*"))
    negative = md5_bucket_row_number(rest, f"{seed}-neg", [column], "_i").withColumn("_n", n.scalar()).select(
        column, F.when(F.col("_i") <= F.floor(F.col("_n") * fraction), "train").otherwise("test").alias("side"))
    return sides.unionByName(negative)


def flagged_split(df: DataFrame, column: str, fraction: float = 0.7, seed=0, exclude_test_queries: bool = False,
                  strict: bool = False, query="query_id", label="label") -> DataFrame:
    """``df`` with in_train and in_test. Only the values are written: a matrix grows anew from its short query table, once
    for the values and once per use of the flags."""
    return held_flags(df, column, value_sides(df, column, fraction, seed, strict, label), strict, exclude_test_queries, query, label)


def value_heldout_split(df: DataFrame, column: str, fraction: float = 0.7, seed=0, exclude_test_queries: bool = False,
                        strict: bool = False, query="query_id", label="label") -> tuple[DataFrame, DataFrame]:
    """(train, test). Positive-support values are held out; test is made of whole queries that have a
    held-out positive. ``strict`` also divides the values that only occur in negatives. Both sides are filters of one written
    table."""
    both = cut_lineage(flagged_split(df, column, fraction, seed, exclude_test_queries, strict, query, label))
    return both.where("in_train").drop("in_train", "in_test"), both.where("in_test").drop("in_train", "in_test")


def fold_flags(train: DataFrame, column: str, n: int = 3, exclude_queries: bool = False, query="query_id", label="label") -> DataFrame:
    """``train`` with arrays in_fit and in_val of one boolean per fold, in one pass over the written table.

    Fold i holds out the values with a positive whose hash falls on i; its validation rows are the whole queries with such a
    positive, without their positives of other values."""
    train = cut_lineage(train)
    values = train.where(F.col(label) == 1).select(column).distinct().withColumn("_f", hash_fold(column, n))
    rows = train.join(values, column, "left")
    positive = F.col(label) == 1
    asked = [F.coalesce(F.max(positive & (F.col("_f") == i)).over(Window.partitionBy(query)), F.lit(False)) for i in range(n)]
    rows = rows.withColumn("_asked", F.array(*asked))
    held = [F.coalesce(F.col("_f") == i, F.lit(False)) for i in range(n)]
    fit = [~h & (~F.col("_asked")[i] if exclude_queries else F.lit(True)) for i, h in enumerate(held)]
    val = [F.col("_asked")[i] & (~positive | h) for i, h in enumerate(held)]
    return rows.withColumns({"in_fit": F.array(*fit), "in_val": F.array(*val)}).drop("_f", "_asked")


def inner_folds(train: DataFrame, column: str, n: int = 3, exclude_queries: bool = False, query="query_id",
                label="label") -> list[tuple[DataFrame, DataFrame]]:
    """Value-heldout folds inside the train side, with the same exclusions, as filters of one written table."""
    rows = cut_lineage(fold_flags(train, column, n, exclude_queries, query, label))
    own = [c for c in rows.columns if c not in ("in_fit", "in_val")]
    return [(rows.where(F.col("in_fit")[i]).select(own), rows.where(F.col("in_val")[i]).select(own)) for i in range(n)]


def flag_report(rows: DataFrame, column: str, query="query_id", label="label") -> DataFrame:
    """:func:`split_report` of rows with in_train and in_test, in two aggregates over one table."""
    one = lambda c: F.col(c).cast("int")
    rows = rows.select(query, column, F.col(label).cast("int").alias("_y"), one("in_train").alias("t"), one("in_test").alias("e"))
    rows = rows.where("t + e > 0")
    per_value = rows.groupBy(column).agg(F.max("t").alias("t"), F.max("e").alias("e"), F.max(F.col("e") * F.col("_y")).alias("ep"))
    v = per_value.agg(F.sum(F.col("t") * F.col("e")).cast("bigint").alias("value_overlap"),
                      F.sum(F.col("t") * F.col("ep")).cast("bigint").alias("positive_value_overlap"))
    per_query = rows.groupBy(query).agg(F.max("t").alias("t"), F.max("e").alias("e"), F.sum("t").alias("nt"), F.sum("e").alias("ne"),
                                        F.sum(F.col("t") * F.col("_y")).alias("pt"), F.sum(F.col("e") * F.col("_y")).alias("pe"))
    b = lambda c, n: F.sum(c).cast("bigint").alias(n)
    q = per_query.agg(b("nt", "train_rows"), b("ne", "test_rows"), b("t", "train_queries"), b("e", "test_queries"), b("pt", "train_positives"),
                      b("pe", "test_positives"), b(F.col("t") * F.col("e"), "query_overlap"))
    return q.withColumn("_v", v.select(F.struct("*")).scalar()).select(*q.columns, "_v.*")


def split_report(train: DataFrame, test: DataFrame, column: str, query="query_id", label="label") -> DataFrame:
    """Rows, queries, positives per side and the overlaps a protocol promises to be empty."""
    both = train.select(F.lit(1).alias("t"), F.lit(0).alias("e"), query, column, label).unionByName(
        test.select(F.lit(0).alias("t"), F.lit(1).alias("e"), query, column, label))
    per_value = both.groupBy(column).agg(F.max("t").alias("t"), F.max("e").alias("e"),
                                         F.max(F.col("e") * F.col(label)).alias("ep"))
    v = per_value.agg(F.sum(F.col("t") * F.col("e")).cast("bigint").alias("value_overlap"),
                      F.sum(F.col("t") * F.col("ep")).cast("bigint").alias("positive_value_overlap"))
    per_query = both.groupBy(query).agg(F.max("t").alias("t"), F.max("e").alias("e"), F.sum("t").alias("nt"),
                                        F.sum("e").alias("ne"), F.sum(F.col("t") * F.col(label)).alias("pt"),
                                        F.sum(F.col("e") * F.col(label)).alias("pe"))
    b = lambda c, n: F.sum(c).cast("bigint").alias(n)
    q = per_query.agg(b("nt", "train_rows"), b("ne", "test_rows"), b("t", "train_queries"), b("e", "test_queries"),
                      b("pt", "train_positives"), b("pe", "test_positives"),
                      b(F.col("t") * F.col("e"), "query_overlap"))
    return q.withColumn("_v", v.select(F.struct("*")).scalar()).select(*q.columns, "_v.*")


def leakage_audit(df: DataFrame, split: str, keys: Sequence[str], warn_share: float = 0.05) -> DataFrame:
    """Values of every key seen on both sides, with a verdict. One pass over unpivoted keys."""
    long = df.unpivot([split], [F.col(k).cast("string").alias(k) for k in keys], "key", "value")
    per = long.groupBy("key", "value").agg(F.max(flag(F.col(split) == "train")).alias("t"),
                                           F.max(flag(F.col(split) == "test")).alias("e"))
    g = per.groupBy("key").agg(F.sum("t").cast("bigint").alias("train_values"),
                               F.sum("e").cast("bigint").alias("test_values"),
                               F.sum(F.col("t") * F.col("e")).cast("bigint").alias("shared"))
    share = F.col("shared") / F.greatest(F.col("test_values"), F.lit(1))
    return g.withColumn("shared_ratio", share).withColumn(
        "verdict", F.when(F.col("shared") == 0, "PASS").when(share <= warn_share, "WARN").otherwise("FAIL"))


def annotate_vocab(queries: DataFrame, positives: DataFrame, vocab: DataFrame, query="query_id",
                   candidate="candidate") -> DataFrame:
    """Whether any / all / none of a query's targets stand in the train vocabulary."""
    v = vocab.select(candidate).distinct().withColumn("_v", F.lit(True))
    per = (positives.join(v, candidate, "left").withColumn("_s", F.coalesce("_v", F.lit(False)))
           .groupBy(query).agg(F.count("*").alias("targets"), F.bool_or("_s").alias("any_seen"),
                               F.bool_and("_s").alias("all_seen")))
    j = queries.join(per, query)
    return j.withColumn("vocab_flag", F.when(F.col("all_seen"), "all").when(F.col("any_seen"), "any").otherwise("none"))


def seen_flag(df: DataFrame, train: DataFrame, key: Sequence[str], out: str) -> DataFrame:
    t = train.select(*key).distinct().withColumn("_s", F.lit(1))
    return df.join(t, list(key), "left").withColumn(out, F.coalesce("_s", F.lit(0))).drop("_s")


def temporal_split(df: DataFrame, time: str, boundary, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Earlier rows train, later rows test; test keys seen before the boundary are dropped."""
    cut = F.lit(boundary).cast(df.schema[time].dataType)
    train, test = df.where(F.col(time) < cut), df.where(F.col(time) >= cut)
    if keys:
        test = test.join(train.select(*keys).distinct(), list(keys), "left_anti")
    return train, test


def random_row_split(df: DataFrame, key: Sequence[str], seed, shares=(0.8, 0.9)) -> DataFrame:
    """Rows by hash order to train / val / test at exact cut points: the weak baseline that leaks."""
    n = df.agg(F.count("*"))
    t = md5_bucket_row_number(df, seed, key, "_i").withColumn("_n", n.scalar())
    i = F.col("_i")
    return t.withColumn("split", F.when(i <= F.floor(F.col("_n") * shares[0]), "train")
                        .when(i <= F.floor(F.col("_n") * shares[1]), "val").otherwise("test")).drop("_i", "_n")


def seen_unseen_performance(q: DataFrame, flags: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric means on seen and unseen sides of several flags."""
    long = q.select(*metrics, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("seen"))
                                                  for f in flags])).alias("e")).select(*metrics, "e.*")
    return long.groupBy("flag", "seen").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])
