"""Exact quantiles without holding a column in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.functions.hashing import hash_order
from rankspark.session import cut_lineage
from rankspark.operators.ranking import fitted_cuts, global_row_number, slice_column

SLICES = 256


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles, one row per group.

    Equal values collapse to counts first; distinct values fall into slices between fitted cut points; only slice
    sizes are accumulated per group. A value shared by many rows is one counted row.
    """
    by = list(by)
    names = names or [f"q{i}" for i in range(len(probs))]
    vc = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v"))
          .agg(F.count("*").alias("_n")))
    return _at_positions(vc, probs, by, names)


def _at_positions(vc: DataFrame, probs: Sequence[float], by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Quantiles of counted values: ``_v`` occurs ``_n`` times."""
    vc = cut_lineage(vc)  # read three times below
    vc = slice_column(vc, "_v", fitted_cuts(vc, "_v", SLICES), "_s")
    sizes = vc.groupBy(*by, "_s").agg(F.sum("_n").alias("_m"))
    keys = by or [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy("_s")
    sizes = sizes.select(*by, "_s",
                         F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                         .alias("_off"),
                         F.sum("_m").over(Window.partitionBy(*keys)).alias("_tot"))
    local = Window.partitionBy(*by, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    pos = (vc.withColumn("_c", F.sum("_n").over(local)).join(sizes, [*by, "_s"])
           .withColumn("_end", F.col("_off") + F.col("_c")).withColumn("_start", F.col("_end") - F.col("_n")))
    aggs = []
    for i, p in enumerate(probs):
        at = F.round((F.col("_tot") - 1) * F.lit(float(p)), 9)
        inside = lambda x: (x >= F.col("_start")) & (x < F.col("_end"))
        aggs += [F.max(F.when(inside(F.floor(at)), F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when(inside(F.ceil(at)), F.col("_v"))).alias(f"_hi{i}"),
                 F.max(at - F.floor(at)).alias(f"_f{i}")]
    q = pos.groupBy(*by).agg(*aggs)
    return q.select(*by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(n)
                           for i, n in enumerate(names)])


def narrowed_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                       names: Sequence[str] | None = None, accuracy: int = 10000) -> DataFrame:
    """:func:`exact_quantiles` for few groups of very many different values: the values are not shuffled.

    A sketch gives a bracket around every quantile, twice as wide as its error. Only values inside a bracket are counted one
    by one, all others once per gap between brackets. A quantile that its bracket misses sends the table the plain way.
    """
    by, probs = list(by), [float(p) for p in probs]
    names = names or [f"q{i}" for i in range(len(probs))]
    order = sorted(probs)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    reach = [max(0.0, p - 2.0 / accuracy) for p in order] + [min(1.0, p + 2.0 / accuracy) for p in order]
    edges = cut_lineage(rows.groupBy(*by).agg(F.percentile_approx("_v", reach, accuracy).alias("_e")))
    k = len(order)
    low, high = [F.col("_e")[i] for i in range(k)], [F.col("_e")[k + i] for i in range(k)]
    near = F.lit(False)
    gap = F.lit(0)
    for lo, hi in zip(low, high):
        near = near | F.col("_v").between(lo, hi)
        gap = gap + F.when(F.col("_v") > hi, 1).otherwise(0)
    rows = rows.join(F.broadcast(edges), by) if by else rows.crossJoin(F.broadcast(edges))
    rows = rows.select(*by, "_v", F.when(near, F.col("_v")).alias("_one"), F.when(near, -1).otherwise(gap).alias("_gap"))
    # a gap stands in the order as its least value; it also shows whether it holds more than that one
    cells = cut_lineage(rows.groupBy(*by, "_gap", "_one").agg(F.count("*").alias("_n"), F.min("_v").alias("_v"), F.max("_v").alias("_top")))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    upto = F.sum("_n").over(w.orderBy("_v"))
    wide = cells.withColumns({"_end": upto, "_tot": F.sum("_n").over(w)}).where("_gap >= 0 and _top > _v")
    missed = F.lit(False)
    for p in probs:
        at = F.round((F.col("_tot") - 1) * F.lit(p), 9)
        for place in (F.floor(at), F.ceil(at)):
            missed = missed | ((place >= F.col("_end") - F.col("_n")) & (place < F.col("_end")))
    if not wide.where(missed).isEmpty():
        return exact_quantiles(df, value, probs, by, names)
    return _at_positions(cells.select(*by, "_v", "_n"), probs, by, names)


def quantile_edges(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """One row with the array of n+1 edges (train side); joined as a scalar subquery by the caller."""
    names = [f"e{i}" for i in range(n + 1)]
    q = exact_quantiles(df, value, [i / n for i in range(n + 1)], names=names)
    return q.select(F.array(*names).alias("edges"))


def qcut_rank(df: DataFrame, value: str, tie: Sequence, q: int, out: str = "bin") -> DataFrame:
    """Q equal-count bins over the rank with ties broken by hash order."""
    t = global_row_number(df, value, hash_order("qcut", *tie), "_r")
    n = df.agg(F.count("*").cast("double"))
    return (t.withColumn("_n", n.scalar())
            .withColumn(out, F.greatest(F.lit(1), F.ceil((F.col("_r") - 1) * q / F.greatest(F.col("_n") - 1, F.lit(1.0)))
                                        ).cast("int")).drop("_r", "_n"))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of every distinct value over the whole table: (value, out)."""
    vc = df.groupBy(F.col(value)).agg(F.count("*").alias("_n"))
    vc = cut_lineage(vc)
    vc = slice_column(vc, value, fitted_cuts(vc, value, SLICES), "_s")
    before = Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (vc.groupBy("_s").agg(F.sum("_n").alias("_m"))
             .select("_s", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off")))
    local = Window.partitionBy("_s").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (vc.withColumn("_c", F.sum("_n").over(local)).join(sizes, "_s")
            .select(value, (F.col("_off") + F.col("_c") - (F.col("_n") - 1) / 2.0).alias(out)))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    r = df.select(a, b).join(average_rank(df, a, "_ra"), a).join(average_rank(df, b, "_rb"), b)
    return r.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("spearman"))


def distribution_by_label(df: DataFrame, metrics: Sequence[str], label="label") -> DataFrame:
    """Count, mean, sample spread, minimum, percentiles and maximum per metric and label."""
    long = df.unpivot([label], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    base = long.groupBy("metric", label).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = narrowed_quantiles(long, "value", [0.1, 0.25, 0.5, 0.75, 0.9], ["metric", label],
                           ["p10", "p25", "p50", "p75", "p90"])
    return base.join(q, ["metric", label])


def mean_contrast(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), label="label") -> DataFrame:
    """Mean per metric for labels 0 and 1 and their difference, averaged over ``by`` (seeds) first."""
    long = df.unpivot([*by, label], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    per = long.groupBy(*by, "metric", label).agg(F.avg("value").alias("v"))
    w = per.groupBy("metric").pivot(label, [0, 1]).agg(F.avg("v"))
    return w.select("metric", F.col("0").alias("mean_0"), F.col("1").alias("mean_1"),
                    (F.col("1") - F.col("0")).alias("contrast"))


def measurement_rollup(df: DataFrame, key: str, value: str, tag: str) -> DataFrame:
    """A10: median, minimum, maximum, distinct tags and their sorted list."""
    tags = (df.select(key, tag).distinct().groupBy(key)
            .agg(F.count("*").alias("n_tags"), F.array_join(F.array_sort(F.collect_list(tag)), ";").alias("tags")))
    base = df.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    med = exact_quantiles(df, value, [0.5], [key], ["median"])
    return base.join(med, key).join(tags, key)
