"""Resampling statistics: bootstrap intervals, sign flips, label permutation, prior nulls."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.functions.bits import let
from rankspark.functions.hashing import hash_order
from rankspark.operators.ranking import md5_bucket_row_number
from rankspark.schema import flag
from rankspark.session import cut_lineage


def _uniform(*parts) -> Column:
    """Hash-based uniform in (0, 1), the same on every rerun of a task."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / float(16 ** 13)


def poisson_total(n: Column, key: Sequence[Column]) -> Column:
    """Sum of n independent Poisson(1) weights, i.e. one Poisson(n) draw: inversion of a hash uniform, at every n.

    The walk covers eight deviations on either side (beyond them lies less than 1e-14), so a draw takes some 16 sqrt(n) steps.
    """
    x = n.cast("double")
    k0 = F.greatest(F.floor(x - 8 * F.sqrt(x) - 8), F.lit(0)).cast("double")
    top = F.ceil(x + 8 * F.sqrt(x) + 8).cast("double")

    def log_factorial(k):
        z = k + 1.0
        return F.when(k < 1, 0.0).otherwise((z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))))

    def invert(v):
        p0 = F.exp(-v["x"] + v["k0"] * F.log(v["x"]) - log_factorial(v["k0"]))
        start = F.struct(p0.alias("p"), p0.alias("c"), v["k0"].alias("k"))
        return F.aggregate(F.sequence((v["k0"] + 1).cast("int"), v["top"].cast("int")), start, lambda s, i: F.struct(
            (s["p"] * v["x"] / i).alias("p"), (s["c"] + s["p"] * v["x"] / i).alias("c"),
            (s["k"] + F.when(v["u"] > s["c"], 1.0).otherwise(0.0)).alias("k")))["k"]
    drawn = let(F.struct(x.alias("x"), k0.alias("k0"), top.alias("top"), _uniform(F.lit("u"), *key).alias("u")), invert)
    return F.when(x > 0, drawn).otherwise(0.0)


def _counted(df: DataFrame, value: str, by: Sequence[str], weight: str | None) -> DataFrame:
    v = F.col(value).cast("double").alias("_v")
    w = (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")
    return df.select(*by, v, w).where(F.col("_v").isNotNull()).groupBy(*by, "_v", "_w").agg(F.count("*").alias("_n"))


def _ratio(c: DataFrame, by: Sequence[str], times: str, out: str, *more: Column) -> DataFrame:
    return c.groupBy(*by).agg((F.sum(F.col("_v") * F.col(times)) / F.nullif(F.sum(F.col("_w") * F.col(times)), F.lit(0.0))).alias(out), *more)


def _replicates(c: DataFrame, by: Sequence[str], replicates: int, seed) -> DataFrame:
    """_r, _m: the resampled mean of every replicate."""
    r = c.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    key = [F.lit(str(seed)), F.col("_r").cast("string"), F.col("_v").cast("string"), F.col("_w").cast("string"),
           *[F.col(b).cast("string") for b in by]]
    return _ratio(r.withColumn("_k", poisson_total(F.col("_n"), key)), [*by, "_r"], "_k", "_m")


def bootstrap_ci(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None, replicates: int = 1000,
                 seed=0, level: float = 0.95) -> DataFrame:
    """M6/M7/M8: percentile interval of a mean (or of a ratio sum(value)/sum(weight)) over the rows of ``df``.

    Rows with equal values are one counted row, so the work is replicates x distinct values, not replicates x rows.
    For pre-aggregated clusters pass the cluster's sum as ``value`` and its size as ``weight``.
    """
    by = list(by)
    c = _counted(df, value, by, weight)
    obs = _ratio(c, by, "_n", "estimate", F.sum("_n").alias("n"))
    means = _replicates(c, by, replicates, seed)
    tail = (1.0 - level) / 2.0
    ci = means.groupBy(*by).agg(F.percentile("_m", tail).alias("low"), F.percentile("_m", 1.0 - tail).alias("high"),
                                F.avg(flag(F.col("_m") > 0)).alias("p_positive"), F.stddev_samp("_m").alias("se"))
    return obs.join(ci, by) if by else ci.select("*", obs.select(F.struct("estimate", "n")).scalar().alias("_o")).select(
        "_o.estimate", "_o.n", "low", "high", "p_positive", "se")


def paired_bootstrap(df: DataFrame, a: str, b: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """M7: interval of the mean difference on shared resamples."""
    return bootstrap_ci(df.withColumn("_diff", F.round(F.col(a) - F.col(b), 12)), "_diff", by, **kw)


def clustered_bootstrap(df: DataFrame, value: str, cluster: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """M8: whole clusters are resampled; each enters with its sum and size."""
    per = df.groupBy(*by, cluster).agg(F.sum(value).alias("_sum"), F.count("*").alias("_size"))
    return bootstrap_ci(per, "_sum", by, "_size", **kw)


def rescue_intervals(q: DataFrame, model="hit10_b", reference="hit10_a", **kw) -> DataFrame:
    """M9: intervals of the net gain per query and of rescued over lost queries; the ratio is taken per replicate."""
    a, b = F.col(model) == 1, F.col(reference) == 1
    r = q.select(flag(a & ~b).alias("rescued"), flag(~a & b).alias("lost")).withColumn("net", F.col("rescued") - F.col("lost"))
    rows = [bootstrap_ci(r, "net", **kw).withColumn("measure", F.lit("net")),
            bootstrap_ci(r, "rescued", weight="lost", **kw).withColumn("measure", F.lit("ratio"))]
    return rows[0].unionByName(rows[1]).select("measure", "estimate", "n", "low", "high")


def two_group_difference(df: DataFrame, value: str, cluster: str, group: str, first, second, replicates: int = 1000, seed=0,
                         level: float = 0.95) -> DataFrame:
    """M8: difference of two independent groups; each replicate resamples the clusters of both."""
    per = df.where(F.col(group).isin(first, second)).groupBy(group, cluster).agg(F.sum(value).alias("_sum"), F.count("*").alias("_size"))
    c = _counted(per, "_sum", [group], "_size")
    at = lambda g, x: F.max(F.when(F.col(group) == g, F.col(x)))
    estimate = _ratio(c, [group], "_n", "_m").agg((at(first, "_m") - at(second, "_m")).alias("difference"))
    drawn = _replicates(c, [group], replicates, seed).groupBy("_r").agg((at(first, "_m") - at(second, "_m")).alias("_d"))
    tail = (1.0 - level) / 2.0
    return drawn.agg(F.percentile("_d", tail).alias("low"), F.percentile("_d", 1.0 - tail).alias("high")).select(
        estimate.scalar().alias("difference"), "low", "high")


def sign_flip_exact(diffs: DataFrame, diff: str) -> DataFrame:
    """Exact distribution of the mean over all sign vectors of paired differences, by convolution.

    One row per distinct partial sum (to nine digits) with its number of sign vectors: differences on a grid stay few rows
    however many there are.
    """
    values = [float(r[0]) for r in diffs.select(F.col(diff).cast("double").alias("x")).orderBy("x").toLocalIterator()]
    t = diffs.sparkSession.range(1).select(F.lit(0.0).alias("s"), F.lit(1.0).alias("n"))
    for i, x in enumerate(values, 1):
        t = t.select(F.explode(F.array(*[F.round(F.col("s") + sign * x, 9) for sign in (1, -1)])).alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))
        t = cut_lineage(t) if i % 8 == 0 else t
    k, o = len(values), round(sum(values), 9)
    share = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0.0)) / F.sum("n")
    return t.agg(F.lit(k).cast("bigint").alias("n"), F.lit(o / max(k, 1)).alias("mean_diff"),
                 share(F.col("s") >= o - 5e-9).alias("one_sided_p"), share(F.abs("s") >= abs(o) - 5e-9).alias("two_sided_p"))


def permute_within_query(df: DataFrame, seed, query="query_id", candidate="candidate", label="label") -> DataFrame:
    """Labels shuffled inside each query; the number of positives stays.

    Shuffling 0/1 labels is choosing which rows become positive: the first p rows in hash order.
    """
    w = Window.partitionBy(query).orderBy(hash_order(seed, query, candidate), candidate)
    p = F.sum(label).over(Window.partitionBy(query))
    return df.withColumn("_r", F.row_number().over(w)).withColumn("_p", p).withColumn(
        label, flag(F.col("_r") <= F.col("_p"))).drop("_r", "_p")


def permutation_sides(n: int) -> tuple[int, int]:
    """a x b >= n with a near the root of n and as few places above n as can be."""
    root = max(1, int(n ** 0.5))
    return min(((a, -(-n // a)) for a in range(root, root + min(root, 1000) + 1)), key=lambda s: (s[0] * s[1] - n, s[0]))


def permuted(df: DataFrame, place: str, key: str, n: int, out: str, rounds: int = 4) -> DataFrame:
    """``out``: the place 0..n-1 that a pseudo-random permutation named by ``key`` (below 2**20) gives to ``place``.

    The place is cut into a row and a column of a grid of at least n cells; in turn one of them is shifted by a hash of the
    other, which can be undone, so it is a permutation of the grid. A place past n is permuted again until it falls below:
    the grid has only a few of them, and no walk is longer than their number. Each row is computed by itself: a permutation of
    any size needs no sort and no copy.
    """
    a, b = permutation_sides(n)

    def shift(x: str, turn: int) -> Column:
        k = (F.col(key) * (2 * turn + 3) + 7919 * turn) % (1 << 20)
        return F.shiftright((F.col(x) + k) * (F.col(x) + k) * 31 + F.col(x) * k, 5)
    df = df.withColumn("_p", F.col(place).cast("bigint"))
    for walk in range(a * b - n + 1):
        df = df.withColumns({"_l": F.expr(f"_p div {b}"), "_c": F.col("_p") % b})
        for turn in range(rounds):
            df = df.withColumn("_l", (F.col("_l") + shift("_c", turn)) % a) if turn % 2 == 0 else df.withColumn("_c", (F.col("_c") + shift("_l", turn)) % b)
        moved = F.col("_l") * b + F.col("_c")
        df = df.withColumn("_p", moved if walk == 0 else F.when(F.col("_p") < n, F.col("_p")).otherwise(moved))
    # never null: else a join would ask for it below all these columns, with their expressions copied into one another
    return df.withColumn(out, F.coalesce("_p", F.lit(0).cast("bigint"))).drop("_p", "_l", "_c")


def shuffled_edges(edges: DataFrame, replicates: int, seed, template="template", target="candidate") -> DataFrame:
    """The prior edges with the target column permuted, one permutation per replicate.

    Edges are seated once; replicate r takes the target of the seat that its permutation names.
    """
    seats = cut_lineage(md5_bucket_row_number(edges, seed, [template, target], "_i"))
    n = seats.count()
    if n == 0:
        return edges.withColumn("replicate", F.lit(0))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"))), 1, 5), 16, 10).cast("bigint")
    rows = seats.drop(target).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_key", key)
    rows = permuted(rows.withColumn("_i", F.col("_i") - 1), "_i", "_key", n, "_seat").drop("_i", "_key")
    return rows.join(seats.select((F.col("_i") - 1).alias("_seat"), target), "_seat").drop("_seat")


def null_summary(observed: DataFrame, null: DataFrame, value: str) -> DataFrame:
    """Null mean, interval and p = (1 + #(null >= observed)) / (n + 1)."""
    o = observed.select(F.col(value).cast("double"))
    n = null.withColumn("_o", o.scalar())
    return n.agg(F.max("_o").alias("observed"), F.avg(value).alias("null_mean"), F.percentile(value, 0.025).alias("low"),
                 F.percentile(value, 0.975).alias("high"),
                 ((F.sum(flag(F.col(value) >= F.col("_o"))) + 1) / (F.count("*") + 1)).alias("p_value"))


def policy_pairwise(long: DataFrame, policy: str, metric: str, value: str, query="query_id", **kw) -> DataFrame:
    """Paired interval for every policy pair and metric, and its reading."""
    per = long.groupBy(query, metric).agg(F.collect_list(F.struct(F.col(policy).alias("p"), F.col(value).alias("v")))
                                          .alias("_l"))
    pairs = per.select(query, metric, F.explode("_l").alias("a"), "_l").select(
        query, metric, "a", F.explode("_l").alias("b")).where("a.p < b.p")
    d = pairs.select(metric, F.col("a.p").alias("policy_a"), F.col("b.p").alias("policy_b"),
                     F.round(F.col("a.v") - F.col("b.v"), 12).alias("d"))
    ci = bootstrap_ci(d, "d", [metric, "policy_a", "policy_b"], **kw)
    return ci.withColumn("reading", F.when(F.col("low") > 0, "A better").when(F.col("high") < 0, "B better")
                         .otherwise("no clear difference"))
