"""Ranking metrics per query and their summaries."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankspark.functions.scalar import enrichment, random_hit, random_normalised
from rankspark.operators.ranking import rank_candidates
from rankspark.schema import flag

HIT_KS = (1, 5, 10)


def ideal_gain(n, k: int) -> Column:
    """Discounted gain of n positives at the head of the list, cut at k."""
    n = F.col(n) if isinstance(n, str) else n
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0),
                       lambda a, i: a + 1.0 / F.log2(i + 1.0))


def metrics_from_ranks(ranked: DataFrame, rank="rank", ks: Sequence[int] = HIT_KS, query="query_id",
                       label="label", carry: Sequence[str] = (), no_positive: str = "skip",
                       ndcg_k: int = 10, random: bool = True) -> DataFrame:
    """M1: per query hit@k, mrr, ndcg@k, best rank and (M3) the random expectation of every hit.

    ``no_positive`` is ``skip`` or ``zero``: what becomes of queries without a positive.
    """
    pos = F.col(label) == 1
    best = F.min(F.when(pos, F.col(rank)))
    gain = F.sum(F.when(pos & (F.col(rank) <= ndcg_k), 1.0 / F.log2(F.col(rank) + 1.0)).otherwise(0.0))
    q = ranked.groupBy(query).agg(
        *[F.min(c).alias(c) for c in carry],
        F.count("*").alias("n_candidates"), F.sum(label).cast("bigint").alias("n_positive"),
        best.cast("bigint").alias("best_rank"), gain.alias("_dcg"))
    if no_positive == "skip":
        q = q.where("n_positive > 0")
    elif no_positive != "zero":
        raise ValueError("no_positive must be 'skip' or 'zero'")
    hit = {k: flag(F.coalesce(F.col("best_rank") <= k, F.lit(False))) for k in ks}
    out = [F.col(query), *[F.col(c) for c in carry], F.col("n_candidates"), F.col("n_positive"), F.col("best_rank"),
           *[hit[k].alias(f"hit{k}") for k in ks],
           F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0)).alias("mrr"),
           F.when(F.col("n_positive") > 0, F.col("_dcg") / ideal_gain("n_positive", ndcg_k))
           .otherwise(0.0).alias(f"ndcg{ndcg_k}")]
    if random:
        for k in ks:
            e = random_hit("n_candidates", "n_positive", k)
            out += [e.alias(f"random_hit{k}")]
    q = q.select(*out)
    if random:
        for k in ks:
            q = (q.withColumn(f"enrichment{k}", enrichment(f"hit{k}", f"random_hit{k}"))
                 .withColumn(f"norm_hit{k}", random_normalised(f"hit{k}", f"random_hit{k}")))
    return q


def ranking_metrics(frame: DataFrame, score: str, **kw) -> DataFrame:
    """Rank by score, then :func:`metrics_from_ranks`; one exchange by query for both."""
    return metrics_from_ranks(rank_candidates(frame, score, "rank"), "rank", **kw)


def macro_mean(detail: DataFrame, group: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Plain mean over rows and mean of per-group means."""
    per = detail.groupBy(*by, group).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("_n"),
                                         *[F.sum(c).alias("_s_" + c) for c in columns])
    return per.groupBy(*by).agg(
        F.sum("_n").alias("n_queries"), F.count("*").alias("n_groups"),
        *[(F.sum("_s_" + c) / F.sum("_n")).alias("query_" + c) for c in columns],
        *[F.avg(c).alias("macro_" + c) for c in columns])


def long_methods(frame: DataFrame, methods: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Wide score or rank columns to (method, value) rows."""
    return frame.unpivot(list(keep), [F.col(c).cast("double").alias(m) for m, c in methods.items()],
                         "method", "value")


def metrics_by_method(ranked: DataFrame, ranks: dict[str, str], ks=HIT_KS, query="query_id", label="label",
                      carry=("anchor",), no_positive="skip", random=False) -> DataFrame:
    """M4 detail: metrics of several methods in one pass. One aggregate over the query, then unpivoted:
    the candidate rows are never multiplied by the number of methods."""
    pos = F.col(label) == 1
    aggs = [F.min(c).alias(c) for c in carry] + [
        F.count("*").alias("n_candidates"), F.sum(label).cast("bigint").alias("n_positive")]
    for m, r in ranks.items():
        aggs.append(F.struct(
            F.min(F.when(pos, F.col(r))).cast("bigint").alias("best_rank"),
            F.sum(F.when(pos & (F.col(r) <= 10), 1.0 / F.log2(F.col(r) + 1.0)).otherwise(0.0)).alias("dcg"))
            .alias("m_" + m))
    q = ranked.groupBy(query).agg(*aggs)
    if no_positive == "skip":
        q = q.where("n_positive > 0")
    long = q.select(query, *carry, "n_candidates", "n_positive", F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col("m_" + m).alias("x")) for m in ranks])).alias("e"))
    best = F.col("e.x.best_rank")
    out = long.select(
        query, *carry, "n_candidates", "n_positive", F.col("e.method").alias("method"), best.alias("best_rank"),
        *[flag(F.coalesce(best <= k, F.lit(False))).alias(f"hit{k}") for k in ks],
        F.coalesce(1.0 / best, F.lit(0.0)).alias("mrr"),
        F.when(F.col("n_positive") > 0, F.col("e.x.dcg") / ideal_gain("n_positive", 10)).otherwise(0.0)
        .alias("ndcg10"))
    if random:
        for k in ks:
            out = out.withColumn(f"random_hit{k}", random_hit("n_candidates", "n_positive", k))
    return out


def wide_metrics(ranked: DataFrame, ranks: dict[str, str], ks=(1, 5, 10), query="query_id", label="label",
                 carry=("anchor", "context"), no_positive="skip") -> DataFrame:
    """One row per query with ``hit<k>_<method>``, ``mrr_<method>``, ``best_<method>``."""
    pos = F.col(label) == 1
    q = ranked.groupBy(query).agg(
        *[F.min(c).alias(c) for c in carry], F.count("*").alias("n_candidates"),
        F.sum(label).cast("bigint").alias("n_positive"),
        *[F.min(F.when(pos, F.col(r))).cast("bigint").alias(f"best_{m}") for m, r in ranks.items()])
    if no_positive == "skip":
        q = q.where("n_positive > 0")
    for m in ranks:
        b = F.col(f"best_{m}")
        for k in ks:
            q = q.withColumn(f"hit{k}_{m}", flag(F.coalesce(b <= k, F.lit(False))))
        q = q.withColumn(f"mrr_{m}", F.coalesce(1.0 / b, F.lit(0.0)))
    return q


def summarise(detail: DataFrame, columns=("hit1", "hit5", "hit10", "mrr", "ndcg10"), group="anchor") -> DataFrame:
    """M4: query and macro mean per method."""
    return macro_mean(detail, group, columns, by=["method"])


def method_deltas(summary: DataFrame, pairs: Sequence[tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """M4: differences between methods of a summary, one aggregate row."""
    at = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    return summary.agg(*[(at(a, c) - at(b, c)).alias(f"delta_{a}_vs_{b}_{c}") for a, b in pairs for c in columns])


def pair_metrics(pairs: DataFrame, rank="rank", weight="weight", ks=(1, 5, 10)) -> DataFrame:
    """Recovery of known pairs from their rank."""
    hit10 = flag(F.col(rank) <= 10)
    return pairs.agg(
        F.count("*").alias("n_pairs"), *[F.avg(flag(F.col(rank) <= k)).alias(f"pair_top{k}") for k in ks],
        F.avg(1.0 / F.col(rank)).alias("pair_mrr"),
        (F.sum(F.col(weight) * hit10) / F.sum(weight)).alias("weighted_top10"))


def rescue_lost(q: DataFrame, model="hit10_b", reference="hit10_a") -> DataFrame:
    """M9: queries gained and lost against a reference."""
    rescued = F.sum(flag((F.col(model) == 1) & (F.col(reference) == 0))).cast("bigint")
    lost = F.sum(flag((F.col(model) == 0) & (F.col(reference) == 1))).cast("bigint")
    return q.agg(F.count("*").alias("n"), rescued.alias("rescued"), lost.alias("lost")).select(
        "n", "rescued", "lost", (F.col("rescued") - F.col("lost")).alias("net"),
        F.when(F.col("lost") > 0, F.col("rescued") / F.col("lost")).alias("ratio"))


def hit_quadrants(q: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Both / only A / only B / neither."""
    x, y = F.col(a) == 1, F.col(b) == 1
    count = lambda c: F.sum(flag(c)).cast("bigint")
    return q.groupBy(*by).agg(count(x & y).alias("both"), count(x & ~y).alias("only_a"),
                              count(~x & y).alias("only_b"), count(~x & ~y).alias("neither"))


def hit_patterns(q: DataFrame, hits: Mapping[str, str], marks: Mapping[str, Column] | None = None) -> DataFrame:
    """Which of any number of rankers hit together: one row per pattern (names joined by ``+``, ``none`` if empty) with
    its number of queries, and how many of them carry each mark."""
    names = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(n)) for n, c in sorted(hits.items())]))
    pattern = F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise("none")
    return q.groupBy(pattern.alias("hits")).agg(
        F.count("*").alias("n"), *[F.sum(flag(m)).cast("bigint").alias(f"n_{k}") for k, m in (marks or {}).items()])


def rank_bin_flow(q: DataFrame, bin_a: Column, bin_b: Column) -> DataFrame:
    """How queries move between rank bins."""
    g = q.groupBy(bin_a.alias("bin_a"), bin_b.alias("bin_b")).agg(F.count("*").alias("n"))
    total = q.agg(F.count("*").cast("double"))
    return g.withColumn("share", F.col("n") / total.scalar())


def transition_groups(q: DataFrame, a: str, b: str) -> DataFrame:
    """Gain / loss / unchanged by best rank, with rate and median rank change."""
    d = F.col(b) - F.col(a)
    g = F.when(d < 0, "gain").when(d > 0, "loss").otherwise("unchanged")
    total = q.agg(F.count("*").cast("double"))
    return (q.withColumn("_d", d).groupBy(g.alias("transition"))
            .agg(F.count("*").alias("n"), F.percentile("_d", 0.5).alias("median_rank_delta"))
            .withColumn("rate", F.col("n") / total.scalar()))


def metric_reconcile(expected: DataFrame, actual: DataFrame, on: Sequence[str], tol: float) -> DataFrame:
    """Recomputed values against stored ones."""
    j = expected.join(actual, list(on), "full_outer")
    diff = F.abs(F.col("expected") - F.col("actual"))
    return j.withColumn("abs_diff", diff).withColumn(
        "status", F.when(diff.isNull(), "MISSING").when(diff <= tol, "PASS").otherwise("FAIL"))


def pareto_frontier(policies: DataFrame, up: str, down: str, key="policy") -> DataFrame:
    """Rows no other row beats on both axes at once, with the names of those that do.

    Policies are a short report table; the comparison is an inequality self-join over it.
    """
    a = policies.select(F.col(key), F.col(up), F.col(down))
    b = policies.select(F.col(key).alias("_k"), F.col(up).alias("_u"), F.col(down).alias("_d"))
    j = a.join(b, (F.col("_u") > F.col(up)) & (F.col("_d") < F.col(down)), "left")
    return j.groupBy(key, up, down).agg(
        F.array_join(F.array_sort(F.collect_list("_k")), "; ").alias("dominated_by")).withColumn(
        "status", F.when(F.col("dominated_by") == "", "Pareto-optimal").otherwise("Dominated"))


def stability_select(folds: DataFrame, policy="policy", delta="delta", min_positive: int = 4) -> DataFrame:
    """Fold-wise gains; stable when no fold loses and enough folds gain."""
    return folds.groupBy(policy).agg(
        F.avg(delta).alias("mean_delta"), F.stddev_pop(delta).alias("std_delta"), F.min(delta).alias("min_delta"),
        F.sum(flag(F.col(delta) > 0)).cast("bigint").alias("positive_folds")).withColumn(
        "stable", flag((F.col("min_delta") > 0) & (F.col("positive_folds") >= min_positive)))


def subset_metrics(q: DataFrame, subsets: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    """Named, overlapping subsets as one exploded membership list."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]), lambda x: x.isNotNull())
    return (q.withColumn("subset", F.explode(names)).groupBy("subset")
            .agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]))


def concentration(gains: DataFrame, subset="subset", gain="gain") -> DataFrame:
    """Share of the whole positive gain that one subset holds; above one half is flagged."""
    total = gains.agg(F.sum(F.greatest(F.col(gain), F.lit(0))).cast("double"))
    return (gains.withColumn("share", F.greatest(F.col(gain), F.lit(0)) / total.scalar())
            .withColumn("concentrated", flag(F.col("share") > 0.5)))
