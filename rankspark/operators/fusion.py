"""Rank fusion and re-ranking. Lists of one query stand side by side as columns wherever possible."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankspark.functions.hashing import tie_key
from rankspark.operators.ranking import policy_rank, rank_candidates, zscore
from rankspark.schema import flag


def _points(lists: DataFrame, score: Column, query, candidate, carry) -> DataFrame:
    return lists.groupBy(query, candidate).agg(F.sum(score).alias("score"), *[F.max(c).alias(c) for c in carry])


def borda(lists: DataFrame, n: int, universe: str = "union", left: str | None = None, query="query_id",
          candidate="candidate", carry: Sequence[str] = ("label",)) -> DataFrame:
    """Sum of (n - rank + 1) over long lists cut at n; a missing candidate scores nothing.

    ``universe='left'`` keeps only candidates of the list named ``left``.
    """
    cut = lists.where(F.col("rank") <= n)
    pts = cut.groupBy(query, candidate).agg(
        F.sum(F.lit(n + 1) - F.col("rank")).cast("double").alias("score"),
        F.max(flag(F.col("method") == F.lit(left))).alias("_left"), *[F.max(c).alias(c) for c in carry])
    if universe == "left":
        pts = pts.where("_left = 1")
    elif universe != "union":
        raise ValueError("universe must be 'union' or 'left'")
    return rank_candidates(pts.drop("_left"), "score", "rank", query, candidate)


def rank_sum(lists: DataFrame, methods: Sequence[str], n: int, penalty: int, query="query_id", candidate="candidate",
             carry: Sequence[str] = ("label",)) -> DataFrame:
    """X1 variant: sum of ranks, a missing list counts ``penalty``; small is good."""
    cut = lists.where(F.col("rank") <= n)
    cols = [F.coalesce(F.min(F.when(F.col("method") == m, F.col("rank"))), F.lit(penalty)) for m in methods]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    s = cut.groupBy(query, candidate).agg((-total).cast("double").alias("score"), *[F.max(c).alias(c) for c in carry])
    return rank_candidates(s, "score", "rank", query, candidate)


def rrf(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None, query="query_id",
        candidate="candidate", carry: Sequence[str] = ("label",)) -> DataFrame:
    """Sum of w / (k + rank)."""
    w = F.lit(1.0)
    for m, v in (weights or {}).items():
        w = F.when(F.col("method") == m, F.lit(float(v))).otherwise(w)
    return rank_candidates(_points(lists, w / (F.lit(float(k)) + F.col("rank")), query, candidate, carry),
                           "score", "rank", query, candidate)


def rank_average(lists: DataFrame, n_lists: int, query="query_id", candidate="candidate",
                 carry: Sequence[str] = ("label",)) -> DataFrame:
    """Negative mean rank of candidates that every list holds."""
    s = (lists.groupBy(query, candidate)
         .agg((-F.avg("rank")).alias("score"), F.count("*").alias("_n"), *[F.max(c).alias(c) for c in carry])
         .where(F.col("_n") == n_lists).drop("_n"))
    return rank_candidates(s, "score", "rank", query, candidate)


def weighted_negative_rank(ranks: dict[str, float]) -> Column:
    """-(sum w * rank) / sum w over rank columns of one row."""
    total = F.lit(0.0)
    for c, w in ranks.items():
        total = total + F.lit(float(w)) * F.col(c)
    return -(total / F.lit(float(sum(ranks.values()))))


def z_columns(df: DataFrame, scores: Sequence[str], query="query_id", digits: int = 9) -> DataFrame:
    """z-scores of several rankers in one window pass; rounded so that ties stay ties in any engine."""
    return df.withColumns({f"z_{s}": F.round(zscore(s, query), digits) for s in scores})


def best_rank_table(df: DataFrame, scores: dict[str, Column], query="query_id", candidate="candidate", label="label",
                    carry: Sequence[str] = ("anchor",)) -> DataFrame:
    """One row per query with ``best_<name>``: the best positive's rank under every score.

    Two aggregates per query instead of one sort per score: the best positive's order key, then how many candidates
    stand before it. Both combine map-side, so even a query with very many rows is no hot spot. Queries without a
    positive are skipped.
    """
    names = list(scores)
    t = df.select(query, candidate, label, *carry, tie_key(query, candidate).alias("_t"),
                  *[scores[n].cast("double").alias(f"_s{i}") for i, n in enumerate(names)])
    key = lambda i: F.struct((-F.col(f"_s{i}")).alias("s"), F.col("_t").alias("t"), F.col(candidate).alias("c"))
    best = t.where(F.col(label) == 1).groupBy(query).agg(*[F.min(key(i)).alias(f"_b{i}") for i in range(len(names))])
    return t.join(best, query).groupBy(query).agg(
        *[F.min(c).alias(c) for c in carry], F.count("*").alias("n_candidates"),
        F.sum(label).cast("bigint").alias("n_positive"),
        *[(F.sum(flag(key(i) < F.col(f"_b{i}"))) + 1).cast("bigint").alias(f"best_{n}") for i, n in enumerate(names)])


def wide_metrics(df: DataFrame, scores: dict[str, Column], ks=(1, 5, 10), carry: Sequence[str] = ("anchor", "context"),
                 **kw) -> DataFrame:
    """:func:`best_rank_table` with ``hit<k>_<name>`` and ``mrr_<name>``."""
    q = best_rank_table(df, scores, carry=carry, **kw)
    return q.withColumns({
        **{f"hit{k}_{n}": flag(F.col(f"best_{n}") <= k) for n in scores for k in ks},
        **{f"mrr_{n}": 1.0 / F.col(f"best_{n}") for n in scores}})


def grid_best_ranks(df: DataFrame, scores: dict[str, Column], query="query_id", carry: Sequence[str] = ("anchor",),
                    **kw) -> DataFrame:
    """Long form of :func:`best_rank_table`: (query, carry, variant, best_rank)."""
    names = list(scores)
    r = best_rank_table(df, {f"v{i}": scores[n] for i, n in enumerate(names)}, query=query, carry=carry, **kw)
    return r.select(query, *carry, F.explode(F.array(*[
        F.struct(F.lit(n).alias("variant"), F.col(f"best_v{i}").alias("best_rank")) for i, n in enumerate(names)])).alias("e")
    ).select(query, *carry, "e.*")


def variant_summary(best: DataFrame, by: Sequence[str] = ("variant",)) -> DataFrame:
    b = F.col("best_rank")
    return best.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(flag(b <= k)).alias(f"hit{k}") for k in (1, 5, 10)],
                                 F.avg(1.0 / b).alias("mrr"))


def zscore_blend_grid(df: DataFrame, a: str, b: str, alphas: Sequence[float], c: str | None = None,
                      **kw) -> DataFrame:
    """Two-way (or three-way) blends of z-scores over a grid, all in one pass."""
    cols = [a, b] + ([c] if c else [])
    z = z_columns(df, cols)
    scores = {}
    for x in alphas:
        if c is None:
            scores[f"{x:.2f}"] = F.round(F.lit(x) * F.col(f"z_{a}") + F.lit(1.0 - x) * F.col(f"z_{b}"), 9)
        else:
            for y in alphas:
                if x + y <= 1.0:
                    scores[f"{x:.2f}/{y:.2f}"] = F.round(
                        F.lit(x) * F.col(f"z_{a}") + F.lit(y) * F.col(f"z_{b}")
                        + F.lit(1.0 - x - y) * F.col(f"z_{c}"), 9)
    return grid_best_ranks(z, scores, **kw)


def boundary_rerank(df: DataFrame, base_rank: str, blend, keep: int, high: int, query="query_id",
                    candidate="candidate", out="rank") -> DataFrame:
    """Ranks up to ``keep`` stay, (keep, high] is re-sorted by the blend, the tail stays."""
    r = F.col(base_rank)
    band = F.when(r <= keep, 0).when(r <= high, 1).otherwise(2)
    blend = F.col(blend) if isinstance(blend, str) else blend
    inner = F.when(band == 1, -blend)
    w = Window.partitionBy(query).orderBy(band, inner.asc_nulls_first(), base_rank)
    return df.withColumn(out, F.row_number().over(w))


def rerank_within_topk(df: DataFrame, base_rank: str, score, k: int, query="query_id", out="rank") -> DataFrame:
    """Scorer order inside the baseline's top k, baseline order outside (two keys, no mixed scales)."""
    return boundary_rerank(df, base_rank, score, 0, k, query=query, out=out)


def segment_rules(val: DataFrame, by: Sequence[str], hit_a: str, hit_b: str, mrr_a: str, mrr_b: str,
                  min_n: int) -> DataFrame:
    """Segments where expert B has more hits and no lower MRR on enough validation queries."""
    g = val.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit_a).alias("hit_a"), F.avg(hit_b).alias("hit_b"),
                             F.avg(mrr_a).alias("mrr_a"), F.avg(mrr_b).alias("mrr_b"))
    return g.withColumn("use_b", flag((F.col("n") >= min_n) & (F.round("hit_b", 9) > F.round("hit_a", 9))
                                      & (F.round("mrr_b", 9) >= F.round("mrr_a", 9))))


def apply_router(queries: DataFrame, rules: DataFrame, by: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Frozen rules choose B's columns for their segments."""
    r = rules.where("use_b = 1").select(*by, F.lit(1).alias("_u"))
    j = queries.join(r, list(by), "left").withColumn("routed", F.coalesce("_u", F.lit(0))).drop("_u")
    for out, (a, b) in pairs.items():
        j = j.withColumn(out, F.when(F.col("routed") == 1, F.col(b)).otherwise(F.col(a)))
    return j


def oracle(df: DataFrame, ranks: Sequence[str], hits: Sequence[str]) -> DataFrame:
    """The better of several rankers per query."""
    return df.withColumn("oracle_rank", F.least(*ranks)).withColumn("oracle_hit", F.greatest(*hits))


def soft_penalty(score, reject, warning, lam: float, warning_share: float = 0.3) -> Column:
    """Score - lambda * (reject + share * warning)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(score) - F.lit(lam) * (c(reject) + F.lit(warning_share) * c(warning))


def risk_borda(total_rank, reject, warning, lam: float) -> Column:
    """Penalised rank sum (small is good) as a score; rejects cost 10, warnings 3."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    risk = F.when(c(reject) == 1, 10.0).when(c(warning) == 1, 3.0).otherwise(0.0)
    return -(c(total_rank) + F.lit(lam) * risk)


def conservative_hybrid(df: DataFrame, main_rank: str, other_rank: str, reject: str, share: float = 0.2, k: int = 10,
                        query="query_id", out="rank") -> DataFrame:
    """Queries with too many rejects in the main top k use the other ranking."""
    w = Window.partitionBy(query)
    top = F.col(main_rank) <= k
    frac = F.sum(F.when(top, F.col(reject))).over(w) / F.sum(flag(top)).over(w)
    return df.withColumn("_f", frac).withColumn(
        out, F.when(F.col("_f") > share, F.col(other_rank)).otherwise(F.col(main_rank))).drop("_f")


def two_mode_profile(df: DataFrame, modes: dict[str, str], tier: str, tiers: Sequence[str], k: int = 10,
                     query="query_id") -> DataFrame:
    """Per query and mode the tier mix of its top k and any-flags, from rank columns of one table."""
    cells = df.select(query, tier, F.explode(F.array(*[
        F.when(F.col(r) <= k, F.lit(m)) for m, r in modes.items()])).alias("mode")).where("mode is not null")
    return cells.groupBy(query, "mode").agg(
        F.count("*").alias("n"), *[F.sum(flag(F.col(tier) == t)).cast("bigint").alias(f"n_{t}") for t in tiers],
        *[flag(F.bool_or(F.col(tier) == t)).alias(f"any_{t}") for t in tiers])


def margin_gate(df: DataFrame, score_a: str, rank_a: str, thresholds: Sequence[float], best_a: str = "rank_a",
                best_b: str = "rank_b", k: int = 10, query="query_id", label="label") -> DataFrame:
    """Per threshold, ranker A where its top-1 margin is larger, else B; wins per choice."""
    at = lambda i: F.max(F.when(F.col(rank_a) == i, F.col(score_a)))
    q = df.groupBy(query).agg(
        (at(1) - F.coalesce(at(2), F.lit(0.0))).alias("margin"), F.sum(label).alias("_p"),
        flag(F.coalesce(F.min(F.when(F.col(label) == 1, F.col(best_a))) <= k, F.lit(False))).alias("hit_a"),
        flag(F.coalesce(F.min(F.when(F.col(label) == 1, F.col(best_b))) <= k, F.lit(False))).alias("hit_b")
    ).where("_p > 0")
    cells = q.select("margin", "hit_a", "hit_b", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    use_a = F.col("margin") > F.col("threshold")
    s = lambda c: F.sum(flag(c)).cast("bigint")
    return cells.groupBy("threshold").agg(
        F.count("*").alias("n"), s(use_a).alias("a_selected"), s(use_a & (F.col("hit_a") == 1)).alias("a_wins"),
        s(~use_a & (F.col("hit_b") == 1)).alias("b_wins"))


def select_config(grid: DataFrame, family: str, value: str, tie_eps: float, simplicity: Sequence[Column]) -> DataFrame:
    """Per family the simplest configuration within ``tie_eps`` of the best."""
    top = grid.groupBy(family).agg((F.round(F.max(value), 9) - tie_eps).alias("_floor"))
    near = grid.join(top, family).where(F.round(value, 9) >= F.round("_floor", 9)).drop("_floor")
    rest = [c for c in near.columns if c != family]
    return near.groupBy(family).agg(F.min_by(F.struct(*rest), F.struct(*simplicity)).alias("_c")).select(family, "_c.*")
