"""Fusion, re-ranking and proposals over the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions.hashing import hash_fold
from rankspark.functions.scalar import first_match, r6
from rankspark.operators import fusion as X
from rankspark.operators import metrics as M
from rankspark.operators import priors as P
from rankspark.operators import propose as PP
from rankspark.operators import ranking as R
from rankspark.operators import sets as U
from rankspark.plans import fixtures as fx
from rankspark.plans.benchmark_queries import metric_sql
from rankspark.plans.prior_queries import rounded
from rankspark.plans.registry import query
from rankspark.plans.scalar_queries import FLAGS, OTHER_TIER, candidate_flags, tier_rules


def lists(spark, d, n: int = 50):
    """Top-n lists of both rankers as rows, unpivoted from one ranked table."""
    r = fx.ranked(spark, d)
    cells = F.array(*[F.when(F.col(f"rank_{m}") <= n, F.struct(F.lit(m).alias("method"), F.col(f"rank_{m}").alias("rank")))
                      for m in "ab"])
    return (r.select("query_id", "anchor", "candidate", "label", F.explode(cells).alias("e")).where("e is not null")
            .select("query_id", "anchor", "candidate", "label", "e.*"))


def _out(df):
    return df.where("rank <= 10").select("query_id", "candidate", "rank", "label", r6("score").alias("score"))


def _fused(score: str, where: str, n: int = 50, digits: int = 9) -> str:
    """SQL of a fused score over the cut lists."""
    return fx.sql(f"""SELECT query_id, candidate, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie, candidate) AS rank, label, round(score,6) AS score FROM (
 SELECT query_id, candidate, label, tie, {score} AS score FROM rk WHERE {where}) QUALIFY rank<=10""")


@query("borda", "X1", _fused("((CASE WHEN rank_a<=50 THEN 51-rank_a ELSE 0 END)+(CASE WHEN rank_b<=50 THEN 51-rank_b ELSE 0 END))::DOUBLE", "rank_a<=50 OR rank_b<=50"))
def borda(spark, d):
    return _out(X.borda(lists(spark, d), 50))


@query("borda_left", "X1", _fused("((CASE WHEN rank_a<=50 THEN 51-rank_a ELSE 0 END)+(CASE WHEN rank_b<=50 THEN 51-rank_b ELSE 0 END))::DOUBLE", "rank_a<=50"))
def borda_left(spark, d):
    return _out(X.borda(lists(spark, d), 50, "left", "a"))


@query("rank_sum", "X1", _fused("-(CASE WHEN rank_a<=10 THEN rank_a ELSE 11 END + CASE WHEN rank_b<=10 THEN rank_b ELSE 11 END)::DOUBLE", "rank_a<=10 OR rank_b<=10"))
def rank_sum(spark, d):
    return _out(X.rank_sum(lists(spark, d), ["a", "b"], 10, 11))


@query("rrf", "X2", _fused("(CASE WHEN rank_a<=50 THEN 2.0::DOUBLE/(60.0::DOUBLE+rank_a) ELSE 0.0 END)+(CASE WHEN rank_b<=50 THEN 1.0::DOUBLE/(60.0::DOUBLE+rank_b) ELSE 0.0 END)", "rank_a<=50 OR rank_b<=50"))
def rrf(spark, d):
    return _out(X.rrf(lists(spark, d), 60, {"a": 2.0, "b": 1.0}))


@query("rank_average", "X3", _fused("-((rank_a+rank_b)/2.0::DOUBLE)", "rank_a<=50 AND rank_b<=50"))
def rank_average(spark, d):
    return _out(X.rank_average(lists(spark, d), 2))


@query("weighted_negative_rank", "X3 R5", _fused("-((0.0::DOUBLE+2.0::DOUBLE*rank_a+1.0::DOUBLE*rank_b)/3.0::DOUBLE)", "true"))
def weighted_negative_rank(spark, d):
    s = fx.ranked(spark, d).withColumn("score", X.weighted_negative_rank({"rank_a": 2.0, "rank_b": 1.0}))
    return _out(R.rank_candidates(s, "score"))


ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]
ZS = """zs AS (SELECT *, round(CASE WHEN stddev_pop(score_a) OVER w<=1e-12 THEN 0.0 ELSE (score_a-avg(score_a) OVER w)/stddev_pop(score_a) OVER w END,9) AS za,
 round(CASE WHEN stddev_pop(score_b) OVER w<=1e-12 THEN 0.0 ELSE (score_b-avg(score_b) OVER w)/stddev_pop(score_b) OVER w END,9) AS zb FROM sc WINDOW w AS (PARTITION BY query_id))"""
GRID = ZS + """, gr AS (SELECT query_id, anchor, label, variant, row_number() OVER (PARTITION BY query_id, variant ORDER BY s DESC, tie, candidate) AS r FROM (
 SELECT query_id, anchor, candidate, label, tie, printf('%.2f', x) AS variant, round(x*za+(1.0::DOUBLE-x)*zb,9) AS s FROM zs, (VALUES (0.0::DOUBLE),(0.25),(0.5),(0.75),(1.0)) v(x))),
gb AS (SELECT query_id, variant, min(anchor) AS anchor, min(CASE WHEN label=1 THEN r END) AS best_rank FROM gr GROUP BY ALL HAVING sum(label)>0),
gs AS (SELECT variant, count(*) AS n, avg((best_rank<=1)::INT) AS hit1, avg((best_rank<=5)::INT) AS hit5, avg((best_rank<=10)::INT) AS hit10, avg(1.0::DOUBLE/best_rank) AS mrr FROM gb GROUP BY 1)"""


def blend_grid(spark, d):
    return X.variant_summary(X.zscore_blend_grid(fx.scored(spark, d), "score_a", "score_b", ALPHAS))


@query("zscore_blend_grid", "X4 R5", fx.sql("SELECT variant, n, round(hit1,6) AS hit1, round(hit5,6) AS hit5, round(hit10,6) AS hit10, round(mrr,6) AS mrr FROM gs", GRID))
def zscore_blend_grid(spark, d):
    return rounded(blend_grid(spark, d), "hit1", "hit5", "hit10", "mrr")


@query("select_config", "R19", fx.sql("""SELECT family, variant, round(hit10,6) AS hit10 FROM (SELECT CASE WHEN variant IN ('0.00','1.00') THEN 'single' ELSE 'mixed' END AS family, * FROM gs)
 QUALIFY hit10>=max(hit10) OVER (PARTITION BY family)-0.005 AND row_number() OVER (PARTITION BY family, hit10>=0 ORDER BY (hit10>=mx-0.005)::INT DESC, abs(variant::DOUBLE-0.5), variant)=1""".replace(
    "FROM (SELECT CASE", "FROM (SELECT *, max(hit10) OVER (PARTITION BY family) AS mx FROM (SELECT CASE").replace("* FROM gs)", "* FROM gs))"), GRID))
def select_config(spark, d):
    g = blend_grid(spark, d).withColumn("family", F.when(F.col("variant").isin("0.00", "1.00"), "single").otherwise("mixed"))
    o = X.select_config(g.select("family", "variant", "hit10"), "family", "hit10", 0.005,
                        [F.abs(F.col("variant").cast("double") - 0.5), F.col("variant")])
    return rounded(o, "hit10")


@query("boundary_rerank", "X5", fx.sql("""SELECT query_id, candidate, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank_a<=5 THEN 0 WHEN rank_a<=30 THEN 1 ELSE 2 END, CASE WHEN rank_a>5 AND rank_a<=30 THEN -score_b END NULLS FIRST, rank_a) AS rank FROM rk QUALIFY rank<=12"""))
def boundary_rerank(spark, d):
    b = X.boundary_rerank(fx.ranked(spark, d), "rank_a", "score_b", 5, 30)
    return b.where("rank <= 12").select("query_id", "candidate", "rank")


@query("rerank_within_topk", "X6", fx.sql("""SELECT query_id, candidate, row_number() OVER (PARTITION BY query_id ORDER BY (rank_a>20)::INT, CASE WHEN rank_a<=20 THEN -score_b END NULLS FIRST, rank_a) AS rank FROM rk QUALIFY rank<=10"""))
def rerank_within_topk(spark, d):
    b = X.rerank_within_topk(fx.ranked(spark, d), "rank_a", "score_b", 20)
    return b.where("rank <= 10").select("query_id", "candidate", "rank")


def wide(spark, d):
    return X.wide_metrics(fx.scored(spark, d), {"a": F.col("score_a"), "b": F.col("score_b")})


WIDE = """wm AS (SELECT *, (best_a<=1)::INT AS hit1_a, (best_b<=1)::INT AS hit1_b, (best_a<=5)::INT AS hit5_a, (best_b<=5)::INT AS hit5_b, (best_a<=10)::INT AS hit10_a, (best_b<=10)::INT AS hit10_b, 1.0::DOUBLE/best_a AS mrr_a, 1.0::DOUBLE/best_b AS mrr_b
 FROM (SELECT query_id, min(anchor) AS anchor, min(context) AS context, count(*) AS n_candidates, sum(label)::BIGINT AS n_positive, min(CASE WHEN label=1 THEN rank_a END) AS best_a, min(CASE WHEN label=1 THEN rank_b END) AS best_b FROM rk GROUP BY 1 HAVING sum(label)>0))"""
VAL = "('0x'||substr(md5(query_id),1,8))::BIGINT % 2 = 0"


@query("segment_router", "X7", fx.sql(f"""SELECT context, count(*) AS n, sum(routed)::BIGINT AS routed, round(avg(CASE WHEN routed=1 THEN hit10_b ELSE hit10_a END),6) AS hit10, round(avg(CASE WHEN routed=1 THEN mrr_b ELSE mrr_a END),6) AS mrr FROM (
 SELECT w.*, coalesce(r.use_b,0) AS routed FROM wm w LEFT JOIN ru r ON r.anchor=w.anchor AND r.context=w.context WHERE NOT ({VAL.replace('query_id','w.query_id')})) GROUP BY 1""",
    WIDE + f""", ru AS (SELECT anchor, context, (count(*)>=3 AND round(avg(hit10_b),9)>round(avg(hit10_a),9) AND round(avg(mrr_b),9)>=round(avg(mrr_a),9))::INT AS use_b FROM wm WHERE {VAL} GROUP BY ALL)"""))
def segment_router(spark, d):
    w = wide(spark, d)
    val = hash_fold("query_id", 2) == 0
    rules = X.segment_rules(w.where(val), ["anchor", "context"], "hit10_a", "hit10_b", "mrr_a", "mrr_b", 3)
    r = X.apply_router(w.where(~val), rules, ["anchor", "context"], {"hit10": ("hit10_a", "hit10_b"), "mrr": ("mrr_a", "mrr_b")})
    return r.groupBy("context").agg(F.count("*").alias("n"), F.sum("routed").cast("bigint").alias("routed"),
                                    r6(F.avg("hit10")).alias("hit10"), r6(F.avg("mrr")).alias("mrr"))


@query("oracle_rank", "X9", fx.sql("SELECT query_id, least(best_a,best_b) AS oracle_rank, greatest(hit10_a,hit10_b) AS oracle_hit FROM wm", WIDE))
def oracle_rank(spark, d):
    return X.oracle(wide(spark, d), ["best_a", "best_b"], ["hit10_a", "hit10_b"]).select(
        "query_id", "oracle_rank", "oracle_hit")


def flagged(spark, d):
    return fx.ranked(spark, d).join(candidate_flags(spark, d), "candidate")


LAMS = [0.0, 1.0, 5.0, 20.0]


@query("soft_penalty", "X10", fx.sql("""SELECT lam, count(*) AS n, round(avg((best<=10)::INT),6) AS hit10, round(avg(1.0::DOUBLE/best),6) AS mrr FROM (SELECT lam, query_id, min(CASE WHEN label=1 THEN r END) AS best FROM (
 SELECT query_id, label, lam, row_number() OVER (PARTITION BY query_id, lam ORDER BY score_a-lam*(reject+0.3::DOUBLE*warning) DESC, tie, rk.candidate) AS r FROM rk JOIN cf ON cf.candidate=rk.candidate, (VALUES (0.0::DOUBLE),(1.0),(5.0),(20.0)) v(lam)) GROUP BY ALL HAVING sum(label)>0) GROUP BY 1""", FLAGS))
def soft_penalty(spark, d):
    b = X.grid_best_ranks(flagged(spark, d), {str(x): X.soft_penalty("score_a", "reject", "warning", x) for x in LAMS})
    s = X.variant_summary(b)
    return s.select(F.col("variant").cast("double").alias("lam"), "n", r6("hit10").alias("hit10"), r6("mrr").alias("mrr"))


@query("risk_borda", "X10", fx.sql("""SELECT query_id, candidate, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, tie, candidate) AS rank FROM (SELECT query_id, rk.candidate, tie,
 -((CASE WHEN rank_a<=50 THEN rank_a ELSE 51 END + CASE WHEN rank_b<=50 THEN rank_b ELSE 51 END)+0.5::DOUBLE*CASE WHEN reject=1 THEN 10.0 WHEN warning=1 THEN 3.0 ELSE 0.0 END) AS s FROM rk JOIN cf ON cf.candidate=rk.candidate WHERE rank_a<=50 OR rank_b<=50) QUALIFY rank<=10""", FLAGS))
def risk_borda(spark, d):
    f = flagged(spark, d).where("rank_a <= 50 or rank_b <= 50")
    total = F.least("rank_a", F.lit(51)) + F.least("rank_b", F.lit(51))
    s = f.withColumn("score", X.risk_borda(total, "reject", "warning", 0.5))
    return R.rank_candidates(s, "score").where("rank <= 10").select("query_id", "candidate", "rank")


@query("tier_first", "X11", fx.sql("""SELECT query_id, rk.candidate, row_number() OVER (PARTITION BY query_id ORDER BY reject*2+warning, score_a DESC, tie, rk.candidate) AS rank FROM rk JOIN cf ON cf.candidate=rk.candidate QUALIFY rank<=10""", FLAGS))
def tier_first(spark, d):
    r = R.policy_rank(flagged(spark, d), [(F.col("reject") * 2 + F.col("warning")).asc(), F.desc("score_a")])
    return r.where("rank <= 10").select("query_id", "candidate", "rank")


@query("conservative_hybrid", "X12", fx.sql("""SELECT context, sum((f>0.2)::INT)::BIGINT AS switched, count(*) AS n, round(avg(best),6) AS mean_best FROM (SELECT query_id, context, max(f) AS f, min(CASE WHEN label=1 THEN CASE WHEN f>0.2 THEN rank_b ELSE rank_a END END)::DOUBLE AS best FROM (
 SELECT rk.*, sum(CASE WHEN rank_a<=10 THEN reject END) OVER (PARTITION BY query_id)/10.0::DOUBLE AS f FROM rk JOIN cf ON cf.candidate=rk.candidate) GROUP BY ALL HAVING sum(label)>0) GROUP BY 1""", FLAGS))
def conservative_hybrid(spark, d):
    h = X.conservative_hybrid(flagged(spark, d), "rank_a", "rank_b", "reject")
    q = h.groupBy("query_id", "context").agg(
        F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("best"),
        F.max(F.when(F.col("rank") != F.col("rank_a"), 1).otherwise(0)).alias("switched"), F.sum("label").alias("p")).where("p > 0")
    return q.groupBy("context").agg(F.sum("switched").cast("bigint").alias("switched"), F.count("*").alias("n"),
                                    r6(F.avg("best")).alias("mean_best"))


TIERS = ["Tier1_STANDARD_REVIEW", "Tier2_EXPERT_REVIEW", "Tier3_HARD_REJECT"]
TIER_SQL = """CASE WHEN pending=1 THEN 'Tier0_DATA_PENDING' WHEN reject=1 THEN 'Tier3_HARD_REJECT' WHEN warning=1 OR geometry=1 THEN 'Tier2_EXPERT_REVIEW' WHEN ready=1 THEN 'Tier1_STANDARD_REVIEW' ELSE 'TierX_OTHER_REVIEWABLE' END"""


def tiered(spark, d):
    return flagged(spark, d).withColumn("tier", first_match(tier_rules(), OTHER_TIER))


@query("two_mode_profile", "X13", fx.sql(f"""SELECT mode, n_queries, {", ".join(f"n_{t}" for t in TIERS)}, any_reject, mode_overlap FROM (SELECT mode, count(*) AS n_queries, {", ".join(f"sum(n_{t})::BIGINT AS n_{t}" for t in TIERS)}, sum((n_Tier3_HARD_REJECT>0)::INT)::BIGINT AS any_reject FROM (
 SELECT query_id, mode, {", ".join(f"sum((tier='{t}')::INT) AS n_{t}" for t in TIERS)} FROM (SELECT query_id, {TIER_SQL} AS tier, mode FROM rk JOIN cf ON cf.candidate=rk.candidate, (VALUES ('conservative'),('exploration')) v(mode)
  WHERE CASE mode WHEN 'conservative' THEN rank_a ELSE rank_b END<=10) GROUP BY ALL) GROUP BY mode), (SELECT count(*) AS mode_overlap FROM rk WHERE rank_a<=10 AND rank_b<=10)""", FLAGS))
def two_mode_profile(spark, d):
    t = tiered(spark, d)
    p = X.two_mode_profile(t, {"conservative": "rank_a", "exploration": "rank_b"}, "tier", TIERS)
    both = t.where("rank_a <= 10 and rank_b <= 10").agg(F.count("*"))
    return p.groupBy("mode").agg(
        F.count("*").alias("n_queries"), *[F.sum(f"n_{x}").cast("bigint").alias(f"n_{x}") for x in TIERS],
        F.sum("any_Tier3_HARD_REJECT").cast("bigint").alias("any_reject")).withColumn("mode_overlap", both.scalar())


@query("margin_gate", "X14", fx.sql("""SELECT t AS threshold, count(*) AS n, sum((margin>t)::INT)::BIGINT AS a_selected, sum((margin>t AND best_a<=10)::INT)::BIGINT AS a_wins, sum((margin<=t AND best_b<=10)::INT)::BIGINT AS b_wins FROM (
 SELECT query_id, max(CASE WHEN rank_b=1 THEN score_b END)-coalesce(max(CASE WHEN rank_b=2 THEN score_b END),0.0) AS margin, min(CASE WHEN label=1 THEN rank_b END) AS best_a, min(CASE WHEN label=1 THEN rank_a END) AS best_b FROM rk GROUP BY 1 HAVING sum(label)>0), (VALUES (0.1::DOUBLE),(0.25),(0.5),(1.0),(2.0),(5.0)) v(t) GROUP BY 1"""))
def margin_gate(spark, d):
    return X.margin_gate(fx.ranked(spark, d), "score_b", "rank_b", [0.1, 0.25, 0.5, 1.0, 2.0, 5.0], "rank_b", "rank_a")


# --- proposals -----------------------------------------------------------------------------------------------

@query("propose_random", "R1", fx.sql("""SELECT q.query_id, s.candidate, r::INT AS rank, 0 AS fallback FROM qt q JOIN (SELECT context, count(*) AS n FROM vocab GROUP BY 1) z ON z.context=q.context, unnest(range(1,11)) t(r)
 JOIN (SELECT context, candidate, row_number() OVER (PARTITION BY context ORDER BY md5('11|'||candidate), candidate) AS p FROM vocab) s ON s.context=q.context AND s.p=(('0x'||substr(md5('11|'||q.query_id),1,8))::BIGINT + r - 1) % z.n + 1"""))
def propose_random(spark, d):
    v = P.train_vocab(fx.train_positives(spark, d))
    return PP.propose_random(fx.query_table(spark, d), v, 10, 11)


SPARSE = """sp AS (SELECT DISTINCT query_id, anchor, context, candidate FROM purch WHERE is_train AND anchor NOT IN ('n1','n5') AND context<>'MACHINERY'),
l1 AS (SELECT anchor, context, candidate, count(*) AS n, row_number() OVER (PARTITION BY anchor, context ORDER BY count(*) DESC, candidate) AS r FROM sp GROUP BY anchor, context, candidate),
l2 AS (SELECT anchor, candidate, count(*) AS n, row_number() OVER (PARTITION BY anchor ORDER BY count(*) DESC, candidate) AS r FROM sp GROUP BY anchor, candidate),
l3 AS (SELECT context, candidate, count(*) AS n, row_number() OVER (PARTITION BY context ORDER BY count(*) DESC, candidate) AS r FROM sp GROUP BY context, candidate),
l4 AS (SELECT candidate, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, candidate) AS r FROM sp GROUP BY candidate),
al AS (SELECT query_id, candidate, r, n, 1 AS lv FROM qt JOIN l1 USING (anchor, context) UNION ALL SELECT query_id, candidate, r, n, 2 FROM qt JOIN l2 USING (anchor)
 UNION ALL SELECT query_id, candidate, r, n, 3 FROM qt JOIN l3 USING (context) UNION ALL SELECT query_id, candidate, r, n, 4 FROM qt, l4)"""


def held_positives(spark, d):
    """Train purchases without two anchors and one context, whose queries must fall back."""
    return (fx.purchases(spark, d).where("is_train AND anchor NOT IN ('n1','n5') AND context<>'MACHINERY'")
            .select("query_id", "anchor", "context", "candidate").distinct())


LEVELS = [("transform", ["anchor", "context"]), ("anchor", ["anchor"]), ("context", ["context"]), ("global", [])]


@query("propose_frequency", "R2", fx.sql("""SELECT query_id, candidate, r AS rank, n, (['transform','anchor','context','global'])[lv] AS level, (lv>1)::INT AS fallback FROM al WHERE r<=10 QUALIFY lv=min(lv) OVER (PARTITION BY query_id)""", SPARSE))
def propose_frequency(spark, d):
    return PP.propose_frequency(fx.query_table(spark, d), held_positives(spark, d), 10, LEVELS)


@query("two_stage", "R13", fx.sql("""SELECT query_id, candidate, row_number() OVER (PARTITION BY query_id ORDER BY round(0.3::DOUBLE*ln(1.0::DOUBLE+score_a)/10.0::DOUBLE+0.7::DOUBLE*score_c,9) DESC, tie, candidate) AS rank FROM rc WHERE rank_a<=100 QUALIFY rank<=10""", fx.RANKED_C))
def two_stage(spark, d):
    r = R.rank_candidates(fx.featured(spark, d), "score_a", "rank_a").where("rank_a <= 100")
    s = r.withColumn("score", F.round(PP.two_stage(F.log1p("score_a"), "score_c"), 9))
    return R.rank_candidates(s, "score").where("rank <= 10").select("query_id", "candidate", "rank")
