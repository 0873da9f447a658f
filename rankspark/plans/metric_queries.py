"""Metrics and reports over the test tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import scalar as S
from rankspark.functions.hashing import hash_fold
from rankspark.functions.scalar import r6
from rankspark.operators import fusion as X
from rankspark.operators import metrics as M
from rankspark.operators import propose as PP
from rankspark.operators import ranking as R
from rankspark.operators import stats as ST
from rankspark.plans import fixtures as fx
from rankspark.plans.benchmark_queries import HITS, metric_sql, random_hit_sql
from rankspark.plans.fusion_queries import (LEVELS, SPARSE, TIER_SQL, WIDE, flagged, held_positives, tiered, wide)
from rankspark.plans.prior_queries import rounded
from rankspark.plans.registry import query
from rankspark.session import cut_lineage
from rankspark.plans.scalar_queries import EDGES, FLAGS, edge_table
from rankspark.schema import flag

METHODS = {"a": "rank_a", "b": "rank_b", "c": "rank_c"}


@query("ranking_metrics", "M1 M2", fx.sql("SELECT query_id, n_candidates, n_positive, best_rank, hit1, hit5, hit10, round(mrr,6) AS mrr, round(ndcg10,6) AS ndcg10 FROM d", f"d AS ({metric_sql('rk', 'rank_b')})"))
def ranking_metrics(spark, d):
    return rounded(M.metrics_from_ranks(fx.ranked(spark, d), "rank_b", random=False), "mrr", "ndcg10")


@query("ranking_metrics_zero", "M1", fx.sql("SELECT count(*) AS n, sum(hit10)::BIGINT AS hits, round(avg(mrr),6) AS mrr, round(avg(ndcg10),6) AS ndcg10 FROM d", f"d AS ({metric_sql('rk', 'rank_a', zero=True)})"))
def ranking_metrics_zero(spark, d):
    m = M.metrics_from_ranks(fx.ranked(spark, d), "rank_a", random=False, no_positive="zero")
    return m.agg(F.count("*").alias("n"), F.sum("hit10").cast("bigint").alias("hits"), r6(F.avg("mrr")).alias("mrr"),
                 r6(F.avg("ndcg10")).alias("ndcg10"))


@query("random_hit", "M3", fx.sql("""SELECT query_id, round(e10,6) AS random_hit10, round(CASE WHEN e10>1e-12 THEN hit10/e10 END,6) AS enrichment10, round(CASE WHEN e10<1.0::DOUBLE-1e-12 THEN (hit10-e10)/(1.0::DOUBLE-e10) END,6) AS norm_hit10, round(e1,6) AS random_hit1 FROM e""",
    f"d AS ({metric_sql('rk', 'rank_a')}), e AS (SELECT *, {random_hit_sql(10)} AS e10, {random_hit_sql(1)} AS e1 FROM d)"))
def random_hit(spark, d):
    m = M.metrics_from_ranks(fx.ranked(spark, d), "rank_a")
    return rounded(m.select("query_id", "random_hit10", "enrichment10", "norm_hit10", "random_hit1"),
                   "random_hit10", "enrichment10", "norm_hit10", "random_hit1")


ML = "ml AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({metric_sql('rc', f'rank_{m}')})" for m in "abc") + ")"


def method_detail(spark, d):
    return M.metrics_by_method(fx.ranked_c(spark, d), METHODS, carry=("anchor", "context"))


@query("summarise_methods", "M4", fx.sql("SELECT method, count(*) AS n_queries, count(DISTINCT anchor) AS n_groups, " + ", ".join(
    f"round(avg({c}),6) AS query_{c}, (SELECT round(avg(x),6) FROM (SELECT avg({c}) AS x FROM ml i WHERE i.method=ml.method GROUP BY anchor)) AS macro_{c}" for c in HITS) + " FROM ml GROUP BY method", fx.RANKED_C + ", " + ML))
def summarise_methods(spark, d):
    s = M.summarise(method_detail(spark, d))
    return rounded(s, *[c for c in s.columns if c.startswith(("query_", "macro_"))])


@query("method_deltas", "M4", fx.sql("SELECT " + ", ".join(f"round(avg({c}) FILTER (method='{x}')-avg({c}) FILTER (method='{y}'),6) AS delta_{x}_vs_{y}_query_{c}" for x, y in (("b", "a"), ("c", "a")) for c in ("hit10", "mrr")) + " FROM ml", fx.RANKED_C + ", " + ML))
def method_deltas(spark, d):
    s = M.method_deltas(M.summarise(method_detail(spark, d)), [("b", "a"), ("c", "a")], ["query_hit10", "query_mrr"])
    return rounded(s, *s.columns)


@query("pair_metrics", "M5 A17", fx.sql("""SELECT context, count(*) AS n_pairs, round(avg((rank_a<=1)::INT),6) AS pair_top1, round(avg((rank_a<=5)::INT),6) AS pair_top5, round(avg((rank_a<=10)::INT),6) AS pair_top10, round(avg(1.0::DOUBLE/rank_a),6) AS pair_mrr,
 round(sum(ln(1.0::DOUBLE+n_sources)*(rank_a<=10)::INT)/sum(ln(1.0::DOUBLE+n_sources)),6) AS weighted_top10 FROM rk JOIN edges ON template=anchor AND edges.candidate=rk.candidate WHERE label=1 GROUP BY 1""", EDGES))
def pair_metrics(spark, d):
    p = fx.ranked(spark, d).where("label = 1").withColumn("template", F.col("anchor")).join(
        edge_table(spark, d), ["template", "candidate"]).withColumn("weight", F.log1p("n_sources"))
    out = None
    hit10 = flag(F.col("rank_a") <= 10)
    o = p.groupBy("context").agg(
        F.count("*").alias("n_pairs"), *[F.avg(flag(F.col("rank_a") <= k)).alias(f"pair_top{k}") for k in (1, 5, 10)],
        F.avg(1.0 / F.col("rank_a")).alias("pair_mrr"), (F.sum(F.col("weight") * hit10) / F.sum("weight")).alias("weighted_top10"))
    return rounded(o, "pair_top1", "pair_top5", "pair_top10", "pair_mrr", "weighted_top10")


@query("rescue_lost", "M9", fx.sql("""SELECT count(*) AS n, r AS rescued, l AS lost, r-l AS net, round(r/l::DOUBLE,6) AS ratio FROM (SELECT sum((hit10_b=1 AND hit10_a=0)::INT)::BIGINT AS r, sum((hit10_b=0 AND hit10_a=1)::INT)::BIGINT AS l FROM wm), wm GROUP BY r, l""", WIDE))
def rescue_lost(spark, d):
    return rounded(M.rescue_lost(wide(spark, d)), "ratio")


@query("rescue_intervals", "M9")
def rescue_intervals(spark, d):
    return rounded(ST.rescue_intervals(wide(spark, d)), "estimate", "low", "high")


SEEDS = "('0x'||substr(md5(query_id),1,8))::BIGINT % 10"


@query("sign_flip_exact", "M10", fx.sql("""SELECT (SELECT count(*) FROM df) AS n, round((SELECT avg(x) FROM df),6) AS mean_diff, round(avg((s>=o)::INT),6) AS one_sided_p, round(avg((abs(s)>=abs(o))::INT),6) AS two_sided_p FROM (
 SELECT round(list_sum([arr[i+1]*(2*((id>>i)&1)-1) FOR i IN range(0,10)])/10,12) AS s, round(list_sum(arr)/10,12) AS o FROM (SELECT unnest(range(0,1024)) AS id), (SELECT list(x ORDER BY x) AS arr FROM df))""",
    WIDE + f", df AS (SELECT avg(mrr_b)-avg(mrr_a) AS x FROM wm GROUP BY {SEEDS})"))
def sign_flip_exact(spark, d):
    g = wide(spark, d).groupBy(hash_fold("query_id", 10).alias("s")).agg((F.avg("mrr_b") - F.avg("mrr_a")).alias("x"))
    return rounded(ST.sign_flip_exact(g.select("x"), "x"), "mean_diff", "one_sided_p", "two_sided_p")


@query("permute_within_query", "M11", fx.sql("""SELECT context, count(*) AS n, sum(lab)::BIGINT AS positives, round(avg((best<=10)::INT),6) AS hit10 FROM (SELECT query_id, context, sum(lab) AS lab, min(CASE WHEN lab=1 THEN rank_a END) AS best FROM (
 SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY md5('13|'||query_id||'|'||candidate), candidate)<=sum(label) OVER (PARTITION BY query_id))::INT AS lab FROM rk) GROUP BY ALL HAVING sum(lab)>0) GROUP BY 1"""))
def permute_within_query(spark, d):
    p = ST.permute_within_query(fx.ranked(spark, d), 13)
    m = M.metrics_from_ranks(p, "rank_a", random=False, carry=["context"])
    return m.groupBy("context").agg(F.count("*").alias("n"), F.sum("n_positive").alias("positives"), r6(F.avg("hit10")).alias("hit10"))


def subsets():
    return {"rare": F.col("n_positive") <= 2, "many": F.col("n_positive") > 8, "hard": F.col("hit10_a") == 0,
            "north": F.col("anchor").isin("n1", "n2", "n3", "n4"), "all": F.lit(True)}


SUB = "su AS (SELECT wm.*, s AS subset FROM wm, unnest(list_filter([CASE WHEN n_positive<=2 THEN 'rare' END, CASE WHEN n_positive>8 THEN 'many' END, CASE WHEN hit10_a=0 THEN 'hard' END, CASE WHEN anchor IN ('n1','n2','n3','n4') THEN 'north' END, 'all'], lambda x: x IS NOT NULL)) t(s))"


@query("subset_metrics", "M14", fx.sql("""SELECT subset, count(*) AS n, round(avg(hit10_a),6) AS hit10_a, round(avg(hit10_b),6) AS hit10_b, round(avg(mrr_a),6) AS mrr_a, round(avg(mrr_b),6) AS mrr_b, round(avg(mrr_b)-avg(mrr_a),6) AS diff FROM su GROUP BY 1""", WIDE + ", " + SUB))
def subset_metrics(spark, d):
    s = M.subset_metrics(wide(spark, d), subsets(), ["hit10_a", "hit10_b", "mrr_a", "mrr_b"])
    return rounded(s.withColumn("diff", F.col("mrr_b") - F.col("mrr_a")), "hit10_a", "hit10_b", "mrr_a", "mrr_b", "diff")


@query("gain_concentration", "M14", fx.sql("""SELECT anchor AS subset, gain, round(greatest(gain,0)/(SELECT sum(greatest(gain,0)) FROM g)::DOUBLE,6) AS share, (greatest(gain,0)/(SELECT sum(greatest(gain,0)) FROM g)::DOUBLE>0.5)::INT AS concentrated FROM g""", WIDE + ", g AS (SELECT anchor, sum(hit10_b-hit10_a)::BIGINT AS gain FROM wm GROUP BY 1)"))
def gain_concentration(spark, d):
    g = wide(spark, d).groupBy(F.col("anchor").alias("subset")).agg(F.sum(F.col("hit10_b") - F.col("hit10_a")).cast("bigint").alias("gain"))
    return rounded(M.concentration(g), "share")


RB = "CASE WHEN {0}<=1 THEN 'rank=1' WHEN {0}<=5 THEN 'rank=2-5' WHEN {0}<=10 THEN 'rank=6-10' WHEN {0}<=20 THEN 'rank=11-20' ELSE 'rank>20' END"


@query("stratified_report", "M15", fx.sql(f"""SELECT anchor, rank_bin, context, count(*) AS n, sum(hit10_b)::BIGINT AS hits, sum((hit10_b=1 AND hit10_a=0)::INT)::BIGINT AS rescued FROM (SELECT *, {RB.format('best_a')} AS rank_bin FROM wm) GROUP BY GROUPING SETS ((anchor),(rank_bin),(context))""", WIDE))
def stratified_report(spark, d):
    w = wide(spark, d).withColumn("rank_bin", S.rank_bin("best_a"))
    g = w.groupingSets([[F.col("anchor")], [F.col("rank_bin")], [F.col("context")]], "anchor", "rank_bin", "context")
    return g.agg(F.count("*").alias("n"), F.sum("hit10_b").cast("bigint").alias("hits"),
                 F.sum(flag((F.col("hit10_b") == 1) & (F.col("hit10_a") == 0))).cast("bigint").alias("rescued"))


FUSED = """rf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -(rank_a+rank_b) DESC, tie, candidate) AS rank_x FROM rk),
wx AS (SELECT query_id, min(anchor) AS anchor, min(context) AS context, min(CASE WHEN label=1 THEN rank_a END)<=10 AS a, min(CASE WHEN label=1 THEN rank_b END)<=10 AS b, min(CASE WHEN label=1 THEN rank_x END)<=10 AS x FROM rf GROUP BY 1 HAVING sum(label)>0)"""


def fused(spark, d):
    r = fx.ranked(spark, d).withColumn("score_x", -(F.col("rank_a") + F.col("rank_b")))
    return R.rank_candidates(r, "score_x", "rank_x")


def fused_hits(spark, d):
    w = M.wide_metrics(fused(spark, d), {"a": "rank_a", "b": "rank_b", "x": "rank_x"}, ks=(10,))
    return w.withColumn("oracle", F.greatest("hit10_a", "hit10_b"))


@query("gap_taxonomy", "M16", fx.sql("""SELECT CASE WHEN a OR b OR x THEN array_to_string(list_filter([CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN x THEN 'fused' END], lambda h: h IS NOT NULL), '+') ELSE 'none' END AS hits,
 count(*) AS n, sum((anchor IN ('n1','n5'))::INT)::BIGINT AS n_hard FROM wx GROUP BY 1""", FUSED))
def gap_taxonomy(spark, d):
    return M.hit_patterns(fused_hits(spark, d), {"a": "hit10_a", "b": "hit10_b", "fused": "hit10_x"}, {"hard": F.col("anchor").isin("n1", "n5")})


@query("policy_metrics", "M17", fx.sql(f"""SELECT policy, quadrant, count(*) AS n, round(avg(captured),6) AS capture_rate, round(avg(rejects),6) AS reject_rate, round(avg(readys),6) AS ready_rate FROM (
 SELECT query_id, policy, max(quadrant) AS quadrant, max(label) AS captured, avg(reject) AS rejects, avg(ready) AS readys FROM (SELECT rf.query_id, label, reject, ready, policy,
  CASE WHEN wx.a AND wx.b THEN 'both' WHEN wx.a THEN 'only_a' WHEN wx.b THEN 'only_b' ELSE 'neither' END AS quadrant FROM rf JOIN wx ON wx.query_id=rf.query_id JOIN cf ON cf.candidate=rf.candidate, (VALUES ('a'),('b'),('x')) v(policy)
  WHERE CASE policy WHEN 'a' THEN rank_a WHEN 'b' THEN rank_b ELSE rank_x END<=10) GROUP BY ALL) GROUP BY ALL""", FUSED + ", " + FLAGS))
def policy_metrics(spark, d):
    from rankspark.plans.scalar_queries import candidate_flags
    r = fused(spark, d).join(candidate_flags(spark, d).select("candidate", "reject", "ready"), "candidate")
    h = fused_hits(spark, d)
    A, B = F.col("hit10_a") == 1, F.col("hit10_b") == 1
    q = h.select("query_id", F.when(A & B, "both").when(A, "only_a").when(B, "only_b").otherwise("neither").alias("quadrant"))
    cells = r.select("query_id", "label", "reject", "ready", F.explode(F.filter(F.array(*[
        F.when(F.col(f"rank_{p}") <= 10, F.lit(p)) for p in "abx"]), lambda x: x.isNotNull())).alias("policy"))
    per = cells.groupBy("query_id", "policy").agg(F.max("label").alias("captured"), F.avg("reject").alias("rejects"),
                                                  F.avg("ready").alias("readys")).join(q, "query_id")
    return per.groupBy("policy", "quadrant").agg(
        F.count("*").alias("n"), r6(F.avg("captured")).alias("capture_rate"), r6(F.avg("rejects")).alias("reject_rate"),
        r6(F.avg("readys")).alias("ready_rate"))


@query("pareto_frontier", "M19", fx.sql("""SELECT p.policy, p.up, p.down, coalesce(string_agg(o.policy, '; ' ORDER BY o.policy),'') AS dominated_by, CASE WHEN count(o.policy)=0 THEN 'Pareto-optimal' ELSE 'Dominated' END AS status FROM pol p LEFT JOIN pol o ON o.up>p.up AND o.down<p.down GROUP BY p.policy, p.up, p.down""",
    WIDE + ", pol AS (SELECT anchor AS policy, round(avg(hit10_b),6) AS up, round(avg(best_b),6) AS down FROM wm GROUP BY 1)"))
def pareto_frontier(spark, d):
    p = wide(spark, d).groupBy(F.col("anchor").alias("policy")).agg(r6(F.avg("hit10_b")).alias("up"), r6(F.avg("best_b")).alias("down"))
    return M.pareto_frontier(p, "up", "down")


@query("stability_select", "M20", fx.sql("""SELECT policy, round(avg(delta),6) AS mean_delta, round(stddev_pop(delta),6) AS std_delta, round(min(delta),6) AS min_delta, sum((delta>0)::INT)::BIGINT AS positive_folds, (min(delta)>0 AND sum((delta>0)::INT)>=4)::INT AS stable FROM fo GROUP BY 1""",
    WIDE + f", fo AS (SELECT context AS policy, {SEEDS.replace('10', '5')} AS fold, round(avg(mrr_b)-avg(mrr_a),9) AS delta FROM wm GROUP BY ALL)"))
def stability_select(spark, d):
    f = wide(spark, d).groupBy(F.col("context").alias("policy"), hash_fold("query_id", 5).alias("fold")).agg(
        F.round(F.avg("mrr_b") - F.avg("mrr_a"), 9).alias("delta"))
    return rounded(M.stability_select(f), "mean_delta", "std_delta", "min_delta")


@query("baseline_summary", "M21", fx.sql(f"""SELECT 'frequency' AS method, count(*) AS n, round(avg(covered),6) AS coverage, round(avg(fallback),6) AS fallback_rate, round(avg(hit1),6) AS hit1, round(avg(hit5),6) AS hit5, round(avg(hit10),6) AS hit10, round(avg(mrr),6) AS mrr, round(avg(hit10)/avg(e),6) AS enrichment10
FROM (SELECT u.query_id, (p.query_id IS NOT NULL)::INT AS covered, coalesce(fb,0) AS fallback, coalesce((best<=1)::INT,0) AS hit1, coalesce((best<=5)::INT,0) AS hit5, coalesce((best<=10)::INT,0) AS hit10, coalesce(1.0::DOUBLE/best,0.0) AS mrr, e
 FROM (SELECT query_id, {random_hit_sql(10, 'n', 'p')} AS e FROM (SELECT query_id, count(*) AS n, sum(label)::BIGINT AS p FROM m GROUP BY 1 HAVING sum(label)>0)) u LEFT JOIN (SELECT pr.query_id, max(fallback) AS fb, min(CASE WHEN t.candidate IS NOT NULL THEN rank END) AS best FROM pr LEFT JOIN tpos t ON t.query_id=pr.query_id AND t.candidate=pr.candidate GROUP BY 1) p ON p.query_id=u.query_id)""",
    SPARSE + ", pr AS (SELECT query_id, candidate, r AS rank, (lv>1)::INT AS fallback FROM al WHERE r<=10 QUALIFY lv=min(lv) OVER (PARTITION BY query_id))"))
def baseline_summary(spark, d):
    pr = PP.propose_frequency(fx.query_table(spark, d), held_positives(spark, d), 10, LEVELS)
    t = fx.test_positives(spark, d).withColumn("_t", F.lit(1))
    per = pr.join(t, ["query_id", "candidate"], "left").groupBy("query_id").agg(
        F.max("fallback").alias("fb"), F.min(F.when(F.col("_t") == 1, F.col("rank"))).alias("best"))
    u = fx.matrix(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("label").alias("p")).where("p > 0")
    b = F.col("best")
    q = u.join(per.withColumn("_in", F.lit(1)), "query_id", "left").select(
        F.lit("frequency").alias("method"), F.coalesce("_in", F.lit(0)).alias("covered"), F.coalesce("fb", F.lit(0)).alias("fallback"),
        *[flag(F.coalesce(b <= k, F.lit(False))).alias(f"hit{k}") for k in (1, 5, 10)], F.coalesce(1.0 / b, F.lit(0.0)).alias("mrr"),
        S.random_hit("n", "p", 10).alias("random_hit10"))
    o = PP.baseline_summary(q)
    return rounded(o, *[c for c in o.columns if c not in ("method", "n")])


@query("coverage_audit", "M23", fx.sql("""SELECT context, count(*) AS rows, sum((rank_a<=10)::INT)::BIGINT AS in_a, sum((rank_b<=10)::INT)::BIGINT AS in_b, sum((rank_a<=10 AND rank_b<=10)::INT)::BIGINT AS overlapping, sum((rank_a<=10 AND rank_b>10)::INT)::BIGINT AS exclusive_a,
 sum((rank_a>10 AND rank_b<=10)::INT)::BIGINT AS exclusive_b, round(avg((score_b>0)::INT),6) AS join_coverage FROM rk GROUP BY 1"""))
def coverage_audit(spark, d):
    a, b = F.col("rank_a") <= 10, F.col("rank_b") <= 10
    s = lambda c, n: F.sum(flag(c)).cast("bigint").alias(n)
    return fx.ranked(spark, d).groupBy("context").agg(
        F.count("*").alias("rows"), s(a, "in_a"), s(b, "in_b"), s(a & b, "overlapping"), s(a & ~b, "exclusive_a"),
        s(~a & b, "exclusive_b"), r6(F.avg(flag(F.col("score_b") > 0))).alias("join_coverage"))


@query("metric_reconcile", "M24", fx.sql("""SELECT context, round(avg(hit10_a),6) AS expected, round(avg(hit10_a),6) AS actual, 0.0::DOUBLE AS abs_diff, 'PASS' AS status FROM wm GROUP BY 1""", WIDE))
def metric_reconcile(spark, d):
    """The same hit rate from ranked lists (windows) and from best ranks counted without sorting."""
    r = fx.ranked(spark, d)
    per = r.groupBy("query_id", "context").agg(F.max(flag((F.col("label") == 1) & (F.col("rank_a") <= 10))).alias("hit"),
                                               F.sum("label").alias("positives")).where("positives > 0")
    e = per.groupBy("context").agg(F.avg("hit").alias("expected"))
    best = X.grid_best_ranks(fx.scored(spark, d), {"a": F.col("score_a")}, carry=("context",))
    a = best.groupBy("context").agg(F.avg(flag(F.col("best_rank") <= 10)).alias("actual"))
    return rounded(M.metric_reconcile(e, a, ["context"], 1e-9), "expected", "actual", "abs_diff")


@query("rank_bin_flow", "M25", fx.sql(f"""SELECT {RB.format('best_a')} AS bin_a, {RB.format('best_b')} AS bin_b, count(*) AS n, round(count(*)/(SELECT count(*) FROM wm)::DOUBLE,6) AS share FROM wm GROUP BY ALL""", WIDE))
def rank_bin_flow(spark, d):
    return rounded(M.rank_bin_flow(wide(spark, d), S.rank_bin("best_a"), S.rank_bin("best_b")), "share")


@query("rank_transitions", "M25", fx.sql("""SELECT CASE WHEN best_b<best_a THEN 'gain' WHEN best_b>best_a THEN 'loss' ELSE 'unchanged' END AS transition, count(*) AS n, median(best_b-best_a)::DOUBLE AS median_rank_delta, round(count(*)/(SELECT count(*) FROM wm)::DOUBLE,6) AS rate FROM wm GROUP BY 1""", WIDE))
def rank_transitions(spark, d):
    return rounded(M.transition_groups(wide(spark, d), "best_a", "best_b"), "rate", "median_rank_delta")


@query("annotate_difficulty", "M26", fx.sql("""SELECT outcome, positives_bin, count(*) AS n, round(avg(mrr_a),6) AS mrr_a, round(avg(mrr_b),6) AS mrr_b, sum(seen)::BIGINT AS seen_anchor FROM (SELECT wm.*, CASE WHEN hit10_a=1 AND hit10_b=1 THEN 'both' WHEN hit10_a=1 THEN 'A only' WHEN hit10_b=1 THEN 'B only' ELSE 'none' END AS outcome,
 CASE WHEN n_positive=1 THEN '1' WHEN n_positive<=3 THEN '2-3' WHEN n_positive<=10 THEN '4-10' ELSE '>10' END AS positives_bin, (s.query_id IS NOT NULL)::INT AS seen FROM wm LEFT JOIN (SELECT DISTINCT query_id FROM pos) s ON s.query_id=wm.query_id) GROUP BY ALL""", WIDE))
def annotate_difficulty(spark, d):
    from rankspark.operators.splits import seen_flag
    w = seen_flag(wide(spark, d), fx.train_positives(spark, d), ["query_id"], "seen")
    A, B = F.col("hit10_a") == 1, F.col("hit10_b") == 1
    return w.groupBy(F.when(A & B, "both").when(A, "A only").when(B, "B only").otherwise("none").alias("outcome"),
                     S.cut("n_positive", [0, 1, 3, 10, None], ["1", "2-3", "4-10", ">10"]).alias("positives_bin")).agg(
        F.count("*").alias("n"), r6(F.avg("mrr_a")).alias("mrr_a"), r6(F.avg("mrr_b")).alias("mrr_b"),
        F.sum("seen").cast("bigint").alias("seen_anchor"))


@query("component_profile", "M27", fx.sql("""SELECT context, round(avg(sim),6) AS pool_sim, round(avg(CASE WHEN label=1 AND rank_a<=10 THEN sim END),6) AS a_sim, round(avg(CASE WHEN label=1 AND rank_b<=10 THEN sim END),6) AS b_sim, round(avg(CASE WHEN label=1 AND rank_a<=10 THEN score_b END),6) AS a_freq,
 round(avg(CASE WHEN label=1 AND rank_b<=10 THEN score_b END),6) AS b_freq, round(avg(CASE WHEN label=1 AND rank_a<=10 THEN rank_a END),6) AS a_rank, round(avg(CASE WHEN label=1 AND rank_b<=10 THEN rank_b END),6) AS b_rank FROM rc GROUP BY 1""", fx.RANKED_C))
def component_profile(spark, d):
    r = fx.ranked_c(spark, d)
    found = lambda m, c: r6(F.avg(F.when((F.col("label") == 1) & (F.col(f"rank_{m}") <= 10), F.col(c))))
    return r.groupBy("context").agg(
        r6(F.avg("sim")).alias("pool_sim"), found("a", "sim").alias("a_sim"), found("b", "sim").alias("b_sim"),
        found("a", "score_b").alias("a_freq"), found("b", "score_b").alias("b_freq"), found("a", "rank_a").alias("a_rank"),
        found("b", "rank_b").alias("b_rank"))


def _status(full, part):
    return F.when(full, "SUPPORTED").when(part, "PARTIALLY_SUPPORTED").otherwise("NOT_SUPPORTED")


@query("hypothesis_table", "M28", fx.sql("""SELECT h AS hypothesis, CASE WHEN full_ THEN 'SUPPORTED' WHEN part THEN 'PARTIALLY_SUPPORTED' ELSE 'NOT_SUPPORTED' END AS status FROM (SELECT 'H1' AS h, abs(many)<=0.01 AND abs(al)<=0.03 AS full_, abs(many)<=0.01 AS part FROM p
 UNION ALL SELECT 'H2', rare>0 AND rare>many, rare>0 FROM p UNION ALL SELECT 'H3', hard>0 AND hard>al, hard>0 FROM p UNION ALL SELECT 'H4', north<0 AND rare<0, north<0 OR rare<0 FROM p)""",
    WIDE + ", " + SUB + ", p AS (SELECT round(max(CASE WHEN subset='many' THEN d END),9) AS many, round(max(CASE WHEN subset='all' THEN d END),9) AS al, round(max(CASE WHEN subset='rare' THEN d END),9) AS rare, round(max(CASE WHEN subset='hard' THEN d END),9) AS hard, round(max(CASE WHEN subset='north' THEN d END),9) AS north FROM (SELECT subset, avg(hit10_b)-avg(hit10_a) AS d FROM su GROUP BY 1))"))
def hypothesis_table(spark, d):
    s = M.subset_metrics(wide(spark, d), subsets(), ["hit10_a", "hit10_b"]).withColumn("d", F.col("hit10_b") - F.col("hit10_a"))
    at = lambda n: F.round(F.max(F.when(F.col("subset") == n, F.col("d"))), 9).alias(n)
    p = s.agg(*[at(n) for n in ("many", "all", "rare", "hard", "north")])
    c = F.col
    rows = F.array(*[F.struct(F.lit(h).alias("hypothesis"), _status(full, part).alias("status")) for h, full, part in [
        ("H1", (F.abs("many") <= 0.01) & (F.abs("all") <= 0.03), F.abs("many") <= 0.01),
        ("H2", (c("rare") > 0) & (c("rare") > c("many")), c("rare") > 0),
        ("H3", (c("hard") > 0) & (c("hard") > c("all")), c("hard") > 0),
        ("H4", (c("north") < 0) & (c("rare") < 0), (c("north") < 0) | (c("rare") < 0))]])
    return p.select(F.explode(rows).alias("e")).select("e.*")


# --- resampling (rows-only checks; intervals are tested against closed forms) -----------------------------------

@query("bootstrap_ci", "M6")
def bootstrap_ci(spark, d):
    return rounded(ST.bootstrap_ci(wide(spark, d), "mrr_a", ["context"]), "estimate", "low", "high", "se")


@query("paired_bootstrap", "M7")
def paired_bootstrap(spark, d):
    return rounded(ST.paired_bootstrap(wide(spark, d), "hit10_b", "hit10_a", replicates=1000), "estimate", "low", "high", "se")


@query("clustered_bootstrap", "M8")
def clustered_bootstrap(spark, d):
    r = fx.ranked(spark, d).where("rank_a <= 10")
    return rounded(ST.clustered_bootstrap(r, "label", "query_id", ["context"]), "estimate", "low", "high", "se")


@query("two_group_difference", "M8")
def two_group_difference(spark, d):
    r = fx.ranked(spark, d).where("rank_a <= 10")
    return ST.two_group_difference(r, "label", "query_id", "context", "BUILDING", "MACHINERY")


def _shift(x: str, turn: int) -> str:
    k = f"((key * {2 * turn + 3} + {7919 * turn}) % {1 << 20})"
    return f"((({x} + {k}) * ({x} + {k}) * 31 + {x} * {k}) >> 5)"


def _permuted_sql() -> str:
    """One application of the keyed permutation to x, as nested selects."""
    sql = "SELECT *, x // b AS l, x % b AS c FROM src"
    for turn in range(4):
        sql = (f"SELECT * REPLACE ((l + {_shift('c', turn)}) % a AS l) FROM ({sql})" if turn % 2 == 0
               else f"SELECT * REPLACE ((c + {_shift('l', turn)}) % b AS c) FROM ({sql})")
    return f"SELECT i, replicate, key, n, a, b, l * b + c AS x FROM ({sql})"


NULL_SQL = """seated AS (SELECT template, candidate, greatest(0.0::DOUBLE,improvement)*ln(1.0::DOUBLE+n_sources) AS weight, row_number() OVER (ORDER BY md5('17|'||template||'|'||candidate), template, candidate)-1 AS i FROM edges),
size AS (SELECT count(*) AS n, greatest(1, floor(sqrt(count(*)::DOUBLE)))::BIGINT AS root FROM seated),
grid AS (SELECT n, a, (n+a-1)//a AS b FROM (SELECT n, unnest(range(root, root+least(root,1000)+1)) AS a FROM size) ORDER BY a*((n+a-1)//a)-n, a LIMIT 1),
first AS (SELECT i, replicate, ('0x'||substr(md5('17|'||replicate),1,5))::BIGINT AS key, n, a, b, i AS x FROM seated, grid, unnest(range(1,1001)) t(replicate)),
walk AS (""" + _permuted_sql().replace("FROM src", "FROM first") + " UNION ALL " + _permuted_sql().replace("FROM src", "FROM (SELECT * FROM walk WHERE x >= n)") + """),
pairs AS (SELECT anchor AS template, candidate, count(*) AS k FROM m WHERE label=1 GROUP BY ALL),
tot AS (SELECT sum(k)::DOUBLE AS t FROM pairs),
ob AS (SELECT sum(k*weight)/max(t) AS v FROM pairs JOIN seated USING (template, candidate), tot),
nul AS (SELECT replicate, sum(k*s.weight)/max(t) AS v FROM walk JOIN seated s ON s.i=walk.i JOIN seated o ON o.i=walk.x JOIN pairs p ON p.template=s.template AND p.candidate=o.candidate, tot WHERE x < n GROUP BY 1)"""


@query("randomized_prior_null", "M12", fx.sql("""SELECT round(max(ob.v),6) AS observed, round(avg(nul.v),6) AS null_mean, round(quantile_cont(nul.v,0.025),6) AS low, round(quantile_cont(nul.v,0.975),6) AS high,
 round((sum((nul.v>=ob.v)::INT)+1)/(count(*)+1.0::DOUBLE),6) AS p_value FROM nul, ob""", EDGES + ", " + NULL_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def randomized_prior_null(spark, d):
    e = edge_table(spark, d).withColumn("weight", S.edge_weight("full_activity_publication", "improvement", "n_sources"))
    pairs = fx.matrix(spark, d).where("label = 1").groupBy(F.col("anchor").alias("template"), "candidate").agg(F.count("*").alias("k"))
    total = pairs.agg(F.sum("k").cast("double"))
    score = lambda t: (F.sum(F.col("k") * F.col("weight")) / total.scalar()).alias("v")
    observed = pairs.join(e, ["template", "candidate"]).agg(score(0))
    null = ST.shuffled_edges(e.select("template", "candidate", "weight"), 1000, 17).join(
        pairs, ["template", "candidate"]).groupBy("replicate").agg(score(1))
    return rounded(ST.null_summary(observed, cut_lineage(null), "v"), "observed", "null_mean", "low", "high", "p_value")


@query("policy_pairwise", "M18")
def policy_pairwise(spark, d):
    det = M.metrics_by_method(fx.ranked_c(spark, d), METHODS).select(
        "query_id", "method", F.explode(F.array(F.struct(F.lit("hit10").alias("metric"), F.col("hit10").cast("double").alias("value")),
                                                F.struct(F.lit("mrr").alias("metric"), F.col("mrr").alias("value")))).alias("e")
    ).select("query_id", "method", "e.*")
    return rounded(ST.policy_pairwise(det, "method", "metric", "value", replicates=1000), "estimate", "low", "high", "se")
