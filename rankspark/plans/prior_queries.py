"""Priors, aggregates, windows and set operations over the test tables."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from rankspark.functions import bits as B
from rankspark.functions.scalar import frequency_band, r6
from rankspark.operators import fusion as X
from rankspark.operators import metrics as M
from rankspark.operators import priors as P
from rankspark.operators import quantiles as Q
from rankspark.operators import ranking as R
from rankspark.operators import sets as U
from rankspark.plans import fixtures as fx
from rankspark.plans.benchmark_queries import HITS, metric_sql, random_hit_sql
from rankspark.plans.registry import query
from rankspark.plans.scalar_queries import EDGES, edge_table, split_by_anchor
from rankspark.schema import flag


def rounded(df, *names):
    """Round the named double columns for comparison."""
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


@query("freq_priors", "A1", fx.sql("""SELECT 'global' AS level, NULL AS anchor, NULL AS context, candidate, count(*) AS n FROM pos GROUP BY candidate
UNION ALL SELECT 'context', NULL, context, candidate, count(*) FROM pos GROUP BY ALL
UNION ALL SELECT 'anchor', anchor, NULL, candidate, count(*) FROM pos GROUP BY ALL
UNION ALL SELECT 'anchor_context', anchor, context, candidate, count(*) FROM pos GROUP BY ALL"""))
def freq_priors(spark, d):
    return P.freq_priors(fx.train_positives(spark, d))


@query("freq_variants", "A3", fx.sql("""SELECT candidate, c, df, round(ln(1+c)/ln(1+(SELECT max(c) FROM g)),6) AS log_freq,
 round(c/(SELECT max(c) FROM g)*ln(na/(1+df)),6) AS tfidf, round(df/(na+1),6) AS diversity, round(c/df/(SELECT max(c) FROM g),6) AS concentration
 FROM g, (SELECT count(DISTINCT anchor)::DOUBLE AS na FROM pos)""",
    "g AS (SELECT candidate, count(*)::DOUBLE AS c, count(DISTINCT anchor)::DOUBLE AS df FROM pos GROUP BY candidate)"))
def freq_variants(spark, d):
    return rounded(P.freq_variants(fx.train_positives(spark, d)), "log_freq", "tfidf", "diversity", "concentration")


@query("success_matrix", "A4", fx.sql("""SELECT anchor, candidate, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY anchor)::DOUBLE,6) AS share FROM pos GROUP BY anchor, candidate"""))
def success_matrix(spark, d):
    return rounded(P.success_matrix(fx.train_positives(spark, d)), "share")


@query("strata_audit", "A6", fx.sql("""SELECT context, CASE WHEN score_b=0 THEN '0' WHEN score_b=1 THEN '1' WHEN score_b<5 THEN '2-4' ELSE '5+' END AS freq_band, label, count(*) AS n FROM sc GROUP BY ALL"""))
def strata_audit(spark, d):
    return fx.scored(spark, d).groupBy("context", frequency_band("score_b").alias("freq_band"), "label").agg(
        F.count("*").alias("n"))


@query("class_balance", "A7", fx.sql("""SELECT label, n, round(n/sum(n) OVER ()::DOUBLE,6) AS ratio, (abs(n/sum(n) OVER ()::DOUBLE-0.5)>0.1)::INT AS deviates, top_contexts FROM (
 SELECT label, sum(c)::BIGINT AS n, string_agg(CASE WHEN rn<=3 THEN context END, ';' ORDER BY rn) AS top_contexts FROM (SELECT label, context, count(*) AS c,
  row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, context) AS rn FROM m GROUP BY label, context) GROUP BY label)"""))
def class_balance(spark, d):
    c = fx.matrix(spark, d).groupBy("label", "context").agg(F.count("*").alias("c"))
    rn = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("c"), "context"))
    g = (c.withColumn("rn", rn).groupBy("label").agg(
        F.sum("c").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("rn") <= 3, F.struct("rn", "context")))), lambda x: x["context"]), ";").alias("top_contexts")))
    ratio = F.col("n") / g.agg(F.sum("n")).scalar()
    return g.select("label", "n", r6(ratio).alias("ratio"), flag(F.abs(ratio - 0.5) > 0.1).alias("deviates"),
                    "top_contexts")


@query("distribution_by_label", "A8", fx.sql("""SELECT metric, label, count(v) AS n, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS std, round(min(v),6) AS min, round(max(v),6) AS max,
 round(quantile_cont(v,0.1),6) AS p10, round(quantile_cont(v,0.25),6) AS p25, round(quantile_cont(v,0.5),6) AS p50, round(quantile_cont(v,0.75),6) AS p75, round(quantile_cont(v,0.9),6) AS p90
FROM (SELECT label, 'sim' AS metric, sim AS v FROM ft UNION ALL SELECT label, 'score_a', score_a FROM ft UNION ALL SELECT label, 'score_c', score_c FROM ft) GROUP BY ALL"""))
def distribution_by_label(spark, d):
    o = Q.distribution_by_label(fx.featured(spark, d), ["sim", "score_a", "score_c"])
    return rounded(o, "mean", "std", "min", "max", "p10", "p25", "p50", "p75", "p90")


@query("mean_contrast", "A9", fx.sql("""SELECT metric, round(a0,6) AS mean_0, round(a1,6) AS mean_1, round(a1-a0,6) AS contrast FROM (SELECT metric, avg(CASE WHEN label=0 THEN v END) AS a0, avg(CASE WHEN label=1 THEN v END) AS a1 FROM (
 SELECT context, metric, label, avg(v) AS v FROM (SELECT context, label, 'sim' AS metric, sim AS v FROM ft UNION ALL SELECT context, label, 'd1', d1 FROM ft UNION ALL SELECT context, label, 'score_b', score_b FROM ft) GROUP BY ALL) GROUP BY metric)"""))
def mean_contrast(spark, d):
    return rounded(Q.mean_contrast(fx.featured(spark, d), ["sim", "d1", "score_b"], by=["context"]),
                   "mean_0", "mean_1", "contrast")


@query("measurement_rollup", "A10", """SELECT l_partkey, count(*) AS n, min(u) AS min, max(u) AS max, round(median(u),6) AS median, count(DISTINCT s) AS n_tags, string_agg(DISTINCT s, ';' ORDER BY s) AS tags
FROM (SELECT l_partkey, l_extendedprice AS u, l_suppkey::VARCHAR AS s FROM lineitem) GROUP BY 1""")
def measurement_rollup(spark, d):
    li = fx.table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_extendedprice").select(
        "l_partkey", F.col("l_suppkey").cast("string").alias("s"),
        F.col("l_extendedprice").alias("u"))
    return rounded(Q.measurement_rollup(li, "l_partkey", "u", "s"), "median")


@query("train_vocab", "A12", fx.sql("""SELECT candidate, sum(n)::BIGINT AS freq, string_agg(context, ';' ORDER BY context) AS contexts, count(*) AS n_contexts FROM (SELECT candidate, context, count(*) AS n FROM pos GROUP BY ALL) GROUP BY 1"""))
def train_vocab(spark, d):
    return P.vocab_table(fx.train_positives(spark, d))


@query("candidate_set_sizes", "A13", fx.sql("""SELECT context, count(*) AS queries, round(avg(n),6) AS mean_size, quantile_cont(n,0.5)::DOUBLE AS p50, round(quantile_cont(n,0.9),6)::DOUBLE AS p90, max(n) AS max_size FROM (SELECT context, query_id, count(*) AS n FROM pos GROUP BY ALL) GROUP BY 1"""))
def candidate_set_sizes(spark, d):
    return rounded(P.candidate_set_sizes(fx.train_positives(spark, d), ["context"]), "mean_size", "p50", "p90")


@query("spearman", "A15", fx.sql("""SELECT count(*) AS n, round(corr(ra,rb),6) AS spearman FROM (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n)-1)/2.0::DOUBLE AS ra,
 rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k)-1)/2.0::DOUBLE AS rb FROM (SELECT query_id, count(*) AS n, count(DISTINCT p_brand) AS k FROM purch GROUP BY 1))"""))
def spearman(spark, d):
    s = fx.purchases(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("k"))
    return rounded(Q.spearman(s, "n", "k"), "spearman")


@query("norm_profile", "A16", """SELECT label, count(*) AS n, round(avg(x),6) AS mean_norm, round(quantile_cont(x,0.1),6) AS p10, round(quantile_cont(x,0.5),6) AS p50, round(quantile_cont(x,0.9),6) AS p90, round(avg((x<1e-9)::INT),6) AS zero_share
FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE*e::DOUBLE))) AS x FROM embeddings) GROUP BY label""")
def norm_profile(spark, d):
    e = fx.table(spark, d, "embeddings").withColumn("x", B.norm("embedding"))
    q = Q.exact_quantiles(e, "x", [0.1, 0.5, 0.9], ["label"], ["p10", "p50", "p90"])
    b = e.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean_norm"),
                               r6(F.avg(flag(F.col("x") < 1e-9))).alias("zero_share"))
    return rounded(b.join(q, "label"), "p10", "p50", "p90")


@query("prior_support", "A18", fx.sql("""SELECT query_id, min(anchor) AS anchor, min(context) AS context, quantile_cont(score_b,0.5)::DOUBLE AS median_support, round(avg(score_b),6) AS mean_support, round(quantile_cont(score_b,0.9),6) AS p90_support, max(score_b) AS max_support FROM sc GROUP BY 1"""))
def prior_support(spark, d):
    return rounded(P.prior_support(fx.scored(spark, d), "score_b", ["anchor", "context"]),
                   "median_support", "mean_support", "p90_support")


LEVELS = {"P0": [], "P1": ["context"], "P2": ["anchor"], "P4": ["anchor", "context"]}
PRIORS = """tr AS (SELECT qt.*, v.candidate, CASE WHEN t.candidate IS NULL THEN 0 ELSE 1 END AS label FROM qt JOIN vocab v ON v.context=qt.context
 LEFT JOIN pos t ON t.query_id=qt.query_id AND t.candidate=v.candidate WHERE ('0x'||substr(md5(qt.anchor),1,8))::BIGINT % 3 <> 0),
pr0 AS (SELECT 'P0' AS level, NULL AS anchor, NULL AS context, candidate, count(*) AS exposure, sum(label)::BIGINT AS positives FROM tr GROUP BY candidate
 UNION ALL SELECT 'P1', NULL, context, candidate, count(*), sum(label)::BIGINT FROM tr GROUP BY context, candidate
 UNION ALL SELECT 'P2', anchor, NULL, candidate, count(*), sum(label)::BIGINT FROM tr GROUP BY anchor, candidate
 UNION ALL SELECT 'P4', anchor, context, candidate, count(*), sum(label)::BIGINT FROM tr GROUP BY anchor, context, candidate),
pr1 AS (SELECT *, (positives+1.0::DOUBLE*(SELECT avg(label) FROM tr))/(exposure+1.0::DOUBLE) AS rate FROM pr0),
pr AS (SELECT *, ln(rate/(1-rate)) AS logit FROM pr1),
lk AS (SELECT m.*, p4.logit AS p4_logit, p4.rate AS p4_rate, p4.exposure::DOUBLE AS p4_exposure, p2.logit AS p2_logit, p2.rate AS p2_rate, p2.exposure::DOUBLE AS p2_exposure,
 p1.logit AS p1_logit, p1.rate AS p1_rate, p1.exposure::DOUBLE AS p1_exposure, p0.logit AS p0_logit, p0.rate AS p0_rate, p0.exposure::DOUBLE AS p0_exposure FROM m
 LEFT JOIN pr p4 ON p4.level='P4' AND p4.anchor=m.anchor AND p4.context=m.context AND p4.candidate=m.candidate
 LEFT JOIN pr p2 ON p2.level='P2' AND p2.anchor=m.anchor AND p2.candidate=m.candidate
 LEFT JOIN pr p1 ON p1.level='P1' AND p1.context=m.context AND p1.candidate=m.candidate
 LEFT JOIN pr p0 ON p0.level='P0' AND p0.candidate=m.candidate),
bo AS (SELECT *, CASE WHEN p4_logit IS NOT NULL THEN 'p4' WHEN p2_logit IS NOT NULL THEN 'p2' WHEN p1_logit IS NOT NULL THEN 'p1' WHEN p0_logit IS NOT NULL THEN 'p0' END AS backoff_level,
 round(coalesce(p4_logit,p2_logit,p1_logit,p0_logit),9) AS backoff_logit, coalesce(p4_exposure,p2_exposure,p1_exposure,p0_exposure) AS backoff_support FROM lk)"""


def train_matrix(spark, d):
    """Matrix labelled by train purchases, for the anchors of the train side."""
    pos = fx.train_positives(spark, d)
    m = P.expand_candidates(fx.query_table(spark, d), P.train_vocab(pos), pos)
    return split_by_anchor(m).where("split = 'train'").drop("split")


def prior_table(spark, d):
    return P.conditional_priors(train_matrix(spark, d), levels=LEVELS)


def looked_up(spark, d):
    pr = prior_table(spark, d)
    on = {"p4": ["anchor", "context", "candidate"], "p2": ["anchor", "candidate"], "p1": ["context", "candidate"],
          "p0": ["candidate"]}
    return P.lookup_priors(fx.matrix(spark, d), {
        lv: (pr.where(F.col("level") == lv.upper()), keys) for lv, keys in on.items()})


def backed_off(spark, d):
    return P.backoff_cascade(looked_up(spark, d), ["p4", "p2", "p1", "p0"]).withColumn(
        "backoff_logit", F.round("backoff_logit", 9))


@query("conditional_priors", "A19", fx.sql("SELECT level, anchor, context, candidate, exposure, positives, round(rate,6) AS rate, round(logit,6) AS logit FROM pr", PRIORS))
def conditional_priors(spark, d):
    return rounded(prior_table(spark, d), "rate", "logit")


@query("lookup_priors", "J5", fx.sql("SELECT count(*) AS rows, " + ", ".join(f"round(avg(({x}_logit IS NOT NULL)::INT),6) AS {x}_coverage" for x in ("p4", "p2", "p1", "p0")) + " FROM lk", PRIORS))
def lookup_priors(spark, d):
    o = P.prior_coverage(looked_up(spark, d), ["p4", "p2", "p1", "p0"])
    return rounded(o, "p4_coverage", "p2_coverage", "p1_coverage", "p0_coverage")


@query("backoff_cascade", "J6", fx.sql("SELECT backoff_level, context, count(*) AS n, round(avg(backoff_logit),6) AS logit, round(avg(backoff_support),6) AS support FROM bo GROUP BY ALL", PRIORS))
def backoff_cascade(spark, d):
    return backed_off(spark, d).groupBy("backoff_level", "context").agg(
        F.count("*").alias("n"), r6(F.avg("backoff_logit")).alias("logit"), r6(F.avg("backoff_support")).alias("support"))


@query("query_uncertainty", "W6", fx.sql("""SELECT query_id, round(ln(sum(e))-sum(e*ln(e))/sum(e),6) AS entropy, round(max(CASE WHEN r=1 THEN backoff_logit END)-max(CASE WHEN r=2 THEN backoff_logit END),6) AS margin,
 max(CASE WHEN r<=20 THEN backoff_support END) AS max_support FROM (SELECT *, exp(greatest(backoff_logit-max(backoff_logit) OVER (PARTITION BY query_id),-50.0)) AS e,
 row_number() OVER (PARTITION BY query_id ORDER BY backoff_logit DESC, md5(query_id||'|'||candidate), candidate) AS r FROM bo) GROUP BY 1""", PRIORS))
def query_uncertainty(spark, d):
    return rounded(R.query_uncertainty(backed_off(spark, d), "backoff_logit", "backoff_support"), "entropy", "margin")


@query("continuation_prior", "W8", fx.sql("""SELECT backoff_level, count(*) AS n, round(avg(c),6) AS continuation, round(avg(p4_logit-p2_logit),6) AS pmi_p4_p2, round(avg(p2_logit-p1_logit),6) AS pmi_p2_p1, round(avg(p1_logit-p0_logit),6) AS pmi_p1_p0 FROM (
 SELECT *, CASE WHEN p4_logit IS NOT NULL THEN conf*p4_logit+(1-conf)*p1_logit WHEN p2_logit IS NOT NULL THEN p2_logit-ln(2) WHEN p1_logit IS NOT NULL THEN p1_logit-ln(4) WHEN p0_logit IS NOT NULL THEN p0_logit-ln(8) END AS c FROM (
  SELECT *, least(coalesce(p4_exposure,0.0)/(SELECT greatest(max(coalesce(p4_exposure,0.0)),10.0) FROM bo),1.0) AS conf FROM bo)) GROUP BY 1""", PRIORS))
def continuation_prior(spark, d):
    o = P.continuation_prior(backed_off(spark, d), "p4", ["p2", "p1", "p0"], "p1")
    return o.groupBy("backoff_level").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in (
        "continuation", "pmi_p4_p2", "pmi_p2_p1", "pmi_p1_p0")])


@query("direct_prior", "J10", fx.sql("""SELECT m.anchor, count(*) AS n, sum((w IS NOT NULL)::INT)::BIGINT AS covered, round(avg(coalesce(w,0.0)),6) AS mean_prior FROM (SELECT DISTINCT anchor, candidate FROM m) m
 LEFT JOIN (SELECT template, candidate, max(greatest(0.0::DOUBLE,improvement)*ln(1.0::DOUBLE+n_sources)) AS w FROM edges GROUP BY ALL) e ON e.template=m.anchor AND e.candidate=m.candidate GROUP BY 1""", EDGES))
def direct_prior(spark, d):
    from rankspark.functions.scalar import edge_weight
    e = edge_table(spark, d).withColumn("weight", edge_weight("full_activity_publication", "improvement", "n_sources"))
    q = fx.matrix(spark, d).select(F.col("anchor").alias("template"), "candidate").distinct()
    has = e.select("template", "candidate").distinct().withColumn("_h", F.lit(1))
    return (P.direct_prior(q, e).join(has, ["template", "candidate"], "left").groupBy(F.col("template").alias("anchor"))
            .agg(F.count("*").alias("n"), F.count("_h").alias("covered"), r6(F.avg("direct_prior")).alias("mean_prior")))


@query("merge_methods", "J11", fx.sql("""SELECT query_id, candidate, (rank_a<=10)::INT AS in_a, (rank_b<=10)::INT AS in_b, CASE WHEN rank_a<=10 THEN rank_a END AS rank_a, CASE WHEN rank_b<=10 THEN rank_b END AS rank_b,
 CASE WHEN rank_a<=10 THEN score_a END AS score_a, CASE WHEN rank_b<=10 THEN score_b END AS score_b, label FROM rk WHERE rank_a<=10 OR rank_b<=10"""))
def merge_methods(spark, d):
    r = fx.ranked(spark, d)
    lists = U.concat([r.where(F.col(f"rank_{m}") <= 10).select("query_id", "candidate", "label", F.lit(m).alias("method"),
                                                              F.col(f"rank_{m}").alias("rank"),
                                                              F.col(f"score_{m}").alias("score")) for m in "ab"])
    return U.merge_methods(lists, ["a", "b"])


_SEV = ["ALERT", "SHIFT", "READY"]


@query("most_conservative", "J12", """SELECT p_type, p_brand, bucket, p_partkey FROM (SELECT *, CASE WHEN p_retailprice>1000 AND p_size>45 THEN 'ALERT' WHEN p_size>40 THEN 'SHIFT' ELSE 'READY' END AS bucket FROM part)
QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY list_position(['ALERT','SHIFT','READY'], bucket), p_partkey)=1""")
def most_conservative(spark, d):
    p = fx.table(spark, d, "part", "p_partkey", "p_type", "p_brand", "p_size", "p_retailprice").withColumn(
        "bucket", F.when((F.col("p_retailprice") > 1000) & (F.col("p_size") > 45), "ALERT")
        .when(F.col("p_size") > 40, "SHIFT").otherwise("READY"))
    return P.most_conservative(p, ["p_type", "p_brand"], _SEV, "bucket", ["p_partkey"])


@query("zero_fill", "J13", fx.sql(f"""SELECT qt.query_id, coalesce(hit10,0) AS hit10, round(coalesce(mrr,0.0),6) AS mrr FROM qt LEFT JOIN ({metric_sql('rk', 'rank_a')}) d ON d.query_id=qt.query_id"""))
def zero_fill(spark, d):
    m = M.metrics_from_ranks(fx.ranked(spark, d), "rank_a", random=False).select("query_id", "hit10", "mrr")
    return rounded(P.zero_fill(m, fx.query_table(spark, d), columns=["hit10", "mrr"]), "mrr")


# --- windows -------------------------------------------------------------------------------------------------

@query("rank_candidates", "W1 T1", fx.sql("SELECT query_id, candidate, rank_a, score_a FROM rk WHERE rank_a<=10"))
def rank_candidates(spark, d):
    t = R.top_k(fx.scored(spark, d), "score_a", 10, rank="rank_a")
    return t.select("query_id", "candidate", "rank_a", "score_a")


@query("rank_min_desc", "W2", fx.sql("""SELECT context, sum(ra)::BIGINT AS sum_ra, max(ra) AS max_ra, sum(rb)::BIGINT AS sum_rb, count(rb) AS n_rb FROM (SELECT context, rank() OVER (PARTITION BY query_id ORDER BY score_a DESC) AS ra,
 CASE WHEN score_b>0 THEN rank() OVER (PARTITION BY query_id ORDER BY CASE WHEN score_b>0 THEN score_b END DESC NULLS LAST) END AS rb FROM sc) GROUP BY 1"""))
def rank_min_desc(spark, d):
    s = fx.scored(spark, d).withColumn("score_b", F.when(F.col("score_b") > 0, F.col("score_b")))
    r = R.rank_min_desc(s, ["score_a", "score_b"])
    return r.groupBy("context").agg(F.sum("score_a_rank").alias("sum_ra"), F.max("score_a_rank").alias("max_ra"),
                                    F.sum("score_b_rank").alias("sum_rb"), F.count("score_b_rank").alias("n_rb"))


@query("policy_rank", "W3", fx.sql("""SELECT query_id, candidate, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (score_b>0)::INT DESC, score_a DESC, tie, candidate) AS rank FROM sc) WHERE rank<=5"""))
def policy_rank(spark, d):
    r = R.policy_rank(fx.scored(spark, d), [flag(F.col("score_b") > 0).desc(), F.desc("score_a")])
    return r.where("rank <= 5").select("query_id", "candidate", "rank")


@query("zscore_by_query", "W4", fx.sql("""SELECT context, round(avg(abs(z0)),6) AS z0, round(max(z1),6) AS z1, round(avg(abs((score_a-(SELECT avg(score_a) FROM sc WHERE label=1))/(SELECT stddev_pop(score_a) FROM sc WHERE label=1))),6) AS zt FROM (
 SELECT *, CASE WHEN stddev_pop(score_b) OVER w <= 1e-12 THEN 0.0 ELSE (score_b-avg(score_b) OVER w)/stddev_pop(score_b) OVER w END AS z0,
 (score_a-avg(score_a) OVER w)/(stddev_samp(score_a) OVER w+1e-6) AS z1 FROM sc WINDOW w AS (PARTITION BY query_id)) GROUP BY 1"""))
def zscore_by_query(spark, d):
    s = fx.scored(spark, d)
    z = s.withColumn("z0", R.zscore("score_b")).withColumn("z1", R.zscore("score_a", ddof=1, eps=1e-6))
    z = R.zscore_by_train(z, s.where("label = 1"), ["score_a"])
    return z.groupBy("context").agg(r6(F.avg(F.abs("z0"))).alias("z0"), r6(F.max("z1")).alias("z1"),
                                    r6(F.avg(F.abs("score_a_z"))).alias("zt"))


@query("sample_weights", "W5", fx.sql("""SELECT context, label, count(*) AS n, round(avg(w/(SELECT avg(w) FROM wt)),6) AS mean_weight FROM wt GROUP BY ALL""",
    """wt AS (SELECT m.*, (SELECT count(*) FROM m)::DOUBLE/(2.0::DOUBLE*nl)/nq/sqrt(nc) AS w FROM m JOIN (SELECT label, count(*) AS nl FROM m GROUP BY 1) l ON l.label=m.label
 JOIN (SELECT query_id, count(*) AS nq FROM m GROUP BY 1) q ON q.query_id=m.query_id JOIN (SELECT candidate, count(*) AS nc FROM m GROUP BY 1) c ON c.candidate=m.candidate)"""))
def sample_weights(spark, d):
    w = R.sample_weights(fx.matrix(spark, d))
    return w.groupBy("context", "label").agg(F.count("*").alias("n"), r6(F.avg("weight")).alias("mean_weight"))


_SHAPE = """round(stddev_pop(score_b),6) AS std, max(score_b)-min(score_b) AS range, """ + ", ".join(
    f"max(CASE WHEN rank_b={k} THEN score_b END)-max(CASE WHEN rank_b={k + 1} THEN score_b END) AS margin{k}" for k in R.MARGIN_RANKS
) + """, round(avg(CASE WHEN rank_b<=10 THEN score_b END),6) AS top10_mean, round(stddev_pop(CASE WHEN rank_b<=10 THEN score_b END),6) AS top10_std, max(CASE WHEN rank_b=10 THEN score_b END)-max(CASE WHEN rank_b=30 THEN score_b END) AS top10_to_30_gap,
 sum((rank_a<=10 AND rank_b<=10)::INT)::BIGINT AS rank_a_rank_b_top10_overlap, sum((rank_a<=20 AND rank_b<=20)::INT)::BIGINT AS rank_a_rank_b_top20_overlap"""


@query("query_shape_features", "W7", fx.sql(f"SELECT query_id, {_SHAPE} FROM rk GROUP BY 1"))
def query_shape_features(spark, d):
    r = fx.ranked(spark, d)
    s = R.query_shape_features(r, "score_b", "rank_b").join(R.topk_overlaps(r, ["rank_a", "rank_b"]), "query_id")
    return rounded(s, "std", "top10_mean", "top10_std")


@query("softmax_scores", "V12", fx.sql("""SELECT query_id, round(max(s),6) AS top, round(sum(s*s),6) AS peak FROM (SELECT query_id, e/sum(e) OVER (PARTITION BY query_id) AS s FROM (
 SELECT query_id, exp((score_b-max(score_b) OVER (PARTITION BY query_id))/2.0) AS e FROM sc)) GROUP BY 1"""))
def softmax_scores(spark, d):
    s = P.softmax_scores(fx.scored(spark, d), "score_b", 2.0)
    return s.groupBy("query_id").agg(r6(F.max("softmax")).alias("top"), r6(F.sum(F.col("softmax") * F.col("softmax"))).alias("peak"))


# --- top-k and sets ------------------------------------------------------------------------------------------

@query("nearest_negatives", "T3", fx.sql("""SELECT query_id, candidate, label FROM ft WHERE label=1 UNION ALL SELECT DISTINCT query_id, candidate, 0 FROM (SELECT p.query_id, n.candidate,
 row_number() OVER (PARTITION BY p.query_id, p.candidate ORDER BY abs(p.score_c-n.score_c), n.candidate) AS k FROM ft p JOIN ft n ON n.query_id=p.query_id AND n.label=0 WHERE p.label=1) WHERE k<=5"""))
def nearest_negatives(spark, d):
    return R.nearest_negatives(fx.featured(spark, d), "score_c", 5).select("query_id", "candidate", "label")


@query("pool_coverage", "T4", fx.sql(" UNION ALL ".join(f"SELECT {k} AS k, count(*) AS queries, round(avg(n),6) AS mean_pool, round(avg(h),6) AS possible_hit FROM (SELECT query_id, sum((least(rank_a,rank_b)<={k})::INT) AS n, max((least(rank_a,rank_b)<={k} AND label=1)::INT) AS h FROM rk GROUP BY 1 HAVING sum(label)>0)" for k in (10, 20, 50))))
def pool_coverage(spark, d):
    return rounded(U.pool_coverage(fx.ranked(spark, d), ["rank_a", "rank_b"]), "mean_pool", "possible_hit")


@query("filter_then_backfill", "T5", fx.sql("""SELECT query_id, candidate, row_number() OVER (PARTITION BY query_id ORDER BY score_b DESC, tie, candidate) AS rank FROM sc WHERE score_a<10 OR score_a>20 QUALIFY rank<=10"""))
def filter_then_backfill(spark, d):
    t = R.filter_then_backfill(fx.scored(spark, d), (F.col("score_a") >= 10) & (F.col("score_a") <= 20), "score_b", 10)
    return t.select("query_id", "candidate", "rank")


_KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("novelty_filter", "T6", fx.sql("""SELECT query_id, candidate, row_number() OVER (PARTITION BY query_id ORDER BY score_a DESC, tie, candidate) AS rank FROM sc
 WHERE split_part(candidate,':',1) <> (['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'])[substr(anchor,2)::INT % 6 + 1] QUALIFY rank<=10"""))
def novelty_filter(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), F.substring("anchor", 2, 9).cast("int") % 6 + 1)
    t = R.novelty_filter(fx.scored(spark, d), "score_a", 10, kind, F.split("candidate", ":")[0])
    return t.select("query_id", "candidate", "rank")


@query("unique_pair_table", "T7", fx.sql("""SELECT anchor, candidate, query_id, n FROM (SELECT anchor, candidate, query_id, count(*) AS n, sum(l_quantity) AS q FROM purch GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY anchor, candidate ORDER BY n DESC, q DESC, query_id DESC)=1"""))
def unique_pair_table(spark, d):
    p = fx.purchases(spark, d).groupBy("anchor", "candidate", "query_id").agg(F.count("*").alias("n"),
                                                                              F.sum("l_quantity").alias("q"))
    return R.best_row(p, ["anchor", "candidate"], ["n", "q", "query_id"], ["query_id", "n"])


@query("concat_lists", "U1", fx.sql("""SELECT method, context, count(*) AS n, count(score_b) AS n_b FROM (SELECT 'a' AS method, context, NULL AS score_b FROM rk WHERE rank_a<=5 UNION ALL SELECT 'b', context, score_b FROM rk WHERE rank_b<=10) GROUP BY ALL"""))
def concat_lists(spark, d):
    r = fx.ranked(spark, d)
    u = U.concat([r.where("rank_a <= 5").select(F.lit("a").alias("method"), "context"),
                  r.where("rank_b <= 10").select(F.lit("b").alias("method"), "context", "score_b")])
    return u.groupBy("method", "context").agg(F.count("*").alias("n"), F.count("score_b").alias("n_b"))


@query("distractors", "U2", """SELECT p_partkey, md5('7|'||p_partkey) AS place FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity>=48) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount>=0.1)""")
def distractors(spark, d):
    li = fx.table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_discount")
    key = F.col("l_partkey").alias("p_partkey")
    return U.distractors(fx.table(spark, d, "part", "p_partkey"), li.where("l_quantity >= 48").select(key),
                         li.where("l_discount >= 0.1").select(key), "p_partkey", 7)


@query("hit_quadrants", "U3", fx.sql(f"""SELECT context, k, sum((a AND b)::INT)::BIGINT AS both, sum((a AND NOT b)::INT)::BIGINT AS only_a, sum((NOT a AND b)::INT)::BIGINT AS only_b, sum((NOT a AND NOT b)::INT)::BIGINT AS neither
 FROM (SELECT context, k, min(CASE WHEN label=1 THEN rank_a END)<=k AS a, min(CASE WHEN label=1 THEN rank_b END)<=k AS b FROM rk, (VALUES (1),(5),(10)) v(k) GROUP BY query_id, context, k HAVING sum(label)>0) GROUP BY ALL"""))
def hit_quadrants(spark, d):
    w = X.wide_metrics(fx.scored(spark, d), {"a": F.col("score_a"), "b": F.col("score_b")})
    cells = w.select("context", F.explode(F.array(*[F.struct(
        F.lit(k).alias("k"), F.col(f"hit{k}_a").alias("a"), F.col(f"hit{k}_b").alias("b")) for k in (1, 5, 10)])).alias("e")
    ).select("context", "e.*")
    return M.hit_quadrants(cells, "a", "b", ["context", "k"])


@query("topk_jaccard", "U4", fx.sql("""SELECT query_id, round(sum((rank_a<=10 AND rank_b<=10)::INT)/count(*)::DOUBLE,6) AS jaccard, (sum((rank_a<=10 AND rank_b<=10)::INT)=count(*))::INT AS identical,
 (min(CASE WHEN rank_a=1 THEN candidate END)<>min(CASE WHEN rank_b=1 THEN candidate END))::INT AS top1_differs FROM rk WHERE rank_a<=10 OR rank_b<=10 GROUP BY 1"""))
def topk_jaccard(spark, d):
    r = fx.ranked(spark, d)
    side = lambda m: r.select("query_id", "candidate", F.col(f"rank_{m}").alias("rank"))
    return rounded(U.topk_jaccard(side("a"), side("b"), 10), "jaccard")


@query("mode_membership", "U5", fx.sql("""SELECT membership, count(*) AS n FROM (SELECT CASE WHEN rank_a<=10 AND rank_b<=10 THEN 'a+b' WHEN rank_a<=10 THEN 'a' ELSE 'b' END AS membership FROM rk WHERE rank_a<=10 OR rank_b<=10) GROUP BY 1"""))
def mode_membership(spark, d):
    r = fx.ranked(spark, d)
    lists = U.concat([r.where(F.col(f"rank_{m}") <= 10).select("query_id", "candidate", F.lit(m).alias("mode"))
                      for m in "ab"])
    return U.mode_membership(lists).groupBy("membership").agg(F.count("*").alias("n"))
