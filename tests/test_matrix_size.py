"""The long matrix is expanded in bounded parts and is neither written nor moved."""
import numpy as np
from pyspark.sql import functions as F

from rankspark.operators import models, priors, ranking, splits
from rankspark.plans import fixtures as fx, scalar_queries

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_matrix(spark):
    q = spark.range(40).select(F.concat(F.lit("q"), "id").alias("query_id"), F.lit("x").alias("context"))
    vocab = spark.range(10).select(F.lit("x").alias("context"), F.concat(F.lit("c"), "id").alias("candidate"))
    pos = q.select("query_id", F.lit("c3").alias("candidate"))
    m = priors.expand_candidates(q, vocab, pos, cells=20)
    assert m.rdd.getNumPartitions() >= 20
    per = m.withColumn("part", F.spark_partition_id()).groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum("label").alias("p"), F.countDistinct("part").alias("parts")).collect()
    assert len(per) == 40 and {(r.n, r.p, r.parts) for r in per} == {(10, 1, 1)}
    one = ranking.rank_candidates(m.withColumn("s", F.lit(1.0)), "s", "r")
    assert plan(one).count("Exchange hashpartitioning") == 1  # that of the queries


def test_profile_joins_before_expansion(spark):
    """One exchange of the written queries is all that a pass over the featured matrix moves."""
    p = plan(fx.featured(spark, SMALL))
    assert p.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in p


def test_sides_and_flags_are_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = spark.range(20).select(F.concat(F.lit("q"), "id").alias("query_id"), F.concat(F.lit("n"), F.col("id") % 4).alias("anchor"),
                                   F.lit(1).alias("label"))
        assert "SortMergeJoin" not in plan(splits.group_split(m, "anchor"))
        flagged = m.withColumn("candidate", F.lit("PROMO:1")).join(scalar_queries.candidate_flags(spark, SMALL), "candidate")
        assert "SortMergeJoin" not in plan(flagged)
        assert "SortMergeJoin" not in plan(priors.freq_score(m.withColumn("candidate", F.lit("a")), m.withColumn("candidate", F.lit("a"))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(spark, n=400):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 2))
    y = (r.random(n) < 1 / (1 + np.exp(-(3 * x[:, 0] - x[:, 1] - 2)))).astype(int)
    return spark.createDataFrame([(f"q{i % 40}", float(a), float(b), int(c), float(1 + i % 3)) for i, ((a, b), c) in enumerate(zip(x, y))],
                                 "query_id string, a double, b double, label int, w double")


def test_logistic_is_at_its_optimum(spark):
    t = rows(spark)
    for weight in (None, "w"):
        m = models.fit_logistic(t, ["a", "b"], c=0.5, weight=weight)
        p = t.toPandas()
        z = np.column_stack([(p.a - m.scaler.mean[0]) / m.scaler.std[0], (p.b - m.scaler.mean[1]) / m.scaler.std[1], np.ones(len(p))])
        b = np.array([*m.coef, m.intercept])
        w = p.w if weight else np.ones(len(p))
        slope = z.T @ (w * (1 / (1 + np.exp(-z @ b)) - p.label)) + 2.0 * np.array([*m.coef, 0.0])
        assert np.abs(slope).max() < 1e-5


def test_logistic_of_one_class_and_separable_rows(spark):
    t = rows(spark)
    assert models.fit_logistic(t.withColumn("label", F.lit(1)), ["a", "b"]).intercept == float("inf")
    assert models.fit_logistic(t.withColumn("label", F.lit(0)), ["a"]).coef == [0.0]
    m = models.fit_logistic(t.withColumn("label", (F.col("a") > 1.5).cast("int")), ["a", "b"], c=100.0)
    assert np.isfinite(m.coef).all() and m.coef[0] > 1


def test_oof_rows_stay_where_they_are(spark):
    t = rows(spark)
    s = models.oof_scores(t, "query_id", 3, ["a", "b"])
    assert "Union" not in plan(s)
    got = s.collect()
    assert len(got) == 400
    m = models.fit_logistic(s.where("fold != 1").drop("score_oof"), ["a", "b"])
    for r in got:
        if r.fold == 1:
            z = sum(c * (v - mu) / sd for c, v, mu, sd in zip(m.coef, (r.a, r.b), m.scaler.mean, m.scaler.std)) + m.intercept
            assert abs(z - r.score_oof) < 1e-9
