import pytest
from pyspark.sql import functions as F

from helpers import frame, row, separable
from rankspark.operators import fusion as X
from rankspark.operators import metrics as M
from rankspark.operators import priors as P
from rankspark.operators import ranking as R
from rankspark.operators import sampling as SA
from rankspark.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_ties_do_not_depend_on_input_order(spark):
    rows = [row("q", c, y, 0.5) for c, y in (("C_POS", 1), ("C_NEG_A", 0), ("C_NEG_B", 0))]
    def order(rs):
        r = R.rank_candidates(frame(spark, rs).withColumn("s", F.lit(0.0)), "s")
        return [x.candidate for x in r.orderBy("rank").collect()]
    assert order(rows) == order(rows[::-1])


def test_metrics_closed_form(spark):
    df = spark.createDataFrame([("q", f"c{i}", y, s) for i, (y, s) in enumerate(zip([0, 1, 0, 1], [.9, .8, .7, .6]))],
                               "query_id string, candidate string, label int, score double")
    m = M.ranking_metrics(df, "score").first()
    assert (m.hit1, m.hit5, m.hit10) == (0, 1, 1)
    assert m.mrr == 0.5 and round(m.ndcg10, 6) == 0.650921
    assert m.random_hit10 == 1.0 and m.norm_hit10 is None and m.enrichment10 == 1.0


def test_queries_without_positive(spark):
    df = spark.createDataFrame([("q", "a", 0, 1.0), ("r", "a", 1, 1.0)], "query_id string, candidate string, label int, score double")
    assert M.ranking_metrics(df, "score").count() == 1
    z = {r.query_id: r for r in M.ranking_metrics(df, "score", no_positive="zero").collect()}
    assert z["q"].mrr == 0.0 and z["q"].hit10 == 0 and z["r"].mrr == 1.0
    with pytest.raises(ValueError):
        M.ranking_metrics(df, "score", no_positive="drop")


def test_grid_ranks_equal_window_ranks(spark):
    s = fx.scored(spark, SF)
    blend = F.col("score_a") * 2 + F.col("score_b")
    g = {r.query_id: r.best_rank for r in X.grid_best_ranks(s, {"x": blend}).collect()}
    w = {r.query_id: r.best_rank for r in M.ranking_metrics(s.withColumn("x", blend), "x", random=False).collect()}
    assert g == w and len(g) > 50


def test_results_do_not_depend_on_partitioning(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    def run(parts, shuffle):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        m = fx.scored(spark, SF)
        m = m.repartition(7, "candidate") if shuffle else m
        return sorted(tuple(r) for r in M.ranking_metrics(m, "score_b", random=False).collect())
    try:
        first = run(1, False)
        assert first == run(4, True) == run(16, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_nearest_negatives(spark):
    rows = [row("q1", "POS_A", 1, .70), row("q1", "NEAR_A", 0, .69), row("q1", "NEAR_B", 0, .73), row("q1", "FAR", 0, .10),
            row("q2", "POS_B", 1, .30), row("q2", "NEAR_C", 0, .31), row("q2", "FAR_B", 0, .90), row("q3", "LONE", 1, .5)]
    got = {r.candidate for r in R.nearest_negatives(frame(spark, rows), "sim", 1).collect()}
    assert got == {"POS_A", "NEAR_A", "POS_B", "NEAR_C", "LONE"}


def test_unseen_context_gets_the_full_vocabulary(spark):
    q = spark.createDataFrame([("q1", "x"), ("q2", "new")], "query_id string, context string")
    v = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "context string, candidate string")
    p = spark.createDataFrame([("q1", "a"), ("q2", "c")], "query_id string, candidate string")
    m = P.expand_candidates(q, v, p).collect()
    assert sorted((r.query_id, r.candidate, r.label) for r in m) == [
        ("q1", "a", 1), ("q1", "b", 0), ("q2", "a", 0), ("q2", "b", 0), ("q2", "c", 1)]


def test_large_vocabulary_takes_the_salted_join(spark):
    pos = fx.train_positives(spark, SF)
    args = (fx.query_table(spark, SF), P.train_vocab(pos), fx.test_positives(spark, SF))
    want = sorted(tuple(r) for r in P.expand_candidates(*args).collect())
    got = P.expand_candidates(*args, max_vocab=10)
    assert sorted(tuple(r) for r in got.select("query_id", "anchor", "context", "candidate", "label").collect()) == want


def test_ranking_needs_no_exchange_of_the_matrix(spark):
    plan = fx.ranked(spark, SF)._jdf.queryExecution().executedPlan().toString()
    between = plan[plan.index("Window"):plan.index("BroadcastHashJoin")]
    assert "Exchange" not in between


def test_borda_universe(spark):
    l = spark.createDataFrame([("q", "x", 1, "a", 1), ("q", "y", 0, "a", 2), ("q", "z", 0, "b", 1), ("q", "x", 1, "b", 2)],
                              "query_id string, candidate string, label int, method string, rank int")
    u = {r.candidate: r.score for r in X.borda(l, 10).collect()}
    assert u == {"x": 19.0, "y": 9.0, "z": 10.0}
    assert {r.candidate for r in X.borda(l, 10, "left", "a").collect()} == {"x", "y"}


def test_pos_neg_pairs_are_mirrored_and_bounded(spark):
    p = SA.pos_neg_pairs(separable(spark), ["sim"], 3, 1)
    per = p.groupBy("query_id", "label").count().collect()
    assert all(r["count"] == 3 for r in per) and len(per) == 48
    assert p.agg(F.sum(F.col("diff")[0])).first()[0] == pytest.approx(0.0)


def test_md5_permutation_keeps_positives(spark):
    from rankspark.operators.stats import permute_within_query
    s = separable(spark)
    p = permute_within_query(s, 5)
    assert p.groupBy("query_id").agg(F.sum("label").alias("p")).where("p != 1").count() == 0
    assert p.where("label = 1").join(s.where("label = 1"), ["query_id", "candidate"]).count() < 24


def test_pairs_of_a_table_by_query_move_no_row(spark):
    rows = [row(f"q{q}", f"c{c}", int(c < q), 0.1 * c) for q in range(4) for c in range(9)]
    m = frame(spark, rows).repartition(4, "query_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = SA.pos_neg_pairs(m, ["sim"], 7, 1)
        assert "ENSURE_REQUIREMENTS" not in p._jdf.queryExecution().executedPlan().toString()
        got = p.where("label = 1").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    n = {q: sum(r.query_id == q for r in got) for q in ("q0", "q1", "q2", "q3")}
    assert n == {"q0": 0, "q1": 7, "q2": 7, "q3": 7} and len({(r.query_id, r.candidate, r.negative) for r in got}) == 21
    assert all(abs(r.diff[0] - 0.1 * (int(r.candidate[1:]) - int(r.negative[1:]))) < 1e-9 for r in got)


def test_nearest_negatives_equals_all_pairs_and_moves_nothing(spark):
    """Ties in score and gap, positives without negatives, fewer negatives than asked for; rows that lie by query stay there."""
    import random
    r = random.Random(2)
    rows = [(f"q{q}", f"c{i}", float(r.randint(0, 12)), int(r.random() < 0.2)) for q in range(30) for i in range(r.randint(1, 25))]
    want = set()
    for q, c, s, y in rows:
        if y:
            near = sorted((abs(s - t), d) for p, d, t, z in rows if p == q and not z)[:3]
            want |= {(q, c, 1)} | {(q, d, 0) for _, d in near}
    df = spark.createDataFrame(rows, "query_id string, candidate string, sim double, label int").repartition(3, "query_id")
    got = R.nearest_negatives(df, "sim", 3)
    assert sorted((x.query_id, x.candidate, x.label) for x in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan and "ENSURE_REQUIREMENTS" not in plan
