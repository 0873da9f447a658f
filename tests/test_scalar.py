import hashlib
import math

from pyspark.sql import functions as F

from rankspark.functions import bits as B
from rankspark.functions import hashing as H
from rankspark.functions import scalar as S
from rankspark.operators import filters as FL
from rankspark.operators import quantiles as Q
from rankspark.operators.ranking import global_row_number, md5_bucket_row_number


def test_censored_values(spark):
    texts = [" 100 ", "< 1000", ">1000", "", "n/a", "~5", "1,500", "<=2e1", "-3", "0", "abc", None]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = [tuple(r.m) if r.m else None for r in df.select(S.parse_censored("raw").alias("m")).collect()]
    assert got == [("=", 100.0), ("<", 1000.0), (">", 1000.0), None, None, ("=", 5.0), ("=", 1500.0), ("<=", 20.0),
                   None, None, None, None]
    assert df.select(S.p_activity(F.lit(100.0))).first()[0] == 7.0


def test_only_certain_actives_survive(spark):
    df = spark.createDataFrame([(1, "100", ">1000", "<500", "")], "id int, ki string, ic string, kd string, ec string")
    m = FL.active_measurements(df, ["id"], {"Ki": "ki", "IC50": "ic", "Kd": "kd", "EC50": "ec"}).collect()
    assert sorted(r.endpoint for r in m) == ["Kd", "Ki"]
    assert {r.endpoint: r.relation for r in m}["Kd"] == "<"
    assert abs({r.endpoint: r.pactivity for r in m}["Ki"] - 7.0) < 1e-12


def test_parse_list_trims_and_drops_blanks(spark):
    df = spark.createDataFrame([(" a || b |",), (None,)], "x string")
    assert [r[0] for r in df.select(S.parse_list("x")).collect()] == [["a", "b"], []]


def test_coalesced_key_and_fallback(spark):
    df = spark.createDataFrame([("P1", None, "P1", "Q2"), (None, " ", None, None)], "a string, b string, c string, d string")
    k = [r[0] for r in df.select(S.coalesced_key([("a", "b"), ("c", "d"), ("b", "d")], F.lit("name "), F.lit("org"))).collect()]
    assert k[0] == "P1|Q2"
    assert k[1] == "name:" + hashlib.md5(b"name|org").hexdigest()[:24]


def test_md5_mod10_is_the_whole_hash(spark):
    keys = [str(i) for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(H.md5_mod10("k")).collect()]
    assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 10 for k in keys]


def test_buckets_follow_train_edges(spark):
    df = spark.createDataFrame([(0.1 * i,) for i in range(10)], "x double")
    e = Q.quantile_edges(df, "x", 5)
    b = df.withColumn("e", e.scalar()).select(S.assign_bucket("x", "e").alias("b"))
    assert b.distinct().count() == 5
    one = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert {r[0] for r in one.withColumn("e", Q.quantile_edges(one, "x", 5).scalar()).select(S.assign_bucket("x", "e")).collect()} == {0}


def test_random_hit_closed_form(spark):
    df = spark.createDataFrame([(20, 3, 5), (4, 2, 10), (10, 0, 5), (150, 7, 10)], "n int, p int, k int")
    for n, p, k in [(20, 3, 5), (4, 2, 10), (10, 0, 5), (150, 7, 10)]:
        got = df.where(f"n = {n}").select(S.random_hit("n", "p", k)).first()[0]
        kk = min(k, n)
        want = 0.0 if p == 0 else 1.0 if kk > n - p else 1 - math.comb(n - p, kk) / math.comb(n, kk)
        assert abs(got - want) < 1e-12


def test_first_match_takes_the_first_rule_that_holds(spark):
    df = spark.createDataFrame([(None, True), (1, True), (2, False), (5, None)], "x int, y boolean")
    rule = S.first_match({"one": F.col("x") == 1, "small": F.col("x") < 3, "yes": F.col("y")}, "other")
    assert [r[0] for r in df.select(rule).collect()] == ["yes", "one", "small", "other"]


def test_exact_quantiles_and_ranks_against_pandas(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    vals = [5.0] * 400 + rng.normal(size=800).round(2).tolist()  # a third of the rows share one value
    df = spark.createDataFrame([(i, float(v), i % 3) for i, v in enumerate(vals)], "id int, v double, g int")
    got = Q.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.93, 1.0]).first()
    assert np.allclose(list(got), np.quantile(vals, [0.0, 0.1, 0.5, 0.93, 1.0]))
    by = {r.g: r.q0 for r in Q.exact_quantiles(df, "v", [0.25], ["g"]).collect()}
    for g in range(3):
        assert abs(by[g] - np.quantile([v for i, v in enumerate(vals) if i % 3 == g], 0.25)) < 1e-12
    n = global_row_number(df, "v", H.hash_order("t", "id"), "rn", buckets=16).collect()
    order = sorted(n, key=lambda r: (r.v, hashlib.md5(f"t|{r.id}".encode()).hexdigest()))
    assert [r.rn for r in order] == list(range(1, len(vals) + 1))
    m = md5_bucket_row_number(df, "s", ["id"], "rn", within=["g"]).where("g = 1").collect()
    order = sorted(m, key=lambda r: hashlib.md5(f"s|{r.id}".encode()).hexdigest())
    assert [r.rn for r in order] == list(range(1, len(m) + 1))


def test_shingles_and_similarity(spark):
    df = spark.createDataFrame([("a b c d", "b c d e"), ("one", "one")], "x string, y string")
    s = df.select(B.word_shingles("x", 2).alias("s")).collect()
    assert s[0].s == ["a b", "b c", "c d"] and s[1].s == ["one"]
    t = df.select(B.tanimoto(B.fingerprint(B.word_shingles("x", 2), 1 << 20), B.fingerprint(B.word_shingles("y", 2), 1 << 20))).collect()
    assert [round(r[0], 6) for r in t] == [0.5, 1.0]
