"""Keyed permutations and the null of permuted prior edges."""
import pytest
from pyspark.sql import functions as F

from rankspark.operators import stats as ST


@pytest.mark.parametrize("n", [1, 2, 7, 50, 997])
def test_every_key_permutes_all_places(spark, n):
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"))
    got = {}
    for r in ST.permuted(rows, "i", "k", n, "to").collect():
        got.setdefault(r.k, {})[r.i] = r.to
    assert all(sorted(p.values()) == list(range(n)) for p in got.values()) and len(got) == 8
    if n > 10:
        assert len({tuple(sorted(p.items())) for p in got.values()}) == 8


def test_sides_leave_few_places_over():
    assert all(a * b >= n and a * b - n <= n ** 0.5 for n in range(1, 3000) for a, b in [ST.permutation_sides(n)])


def test_null_of_permuted_edges_has_the_mean_of_all_permutations(spark):
    """Every edge meets every target with equal frequency: the null mean is the product of the means."""
    n = 60
    edges = spark.createDataFrame([(f"t{i % 6}", f"c{i}", float(i)) for i in range(n)], "template string, candidate string, weight double")
    s = ST.shuffled_edges(edges, 600, 5)
    assert s.count() == 600 * n
    per = s.groupBy("replicate").agg(F.countDistinct("candidate").alias("c"), F.sum("weight").alias("w"))
    assert per.where(f"c <> {n} or abs(w - {sum(range(n))}) > 1e-9").isEmpty()
    mean = s.where("candidate = 'c7'").agg(F.avg("weight")).first()[0]
    assert abs(mean - (n - 1) / 2) < 3  # standard error 0.7
    assert ST.shuffled_edges(edges.limit(0), 5, 1).count() == 0
