"""Quantiles without a shuffle of the values; streams in batches of bounded size."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.operators import quantiles as Q
from rankspark.plans import model_queries


@pytest.mark.parametrize("accuracy", [50, 10000])
def test_narrowed_quantiles_are_exact(spark, accuracy):
    r = np.random.default_rng(1)
    t = spark.createDataFrame([("a", float(x)) for x in r.normal(size=3000)] + [("b", float(x)) for x in r.integers(0, 4, 999)]
                              + [("c", 1.0), ("c", 3.0), ("d", None)], "g string, v double").repartition(5)
    probs = [0.9, 0.0, 0.1, 0.25, 0.5, 1.0]
    got = {x.g: list(x)[1:] for x in Q.narrowed_quantiles(t, "v", probs, ["g"], accuracy=accuracy).collect()}
    p = t.toPandas().dropna()
    assert set(got) == {"a", "b", "c"}
    for g, v in got.items():
        assert np.allclose(v, np.quantile(p[p.g == g].v, probs), atol=1e-12)
    assert np.allclose(list(Q.narrowed_quantiles(t, "v", probs, accuracy=accuracy).first()), np.quantile(p.v, probs), atol=1e-12)


def test_few_values_of_a_column_are_counted(spark, monkeypatch):
    counted = []
    plain = Q._at_positions
    monkeypatch.setattr(Q, "_at_positions", lambda vc, *a: counted.append(vc.count()) or plain(vc, *a))
    t = spark.range(20000).select(F.lit(1).alias("label"), F.rand(3).alias("v"))
    Q.distribution_by_label(t, ["v"]).collect()
    assert len(counted) == 1 and counted[0] < 1000  # before: 20,000


def test_stream_files_are_parts_of_whole_queries(spark, monkeypatch):
    seen = []
    real = model_queries.J.shard_stream
    monkeypatch.setattr(model_queries.J, "shard_stream", lambda s, src, schema, n=1: seen.append((src, n)) or real(s, src, schema, n))
    m = model_queries.streaming_metrics(spark, "/root/testdata/sf0.001")
    assert m.count() == m.select("query_id").distinct().count() > 0
    src, n = seen[0]
    files = spark.read.parquet(src).withColumn("f", F.input_file_name()).groupBy("query_id").agg(F.countDistinct("f").alias("n"))
    assert files.where("n > 1").isEmpty() and 1 <= n <= 64
