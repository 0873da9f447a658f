import pytest
from pyspark.sql import functions as F

from rankspark.sources import tables as TB
from rankspark.streaming import callbacks as K
from rankspark.streaming import jobs as J


def test_label_stream_resumes_without_repeats(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    counts = spark.createDataFrame([("a>>b", 10), ("b>>c", 1)], "transform string, n bigint")
    mk = lambda rows: spark.createDataFrame(rows, "pair_id string, transform string").coalesce(1)
    mk([("p1", "a>>b"), ("p2", "b>>c")]).write.parquet(src)
    schema = spark.read.parquet(src).schema
    J.label_stream(J.shard_stream(spark, src, schema), counts, out, ck)
    mk([("p3", "x>>y")]).write.mode("append").parquet(src)
    J.label_stream(J.shard_stream(spark, src, schema), counts, out, ck)
    got = sorted((r.pair_id, r.weak_label, r.confidence) for r in spark.read.parquet(out).collect())
    assert got == [("p1", 1, 0.5), ("p2", 0, 0.5), ("p3", 0, 0.5)]


def test_metrics_refuse_split_queries(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows = [("q1", "a", 1, 1.0), ("q1", "b", 0, 2.0)]
    for r in rows:
        spark.createDataFrame([r], "query_id string, candidate string, label int, s double").coalesce(1).write.mode("append").parquet(src)
    J.streaming_metrics(J.shard_stream(spark, src, spark.read.parquet(src).schema), "s", out, ck)
    # the second shard holds no positive and is skipped; force both shards to count
    spark.read.parquet(out).withColumn("batch", F.lit(7)).drop("batch").write.parquet(out + "/batch=7")
    with pytest.raises(ValueError):
        J.read_metrics(spark, out)


def test_json_shards_skip_blank_lines(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": null}\n')
    (tmp_path / "s2.jsonl").write_text('\n{"a": 3, "b": "y"}\n')
    r = TB.scan_jsonl_shards(spark, str(tmp_path / "*.jsonl"), "a int, b string").collect()
    assert sorted((x.a, x.shard) for x in r) == [(1, "s1.jsonl"), (2, "s1.jsonl"), (3, "s2.jsonl")]


def test_generator_contract(spark):
    K.register_generator("bad", lambda q: q)
    with pytest.raises(ValueError):
        K.propose_with("bad", spark.createDataFrame([("q",)], "query_id string"))
