import pytest
from pyspark.sql import functions as F

from helpers import frame, row
from rankspark.operators import splits as L
from rankspark.sources import audit as A
from rankspark.sources import tables as TB


def _values(df, column, where="true"):
    return {r[0] for r in df.where(where).select(column).distinct().collect()}


def _matrix(spark, n=8):
    rows = []
    for i in range(n):
        rows += [row(f"q{i}", f"C_{i}", 1, .8, context=f"core_{i}"), row(f"q{i}", f"NEG_{i}", 0, .2, context=f"core_{i}"),
                 row(f"q{i}", f"SHARED_{i % 3}", 0, .1, context=f"core_{i}")]
    return frame(spark, rows)


def test_value_heldout_is_disjoint(spark):
    tr, te = L.value_heldout_split(_matrix(spark), "candidate", 0.5, 7, exclude_test_queries=True)
    a, b = _values(tr, "candidate", "label = 1"), _values(te, "candidate", "label = 1")
    assert a and b and not a & b
    assert not _values(tr, "query_id") & _values(te, "query_id")
    assert L.split_report(tr, te, "candidate").first().positive_value_overlap == 0


def test_core_heldout_is_disjoint(spark):
    tr, te = L.value_heldout_split(_matrix(spark), "context", 0.5, 11)
    assert not _values(tr, "context") & _values(te, "context")
    assert tr.select("label").distinct().count() == 2 and te.where("label = 1").count() > 0


def test_strict_removes_every_shared_value(spark):
    tr, te = L.value_heldout_split(_matrix(spark), "candidate", 0.5, 7, exclude_test_queries=True, strict=True)
    r = L.split_report(tr, te, "candidate").first()
    assert r.value_overlap == 0 and r.positive_value_overlap == 0 and r.query_overlap == 0


def test_nonheldout_positives_are_dropped_not_relabelled(spark):
    rows = [row("q1", "A", 1, .5), row("q1", "B", 1, .5), row("q2", "B", 1, .5), row("q3", "C", 1, .5), row("q1", "N", 0, .1)]
    df = frame(spark, rows)
    from rankspark.operators.filters import drop_nonheldout_positives
    out = drop_nonheldout_positives(df.where("query_id = 'q1'"), spark.createDataFrame([("A",)], "candidate string"), "candidate")
    assert sorted((r.candidate, r.label) for r in out.collect()) == [("A", 1), ("N", 0)]


def test_inner_folds_cover_all_positives(spark):
    folds = L.inner_folds(_matrix(spark, 12), "candidate", 3, exclude_queries=True)
    seen = set()
    for tr, va in folds:
        v = _values(va, "candidate", "label = 1")
        assert not v & _values(tr, "candidate")
        assert not seen & v
        seen |= v
    assert seen == {f"C_{i}" for i in range(12)}


def test_random_rows_leak_but_sizes_are_exact(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 10)
    s = {r.split: r["count"] for r in L.random_row_split(df, ["id"], 3).groupBy("split").count().collect()}
    assert s == {"train": 800, "val": 100, "test": 100}
    a = L.leakage_audit(L.random_row_split(df, ["id"], 3), "split", ["g", "id"]).collect()
    assert {r.key: r.verdict for r in a} == {"g": "FAIL", "id": "PASS"}


def test_validate_matrix_raises(spark):
    good = frame(spark, [row("q", "a", 1, .5)])
    assert "dataset" in A.validate_matrix(good).columns
    with pytest.raises(ValueError, match="duplicate_pair=1"):
        A.validate_matrix(frame(spark, [row("q", "a", 1, .5), row("q", "a", 0, .5)]))
    with pytest.raises(ValueError, match="bad_label=1"):
        A.validate_matrix(frame(spark, [row("q", "a", 2, .5)]))
    with pytest.raises(ValueError, match="missing columns"):
        A.validate_matrix(good.drop("label"))


def test_unknown_suffix_is_an_error(spark):
    with pytest.raises(ValueError):
        TB.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        TB.write_table(spark.range(1), "/tmp/x.feather")


def test_manifest_matches_md5(spark, tmp_path):
    import hashlib
    (tmp_path / "a.bin").write_bytes(b"x" * 1000)
    (tmp_path / "b.bin").write_bytes(b"y")
    m = {r.file: (r.length, r.md5) for r in A.source_manifest(spark, str(tmp_path), chunk=64).collect()}
    assert m == {"a.bin": (1000, hashlib.md5(b"x" * 1000).hexdigest()), "b.bin": (1, hashlib.md5(b"y").hexdigest())}


def test_shards_cut_only_keys_above_the_bound(spark, tmp_path):
    from pyspark.sql import functions as F
    from rankspark.sources import tables as TB
    rows = [("hot", i) for i in range(1000)] + [(f"k{i % 40}", i) for i in range(400)] + [(None, i) for i in range(5)]
    TB.write_sharded(spark.createDataFrame(rows, "k string, v int"), str(tmp_path / "s"), "k", rows_per_shard=100, buckets=16)
    back = spark.read.parquet(str(tmp_path / "s")).withColumn("f", F.col("_metadata.file_path"))
    per = {r.k: (r.n, r.files) for r in back.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct(F.regexp_extract("f", "part-([0-9]+)", 1)).alias("files")).collect()}
    assert per.pop("hot")[0] == 1000 and per.pop(None) == (5, 1)
    assert all(v == (10, 1) for v in per.values()) and len(per) == 40
    assert back.groupBy("f").count().agg(F.max("count")).first()[0] <= 100


def test_flagged_split_writes_values_only(spark, monkeypatch):
    """The matrix itself is not written: its rows come anew from what it is made of."""
    written, real = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    rows = [(f"q{i % 4}", f"c{i}", int(i % 3 == 0)) for i in range(24)]
    df = spark.createDataFrame(rows, "query_id string, candidate string, label int")
    got = L.flagged_split(df, "candidate", seed=1)
    assert got.count() == 24 and written and all("query_id" not in c for c in written)
