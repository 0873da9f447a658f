"""Contract checks, profiles and manifests of input tables."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankspark.schema import flag, require_columns


def matrix_violations(df: DataFrame, query="query_id", candidate="candidate", label="label",
                      required: Sequence[str] = ("query_id", "anchor", "candidate", "label")) -> DataFrame:
    """Counts of broken rules: bad labels, null keys, repeated (query, candidate)."""
    require_columns(df, required)
    lab = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    per = df.groupBy(query, candidate).agg(
        F.count("*").alias("_n"), F.sum(flag(~lab)).alias("_bad"))
    one = per.agg(F.sum("_bad").cast("bigint").alias("bad_label"),
                  F.sum(F.when(F.col(query).isNull() | F.col(candidate).isNull(), F.col("_n")).otherwise(0))
                  .cast("bigint").alias("null_key"),
                  F.sum(flag(F.col("_n") > 1)).cast("bigint").alias("duplicate_pair"))
    return one.unpivot([], ["bad_label", "null_key", "duplicate_pair"], "check", "violations")


def validate_matrix(df: DataFrame, name: str = "matrix", **kw) -> DataFrame:
    """Raise when any rule is broken, else the matrix with a default dataset column."""
    bad = matrix_violations(df, **kw).where("violations > 0").collect()
    if bad:
        raise ValueError(f"{name}: " + ", ".join(f"{r['check']}={r['violations']}" for r in bad))
    return df if "dataset" in df.columns else df.withColumn("dataset", F.lit(name))


def profile_sources(df: DataFrame, source: str, key) -> DataFrame:
    """Per source rows, unique keys, repeats, and how many keys another source also has."""
    per = df.groupBy(F.col(source).alias("source"), F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    spread = per.groupBy("_k").agg(F.count("*").alias("_m"))
    j = per.join(spread, "_k")
    return j.groupBy("source").agg(
        F.sum("_n").alias("rows"), F.count("*").alias("unique_keys"),
        (F.sum("_n") - F.count("*")).alias("repeated_rows"),
        F.sum(flag(F.col("_m") > 1)).cast("bigint").alias("shared_keys")).withColumn(
        "shared_ratio", F.col("shared_keys") / F.col("unique_keys"))


def column_availability(df: DataFrame, columns: Sequence[str], evidence: Sequence[str]) -> DataFrame:
    """Filled cells per column and the verdict: PARTIAL when any evidence column is filled."""
    filled = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    one = df.agg(F.count("*").alias("rows"), *[F.sum(flag(filled(c))).cast("bigint").alias(c) for c in columns])
    verdict = F.when(sum((F.col(c) for c in evidence), F.lit(0)) > 0, "PARTIAL").otherwise("STRUCTURE_ONLY")
    return one.withColumn("verdict", verdict).unpivot(
        ["rows", "verdict"], list(columns), "column", "filled")


def dataset_stats(df: DataFrame, split="split", query="query_id", candidate="candidate", anchor="anchor",
                  context="context", label="label") -> DataFrame:
    """Size figures per split, from one aggregate per query and one per distinct key."""
    per = df.groupBy(split, query).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    q = per.groupBy(split).agg(
        F.sum("n").alias("rows"), F.count("*").alias("queries"), F.sum("p").cast("bigint").alias("positives"),
        F.min("n").alias("min_candidates"), F.percentile("n", 0.5).alias("median_candidates"),
        F.max("n").alias("max_candidates"), F.min("p").cast("bigint").alias("min_positives"),
        F.percentile("p", 0.5).alias("median_positives"), F.max("p").cast("bigint").alias("max_positives"),
        F.sum(flag(F.col("p") == 1)).cast("bigint").alias("single_positive"),
        F.sum(flag(F.col("p") > 1)).cast("bigint").alias("multi_positive"))
    keys = df.groupBy(split).agg(
        F.countDistinct(candidate).alias("candidates"), F.countDistinct(anchor).alias("anchors"),
        F.countDistinct(context).alias("contexts"), F.countDistinct(anchor, context).alias("anchor_contexts"))
    return q.join(keys, split)


def source_manifest(spark: SparkSession, path: str, expected: DataFrame | None = None,
                    chunk: int = 8 << 20) -> DataFrame:
    """Bytes and md5 of every file. Content is read in chunks, one file per task, never held whole."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", "length"))
    n = max(1, min(files.rdd.getNumPartitions() * 4, 1000))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        from pyarrow import fs
        for b in batches:
            sums = []
            for uri in b["path"]:
                filesystem, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1)
                                                          if uri.startswith("file:/") and not uri.startswith("file:///")
                                                          else uri)
                h = hashlib.md5()
                with filesystem.open_input_stream(name) as stream:
                    while block := stream.read(chunk):
                        h.update(block)
                sums.append(h.hexdigest())
            yield b.assign(md5=sums)

    out = files.repartition(n, "path").mapInPandas(digest, "path string, length bigint, md5 string")
    out = out.withColumn("file", F.element_at(F.split("path", "/"), -1)).drop("path")
    if expected is not None:
        out = out.join(expected.select("file", F.col("md5").alias("expected_md5")), "file", "left").withColumn(
            "matches", F.col("md5") == F.col("expected_md5"))
    return out


def schema_flags(spark: SparkSession, path: str, roles: dict[str, list[str]], flags: dict[str, list[str]]) -> DataFrame:
    """One row per file with its columns, a role by required columns, and has_* flags.

    Only footers are read: the distinct schemas of a folder, not its rows.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
             .load(path).select("path", "length"))

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        for b in batches:
            rows = []
            for uri in b["path"]:
                if uri.startswith("file:/") and not uri.startswith("file:///"):
                    uri = uri.replace("file:/", "file:///", 1)
                filesystem, name = fs.FileSystem.from_uri(uri)
                rows.append(list(pq.read_schema(name, filesystem=filesystem).names))
            yield pd.DataFrame({"file": [u.rsplit("/", 1)[-1] for u in b["path"]], "columns": rows})

    t = files.mapInPandas(footers, "file string, columns array<string>")
    role = F.lit("unknown")
    for name, need in reversed(list(roles.items())):
        has = F.lit(True)
        for c in need:
            has = has & F.array_contains("columns", c)
        role = F.when(has, name).otherwise(role)
    for name, any_of in flags.items():
        t = t.withColumn(f"has_{name}", F.arrays_overlap("columns", F.array(*[F.lit(c) for c in any_of])))
    return t.withColumn("role", role)
