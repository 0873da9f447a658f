"""Structured Streaming jobs over shard files. Progress, restart and exactly-once output come from Spark's checkpoint."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rankspark.operators.metrics import ranking_metrics
from rankspark.operators.sampling import weak_labels


def shard_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def _drain(q: StreamingQuery) -> StreamingQuery:
    q.awaitTermination()
    return q


def label_stream(pairs: DataFrame, counts: DataFrame, out: str, checkpoint: str, recurrent: int = 5) -> StreamingQuery:
    """Weak labels for arriving pair shards (stream-static join); each shard lands in the output once."""
    lab = weak_labels(pairs, counts, recurrent)
    return _drain(lab.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                  .outputMode("append").trigger(availableNow=True).start())


def stream_with_dead_letters(df: DataFrame, valid, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Rows that break the rule go to a side table. A batch is written under its id, so a replay overwrites itself."""
    ok = F.coalesce(valid, F.lit(False))

    def write(batch: DataFrame, batch_id: int) -> None:
        for cond, path in ((ok, good), (~ok, bad)):
            batch.where(cond).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _drain(df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def upsert_counts(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running aggregate in update mode; each batch writes the changed groups under its id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _drain(counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, out: str, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Newest value per key of an update stream."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def running_counts(events: DataFrame, time: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Z3: events per window and kind; the watermark bounds the state."""
    return (events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("start"), kind, "n"))


def streaming_frequency(positives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frequency table accumulated shard by shard."""
    return positives.groupBy(*keys).agg(F.count("*").alias("n"))


def streaming_metrics(frame: DataFrame, score: str, out: str, checkpoint: str, carry: Sequence[str] = ()) -> StreamingQuery:
    """Rank and evaluate each batch. A query's rows must arrive in one file; :func:`read_metrics` checks it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        ranking_metrics(batch, score, carry=carry, random=False).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _drain(frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def read_metrics(spark: SparkSession, out: str, query: str = "query_id") -> DataFrame:
    m = spark.read.parquet(out)
    split = m.groupBy(query).agg(F.count("*").alias("n")).where("n > 1")
    if not split.isEmpty():
        raise ValueError("a query is spread over several batches: write whole queries per file")
    return m.drop("batch")
