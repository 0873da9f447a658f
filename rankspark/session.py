"""Session settings the library relies on."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the cluster names. Only a local session may do without and gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and read it back, so lost executors do not replay its history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 500_000


def broadcast_when_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """(table, small): the table is written once and counted; only below ``max_rows`` it carries a broadcast hint.

    Beyond the bound the caller takes its shuffled way.
    """
    from pyspark.sql import functions as F
    t = cut_lineage(df)
    small = t.count() <= max_rows
    return (F.broadcast(t) if small else t), small


def local_session(cores: str | int = 8, memory: str = "20g", shuffle: int = 8, app: str = "rankspark") -> SparkSession:
    """Local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
