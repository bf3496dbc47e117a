"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "ledgerkeel") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    warehouse = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", warehouse)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder the session names.

    All folders of an application lie below one of its own, so its owner can
    remove that folder once the application and readers of its results are done.
    Only a local session without that setting falls back to a machine-local
    folder: on a cluster such a folder would be lost with its executor.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder all executors share.")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    application = spark.conf.get("spark.app.id", "session")
    return f"{base.rstrip('/')}/ledgerkeel/{application}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage by writing the rows once to the shared folder.

    Parquet keeps later reads column-pruned, and the rows (with any partition
    ids computed from a sampled range split) stay the same when a task reruns.
    Zstandard, since hex digests, which have no repeats, shrink to half by their alphabet only.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
