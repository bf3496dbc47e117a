"""Payload files keyed by relative path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as Spark writes it in front of the paths it has found."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(path).toString()


def payload_scan(spark: SparkSession, root: str, prefix: str = "", pattern: str = "*.sql") -> DataFrame:
    """All files below ``root``: DataFrame[entry, payload binary].

    The entry is the path below ``root``, put under ``prefix`` when given.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    below = F.substring("path", F.lit(len(_qualified(spark, root)) + 2), F.length("path"))
    entry = F.concat(F.lit(f"{prefix}/"), below) if prefix else below
    return files.select(entry.alias("entry"), F.col("content").alias("payload"))
