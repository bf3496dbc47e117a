"""Publish desired artifacts into a catalog table, changed parts only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import publish
from ..operators.ledger import DEFAULT_POLICY
from ..session import written
from ..sources import tables


def publish_artifacts(
    spark: SparkSession,
    table: str,
    desired: DataFrame,
    prunable: str = DEFAULT_POLICY.checkpoints_dir,
) -> DataFrame:
    """Bring ``table`` (grp, entry, payload, partition columns) to the desired artifacts.

    Returns the changed entries, sorted; with none nothing is written. Partition
    columns must follow from the group and be columns of ``desired`` too. Only
    partitions with a change are read in full and rewritten.
    """
    stored = spark.table(table)
    parts = tables.partition_columns(spark, table)
    # Both the delta and what it writes read the desired rows: they are computed once.
    desired = written(desired.select(*stored.columns), "desired")
    delta = written(publish.publish_delta(desired, stored, prunable, extra=parts), "delta")
    changed = delta.where(F.col("action") != "keep")
    if changed.isEmpty():
        return publish.apply_result(delta)
    if not parts:
        tables.replace_content(spark, table, publish.apply_delta(desired, stored, delta))
        return publish.apply_result(delta)
    near = [tables.in_touched_partitions(df, changed, parts) for df in (desired, stored)]
    content = publish.apply_delta(*near, delta)
    # A partition that loses its last row is emptied like any other touched one.
    tables.switch(spark, [tables.stage_partitions(spark, table, content, changed)])
    return publish.apply_result(delta)
