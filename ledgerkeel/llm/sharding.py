"""Contiguous shards of near equal bytes from prefix sums of per-partition totals.

Rows are range-partitioned by document order once and written with their running
position inside the partition. The totals of the partitions (one row each) give
every partition its global offset; offset plus running sum is the global prefix
sum, and a row belongs to the shard in whose equal share of all bytes its middle
lies. Rows are shuffled once, nothing else is; a partition streams through one
counter, so no partition or shard has to fit into memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, held, row_hash, whole, written

LAW = "bytes"
#: Bytes counted for every row besides its text.
ROW_BYTES = 16


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows before each row of the partition."""
    size = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(batch.schema.get_field_index("size"))
        ends = pc.add(pc.cumulative_sum(own), size)
        before = pc.subtract(ends, own)
        place = pa.array(range(rows, rows + batch.num_rows), pa.int64())
        size, rows = ends[-1].as_py(), rows + batch.num_rows
        names = [*batch.schema.names, "before", "place"]
        yield pa.RecordBatch.from_arrays([*batch.columns, before, place], names=names)


def shard(docs: DataFrame, shards: int = 40, *, size: Column | None = None) -> DataFrame:
    """Rows (doc, size, shard, slot): ``doc`` holds every column of the input.

    Order: doc_id (null last), then a hash of all columns. Rows equal in everything
    count one by one, so copies spread like any other rows. Null text: no bytes, so
    ``ROW_BYTES``. A document larger than a share takes its shard whole and may leave
    a shard empty. Empty input: no rows. ``slot`` is gapless from 0 in each shard.
    """
    if shards < 1:
        raise ValueError("There must be one shard at least.")
    rows = whole(docs)
    text = held(rows, "text")
    size = byte_size(text) if size is None else size
    doc_id = held(rows, "doc_id")
    keyed = rows.select(
        "doc",
        size.alias("size"),
        doc_id.isNull().alias("last"),
        doc_id.alias("id"),
        row_hash(rows).alias("tie"),
        F.monotonically_increasing_id().alias("copy"),
    )
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["last", "id", "tie", "copy"]
    ranged = (
        keyed.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("doc", "size", F.spark_partition_id().alias("part"))
    )
    schema = T.StructType([*ranged.schema.fields]).add("before", "long").add("place", "long")
    placed = written(ranged.mapInArrow(_running, schema), "shard-rows")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = written(
        totals.select(
            "part",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(everything).alias("total"),
        ),
        "shard-offsets",
    )
    middle = F.col("bytes_before") + F.col("before") + F.col("size") / 2
    place = placed.join(bounded(offsets, n), "part").select(
        "doc",
        "size",
        F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("place")).alias("place"),
    )
    starts = place.groupBy("shard").agg(F.min("place").alias("start"))
    return place.join(bounded(starts, shards), "shard").select(
        "doc", "size", "shard", (F.col("place") - F.col("start")).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows by slot."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("doc.*", "shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
