"""Strict JSON-lines source and deterministic JSON-lines sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_rows
from ..functions.rendering import json_line


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with the file they come from: DataFrame[value, origin]."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("origin"))


def checked_lines(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Blank lines dropped, each other line parsed and judged.

    Adds ``row`` (struct of the table's columns), ``present`` (keys the line
    names) and ``error`` (null when the line is good). Each line is parsed once
    as a variant, once with the table's types, and scanned once for its keys.
    Binary is read as the hex text the export writes. A value of another type, at
    any depth, is an error; a string column takes any value as its text.
    """
    line, seal, variant = F.col("_line"), F.col("_seal"), F.col("_variant")
    wire = json_rows.wire_schema(schema)
    parsed = (
        lines.withColumn("_line", json_rows.stripped(F.col(value)))
        .where(line != "")
        .withColumn("_seal", json_rows.seal_of(line))
        .withColumns(
            {
                "_variant": json_rows.sealed_variant(line, seal),
                "present": json_rows.object_keys(line),
                "_wire": F.from_json(line, wire, {"columnNameOfCorruptRecord": json_rows.CORRUPT}),
            }
        )
    )
    error = json_rows.row_error(line, seal, variant, F.col("present"), F.col("_wire"), schema)
    row = json_rows.typed(F.col("_wire"), schema)
    return parsed.withColumns({"error": error, "row": row}).drop("_line", "_seal", "_variant", "_wire")


def parse_lines(
    lines: DataFrame, schema: T.StructType, value: str = "value", present: str | None = None
) -> DataFrame:
    """The table rows of JSON lines; reading a bad line fails the job.

    ``present`` names a column to add that holds the keys each line gave.
    """
    where = F.concat(F.col("origin"), F.lit(": ")) if "origin" in lines.columns else F.lit("")
    stop = F.raise_error(F.concat(where, F.col("error"), F.lit(": "), F.col(value)))
    # A filter holds even where no column is read, as in a count.
    good = F.when(F.col("error").isNull(), F.lit(True)).otherwise(stop.cast("boolean"))
    named = [] if present is None else [F.col("present").alias(present)]
    return checked_lines(lines, schema, value).where(good).select("row.*", *named)


def jsonl_scan(spark: SparkSession, path: str, schema: T.StructType, present: str | None = None) -> DataFrame:
    return parse_lines(read_lines(spark, path), schema, present=present)


def jsonl_lines(df: DataFrame) -> DataFrame:
    return df.select(json_line(df.schema).alias("value"))


def jsonl_sink(df: DataFrame, path: str) -> int:
    """Write one object per line, in the order of ``df``; returns the row count.

    The count is observed while writing, so the rows are computed once.
    """
    seen = Observation("jsonl_sink")
    jsonl_lines(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").text(path)
    return seen.get["rows"]
