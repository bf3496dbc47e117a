"""Word rules, tables and size-checked broadcasts that the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fetch
from ..session import written

__all__ = [
    "BROADCAST_ROWS", "WORD", "batch_rows", "bounded", "held", "lower_az", "matched", "may_match", "row_hash", "table", "whole", "words", "written",
]

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a narrow side (under about 100 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows per Arrow batch for the jobs inside, so that tasks hold less text at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` inside one struct ``doc``, so that own names cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def held(df: DataFrame, name: str) -> Column:
    """The field of ``doc``, or null where the input has no such column."""
    return F.col(f"doc.`{name}`") if name in df.schema["doc"].dataType.names else F.lit(None)


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns inside ``doc``; maps and variants enter as their JSON."""

    def hashable(dtype: T.DataType) -> bool:
        if isinstance(dtype, T.ArrayType):
            return hashable(dtype.elementType)
        if isinstance(dtype, T.StructType):
            return all(hashable(f.dataType) for f in dtype.fields)
        return not isinstance(dtype, (T.MapType, T.VariantType))

    fields = rows.schema["doc"].dataType.fields
    own = [F.col(f"doc.`{f.name}`") for f in fields]
    return F.xxhash64(*[c if hashable(f.dataType) else F.to_json(F.struct(c)) for f, c in zip(fields, own, strict=True)])


def bounded(df: DataFrame, rows: int, limit: int | None = None) -> DataFrame:
    """Broadcast a side whose counted rows are under the limit; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if limit is None else limit) else df


def may_match(asked: DataFrame, keys: list[str], rows: int) -> Column | None:
    """For rows with the same ``keys``: whether one of the counted rows of ``asked`` may equal them, null as a value.

    It is asked before a join that ``bounded`` does not broadcast, so that the join shuffles the texts that have a
    partner and about one in a hundred others, not all of them. None where the join broadcasts. ``asked`` should be written.
    """
    return None if rows <= BROADCAST_ROWS else fetch.in_bits(fetch.bloom_bits(asked, keys, rows), keys)


def matched(wide: DataFrame, asked: DataFrame, keys: list[str], rows: int, how: str) -> DataFrame:
    """Rows of ``wide`` whose ``keys`` a row of the written and counted ``asked`` equals (null as a value), by a
    ``left_semi`` join, or does not, by a ``left_anti`` one. A large ``asked`` meets only the rows that its bits let pass."""
    side = asked.select(*[F.col(k).alias(f"_asked_{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_asked_{i}"))
    passed = may_match(asked, keys, rows)
    found = (wide if passed is None else wide.where(passed)).join(bounded(side, rows), same, how)
    return found if passed is None or how == "left_semi" else wide.where(~passed).unionByName(found)
