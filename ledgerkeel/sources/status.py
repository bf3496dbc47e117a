"""Applied logs as status text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_rows import stripped
from ..operators.ordering import HOT_ROWS, ordinal

# How a status line marks an applied or pending entry, and the count line.
STATUS_LINE = r"^\[([ X])\]\s+(.+?)\s*$"
COUNT_LINE = r"^(?i:applied:)(.*)$"


def applied_scan(status: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Applied entries of status lines: DataFrame[grp, pos, entry].

    ``status`` has ``grp``, ``line_no`` and ``line``; ``pos`` counts the applied
    lines of a group from 1 in line order.
    """
    applied = status.select("grp", "line_no", stripped(F.col("line")).alias("line")).where(
        F.regexp_extract("line", STATUS_LINE, 1) == "X"
    )
    named = applied.select("grp", "line_no", F.regexp_extract("line", STATUS_LINE, 2).alias("entry"))
    placed = ordinal(named, ["grp"], ["line_no"], "pos", hot_rows)
    return placed.select("grp", "pos", "entry")


def status_check(status: DataFrame) -> DataFrame:
    """Listed against declared applied counts: DataFrame[grp, listed, declared, status].

    ``status`` is ``ok``, ``mismatch`` or ``unreadable`` (the count is no number).
    """
    line = stripped(F.col("line"))
    marked = F.regexp_extract(line, STATUS_LINE, 1)
    counted = F.trim(F.regexp_extract(line, COUNT_LINE, 1))
    is_count = (marked == "") & F.rlike(line, F.lit(COUNT_LINE))
    number = F.expr("try_cast(_count AS bigint)")
    per_group = (
        status.select(
            "grp",
            "line_no",
            (marked == "X").alias("_applied"),
            F.when(is_count, counted).alias("_count"),
        )
        .groupBy("grp")
        .agg(
            F.count_if("_applied").alias("listed"),
            # The last count line of a group counts.
            F.max_by(number, F.when(F.col("_count").isNotNull(), F.col("line_no"))).alias("declared"),
            F.count_if(F.col("_count").isNotNull() & number.isNull()).alias("_bad"),
        )
    )
    verdict = (
        F.when(F.col("_bad") > 0, F.lit("unreadable"))
        .when(F.col("declared") != F.col("listed"), F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    return per_group.select("grp", "listed", "declared", verdict.alias("status"))
