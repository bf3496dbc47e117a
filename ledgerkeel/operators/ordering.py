"""Positions and neighbours inside ordered groups that may be very large.

A window puts one group into one task. That is right for the many small groups
and wrong for a group that holds a third of all rows, so every function here
first counts the largest group (a partial aggregate over the group columns
only). Above ``hot_rows`` the rows are range-partitioned by group and order,
written once, windowed per (group, part) and stitched together from one edge
row per part. Both ways give the same values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

HOT_ROWS = 2_000_000
#: Rows a task takes, about, of a frame that is dealt by group.
TASK_ROWS = 250_000


def largest_group(df: DataFrame, group: list[str]) -> int:
    return group_sizes(df, group)[0]


def group_sizes(df: DataFrame, group: list[str]) -> tuple[int, int]:
    """Rows of the largest group, and all rows."""
    found = df.groupBy(*group).count().agg(F.max("count"), F.sum("count")).first()
    return found[0] or 0, found[1] or 0


def dealt(df: DataFrame, keys: list[str], rows: int, always: bool = False) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as ``rows`` need, ``TASK_ROWS`` each.

    The number is fixed, so tasks do not grow with the input: by default it would stay that of the
    session, and Spark joins parts until they have 64 MB, which packed rows exceed many times in a sort.
    A frame that fits one task is left as it is, or (``always``) dealt as the session says.
    """
    parts = -(-rows // TASK_ROWS)
    if parts <= 1:
        return df.repartition(*keys) if always else df
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def attach(df: DataFrame, other: DataFrame, keys: list[str], values: list[str], how: str = "left") -> DataFrame:
    """Join ``values`` of ``other`` on ``keys`` (null equals null), keeping ``df``'s columns.

    The other side's keys are renamed, so both sides may come from one frame.
    """
    renamed = other.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *values)
    equal = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    )
    return df.join(renamed, equal, how).select(*df.columns, *values)


def _in_parts(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    spread = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    return written(spread, "parts")


def _with_edges(parts: DataFrame, edges: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    # Only groups that cross a part border have an edge: at most one per part.
    return attach(parts, edges, [*group, "_part"], values)


def ordinal(
    df: DataFrame,
    group: list[str],
    order: list[str],
    name: str = "idx",
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
    rows: int = 0,
) -> DataFrame:
    """Add the 1-based position of each row in its group (bigint).

    ``order`` must be unique within a group for a stable result. ``largest`` is
    an upper bound on the group size where the caller knows one, ``rows`` then the number of rows.
    """
    if largest is None:
        largest, rows = group_sizes(df, group)
    if largest <= hot_rows:
        place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
        return dealt(df, group, rows).withColumn(name, place.cast("bigint"))
    parts = _in_parts(df, group, order)
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*group, "_part")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(earlier))
        .where(F.col("_before").isNotNull())
        .drop("_rows")
    )
    local = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
    placed = parts.withColumn("_local", local.cast("bigint"))
    return (
        _with_edges(placed, offsets, group, ["_before"])
        .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_local", "_before")
    )


def running_sum(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str,
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the sum of ``value`` over the group's rows up to and including this one."""
    return running_sums(df, group, order, {name: value}, hot_rows)


def running_sums(
    df: DataFrame,
    group: list[str],
    order: list[str],
    values: dict[str, str],
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add, under each name, the sum of its column over the group's rows up to and including this one.

    ``largest`` is an upper bound on the group size where the caller knows one.
    """
    if (largest_group(df, group) if largest is None else largest) <= hot_rows:
        here = _up_to_here(group, order)
        return df.withColumns({name: F.sum(value).over(here) for name, value in values.items()})
    parts = _in_parts(df, group, order)
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = {name: f"_before_{i}" for i, name in enumerate(values)}
    offsets = (
        parts.groupBy(*group, "_part")
        .agg(*[F.sum(value).alias(before[name]) for name, value in values.items()])
        .withColumns({column: F.sum(column).over(earlier) for column in before.values()})
        .where(" OR ".join(f"{column} IS NOT NULL" for column in before.values()))
    )
    here = _up_to_here([*group, "_part"], order)
    local = parts.withColumns({name: F.sum(value).over(here) for name, value in values.items()})
    return (
        _with_edges(local, offsets, group, list(before.values()))
        .withColumns({name: F.col(name) + F.coalesce(before[name], F.lit(0)) for name in values})
        .drop("_part", *before.values())
    )


def _up_to_here(group: list[str], order: list[str]):
    return W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def previous_value(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str,
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``value`` of the row before, null for the first row of a group."""
    if largest_group(df, group) <= hot_rows:
        return df.withColumn(name, F.lag(value).over(W.partitionBy(*group).orderBy(*order)))
    parts = _in_parts(df, group, order)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    edges = (
        parts.groupBy(*group, "_part")
        .agg(last.alias("_last"))
        .withColumn("_edge", F.lag("_last").over(W.partitionBy(*group).orderBy("_part")))
        .where(F.col("_edge").isNotNull())
        .drop("_last")
    )
    inner = W.partitionBy(*group, "_part").orderBy(*order)
    placed = parts.withColumns({"_lag": F.lag(value).over(inner), "_local": F.row_number().over(inner)})
    return (
        _with_edges(placed, edges, group, ["_edge"])
        .withColumn(name, F.when(F.col("_local") == 1, F.col("_edge")["v"]).otherwise(F.col("_lag")))
        .drop("_part", "_lag", "_local", "_edge")
    )


def nearest_flagged(
    df: DataFrame,
    group: list[str],
    order: str,
    flag: Column,
    name: str,
    ahead: bool = True,
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add the closest ``order`` value after (or before) the row's own one that
    belongs to a flagged row of the group; null if there is none."""
    if (largest_group(df, group) if largest is None else largest) <= hot_rows:
        return df.withColumn(name, nearest(group, order, F.when(flag, F.col(order)), ahead))
    points = df.groupBy(*group, order).agg(F.bool_or(flag).alias("_flag"))
    parts = _in_parts(points, group, [order])
    marked = F.when(F.col("_flag"), F.col(order))
    best = F.min if ahead else F.max
    by_part = F.col("_part").desc() if ahead else F.col("_part").asc()
    beyond = W.partitionBy(*group).orderBy(by_part).rowsBetween(W.unboundedPreceding, -1)
    edges = (
        parts.groupBy(*group, "_part")
        .agg(best(marked).alias("_best"))
        .withColumn("_edge", best("_best").over(beyond))
        .where(F.col("_edge").isNotNull())
        .drop("_best")
    )
    placed = parts.withColumn("_near", nearest([*group, "_part"], order, marked, ahead))
    points = _with_edges(placed, edges, group, ["_edge"]).select(
        *group, order, F.coalesce("_near", "_edge").alias(name)
    )
    return attach(df, points, [*group, order], [name])


def nearest(group: list[str], order: str, marked: Column, ahead: bool) -> Column:
    # Always a frame that only grows: from the far end up to just before the row.
    by = F.col(order).desc() if ahead else F.col(order).asc()
    frame = W.partitionBy(*group).orderBy(by).rangeBetween(W.unboundedPreceding, -1)
    return (F.min if ahead else F.max)(marked).over(frame)


def repeats(df: DataFrame, keys: list[str], position: str, first: str) -> DataFrame:
    """Rows that are not the first by ``position`` among those sharing ``keys``.

    ``first`` names a column for the first row's position, which must be unique
    within the keys. An aggregate with map-side partials finds the keys that
    repeat; only those meet the rows again, so the usual few repeats make a small
    join side and a key with very many copies can be split by its probe side.
    """
    again = (
        df.groupBy(*keys)
        .agg(F.min(position).alias(first), F.count("*").alias("_copies"))
        .where(F.col("_copies") > 1)
    )
    return attach(df, again, keys, [first], "inner").where(F.col(position) > F.col(first))
