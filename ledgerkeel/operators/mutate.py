"""Table mutation in pure form: target and rows in, new table content out.

Plain files have no row updates, so an upsert is "target without the matching
keys, plus the rows". The anti join is the only shuffle; Spark broadcasts the
key side when its size is under the session's threshold and can split a hot
target key (or the null keys, which never match) otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DatasetError

MODES = ("replace", "upsert", "insert")

# A key side of at most this many fixed-width rows is small enough to broadcast.
BROADCAST_KEYS = 1_000_000
_FIXED_WIDTH = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def align(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in the target's columns and types; omitted columns are null."""
    unknown = sorted(set(rows.columns) - set(schema.fieldNames()))
    if unknown:
        raise DatasetError(f"unknown column(s): {', '.join(map(repr, unknown))}")
    return rows.select(
        *[
            (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def apply_insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(align(rows, target.schema))


def apply_replace(target: DataFrame, rows: DataFrame) -> DataFrame:
    return align(rows, target.schema)


def apply_replace_empty(target: DataFrame) -> DataFrame:
    return target.where(F.lit(False))


def _known_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.select(*on).dropna("any")


def all_fixed_width(df: DataFrame, columns: list[str]) -> bool:
    return all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in columns)


def _without_keys(target: DataFrame, keys: DataFrame, on: list[str], source_rows: int | None) -> DataFrame:
    """Anti join. Keys with a known small bound are broadcast, so that a huge
    target is not shuffled; otherwise Spark decides by size."""
    if all_fixed_width(keys, on) and source_rows is not None and source_rows <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return target.join(keys, on, "left_anti").select(*target.columns)


def delete_matching(
    target: DataFrame, rows: DataFrame, on: list[str], source_rows: int | None = None
) -> DataFrame:
    """Target rows whose key is not among the rows; a null key matches nothing."""
    return _without_keys(target, _known_keys(rows, on).distinct(), on, source_rows)


def apply_upsert(
    target: DataFrame,
    rows: DataFrame,
    on: list[str],
    missing: str = "null",
    on_duplicate: str = "raise",
    present: str | None = None,
    source_rows: int | None = None,
    buckets: tuple[int, list[str]] | None = None,
) -> DataFrame:
    """Rows replace the target rows that share their key, the others are added.

    ``missing="null"`` rewrites whole rows. ``missing="keep"`` keeps the old value
    of columns a row does not name; ``present`` is then the array column of names
    the row did give (an explicit null still overwrites). ``on_duplicate`` is
    ``raise`` or ``insert_all``. Any number of key columns is fine. ``source_rows``
    is an upper bound on the number of rows where the caller has counted them. ``buckets``
    (number, columns) are those of a bucketed target: if its key is the bucket columns, rows are
    dealt the same way, the target meets them bucket by bucket without a shuffle of its own, and the
    result lies as the target does.
    """
    if not on:
        raise DatasetError("upsert requires on")
    absent = [c for c in on if c not in target.columns or c not in rows.columns]
    if absent:
        raise DatasetError(f"missing upsert key column(s): {', '.join(map(repr, absent))}")
    if on_duplicate not in ("raise", "insert_all"):
        raise DatasetError(f"unknown on_duplicate {on_duplicate!r}")
    if buckets is not None and set(buckets[1]) == set(on):
        typed = [F.col(c).cast(target.schema[c].dataType).alias(c) if c in on else F.col(c) for c in rows.columns]
        rows = rows.select(*typed).repartition(buckets[0], *buckets[1])
    if missing == "keep":
        return _merge_present(target, rows, on, present, source_rows)
    if missing != "null":
        raise DatasetError(f"unknown missing {missing!r}")
    kept = delete_matching(target, rows, on, source_rows)
    return kept.unionByName(align(_guarded(rows, on) if on_duplicate == "raise" else rows, target.schema))


def _guarded(rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows, failing the job if a key without nulls is repeated.

    Every keyed row comes out of the aggregate that counts its key, so no plan that
    returns such a row can do without the check, whatever is filtered or joined later.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    rest = [c for c in rows.columns if c not in on]
    repeated = F.raise_error(F.concat(F.lit("duplicate upsert key: "), F.to_json(F.struct(*on))))
    own = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    keyed = (
        rows.where(known)
        .groupBy(*on)
        .agg(F.first(own).alias("_row"), F.count("*").alias("_copies"))
        .where(F.when(F.col("_copies") > 1, repeated.cast("boolean")).otherwise(F.lit(True)))
    )
    single = keyed.select(*[F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in rows.columns])
    return single.unionByName(rows.where(~known))


def _merge_present(
    target: DataFrame, rows: DataFrame, on: list[str], present: str | None, source_rows: int | None
) -> DataFrame:
    """One outer join of target and rows. With few rows, of a counted number and fixed width of
    keys, only target rows they touch take part; the others stay where they lie."""
    if present is None:
        raise DatasetError("missing='keep' needs the present column")
    if source_rows is not None and source_rows <= BROADCAST_KEYS and all_fixed_width(rows, on):
        keys = F.broadcast(_known_keys(rows, on).distinct())
        apart = target.join(keys, on, "left_anti").select(*target.columns)
        near = target.join(keys, on, "left_semi").select(*target.columns)
        return apart.unionByName(_merged(near, _guarded(rows, on), on, present))
    return _merged(target, _guarded(rows, on), on, present)


def _merged(target: DataFrame, rows: DataFrame, on: list[str], present: str) -> DataFrame:
    plain = align(rows.drop(present), target.schema)
    given = set(rows.columns) - {*on, present}
    new = rows.select(
        *[F.col(c).cast(plain.schema[c].dataType).alias(f"_on_{i}") for i, c in enumerate(on)],
        F.col(present).alias("_present"),
        F.struct(*[F.col(c).cast(plain.schema[c].dataType).alias(c) for c in rows.columns if c in given]).alias("_new")
        if given
        else F.struct(F.lit(0)).alias("_new"),
        F.lit(True).alias("_given"),
    )
    old = target.withColumn("_old", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_on_{i}") for i, c in enumerate(on)])
    joined = old.join(new, same, "full_outer")
    fresh = F.col("_old").isNull()

    def merged(name: str) -> Column:
        if name in on:
            return F.when(fresh, F.col(f"_on_{on.index(name)}")).otherwise(F.col(name)).alias(name)
        if name not in given:
            return F.col(name)
        named = fresh | F.coalesce(F.array_contains("_present", name), F.lit(False))
        return F.when(named, F.col("_new")[name]).otherwise(F.col(name)).alias(name)

    return joined.select(*[merged(c) for c in target.columns])


def apply_rows(target: DataFrame, rows: DataFrame, mode: str, on: list[str] | None = None, **upsert) -> DataFrame:
    """Dispatch one data file's rows by mode."""
    if mode == "insert":
        return apply_insert(target, rows)
    if mode == "replace":
        return apply_replace(target, rows)
    if mode == "upsert":
        return apply_upsert(target, rows, list(on or ()), **upsert)
    raise DatasetError(f"unsupported mode {mode!r}; known: {', '.join(MODES)}")


def duplicate_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (
        _known_keys(rows, on)
        .groupBy(*on)
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
