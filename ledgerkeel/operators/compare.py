"""Comparison of table states: multiset and keyed differences, drift, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StateError
from ..functions.rendering import json_line, render_json_value
from ..session import written
from .mutate import BROADCAST_KEYS, all_fixed_width


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with unequal numbers of copies and ``copies`` = left minus right.

    Both directions of ``exceptAll`` in one aggregate: copies collapse on the map
    side, so a row repeated very often travels once per task.
    """
    names = columns or left.columns
    signed = left.select(*names, F.lit(1).alias("_sign")).unionByName(
        right.select(*names, F.lit(-1).alias("_sign"))
    )
    return signed.groupBy(*names).agg(F.sum("_sign").alias("copies")).where(F.col("copies") != 0)


def _row_digests(df: DataFrame, columns: list[str], sign: int) -> DataFrame:
    row = df.select(*columns)
    digest = F.unhex(F.sha2(json_line(row.schema), 256))
    group = ["grp"] if "grp" in columns else []
    return row.select(*group, digest.alias("_digest"), F.lit(sign).alias("_sign"))


def equal_states(live: DataFrame, expected: DataFrame) -> DataFrame:
    """DataFrame[grp, missing_rows, extra_rows, matches] over groups of either side.

    Rows are compared by the digest of their export line, so however wide they
    are, 32 bytes and a sign are shuffled per row. Values that export alike are
    alike; of floats, 0.0 and -0.0 are not.
    """
    names = live.columns
    signed = _row_digests(live, names, 1).unionByName(_row_digests(expected, names, -1))
    copies = signed.groupBy("grp", "_digest").agg(F.sum("_sign").alias("_copies"))
    return copies.groupBy("grp").agg(
        F.sum(F.greatest(-F.col("_copies"), F.lit(0))).alias("missing_rows"),
        F.sum(F.greatest(F.col("_copies"), F.lit(0))).alias("extra_rows"),
        F.bool_and(F.col("_copies") == 0).alias("matches"),
    )


def _compared(live: DataFrame, expected: DataFrame, relation: DataFrame) -> DataFrame:
    """Every group of ``relation`` with its comparison, null for groups that are ahead.

    Rows become digests before anything is shuffled, and groups are told apart only
    once there is one row for each: a large group is spread over its digests.
    """
    compared = equal_states(live, expected)
    joined = relation.join(compared, "grp", "left")
    ahead = F.col("relation") == "ahead"
    return joined.withColumn("matches", F.when(~ahead, F.col("matches")))


def drift(live: DataFrame, expected: DataFrame, relation: DataFrame) -> DataFrame:
    """DataFrame[grp, applied_index, drifted].

    ``expected`` is each group's state at its own applied index. A group that is
    ahead has drifted and its rows are not compared.
    """
    differs = ~F.coalesce("matches", F.lit(True))
    return _compared(live, expected, relation).select(
        "grp",
        F.col("applied_count").alias("applied_index"),
        ((F.col("relation") == "ahead") | differs).alias("drifted"),
    )


def plan_summary(live: DataFrame, head: DataFrame, relation: DataFrame) -> DataFrame:
    """DataFrame[grp, applied_index, target_index, matches] against the head state."""
    return _compared(live, head, relation).select(
        "grp",
        F.col("applied_count").alias("applied_index"),
        F.col("head_count").alias("target_index"),
        ((F.col("relation") != "ahead") & F.coalesce("matches", F.lit(True))).alias("matches"),
    )


def keyed_difference(
    old: DataFrame,
    new: DataFrame,
    key: list[str],
    columns: list[str] | None = None,
    narrow_first: bool = False,
) -> DataFrame:
    """DataFrame[*key, change, column, old_value, new_value].

    ``change`` is added, removed or changed; added and removed rows have one row
    per column too. Values are text. Keys must be unique on each side; a repeated
    key fails the job. Both sides go into one aggregate by key, so there is one
    shuffle and a repeated key cannot pile up in a join.

    ``narrow_first`` suits wide tables with few changes: keys and row digests are
    compared first, and only rows of keys that differ are shuffled in full.
    """
    values = columns or [c for c in old.columns if c not in key]
    if narrow_first:
        changed = written(_changed_keys(old, new, key, values), "changed")
        few = changed.count() <= BROADCAST_KEYS and all_fixed_width(changed, key)
        side = F.broadcast(changed) if few else changed
        old, new = _of_keys(old, side, key), _of_keys(new, side, key)

    def packed(df: DataFrame, side: str) -> DataFrame:
        text = F.struct(*[F.col(c).cast("string").alias(c) for c in values])
        exact = F.struct(*[_comparable(F.col(c), df.schema[c].dataType).alias(c) for c in values])
        return df.select(*key, F.lit(side).alias("_side"), F.struct(text.alias("text"), exact.alias("exact")).alias("_row"))

    sides = packed(old, "old").unionByName(packed(new, "new"))

    def of(side: str) -> tuple[Column, Column]:
        mine = F.col("_side") == side
        return F.max(F.when(mine, F.col("_row"))).alias(f"_{side}"), F.count_if(mine).alias(f"_n_{side}")

    grouped = sides.groupBy(*key).agg(*of("old"), *of("new"))
    repeated = F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*key))))
    change = (
        F.when((F.col("_n_old") > 1) | (F.col("_n_new") > 1), repeated.cast("string"))
        .when(F.col("_n_old") == 0, F.lit("added"))
        .when(F.col("_n_new") == 0, F.lit("removed"))
        .otherwise(F.lit("changed"))
    )
    cells = F.array(
        *[
            F.when(
                (change != "changed") | ~F.col("_old")["exact"][c].eqNullSafe(F.col("_new")["exact"][c]),
                F.struct(
                    F.lit(c).alias("column"),
                    F.col("_old")["text"][c].alias("old_value"),
                    F.col("_new")["text"][c].alias("new_value"),
                ),
            )
            for c in values
        ]
    )
    return grouped.select(*key, change.alias("change"), F.inline(F.array_compact(cells)))


def _comparable(value: Column, dtype: T.DataType) -> Column:
    """The value itself, or for nested values their JSON: ["a, b"] is not ["a", "b"]."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(render_json_value(value, dtype).alias("v")), {"ignoreNullFields": "false"})
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    return value


def _changed_keys(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys that are not exactly once on both sides with the same row."""

    def digested(df: DataFrame, sign: int) -> DataFrame:
        row = df.select(*values)
        return df.select(*key, F.unhex(F.sha2(json_line(row.schema), 256)).alias("_digest"), F.lit(sign).alias("_sign"))

    return (
        digested(old, 1)
        .unionByName(digested(new, -1))
        .groupBy(*key)
        .agg(
            F.count("*").alias("_rows"),
            F.sum("_sign").alias("_balance"),
            F.min("_digest").alias("_low"),
            F.max("_digest").alias("_high"),
        )
        .where((F.col("_rows") != 2) | (F.col("_balance") != 0) | (F.col("_low") != F.col("_high")))
        .select(*key)
    )


def _of_keys(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    renamed = keys.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)])
    equal = F.lit(True)
    for i, k in enumerate(key):
        equal = equal & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return df.join(renamed, equal, "left_semi")


def plan_diff(
    live: DataFrame,
    head: DataFrame,
    key: list[str],
    relation: DataFrame | None = None,
    narrow_first: bool = False,
) -> DataFrame:
    """Keyed difference from the live to the head state.

    The live side of a group that is ahead counts as empty: every head row of it
    is an addition. With ``relation`` the key must contain ``grp``.
    """
    if relation is not None:
        ahead = relation.where(F.col("relation") == "ahead").select("grp")
        live = live.join(ahead, "grp", "left_anti").select(*live.columns)
    return keyed_difference(live, head, key, narrow_first=narrow_first)


def line_diff(old: DataFrame, new: DataFrame, key: list[str], text: str) -> DataFrame:
    """DataFrame[*key, line, change, copies]: lines removed from or added to a text.

    Lines are compared as a multiset per key; where in the text they moved is
    not told. Equal lines cancel in the map-side part of the aggregate.
    """

    def lines(df: DataFrame, sign: int) -> DataFrame:
        # Every text ends with a newline once normalised, so the last piece is empty.
        closed = F.regexp_replace(F.col(text), r"\n\z", "")
        return df.select(*key, F.explode(F.split(closed, "\n")).alias("line"), F.lit(sign).alias("_sign"))

    summed = (
        lines(old, -1)
        .unionByName(lines(new, 1))
        .groupBy(*key, "line")
        .agg(F.sum("_sign").alias("_n"))
        .where(F.col("_n") != 0)
    )
    return summed.select(
        *key,
        "line",
        F.when(F.col("_n") > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change"),
        F.abs("_n").alias("copies"),
    )


def verify_expected(live: DataFrame, expected: DataFrame, context: str) -> None:
    """Raise, with one of the rows, when the two states differ.

    Digests are compared; a full row is fetched only for the message.
    """
    names = live.columns
    signed = _row_digests(live, names, 1).unionByName(_row_digests(expected, names, -1))
    odd = signed.groupBy("_digest").agg(F.sum("_sign").alias("copies")).where(F.col("copies") != 0).first()
    if odd is None:
        return
    side, df = ("extra", live) if odd["copies"] > 0 else ("missing", expected)
    digest = F.unhex(F.sha2(json_line(live.schema), 256))
    row = df.select(*names).where(digest == F.lit(bytes(odd["_digest"]))).first()
    raise StateError(f"{context}: live state differs from the expected one, {side} row {row.asDict()}")
