"""Round trips of replace, insert and upsert steps by homomorphic state digests.

The digest of a state is the sum of one number per row, so a step changes it by what its rows
add and what the rows they end take away. Rolling a step back is right exactly if the inverse changes
the digest by the opposite amount. Neither the state before nor the one after is built: sums
per step are aggregates with map-side partials, and the digest of a whole state, needed where an
inverse replaces it, is a running sum over steps (one row each).

A row's number has 86 bits of the SHA-256 of its export line. Sums are exact decimals, so two states
have equal digests only if they hold the same rows as often, up to chance.

Inverse rows have grp, idx, op, key and value columns; ``op`` is one of

* ``upsert``   live rows of its key go, the row comes
* ``delete``   live rows of its key go
* ``insert``   the row comes
* ``remove``   one live copy of an equal row goes, if there is one
* ``replace``  the whole state goes, the row comes
* ``clear``    the whole state goes; the row itself says nothing (a replace by no row)

All rows of one (grp, idx) are one inverse: what goes is taken from the state after the step,
then what comes is added. Rows of an unknown ``op`` fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rendering import json_line
from ..session import written
from .ordering import HOT_ROWS, attach, dealt, group_sizes, largest_group, running_sums
from .replay import change_sets, validity_ranges

OPS = ("upsert", "delete", "insert", "remove", "replace", "clear")
_HALF = 1 << 43
#: Holds a row's number; the ten digits that Spark adds to a sum are enough for 10^11 rows.
NUMBER = "decimal(27,0)"


def row_number(df: DataFrame, columns: list[str]) -> Column:
    """86 bits of a row's digest as a decimal without fraction."""
    digest = F.sha2(json_line(df.select(*columns).schema), 256)

    def half(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), digest).bitwiseAND(F.lit(_HALF - 1)).cast("decimal(13,0)")

    return (half(1) * F.lit(_HALF).cast("decimal(13,0)") + half(2)).cast(NUMBER)


def state_digests(
    ranges: DataFrame, columns: list[str], sets: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """DataFrame[grp, idx, rows, digest]: size and digest of the state after every change-set.

    ``columns`` are the row's own columns, without the group. States are equal up to chance if both
    numbers are, so any two points of a history compare by two of these rows.
    """
    number = ranges.select("grp", "valid_from", "valid_to", row_number(ranges, columns).alias("h"))
    number = written(number, "numbers")
    asked = _zero(sets).withColumn("_asked", F.lit(True))
    every = _deltas(number).withColumn("_asked", F.lit(False)).unionByName(asked)
    largest, total = group_sizes(number.select("grp").unionByName(sets.select("grp")), ["grp"])
    bound = 2 * largest if 2 * largest <= hot_rows else None
    if bound is not None:
        # All of a group lies together, so that sums per step and running sums share one shuffle.
        every = dealt(every, ["grp"], 2 * total, always=True)
    deltas = every.groupBy("grp", "idx").agg(F.sum("h").alias("h"), F.sum("n").alias("n"), F.bool_or("_asked").alias("_asked"))
    summed = running_sums(deltas, ["grp"], ["idx"], {"digest": "h", "rows": "n"}, hot_rows, bound)
    return summed.where("_asked").select("grp", "idx", "rows", "digest")


def _zero(points: DataFrame) -> DataFrame:
    return points.select("grp", "idx", F.lit(0).cast(NUMBER).alias("h"), F.lit(0).alias("n"))


def _deltas(versions: DataFrame) -> DataFrame:
    """What every row adds where it begins and takes away where it ends."""
    born = versions.select("grp", F.col("valid_from").alias("idx"), "h", F.lit(1).alias("n"))
    died = versions.where(F.col("valid_to").isNotNull())
    return born.unionByName(
        died.select("grp", F.col("valid_to").alias("idx"), (-F.col("h")).cast(NUMBER).alias("h"), F.lit(-1).alias("n"))
    )


def _alive(
    versions: DataFrame, asked: DataFrame, by: list[str], hot_rows: int, largest: int | None = None
) -> DataFrame:
    """``asked`` (by, idx) with digest sum and number of the rows alive there that share ``by``.

    Only versions whose ``by`` is asked for at all are looked at.
    """
    events = []
    for at, sign in (("valid_from", 1), ("valid_to", -1)):
        own = versions.where(F.col(at).isNotNull())
        signed = (F.col("h") * sign).cast(NUMBER)
        events.append(own.select(*by, F.col(at).alias("idx"), signed.alias("_h"), F.lit(sign).alias("_n"), F.lit(False).alias("_asked")))
    # Null keys are never asked for, so plain equality is right; only grp may be null.
    wanted = asked.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & (F.col(c).eqNullSafe(F.col(f"_{i}")) if c == "grp" else F.col(c) == F.col(f"_{i}"))
    touching = events[0].unionByName(events[1]).join(wanted, same, "left_semi")
    zero = F.lit(0).cast(NUMBER).alias("_h")
    points = touching.unionByName(asked.select(*by, "idx", zero, F.lit(0).alias("_n"), F.lit(True).alias("_asked")))
    merged = points.groupBy(*by, "idx").agg(
        F.sum("_h").alias("_h"), F.sum("_n").alias("_n"), F.bool_or("_asked").alias("_asked")
    )
    summed = running_sums(merged, by, ["idx"], {"alive_h": "_h", "alive_n": "_n"}, hot_rows, largest)
    return summed.where("_asked").select(*by, "idx", "alive_h", "alive_n")


def state_roundtrip(
    changes: DataFrame,
    inverses: DataFrame,
    key: list[str],
    anchor: DataFrame | None = None,
    sets: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """DataFrame[grp, idx, mode, status, surplus_rows], one row per change-set.

    ``status`` is ``checked`` if rolling the step back by its inverse gives the state before
    it, ``mismatch`` if not, ``skipped`` for a step without inverse. ``surplus_rows`` is the number of rows
    the rolled-back state has too many (negative: too few); a mismatch may have none. Inverses of
    steps that do not exist are passed over. Frames are those of ``replay``; a state may hold
    equal rows and keys more than once, and null keys, which no key matches. Versions and inverses, which
    every part below reads, are written once, as keys and row numbers.
    """
    columns = [*key, *[c for c in changes.columns if c not in ("grp", "idx", "mode", *key)]]
    steps = change_sets(changes) if sets is None else sets.select("grp", "idx", "mode").distinct()
    ranges = validity_ranges(changes, key, anchor, steps, hot_rows)
    versions = ranges.select("grp", *key, "valid_from", "valid_to", row_number(ranges, columns).alias("h"))
    versions = written(versions, "versions")
    op = F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(
        F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("string")
    )
    undo = inverses.select("grp", "idx", op.alias("op"), *key, row_number(inverses, columns).alias("h"))
    undo = written(undo, "inverses")
    # Of any frame below whose sums run on: a version begins and ends, an inverse row asks once.
    largest = 2 * largest_group(versions, ["grp"]) + largest_group(undo, ["grp"])
    bound = largest if largest <= hot_rows else None
    undone = undo.groupBy("grp", "idx").agg(F.bool_or(F.col("op").isin("replace", "clear")).alias("_whole"))
    whole, partly = undone.where("_whole").select("grp", "idx"), undone.where("NOT _whole").select("grp", "idx", F.lit(True).alias("_partly"))

    deltas = _deltas(versions)
    comes = undo.where(F.col("op").isin("upsert", "insert", "replace")).select("grp", "idx", "h", F.lit(1).alias("n"))

    # Keys of partial inverses: all their live rows go.
    known = F.lit(True)
    for name in key:
        known = known & F.col(name).isNotNull()
    by_key = ["grp", *key]
    partial = attach(undo, partly, ["grp", "idx"], ["_partly"], "inner").drop("_partly")
    gone_keys = partial.where(F.col("op").isin("upsert", "delete") & known).select(*by_key, "idx").distinct()
    gone = _alive(versions, gone_keys, by_key, hot_rows, bound).select("grp", "idx", "alive_h", "alive_n")

    # Single rows of partial inverses: as many copies go as are asked for and live, of keys that stay.
    flagged = gone_keys.withColumn("_gone", F.lit(True))
    asked = attach(partial.where(F.col("op") == "remove"), flagged, [*by_key, "idx"], ["_gone"])
    asked = asked.where(F.col("_gone").isNull()).groupBy("grp", "h", "idx").agg(F.count("*").alias("_copies"))
    live = _alive(versions, asked.select("grp", "h", "idx"), ["grp", "h"], hot_rows, bound)
    taken = attach(asked, live, ["grp", "h", "idx"], ["alive_n"]).select(
        "grp", "idx", "h", F.least("_copies", "alive_n").alias("_taken")
    )

    # Whole states go: the running digest of the group at that step.
    running = deltas.unionByName(_zero(whole)).groupBy("grp", "idx").agg(F.sum("h").alias("h"), F.sum("n").alias("n"))
    running = running_sums(running, ["grp"], ["idx"], {"state_h": "h", "state_n": "n"}, hot_rows, bound)
    cleared = attach(whole, running, ["grp", "idx"], ["state_h", "state_n"])

    def part(df: DataFrame, h: Column, n: Column) -> DataFrame:
        return df.select("grp", "idx", h.cast("decimal(38,0)").alias("h"), n.cast("bigint").alias("n"))

    balance = (
        part(deltas, F.col("h"), F.col("n"))
        .unionByName(part(comes, F.col("h"), F.col("n")))
        .unionByName(part(gone, -F.col("alive_h"), -F.col("alive_n")))
        .unionByName(part(taken, -F.col("h") * F.col("_taken"), -F.col("_taken")))
        .unionByName(part(cleared, -F.col("state_h"), -F.col("state_n")))
        .groupBy("grp", "idx")
        .agg(F.sum("h").alias("_h"), F.sum("n").alias("_n"))
    )
    flagged = undone.withColumn("_undone", F.lit(True))
    joined = attach(attach(steps, flagged, ["grp", "idx"], ["_undone"]), balance, ["grp", "idx"], ["_h", "_n"])
    even = (F.coalesce("_h", F.lit(0)) == 0) & (F.coalesce("_n", F.lit(0)) == 0)
    skipped = F.col("_undone").isNull()
    return joined.select(
        "grp",
        "idx",
        "mode",
        F.when(skipped, "skipped").when(even, "checked").otherwise("mismatch").alias("status"),
        F.when(skipped, F.lit(0)).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("surplus_rows"),
    )
