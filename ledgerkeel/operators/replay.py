"""Replay of ordered change-sets over an anchor state.

Frames:

* changes  grp, idx, mode, key columns, value columns; a change-set is all rows
           of one (grp, idx) and has one mode: ``replace``, ``insert`` or ``upsert``
* sets     grp, idx, mode: one row per change-set. Derived from the changes when
           not given; give it when change-sets may be empty (an empty replace
           still clears the group)
* anchor   grp, key columns, value columns; optional ``idx``, 0 when absent

A row lives from its change-set until the next replace of its group or the next
upsert of its key, whichever comes first. These validity ranges answer every
question about past states without building one full copy per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StateError
from .compare import equal_states
from .history import blocked_groups
from .ordering import HOT_ROWS, attach, dealt, group_sizes, nearest, nearest_flagged, running_sum


def change_sets(changes: DataFrame) -> DataFrame:
    return changes.select("grp", "idx", "mode").distinct()


def _with_anchor(changes: DataFrame, anchor: DataFrame | None) -> DataFrame:
    if anchor is None:
        return changes
    start = anchor if "idx" in anchor.columns else anchor.withColumn("idx", F.lit(0).cast("bigint"))
    return changes.unionByName(start.withColumn("mode", F.lit("insert")))


def validity_ranges(
    changes: DataFrame,
    key: list[str],
    anchor: DataFrame | None = None,
    sets: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every row version with ``valid_from`` and ``valid_to`` (exclusive, null = open).

    One shuffle by (grp, key) finds the next upsert of the key. Group-wide
    replaces are looked for first; with some, and groups up to ``hot_rows``, rows are dealt by
    group instead, for both. A null key matches no upsert, so such rows live until a replace.
    """
    rows = _with_anchor(changes, anchor)
    has_key = ~_any_null(key)
    upserts = (F.col("mode") == "upsert") & has_key
    all_sets = change_sets(changes) if sets is None else sets
    largest, total = group_sizes(rows, ["grp"])
    bound = largest if largest <= hot_rows else None
    replaces = (changes if sets is None else sets).where(F.col("mode") == "replace")
    none = replaces.isEmpty()
    if not none and bound is not None and (sets is None or largest + group_sizes(replaces, ["grp"])[0] <= hot_rows):
        return _ranges_by_group(rows, upserts, has_key, key, None if sets is None else replaces, total)
    # Spread by key even where the input already lies by group: a group may be very large.
    rows = dealt(rows, ["grp", *key], total, always=True)
    timed = nearest_flagged(rows, ["grp", *key], "idx", upserts, "_upsert", hot_rows=hot_rows, largest=bound)
    ended = F.when(has_key, F.col("_upsert"))
    if none:
        dated = timed.withColumn("valid_to", ended)
    else:
        replaced = next_replace(all_sets, rows, hot_rows)
        dated = (
            attach(timed, replaced, ["grp", "idx"], ["_replace"])
            .withColumn("valid_to", F.least(ended, F.col("_replace")))
            .drop("_replace")
        )
    return dated.drop("_upsert").withColumnRenamed("idx", "valid_from")


def _ranges_by_group(
    rows: DataFrame, upserts: Column, has_key: Column, key: list[str], replaces: DataFrame | None, total: int
) -> DataFrame:
    """``validity_ranges`` where a group fits a task: one shuffle, two windows, no join.

    ``replaces`` are change-sets, empty ones too; without them the rows' own modes say where replaces are.
    """
    own = rows.withColumn("_row", F.lit(True))
    if replaces is not None:
        own = own.unionByName(replaces.select("grp", "idx", "mode", F.lit(False).alias("_row")), allowMissingColumns=True)
    lying = dealt(own, ["grp"], total, always=True)
    by_key = nearest(["grp", *key], "idx", F.when(upserts, F.col("idx")), True)
    by_group = nearest(["grp"], "idx", F.when(F.col("mode") == "replace", F.col("idx")), True)
    timed = lying.withColumn("_upsert", F.when(has_key, by_key)).withColumn("_replace", by_group).where("_row")
    dated = timed.withColumn("valid_to", F.least("_upsert", "_replace"))
    return dated.drop("_upsert", "_replace", "_row").withColumnRenamed("idx", "valid_from")


def _any_null(columns: list[str]) -> Column:
    found = F.lit(False)
    for name in columns:
        found = found | F.col(name).isNull()
    return found


def next_replace(sets: DataFrame, rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """DataFrame[grp, idx, _replace]: the next replace after each (grp, idx) in use."""
    points = sets.unionByName(
        rows.select("grp", "idx").distinct().withColumn("mode", F.lit("point"))
    )
    marked = points.groupBy("grp", "idx").agg(F.bool_or(F.col("mode") == "replace").alias("_r"))
    return nearest_flagged(marked, ["grp"], "idx", F.col("_r"), "_replace", hot_rows=hot_rows).drop("_r")


def state_at(ranges: DataFrame, at: Column | int | None = None) -> DataFrame:
    """Rows alive after step ``at``; the last step when not given."""
    if at is None:
        alive = F.col("valid_to").isNull()
    else:
        k = F.lit(at) if isinstance(at, int) else at
        alive = (F.col("valid_from") <= k) & (F.col("valid_to").isNull() | (F.col("valid_to") > k))
    return ranges.where(alive).drop("valid_from", "valid_to", "mode")


def replay_tail(
    changes: DataFrame, key: list[str], anchor: DataFrame | None = None, sets: DataFrame | None = None
) -> DataFrame:
    """State after the last change-set.

    Only two facts decide about a row: the last replace of its group and the last upsert of
    its key. Both are maxima with map-side partials, so a group or key with a third of all rows
    collapses in every task. Rows from before the last replace leave first; the others meet the
    last upsert of their key in an equi-join whose row side Spark may split, or which it turns
    into a broadcast. There is no window and nothing is sorted by time.
    """
    rows = _with_anchor(changes, anchor)
    replaces = changes if sets is None else sets
    last = _latest(replaces.where(F.col("mode") == "replace"), ["grp"], "_replace")
    rows = attach(rows, last, ["grp"], ["_replace"]).where(_not_before("_replace")).drop("_replace")
    keyed = rows.where((F.col("mode") == "upsert") & ~_any_null(key))
    last = _latest(keyed, ["grp", *key], "_upsert")
    # A null key matches no upsert; plain equality keeps such rows out of the match, group by group.
    same = F.col("grp").eqNullSafe(F.col("_of"))
    for i, name in enumerate(key):
        same = same & (F.col(name) == F.col(f"_key_{i}"))
    other = last.select(
        F.col("grp").alias("_of"), *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)], "_upsert"
    )
    alive = rows.join(other, same, "left").where(_not_before("_upsert"))
    return alive.select(*[c for c in rows.columns if c not in ("idx", "mode")])


def _latest(rows: DataFrame, group: list[str], name: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.max("idx").alias(name))


def _not_before(limit: str) -> Column:
    return F.col(limit).isNull() | (F.col("idx") >= F.col(limit))


def replay_upserts(changes: DataFrame, key: list[str], anchor: DataFrame | None = None) -> DataFrame:
    """State after an upsert-only tail whose change-sets have unique keys.

    The latest row per key is an aggregate: a key that changes very often
    collapses on the map side, so it needs no window and no large group.
    """
    rows = _with_anchor(changes, anchor).drop("mode")
    keys = ["grp", *key]
    values = [c for c in rows.columns if c not in (*keys, "idx")]
    latest = F.max_by(F.struct(*values), "idx").alias("_row")
    return rows.groupBy(*keys).agg(latest).select(*keys, "_row.*")


def capture_checkpoints(
    changes: DataFrame,
    key: list[str],
    anchor: DataFrame | None = None,
    sets: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The state after every change-set, as validity ranges."""
    return validity_ranges(changes, key, anchor, sets, hot_rows)


def checkpoint_sizes(ranges: DataFrame, sets: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """DataFrame[grp, idx, rows]: number of live rows after each change-set.

    Births and deaths are summed per step first; the running total then has one
    row per change-set, however many rows the sets hold.
    """
    born = ranges.select("grp", F.col("valid_from").alias("idx"), F.lit(1).alias("d"))
    died = ranges.where(F.col("valid_to").isNotNull()).select(
        "grp", F.col("valid_to").alias("idx"), F.lit(-1).alias("d")
    )
    steps = sets.select("grp", "idx", F.lit(0).alias("d"))
    deltas = born.unionByName(died).unionByName(steps).groupBy("grp", "idx").agg(F.sum("d").alias("d"))
    counted = running_sum(deltas, ["grp"], ["idx"], "d", "rows", hot_rows)
    return counted.join(sets.select("grp", "idx").distinct(), ["grp", "idx"]).select("grp", "idx", "rows")


def rollback_roundtrip(
    changes: DataFrame,
    inverses: DataFrame,
    key: list[str],
    anchor: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Check each step's inverse: DataFrame[grp, idx, status, wrong_keys].

    Steps are keyed upserts with unique keys. ``inverses`` has grp, idx, op
    (``upsert`` or ``delete``), key and value columns. Rolling back step ``idx``
    must give the state before it. Only keys the step or its inverse touches can
    differ, so each such key is looked at once: its row before the step against
    its row after the roll-back. ``status`` is ``checked``, ``mismatch`` or, for
    a step without inverse, ``skipped``.
    """
    keys = ["grp", *key]
    rows = _with_anchor(changes, anchor).drop("mode")
    values = [c for c in rows.columns if c not in (*keys, "idx")]
    versions = rows.select(*keys, "idx", F.struct(*values).alias("_row"))
    undo = inverses.select(
        *keys, "idx", F.struct("op", F.struct(*values).alias("row")).alias("_undo")
    )
    touched = versions.join(undo, [*keys, "idx"], "full_outer")
    touched = nearest_flagged(
        touched, keys, "idx", F.col("_row").isNotNull(), "_before", ahead=False, hot_rows=hot_rows
    )
    before = versions.select(*keys, F.col("idx").alias("_before"), F.col("_row").alias("_old"))
    joined = touched.join(before, [*keys, "_before"], "left")
    after_step = F.coalesce("_row", "_old")
    rolled = (
        F.when(F.col("_undo").isNull(), after_step)
        .when(F.col("_undo")["op"] == "upsert", F.col("_undo")["row"])
    )
    steps = changes.select("grp", "idx").distinct()
    # Anchor rows (an index no change-set has) are not steps.
    per_step = joined.select(
        "grp",
        "idx",
        F.col("_undo").isNotNull().alias("has_undo"),
        (~rolled.eqNullSafe(F.col("_old"))).alias("wrong"),
    ).groupBy("grp", "idx").agg(
        F.bool_or("has_undo").alias("reversible"), F.count_if("wrong").alias("wrong_keys")
    )
    status = (
        F.when(~F.coalesce("reversible", F.lit(False)), F.lit("skipped"))
        .when(F.col("wrong_keys") > 0, F.lit("mismatch"))
        .otherwise(F.lit("checked"))
    )
    return steps.join(per_step, ["grp", "idx"], "left").select(
        "grp",
        "idx",
        status.alias("status"),
        F.when(status == "skipped", F.lit(0)).otherwise(F.col("wrong_keys")).cast("bigint").alias("wrong_keys"),
    )


def bootstrap(head: DataFrame, applied: DataFrame) -> DataFrame:
    """Rows to load for groups with nothing applied: their head state directly.

    ``applied`` is grp, applied_count; groups it does not list are empty.
    """
    busy = applied.where(F.col("applied_count") > 0).select("grp")
    return head.join(busy, "grp", "left_anti").select(*head.columns)


def bootstrap_status(steps: DataFrame, applied: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """DataFrame[grp, before_index, after_index, status]: loaded, refused, or no_head.

    With ``heads`` (grp), a group that is not among them has nothing to load.
    """
    sizes = steps.groupBy("grp").agg(F.count("*").alias("_n"))
    before = F.coalesce("applied_count", F.lit(0))
    joined = sizes.join(applied.select("grp", "applied_count"), "grp", "left")
    known = F.lit(True)
    if heads is not None:
        joined = joined.join(heads.select("grp").distinct().withColumn("_head", F.lit(True)), "grp", "left")
        known = F.col("_head").isNotNull()
    status = F.when(before > 0, F.lit("refused")).when(known, F.lit("loaded")).otherwise(F.lit("no_head"))
    return joined.select(
        "grp",
        before.alias("before_index"),
        F.when(status == "loaded", F.col("_n")).otherwise(before).alias("after_index"),
        status.alias("status"),
    )


def apply_pending(
    live: DataFrame,
    changes: DataFrame,
    applied: DataFrame,
    key: list[str],
    sets: DataFrame | None = None,
    create_missing: bool = True,
) -> DataFrame:
    """State after running the steps beyond each group's applied count on its live rows.

    ``applied`` is grp, applied_count. A group it does not list has no target
    yet: it starts empty with ``create_missing`` and is left out otherwise.
    """
    counts = applied.select("grp", "applied_count")
    how = "left" if create_missing else "inner"

    def pending(df: DataFrame) -> DataFrame:
        joined = df.join(counts, "grp", how)
        return joined.where(F.col("idx") > F.coalesce("applied_count", F.lit(0))).select(*df.columns)

    todo = pending(changes)
    return replay_tail(todo, key, live, None if sets is None else pending(sets))


def pending_status(steps: DataFrame, relation: DataFrame, prefix: DataFrame) -> DataFrame:
    """DataFrame[grp, before_index, after_index, status] of ``apply_pending``.

    Refused groups keep their index: no steps at all, an applied list that is
    not a prefix of the steps, or a live state ahead of them.
    """
    checked = prefix.select("grp", F.col("status").alias("_prefix"))
    joined = relation.join(checked, "grp", "left")
    status = (
        F.when(F.col("head_count") == 0, F.lit("no_steps"))
        .when(F.coalesce("_prefix", F.lit("ok")) != "ok", F.col("_prefix"))
        .when(F.col("relation") == "ahead", F.lit("ahead"))
        .when(F.col("relation") == "equal", F.lit("up_to_date"))
        .otherwise(F.lit("applied"))
    )
    done = status.isin("applied", "up_to_date")
    return joined.select(
        "grp",
        F.col("applied_count").alias("before_index"),
        F.when(done, F.col("head_count")).otherwise(F.col("applied_count")).alias("after_index"),
        status.alias("status"),
    )


def rollback(ranges: DataFrame, applied: DataFrame, steps: int = 1) -> DataFrame:
    """State of each group ``steps`` steps before its applied count, at least 0."""
    if steps <= 0:
        raise StateError("rollback needs a positive number of steps")
    targets = applied.select(
        "grp", F.greatest(F.col("applied_count") - steps, F.lit(0)).alias("_at")
    )
    return state_at(ranges.join(targets, "grp"), F.col("_at")).drop("_at")


def verified_equal(live: DataFrame, expected: DataFrame) -> DataFrame:
    """Groups whose states differ; empty when an operation reached its goal."""
    return equal_states(live, expected).where(~F.col("matches"))


def schema_plan(
    plan: DataFrame,
    replayed: DataFrame,
    committed: DataFrame,
    roundtrip: DataFrame | None = None,
    findings: DataFrame | None = None,
) -> DataFrame:
    """Replayed against committed head state of each group of ``plan`` (``anchor_tail``).

    Groups with a fatal finding among ``findings`` are left out, whatever ``plan`` holds.

    DataFrame[grp, divergence_index, anchor_index, tail_count, matches] and, with
    a round trip given, the numbers of checked, mismatching and skipped steps.
    """
    if findings is not None:
        plan = plan.join(blocked_groups(findings), "grp", "left_anti")
    compared = equal_states(replayed, committed).select("grp", "matches")
    summary = plan.join(compared, "grp", "left").select(
        "grp",
        "divergence_index",
        "anchor_index",
        "tail_count",
        F.coalesce("matches", F.lit(True)).alias("matches"),
    )
    if roundtrip is None:
        return summary
    counts = roundtrip.groupBy("grp").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("checked", "mismatch", "skipped")]
    )
    return summary.join(counts, "grp", "left").fillna(0, ["checked", "mismatch", "skipped"])
