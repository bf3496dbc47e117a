"""Operations on live states: up, migrate, down, bootstrap, with their guards.

A state is grp, key columns, value columns; an applied log is grp, pos, entry;
``steps`` are a history's steps and ``changes`` its change-sets by the same
index. Each operation works on all groups at once and returns the new state of
every group with a status row per group: a group a guard refuses keeps its rows
and says why, instead of stopping the others. With ``expected``, a state per group, each
operation ends with its check: the moved groups must be in that state (``verify``), or it raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StateError
from ..operators import coherence, compare, history, replay
from ..session import written


@dataclass(frozen=True)
class Outcome:
    """New state, and DataFrame[grp, before_index, after_index, status]."""

    state: DataFrame
    status: DataFrame


def _only(df: DataFrame, groups: DataFrame, how: str = "left_semi") -> DataFrame:
    return df.join(groups.select("grp"), "grp", how).select(*df.columns)


def up(
    live: DataFrame,
    changes: DataFrame,
    steps: DataFrame,
    applied: DataFrame,
    key: list[str],
    sets: DataFrame | None = None,
    create_missing: bool = True,
    findings: DataFrame | None = None,
    expected: DataFrame | None = None,
) -> Outcome:
    """Run the pending steps of every group that passes its guards.

    Guards: the group has steps, its applied list is a prefix of them and not
    ahead, and none of its ledger ``findings`` is fatal (``blocked``). With ``create_missing`` a group without any applied entry counts as a
    new, empty target; otherwise such a group is refused as ``missing``.
    """
    relation = history.live_relation(steps, applied)
    status = replay.pending_status(steps, relation, history.prefix_check(steps, applied))
    if not create_missing:
        absent = (F.col("before_index") == 0) & (F.col("status") == "applied")
        status = status.withColumn("after_index", F.when(absent, F.lit(0)).otherwise(F.col("after_index")))
        status = status.withColumn("status", F.when(absent, F.lit("missing")).otherwise(F.col("status")))
    status = written(_unless_fatal(status, findings), "status")
    going = status.where(F.col("status") == "applied")
    counts = going.select("grp", F.col("before_index").alias("applied_count"))
    own_sets = None if sets is None else _only(sets, going)
    moved = replay.apply_pending(_only(live, going), _only(changes, going), counts, key, own_sets)
    rest = _only(live, going, "left_anti")
    return _checked(Outcome(rest.unionByName(moved.select(*live.columns)), status), expected, "up")


def migrate(
    live: DataFrame,
    changes: DataFrame,
    steps: DataFrame,
    applied: DataFrame,
    key: list[str],
    sets: DataFrame | None = None,
    findings: DataFrame | None = None,
    expected: DataFrame | None = None,
) -> Outcome:
    """``up`` for targets that exist already."""
    return up(live, changes, steps, applied, key, sets, create_missing=False, findings=findings, expected=expected)


def down(
    live: DataFrame,
    ranges: DataFrame,
    steps: DataFrame,
    applied: DataFrame,
    count: int = 1,
    findings: DataFrame | None = None,
    expected: DataFrame | None = None,
) -> Outcome:
    """Step every group that passes its guards back ``count`` steps, at most to zero.

    A group with a fatal finding among ``findings`` is ``blocked``.
    """
    if count <= 0:
        raise StateError("rollback needs a positive number of steps")
    relation = history.live_relation(steps, applied)
    prefix = history.prefix_check(steps, applied).select("grp", F.col("status").alias("_prefix"))
    before = F.col("applied_count")
    verdict = (
        F.when(F.coalesce("_prefix", F.lit("ok")) != "ok", F.col("_prefix"))
        .when(F.col("relation") == "ahead", F.lit("ahead"))
        .when(before == 0, F.lit("at_zero"))
        .otherwise(F.lit("rolled_back"))
    )
    back = F.greatest(before - count, F.lit(0))
    status = relation.join(prefix, "grp", "left").select(
        "grp",
        before.alias("before_index"),
        F.when(verdict == "rolled_back", back).otherwise(before).alias("after_index"),
        verdict.alias("status"),
    )
    status = written(_unless_fatal(status, findings), "status")
    going = status.where(F.col("status") == "rolled_back")
    counts = going.select("grp", F.col("before_index").alias("applied_count"))
    moved = replay.rollback(ranges, counts, count)
    rest = _only(live, going, "left_anti")
    return _checked(Outcome(rest.unionByName(moved.select(*live.columns)), status), expected, "down")


def _unless_fatal(status: DataFrame, findings: DataFrame | None) -> DataFrame:
    """Groups that have a fatal finding do not move and are ``blocked``."""
    if findings is None:
        return status
    fatal = coherence.fatal_diagnostics(findings).select("grp").distinct().withColumn("_fatal", F.lit(True))
    joined = status.join(fatal, "grp", "left")
    blocked = F.col("_fatal").isNotNull()
    return joined.select(
        "grp",
        "before_index",
        F.when(blocked, F.col("before_index")).otherwise(F.col("after_index")).alias("after_index"),
        F.when(blocked, F.lit("blocked")).otherwise(F.col("status")).alias("status"),
    )


def bootstrap(
    live: DataFrame,
    head: DataFrame,
    steps: DataFrame,
    applied: DataFrame,
    heads: DataFrame | None = None,
    findings: DataFrame | None = None,
    expected: DataFrame | None = None,
) -> Outcome:
    """Load the head state of groups with nothing applied; others are refused.

    ``heads`` lists the groups that have a head snapshot; a group without one is
    ``no_head`` and stays as it is. Without ``heads`` a group without head rows is
    taken to have none. A group with a fatal finding is ``blocked``.
    """
    relation = history.live_relation(steps, applied)
    status = replay.bootstrap_status(steps, relation, head if heads is None else heads)
    status = written(_unless_fatal(status, findings), "status")
    loaded = status.where(F.col("status") == "loaded")
    rest = _only(live, loaded, "left_anti")
    return _checked(Outcome(rest.unionByName(_only(head, loaded).select(*live.columns)), status), expected, "bootstrap")


def _checked(outcome: Outcome, expected: DataFrame | None, context: str) -> Outcome:
    """The outcome, verified, and its state written so that what was checked is what is used."""
    if expected is None:
        return outcome
    outcome = Outcome(written(outcome.state, "state"), outcome.status)
    verify(outcome, expected, context)
    return outcome


def verify(outcome: Outcome, expected: DataFrame, context: str) -> None:
    """Raise unless every group the operation moved is in its expected state."""
    done = outcome.status.where(F.col("status").isin("applied", "rolled_back", "loaded"))
    columns = outcome.state.columns
    compare.verify_expected(
        _only(outcome.state, done), _only(expected.select(*columns), done), context
    )
