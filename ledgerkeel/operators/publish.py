"""Desired artifacts of a ledger, and what of them must be written.

Artifacts are DataFrame[grp, entry, payload]. Only digests are compared: the
payloads of unchanged artifacts are hashed where they lie and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StateError
from ..functions.digests import SHA2, ensure_newline, packed, payload_digest
from ..functions.entries import ENTRY_SUFFIX
from .ledger import DEFAULT_POLICY, LedgerPolicy


def carry_forward(
    plan: DataFrame, steps: DataFrame, stored: DataFrame, recomputed: DataFrame
) -> DataFrame:
    """Snapshot of every step: stored up to the anchor, recomputed after it.

    ``stored`` and ``recomputed`` are grp, entry, payload. DataFrame[grp, idx,
    entry, payload, origin]; a step without its snapshot keeps a null payload,
    see ``snapshot_gaps``.
    """
    anchors = plan.select("grp", "anchor_index")
    wanted = steps.join(anchors, "grp").select(
        "grp",
        "idx",
        F.col("snapshot_entry").alias("entry"),
        F.when(F.col("idx") <= F.col("anchor_index"), F.lit("carried")).otherwise(F.lit("replayed")).alias("origin"),
    )
    offered = stored.select("grp", "entry", "payload", F.lit("carried").alias("origin")).unionByName(
        recomputed.select("grp", "entry", "payload", F.lit("replayed").alias("origin"))
    )
    return wanted.join(offered, ["grp", "entry", "origin"], "left").select(
        "grp", "idx", "entry", "payload", "origin"
    )


def snapshot_gaps(carried: DataFrame) -> DataFrame:
    return carried.where(F.col("payload").isNull()).select("grp", "idx", "entry", "origin")


def require_no_gaps(carried: DataFrame) -> None:
    gap = snapshot_gaps(carried).first()
    if gap is not None:
        raise StateError(f"{gap['grp']!r}: no {gap['origin']} snapshot {gap['entry']}")


def ledger_lines(headers: DataFrame, locked: DataFrame) -> DataFrame:
    """A ledger as artifact rows: one for the header, one per step.

    One artifact per row keeps long ledgers out of a single value.
    """
    head = headers.select(
        "grp",
        F.lit("ledger/header.json").alias("entry"),
        F.to_json(F.struct(*sorted(c for c in headers.columns if c != "grp"))).alias("payload"),
    )
    step = locked.select(
        "grp",
        F.concat(F.lit("ledger/"), F.lpad(F.col("idx").cast("string"), 12, "0"), F.lit(".json")).alias("entry"),
        F.to_json(F.struct(*sorted(c for c in locked.columns if c != "grp"))).alias("payload"),
    )
    return head.unionByName(step)


def desired_artifacts(
    carried: DataFrame,
    heads: DataFrame,
    headers: DataFrame,
    locked: DataFrame,
    policy: LedgerPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Head snapshot, ledger rows and one snapshot per step of every group."""
    missing = F.raise_error(F.concat(F.lit("no snapshot for "), F.col("entry")))
    snapshots = carried.select(
        "grp",
        "entry",
        F.when(F.col("payload").isNotNull(), ensure_newline(F.col("payload").cast("string")))
        .otherwise(missing)
        .alias("payload"),
    )
    head = heads.select(
        "grp",
        F.lit(policy.schema_file).alias("entry"),
        ensure_newline(F.col("payload").cast("string")).alias("payload"),
    )
    return head.unionByName(ledger_lines(headers, locked)).unionByName(snapshots)


def _digests(artifacts: DataFrame, keys: list[str], name: str, algorithm: str) -> DataFrame:
    return artifacts.select(*keys, packed(payload_digest(F.col("payload"), algorithm)).alias(name))


def publish_delta(
    desired: DataFrame,
    stored: DataFrame,
    prunable: str = DEFAULT_POLICY.checkpoints_dir,
    algorithm: str = SHA2,
    extra: list[str] | None = None,
) -> DataFrame:
    """DataFrame[grp, entry, action]: write, delete or keep.

    ``write`` when an artifact is new or differs; ``delete`` for stored snapshots
    (entries below ``prunable``) that are no longer wanted; other stored entries
    nobody asks for are kept. ``extra`` columns that follow from the group (the
    partition of a stored table) come along.
    """
    keys = ["grp", "entry", *(extra or [])]
    want = _digests(desired, keys, "_want", algorithm)
    have = _digests(stored, keys, "_have", algorithm)
    return want.join(have, keys, "full_outer").select(*keys, _action(prunable).alias("action"))


def _action(prunable: str) -> Column:
    snapshot = F.startswith(F.col("entry"), F.lit(f"{prunable}/")) & F.endswith(F.col("entry"), F.lit(ENTRY_SUFFIX))
    unwanted = F.when(snapshot, F.lit("delete")).otherwise(F.lit("keep"))
    return (
        F.when(F.col("_want").isNull(), unwanted)
        .when(F.col("_have").eqNullSafe(F.col("_want")), F.lit("keep"))
        .otherwise(F.lit("write"))
    )


def apply_delta(desired: DataFrame, stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored artifacts after the delta, in pure form."""
    written = delta.where(F.col("action") == "write").select("grp", "entry")
    touched = delta.where(F.col("action") != "keep").select("grp", "entry")
    kept = stored.join(touched, ["grp", "entry"], "left_anti")
    fresh = desired.join(written, ["grp", "entry"], "left_semi")
    columns = stored.columns
    return kept.select(*columns).unionByName(fresh.select(*columns))


def apply_result(delta: DataFrame) -> DataFrame:
    """Changed entries, sorted: DataFrame[grp, entry, action]."""
    return delta.where(F.col("action") != "keep").orderBy("grp", "entry")


def apply_summary(delta: DataFrame) -> DataFrame:
    """DataFrame[grp, wrote, changed, kept] over all groups of the delta."""
    changed = F.count_if(F.col("action") != "keep")
    return delta.groupBy("grp").agg(
        (changed > 0).alias("wrote"),
        changed.alias("changed"),
        F.count_if(F.col("action") == "keep").alias("kept"),
    )


def check_delta_overlap(writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """DataFrame[grp, entry, problem]: duplicate_write, write_and_delete.

    A repeated delete is fine. Both sides are counted in one aggregate.
    """
    both = writes.select("grp", "entry", F.lit(1).alias("w"), F.lit(0).alias("d")).unionByName(
        deletes.select("grp", "entry", F.lit(0).alias("w"), F.lit(1).alias("d"))
    )
    counts = both.groupBy("grp", "entry").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("w") > 1, F.lit("duplicate_write")),
            F.when((F.col("w") > 0) & (F.col("d") > 0), F.lit("write_and_delete")),
        )
    )
    return counts.select("grp", "entry", F.explode(problems).alias("problem"))


def require_no_overlap(writes: DataFrame, deletes: DataFrame) -> None:
    bad = check_delta_overlap(writes, deletes).first()
    if bad is not None:
        raise StateError(f"{bad['grp']!r}: {bad['entry']}: {bad['problem']}")
