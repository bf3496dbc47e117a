"""Comparison of step histories and of applied logs against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LedgerError, StateError
from ..functions.digests import packed, unpacked
from ..functions.entries import is_path_like, status_basename, status_path
from ..functions.sections import valid_text
from ..session import written
from . import findings as codes
from .fetch import requested_rows

SIGNATURE = ("version", "entry", "payload_digest")

# How a divergence names the field that differs.
FIELD_NAMES = {
    "version": "version",
    "entry": "migration_file",
    "payload_digest": "migration_digest",
}


def first_divergence(base: DataFrame, head: DataFrame) -> DataFrame:
    """First position where two step lists of a group differ.

    DataFrame[grp, divergence_index, field, base_value, head_value], one row per
    diverging group. Steps meet on (grp, idx), which is unique on each side, so
    no task depends on the size of a group; the per-group minimum and the two
    lengths come from one aggregate with map-side partials.
    """
    # Digests meet as their 32 bytes.
    narrow = F.struct("version", "entry", packed(F.col("payload_digest")).alias("payload_digest"))
    left = base.select("grp", "idx", narrow.alias("b"))
    right = head.select("grp", "idx", narrow.alias("h"))
    b, h = F.col("b"), F.col("h")
    differing = F.when(b.isNull() | h.isNull(), _difference("step_count", F.lit(None), F.lit(None)))
    for name in SIGNATURE:
        texts = [unpacked(side[name]) if name == "payload_digest" else side[name] for side in (b, h)]
        differing = differing.when(~b[name].eqNullSafe(h[name]), _difference(FIELD_NAMES[name], *texts))
    joined = left.join(right, ["grp", "idx"], "full_outer")
    per_group = (
        joined.select("grp", "idx", b.isNotNull().alias("in_base"), h.isNotNull().alias("in_head"), differing.alias("d"))
        .groupBy("grp")
        .agg(
            F.min(F.when(F.col("d").isNotNull(), F.struct("idx", "d"))).alias("first"),
            F.count_if("in_base").alias("n_base"),
            F.count_if("in_head").alias("n_head"),
        )
        .where(F.col("first").isNotNull())
    )
    d = F.col("first")["d"]
    by_count = d["field"] == "step_count"
    return per_group.select(
        "grp",
        F.col("first")["idx"].alias("divergence_index"),
        d["field"].alias("field"),
        F.when(by_count, F.col("n_base").cast("string")).otherwise(d["base_value"]).alias("base_value"),
        F.when(by_count, F.col("n_head").cast("string")).otherwise(d["head_value"]).alias("head_value"),
    )


def _difference(field: str, base_value: Column, head_value: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        base_value.cast("string").alias("base_value"),
        head_value.cast("string").alias("head_value"),
    )


def _renamed(groups: DataFrame, base_name: str, head_name: str) -> DataFrame:
    return groups.where(~F.col(base_name).eqNullSafe(F.col(head_name))).select(
        "grp",
        F.lit(1).cast("bigint").alias("divergence_index"),
        F.lit("target_name").alias("field"),
        F.col(base_name).cast("string").alias("base_value"),
        F.col(head_name).cast("string").alias("head_value"),
    )


def ledger_divergence(headers: DataFrame, locked: DataFrame, steps: DataFrame) -> DataFrame:
    """Stored steps against input steps; another stored target diverges at 1.

    ``locked`` uses its order of arrival ``pos`` as position, as a stored list
    does. Groups without a header have an empty base.
    """
    named = headers.select("grp", "target", F.col("grp").cast("string").alias("_own"))
    renamed = _renamed(named, "target", "_own")
    base = _positions(locked)
    stepwise = first_divergence(base, steps).join(renamed.select("grp"), "grp", "left_anti")
    return renamed.unionByName(stepwise)


def _positions(locked: DataFrame) -> DataFrame:
    if "pos" not in locked.columns:
        return locked
    from .ordering import ordinal

    narrow = locked.select("grp", "pos", *SIGNATURE)
    return ordinal(narrow, ["grp"], ["pos"], "idx")


def state_divergence(
    base: DataFrame,
    head: DataFrame,
    base_findings: DataFrame | None = None,
    head_findings: DataFrame | None = None,
    base_groups: DataFrame | None = None,
    head_groups: DataFrame | None = None,
) -> DataFrame:
    """Input steps of two states. With findings given both must be clean.

    With groups (grp, target) given for both, a group whose target names differ
    diverges there, at 1, and its steps are not compared.
    """
    for found in (base_findings, head_findings):
        if found is not None and not found.isEmpty():
            raise LedgerError("cannot compare histories that have findings")
    stepwise = first_divergence(base, head)
    if base_groups is None or head_groups is None:
        return stepwise
    renamed = target_divergence(base_groups, head_groups)
    return renamed.unionByName(stepwise.join(renamed.select("grp"), "grp", "left_anti").select(*renamed.columns))


def prefix_check(steps: DataFrame, applied: DataFrame) -> DataFrame:
    """Whether the applied list of a group equals its leading steps.

    ``applied`` is grp, pos, entry. DataFrame[grp, style, applied_count, status];
    status is ``ok``, ``mixed_styles``, ``duplicate_basenames`` or ``not_prefix``.
    Applied rows beyond the last step are not compared. Aggregating first per
    basename and then per group keeps every shuffle small after map-side partials.
    """
    prefix = steps.select("grp", F.col("idx").alias("pos"), F.col("entry").alias("step"))
    joined = applied.join(prefix, ["grp", "pos"], "left")
    compared = F.col("step").isNotNull()
    per_name = (
        joined.withColumn("_base", status_basename(F.col("step")))
        .groupBy("grp", "_base")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(compared).alias("compared"),
            F.count_if(is_path_like(F.col("entry"))).alias("paths"),
            F.count_if(compared & (status_path(F.col("entry")) != status_path(F.col("step")))).alias("off_path"),
            F.count_if(compared & (status_basename(F.col("entry")) != F.col("_base"))).alias("off_base"),
        )
    )
    per_group = per_name.groupBy("grp").agg(
        *[F.sum(c).alias(c) for c in ("rows", "paths", "off_path", "off_base")],
        F.max("compared").alias("most_alike"),
    )
    style = (
        F.when(F.col("paths") == 0, F.lit("basename"))
        .when(F.col("paths") == F.col("rows"), F.lit("path"))
        .otherwise(F.lit("mixed"))
    )
    status = (
        F.when(F.col("style") == "mixed", F.lit("mixed_styles"))
        .when((F.col("style") == "basename") & (F.col("most_alike") > 1), F.lit("duplicate_basenames"))
        .when(
            F.when(F.col("style") == "path", F.col("off_path")).otherwise(F.col("off_base")) > 0,
            F.lit("not_prefix"),
        )
        .otherwise(F.lit("ok"))
    )
    return per_group.withColumn("style", style).select(
        "grp", "style", F.col("rows").alias("applied_count"), status.alias("status")
    )


def live_relation(steps: DataFrame, applied: DataFrame) -> DataFrame:
    """DataFrame[grp, head_count, applied_count, relation]: behind, equal or ahead.

    One union and one aggregate: both counts shrink before the shuffle and
    groups known to only one side are kept.
    """
    own = steps.select("grp", F.lit(1).alias("h"), F.lit(0).alias("a"))
    live = applied.select("grp", F.lit(0).alias("h"), F.lit(1).alias("a"))
    counts = own.unionByName(live).groupBy("grp").agg(
        F.sum("h").alias("head_count"), F.sum("a").alias("applied_count")
    )
    relation = (
        F.when(F.col("applied_count") < F.col("head_count"), F.lit("behind"))
        .when(F.col("applied_count") > F.col("head_count"), F.lit("ahead"))
        .otherwise(F.lit("equal"))
    )
    return counts.withColumn("relation", relation)


def require_not_ahead(relation: DataFrame, context: str) -> None:
    ahead = relation.where(F.col("relation") == "ahead").select("grp").first()
    if ahead is not None:
        raise StateError(f"{context}: live state of {ahead['grp']!r} is ahead of its history")


def require_prefix(checked: DataFrame, context: str) -> None:
    bad = checked.where(F.col("status") != "ok").first()
    if bad is not None:
        raise StateError(f"{context}: applied list of {bad['grp']!r} is not usable: {bad['status']}")


def anchor_tail(
    steps: DataFrame, divergence: DataFrame, clean: bool = False, findings: DataFrame | None = None
) -> DataFrame:
    """DataFrame[grp, step_count, divergence_index, anchor_index, tail_count].

    With ``findings`` of the ledger state, groups that have a fatal one are not planned
    and have no row; ``blocked_groups`` lists them.

    Without divergence the anchor is the last step and the tail is empty;
    ``clean`` replays every group from its first step. Groups that lost all their
    steps are listed too, with nothing to replay.
    """
    if findings is not None:
        blocked = blocked_groups(findings).select("grp")
        steps = steps.join(blocked, "grp", "left_anti")
        divergence = divergence.join(blocked, "grp", "left_anti")
    counts = steps.groupBy("grp").agg(F.count("*").alias("step_count"))
    if clean:
        found = counts.withColumn("divergence_index", F.lit(1).cast("bigint"))
    else:
        found = counts.join(divergence.select("grp", "divergence_index"), "grp", "full_outer")
    total = F.coalesce("step_count", F.lit(0))
    anchor = F.coalesce(F.col("divergence_index") - 1, total)
    return found.select(
        "grp",
        total.alias("step_count"),
        "divergence_index",
        anchor.alias("anchor_index"),
        F.greatest(total - anchor, F.lit(0)).alias("tail_count"),
    )


def blocked_groups(findings: DataFrame) -> DataFrame:
    """DataFrame[grp, code]: groups that must not be planned, with the first of their fatal codes."""
    fatal = findings.where(F.col("code").isin(*codes.FATAL))
    return fatal.groupBy("grp").agg(F.min("code").alias("code"))


def tail_steps(steps: DataFrame, plan: DataFrame) -> DataFrame:
    """Steps after the anchor."""
    anchors = plan.select("grp", "anchor_index")
    return steps.join(anchors, "grp").where(F.col("idx") > F.col("anchor_index")).drop("anchor_index")


def select_anchor(plan: DataFrame, steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshot each group is anchored at, from the side ``steps`` belong to.

    DataFrame[grp, anchor_index, snapshot_entry, payload, error]; groups anchored
    at 0 start from nothing and have no row. ``error`` is ``no_step`` when the
    side has too few steps and ``no_snapshot`` when the snapshot is missing.
    """
    wanted = plan.where(F.col("anchor_index") > 0).select("grp", "anchor_index")
    named = steps.select("grp", F.col("idx").alias("anchor_index"), "snapshot_entry")
    placed = written(wanted.join(named, ["grp", "anchor_index"], "left"), "anchors")
    texts = snapshots.select("grp", F.col("entry").alias("snapshot_entry"), "payload")
    texts = requested_rows(texts, placed, ["grp", "snapshot_entry"])
    texts = texts.select("grp", "snapshot_entry", valid_text(F.col("payload")).alias("payload"))
    error = F.when(F.col("snapshot_entry").isNull(), F.lit("no_step")).when(
        F.col("payload").isNull(), F.lit("no_snapshot")
    )
    return placed.join(texts, ["grp", "snapshot_entry"], "left").select(
        "grp", "anchor_index", "snapshot_entry", "payload", error.alias("error")
    )


def expected_at(
    requests: DataFrame, steps: DataFrame, snapshots: DataFrame, heads: DataFrame, zero: str = ""
) -> DataFrame:
    """Expected snapshot text of each requested (grp, index).

    0 is the zero baseline, the last index the head snapshot, others the step's
    snapshot. DataFrame[grp, index, source, payload, error] with error
    ``out_of_range``, ``missing`` or ``not_utf8``. Requests are placed first, by
    paths alone; snapshots and heads are filtered by them in their scans (``fetch``).
    """
    counts = steps.groupBy("grp").agg(F.count("*").alias("_n"))
    named = steps.select("grp", F.col("idx").alias("index"), "snapshot_entry")
    head = heads.select("grp", F.col("payload").cast("binary").alias("_head"))
    n = F.coalesce("_n", F.lit(0))
    ranged = requests.select("grp", "index").join(counts, "grp", "left")
    source = (
        F.when((F.col("index") < 0) | (F.col("index") > n), F.lit(None))
        .when(F.col("index") == 0, F.lit("zero"))
        .when(F.col("index") == n, F.lit("head"))
        .otherwise(F.lit("snapshot"))
    )
    placed = written(ranged.withColumn("source", source).join(named, ["grp", "index"], "left"), "requests")
    asked = placed.where(F.col("source") == "snapshot").select("grp", F.col("snapshot_entry").alias("entry"))
    texts = requested_rows(
        snapshots.select("grp", "entry", F.col("payload").cast("binary").alias("_snap")), asked, ["grp", "entry"]
    )
    head = requested_rows(head, placed.where(F.col("source") == "head"), ["grp"])
    joined = placed.join(texts.withColumnRenamed("entry", "snapshot_entry"), ["grp", "snapshot_entry"], "left").join(
        head, "grp", "left"
    )
    raw = (
        F.when(F.col("source") == "zero", F.lit(zero).cast("binary"))
        .when(F.col("source") == "head", F.col("_head"))
        .when(F.col("source") == "snapshot", F.col("_snap"))
    )
    payload = valid_text(raw)
    error = (
        F.when(F.col("source").isNull(), F.lit("out_of_range"))
        .when(raw.isNull(), F.lit("missing"))
        .when(payload.isNull(), F.lit("not_utf8"))
    )
    return joined.select("grp", "index", "source", payload.alias("payload"), error.alias("error"))


def target_divergence(base_groups: DataFrame, head_groups: DataFrame) -> DataFrame:
    """States compared under one ``grp`` whose target names differ."""
    joined = base_groups.select("grp", F.col("target").alias("_b")).join(
        head_groups.select("grp", F.col("target").alias("_h")), "grp"
    )
    return _renamed(joined, "_b", "_h")
