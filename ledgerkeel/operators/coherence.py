"""Checks of a stored ledger against its input: DataFrame[grp, code, path, detail].

``locked`` are stored steps: grp, pos (arrival order), idx, version, entry,
payload_digest, snapshot_entry, snapshot_digest, schema_digest, chain_hash.
``steps`` are the input's steps from ``ledger.build_steps``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import packed, text_digest, unpacked
from ..functions.entries import ENTRY_SUFFIX, companion_entry, entry_error, entry_value, entry_within, version_of
from ..functions.sections import valid_text
from ..session import written
from . import findings as codes
from . import ledger
from .ledger import DEFAULT_POLICY, LedgerPolicy
from .mutate import union_all
from .ordering import HOT_ROWS, dealt, group_sizes, largest_group, ordinal, repeats


def _when(failed: Column, code: str, path: Column, detail: Column | str) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(
        failed, F.struct(F.lit(code).alias("code"), path.alias("path"), text.alias("detail"))
    )


def _explode(df: DataFrame, checks: list[Column]) -> DataFrame:
    return df.select("grp", F.inline(F.array_compact(F.array(*checks))))


def _differs(name: Column, expected: str | int) -> Column:
    return ~name.eqNullSafe(F.lit(expected))


At = Callable[[str], Column]


def _header_rules(at: At, policy: LedgerPolicy) -> list[Column]:
    fields = (
        ("lock_version", policy.lock_version, codes.LOCKFILE_VERSION_MISMATCH),
        ("hash_algorithm", policy.hash_algorithm, codes.LOCKFILE_HASH_ALGORITHM_MISMATCH),
        ("canonicalizer", policy.canonicalizer, codes.LOCKFILE_CANONICALIZER_MISMATCH),
        ("schema_file", policy.schema_file, codes.LOCKFILE_SCHEMA_PATH_MISMATCH),
        ("migrations_dir", policy.migrations_dir, codes.LOCKFILE_MIGRATIONS_PATH_MISMATCH),
        ("checkpoints_dir", policy.checkpoints_dir, codes.LOCKFILE_CHECKPOINTS_PATH_MISMATCH),
    )
    return [
        _when(
            _differs(at(name), wanted),
            code,
            F.lit(codes.LEDGER_FILE),
            F.concat(F.lit(f"{name} is "), F.coalesce(at(name).cast("string"), F.lit("null")), F.lit(f", expected {wanted}")),
        )
        for name, wanted, code in fields
    ]


def check_header(headers: DataFrame, policy: LedgerPolicy = DEFAULT_POLICY) -> DataFrame:
    """Header fields that differ from the policy."""
    return _explode(headers, _header_rules(F.col, policy))


def _group_rules(at: At) -> list[Column]:
    detail = F.concat(F.lit("ledger target is "), at("target"))
    wrong = ~at("target").eqNullSafe(F.col("grp").cast("string"))
    return [_when(wrong, codes.COHERENCE_TARGET_MISMATCH, F.lit(codes.LEDGER_FILE), detail)]


def check_group(headers: DataFrame) -> DataFrame:
    """Headers whose target is not the group they are stored for."""
    return _explode(headers, _group_rules(F.col))


def _head_digest_rules(at: At, digest: Column, policy: LedgerPolicy) -> list[Column]:
    path = F.lit(policy.schema_file)
    return [
        _when(digest.isNull(), codes.INPUT_SCHEMA_MISSING, path, "head snapshot is missing"),
        _when(
            digest.isNotNull() & ~digest.eqNullSafe(at("head_schema_digest")),
            codes.COHERENCE_SCHEMA_DIGEST_MISMATCH,
            path,
            "head snapshot differs from the header digest",
        ),
    ]


def check_head_digest(
    headers: DataFrame, heads: DataFrame, policy: LedgerPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Head snapshots missing, or not the one the header names."""
    digests = heads.select(
        "grp", text_digest(valid_text(F.col("payload")), policy.hash_algorithm).alias("_digest")
    )
    joined = headers.select("grp", "head_schema_digest").join(digests, "grp", "left")
    return _explode(joined, _head_digest_rules(F.col, F.col("_digest"), policy))


def undecodable_snapshots(
    steps: DataFrame, snapshots: DataFrame, heads: DataFrame, policy: LedgerPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Snapshots of steps and head snapshots that are not UTF-8."""
    digested = ledger.digested_snapshots(snapshots, policy)
    bad = digested.where(F.col("snapshot_digest").isNull()).select("grp", "entry")
    used = bad.join(
        steps.select("grp", F.col("snapshot_entry").alias("entry")), ["grp", "entry"], "left_semi"
    )
    bad_heads = heads.where(~F.is_valid_utf8(F.col("payload").cast("string"))).select(
        "grp", F.lit(policy.schema_file).alias("entry")
    )
    return _labelled(used.unionByName(bad_heads), codes.INPUT_PATH_INVALID, "entry", "not UTF-8")


def _labelled(df: DataFrame, code: str, path: str, detail: str) -> DataFrame:
    return df.select(
        "grp", F.lit(code).alias("code"), F.col(path).alias("path"), F.lit(detail).alias("detail")
    )


def orphan_snapshots(steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots no step of the input maps to."""
    wanted = steps.select("grp", F.col("snapshot_entry").alias("entry"))
    orphans = snapshots.select("grp", "entry").join(wanted, ["grp", "entry"], "left_anti")
    return _labelled(orphans, codes.INPUT_ORPHAN_CHECKPOINT, "entry", "snapshot belongs to no entry")


def new_in_input(steps: DataFrame, locked: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Input steps the ledger does not have, of groups that have a ledger."""
    fresh = steps.select("grp", "entry").join(locked.select("grp", "entry"), ["grp", "entry"], "left_anti")
    if headers is not None:
        fresh = fresh.join(headers.select("grp"), "grp", "left_semi")
    return _labelled(fresh, codes.COHERENCE_NEW_IN_INPUT, "entry", "entry is not in the ledger")


def missing_from_input(steps: DataFrame, locked: DataFrame) -> DataFrame:
    """Ledger steps the input does not have."""
    gone = locked.select("grp", "entry").join(steps.select("grp", "entry"), ["grp", "entry"], "left_anti")
    return _labelled(gone, codes.COHERENCE_MISSING_FROM_INPUT, "entry", "ledger entry is not in the input")


def compare_steps(steps: DataFrame, locked: DataFrame) -> DataFrame:
    """Differences between matched steps, up to seven findings per step."""
    names = ("idx", "version", "snapshot_entry")

    def side(df: DataFrame, digests: tuple[str, ...], name: str) -> DataFrame:
        fields = [*names, *[packed(F.col(c)).alias(c) for c in digests]]
        return df.select("grp", "entry", F.struct(*fields).alias(name))

    digests = ("payload_digest", "snapshot_digest", "chain_hash")
    joined = side(steps, digests, "s").join(side(locked, (*digests, "schema_digest"), "l"), ["grp", "entry"])
    return _explode(joined, _step_rules(F.col("s"), F.col("l"), F.col("entry")))


def _step_rules(step: Column, stored: Column, entry: Column) -> list[Column]:
    """Differences of a matched step."""
    companion = step["snapshot_entry"]

    def unequal(name: str) -> Column:
        return ~stored[name].eqNullSafe(step[name])

    present = step["snapshot_digest"].isNotNull()
    return [
        _when(unequal("idx"), codes.COHERENCE_STEP_INDEX_MISMATCH, entry, "position differs"),
        _when(unequal("version"), codes.COHERENCE_STEP_VERSION_MISMATCH, entry, "version differs"),
        _when(
            unequal("payload_digest"), codes.COHERENCE_MIGRATION_DIGEST_MISMATCH, entry, "payload differs"
        ),
        _when(
            unequal("snapshot_entry"), codes.COHERENCE_CHECKPOINT_MISMATCH, companion, "snapshot path differs"
        ),
        _when(~present, codes.COHERENCE_CHECKPOINT_MISSING, companion, "snapshot is missing"),
        _when(
            present & unequal("snapshot_digest"), codes.COHERENCE_CHECKPOINT_MISMATCH, companion, "snapshot differs"
        ),
        _when(
            present & ~stored["schema_digest"].eqNullSafe(step["snapshot_digest"]),
            codes.COHERENCE_STEP_SCHEMA_MISMATCH,
            companion,
            "stored schema digest differs from the snapshot",
        ),
        _when(unequal("chain_hash"), codes.COHERENCE_CHAIN_HASH_MISMATCH, entry, "chain differs"),
    ]


def check_ledger_paths(
    locked: DataFrame, policy: LedgerPolicy = DEFAULT_POLICY, headers: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Stored steps with normalised paths, and findings for the steps dropped.

    A step is dropped when one of its paths is invalid, or valid but outside its
    folder; only then is the second kind of finding given. The folders are those
    the group's stored header names; without headers, or for a group that has
    none, the policy's.
    """
    folders = {"entry": F.lit(policy.migrations_dir), "snapshot_entry": F.lit(policy.checkpoints_dir)}
    columns = locked.columns
    if headers is not None:
        named = headers.select(
            "grp", F.col("migrations_dir").alias("_entry_dir"), F.col("checkpoints_dir").alias("_snapshot_entry_dir")
        )
        locked = locked.join(named, "grp", "left")
        folders = {name: F.coalesce(F.col(f"_{name}_dir"), folder) for name, folder in folders.items()}
    inside, checks = _path_rules(folders)
    kept = locked.where(inside).select(
        *[entry_value(F.col(c)).alias(c) if c in folders else F.col(c) for c in columns]
    )
    return kept, _explode(locked.where(~inside), checks)


def _path_rules(folders: dict[str, Column]) -> tuple[Column, list[Column]]:
    """Whether all paths of a stored step are valid and inside, and the findings if not."""
    names = tuple(folders.items())
    all_valid, all_inside = F.lit(True), F.lit(True)
    for name, folder in names:
        valid = entry_error(F.col(name)).isNull()
        under = F.startswith(entry_value(F.col(name)), F.concat(folder, F.lit("/")))
        all_valid = all_valid & valid
        all_inside = all_inside & F.coalesce(valid & under, F.lit(False))
    checks = []
    for name, folder in names:
        error, value = entry_error(F.col(name)), entry_value(F.col(name))
        checks.append(
            _when(
                error.isNotNull(),
                codes.LOCKFILE_STEP_PATH_INVALID,
                F.col(name),
                F.concat(F.lit("bad path: "), error),
            )
        )
        checks.append(
            _when(
                all_valid & ~F.startswith(value, F.concat(folder, F.lit("/"))),
                codes.LOCKFILE_STEP_PATH_MISMATCH,
                value,
                F.concat(F.lit("not under "), folder, F.lit("/")),
            )
        )
    return all_inside, checks


def duplicate_ledger_steps(
    locked: DataFrame, hot_rows: int = HOT_ROWS, largest: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Surviving steps, and findings for repeated entries or indices.

    Each flag is "not the first row with this value in arrival order", whether
    or not that first row survives itself, so the two flags are independent. Rows of groups
    up to ``hot_rows`` are dealt by group once for both; ``largest`` is an upper bound
    on the group size where the caller knows one.
    """
    if (largest_group(locked, ["grp"]) if largest is None else largest) <= hot_rows:
        lying = locked.repartition("grp")
        for name in ("entry", "idx"):
            first = F.min("pos").over(W.partitionBy("grp", name))
            lying = lying.withColumn(f"_{name}_again", F.coalesce(F.col("pos") > first, F.lit(False)))
        index = F.concat(F.lit("index "), F.col("idx").cast("string"), F.lit(" is repeated"))
        found = _explode(
            lying,
            [
                _when(F.col("_entry_again"), codes.LOCKFILE_DUPLICATE_MIGRATION, F.col("entry"), "entry is repeated"),
                _when(F.col("_idx_again"), codes.LOCKFILE_DUPLICATE_STEP_INDEX, F.col("entry"), index),
            ],
        )
        return lying.where("NOT _entry_again AND NOT _idx_again").select(*locked.columns), found
    again = repeats(locked, ["grp", "entry"], "pos", "_first")
    index_again = repeats(locked, ["grp", "idx"], "pos", "_first")
    lost = again.select("grp", "pos").unionByName(index_again.select("grp", "pos")).distinct()
    kept = locked.join(lost, ["grp", "pos"], "left_anti").select(*locked.columns)
    numbered = index_again.select(
        "grp",
        F.lit(codes.LOCKFILE_DUPLICATE_STEP_INDEX).alias("code"),
        F.col("entry").alias("path"),
        F.concat(F.lit("index "), F.col("idx").cast("string"), F.lit(" is repeated")).alias("detail"),
    )
    return kept, _labelled(again, codes.LOCKFILE_DUPLICATE_MIGRATION, "entry", "entry is repeated").unionByName(numbered)


def ledger_scan(
    locked: DataFrame,
    policy: LedgerPolicy = DEFAULT_POLICY,
    headers: DataFrame | None = None,
    largest: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Usable stored steps and all findings of reading them."""
    inside, path_findings = check_ledger_paths(locked, policy, headers)
    kept, duplicate_findings = duplicate_ledger_steps(inside, largest=largest)
    return kept, path_findings.unionByName(duplicate_findings)


def check_sequential(
    locked: DataFrame, hot_rows: int = HOT_ROWS, largest: int | None = None, rows: int = 0
) -> DataFrame:
    """Surviving steps whose index is not their 1-based place in ledger order."""
    placed = ordinal(locked.select("grp", "pos", "idx", "entry"), ["grp"], ["pos"], "_place", hot_rows, largest, rows)
    detail = F.concat(
        F.lit("index "), F.col("idx").cast("string"), F.lit(" at place "), F.col("_place").cast("string")
    )
    return _explode(
        placed,
        [
            _when(
                F.col("idx") != F.col("_place"), codes.LOCKFILE_STEP_INDEX_INVALID, F.col("entry"), detail
            )
        ],
    )


def check_head(
    headers: DataFrame, locked: DataFrame, steps: DataFrame, policy: LedgerPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Head index against both step counts, head chain against the recomputed one."""
    stored = locked.groupBy("grp").agg(F.count("*").alias("_stored"))
    own = steps.groupBy("grp").agg(
        F.count("*").alias("_own"), F.max_by("chain_hash", "idx").alias("_chain")
    )
    joined = headers.join(stored, "grp", "left").join(own, "grp", "left")
    return _explode(joined, _head_rules(F.col, F.col("_stored"), F.col("_own"), F.col("_chain"), policy))


def _head_rules(at: At, stored: Column, own: Column, last: Column, policy: LedgerPolicy) -> list[Column]:
    n_stored, n_own = F.coalesce(stored, F.lit(0)), F.coalesce(own, F.lit(0))
    chain = F.coalesce(last, ledger.seed_of(at("engine"), at("target"), policy))
    path = F.lit(codes.LEDGER_FILE)

    def counted(what: str, number: Column) -> Column:
        return F.concat(
            F.lit("head_index "), F.coalesce(at("head_index").cast("string"), F.lit("null")), F.lit(f", {what} "), number.cast("string")
        )

    def index_differs(what: str, number: Column) -> Column:
        differs = ~at("head_index").eqNullSafe(number)
        return _when(differs, codes.COHERENCE_HEAD_INDEX_MISMATCH, path, counted(what, number))

    return [
        index_differs("ledger steps", n_stored),
        index_differs("input entries", n_own),
        _when(
            ~at("head_chain_hash").eqNullSafe(chain),
            codes.COHERENCE_HEAD_CHAIN_MISMATCH,
            path,
            "head chain differs from the recomputed one",
        ),
    ]


#: Fields without which a stored header, or a stored step, cannot be read.
HEADER_FIELDS = (
    "lock_version", "hash_algorithm", "canonicalizer", "engine", "target", "schema_file", "migrations_dir",
    "checkpoints_dir", "head_index", "head_chain_hash", "head_schema_digest",
)
STEP_FIELDS = (
    "idx", "version", "entry", "payload_digest", "chain_hash", "snapshot_entry", "snapshot_digest", "schema_digest",
)


def _first_null(fields: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.col(name).isNull(), F.lit(name)) for name in fields])


def stored_groups(headers: DataFrame, locked: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """DataFrame[grp, header, reason]: one row per group that has a header or an unreadable part.

    ``reason`` is null for a readable ledger. A header repeated for a group, a header or step with a
    null in a required field, or a row of ``unreadable`` (grp, reason; ``sources.ledgers`` finds those
    in stored text) makes the whole ledger of its group unreadable: ``header`` is null then,
    and the ledger counts as absent. Steps of a group without any header stay what they are.
    """
    fields = F.struct(*[F.col(c) for c in HEADER_FIELDS]).alias("header")
    none = F.lit(None).cast(T.StringType())
    wrong = F.concat(F.lit("header without "), _first_null(HEADER_FIELDS))
    parts = headers.select("grp", fields, F.lit(1).alias("n"), wrong.alias("reason"))
    empty = F.lit(None).cast(parts.schema["header"].dataType).alias("header")

    def only(df: DataFrame, reason: Column) -> DataFrame:
        return df.select("grp", empty, F.lit(0).alias("n"), reason.alias("reason"))

    torn = locked.where(_first_null(STEP_FIELDS).isNotNull())
    parts = parts.unionByName(only(torn, F.concat(F.lit("step without "), _first_null(STEP_FIELDS))))
    if unreadable is not None:
        parts = parts.unionByName(only(unreadable, F.col("reason")))
    grouped = parts.groupBy("grp").agg(
        F.first("header", ignorenulls=True).alias("header"), F.sum("n").alias("n"), F.min("reason").alias("reason")
    )
    reason = F.when(F.col("n") > 1, F.lit("header is repeated")).otherwise(F.coalesce("reason", none))
    return grouped.select("grp", F.when(reason.isNull(), F.col("header")).alias("header"), reason.alias("reason"))


def ledger_state(
    entries: DataFrame,
    snapshots: DataFrame,
    heads: DataFrame,
    headers: DataFrame,
    locked: DataFrame,
    policy: LedgerPolicy = DEFAULT_POLICY,
    position: str | None = None,
    unreadable: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, usable stored steps, all findings) of every group.

    The step findings concern groups that have a readable ledger (``stored_groups``); the input findings
    all. Rows of groups up to ``hot_rows`` are dealt by group once (``_state_at_once``). With a larger
    group, stored steps are judged once, input steps are aligned with their snapshots by one
    outer join and with the stored steps by a second one. All rules of a pair are one
    array; what concerns a whole group comes together in one aggregate.
    """
    return _state(entries, snapshots, heads, headers, locked, policy, position, unreadable, hot_rows, True)


def ledger_findings(
    entries: DataFrame,
    snapshots: DataFrame,
    heads: DataFrame,
    headers: DataFrame,
    locked: DataFrame,
    policy: LedgerPolicy = DEFAULT_POLICY,
    position: str | None = None,
    unreadable: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The findings of ``ledger_state``, for who needs no steps: the rules are applied before the rows
    are written, so of the digests only the chain is."""
    return _state(entries, snapshots, heads, headers, locked, policy, position, unreadable, hot_rows, False)[2]


def _state(
    entries: DataFrame,
    snapshots: DataFrame,
    heads: DataFrame,
    headers: DataFrame,
    locked: DataFrame,
    policy: LedgerPolicy,
    position: str | None,
    unreadable: DataFrame | None,
    hot_rows: int,
    with_steps: bool,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    groups = written(stored_groups(headers, locked, unreadable), "groups")
    largest, total = _sizes_of(entries, snapshots, locked)
    if largest <= hot_rows:
        return _state_at_once(entries, snapshots, heads, locked, groups, policy, position, largest, total, with_steps)
    judged = written(_judged_steps(locked, groups, policy), "judged")
    usable = judged.where(F.size("_problems") == 0).select(*locked.columns)
    kept, rejected = ledger.judged_entries(
        ledger.digested_entries(entries, policy), policy.migrations_dir, position
    )
    snapshots_kept, snapshots_rejected = ledger.judged_entries(
        ledger.digested_snapshots(snapshots, policy), policy.checkpoints_dir, position
    )
    sided = written(_with_snapshots(_chained(kept, groups, policy, largest), snapshots_kept), "sided")
    steps = sided.where(F.col("step").isNotNull()).select("grp", *[f"step.{c}" for c in _STEP_COLUMNS])
    found = union_all(
        [
            judged.select("grp", F.inline("_problems")),
            check_sequential(usable, largest=largest),
            rejected,
            snapshots_rejected,
            _repeated_inputs(sided.select("grp", F.inline(_repeated_paths()))),
            _aligned(sided, usable),
            _of_groups(groups, heads, steps, usable, policy),
        ]
    )
    return steps, usable, found


def _state_at_once(
    entries: DataFrame,
    snapshots: DataFrame,
    heads: DataFrame,
    locked: DataFrame,
    groups: DataFrame,
    policy: LedgerPolicy,
    position: str | None,
    largest: int,
    total: int,
    with_steps: bool,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``ledger_state`` with one shuffle of all rows, digests packed, by group, and one written frame.

    That frame holds the steps or, without ``with_steps``, what the rules made of them.
    """
    aligned = _side_by_side(entries, snapshots, locked, groups, policy, position, largest, total)
    aligned = written(aligned, "aligned") if with_steps else aligned
    steps = aligned.where(F.col("step").isNotNull()).select(
        "grp", *[_opened(c, F.col(f"step.{c}")) for c in _STEP_COLUMNS]
    )
    judged = aligned.select("grp", F.inline("stored"))
    usable = judged.where(F.size("_problems") == 0).select("grp", *[_opened(c, F.col(c)) for c in locked.columns if c != "grp"])
    rejected = [
        ledger._rejected_entries(df, folder) for df, folder in ((entries, policy.migrations_dir), (snapshots, policy.checkpoints_dir))
    ]
    facts = _facts(aligned) if with_steps else written(_facts(aligned), "facts")
    kept = facts.where(F.col("kept").isNotNull()).select("grp", "kept.*")
    own = facts.where(F.col("own").isNotNull()).select("grp", "own.idx", _opened("chain_hash", F.col("own.chain_hash")))
    found = union_all(
        [
            facts.select("grp", F.inline("found")),
            check_sequential(kept, largest=largest, rows=total),
            *rejected,
            _repeated_inputs(facts.select("grp", F.inline("repeated"))),
            _of_groups(groups, heads, own, kept, policy),
        ]
    )
    return steps, usable.select(*locked.columns), found


def _facts(aligned: DataFrame) -> DataFrame:
    """DataFrame[grp, found, repeated, kept, own]: a row per path and usable stored step.

    ``found`` are its findings, ``repeated`` the paths that several inputs share, ``kept`` the place of the stored
    step and ``own`` the index and chain of the input's step; what concerns the path is on its first row.
    """
    pairs = aligned.select(
        "grp", "step", "has_ledger", "snapshot", "copies", "snapshot_copies",
        F.flatten(F.transform("stored", lambda x: x["_problems"])).alias("_problems"),
        F.posexplode_outer(F.filter("stored", _is_usable)).alias("_at", "stored"),
    )
    step, stored, first = F.col("step"), F.col("stored"), F.coalesce("_at", F.lit(0)) == 0
    # A snapshot of no step is one finding, however many stored steps share its path.
    once = F.when(step.isNotNull() | first, F.col("snapshot"))
    pairs = pairs.withColumns(
        {
            "_repeated": F.when(first, _repeated_paths()),
            "entry": F.coalesce("step.entry", "stored.entry"),
            "snapshot": once,
        }
    )
    met = step.isNotNull() | F.col("snapshot").isNotNull() | stored.isNotNull()
    rules = F.array_compact(F.array(*_pair_rules()))
    return pairs.select(
        "grp",
        F.flatten(F.array_compact(F.array(F.when(first, F.col("_problems")), F.when(met, rules)))).alias("found"),
        F.col("_repeated").alias("repeated"),
        F.when(stored.isNotNull(), F.struct("stored.pos", "stored.idx", "stored.entry")).alias("kept"),
        F.when(step.isNotNull() & first, F.struct("step.idx", "step.chain_hash")).alias("own"),
    )


_DIGESTS = ("payload_digest", "snapshot_digest", "schema_digest", "chain_hash")


def _closed(name: str) -> Column:
    return (packed(F.col(name)) if name in _DIGESTS else F.col(name)).alias(name)


def _opened(name: str, value: Column) -> Column:
    return (unpacked(value) if name in _DIGESTS else value).alias(name)


def _is_usable(stored: Column) -> Column:
    return F.size(stored["_problems"]) == 0


def _side_by_side(
    entries: DataFrame,
    snapshots: DataFrame,
    locked: DataFrame,
    groups: DataFrame,
    policy: LedgerPolicy,
    position: str | None,
    largest: int,
    total: int,
) -> DataFrame:
    """DataFrame[grp, step, has_ledger, snapshot, copies, snapshot_copies, stored], digests packed.

    A row is a path: its step, its snapshot and its stored steps (an array, with ``_problems``).
    A stored step with a problem has a row of its own. Everything after the one shuffle by group is
    windows and aggregates that keep the rows where they are.
    """

    def given(df: DataFrame, folder: str, digest: str, name: str) -> DataFrame:
        good = df.where(entry_within(F.col("entry"), folder, ENTRY_SUFFIX))
        row = F.struct(F.col(position or "entry").alias("arrival"), packed(F.col(digest)).alias("digest")).alias(name)
        tail = F.substring("path", len(folder) + 1, (1 << 31) - 1)
        return good.withColumn("path", entry_value(F.col("entry"))).select("grp", tail.alias("path"), row)

    fields = [c for c in locked.columns if c != "grp"]
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            given(ledger.digested_entries(entries, policy), policy.migrations_dir, "payload_digest", "own"),
            given(ledger.digested_snapshots(snapshots, policy), policy.checkpoints_dir, "snapshot_digest", "state"),
            locked.select("grp", F.struct(*[_closed(c) for c in fields]).alias("kept")),
        ],
    )
    named = groups.select(
        "grp", F.col("header.engine").alias("engine"), F.col("header.target").alias("target"),
        F.col("header").isNotNull().alias("has_ledger"), F.col("header.migrations_dir").alias("_entry_dir"),
        F.col("header.checkpoints_dir").alias("_snapshot_entry_dir"), F.col("reason").alias("_reason"),
    )
    kept = F.col("kept")
    lying = dealt(rows, ["grp"], total, always=True)
    lying = lying.join(named, "grp", "left").where(kept.isNull() | F.col("_reason").isNull())
    folders = {
        "entry": F.coalesce("_entry_dir", F.lit(policy.migrations_dir)),
        "snapshot_entry": F.coalesce("_snapshot_entry_dir", F.lit(policy.checkpoints_dir)),
    }
    inside, checks = _path_rules(folders)
    inside = kept.isNotNull() & inside
    lying = lying.withColumns({name: kept[name] for name in folders})
    # The path of the input entry all kinds of rows meet at; a stored path may lie anywhere.
    stored_entry = F.when(inside, entry_value(F.col("entry"))).otherwise(F.col("entry"))
    placed = lying.withColumns(
        {
            "_paths": F.when(kept.isNotNull() & ~inside, F.array_compact(F.array(*checks))),
            "_pos": F.when(inside, kept["pos"]),
            "path": F.when(kept.isNull(), F.concat(F.lit(policy.migrations_dir), "path")).otherwise(stored_entry),
            "snapshot_entry": F.when(inside, entry_value(F.col("snapshot_entry"))).otherwise(F.col("snapshot_entry")),
            "_idx": kept["idx"],
        }
    )
    first_idx = F.min("_pos").over(W.partitionBy("grp", "_idx"))
    first_entry = F.min("_pos").over(W.partitionBy("grp", "path"))
    again = placed.withColumn("_first_idx", first_idx).withColumn("_first_entry", first_entry)
    index = F.concat(F.lit("index "), F.col("_idx").cast("string"), F.lit(" is repeated"))
    repeated = [
        _when(F.col("_pos") > F.col("_first_entry"), codes.LOCKFILE_DUPLICATE_MIGRATION, F.col("path"), "entry is repeated"),
        _when(F.col("_pos") > F.col("_first_idx"), codes.LOCKFILE_DUPLICATE_STEP_INDEX, F.col("path"), index),
    ]
    problems = F.coalesce("_paths", F.array_compact(F.array(*repeated)))
    changed = {"entry": F.col("path"), "snapshot_entry": F.col("snapshot_entry")}
    stored = F.struct(*[changed.get(c, kept[c]).alias(c) for c in fields], problems.alias("_problems"))
    alone = (
        F.when(kept.isNotNull() & (F.size(problems) > 0), F.concat(F.lit("at "), kept["pos"].cast("string")))
        # A missing group matches nothing, itself neither.
        .when(F.col("grp").isNull(), F.when(kept.isNotNull(), "kept").when(F.col("own").isNotNull(), "own").otherwise("state"))
    )
    met = again.withColumn("_alone", alone).groupBy("grp", "path", "_alone").agg(
        F.min("own").alias("own"), F.count("own").alias("copies"),
        F.min("state").alias("state"), F.count("state").alias("snapshot_copies"),
        F.collect_list(F.when(kept.isNotNull(), stored)).alias("stored"),
        *[F.first(c).alias(c) for c in ("engine", "target", "has_ledger")],
    )
    is_step = F.col("own").isNotNull()
    here = W.partitionBy("grp").orderBy("path", "_alone").rowsBetween(W.unboundedPreceding, 0)
    numbered = met.withColumn("idx", F.count("own").over(here)).select(
        "grp", F.col("path").alias("entry"), "_alone", "idx", F.when(is_step, version_of(F.col("path"))).alias("version"),
        unpacked(F.col("own.digest")).alias("payload_digest"), "state", "copies", "snapshot_copies", "stored", "has_ledger",
        F.coalesce("engine", F.lit("")).alias("engine"), F.coalesce("target", F.col("grp").cast("string")).alias("target"),
    )
    chained = ledger.fold_steps(numbered, policy, ("entry", "_alone"), largest)
    companion = companion_entry(F.col("entry"), policy.migrations_dir, policy.checkpoints_dir)
    parts = {
        "snapshot_entry": companion,
        "payload_digest": packed(F.col("payload_digest")),
        "snapshot_digest": F.col("state.digest"),
        "chain_hash": packed(F.col("chain_hash")),
    }
    step = F.struct(*[parts.get(c, F.col(c)).alias(c) for c in _STEP_COLUMNS])
    return chained.select(
        "grp", F.when(F.col("version").isNotNull(), step).alias("step"), "has_ledger",
        F.when(F.col("state").isNotNull(), companion).alias("snapshot"), "copies", "snapshot_copies", "stored",
    )


_STEP_COLUMNS = ("idx", "version", "entry", "payload_digest", "snapshot_entry", "snapshot_digest", "chain_hash")


def _sizes_of(*frames: DataFrame) -> tuple[int, int]:
    """Rows of the largest group in any frame, and all rows, in one job."""
    tagged = [df.select("grp", F.lit(i).alias("of")) for i, df in enumerate(frames)]
    return group_sizes(union_all(tagged), ["of", "grp"])


def _judged_steps(locked: DataFrame, groups: DataFrame, policy: LedgerPolicy) -> DataFrame:
    """Stored steps of readable ledgers with normalised paths and an array ``_problems``."""
    named = groups.select(
        "grp",
        F.col("header.migrations_dir").alias("_entry_dir"),
        F.col("header.checkpoints_dir").alias("_snapshot_entry_dir"),
        F.col("reason").alias("_reason"),
    )
    rows = locked.join(named, "grp", "left").where(F.col("_reason").isNull())
    folders = {
        "entry": F.coalesce("_entry_dir", F.lit(policy.migrations_dir)),
        "snapshot_entry": F.coalesce("_snapshot_entry_dir", F.lit(policy.checkpoints_dir)),
    }
    inside, checks = _path_rules(folders)
    paths = [F.when(inside, entry_value(F.col(c))).otherwise(F.col(c)).alias(c) if c in folders else F.col(c) for c in locked.columns]
    placed = rows.select(*paths, inside.alias("_inside"), F.when(~inside, F.array_compact(F.array(*checks))).alias("_paths"))
    again = _with_first(_with_first(placed, "entry"), "idx")
    index = F.concat(F.lit("index "), F.col("idx").cast("string"), F.lit(" is repeated"))
    repeated = [
        _when(F.col("pos") > F.col("_first_entry"), codes.LOCKFILE_DUPLICATE_MIGRATION, F.col("entry"), "entry is repeated"),
        _when(F.col("pos") > F.col("_first_idx"), codes.LOCKFILE_DUPLICATE_STEP_INDEX, F.col("entry"), index),
    ]
    problems = F.coalesce("_paths", F.array_compact(F.array(*repeated)))
    return again.select(*locked.columns, problems.alias("_problems"))


def _with_first(placed: DataFrame, name: str) -> DataFrame:
    """Add ``_first_<name>``: the first position that shares the value, null if no other row does."""
    first = (
        placed.where("_inside")
        .groupBy("grp", F.col(name).alias("_value"))
        .agg(F.min("pos").alias(f"_first_{name}"), F.count("*").alias("_copies"))
        .where(F.col("_copies") > 1)
        .select(F.col("grp").alias("_of"), "_value", f"_first_{name}")
    )
    same = F.col("grp").eqNullSafe(F.col("_of")) & F.col(name).eqNullSafe(F.col("_value")) & F.col("_inside")
    return placed.join(first, same, "left").drop("_of", "_value")


def _chained(kept: DataFrame, groups: DataFrame, policy: LedgerPolicy, largest: int) -> DataFrame:
    """Input steps with their chain under the stored header's seed, and whether there is one."""
    placed = ordinal(kept, ["grp"], ["entry"], "idx", largest=largest)
    steps = placed.select(
        "grp", "idx", version_of(F.col("entry")).alias("version"), "entry", "payload_digest",
        companion_entry(F.col("entry"), policy.migrations_dir, policy.checkpoints_dir).alias("snapshot_entry"), "copies",
    )
    stored = groups.select("grp", "header")
    seeded = steps.join(stored, "grp", "left").withColumns(
        {
            "engine": F.coalesce("header.engine", F.lit("")),
            "target": F.coalesce("header.target", F.col("grp").cast("string")),
            "has_ledger": F.col("header").isNotNull(),
        }
    )
    return ledger.chain_hash(seeded.drop("header"), policy, largest=largest).drop("engine", "target")


def _with_snapshots(steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """DataFrame[grp, step, has_ledger, snapshot, copies, snapshot_copies]: steps and snapshots side by side.

    ``step`` is null for a snapshot of no step, ``snapshot`` (a path) for a step without one.
    """
    own = snapshots.select(
        F.col("grp").alias("_of"), F.col("entry").alias("snapshot"), "snapshot_digest", F.col("copies").alias("snapshot_copies")
    )
    same = (F.col("grp") == F.col("_of")) & (F.col("snapshot_entry") == F.col("snapshot"))
    joined = steps.join(own, same, "full_outer")
    step = F.when(F.col("entry").isNotNull(), F.struct(*[F.col(c) for c in _STEP_COLUMNS]))
    return joined.select(
        F.coalesce("grp", "_of").alias("grp"), step.alias("step"), "has_ledger", "snapshot", "copies", "snapshot_copies"
    )


def _repeated_paths() -> Column:
    """The paths of a step and its snapshot that several rows share, with the number ``n`` of rows."""
    both = F.array(
        F.struct(F.col("step.entry").alias("path"), F.col("copies").alias("n")),
        F.struct(F.col("snapshot").alias("path"), F.col("snapshot_copies").alias("n")),
    )
    return F.filter(both, lambda x: x["n"] > 1)


def _repeated_inputs(repeated: DataFrame) -> DataFrame:
    """A finding for every row beyond the first that a path stands for, from DataFrame[grp, path, n]."""
    # Two bounded steps, so that a path with very many rows needs no array of that length.
    chunk = 1 << 16
    parts = repeated.select("grp", "path", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 2) / chunk))).alias("part"), "n")
    size = F.least(F.lit(chunk), F.col("n") - 1 - F.col("part") * chunk)
    each = parts.select("grp", "path", F.explode(F.array_repeat(F.lit(0), size.cast("int"))).alias("_"))
    return _labelled(each, codes.INPUT_PATH_DUPLICATE, "path", "repeats the path of an earlier entry")


def _aligned(sided: DataFrame, usable: DataFrame) -> DataFrame:
    """All rules about a step, its snapshot and its stored form."""
    stored = usable.select(
        F.col("grp").alias("_of"), F.col("entry").alias("_entry"),
        F.struct(*[F.col(c) for c in usable.columns if c not in ("grp", "entry")]).alias("stored"),
    )
    same = (F.col("grp") == F.col("_of")) & (F.col("step.entry") == F.col("_entry"))
    joined = sided.join(stored, same, "full_outer").select(
        F.coalesce("grp", "_of").alias("grp"), "step", "has_ledger", "snapshot", "stored",
        F.coalesce("step.entry", "_entry").alias("entry"),
    )
    return _explode(joined, _pair_rules())


def _pair_rules() -> list[Column]:
    """The rules about columns step, has_ledger, snapshot, stored and entry, not all of them null."""
    step, kept = F.col("step"), F.col("stored")
    lone = step.isNull() & F.col("snapshot").isNotNull()
    undecodable = step.isNotNull() & F.col("snapshot").isNotNull() & step["snapshot_digest"].isNull()
    return [
        _when(lone, codes.INPUT_ORPHAN_CHECKPOINT, F.col("snapshot"), "snapshot belongs to no entry"),
        _when(undecodable, codes.INPUT_PATH_INVALID, F.col("snapshot"), "not UTF-8"),
        _when(
            step.isNotNull() & kept.isNull() & F.col("has_ledger"), codes.COHERENCE_NEW_IN_INPUT, F.col("entry"), "entry is not in the ledger"
        ),
        _when(step.isNull() & kept.isNotNull(), codes.COHERENCE_MISSING_FROM_INPUT, F.col("entry"), "ledger entry is not in the input"),
        *[F.when(step.isNotNull() & kept.isNotNull(), rule) for rule in _step_rules(step, kept, F.col("entry"))],
    ]


def _of_groups(
    groups: DataFrame, heads: DataFrame, steps: DataFrame, usable: DataFrame, policy: LedgerPolicy
) -> DataFrame:
    """All rules about a header, its head snapshot and the numbers of steps, from one aggregate by group."""
    digest = text_digest(valid_text(F.col("payload")), policy.hash_algorithm)
    bad_text = ~F.is_valid_utf8(F.col("payload").cast("string"))
    own = steps.groupBy("grp").agg(F.count("*").alias("_own"), F.max_by("chain_hash", "idx").alias("_chain"))
    parts = [
        groups,
        heads.select("grp", digest.alias("_digest"), bad_text.alias("_bad_head")),
        own,
        usable.groupBy("grp").agg(F.count("*").alias("_stored")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in every.columns if c != "grp"]
    merged = every.groupBy("grp").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    header = F.col("header")

    def at(name: str) -> Column:
        return header[name]

    rules = [
        *_header_rules(at, policy),
        *_group_rules(at),
        *_head_digest_rules(at, F.col("_digest"), policy),
        *_head_rules(at, F.col("_stored"), F.col("_own"), F.col("_chain"), policy),
    ]
    always = [
        _when(F.col("reason").isNotNull(), codes.LOCKFILE_PARSE_ERROR, F.lit(codes.LEDGER_FILE), F.col("reason")),
        _when(F.coalesce("_bad_head", F.lit(False)), codes.INPUT_PATH_INVALID, F.lit(policy.schema_file), "not UTF-8"),
    ]
    return _explode(merged, [*always, *[F.when(header.isNotNull(), rule) for rule in rules]])


def is_clean(groups: DataFrame, found: DataFrame) -> DataFrame:
    """DataFrame[grp, findings, is_clean]: clean means no finding at all."""
    counts = found.groupBy("grp").agg(F.count("*").alias("_n"))
    return groups.select("grp").distinct().join(counts, "grp", "left").select(
        "grp",
        F.coalesce("_n", F.lit(0)).alias("findings"),
        F.col("_n").isNull().alias("is_clean"),
    )


def fatal_diagnostics(found: DataFrame) -> DataFrame:
    """Findings that block a replay."""
    return found.where(F.col("code").isin(*codes.FATAL))
