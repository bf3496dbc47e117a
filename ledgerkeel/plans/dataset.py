"""Dataset apply and export over catalog tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DatasetError, StateError
from ..operators import coherence, compare, history, mutate, validate
from ..session import written
from ..sources import jsonl, tables
from .config import DataFile, DataSet

REPORT_SCHEMA = "name string, table string, mode string, rows bigint"


@dataclass(frozen=True)
class Checked:
    """A data file's rows, parsed once and good, and their number."""

    file: DataFile
    rows: DataFrame
    count: int


def check_file(spark: SparkSession, data_file: DataFile) -> Checked:
    """Parse one data file and validate it against its table.

    The parsed rows are written once; checks and the apply read those. Only counts and one
    sample come back.
    """
    schema = spark.table(data_file.table).schema
    validate.require_apply_columns(data_file, schema.fieldNames())
    lines = jsonl.read_lines(spark, data_file.path)
    bad = F.when(F.col("error").isNotNull(), F.struct("origin", "error", "value")).alias("bad")
    parsed = jsonl.checked_lines(lines, _nullable(schema)).select("row", F.col("present").alias(PRESENT), bad)
    checked = written(parsed, "data-file")
    seen = checked.agg(F.count(F.lit(1)).alias("rows"), F.min("bad").alias("bad")).first()
    if seen["bad"] is not None:
        bad = seen["bad"]
        unknown = validate.unknown_columns(lines, schema.fieldNames())
        unknown = unknown.agg(F.count("*").alias("n"), F.min("key").alias("first")).first()
        if unknown["n"]:
            raise DatasetError(
                f"data file {data_file.name!r} contains {unknown['n']} unknown column(s), "
                f"first {unknown['first']!r}; validate.unknown_columns lists them"
            )
        raise DatasetError(f"data file {data_file.name!r}: {bad['origin']}: {bad['error']}: {bad['value']}")
    keeps = data_file.mode == "upsert" and data_file.missing == "keep"
    rows = checked.select("row.*", PRESENT) if keeps else checked.select("row.*")
    if data_file.mode == "upsert" and data_file.on_duplicate == "raise":
        repeated = mutate.duplicate_keys(rows, list(data_file.on)).first()
        if repeated is not None:
            raise DatasetError(f"data file {data_file.name!r} repeats key {repeated.asDict()}")
    return Checked(data_file, rows, seen["rows"])


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


PRESENT = "_ledgerkeel_present"


def stage_file(spark: SparkSession, checked: Checked, held: DataFrame | None = None) -> tables.Staged | None:
    """Stage what one checked data file makes of its table, or of ``held``, its content staged so far."""
    data_file, table = checked.file, checked.file.table
    if checked.count == 0:
        if data_file.mode != "replace":
            return None
        return tables.stage_replace(spark, table, mutate.apply_replace_empty(spark.table(table)))
    target = spark.table(table) if held is None else held
    if data_file.mode == "insert":
        rows = mutate.align(checked.rows, target.schema)
        if held is None:
            return tables.stage_append(spark, table, rows)
        return tables.stage_replace(spark, table, held.unionByName(rows))
    if data_file.mode == "replace":
        return tables.stage_replace(spark, table, mutate.apply_replace(target, checked.rows))
    return _stage_upsert(spark, checked, target, held is not None)


def _stage_upsert(spark: SparkSession, checked: Checked, target: DataFrame, chained: bool) -> tables.Staged:
    """Where the key contains the partition columns, a row can only meet target
    rows of its own partition: only those partitions are read and rewritten."""
    data_file, source = checked.file, checked.rows
    table, on = data_file.table, list(data_file.on)
    options = {"missing": data_file.missing, "on_duplicate": data_file.on_duplicate, "source_rows": checked.count}
    if data_file.missing == "keep":
        options["present"] = PRESENT
    count, columns, _ = tables.bucket_columns(tables.table_details(spark, table))
    options["buckets"] = (count, columns) if count and not chained else None
    parts = tables.partition_columns(spark, table)
    if parts and set(parts) <= set(on) and not chained:
        near = tables.in_touched_partitions(target, source, parts)
        return tables.stage_partitions(spark, table, mutate.apply_upsert(near, source, on, **options), source)
    return tables.stage_replace(spark, table, mutate.apply_upsert(target, source, on, **options))


def ledger_gate(
    findings: DataFrame, steps: DataFrame, applied: DataFrame, live: DataFrame, head: DataFrame
) -> DataFrame:
    """The gate of ``apply_dataset`` and ``export_dataset`` from a ledger state.

    ``findings`` and ``steps`` come from ``coherence.ledger_state``, ``applied`` is the applied log,
    ``live`` and ``head`` the state as it is and as the last step leaves it. A group that any of
    them knows is open if it has no finding, its applied list is a prefix of its steps and not
    ahead, and its live state equals its head.
    """
    relation = written(history.live_relation(steps, applied), "relation")
    groups = relation.select("grp").unionByName(findings.select("grp")).distinct()
    clean = coherence.is_clean(groups, findings)
    prefix = history.prefix_check(steps, applied)
    return validate.schema_gate(clean, prefix, relation, compare.equal_states(live, head))


def require_open(gate: DataFrame | None, context: str) -> None:
    """Raise unless every group of a ``validate.schema_gate`` is open."""
    if gate is None:
        return
    shut = gate.where(~F.col("open"))
    first = shut.agg(F.count("*").alias("n"), F.min(F.struct(*[F.col(c) for c in gate.columns])).alias("row")).first()
    if first["n"]:
        raise StateError(f"{context} is refused for {first['n']} group(s), first {first['row'].asDict()}")


def apply_dataset(
    spark: SparkSession,
    data_set: DataSet,
    declared: dict[str, T.StructType] | None = None,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Apply every file in manifest order; returns the report.

    All files are validated before the first one is staged, and all are staged before the
    first table changes, so a failure on the way leaves every table as it was. Files of one table
    build on each other; only the last staged content becomes visible (``tables.switch``). ``declared`` schemas gate the tables first, and
    so does ``gate``, the conditions of ``validate.schema_gate``: a group whose
    ledger is not clean, whose applied list is no prefix or ahead, or whose live
    state is not its head refuses the whole set.
    """
    require_open(gate, "data apply")
    for data_file in data_set.files:
        if declared and data_file.table in declared:
            live = spark.table(data_file.table).schema
            validate.require_schema(live, declared[data_file.table], "data apply")
    checked = [check_file(spark, data_file) for data_file in data_set.files]
    staged: dict[str, tables.Staged] = {}
    for one in checked:
        before = staged.get(one.file.table)
        after = stage_file(spark, one, None if before is None else before.content)
        if after is not None:
            staged[one.file.table] = after
    tables.switch(spark, list(staged.values()))
    return report(spark, data_set, [one.count for one in checked])


def export_dataset(
    spark: SparkSession,
    data_set: DataSet,
    declared: dict[str, T.StructType] | None = None,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Export every file's table as ordered JSON lines, gated as ``apply_dataset``; returns the report."""
    require_open(gate, "data export")
    orders = []
    for data_file in data_set.files:
        live = spark.table(data_file.table).schema
        if declared and data_file.table in declared:
            validate.require_schema(live, declared[data_file.table], "data export")
        orders.append(validate.require_export_columns(data_file, live.fieldNames()))
    counts = [
        jsonl.jsonl_sink(tables.ordered_table_scan(spark, f.table, list(order)), f.path)
        for f, order in zip(data_set.files, orders, strict=True)
    ]
    return report(spark, data_set, counts)


def report(spark: SparkSession, data_set: DataSet, counts: list[int]) -> DataFrame:
    rows = [(f.name, f.table, f.mode, n) for f, n in zip(data_set.files, counts, strict=True)]
    return spark.createDataFrame(rows, REPORT_SCHEMA)
