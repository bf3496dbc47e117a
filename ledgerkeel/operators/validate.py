"""Checks on data files against their table, and the schema gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DatasetError, StateError
from ..functions import json_rows
from ..plans.config import DataFile


def observed_keys(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct top-level keys over all JSON lines: DataFrame[key]."""
    keys = F.explode(json_rows.object_keys(F.col(value))).alias("key")
    return lines.select(keys).distinct()


def unknown_columns(lines: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """Observed keys the table does not have, sorted: DataFrame[key].

    The table's names are few and known on the driver, so they prune inside the
    row expression and only unknown names ever reach the shuffle.
    """
    keys = json_rows.unknown_keys(json_rows.object_keys(F.col(value)), columns)
    return lines.select(F.explode(keys).alias("key")).distinct().orderBy("key")


def json_row_check(lines: DataFrame, value: str = "value") -> DataFrame:
    """Non-blank lines with ``ok``: exactly one JSON object, valid UTF-8."""
    line = json_rows.stripped(F.col(value))
    kept = lines.withColumn(value, line).where(F.col(value) != "")
    return kept.withColumn(
        "ok", F.is_valid_utf8(value) & json_rows.is_object(F.col(value))
    )


def resolve_order_by(data_file: DataFile) -> tuple[str, ...]:
    columns = data_file.order_by or data_file.on
    if not columns:
        raise DatasetError(f"data file {data_file.name!r} requires order_by for export")
    return columns


def missing_key_columns(data_file: DataFile, columns: list[str]) -> list[str]:
    return [c for c in data_file.on or () if c not in columns]


def missing_order_columns(data_file: DataFile, columns: list[str]) -> list[str]:
    return [c for c in data_file.order_by or () if c not in columns]


def require_upsert_key(data_file: DataFile) -> None:
    if data_file.mode == "upsert" and not data_file.on:
        raise DatasetError(f"data file {data_file.name!r}: upsert requires on")


def _require_none(data_file: DataFile, missing: list[str], role: str) -> None:
    if missing:
        names = ", ".join(map(repr, missing))
        raise DatasetError(f"data file {data_file.name!r}: missing {role} column(s): {names}")


def require_apply_columns(data_file: DataFile, columns: list[str]) -> None:
    require_upsert_key(data_file)
    _require_none(data_file, missing_key_columns(data_file, columns), "upsert key")
    _require_none(data_file, missing_order_columns(data_file, columns), "order_by")


def require_export_columns(data_file: DataFile, columns: list[str]) -> tuple[str, ...]:
    order = resolve_order_by(data_file)
    _require_none(data_file, [c for c in order if c not in columns], "order_by")
    _require_none(data_file, missing_key_columns(data_file, columns), "upsert key")
    return order


def schema_differences(live: T.StructType, declared: T.StructType) -> list[str]:
    """Readable differences in name, type, nullability and order; empty if equal."""
    found = []
    for position in range(max(len(live), len(declared))):
        have = live[position] if position < len(live) else None
        want = declared[position] if position < len(declared) else None
        if have is None or want is None or (have.name, have.dataType, have.nullable) != (
            want.name,
            want.dataType,
            want.nullable,
        ):
            found.append(f"column {position + 1}: live {_field(have)}, declared {_field(want)}")
    return found


def _field(field: T.StructField | None) -> str:
    if field is None:
        return "absent"
    return f"{field.name} {field.dataType.simpleString()}{'' if field.nullable else ' not null'}"


def require_schema(live: T.StructType, declared: T.StructType, context: str) -> None:
    found = schema_differences(live, declared)
    if found:
        raise StateError(f"{context} requires the declared schema: {'; '.join(found)}")


def schema_gate(clean: DataFrame, prefix: DataFrame, relation: DataFrame, equal: DataFrame) -> DataFrame:
    """One row per group with the four gate conditions and ``open`` = all hold.

    Inputs are keyed by ``grp``: ``clean(is_clean)``, ``prefix(status)``,
    ``relation(relation)``, ``equal(matches)``.
    """
    joined = (
        clean.select("grp", "is_clean")
        .join(prefix.select("grp", F.col("status").alias("prefix_status")), "grp", "left")
        .join(relation.select("grp", "relation"), "grp", "left")
        .join(equal.select("grp", "matches"), "grp", "left")
    )
    prefix_ok = F.coalesce(F.col("prefix_status") == "ok", F.lit(True))
    behind = F.coalesce(F.col("relation") != "ahead", F.lit(True))
    matches = F.coalesce("matches", F.lit(False))
    return joined.select(
        "grp",
        "is_clean",
        prefix_ok.alias("prefix_ok"),
        behind.alias("not_ahead"),
        matches.alias("matches"),
        (F.col("is_clean") & prefix_ok & behind & matches).alias("open"),
    )
