"""Rendering of table values as JSON lines with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _iso_timestamp(value: Column, suffix: str = "") -> Column:
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    text = F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
    return F.concat(text, F.lit(suffix)) if suffix else text


def render_json_value(value: Column, dtype: T.DataType) -> Column:
    """A column ``to_json`` prints the way the export contract asks for.

    Timestamps become ISO text (zone-aware ones in UTC), binary lowercase hex;
    struct fields and map keys come out sorted; what JSON has no form for (dates,
    times, decimals, intervals) is its text.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return _iso_timestamp(value)
    if isinstance(dtype, T.TimestampType):
        return _iso_timestamp(F.to_utc_timestamp(value, F.current_timezone()), "+00:00")
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(dtype, T.ArrayType):
        if not _needs_rendering(dtype.elementType):
            return value
        return F.transform(value, lambda item: render_json_value(item, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda field: field.name)
        rendered = F.struct(
            *[render_json_value(value[f.name], f.dataType).alias(f.name) for f in fields]
        )
        return F.when(value.isNotNull(), rendered)
    if isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(
            F.transform(
                entries,
                lambda item: F.struct(
                    render_json_value(item["key"], dtype.keyType).cast("string"),
                    render_json_value(item["value"], dtype.valueType),
                ),
            )
        )
    if _needs_rendering(dtype):
        return value.cast("string")
    return value


_PLAIN = (T.StringType, T.NumericType, T.BooleanType, T.NullType, T.VariantType)


def _needs_rendering(dtype: T.DataType) -> bool:
    return not isinstance(dtype, _PLAIN) or isinstance(dtype, T.DecimalType)


def json_line(schema: T.StructType) -> Column:
    """One JSON object per row of ``schema``: sorted keys, nulls written out."""
    fields = sorted(schema.fields, key=lambda field: field.name)
    return F.to_json(
        F.struct(*[render_json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]),
        {"ignoreNullFields": "false"},
    )
