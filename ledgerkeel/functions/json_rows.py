"""Checks and parsing of one-object-per-line JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def seal_of(line: Column) -> Column:
    return F.md5(line)


def sealed_variant(line: Column, seal: Column | None = None) -> Column:
    """Variant ``[line, seal]``, null unless the line and seal parse as one array.

    The JSON functions ignore text after the first value. Closing the line into
    an array with a seal the line cannot contain shows whether the whole line
    was read as exactly one value.
    """
    end = seal_of(line) if seal is None else seal
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit(',"'), end, F.lit('"]')))


def is_object(line: Column, seal: Column | None = None, variant: Column | None = None) -> Column:
    end = seal_of(line) if seal is None else seal
    whole = sealed_variant(line, end) if variant is None else variant
    found = F.try_variant_get(whole, "$[1]", "string")
    return F.startswith(line, F.lit("{")) & F.coalesce(found == end, F.lit(False))


def object_keys(line: Column) -> Column:
    return F.json_object_keys(line)


def unknown_keys(keys: Column, columns: list[str]) -> Column:
    return F.array_except(keys, F.array(*[F.lit(c) for c in columns]).cast("array<string>"))


#: Field of the wire schema that holds the line if some value, at any depth, did not fit.
CORRUPT = "_ledgerkeel_corrupt"


def _wire_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, (T.BinaryType, T.DecimalType)):
        return T.StringType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_wire_type(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _wire_type(dtype.valueType), dtype.valueContainsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _wire_type(f.dataType), f.nullable) for f in dtype.fields])
    return dtype


def wire_schema(schema: T.StructType) -> T.StructType:
    """The types lines are parsed with: binary is hex text, decimals are kept as text
    so that no digit is rounded away unseen, and a field tells of misfits."""
    return T.StructType([*_wire_type(schema).fields, T.StructField(CORRUPT, T.StringType())])


def typed(value: Column, dtype: T.DataType) -> Column:
    """A parsed value in the table's type."""
    if _wire_type(dtype) == dtype and not isinstance(dtype, T.StructType):
        return value
    if isinstance(dtype, T.BinaryType):
        return F.try_to_binary(value, F.lit("hex"))
    if isinstance(dtype, T.DecimalType):
        return value.try_cast(dtype)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: typed(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: typed(item, dtype.valueType))
    fields = F.struct(*[typed(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
    return F.when(value.isNotNull(), fields)


_DECIMAL = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def _inexact(text: Column, dtype: T.DecimalType) -> Column:
    """Whether a text is no number, or one that the decimal type cannot hold digit for digit."""
    digits = F.length(F.regexp_extract(text, r"^[^eE.]*\.([0-9]*?)0*$", 1))
    wider = f"decimal(38,{38 - (dtype.precision - dtype.scale)})"
    value = text.try_cast(dtype)
    rounded = F.coalesce(text.try_cast(wider) != value.cast(wider), F.lit(False))
    return text.isNotNull() & (~text.rlike(_DECIMAL) | value.isNull() | (digits > dtype.scale) | rounded)


def _misfit(value: Column, dtype: T.DataType) -> Column | None:
    """Whether some leaf of a parsed value is binary but no hex text, a decimal that would be
    rounded, or a float that is no number or endless; null where no leaf can be."""
    if isinstance(dtype, T.BinaryType):
        return value.isNotNull() & F.try_to_binary(value, F.lit("hex")).isNull()
    if isinstance(dtype, T.DecimalType):
        return _inexact(value, dtype)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.isnan(value) | (F.abs(value) == float("inf"))
    if isinstance(dtype, T.ArrayType):
        return _any_misfit(value, dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _any_misfit(F.map_values(value), dtype.valueType)
    if isinstance(dtype, T.StructType):
        parts = [_misfit(value.getField(f.name), f.dataType) for f in dtype.fields]
        parts = [F.coalesce(p, F.lit(False)) for p in parts if p is not None]
        return reduce(lambda a, b: a | b, parts) if parts else None
    return None


def _any_misfit(items: Column, dtype: T.DataType) -> Column | None:
    if _misfit(F.lit(None), dtype) is None:
        return None
    return F.exists(items, lambda item: F.coalesce(_misfit(item, dtype), F.lit(False)))


def _step(name: str) -> str | None:
    """A field as a step of a variant path; null for a name that has both kinds of quotes."""
    if '"' not in name:
        return f'["{name}"]'
    return f"['{name}']" if "'" not in name else None


def _lost(variant: Column, parsed: Column, schema: T.StructType) -> dict[str, Column]:
    """Per column: present and not null in the text, but null after typed parsing, or a misfit.

    The text is looked up only where the parsed value is null.
    """
    found = {}
    for field in schema.fields:
        value, step = parsed.getField(field.name), _step(field.name)
        lost = F.lit(False)
        if step is not None:
            lost = value.isNull() & F.try_variant_get(variant, f"$[0]{step}", "string").isNotNull()
        misfit = _misfit(value, field.dataType)
        found[field.name] = lost if misfit is None else lost | F.coalesce(misfit, F.lit(False))
    return found


def _has_struct(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_struct(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_struct(dtype.valueType)
    return isinstance(dtype, T.StructType)


def _unknown_in(text: Column, dtype: T.DataType, name: str) -> Column:
    """Fields inside a nested value, given as its JSON text, that its type does not have."""
    if isinstance(dtype, T.StructType):
        keys = unknown_keys(F.json_object_keys(text), dtype.fieldNames())
        found = [F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda key: F.concat(F.lit(f"{name}."), key))]
        nested = [f for f in dtype.fields if _has_struct(f.dataType)]
        if nested:
            parts = F.from_json(text, T.StructType([T.StructField(f.name, T.StringType()) for f in nested]))
            found += [_unknown_in(parts.getField(f.name), f.dataType, f"{name}.{f.name}") for f in nested]
        return F.concat(*found)
    if isinstance(dtype, T.ArrayType):
        items, inner = F.from_json(text, "array<string>"), dtype.elementType
    else:
        items, inner = F.map_values(F.from_json(text, "map<string,string>")), dtype.valueType
    each = F.flatten(F.transform(items, lambda item: _unknown_in(item, inner, name)))
    return F.coalesce(each, F.array().cast("array<string>"))


def _unknown_inside(variant: Column, schema: T.StructType) -> Column:
    """Fields at any depth of nested columns that the table does not have, as dotted names."""
    found = []
    for field in schema.fields:
        step = _step(field.name)
        if step is not None and _has_struct(field.dataType):
            text = F.try_variant_get(variant, f"$[0]{step}", "string")
            found.append(_unknown_in(text, field.dataType, field.name))
    return F.concat(*found)


def row_error(
    line: Column, seal: Column, variant: Column, keys: Column, parsed: Column, schema: T.StructType
) -> Column:
    """Null for a good line, else what is wrong with it."""
    unknown = unknown_keys(keys, schema.fieldNames())
    if any(_has_struct(f.dataType) and _step(f.name) is not None for f in schema.fields):
        unknown = F.concat(unknown, _unknown_inside(variant, schema))
    lost = _lost(variant, parsed, schema)
    names = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in lost.items()]))
    return (
        F.when(~F.is_valid_utf8(line), F.lit("not UTF-8"))
        .when(~is_object(line, seal, variant), F.lit("not one JSON object"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown columns: "), F.array_join(unknown, ", ")))
        .when(
            reduce(lambda a, b: a | b, lost.values()),
            F.concat(F.lit("values not of the column type: "), F.array_join(names, ", ")),
        )
        .when(parsed.getField(CORRUPT).isNotNull(), F.lit("values not of the column type inside a column"))
    )
