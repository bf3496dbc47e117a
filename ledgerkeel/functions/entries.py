"""Column expressions over ledger entries (relative POSIX paths)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names and the suffix of ledger entries.
PAYLOAD_DIR = "migrations"
SNAPSHOT_DIR = "checkpoints"
ENTRY_SUFFIX = ".sql"


# Some segment is empty, "." or ".."; most entries have none and skip the rest.
_UNTIDY = r"(?:\A|/)\.{0,2}(?:/|\z)"


def _untidy(path: Column) -> Column:
    return F.rlike(path, F.lit(_UNTIDY))


def _tidied(path: Column) -> Column:
    """Without empty and "." segments; a leading slash is dropped too."""
    folded = F.regexp_replace(path, r"(?:\A|(?<=/))\.?/", "")
    return F.regexp_replace(folded, r"(?:/|\A)\.?\z", "")


def basename(path: Column) -> Column:
    return F.substring_index(F.when(_untidy(path), _tidied(path)).otherwise(path), "/", -1)


def version_of(entry: Column) -> Column:
    """Text before the first underscore of the stem, else the whole stem."""
    name = basename(entry)
    stem = F.when(
        F.endswith(name, F.lit(ENTRY_SUFFIX)), F.left(name, F.length(name) - len(ENTRY_SUFFIX))
    ).otherwise(name)
    prefix = F.substring_index(stem, "_", 1)
    return F.when(prefix != "", prefix).otherwise(stem)


def companion_entry(
    entry: Column, payload_dir: str = PAYLOAD_DIR, snapshot_dir: str = SNAPSHOT_DIR
) -> Column:
    """The snapshot entry that belongs to a payload entry."""
    tail = F.substring(entry, F.lit(len(payload_dir) + 1), F.length(entry))
    return F.when(
        F.startswith(entry, F.lit(f"{payload_dir}/")), F.concat(F.lit(snapshot_dir), tail)
    ).otherwise(entry)


def entry_error(path: Column) -> Column:
    """Null for a usable relative path, else ``empty``, ``absolute`` or ``dot_segment``."""
    return (
        F.when(~_untidy(path), F.lit(None))
        .when(F.startswith(path, F.lit("/")), F.lit("absolute"))
        .when(_tidied(path) == "", F.lit("empty"))
        .when(F.rlike(path, F.lit(r"(?:\A|/)\.\.(?:/|\z)")), F.lit("dot_segment"))
    )


def entry_value(path: Column) -> Column:
    """The normalised path, null where it has an error."""
    return F.when(~_untidy(path), path).when(entry_error(path).isNull(), _tidied(path))


def entry_within(path: Column, folder: str, suffix: str = "") -> Column:
    """Whether the normalised path is usable, below ``folder`` and ends with ``suffix``.

    A predicate of its own, so a filter on it costs one match for a tidy path
    even where the optimiser copies it below a projection.
    """

    def fits(value: Column) -> Column:
        return F.startswith(value, F.lit(f"{folder}/")) & F.endswith(value, F.lit(suffix))

    return F.when(~_untidy(path), fits(path)).otherwise(
        entry_error(path).isNull() & fits(_tidied(path))
    )


def normalize_entry(path: Column) -> Column:
    """struct(value, error) of a path."""
    return F.struct(entry_value(path).alias("value"), entry_error(path).alias("error"))


def _forward(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def status_basename(path: Column) -> Column:
    return basename(_forward(path))


def status_path(path: Column) -> Column:
    """Slashes unified, repeated separators and dot segments folded."""
    forward = _forward(path)
    tidied = _tidied(forward)
    return (
        F.when(~_untidy(forward), forward)
        .when(F.startswith(forward, F.lit("/")), F.concat(F.lit("/"), tidied))
        .when(tidied == "", F.lit("."))
        .otherwise(tidied)
    )


def is_path_like(path: Column) -> Column:
    return F.contains(path, F.lit("/")) | F.contains(path, F.lit("\\"))


def path_style(path: Column) -> Column:
    """Aggregate: ``path``, ``basename`` or ``mixed``; ``basename`` for no rows."""
    some = F.coalesce(F.bool_or(is_path_like(path)), F.lit(False))
    every = F.coalesce(F.bool_and(is_path_like(path)), F.lit(False))
    return (
        F.when(~some, F.lit("basename")).when(every, F.lit("path")).otherwise(F.lit("mixed"))
    )
