"""Dataset manifests: which data file feeds which table, and how."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from pathlib import Path

from ..errors import DatasetError

# Keys of a manifest and the write modes.
SET_KEYS = ("files",)
FILE_KEYS = ("name", "table", "mode", "on", "order_by")
MODES = ("replace", "upsert", "insert")
DATA_SUFFIX = ".jsonl"


@dataclass(frozen=True)
class DataFile:
    name: str
    table: str
    mode: str
    path: str
    on: tuple[str, ...] | None = None
    order_by: tuple[str, ...] | None = None
    # Options of an upsert, see ``mutate.apply_upsert``; a manifest cannot set them.
    missing: str = "null"
    on_duplicate: str = "raise"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise DatasetError(f"data file {self.name!r}: unsupported mode {self.mode!r}")
        if self.mode == "upsert" and not self.on:
            raise DatasetError(f"data file {self.name!r}: upsert requires on")


@dataclass(frozen=True)
class DataSet:
    name: str
    files: tuple[DataFile, ...]


def load_dataset_config(manifest: str | Path, data_dir: str) -> tuple[DataSet, ...]:
    """Read a TOML manifest; data file paths are below ``data_dir`` (any Spark URI)."""
    path = Path(manifest)
    try:
        parsed = tomllib.loads(path.read_bytes().decode("utf-8"))
    except OSError as error:
        raise DatasetError(f"cannot read manifest {path}: {error}") from error
    except (UnicodeDecodeError, tomllib.TOMLDecodeError) as error:
        raise DatasetError(f"cannot parse manifest {path}: {error}") from error
    return tuple(_data_set(name, body, data_dir) for name, body in parsed.items())


def _data_set(name: str, body: object, data_dir: str) -> DataSet:
    if not isinstance(body, dict):
        raise DatasetError(f"data set {name!r} must be a table")
    _only_known(body, SET_KEYS, f"data set {name!r}")
    files = body.get("files")
    if not isinstance(files, list):
        raise DatasetError(f"data set {name!r} must define a files array")
    return DataSet(name, tuple(_data_file(item, data_dir, name) for item in files))


def _data_file(raw: object, data_dir: str, set_name: str) -> DataFile:
    if not isinstance(raw, dict):
        raise DatasetError(f"data set {set_name!r}: each file must be a table")
    _only_known(raw, FILE_KEYS, f"data set {set_name!r}")
    texts = {key: raw.get(key) for key in ("name", "table", "mode")}
    wrong = [key for key, value in texts.items() if not isinstance(value, str)]
    if wrong:
        raise DatasetError(f"data set {set_name!r}: {', '.join(wrong)} must be a string")
    relative = _relative(texts["name"])
    stem = relative.rsplit("/", 1)[-1]
    location = relative if relative.endswith(DATA_SUFFIX) else relative + DATA_SUFFIX
    return DataFile(
        name=re.sub(r"(?<=.)\.[^.]+\Z", "", stem),
        table=texts["table"],
        mode=texts["mode"],
        path=f"{data_dir.rstrip('/')}/{location}",
        on=_columns(raw.get("on"), "on", texts["name"]),
        order_by=_columns(raw.get("order_by"), "order_by", texts["name"]),
    )


def _relative(name: str) -> str:
    parts = [part for part in name.split("/") if part not in ("", ".")]
    if name.startswith("/") or not parts or ".." in parts:
        raise DatasetError(f"data file name {name!r} must be a relative path below the data folder")
    return "/".join(parts)


def _only_known(body: dict, known: tuple[str, ...], where: str) -> None:
    unknown = sorted(set(body) - set(known))
    if unknown:
        raise DatasetError(f"{where}: unsupported keys: {', '.join(map(repr, unknown))}")


def _columns(value: object, key: str, name: str) -> tuple[str, ...] | None:
    if value is None:
        return None
    columns = (value,) if isinstance(value, str) else value
    if not isinstance(columns, (list, tuple)):
        raise DatasetError(f"data file {name!r}: {key} must be a string or an array of strings")
    if not columns:
        raise DatasetError(f"data file {name!r}: {key} is empty")
    if not all(isinstance(c, str) and c for c in columns):
        raise DatasetError(f"data file {name!r}: {key} has entries that are not names")
    return tuple(columns)


def select_dataset(sets: tuple[DataSet, ...], name: str | None = None) -> DataSet:
    if not sets:
        raise DatasetError("no data sets are defined")
    names = ", ".join(s.name for s in sets)
    if name is None:
        if len(sets) > 1:
            raise DatasetError(f"several data sets are defined, name one of: {names}")
        return sets[0]
    chosen = [s for s in sets if s.name == name]
    if not chosen:
        raise DatasetError(f"unknown data set {name!r}; defined: {names}")
    return chosen[0]
