"""Entry scalars against pathlib over many short paths."""

import itertools
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from ledgerkeel.functions import entries as E

PATHS = sorted({"".join(p) for n in range(1, 6) for p in itertools.product(["/", ".", "..", "a", "b_c.sql"], repeat=n)} | {""})


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").repartition(4)


def expected_norm(path):
    if path.startswith("/"):
        return None, "absolute"
    pure = PurePosixPath(path)
    if str(pure) == ".":
        return None, "empty"
    if ".." in pure.parts:
        return None, "dot_segment"
    return str(pure), None


def test_normalize_entry(paths):
    got = {r["path"]: (r["n"]["value"], r["n"]["error"]) for r in paths.select("path", E.normalize_entry(F.col("path")).alias("n")).collect()}
    assert got == {p: expected_norm(p) for p in PATHS}


def test_entry_within(paths):
    got = {r["path"]: r["w"] for r in paths.select("path", E.entry_within(F.col("path"), "a", ".sql").alias("w")).collect()}
    for path in PATHS:
        value, _ = expected_norm(path)
        assert got[path] == (value is not None and value.startswith("a/") and value.endswith(".sql")), path


def test_basename_and_status(paths):
    got = paths.select("path", E.basename(F.col("path")).alias("b"), E.status_path(F.col("path")).alias("s")).collect()
    for r in got:
        assert r["b"] == PurePosixPath(r["path"]).name or ".." in r["path"], r
        assert r["s"].lstrip("/") == PurePosixPath(r["path"]).as_posix().lstrip("/"), r


@pytest.mark.parametrize(
    "entry,version",
    [
        ("migrations/001_init.sql", "001"),
        ("migrations/a/20240101_x_y.sql", "20240101"),
        ("_x.sql", "_x"),
        ("plain.sql", "plain"),
        ("noext_1", "noext"),
        (".sql", ""),
    ],
)
def test_version_of(spark, entry, version):
    df = spark.createDataFrame([(entry,)], "e string")
    assert df.select(E.version_of(F.col("e"))).first()[0] == version


def test_companion_and_style(spark):
    df = spark.createDataFrame(
        [("p", "migrations/a/b.sql"), ("p", "x\\y.sql"), ("b", "b.sql"), ("m", "b.sql"), ("m", "a/b.sql")], "g string, e string"
    )
    companions = {r[0] for r in df.select(E.companion_entry(F.col("e"))).collect()}
    assert "checkpoints/a/b.sql" in companions
    styles = {r["g"]: r["s"] for r in df.groupBy("g").agg(E.path_style(F.col("e")).alias("s")).collect()}
    assert styles == {"p": "path", "b": "basename", "m": "mixed"}
    assert df.where(F.lit(False)).agg(E.path_style(F.col("e"))).first()[0] == "basename"
