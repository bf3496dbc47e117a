"""Section split and content check against plain Python over random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerkeel.functions import sections as S

ENDS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
MARK = re.compile(r"\s*--\s*migrate:(up|down)\b.*", re.IGNORECASE)


def split_plain(text):
    parts = {"up": "", "down": ""}
    now, kinds = "up", []
    for line in text.splitlines(keepends=True):
        hit = MARK.fullmatch(line.rstrip("\r\n"))
        if hit:
            now = hit.group(1).lower()
            kinds.append(now)
        else:
            parts[now] += line
    return parts["up"], parts["down"], kinds


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bits = ["-- migrate:up", " --migrate:DOWN x", "--  Migrate:up;", "-- migrate:upper", "-- migrate:up_", "x -- migrate:up", "a", "", "  ", "\t-- migrate:down", "\u3000--\xa0migrate:down"]
    made = ["", "-- migrate:up", "\n-- migrate:up\n"]
    for _ in range(600):
        ends = ENDS if rng.random() < 0.5 else ["\n", "\r\n"]
        made.append("".join(rng.choice(bits) + rng.choice(ends) for _ in range(rng.randrange(7))) + rng.choice(["", "end"]))
    return made


def test_split_sections(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = S.split_sections(df, "t", "up", "down", "kinds", "flagged").collect()
    for r in got:
        assert (r["up"], r["down"], r["kinds"]) == split_plain(r["t"]), repr(r["t"])


def test_marker_flag(spark):
    df = spark.createDataFrame([("-- migrate:up TRANSACTION:false\nx",), ("-- migrate:up\n-- transaction:false",)], "t string")
    flags = [r["f"] for r in S.split_sections(df, "t", "u", "d", flagged="f").collect()]
    assert flags == [True, False]


def content_plain(text):
    depth, i = 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if depth:
            step = {"/*": 1, "*/": -1}.get(two, 0)
            depth += step
            i += 2 if step else 1
        elif two == "--":
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif two == "/*":
            depth, i = 1, i + 2
        elif text[i].isspace():
            i += 1
        else:
            return not (text[i] in "'\"`" and i == len(text) - 1)
    return False


def test_has_content(spark):
    rng = random.Random(5)
    bits = ["/*", "*/", "--", "\n", " ", "'", '"', "x", "-", "/", "*", "`", "\u2003"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in set(made)], "t string")
    for r in df.select("t", S.section_has_content(F.col("t")).alias("c")).collect():
        assert r["c"] == content_plain(r["t"]), repr(r["t"])


def test_long_text_is_fine(spark):
    long = "/* " + "word " * 200_000 + "*/" + "-- c\n" * 50_000
    df = spark.createDataFrame([(long,), (long + "x",)], "t string")
    assert [r[0] for r in df.select(S.section_has_content(F.col("t"))).collect()] == [False, True]
    assert S.split_sections(df, "t").select("up").first()[0] == long


@pytest.mark.parametrize("text,short", [("a  b\n c ", "a b c"), ("x" * 120, "x" * 120), ("y" * 121, "y" * 117 + "...")])
def test_excerpt(spark, text, short):
    assert spark.createDataFrame([(text,)], "t string").select(S.excerpt(F.col("t"))).first()[0] == short


def test_valid_text(spark):
    df = spark.createDataFrame([(b"ok",), (b"\xff\xfe",)], "p binary")
    assert [r[0] for r in df.select(S.valid_text(F.col("p"))).collect()] == ["ok", None]
