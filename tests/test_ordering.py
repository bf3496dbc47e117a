"""Positions and neighbours: the split way must equal the plain window."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerkeel.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds more than a third of the rows; one group key is null."""
    rng = random.Random(7)
    data = [("hot", i, rng.choice("abc"), rng.random() < 0.1) for i in range(400)]
    data += [(f"g{i % 60}", 1000 + i, rng.choice("abc"), rng.random() < 0.3) for i in range(500)]
    data += [(None, 5000 + i, "n", i == 3) for i in range(5)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "grp string, k bigint, v string, flag boolean").repartition(5)


def test_ordinal(skewed, rows):
    plain = ordering.ordinal(skewed, ["grp"], ["k"])
    split = ordering.ordinal(skewed, ["grp"], ["k"], hot_rows=10)
    assert rows(plain, "grp", "k", "idx") == rows(split, "grp", "k", "idx")
    assert plain.schema["idx"].dataType == split.schema["idx"].dataType


def test_previous_value(skewed, rows):
    plain = ordering.previous_value(skewed, ["grp"], ["k"], "v", "before")
    split = ordering.previous_value(skewed, ["grp"], ["k"], "v", "before", hot_rows=10)
    assert rows(plain, "grp", "k", "before") == rows(split, "grp", "k", "before")


def test_running_sum(skewed, rows):
    sums = [ordering.running_sum(skewed, ["grp"], ["k"], "k", "s", h) for h in (10, 10**6)]
    assert rows(sums[0], "grp", "k", "s") == rows(sums[1], "grp", "k", "s")


@pytest.mark.parametrize("ahead", [True, False])
def test_nearest_flagged(skewed, rows, ahead):
    def near(hot):
        return ordering.nearest_flagged(skewed, ["grp"], "k", F.col("flag"), "near", ahead, hot)

    got = rows(near(10), "grp", "k", "near")
    assert got == rows(near(10**6), "grp", "k", "near")
    data = [(r["grp"], r["k"], r["flag"]) for r in skewed.collect()]
    expected = []
    for grp, k, _ in data:
        others = [o for g, o, f in data if g == grp and f and (o > k if ahead else o < k)]
        expected.append((grp, k, (min(others) if ahead else max(others)) if others else None))
    assert got == sorted(expected, key=repr)


def test_nearest_flagged_with_equal_positions(spark, rows):
    data = [("a", i // 7, i % 11 == 0) for i in range(210)]
    df = spark.createDataFrame(data, "grp string, k bigint, flag boolean")
    near = [ordering.nearest_flagged(df, ["grp"], "k", F.col("flag"), "near", hot_rows=h) for h in (5, 10**6)]
    assert rows(near[0]) == rows(near[1])


def test_repeats(skewed, rows):
    again = ordering.repeats(skewed, ["grp", "v"], "k", "first")
    data = [(r["grp"], r["v"], r["k"]) for r in skewed.collect()]
    firsts = {}
    for grp, v, k in data:
        firsts[grp, v] = min(k, firsts.get((grp, v), k))
    expected = [(g, v, k, firsts[g, v]) for g, v, k in data if k > firsts[g, v]]
    assert rows(again, "grp", "v", "k", "first") == sorted(expected, key=repr)
