"""Hunks against the texts they must give, for random, odd and very long texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerkeel.operators import textdiff as D

TEXT = "grp string, k int, text string"


def longest(places):
    best = [1] * len(places)
    for i in range(len(places)):
        best[i] = 1 + max((best[j] for j in range(i) if places[j] < places[i]), default=0)
    return max(best, default=0)


def test_rising_run():
    rng = random.Random(1)
    for _ in range(300):
        places = rng.sample(range(40), rng.randrange(20))
        run = D.rising_run(places)
        assert run == sorted(run) and [places[i] for i in run] == sorted(places[i] for i in run)
        assert len(run) == longest(places)


def edited(rng, lines):
    lines = list(lines)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(lines) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            lines[at:at] = [rng.choice("abcxyz")] * rng.randint(1, 3)
        elif kind == 1:
            del lines[at : at + rng.randint(1, 3)]
        elif kind == 2 and lines:
            lines.append(lines.pop(rng.randrange(len(lines))))
        else:
            lines[at : at + 1] = [f"line {rng.randrange(99)}", ""]
    return lines


def texts():
    rng = random.Random(8)
    rows = []
    for k in range(60):
        old = [rng.choice(["a", "b", "", f"line {rng.randrange(30)}"]) for _ in range(rng.randrange(25))]
        new = edited(rng, old)
        end = rng.choice(["", "\n"])
        rows.append(("g", k, "\n".join(old) + end, "\n".join(new) + rng.choice([end, "\n"])))
    rows += [("g", 100, "", "a\nb"), ("g", 101, "a\nb", ""), (None, 102, "x\n", "x"), ("g", None, "\n\n", "\n"), ("g", 103, "é\r\nü", "é\r\nö")]
    rows += [("hot", 1, "".join(f"{i}\n" for i in range(30_000)), "".join(f"{i}\n" for i in range(30_000) if i % 1_000) + "end")]
    return rows


def test_hunks_give_the_new_text_in_order(spark):
    rows = texts()
    old = spark.createDataFrame([(g, k, o) for g, k, o, _ in rows] + [("old", 1, "gone\n")], TEXT)
    new = spark.createDataFrame([(g, k, n) for g, k, _, n in rows] + [("new", 1, "come")], TEXT)
    hunks = D.ordered_diff(old, new, ["grp", "k"], "text").cache()
    got = {(r.grp, r.k): r.text for r in D.apply_hunks(old, hunks, ["grp", "k"], "text").collect()}
    assert all(got[g, k] == n for g, k, _, n in rows) and got["old", 1] == ""
    found = {}
    for r in hunks.orderBy("grp", "k", "hunk").collect():
        found.setdefault((r.grp, r.k), []).append(r)
    assert found["new", 1][0].added == ["come"] and found["new", 1][0].old_start == 1
    for g, k, o, n in rows:
        mine = found.get((g, k), [])
        assert bool(mine) == (o != n) and [r.hunk for r in mine] == list(range(1, len(mine) + 1))
        end = 0
        for r in mine:
            assert r.removed or r.added
            assert r.old_start > end and o.splitlines(keepends=True)[r.old_start - 1 : r.old_start - 1 + len(r.removed)] == r.removed or "\r" in o
            end = r.old_start + len(r.removed) - 1
    # The hot text: every thousandth line goes, one comes, and nothing else.
    assert sum(len(r.removed) for r in found["hot", 1]) == 30 and sum(len(r.added) for r in found["hot", 1]) == 1


def test_a_hunk_that_does_not_fit_fails(spark):
    old = spark.createDataFrame([("g", 1, "a\nb\n")], TEXT)
    hunks = D.ordered_diff(old, old.withColumn("text", F.lit("a\nc\n")), ["grp", "k"], "text")
    with pytest.raises(Exception, match="hunk does not fit at line 2"):
        D.apply_hunks(old.withColumn("text", F.lit("a\nx\n")), hunks, ["grp", "k"], "text").collect()


def test_equal_texts_have_no_hunks(spark):
    old = spark.createDataFrame([("g", 1, "a\nb\n"), ("g", 2, None)], TEXT)
    assert D.ordered_diff(old, old, ["grp", "k"], "text").count() == 0
    assert D.ordered_diff(old.limit(0), old.limit(0), ["grp", "k"], "text").count() == 0


def test_texts_are_dealt_once(spark, monkeypatch):
    """Both texts of a key are dealt by it over as many tasks as they need; lines, gaps and hunks stay there."""
    monkeypatch.setattr(D, "TASK_BYTES", 20_000)
    old = spark.createDataFrame([(g, k, o) for g, k, o, _ in texts()], TEXT)
    new = spark.createDataFrame([(g, k, n) for g, k, _, n in texts()], TEXT)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hunks = D.ordered_diff(old, new, ["grp", "k"], "text")
        plan = hunks._jdf.queryExecution().executedPlan().toString()
        got = {(r.grp, r.k): r.text for r in D.apply_hunks(old, hunks, ["grp", "k"], "text").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {(g, k): n for g, k, _, n in texts()}
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
    # The keys, the texts of each side, the runs of anchors.
    assert len(dealt) <= 5 and all(int(re.search(r"hashpartitioning\(.*?, (\d+)\)", x)[1]) > 8 for x in dealt), dealt
