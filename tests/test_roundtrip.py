"""Round trips of every kind of step against states built row by row."""

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from ledgerkeel.operators import ordering, replay, roundtrip
from ledgerkeel.session import written

CHANGE = "grp string, idx bigint, mode string, k int, v int"
INVERSE = "grp string, idx bigint, op string, k int, v int"
ROW = "grp string, k int, v int"


def step(state, mode, rows):
    if mode == "replace":
        return list(rows)
    if mode == "upsert":
        state = [r for r in state if r[0] is None or r[0] not in {k for k, _ in rows}]
    return state + list(rows)


def roll(state, ops):
    """The inverse by the rules of the module docstring."""
    if any(op in ("replace", "clear") for op, *_ in ops):
        left = []
    else:
        gone = {k for op, k, _ in ops if op in ("upsert", "delete") and k is not None}
        left = [r for r in state if r[0] not in gone]
        for op, k, v in ops:
            if op == "remove" and (k, v) in left:
                left.remove((k, v))
    return left + [(k, v) for op, k, v in ops if op in ("upsert", "insert", "replace")]


def history(seed):
    """Random steps with right, wrong, odd and absent inverses; a hot group, equal rows, null keys."""
    rng = random.Random(seed)
    anchor, sets, changes, inverses, want = [], [], [], [], []
    for grp in ("hot", "a", "b", None):
        state = [(rng.choice([0, 1, None]), rng.randrange(3)) for _ in range(rng.randrange(4))]
        anchor += [(grp, k, v) for k, v in state]
        for idx in range(1, (70 if grp == "hot" else 6) + 1):
            mode = rng.choice(["replace", "insert", "upsert", "upsert"])
            new = [(rng.choice([0, 1, 2, 3, None]), rng.randrange(3)) for _ in range(rng.randrange(4))]
            before, state = state, step(state, mode, new)
            sets.append((grp, idx, mode))
            changes += [(grp, idx, mode, k, v) for k, v in new]
            kind = rng.random()
            if kind < 0.15:
                ops = []
            elif mode == "replace" or kind < 0.3:
                ops = [("clear", None, None)] * (not before) + [("replace", k, v) for k, v in before]
            elif mode == "insert":
                ops = [("remove", k, v) for k, v in new]
            else:
                keys = {k for k, _ in new if k is not None}
                ops = [("delete", k, None) for k in keys] + [("insert", k, v) for k, v in before if k in keys]
                ops += [("remove", k, v) for k, v in new if k is None]
            if kind > 0.7 and ops:
                odd = rng.randrange(4)
                if odd == 0:
                    ops = ops[1:]
                elif odd == 1:
                    ops.append(rng.choice([("remove", 7, 7), ("delete", 9, 0), ("remove", None, 1), ("remove", 0, 1)]))
                elif odd == 2:
                    ops.append(("upsert", rng.choice([0, 1, None]), 1))
                else:
                    ops[0] = (ops[0][0], ops[0][1], (ops[0][2] or 0) + 1)
            inverses += [(grp, idx, *op) for op in ops]
            if not ops:
                want.append((grp, idx, mode, "skipped", 0))
                continue
            after = roll(state, ops)
            status = "checked" if Counter(after) == Counter(before) else "mismatch"
            want.append((grp, idx, mode, status, len(after) - len(before)))
    inverses += [("a", 99, "delete", 1, 1), ("zz", 1, "insert", 1, 1)]
    return anchor, sets, changes, inverses, want


@pytest.mark.parametrize("hot_rows", [4, 10**6])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_states_built_row_by_row(spark, rows, seed, hot_rows):
    anchor, sets, changes, inverses, want = history(seed)
    got = roundtrip.state_roundtrip(
        spark.createDataFrame(changes, CHANGE),
        spark.createDataFrame(inverses, INVERSE),
        ["k"],
        spark.createDataFrame(anchor, ROW),
        spark.createDataFrame(sets, "grp string, idx bigint, mode string"),
        hot_rows,
    )
    assert rows(got) == sorted(want, key=repr)
    assert {"checked", "mismatch", "skipped"} == {w[3] for w in want}


def test_wrong_with_the_right_number_of_rows(spark, rows):
    changes = spark.createDataFrame([("g", 1, "insert", 1, 5), ("g", 2, "replace", 1, 6)], CHANGE)
    inverses = spark.createDataFrame([("g", 1, "remove", 1, 5), ("g", 2, "replace", 1, 7)], INVERSE)
    got = roundtrip.state_roundtrip(changes, inverses, ["k"])
    assert rows(got) == [("g", 1, "insert", "checked", 0), ("g", 2, "replace", "mismatch", 0)]


def test_unknown_op_fails(spark):
    changes = spark.createDataFrame([("g", 1, "insert", 1, 5)], CHANGE)
    inverses = spark.createDataFrame([("g", 1, "undo", 1, 5)], INVERSE)
    with pytest.raises(PySparkException, match="unknown op: undo"):
        roundtrip.state_roundtrip(changes, inverses, ["k"]).collect()


def test_equal_states_have_equal_digests(spark):
    """A state that comes back has its digest back, however it came about."""
    data = [("g", 1, "insert", 1, 5), ("g", 2, "upsert", 1, 6), ("g", 3, "upsert", 1, 5), ("g", 4, "replace", 2, 5), ("g", 5, "replace", 1, 5)]
    changes = spark.createDataFrame(data, CHANGE)
    ranges = replay.capture_checkpoints(changes, ["k"])
    digests = {r.idx: (r["rows"], r.digest) for r in roundtrip.state_digests(ranges, ["k", "v"], changes).collect()}
    assert digests[1] == digests[3] == digests[5] and len(set(digests.values())) == 3


def test_replay_has_no_window(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        base = spark.range(1_000).selectExpr("'hot' AS grp", "id + 1 AS idx", "'upsert' AS mode", "id % 50 AS k", "id AS v")
        by_group = base.repartition("grp")
        plan = replay.replay_tail(by_group, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning(grp#" in plan and "k#" in plan.split("hashpartitioning", 1)[1]
        ranges = replay.capture_checkpoints(by_group, ["k"])._jdf.queryExecution().executedPlan().toString()
        window = ranges[ranges.index("Window") :]
        assert "k#" in window[window.index("hashpartitioning(") :].split(")", 1)[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_inverses_are_read_once(spark):
    changes = spark.createDataFrame([("g", 1, "insert", 1, 5), ("g", 2, "upsert", 1, 6)], CHANGE)
    inverses = written(spark.createDataFrame([("g", 1, "remove", 1, 5), ("g", 2, "upsert", 1, 5)], INVERSE), "given")
    got = roundtrip.state_roundtrip(changes, inverses, ["k"])
    assert {r.status for r in got.collect()} == {"checked"}
    assert inverses.inputFiles() and not set(inverses.inputFiles()) & set(got.inputFiles())


def test_tasks_do_not_grow_with_the_history(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 50)
    data = [(f"g{i % 40}", i, ("insert", "upsert", "replace")[i % 3], i % 7, i) for i in range(1_000)]
    changes = spark.createDataFrame(data, CHANGE)
    ranges = replay.capture_checkpoints(changes, ["k"])
    digests = roundtrip.state_digests(ranges, ["k", "v"], changes)
    assert ranges.rdd.getNumPartitions() == 20 and digests.rdd.getNumPartitions() >= 20
    sizes = {(r.grp, r.idx): r.rows for r in replay.checkpoint_sizes(ranges, changes).collect()}
    assert {(r.grp, r.idx): r["rows"] for r in digests.collect()} == sizes and len(sizes) == 1_000


def test_ranges_by_group_equal_ranges_by_key(spark, rows):
    """Groups that fit a task, and the same ones beyond the limit; null groups and keys, given empty replaces."""
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), i // 2, ("insert", "upsert", "replace")[i // 2 % 3], rng.choice([1, 2, None]), i) for i in range(60)]
    changes = spark.createDataFrame(data, CHANGE)
    sets = replay.change_sets(changes).unionByName(spark.createDataFrame([("a", 40, "replace")], "grp string, idx bigint, mode string"))
    for given in (None, sets):
        one, other = (replay.validity_ranges(changes, ["k"], sets=given, hot_rows=h) for h in (1_000, 3))
        assert one.columns == other.columns and rows(one) == rows(other)
