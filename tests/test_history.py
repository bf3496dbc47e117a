"""Divergence, applied prefixes, anchors, drift and differences."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerkeel.errors import LedgerError, StateError
from ledgerkeel.operators import compare, history, ledger

STEP = "grp string, idx bigint, version string, entry string, payload_digest string"


def step(i, name=None, digest="d", version=None, grp="g"):
    return (grp, i, version or str(i), name or f"migrations/{i}_x.sql", digest)


def steps(spark, *data):
    return spark.createDataFrame(list(data), STEP)


@pytest.mark.parametrize(
    "base,head,expected",
    [
        ([step(1), step(2)], [step(1), step(2)], None),
        ([step(1), step(2)], [step(1), step(2, digest="e")], (2, "migration_digest", "d", "e")),
        ([step(1)], [step(1), step(2)], (2, "step_count", "1", "2")),
        ([step(1), step(2), step(3)], [step(1)], (2, "step_count", "3", "1")),
        ([], [step(1)], (1, "step_count", "0", "1")),
        ([step(1, name="a", version="v")], [step(1, name="b", version="w")], (1, "version", "v", "w")),
        ([step(1, name="a")], [step(1, name="b", digest="e")], (1, "migration_file", "a", "b")),
        ([step(1), step(2)], [step(1, digest="e")], (1, "migration_digest", "d", "e")),
    ],
)
def test_first_divergence(spark, base, head, expected):
    got = history.first_divergence(steps(spark, *base), steps(spark, *head)).collect()
    assert [tuple(r)[1:] for r in got] == ([] if expected is None else [expected])


def test_random_divergence(spark):
    rng = random.Random(11)
    lists = {g: ([rng.choice("ab") for _ in range(rng.randrange(6))], [rng.choice("ab") for _ in range(rng.randrange(6))]) for g in map(str, range(200))}
    base = steps(spark, *[step(i, digest=d, grp=g) for g, (b, _) in lists.items() for i, d in enumerate(b, 1)])
    head = steps(spark, *[step(i, digest=d, grp=g) for g, (_, h) in lists.items() for i, d in enumerate(h, 1)])
    got = {r["grp"]: r["divergence_index"] for r in history.first_divergence(base, head).collect()}
    for grp, (b, h) in lists.items():
        same = 0
        while same < min(len(b), len(h)) and b[same] == h[same]:
            same += 1
        assert got.get(grp) == (None if b == h else same + 1)


def test_target_name_and_seed(spark):
    headers = spark.createDataFrame([("g", "other")], "grp string, target string")
    found = history.ledger_divergence(headers, steps(spark, step(1)), steps(spark, step(1))).collect()
    assert [tuple(r) for r in found] == [("g", 1, "target_name", "other", "g")]
    entries = spark.createDataFrame([("g", "migrations/1.sql", "x")], "grp string, entry string, payload string")
    seeds = [spark.createDataFrame([("g", e, "g")], "grp string, engine string, target string") for e in ("a", "b")]
    one, two = [ledger.build_steps(entries, None, s) for s in seeds]
    assert one.first()["chain_hash"] != two.first()["chain_hash"]
    assert history.state_divergence(one, two).isEmpty()
    groups = [spark.createDataFrame([("g", t)], "grp string, target string") for t in ("x", "y")]
    assert history.target_divergence(*groups).first()["field"] == "target_name"


def test_state_divergence_needs_clean_states(spark):
    found = spark.createDataFrame([("g",)], "grp string")
    with pytest.raises(LedgerError):
        history.state_divergence(steps(spark, step(1)), steps(spark, step(1)), found, None)


NAMES = ["migrations/1_a.sql", "migrations/x/2_b.sql", "migrations/y/2_b.sql"]


@pytest.mark.parametrize(
    "applied,style,status",
    [
        (["migrations/1_a.sql"], "path", "ok"),
        (["1_a.sql"], "basename", "ok"),
        (["migrations\\1_a.sql", "migrations\\x\\2_b.sql"], "path", "ok"),
        (["1_a.sql", "2_b.sql"], "basename", "ok"),
        (["1_a.sql", "2_b.sql", "2_b.sql"], "basename", "duplicate_basenames"),
        (["migrations/1_a.sql", "2_b.sql"], "mixed", "mixed_styles"),
        (["migrations/x/2_b.sql"], "path", "not_prefix"),
        (["2_b.sql"], "basename", "not_prefix"),
        (NAMES + ["migrations/z.sql"], "path", "ok"),
    ],
)
def test_prefix_check(spark, applied, style, status):
    own = steps(spark, *[step(i, n) for i, n in enumerate(NAMES, 1)])
    log = spark.createDataFrame([("g", i, e) for i, e in enumerate(applied, 1)], "grp string, pos bigint, entry string")
    row = history.prefix_check(own, log).first()
    assert (row["style"], row["status"], row["applied_count"]) == (style, status, len(applied))
    if status != "ok":
        with pytest.raises(StateError, match=status):
            history.require_prefix(history.prefix_check(own, log), "x")


def test_relation_and_guards(spark, rows):
    own = spark.createDataFrame([("b",), ("b",), ("e",), ("n",)], "grp string")
    log = spark.createDataFrame([("b",), ("e",), ("a",)], "grp string")
    relation = history.live_relation(own, log)
    assert rows(relation, "grp", "relation") == [("a", "ahead"), ("b", "behind"), ("e", "equal"), ("n", "behind")]
    with pytest.raises(StateError, match="ahead"):
        history.require_not_ahead(relation, "up")
    history.require_not_ahead(relation.where("grp <> 'a'"), "up")


def test_anchor_and_expected(spark, rows):
    own = steps(spark, step(1), step(2), step(3), step(1, grp="h")).withColumn(
        "snapshot_entry", F.replace("entry", F.lit("migrations"), F.lit("checkpoints"))
    )
    found = spark.createDataFrame([("g", 3)], "grp string, divergence_index bigint")
    plan = history.anchor_tail(own, found)
    assert rows(plan, "grp", "anchor_index", "tail_count") == [("g", 2, 1), ("h", 1, 0)]
    assert rows(history.tail_steps(own, plan), "grp", "idx") == [("g", 3)]
    assert rows(history.anchor_tail(own, found, clean=True), "grp", "anchor_index", "tail_count") == [("g", 0, 3), ("h", 0, 1)]
    snaps = spark.createDataFrame([("g", "checkpoints/2_x.sql", "s2")], "grp string, entry string, payload string")
    anchors = history.select_anchor(plan, own, snaps)
    assert rows(anchors, "grp", "payload", "error") == sorted([("g", "s2", None), ("h", None, "no_snapshot")], key=repr)
    assert rows(history.select_anchor(plan, own.where("idx < 2"), snaps).where("grp = 'g'"), "error") == [("no_step",)]
    heads = spark.createDataFrame([("g", "top")], "grp string, payload string")
    asked = spark.createDataFrame([("g", i) for i in (-1, 0, 1, 2, 3, 4)] + [("h", 1)], "grp string, index bigint")
    got = rows(history.expected_at(asked, own, snaps, heads), "grp", "index", "source", "payload", "error")
    assert got == sorted(
        [
            ("g", -1, None, None, "out_of_range"), ("g", 0, "zero", "", None), ("g", 1, "snapshot", None, "missing"),
            ("g", 2, "snapshot", "s2", None), ("g", 3, "head", "top", None), ("g", 4, None, None, "out_of_range"),
            ("h", 1, "head", None, "missing"),
        ],
        key=repr,
    )


ROW = "grp string, k int, v string"


def test_drift_and_plan(spark, rows):
    live = spark.createDataFrame([("same", 1, "a"), ("same", 1, "a"), ("off", 1, "a"), ("ahead", 1, "a")], ROW)
    want = spark.createDataFrame([("same", 1, "a"), ("same", 1, "a"), ("off", 1, "b"), ("ahead", 1, "a")], ROW)
    data = [("same", 1, 1, "equal"), ("off", 2, 1, "behind"), ("ahead", 1, 2, "ahead"), ("empty", 0, 0, "equal")]
    relation = spark.createDataFrame(data, "grp string, head_count bigint, applied_count bigint, relation string")
    assert rows(compare.drift(live, want, relation), "grp", "drifted") == [("ahead", True), ("empty", False), ("off", True), ("same", False)]
    assert rows(compare.plan_summary(live, want, relation), "grp", "matches") == [("ahead", False), ("empty", True), ("off", False), ("same", True)]
    assert rows(compare.plan_diff(live.where("grp <> 'same'"), want.where("grp <> 'same'"), ["grp", "k"], relation), "grp", "change", "old_value", "new_value") == sorted(
        [("ahead", "added", None, "a"), ("off", "changed", "a", "b")], key=repr
    )
    with pytest.raises(StateError, match="differs"):
        compare.verify_expected(live, want, "postcheck")
    compare.verify_expected(live, live, "postcheck")


def test_multiset_difference_is_both_except_all(spark, rows):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.randrange(5), None if rng.random() < 0.3 else "x") for _ in range(60)], "a int, b string")
    right = spark.createDataFrame([(rng.randrange(5), None if rng.random() < 0.3 else "x") for _ in range(60)], "a int, b string")
    found = compare.multiset_difference(left, right).collect()
    assert sum(r["copies"] for r in found if r["copies"] > 0) == left.exceptAll(right).count()
    assert -sum(r["copies"] for r in found if r["copies"] < 0) == right.exceptAll(left).count()


def test_equal_states_on_every_type(spark, rows):
    """A null differs from the text "null", microseconds and map values count."""
    base = "SELECT 'g' AS grp, TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' AS t, map('a', 1, 'b', 2) AS m, CAST(NULL AS STRING) AS n, 1.50D AS x, X'00' AS b"
    changed = [base.replace("000001'", "000002'"), base.replace("'b', 2", "'b', 3"), base.replace("CAST(NULL AS STRING)", "'null'"), base.replace("X'00'", "X'01'")]
    live = spark.sql(base)
    assert rows(compare.equal_states(live, spark.sql(base.replace("map('a', 1, 'b', 2)", "map('b', 2, 'a', 1)"))), "matches") == [(True,)]
    for other in changed:
        assert rows(compare.equal_states(live, spark.sql(other)), "missing_rows", "extra_rows", "matches") == [(1, 1, False)]
    assert rows(compare.equal_states(live.union(live), live), "extra_rows", "matches") == [(1, False)]


@pytest.mark.parametrize("narrow_first", [False, True])
def test_keyed_difference(spark, rows, narrow_first):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (None, "x", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", 2), (None, "y", 1)], "k int, v string, n int")
    assert rows(compare.keyed_difference(old, new, ["k"], narrow_first=narrow_first)) == sorted(
        [
            (2, "changed", "n", "1", None), (3, "removed", "v", "c", None), (3, "removed", "n", "1", None),
            (4, "added", "v", None, "d"), (4, "added", "n", None, "2"), (None, "changed", "v", "x", "y"),
        ],
        key=repr,
    )
    with pytest.raises(PySparkException, match="repeated key"):
        compare.keyed_difference(old.union(old), new, ["k"], narrow_first=narrow_first).collect()


def test_line_diff(spark, rows):
    old = spark.createDataFrame([(1, "a\nb\nb\n"), (2, "same")], "k int, t string")
    new = spark.createDataFrame([(1, "b\na\nc"), (2, "same\n")], "k int, t string")
    assert rows(compare.line_diff(old, new, ["k"], "t")) == [(1, "b", "removed", 1), (1, "c", "added", 1)]


def test_array_changes_are_told_apart(spark, rows):
    old = spark.createDataFrame([(1, ["a, b"]), (2, ["x"])], "k int, v array<string>")
    new = spark.createDataFrame([(1, ["a", "b"]), (2, ["x"])], "k int, v array<string>")
    for narrow in (False, True):
        assert rows(compare.keyed_difference(old, new, ["k"], narrow_first=narrow), "k", "change", "column") == [(1, "changed", "v")]


def test_null_digests_diverge_and_targets_are_compared(spark, rows):
    steps = "grp string, idx long, version string, entry string, payload_digest string"
    base = spark.createDataFrame([("g", 1, "1", "a", None), ("h", 1, "1", "a", "x")], steps)
    head = spark.createDataFrame([("g", 1, "1", "a", "d"), ("h", 1, "1", "a", "x")], steps)
    assert rows(history.first_divergence(base, head), "grp", "field") == [("g", "migration_digest")]
    names = lambda t: spark.createDataFrame([("g", "t"), ("h", t)], "grp string, target string")
    got = history.state_divergence(base, head, base_groups=names("a"), head_groups=names("b"))
    assert rows(got, "grp", "field") == [("g", "migration_digest"), ("h", "target_name")]


def test_undecodable_snapshots_are_not_served(spark, rows):
    steps = spark.createDataFrame([("g", 1, "c/1"), ("g", 2, "c/2")], "grp string, idx long, snapshot_entry string")
    snaps = spark.createDataFrame([("g", "c/1", bytearray(b"\xff")), ("g", "c/2", bytearray(b"ok"))], "grp string, entry string, payload binary")
    heads = spark.createDataFrame([("g", bytearray(b"h"))], "grp string, payload binary")
    asked = spark.createDataFrame([("g", 0), ("g", 1), ("g", 2), ("g", 3)], "grp string, index long")
    got = rows(history.expected_at(asked, steps, snaps, heads), "index", "payload", "error")
    assert got == [(0, "", None), (1, None, "not_utf8"), (2, "h\n", None), (3, None, "out_of_range")] or got == [
        (0, "", None), (1, None, "not_utf8"), (2, "h", None), (3, None, "out_of_range")
    ]
