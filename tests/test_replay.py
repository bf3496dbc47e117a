"""Replay against a step-by-step simulation, rollback, bootstrap and publishing."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerkeel.errors import StateError
from ledgerkeel.operators import history, publish, replay
from ledgerkeel.plans import live, publishing

CHANGE = "grp string, idx bigint, mode string, k int, v int"
ROW = "grp string, k int, v int"


def make(seed, modes, groups=("hot", "a", "b", "c")):
    """Random change-sets; the hot group has most of them, and null keys occur."""
    rng = random.Random(seed)
    sets, changes, anchor, n = [], [], [], 0
    for grp in groups:
        for _ in range(rng.randrange(4)):
            anchor.append((grp, rng.choice([0, 1, 2, None]), n := n + 1))
        for idx in range(1, (60 if grp == "hot" else rng.randrange(8)) + 1):
            mode = rng.choice(modes)
            sets.append((grp, idx, mode))
            keys = [0] if rng.random() < 0.5 else rng.sample([0, 1, 2, 3], rng.randrange(4))
            if mode != "upsert" and keys:
                keys += [keys[0], None]
            elif rng.random() < 0.2:
                keys.append(None)
            for key in keys:
                changes.append((grp, idx, mode, key, n := n + 1))
    return sets, changes, anchor


def simulate(sets, changes, anchor, upto=None):
    states = {}
    for grp, key, value in anchor:
        states.setdefault(grp, []).append((key, value))
    for grp, idx, mode in sorted(sets):
        if upto is not None and idx > upto(grp):
            continue
        rows = [(k, v) for g, i, _, k, v in changes if (g, i) == (grp, idx)]
        state = states.get(grp, [])
        if mode == "replace":
            state = []
        elif mode == "upsert":
            state = [(k, v) for k, v in state if k is None or k not in {x for x, _ in rows}]
        states[grp] = state + rows
    return sorted(((g, k, v) for g, s in states.items() for k, v in s), key=repr)


ALL = ["replace", "insert", "upsert", "upsert", "upsert"]


@pytest.mark.parametrize("hot_rows", [5, 10**6])
@pytest.mark.parametrize("seed,modes", [(1, ALL), (2, ALL), (3, ["upsert"]), (4, ["insert", "upsert"])])
def test_replay_equals_simulation(spark, rows, seed, modes, hot_rows):
    sets, changes, anchor = make(seed, modes)
    frames = [spark.createDataFrame(d, s) for d, s in ((changes, CHANGE), (anchor, ROW), (sets, "grp string, idx bigint, mode string"))]
    ranges = replay.capture_checkpoints(frames[0], ["k"], frames[1], frames[2], hot_rows).cache()
    assert rows(replay.replay_tail(frames[0], ["k"], frames[1], frames[2]), "grp", "k", "v") == simulate(sets, changes, anchor)
    for k in (0, 1, 3, 30, 60):
        assert rows(replay.state_at(ranges, k), "grp", "k", "v") == simulate(sets, changes, anchor, lambda g: k)
    sizes = {(r["grp"], r["idx"]): r["rows"] for r in replay.checkpoint_sizes(ranges, frames[2], hot_rows).collect()}
    for grp, idx in [(g, i) for g, i, _ in sets if i in (1, 2, 5, 40)]:
        state = simulate(sets, changes, anchor, lambda g: idx)
        assert sizes[grp, idx] == sum(1 for g, _, _ in state if g == grp)


def test_replay_upserts(spark, rows):
    sets, changes, anchor = make(5, ["upsert"])
    changes = [c for c in changes if c[3] is not None]
    anchor = [(g, k, max(v for a, b, v in anchor if (a, b) == (g, k))) for g, k in {(g, k) for g, k, _ in anchor if k is not None}]
    got = replay.replay_upserts(spark.createDataFrame(changes, CHANGE), ["k"], spark.createDataFrame(anchor, ROW))
    assert rows(got, "grp", "k", "v") == simulate(sets, changes, anchor)


def test_pending_rollback_and_bootstrap(spark, rows):
    sets, changes, _ = make(6, ALL)
    done = {"hot": 20, "a": 0, "b": 2}
    df = spark.createDataFrame(changes, CHANGE)
    set_df = spark.createDataFrame(sets, "grp string, idx bigint, mode string")
    applied = spark.createDataFrame(list(done.items()), "grp string, applied_count bigint")
    live = spark.createDataFrame(simulate(sets, changes, [], lambda g: done.get(g, 0)), ROW)
    full = simulate(sets, changes, [])
    assert rows(replay.apply_pending(live, df, applied, ["k"], set_df), "grp", "k", "v") == full
    kept = replay.apply_pending(live, df, applied, ["k"], set_df, create_missing=False)
    assert rows(kept, "grp", "k", "v") == [r for r in full if r[0] in done]
    ranges = replay.capture_checkpoints(df, ["k"], None, set_df)
    for n in (1, 3, 100):
        back = simulate(sets, changes, [], lambda g: max(done.get(g, 0) - n, 0))
        assert rows(replay.rollback(ranges, applied, n), "grp", "k", "v") == back
    with pytest.raises(StateError):
        replay.rollback(ranges, applied, 0)
    head = spark.createDataFrame(full, ROW)
    assert rows(replay.bootstrap(head, applied)) == [r for r in full if done.get(r[0], 0) == 0]
    assert replay.verified_equal(replay.replay_tail(df, ["k"], None, set_df).select("grp", "k", "v"), head).isEmpty()


def test_status_of_operations(spark, rows):
    own = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "grp string")
    log = spark.createDataFrame([("a",), ("b",), ("z",)], "grp string")
    relation = history.live_relation(own, log)
    prefix = spark.createDataFrame([("a", "not_prefix"), ("b", "ok")], "grp string, status string")
    assert rows(replay.pending_status(own, relation, prefix), "grp", "after_index", "status") == [
        ("a", 1, "not_prefix"), ("b", 1, "up_to_date"), ("c", 1, "applied"), ("z", 1, "no_steps"),
    ]
    assert rows(replay.bootstrap_status(own, relation)) == [("a", 1, 1, "refused"), ("b", 1, 1, "refused"), ("c", 0, 1, "loaded")]


@pytest.mark.parametrize("hot_rows", [2, 10**6])
def test_rollback_roundtrip(spark, rows, hot_rows):
    changes = [("g", 1, "upsert", 1, 10), ("g", 1, "upsert", 2, 20), ("g", 2, "upsert", 1, 11), ("g", 3, "upsert", 9, 90), ("g", 4, "upsert", 3, 30), ("g", 5, "upsert", 1, 12)]
    inverses = [
        ("g", 1, "delete", 1, None), ("g", 1, "delete", 2, None),
        ("g", 2, "upsert", 1, 10), ("g", 2, "upsert", 2, 20),
        ("g", 4, "delete", 3, None), ("g", 4, "delete", 2, None),
        ("g", 5, "upsert", 1, 10),
    ]
    got = replay.rollback_roundtrip(
        spark.createDataFrame(changes, CHANGE),
        spark.createDataFrame(inverses, "grp string, idx bigint, op string, k int, v int"),
        ["k"],
        spark.createDataFrame([("g", 8, 80)], ROW),
        hot_rows,
    )
    assert rows(got) == [("g", 1, "checked", 0), ("g", 2, "checked", 0), ("g", 3, "skipped", 0), ("g", 4, "mismatch", 1), ("g", 5, "mismatch", 1)]


ART = "grp string, entry string, payload string"


def art(spark, *data):
    return spark.createDataFrame([("g", *d) for d in data], ART)


def test_publish(spark, rows):
    want = art(spark, ("schema.sql", "x"), ("checkpoints/1.sql", "a"), ("checkpoints/2.sql", "new"))
    have = art(spark, ("checkpoints/1.sql", "a"), ("checkpoints/2.sql", "old"), ("checkpoints/9.sql", "z"), ("notes", "n"))
    delta = publish.publish_delta(want, have)
    assert rows(delta, "entry", "action") == [
        ("checkpoints/1.sql", "keep"), ("checkpoints/2.sql", "write"), ("checkpoints/9.sql", "delete"), ("notes", "keep"), ("schema.sql", "write"),
    ]
    after = publish.apply_delta(want, have, delta)
    assert rows(after, "entry", "payload") == [("checkpoints/1.sql", "a"), ("checkpoints/2.sql", "new"), ("notes", "n"), ("schema.sql", "x")]
    again = publish.publish_delta(want, after)
    assert rows(publish.apply_summary(again)) == [("g", False, 0, 4)]
    assert publish.apply_result(again).isEmpty()
    assert [r["entry"] for r in publish.apply_result(delta).collect()] == ["checkpoints/2.sql", "checkpoints/9.sql", "schema.sql"]


def test_delta_overlap(spark, rows):
    writes = art(spark, ("a", ""), ("a", ""), ("b", ""), ("c", ""))
    deletes = art(spark, ("b", ""), ("d", ""), ("d", ""))
    assert rows(publish.check_delta_overlap(writes, deletes), "entry", "problem") == [("a", "duplicate_write"), ("b", "write_and_delete")]
    with pytest.raises(StateError):
        publish.require_no_overlap(writes, deletes)


def test_carry_forward_gap(spark, rows):
    steps = spark.createDataFrame([("g", i, f"checkpoints/{i}.sql") for i in (1, 2, 3)], "grp string, idx bigint, snapshot_entry string")
    plan = spark.createDataFrame([("g", 2)], "grp string, anchor_index bigint")
    stored = art(spark, ("checkpoints/1.sql", "s1"), ("checkpoints/3.sql", "stale"))
    fresh = art(spark, ("checkpoints/3.sql", "r3"), ("checkpoints/2.sql", "unused"))
    carried = publish.carry_forward(plan, steps, stored, fresh)
    assert rows(carried, "idx", "payload") == [(1, "s1"), (2, None), (3, "r3")]
    assert rows(publish.snapshot_gaps(carried), "idx") == [(2,)]
    with pytest.raises(StateError, match="no carried snapshot"):
        publish.require_no_gaps(carried)
    heads = spark.createDataFrame([("g", "h")], "grp string, payload string")
    empty = spark.createDataFrame([], "grp string, idx bigint, a string")
    with pytest.raises(PySparkException, match="no snapshot for"):
        publish.desired_artifacts(carried, heads, heads, empty).collect()
    good = publish.desired_artifacts(carried.where(F.col("payload").isNotNull()), heads, heads, empty)
    assert ("checkpoints/1.sql", "s1\n") in rows(good, "entry", "payload")


@pytest.mark.parametrize("partitioned", [True, False])
def test_publish_artifacts(spark, rows, tmp_path, partitioned):
    name = f"artifacts_{tmp_path.name}"
    schema = "entry string, payload string, grp string, part int"
    data = [("schema.sql", "x", "g", 1), ("checkpoints/1.sql", "a", "g", 1), ("schema.sql", "y", "h", 2), ("checkpoints/1.sql", "gone", "i", 3)]
    writer = spark.createDataFrame(data, schema).write.option("path", str(tmp_path / "t"))
    (writer.partitionBy("part") if partitioned else writer).saveAsTable(name)

    def publish_to(*wanted):
        return rows(publishing.publish_artifacts(spark, name, spark.createDataFrame(list(wanted), schema)), "grp", "entry", "action")

    kept = [("schema.sql", "x", "g", 1), ("schema.sql", "y", "h", 2)]
    assert publish_to(("checkpoints/1.sql", "a", "g", 1), ("checkpoints/1.sql", "gone", "i", 3), *kept) == []
    one = [("checkpoints/1.sql", "b", "g", 1), ("checkpoints/1.sql", "gone", "i", 3), *kept]
    assert publish_to(*one) == [("g", "checkpoints/1.sql", "write")]
    assert rows(spark.table(name), "entry", "payload", "grp", "part") == sorted(one, key=repr)
    assert publish_to(*kept) == [("g", "checkpoints/1.sql", "delete"), ("i", "checkpoints/1.sql", "delete")]
    assert rows(spark.table(name), "entry", "payload", "grp", "part") == sorted(kept, key=repr)
    spark.sql(f"DROP TABLE {name}")


def test_desired_artifacts_are_computed_once(spark, tmp_path):
    name, asked = f"artifacts_once_{tmp_path.name}", spark.sparkContext.accumulator(0)
    have = spark.createDataFrame([("g", f"checkpoints/{i}.sql", "old") for i in range(20)], ART)
    have.write.option("path", str(tmp_path / "t")).saveAsTable(name)

    @F.udf("string")
    def payload(i):
        asked.add(1)
        return "old" if i % 2 else "new"

    wanted = spark.range(20).select(F.lit("g").alias("grp"), F.format_string("checkpoints/%d.sql", "id").alias("entry"), payload("id").alias("payload"))
    assert publishing.publish_artifacts(spark, name, wanted).count() == 10
    assert spark.table(name).where("payload = 'new'").count() == 10 and asked.value == 20
    spark.sql(f"DROP TABLE {name}")


def test_published_inputs_are_derived_once(spark, monkeypatch):
    from ledgerkeel.checks import inputs, replays

    made = []
    for module, name in ((replays, "_wanted"), (inputs, "input_entries")):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, plain=plain, name=name: made.append(name) or plain(*a))
    replays.publish_applied(spark, "/root/testdata/sf0.001").count()
    assert made.count("_wanted") == 1 and made.count("input_entries") == 2  # its steps, and the recomputed snapshots


def test_digests_are_compared_as_bytes(spark, rows):
    delta = publish.publish_delta(art(spark, ("a", "x")), art(spark, ("a", "x")))
    assert "unhex" in delta._jdf.queryExecution().optimizedPlan().toString() and rows(delta, "action") == [("keep",)]
    step = "grp string, idx bigint, version string, entry string, payload_digest string"
    base = spark.createDataFrame([("g", 1, "1", "e", "0" * 64), ("h", 1, "1", "e", "f" * 64), ("i", 1, "1", "e", "odd")], step)
    head = spark.createDataFrame([("g", 1, "1", "e", "0" * 64), ("h", 1, "1", "e", "a" * 64), ("i", 1, "1", "e", "f" * 64)], step)
    found = history.first_divergence(base, head)
    assert "unhex" in found._jdf.queryExecution().optimizedPlan().toString()
    digests = [("h", "migration_digest", "f" * 64, "a" * 64), ("i", "migration_digest", "odd", "f" * 64)]
    assert rows(found, "grp", "field", "base_value", "head_value") == digests


def live_case(spark):
    """Four groups: behind, not a prefix, ahead, and nothing applied yet."""
    names = {g: [f"migrations/{i}.sql" for i in (1, 2, 3)] for g in "bpan"}
    steps = [(g, i, n) for g, ns in names.items() for i, n in enumerate(ns, 1)]
    changes = [(g, i, "upsert", i % 2, i) for g, i, _ in steps]
    log = {"b": names["b"][:1], "p": ["migrations/9.sql"], "a": [*names["a"], "migrations/4.sql"]}
    applied = [(g, i, e) for g, es in log.items() for i, e in enumerate(es, 1)]
    live = [("b", 1, 1), ("p", 7, 7), ("a", 8, 8)]
    frames = (live, ROW), (changes, CHANGE), (steps, "grp string, idx bigint, entry string"), (applied, "grp string, pos bigint, entry string")
    return [spark.createDataFrame(d, s) for d, s in frames]


def test_live_up_and_migrate(spark, rows):
    own, changes, steps, applied = live_case(spark)
    done = live.up(own, changes, steps, applied, ["k"])
    assert rows(done.status) == [("a", 4, 4, "ahead"), ("b", 1, 3, "applied"), ("n", 0, 3, "applied"), ("p", 1, 1, "not_prefix")]
    full = [("a", 8, 8), ("b", 0, 2), ("b", 1, 3), ("n", 0, 2), ("n", 1, 3), ("p", 7, 7)]
    assert rows(done.state, "grp", "k", "v") == full
    head = replay.replay_tail(changes, ["k"])
    live.verify(done, head, "up")
    with pytest.raises(StateError, match="differs"):
        live.verify(done, head.withColumn("v", F.col("v") + 1), "up")
    some = live.migrate(own, changes, steps, applied, ["k"])
    assert rows(some.status, "grp", "status") == [("a", "ahead"), ("b", "applied"), ("n", "missing"), ("p", "not_prefix")]
    assert rows(some.state, "grp", "k", "v") == [r for r in full if r[0] != "n"]


def test_live_down_and_bootstrap(spark, rows):
    own, changes, steps, applied = live_case(spark)
    done = live.down(own, replay.capture_checkpoints(changes, ["k"]), steps, applied, 2)
    assert rows(done.status) == [("a", 4, 4, "ahead"), ("b", 1, 0, "rolled_back"), ("n", 0, 0, "at_zero"), ("p", 1, 1, "not_prefix")]
    assert rows(done.state, "grp", "k", "v") == [("a", 8, 8), ("p", 7, 7)]
    loaded = live.bootstrap(own, replay.replay_tail(changes, ["k"]), steps, applied)
    assert rows(loaded.status, "grp", "status") == [("a", "refused"), ("b", "refused"), ("n", "loaded"), ("p", "refused")]
    assert rows(loaded.state, "grp", "k", "v") == [("a", 8, 8), ("b", 1, 1), ("n", 0, 2), ("n", 1, 3), ("p", 7, 7)]


def test_fatal_findings_and_missing_heads_stop_groups(spark, rows):
    steps = spark.createDataFrame([("a", 1, "m/1"), ("b", 1, "m/1"), ("c", 1, "m/1")], "grp string, idx long, entry string")
    applied = spark.createDataFrame([], "grp string, pos long, entry string")
    head = spark.createDataFrame([("a", 1, "v"), ("b", 1, "v")], "grp string, k int, v string")
    found = spark.createDataFrame(
        [("b", "lockfile-version-mismatch", "p", ""), ("a", "coherence-new-in-input", "p", "")],
        "grp string, code string, path string, detail string",
    )
    out = live.bootstrap(head.limit(0), head, steps, applied, findings=found)
    assert rows(out.status, "grp", "after_index", "status") == [("a", 1, "loaded"), ("b", 0, "blocked"), ("c", 0, "no_head")]
    assert rows(out.state, "grp") == [("a",)]
    assert rows(live.bootstrap(head.limit(0), head, steps, applied).status, "grp", "status")[1] == ("b", "loaded")


def test_operations_end_with_their_check(spark, rows):
    """With an expected state, a moved group that is not in it fails the operation; others are not looked at."""
    own, changes, steps, applied = live_case(spark)
    head = replay.replay_tail(changes, ["k"])
    done = live.up(own, changes, steps, applied, ["k"], expected=head)
    assert rows(done.state) == rows(live.up(own, changes, steps, applied, ["k"]).state)
    wrong = head.withColumn("v", F.col("v") + 1)
    ranges = replay.capture_checkpoints(changes, ["k"])
    assert live.down(own, ranges, steps, applied, 2, expected=head.where("grp = 'p'")).status.count() == 4
    for call in (
        lambda: live.up(own, changes, steps, applied, ["k"], expected=wrong),
        lambda: live.migrate(own, changes, steps, applied, ["k"], expected=wrong),
        lambda: live.down(own, ranges, steps, applied, 2, expected=wrong),
        lambda: live.bootstrap(own, head, steps, applied, expected=wrong),
    ):
        with pytest.raises(StateError, match="differs"):
            call()


def test_fatal_findings_block_planning(spark, rows):
    steps = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "grp string, idx long")
    divergence = spark.createDataFrame([("a", 2), ("b", 1)], "grp string, divergence_index long")
    found = spark.createDataFrame(
        [("b", "lockfile-parse-error", "p", ""), ("c", "coherence-new-in-input", "p", "")],
        "grp string, code string, path string, detail string",
    )
    plan = history.anchor_tail(steps, divergence, findings=found)
    assert rows(plan, "grp", "anchor_index") == [("a", 1), ("c", 1)]
    state = spark.createDataFrame([("a", 1, 1)], ROW)
    whole = history.anchor_tail(steps, divergence)
    assert rows(replay.schema_plan(whole, state, state, findings=found), "grp") == [("a",), ("c",)]
    assert rows(history.blocked_groups(found)) == [("b", "lockfile-parse-error")]
