"""Stored states compared by their trees against the comparison of all rows."""

import random
import uuid

from pyspark.sql import functions as F

from ledgerkeel.operators import compare, digest_tree as D

STATE = "grp string, k int, v string"


def states(seed):
    rng = random.Random(seed)
    live = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(40), rng.choice(["x", "y", None])) for _ in range(400)]
    expected = [r for r in live if rng.random() > 0.03] + [("a", 99, "new"), ("only", 1, "x")]
    expected += [live[0]] * 3
    return live, expected


def stored(spark, rows, path):
    frame = spark.createDataFrame(rows, STATE)
    D.save(frame, path)
    return D.load(spark, path, frame)


def test_same_rows_as_the_full_comparison(spark, tmp_path, rows):
    for seed in (1, 2):
        live, expected = states(seed)
        a, b = (stored(spark, r, str(tmp_path / f"{n}{seed}")) for r, n in ((live, "live"), (expected, "expected")))
        want = compare.equal_states(spark.createDataFrame(live, STATE), spark.createDataFrame(expected, STATE))
        assert rows(D.equal_states(a, b)) == rows(want) and rows(D.equal_states(a, a), "grp", "matches") == sorted(
            {(g, True) for g, _, _ in live}, key=repr
        )


def test_equal_states_read_the_tree_only(spark, tmp_path):
    live, expected = states(3)
    a, b = stored(spark, live, str(tmp_path / "a")), stored(spark, live, str(tmp_path / "b"))
    plan = D.equal_states(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "/tree" in plan and "/rows" not in plan
    changed = stored(spark, [*live, ("a", 7, "one more")], str(tmp_path / "c"))
    files = D.equal_states(a, changed).select("grp")._jdf.queryExecution().executedPlan().toString()
    branches = D.differing_leaves(a.tree, changed.tree).select("branch").distinct().count()
    assert branches == 1 and files.count("PartitionFilters: [isnotnull(_branch") == 2
    assert b.rows.count() == len(live) and expected


def test_a_tree_takes_changes(spark, rows):
    live, _ = states(4)
    frame = spark.createDataFrame(live, STATE)
    removed = frame.where("k < 5")
    added = spark.createDataFrame([("z", 1, "q"), ("hot", 1, "q")], STATE)
    after = frame.where("NOT k < 5").unionByName(added)
    assert rows(D.changed_tree(D.tree(frame), added, removed)) == rows(D.tree(after))
    everything = D.changed_tree(D.tree(frame), added.limit(0), frame)
    assert everything.count() == 0 and D.tree(frame.where(F.lit(False))).count() == 0


def test_a_state_is_computed_once(spark, tmp_path, rows):
    """A state that is another one each time it is computed is still stored with its own tree."""
    name = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    state = spark.range(300).select((F.col("id") % 3).cast("string").alias("grp"), F.col("id").cast("int").alias("k"), name().alias("v"))
    D.save(state, str(tmp_path / "s"))
    saved = D.load(spark, str(tmp_path / "s"), state)
    assert rows(D.tree(saved.rows.select("grp", "k", "v"))) == rows(saved.tree, "level", "grp", "branch", "leaf", "rows", "digest")
