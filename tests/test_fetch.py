"""Wide rows of asked keys, by hashes and by bits."""

import pytest
from pyspark.sql import functions as F

from ledgerkeel.operators import fetch, history


@pytest.mark.parametrize("broadcast_keys", [10**6, 0])
def test_only_asked_rows(spark, rows, broadcast_keys):
    wide = spark.range(5_000).selectExpr("IF(id % 50 = 0, NULL, id % 7) AS grp", "concat('e', id) AS entry", "id AS v")
    asked = [(i % 7, f"e{i}") for i in range(0, 5_000, 9)] + [(1, "nowhere"), (None, "e50"), (2, None)] + [(3, "e3")] * 3
    frame = spark.createDataFrame(asked, "grp long, entry string")
    got = fetch.requested_rows(wide, frame, ["grp", "entry"], broadcast_keys)
    keys = {k for k in asked if None not in k}
    want = [r for r in map(tuple, wide.collect()) if (r[0], r[1]) in keys]
    assert rows(got) == sorted(want, key=repr) and want
    assert fetch.requested_rows(wide, frame.limit(0), ["grp", "entry"], broadcast_keys).count() == 0


def test_few_unasked_rows_pass_the_bits(spark):
    known = spark.range(20_000).select(F.col("id").alias("k"))
    bits = fetch.bloom_bits(known, ["k"], 20_000)
    assert len(bits) == 1 << 16
    one, two = fetch._hashes(["k"])
    passed = spark.range(20_000, 120_000).select(F.col("id").alias("k")).where(fetch._set(bits, one) & fetch._set(bits, two)).count()
    assert known.where(fetch._set(bits, one) & fetch._set(bits, two)).count() == 20_000 and passed < 2_000


def test_no_unasked_payload_is_shuffled(spark, tmp_path):
    """With automatic broadcasts off, the scan of the payloads meets the asked keys before any exchange."""
    snaps = spark.range(1_000).selectExpr("id AS grp", "'checkpoints/1_a.sql' AS entry", "repeat('x', 100) AS payload")
    snaps.write.parquet(str(tmp_path / "snaps"))
    stored = spark.read.parquet(str(tmp_path / "snaps"))
    steps = spark.range(1_000).selectExpr("id AS grp", "1L AS idx", "'checkpoints/1_a.sql' AS snapshot_entry")
    plan = spark.createDataFrame([(7, 1), (9, 1), (11, 2)], "grp long, anchor_index long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = history.select_anchor(plan, steps, stored)
        text = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scan = next(line for line in text.splitlines() if "payload" in line and "FileScan" in line)
    above = text[: text.index(scan)].splitlines()[::-1]
    assert "BroadcastHashJoin" in "".join(above[: next(i for i, line in enumerate(above) if "Exchange hashpartitioning" in line)])
    assert sorted((r.grp, r.error) for r in found.collect()) == [(7, None), (9, None), (11, "no_step")]
