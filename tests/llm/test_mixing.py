"""Mixing: targets, exact quotas, draws; and what each row gets."""

import math
import statistics

import pytest
from ledgerkeel.llm import mixing
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, size string, draws long"


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > limit * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = float(limit * sizes[s])
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_targets_agree_with_repeated_resharing(spark):
    sizes = {"a": 100, "b": 5, "B": 900, "é": 3, "z": 0, "10": 40, None: 77}
    rows = [(s is None, s or "", n) for s, n in sizes.items()]
    df = spark.createDataFrame(rows, "no_source boolean, source_key string, source_size long")
    got = {None if r.no_source else r.source_key: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9), s


def test_hypergeometric_draws_follow_the_distribution(spark):
    draw = mixing.hypergeometric("30L", "12L", "10L", "((id + 0.5D) / 4000D)")
    counts = {r.x: r["count"] for r in spark.range(4000).select(F.expr(draw).alias("x")).groupBy("x").count().collect()}
    for k in range(11):
        p = math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        assert abs(counts.get(k, 0) / 4000 - p) < 1e-3


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_tree_deals_every_quota_exactly(spark, shards):
    quotas = [(0, 1000), (1, 1), (2, 37), (3, 400)]
    df = spark.createDataFrame(quotas, "idx long, quota long")
    rows = mixing.split_quotas(df, shards, 3).collect()
    for idx, quota in quotas:
        assert sum(r.blocks for r in rows if r.idx == idx) == quota
    per_shard = [sum(r.blocks for r in rows if r.shard == s) for s in range(shards)]
    assert max(per_shard) - min(per_shard) <= math.ceil(math.log2(shards)) + 1
    assert {r.shard for r in rows} <= set(range(shards))


def docs(spark):
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, "word " * (1 + i % 41), source, "x", 1))
    rows += [(1000, None, "hot", None, None), (1001, "", None, None, None), (None, "a b c", None, "y", None)]
    rows += [(1002, "long " * 5000, "s1", None, None), (1003, "a b", None, None, None), (1003, "a b", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_mix_comes_near_every_target_and_reruns_agree(spark, rows):
    table = docs(spark)
    plan = mixing.draw_plan(table, shards=8, block_rows=8)
    got = plan.select(
        "doc.doc_id", "doc.source", mixing.word_size(F.col("doc.text")).alias("size"), "source_size", "target", F.size("draws").alias("n"),
        F.col("doc.size").alias("other"), F.expr("transform(draws, d -> d.pass)").alias("passes"),
        F.expr("transform(draws, d -> d.shard)").alias("shards"),
    ).collect()
    assert len(got) == table.count()
    sizes = {}
    for r in got:
        assert r.n <= 3 and sorted(r.passes) == list(range(r.n))
        assert all(0 <= s < 8 for s in r.shards)
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = brute_targets(sizes)
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and math.isclose(r.target, want[source], rel_tol=1e-9) for r in mine)
        taken = sum(r.n * r["size"] for r in mine)
        typical = statistics.mean(r["size"] for r in mine)
        assert abs(taken - want[source]) <= max(2 * typical, 0.02 * want[source]), source
    again = mixing.draw_plan(table.repartition(5), shards=8, block_rows=8)
    key = ["doc.doc_id", F.col("doc.text").alias("t"), F.to_json("draws").alias("d")]
    assert rows(plan.select(*key)) == rows(again.select(*key))


def test_mix_keeps_columns_and_shards_are_mixed(spark):
    mixed = mixing.mix(docs(spark), shards=4, block_rows=4)
    assert mixed.select("doc.*").columns == ["doc_id", "text", "source", "size", "draws"]
    per = mixed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("doc.source").alias("sources")).collect()
    assert len(per) == 4 and all(r.sources >= 6 for r in per)


def test_empty_and_wordless_tables(spark):
    empty = docs(spark).limit(0)
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    assert mixing.mix(blank).count() == 0
    assert mixing.draw_plan(blank).where("target = 0").count() == 2


def test_written_mix_has_a_folder_per_shard(spark, tmp_path):
    mixing.write_mix(mixing.mix(docs(spark).drop("size"), shards=3), str(tmp_path / "mix"))
    assert {p.name for p in (tmp_path / "mix").iterdir() if p.is_dir()} == {"shard=0", "shard=1", "shard=2"}


def test_sources_are_broadcast_only_while_bounded(spark):
    columns = "idx long, quota long, n_blocks long, no_source boolean, source_key string"
    sources = spark.createDataFrame([(0, 5, 3, False, "a"), (1, 2, 2, True, None)], columns)
    hints = lambda n: mixing._draws(sources, n, 4, 1)._jdf.queryExecution().optimizedPlan().toString().count("broadcast")
    assert hints(mixing.bounded.__defaults__[0]) == 1 and hints(mixing.bounded.__defaults__[0] + 1) == 0
