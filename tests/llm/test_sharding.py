"""Sharding against a plain prefix sum."""

import zlib

from ledgerkeel.llm import sharding
from ledgerkeel.llm.queries import QUERIES
from pyspark.sql import functions as F


def brute(rows, shards):
    total = sum(size for _, size in rows)
    before, out, slots = 0, [], {}
    for doc_id, size in rows:
        shard = min(shards - 1, int((before + size / 2) * shards / total))
        out.append((doc_id, size, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    return out


def test_query_against_brute_force(spark, rows):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want = brute([(i, len((t or "").encode()) + 16) for i, t in docs], 40)
    got = QUERIES["op2_shard"](spark, sf)
    assert rows(got, "doc_id", "size", "shard", "slot") == sorted(want, key=repr)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in docs}
    assert {r.doc_id: r.text_crc32 for r in got.collect()} == crc
    assert {(r.law, r.grown_shard) for r in got.collect()} == {("bytes", None)}


def test_ties_nulls_long_texts_and_clashing_names(spark):
    data = [(i, "x" * (i % 50), 1, "a") for i in range(300)]
    data += [(None, None, None, None)] * 5 + [(7, "same", 2, "b")] * 200 + [(8, "y" * 40_000, 3, "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, shard long, part string")
    out = sharding.shard(docs, 6)
    got = out.select("shard", "slot", "size", F.col("doc.doc_id").alias("id")).collect()
    assert len(got) == len(data)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    in_order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.id for r in in_order if r.id is not None]
    assert ids == sorted(ids) and [r.id for r in in_order][-5:] == [None] * 5
    assert out.select("doc.*").columns == docs.columns


def test_sizes_are_near_equal(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("z"), (F.col("id") % 90).cast("int")).alias("text"))
    sizes = [r.s for r in sharding.shard(docs, 7).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 2 * 106


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(docs).count() == 0
    sharding.write_shards(sharding.shard(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 3), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 9
