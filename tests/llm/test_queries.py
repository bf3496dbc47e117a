"""Queries with SQL against DuckDB, and the pipeline against its own rules."""

import collections

import corpus_pipeline
import duckdb
import pytest
from ledgerkeel.llm import decontaminate, jaccard, mixing, toxicity
from ledgerkeel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in places) for r in cursor.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_keep_their_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), name)
        left[name] = docs
        if name != "sharding":
            assert docs.columns == before.columns
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    scores = toxicity.score(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(left["toxicity"]) == ids(scores.where("score < 0.3").select("doc.doc_id"))
    groups = collections.defaultdict(list)
    for r in jaccard.classify(left["toxicity"]).collect():
        groups[r.component_id if r.n_shingles else ("blank", r.doc_id)].append(r.doc_id)
    assert ids(left["ngram_jaccard_join"]) == {min(g) for g in groups.values()}
    leaked = ids(decontaminate.leaks(left["ngram_jaccard_join"], spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert leaked and ids(left["benchmark_decontamination"]) == ids(left["ngram_jaccard_join"]) - leaked
    drawn = mixing.draw_plan(left["benchmark_decontamination"], shards=40)
    want = {r.doc_id: r.n for r in drawn.selectExpr("doc.doc_id", "size(draws) AS n").where("n > 0").collect()}
    got = collections.Counter(r.doc_id for r in left["source_mixing"].select("doc_id").collect())
    assert got == want
    final = left["sharding"]
    assert final.count() == left["source_mixing"].count()
    bytes_ = [r.s for r in final.groupBy("shard").sum("size").toDF("shard", "s").collect()]
    biggest = max(r["size"] for r in final.select("size").collect())
    assert len(bytes_) == 40 and max(bytes_) - min(bytes_) <= 2 * biggest


def test_run_is_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
