"""Toxicity model: features, held-out accuracy, edge rows."""

import numpy as np
from ledgerkeel.llm import common
from ledgerkeel.llm import toxicity as T
from ledgerkeel.llm.queries import QUERIES
from pyspark.sql import functions as F


def test_features_are_the_distinct_ngrams():
    features = T._Features()
    for text in ("abcabc", "a", "", "Abc é\nde", "zz" * 40, None):
        padded = f" {text or ''} ".lower().replace("\n", " ")
        grams = {padded[i : i + n] for n in T.GRAMS for i in range(len(padded) - n + 1)}
        found = features(text)
        alone = [set(features._piece(g, 1 << 18)) - set().union(*[features._piece(h, 1 << 18) for h in (g[1:], g[:-1])]) for g in grams]
        assert len(found) == len(set(found)) <= len(grams)
        assert set().union(*alone) <= set(found)
    assert set(features("a b")) == set(features("A\tb"))


def test_long_texts_are_whole():
    features = T._Features()
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefgh "), 600_000)) + " needle"
    assert set(features._piece(" needle", 1 << 18)) <= set(features(text))
    small = T._Features()
    pieces = set()
    padded = f" {text} "
    for i in range(0, len(padded), 5000):
        pieces |= set(small._piece(padded[i : i + 5000 + max(T.GRAMS) - 1], 1 << 18))
    assert pieces == set(features(text))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = out.where("held_out").select("score", "predicted", "toxic").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    toxic = [r for r in rows if r.toxic]
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) / len(toxic) >= 0.75
    assert sum(r.predicted for r in rows if not r.toxic) / (len(rows) - len(toxic)) <= 0.02


def test_held_out_labels_teach_nothing(spark, rows):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = T.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.score(docs, labels), T.score(docs, turned)
    assert rows(a.select("doc.doc_id", "score")) == rows(b.select("doc.doc_id", "score"))


def test_edge_rows(spark):
    docs = [(i, f"some plain words {i} " + ("you scum" if i % 4 == 0 else "you there"), 1) for i in range(120)]
    docs += [(200, None, 2), (201, "", 2), (None, "plain words you scum", 3), (202, "word " * 60_000 + "scum", 4), (0, "twice", 5)]
    table = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = [(i, int(i % 4 == 0)) for i in range(120)] + [(200, 0), (None, 1), (202, None), (4, 1), (4, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = T.score(table, labels)
    got = out.select("doc.doc_id", "doc.text", F.col("score").alias("s")).collect()
    assert len(got) == len(docs) and all(0 <= r.s <= 1 for r in got)
    blank = {r.doc_id: r.s for r in got if r.doc_id in (200, 201)}
    assert blank[200] == blank[201]
    assert min(r.s for r in got if r.text and "scum" in r.text) > max(r.s for r in got if r.text and "scum" not in r.text)
    kept = T.keep_clean(table, labels)
    assert kept.columns == table.columns and kept.where("text LIKE '%scum%'").count() == 0
    assert T.keep_clean(table, labels.limit(0)).count() == len(docs)
    assert T.score(table.limit(0), labels).count() == 0


def copied(spark):
    """40,000 labelled rows of both classes, two documents."""
    docs = [(1, "you scum of the earth"), (2, "a fine and quiet day")] * 20_000
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, toxic int, quality int")


def test_repeated_rows_are_learned_from(spark):
    docs, labels = copied(spark)
    scores = {r.doc_id: r.s for r in T.score(docs, labels).select("doc.doc_id", F.col("score").alias("s")).distinct().collect()}
    assert scores[1] > 0.9 and scores[2] < 0.1


def test_copies_are_weights(spark):
    """A fit on copies is the fit on rows with weights, by plain descent."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(40)]
    labels = (rng.random(40) < 0.4).astype(float)
    copies = rng.integers(1, 5, 40)
    ratio = np.zeros(T.BUCKETS)
    ratio[:12] = rng.normal(size=12)
    weighted = T.fit_regression(list(rows), labels, ratio, copies / copies.mean())
    repeated = T.fit_regression([r for r, c in zip(rows, copies, strict=True) for _ in range(c)], np.repeat(labels, copies), ratio)
    assert np.allclose(weighted.weights[:12], repeated.weights[:12], atol=2e-2)


def test_a_rare_class_is_in_the_sample(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('word', id % 977, IF(id < 5, ' scum', ' fine')) AS text")
    labels = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id < 5 AS INT) AS toxic")
    plan = T.samples.plan(T.labelled_rows(docs, labels, "toxic").withColumn("draw", T.samples.draw()), T.SAMPLE_ROWS)
    assert plan.stretch[1] == 1.0 and plan.weight[1] < plan.weight[0] * 1.5
    scores = T.score(docs.where("doc_id < 2000"), labels).where("doc.doc_id < 5").select("score").collect()
    assert min(r[0] for r in scores) > 0


def test_more_labels_than_a_broadcast_holds_do_not_shuffle_all_texts(spark, rows, monkeypatch):
    docs = spark.range(300).selectExpr("IF(id = 7, NULL, id) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(0, 300, 9).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    labels = labels.unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS doc_id, 1 AS toxic"))
    want = rows(T.labelled_rows(docs, labels, "toxic"))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    found = T.labelled_rows(docs, labels, "toxic")
    assert "getbit" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == want and want
    assert rows(T.labelled_rows(docs.withColumn("doc_id", F.col("doc_id").cast("int")), labels, "toxic")) == want
