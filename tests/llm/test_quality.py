"""Quality field: forward-backward against enumeration, held-out accuracy, edge rows."""

import itertools

import numpy as np
from ledgerkeel.llm import quality as Q
from ledgerkeel.llm.queries import QUERIES
from pyspark.sql import functions as F


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = [4, 1, 3, 5]
    first = np.r_[0, np.cumsum(lengths)]
    good, link = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    p, expected, total = Q.marginals(good, link, first)
    want_p, want_pairs, want_total = np.zeros(first[-1]), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(first):
        weights = {}
        for states in itertools.product((0, 1), repeat=b - a):
            score = sum(good[a + i] for i, s in enumerate(states) if s)
            score += sum(link[s, t] for s, t in itertools.pairwise(states))
            weights[states] = np.exp(score)
        z = sum(weights.values())
        want_total += np.log(z)
        for states, w in weights.items():
            want_p[a:b] += np.array(states) * w / z
            for s, t in itertools.pairwise(states):
                want_pairs[s, t] += w / z
    assert np.allclose(p, want_p) and np.allclose(expected, want_pairs) and np.isclose(total, want_total)


def test_gradient_raises_the_likelihood():
    rng = np.random.default_rng(2)
    texts = ["\n".join("plain words here." for _ in range(3)) for _ in range(30)]
    texts += ["\n".join("LOUD!! SHOUT!!" for _ in range(2)) for _ in range(30)]
    x, _, first = Q.line_features(texts)
    field = Q.fit(x + rng.normal(scale=1e-3, size=x.shape), first, np.r_[np.ones(30, int), np.zeros(30, int)])
    scores = field.score(texts)
    assert scores[:30].min() > 0.9 and scores[30:].max() < 0.1


def test_line_features_do_not_depend_on_the_batch():
    texts = ["a b\nC!! D!!", "", "\n\n", "x x x x", "é" * 3000, "last"]
    x, length, first = Q.line_features(texts)
    assert list(np.diff(first)) == [2, 1, 3, 1, 1, 1] and length.sum() == 3 + 7 + 7 + 3000 + 4
    for i, text in enumerate(texts):
        alone, _, _ = Q.line_features([text])
        assert np.allclose(alone, x[first[i] : first[i + 1]])
    assert x.shape[1] == Q.FEATURES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = out.where("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 30 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95


def test_held_out_labels_teach_nothing(spark, rows):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = Q.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.score(docs, labels), Q.score(docs, turned)
    assert rows(a.select("doc.doc_id", "score")) == rows(b.select("doc.doc_id", "score"))


def test_edge_rows(spark):
    docs = [(i, "good plain line.\nmore of it here." if i % 2 else "BAD!! BAD!!\n%%% $$$", 1) for i in range(60)]
    docs += [(70, None, 2), (71, "", 2), (None, "good plain line.", 3), (72, "word " * 60_000, 4), (1, "good plain line.", 5)]
    table = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = [(i, i % 2) for i in range(60)] + [(70, 1), (None, 0), (72, None), (3, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    out = Q.score(table, labels)
    got = out.select("doc.doc_id", "score").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert out.select("doc.*").columns == table.columns
    blank = {r.doc_id: r.score for r in got if r.doc_id in (70, 71)}
    assert blank[70] == blank[71]
    assert {r.score for r in Q.score(table, labels.limit(0)).collect()} == {1.0}
    assert Q.score(table.limit(0), labels).count() == 0


def test_repeated_rows_are_learned_from(spark):
    docs = spark.createDataFrame([(1, "#### $$$ buy buy buy !!!\n%% %%"), (2, "A quiet day by the sea.\nWe read.")] * 20_000, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    out = Q.score(docs, labels).selectExpr("doc.doc_id", "score AS s").distinct().collect()
    scores = {r.doc_id: r.s for r in out}
    assert scores[2] > 0.8 and scores[1] < 0.2


def test_copies_count_as_rows(spark):
    rng = np.random.default_rng(2)
    texts = ["\n".join("x" * int(n) for n in rng.integers(0, 30, 4)) for _ in range(12)]
    labels, copies = (rng.random(12) < 0.5).astype(int), rng.integers(1, 4, 12)
    x, _, first = Q.line_features(texts)
    again, _, many = Q.line_features([t for t, c in zip(texts, copies, strict=True) for _ in range(c)])
    one, other = Q.fit(x, first, labels, copies.astype(float)), Q.fit(again, many, np.repeat(labels, copies))
    assert np.allclose(one.odds(x), other.odds(x), atol=1e-3) and np.allclose(one.link, other.link, atol=1e-3)


def test_lines_of_the_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE_LINES", 200)
    docs = [(i, ("###\n" if i % 2 else "Good words here.\n") * (i % 9 + 1)) for i in range(1, 120)] + [(500, "###\n" * 5_000)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in docs], "doc_id long, quality int")
    seen = {}
    plain = Q.fit
    monkeypatch.setattr(Q, "fit", lambda x, *rest: seen.update(lines=len(x)) or plain(x, *rest))
    Q.score(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert 100 < seen["lines"] <= 200
