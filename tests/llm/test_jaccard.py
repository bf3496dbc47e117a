"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from ledgerkeel.llm import common, jaccard, kernels
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs):
    """Per row: set size and smallest reachable doc_id."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        low.setdefault(find(i), []).append(doc_id)
    return [(d, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)]


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "ÉTÉ", "naïve"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.5:
            words = WORD.findall(docs[rng.randrange(len(docs))][1] or "") or ["x"]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[at] = rng.choice(vocabulary)
                else:
                    words = words[:at] + words[at + rng.choice([0, 1, 3]) :] or ["y"]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 40, 80, 200]))]
            if rng.random() < 0.3:
                words[len(words) // 2 : len(words) // 2] = passage
        text = rng.choice([" ", "\n", "\t "]).join(words)
        docs.append((i, text.upper() if rng.random() < 0.1 else text))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, rows, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = rows(jaccard.classify(df), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute(docs), key=repr)


def test_small_blocks_and_cells_lose_no_link(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 16)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 2, 3])):
            words[at] = f"e{rng.randrange(10_000)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard.classify(df), "doc_id", "n_shingles", "component_id") == sorted(brute(docs), key=repr)


def test_voronoi_cells_equal_all_pairs():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(400):
        if sets and rng.random() < 0.6:
            old = sets[rng.integers(len(sets))]
            keep = old[rng.random(len(old)) > rng.choice([0.02, 0.08, 0.2])]
            new = np.unique(np.r_[keep, rng.integers(0, 1 << 60, rng.integers(0, 4)).astype(np.uint64)])
        else:
            new = np.unique(rng.integers(0, 1 << 60, rng.integers(5, 80)).astype(np.uint64))
        sets.append(new)
    parent = np.arange(len(sets))
    jaccard.link_cells(sets, parent)
    groups = [jaccard._find(parent, i) for i in range(len(sets))]
    plain = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = jaccard._find(plain, i), jaccard._find(plain, j)
                plain[max(a, b)] = min(a, b)
    assert groups == [jaccard._find(plain, i) for i in range(len(sets))]


def test_edge_rows(spark, rows):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (5, "one two"), (6, "two one")]
    docs += [(None, "a b c d e f"), (None, "a b c d e f"), (9, "x " * 30_000), (8, "X " * 20_000)]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in docs], "doc_id long, text string, class long, doc string")
    got = rows(jaccard.classify(df), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute(docs), key=repr)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    left = sorted((str(r.doc_id), (r.text or "")[:12]) for r in kept.collect())
    assert left == sorted([("1", ""), ("2", ""), ("3", " \n"), ("4", "one two"), ("6", "two one"), ("None", "a b c d e f"), ("8", "X X X X X X ")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.classify(df).count() == 0 and jaccard.keep_one(df).count() == 0


def test_kernel_words_and_shingles_match_plain_python():
    import pyarrow as pa

    texts = ["A b\tc  d e f", None, "", "é É", "a b c d e", "A B C D E f", "x y z", "one"]
    sets = list(kernels.shingle_sets(pa.array(texts)))
    plain = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def exchanged(df):
    """Filters and scans below each exchange by hash of a plan without broadcasts."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("Exchange hashpartitioning")[0] for part in text.split("Exchange hashpartitioning")[1:]]


def test_more_near_copies_than_a_broadcast_holds_do_not_shuffle_all_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = corpus(3, 200) + [(None, "n n n n n n"), (None, "n n n n n n"), (7, "twice " * 9), (7, "twice " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(jaccard.classify(df), "doc_id", "n_shingles", "component_id") == sorted(brute(docs), key=repr)
    kept = jaccard.keep_one(df)
    wide = [below for below in exchanged(kept) if "doc#" in below.splitlines()[0] + below.splitlines()[1]]
    assert wide and all("getbit" in below for below in wide)
    got = rows(kept.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 200_000)
    assert got == rows(jaccard.keep_one(df).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def test_unlike_sizes_that_share_a_shingle_do_not_meet(spark, rows):
    sizes = [10, 20, 40, 80, 81, 101, 500]
    signed = [(i, n, 1, [7, 100 + i]) for i, n in enumerate(sizes)] + [(2, 40, 1, [7, 102])]
    df = spark.createDataFrame(signed, "class long, n long, shown int, first array<long>")
    assert rows(jaccard._buckets(df, 80)) == [(3, 3, 7, True), (4, 3, 7, True), (5, 3, 7, True)]
    assert rows(jaccard._buckets(df, 40), "class", "pivot") == [(i, 0) for i in range(6)]


def test_large_clusters_and_size_bands_lose_no_link(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    docs = corpus(4, 220)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(jaccard.classify(df), "doc_id", "n_shingles", "component_id") == sorted(brute(docs), key=repr)
