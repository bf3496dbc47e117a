"""Search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest
from ledgerkeel.llm import ranking as R
from ledgerkeel.llm.bytewords import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """(item text, rank, doc_id, score) by the definition."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    holding = Counter(t for _, c in held for t in c)
    out = []
    for item in items:
        scored = []
        for doc_id, c in held:
            m = 10 + 90 * c.total() * n_docs // max(n_terms, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(item))
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return out


def corpus(n, seed):
    """Few very frequent words, many rare ones, repeated texts, texts of any length."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 30, 200])
        docs.append((i, " ".join(rng.choice(["The", "la", "ñu", "x9"]) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.7))}" for _ in range(size))))
    docs += [(n + i, docs[rng.randrange(n)][1]) for i in range(n // 5)]
    return docs + [(None, "la la w3"), (10**12, None), (n * 9, "la la w3"), (3, "la la w3")]


def items_of(seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "la", "ÑU", "ñu", "w1", "w2", "w3", f"w{rng.randrange(300)}", "nowhere"]) for _ in range(rng.randint(1, 9))) for _ in range(25)]


@pytest.mark.parametrize(("short", "segment", "block", "k"), [(2_048, 16_384, 200_000, 10), (0, 50, 40, 3), (40, 97, 1, 1), (10**6, 300, 30, 5)])
def test_equals_plain_scoring(spark, short, segment, block, k):
    """Without accumulators, with all lists in them, over many segments and blocks."""
    docs, items = corpus(900, 2), items_of(4)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").coalesce(1)
    found = R.search(table, asked, k, limits=R.Limits(segment, short), block_terms=block)
    got = found.select("item.text", "rank", "doc_id", "score").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(docs, items, k)))


def test_skips_long_lists():
    """Rare terms set a floor that a frequent term alone cannot reach: its list is only probed."""
    import numpy as np

    n = 10_000
    docs = np.r_[np.arange(n), np.array([7, 5_000, 9_999])]
    own = np.r_[np.zeros(n, int), np.ones(3, int)]
    order = np.argsort(docs, kind="stable")
    sizes = np.bincount(docs, minlength=n)
    weights = np.array([R.term_weight(n, n), R.term_weight(n, 3)])
    segment = R.Segment(list(range(n)), np.ones(n, int), own[order], np.ones(n + 3, int), sizes, R.Corpus(n, n, weights))
    looked = Counter()

    class Watched(R._Iterator):
        def next(self):
            looked[len(self.docs)] += 1
            super().next()

    kept, R._Iterator = R._Iterator, Watched
    try:
        best = R.Best(2)
        segment.search([0, 1], best)
    finally:
        R._Iterator = kept
    assert sorted(d for d, _ in best.rows()) == [7, 5_000]
    assert looked[3] == 3 and looked[n] < 10


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(2_000):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x80, 0x3000), 0x1F600])) for _ in range(20))
        assert [w.decode() for w in words(text)] == terms(text)
    assert words(None) == words("") == words(" -\n") == []


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6)], "doc_id long, text string, rank int")
    items = spark.createDataFrame([("a a", 1), (None, 2), ("", 3), ("zz", 4), ("a", 5), ("a", 5)], "text string, score int")
    got = R.search(docs, items).select("item.score", "rank", "doc_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (5, 1, 1), (5, 1, 1)]
    assert R.search(docs.limit(0), items).count() == R.search(docs, items.limit(0)).count() == 0
    assert R.search(docs.where("text IS NULL"), items).count() == 0
    with pytest.raises(ValueError, match="positive"):
        R.search(docs, items, 0)
