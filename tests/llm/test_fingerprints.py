"""Fingerprints: multiset laws, and the query against a plain loop."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerkeel.llm import fingerprints as P
from ledgerkeel.llm.queries import QUERIES

lines = st.lists(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\n"), max_size=30), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(lines, lines, st.randoms())
def test_order_insertion_and_deletion(a, b, rng):
    shuffled = list(a)
    rng.shuffle(shuffled)
    one = P.fingerprint("\n".join(a))
    assert one == P.fingerprint("\n".join(shuffled))
    both = P.insert(one, "\n".join(b))
    assert both == P.fingerprint("\n".join([*b, *a]))
    assert P.remove(both, "\n".join(b)) == one
    assert (one == P.fingerprint("\n".join(b))) == (sorted(a) == sorted(b))


def test_batches_do_not_matter():
    texts = ["a b c\nd e", "", "x " * 500, "é ü\n\n", "a b c\nd e"]
    strong, sketch = P.vectors(texts)
    for i, text in enumerate(texts):
        s, k = P.vectors([text])
        assert (strong[i] == s[0]).all() and (sketch[i] == k[0]).all()


def test_likeness():
    text = " ".join(f"w{i}" for i in range(400))
    other = " ".join(f"v{i}" for i in range(400))
    half = " ".join([*(f"w{i}" for i in range(200)), *(f"u{i}" for i in range(200))])
    _, k = P.vectors([text, other, half, "", text])
    assert P.likeness(k[0], k[4]) == 1 and P.likeness(k[3], k[3]) == 1
    assert P.likeness(k[0], k[1]) < 0.2 and P.likeness(k[0], k[3]) == 0
    assert abs(float(P.likeness(k[0], k[2])) - 1 / 3) < 0.15


def plain(docs):
    docs = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        pair = P.vectors([text, edited, after])[1]
        out.append(
            (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), P.fingerprint(text), P.fingerprint(edited),
             float(P.likeness(pair[0], pair[1])), float(P.likeness(pair[0], pair[2])))
        )
    return out


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_query_against_a_plain_loop(spark, rows):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(QUERIES["op4_fingerprint"](spark, sf), *COLUMNS) == sorted(plain(docs), key=repr)


def test_edge_rows(spark, rows):
    docs = [(3, None), (1, ""), (2, "é" * 7), (9, "line\n" * 30_000), (None, "last of all")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, part string, h long")
    assert rows(P.compare_with_next(df), *COLUMNS) == sorted(plain(docs), key=repr)
    assert P.compare_with_next(df.where("doc_id = 2")).count() == 1
    assert P.compare_with_next(df.limit(0)).count() == 0
    assert P.compare_with_next(df.unionByName(df)).count() == 2 * len(docs)
    printed = P.fingerprints(df)
    assert printed.select("doc.*").columns == df.columns and printed.count() == len(docs)


def test_ranges(spark):
    from pyspark.sql import functions as F

    cuts = [2, 5, 5, 11]
    values = [-3, 2, 4, 5, 10, 11, 99, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r.x for r in df.select(P._range_of(F.col("v"), F.array(*map(F.lit, cuts)), 4).alias("x")).collect()]
    assert got == [int(np.searchsorted(cuts, v, "right")) if v is not None else 4 for v in values]


def test_long_repetitive_texts_do_not_wrap(spark):
    long, half = "x " * 140_000, "x " * 70_000
    one, other = P.vectors([long])[1], P.vectors([half])[1]
    assert np.abs(one).max() == 139_998 and np.abs(other).max() == 69_998
    assert (P.decode(P.fingerprint(long))[1] == one[0]).all()
    # Shares of a and b equal sequences: ab / (a^2 + b^2 - ab).
    assert abs(float(P.likeness(one[0], other[0])) - 2 / 3) < 1e-3
    assert P.remove(P.insert(P.fingerprint(half), half), half) == P.fingerprint(half)
    df = spark.createDataFrame([(1, long), (2, half)], "doc_id long, text string")
    got = {r.doc_id: (r.near_edited, r.near_next) for r in P.compare_with_next(df).collect()}
    assert all(abs(x - y) < 1e-3 for x, y in zip(got[1], (1, 2 / 3), strict=True))
    assert all(abs(x - y) < 1e-3 for x, y in zip(got[2], (1, 2 / 3), strict=True))
