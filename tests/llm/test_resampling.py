"""Resampling against plain counting, and the draw at its edges."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from ledgerkeel.llm import resampling as R
from ledgerkeel.llm.bytewords import words
from ledgerkeel.llm.queries import QUERIES


def features(text, longest=2):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def plain(docs, target, percent=25, least=20):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    out = []
    for doc_id, text in docs:
        own, found = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(own)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def test_query_equals_plain_counting(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = QUERIES["op13_resampling"](spark, sf)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(docs, target), key=repr)


def test_chained_hashes_are_those_of_the_ngrams():
    for text in ("", "one", "Zwei  drei-vier ñu 9x", "a b " * 20, None):
        for longest in (1, 2, 4):
            assert sorted(R.ngram_hashes(words(text), longest)) == sorted(zlib.crc32(f.encode()) for f in features(text, longest)[1])


def test_edge_rows(spark, rows):
    long = "word " * 100_000
    docs = [(1, None), (2, ""), (3, "- ."), (None, "a " * 30), (None, "a " * 30), (5, long), (6, "b " * 20), (7, "b " * 19)]
    docs += [(100 + i, f"t{i} " * 25) for i in range(40)] + [(100, "t0 " * 25)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rank int")
    target = spark.createDataFrame([("b b b", 1), (None, 2)], "text string, doc_id int")
    drawn = R.draw(R.score(table, target), percent=30)
    got = sorted((tuple(r) for r in drawn.select("doc.doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == sorted(plain(docs, ["b b b"], percent=30), key=repr)
    kept = R.resample(table, target)
    assert kept.columns == table.columns and kept.count() == (len(docs) - 4) * 25 // 100
    assert R.resample(table.limit(0), target).count() == 0
    assert {r.weight for r in R.score(table.limit(3), target.limit(0)).collect()} == {0}
    with pytest.raises(ValueError, match="percent"):
        R.draw(drawn, percent=101)


def test_no_task_ranks_all_rows(spark):
    """The ranks come from a range sort in parts; the one unpartitioned window is over part totals."""
    docs = spark.range(2_000).selectExpr("id AS doc_id", "repeat(concat('w', id % 7, ' '), 25) AS text")
    drawn = R.draw(R.score(docs, docs))
    ranks = sorted(r.rank for r in drawn.where("rank IS NOT NULL").select("rank").collect())
    assert ranks == list(range(1, 501))
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(_part" in plan and "row_number() windowspecdefinition(down" not in plan
