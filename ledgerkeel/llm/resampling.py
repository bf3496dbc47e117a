"""Importance resampling towards a target: hashed n-gram log-ratios plus Gumbel noise.

Texts become words by one byte translate and one split. ``zlib.crc32`` takes a seed, so the
hash of a longer n-gram continues the hash of the shorter one by a blank and the next word. Tasks
fold bucket counts of their documents in one Counter of at most ``BUCKETS`` keys; Spark sums
them. From the counts of corpus and target every bucket has a gain, the floored thousandfold
log-ratio of its smoothed shares; a document's weight is the floored mean gain of its features.
Adding Gumbel noise, drawn from a hash of its id, and keeping the highest scores draws
documents without replacement in proportion to the exponential of their weights.

Only the gains (``BUCKETS`` numbers) reach the driver and the tasks, whatever the size of both
tables. The rows that take part in the draw are ranked by a range sort whose parts are stitched
by their row counts, so no task holds more than its range.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import ordinal
from .bytewords import words
from .common import held, whole, written

BUCKETS, LONGEST = 10_000, 2
MIN_WORDS, PERCENT, SEED = 20, 25, 7


def ngram_hashes(tokens: list[bytes], longest: int = LONGEST) -> list[int]:
    """CRC-32 of every run of 1 to ``longest`` words joined by a blank, repeats included."""
    found: list[int] = []
    runs: Iterator[int] | list[int] = list(map(crc32, tokens))
    for n in range(2, longest + 2):
        found += runs
        runs = list(map(crc32, tokens[n - 1 :], map(crc32, repeat(b" "), runs)))
    return found


def _bucket_counts(buckets: int, longest: int):
    bucket_of = buckets.__rmod__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(map(bucket_of, ngram_hashes(words(text.as_py()), longest)))
        columns = [pa.array(list(counts.keys()), pa.int32()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> dict[int, int]:
    """Features per bucket over every row of the one column ``texts``; at most ``buckets`` entries."""
    partial = texts.mapInArrow(_bucket_counts(buckets, longest), "bucket int, n long")
    return {r.bucket: r.n for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, with one feature added to each on both sides."""
    own, aim = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * own / ((corpus.get(b, 0) + 1.0) * aim)))
        for b in range(buckets)
    ]


def _weights(gain: list[int], longest: int):
    bucket_of, gain_of = len(gain).__rmod__, gain.__getitem__

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for text in batch:
                tokens = words(text.as_py())
                hashes = ngram_hashes(tokens, longest)
                total = sum(map(gain_of, map(bucket_of, hashes)))
                rows.append((len(tokens), len(hashes), total // len(hashes) if hashes else 0))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.StructArray.from_arrays(columns, ["n_words", "n_features", "weight"])

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and id (null: no id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(
    docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """Rows (doc, n_words, n_features, weight, score), one per input row.

    Both tables are read by their column ``text``. Null, empty and wordless texts have no
    feature and weight 0; so has every text if both tables hold none. Repeated rows count, and
    score, one by one; equal ids have equal noise. Extra columns stay in ``doc`` untouched.
    """
    rows = whole(docs)
    text = held(rows, "text").cast("string").alias("text")
    goal = whole(target)
    aim = bucket_counts(goal.select(held(goal, "text").cast("string").alias("text")), buckets, longest)
    gain = gains(bucket_counts(rows.select(text), buckets, longest), aim, buckets)
    scored = rows.select("doc", _weights(gain, longest)(text).alias("of"))
    return scored.select(
        "doc", "of.*", (F.col("of.weight") + noise(held(rows, "doc_id"), seed)).alias("score")
    )


def draw(scored: DataFrame, *, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Add ``rank`` (long): 1, 2, 3... for the drawn rows by falling score, null for all others.

    Of the N rows with ``min_words`` words or more, floor(percent * N / 100) are drawn. Ties go to the
    smaller doc_id, null last, then to either of equal rows. Every column of ``scored`` is
    written once and sorted once, so let ``doc`` hold no more than is wanted afterwards.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie between 0 and 100.")
    held_rows = written(scored.withColumn("copy", F.monotonically_increasing_id()), "resampling")
    doc_id = held(held_rows, "doc_id")
    able = held_rows.where(F.col("n_words") >= min_words)
    taken = able.count() * percent // 100
    keyed = able.select("*", (-F.col("score")).alias("down"), doc_id.isNull().alias("last"), doc_id.alias("id"))
    ranked = ordinal(keyed, [], ["down", "last", "id", "copy"], "place", hot_rows=-1)
    rank = F.when(F.col("place") <= taken, F.col("place")).alias("rank")
    unable = held_rows.where(F.col("n_words") < min_words)
    return ranked.select(*scored.columns, rank).unionByName(
        unable.select(*scored.columns, F.lit(None).cast(T.LongType()).alias("rank"))
    )


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns; ``options`` are those of ``draw``."""
    return draw(score(docs, target), **options).where(F.col("rank").isNotNull()).select("doc.*")
