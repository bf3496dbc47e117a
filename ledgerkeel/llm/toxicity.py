"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are hashed character n-grams (3 to 7 code points of the lower-cased text between
blanks, any other white space being a blank too), each present or not in a document. Over
all labelled training rows a count per feature and class gives its log-count ratio
``log((p + a) / (P + 2a)) - log((q + a) / (Q + 2a))``, of p among P toxic documents and q
among Q clean ones. A logistic regression is fitted on
features scaled by these ratios; a document's score is its probability.

The counts cover every training row: tasks fold them into one vector per class of a
fixed width, so that what is summed and sent to the driver does not grow. Only the
regression sees a bounded sample (``SAMPLE_ROWS`` different rows, chosen by hash, copies as
weights, both classes).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import samples
from .common import bounded, held, may_match, whole, written
from .kernels import mix64

GRAMS = (3, 4, 5, 6, 7)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Different labelled rows that the regression is fitted on, at most; copies weigh.
SAMPLE_ROWS = 6_000
#: Features enter the regression if their ratio is this many standard errors from 0; of
#: those, the strongest are kept, at most so many.
STRENGTH, KEPT_FEATURES = 2.5, 15_000
ALPHA, L2, STEPS = 1.0, 1e-4, 120
THRESHOLD = 0.3
_BLANKS = {ord(c): " " for c in "\t\n\v\f\r"}
_U = np.uint64
_PLACE = mix64(np.arange(101, 101 + max(GRAMS), dtype=np.uint64)) | _U(1)


@dataclass(frozen=True)
class Model:
    """Weights per feature bucket (ratio times coefficient), and the intercept."""

    weights: np.ndarray
    intercept: float


class _Features:
    """Distinct feature buckets of a text, by last writer in a table of all buckets."""

    def __init__(self) -> None:
        self.last = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        """Texts that with their blanks are shorter than the shortest n-gram have no feature. Long texts go in pieces
        that overlap by the longest n-gram less one, so none is lost or cut."""
        text = f" {text or ''} ".lower().translate(_BLANKS)
        piece, found = 1 << 18, []
        for start in range(0, max(1, len(text)), piece):
            part = text[start : start + piece + max(GRAMS) - 1]
            found.append(self._piece(part, piece))
        if len(found) == 1:
            return found[0]
        return np.unique(np.concatenate(found))

    def _piece(self, text: str, piece: int) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
        n = len(codes)
        total, hashes = np.zeros(n, np.uint64), []
        for k in range(min(max(GRAMS), n)):
            total[: n - k] += codes[k:] * _PLACE[k]
            if k + 1 in GRAMS:
                hashes.append((total[: min(n - k, piece)] + _U(k + 1)) * _U(0x9E3779B97F4A7C15))
        if not hashes:
            return np.zeros(0, np.int64)
        at = (np.concatenate(hashes) >> _U(64 - BUCKET_BITS)).astype(np.int64)
        order = np.arange(len(at), dtype=np.int32)
        self.last[at] = order
        return at[self.last[at] == order]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class per bucket, over the whole task."""
    features, counts, rows = _Features(), np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[label, features(text.as_py())] += 1
            rows[label] += 1
    used = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[-1, used]),
            pa.array(np.r_[rows[0], counts[0, used]]),
            pa.array(np.r_[rows[1], counts[1, used]]),
        ],
        names=["bucket", "clean", "toxic"],
    )


def _kept_features(kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in batches:
            out = []
            for text in batch.column(0):
                found = features(text.as_py())
                out.append(np.sort(found[kept[found]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.list_(pa.int32())), batch.column(1), batch.column(2)],
                names=["features", "label", "place"],
            )

    return run


def fit_regression(
    rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, weight: np.ndarray | None = None
) -> Model:
    """Logistic regression on ratio-scaled features by accelerated gradient steps; empties ``rows``.

    ``weight`` (of mean 1) is what each row counts.
    """
    ends = np.cumsum([0, *(len(r) for r in rows)])
    at = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    rows.clear()
    n = len(ends) - 1
    weight = np.ones(n) if weight is None else weight
    # Runs of documents, so that intermediate vectors stay small.
    runs = [(i, min(i + 500, n)) for i in range(0, n, 500)]

    def run_of(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = at[ends[i] : ends[j]]
        return own, np.repeat(np.arange(j - i, dtype=np.int32), np.diff(ends[i : j + 1])), ratio[own]

    square = 0.0
    for i, j in runs:
        _, doc, value = run_of(i, j)
        square += float((value**2 * weight[i:j][doc]).sum())
    rate = 4.0 / (square / max(n, 1) + 1.0)
    toxic = float(labels @ weight)
    w, b = np.zeros(len(ratio)), float(np.log((toxic + 1) / (weight.sum() - toxic + 1)))
    ahead_w, ahead_b = w, b
    for step in range(STEPS):
        grad, error_sum = L2 * ahead_w, 0.0
        for i, j in runs:
            own, doc, value = run_of(i, j)
            z = np.bincount(doc, value * ahead_w[own], minlength=j - i) + ahead_b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i:j]) * weight[i:j] / n
            grad = grad + np.bincount(own, value * error[doc], minlength=len(ratio))
            error_sum += error.sum()
        next_w, next_b = ahead_w - rate * grad, ahead_b - error_sum
        pull = step / (step + 3)
        ahead_w, ahead_b = next_w + pull * (next_w - w), next_b + pull * (next_b - b)
        w, b = next_w, next_b
    return Model((ratio * w).astype(np.float32), b)


def train(labelled: DataFrame) -> Model | None:
    """Fit on rows (doc_id, text, label 0 or 1); None if a class has no row.

    Rows with a null label are passed over; a null text counts as empty. Repeated rows are
    one row of the sample, with their number as weight.
    """
    labelled = labelled.where("label IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    # Joined once; counts, draws and the sample read the written rows.
    labelled = written(labelled.withColumn("draw", samples.draw()).drop("doc_id"), "labelled")
    counted = labelled.select("text", "label").mapInArrow(_counts, "bucket long, clean long, toxic long")
    sums = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    bucket = sums.column("bucket").to_numpy()
    both = np.zeros((2, BUCKETS + 1))
    both[0, bucket], both[1, bucket] = sums.column("clean").to_numpy(), sums.column("toxic").to_numpy()
    rows, counts = both[:, -1], both[:, :-1]
    if not rows.all():
        return None
    smooth = counts + ALPHA
    ratio = np.log(smooth[1] / (rows[1] + 2 * ALPHA)) - np.log(smooth[0] / (rows[0] + 2 * ALPHA))
    strength = np.abs(ratio) / np.sqrt(1 / smooth[0] + 1 / smooth[1])
    limit = np.partition(strength, BUCKETS - KEPT_FEATURES)[BUCKETS - KEPT_FEATURES]
    kept = strength >= max(limit, STRENGTH)
    ratio = np.where(kept, ratio, 0)
    chosen = samples.plan(labelled, SAMPLE_ROWS)
    sample = labelled.select("text", "label", samples.place(chosen).alias("place")).where(F.col("place") <= 1.2)
    sampled = sample.mapInArrow(_kept_features(kept), "features array<int>, label int, place double")
    found = samples.unique(sampled, chosen, "features").toArrow()
    labels = found.column("label").to_numpy().astype(float)
    weight = found.column("copies").to_numpy() * np.array(chosen.weight)[labels.astype(int)]
    column = found.column("features").combine_chunks()
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    each = [values[a:b].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    # The driver holds one copy of the sample during the fit.
    del found, column, values
    pa.default_memory_pool().release_unused()
    return fit_regression(each, labels, ratio, weight / weight.mean())


def _scores(model: Model):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = _Features()
        for batch in texts:
            z = np.array([model.weights[features(t)].sum(dtype=np.float64) for t in batch], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z + model.intercept, -500, 500))))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null doc_id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, held: Column | None = None) -> DataFrame:
    """Rows (doc_id, text, label) of labelled documents outside the held-out fold.

    A doc_id labelled more than once takes its most frequent label, 1 in a tie. Null
    doc_ids and null labels teach nothing. Documents that repeat a doc_id all count.
    """
    votes = (
        labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("labelled_id").isNotNull() & F.col("label").isin(0, 1))
        .where(~(held_out(F.col("labelled_id")) if held is None else held))
        .groupBy("labelled_id")
        .agg((F.sum("label") * 2 >= F.count("*")).cast("int").alias("label"))
    )
    rows = labels.count()
    if docs.schema["doc_id"].dataType == votes.schema["labelled_id"].dataType:
        passed = may_match(votes.withColumnRenamed("labelled_id", "doc_id"), ["doc_id"], rows)
        docs = docs if passed is None else docs.where(passed)
    return docs.join(bounded(votes, rows), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc, score): every input row with its probability of being toxic.

    Null text: as an empty one; both score by the intercept. Without labels of both
    classes every score is 0. Extra columns stay in ``doc`` untouched.
    """
    rows = whole(docs)
    text = F.coalesce(held(rows, "text").cast("string"), F.lit("")).alias("text")
    plain = rows.select(held(rows, "doc_id").alias("doc_id"), text)
    model = train(labelled_rows(plain, labels, "toxic"))
    if model is None:
        return rows.select("doc", F.lit(0.0).alias("score"))
    return rows.select("doc", _scores(model)(text).alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    return score(docs, labels).where(F.col("score") < threshold).select("doc.*")
