"""Quality classifier: a linear-chain conditional random field over lines.

A document is a chain of its lines, each good or bad. A line's features are shares of
character kinds, its length, repeated words, and the same figures of the lines before
and after it. Lines of labelled documents carry their document's label; the field is
fitted by gradient ascent on the conditional likelihood (forward-backward gives the
expected counts). A document's score is the mean of its lines' marginal probabilities
of being good, weighted by their lengths.

The fit uses a bounded sample (``SAMPLE_ROWS`` different labelled documents, chosen by hash, with
``SAMPLE_LINES`` lines at most, of which tasks return the line features only); every
document is scored whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import samples
from .common import held, whole, written
from .toxicity import labelled_rows

#: Different labelled documents in the sample, and lines of those the field is fitted on, at most.
SAMPLE_ROWS, SAMPLE_LINES = 4_000, 400_000
STEPS, RATE, L2 = 150, 0.05, 1e-3
THRESHOLD = 0.3
#: Code points handled at a time.
SLICE = 1 << 19

KINDS = ("upper", "lower", "digit", "blank", "mark", "symbol", "break")
_OWN = 13
FEATURES = 3 * _OWN + 3


def _kind_table() -> np.ndarray:
    """The kind of each code point of the basic plane, from its Unicode category."""
    by_category = {"Lu": 0, "Lt": 0, "Ll": 1, "Lo": 1, "Lm": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Cc": 3}
    table = np.full(1 << 16, 5, np.uint8)
    for code in range(1 << 16):
        category = unicodedata.category(chr(code))
        table[code] = by_category.get(category, 4 if category[0] in "PM" else 5)
    table[[ord(c) for c in "#$%&*@|\\/<>{}[]~^_=+"]] = 5
    table[10] = 6
    return table


_kinds: list[np.ndarray] = []


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, length per line, first line of each text and the end)."""
    if not _kinds:
        _kinds.append(_kind_table())
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds[0][np.minimum(codes, 0xFFFF)]
    end = np.flatnonzero(kind == 6)
    begin = np.r_[0, end[:-1] + 1]
    length = (end - begin).astype(float)
    lines = np.array([t.count("\n") + 1 for t in texts])
    first = np.r_[0, np.cumsum(lines)]
    some = np.maximum(length, 1)

    def per_line(flags: np.ndarray) -> np.ndarray:
        run = np.r_[0, np.cumsum(flags)]
        return run[end] - run[begin]

    shares = [per_line(kind == k) / some for k in range(6)]
    word = (kind != 3) & (kind != 6)
    starts = word & ~np.r_[False, word[:-1]]
    n_words = per_line(starts)
    at, stop = np.flatnonzero(starts), np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    run = np.r_[np.uint64(0), np.cumsum(codes.astype(np.uint64) * (codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))]
    sums = run[stop] - run[at]
    repeated = np.zeros(len(codes), bool)
    for lag in (1, 2):
        same = (sums[lag:] == sums[:-lag]) & (at[lag:] - at[:-lag] < 200)
        repeated[at[lag:][same]] = True
    again = per_line(repeated) / np.maximum(n_words, 1)
    bang = per_line(codes == 33) / some
    final = np.where(length > 0, kind[np.maximum(end - 1, 0)] == 4, False)
    small_first = np.where(length > 0, kind[np.minimum(begin, len(kind) - 1)] == 1, False)
    own = np.stack(
        [
            *shares,
            np.log1p(length) / 8,
            np.log1p(n_words) / 6,
            np.minimum(length / np.maximum(n_words, 1), 40) / 20,
            again,
            bang,
            final.astype(float),
            small_first.astype(float),
        ],
        axis=1,
    )
    before, after = np.vstack([np.zeros((1, _OWN)), own[:-1]]), np.vstack([own[1:], np.zeros((1, _OWN))])
    is_first, is_last = np.zeros(len(own)), np.zeros(len(own))
    is_first[first[:-1]], is_last[first[1:] - 1] = 1, 1
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    rest = np.stack([is_first, is_last, np.ones(len(own))], axis=1)
    return np.hstack([own, before, after, rest]), length, first


def _padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers by (place, text), longest chains first, and how many texts reach each place."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    reach = np.searchsorted(-counts[order], -np.arange(1, counts.max() + 1), "right")
    return order, reach


def marginals(
    good: np.ndarray, link: np.ndarray, first: np.ndarray, copies: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once; chains count ``copies`` times in both sums.

    ``good`` is each line's log odds of good, ``link`` the 2 x 2 transition scores
    (bad, good). Returns P(good) per line, expected transitions, and the sum of log Z.
    """
    order, reach = _padded(first)
    head = first[:-1][order]
    times = np.ones(len(order)) if copies is None else copies[order]
    steps = len(reach)
    emit = np.stack([np.zeros(len(good)), good], axis=1)
    forward, total = np.zeros((len(good), 2)), np.zeros(len(order))
    backward = np.zeros((len(good), 2))
    for t in range(steps):
        rows = head[: reach[t]] + t
        if t == 0:
            score = emit[rows]
        else:
            past = forward[rows - 1]
            score = np.logaddexp(past[:, :1] + link[0], past[:, 1:] + link[1]) + emit[rows]
        norm = np.logaddexp(score[:, 0], score[:, 1])
        forward[rows] = score - norm[:, None]
        total[: reach[t]] += norm
    expected = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        rows = head[: reach[t + 1]] + t
        ahead = emit[rows + 1] + backward[rows + 1]
        pair = forward[rows][:, :, None] + link[None] + ahead[:, None, :]
        top = pair.max((1, 2), keepdims=True)
        weight = np.exp(pair - top)
        expected += (weight / weight.sum((1, 2), keepdims=True) * times[: reach[t + 1], None, None]).sum(0)
        back = np.logaddexp(link[:, 0] + ahead[:, :1], link[:, 1] + ahead[:, 1:])
        backward[rows] = back - back.max(1, keepdims=True)
    post = forward + backward
    return 1 / (1 + np.exp(np.clip(post[:, 0] - post[:, 1], -500, 500))), expected, float(total @ times)


@dataclass(frozen=True)
class Field:
    weights: np.ndarray
    link: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        x, length, first = line_features(texts)
        p, _, _ = marginals(self.odds(x), self.link, first)
        weight = np.add.reduceat(length, first[:-1])
        blank = np.repeat(weight == 0, np.diff(first))
        length = np.where(blank, 1.0, length)
        return np.add.reduceat(p * length, first[:-1]) / np.add.reduceat(length, first[:-1])


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, copies: np.ndarray | None = None) -> Field:
    """Maximise the conditional likelihood of chains whose lines all have their text's label (Adam).

    A chain counts ``copies`` times.
    """
    copies = np.ones(len(labels)) if copies is None else copies
    times = np.repeat(copies, np.diff(first))
    mean = (x * times[:, None]).sum(0) / times.sum()
    spread = np.sqrt(((x - mean) ** 2 * times[:, None]).sum(0) / times.sum()) + 1e-6
    mean[-1], spread[-1] = 0.0, 1.0
    x = (x - mean) / spread
    y = np.repeat(labels, np.diff(first)).astype(float)
    inner = (np.diff(first) - 1) * copies
    seen = np.array([[inner[labels == 0].sum(), 0.0], [0.0, inner[labels == 1].sum()]])
    scale = 1.0 / times.sum()
    theta = np.zeros(x.shape[1] + 4)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        link = theta[-4:].reshape(2, 2)
        p, expected, _ = marginals(x @ theta[:-4], link, first, copies)
        grad = np.r_[x.T @ ((p - y) * times), (expected - seen).ravel()] * scale + L2 * theta
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta -= RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2), mean, spread)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about SLICE code points; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > SLICE:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text) + 1
    if run:
        yield run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for group in _groups(batch.column(0).to_pylist()):
            x, _, first = line_features(group)
            x = x.astype(np.float32)
            found += [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.binary()), batch.column(1), batch.column(2)], names=["features", "label", "place"]
        )


def train(labelled: DataFrame) -> Field | None:
    """Fit on rows (doc_id, text, label 0 or 1); None if a class has no row.

    Repeated rows are one chain, counted as often. Of the sample, documents of up to a twentieth of
    ``SAMPLE_LINES`` lines take part, lowest places first, while they have no more lines together
    than that; if a class has longer ones only, its shortest comes in its place.
    """
    rows = labelled.where("label IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    rows = written(rows.withColumn("draw", samples.draw()).drop("doc_id"), "labelled")
    chosen = samples.plan(rows, SAMPLE_ROWS)
    if chosen is None:
        return None
    near = rows.select("text", "label", samples.place(chosen).alias("place")).where(F.col("place") <= 1.2)
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    sizes = samples.unique(near.select(lines.alias("lines"), "label", "place"), chosen, "lines").toArrow().to_pylist()
    kept, room = [], SAMPLE_LINES
    for own in sizes:
        if own["lines"] <= min(room, SAMPLE_LINES // 20):
            kept.append(own)
            room -= own["lines"]
    for label in (0, 1):
        if not any(own["label"] == label for own in kept):
            kept.append(min((own for own in sizes if own["label"] == label), key=lambda own: own["lines"]))
    spark = labelled.sparkSession
    wanted = spark.createDataFrame([(own["place"], own["label"]) for own in kept], "place double, label int")
    sampled = near.join(F.broadcast(wanted), ["place", "label"]).select("text", "label", "place")
    sampled = sampled.dropDuplicates(["place", "label"]).mapInArrow(_sampled, "features binary, label int, place double")
    found = sampled.orderBy("place", "label").toArrow()
    labels = found.column("label").to_numpy()
    counted = {(own["place"], own["label"]): own["copies"] * chosen.weight[own["label"]] for own in kept}
    copies = np.array([counted[key] for key in zip(found.column("place").to_pylist(), labels.tolist(), strict=True)])
    x = [np.frombuffer(b.as_buffer(), np.float32).reshape(-1, FEATURES) for b in found.column("features")]
    first = np.r_[0, np.cumsum([len(r) for r in x])]
    return fit(np.vstack(x).astype(float), first, labels, copies / copies.mean())


def _scores(field: Field):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts = [field.score(group) for group in _groups(list(batch))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null doc_id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc, score): every input row with the length-weighted share of good in its lines.

    Null text: as an empty one, a single empty line (its lines weigh the same then).
    Without labels of both classes every score is 1. Labels: as in ``toxicity``.
    """
    rows = whole(docs)
    text = F.coalesce(held(rows, "text").cast("string"), F.lit("")).alias("text")
    plain = rows.select(held(rows, "doc_id").alias("doc_id"), text)
    field = train(labelled_rows(plain, labels, "quality", held_out(F.col("labelled_id"))))
    if field is None:
        return rows.select("doc", F.lit(1.0).alias("score"))
    return rows.select("doc", _scores(field)(text).alias("score"))
