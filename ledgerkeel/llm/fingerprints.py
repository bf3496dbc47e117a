"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) is hashed to a wide vector, and a document's fingerprint is the sum of
its paragraphs' vectors, lane by lane modulo a power of two. So order does not matter, equal
multisets of paragraphs have equal fingerprints, and a paragraph is put in or taken out by
adding or subtracting its vector.

The vector has two parts. ``STRONG`` lanes modulo 2**64 come from a 512-bit digest of the
paragraph and tell multisets apart. ``LANES`` lanes modulo 2**32 hold, for each word of the
paragraph, plus or minus one in the lane that the three words from there hash to. A text of
2**31 bytes has too few words for a sum to wrap. Differences of two documents' lanes estimate
how many word sequences they do not share, and ``likeness`` is the estimated share that they do (standard error about 0.05).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import held, whole

STRONG, LANES, WORDS = 8, 256, 3
#: Bytes of text handled at a time.
SLICE = 1 << 20
_U = np.uint64


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the texts' paragraph vectors: (strong lanes, sketch lanes)."""
    parts = [text.encode("utf-8", "surrogatepass").split(b"\n") for text in texts]
    counts = np.array([len(p) for p in parts])
    flat = [p for ps in parts for p in ps]
    digests = b"".join(hashlib.blake2b(p).digest() for p in flat)
    begins = np.r_[0, np.cumsum(counts)[:-1]]
    strong = np.add.reduceat(np.frombuffer(digests, np.uint64).reshape(-1, STRONG), begins, axis=0)
    offsets = np.zeros(len(flat) + 1, np.int64)
    np.cumsum([len(p) for p in flat], out=offsets[1:])
    words, rows = kernels.word_hashes(np.frombuffer(b"".join(flat), np.uint8), offsets, lower=False)
    per_part = np.diff(rows)
    left = np.repeat(rows[1:], per_part) - np.arange(len(words))
    total = words * _U(0xD6E8FEB86659FD93)
    for k in range(1, WORDS):
        more = np.zeros_like(total)
        more[: len(words) - k] = words[k:] * kernels._PLACE[k]
        total += np.where(left > k, more, _U(k))
    h = kernels.mix64(total)
    doc = np.repeat(np.repeat(np.arange(len(texts)), counts), per_part)
    sign = (h & _U(1)).astype(np.float64) * 2 - 1
    at = doc * LANES + (h >> _U(56)).astype(np.int64)
    sketch = np.bincount(at, sign, minlength=len(texts) * LANES).reshape(-1, LANES)
    return strong, sketch.astype(np.int32)


def encode(strong: np.ndarray, sketch: np.ndarray) -> str:
    return base64.b64encode(strong.astype("<u8").tobytes() + sketch.astype("<i4").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data[: 8 * STRONG], "<u8").copy(), np.frombuffer(data[8 * STRONG :], "<i4").copy()


def fingerprint(text: str) -> str:
    strong, sketch = vectors([text])
    return encode(strong[0], sketch[0])


def insert(print_: str, paragraphs: str) -> str:
    """The fingerprint after adding paragraphs (joined by newlines)."""
    (a, b), (c, d) = decode(print_), decode(fingerprint(paragraphs))
    return encode(a + c, b + d)


def remove(print_: str, paragraphs: str) -> str:
    """The fingerprint after taking paragraphs away."""
    (a, b), (c, d) = decode(print_), decode(fingerprint(paragraphs))
    return encode(a - c, b - d)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated shared part of the word sequences of two sketches, by row, from 0 to 1."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    own, apart = (a * a).sum(-1) + (b * b).sum(-1), ((a - b) ** 2).sum(-1)
    return np.where(own + apart > 0, np.clip((own - apart) / np.maximum(own + apart, 1), 0, 1), 1.0)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > SLICE:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _print_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        texts, out = list(texts), []
        for a, b in _groups([len(text) for text in texts]):
            out += [encode(s, k) for s, k in zip(*vectors(texts[a:b]), strict=True)]
        yield pd.Series(out, dtype=object)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc, fingerprint), one per input row; a null text is an empty one.

    Equal texts have equal fingerprints, and so have texts with the same lines in another
    order. An empty text is one empty paragraph. Extra columns stay in ``doc``.
    """
    rows = whole(docs)
    text = F.coalesce(held(rows, "text").cast("string"), F.lit(""))
    return rows.select("doc", F.pandas_udf(_print_texts, "string")(text).alias("fingerprint"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the next one of its part; the last row of a part is only looked at."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held_part, held_id, held_text, held_vec = None, None, None, None
    for batch in batches:
        parts, tails = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids, sizes = batch.column(2).to_pylist(), pc.binary_length(batch.column(3)).to_pylist()
        for a, b in _groups(sizes):
            own_part, own_id, own_text = parts[a:b], ids[a:b], batch.column(3).slice(a, b - a).to_pylist()
            strong, sketch = vectors(own_text)
            tail = tails[a:b]
            if held_part is not None:
                own_part, own_id, own_text = [held_part, *own_part], [held_id, *own_id], [held_text, *own_text]
                strong, sketch = np.vstack([held_vec[0], strong]), np.vstack([held_vec[1], sketch])
                tail = [0, *tail]
            held_part = None
            pairs = [i for i in range(len(own_text) - 1) if not tail[i] and own_part[i] == own_part[i + 1]]
            if not tail[-1]:
                held_part, held_id, held_text, held_vec = own_part[-1], own_id[-1], own_text[-1], (strong[-1], sketch[-1])
            if not pairs:
                continue
            edited = []
            for i in pairs:
                half = len(own_text[i]) // 2
                edited.append(own_text[i][: len(own_text[i]) - half] + own_text[i + 1][:half])
            edited_strong, edited_sketch = vectors(edited)
            at = np.array(pairs)
            columns = [
                [own_id[i] for i in pairs],
                [len(own_text[i]) for i in pairs],
                [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                [encode(strong[i], sketch[i]) for i in pairs],
                [encode(s, k) for s, k in zip(edited_strong, edited_sketch, strict=True)],
                likeness(sketch[at], edited_sketch),
                likeness(sketch[at], sketch[at + 1]),
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edit: its last half replaced by the start of the next text.

    Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). Next is by doc_id, null last, rows of one doc_id by text hash; the first row
    follows the last, and a single row follows itself. Documents are cut into ranges of
    doc_id, each with a copy of the first document of the following range, so texts are
    shuffled once and a task streams through its ranges with one document held.
    """
    spark = docs.sparkSession
    rows = whole(docs)
    text = F.coalesce(held(rows, "text").cast("string"), F.lit("")).alias("text")
    keyed = rows.select(held(rows, "doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / (2 * n) for i in range(1, 2 * n)]
    cuts = keyed.agg(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in shares]), 20_000)).head()[0] or []
    cuts = sorted(set(cuts))
    listed = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("CAST(array() AS ARRAY<BIGINT>)")
    keyed = keyed.withColumn("part", _range_of(F.col("doc_id"), listed, len(cuts)))
    order = [F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("h")]
    firsts = keyed.groupBy("part").agg(F.min(F.struct(*order)).alias("first")).orderBy("part").collect()
    before = [(r["first"]["doc_id"], r["first"]["h"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(before, "id long, head_h long, previous int")
    at_head = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("head_h"))
    places = F.filter(
        F.array(
            F.struct(F.col("part").alias("part"), F.lit(0).alias("tail")),
            F.struct(F.col("previous").alias("part"), F.lit(1).alias("tail")),
        ),
        lambda p: p["part"].isNotNull(),
    )
    dealt = keyed.join(F.broadcast(heads), at_head, "left").withColumn("p", F.explode(places))
    dealt = dealt.select(F.col("p.part").alias("part"), F.col("p.tail").alias("tail"), "doc_id", "h", "text")
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), "h")
    return ordered.select("part", "tail", "doc_id", "text").mapInArrow(
        _compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _range_of(value: Column, cuts: Column, n: int) -> Column:
    """How many of n sorted cuts are not above a value, by binary search; null counts all."""

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.element_at(cuts, F.least(middle, F.lit(max(n - 1, 0))) + 1) <= value)
        low = F.when(up, middle + 1).otherwise(s["lo"])
        high = F.when((s["lo"] < s["hi"]) & ~up, middle).otherwise(s["hi"])
        return F.struct(low.alias("lo"), high.alias("hi"))

    if not n:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step)["lo"]
    return F.when(value.isNull(), F.lit(n)).otherwise(found)
