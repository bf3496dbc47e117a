"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

One pass over the documents keeps, of each text, the query terms it holds with their counts, and
its length. Corpus numbers (documents, lengths, document frequencies) are aggregates of those
rows. A second pass reads them segment by segment: a task inverts ``SEGMENT_ROWS`` documents into
posting lists and answers all queries on them. For one query the shortest lists, up to
``SHORT_POSTINGS`` postings together, are added up term at a time into accumulators, sorted by
document. These then act as one more iterator, whose bound is the highest accumulator, beside
the long lists with theirs. From the k-th best score so far follows which iterators can only matter
together with others; documents are taken from the remaining ones, the rest is looked up by skipping,
best bound first, and given up as soon as the bounds left cannot reach the k-th score.
Thresholds live on from segment to segment of a task. Every task returns at most k rows per
query; Spark ranks those.

Queries are served in blocks of ``BLOCK_TERMS`` terms, at least one query, so that what each task
is told has a fixed size; each block reads the documents once. The scores are exact integers.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import words
from .common import held, whole, written

TOP = 10
SEGMENT_ROWS, SHORT_POSTINGS = 16_384, 2_048
BLOCK_TERMS = 200_000
#: Length share in percent, and scale of a contribution.
LENGTH_SHARE, SCALE = 90, 1_000_000_000


@dataclass(frozen=True)
class Limits:
    """Documents inverted at once, and postings of the lists that are added up first."""

    segment_rows: int = SEGMENT_ROWS
    short_postings: int = SHORT_POSTINGS


LIMITS = Limits()


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, terms of all documents, and the weight of every term number."""

    documents: int
    terms: int
    weights: np.ndarray


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * holding + 1)))


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [list(dict.fromkeys(words(t.as_py()))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lists, pa.list_(pa.binary()))], names=["query", "terms"]
        )


def _forward(numbers: dict[bytes, int]):
    """Per document: its number of terms, and numbers and counts of the query terms it holds."""
    asked = numbers.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column(1):
                own = words(text.as_py())
                held_counts = Counter(own)
                found = held_counts.keys() & asked
                n.append(len(own))
                terms.append([numbers[t] for t in found])
                counts.append([held_counts[t] for t in found])
            columns = [pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "terms", "counts"])

    return run


class Best:
    """The k best (score, document) pairs: higher scores first, then smaller ids, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def floor(self) -> int:
        """A score below this cannot enter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.k:
            heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int | None, int]]:
        return [(-negative if known else None, score) for score, known, negative in self.heap]


class Segment:
    """Posting lists, with contributions and bounds, of some documents."""

    def __init__(
        self,
        ids: list,
        n: np.ndarray,
        terms: np.ndarray,
        counts: np.ndarray,
        sizes: np.ndarray,
        corpus: Corpus,
        short_postings: int = SHORT_POSTINGS,
    ) -> None:
        self.ids, self.short_postings = ids, short_postings
        docs = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        terms, docs, tf = terms[order], docs[order], counts[order].astype(np.int64)
        m = (100 - LENGTH_SHARE) + LENGTH_SHARE * n.astype(np.int64) * corpus.documents // max(corpus.terms, 1)
        gains = corpus.weights[terms] * (SCALE * tf // (1000 * tf + 8 * m[docs]))
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(terms)].astype(np.int64) if len(starts) else starts
        self.lists = {
            int(terms[a]): (docs[a:b], gains[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
        }

    def search(self, query: list[int], best: Best) -> None:
        lists = sorted((self.lists[t] for t in query if t in self.lists), key=lambda x: len(x[0]))
        short, room = 0, self.short_postings
        while short < len(lists) and len(lists[short][0]) <= room:
            room -= len(lists[short][0])
            short += 1
        iterators = [_Iterator(*own) for own in lists[short:]]
        if short:
            iterators.append(_Iterator(*accumulate(lists[:short])))
        self._by_document([i for i in iterators if i.bound > 0], best)

    def _by_document(self, iterators: list[_Iterator], best: Best) -> None:
        iterators.sort(key=lambda i: i.bound)
        # together[i]: what the first i iterators can add at most.
        together = [0]
        for i in iterators:
            together.append(together[-1] + i.bound)
        floor, leading = best.floor(), 0
        while True:
            while leading < len(iterators) and together[leading + 1] < floor:
                leading += 1
            if leading == len(iterators):
                return
            current = iterators[leading:]
            if len(current) == 1:
                # A lone source skips to where it can still reach the floor.
                current[0].skip_below(floor - together[leading])
            doc = min(i.doc for i in current)
            if doc == _END:
                return
            score = 0
            for i in current:
                if i.doc == doc:
                    score += i.gain()
                    i.next()
            for at in range(leading - 1, -1, -1):
                if score + together[at + 1] < floor:
                    break
                score += iterators[at].gain_of(doc)
            else:
                if score >= floor:
                    best.add(score, self.ids[doc])
                    floor = best.floor()


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the documents of several lists with their summed contributions."""
    docs, gains = np.concatenate([d for d, _ in lists]), np.concatenate([g for _, g in lists])
    order = np.argsort(docs, kind="stable")
    docs, gains = docs[order], gains[order]
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    return docs[starts], np.add.reduceat(gains, starts)


_END = 1 << 62


class _Iterator:
    """Documents in order with their contributions, the highest of which is the bound."""

    def __init__(self, docs: np.ndarray, gains: np.ndarray) -> None:
        self.gains_array, self.bound = gains, int(gains.max())
        self.docs, self.gains, self.at = docs.tolist(), gains.tolist(), 0
        self.doc = self.docs[0]
        self.limit, self.able = -1, None

    def gain(self) -> int:
        return self.gains[self.at]

    def next(self) -> None:
        self.at += 1
        self.doc = self.docs[self.at] if self.at < len(self.docs) else _END

    def skip_below(self, limit: int) -> None:
        """Move on to the next document that contributes ``limit`` at least."""
        if self.doc == _END or self.gains[self.at] >= limit:
            return
        if limit != self.limit:
            self.limit, self.able = limit, np.flatnonzero(self.gains_array >= limit).tolist()
        place = bisect_left(self.able, self.at)
        self.at = self.able[place] if place < len(self.able) else len(self.docs)
        self.doc = self.docs[self.at] if self.at < len(self.docs) else _END

    def gain_of(self, doc: int) -> int:
        """The contribution of a document no smaller than any asked for before."""
        self.at = bisect_left(self.docs, doc, self.at)
        if self.at == len(self.docs):
            self.doc = _END
            return 0
        self.doc = self.docs[self.at]
        return self.gains[self.at] if self.doc == doc else 0


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and list sizes of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _answers(queries: dict[int, list[int]], corpus: Corpus, k: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: Best(k) for q in queries}
        for batch in batches:
            for start in range(0, batch.num_rows, limits.segment_rows):
                part = batch.slice(start, limits.segment_rows)
                terms, sizes = _flat(part.column(2))
                counts, _ = _flat(part.column(3))
                ids, n = part.column(0).to_pylist(), part.column(1).to_numpy()
                segment = Segment(ids, n, terms, counts, sizes, corpus, limits.short_postings)
                for q, own in queries.items():
                    segment.search(own, best[q])
        found = [(q, d, s) for q, b in best.items() for d, s in b.rows()]
        columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return run


def _block(items: DataFrame, docs: DataFrame, k: int, limits: Limits) -> DataFrame:
    """The k best documents, at most, of every task for the queries of one block."""
    found = items.toArrow()
    lists = found.column("terms").to_pylist()
    numbers: dict[bytes, int] = {}
    for terms in lists:
        for term in terms:
            numbers.setdefault(term, len(numbers))
    queries = {q: [numbers[t] for t in terms] for q, terms in zip(found.column("query").to_pylist(), lists, strict=True)}
    kept = written(docs.mapInArrow(_forward(numbers), "doc_id long, n long, terms array<int>, counts array<int>"), "ranking")
    totals = kept.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = totals[0], totals[1] or 0
    frequencies = kept.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    weights = np.full(len(numbers), term_weight(n_docs, 0), np.int64)
    holding = frequencies.column("count").to_pylist()
    weights[frequencies.column("term").to_numpy()] = [term_weight(n_docs, h) for h in holding]
    corpus = Corpus(n_docs, n_terms, weights)
    return kept.where(F.size("terms") > 0).mapInArrow(_answers(queries, corpus, k, limits), "query long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, *, limits: Limits = LIMITS, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """Rows (item, rank, doc_id, score): for every row of ``items`` its k best documents.

    ``docs`` are read by doc_id and text, ``items`` by text; ``item`` holds all columns of an item,
    so names cannot clash. Documents that score 0 are not listed, so an item without a term, or one
    whose terms occur nowhere, has no rows; null and empty texts hold no term. Equal scores rank
    by ascending doc_id, null last. Repeated items are answered each, repeated documents are
    documents of their own. Empty tables give no rows.
    """
    if k < 1:
        raise ValueError("k must be positive.")
    rows = whole(items)
    numbered = written(rows.select("doc", F.monotonically_increasing_id().alias("query")), "ranking-items")
    text = held(numbered, "text").cast("string")
    terms = written(
        numbered.select("query", text.alias("text")).mapInArrow(_term_lists, "query long, terms array<binary>").where(F.size("terms") > 0),
        "ranking-terms",
    )
    plain = whole(docs)
    plain = plain.select(held(plain, "doc_id").cast("long").alias("doc_id"), held(plain, "text").cast("string").alias("text"))
    found = None
    for block in _blocks(terms, block_terms):
        own = written(_block(block, plain, k, limits), "ranking-block")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = plain.sparkSession.createDataFrame([], "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    return ranked.join(numbered, "query").select(F.col("doc").alias("item"), "rank", "doc_id", "score")


def _blocks(terms: DataFrame, block_terms: int) -> Iterator[DataFrame]:
    """The queries in runs of their numbers with at most ``block_terms`` terms, or a single query."""
    sizes = terms.select("query", F.size("terms").alias("n"))
    if not (sizes.agg(F.sum("n")).first()[0] or 0) > block_terms:
        yield terms
        return
    first, last, room = None, None, block_terms
    for row in sizes.orderBy("query").toLocalIterator():
        if first is not None and row.n > room:
            yield terms.where(F.col("query").between(first, last))
            first, room = None, block_terms
        first, room, last = row.query if first is None else first, room - row.n, row.query
    yield terms.where(F.col("query").between(first, last))
