"""Bounded samples of labelled rows that hold both classes and count copies.

Rows are drawn by a hash of document id and text, so copies are drawn together; what is bounded is
the number of different draws, each with its number of rows as weight. A rare class keeps at
least a twelfth of the sample, or all its draws; weights put the shares right again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least part of a sample that a class gets, if it has so many draws.
LEAST_SHARE = 12


@dataclass(frozen=True)
class Plan:
    """Draws of each class in the sample, how far its draws are stretched, and its weight."""

    rows: int
    stretch: tuple[float, float]
    weight: tuple[float, float]


def draw() -> Column:
    """The draw of a row (doc_id, text), below 1."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)


def plan(labelled: DataFrame, rows: int) -> Plan | None:
    """Count the different draws per class over all rows (label, draw); None if a class has no row."""
    drawn = labelled.select("label", "draw").distinct()
    found = {r.label: r.n for r in drawn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    have = (found.get(0, 0), found.get(1, 0))
    total = sum(have)
    if not all(have):
        return None
    taken = [min(h, max(round(rows * h / total), min(h, rows // LEAST_SHARE), 1)) for h in have]
    weight = tuple((h / total) / (t / sum(taken)) for h, t in zip(have, taken, strict=True))
    return Plan(sum(taken), tuple(h / t for h, t in zip(have, taken, strict=True)), weight)


def place(of: Plan) -> Column:
    """A row's place in the sample: up to about 1 are in, rising with its draw."""
    return F.col("draw") * F.when(F.col("label") == 1, of.stretch[1]).otherwise(of.stretch[0])


def unique(sampled: DataFrame, of: Plan, features: str) -> DataFrame:
    """Rows (features, label, place, copies), lowest places first, at most the planned number."""
    one = sampled.groupBy("place", "label").agg(F.first(features).alias(features), F.count("*").alias("copies"))
    return one.orderBy("place", "label").limit(of.rows)
