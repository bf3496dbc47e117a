"""Wide rows of few keys: filtered where they are scanned, before anything wide is shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutate import BROADCAST_KEYS

#: Bits of the filter for many keys, at most (16 MB); about 16 per key keep one row in a hundred that nobody asked for.
FILTER_BITS = 1 << 27


def _hashes(keys: list[str]) -> tuple[Column, Column]:
    return F.xxhash64(*[F.col(k) for k in keys]), F.xxhash64(F.lit(1), *[F.col(k) for k in keys])


def requested_rows(wide: DataFrame, asked: DataFrame, keys: list[str], broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``wide`` that share the ``keys`` of a row of ``asked``; null keys are asked for by none.

    ``asked`` is counted. Up to ``broadcast_keys`` keys, eight bytes of hash each are broadcast and an
    exact join of what passes follows. More keys become the bits of a Bloom filter of bounded size in the scan's
    own filter; it lets some unrequested rows pass, never drops a requested one. Only what passes
    is shuffled by the exact join. ``asked`` is read twice, so it should be a written table.
    """
    named = [f"_asked_{i}" for i in range(len(keys))]
    known = asked.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]).dropna("any").distinct()
    count = known.count()
    if count <= broadcast_keys:
        hashed = known.select(F.xxhash64(*named).alias("_hash"))
        near = wide.withColumn("_own", _hashes(keys)[0]).join(F.broadcast(hashed), F.col("_own") == F.col("_hash"), "left_semi").drop("_own")
    else:
        near = wide.where(in_bits(bloom_bits(known, named, count), keys))
    same = F.lit(True)
    for k, n in zip(keys, named, strict=True):
        same = same & (F.col(k) == F.col(n))
    return near.join(known, same, "left_semi")


def bloom_bits(known: DataFrame, keys: list[str], count: int) -> bytes:
    """The filter of all keys; a group per byte that is set is all that reaches the driver."""
    size = min(FILTER_BITS, 1 << max(10, (16 * count - 1).bit_length()))
    places = known.select(F.explode(F.array(*[F.pmod(h, F.lit(size)) for h in _hashes(keys)])).alias("at"))
    mask = F.expr("shiftleft(1, CAST(at % 8 AS INT))")
    found = places.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(mask).alias("mask")).toArrow()
    filled = np.zeros(size // 8, np.uint8)
    filled[found.column("byte").to_numpy()] = found.column("mask").to_numpy()
    return filled.tobytes()


def in_bits(bits: bytes, keys: list[str]) -> Column:
    """Whether a row's keys may be in the filter; never false for one that is. Nulls are keys like others."""
    one, two = _hashes(keys)
    return _set(bits, one) & _set(bits, two)


def _set(bits: bytes, own: Column) -> Column:
    """Whether the bit of a hash is set."""
    at = F.pmod(own, F.lit(8 * len(bits)))
    byte = F.conv(F.hex(F.substring(F.lit(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1
