"""Content digests as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digest names a ledger header may carry.
SHA2 = "sha2-256"
BLAKE2B = "blake2b-256"
ALGORITHMS = (SHA2, BLAKE2B)


def hasher(algorithm: str = SHA2) -> Callable[[bytes], "hashlib._Hash"]:
    if algorithm == SHA2:
        return hashlib.sha256
    if algorithm == BLAKE2B:
        return partial(hashlib.blake2b, digest_size=32)
    raise ValueError(f"unknown digest {algorithm!r}; known: {', '.join(ALGORITHMS)}")


def hexdigest(payload: bytes, algorithm: str = SHA2) -> str:
    return hasher(algorithm)(payload).hexdigest()


@F.pandas_udf(T.StringType())
def _blake2b(payload: pd.Series) -> pd.Series:
    return payload.map(lambda raw: None if raw is None else hexdigest(raw, BLAKE2B))


def payload_digest(payload: Column, algorithm: str = SHA2) -> Column:
    """Hex digest of the raw bytes. SHA-2 stays in the JVM, BLAKE2b is Arrow-batched."""
    if algorithm == SHA2:
        return F.sha2(payload, 256)
    if algorithm == BLAKE2B:
        return _blake2b(payload.cast("binary"))
    raise ValueError(f"unknown digest {algorithm!r}; known: {', '.join(ALGORITHMS)}")


def ensure_newline(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def text_digest(text: Column, algorithm: str = SHA2) -> Column:
    """Digest after the newline rule; null stays null."""
    return payload_digest(ensure_newline(text), algorithm)


#: Before text that is no digest: longer than one, so that the two are never taken for each other.
_NO_DIGEST = bytes(33)


def packed(digest: Column) -> Column:
    """A hex digest as its 32 bytes, for shuffles; any other text behind a mark. Equal only if the texts are."""
    marked = F.concat(F.lit(_NO_DIGEST), digest.cast("binary"))
    return F.when(F.rlike(digest, F.lit(r"\A[0-9a-f]{64}\z")), F.unhex(digest)).otherwise(marked)


def unpacked(digest: Column) -> Column:
    """The text that ``packed`` was given."""
    text = F.substring(digest, len(_NO_DIGEST) + 1, (1 << 31) - 1).cast("string")
    return F.when(F.octet_length(digest) == 32, F.lower(F.hex(digest))).otherwise(text)
