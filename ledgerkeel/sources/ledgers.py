"""Stored ledgers read from their published text, one artifact per header and step.

Reading is permissive: an artifact that cannot be read makes the ledger of its group
unreadable and is reported, and no other group is concerned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import jsonl

LEDGER_DIR = "ledger"
HEADER_ENTRY = f"{LEDGER_DIR}/header.json"
_STEP_ENTRY = rf"^{LEDGER_DIR}/([0-9]{{12}})\.json$"



def _schema(numbers: dict[str, T.DataType], texts: str) -> T.StructType:
    schema = T.StructType()
    for name, dtype in numbers.items():
        schema.add(name, dtype)
    for name in texts.split():
        schema.add(name, T.StringType())
    return schema


HEADER_SCHEMA = _schema(
    {"lock_version": T.IntegerType(), "head_index": T.LongType()},
    "hash_algorithm canonicalizer engine target schema_file migrations_dir checkpoints_dir head_chain_hash head_schema_digest",
)
STEP_SCHEMA = _schema(
    {"idx": T.LongType()}, "version entry payload_digest snapshot_entry snapshot_digest schema_digest chain_hash"
)


def stored_ledgers(artifacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, locked, unreadable) of artifacts grp, entry, payload.

    Only artifacts below the ledger folder are looked at. ``unreadable`` (grp, reason) has a row for
    each that is not one JSON object of the known fields and types, has a name that no header or
    step has, or is a step of a group without a header; ``coherence.ledger_state`` takes it. Fields
    that are absent or null are found there. A step's arrival position is the number in its name.
    """
    mine = artifacts.where(F.startswith("entry", F.lit(f"{LEDGER_DIR}/"))).select(
        "grp",
        F.col("entry").alias("_name"),
        # An empty artifact is no object either; as a blank line it would be passed over.
        F.when(F.trim(F.col("payload").cast("string")) == "", F.lit("(empty)")).otherwise(F.col("payload").cast("string")).alias("value"),
    )
    number = F.regexp_extract("_name", _STEP_ENTRY, 1)
    # Written, so that what reads the parts several times does not parse them again.
    header = written(jsonl.checked_lines(mine.where(F.col("_name") == HEADER_ENTRY), HEADER_SCHEMA), "headers")
    step = written(jsonl.checked_lines(mine.where(number != ""), STEP_SCHEMA), "locked")
    good_header, good_step = (df.where(F.col("error").isNull()) for df in (header, step))
    reason = F.concat("_name", F.lit(": "), F.col("error"))
    bad = [df.where(F.col("error").isNotNull()).select("grp", reason.alias("reason")) for df in (header, step)]
    odd = mine.where((F.col("_name") != HEADER_ENTRY) & (number == "")).select(
        "grp", F.concat("_name", F.lit(": not an artifact of a ledger")).alias("reason")
    )
    null = mine.where(F.col("value").isNull()).select("grp", F.concat("_name", F.lit(": no content")).alias("reason"))
    headless = (
        mine.groupBy("grp").agg(F.bool_or(F.col("_name") == HEADER_ENTRY).alias("_header")).where("NOT _header")
    ).select("grp", F.lit("no header").alias("reason"))
    unreadable = bad[0].unionByName(bad[1]).unionByName(odd).unionByName(null).unionByName(headless)
    locked = good_step.select("grp", number.try_cast("bigint").alias("pos"), "row.*")
    return good_header.select("grp", "row.*"), locked, unreadable
