"""Catalog tables: ordered scan and snapshot swap."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# Most partition values a scan is filtered by.
LISTED_PARTITIONS = 500

_SNAPSHOT = re.compile(r"__snap_[0-9a-f]{32}\Z")


def table_columns(spark: SparkSession, table: str) -> list[str]:
    return spark.table(table).columns


def sortable(schema: T.StructType) -> list[str]:
    plain = (T.MapType, T.VariantType)
    return [f.name for f in schema.fields if not isinstance(f.dataType, plain)]


def ordered_rows(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Sorted by the named columns, ties by all others.

    The tie-break makes repeated exports equal and lets the range partitioner
    split a value of the leading column that very many rows share.
    """
    rest = [c for c in sortable(df.schema) if c not in order_by]
    return df.orderBy(*order_by, *rest)


def ordered_table_scan(spark: SparkSession, table: str, order_by: list[str]) -> DataFrame:
    return ordered_rows(spark.table(table), order_by)


def table_location(spark: SparkSession, table: str) -> str:
    return table_details(spark, table)["Location"]


def table_details(spark: SparkSession, table: str) -> dict[str, str]:
    """The detail section of a table's description: one row per property, below the columns."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    start = next(i for i, row in enumerate(rows) if row["col_name"] == "# Detailed Table Information")
    return {row["col_name"]: row["data_type"] for row in rows[start + 1 :]}


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


@dataclass(frozen=True)
class Staged:
    """New content of a table, complete on shared storage but not yet visible.

    ``content`` is what the whole table holds once switched. ``location`` is the new one of an
    unpartitioned table, ``moves`` are the partitions (SQL clause) with their new locations,
    ``appended`` are rows to add.
    """

    table: str
    content: DataFrame
    location: str | None = None
    moves: tuple[tuple[str, str], ...] = ()
    appended: DataFrame | None = None


def _new_location(details: dict[str, str]) -> str:
    return f"{_SNAPSHOT.sub('', details['Location'].rstrip('/'))}__snap_{uuid.uuid4().hex}"


def stage_replace(spark: SparkSession, table: str, content: DataFrame) -> Staged:
    """Stage ``content``, which may read the table itself, as the table's whole content."""
    details = table_details(spark, table)
    if partition_columns(spark, table):
        return _stage_parts(spark, table, content, details, None)
    location, schema = _new_location(details), spark.table(table).schema
    _write_files(spark, table, content.select(*schema.fieldNames()), details, [], location)
    return Staged(table, spark.read.format(details["Provider"]).schema(schema).load(location), location)


def bucket_columns(details: dict[str, str]) -> tuple[int, list[str], list[str]]:
    """(number of buckets, bucket columns, sort columns) from a table's description; 0 if it has none."""
    names = [re.findall(r"`((?:[^`]|``)*)`", details.get(f"{kind} Columns", "")) for kind in ("Bucket", "Sort")]
    return int(details.get("Num Buckets", "0") or 0), *[[n.replace("``", "`") for n in own] for own in names]


def _write_files(
    spark: SparkSession, table: str, content: DataFrame, details: dict[str, str], parts: list[str], location: str
) -> None:
    """Write files as the table has them. Buckets are kept: the writer deals each row to the file of its
    bucket, under a second catalog entry for the new folder that is dropped again (its files stay)."""
    count, columns, order = bucket_columns(details)
    writer = content.write.format(details["Provider"])
    writer = writer.partitionBy(*parts) if parts else writer
    if not count:
        writer.save(location)
        return
    writer = writer.bucketBy(count, *columns)
    writer = writer.sortBy(*order) if order else writer
    staging = f"{table}__staged_{uuid.uuid4().hex}"
    try:
        writer.option("path", location).saveAsTable(staging)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")


def stage_partitions(spark: SparkSession, table: str, content: DataFrame, touched: DataFrame) -> Staged:
    """Stage ``content`` as that of the partitions in ``touched``, all others staying as they are.

    A touched partition without rows is emptied. Neither others' files nor their rows are read.
    """
    return _stage_parts(spark, table, content, table_details(spark, table), touched)


def _stage_parts(
    spark: SparkSession, table: str, content: DataFrame, details: dict[str, str], touched: DataFrame | None
) -> Staged:
    parts, target = partition_columns(spark, table), spark.table(table)
    location = _new_location(details)
    _write_files(spark, table, content.select(*target.columns), details, parts, location)
    written_rows = spark.read.format(details["Provider"]).schema(target.schema).load(location)
    # One row per partition comes to the driver, as many as the catalog is told of.
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1)
    filled = {_clause(parts, r): unquote(r["_folder"]) for r in written_rows.select(*parts, folder.alias("_folder")).distinct().collect()}
    if touched is None:
        names = [r["partition"] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
        existing = {_clause_of_name(name) for name in names}
        rest = target.where(F.lit(False))
    else:
        existing = {_clause(parts, r) for r in touched.select(*parts).distinct().collect()}
        rest = target.join(_renamed(touched.select(*parts).distinct(), parts), _same(parts), "left_anti")
    moves = filled | {clause: f"{location}/_empty" for clause in existing - set(filled)}
    return Staged(table, rest.unionByName(written_rows), moves=tuple(sorted(moves.items())))


def stage_append(spark: SparkSession, table: str, rows: DataFrame, content: DataFrame | None = None) -> Staged:
    """Stage rows to add to the table, or to ``content`` where that is staged for it already."""
    ready = written(rows, "appended")
    held = spark.table(table) if content is None else content
    return Staged(table, held.unionByName(ready.select(*held.columns)), appended=ready)


def _clause(parts: list[str], row) -> str:
    return ", ".join(f"`{c}` = {_literal(row[c])}" for c in parts)


def _literal(value) -> str:
    if value is None:
        return "null"
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _clause_of_name(name: str) -> str:
    """The clause of a partition as the catalog lists it: escaped ``column=value`` steps."""
    steps = [step.split("=", 1) for step in name.split("/")]
    values = {c: None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for c, v in steps}
    return _clause(list(values), values)


def switch(spark: SparkSession, staged: list[Staged]) -> None:
    """Make staged contents visible: rows are appended first, then locations are changed in the catalog.

    Nothing but catalog entries changes in the second part; if one change fails, the ones
    before it are taken back. Each table, or each partition of a partitioned one, changes at
    once. Running readers keep the old files, which stay until their owner removes them.
    """
    for one in staged:
        if one.appended is not None:
            append_rows(one.table, one.appended.select(*spark.table(one.table).columns))
    undo: list[str] = []
    try:
        for one in staged:
            if one.location is not None:
                undo.append(f"ALTER TABLE {one.table} SET LOCATION {_literal(table_location(spark, one.table))}")
                spark.sql(f"ALTER TABLE {one.table} SET LOCATION {_literal(one.location)}")
            for clause, location in one.moves:
                undo.append(_move(spark, one.table, clause, location))
    except Exception:
        for statement in reversed(undo):
            spark.sql(statement)
        raise
    finally:
        for one in staged:
            spark.catalog.refreshTable(one.table)


def _move(spark: SparkSession, table: str, clause: str, location: str) -> str:
    """Give a partition its new location; returns the statement that takes it back."""
    name = f"{table} PARTITION ({clause})"
    if spark.sql(f"SHOW PARTITIONS {name}").isEmpty():
        spark.sql(f"ALTER TABLE {table} ADD PARTITION ({clause}) LOCATION {_literal(location)}")
        return f"ALTER TABLE {name} SET LOCATION {_literal(f'{location}_undone')}"
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    start = next(i for i, row in enumerate(rows) if row["col_name"] == "# Detailed Partition Information")
    before = next(row["data_type"] for row in rows[start:] if row["col_name"] == "Location")
    spark.sql(f"ALTER TABLE {name} SET LOCATION {_literal(location)}")
    return f"ALTER TABLE {name} SET LOCATION {_literal(before)}"


def replace_content(spark: SparkSession, table: str, content: DataFrame) -> None:
    """Make ``content``, which may read the table itself, the table's whole content."""
    switch(spark, [stage_replace(spark, table, content)])


def _renamed(touched: DataFrame, parts: list[str]) -> DataFrame:
    return touched.select(*[F.col(c).alias(f"_touched_{c}") for c in parts])


def _same(parts: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_touched_{c}")) for c in parts])


def in_touched_partitions(target: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Target rows of the partitions the rows fall into.

    Up to ``LISTED_PARTITIONS`` distinct values become a filter the scan prunes
    by; more than that stay a semi join. Null is a partition of its own: its rows
    match no key, but they are in the partition that will be rewritten.
    """
    touched = rows.select(*columns).distinct()
    listed = touched.limit(LISTED_PARTITIONS + 1).collect()
    if len(listed) <= LISTED_PARTITIONS:
        inside = F.lit(False)
        for values in listed:
            own = F.lit(True)
            for column in columns:
                value = values[column]
                own = own & (F.col(column).isNull() if value is None else F.col(column) == F.lit(value))
            inside = inside | own
        return target.where(inside)
    return target.join(_renamed(touched, columns), _same(columns), "left_semi")


def swap_snapshot(spark: SparkSession, table: str, content: DataFrame) -> str:
    """Write the new content beside the table and point the table at it.

    The content may read the table itself. The catalog entry is the pointer:
    a failed write leaves it alone, and running readers keep the old files,
    which stay until the owner removes them.
    """
    staged = stage_replace(spark, table, content)
    switch(spark, [staged])
    return staged.location


def append_rows(table: str, rows: DataFrame) -> None:
    rows.write.insertInto(table)
