"""Checks of the JSON-lines source and sink, validation and table mutation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digests, rendering, sections
from ..operators import compare, mutate, validate
from ..plans import dataset
from ..plans.config import DataFile, DataSet
from ..session import scratch_path
from ..sources import jsonl, payloads, tables
from . import inputs as I
from .registry import check, cte

PLAIN = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_cents", T.LongType()),
        T.StructField("o_day", T.StringType()),
    ]
)

cte(
    "ord_json",
    """SELECT '{"o_cents":' || o_cents || ',"o_custkey":' || o_custkey || ',"o_day":"' || o_day || '","o_orderkey":' || o_orderkey
    || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS value FROM ord""",
)


@check("jsonl_sink", "SELECT value FROM ord_json")
def jsonl_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sink")
    jsonl.jsonl_sink(I.orders(spark, sf), path)
    return spark.read.text(path)


@check("jsonl_scan", "SELECT * FROM ord")
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "scan")
    df = I.orders(spark, sf)
    jsonl.jsonl_sink(df, path)
    return jsonl.jsonl_scan(spark, path, df.schema)


@check(
    "ordered_table_scan",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS p_cents FROM part ORDER BY p_brand, p_name",
)
def ordered_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    part = I.table(spark, sf, "part").withColumn("p_cents", I.cents("p_retailprice")).drop("p_retailprice")
    return tables.ordered_rows(part, ["p_brand", "p_name"])


@check(
    "payload_scan",
    "SELECT lang, source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang, source",
)
def payload_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "payloads")
    docs = I.table(spark, sf, "documents").select("text", "lang", "source")
    docs.repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    files = payloads.payload_scan(spark, path, "documents", "*.txt")
    return files.groupBy(
        F.regexp_extract("entry", r"^documents/lang=([^/]+)/source=([^/]+)/", 1).alias("lang"),
        F.regexp_extract("entry", r"^documents/lang=([^/]+)/source=([^/]+)/", 2).alias("source"),
    ).agg(F.sum(F.length("payload")).cast("bigint").alias("bytes"))


# ------------------------------------------------------------------ rendering


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second"),
        F.to_date("ts").alias("day"),
        F.col("value").cast("decimal(12,3)").alias("amount"),
        F.encode("event_type", "utf-8").alias("raw"),
        F.array(F.to_date("ts"), F.lit(None).cast("date")).alias("days"),
        F.struct(F.col("user_id").alias("u"), F.encode("event_type", "utf-8").alias("b")).alias("who"),
    )


@check(
    "render_json_value",
    """SELECT '{"amount":"' || CAST(CAST(value AS DECIMAL(12,3)) AS VARCHAR) || '","day":"' || strftime(ts, '%Y-%m-%d')
      || '","days":["' || strftime(ts, '%Y-%m-%d') || '",null],"event_id":' || event_id
      || ',"raw":"' || lower(hex(encode(event_type))) || '","second":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
      || '","ts":"' || CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END
      || '","who":{"b":"' || lower(hex(encode(event_type))) || '","u":' || user_id || '}}' AS value FROM events""",
)
def render_json_value(spark: SparkSession, sf: str) -> DataFrame:
    typed = _typed(spark, sf)
    return typed.select(rendering.json_line(typed.schema).alias("value"))


# ----------------------------------------------------------------- validation


def ragged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON lines whose keys, blanks and faults hang on the type."""
    kind = F.col("event_type")
    base = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"))
    line = (
        F.when(kind == "click", F.concat(F.lit("  "), base, F.lit(',"clicked":true} ')))
        .when(kind == "view", F.concat(base, F.lit(',"props":'), F.col("props"), F.lit("}")))
        .when(kind == "signup", F.concat(base, F.lit("}{}")))
        .when(kind == "error", F.concat(F.lit("["), base, F.lit("}]")))
        .otherwise(F.concat(base, F.lit(',"user_id":'), F.col("user_id").cast("string"), F.lit(',"k.'), F.get_json_object("props", "$.k"), F.lit('":null}')))
    )
    return I.table(spark, sf, "events").select("event_id", "event_type", line.alias("value"))


@check(
    "json_row_check",
    """SELECT event_id, event_type NOT IN ('signup', 'error') AS ok FROM events""",
)
def json_row_check(spark: SparkSession, sf: str) -> DataFrame:
    return validate.json_row_check(ragged_lines(spark, sf)).select("event_id", "ok")


cte(
    "good_keys",
    """SELECT 'event_id' AS key UNION SELECT 'clicked' FROM events WHERE event_type = 'click'
    UNION SELECT 'props' FROM events WHERE event_type = 'view' UNION SELECT 'user_id' FROM events WHERE event_type = 'purchase'
    UNION SELECT 'k.' || regexp_extract(props, '[0-9]+') FROM events WHERE event_type = 'purchase'""",
)


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    return ragged_lines(spark, sf).where(~F.col("event_type").isin("signup", "error"))


@check("observed_keys", "SELECT key FROM good_keys")
def observed_keys(spark: SparkSession, sf: str) -> DataFrame:
    return validate.observed_keys(_objects(spark, sf))


@check("unknown_columns", "SELECT key FROM good_keys WHERE key NOT IN ('event_id', 'user_id', 'props')")
def unknown_columns(spark: SparkSession, sf: str) -> DataFrame:
    return validate.unknown_columns(_objects(spark, sf), ["event_id", "user_id", "props"])


@check(
    "jsonl_findings",
    """SELECT event_type, CASE event_type WHEN 'click' THEN 'unknown columns: clicked' WHEN 'signup' THEN 'not one JSON object'
      WHEN 'error' THEN 'not one JSON object' WHEN 'view' THEN 'values not of the column type: props' END AS error, count(*) AS n
    FROM events WHERE event_type <> 'purchase' GROUP BY event_type
    UNION ALL SELECT event_type, 'unknown columns: k.' || regexp_extract(props, '[0-9]+'), count(*) FROM events WHERE event_type = 'purchase'
    GROUP BY event_type, props""",
)
def jsonl_findings(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("props", T.LongType())]
    )
    checked = jsonl.checked_lines(ragged_lines(spark, sf), schema)
    return checked.groupBy("event_type", "error").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- mutation

NEW_ROW = "o_orderkey, o_custkey, o_orderstatus, o_cents, NULL AS o_day, NULL AS o_orderpriority"


@check("apply_insert", f"SELECT * FROM ord UNION ALL SELECT {NEW_ROW} FROM new_orders")
def apply_insert(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.apply_insert(I.orders(spark, sf), I.new_orders(spark, sf))


@check(
    "apply_replace",
    "SELECT c_custkey AS s_suppkey, CAST(NULL AS VARCHAR) AS s_name, c_nationkey AS s_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS s_cents FROM customer",
)
def apply_replace(spark: SparkSession, sf: str) -> DataFrame:
    target = I.table(spark, sf, "supplier").withColumn("s_cents", I.cents("s_acctbal")).drop("s_acctbal")
    rows = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"), I.cents("c_acctbal").alias("s_cents")
    )
    return mutate.apply_replace(target, rows)


@check("apply_replace_empty", "SELECT count(*) AS rows_before, 0 AS rows_after FROM lineitem")
def apply_replace_empty(spark: SparkSession, sf: str) -> DataFrame:
    lines = I.table(spark, sf, "lineitem")
    after = mutate.apply_replace_empty(lines).select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    both = lines.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after)
    return both.agg(F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"))


@check(
    "apply_upsert",
    f"""SELECT * FROM ord o WHERE NOT EXISTS (SELECT 1 FROM corrections c WHERE c.o_orderkey = o.o_orderkey)
    UNION ALL SELECT {NEW_ROW} FROM corrections""",
)
def apply_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.apply_upsert(I.orders(spark, sf), I.corrections(spark, sf), ["o_orderkey"])


@check(
    "apply_upsert_keep",
    f"""SELECT o.o_orderkey, o.o_custkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_cents, o_day, o_orderpriority
    FROM ord o LEFT JOIN corrections c USING (o_orderkey)
    UNION ALL SELECT {NEW_ROW} FROM new_orders""",
)
def apply_upsert_keep(spark: SparkSession, sf: str) -> DataFrame:
    """Only the status is named by existing orders, so their amounts stay."""
    named = F.array(F.lit("o_orderkey"), F.lit("o_orderstatus"))
    rows = I.corrections(spark, sf).withColumn("present", named)
    return mutate.apply_upsert(I.orders(spark, sf), rows, ["o_orderkey"], missing="keep", present="present")


@check(
    "apply_upsert_composite",
    """SELECT conv_id, turn, role, text FROM conversations c
      WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = c.conv_id AND t.turn = c.turn)
    UNION ALL SELECT conv_id, turn, role, text FROM turns""",
)
def apply_upsert_composite(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.apply_upsert(I.table(spark, sf, "conversations"), I.turns(spark, sf), ["conv_id", "turn"])


@check(
    "apply_upsert_insert_all",
    """SELECT grp, event_type, CASE WHEN event_type IN ('click', 'view') THEN -1 - event_id ELSE event_id END AS event_id FROM ev""",
)
def apply_upsert_insert_all(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated keys in the file: all its rows stay, all old rows of the key go."""
    rows = I.event_changes(spark, sf).select("grp", "event_type", "event_id")
    fresh = rows.where(F.col("event_type").isin("click", "view")).withColumn("event_id", -1 - F.col("event_id"))
    return mutate.apply_upsert(rows, fresh, ["grp", "event_type"], on_duplicate="insert_all")


@check(
    "delete_matching",
    "SELECT * FROM ord o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
)
def delete_matching(spark: SparkSession, sf: str) -> DataFrame:
    keys = I.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return mutate.delete_matching(I.orders(spark, sf), keys, ["o_orderkey"])


@check(
    "delete_matching_null_keys",
    """SELECT key, o_cents FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS key, o_cents FROM ord)
    WHERE key IS NULL OR key NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def delete_matching_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("key")
    flag = F.col("l_returnflag")
    keys = I.table(spark, sf, "lineitem").where(flag != "A").select(F.when(flag == "R", F.col("l_orderkey")).alias("key"))
    return mutate.delete_matching(I.orders(spark, sf).select(key, "o_cents"), keys, ["key"])


# -------------------------------------------------------------- whole datasets


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


def _stored(spark: SparkSession, df: DataFrame, label: str) -> str:
    name = _name(label)
    df.write.option("path", scratch_path(spark, label)).saveAsTable(name)
    return name


def _data_set(spark: SparkSession, sf: str) -> tuple[DataSet, dict[str, str]]:
    """Three tables of the catalog and a data file for each write mode."""
    folder = scratch_path(spark, "data")
    orders_table = _stored(spark, I.orders(spark, sf), "orders")
    events_table = _stored(spark, I.table(spark, sf, "events").select("event_id", "user_id", "event_type"), "events")
    people = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    names_table = _stored(spark, people, "names")
    jsonl.jsonl_sink(I.corrections(spark, sf), f"{folder}/orders.jsonl")
    extra = I.table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("event_id"), F.lit("page").alias("event_type"))
    jsonl.jsonl_sink(extra, f"{folder}/events.jsonl")
    parts = I.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    jsonl.jsonl_sink(parts, f"{folder}/names.jsonl")
    files = (
        DataFile("orders", orders_table, "upsert", f"{folder}/orders.jsonl", on=("o_orderkey",)),
        DataFile("events", events_table, "insert", f"{folder}/events.jsonl", order_by=("event_id",)),
        DataFile("names", names_table, "replace", f"{folder}/names.jsonl", order_by=("name", "key")),
    )
    return DataSet("core", files), {"orders": orders_table, "events": events_table, "names": names_table}


def _as_text(df: DataFrame, name: str) -> DataFrame:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns]
    return df.select(F.lit(name).alias("name"), F.concat_ws("|", *cells).alias("row"))


@check(
    "apply_dataset",
    f"""SELECT 'orders' AS name, o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_cents || '|' || coalesce(o_day, 'null') || '|' || coalesce(o_orderpriority, 'null') AS row FROM (
      SELECT * FROM ord o WHERE NOT EXISTS (SELECT 1 FROM corrections c WHERE c.o_orderkey = o.o_orderkey)
      UNION ALL SELECT {NEW_ROW} FROM corrections)
    UNION ALL SELECT 'events', event_id || '|' || user_id || '|' || event_type FROM events
    UNION ALL SELECT 'events', (-1 - page_id) || '|null|page' FROM pages
    UNION ALL SELECT 'names', p_partkey || '|' || p_name FROM part""",
)
def apply_dataset(spark: SparkSession, sf: str) -> DataFrame:
    data_set, names = _data_set(spark, sf)
    dataset.apply_dataset(spark, data_set)
    return mutate.union_all([_as_text(spark.table(table), name) for name, table in names.items()])


@check(
    "apply_upsert_bucketed",
    f"""SELECT * FROM ord o WHERE NOT EXISTS (SELECT 1 FROM corrections c WHERE c.o_orderkey = o.o_orderkey)
    UNION ALL SELECT {NEW_ROW} FROM corrections""",
)
def apply_upsert_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections into a table bucketed by its key, as a data file."""
    name, path = _name("bucketed"), f"{scratch_path(spark, 'data')}/orders.jsonl"
    start = I.orders(spark, sf).write.bucketBy(8, "o_orderkey").sortBy("o_orderkey")
    start.option("path", scratch_path(spark, "bucketed")).saveAsTable(name)
    jsonl.jsonl_sink(I.corrections(spark, sf), path)
    dataset.apply_dataset(spark, DataSet("core", (DataFile("orders", name, "upsert", path, on=("o_orderkey",)),)))
    return spark.table(name)


@check(
    "apply_report",
    """SELECT 'orders' AS name, 'upsert' AS mode, count(*) AS rows FROM corrections
    UNION ALL SELECT 'events', 'insert', count(*) FROM pages UNION ALL SELECT 'names', 'replace', count(*) FROM part""",
)
def apply_report(spark: SparkSession, sf: str) -> DataFrame:
    data_set, _ = _data_set(spark, sf)
    return dataset.apply_dataset(spark, data_set).select("name", "mode", "rows")


@check(
    "export_dataset",
    """SELECT value FROM ord_json UNION ALL
    SELECT '{"name":"' || replace(p_name, '"', '\\"') || '","p_cents":' || CAST(round(p_retailprice * 100) AS BIGINT) || ',"p_partkey":' || p_partkey || '}' FROM part""",
)
def export_dataset(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "export")
    part = I.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), I.cents("p_retailprice").alias("p_cents"))
    files = (
        DataFile("orders", _stored(spark, I.orders(spark, sf), "orders"), "replace", f"{folder}/orders.jsonl", order_by=("o_custkey", "o_day")),
        DataFile("parts", _stored(spark, part, "parts"), "upsert", f"{folder}/parts.jsonl", on=("p_partkey",)),
    )
    dataset.export_dataset(spark, DataSet("core", files))
    return spark.read.text(files[0].path).unionByName(spark.read.text(files[1].path))


@check(
    "roundtrip_check",
    "SELECT 'orders' AS name, count(*) AS rows, 0 AS differing FROM orders UNION ALL SELECT 'events', count(*), 0 FROM events",
)
def roundtrip_check(spark: SparkSession, sf: str) -> DataFrame:
    """Export, apply to emptied tables, export again: the same lines and the same values."""
    folder = scratch_path(spark, "roundtrip")
    sources = {"orders": (I.orders(spark, sf), "o_orderkey"), "events": (_typed(spark, sf), "event_id")}
    result = None
    for name, (df, key) in sources.items():
        full = _stored(spark, df, name)
        empty = _stored(spark, mutate.apply_replace_empty(df), name)
        path = f"{folder}/{name}.jsonl"
        out = DataSet("core", (DataFile(name, full, "replace", path, order_by=(key,)),))
        back = DataSet("core", (DataFile(name, empty, "replace", path, order_by=(key,)),))
        again = DataSet("core", (DataFile(name, empty, "replace", f"{path}.again", order_by=(key,)),))
        dataset.export_dataset(spark, out)
        dataset.apply_dataset(spark, back)
        dataset.export_dataset(spark, again)
        first, second = spark.read.text(path), spark.read.text(f"{path}.again")
        lines = first.select(F.lit(1).alias("rows"), F.lit(0).alias("differing"))
        odd = compare.multiset_difference(first, second).select(F.lit(0).alias("rows"), F.lit(1).alias("differing"))
        kept, came = spark.table(full), spark.table(empty)
        values = [F.xxhash64(*[F.col(c) if not isinstance(f.dataType, T.MapType) else F.to_json(c) for c, f in zip(kept.columns, kept.schema)]).alias("v")]
        moved = compare.multiset_difference(kept.select(*values), came.select(*values))
        odd = odd.unionByName(moved.select(F.lit(0).alias("rows"), F.lit(1).alias("differing")))
        row = lines.unionByName(odd).agg(F.sum("rows").alias("rows"), F.sum("differing").alias("differing"))
        row = row.select(F.lit(name).alias("name"), "rows", "differing")
        result = row if result is None else result.unionByName(row)
    return result


# --------------------------------------------------------------- text scalars


@check("utf8_check", "SELECT doc_id, source <> 'src15' AS ok FROM documents")
def utf8_check(spark: SparkSession, sf: str) -> DataFrame:
    return I.corpus(spark, sf).select("doc_id", sections.utf8_check(F.col("payload")).alias("ok"))


@check("ensure_newline", "SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END AS text FROM documents")
def ensure_newline(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "documents").select("doc_id", digests.ensure_newline(F.col("text")).alias("text"))


@check("payload_digest", "SELECT page_id, sha256(html) AS digest FROM pages")
def payload_digest(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "pages").select("page_id", digests.payload_digest(F.col("html")).alias("digest"))


@check(
    "text_digest",
    "SELECT doc_id, CASE WHEN lang <> 'fr' THEN sha256(CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END) END AS digest FROM documents",
)
def text_digest(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("lang") != "fr", F.col("text"))
    return I.table(spark, sf, "documents").select("doc_id", digests.text_digest(text).alias("digest"))


@check("split_sections", "SELECT doc_id, up, down FROM sections")
def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    return sections.split_sections(I.corpus(spark, sf), "body").select("doc_id", "up", "down")


cte(
    "contents",
    """SELECT doc_id, up, down, regexp_matches(u, '\\S') AS up_runs, regexp_matches(d, '\\S') AS down_runs FROM (
      SELECT *, regexp_replace(regexp_replace(up, '/\\*[^*/]*\\*/', ''), '^(\\s|--[^\\n]*|/\\*([^*]|\\*+[^*/])*\\*+/)*', '') AS u,
        regexp_replace(regexp_replace(down, '/\\*[^*/]*\\*/', ''), '^(\\s|--[^\\n]*|/\\*([^*]|\\*+[^*/])*\\*+/)*', '') AS d FROM sections)""",
)


@check("section_has_content", "SELECT doc_id, up_runs, down_runs FROM contents")
def section_has_content(spark: SparkSession, sf: str) -> DataFrame:
    return sections.split_sections(I.corpus(spark, sf), "body").select(
        "doc_id", sections.section_has_content(F.col("up")).alias("up_runs"), sections.section_has_content(F.col("down")).alias("down_runs")
    )


@check(
    "excerpt",
    """SELECT doc_id, CASE WHEN length(t) > 120 THEN left(t, 117) || '...' ELSE t END AS excerpt
    FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')) AS t FROM documents)""",
)
def excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "documents").select("doc_id", sections.excerpt(F.col("text")).alias("excerpt"))
