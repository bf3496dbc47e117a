"""Operator inputs derived from the given tables, in Spark and in SQL.

Variants hang on attributes the tables have (status, priority, segment, event
type, source), so every input covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import packed, payload_digest, text_digest, unpacked
from ..operators import ledger
from ..operators.ordering import ordinal
from ..session import written
from .registry import cte

ENGINE = "spark"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(value: str) -> Column:
    return F.round(F.col(value) * 100).cast("bigint")


# ---------------------------------------------------------------- datasets


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        cents("o_totalprice").alias("o_cents"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"),
        "o_orderpriority",
    )


cte(
    "ord",
    """SELECT o_orderkey, o_custkey, o_orderstatus,
    CAST(round(o_totalprice * 100) AS BIGINT) AS o_cents,
    strftime(o_orderdate, '%Y-%m-%d') AS o_day, o_orderpriority FROM orders""",
)


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with a returned line, and one new order per customer."""
    returned = (
        table(spark, sf, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_partkey").alias("o_custkey"), F.count("*").alias("o_cents"))
        .select("o_orderkey", "o_custkey", F.lit("R").alias("o_orderstatus"), "o_cents")
    )
    return returned.unionByName(new_orders(spark, sf))


def new_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        (-1 - F.col("c_custkey")).alias("o_orderkey"),
        F.col("c_custkey").alias("o_custkey"),
        F.lit("N").alias("o_orderstatus"),
        cents("c_acctbal").alias("o_cents"),
    )


cte(
    "new_orders",
    """SELECT -1 - c_custkey AS o_orderkey, c_custkey AS o_custkey, 'N' AS o_orderstatus,
    CAST(round(c_acctbal * 100) AS BIGINT) AS o_cents FROM customer""",
)
cte(
    "corrections",
    """SELECT l_orderkey AS o_orderkey, min(l_partkey) AS o_custkey, 'R' AS o_orderstatus, count(*) AS o_cents
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
    UNION ALL SELECT * FROM new_orders""",
)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Replies rewritten, and a closing turn for every conversation."""
    talk = table(spark, sf, "conversations")
    rewritten = talk.where(F.col("role") == "assistant").select(
        "conv_id", "turn", "role", F.concat(F.lit("rewritten: "), F.col("text")).alias("text")
    )
    closing = talk.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select(
        "conv_id", "turn", F.lit("system").alias("role"), F.lit("closed").alias("text")
    )
    return rewritten.unionByName(closing)


cte(
    "turns",
    """SELECT conv_id, turn, role, 'rewritten: ' || text AS text FROM conversations
    WHERE role = 'assistant'
    UNION ALL SELECT conv_id, max(turn) + 1, 'system', 'closed' FROM conversations GROUP BY conv_id""",
)


# ------------------------------------------------------------ event entries


def event_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in every shape the path rules know: grp, pos, entry, payload."""
    kind, hour = F.col("event_type"), F.date_format("ts", "HH")
    day = F.date_format("ts", "yyyyMMdd")
    entry = (
        F.when(kind == "error", F.concat(F.lit("/migrations/"), day, F.lit("_"), hour, F.lit(".sql")))
        .when(kind == "view", F.concat(F.lit("./migrations//"), day, F.lit("_"), hour, F.lit(".sql")))
        .when(kind == "signup", F.concat(F.lit("migrations/../"), day, F.lit(".sql")))
        .when(
            kind == "click",
            F.concat(F.lit("migrations/"), day, F.lit("_"), hour, F.when(hour < "12", ".sql").otherwise(".txt")),
        )
        .otherwise(F.concat(F.when(hour < "12", "migrations/").otherwise("checkpoints/"), F.lit("_"), hour, F.lit(".sql")))
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("grp"), F.col("event_id").alias("pos"), entry.alias("entry"), F.col("props").alias("payload")
    )


cte(
    "event_paths",
    """SELECT user_id AS grp, event_id AS pos, props AS payload, CASE event_type
      WHEN 'error' THEN '/migrations/' || d || '_' || h || '.sql'
      WHEN 'view' THEN './migrations//' || d || '_' || h || '.sql'
      WHEN 'signup' THEN 'migrations/../' || d || '.sql'
      WHEN 'click' THEN 'migrations/' || d || '_' || h || CASE WHEN h < '12' THEN '.sql' ELSE '.txt' END
      ELSE CASE WHEN h < '12' THEN 'migrations/' ELSE 'checkpoints/' END || '_' || h || '.sql' END AS entry
    FROM (SELECT *, strftime(ts, '%Y%m%d') AS d, strftime(ts, '%H') AS h FROM events)""",
)
cte(
    "event_norm",
    """SELECT grp, pos, payload, entry, parts,
      CASE WHEN starts_with(entry, '/') THEN 'absolute' WHEN len(parts) = 0 THEN 'empty'
        WHEN list_contains(parts, '..') THEN 'dot_segment' END AS error,
      array_to_string(parts, '/') AS joined
    FROM (SELECT *, [x FOR x IN string_split(entry, '/') IF x <> '' AND x <> '.'] AS parts FROM event_paths)""",
)
cte(
    "event_judged",
    """SELECT grp, pos, payload, CASE WHEN error IS NULL THEN joined ELSE entry END AS path,
      CASE WHEN error IS NOT NULL THEN 'bad path: ' || error
        WHEN NOT starts_with(joined, 'migrations/') THEN 'not under migrations/'
        WHEN NOT ends_with(joined, '.sql') THEN 'does not end with .sql' END AS reason
    FROM event_norm""",
)


# ------------------------------------------------------- change-sets (events)


def event_changes(spark: SparkSession, sf: str) -> DataFrame:
    """One upsert per event: the user's latest value of each event type."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("grp"), "ts", "event_id", "event_type", cents("value").alias("amount"), "props"
    )
    placed = ordinal(rows, ["grp"], ["ts", "event_id"], "idx")
    return placed.select("grp", "idx", F.lit("upsert").alias("mode"), "event_type", "event_id", "amount", "props")


cte(
    "ev",
    """SELECT user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
    event_type, event_id, CAST(round(value * 100) AS BIGINT) AS amount, props, hour(ts) AS hr FROM events""",
)


def mixed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as replaces, inserts and upserts by type, keyed by hour of day."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("grp"), "ts", "event_id", "event_type", cents("value").alias("amount"),
        F.hour("ts").cast("bigint").alias("hr"),
    )
    mode = (
        F.when(F.col("event_type") == "signup", "replace")
        .when(F.col("event_type") == "view", "insert")
        .otherwise("upsert")
    )
    placed = ordinal(rows, ["grp"], ["ts", "event_id"], "idx")
    return placed.select("grp", "idx", mode.alias("mode"), "hr", "event_id", "amount")


cte(
    "mixed",
    """SELECT grp, idx, CASE event_type WHEN 'signup' THEN 'replace' WHEN 'view' THEN 'insert'
    ELSE 'upsert' END AS mode, hr, event_id, amount FROM ev""",
)
cte(
    "mixed_ranges",
    """SELECT m.grp, m.hr, m.event_id, m.amount, m.idx AS valid_from, least(
      (SELECT min(r.idx) FROM mixed r WHERE r.grp = m.grp AND r.idx > m.idx AND r.mode = 'replace'),
      (SELECT min(u.idx) FROM mixed u WHERE u.grp = m.grp AND u.idx > m.idx AND u.mode = 'upsert' AND u.hr = m.hr)
    ) AS valid_to FROM mixed m""",
)
cte(
    "ev_ranges",
    """SELECT *, idx AS valid_from, lead(idx) OVER (PARTITION BY grp, event_type ORDER BY idx) AS valid_to FROM ev""",
)


def event_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Applied count per user: its events before the middle of the month."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("grp"))
        .agg(F.count_if(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("applied_count"))
    )


cte(
    "ev_applied",
    "SELECT user_id AS grp, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS applied_count FROM events GROUP BY user_id",
)


# ------------------------------------------------------------ order ledgers


def _entry(prefix: str, suffix: str = ".sql") -> Column:
    return F.concat(
        F.lit(prefix), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"),
        F.lpad(F.col("o_orderkey").cast("string"), 14, "0"), F.lit(suffix),
    )


def _payload() -> Column:
    return F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority", cents("o_totalprice").cast("string"))


def _is(priority: str, status: str) -> Column:
    return (F.col("o_orderpriority") == priority) & (F.col("o_orderstatus") == status)


def input_entries(spark: SparkSession, sf: str, status: str | None = None) -> DataFrame:
    """Ledger input: the orders of a customer (of one status only), without open low-priority ones."""
    asked = F.lit(True) if status is None else F.col("o_orderstatus") == status
    return table(spark, sf, "orders").where(asked & ~_is("5-LOW", "O")).select(
        F.col("o_custkey").alias("grp"), _entry("migrations/").alias("entry"), _payload().alias("payload")
    )


def base_entries(spark: SparkSession, sf: str, *others: Column) -> DataFrame:
    """What the stored ledger saw: no pending urgent orders, other high-priority payloads."""
    return table(spark, sf, "orders").where(~_is("1-URGENT", "P")).select(
        F.col("o_custkey").alias("grp"),
        _entry("migrations/").alias("entry"),
        F.when(_is("2-HIGH", "F"), F.concat(F.lit("was "), _payload())).otherwise(_payload()).alias("payload"),
        *others,
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of the orders; pending ones have a draft that belongs to no step."""
    draft = F.col("o_orderstatus") == "P"
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("grp"),
        F.when(draft, _entry("checkpoints/", "_draft.sql")).otherwise(_entry("checkpoints/")).alias("entry"),
        F.concat(F.lit("state "), _payload()).alias("payload"),
    )


def heads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_mktsegment") != "HOUSEHOLD").select(
        F.col("c_custkey").alias("grp"), F.concat(F.lit("head "), F.col("c_name")).alias("payload")
    )


def input_steps(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.build_steps(
        input_entries(spark, sf), snapshots(spark, sf), stored_headers(spark, sf)
    )


def plain_input_steps(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.plain_steps(input_entries(spark, sf), snapshots(spark, sf))


def plain_base_steps(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.plain_steps(base_entries(spark, sf))


def _header_fields() -> list[Column]:
    segment = F.col("c_mktsegment")

    def unless(name: str, odd: str | int, usual: str | int) -> Column:
        return F.when(segment == name, odd).otherwise(usual)

    return [
        unless("AUTOMOBILE", 1, 0).alias("lock_version"),
        unless("MACHINERY", "md5", "sha2-256").alias("hash_algorithm"),
        unless("BUILDING", "none", "ledgerkeel-v0").alias("canonicalizer"),
        F.lit(ENGINE).alias("engine"),
        F.when(segment == "FURNITURE", F.concat(F.lit("x"), F.col("c_custkey").cast("string")))
        .otherwise(F.col("c_custkey").cast("string")).alias("target"),
        F.lit("schema.sql").alias("schema_file"),
        F.lit("migrations").alias("migrations_dir"),
        unless("HOUSEHOLD", "states", "checkpoints").alias("checkpoints_dir"),
    ]


def stored_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Header fields that name the chain seed, per customer."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("grp"), *_header_fields())


def locked_steps(spark: SparkSession, sf: str, groups: DataFrame | None = None) -> DataFrame:
    """Stored steps with their chain, under each header's seed, and the columns of ``groups`` (keyed by grp).

    What belongs to an order goes along with its entry, so that the steps are not joined with the orders again.
    """
    older = F.when(_is("3-MEDIUM", "O"), "old state ")
    facts = {
        "_snapshot": older.otherwise("state "),
        "_schema": older.when(_is("4-NOT SPECIFIED", "O"), "other state ").otherwise("state "),
    }
    digests = [packed(text_digest(F.concat(words, _payload()))).alias(name) for name, words in facts.items()]
    entries = base_entries(spark, sf, *digests, F.col("o_orderstatus").alias("_status"))
    own = () if groups is None else ("_status", *[c for c in groups.columns if c != "grp"])
    if groups is not None:
        entries = entries.join(groups, "grp")
    steps = ledger.build_steps(entries, None, stored_headers(spark, sf), carry=(*facts, *own))
    return steps.select(
        "grp", F.col("idx").alias("pos"), "idx", "version", "entry", "payload_digest",
        "snapshot_entry", unpacked(F.col("_snapshot")).alias("snapshot_digest"),
        unpacked(F.col("_schema")).alias("schema_digest"), "chain_hash", *own,
    )


def full_headers(spark: SparkSession, sf: str, locked: DataFrame) -> DataFrame:
    """Stored headers with head index, head chain and head digest."""
    tops = locked.groupBy("grp").agg(
        F.count("*").alias("head_index"), F.max_by("chain_hash", "idx").alias("head_chain_hash")
    )
    digest = F.when(
        F.col("c_nationkey") == 0, text_digest(F.concat(F.lit("older head "), F.col("c_name")))
    ).otherwise(text_digest(F.concat(F.lit("head "), F.col("c_name"))))
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("grp"), *_header_fields(), digest.alias("head_schema_digest")
    )
    return base.join(tops, "grp", "left").select(
        *base.columns,
        F.coalesce("head_index", F.lit(0)).alias("head_index"),
        F.coalesce("head_chain_hash", ledger.seed_of(F.col("engine"), F.col("target"))).alias("head_chain_hash"),
    )


cte(
    "ord_entries",
    """SELECT o_custkey AS grp, o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, o_day,
      replace(o_day, '-', '') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS stem,
      o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority || '|' || o_cents AS payload FROM ord""",
)
cte(
    "snaps",
    """SELECT grp, 'checkpoints/' || stem || CASE WHEN st = 'P' THEN '_draft.sql' ELSE '.sql' END AS entry,
    'state ' || payload AS payload FROM ord_entries""",
)
cte(
    "heads",
    "SELECT c_custkey AS grp, 'head ' || c_name AS payload FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'",
)
cte(
    "plain_in",
    """SELECT e.*, row_number() OVER (PARTITION BY grp ORDER BY entry) AS idx, sha256(payload) AS payload_digest,
      replace(o_day, '-', '') AS version, 'checkpoints/' || stem || '.sql' AS snapshot_entry,
      CASE WHEN st <> 'P' THEN sha256('state ' || payload || chr(10)) END AS snapshot_digest
    FROM (SELECT *, 'migrations/' || stem || '.sql' AS entry FROM ord_entries WHERE NOT (pr = '5-LOW' AND st = 'O')) e""",
)
cte(
    "plain_base",
    """SELECT e.* EXCLUDE (payload), body AS payload, row_number() OVER (PARTITION BY grp ORDER BY entry) AS idx, sha256(body) AS payload_digest,
      replace(o_day, '-', '') AS version, 'checkpoints/' || stem || '.sql' AS snapshot_entry,
      sha256(CASE WHEN pr = '3-MEDIUM' AND st = 'O' THEN 'old state ' ELSE 'state ' END || payload || chr(10)) AS snapshot_digest,
      sha256(CASE WHEN pr = '3-MEDIUM' AND st = 'O' THEN 'old state ' WHEN pr = '4-NOT SPECIFIED' AND st = 'O' THEN 'other state '
        ELSE 'state ' END || payload || chr(10)) AS schema_digest
    FROM (SELECT *, 'migrations/' || stem || '.sql' AS entry,
        CASE WHEN pr = '2-HIGH' AND st = 'F' THEN 'was ' ELSE '' END || payload AS body
      FROM ord_entries WHERE NOT (pr = '1-URGENT' AND st = 'P')) e""",
)
cte(
    "hdr",
    """SELECT c_custkey AS grp, c_name, c_nationkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS lock_version,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'md5' ELSE 'sha2-256' END AS hash_algorithm,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'none' ELSE 'ledgerkeel-v0' END AS canonicalizer, 'spark' AS engine,
      CASE WHEN c_mktsegment = 'FURNITURE' THEN 'x' ELSE '' END || c_custkey AS target,
      'schema.sql' AS schema_file, 'migrations' AS migrations_dir,
      CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'states' ELSE 'checkpoints' END AS checkpoints_dir FROM customer""",
)
cte(
    "seeds",
    """SELECT grp, sha256('["ledgerkeel-chain-v0","' || engine || '","' || target || '"]') AS seed FROM hdr""",
)
for _name, _steps in (("chain_in", "plain_in"), ("chain_base", "plain_base")):
    cte(
        _name,
        f"""SELECT grp, CAST(0 AS BIGINT), seed FROM seeds UNION ALL
        SELECT s.grp, s.idx, sha256('["' || c.h || '","' || s.version || '","' || s.entry || '","' || s.payload_digest || '"]')
        FROM {_name} c JOIN {_steps} s ON s.grp = c.grp AND s.idx = c.idx + 1""",
    )
cte("steps_in", "SELECT p.*, c.h AS chain_hash FROM plain_in p JOIN chain_in c ON c.grp = p.grp AND c.idx = p.idx")
cte("locked", "SELECT p.*, c.h AS chain_hash FROM plain_base p JOIN chain_base c ON c.grp = p.grp AND c.idx = p.idx")
cte(
    "full_hdr",
    """SELECT h.*, coalesce(t.n, 0) AS head_index, coalesce(t.h, s.seed) AS head_chain_hash,
      sha256(CASE WHEN c_nationkey = 0 THEN 'older head ' ELSE 'head ' END || c_name || chr(10)) AS head_schema_digest
    FROM hdr h JOIN seeds s USING (grp)
    LEFT JOIN (SELECT grp, count(*) AS n, max_by(chain_hash, idx) AS h FROM locked GROUP BY grp) t USING (grp)""",
)


def dirty_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a stored ledger, a written table, full of repeats and bad paths."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("grp"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_returnflag", "l_linestatus",
    )
    placed = ordinal(rows, ["grp"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "pos")
    number = F.lpad(F.col("l_linenumber").cast("string"), 3, "0")
    folder = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "migrations/./").otherwise("migrations/")
    snap = (
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "/checkpoints/")
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "states/")
        .otherwise("checkpoints/")
    )
    tail = F.concat(number, F.lit("_"), F.col("l_returnflag"), F.lit(".sql"))
    stored = placed.select(
        "grp", "pos", F.col("l_linenumber").cast("bigint").alias("idx"), number.alias("version"),
        F.concat(folder, tail).alias("entry"),
        payload_digest(F.col("l_partkey").cast("string")).alias("payload_digest"),
        F.concat(snap, tail).alias("snapshot_entry"),
    )
    return written(stored, "dirty")


cte(
    "dirty",
    """SELECT grp, pos, idx, 'migrations/' || CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN './' ELSE '' END || tail AS entry,
      'migrations/' || tail AS clean_entry,
      CASE WHEN l_returnflag <> 'N' THEN 'checkpoints/' WHEN l_linestatus = 'F' THEN '/checkpoints/' ELSE 'states/' END || tail AS snapshot_entry
    FROM (SELECT *, lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '_' || l_returnflag || '.sql' AS tail,
      l_orderkey AS grp, CAST(l_linenumber AS BIGINT) AS idx,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS pos FROM lineitem)""",
)
cte(
    "dirty_flags",
    """SELECT *, pos > min(pos) OVER (PARTITION BY grp, clean_entry) AS entry_again, pos > min(pos) OVER (PARTITION BY grp, idx) AS idx_again
    FROM dirty WHERE starts_with(snapshot_entry, 'checkpoints/')""",
)


# --------------------------------------------------------------- applied log


def applied(spark: SparkSession, sf: str) -> DataFrame:
    """Applied entries per customer: orders before 1998, all for machinery.

    The listing style hangs on the segment: full paths, base names, backslashes
    or a mixture; automobile customers miss their urgent orders.
    """
    people = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    segment = F.col("c_mktsegment")
    full = _entry("migrations/")
    base = F.element_at(F.split(full, "/"), -1)
    style = (
        F.when(segment == "HOUSEHOLD", base)
        .when(segment == "BUILDING", F.translate(full, "/", "\\"))
        .when((segment == "FURNITURE") & (F.col("o_orderstatus") == "F"), base)
        .otherwise(full)
    )
    seen = (segment == "MACHINERY") | (F.date_format("o_orderdate", "yyyy") < "1998")
    skipped = (segment == "AUTOMOBILE") & (F.col("o_orderpriority") == "1-URGENT")
    rows = (
        table(spark, sf, "orders")
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .where(seen & ~skipped)
        .select(F.col("o_custkey").alias("grp"), full.alias("_full"), style.alias("entry"), _payload().alias("payload"))
    )
    return ordinal(rows, ["grp"], ["_full"], "pos").select("grp", "pos", "entry", "_full", "payload")


cte(
    "applied_log",
    """SELECT grp, payload, full_entry, row_number() OVER (PARTITION BY grp ORDER BY full_entry) AS pos,
      CASE WHEN seg = 'HOUSEHOLD' OR (seg = 'FURNITURE' AND st = 'F') THEN stem || '.sql'
        WHEN seg = 'BUILDING' THEN 'migrations\\' || stem || '.sql' ELSE full_entry END AS entry
    FROM (SELECT e.*, c_mktsegment AS seg, 'migrations/' || stem || '.sql' AS full_entry
      FROM ord_entries e JOIN customer c ON c.c_custkey = e.grp
      WHERE (c_mktsegment = 'MACHINERY' OR o_day < '1998') AND NOT (c_mktsegment = 'AUTOMOBILE' AND pr = '1-URGENT'))""",
)
cte(
    "relation",
    """SELECT grp, CAST(sum(h) AS BIGINT) AS head_count, CAST(sum(a) AS BIGINT) AS applied_count,
      CASE WHEN sum(a) < sum(h) THEN 'behind' WHEN sum(a) > sum(h) THEN 'ahead' ELSE 'equal' END AS relation
    FROM (SELECT grp, 1 AS h, 0 AS a FROM plain_in UNION ALL SELECT grp, 0, 1 FROM applied_log) GROUP BY grp""",
)


# ------------------------------------------------------------ sectioned texts


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sectioned texts; the marker layout hangs on the source."""
    text, source = F.col("text"), F.col("source")
    up, down = F.lit("-- migrate:up\n"), F.lit("\n-- migrate:down\n")
    body = (
        F.when(source.isin("src0", "src1", "src2", "src3", "src4"), F.concat(up, text, down, F.lit("drop "), F.col("lang")))
        .when(source.isin("src5", "src6"), F.concat(up, text))
        .when(source == "src7", F.concat(F.lit("-- migrate:down\n"), text, F.lit("\n"), up))
        .when(source == "src8", F.concat(up, up, text))
        .when(source == "src9", F.concat(up, text, down, up, text))
        .when(source == "src10", F.concat(up, text, down, text, down))
        .when(source == "src11", F.concat(F.lit("-- migrate:up transaction:false\n"), text, down, F.lit("-- nothing to do\n")))
        .when(source == "src12", F.concat(up, F.lit("/* "), text, F.lit(" */"), down, F.lit("/* a /* b */ c */ x")))
        .when(source == "src13", F.concat(up, text, down, F.lit("  \n\n")))
        .when(source == "src14", F.concat(F.lit("  --  MIGRATE:UP now\n"), text, F.lit("\n--migrate:down;\ndone")))
        .otherwise(text)
    )
    entry = F.concat(
        F.lit("migrations/"), source, F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/"),
        F.lpad(F.col("n_chars").cast("string"), 6, "0"), F.lit("_"), F.col("lang"), F.lit(".sql"),
    )
    payload = F.when(source == "src15", F.concat(text.cast("binary"), F.unhex(F.lit("FF")))).otherwise(body.cast("binary"))
    return table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("grp"), entry.alias("entry"), body.alias("body"), payload.alias("payload")
    )


cte(
    "corpus",
    """SELECT doc_id, lang AS grp, source, source = 'src15' AS broken,
      'migrations/' || source || '/d' || doc_id || '/' || lpad(CAST(n_chars AS VARCHAR), 6, '0') || '_' || lang || '.sql' AS entry,
      lpad(CAST(n_chars AS VARCHAR), 6, '0') AS version, lpad(CAST(n_chars AS VARCHAR), 6, '0') || '_' || lang || '.sql' AS base,
      CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN up || text || down || 'drop ' || lang
        WHEN source IN ('src5', 'src6') THEN up || text
        WHEN source = 'src7' THEN '-- migrate:down' || nl || text || nl || up
        WHEN source = 'src8' THEN up || up || text
        WHEN source = 'src9' THEN up || text || down || up || text
        WHEN source = 'src10' THEN up || text || down || text || down
        WHEN source = 'src11' THEN '-- migrate:up transaction:false' || nl || text || down || '-- nothing to do' || nl
        WHEN source = 'src12' THEN up || '/* ' || text || ' */' || down || '/* a /* b */ c */ x'
        WHEN source = 'src13' THEN up || text || down || '  ' || nl || nl
        WHEN source = 'src14' THEN '  --  MIGRATE:UP now' || nl || text || nl || '--migrate:down;' || nl || 'done'
        ELSE text END AS body
    FROM (SELECT *, chr(10) AS nl, '-- migrate:up' || chr(10) AS up, chr(10) || '-- migrate:down' || chr(10) AS down FROM documents)""",
)
cte(
    "corpus_lines",
    """SELECT doc_id, i, n, line, lower(regexp_extract(line, '^\\s*--\\s*((?i)migrate:(up|down))\\b.*$', 2)) AS kind,
      contains(lower(line), 'transaction:false') AS flag
    FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i,
      len(string_split(body, chr(10))) AS n FROM corpus)""",
)
cte(
    "corpus_placed",
    """SELECT *, coalesce(last_value(CASE WHEN kind <> '' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 'up') AS part FROM corpus_lines""",
)
cte(
    "sections",
    """SELECT doc_id,
      coalesce(string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) FILTER (WHERE kind = '' AND part = 'up'), '') AS up,
      coalesce(string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) FILTER (WHERE kind = '' AND part = 'down'), '') AS down
    FROM corpus_placed GROUP BY doc_id""",
)
cte(
    "markers",
    "SELECT doc_id, list(kind ORDER BY i) FILTER (WHERE kind <> '') AS kinds, coalesce(bool_or(flag) FILTER (WHERE kind <> ''), false) AS flagged FROM corpus_lines GROUP BY doc_id",
)
