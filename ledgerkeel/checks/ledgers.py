"""Checks of entry scalars, ledgers and their coherence findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entries as E
from ..operators import coherence, ledger, publish
from ..operators.ordering import largest_group, ordinal
from ..session import written
from ..sources import ledgers, status
from . import inputs as I
from .registry import check, cte

# ------------------------------------------------------------------ entry scalars

cte("event_base", "SELECT *, coalesce(parts[len(parts)], '') AS base FROM event_norm")


@check(
    "version_of",
    """SELECT pos, CASE WHEN string_split(stem, '_')[1] <> '' THEN string_split(stem, '_')[1] ELSE stem END AS version
    FROM (SELECT pos, CASE WHEN ends_with(base, '.sql') THEN left(base, length(base) - 4) ELSE base END AS stem FROM event_base)""",
)
def version_of(spark: SparkSession, sf: str) -> DataFrame:
    return I.event_paths(spark, sf).select("pos", E.version_of(F.col("entry")).alias("version"))


@check(
    "companion_entry",
    "SELECT pos, CASE WHEN starts_with(entry, 'migrations/') THEN 'checkpoints/' || substr(entry, 12) ELSE entry END AS companion FROM event_paths",
)
def companion_entry(spark: SparkSession, sf: str) -> DataFrame:
    return I.event_paths(spark, sf).select("pos", E.companion_entry(F.col("entry")).alias("companion"))


@check("normalize_entry", "SELECT pos, CASE WHEN error IS NULL THEN joined END AS value, error FROM event_norm")
def normalize_entry(spark: SparkSession, sf: str) -> DataFrame:
    parsed = I.event_paths(spark, sf).select("pos", E.normalize_entry(F.col("entry")).alias("n"))
    return parsed.select("pos", "n.value", "n.error")


cte(
    "event_kept",
    "SELECT grp, path AS entry, arg_min(payload, pos) AS payload, min(pos) AS first FROM event_judged WHERE reason IS NULL GROUP BY grp, path",
)


@check("filter_entries", "SELECT grp, entry, payload FROM event_kept")
def filter_entries(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.filter_entries(I.event_paths(spark, sf), position="pos")[0]


@check(
    "filter_entries_findings",
    """SELECT grp, 'input-path-invalid' AS code, path, reason AS detail FROM event_judged WHERE reason IS NOT NULL
    UNION ALL SELECT j.grp, 'input-path-duplicate', j.path, 'repeats the path of an earlier entry'
    FROM event_judged j JOIN event_kept k ON k.grp = j.grp AND k.entry = j.path WHERE reason IS NULL AND j.pos > k.first""",
)
def filter_entries_findings(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.filter_entries(I.event_paths(spark, sf), position="pos")[1]


@check(
    "duplicate_entries",
    "SELECT j.grp, j.path FROM event_judged j JOIN event_kept k ON k.grp = j.grp AND k.entry = j.path WHERE reason IS NULL AND j.pos > k.first",
)
def duplicate_entries(spark: SparkSession, sf: str) -> DataFrame:
    found = ledger.filter_entries(I.event_paths(spark, sf), position="pos")[1]
    return found.where(F.col("code") == "input-path-duplicate").select("grp", "path")


@check("status_basename", "SELECT grp, pos, string_split(replace(entry, '\\', '/'), '/')[-1] AS base FROM applied_log")
def status_basename(spark: SparkSession, sf: str) -> DataFrame:
    return I.applied(spark, sf).select("grp", "pos", E.status_basename(F.col("entry")).alias("base"))


@check("status_path", "SELECT grp, pos, replace(entry, '\\', '/') AS path FROM applied_log")
def status_path(spark: SparkSession, sf: str) -> DataFrame:
    return I.applied(spark, sf).select("grp", "pos", E.status_path(F.col("entry")).alias("path"))


cte(
    "styles",
    """SELECT grp, CASE WHEN NOT bool_or(p) THEN 'basename' WHEN bool_and(p) THEN 'path' ELSE 'mixed' END AS style
    FROM (SELECT grp, contains(entry, '/') OR contains(entry, '\\') AS p FROM applied_log) GROUP BY grp""",
)


@check("path_style", "SELECT grp, style FROM styles")
def path_style(spark: SparkSession, sf: str) -> DataFrame:
    return I.applied(spark, sf).groupBy("grp").agg(E.path_style(F.col("entry")).alias("style"))


# --------------------------------------------------------------------- applied log


def status_lines(spark: SparkSession, sf: str) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    name = F.concat(F.lit("migrations/"), F.col("event_id").cast("string"), F.lit("_"), kind, F.lit(".sql"))
    line = (
        F.when(kind == "view", F.concat(F.lit("[ ] "), name))
        .when((kind == "signup") & (F.col("value") < 5), F.concat(F.lit("Applied: "), k))
        .when((kind == "signup") & (F.col("value") < 6), F.lit("applied: none"))
        .when(kind == "signup", F.lit(""))
        .otherwise(F.concat(F.lit("  [X]  "), name, F.lit("  ")))
    )
    return I.table(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("line_no"), line.alias("line"))


@check(
    "applied_scan",
    """SELECT user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos,
    'migrations/' || event_id || '_' || event_type || '.sql' AS entry FROM events WHERE event_type NOT IN ('view', 'signup')""",
)
def applied_scan(spark: SparkSession, sf: str) -> DataFrame:
    return status.applied_scan(status_lines(spark, sf))


@check(
    "applied_scan_counts",
    """SELECT grp, listed, coalesce(declared, -1) AS declared, CASE WHEN bad > 0 THEN 'unreadable' WHEN declared <> listed THEN 'mismatch' ELSE 'ok' END AS status FROM (
      SELECT user_id AS grp, count(*) FILTER (WHERE event_type NOT IN ('view', 'signup')) AS listed,
        arg_max(CASE WHEN value < 5 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END, event_id) FILTER (WHERE event_type = 'signup' AND value < 5) AS declared0,
        max(event_id) FILTER (WHERE event_type = 'signup' AND value < 5) AS d_at, max(event_id) FILTER (WHERE event_type = 'signup' AND value >= 5 AND value < 6) AS b_at,
        count(*) FILTER (WHERE event_type = 'signup' AND value >= 5 AND value < 6) AS bad,
        CASE WHEN b_at IS NULL OR d_at > b_at THEN declared0 END AS declared
      FROM events GROUP BY user_id)""",
)
def applied_scan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return status.status_check(status_lines(spark, sf)).fillna(-1, ["declared"])


# -------------------------------------------------------------------------- ledger

STEP = "grp, idx, version, entry, payload_digest, snapshot_entry, snapshot_digest"


@check("build_steps", f"SELECT {STEP}, chain_hash FROM steps_in")
def build_steps(spark: SparkSession, sf: str) -> DataFrame:
    return I.input_steps(spark, sf)


cte(
    "chain_ev",
    """SELECT DISTINCT grp, CAST(0 AS BIGINT), sha256('["ledgerkeel-chain-v0","","' || grp || '"]') FROM ev UNION ALL
    SELECT e.grp, e.idx, sha256('["' || c.h || '","' || e.event_type || '","' || e.event_id || '","' || sha256(e.props) || '"]')
    FROM chain_ev c JOIN ev e ON e.grp = c.grp AND e.idx = c.idx + 1""",
)


@check("chain_hash", "SELECT grp, idx, h AS chain_hash FROM chain_ev WHERE idx > 0")
def chain_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A chain over every user's events."""
    steps = I.event_changes(spark, sf).select(
        "grp", "idx", F.col("event_type").alias("version"), F.col("event_id").cast("string").alias("entry"),
        F.sha2("props", 256).alias("payload_digest"), F.lit("").alias("engine"), F.col("grp").cast("string").alias("target"),
    )
    return ledger.chain_hash(steps).select("grp", "idx", "chain_hash")


cte(
    "base_heads",
    """SELECT c_custkey AS grp, sha256('head ' || c_name || chr(10)) AS head_schema_digest FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'""",
)
cte(
    "own_seed",
    """SELECT c_custkey AS grp, sha256('["ledgerkeel-chain-v0","spark","' || c_custkey || '"]') AS seed FROM customer""",
)
HEADER = """'sha2-256' AS hash_algorithm, 'spark' AS engine, CAST(grp AS VARCHAR) AS target"""
cte(
    "chain_own",
    """SELECT grp, CAST(0 AS BIGINT), seed FROM own_seed UNION ALL
    SELECT s.grp, s.idx, sha256('["' || c.h || '","' || s.version || '","' || s.entry || '","' || s.payload_digest || '"]')
    FROM chain_own c JOIN plain_in s ON s.grp = c.grp AND s.idx = c.idx + 1""",
)


def _own_steps(spark: SparkSession, sf: str) -> DataFrame:
    people = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("grp"), F.lit(I.ENGINE).alias("engine"), F.col("c_custkey").cast("string").alias("target")
    )
    return ledger.build_steps(I.input_entries(spark, sf), None, people)


@check(
    "build_ledger",
    f"""SELECT h.grp, {HEADER}, coalesce(t.n, 0) AS head_index, coalesce(t.h, s.seed) AS head_chain_hash, head_schema_digest
    FROM base_heads h JOIN own_seed s USING (grp) LEFT JOIN (SELECT grp, max(idx) AS n, max_by(h, idx) AS h FROM chain_own WHERE idx > 0 GROUP BY grp) t USING (grp)""".replace(
        "CAST(grp", "CAST(h.grp"
    ),
)
def build_ledger(spark: SparkSession, sf: str) -> DataFrame:
    _, headers = ledger.build_ledger(_own_steps(spark, sf), I.heads(spark, sf), I.ENGINE)
    return headers.select("grp", "hash_algorithm", "engine", "target", "head_index", "head_chain_hash", "head_schema_digest")


@check(
    "build_ledger_steps",
    """SELECT p.grp, p.idx, version, entry, payload_digest, snapshot_entry, sha256('state ' || payload || chr(10)) AS snapshot_digest,
      sha256('state ' || payload || chr(10)) AS schema_digest, c.h AS chain_hash
    FROM plain_in p JOIN chain_own c ON c.grp = p.grp AND c.idx = p.idx""",
)
def build_ledger_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Stored steps when every step has its snapshot."""
    entries = I.input_entries(spark, sf)
    snaps = entries.select(
        "grp", E.companion_entry(F.col("entry")).alias("entry"), F.concat(F.lit("state "), "payload").alias("payload")
    )
    people = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("grp"), F.lit(I.ENGINE).alias("engine"), F.col("c_custkey").cast("string").alias("target")
    )
    steps = ledger.build_steps(entries, snaps, people)
    locked, _ = ledger.build_ledger(steps, I.heads(spark, sf), I.ENGINE)
    return locked


@check(
    "zero_ledger",
    f"""SELECT grp, {HEADER}, 0 AS head_index, sha256('["ledgerkeel-chain-v0","spark","' || grp || '"]') AS head_chain_hash, sha256(chr(10)) AS head_schema_digest
    FROM (SELECT o_orderkey AS grp FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""",
)
def zero_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as groups, line items as their steps: orders without any."""
    groups = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("grp"))
    lines = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"))
    headers = ledger.zero_ledger(groups, lines, I.ENGINE)
    return headers.select("grp", "hash_algorithm", "engine", "target", "head_index", "head_chain_hash", "head_schema_digest")


# ------------------------------------------------------------------------ findings

cte(
    "f_header",
    "\nUNION ALL ".join(
        f"SELECT grp, '{code}' AS code, 'schema.lock.toml' AS path, '{name} is ' || {name} || ', expected {want}' AS detail FROM hdr WHERE CAST({name} AS VARCHAR) <> '{want}'"
        for name, want, code in (
            ("lock_version", "0", "lockfile-version-mismatch"),
            ("hash_algorithm", "sha2-256", "lockfile-hash-algorithm-mismatch"),
            ("canonicalizer", "ledgerkeel-v0", "lockfile-canonicalizer-mismatch"),
            ("schema_file", "schema.sql", "lockfile-schema-path-mismatch"),
            ("migrations_dir", "migrations", "lockfile-migrations-path-mismatch"),
            ("checkpoints_dir", "checkpoints", "lockfile-checkpoints-path-mismatch"),
        )
    ),
)
cte(
    "f_group",
    """SELECT grp, 'coherence-target-mismatch' AS code, 'schema.lock.toml' AS path, 'ledger target is ' || target AS detail FROM hdr WHERE target <> CAST(grp AS VARCHAR)""",
)
cte(
    "f_head_digest",
    """SELECT f.grp, CASE WHEN h.payload IS NULL THEN 'input-schema-missing' ELSE 'coherence-schema-digest-mismatch' END AS code, 'schema.sql' AS path,
      CASE WHEN h.payload IS NULL THEN 'head snapshot is missing' ELSE 'head snapshot differs from the header digest' END AS detail
    FROM full_hdr f LEFT JOIN heads h USING (grp) WHERE h.payload IS NULL OR sha256(h.payload || chr(10)) <> f.head_schema_digest""",
)
cte(
    "f_orphan",
    """SELECT grp, 'input-orphan-checkpoint' AS code, entry AS path, 'snapshot belongs to no entry' AS detail FROM snaps s
    WHERE NOT EXISTS (SELECT 1 FROM plain_in p WHERE p.grp = s.grp AND p.snapshot_entry = s.entry)""",
)
cte(
    "f_new",
    """SELECT grp, 'coherence-new-in-input' AS code, entry AS path, 'entry is not in the ledger' AS detail FROM plain_in i
    WHERE NOT EXISTS (SELECT 1 FROM plain_base b WHERE b.grp = i.grp AND b.entry = i.entry)""",
)
cte(
    "f_missing",
    """SELECT grp, 'coherence-missing-from-input' AS code, entry AS path, 'ledger entry is not in the input' AS detail FROM plain_base b
    WHERE NOT EXISTS (SELECT 1 FROM plain_in i WHERE b.grp = i.grp AND b.entry = i.entry)""",
)
cte(
    "matched",
    """SELECT s.grp, s.entry, s.snapshot_entry, s.idx AS i1, l.idx AS i2, s.payload_digest AS p1, l.payload_digest AS p2,
    s.snapshot_digest AS s1, l.snapshot_digest AS s2, l.schema_digest AS s3, s.chain_hash AS c1, l.chain_hash AS c2
    FROM steps_in s JOIN locked l ON l.grp = s.grp AND l.entry = s.entry""",
)
cte(
    "f_compare",
    "\nUNION ALL ".join(
        f"SELECT grp, '{code}' AS code, {path} AS path, '{detail}' AS detail FROM matched WHERE {cond}"
        for cond, code, path, detail in (
            ("i1 <> i2", "coherence-step-index-mismatch", "entry", "position differs"),
            ("p1 <> p2", "coherence-migration-digest-mismatch", "entry", "payload differs"),
            ("s1 IS NULL", "coherence-checkpoint-missing", "snapshot_entry", "snapshot is missing"),
            ("s1 <> s2", "coherence-checkpoint-mismatch", "snapshot_entry", "snapshot differs"),
            ("s1 <> s3", "coherence-step-schema-mismatch", "snapshot_entry", "stored schema digest differs from the snapshot"),
            ("c1 <> c2", "coherence-chain-hash-mismatch", "entry", "chain differs"),
        )
    ),
)
cte(
    "f_head",
    """SELECT f.grp, u.code, 'schema.lock.toml' AS path, u.detail FROM full_hdr f JOIN seeds s USING (grp)
    LEFT JOIN (SELECT grp, count(*) AS n FROM locked GROUP BY grp) l USING (grp)
    LEFT JOIN (SELECT grp, count(*) AS n, max_by(chain_hash, idx) AS h FROM steps_in GROUP BY grp) i USING (grp),
    LATERAL (SELECT 'coherence-head-index-mismatch' AS code, 'head_index ' || f.head_index || ', ledger steps ' || coalesce(l.n, 0) AS detail WHERE f.head_index <> coalesce(l.n, 0)
      UNION ALL SELECT 'coherence-head-index-mismatch', 'head_index ' || f.head_index || ', input entries ' || coalesce(i.n, 0) WHERE f.head_index <> coalesce(i.n, 0)
      UNION ALL SELECT 'coherence-head-chain-mismatch', 'head chain differs from the recomputed one' WHERE f.head_chain_hash <> coalesce(i.h, s.seed)) u""",
)


@check("check_header", "SELECT * FROM f_header")
def check_header(spark: SparkSession, sf: str) -> DataFrame:
    return coherence.check_header(I.stored_headers(spark, sf))


@check("check_group", "SELECT * FROM f_group")
def check_group(spark: SparkSession, sf: str) -> DataFrame:
    return coherence.check_group(I.stored_headers(spark, sf))


@check("check_head_digest", "SELECT * FROM f_head_digest")
def check_head_digest(spark: SparkSession, sf: str) -> DataFrame:
    headers = I.full_headers(spark, sf, I.locked_steps(spark, sf))
    return coherence.check_head_digest(headers, I.heads(spark, sf))


@check("orphan_snapshots", "SELECT * FROM f_orphan")
def orphan_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return coherence.orphan_snapshots(I.plain_input_steps(spark, sf), I.snapshots(spark, sf))


@check("new_in_input", "SELECT * FROM f_new")
def new_in_input(spark: SparkSession, sf: str) -> DataFrame:
    return coherence.new_in_input(I.plain_input_steps(spark, sf), I.plain_base_steps(spark, sf))


@check("missing_from_input", "SELECT * FROM f_missing")
def missing_from_input(spark: SparkSession, sf: str) -> DataFrame:
    return coherence.missing_from_input(I.plain_input_steps(spark, sf), I.plain_base_steps(spark, sf))


@check("compare_steps", "SELECT * FROM f_compare")
def compare_steps(spark: SparkSession, sf: str) -> DataFrame:
    return coherence.compare_steps(I.input_steps(spark, sf), I.locked_steps(spark, sf))


@check("check_head", "SELECT * FROM f_head")
def check_head(spark: SparkSession, sf: str) -> DataFrame:
    locked = written(I.locked_steps(spark, sf), "locked")
    return coherence.check_head(I.full_headers(spark, sf, locked), locked, I.input_steps(spark, sf))


@check(
    "check_sequential",
    """SELECT grp, 'lockfile-step-index-invalid' AS code, clean_entry AS path, 'index ' || idx || ' at place ' || place AS detail FROM (
      SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos) AS place FROM dirty_flags WHERE NOT entry_again AND NOT idx_again) WHERE idx <> place""",
)
def check_sequential(spark: SparkSession, sf: str) -> DataFrame:
    dirty = I.dirty_ledger(spark, sf)
    largest = largest_group(dirty, ["grp"])
    usable, _ = coherence.ledger_scan(dirty, largest=largest)
    return coherence.check_sequential(usable, largest=largest)


@check(
    "check_ledger_paths",
    """SELECT grp, 'lockfile-step-path-invalid' AS code, snapshot_entry AS path, 'bad path: absolute' AS detail FROM dirty WHERE starts_with(snapshot_entry, '/')
    UNION ALL SELECT grp, 'lockfile-step-path-mismatch', snapshot_entry, 'not under ' || CASE WHEN o_orderstatus = 'O' THEN 'states/' ELSE 'checkpoints/' END
    FROM dirty JOIN orders ON o_orderkey = grp
    WHERE NOT starts_with(snapshot_entry, '/') AND NOT starts_with(snapshot_entry, CASE WHEN o_orderstatus = 'O' THEN 'states/' ELSE 'checkpoints/' END)""",
)
def check_ledger_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of open orders name another snapshot folder than the policy."""
    headers = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("grp"),
        F.lit("migrations").alias("migrations_dir"),
        F.when(F.col("o_orderstatus") == "O", "states").otherwise("checkpoints").alias("checkpoints_dir"),
    )
    return coherence.check_ledger_paths(I.dirty_ledger(spark, sf), headers=headers)[1]


@check(
    "duplicate_ledger_steps",
    """SELECT grp, 'lockfile-duplicate-migration' AS code, clean_entry AS path, 'entry is repeated' AS detail FROM dirty_flags WHERE entry_again
    UNION ALL SELECT grp, 'lockfile-duplicate-step-index', clean_entry, 'index ' || idx || ' is repeated' FROM dirty_flags WHERE idx_again""",
)
def duplicate_ledger_steps(spark: SparkSession, sf: str) -> DataFrame:
    inside, _ = coherence.check_ledger_paths(I.dirty_ledger(spark, sf))
    return coherence.duplicate_ledger_steps(inside)[1]


@check("ledger_scan", "SELECT grp, pos, idx, clean_entry AS entry, snapshot_entry FROM dirty_flags WHERE NOT entry_again AND NOT idx_again")
def ledger_scan(spark: SparkSession, sf: str) -> DataFrame:
    usable, _ = coherence.ledger_scan(I.dirty_ledger(spark, sf))
    return usable.select("grp", "pos", "idx", "entry", "snapshot_entry")


# Stored steps whose snapshot folder is not the one their own header names are dropped by the state.
cte("elsewhere", "SELECT c_custkey AS grp FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
cte(
    "s_path",
    """SELECT grp, 'lockfile-step-path-mismatch' AS code, snapshot_entry AS path, 'not under states/' AS detail FROM locked
    WHERE grp IN (SELECT grp FROM elsewhere)""",
)
cte(
    "s_new",
    """SELECT * FROM f_new WHERE grp NOT IN (SELECT grp FROM elsewhere) UNION ALL
    SELECT grp, 'coherence-new-in-input', entry, 'entry is not in the ledger' FROM plain_in WHERE grp IN (SELECT grp FROM elsewhere)""",
)
cte("s_missing", "SELECT * FROM f_missing WHERE grp NOT IN (SELECT grp FROM elsewhere)")
cte("s_compare", "SELECT * FROM f_compare WHERE grp NOT IN (SELECT grp FROM elsewhere)")
cte(
    "s_head",
    """SELECT * FROM f_head WHERE grp NOT IN (SELECT grp FROM elsewhere) OR detail NOT LIKE '%, ledger steps %' UNION ALL
    SELECT grp, 'coherence-head-index-mismatch', 'schema.lock.toml', 'head_index ' || head_index || ', ledger steps 0'
    FROM full_hdr WHERE grp IN (SELECT grp FROM elsewhere) AND head_index <> 0""",
)
cte(
    "state_found",
    """SELECT * FROM f_header UNION ALL SELECT * FROM f_group UNION ALL SELECT * FROM f_head_digest UNION ALL SELECT * FROM f_orphan
    UNION ALL SELECT * FROM s_new UNION ALL SELECT * FROM s_missing UNION ALL SELECT * FROM s_compare UNION ALL SELECT * FROM s_head
    UNION ALL SELECT * FROM s_path""",
)
FATAL = "(code LIKE 'lockfile-%' OR code IN ('input-path-invalid', 'input-path-duplicate', 'coherence-target-mismatch'))"


def state_findings(spark: SparkSession, sf: str) -> DataFrame:
    locked = written(I.locked_steps(spark, sf), "locked")
    return coherence.ledger_findings(
        I.input_entries(spark, sf), I.snapshots(spark, sf), I.heads(spark, sf), I.full_headers(spark, sf, locked), locked
    )


@check("ledger_state", "SELECT * FROM state_found")
def ledger_state(spark: SparkSession, sf: str) -> DataFrame:
    return state_findings(spark, sf)


# Nations whose customers, but those of HOUSEHOLD, have one fault each, so that every code occurs.
cte(
    "planted",
    "SELECT c_custkey AS grp, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0 ELSE c_nationkey END AS plant FROM customer",
)
cte("unread", "SELECT grp FROM planted WHERE plant = 7 OR (plant = 8 AND grp IN (SELECT grp FROM plain_base))")
cte("unmatched", "SELECT grp FROM planted WHERE plant IN (4, 5)")
cte(
    "codes_found",
    """SELECT s.* FROM state_found s WHERE grp NOT IN (SELECT grp FROM unread) AND NOT (grp IN (SELECT grp FROM unmatched) AND (
        code IN ('coherence-new-in-input', 'coherence-missing-from-input', 'coherence-step-index-mismatch', 'coherence-migration-digest-mismatch',
          'coherence-checkpoint-missing', 'coherence-checkpoint-mismatch', 'coherence-step-schema-mismatch', 'coherence-chain-hash-mismatch')
        OR detail LIKE '%, ledger steps %'))
      AND NOT (code = 'coherence-step-index-mismatch' AND grp IN (SELECT grp FROM planted WHERE plant = 3))
    UNION ALL SELECT grp, code, path, detail FROM state_found WHERE grp IN (SELECT grp FROM unread) AND code = 'input-orphan-checkpoint'
    UNION ALL SELECT grp, 'lockfile-parse-error', 'schema.lock.toml', CASE plant WHEN 7 THEN 'header without head_chain_hash' ELSE 'step without payload_digest' END
      FROM planted WHERE grp IN (SELECT grp FROM unread)
    UNION ALL SELECT grp, 'coherence-new-in-input', entry, 'entry is not in the ledger' FROM plain_in WHERE grp IN (SELECT grp FROM unmatched)
    UNION ALL SELECT grp, 'coherence-head-index-mismatch', 'schema.lock.toml', 'head_index ' || head_index || ', ledger steps 0'
      FROM full_hdr WHERE grp IN (SELECT grp FROM unmatched) AND head_index <> 0
    UNION ALL SELECT grp, 'coherence-step-version-mismatch', entry, 'version differs' FROM matched JOIN planted USING (grp) WHERE plant = 1
    UNION ALL SELECT grp, unnest(['lockfile-duplicate-migration', 'lockfile-duplicate-step-index']), entry,
      unnest(['entry is repeated', 'index ' || idx || ' is repeated']) FROM locked JOIN planted USING (grp) WHERE plant = 2 AND st = 'F'
    UNION ALL SELECT grp, 'lockfile-step-index-invalid', entry, 'index ' || (idx + 1) || ' at place ' || idx FROM locked JOIN planted USING (grp) WHERE plant = 3
    UNION ALL SELECT grp, 'coherence-step-index-mismatch', entry, 'position differs' FROM matched JOIN planted USING (grp) WHERE plant = 3 AND i1 <> i2 + 1
    UNION ALL SELECT grp, 'lockfile-step-path-invalid', '/' || snapshot_entry, 'bad path: absolute' FROM locked JOIN planted USING (grp) WHERE plant = 4
    UNION ALL SELECT grp, 'lockfile-migrations-path-mismatch', 'schema.lock.toml', 'migrations_dir is moves, expected migrations' FROM planted WHERE plant = 5
    UNION ALL SELECT grp, 'lockfile-step-path-mismatch', entry, 'not under moves/' FROM locked JOIN planted USING (grp) WHERE plant = 5
    UNION ALL SELECT grp, 'lockfile-schema-path-mismatch', 'schema.lock.toml', 'schema_file is other.sql, expected schema.sql' FROM planted WHERE plant = 6
    UNION ALL SELECT grp, 'input-path-invalid', '/abs.sql', 'bad path: absolute' FROM planted WHERE plant = 9
    UNION ALL SELECT grp, 'input-path-duplicate', entry, 'repeats the path of an earlier entry' FROM plain_in JOIN planted USING (grp) WHERE plant = 10 AND st = 'F'""",
)


def planted_state(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.when(F.col("c_mktsegment") == "HOUSEHOLD", 0).otherwise(F.col("c_nationkey"))
    plants = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("grp"), nation.alias("plant"))
    stored = written(I.locked_steps(spark, sf, plants), "locked")
    locked = stored.drop("plant", "_status")
    headers = I.full_headers(spark, sf, locked)
    plant = F.col("plant")

    def fault(number: int, name: str, value) -> Column:
        return F.when(plant == number, value).otherwise(F.col(name)).alias(name)

    changed = {
        "version": fault(1, "version", F.lit("x")),
        "idx": fault(3, "idx", F.col("idx") + 1),
        "snapshot_entry": fault(4, "snapshot_entry", F.concat(F.lit("/"), "snapshot_entry")),
        "payload_digest": F.when((plant == 8) & (F.col("idx") == 1), F.lit(None)).otherwise(F.col("payload_digest")).alias("payload_digest"),
    }
    rows = stored.select(*[changed.get(c, F.col(c)) for c in locked.columns])
    again = stored.where((plant == 2) & (F.col("_status") == "F")).withColumn("pos", F.col("pos") + 1_000_000)
    rows = rows.unionByName(again.select(*locked.columns))

    changed = {
        "migrations_dir": fault(5, "migrations_dir", F.lit("moves")),
        "schema_file": fault(6, "schema_file", F.lit("other.sql")),
        "head_chain_hash": F.when(plant == 7, F.lit(None)).otherwise(F.col("head_chain_hash")).alias("head_chain_hash"),
    }
    tops = headers.join(plants, "grp").select(*[changed.get(c, F.col(c)) for c in headers.columns])

    entries = I.input_entries(spark, sf)
    outside = plants.where(plant == 9).select("grp", F.lit("/abs.sql").alias("entry"), F.lit("x").alias("payload"))
    filled = I.input_entries(spark, sf, "F")
    doubled = filled.join(plants.where(plant == 10), "grp")
    doubled = doubled.select("grp", F.concat(F.lit("./"), "entry").alias("entry"), "payload")
    given = entries.unionByName(outside).unionByName(doubled)
    return coherence.ledger_findings(given, I.snapshots(spark, sf), I.heads(spark, sf), tops, rows)


@check("ledger_state_codes", "SELECT * FROM codes_found")
def ledger_state_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A state in which every code occurs."""
    return planted_state(spark, sf)


@check("stored_ledgers", "SELECT grp, idx, entry, snapshot_entry, chain_hash, grp IN (SELECT grp FROM planted WHERE plant = 7) AS unreadable FROM locked")
def stored_ledgers(spark: SparkSession, sf: str) -> DataFrame:
    """Ledgers published as text and read back; the headers of one nation are torn."""
    locked = written(I.locked_steps(spark, sf), "locked")
    lines = publish.ledger_lines(I.full_headers(spark, sf, locked), locked.drop("pos"))
    torn = I.table(spark, sf, "customer").where((F.col("c_nationkey") == 7) & (F.col("c_mktsegment") != "HOUSEHOLD"))
    torn = torn.select(F.col("c_custkey").alias("grp"), F.lit(True).alias("_torn"))
    broken = lines.join(torn, "grp", "left").withColumn(
        "payload", F.when(F.col("_torn") & F.endswith("entry", F.lit("header.json")), F.substring("payload", 1, 40)).otherwise(F.col("payload"))
    )
    _, steps, unreadable = ledgers.stored_ledgers(broken.select("grp", "entry", "payload"))
    bad = unreadable.select("grp").distinct().withColumn("_bad", F.lit(True))
    return steps.join(bad, "grp", "left").select(
        "grp", "idx", "entry", "snapshot_entry", "chain_hash", F.col("_bad").isNotNull().alias("unreadable")
    )


@check("fatal_diagnostics", f"SELECT * FROM state_found WHERE {FATAL}")
def fatal_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return coherence.fatal_diagnostics(state_findings(spark, sf))


@check(
    "is_clean",
    "SELECT c_custkey AS grp, coalesce(n, 0) AS findings, n IS NULL AS is_clean FROM customer LEFT JOIN (SELECT grp, count(*) AS n FROM state_found GROUP BY grp) ON grp = c_custkey",
)
def is_clean(spark: SparkSession, sf: str) -> DataFrame:
    groups = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("grp"))
    return coherence.is_clean(groups, state_findings(spark, sf))


@check("step_ordinal", "SELECT grp, pos FROM dirty")
def step_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    placed = ordinal(rows, ["grp"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "pos")
    return placed.select("grp", "pos")
