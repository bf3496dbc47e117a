"""Checks of replay, rollback and publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import ensure_newline
from ..operators import history, ledger, publish, replay, roundtrip
from ..operators.ordering import ordinal, previous_value
from ..plans import live, publishing
from ..session import scratch_path, written
from . import inputs as I
from .histories import _applied, _divergence, _live, _relation
from .registry import check, cte

# -------------------------------------------------------------------- states over time


@check("replay_tail", "SELECT grp, hr, event_id, amount FROM mixed_ranges WHERE valid_to IS NULL")
def replay_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Replaces, inserts and upserts by hour of day, from nothing."""
    return replay.replay_tail(I.mixed_changes(spark, sf), ["hr"])


cte(
    "anchor_rows",
    "SELECT c_custkey AS grp, c_nationkey AS hr, -1 - c_custkey AS event_id, CAST(round(c_acctbal * 100) AS BIGINT) AS amount FROM customer",
)


def _anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as users, their nations as hours: the state to start from."""
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("grp"),
        F.col("c_nationkey").cast("bigint").alias("hr"),
        (-1 - F.col("c_custkey")).alias("event_id"),
        I.cents("c_acctbal").alias("amount"),
    )


@check(
    "replay_tail_anchored",
    """SELECT grp, hr, event_id, amount FROM mixed_ranges WHERE valid_to IS NULL
    UNION ALL SELECT grp, hr, event_id, amount FROM anchor_rows a WHERE NOT EXISTS (
      SELECT 1 FROM mixed m WHERE m.grp = a.grp AND (m.mode = 'replace' OR (m.mode = 'upsert' AND m.hr = a.hr)))""",
)
def replay_tail_anchored(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay_tail(I.mixed_changes(spark, sf), ["hr"], _anchor(spark, sf))


@check(
    "replay_upserts",
    "SELECT grp, event_type, event_id, amount, props FROM ev_ranges WHERE valid_to IS NULL",
)
def replay_upserts(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay_upserts(I.event_changes(spark, sf), ["event_type"])


@check("capture_checkpoints", "SELECT grp, hr, event_id, valid_from, coalesce(valid_to, 0) AS valid_to FROM mixed_ranges")
def capture_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    ranges = replay.capture_checkpoints(I.mixed_changes(spark, sf), ["hr"])
    return ranges.select("grp", "hr", "event_id", "valid_from", F.coalesce("valid_to", F.lit(0)).alias("valid_to"))


@check(
    "checkpoint_sizes",
    """SELECT s.grp, s.idx, count(r.event_id) AS rows FROM mixed s LEFT JOIN mixed_ranges r
      ON r.grp = s.grp AND r.valid_from <= s.idx AND (r.valid_to IS NULL OR r.valid_to > s.idx) GROUP BY s.grp, s.idx""",
)
def checkpoint_sizes(spark: SparkSession, sf: str) -> DataFrame:
    changes = I.mixed_changes(spark, sf)
    ranges = replay.capture_checkpoints(changes, ["hr"])
    return replay.checkpoint_sizes(ranges, changes.select("grp", "idx"))


# ------------------------------------------------------------------------- round trips


def _inverses(spark: SparkSession, sf: str, changes: DataFrame) -> DataFrame:
    """An inverse per event: the row before it or a delete. Views have none; those
    of errors are wrong when the amount is above one hundred."""
    packed = changes.withColumn("_row", F.struct("event_id", "amount"))
    undo = previous_value(packed, ["grp", "event_type"], ["idx"], "_row", "_old").where(F.col("event_type") != "view").select(
        "grp", "idx", "event_type", "_old.event_id", "_old.amount", F.col("amount").alias("_now")
    )
    wrong = (F.col("event_type") == "error") & (F.col("_now") > 10000)
    return undo.select(
        "grp", "idx", "event_type", "event_id",
        F.when(wrong, F.coalesce("amount", F.lit(0)) + 1).otherwise(F.col("amount")).alias("amount"),
        F.when(F.col("event_id").isNull() & ~wrong, "delete").otherwise("upsert").alias("op"),
    )


cte(
    "roundtrips",
    """SELECT grp, idx, CASE WHEN event_type = 'view' THEN 'skipped' WHEN event_type = 'error' AND amount > 10000 THEN 'mismatch' ELSE 'checked' END AS status,
      CASE WHEN event_type = 'error' AND amount > 10000 THEN 1 ELSE 0 END AS wrong_keys FROM ev""",
)


def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    changes = I.event_changes(spark, sf).drop("props")
    return replay.rollback_roundtrip(changes, _inverses(spark, sf, changes), ["event_type"])


@check("rollback_roundtrip", "SELECT * FROM roundtrips")
def rollback_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _roundtrip(spark, sf)


cte(
    "state_rows",
    """SELECT s.grp, s.idx, s.point, r.hr, r.event_id, r.amount, r.valid_to FROM (SELECT grp, idx, unnest([idx - 1, idx]) AS point FROM mixed) s
    JOIN mixed_ranges r ON r.grp = s.grp AND r.valid_from <= s.point AND (r.valid_to IS NULL OR r.valid_to > s.point)""",
)
cte("step_facts", "SELECT m.*, e.event_type AS kind FROM mixed m JOIN ev e ON e.grp = m.grp AND e.idx = m.idx")
cte(
    "rolled_rows",
    # Inserts: the row goes, unless its inverse names another amount. Upserts: the hour's rows go, the ended ones
    # come back, but not for errors above one hundred. Replaces: the ended rows come back, large sign-ups a row short.
    """SELECT f.grp, f.idx, r.event_id, r.hr, r.amount FROM step_facts f JOIN state_rows r ON r.grp = f.grp AND r.idx = f.idx AND r.point = f.idx
      WHERE f.mode <> 'replace' AND NOT (f.mode = 'insert' AND r.event_id = f.event_id AND f.amount <= 10000) AND NOT (f.mode = 'upsert' AND r.hr = f.hr)
    UNION ALL SELECT f.grp, f.idx, r.event_id, r.hr, r.amount FROM step_facts f JOIN mixed_ranges r ON r.grp = f.grp AND r.valid_to = f.idx
      WHERE NOT (f.kind = 'error' AND f.amount > 10000) AND NOT (f.kind = 'signup' AND f.amount > 10000 AND r.hr = f.hr)""",
)
cte(
    "mixed_roundtrips",
    """SELECT f.grp, f.idx, f.mode, CASE WHEN f.kind = 'purchase' AND f.hr < 6 THEN 'skipped' WHEN d.grp IS NULL THEN 'checked' ELSE 'mismatch' END AS status,
      CASE WHEN f.kind = 'purchase' AND f.hr < 6 THEN 0 ELSE coalesce(d.surplus, 0) END AS surplus_rows
    FROM step_facts f LEFT JOIN (
      SELECT grp, idx, CAST(sum(n) AS BIGINT) AS surplus FROM (
        SELECT grp, idx, event_id, hr, amount, sum(n) AS n FROM (
          SELECT grp, idx, event_id, hr, amount, 1 AS n FROM rolled_rows
          UNION ALL SELECT grp, idx, event_id, hr, amount, -1 FROM state_rows WHERE point = idx - 1)
        GROUP BY ALL HAVING sum(n) <> 0) GROUP BY grp, idx) d USING (grp, idx)""",
)


def _mixed_inverses(spark: SparkSession, sf: str, changes: DataFrame) -> DataFrame:
    """Inverses of inserts, upserts and replaces with planted wrong ones; early purchases have none."""
    kinds = I.table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    steps = changes.join(kinds, "event_id")
    large = F.col("amount") > 10000
    row = ["grp", "idx", "op", "hr", "event_id", "amount"]
    own = steps.where(~((F.col("kind") == "purchase") & (F.col("hr") < 6)))
    removed = own.where(F.col("mode") == "insert").withColumn("op", F.lit("remove"))
    removed = removed.withColumn("amount", F.when(large, F.col("amount") + 1).otherwise(F.col("amount")))
    deleted = own.where(F.col("mode") == "upsert").withColumn("op", F.lit("delete"))
    cleared = own.where(F.col("mode") == "replace").withColumn("op", F.lit("clear"))
    ended = replay.capture_checkpoints(changes, ["hr"]).where(F.col("valid_to").isNotNull()).select(
        "grp", F.col("valid_to").alias("idx"), F.col("hr").alias("_hr"), F.col("event_id").alias("_id"), F.col("amount").alias("_amount")
    )
    lost = ((F.col("kind") == "error") & large) | ((F.col("kind") == "signup") & large & (F.col("_hr") == F.col("hr")))
    back = own.join(ended, ["grp", "idx"]).where(~lost).select(
        "grp", "idx", F.when(F.col("mode") == "replace", "replace").otherwise("insert").alias("op"),
        F.col("_hr").alias("hr"), F.col("_id").alias("event_id"), F.col("_amount").alias("amount"),
    )
    return removed.select(*row).unionByName(deleted.select(*row)).unionByName(cleared.select(*row)).unionByName(back)


@check("state_roundtrip", "SELECT * FROM mixed_roundtrips")
def state_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Every replace, insert and upsert rolled back by its inverse."""
    changes = written(I.mixed_changes(spark, sf), "mixed")
    return roundtrip.state_roundtrip(changes, _mixed_inverses(spark, sf, changes), ["hr"])


@check(
    "state_digests",
    """SELECT s.grp, s.idx, count(r.event_id) AS rows, true AS digest_holds
    FROM mixed s LEFT JOIN state_rows r ON r.grp = s.grp AND r.idx = s.idx AND r.point = s.idx GROUP BY s.grp, s.idx""",
)
def state_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes beside digests; a state's digest must be the sum over its rows, taken anew from the last one."""
    changes = written(I.mixed_changes(spark, sf), "mixed")
    ranges = replay.capture_checkpoints(changes, ["hr"])
    digests = roundtrip.state_digests(ranges, ["hr", "event_id", "amount"], changes)
    rows = replay.replay_tail(changes, ["hr"])
    anew = rows.groupBy("grp").agg(F.sum(roundtrip.row_number(rows, ["hr", "event_id", "amount"])).alias("_anew"))
    last = changes.groupBy("grp").agg(F.max("idx").alias("idx")).join(anew, "grp")
    wrong = F.col("_anew").isNotNull() & (F.col("_anew") != F.col("digest"))
    return digests.join(last, ["grp", "idx"], "left").select("grp", "idx", "rows", (~wrong).alias("digest_holds"))


@check(
    "schema_plan",
    """SELECT e.grp, a.applied_count + 1 AS divergence_index, a.applied_count AS anchor_index, count(*) FILTER (WHERE e.idx > a.applied_count) AS tail_count, true AS matches,
      count(*) FILTER (WHERE t.status = 'checked') AS checked, count(*) FILTER (WHERE t.status = 'mismatch') AS mismatch, count(*) FILTER (WHERE t.status = 'skipped') AS skipped
    FROM ev e JOIN ev_applied a USING (grp) JOIN roundtrips t ON t.grp = e.grp AND t.idx = e.idx GROUP BY e.grp, a.applied_count""",
)
def schema_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Replay from each user's mid-month state must give its committed last state."""
    changes = I.event_changes(spark, sf).drop("props")
    applied = I.event_applied(spark, sf)
    ranges = replay.capture_checkpoints(changes, ["event_type"])
    anchor = replay.state_at(ranges.join(applied, "grp"), F.col("applied_count")).drop("applied_count")
    replayed = replay.apply_pending(anchor, changes, applied, ["event_type"])
    committed = replay.replay_upserts(changes, ["event_type"])
    counts = changes.groupBy("grp").agg(F.count("*").alias("_n"))
    plan = counts.join(applied, "grp").select(
        "grp",
        (F.col("applied_count") + 1).alias("divergence_index"),
        F.col("applied_count").alias("anchor_index"),
        (F.col("_n") - F.col("applied_count")).alias("tail_count"),
    )
    return replay.schema_plan(plan, replayed.select(*committed.columns), committed, _roundtrip(spark, sf))


# ---------------------------------------------------------------------- live operations


@check(
    "bootstrap",
    "SELECT p.grp, p.entry, p.payload FROM plain_in p WHERE p.grp NOT IN (SELECT grp FROM applied_log)",
)
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Head rows for customers nothing is applied to."""
    return replay.bootstrap(I.input_entries(spark, sf), _relation(spark, sf))


@check(
    "bootstrap_status",
    """SELECT grp, applied_count AS before_index, CASE WHEN applied_count = 0 THEN head_count ELSE applied_count END AS after_index,
      CASE WHEN applied_count = 0 THEN 'loaded' ELSE 'refused' END AS status FROM relation WHERE head_count > 0""",
)
def bootstrap_status(spark: SparkSession, sf: str) -> DataFrame:
    return replay.bootstrap_status(I.input_entries(spark, sf), _relation(spark, sf))


@check("apply_pending", "SELECT grp, hr, event_id, amount FROM mixed_ranges WHERE valid_to IS NULL")
def apply_pending(spark: SparkSession, sf: str) -> DataFrame:
    """From each user's live mid-month state to the head."""
    changes = I.mixed_changes(spark, sf)
    applied = I.event_applied(spark, sf)
    ranges = replay.capture_checkpoints(changes, ["hr"])
    now = replay.state_at(ranges.join(applied, "grp"), F.col("applied_count")).drop("applied_count")
    return replay.apply_pending(now, changes, applied, ["hr"])


@check(
    "apply_pending_status",
    """SELECT r.grp, applied_count AS before_index, CASE WHEN s IN ('applied', 'up_to_date') THEN head_count ELSE applied_count END AS after_index, s AS status FROM (
      SELECT r.*, CASE WHEN head_count = 0 THEN 'no_steps' WHEN coalesce(p.status, 'ok') <> 'ok' THEN p.status WHEN relation = 'ahead' THEN 'ahead'
        WHEN relation = 'equal' THEN 'up_to_date' ELSE 'applied' END AS s FROM relation r LEFT JOIN prefix p USING (grp)) r""",
)
def apply_pending_status(spark: SparkSession, sf: str) -> DataFrame:
    prefix = history.prefix_check(I.plain_input_steps(spark, sf), _applied(spark, sf))
    return replay.pending_status(I.input_entries(spark, sf), _relation(spark, sf), prefix)


@check(
    "rollback",
    """SELECT r.grp, r.hr, r.event_id, r.amount FROM mixed_ranges r JOIN ev_applied a USING (grp)
    WHERE r.valid_from <= greatest(a.applied_count - 3, 0) AND (r.valid_to IS NULL OR r.valid_to > greatest(a.applied_count - 3, 0))""",
)
def rollback(spark: SparkSession, sf: str) -> DataFrame:
    """Three steps back from each user's applied count."""
    ranges = replay.capture_checkpoints(I.mixed_changes(spark, sf), ["hr"])
    return replay.rollback(ranges, I.event_applied(spark, sf), 3)


# --------------------------------------------------------------------------- publishing

cte(
    "carried",
    """SELECT p.grp, p.idx, p.snapshot_entry AS entry, CASE WHEN p.idx <= a.anchor_index THEN 'carried' ELSE 'replayed' END AS origin,
      CASE WHEN p.idx <= a.anchor_index THEN s.payload ELSE 'replayed ' || p.payload END AS payload
    FROM plain_in p JOIN anchors a USING (grp) LEFT JOIN snaps s ON s.grp = p.grp AND s.entry = p.snapshot_entry""",
)


def _recomputed(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.entries import companion_entry

    return I.input_entries(spark, sf).select(
        "grp", companion_entry(F.col("entry")).alias("entry"), F.concat(F.lit("replayed "), "payload").alias("payload")
    )


def _carried(spark: SparkSession, sf: str) -> DataFrame:
    # Three joins read the steps, none of them their snapshots' digests.
    steps = written(ledger.plain_steps(I.input_entries(spark, sf)).drop("snapshot_digest"), "steps")
    plan = history.anchor_tail(steps, _divergence(spark, sf, steps))
    return publish.carry_forward(plan, steps, I.snapshots(spark, sf), _recomputed(spark, sf))


@check("carry_forward", "SELECT * FROM carried")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _carried(spark, sf)


@check("snapshot_gaps", "SELECT grp, idx, entry, origin FROM carried WHERE payload IS NULL")
def snapshot_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return publish.snapshot_gaps(_carried(spark, sf))


cte(
    "want_art",
    """SELECT grp, entry, payload || chr(10) AS payload FROM carried WHERE payload IS NOT NULL
    UNION ALL SELECT grp, 'schema.sql', payload || chr(10) FROM heads""",
)
cte(
    "have_art",
    """SELECT grp, entry, payload || chr(10) AS payload FROM snaps
    UNION ALL SELECT c_custkey, 'schema.sql', 'head ' || c_name || CASE WHEN c_nationkey = 0 THEN '' ELSE chr(10) END FROM customer
    UNION ALL SELECT c_custkey, 'notes.txt', c_mktsegment FROM customer""",
)
cte(
    "delta",
    """SELECT coalesce(w.grp, h.grp) AS grp, coalesce(w.entry, h.entry) AS entry,
      CASE WHEN w.entry IS NULL THEN CASE WHEN starts_with(h.entry, 'checkpoints/') THEN 'delete' ELSE 'keep' END
        WHEN w.payload = h.payload THEN 'keep' ELSE 'write' END AS action
    FROM want_art w FULL JOIN have_art h ON h.grp = w.grp AND h.entry = w.entry""",
)


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    kept = _carried(spark, sf).where(F.col("payload").isNotNull())
    head = I.heads(spark, sf).select("grp", F.lit("schema.sql").alias("entry"), "payload")
    every = kept.select("grp", "entry", "payload").unionByName(head)
    return every.withColumn("payload", ensure_newline(F.col("payload")))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    people = I.table(spark, sf, "customer")
    end = F.when(F.col("c_nationkey") == 0, "").otherwise("\n")
    head = people.select(
        F.col("c_custkey").alias("grp"), F.lit("schema.sql").alias("entry"), F.concat(F.lit("head "), "c_name", end).alias("payload")
    )
    notes = people.select(F.col("c_custkey").alias("grp"), F.lit("notes.txt").alias("entry"), F.col("c_mktsegment").alias("payload"))
    snaps = I.snapshots(spark, sf).withColumn("payload", ensure_newline(F.col("payload")))
    return snaps.unionByName(head).unionByName(notes)


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    return publish.publish_delta(_wanted(spark, sf), _stored(spark, sf))


@check("publish_delta", "SELECT * FROM delta")
def publish_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _delta(spark, sf)


@check(
    "publish_applied",
    """SELECT h.* FROM have_art h JOIN delta d ON d.grp = h.grp AND d.entry = h.entry AND d.action = 'keep'
    UNION ALL SELECT w.* FROM want_art w JOIN delta d ON d.grp = w.grp AND d.entry = w.entry AND d.action = 'write'""",
)
def publish_applied(spark: SparkSession, sf: str) -> DataFrame:
    wanted = written(_wanted(spark, sf), "desired")
    delta = written(publish.publish_delta(wanted, _stored(spark, sf)), "delta")
    return publish.apply_delta(wanted, _stored(spark, sf), delta)


@check("apply_result", "SELECT * FROM delta WHERE action <> 'keep'")
def apply_result(spark: SparkSession, sf: str) -> DataFrame:
    return publish.apply_result(_delta(spark, sf))


@check(
    "apply_summary",
    "SELECT grp, count(*) FILTER (WHERE action <> 'keep') > 0 AS wrote, count(*) FILTER (WHERE action <> 'keep') AS changed, count(*) FILTER (WHERE action = 'keep') AS kept FROM delta GROUP BY grp",
)
def apply_summary(spark: SparkSession, sf: str) -> DataFrame:
    return publish.apply_summary(_delta(spark, sf))


@check(
    "check_delta_overlap",
    """SELECT grp, path AS entry, unnest(CASE WHEN w > 1 AND d > 0 THEN ['duplicate_write', 'write_and_delete'] WHEN w > 1 THEN ['duplicate_write'] WHEN w > 0 AND d > 0 THEN ['write_and_delete'] ELSE [] END) AS problem
    FROM (SELECT grp, path, count(*) FILTER (WHERE reason IS NULL) AS w, count(*) FILTER (WHERE reason IS NOT NULL) AS d FROM (
      SELECT l_orderkey AS grp, l_returnflag || l_linestatus AS path, CASE WHEN l_linenumber > 4 THEN 'd' END AS reason FROM lineitem) GROUP BY grp, path)""",
)
def check_delta_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a delta: the first four lines write, the later ones delete."""
    lines = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("grp"), F.concat("l_returnflag", "l_linestatus").alias("entry"), "l_linenumber"
    )
    writes = lines.where(F.col("l_linenumber") <= 4)
    return publish.check_delta_overlap(writes, lines.where(F.col("l_linenumber") > 4))


cte("n_own", "SELECT grp, max(idx) AS n, max_by(h, idx) AS h FROM chain_own WHERE idx > 0 GROUP BY grp")
cte(
    "replayed_steps",
    """SELECT p.grp, p.idx, p.version, p.entry, p.payload_digest, p.snapshot_entry, p.payload, c.h AS chain_hash, sha256('replayed ' || p.payload || chr(10)) AS snapshot_digest
    FROM plain_in p JOIN chain_own c ON c.grp = p.grp AND c.idx = p.idx""",
)


@check(
    "desired_artifacts",
    """SELECT grp, snapshot_entry AS entry, 'replayed ' || payload || chr(10) AS payload FROM replayed_steps
    UNION ALL SELECT grp, 'schema.sql', payload || chr(10) FROM heads
    UNION ALL SELECT h.grp, 'ledger/header.json', '{"canonicalizer":"ledgerkeel-v0","checkpoints_dir":"checkpoints","engine":"spark","hash_algorithm":"sha2-256","head_chain_hash":"' || coalesce(t.h, s.seed)
      || '","head_index":' || coalesce(t.n, 0) || ',"head_schema_digest":"' || sha256(h.payload || chr(10)) || '","lock_version":0,"migrations_dir":"migrations","schema_file":"schema.sql","target":"' || h.grp || '"}'
      FROM heads h JOIN own_seed s USING (grp) LEFT JOIN n_own t USING (grp)
    UNION ALL SELECT grp, 'ledger/' || lpad(CAST(idx AS VARCHAR), 12, '0') || '.json', '{"chain_hash":"' || chain_hash || '","entry":"' || entry || '","idx":' || idx || ',"payload_digest":"' || payload_digest
      || '","schema_digest":"' || snapshot_digest || '","snapshot_digest":"' || snapshot_digest || '","snapshot_entry":"' || snapshot_entry || '","version":"' || version || '"}' FROM replayed_steps""",
)
def desired_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Everything a clean replay of all customers would publish."""
    people = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("grp"), F.lit(I.ENGINE).alias("engine"), F.col("c_custkey").cast("string").alias("target")
    )
    snaps = _recomputed(spark, sf)
    steps = written(ledger.build_steps(I.input_entries(spark, sf), snaps, people), "steps")
    locked, headers = ledger.build_ledger(steps, I.heads(spark, sf), I.ENGINE)
    plan = history.anchor_tail(steps, steps, clean=True)
    carried = publish.carry_forward(plan, steps, I.snapshots(spark, sf), snaps)
    return publish.desired_artifacts(carried, I.heads(spark, sf), headers, locked)


# ------------------------------------------------------------- whole live operations

cte(
    "up_status",
    """SELECT r.grp, r.applied_count, head_count, CASE WHEN head_count = 0 THEN 'no_steps' WHEN coalesce(p.status, 'ok') <> 'ok' THEN p.status WHEN relation = 'ahead' THEN 'ahead'
      WHEN relation = 'equal' THEN 'up_to_date' ELSE 'applied' END AS s FROM relation r LEFT JOIN prefix p USING (grp)""",
)
cte("going_up", "SELECT * FROM up_status WHERE s = 'applied'")
cte(
    "going_down",
    """SELECT r.grp, r.applied_count FROM relation r LEFT JOIN prefix p USING (grp)
    WHERE coalesce(p.status, 'ok') = 'ok' AND relation <> 'ahead' AND r.applied_count > 0""",
)
cte("pending_rows", "SELECT p.grp, p.entry, p.payload FROM plain_in p JOIN going_up g USING (grp) WHERE p.idx > g.applied_count")


def _entry_changes(spark: SparkSession, sf: str) -> DataFrame:
    placed = ordinal(I.input_entries(spark, sf), ["grp"], ["entry"], "idx")
    return placed.select("grp", "idx", F.lit("upsert").alias("mode"), "entry", "payload")


def _live_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return _live(spark, sf), _entry_changes(spark, sf), I.plain_input_steps(spark, sf), _applied(spark, sf)


@check(
    "live_up",
    """SELECT grp, entry, payload FROM live_rows l WHERE NOT EXISTS (SELECT 1 FROM pending_rows p WHERE p.grp = l.grp AND p.entry = l.entry)
    UNION ALL SELECT grp, entry, payload FROM pending_rows""",
)
def live_up(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's rows after its pending entries ran, refused ones unchanged."""
    own, changes, steps, applied = _live_inputs(spark, sf)
    return live.up(own, changes, steps, applied, ["entry"]).state


@check(
    "live_down",
    """SELECT grp, entry, payload FROM live_rows WHERE grp NOT IN (SELECT grp FROM going_down)
    UNION ALL SELECT p.grp, p.entry, p.payload FROM plain_in p JOIN going_down g USING (grp) WHERE p.idx <= greatest(g.applied_count - 2, 0)""",
)
def live_down(spark: SparkSession, sf: str) -> DataFrame:
    own, changes, steps, applied = _live_inputs(spark, sf)
    ranges = replay.capture_checkpoints(changes, ["entry"])
    return live.down(own, ranges, steps, applied, 2).state


@check(
    "live_bootstrap",
    """SELECT grp, entry, payload FROM live_rows
    UNION ALL SELECT grp, entry, payload FROM head_rows WHERE grp NOT IN (SELECT grp FROM applied_log)""",
)
def live_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    own, changes, steps, applied = _live_inputs(spark, sf)
    return live.bootstrap(own, changes.select("grp", "entry", "payload"), steps, applied).state


@check(
    "publish_artifacts",
    """SELECT grp, entry, payload, c_nationkey AS part FROM customer JOIN (
      SELECT h.* FROM have_art h JOIN delta d ON d.grp = h.grp AND d.entry = h.entry AND d.action = 'keep'
      UNION ALL SELECT w.* FROM want_art w JOIN delta d ON d.grp = w.grp AND d.entry = w.entry AND d.action = 'write') ON grp = c_custkey""",
)
def publish_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Publish into a table partitioned by the customer's nation."""
    nations = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("grp"), F.col("c_nationkey").alias("part"))
    name = f"artifacts_{uuid.uuid4().hex[:12]}"
    columns = ["grp", "entry", "payload", "part"]
    start = _stored(spark, sf).join(nations, "grp").select(*columns)
    start.write.partitionBy("part").option("path", scratch_path(spark, "artifacts")).saveAsTable(name)
    publishing.publish_artifacts(spark, name, _wanted(spark, sf).join(nations, "grp").select(*columns))
    return spark.table(name)
