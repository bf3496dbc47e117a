"""Checks of history comparison, drift and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StateError
from ..operators import coherence, compare, digest_tree, history, mutate, textdiff, validate
from ..operators.ordering import ordinal
from ..plans import dataset
from ..session import scratch_path, written
from . import inputs as I
from .ledgers import FATAL, STEP, planted_state  # noqa: F401
from .registry import check, cte

# ---------------------------------------------------------------------- divergence

DIVERGENCE = """SELECT grp, coalesce(b.idx, h.idx) AS idx, CASE WHEN b.idx IS NULL OR h.idx IS NULL THEN 'step_count'
  WHEN b.version <> h.version THEN 'version' WHEN b.entry <> h.entry THEN 'migration_file'
  WHEN b.payload_digest <> h.payload_digest THEN 'migration_digest' END AS field,
  b.version AS bv, h.version AS hv, b.entry AS be, h.entry AS he, b.payload_digest AS bd, h.payload_digest AS hd
FROM plain_base b FULL JOIN plain_in h USING (grp, idx)"""
cte("div_rows", DIVERGENCE)
cte("n_base", "SELECT grp, count(*) AS n FROM plain_base GROUP BY grp")
cte("n_in", "SELECT grp, count(*) AS n FROM plain_in GROUP BY grp")
cte(
    "divergence",
    """SELECT d.grp, d.idx AS divergence_index, d.field,
      CASE field WHEN 'step_count' THEN CAST(coalesce(b.n, 0) AS VARCHAR) WHEN 'version' THEN bv WHEN 'migration_file' THEN be ELSE bd END AS base_value,
      CASE field WHEN 'step_count' THEN CAST(coalesce(h.n, 0) AS VARCHAR) WHEN 'version' THEN hv WHEN 'migration_file' THEN he ELSE hd END AS head_value
    FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY idx) AS k FROM div_rows WHERE field IS NOT NULL) d
    LEFT JOIN n_base b USING (grp) LEFT JOIN n_in h USING (grp) WHERE k = 1""",
)


def _divergence(spark: SparkSession, sf: str, steps: DataFrame | None = None) -> DataFrame:
    own = I.plain_input_steps(spark, sf) if steps is None else steps
    return history.first_divergence(I.plain_base_steps(spark, sf), own)


@check("first_divergence", "SELECT * FROM divergence")
def first_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return _divergence(spark, sf)


@check(
    "ledger_divergence",
    """SELECT grp, 1 AS divergence_index, 'target_name' AS field, target AS base_value, CAST(grp AS VARCHAR) AS head_value FROM hdr WHERE target <> CAST(grp AS VARCHAR)
    UNION ALL SELECT * FROM divergence WHERE grp NOT IN (SELECT grp FROM hdr WHERE target <> CAST(grp AS VARCHAR))""",
)
def ledger_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return history.ledger_divergence(
        I.stored_headers(spark, sf), I.plain_base_steps(spark, sf), I.plain_input_steps(spark, sf)
    )


@check(
    "state_divergence",
    """SELECT grp, 1 AS divergence_index, 'target_name' AS field, target AS base_value, CAST(grp AS VARCHAR) AS head_value FROM hdr WHERE target <> CAST(grp AS VARCHAR)
    UNION ALL SELECT * FROM divergence WHERE grp NOT IN (SELECT grp FROM hdr WHERE target <> CAST(grp AS VARCHAR))""",
)
def state_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """The strict variant: no finding on either side; some groups have other target names."""
    stored = I.stored_headers(spark, sf)
    own = stored.select("grp", F.col("grp").cast("string").alias("target"))
    none = coherence.check_group(own)
    return history.state_divergence(
        I.plain_base_steps(spark, sf), I.plain_input_steps(spark, sf), none, none, stored.select("grp", "target"), own
    )


# --------------------------------------------------------------------- applied prefix

cte(
    "prefix",
    """SELECT grp, style, n AS applied_count, CASE WHEN style = 'mixed' THEN 'mixed_styles'
      WHEN style = 'basename' AND alike > 1 THEN 'duplicate_basenames'
      WHEN CASE style WHEN 'path' THEN off_path ELSE off_base END > 0 THEN 'not_prefix' ELSE 'ok' END AS status
    FROM (SELECT a.grp, count(*) AS n, any_value(s.style) AS style, max(p.alike) AS alike,
        count(*) FILTER (WHERE replace(a.entry, '\\', '/') <> p.entry) AS off_path,
        count(*) FILTER (WHERE string_split(replace(a.entry, '\\', '/'), '/')[-1] <> p.base) AS off_base
      FROM applied_log a JOIN styles s USING (grp)
      LEFT JOIN (SELECT grp, idx, entry, stem || '.sql' AS base, count(*) OVER (PARTITION BY grp, stem) AS alike FROM plain_in) p ON p.grp = a.grp AND p.idx = a.pos
      GROUP BY a.grp)""",
)


def _applied(spark: SparkSession, sf: str) -> DataFrame:
    return I.applied(spark, sf).select("grp", "pos", "entry")


def _relation(spark: SparkSession, sf: str) -> DataFrame:
    steps = I.input_entries(spark, sf).select("grp")
    return history.live_relation(steps, I.applied(spark, sf).select("grp"))


@check("prefix_check", "SELECT * FROM prefix")
def prefix_check(spark: SparkSession, sf: str) -> DataFrame:
    return history.prefix_check(I.plain_input_steps(spark, sf), _applied(spark, sf))


@check("live_relation", "SELECT * FROM relation")
def live_relation(spark: SparkSession, sf: str) -> DataFrame:
    return _relation(spark, sf)


# -------------------------------------------------------------------- anchor and tail

cte(
    "anchors",
    """SELECT grp, coalesce(n, 0) AS step_count, divergence_index, coalesce(divergence_index - 1, n) AS anchor_index,
      greatest(coalesce(n, 0) - coalesce(divergence_index - 1, n), 0) AS tail_count FROM n_in FULL JOIN divergence USING (grp)""",
)


@check("anchor_tail", "SELECT * REPLACE (coalesce(divergence_index, 0) AS divergence_index) FROM anchors")
def anchor_tail(spark: SparkSession, sf: str) -> DataFrame:
    plan = history.anchor_tail(I.plain_input_steps(spark, sf), _divergence(spark, sf))
    return plan.fillna(0, ["divergence_index"])


@check(
    "tail_steps",
    "SELECT p.grp, p.idx, p.entry FROM plain_in p JOIN anchors a USING (grp) WHERE p.idx > a.anchor_index",
)
def tail_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = I.plain_input_steps(spark, sf)
    plan = history.anchor_tail(steps, _divergence(spark, sf))
    return history.tail_steps(steps, plan).select("grp", "idx", "entry")


@check(
    "select_anchor",
    """SELECT a.grp, anchor_index, p.snapshot_entry, s.payload, CASE WHEN p.grp IS NULL THEN 'no_step' WHEN s.payload IS NULL THEN 'no_snapshot' END AS error
    FROM anchors a LEFT JOIN plain_in p ON p.grp = a.grp AND p.idx = a.anchor_index
    LEFT JOIN snaps s ON s.grp = a.grp AND s.entry = p.snapshot_entry WHERE anchor_index > 0""",
)
def select_anchor(spark: SparkSession, sf: str) -> DataFrame:
    steps = I.plain_input_steps(spark, sf)
    plan = history.anchor_tail(steps, _divergence(spark, sf))
    return history.select_anchor(plan, steps, I.snapshots(spark, sf))


cte(
    "requested",
    """SELECT grp, applied_count AS index FROM relation UNION ALL SELECT grp, head_count FROM relation UNION ALL SELECT grp, 0 FROM relation""",
)


@check(
    "expected_at",
    """SELECT grp, index, source, payload, CASE WHEN source IS NULL THEN 'out_of_range' WHEN payload IS NULL THEN 'missing' END AS error FROM (
      SELECT r.grp, r.index, src AS source, CASE src WHEN 'zero' THEN '' WHEN 'head' THEN h.payload WHEN 'snapshot' THEN s.payload END AS payload
      FROM (SELECT r.*, CASE WHEN index < 0 OR index > coalesce(n, 0) THEN NULL WHEN index = 0 THEN 'zero' WHEN index = coalesce(n, 0) THEN 'head' ELSE 'snapshot' END AS src
        FROM requested r LEFT JOIN n_in USING (grp)) r
      LEFT JOIN plain_in p ON p.grp = r.grp AND p.idx = r.index LEFT JOIN snaps s ON s.grp = p.grp AND s.entry = p.snapshot_entry LEFT JOIN heads h ON h.grp = r.grp)""",
)
def expected_at(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's applied index, its last index and the zero baseline."""
    relation = _relation(spark, sf)
    at = F.explode(F.array("applied_count", "head_count", F.lit(0).cast("bigint"))).alias("index")
    requests = relation.select("grp", at)
    return history.expected_at(
        requests, I.plain_input_steps(spark, sf), I.snapshots(spark, sf), I.heads(spark, sf)
    )


# ------------------------------------------------------------------- drift and plans

cte("live_rows", "SELECT grp, full_entry AS entry, payload FROM applied_log")
cte("head_rows", "SELECT grp, entry, payload FROM plain_in")
cte(
    "own_rows",
    "SELECT p.grp, p.entry, p.payload FROM plain_in p JOIN relation r USING (grp) WHERE p.idx <= r.applied_count",
)


def _live(spark: SparkSession, sf: str) -> DataFrame:
    return I.applied(spark, sf).select("grp", F.col("_full").alias("entry"), "payload")


def _expected(spark: SparkSession, sf: str, relation: DataFrame) -> DataFrame:
    """The steps' rows up to each customer's applied count."""
    placed = ordinal(I.input_entries(spark, sf), ["grp"], ["entry"], "idx")
    counts = relation.select("grp", "applied_count")
    return placed.join(counts, "grp").where(F.col("idx") <= F.col("applied_count")).select("grp", "entry", "payload")


def _differing(left: str, right: str) -> str:
    return f"""SELECT DISTINCT grp FROM ((SELECT * FROM {left} EXCEPT ALL SELECT * FROM {right}) UNION ALL (SELECT * FROM {right} EXCEPT ALL SELECT * FROM {left}))"""


@check(
    "drift",
    f"SELECT grp, applied_count AS applied_index, relation = 'ahead' OR grp IN ({_differing('live_rows', 'own_rows')}) AS drifted FROM relation",
)
def drift(spark: SparkSession, sf: str) -> DataFrame:
    relation = written(_relation(spark, sf), "relation")
    return compare.drift(_live(spark, sf), _expected(spark, sf, relation), relation)


@check(
    "drift_by_tree",
    f"SELECT grp, grp NOT IN ({_differing('live_rows', 'own_rows')}) AS matches FROM (SELECT grp FROM live_rows UNION SELECT grp FROM own_rows)",
)
def drift_by_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Live and expected states stored with their trees; only rows below differing nodes are compared."""
    relation = written(_relation(spark, sf), "relation")
    stored = []
    for state in (_live(spark, sf), _expected(spark, sf, relation).select("grp", "entry", "payload")):
        path = scratch_path(spark, "state")
        digest_tree.save(state, path)
        stored.append(digest_tree.load(spark, path, state))
    return digest_tree.equal_states(*stored).select("grp", "matches")


@check(
    "plan_summary",
    f"SELECT grp, applied_count AS applied_index, head_count AS target_index, relation <> 'ahead' AND grp NOT IN ({_differing('live_rows', 'head_rows')}) AS matches FROM relation",
)
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return compare.plan_summary(_live(spark, sf), I.input_entries(spark, sf), _relation(spark, sf))


@check("plan_rows", "SELECT h.grp, 'head' AS source, h.payload FROM heads h JOIN n_in USING (grp)")
def plan_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The expected head state itself: each customer's head snapshot."""
    steps = I.plain_input_steps(spark, sf)
    last = steps.groupBy("grp").agg(F.count("*").alias("index"))
    expected = history.expected_at(last, steps, I.snapshots(spark, sf), I.heads(spark, sf))
    return expected.where(F.col("error").isNull()).select("grp", "source", "payload")


@check(
    "plan_diff",
    """SELECT coalesce(l.grp, h.grp) AS grp, coalesce(l.entry, h.entry) AS entry, CASE WHEN l.entry IS NULL THEN 'added' WHEN h.entry IS NULL THEN 'removed' ELSE 'changed' END AS change,
      'payload' AS "column", l.payload AS old_value, h.payload AS new_value
    FROM (SELECT * FROM live_rows WHERE grp NOT IN (SELECT grp FROM relation WHERE relation = 'ahead')) l
    FULL JOIN head_rows h ON h.grp = l.grp AND h.entry = l.entry WHERE l.payload IS DISTINCT FROM h.payload""",
)
def plan_diff(spark: SparkSession, sf: str) -> DataFrame:
    return compare.plan_diff(
        _live(spark, sf), I.input_entries(spark, sf), ["grp", "entry"], _relation(spark, sf)
    )


cte(
    "ord_after",
    """SELECT o.o_orderkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_cents, o.o_day FROM ord o LEFT JOIN corrections c USING (o_orderkey)
    UNION ALL SELECT o_orderkey, o_orderstatus, o_cents, NULL FROM new_orders""",
)


KEYED_SQL = "\nUNION ALL ".join(
    f"""SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS change,
    '{c}' AS "column", CAST(o.{c} AS VARCHAR) AS old_value, CAST(n.{c} AS VARCHAR) AS new_value
    FROM ord o FULL JOIN ord_after n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR o.{c} IS DISTINCT FROM n.{c}"""
    for c in ("o_orderstatus", "o_cents", "o_day")
)


def _before_and_after(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What an upsert that names only the status does to the orders."""
    old = I.orders(spark, sf).select("o_orderkey", "o_orderstatus", "o_cents", "o_day")
    named = F.array(F.lit("o_orderkey"), F.lit("o_orderstatus"))
    rows = I.corrections(spark, sf).drop("o_custkey").withColumn("present", named)
    return old, mutate.apply_upsert(old, rows, ["o_orderkey"], missing="keep", present="present")


@check("keyed_difference", KEYED_SQL)
def keyed_difference(spark: SparkSession, sf: str) -> DataFrame:
    return compare.keyed_difference(*_before_and_after(spark, sf), ["o_orderkey"])


@check("keyed_difference_narrow_first", KEYED_SQL)
def keyed_difference_narrow_first(spark: SparkSession, sf: str) -> DataFrame:
    return compare.keyed_difference(*_before_and_after(spark, sf), ["o_orderkey"], narrow_first=True)


@check(
    "line_diff",
    """SELECT doc_id, line, CASE WHEN sum(s) > 0 THEN 'added' ELSE 'removed' END AS change, CAST(abs(sum(s)) AS BIGINT) AS copies FROM (
      SELECT doc_id, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS line, -1 AS s FROM documents
      UNION ALL SELECT doc_id, unnest(string_split(CASE WHEN ends_with(b, chr(10)) THEN b[:-2] ELSE b END, chr(10))), 1
        FROM (SELECT doc_id, replace(body, ' a ', ' the ') AS b FROM corpus)) GROUP BY doc_id, line HAVING sum(s) <> 0""",
)
def line_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against their sectioned and reworded texts."""
    old = I.table(spark, sf, "documents").select("doc_id", "text")
    new = I.corpus(spark, sf).select("doc_id", F.replace("body", F.lit(" a "), F.lit(" the ")).alias("text"))
    return compare.line_diff(old, new, ["doc_id"], "text")


@check(
    "ordered_diff",
    """SELECT d.doc_id, sha256(replace(c.body, ' a ', ' the ')) AS rebuilt_sha256, d.text IS DISTINCT FROM replace(c.body, ' a ', ' the ') AS has_hunks
    FROM documents d JOIN corpus c USING (doc_id)""",
)
def ordered_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Documents rebuilt into their sectioned and reworded texts by the hunks between them."""
    old = I.table(spark, sf, "documents").select("doc_id", "text")
    new = I.corpus(spark, sf).select("doc_id", F.replace("body", F.lit(" a "), F.lit(" the ")).alias("text"))
    hunks = written(textdiff.ordered_diff(old, new, ["doc_id"], "text"), "hunks")
    # Digested before the join, so that it shuffles no texts.
    rebuilt = textdiff.apply_hunks(old, hunks, ["doc_id"], "text").select("doc_id", F.sha2("text", 256).alias("rebuilt_sha256"))
    changed = hunks.select("doc_id").distinct().withColumn("_changed", F.lit(True))
    return rebuilt.join(changed, "doc_id", "left").select(
        "doc_id", "rebuilt_sha256", F.col("_changed").isNotNull().alias("has_hunks")
    )


@check(
    "verify_expected",
    f"""SELECT grp, entry, payload, CAST(sum(n) AS BIGINT) AS copies FROM (SELECT *, 1 AS n FROM live_rows UNION ALL SELECT *, -1 FROM own_rows) GROUP BY grp, entry, payload HAVING sum(n) <> 0""",
)
def verify_expected(spark: SparkSession, sf: str) -> DataFrame:
    """The verification passes for equal states, fails for live against expected, and for these rows."""
    relation = written(_relation(spark, sf), "relation")
    live, expected = _live(spark, sf), _expected(spark, sf, relation)
    compare.verify_expected(expected, expected, "up")
    rows = compare.multiset_difference(live, expected)
    try:
        compare.verify_expected(live, expected, "up")
    except StateError:
        return rows
    return rows.limit(0)


@check(
    "schema_gate",
    f"""SELECT grp, c, p, a, m, c AND p AND a AND m AS open FROM (SELECT r.grp, f.grp IS NULL AS c, coalesce(p.status = 'ok', true) AS p, r.relation <> 'ahead' AS a,
      r.grp NOT IN ({_differing('live_rows', 'head_rows')}) AS m FROM relation r LEFT JOIN prefix p USING (grp) LEFT JOIN (SELECT DISTINCT grp FROM f_header) f ON f.grp = r.grp)""".replace(
        "SELECT grp, c, p, a, m,", "SELECT grp, c AS is_clean, p AS prefix_ok, a AS not_ahead, m AS matches,"
    ),
)
def schema_gate(spark: SparkSession, sf: str) -> DataFrame:
    """All conditions of a data command per customer, on its ledger header findings."""
    relation = written(_relation(spark, sf), "relation")
    clean = coherence.is_clean(relation, coherence.check_header(I.stored_headers(spark, sf)))
    prefix = history.prefix_check(I.plain_input_steps(spark, sf), _applied(spark, sf))
    equal = compare.equal_states(_live(spark, sf), I.input_entries(spark, sf))
    return validate.schema_gate(clean, prefix, relation, equal)


@check(
    "ledger_gate",
    f"""SELECT grp, is_clean, prefix_ok, not_ahead, matches, is_clean AND prefix_ok AND not_ahead AND matches AS open FROM (
      SELECT r.grp, f.grp IS NULL AS is_clean, coalesce(p.status = 'ok', true) AS prefix_ok, r.relation <> 'ahead' AS not_ahead,
        r.grp NOT IN ({_differing('live_rows', 'head_rows')}) AS matches
      FROM relation r LEFT JOIN prefix p USING (grp) LEFT JOIN (SELECT DISTINCT grp FROM codes_found) f USING (grp)
      UNION ALL SELECT DISTINCT grp, false, true, true, false FROM codes_found WHERE grp NOT IN (SELECT grp FROM relation))""",
)
def ledger_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The gate of a data command from a whole ledger state."""
    findings = written(planted_state(spark, sf), "findings")
    steps = I.plain_input_steps(spark, sf)
    return dataset.ledger_gate(findings, steps, _applied(spark, sf), _live(spark, sf), I.input_entries(spark, sf))


@check(
    "plan_unblocked",
    f"""SELECT * REPLACE (coalesce(divergence_index, 0) AS divergence_index) FROM anchors
    WHERE grp NOT IN (SELECT grp FROM codes_found WHERE {FATAL} AND NOT ends_with(code, '-mismatch'))""",
)
def plan_unblocked(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors and tails of the groups that no fatal finding blocks.

    Every header here differs from the policy in some field, so those findings are left out."""
    found = planted_state(spark, sf)
    findings = written(found.where(~F.endswith("code", F.lit("-mismatch"))), "findings")
    plan = history.anchor_tail(I.plain_input_steps(spark, sf), _divergence(spark, sf), findings=findings)
    return plan.fillna(0, ["divergence_index"])
