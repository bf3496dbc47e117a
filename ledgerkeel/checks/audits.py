"""Checks of the audit rules over the document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from . import inputs as I
from .ledgers import state_findings
from .registry import check, cte

cte(
    "problems",
    """SELECT doc_id, CASE WHEN kinds[1] = 'down' THEN 'down marker before an up marker' WHEN kinds[2] = 'up' THEN 'up marker more than once'
      WHEN kinds[3] = 'up' THEN 'up marker after a down marker' WHEN kinds[3] = 'down' THEN 'down marker more than once' END AS problem, flagged FROM markers""",
)
cte(
    "r_directives",
    """SELECT grp, entry AS path, 'L001' AS code, 'error' AS level, problem AS message FROM corpus JOIN problems USING (doc_id) WHERE NOT broken AND problem IS NOT NULL""",
)
cte("r_utf8", "SELECT grp, entry AS path, 'L004' AS code, 'error' AS level, 'payload is not UTF-8' AS message FROM corpus WHERE broken")
cte(
    "r_no_up",
    """SELECT grp, entry AS path, 'L005' AS code, 'error' AS level, 'up section has no content' AS message FROM corpus JOIN contents USING (doc_id) WHERE NOT broken AND NOT up_runs""",
)
cte(
    "r_down",
    """SELECT grp, entry AS path, code, 'warning' AS level, CASE code WHEN 'L101' THEN 'no down section' WHEN 'L102' THEN 'down section has no content' ELSE 'cannot be rolled back' END AS message
    FROM (SELECT grp, entry, unnest(CASE WHEN NOT regexp_matches(down, '\\S') THEN ['L101', 'L103'] WHEN NOT down_runs THEN ['L102', 'L103'] ELSE [] END) AS code
      FROM corpus JOIN contents USING (doc_id) WHERE NOT broken)""",
)
cte(
    "r_flag",
    """SELECT grp, entry AS path, 'L106' AS code, 'warning' AS level, 'marker turns the transaction off' AS message FROM corpus JOIN problems USING (doc_id) WHERE NOT broken AND flagged""",
)
cte(
    "r_versions",
    """SELECT grp, entry AS path, 'L002' AS code, 'error' AS level, 'version ' || version || ' is already used by ' || first AS message
    FROM (SELECT *, min(entry) OVER (PARTITION BY grp, version) AS first FROM corpus) WHERE entry > first""",
)
cte(
    "r_order",
    """SELECT grp, entry AS path, 'L003' AS code, 'error' AS level, 'version ' || version || ' comes after ' || before AS message
    FROM (SELECT *, lag(version) OVER (PARTITION BY grp ORDER BY entry) AS before FROM corpus) WHERE version < before""",
)
cte(
    "r_names",
    """SELECT grp, min(entry) AS path, 'L006' AS code, 'warning' AS level, 'basename ' || base || ' is shared by '
      || count(*) || ' entries' AS message
    FROM corpus GROUP BY grp, base HAVING count(*) > 1""",
)
cte(
    "r_state",
    """SELECT grp, 'checkpoints' AS path, 'L205' AS code, 'warning' AS level, 'snapshots without a ledger' AS message FROM (SELECT DISTINCT grp FROM snaps) WHERE grp IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    UNION ALL SELECT grp, 'schema.sql', 'L206', 'error', 'head snapshot without a ledger' FROM heads WHERE grp IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
cte(
    "r_ledger",
    """SELECT grp, path, CASE WHEN code = 'input-orphan-checkpoint' THEN 'L202' WHEN code = 'input-schema-missing' THEN 'L203' WHEN starts_with(code, 'coherence-') THEN 'L204' ELSE 'L201' END AS code,
      CASE WHEN code = 'input-orphan-checkpoint' THEN 'warning' ELSE 'error' END AS level, detail AS message FROM state_found""",
)
cte(
    "r_all",
    """SELECT * FROM r_directives UNION ALL SELECT * FROM r_utf8 UNION ALL SELECT * FROM r_no_up UNION ALL SELECT * FROM r_down UNION ALL SELECT * FROM r_flag
    UNION ALL SELECT * FROM r_versions UNION ALL SELECT * FROM r_order UNION ALL SELECT * FROM r_names""",
)


@check("audit_directives", "SELECT * FROM r_directives")
def audit_directives(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_directives(I.corpus(spark, sf))


@check("audit_duplicate_versions", "SELECT * FROM r_versions")
def audit_duplicate_versions(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_duplicate_versions(I.corpus(spark, sf))


@check("audit_version_order", "SELECT * FROM r_order")
def audit_version_order(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_version_order(I.corpus(spark, sf))


@check("audit_utf8", "SELECT * FROM r_utf8")
def audit_utf8(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_utf8(I.corpus(spark, sf))


@check("audit_no_up", "SELECT * FROM r_no_up")
def audit_no_up(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_no_up(I.corpus(spark, sf))


@check("audit_basenames", "SELECT * FROM r_names")
def audit_basenames(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_basenames(I.corpus(spark, sf))


@check(
    "shared_basenames",
    "SELECT grp, base AS basename, entry AS path, first, n AS entries FROM (SELECT *, min(entry) OVER w AS first, count(*) OVER w AS n FROM corpus WINDOW w AS (PARTITION BY grp, base)) WHERE n > 1",
)
def shared_basenames(spark: SparkSession, sf: str) -> DataFrame:
    return audit.shared_basenames(I.corpus(spark, sf))


@check("audit_down", "SELECT * FROM r_down")
def audit_down(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_down(I.corpus(spark, sf))


@check("audit_flag", "SELECT * FROM r_flag")
def audit_flag(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_flag(I.corpus(spark, sf))


@check("audit_ledger", "SELECT * FROM r_ledger")
def audit_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_ledger(state_findings(spark, sf), I.stored_headers(spark, sf))


@check("audit_state", "SELECT * FROM r_state")
def audit_state(spark: SparkSession, sf: str) -> DataFrame:
    """Building customers have no ledger yet."""
    known = I.table(spark, sf, "customer").where(F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("grp"))
    return audit.audit_state(I.snapshots(spark, sf), I.heads(spark, sf), known)


@check("audit_report", "SELECT * FROM r_all")
def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_report(audit.audit_findings(I.corpus(spark, sf)))


@check(
    "audit_exit_codes",
    "SELECT grp, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings, CASE WHEN count(*) FILTER (WHERE level = 'error') > 0 THEN 1 ELSE 0 END AS exit_code FROM r_all GROUP BY grp",
)
def audit_exit_codes(spark: SparkSession, sf: str) -> DataFrame:
    return audit.exit_codes(audit.audit_findings(I.corpus(spark, sf)))
