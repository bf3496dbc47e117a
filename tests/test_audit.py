"""Audit rules on literal corpora."""

import pytest

from ledgerkeel.operators import audit
from ledgerkeel.operators import findings as codes

CORPUS = "grp string, entry string, payload binary"
GOOD = b"-- migrate:up\ncreate x;\n-- migrate:down\ndrop x;\n"


def corpus(spark, *data):
    return spark.createDataFrame([("g", f"migrations/{n}", p) for n, p in data], CORPUS)


@pytest.mark.parametrize(
    "payload,expected",
    [
        (GOOD, []),
        (b"create x;", ["L101", "L103"]),
        (b"-- migrate:up\n-- only\n-- migrate:down\n/* no */", ["L005", "L102", "L103"]),
        (b"-- migrate:up transaction:false\nx\n-- migrate:down\ny", ["L106"]),
        (b"-- migrate:down\ny\n-- migrate:up\nx", ["L001"]),
        (b"-- migrate:up\nx\n-- migrate:up\ny\n-- migrate:down\nz", ["L001"]),
        (b"-- migrate:up\nx\n-- migrate:down\ny\n-- migrate:down\nz", ["L001"]),
        (b"\xff", ["L004"]),
        (b"", ["L005", "L101", "L103"]),
    ],
)
def test_content_rules(spark, payload, expected):
    found = audit.content_findings(corpus(spark, ("1_a.sql", payload)))
    assert sorted(r["code"] for r in found.collect()) == expected


@pytest.mark.parametrize(
    "kinds,words",
    [("d", "before an up"), ("uu", "up marker more than once"), ("udu", "after a down"), ("udd", "down marker more than once")],
)
def test_first_directive_problem(spark, kinds, words):
    lines = {"u": "-- migrate:up", "d": "-- migrate:down"}
    text = "\n".join(lines[k] for k in kinds).encode()
    assert words in audit.audit_directives(corpus(spark, ("1.sql", text))).first()["message"]


@pytest.mark.parametrize("hot_rows", [2, 10**6])
def test_path_rules(spark, rows, hot_rows):
    names = ["a/001_x.sql", "a/003_x.sql", "b/001_y.sql", "b/002_x.sql", "c/001_y.sql", "c/004_z.sql"]
    found = audit.audit_findings(corpus(spark, *[(n, GOOD) for n in names]), hot_rows=hot_rows)
    assert rows(found, "code", "path") == sorted(
        [
            ("L002", "migrations/b/001_y.sql"), ("L002", "migrations/c/001_y.sql"),
            ("L003", "migrations/b/001_y.sql"), ("L003", "migrations/c/001_y.sql"),
            ("L006", "migrations/b/001_y.sql"),
        ]
    )
    shared = found.where("code = 'L006'").first()["message"]
    assert shared.endswith("is shared by 2 entries")


def test_large_basename_group(spark):
    many = [(f"d{i:03d}/1.sql", GOOD) for i in range(70)]
    df = corpus(spark, *many)
    row = audit.audit_basenames(df).collect()
    assert len(row) == 1 and row[0]["path"] == "migrations/d000/1.sql" and "70 entries" in row[0]["message"]
    assert audit.shared_basenames(df).count() == len(many)


def test_ledger_and_state_rules(spark, rows):
    data = [
        ("g", codes.INPUT_ORPHAN_CHECKPOINT, "c", ""), ("g", codes.INPUT_SCHEMA_MISSING, "s", ""), ("h", codes.INPUT_SCHEMA_MISSING, "s", ""),
        ("g", codes.COHERENCE_NEW_IN_INPUT, "m", ""), ("g", codes.LOCKFILE_VERSION_MISMATCH, "l", ""),
    ]
    found = spark.createDataFrame(data, "grp string, code string, path string, detail string")
    headers = spark.createDataFrame([("g",)], "grp string")
    got = audit.audit_ledger(found, headers)
    assert rows(got, "grp", "code", "level") == [
        ("g", "L201", "error"), ("g", "L202", "warning"), ("g", "L203", "error"), ("g", "L204", "error"), ("h", "L201", "error"),
    ]
    frame = spark.createDataFrame([("g",), ("h",)], "grp string")
    assert rows(audit.audit_state(frame, frame, headers), "grp", "code") == [("h", "L205"), ("h", "L206")]


def test_only_missing_heads_meet_the_headers(spark):
    """However many groups there are, findings that need no header are neither shuffled nor sorted."""
    code = f"if(id % 10 = 0, '{codes.INPUT_SCHEMA_MISSING}', '{codes.COHERENCE_NEW_IN_INPUT}') AS code"
    found = spark.range(100).selectExpr("id AS grp", code, "'p' AS path", "'d' AS detail")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = audit.audit_ledger(found, spark.range(50).selectExpr("id AS grp"))
        dealt = got._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[1]
        assert f"<=> {codes.INPUT_SCHEMA_MISSING})" in dealt.splitlines()[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r.code: r["count"] for r in got.groupBy("code").count().collect()} == {"L201": 5, "L203": 5, "L204": 90}


def test_report_order_and_exit(spark, rows):
    found = audit.audit_findings(corpus(spark, ("2_b.sql", b"x"), ("1_a.sql", b"\xff")))
    report = audit.audit_report(found).collect()
    assert [(r["path"], r["code"]) for r in report] == [
        ("migrations/1_a.sql", "L004"), ("migrations/2_b.sql", "L101"), ("migrations/2_b.sql", "L103"),
    ]
    assert rows(audit.exit_codes(found)) == [("g", 1, 2, 1)]
    assert rows(audit.exit_codes(found.where("level = 'warning'"))) == [("g", 0, 2, 0)]
