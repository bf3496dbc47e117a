"""Audit findings over a corpus of sectioned texts.

``corpus`` is grp, entry, payload (string or binary). Findings are DataFrame
[grp, path, code, level, message]. The content rules share one pass without a
shuffle; the path rules read only grp and entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entries import basename, version_of
from ..functions.sections import (
    section_has_content,
    is_blank,
    split_sections,
    valid_text,
)
from ..session import written
from . import findings as codes
from .mutate import union_all
from .ordering import HOT_ROWS, attach, previous_value, repeats

# Levels of the audit rules.
LEVELS = {
    "L001": "error",
    "L002": "error",
    "L003": "error",
    "L004": "error",
    "L005": "error",
    "L006": "warning",
    "L101": "warning",
    "L102": "warning",
    "L103": "warning",
    "L106": "warning",
    "L201": "error",
    "L202": "warning",
    "L203": "error",
    "L204": "error",
    "L205": "warning",
    "L206": "error",
}

FINDING_COLUMNS = ("grp", "path", "code", "level", "message")


def _rule(failed: Column, code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(
        failed,
        F.struct(F.lit(code).alias("code"), F.lit(LEVELS[code]).alias("level"), text.alias("message")),
    )


def directive_problem(kinds: Column) -> Column:
    """First problem of a marker sequence, null when it is up, or up then down.

    A good sequence is at most two markers long, so the first three decide.
    """
    first, second, third = (F.get(kinds, F.lit(i)) for i in range(3))
    return (
        F.when(first == "down", F.lit("down marker before an up marker"))
        .when(second == "up", F.lit("up marker more than once"))
        .when(third == "up", F.lit("up marker after a down marker"))
        .when(third == "down", F.lit("down marker more than once"))
    )


def content_findings(corpus: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """L001, L004, L005, L101-L103 and L106 in one pass over the texts."""
    texts = corpus.select("grp", F.col("entry").alias("path"), valid_text(F.col("payload")).alias("_text"))
    marked = split_sections(texts, "_text", "_up", "_down", "_kinds", "_flagged").withColumns(
        {
            "_problem": directive_problem(F.col("_kinds")),
            "_down_blank": is_blank(F.col("_down")),
            "_down_runs": section_has_content(F.col("_down")),
        }
    )
    readable = F.col("_text").isNotNull()
    blank, runs = F.col("_down_blank"), F.col("_down_runs")
    checks = {
        "L004": [_rule(~readable, "L004", "payload is not UTF-8")],
        "L001": [_rule(F.col("_problem").isNotNull(), "L001", F.col("_problem"))],
        "L106": [_rule(F.col("_flagged"), "L106", "marker turns the transaction off")],
        "L005": [_rule(readable & ~section_has_content(F.col("_up")), "L005", "up section has no content")],
        "L101": [_rule(readable & blank, "L101", "no down section")],
        "L102": [_rule(readable & ~blank & ~runs, "L102", "down section has no content")],
        "L103": [_rule(readable & (blank | ~runs), "L103", "cannot be rolled back")],
    }
    chosen = [check for code, cs in checks.items() if rules is None or code in rules for check in cs]
    return marked.select("grp", "path", F.inline(F.array_compact(F.array(*chosen)))).select(*FINDING_COLUMNS)


def audit_directives(corpus: DataFrame) -> DataFrame:
    return content_findings(corpus, ("L001",))


def audit_utf8(corpus: DataFrame) -> DataFrame:
    return content_findings(corpus, ("L004",))


def audit_no_up(corpus: DataFrame) -> DataFrame:
    return content_findings(corpus, ("L005",))


def audit_down(corpus: DataFrame) -> DataFrame:
    return content_findings(corpus, ("L101", "L102", "L103"))


def audit_flag(corpus: DataFrame) -> DataFrame:
    return content_findings(corpus, ("L106",))


def _found(df: DataFrame, code: str, message: Column) -> DataFrame:
    return df.select(
        "grp",
        "path",
        F.lit(code).alias("code"),
        F.lit(LEVELS[code]).alias("level"),
        message.alias("message"),
    )


def _versions(corpus: DataFrame) -> DataFrame:
    return corpus.select("grp", F.col("entry").alias("path"), version_of(F.col("entry")).alias("version"))


def audit_duplicate_versions(corpus: DataFrame) -> DataFrame:
    """L002 on every entry whose version an earlier path already uses."""
    versions = repeats(_versions(corpus), ["grp", "version"], "path", "first")
    message = F.concat(F.lit("version "), F.col("version"), F.lit(" is already used by "), F.col("first"))
    return _found(versions, "L002", message)


def audit_version_order(corpus: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """L003 where the version sorts before that of the previous path."""
    placed = previous_value(_versions(corpus), ["grp"], ["path"], "version", "before", hot_rows)
    wrong = placed.where((F.col("before") != "") & (F.col("version") < F.col("before")))
    message = F.concat(F.lit("version "), F.col("version"), F.lit(" comes after "), F.col("before"))
    return _found(wrong, "L003", message)


def shared_basenames(corpus: DataFrame) -> DataFrame:
    """All members of a shared basename: DataFrame[grp, basename, path, first, entries]."""
    names = corpus.select("grp", F.col("entry").alias("path"), basename(F.col("entry")).alias("basename"))
    groups = (
        names.groupBy("grp", "basename")
        .agg(F.count("*").alias("entries"), F.min("path").alias("first"))
        .where(F.col("entries") > 1)
    )
    return attach(names, groups, ["grp", "basename"], ["first", "entries"], "inner")


def audit_basenames(corpus: DataFrame) -> DataFrame:
    """L006 once per shared basename, at its first path, with the number of entries.

    ``shared_basenames`` has every member as a row, whatever the size of the group.
    """
    names = corpus.groupBy("grp", basename(F.col("entry")).alias("basename")).agg(
        F.count("*").alias("entries"), F.min("entry").alias("path")
    )
    message = F.concat(
        F.lit("basename "), F.col("basename"), F.lit(" is shared by "), F.col("entries").cast("string"), F.lit(" entries")
    )
    return _found(names.where(F.col("entries") > 1), "L006", message)


def audit_ledger(found: DataFrame, headers: DataFrame) -> DataFrame:
    """L201-L204 from the findings of a ledger state.

    Only a missing head depends on whether its group has a ledger, so only those findings meet the
    headers. All are written once before, so that the state's rules are not applied for either part.
    """
    has_ledger = headers.select("grp").distinct().withColumn("_has", F.lit(True))
    found = written(found.select("grp", "code", "path", "detail"), "state-findings")
    headless = F.col("code").eqNullSafe(F.lit(codes.INPUT_SCHEMA_MISSING))
    others = found.where(~headless).withColumn("_has", F.lit(None).cast("boolean"))
    joined = found.where(headless).join(has_ledger, "grp", "left").unionByName(others)
    code = (
        F.when(F.col("code") == codes.INPUT_ORPHAN_CHECKPOINT, F.lit("L202"))
        .when((F.col("code") == codes.INPUT_SCHEMA_MISSING) & F.col("_has"), F.lit("L203"))
        .when(F.startswith(F.col("code"), F.lit(codes.COHERENCE_PREFIX)), F.lit("L204"))
        .otherwise(F.lit("L201"))
    )
    level = F.when(code == "L202", F.lit(LEVELS["L202"])).otherwise(F.lit(LEVELS["L201"]))
    return joined.select(
        "grp", "path", code.alias("code"), level.alias("level"), F.col("detail").alias("message")
    )


def audit_state(
    snapshots: DataFrame,
    heads: DataFrame,
    headers: DataFrame,
    snapshot_dir: str = "checkpoints",
    schema_file: str = "schema.sql",
) -> DataFrame:
    """L205 and L206: snapshots or a head snapshot in a group without a ledger."""
    known = headers.select("grp")

    def orphaned(df: DataFrame, path: str) -> DataFrame:
        groups = df.select("grp").distinct().join(known, "grp", "left_anti")
        return groups.withColumn("path", F.lit(path))

    return _found(
        orphaned(snapshots, snapshot_dir), "L205", F.lit("snapshots without a ledger")
    ).unionByName(_found(orphaned(heads, schema_file), "L206", F.lit("head snapshot without a ledger")))


def audit_findings(corpus: DataFrame, *others: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All corpus rules, with any ledger or state findings added."""
    return union_all(
        [
            content_findings(corpus),
            audit_duplicate_versions(corpus),
            audit_version_order(corpus, hot_rows),
            audit_basenames(corpus),
            *others,
        ]
    )


def audit_report(found: DataFrame) -> DataFrame:
    """Findings in report order: by group, path, code and message.

    A global sort first samples its input. The findings are written once before,
    so the texts are read once and not a second time for the sample.
    """
    return written(found.select(*FINDING_COLUMNS), "findings").orderBy("grp", "path", "code", "message")


def exit_codes(found: DataFrame) -> DataFrame:
    """DataFrame[grp, errors, warnings, exit_code] of groups that have findings."""
    errors = F.count_if(F.col("level") == "error")
    return found.groupBy("grp").agg(
        errors.alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
        F.when(errors > 0, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
    )
