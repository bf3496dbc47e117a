"""Ordered line differences: hunks that turn one text into another.

Lines that occur exactly once in the old and once in the new text of a key are anchors. The
longest run of anchors whose places rise on both sides is kept; it cuts both texts into
gaps, and in each gap the equal lines at its two ends are kept as well. What is left of a gap
is one hunk. Both texts of a key are dealt by key once; anchors come from an aggregate over their
lines, gaps and their ends from windows, all where the texts lie. Only the run of anchors, a sequence
by nature, is found in Python, from the places of lines without any text.

A key is one text on each side, which Spark holds in one row, so no key has more lines than a row can have.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Bytes of text a task takes, about, of texts that are dealt by key.
TASK_BYTES = 64 << 20


def rising_run(places: list[int]) -> list[int]:
    """Positions of a longest strictly rising run, found with one ordered pile top per length."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(places)
    for i, place in enumerate(places):
        pile = bisect_left(tops, place)
        if pile == len(tops):
            tops.append(place)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = place, i
        before[i] = top_at[pile - 1] if pile else -1
    run, at = [], top_at[-1] if top_at else -1
    while at >= 0:
        run.append(at)
        at = before[at]
    return run[::-1]


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _on_rising_run(places: pd.Series) -> pd.Series:
    def flags(found) -> list[bool]:
        run = set(rising_run(found.tolist()))
        return [i in run for i in range(len(found))]

    return places.map(flags)


def _lines(text: str) -> Column:
    """The lines of a text; one without content has none.

    A line ends with the newline that follows it, so a missing last one is a difference.
    """
    return F.filter(F.split(F.col(text), "(?<=\n)"), lambda p: p != "")


def _dealt(keyed: DataFrame, size: int) -> DataFrame:
    """``keyed`` dealt by key over as many tasks as ``size`` bytes of text need; few stay as the session deals them."""
    parts = -(-size // TASK_BYTES)
    if parts <= int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return keyed
    return keyed.repartition(parts, "_key")


def _numbered(text: str, side: int) -> Column:
    return F.transform(
        _lines(text),
        lambda line, i: F.struct(F.lit(side).alias("side"), (i + 1).cast("bigint").alias("n"), line.alias("line")),
    )


def _anchors(pairs: DataFrame) -> DataFrame:
    """DataFrame[_key, _run]: the anchors (old, new) of a key in order, laid where ``pairs`` lie."""
    lines = pairs.select("_key", F.inline(F.concat(_numbered("_0", 0), _numbered("_1", 1))))
    places = [F.when(F.col("side") == side, F.col("n")) for side in (0, 1)]
    once = (
        lines.groupBy("_key", F.unhex(F.md5("line")).alias("_digest"))
        .agg(
            *[F.count(n).alias(f"_n{side}") for side, n in enumerate(places)],
            F.max(places[0]).alias("old"), F.max(places[1]).alias("new"),
        )
        .where((F.col("_n0") == 1) & (F.col("_n1") == 1))
    )
    found = once.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("old", "new"))).alias("found"))
    flagged = F.arrays_zip("found", _on_rising_run(F.col("found.new")).alias("kept"))
    return found.select("_key", F.transform(F.filter(flagged, lambda x: x["kept"]), lambda x: x["found"]).alias("_run"))


def _in_gaps(pairs: DataFrame) -> DataFrame:
    """Lines that are no anchors: DataFrame[_key, side, n, line, gap, offset, _old, _new].

    A gap's number is that of anchors before it, ``_old`` and ``_new`` are the places of the last of them.
    """
    joined = pairs.join(_anchors(pairs), "_key", "left")
    run = F.coalesce("_run", F.array().cast(joined.schema["_run"].dataType))
    none = F.lit(None).cast("bigint")

    def row(side: Column, n: Column, is_line: bool, old: Column, new: Column, line: Column) -> Column:
        values = {"side": side, "n": n, "is_line": F.lit(is_line), "_old": old, "_new": new, "line": line}
        return F.struct(*[value.alias(name) for name, value in values.items()])

    marks = [
        F.transform(run, lambda x: row(F.lit(side), x[own], False, x["old"], x["new"], F.lit(None).cast("string")))
        for side, own in enumerate(("old", "new"))
    ]
    lines = [F.transform(_numbered(f"_{side}", side), lambda x: row(x["side"], x["n"], True, none, none, x["line"])) for side in (0, 1)]
    # The mark of an anchor comes just before its line, so what is known of the marks so far places every line.
    sofar = Window.partitionBy("_key", "side").orderBy("n", "is_line").rowsBetween(Window.unboundedPreceding, 0)
    known = {"gap": F.count("_old").over(sofar), "_old": F.max("_old").over(sofar), "_new": F.max("_new").over(sofar)}
    placed = joined.select("_key", F.inline(F.concat(*marks, *lines))).withColumns(known)
    last = F.when(F.col("side") == 0, F.col("_old")).otherwise(F.col("_new"))
    between = placed.where(F.col("is_line") & ~F.col("n").eqNullSafe(last))
    return between.select("_key", "side", "n", "line", "gap", (F.col("n") - F.coalesce(last, F.lit(0))).alias("offset"), "_old", "_new")


def ordered_diff(old: DataFrame, new: DataFrame, key: list[str], text: str) -> DataFrame:
    """DataFrame[*key, hunk, old_start, new_start, removed, added], hunks of a key numbered from 1 in order.

    ``removed`` and ``added`` are arrays of lines with their newlines; the removed ones stand in the old text from
    line ``old_start`` on and the added ones in the new from ``new_start`` on (1-based; of an empty
    array, the line it stands before). Keys must be unique on each side; a text that one side lacks
    or has as null counts as empty there. Texts that are equal are not looked at beyond their digest.
    """
    sides = [df.select(_key_of(key), F.coalesce(text, F.lit("")).alias(f"_{s}")) for s, df in enumerate((old, new))]
    # Only digests of all texts are shuffled, then the texts that differ, once.
    signed = [
        df.select(
            "_key", F.xxhash64(f"_{s}").alias("_a"), F.md5(f"_{s}").alias("_b"),
            F.octet_length(f"_{s}").alias("_size"), F.lit(1 - 2 * s).alias("_s"),
        )
        for s, df in enumerate(sides)
    ]
    uneven = signed[0].unionByName(signed[1]).groupBy("_key", "_a", "_b", "_size").agg(F.sum("_s").alias("_s")).where(F.col("_s") != 0)
    found = written(uneven.groupBy("_key").agg(F.sum("_size").alias("_size")), "differing")
    differing = _dealt(found.select("_key"), found.agg(F.sum("_size")).first()[0] or 0)
    pairs = differing
    for df in sides:
        pairs = pairs.join(df.join(differing, "_key", "left_semi"), "_key", "left")
    pairs = pairs.select("_key", *[F.coalesce(c, F.lit("")).alias(c) for c in ("_0", "_1")])

    # Offsets from the start, and from the end: the first unequal one on each bounds the equal ends.
    of_gap = Window.partitionBy("_key", "gap")

    def first_unequal(at: str) -> Column:
        same = Window.partitionBy("_key", "gap", at)
        unequal = (F.count("*").over(same) < 2) | (F.min("line").over(same) != F.max("line").over(same))
        return F.when(unequal, F.col(at))

    size = F.when(F.col("side") == 0, F.col("_olds")).otherwise(F.col("_news"))
    shorter = F.least("_olds", "_news")
    lines = _in_gaps(pairs).withColumn("_head", first_unequal("offset"))
    lines = lines.withColumns(
        {
            "_olds": F.count(F.when(F.col("side") == 0, 1)).over(of_gap),
            "_news": F.count(F.when(F.col("side") == 1, 1)).over(of_gap),
            "_head": F.min("_head").over(of_gap) - 1,
        }
    )
    lines = lines.withColumns({"_head": F.least(F.coalesce("_head", shorter), shorter), "back": size - F.col("offset") + 1})
    lines = lines.withColumn("_foot", first_unequal("back")).withColumn("_foot", F.min("_foot").over(of_gap) - 1)
    foot = F.least(F.coalesce("_foot", shorter), shorter - F.col("_head"))
    changed = lines.where((F.col("offset") > F.col("_head")) & (F.col("back") > foot))
    line = F.struct("n", "line")
    hunks = changed.groupBy("_key", "gap").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == s, line))).alias(f"_{s}") for s in (0, 1)],
        *[F.max(F.coalesce(c, F.lit(0)) + F.col("_head") + 1).alias(f"{c}_start") for c in ("_old", "_new")],
    )
    order = Window.partitionBy("_key").orderBy("gap")
    return hunks.select(
        *[F.col("_key")[i].alias(k) for i, k in _fields(key)],
        F.row_number().over(order).cast("bigint").alias("hunk"),
        F.col("_old_start").alias("old_start"),
        F.col("_new_start").alias("new_start"),
        F.transform("_0", lambda x: x["line"]).alias("removed"),
        F.transform("_1", lambda x: x["line"]).alias("added"),
    )


def _fields(key: list[str]) -> list[tuple[str, str]]:
    return [(f"_of_{i}", k) for i, k in enumerate(key)]


def _key_of(key: list[str]) -> Column:
    """The key as one struct: never null, so that a plain equality, which meets rows dealt by it as they lie, takes null keys too."""
    return F.struct(*[F.col(k).alias(field) for field, k in _fields(key)]).alias("_key")


def apply_hunks(old: DataFrame, hunks: DataFrame, key: list[str], text: str) -> DataFrame:
    """``old`` with its text changed by the hunks of its key; hunks of other keys are passed over.

    A hunk whose removed lines do not stand where it says fails the job.
    """
    rows = F.array_sort(F.collect_list(F.struct("hunk", "old_start", "removed", "added"))).alias("_hunks")
    size = old.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    own = _dealt(hunks.withColumn("_key", _key_of(key)), size).groupBy("_key").agg(rows)
    joined = old.withColumn("_key", _key_of(key)).join(own, "_key", "left")
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), "(?<=\n)"), lambda p: p != "")
    lines = joined.withColumn("_lines", pieces)
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def change(state, hunk):
        size = F.size(hunk["removed"]).cast("bigint")
        kept = F.slice("_lines", state["at"].cast("int"), (hunk["old_start"] - state["at"]).cast("int"))
        there = F.slice("_lines", hunk["old_start"].cast("int"), size.cast("int"))
        wrong = F.raise_error(F.concat(F.lit("hunk does not fit at line "), hunk["old_start"].cast("string")))
        added = F.when(there == hunk["removed"], hunk["added"]).otherwise(wrong.cast("array<string>"))
        return F.struct((hunk["old_start"] + size).alias("at"), F.concat(state["out"], kept, added).alias("out"))

    def finish(state):
        return F.array_join(F.concat(state["out"], F.slice("_lines", state["at"].cast("int"), F.size("_lines") + 1)), "")

    done = F.aggregate(F.coalesce("_hunks", F.array().cast(lines.schema["_hunks"].dataType)), start, change, finish)
    return lines.select(*[F.when(F.col("_hunks").isNull(), F.col(c)).otherwise(done).alias(c) if c == text else F.col(c) for c in old.columns])
