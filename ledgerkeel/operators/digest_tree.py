"""Stored states with a digest tree, compared from the top down.

A state is stored as rows in branches and, beside them, the sums of their row numbers
(``roundtrip.row_number``) per group: one for the whole group, one per branch, one per
leaf. A row's leaf follows from its digest. Two stored states are compared by their group sums; branches
are looked at of groups that differ, leaves of branches that differ, and rows of leaves that differ, which lie in
the folders of their branch. So equal states cost a read of one row per group, and a few
differences cost a few folders, however large the states.

Sums of rows add up, so a stored tree takes additions and removals without its rows being read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rendering import json_line
from ..session import written
from .ordering import attach, dealt
from .roundtrip import row_number

BRANCHES, LEAVES = 64, 4_096
LEVELS = ("group", "branch", "leaf")
_TREE = "level string, grp {grp}, branch int, leaf int, rows bigint, digest decimal(38,0)"


@dataclass(frozen=True)
class Stored:
    """A state's rows (their own columns, _branch, _leaf) and its tree."""

    rows: DataFrame
    tree: DataFrame


def _leaf(df: DataFrame, columns: list[str]) -> Column:
    digest = F.sha2(json_line(df.select(*columns).schema), 256)
    return F.pmod(F.xxhash64(F.lit(3), digest), F.lit(LEAVES)).cast("int")


def _levels(leaves: DataFrame) -> DataFrame:
    """All three levels as rows, from the leaves."""
    leaf = leaves.select(F.lit("leaf").alias("level"), "grp", "branch", "leaf", "rows", "digest")
    return leaf.unionByName(_upper(leaves))


def _upper(leaves: DataFrame) -> DataFrame:
    """Sums per group and branch from those per leaf."""
    sums = (F.sum("rows").alias("rows"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
    none = F.lit(None).cast("int")
    branch = leaves.groupBy("grp", "branch").agg(*sums)
    group = leaves.groupBy("grp").agg(*sums)
    upper = branch.select(F.lit("branch").alias("level"), "grp", "branch", none.alias("leaf"), "rows", "digest")
    return upper.unionByName(group.select(F.lit("group").alias("level"), "grp", none.alias("branch"), none.alias("leaf"), "rows", "digest"))


def _leaf_sums(state: DataFrame, sign: int = 1) -> DataFrame:
    columns = [c for c in state.columns if c != "grp"]
    leaf = _leaf(state, columns)
    return _summed(state.select("grp", leaf.alias("leaf"), (row_number(state, columns) * sign).alias("h")), sign)


def _summed(numbered: DataFrame, sign: int) -> DataFrame:
    return numbered.groupBy("grp", "leaf").agg(
        (F.count("*") * sign).alias("rows"), F.sum("h").cast("decimal(38,0)").alias("digest")
    ).withColumn("branch", _branch_of(F.col("leaf")))


def _branch_of(leaf: Column) -> Column:
    return F.floor(leaf / (LEAVES // BRANCHES)).cast("int")


def tree(state: DataFrame) -> DataFrame:
    """DataFrame[level, grp, branch, leaf, rows, digest] of a state with a column ``grp``."""
    return _levels(_leaf_sums(state))


def changed_tree(stored: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The tree after rows came and went; ``removed`` must be rows of the state."""
    leaves = stored.where(F.col("level") == "leaf").select("grp", "leaf", "rows", "digest", "branch")
    every = leaves.unionByName(_leaf_sums(added)).unionByName(_leaf_sums(removed, -1))
    summed = every.groupBy("grp", "branch", "leaf").agg(
        F.sum("rows").alias("rows"), F.sum("digest").cast("decimal(38,0)").alias("digest")
    )
    return _levels(summed.where((F.col("rows") != 0) | (F.col("digest") != 0)))


def save(state: DataFrame, path: str) -> None:
    """Write the rows in a folder per branch and the tree in a folder per level.

    The state is computed once, with the rows' numbers; leaves come from the written rows, upper levels from the leaves.
    """
    columns = [c for c in state.columns if c != "grp"]
    placed = state.withColumns({"_leaf": _leaf(state, columns), "_h": row_number(state, columns)})
    placed = written(placed.withColumn("_branch", _branch_of(F.col("_leaf"))), "state")
    total = placed.count()
    # Spread by leaf and group: a branch or group may hold very many rows, a leaf of a group few.
    spread = dealt(placed.drop("_h"), ["_leaf", "grp"], total, always=True).sortWithinPartitions("_branch", "grp")
    spread.write.partitionBy("_branch").parquet(f"{path}/rows")
    sums = _summed(placed.select("grp", F.col("_leaf").alias("leaf"), F.col("_h").alias("h")), 1)
    lowest = f"{path}/tree/level=leaf"
    sums.select("grp", "branch", "leaf", "rows", "digest").write.parquet(lowest)
    leaves = state.sparkSession.read.schema(sums.schema).parquet(lowest)
    _upper(leaves).write.mode("append").partitionBy("level").parquet(f"{path}/tree")


def load(spark: SparkSession, path: str, state: DataFrame) -> Stored:
    """The stored state at ``path``; ``state`` (any frame) gives the columns and types."""
    rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
    sums = _TREE.format(grp=state.schema["grp"].dataType.simpleString())
    return Stored(
        spark.read.schema(f"{rows}, _leaf int, _branch int").parquet(f"{path}/rows"),
        spark.read.schema(sums).parquet(f"{path}/tree"),
    )


def _uneven(one: DataFrame, other: DataFrame, level: str, below: DataFrame | None) -> DataFrame:
    """Nodes of a level whose sums differ, below the nodes given."""
    keys = {"group": ["grp"], "branch": ["grp", "branch"], "leaf": ["grp", "branch", "leaf"]}[level]
    signed = None
    for stored, sign in ((one, 1), (other, -1)):
        nodes = stored.where(F.col("level") == level).select(*keys, (F.col("rows") * sign).alias("rows"), (F.col("digest") * sign).alias("digest"))
        if below is not None:
            over = [c for c in below.columns]
            nodes = attach(nodes, below.withColumn("_over", F.lit(True)), over, ["_over"], "inner").drop("_over")
        signed = nodes if signed is None else signed.unionByName(nodes)
    summed = signed.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))
    return summed.where((F.col("rows") != 0) | (F.col("digest") != 0)).select(*keys)


def differing_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """DataFrame[grp, branch, leaf] where two trees differ, found level by level."""
    groups = _uneven(one, other, "group", None)
    branches = _uneven(one, other, "branch", groups)
    return _uneven(one, other, "leaf", branches)


def equal_states(live: Stored, expected: Stored) -> DataFrame:
    """``compare.equal_states`` of two stored states: rows are read of branches that differ only.

    DataFrame[grp, missing_rows, extra_rows, matches] over the groups of either side. The
    branches to read, at most ``BRANCHES`` numbers, come to the driver and prune the folders.
    """
    from .compare import equal_states as compared

    roots = [s.tree.where(F.col("level") == "group").select("grp") for s in (live, expected)]
    groups = roots[0].unionByName(roots[1]).distinct()
    leaves = differing_leaves(live.tree, expected.tree)
    listed = sorted(r["branch"] for r in leaves.select("branch").distinct().collect())
    wanted = leaves.select("grp", F.col("leaf").alias("_leaf")).withColumn("_wanted", F.lit(True))

    def part(stored: Stored) -> DataFrame:
        own = stored.rows.where(F.col("_branch").isin(listed) if listed else F.lit(False))
        own = attach(own, wanted, ["grp", "_leaf"], ["_wanted"], "inner")
        return own.drop("_leaf", "_branch", "_wanted")

    if not listed:
        found = groups.select("grp", *[F.lit(0).cast("bigint").alias(c) for c in ("missing_rows", "extra_rows")])
        return found.withColumn("matches", F.lit(True))
    differing = compared(part(live), part(expected))
    zero = F.lit(0).cast("bigint")
    return attach(groups, differing, ["grp"], ["missing_rows", "extra_rows", "matches"]).select(
        "grp",
        F.coalesce("missing_rows", zero).alias("missing_rows"),
        F.coalesce("extra_rows", zero).alias("extra_rows"),
        F.coalesce("matches", F.lit(True)).alias("matches"),
    )
