"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source gets a target (its weighted share of all words, at most
``max_repeats`` times its own words). Documents of a source lie in a random but
reproducible order, the hash order; equal slices of that order are its blocks.
A source's quota is the exact number of blocks its target needs: whole passes
over all blocks, then the blocks up to the last document that still fits (and one
more document close behind, if it brings the source nearer to its target). The tree starts with all quotas at the root and halves the output
shards at every level: the left half's quota vector is a multivariate
hypergeometric draw, the right half gets the rest. So every leaf (shard) knows
how many blocks of each source it holds, exactly, and those are disjoint ranges
of a permutation of the source's draws. In a shard, rows are in hash order.

Row counts decide nothing but sizes of metadata: one row per source, shards x
sources for the tree, one row per block for the draws. Documents themselves are
joined to their block once, and are shuffled only if the blocks are too many to
broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, held, whole, written

#: Bits of the hash order, and of each step of the search for the last document taken.
ORDER_BITS, STEP_BITS = 62, 12
#: A document above this part of what a broken pass takes is left out of that pass, unless
#: the others are not enough: one document must not decide how near a source comes.
SMALL = 10
#: A prime above any number of block draws, so that multiplying by it permutes them.
PRIME = 4_294_967_291


def word_size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _key(source: Column) -> list[Column]:
    return [source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key")]


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Add ``idx``, ``weight`` and ``target`` to rows (no_source, source_key, source_size, ...).

    Sources by code point, null last, take the weights in turn and share the words
    of all sources. Where a share is above the limit, the excess is dealt again by
    weight to the others: shares are ``level * weight`` up to the limit, and the
    level is found by passing the sources in the order in which they reach it.
    One row per source, so the unpartitioned windows see the recipe only.
    """
    by_code = Window.orderBy("no_source", "source_key")
    by_limit = Window.orderBy("ratio", "idx")
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("idx", (F.row_number().over(by_code) - 1).cast("long"))
    ranked = (
        ranked.withColumn("weight", F.element_at(cycle, (F.col("idx") % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
    )
    before = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level_here", (F.col("total") - before) / rest)
    reached = F.when(F.col("ratio") >= F.col("level_here"), F.struct("ratio", "idx", "level_here"))
    level = F.min(reached).over(everything)["level_here"]
    return ranked.withColumn("target", F.least("limit", level * F.col("weight"))).drop(
        "limit", "ratio", "total", "level_here"
    )


def _block(order: Column, blocks: Column) -> Column:
    """The slice of the hash order, of ``blocks`` equal ones, that a position lies in."""
    high = F.shiftrightunsigned(order, ORDER_BITS - 30)
    return F.shiftrightunsigned(high * blocks, 30)


def _cuts(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """The last position each source's broken pass takes: (idx, cut, gap), -1 for none.

    A radix search: words per slot of 4096, then the slot in which the target is
    reached is opened again, so no window sees more than 4096 rows of a source
    before the last step. Documents are taken as long as they fit; ``gap`` is what is then
    left of the target.
    """
    open_slots = sources.where("rest > 0").select("idx", "rest", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("slot"))
    shift = ORDER_BITS
    for _ in range(2):
        parent = F.shiftrightunsigned("order", shift)
        shift -= STEP_BITS
        inside = (
            rows.join(bounded(open_slots, n_sources), "idx")
            .where(parent == F.col("slot"))
            .select("idx", "order", "size", "rest", "base")
        )
        slots = inside.groupBy("idx", "rest", "base", F.shiftrightunsigned("order", shift).alias("slot")).agg(
            F.sum("size").alias("sum")
        )
        run = Window.partitionBy("idx").orderBy("slot")
        slots = slots.withColumn("upto", F.col("base") + F.sum("sum").over(run))
        open_slots = (
            slots.where("upto > rest")
            .groupBy("idx", "rest")
            .agg(F.min(F.struct("slot", (F.col("upto") - F.col("sum")).alias("base"))).alias("first"))
            .select("idx", "rest", "first.base", "first.slot")
        )
        open_slots = written(open_slots, "mix-slots")
    low = shift
    last = (
        rows.join(bounded(open_slots, n_sources), "idx")
        .where(F.shiftrightunsigned("order", low) == F.col("slot"))
        .groupBy("idx", "rest", "base", "slot", "order")
        .agg(F.sum("size").alias("sum"))
    )
    run = Window.partitionBy("idx").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.col("base") + F.sum("sum").over(run)).withColumn("taken", F.col("upto") <= F.col("rest"))
    return (
        last.groupBy("idx", "rest")
        .agg(
            F.max(F.when(F.col("taken"), F.struct("order", "upto"))).alias("cut"),
            F.min(F.struct((F.shiftleft("slot", low) - 1).alias("order"), F.col("base").alias("upto"))).alias("none"),
        )
        .withColumn("cut", F.coalesce("cut", "none"))
        .select("idx", F.col("cut.order").alias("cut"), (F.col("rest") - F.col("cut.upto")).alias("gap"))
    )


def _fillers(rows: DataFrame, cuts: DataFrame, n_sources: int) -> DataFrame:
    """The place after the cut, up to the end of the next block, that fills the gap best: (idx, extra).

    Documents in one place are taken together, so it is their sum that is held against the
    gap. -1 where none brings the source nearer to its target.
    """
    side = bounded(cuts.where("gap > 0").select("idx", "cut", "gap", "n_blocks"), n_sources)
    block = _block(F.col("order"), F.col("n_blocks"))
    near = block <= F.when(F.col("cut") < 0, 0).otherwise(_block(F.col("cut"), F.col("n_blocks"))) + 1
    places = rows.join(side, "idx").where((F.col("order") > F.col("cut")) & near).groupBy("idx", "gap", "order")
    off = F.abs(F.col("size") - F.col("gap"))
    return (
        places.agg(F.sum("size").alias("size"))
        .where(off < F.col("gap"))
        .groupBy("idx")
        .agg(F.min(F.struct(off.alias("off"), "order"))["order"].alias("extra"))
    )


_LOG_FACTORIAL = (
    "CASE WHEN {x} < 20 THEN ln(factorial(CAST({x} AS INT))) ELSE ({x} + 0.5D) * ln({x}) - {x} "
    "+ 0.9189385332046727D + 1D / (12 * {x}) - 1D / (360D * {x} * {x} * {x}) END"
)


def _lf(x: str) -> str:
    return "(" + _LOG_FACTORIAL.format(x=f"({x})") + ")"


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL of one hypergeometric draw by inversion of the distribution.

    How many of ``drawn`` items, out of ``total`` of which ``marked`` are marked, are
    marked. Values over ten standard deviations from the mean are left out; their
    weight is below the resolution of a double.
    """
    mean = f"({drawn} * CAST({marked} AS DOUBLE) / greatest({total}, 1))"
    spread = (
        f"(10 * sqrt({mean} * ({total} - {marked}) / greatest({total}, 1) * ({total} - {drawn}) "
        f"/ greatest({total} - 1, 1)) + 10)"
    )
    low = f"CAST(greatest(0, {drawn} - ({total} - {marked}), floor({mean} - {spread})) AS BIGINT)"
    high = f"CAST(least({drawn}, {marked}, ceil({mean} + {spread})) AS BIGINT)"
    fixed = f"({_lf(marked)} + {_lf(f'{total} - {marked}')} - {_lf(total)} + {_lf(drawn)} + {_lf(f'{total} - {drawn}')})"
    weight = (
        f"exp(c - {_lf('k')} - {_lf(f'{marked} - k')} - {_lf(f'{drawn} - k')} "
        f"- {_lf(f'{total} - {marked} - {drawn} + k')})"
    )
    return (
        f"element_at(transform(array({fixed}), c -> aggregate(sequence({low}, {high}), "
        f"named_struct('sum', 0D, 'at', {low}), (s, k) -> named_struct('sum', s.sum + {weight}, "
        f"'at', CASE WHEN s.sum < {uniform} THEN k ELSE s.at END)).at), 1)"
    )


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal block quotas (idx, quota) to shards: rows (shard, idx, blocks), zero rows left out.

    The root holds the vector of all quotas. A node with more than one shard gives
    its left half a multivariate hypergeometric draw, made source by source from
    what is left, seeded by the node's name. Each node is one row, and its children
    follow from it alone, so a level needs no shuffle.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("idx", F.col("quota").cast("long").alias("quota")))).alias("all")).select(
        F.expr("transform(all, x -> x.idx)").alias("ids"),
        F.expr("transform(all, x -> x.quota)").alias("left"),
        F.lit(0).alias("first"),
        F.lit(shards).alias("n"),
    )
    uniform = f"((shiftrightunsigned(xxhash64({seed}L, first, n, i), 11) + 0.5D) / 9007199254740992D)"
    draw = hypergeometric("st.total", "left[i]", "st.drawn", uniform)
    halved = (
        "aggregate(sequence(0, size(left) - 1), "
        "named_struct('total', total, 'drawn', (total * half) div n, 'out', CAST(array() AS ARRAY<BIGINT>)), "
        f"(st, i) -> element_at(transform(array({draw}), x -> named_struct('total', st.total - left[i], "
        "'drawn', st.drawn - x, 'out', array_append(st.out, x))), 1)).out"
    )
    for _ in range(max(0, (shards - 1).bit_length())):
        node = (
            node.withColumn("half", F.expr("n div 2"))
            .withColumn("total", F.expr("aggregate(left, 0L, (a, x) -> a + x)"))
            .withColumn("taken", F.expr(f"CASE WHEN n > 1 AND size(left) > 0 THEN {halved} END"))
            .withColumn(
                "child",
                F.explode(
                    F.expr(
                        "CASE WHEN taken IS NULL THEN array(named_struct('q', left, 'first', first, 'n', n)) ELSE "
                        "array(named_struct('q', taken, 'first', first, 'n', CAST(half AS INT)), "
                        "named_struct('q', zip_with(left, taken, (a, b) -> a - b), "
                        "'first', first + CAST(half AS INT), 'n', n - CAST(half AS INT))) END"
                    )
                ),
            )
            .select("ids", F.col("child.q").alias("left"), "child.first", "child.n")
        )
    return (
        node.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("ids", "left")).alias("x"))
        .select("shard", F.col("x.ids").alias("idx"), F.col("x.left").alias("blocks"))
        .where("blocks > 0")
    )


def _draws(sources: DataFrame, n_sources: int, shards: int, seed: int) -> DataFrame:
    """One row per (idx, block): its draws as an array of (pass, shard, place)."""
    leaves = written(split_quotas(sources.where("quota > 0").select("idx", "quota"), shards, seed), "mix-tree")
    earlier = Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = leaves.withColumn("begin", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)))
    ranges = ranges.repartition("idx", "shard").join(
        bounded(sources.select("idx", "quota", "n_blocks", "no_source", "source_key"), n_sources), "idx"
    )
    rank = F.explode(F.sequence("begin", F.col("begin") + F.col("blocks") - 1))
    draws = ranges.select(
        "idx", "shard", "quota", "n_blocks", F.xxhash64(F.lit(seed), "no_source", "source_key").alias("h"), rank.alias("rank")
    )
    place = F.pmod(F.pmod(F.lit(PRIME), F.col("quota")) * F.col("rank") + F.pmod("h", F.col("quota")), F.col("quota"))
    return (
        draws.withColumn("j", place)
        .select("idx", "shard", "rank", (F.expr("j div n_blocks")).alias("pass"), F.expr("j % n_blocks").alias("block"))
        .groupBy("idx", "block")
        .agg(F.collect_list(F.struct("pass", "shard", "rank")).alias("draws"))
    )


def draw_plan(
    docs: DataFrame,
    *,
    size: Column | None = None,
    ident: Column | None = None,
    shards: int = 40,
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: int = 3,
    block_rows: int = 32,
    seed: int = 1,
) -> DataFrame:
    """Every row of ``docs`` (in struct ``doc``) with the draws that take it.

    Adds ``source_size``, ``target`` and ``draws``, an array of (pass, shard, rank,
    order): one entry for each time the mix takes the row, empty if never.
    ``size`` and ``ident`` are expressions over ``doc``; they default to the words
    of ``doc.text`` and a hash of ``doc.doc_id`` and ``doc.text``.
    """
    rows = whole(docs)
    text = held(rows, "text")
    size = word_size(text) if size is None else size
    ident = F.xxhash64(held(rows, "doc_id"), text) if ident is None else ident
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), ident), 64 - ORDER_BITS)
    size = F.coalesce(size, F.lit(0)).alias("size")
    keyed = rows.select("doc", *_key(held(rows, "source")), order.alias("order"), size)
    narrow = written(keyed.drop("doc"), "mix-rows")
    sources = narrow.groupBy("no_source", "source_key").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_rows")
    )
    sources = targets(sources, weights, max_repeats)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = (
        sources.withColumn("full", full)
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumn("n_blocks", F.ceil(F.col("n_rows") / block_rows))
    )
    sources = written(sources, "mix-sources")
    n_sources = sources.count()
    by_source = ["no_source", "source_key"]
    of_source = bounded(sources.select("idx", "rest", *by_source), n_sources)
    located = narrow.join(of_source.drop("rest"), by_source).select("idx", "order", "size")
    small = F.when(F.col("size") * SMALL <= F.col("rest"), F.col("size")).otherwise(0)
    limits = located.join(bounded(sources.select("idx", "rest"), n_sources), "idx").groupBy("idx", "rest")
    limits = limits.agg((F.sum(small) >= F.col("rest")).alias("enough"))
    limit = F.when(F.col("enough"), F.col("rest") / SMALL).otherwise(F.lit(float("inf")))
    limits = written(limits.select("idx", limit.alias("limit")), "mix-limits")
    located = located.join(bounded(limits, n_sources), "idx").where("size <= limit").drop("limit")
    cuts = _cuts(located, sources, n_sources).join(sources.select("idx", "n_blocks"), "idx")
    cuts = written(cuts, "mix-cuts")
    cuts = cuts.drop("n_blocks").join(_fillers(located, cuts, n_sources), "idx", "left")
    end = F.greatest("cut", "extra")
    sources = (
        sources.join(cuts, "idx", "left")
        .join(limits, "idx", "left")
        .withColumn("cut", F.coalesce("cut", F.lit(-1)))
        .withColumn("extra", F.coalesce("extra", F.lit(-1)))
        .withColumn(
            "quota",
            F.col("full") * F.col("n_blocks") + F.when(end >= 0, _block(end, F.col("n_blocks")) + 1).otherwise(0),
        )
    )
    sources = written(sources, "mix-quotas")
    n_draws = sources.agg(F.sum("quota")).head()[0] or 0
    draws = bounded(_draws(sources, n_sources, shards, seed), n_draws)
    facts = sources.select(*by_source, "idx", "source_size", "target", "full", "cut", "extra", "limit", "n_blocks")
    placed = keyed.join(bounded(facts, n_sources), by_source).withColumn("block", _block(F.col("order"), F.col("n_blocks")))
    taken = F.expr(
        "transform(filter(draws, d -> d.pass < full OR (d.pass = full AND (order <= cut AND size <= limit OR order = extra))), "
        f"d -> named_struct('pass', d.pass, 'shard', d.shard, 'rank', d.rank, 'order', xxhash64({seed}L, d.shard, d.pass, order)))"
    )
    return placed.join(draws, ["idx", "block"], "left").select(
        "doc", "source_size", "target", F.coalesce(taken, F.expr(_NO_DRAWS)).alias("draws")
    )


_NO_DRAWS = "CAST(array() AS ARRAY<STRUCT<pass: BIGINT, shard: INT, rank: BIGINT, order: BIGINT>>)"


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix: every taken copy as a row (doc, pass, shard, order), ``doc`` holding all columns.

    Null source: a source of its own, last. Null text: no words; it is taken like
    any other. A source without words has target 0 and is not taken. Empty input:
    empty mix. Rows equal in doc_id and text share a place in the order and are
    taken together. A document of any length is taken whole. Reruns agree.
    """
    return draw_plan(docs, **options).select("doc", F.explode("draws").alias("d")).select("doc", "d.pass", "d.shard", "d.order")


def write_mix(mixed: DataFrame, path: str) -> None:
    """Write one folder per shard, its rows in the shard's shuffled order."""
    (
        mixed.repartition("shard")
        .sortWithinPartitions("shard", "order")
        .select("doc.*", "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
