"""Exact n-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance is a metric, so pivots and the triangle inequality can say
which documents cannot be near each other. Nearly all pairs of documents lie at
distance 1, so the space is first cut where that loses nothing:

1. Equal sets are one class (compared by 128-bit digests); all else is per class.
2. Two sets of similarity t or more share a shingle among the first
   ``n - ceil(t * n) + 1`` of each in any common order. The order here puts shingles
   seen often last. Which ones are seen often is an estimate over all documents; it
   steers cost only, never the result.
   Every document also shows all its shingles up to a fixed point of that order. The
   smaller of two linked sets has at least ``2t / (1 + t)`` of its shingles in common, so
   it misses few of those shown; a document of which too few recur at all can only be
   the larger of a linked pair, and buckets without a possible smaller side fall away.
   A bucket ordered by set size is cut where the next size is too large for a link, so
   documents of other sizes that meet by chance do not; what is alone then falls away.
3. The smallest class of a shingle's bucket leads it, and buckets whose leaders
   meet in a document take the smaller one. A leader's region is every class that
   meets it. Linked classes share a bucket, hence a region. Regions above ``LEAF``
   are cut into bands of set size. In each, the shown shingles say which pairs are not
   ruled out; a spanning forest of those pairs is all that is kept of a region.
4. The components of these forests are clusters; a class is in one, and no link leaves it.
   Texts of a cluster of up to ``LEAF`` classes meet in one task, which joins
   their full sets by recursive Voronoi cells (``link_cells``).
5. Of a larger cluster, each region's smallest class is its pivot. The distance of each
   member to its pivot is computed from the full sets. Members
   within the radius are linked to it and to each other's component: no pair inside
   that ball is looked at again.
6. Where such a region still holds several components, members go to rings of the radius'
   width around the pivot and, as the triangle inequality asks, to the next ring too.
   Rings above ``LEAF`` members become a grid of blocks. Each task joins its block pair
   by ``link_cells`` and returns at most a spanning forest.
7. Links contract to components.

No task holds more than two blocks of sets, no pairs inside a group are emitted, and
rows between the stages follow the number of documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import batch_rows, bounded, held, matched, may_match, whole, written
from .graph import components

#: A shingle seen this often (counting only what recurs within ``HELD``) comes last in the order.
FREQUENT = 16
#: At most so many of them, the most frequent, are sent to the tasks (8 bytes each).
FREQUENT_LIMIT = 1_000_000
#: Shingles a task holds while it looks for recurring ones, and the ranges it sorts them in.
HELD, RANGES = 3_000_000, 4
#: Texts that a task takes over from Spark at a time.
BATCH_ROWS = 2_000
#: All shingles up to this hash are shown, as long as they are not frequent.
SHOWN = (1 << 64) // 5
#: Members of a region block, and of a Voronoi cell that is joined at once.
LEAF, CELL = 512, 96
PIVOTS = 8


def _prefix(n: int, similarity: int) -> int:
    return n - -(-similarity * n // 100) + 1


def _repeats(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Shingles in more than one of the sorted sets, a range of hashes at a time."""
    edges = [(1 << 64) * k // RANGES for k in range(1, RANGES)]
    cuts = [np.r_[0, np.searchsorted(own, np.array(edges, np.uint64)), len(own)] for own in sets]
    for k in range(RANGES):
        part = np.sort(np.concatenate([own[c[k] : c[k + 1]] for own, c in zip(sets, cuts, strict=True)]))
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(part)])
        more = counts > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[starts[more]].view(np.int64)), pa.array(counts[more].astype(np.int64))], names=["shingle", "n"]
        )


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that recur among ``HELD`` shingles of distinct sets, with the number of sets."""
    seen, sets, size = set(), [], 0
    for batch in batches:
        for own in kernels.shingle_sets(batch.column(0)):
            key = hash(own.tobytes())
            if key not in seen:
                seen.add(key)
                sets.append(own)
                size += len(own)
            if size >= HELD:
                yield from _repeats(sets)
                seen, sets, size = set(), [], 0
    if sets:
        yield from _repeats(sets)


def _frequent(docs: DataFrame) -> np.ndarray:
    found = docs.select("text").mapInArrow(_recurring, "shingle long, n long")
    top = found.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    table = top.orderBy(F.desc("n"), "shingle").limit(FREQUENT_LIMIT).select("shingle").toArrow()
    return np.sort(table.column(0).to_numpy().view(np.uint64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def _signatures(frequent: np.ndarray, similarity: int):
    """Tasks that give each row its set's size, digest and first shingles; of equal sets in a task, one row has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            sizes, keys, firsts, lengths, shown = [], [], [], [], []
            for own in kernels.shingle_sets(batch.column(2)):
                n = len(own)
                sizes.append(n)
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                visible = int(np.searchsorted(own, np.uint64(SHOWN), "right"))
                k = max(_prefix(n, similarity), visible) if n else 0
                first = own[:k]
                if _among(first, frequent).any():
                    late = _among(own, frequent)
                    light = own[~late]
                    visible = int(np.searchsorted(light, np.uint64(SHOWN), "right"))
                    first = np.concatenate([light, own[late]])[: max(_prefix(n, similarity), visible)]
                first = first[:0] if keys[-1] in met else first
                met.add(keys[-1])
                firsts.append(first)
                lengths.append(len(first))
                shown.append(visible)
            ends = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum(lengths, out=ends[1:])
            flat = np.concatenate(firsts).view(np.int64) if firsts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(shown, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["doc_id", "text_hash", "n", "set_key", "shown", "first"],
            )

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [own.tobytes() for own in kernels.shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["class", "shingles"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of two blocks of sets, by products of 0/1 matrices."""
    every = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
    names, at = np.unique(every, return_inverse=True)
    own = np.bincount(at, minlength=len(names)) > 1
    code = np.cumsum(own) - 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    keep = own[at]
    row, col = row[keep], code[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(own.sum()), columns):
        a, b = np.searchsorted(col, [start, start + columns])
        block = np.zeros((len(left) + len(right), columns), np.float32)
        block[row[a:b], col[a:b] - start] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return np.rint(out).astype(np.int64)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def link_cells(sets: list[np.ndarray], parent: np.ndarray, similarity: int = 80) -> list[tuple[int, int]]:
    """Links that join different components of ``parent``, by recursive Voronoi cells.

    The first ``PIVOTS`` members are pivots. A member's home is its nearest pivot; it is
    also sent to each cell whose pivot is no further than its home pivot plus twice the
    radius. If x and y are within the radius and y is at home with q, then
    d(x,q) <= d(y,q) + r <= d(y,p) + r <= d(x,p) + 2r for x's home p, so y's cell holds
    both. Cells that do not shrink are joined at once.
    """
    found: list[tuple[int, int]] = []
    radius = 1 - similarity / 100

    def unite(members: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(members[i], members[j], strict=True):
            a, b = _find(parent, int(x)), _find(parent, int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(x), int(y)))

    def cell(members: np.ndarray) -> None:
        if len({_find(parent, int(m)) for m in members}) < 2:
            return
        own = [sets[m] for m in members]
        sizes = np.array([len(s) for s in own])
        if len(members) > CELL:
            inter = overlaps(own, own[:PIVOTS])
            union = sizes[:, None] + sizes[None, :PIVOTS] - inter
            i, j = np.nonzero(100 * inter >= similarity * union)
            unite(members, i, j)
            distance = 1 - inter / union
            home = distance.argmin(1)
            near = distance <= distance.min(1, keepdims=True) + 2 * radius + 1e-9
            if (near.sum(0) ** 2).sum() < 0.7 * len(members) ** 2:
                for q in range(PIVOTS):
                    if (home == q).any():
                        cell(members[near[:, q]])
                return
        for a in range(0, len(members), LEAF):
            for b in range(a, len(members), LEAF):
                inter = overlaps(own[a : a + LEAF], own[b : b + LEAF])
                union = sizes[a : a + LEAF, None] + sizes[None, b : b + LEAF] - inter
                i, j = np.nonzero(100 * inter >= similarity * union)
                ahead = i + a < j + b
                unite(members, i[ahead] + a, j[ahead] + b)

    cell(np.arange(len(sets)))
    return found


def _join_block(similarity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("class").sort_values("class")
        ids = pdf["class"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        _, first, group = np.unique(pdf["root"].to_numpy(), return_index=True, return_inverse=True)
        links = link_cells(sets, first[group].astype(np.int64), similarity)
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype=np.int64)

    return run


def _forest(fits: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric matrix of pairs."""
    a, b = [], []
    fresh = np.ones(len(fits), bool)
    for start in range(len(fits)):
        if not fresh[start]:
            continue
        fresh[start] = False
        ends = [start]
        while ends:
            at = ends.pop()
            found = np.flatnonzero(fits[at] & fresh)
            fresh[found] = False
            a += [at] * len(found)
            b += found.tolist()
            ends += found.tolist()
    return a, b


def _feasible(similarity: int):
    """A spanning forest, per region, of the pairs of a block pair that the shown shingles alone do not rule out.

    Of the shown shingles of x at most ``n_x - o`` are not in y, where ``o`` is the overlap
    that two sets of these sizes need.
    """

    def pairs(tokens: list[np.ndarray], n: np.ndarray, shown: np.ndarray) -> np.ndarray:
        every = np.zeros((len(n), len(n)), bool)
        for a in range(0, len(n), LEAF):
            x = slice(a, a + LEAF)
            if len(n) <= 8:
                inter = np.array([[len(np.intersect1d(s, t, assume_unique=True)) for t in tokens] for s in tokens[x]])
            else:
                inter = overlaps(tokens[x], tokens)
            need = -(-similarity * (n[x, None] + n[None]) // (100 + similarity))
            fits = (inter >= shown[x, None] - n[x, None] + need) & (inter >= shown[None] - n[None] + need)
            fits &= 100 * np.minimum(n[x, None], n[None]) >= similarity * np.maximum(n[x, None], n[None])
            every[x] = fits
        return every

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        region, class_ = pdf["region"].to_numpy(), pdf["class"].to_numpy()
        order = np.lexsort((class_, region))
        region, class_ = region[order], class_[order]
        fresh = np.r_[True, (region[1:] != region[:-1]) | (class_[1:] != class_[:-1])]
        order, region, class_ = order[fresh], region[fresh], class_[fresh]
        seen = pdf["seen"].to_numpy()
        tokens = [np.asarray(seen[i], np.int64).view(np.uint64) for i in order]
        n, shown = pdf["n"].to_numpy(np.int64)[order], pdf["shown"].to_numpy(np.int64)[order]
        low, high = [], []
        edges = np.flatnonzero(np.r_[True, region[1:] != region[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            x, y = _forest(pairs(tokens[a:b], n[a:b], shown[a:b]))
            low += [a + i for i in x]
            high += [a + i for i in y]
        return pd.DataFrame({"region": region[low], "a": class_[low], "b": class_[high]}, dtype=np.int64)

    return run


def _grid(members: DataFrame, group: list[str], counted: DataFrame, columns: list[str]) -> DataFrame:
    """Deal the members of each group to pairs (low, high) of blocks of about LEAF members."""
    grid = F.ceil(F.col("members") / LEAF).cast("int")
    block = F.pmod(F.xxhash64("class"), F.col("grid")).cast("int")
    return (
        members.join(counted.select(*group, "members"), group)
        .withColumn("grid", grid)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
        .select(*group, *columns, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )


def _buckets(signed: DataFrame, similarity: int) -> DataFrame:
    """Rows (class, pivot, shingle, seen): classes that share a first shingle, without sizes that cannot be linked.

    The copies of a set that other tasks have shown again stand beside each other, and one is kept.
    """
    first = signed.where("n > 0").select("class", "n", "shown", F.posexplode("first").alias("at", "shingle"))
    # Size and mark travel in one number.
    sized = (F.col("n") * 2 + (F.col("at") < F.col("shown")).cast("int")).alias("sized")
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_size = Window.partitionBy("shingle").orderBy("sized", "class")
    here, before, after = (F.shiftright(c, 1) for c in ("sized", "sized_before", "sized_after"))
    near = F.coalesce(before * 100 >= here * similarity, F.lit(False))
    close = (
        first.select("class", sized, "shingle")
        .repartition(parts, "shingle")
        .withColumns(
            {
                "sized_before": F.lag("sized").over(by_size),
                "class_before": F.lag("class").over(by_size),
                "sized_after": F.lead("sized").over(by_size),
            }
        )
        .withColumn("starts", (~near).cast("int"))
        .where(F.col("class_before").isNull() | (F.col("class_before") != F.col("class")))
        .where((F.col("starts") == 0) | (here * 100 >= after * similarity))
    )
    run = Window.partitionBy("shingle", "run")
    return (
        close.withColumn("run", F.sum("starts").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("pivot", F.min("class").over(run))
        .withColumn("last", F.max("class").over(run))
        .where("last != pivot")
        .select("class", "pivot", "shingle", (F.col("sized") % 2 == 1).alias("seen"))
    )


def _regions(signed: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Rows (region, a, b): a spanning forest, in each region, of the pairs that may be linked."""
    shared = written(_buckets(signed, similarity), "jaccard-buckets")
    sizes = classes.select("class", "n", "shown")
    smaller = shared.groupBy("class").agg(F.sum(F.col("seen").cast("int")).alias("hits")).join(sizes, "class")
    missed = F.col("n") - F.ceil(F.col("n") * 2 * similarity / (100 + similarity))
    smaller = smaller.select("class", (F.col("hits") >= F.col("shown") - missed).alias("smaller"))
    shared = (
        shared.join(smaller, "class")
        .withColumn("smaller", F.max("smaller").over(Window.partitionBy("shingle", "pivot")))
        .where("smaller")
        .select("class", "pivot", "shingle", "seen")
    )
    shared = written(shared, "jaccard-live-buckets")
    leader = shared.groupBy("class").agg(F.min("pivot").alias("leader"))
    met = shared.join(leader, "class").groupBy("pivot").agg(F.min("leader").alias("region"))
    regions = written(shared.select("class", "pivot").join(met, "pivot").select("region", "class").distinct(), "jaccard-regions")
    tokens = shared.groupBy("class").agg(F.collect_set(F.when(F.col("seen"), F.col("shingle"))).alias("seen"))
    counted = regions.groupBy("region").agg(F.count("*").alias("members")).where("members > 1")
    # Linked sets differ in size by the width of a band at most; a class of a large region is in its own band and the next.
    home = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / similarity) + 1e-9)).cast("int")
    large = F.col("members") > LEAF
    banded = (
        regions.join(counted, "region")
        .join(sizes, "class")
        .withColumn("home", F.when(large, home).otherwise(F.lit(0)))
        .withColumn("band", F.explode(F.when(large, F.array("home", F.col("home") + 1)).otherwise(F.array("home"))))
        .drop("members")
    )
    group = ["region", "band"]
    counted = banded.groupBy(group).agg(F.count("*").alias("members"), F.max((F.col("home") == F.col("band")).cast("int")).alias("homes"))
    counted = counted.where("members > 1 AND homes = 1")
    dealt = _grid(banded, group, counted, ["class", "members", "n", "shown"]).join(tokens, "class")
    # Small regions share a task's group, by hash; blocks of large ones have their own.
    runs = F.ceil(F.lit(regions.count()) / (4 * LEAF))
    alone = F.col("members") > LEAF
    key = F.when(alone, F.col("region")).otherwise(F.pmod(F.xxhash64(*group), runs)).alias("key")
    fit = (
        dealt.select(*group, "class", "low", "high", "seen", "n", "shown", key, alone.alias("alone"))
        .groupBy("key", F.when(F.col("alone"), F.col("band")).alias("own_band"), "alone", "low", "high")
        .applyInPandas(_feasible(similarity), "region long, a long, b long")
    )
    return written(fit, "jaccard-feasible")


def _stars(edges: DataFrame, large: DataFrame) -> DataFrame:
    """Rows (pivot, class), pivot itself left out, of each region's classes whose cluster is a large one."""
    own = edges.join(large.select(F.col("class").alias("a")), "a")
    members = own.select("region", F.explode(F.array("a", "b")).alias("class")).distinct()
    pivots = members.groupBy("region").agg(F.min("class").alias("pivot"))
    return written(members.join(pivots, "region").where("class != pivot").select("pivot", "class").distinct(), "jaccard-stars")


def _cluster_links(similarity: int):
    """Links inside clusters whose rows (root, class, text) stand together; at most a spanning forest of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, ids, sets = None, [], []

        def links() -> list[tuple[int, int]]:
            found = link_cells(sets, np.arange(len(sets)), similarity) if len(sets) > 1 else []
            return [(ids[i], ids[j]) for i, j in found]

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            found = []
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (own_root, class_), own in zip(names, kernels.shingle_sets(batch.column(2)), strict=True):
                if own_root != root:
                    found += links()
                    root, ids, sets = own_root, [], []
                if not ids or ids[-1] != class_:
                    ids.append(class_)
                    sets.append(own)
            if found:
                yield rows(found)
        if found := links():
            yield rows(found)

    return run


def _linked(inter: Column, union: Column, similarity: int) -> Column:
    return inter * 100 >= union * similarity


def _region_links(regions: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    of_pivot = sets.select(F.col("class").alias("pivot"), F.col("shingles").alias("pivot_shingles"))
    both = regions.join(sets, "class").join(of_pivot, "pivot")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, union = [], []
            for own, other in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(own.as_buffer(), np.uint64)
                y = np.frombuffer(other.as_buffer(), np.uint64)
                same = int(_among(x, y).sum())
                inter.append(same)
                union.append(len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())],
                names=["pivot", "class", "inter", "union"],
            )

    measured = both.select("pivot", "class", "shingles", "pivot_shingles").mapInArrow(
        distances, "pivot long, class long, inter long, union long"
    )
    measured = written(measured, "jaccard-distances")
    links = measured.where(_linked(F.col("inter"), F.col("union"), similarity)).select(
        F.col("pivot").alias("a"), F.col("class").alias("b")
    )
    balls = components(links)
    # What a ball has joined needs no further look; the other members meet ring by ring.
    width = 100 - similarity
    ring = F.floor((F.col("union") - F.col("inter")) * 100 / (F.col("union") * width))
    members = (
        measured.join(balls.withColumnRenamed("node", "class"), "class", "left")
        .select("pivot", "class", F.coalesce("root", "class").alias("root"), ring.alias("home"))
        .withColumn("ring", F.explode(F.array("home", F.col("home") + 1)))
    )
    group = ["pivot", "ring"]
    counted = members.groupBy(group).agg(
        F.count("*").alias("members"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.max((F.col("home") == F.col("ring")).cast("int")).alias("homes"),
    )
    open_rings = counted.where("members > 1 AND low != high AND homes = 1").select(*group, "members")
    dealt = _grid(members, group, open_rings, ["class", "root"])
    dealt = written(dealt, "jaccard-blocks")
    more = (
        dealt.join(sets, "class")
        .groupBy(*group, "low", "high")
        .applyInPandas(_join_block(similarity), "a long, b long")
    )
    return links.unionByName(more)


def classify(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """Rows (doc_id, text_hash, n_shingles, class, component_id), one per input row.

    ``class`` numbers the distinct sets (null for empty ones); ``component_id`` is the
    smallest doc_id among all rows reachable by links. Null and blank texts have the
    empty set and link with nothing: their component is their own doc_id. Null doc_ids
    are passed over by the minimum; a component of null ids only has a null id. Rows
    equal in everything stay separate rows of one class. Only ``doc_id`` and ``text``
    are read, so other columns may have any name. Empty input: no rows.
    """
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return _classify(docs, similarity)


def _classify(docs: DataFrame, similarity: int) -> DataFrame:
    rows = whole(docs)
    text = F.coalesce(held(rows, "text"), F.lit("")).cast("string").alias("text")
    own = rows.select(held(rows, "doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text)
    frequent = _frequent(own)
    signed = own.mapInArrow(
        _signatures(frequent, similarity), "doc_id long, text_hash long, n long, set_key binary, shown int, first array<long>"
    )
    signed = written(signed, "jaccard-signed")
    classes, number = _numbered(
        signed.where("n > 0")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("rep"),
            F.min(F.struct("doc_id", "text_hash")).alias("row"),
            F.first("n").alias("n"),
            F.first("shown").alias("shown"),
        )
    )
    signed = signed.select("*", F.when(F.col("n") > 0, number).alias("class"))
    edges = _regions(signed, classes, similarity)
    clusters = components(edges)
    counted = clusters.groupBy("root").agg((F.count("*") > LEAF).alias("large"))
    live = clusters.withColumnRenamed("node", "class").join(counted, "root").join(classes.select("class", "row"), "class")
    live = written(live.select("class", "root", "large", "row.*"), "jaccard-live")

    def texts(part: DataFrame) -> DataFrame:
        rows = part.count()
        passed = may_match(part, ["doc_id", "text_hash"], rows)
        named = part.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "h")
        match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h"))
        return (own if passed is None else own.where(passed)).join(bounded(named, rows), match)

    small = texts(live.where("NOT large")).select("root", "class", "text").repartition("root")
    small = small.sortWithinPartitions("root", "class").mapInArrow(_cluster_links(similarity), "a long, b long")
    links = written(small, "jaccard-links")
    large = live.where("large")
    if large.limit(1).count():
        sets = texts(large).select("class", "text").mapInArrow(_full_sets, "class long, shingles binary")
        sets = written(sets, "jaccard-sets").dropDuplicates(["class"])
        links = links.unionByName(_region_links(_stars(edges, large), sets, similarity))
    links = components(links)
    joined = classes.select("class", "rep").join(links.withColumnRenamed("node", "class"), "class", "left")
    joined = joined.withColumn("root", F.coalesce("root", "class"))
    lowest = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = joined.join(lowest, "root").select("class", "component_id")
    return signed.select("doc_id", "text_hash", "n", "class").join(named, "class", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        "class",
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _numbered(found: DataFrame) -> tuple[DataFrame, Column]:
    """The classes, written with their number, and how it is made of a set's key.

    So a row knows its class without a join. Should two classes ever get one number, all are numbered anew.
    """
    salt = 0
    while True:
        number = F.xxhash64(F.col("set_key"), F.lit(salt))
        classes = written(found.withColumn("class", number).drop("set_key"), "jaccard-classes")
        if not classes.groupBy("class").count().where("count > 1").limit(1).count():
            return classes, number
        salt += 1


def keep_one(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component stays.

    It is the one with the smallest doc_id (null last), of those with one doc_id the
    smallest text hash. Rows with an empty set all stay. All columns are kept as is.
    """
    marked = written(classify(docs, similarity), "jaccard-marked")
    real = marked.where("class IS NOT NULL")
    # A component of null ids only is told apart by its classes' smallest number.
    key = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("class")).alias("alone")]
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = real.groupBy(*key).agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash")
    same = ["doc_id", "text_hash"]
    per_row = real.groupBy(same).agg(F.count("*").alias("copies"))
    kept = kept.withColumn("kept", F.lit(True))
    null_safe = per_row.alias("r").join(
        kept.alias("k"),
        F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.text_hash") == F.col("k.text_hash")),
        "left",
    )
    marks = null_safe.select("r.doc_id", "r.text_hash", "r.copies", F.coalesce("k.kept", F.lit(False)).alias("kept"))
    marks = written(marks.where("NOT kept OR copies > 1"), "jaccard-marks")
    rows = whole(docs)
    text = F.coalesce(held(rows, "text"), F.lit("")).cast("string")
    keyed = rows.select("doc", held(rows, "doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))

    again = marks.where("kept")
    repeated = matched(keyed, again, same, again.count(), "left_semi").dropDuplicates(same)
    return matched(keyed, marks, same, marks.count(), "left_anti").unionByName(repeated).select("doc.*")
