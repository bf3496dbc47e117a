"""Benchmark decontamination by SimHash over item-sized windows.

Texts are words with A-Z lower-cased; a text's features are its shingles of
``SHINGLE`` words with their multiplicities (a shorter text is one shingle).

1. Windows: the places of a document that hold a shingle of some item of a size are
   marked. A window of that size (the whole document, if it is shorter) is laid at every
   start, up to both edges, where enough of its places are marked to reach the threshold;
   overlap with an item cannot exceed their number, so no window left out is similar.
2. SimHash: 64 signed sums over the weighted shingle hashes of the window.
3. Index: fingerprints are cut into ``RADIUS + 1`` blocks. Two fingerprints that differ
   in at most ``RADIUS`` bits agree in some block whole, so the equi-join on (size,
   block, value) finds them all; the distance is then checked.
4. Check: the exact weighted similarity, the sum of smaller over the sum of larger
   multiplicities, must reach the threshold.

The items are the stated query set. They are taken in blocks of ``ITEM_ROWS`` shingles,
so what is broadcast is bounded; documents pass once for each block, row by row, and once
more for their windows. Only marked places are grouped, by document and size. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, held, lower_az, matched, may_match, whole, words, written

SHINGLE = 5
RADIUS = 15
BITS = 64
#: Benchmark shingles broadcast at a time.
ITEM_ROWS = 1_000_000


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all ``size``-word shingles of a text in order; empty if it has fewer words."""
    own = words(lower_az(text))
    return F.transform(
        F.filter(F.array(own), lambda w: F.size(w) >= size),
        lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size))),
    )


def simhash(shingles: str) -> str:
    """SQL of the SimHash of an array of hashes; repeats weigh by their number."""
    bit = f"(aggregate({shingles}, 0, (s, h) -> s + 2 * CAST(getbit(h, b) AS INT) - 1) > 0)"
    return f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | CASE WHEN {bit} THEN shiftleft(1L, b) ELSE 0L END)"


def blocks(fingerprint: str) -> str:
    """SQL of the (block, value) pairs of a fingerprint: RADIUS + 1 runs of its bits."""
    parts = RADIUS + 1
    edges = [BITS * k // parts for k in range(parts + 1)]
    runs = [
        f"named_struct('block', {k}, 'value', shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L)"
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ]
    return f"array({', '.join(runs)})"


def weighted_overlap(left: str, right: str) -> str:
    """SQL of the sum of smaller multiplicities of two sorted arrays of hashes, by merging them."""
    step = (
        "CASE WHEN s.i >= size(L) OR s.j >= size(R) THEN s "
        "WHEN L[s.i] = R[s.j] THEN named_struct('i', s.i + 1, 'j', s.j + 1, 'n', s.n + 1) "
        "WHEN L[s.i] < R[s.j] THEN named_struct('i', s.i + 1, 'j', s.j, 'n', s.n) "
        "ELSE named_struct('i', s.i, 'j', s.j + 1, 'n', s.n) END"
    ).replace("L[", f"{left}[").replace("R[", f"{right}[").replace("size(L)", f"size({left})").replace("size(R)", f"size({right})")
    return (
        f"aggregate(sequence(1, size({left}) + size({right})), "
        f"named_struct('i', 0, 'j', 0, 'n', 0), (s, k) -> {step}).n"
    )


def item_shingles(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id, n_words, size, shingles); items without words are left out."""
    own = benchmark.select(
        F.col(item_id).alias("item_id"), F.col(text).alias("text"), F.size(words(F.col(text))).alias("n_words")
    ).where("n_words > 0")
    parts = []
    for size in range(1, SHINGLE + 1):
        rows = own.where(f"n_words = {size}" if size < SHINGLE else f"n_words >= {size}")
        shingles = F.flatten(shingle_hashes(F.col("text"), size))
        parts.append(rows.select("item_id", "n_words", F.lit(size).alias("size"), shingles.alias("shingles")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _met(docs: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, text_hash, n_own, n_shingles, at): where a shingle of an item of ``n_shingles`` stands."""
    hashed = docs.select("doc_id", "text_hash", F.flatten(shingle_hashes(F.col("text"), size)).alias("own"))
    at = hashed.select("*", F.posexplode("own").alias("at", "shingle"))
    at = at.select("doc_id", "text_hash", F.size("own").alias("n_own"), "at", "shingle")
    return at.join(F.broadcast(places), "shingle").drop("shingle")


def _ranges(met: DataFrame, similarity: int) -> DataFrame:
    """Runs of starts (doc_id, text_hash, size, n_shingles, lo, hi) whose windows hold enough common shingles.

    A window as long as the item, or the whole of a shorter document, is similar enough only
    if at least ``least`` of its places are met. The run of mark i has the windows in which
    it is the first mark, so runs do not overlap.
    """
    marks = met.groupBy("doc_id", "text_hash", "size", "n_shingles", "n_own").agg(
        F.array_sort(F.collect_set("at")).alias("marks")
    )
    length = F.least("n_own", "n_shingles").alias("length")
    enough = marks.select("*", length).withColumn(
        "least",
        F.expr(f"CAST(greatest(1, ((length + n_shingles) * {similarity} + {99 + similarity}) div {100 + similarity}) AS INT)"),
    )
    run = (
        "named_struct('lo', greatest(0, marks[i + least - 1] - length + 1, CASE WHEN i > 0 THEN marks[i - 1] + 1 ELSE 0 END), "
        "'hi', least(marks[i], n_own - length))"
    )
    runs = F.expr(f"filter(transform(sequence(0, size(marks) - least), i -> {run}), r -> r.lo <= r.hi)")
    return (
        enough.where("size(marks) >= least")
        .select("doc_id", "text_hash", "size", "n_shingles", F.explode(runs).alias("r"))
        .select("doc_id", "text_hash", "size", "n_shingles", "r.lo", "r.hi")
    )


def _windows(docs: DataFrame, ranges: DataFrame, size: int, rows: int) -> DataFrame:
    """Windows (doc_id, text_hash, n_shingles, start, shingles) of the counted ``ranges`` of one size."""
    laid = ranges.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).agg(
        F.collect_list(F.struct("n_shingles", "lo", "hi")).alias("laid")
    )
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h"))
    passed = may_match(ranges, ["doc_id", "text_hash"], rows)
    hashed = (docs if passed is None else docs.where(passed)).join(bounded(laid, rows), match).select(
        "doc_id", "text_hash", "laid", F.flatten(shingle_hashes(F.col("text"), size)).alias("own")
    )
    runs = hashed.select("doc_id", "text_hash", "own", F.explode("laid").alias("r"))
    starts = runs.select("doc_id", "text_hash", "own", "r.n_shingles", F.explode(F.sequence("r.lo", "r.hi")).alias("start"))
    return starts.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        "start",
        F.array_sort(F.slice("own", F.col("start") + 1, F.col("n_shingles"))).alias("shingles"),
    )


def _laid(docs: DataFrame, places: DataFrame, similarity: int) -> DataFrame | None:
    """All windows (doc_id, text_hash, size, n_shingles, start, shingles) that may be similar to an item; None without items."""
    met, counts = None, sorted((r["size"], r["count"]) for r in places.groupBy("size").count().collect())
    for size, count in counts:
        parts = -(-count // ITEM_ROWS)
        own = places.where(F.col("size") == size).select("shingle", "n_shingles")
        for part in range(parts):
            block = own.where(F.pmod(F.xxhash64("shingle"), F.lit(parts)) == part) if parts > 1 else own
            rows = _met(docs, block, size).withColumn("size", F.lit(size))
            met = rows if met is None else met.unionByName(rows)
    if met is None:
        return None
    ranges = written(_ranges(met, similarity), "leak-ranges")
    held_by = {r["size"]: r["count"] for r in ranges.groupBy("size").count().collect()}
    found = None
    for size, _ in counts:
        of_size = ranges.where(F.col("size") == size)
        windows = _windows(docs, of_size, size, held_by.get(size, 0)).withColumn("size", F.lit(size))
        found = windows if found is None else found.unionByName(windows)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: int = 80) -> DataFrame:
    """Rows (doc_id, text_hash, item_id, start, overlap, union): windows that repeat an item.

    One row per document and item: its most similar window, the first of equals; ``start``
    counts words from 0. Null and blank texts and items have no window. A text shorter than
    an item is one window as a whole. Items with equal texts are all reported. Rows with
    equal doc_id and text give one row. Only doc_id and text (item_id and text) are read.
    """
    rows = whole(docs)
    text = F.coalesce(held(rows, "text").cast("string"), F.lit("")).alias("text")
    plain = rows.select(held(rows, "doc_id").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text)
    bench = whole(benchmark).select("doc.item_id", "doc.text")
    items = item_shingles(bench).select(
        "item_id", "size", F.size("shingles").alias("n_shingles"), F.array_sort("shingles").alias("sorted"), "shingles"
    )
    items = written(items.withColumn("print", F.expr(simhash("shingles"))), "leak-items")
    places = items.select("size", "n_shingles", F.explode("shingles").alias("shingle")).distinct()
    found = _laid(plain, written(places, "leak-places"), similarity)
    if found is None:
        found = plain.limit(0).select(
            "doc_id", "text_hash", F.lit(0).alias("n_shingles"), F.lit(0).alias("start"),
            F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("shingles"), F.lit(0).alias("size"),
        )
    windows = written(found.withColumn("print", F.expr(simhash("shingles"))), "leak-windows")
    index = items.withColumn("b", F.explode(F.expr(blocks("print")))).select(
        "item_id", "size", "n_shingles", F.col("b.block").alias("block"), F.col("b.value").alias("value"),
        F.col("print").alias("item_print"), F.col("sorted").alias("item"),
    )
    probe = windows.withColumn("b", F.explode(F.expr(blocks("print")))).select(
        "doc_id", "text_hash", "start", "size", "n_shingles", "print", "shingles",
        F.col("b.block").alias("block"), F.col("b.value").alias("value"),
    )
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    agreeing = F.expr(
        f"transform(filter(arrays_zip({blocks('print')}, {blocks('item_print')}), z -> z['0'].value = z['1'].value), z -> z['0'].block)[0]"
    )
    pairs = probe.join(
        bounded(index, items.count() * (RADIUS + 1)), ["size", "n_shingles", "block", "value"]
    ).where(near & (F.col("block") == agreeing))
    checked = pairs.withColumn("overlap", F.expr(weighted_overlap("shingles", "item"))).withColumn(
        "union", F.size("shingles") + F.size("item") - F.col("overlap")
    )
    best = (
        checked.where(F.col("overlap") * 100 >= F.col("union") * similarity)
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.min(F.struct(-F.col("overlap"), "start", "union")).alias("best"))
    )
    return best.select(
        "doc_id", "text_hash", "item_id", "best.start", (-F.col("best.col1")).alias("overlap"), "best.union"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: int = 80) -> DataFrame:
    """The rows of ``docs`` without a window that repeats a benchmark item."""
    bad = written(leaks(docs, benchmark, similarity).select("doc_id", "text_hash").distinct(), "leak-docs")
    rows = whole(docs)
    text = F.coalesce(held(rows, "text").cast("string"), F.lit(""))
    keyed = rows.select("doc", held(rows, "doc_id").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    return matched(keyed, bad, ["doc_id", "text_hash"], bad.count(), "left_anti").select("doc.*")
