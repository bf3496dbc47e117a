"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that hold
it over the number of the host's pages; lines above the ratio limit are boilerplate of
that host and are dropped from its pages. A page holds few distinct lines, so a host has
at most (mean distinct lines) / (limit) such lines: they fit one array per host, whatever
its size, and pages meet that array in one join. Counts are partial aggregates by (host,
line), so neither a large host nor a line on all of its pages meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, whole, written

RATIO, MIN_PAGES = 0.2, 5
#: Boilerplate line keys (16 bytes each) that may be broadcast.
BROADCAST_KEYS = 1_000_000

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BREAKING = (
    r"(?i)</?(?:html|head|title|body|main|header|footer|nav|aside|section|article|div|p|br|hr|h[1-6]|ul|ol|li|dl|dt|dd"
    r"|table|thead|tbody|tr|td|th|blockquote|pre|form|figure)\b[^>]*>"
)
TAG = r"<[^>]*>"
BLANK = " \t\r\f\v"


def page_lines(html: Column) -> Column:
    """Visible lines of a page in order: block tags and newlines break, other tags vanish."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BREAKING, "\n"), TAG, "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    return F.filter(lines, lambda x: x != "")


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def _key(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def drop_boilerplate(
    pages: DataFrame, lines: Column | None = None, host: Column | None = None, *, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Rows (doc, host, lines, kept): all lines of each page, and those that stay.

    A line is dropped if more than ``ratio`` of its host's pages hold it and the host has
    ``min_pages`` pages at least. Repeats inside a page count once and are dropped
    together. Pages without a host (null or bad URL) form no site and keep every line.
    Null pages have no lines, but count as pages. Repeated rows are pages of their own.
    ``lines`` and ``host`` are expressions over ``doc``.
    """
    rows = whole(pages)
    lines = page_lines(held(rows, "html")) if lines is None else lines
    host = host_of(held(rows, "url")) if host is None else host
    split = rows.select("doc", host.alias("host"), lines.alias("lines"))
    of_host = split.where("host != ''").select("host", F.array_distinct("lines").alias("lines"))
    totals = of_host.groupBy("host").agg(F.count("*").alias("pages"))
    counts = (
        of_host.select("host", F.explode("lines").alias("line"))
        .groupBy("host", _key(F.col("line")).alias("key"))
        .agg(F.count("*").alias("n"))
    )
    common = counts.where("n > 1").join(totals.where(F.col("pages") >= min_pages), "host")
    common = common.where(F.col("n") > F.col("pages") * F.lit(ratio))
    common = written(common.groupBy("host").agg(F.collect_list("key").alias("keys"), F.count("*").alias("n")), "boilerplate")
    keys = common.agg(F.sum("n")).head()[0] or 0
    side = common.select("host", "keys")
    joined = split.join(F.broadcast(side) if keys <= BROADCAST_KEYS else side, "host", "left")
    kept = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("keys"), _key(x)))
    )
    return joined.select("doc", "host", "lines", kept.alias("kept"))
