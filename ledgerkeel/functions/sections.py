"""Sectioned texts: marker lines, section split, content check, excerpt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marker words of a sectioned text and the flag a marker may carry.
UP_MARKER = "migrate:up"
DOWN_MARKER = "migrate:down"
TRANSACTION_FLAG = "transaction:false"
EXCERPT_LIMIT = 120

# Character classes: what ends a line, blanks within a line, and any blank.
_LINE_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_BLANKS = r"\t \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
_ANY_BLANK = _LINE_ENDS + _BLANKS

# A marker takes a whole line, whatever ends the line before it. Java's multiline
# caret is several times faster than a look-behind and knows all line ends but the
# rare ones, so only texts that hold one of those use the look-behind. Repetitions
# are possessive or over one class: long texts stay linear.
_RARE_LINE_ENDS = r"\x0b\x0c\x1c\x1d\x1e"
_MARKER = (
    rf"[{_BLANKS}]*+--[{_BLANKS}]*+(?i:{UP_MARKER}|{DOWN_MARKER})(?![\p{{L}}\p{{N}}_])"
)
_AT_MARKER = rf"(?m)^(?={_MARKER})"
_AT_MARKER_ANY_END = rf"(?<![^{_LINE_ENDS}])(?={_MARKER})"
_MARKER_LINE = rf"\A{_MARKER}[^{_LINE_ENDS}]*+(?:\r\n|[{_LINE_ENDS}]|\z)"
_UP_LINE = rf"(?i){UP_MARKER}(?![\p{{L}}\p{{N}}_])"

# Blanks, line comments and flat block comments at the head of a text.
_LEADING_NOISE = rf"\A(?:[{_ANY_BLANK}]++|--[^\n]*+|/\*[\s\S]*?(?:\*/|\z))*+"
_TOKEN = rf"(/\*|\*/|--|\n|['\"`]|[-/*]|[^-/*'\"`{_ANY_BLANK}]+)"
_QUOTES = ("'", '"', "`")


def valid_text(payload: Column) -> Column:
    """The payload as text, null where its bytes are not UTF-8."""
    return F.try_validate_utf8(payload.cast("string"))


def utf8_check(payload: Column) -> Column:
    return F.is_valid_utf8(payload.cast("string"))


def _pieces(text: Column) -> Column:
    """The text cut before every marker line, as structs of marker line and piece."""
    rare = F.rlike(text, F.lit(f"[{_RARE_LINE_ENDS}]"))
    cut = F.when(rare, F.split(text, _AT_MARKER_ANY_END)).otherwise(F.split(text, _AT_MARKER))
    return F.transform(
        cut,
        lambda piece: F.struct(
            F.regexp_extract(piece, _MARKER_LINE, 0).alias("marker"), piece.alias("piece")
        ),
    )


def _kind(marker: Column) -> Column:
    return F.when(marker == "", F.lit(None)).when(F.rlike(marker, F.lit(_UP_LINE)), "up").otherwise("down")


def split_sections(
    df: DataFrame, text: str, up: str = "up", down: str = "down", kinds: str | None = None, flagged: str | None = None
) -> DataFrame:
    """Add the text above/below the markers as two columns, marker lines dropped.

    The text is cut once before its marker lines; each piece belongs to the
    marker it starts with and a first piece without one to the up section. One
    pass per row and no shuffle. ``kinds`` and ``flagged`` name columns for the
    marker kinds in order and for "a marker carries the transaction flag".
    """
    whole = F.col("_section_pieces")

    def joined(kind: str) -> Column:
        own = F.filter(whole, lambda item: F.coalesce(_kind(item["marker"]), F.lit("up")) == kind)
        bodies = F.transform(
            own, lambda item: F.substring(item["piece"], F.length(item["marker"]) + 1, F.length(item["piece"]))
        )
        return F.array_join(bodies, "")

    added = {up: joined("up"), down: joined("down")}
    if kinds:
        added[kinds] = F.array_compact(F.transform(whole, lambda item: _kind(item["marker"])))
    if flagged:
        added[flagged] = F.exists(
            whole, lambda item: F.contains(F.lower(item["marker"]), F.lit(TRANSACTION_FLAG))
        )
    return df.withColumn("_section_pieces", _pieces(F.col(text))).withColumns(added).drop("_section_pieces")


def section_has_content(text: Column) -> Column:
    """True when anything but blanks and comments is in the text.

    The first character outside comments decides. Texts with at most one block
    comment opener need one anchored match of what leads the text; only the
    others, where comments may nest, fold over their tokens. A lone quote that
    ends the text is not content.
    """
    second_opener = F.locate("/*", F.substring(text, F.locate("/*", text) + 2, F.length(text)))
    nested = F.contains(text, F.lit("/*")) & (second_opener > 0)
    left_over = F.length(text) - F.length(F.regexp_extract(text, _LEADING_NOISE, 0))
    flat = (left_over > 1) | ((left_over == 1) & ~F.right(text, F.lit(1)).isin(*_QUOTES))
    return F.when(nested, _nested_content(text)).otherwise(flat)


def _nested_content(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(False).alias("line"),
        F.lit("").alias("quote"),
        F.lit(False).alias("found"),
    )

    def step(state: Column, token: Column) -> Column:
        depth, line, quote, found = (state[k] for k in ("depth", "line", "quote", "found"))
        in_code = ~line & (depth == 0) & (quote == "")
        inside = ~line & (depth > 0)
        opens, closes = token == "/*", token == "*/"
        return F.struct(
            F.when(opens & (inside | in_code), depth + 1)
            .when(closes & inside, depth - 1)
            .otherwise(depth)
            .alias("depth"),
            F.when(line, token != "\n").otherwise(in_code & (token == "--")).alias("line"),
            F.when(in_code & token.isin(*_QUOTES), token).otherwise(quote).alias("quote"),
            (
                found
                | (quote != "")
                | (in_code & ~opens & ~token.isin("--", "\n", *_QUOTES))
            ).alias("found"),
        )

    return F.aggregate(
        tokens,
        start,
        step,
        lambda end: end["found"] | ((end["quote"] != "") & ~F.endswith(text, end["quote"])),
    )


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(rf"[^{_ANY_BLANK}]"))


def excerpt(text: Column, limit: int = EXCERPT_LIMIT) -> Column:
    """Blanks folded, cut to ``limit`` characters with an ellipsis."""
    folded = F.trim(F.regexp_replace(text, rf"[{_ANY_BLANK}]+", " "))
    return F.when(
        F.length(folded) > limit, F.concat(F.left(folded, F.lit(limit - 3)), F.lit("..."))
    ).otherwise(folded)
