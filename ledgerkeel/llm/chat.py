"""Chat formatting from an event log.

A conversation is a log of events, each of one message: ``delta`` appends text, ``edit``
replaces the text, ``regenerate`` drops it so that deltas start anew, ``delete`` removes the
message. Events are folded by sequence number within (conversation, message), so a long
conversation is many small groups; messages are then ordered and rendered per row, and a
running length gives every message its place in the conversation's text. Only the last
step brings a conversation together, as the one row it is.

Template: ``<turn>ROLE\\nTEXT</turn>\\n`` per message. In texts and roles a backslash goes into
each control string (``<turn`` to ``<\\turn``, ``</turn`` to ``</\\turn``, one more if there
already are some), so ``</turn>`` ends a message wherever it occurs; in roles, backslashes
are doubled and newlines written ``\\n`` first. ``read_back`` undoes all of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
EVENT_KINDS = ("delta", "edit", "regenerate", "delete")
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(/?)(\\*)turn", r"<$1\\$2turn")


def escape_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, place, role, text) of a log.

    Events are (conv_id, message, seq, kind, place, role, text). By seq, the last edit or
    regeneration starts the text, and deltas from there on follow; a null text is empty.
    Events with equal seq take the order edit, regenerate, delta, then their text.
    ``place`` and ``role`` are those of the message's first event that has them. A deleted
    message is gone even if deltas follow; a message without events does not exist.
    """
    rank = F.when(F.col("kind") == "edit", 0).when(F.col("kind") == "regenerate", 1).otherwise(2)
    event = F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    message = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(event)).alias("log"),
        F.min(F.when(F.col("place").isNotNull(), F.struct("seq", "place")))["place"].alias("place"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        F.max(F.when(F.col("kind") == "delete", True)).alias("deleted"),
    )
    last = F.expr("coalesce(array_max(transform(log, (e, i) -> CASE WHEN e.rank < 2 THEN i END)), 0)")
    text = F.expr("array_join(transform(slice(log, start + 1, size(log)), e -> CASE WHEN e.rank = 1 THEN '' ELSE e.text END), '')")
    return (
        message.where("deleted IS NULL")
        .withColumn("start", last)
        .select("conv_id", "message", "place", "role", text.alias("text"))
    )


def render(messages: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """Rows (conv_id, formatted, mask): the text and the (start, end) code points to learn from.

    Messages go by place (null last), then role, text and message number. Null roles are
    empty. A conversation of one null id is a conversation. Empty texts of the learned
    role have an empty span. Empty input: no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    rows = messages.select(
        "conv_id",
        F.struct(F.col("place").isNull().alias("last"), "place", role.alias("role"), text.alias("text"), "message").alias("order"),
        F.concat(head, escape(text), F.lit(CLOSE)).alias("piece"),
        F.length(head).alias("head"),
        (role == learned_role).alias("learned"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0)))
    span = F.struct(
        (F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.length("piece") - len(CLOSE)).alias("end")
    )
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("learned"), span))).alias("mask"),
    )
    return whole.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "mask")


_CONTROL = re.compile(r"<(/?)\\(\\*)turn")
_IN_ROLE = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _CONTROL.sub(r"<\1\2turn", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a rendered conversation."""
    turns = []
    for piece in formatted.split(CLOSE)[:-1]:
        role, _, text = piece.removeprefix(OPEN).partition("\n")
        role = _IN_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        turns.append((role, unescape(text)))
    return turns


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for conv_id, formatted, mask in zip(pdf["conv_id"], pdf["formatted"], pdf["mask"], strict=True):
            turns = parse(formatted)
            learned = "".join(unescape(formatted[s["start"] : s["end"]]) for s in mask)
            out.append(
                (
                    None if pd.isna(conv_id) else int(conv_id),
                    len(turns),
                    hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    len(learned),
                    hashlib.sha256(learned.encode()).hexdigest(),
                    len(formatted),
                )
            )
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse rendered conversations: turns, learned text and their digests, per conversation."""
    return rendered.select("conv_id", "formatted", "mask").mapInPandas(
        _read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
