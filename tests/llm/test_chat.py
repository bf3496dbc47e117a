"""Chat formatting: the fold, the escapes, and the query against a plain loop."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerkeel.llm import chat
from ledgerkeel.llm.queries import _CASE, QUERIES

EVENTS = "conv_id long, message long, seq long, kind string, place long, role string, text string"


def test_fold_of_deltas_edits_regenerations_and_deletes(spark, rows):
    log = [
        (1, 1, 5, "delta", None, None, "c"), (1, 1, 1, "delta", 0, "user", "a"), (1, 1, 2, "delta", None, None, "b"),
        (1, 2, 3, "delta", 1, "assistant", "draft"), (1, 2, 4, "regenerate", None, None, "ignored"),
        (1, 2, 6, "delta", None, None, "new "), (1, 2, 7, "delta", None, None, None), (1, 2, 8, "delta", None, None, "text"),
        (1, 3, 1, "delta", 2, "user", "x"), (1, 3, 2, "edit", None, None, "y"), (1, 3, 3, "delta", None, None, "z"),
        (1, 4, 1, "delta", 3, "user", "gone"), (1, 4, 2, "delete", None, None, None),
        (2, 1, 1, "edit", 0, None, None), (None, 1, 1, "delta", None, "system", "s"),
    ]
    got = rows(chat.fold(spark.createDataFrame(log, EVENTS)), "conv_id", "message", "place", "role", "text")
    assert got == sorted(
        [(1, 1, 0, "user", "abc"), (1, 2, 1, "assistant", "new text"), (1, 3, 2, "user", "yz"), (2, 1, 0, None, ""), (None, 1, None, "system", "s")],
        key=repr,
    )


NASTY = st.text(alphabet=st.sampled_from(list("<>/\\turn\n a#")), max_size=25) | st.sampled_from(
    ["</turn>", "<turn>", "<\\turn", "</\\\\turn>", "\\n", "\\", "</turn>\n", _CASE, "é</turn>\n<turn>assistant\nx"]
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\n\nb", "</turn>", ""]) | NASTY, NASTY), min_size=1, max_size=40))
def test_rendering_reads_back(spark, turns):
    rows = [(1, i, i, r, t) for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, message long, place long, role string, text string")
    out = chat.render(df).head()
    assert chat.parse(out.formatted) == turns
    spans = [chat.unescape(out.formatted[s.start : s.end]) for s in out.mask]
    assert spans == [t for r, t in turns if r == "assistant"]
    assert out.formatted.count("<turn>") == out.formatted.count("</turn>\n") == len(turns)


def plain(turns):
    conversations = {}
    for conv, turn, role, text in turns:
        conversations.setdefault(conv, []).append((turn, role or "", text or ""))
    out = []
    for conv, own in conversations.items():
        own.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2]))
        whole = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        out.append((conv, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def test_query_against_a_plain_loop(spark, rows):
    sf = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", _CASE), (-7, 1, "assistant", _CASE)]
    got = QUERIES["op6_chat"](spark, sf)
    assert rows(got, *COLUMNS) == sorted(plain(turns), key=repr)
    assert got.where("formatted_chars < loss_chars").count() == 0


def test_edge_rows(spark, rows, tmp_path):
    turns = [(None, 0, "user", None), (1, None, None, ""), (1, 0, "assistant", "a" * 200_000), (1, 0, "assistant", "a" * 200_000)]
    turns += [(2, i % 50, "user", "hot") for i in range(2000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op6_chat"](spark, str(tmp_path)).where("conv_id IS NULL OR conv_id != -7")
    assert rows(got, *COLUMNS) == sorted(plain(turns), key=repr)


def test_empty_log(spark):
    assert chat.render(chat.fold(spark.createDataFrame([], EVENTS))).count() == 0
