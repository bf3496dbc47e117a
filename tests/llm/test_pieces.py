"""Encoding and decoding against the sentencepiece library."""

import random
from array import array

import pyarrow as pa
import pytest
import sentencepiece
from ledgerkeel.llm import pieces as P
from ledgerkeel.llm.queries import QUERIES
from pyspark.sql import functions as F

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.model_path())


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(P.load(P.model_path()))


def ids_of(encoder, text):
    found = bytearray()
    encoder.encode(text, found)
    return array("i", bytes(found)).tolist()


def random_texts(encoder, n):
    rng = random.Random(5)
    odd = ["▁", " ", "   ", "\n", "\t", "\0", "é", "é", "日", "😀", "<s>", "<0x0A>", "....", "====", " ", "ing", "aaaa"]
    for _ in range(n):
        yield "".join(rng.choice(odd) for _ in range(rng.randint(0, 25)))
        yield "".join(rng.choice(encoder.vocabulary.pieces[259:]) for _ in range(rng.randint(0, 12)))


def test_equals_the_library(encoder):
    for text in random_texts(encoder, 5_000):
        ids = ids_of(encoder, text)
        assert ids == LIBRARY.encode(text), text
        assert encoder.decode(ids) == LIBRARY.decode(ids)


def test_search_without_cuts_is_the_same(encoder):
    for text in random_texts(encoder, 1_000):
        covered = "".join(c for c in " " + text.replace("▁", " ") if c in encoder.alphabet)
        whole = [i for token in encoder.search(covered) for i in encoder.output[token]]
        assert whole == LIBRARY.encode(covered[1:]) or covered == " "


def test_search_backs_off(encoder):
    """Somewhere the longest piece is the wrong one: positions are given up and entered anew."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdehinorst") for _ in range(40)) for _ in range(300)]
    greedy = 0
    for text in texts:
        taken, at = [], 0
        run = " " + text
        while at < len(run):
            size = max(n for n in range(1, 20) if run[at : at + n] in encoder.ids)
            taken.append(encoder.ids[run[at : at + size]])
            at += size
        ids = ids_of(encoder, text)
        assert ids == LIBRARY.encode(text)
        greedy += taken == ids
    assert greedy < len(texts) / 2


def test_decodes_any_ids(encoder):
    rng = random.Random(7)
    for _ in range(5_000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259), 3 + rng.randrange(128, 256)]) for _ in range(8)]
        assert encoder.decode(ids) == LIBRARY.decode(ids), ids


def test_long_texts_in_stretches(encoder, monkeypatch):
    monkeypatch.setattr(P, "STRETCH", 37)
    rng = random.Random(9)
    for pool in (["ab", " ", "cde\n", "é日", "  "], ["abc"], [" "], ["\n"]):
        text = "".join(rng.choice(pool) for _ in range(3_000))
        assert ids_of(encoder, text) == LIBRARY.encode(text)


def test_other_models_are_refused(tmp_path):
    import sentencepiece.sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(P.model_path(), "rb").read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        P.load(str(tmp_path / "m"))


def test_edge_rows(spark):
    texts = [(1, None), (2, ""), (3, " "), (None, "same text"), (5, "same text"), (5, "same text"), (6, "word " * 300_000)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, ids int")
    vocabulary = P.load(P.model_path())
    encoded = P.encode(docs, vocabulary)
    out = encoded.select("doc.doc_id", "doc.text", "doc.ids", F.col("ids").alias("got"), P.decode(F.col("ids"), vocabulary).alias("back"))
    rows = out.collect()
    assert len(rows) == len(texts) and all(r.ids == 9 for r in rows)
    for r in rows:
        assert list(r.got) == LIBRARY.encode(r.text or "") and r.back == LIBRARY.decode(list(r.got))
    assert P.encode(docs.limit(0), vocabulary).count() == 0
    assert P.encode(docs.drop("text", "doc_id"), vocabulary).where("size(ids) > 0").count() == 0


def test_query_equals_the_library(spark):
    import hashlib

    sf = "/root/testdata/sf0.01"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "")
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids))))
    assert sorted(map(tuple, QUERIES["op11_pieces"](spark, sf).collect())) == sorted(want)


def test_batches_decode_like_single_lists(encoder):
    """Any ids, whole batches at once: with and without control ids, bytes that are no text, null and empty lists."""
    rng = random.Random(11)
    number = len(encoder.vocabulary.pieces)
    lists = [[rng.randrange(number) for _ in range(rng.randrange(6))] for _ in range(500)] + [None, []]
    silent = [[i for i in ids or () if i not in encoder.controls] for ids in lists]
    low = [[rng.randrange(260) for _ in range(3)] for _ in range(200)]
    for given in (lists, silent, low, [], [None]):
        batch = pa.array(given, pa.list_(pa.int32()))
        assert encoder.decode_all(batch).to_pylist() == [encoder.decode(ids or ()) for ids in given]
        assert encoder.decode_all(batch.slice(1)).to_pylist() == [encoder.decode(ids or ()) for ids in given[1:]]
