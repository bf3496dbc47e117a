"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A merge-type model joins, again and again, the neighbouring pair whose union is the piece of the
highest score (the leftmost of equals). A sequence of pieces is its result exactly if every
neighbouring two pieces, merged alone, come out as those two: a first merge across the border of
two pieces would have been the next one for the two alone as well. So encoding is a search
from left to right. At each position the longest piece is tried first (Aho-Corasick finds it for
all positions in one pass), then its shorter prefixes; one that does not fit its predecessor is passed
over, and a position without a way on is marked in a bitfield and never entered again. The way to a
position is the one encoding of the text before it, so a failed position fails for good and
the search is linear in the text.

Text is cut where no piece can reach across: between a character and a space mark after it
(if no piece holds such a pair) and around characters outside the alphabet, which become bytes. Cuts
change nothing; they let each task remember the ids of recurring runs.

The vocabulary is read once on the driver and sent to the tasks, so its file need not exist
elsewhere; it does not grow with the data. A task holds one batch of texts and its ids, a
bounded memory of runs, and for the search a few bytes per character of one run.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, whole

MARK = "▁"
#: Runs, and pairs of pieces, whose outcome a task remembers; longer runs are never remembered.
MEMORY, MEMORY_CHARS = 250_000, 40
#: Characters looked over at once.
STRETCH = 1 << 18
#: Lists of ids decoded at once.
LISTS = 256
MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    """The model among the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id. ``kinds``: ``n`` normal, ``b`` byte, ``c`` control, ``u`` unknown."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    unknown: str
    prefix: bool
    key: str


def load(path: str) -> Vocabulary:
    """Read a model file: merge type with byte fallback and without own normalisation rules."""
    import sentencepiece.sentencepiece_model_pb2 as proto

    data = open(path, "rb").read()
    model = proto.ModelProto()
    model.ParseFromString(data)
    rules, trained = model.normalizer_spec, model.trainer_spec
    plain = not (rules.precompiled_charsmap or rules.remove_extra_whitespaces) and rules.escape_whitespaces
    if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or not plain:
        raise ValueError(f"{path}: a merge-type model with byte fallback and plain text rules is needed.")
    names = {proto.ModelProto.SentencePiece.Type.Value(n): k for n, k in _KINDS.items()}
    if any(p.type not in names for p in model.pieces):
        raise ValueError(f"{path}: user-defined and unused pieces are not supported.")
    return Vocabulary(
        tuple(p.piece for p in model.pieces),
        tuple(p.score for p in model.pieces),
        "".join(names[p.type] for p in model.pieces),
        trained.unk_surface,
        rules.add_dummy_prefix,
        hashlib.sha256(data).hexdigest(),
    )


_KINDS = {"NORMAL": "n", "BYTE": "b", "CONTROL": "c", "UNKNOWN": "u"}


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """The plain merge loop, for short texts: best pair first, leftmost of equals."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            value = scores.get(parts[i] + parts[i + 1])
            if value is not None and (best is None or value > best):
                best, at = value, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Decoder:
    """Decoding by one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        kinds = vocabulary.kinds
        self.surfaces = [self._surface(p, k) for p, k in zip(vocabulary.pieces, kinds, strict=True)]
        self.surface_table = pa.array(self.surfaces, pa.large_binary())
        self.controls = {i for i, k in enumerate(kinds) if k == "c"}

    def _surface(self, piece: str, kind: str) -> bytes:
        if kind == "n":
            return piece.replace(MARK, " ").encode()
        if kind == "b":
            return bytes([int(piece[1:-1], 16)])
        return self.vocabulary.unknown.encode() if kind == "u" else b""

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: control ids are silent, bytes that form no character become U+FFFD
        each, and the space that encoding puts before a text is taken off."""
        kinds = self.vocabulary.kinds
        if self.controls.isdisjoint(ids):
            text = self._joined(ids)
        else:
            # Bytes on both sides of a control id are never one character.
            text = "".join(self._joined(part) for silent, part in groupby(ids, self.controls.__contains__) if not silent)
        first = next((i for i in ids if kinds[i] != "c"), None)
        return text[1:] if first is not None and self._drops_space(first) else text

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """``decode`` of every list, ``LISTS`` of them at once."""
        return pa.array([text for at in range(0, len(lists), LISTS) for text in self._texts(lists.slice(at, LISTS))], pa.string())

    def _texts(self, lists: pa.ListArray) -> list[str]:
        """The surfaces of all ids are looked up and laid one after the other, then cut."""
        flat, ends = lists.flatten(), self._ends(lists)
        if len(flat) and pc.any(pc.is_in(flat, pa.array(self.controls, pa.int32()))).as_py():
            return [self.decode(ids or ()) for ids in lists.to_pylist()]
        written = self.surface_table.take(flat)
        sizes = np.frombuffer(written.buffers()[1], np.int64)[written.offset : written.offset + len(flat) + 1]
        data = memoryview(written.buffers()[2] or b"")
        texts = []
        for first, last in zip(ends, ends[1:], strict=False):
            start = sizes[first] + (first < last and self._drops_space(flat[first].as_py()))
            texts.append(_text(bytes(data[start : sizes[last]])))
        return texts

    def _ends(self, lists: pa.ListArray) -> list[int]:
        """Where each list begins among all ids, and the end of the last; a null one is empty."""
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return [0, *np.cumsum(counts, dtype=np.int64).tolist()]

    def _drops_space(self, first: int) -> bool:
        spaced = self.vocabulary.kinds[first] == "n" and self.vocabulary.pieces[first].startswith(MARK)
        return spaced and self.vocabulary.prefix

    def _joined(self, ids: Iterable[int]) -> str:
        return _text(b"".join(map(self.surfaces.__getitem__, ids)))


class Encoder(Decoder):
    """Encoding and decoding by one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(vocabulary)
        kinds = vocabulary.kinds
        # Within, the space mark is a plain space: texts then need no second copy of wider characters.
        self.ids = {p.replace(MARK, " "): i for i, p in enumerate(vocabulary.pieces) if kinds[i] == "n"}
        self.scores = {p: vocabulary.scores[i] for p, i in self.ids.items()}
        self.alphabet = alphabet = set().union(*self.ids)
        self.bytes = {vocabulary.pieces[i]: i for i, k in enumerate(kinds) if k == "b"}
        # Only what merging can yield takes part in the search; characters without a piece
        # of their own take part and are written as bytes.
        self.tokens = sorted(alphabet | {p for p in self.ids if len(p) > 1 and merge(p, self.scores) == [p]})
        self.sizes = [len(p) for p in self.tokens]
        self.shorter = [-1] * len(self.tokens)
        self.matches = ahocorasick.Automaton()
        number = {p: i for i, p in enumerate(self.tokens)}
        for i, piece in enumerate(self.tokens):
            self.matches.add_word(piece, (i, len(piece) - 1))
            self.shorter[i] = next((number[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in number), -1)
        self.matches.make_automaton()
        self.output = [self._written(p) for p in self.tokens]
        self.runs = self._run_pattern(alphabet)
        self.fitting: dict[int, bool] = {}
        self.recent: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _written(self, piece: str) -> tuple[int, ...]:
        return (self.ids[piece],) if piece in self.ids else self._as_bytes(piece)

    def _as_bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.bytes[f"<0x{b:02X}>"] for b in text.encode())

    def _run_pattern(self, alphabet: set[str]) -> re.Pattern:
        letters = "".join(map(re.escape, sorted(alphabet - {" "})))
        crossed = any(a != " " and b == " " for p in self.ids for a, b in zip(p, p[1:], strict=False))
        inner = f"[{letters} ]+" if crossed else f" *[{letters}]+| +"
        return re.compile(f"{inner}|[^{letters} ]+")

    def _fits(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces stay as they are when their text is merged anew."""
        pair = [self.tokens[left], self.tokens[right]]
        if len(self.fitting) >= MEMORY:
            self.fitting.clear()
        fits = self.fitting[left * len(self.tokens) + right] = merge(pair[0] + pair[1], self.scores) == pair
        return fits

    def search(self, run: str) -> list[int]:
        """Token numbers of a run of characters of the alphabet."""
        longest = [0] * len(run)
        for end, (token, reach) in self.matches.iter(run):
            longest[end - reach] = token  # of one start, the longest ends last
        failed, some_failed = bytearray(len(run) // 8 + 1), False
        sizes, shorter, fitting, width = self.sizes, self.shorter, self.fitting, len(self.tokens)
        found, last, at, token, stop = [], -1, 0, longest[0], len(run)
        while True:
            while token >= 0:
                end = at + sizes[token]
                if not some_failed or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = fitting.get(last * width + token)
                    if self._fits(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                found.append(token)
                last, at = token, end
                if at == stop:
                    return found
                token = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                some_failed = True
                token = found.pop()
                last = found[-1] if found else -1
                at -= sizes[token]

    def _run_ids(self, run: str) -> bytes:
        if run[0] not in self.alphabet:
            return array("i", self._as_bytes(run)).tobytes()
        return array("i", [i for token in self.search(run) for i in self.output[token]]).tobytes()

    def _remembered(self, run: str) -> bytes:
        """Ids of a run that did not occur lately; the runs of late make room for each other by halves."""
        ids = self.earlier.get(run)
        if ids is None:
            ids = self._run_ids(run)
        if len(run) <= MEMORY_CHARS:
            if len(self.recent) >= MEMORY:
                self.earlier = dict(self.recent)
                self.recent.clear()
            self.recent[run] = ids
        return ids

    def encode(self, text: str | None, into: bytearray) -> None:
        """Append the ids of a text, four bytes each."""
        if not text:
            return
        text = (" " if self.vocabulary.prefix else "") + text.replace(MARK, " ")
        recent, remembered, start = self.recent.get, self._remembered, 0
        while start < len(text):
            stop = len(text)
            if start + STRETCH < stop:
                border = self.runs.search(text, start + STRETCH)
                # A run found from its middle on has its true end.
                stop = border.end() if border else stop
            for run in self.runs.findall(text, start, stop):
                into += recent(run) or remembered(run)
            start = stop


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return _lenient(data)


def _lenient(data: bytes) -> str:
    """Decode with one U+FFFD for every byte that belongs to no character."""
    found, at = [], 0
    while at < len(data):
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            found.append(data[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            found.append("\ufffd")
            at += 1
    return "".join(found)


@cache
def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(vocabulary)


@cache
def _decoder(vocabulary: Vocabulary) -> Decoder:
    return Decoder(vocabulary)


def _encode(vocabulary: Vocabulary):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary)
        for batch in texts:
            ids, ends = bytearray(), array("i", [0])
            for text in batch:
                encoder.encode(text.as_py(), ids)
                ends.append(len(ids) // 4)
            flat = pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)])
            offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
            yield pa.ListArray.from_arrays(offsets, flat)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")


def _decode(vocabulary: Vocabulary):
    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _decoder(vocabulary)
        for batch in lists:
            yield decoder.decode_all(batch)

    run.__annotations__ = {"lists": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows (doc, ids), one per input row: the ids of its whole text.

    Null and empty texts have no ids. Repeated rows are encoded one by one; a text may be as long as
    Spark can hold. An empty table gives no rows. Extra columns stay in ``doc`` untouched.
    """
    rows = whole(docs)
    return rows.select("doc", _encode(vocabulary)(held(rows, "text").cast("string")).alias("ids"))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of an array of ids, without ids empty."""
    return _decode(vocabulary)(ids)
