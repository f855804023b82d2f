"""SentencePiece BPE encoding and decoding in linear time with a prefix table.

In merge-type BPE a sequence of tokens is the encoding of its text exactly when each adjacent pair is the encoding of
its own text, and the encoding of a text cut at a token boundary is the encoding of the part. So every prefix of a text
has one last token. An automaton over all pieces lists the pieces that end at each character; the one that is
compatible with the last token before it is stored, and the ids are read backwards from the end. Whether two tokens are
compatible is found by merging the pair alone, and remembered.

Text is cut before each run of word-boundary marks, around line feeds and around punctuation and digits where no piece
of the vocabulary crosses; such segments encode on their own, and short ones are remembered within a task's process (up
to a fixed number). Ids are kept as packed bytes from there to the Arrow column.

Null and empty texts have no ids and decode to the empty text. Every text decodes to itself, but for U+2581, which
stands for a space. Ties and repeated rows play no part; other columns pass through, except that columns named as an
output are replaced. Decoding ids that encoding doesn't produce: control ids are nothing, the unknown id is its
surface, bytes that are no UTF-8 become U+FFFD, an id outside the vocabulary raises.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from traincover.llm.base import smaller

# The mark for a space, and what the unknown id decodes to.
MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "

REMEMBERED = 1 << 17
PAIRS_REMEMBERED = 1_600_000
LONGEST_REMEMBERED = 48
_BATCH = 512


class _Remembered(dict):
    """Packed ids of segments, found by `ids_of` when asked for first. Two generations, so that frequent segments survive
    when the newer one is full."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        self.ids_of = ids_of
        self.older: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        found = self.older.get(segment) or self.ids_of(segment)
        if len(segment) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[segment] = found
        return found


class _Compatible(dict):
    """Whether two tokens, as left * size + right, are the encoding of their text; found by `pair` when asked for first."""

    def __init__(self, size: int, pair: Callable[[int, int], bool]):
        self.size, self.pair = size, pair

    def __missing__(self, both: int) -> bool:
        found = self.pair(*divmod(both, self.size))
        if len(self) >= PAIRS_REMEMBERED:
            self.clear()
        self[both] = found
        return found


class Codec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece

        table = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = n = table.get_piece_size()
        self.unknown = table.unk_id()
        self.surfaces: list[bytes] = []
        self.rank: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_ids = [self.unknown] * 256
        for i in range(n):
            piece = table.id_to_piece(i)
            if table.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surfaces.append(bytes([int(piece[3:5], 16)]))
            elif table.is_control(i) or table.is_unknown(i):
                self.surfaces.append(UNKNOWN_SURFACE.encode() if table.is_unknown(i) else b"")
            else:
                self.surfaces.append(piece.replace(MARK, " ").encode())
                self.rank[piece] = -table.get_score(i)
                self.id_of[piece] = i
        self.piece = {i: piece for piece, i in self.id_of.items()}
        self.length = {i: len(piece) for i, piece in self.piece.items()}
        self.alphabet = {piece for piece in self.rank if len(piece) == 1}
        self.joined = {piece[k: k + 2] for piece in self.rank for k in range(len(piece) - 1)}
        # A piece that its own text doesn't merge to is never an output.
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if len(piece) == 1 or self._merged(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        crossing = any(pair[0] != MARK and pair[1] == MARK for pair in self.joined)
        if crossing:
            self.segments = lambda text: [text]
        elif any("\n" in pair for pair in self.joined):
            self.segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        else:
            self.segments = re.compile(self._cuts()).findall
        self.compatible = _Compatible(n, self._pair)
        self.remembered = _Remembered(lambda segment: array("i", self._segment(segment)).tobytes())

    @property
    def older(self) -> dict[str, bytes]:
        return self.remembered.older

    def _cuts(self) -> str:
        """The pattern of segments: runs of marks go with what follows, punctuation and digits stand apart from the rest."""
        others = {c for c in map(chr, range(33, 127)) if not c.isalpha()}
        pairs = [pair for pair in self.joined if MARK not in pair]
        # What is next to one of them within a piece is one of them, so that no piece crosses.
        while more := {c for a, b in pairs if (a in others) != (b in others) for c in (a, b)} - others:
            others |= more
        own = re.escape("".join(sorted(others)))
        return f"{MARK}*[^{MARK}\n{own}]+|{MARK}*[{own}]+|{MARK}+|\n+"

    def _merged(self, text: str) -> list[str]:
        """Merge the characters of a short text, best pair first, leftmost first among equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their text; `size` on the left stands for the start of a text."""
        if left == self.size:
            return True
        a, b = self.piece[left], self.piece[right]
        return a[-1] + b[0] not in self.joined or self._merged(a + b) == [a, b]

    def _known_segment(self, text: str) -> list[int]:
        """The ids of characters of the vocabulary: fill the table of last tokens, then walk back."""
        last = [0] * (len(text) + 1)  # last token of the prefix that ends with each character, 0: not found yet
        last[-1] = size = self.size  # the start, one before the first character
        compatible = self.compatible
        for end, (token, length) in self.automaton.iter(text):
            if not last[end] and (before := last[end - length]) and compatible[before * size + token]:
                last[end] = token
        ids, lengths, at = [], self.length, len(text) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return ids

    def _segment(self, text: str) -> list[int]:
        if self.alphabet.issuperset(text):
            return self._known_segment(text)
        ids: list[int] = []  # a character outside the vocabulary stands alone, as its bytes
        for known, run in groupby(text, self.alphabet.__contains__):
            if known:
                ids += self._known_segment("".join(run))
            else:
                ids += [self.byte_ids[b] for b in "".join(run).encode("utf-8", "surrogatepass")]
        return ids

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit integers side by side."""
        if not text:
            return b""
        return b"".join(map(self.remembered.__getitem__, self.segments(MARK + text.replace(" ", MARK))))

    def encode(self, text: str | None) -> list[int]:
        return _unpacked(self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.surfaces.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _unpacked(ids: bytes) -> memoryview:
    return memoryview(ids).cast("i")


def _column(packed: list[bytes]) -> pa.ListArray:
    """One list of ids for each text."""
    ends = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One codec for each process and model."""
    return Codec(model)


def read_model(path: str | None = None) -> bytes:
    """The model file's bytes; by default the 32k piece model of the public tokenizers installed here."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _with(docs: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    names = [f.name for f in fields]
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches, _BATCH):
            made = make(batch)
            passed = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in names]
            yield pa.RecordBatch.from_arrays([*passed, *made], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
_DECODED = T.StructField("decoded", T.StringType())


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """`docs` with `ids`, the encoding of `text`."""
    return _with(docs, [_IDS], lambda batch: [_column([*map(codec(model).packed, batch.column("text").to_pylist())])])


def decode(docs: DataFrame, model: bytes) -> DataFrame:
    """`docs` with `decoded`, the text of `ids` (null for null)."""
    return _with(docs, [_DECODED], lambda batch: [
        pa.array([None if ids is None else codec(model).decode(ids) for ids in batch.column("ids").to_pylist()], pa.string())
    ])


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """`docs` with `ids` and with `decoded` made from them, in one pass."""

    def both(batch):
        own = codec(model)
        ids = [own.packed(text) for text in batch.column("text").to_pylist()]
        return [_column(ids), pa.array((own.decode(_unpacked(i)) for i in ids), pa.string())]

    return _with(docs, [_IDS, _DECODED], both)
