"""SentencePiece BPE encoding and decoding.

A text is encoded by merges: of all neighbouring pieces whose joined text is a
piece, those with the best score become one, the first of equals first.  Such an
encoding is the only sequence of pieces in which every two neighbours are
compatible: merging the text of the two alone gives the two again, because a
merge across their border would have been due in the whole text as well.  So a
text is encoded from the left by the longest piece that matches; a piece must be
compatible with the one before it, or a shorter one is tried; where none is left,
the last piece is taken back and its end is marked in a bit field of positions
that lead nowhere.  No position fails twice, so the work is linear in the text.

Matches of all pieces come from one Aho-Corasick pass.  Whether two pieces are
compatible is found by merging them once and remembered.  Pieces that merging
their own text would not give are never used.

No piece holds characters of two chunks if a text is cut where a pair of
neighbouring characters is in no piece.  Cuts before white space and between
Latin letters and other characters are tested against the vocabulary when it is
loaded.  Chunks repeat, so a task remembers what it has encoded, a bounded
number of chunks.  Documents are encoded where they are read, without a shuffle.

The model must be a BPE model that keeps its text: no character map, white space
kept, one space put in front, bytes for unknown characters.  Others are refused.

Cases: a null or empty text has no ids and decodes to an empty text.  Texts are
encoded whole.  Rows that repeat an id are encoded each on its own.  An empty
table gives an empty result.  Columns of the input are kept, those called like an
added one are replaced.
"""

from __future__ import annotations

import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import need, once_per_worker

#: Stands for a space in pieces.
SPACE = "▁"
#: A match is a piece's number, shifted by so many bits, and its length; a pair is left * PAIR + right.
BITS, LENGTH, PAIR = 8, 255, 1 << 22
#: Letters of which words are made that end before another character.
LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
#: Chunks that a task remembers, and as many that it has not seen for longer.
CHUNKS = 550_000
#: Pairs of pieces that a task remembers.
PAIRS = 700_000
#: Longest chunk that is remembered.
CHUNK_LENGTH = 64
#: Documents that are encoded at a time.
TOGETHER = 200

#: Texts that tell whether a model keeps its text (ligature, wide digit, spaces, controls).
PROBES = ("ﬁ ２", " a  b ", "\ta\nb", "é 　x", "​­x")


class Vocabulary:
    """Pieces, scores and bytes of a model file, and the encoder made of them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in PROBES:
            if model.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
                raise ValueError(f"{path} changes texts before it encodes them")
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.names = [""] * size
        raw = [b""] * size
        self.byte_ids = [model.unk_id()] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], raw[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.names[i], raw[i] = piece, piece.replace(SPACE, " ").encode()
        if model.unk_id() in self.byte_ids:
            raise ValueError(f"{path} has no bytes for unknown characters")
        self.raw = pa.array(raw, pa.binary())
        if max(map(len, self.ids)) > LENGTH or size >= PAIR >> 1:
            raise ValueError(f"{path} has too long or too many pieces")
        self.matches = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.matches.add_word(piece, i << BITS | len(piece))
        self.matches.make_automaton()
        self.chunk = self._chunks()
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _chunks(self) -> re.Pattern:
        """Where a text may be cut: before spaces, and between letters and other characters."""
        borders = {(a, b) for piece in self.ids for a, b in zip(piece, piece[1:], strict=False)}
        space = any(b == SPACE != a for a, b in borders)
        letter = re.compile(f"[{LETTERS}]")
        marks = any(
            SPACE not in (a, b) and bool(letter.match(a)) != bool(letter.match(b)) for a, b in borders
        )
        word = f" *[{LETTERS}]+| *[^{LETTERS} ]+| +"
        parts = {(False, False): word, (False, True): " *[^ ]+| +"}
        return re.compile(parts.get((space, marks), r"(?s:.+)"))

    def merged(self, text: str) -> list[str]:
        """The pieces of a text by merging: best score first, then leftmost."""
        pieces: list[str | None] = list(text)
        after = list(range(1, len(pieces) + 1))
        before = list(range(-1, len(pieces) - 1))
        due: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(pieces):
                score = self.scores.get(pieces[i] + pieces[j])
                if score is not None:
                    heapq.heappush(due, (-score, i, pieces[i], pieces[j]))

        for i in range(len(pieces) - 1):
            offer(i)
        while due:
            _, i, a, b = heapq.heappop(due)
            j = after[i]
            if pieces[i] != a or j >= len(pieces) or pieces[j] != b:
                continue
            pieces[i], pieces[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(pieces):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in pieces if p is not None]

    def _text(self, piece: int) -> str:
        """Text of a piece; numbers above the vocabulary are characters that are no piece."""
        if piece < 0:
            return ""
        return self.names[piece] if piece < len(self.names) else chr(piece - len(self.names))

    def fits(self, left: int, right: int) -> bool:
        """Whether the two stay as they are when their joined text is merged; -1 is the start."""
        a, b = self._text(left), self._text(right)
        found = self.merged(a + b) == ([a, b] if a else [b])
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[left * PAIR + right] = found
        return found

    def pieces(self, text: str) -> list[int]:
        """The pieces of a text by backtracking over its matches."""
        n = len(text)
        starting: list[list[int] | None] = [None] * n  # number and length of the matches, longest last
        for end, match in self.matches.iter(text):
            at = end + 1 - (match & LENGTH)
            if starting[at]:
                starting[at].append(match)
            else:
                starting[at] = [match]
        for at, matches in enumerate(starting):
            if not matches:
                starting[at] = [self._alone(text[at])]
            elif matches[0] & LENGTH != 1:
                matches.insert(0, self._alone(text[at]))
        compatible, fits = self.compatible, self.fits
        dead = bytearray(n // 8 + 1)  # ends from which nothing fits
        found: list[int] = []
        left: list[int] = []  # how many matches are still untried at the place of each piece
        last, at, k = -1, 0, len(starting[0]) if n else 0
        while at < n:
            matches = starting[at]
            while k:
                k -= 1
                match = matches[k]
                piece = match >> BITS
                good = compatible.get(last * PAIR + piece)
                if good is None:
                    good = fits(last, piece)
                if good:
                    end = at + (match & LENGTH)
                    if not dead[end >> 3] >> (end & 7) & 1:
                        left.append(k)
                        found.append(match)
                        last, at, k = piece, end, len(starting[end]) if end < n else 0
                        break
            else:
                dead[at >> 3] |= 1 << (at & 7)
                at -= found.pop() & LENGTH
                k = left.pop()
                last = found[-1] >> BITS if found else -1
        return [match >> BITS for match in found]

    def _alone(self, character: str) -> int:
        """Match of a single character that is no piece."""
        return (len(self.names) + ord(character)) << BITS | 1

    def _packed(self, chunk: str) -> bytes:
        out: list[int] = []
        for piece in self.pieces(chunk):
            if piece < len(self.names):
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in self._text(piece).encode()]
        return np.array(out, np.int32).tobytes()

    def _learnt(self, chunk: str) -> bytes:
        packed = self.known.get(chunk)  # it may have been learnt in the same text
        if packed is None:
            packed = self.older.get(chunk)
            if packed is None:
                packed = self._packed(chunk.replace(" ", SPACE))
            if len(chunk) <= CHUNK_LENGTH:
                if len(self.known) >= CHUNKS:
                    self.older, self.known = self.known, {}
                self.known[chunk] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        chunks = self.chunk.findall(" " + text.replace(SPACE, " "))
        parts = list(map(self.known.get, chunks))
        if None in parts:
            parts = [self._learnt(c) if p is None else p for c, p in zip(chunks, parts, strict=True)]
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, without the space in front; broken bytes become U+FFFD."""
        pieces = self.raw.take(lists.flatten())
        ends = np.frombuffer(pieces.buffers()[1], np.int32)
        ends = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        buffers = [None, pa.py_buffer(ends), pieces.buffers()[2]]
        texts = pa.Array.from_buffers(pa.binary(), len(lists), buffers).to_pylist()
        return pa.array([t.decode("utf-8", "replace").removeprefix(" ") for t in texts], pa.string())


def vocabulary(path: str) -> Vocabulary:
    """One per worker and file, with what it has learnt."""
    return once_per_worker(f"pieces {path}", lambda: Vocabulary(path))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *values])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encoded(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds ``ids``: array<int> of every text."""
    need(docs, text)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = vocabulary(model_path).encode
        parts = [
            _lists([encode(t or "") for t in texts.slice(k, TOGETHER).to_pylist()])
            for k in range(0, max(len(texts), 1), TOGETHER)
        ]
        return pa.concat_arrays(parts)

    return docs.withColumn("ids", ids(text))


def decoded(ids: Column, model_path: str) -> Column:
    """The text that the ids stand for."""

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        decode = vocabulary(model_path).decode
        starts = range(0, max(len(lists), 1), TOGETHER)
        return pa.concat_arrays([decode(lists.slice(k, TOGETHER)) for k in starts])

    return text(ids)
