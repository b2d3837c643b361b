"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces feeds a Viterbi pass or merges.

The automaton reads the normalised text once; at each position its output links list the pieces that end
there, longest first. What follows is the method that the model file declares. Of a unigram model each
piece relaxes the best score of its position; a character that is no piece costs the least score less
ten; of equal scores the longer last piece wins. Of a BPE model the best score of a whole text means
nothing: its scores are ranks of merges, so of all adjacent parts that make up a listed piece those of
the best rank are merged, the leftmost of equal ones, until none is left. In both a character that is no
piece becomes its UTF-8 bytes.
No piece of a model holds a space sign after another character (checked on loading; otherwise the
whole text is one stretch), so the best path of a text is that of its stretches, and stretches met
lately are kept by the worker.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from fieldweave.llm.common import map_columns, texts

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # fixed values: piece types of the model format
UNIGRAM, BPE = 1, 2  # fixed values: model types
CACHE = 300_000
SHORT = 64  # parts among which the best pair is found by looking at all
NEVER = float("inf")
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]*")
_loaded: dict[int, Pieces] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value (integer or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at:at + size]
        at += size


class Pieces:
    """A SentencePiece model file: its vocabulary with scores, and its space rules."""

    def __init__(self, model: bytes):
        rows, self.dummy, self.trim, charsmap = [], True, True, b""
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                rows.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 3:
                f = dict(_fields(value))
                self.dummy, self.trim, charsmap = bool(f.get(3, 1)), bool(f.get(4, 1)), f.get(2, b"")
        if charsmap:
            raise ValueError("models with a character map are not supported")
        self.unknown = next(i for i, r in enumerate(rows) if r[2] == UNKNOWN)
        self.bytes = {int(r[0][1:-1], 16): i for i, r in enumerate(rows) if r[2] == BYTE}
        scores = [r[1] for r in rows if r[2] == NORMAL]
        self.floor = min(scores, default=0.0) - 10
        most = max(scores, default=0.0)
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score, kind) in enumerate(rows):
            if kind in (NORMAL, USER) and piece:
                self.automaton.add_word(piece, (len(piece), i, len(piece.encode()) * most - 0.1 if kind == USER else score))
        self.automaton.make_automaton()
        self.cut = all(SPACE not in r[0].lstrip(SPACE) for r in rows if r[2] in (NORMAL, USER))
        shown = {BYTE: lambda p: bytes([int(p[1:-1], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        self.raw = [shown.get(kind, lambda p: p.replace(SPACE, " ").encode())(piece) for piece, _, kind in rows]
        self.packed = [struct.pack("<I", i) for i in range(len(rows))]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}  # what ``known`` held before it was full

    @classmethod
    def of(cls, model: bytes) -> Pieces:
        """The model with the method that it declares."""
        key = hash(model)
        if key not in _loaded:
            _loaded[key] = {UNIGRAM: Pieces, BPE: Merges}[declared(model)](model)
        return _loaded[key]

    def normalise(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy:
            text = " " + text
        return text.replace(" ", SPACE)

    def viterbi(self, text: str) -> list[int]:
        """Best ids of a normalised stretch."""
        n = len(text)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        single = -1  # last position that a piece of one character ends at
        at = 0

        def close(upto: int) -> None:
            nonlocal at
            while at < upto:  # position ``at`` + 1 has all its pieces: let an unknown character compete
                at += 1
                if single != at:
                    score = best[at - 1] + self.floor
                    if best[at] is None or score > best[at]:
                        best[at], back[at] = score, (1, -1)

        for end, (size, number, score) in self.automaton.iter(text):
            close(end)
            end += 1
            total = best[end - size] + score
            if best[end] is None or total > best[end]:
                best[end], back[end] = total, (size, number)
            if size == 1:
                single = end
        close(n)
        out: list[int] = []
        while n:
            size, number = back[n]
            if number >= 0:
                out.append(number)
            else:
                out += reversed(self.spelled(text[n - 1]))
            n -= size
        return out[::-1]

    segment = viterbi

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def _stretches(self, text: str) -> list[tuple[bytes, bytes]]:
        """(ids, bytes of those ids) of each stretch; short ones are remembered, and those in use outlive a full cache."""
        text = self.normalise(text)
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        words = STRETCH.findall(text) if self.cut else [text]
        found = list(map(self.known.get, words))
        if None in found:
            found = [f or self._stretch(word) for word, f in zip(words, found)]
        return found

    def _stretch(self, word: str) -> tuple[bytes, bytes]:
        found = self.known.get(word) or self.older.get(word)
        if found is None:
            ids = self.segment(word)
            found = b"".join([self.packed[i] for i in ids]), b"".join([self.raw[i] for i in ids])
        if len(word) < 64:
            self.known[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([ids for ids, _ in self._stretches(text)]), "<u4")

    def both_ways(self, text: str) -> tuple[bytes, str]:
        """Ids of a text, as little-endian unsigned 32-bit numbers, and what they decode to."""
        ids, raw = zip(*self._stretches(text))  # a text has at least one stretch, if an empty one
        return b"".join(ids), self._told(b"".join(raw))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, the leading space sign goes."""
        return self._told(b"".join([self.raw[i] for i in ids]))

    def _told(self, raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


class Merges(Pieces):
    """A BPE model file; its texts are encoded by merges in the order of their ranks."""

    def __init__(self, model: bytes):
        super().__init__(model)
        if any(dict(_fields(value)).get(3, NORMAL) in (USER, UNUSED) for number, value in _fields(model) if number == 1):
            raise ValueError("BPE models with user-defined or unused pieces are not supported")
        self.ranks = {piece: -score for piece, (_, _, score) in self.automaton.items()}
        self.numbers = {piece: number for piece, (_, number, _) in self.automaton.items()}
        self.inner = {piece[i:i + 2] for piece in self.numbers for i in range(len(piece) - 1)}
        self.parts: dict[str, list[int]] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of a normalised stretch. No merge spans two characters that follow each other in no piece, so short ones are cut there."""
        if len(text) > SHORT:
            return self.long(text)
        if len(self.parts) > CACHE:
            self.parts.clear()
        inner, out = self.inner, []
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in inner]
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            ids = self.parts.get(part := text[a:b])
            if ids is None:
                ids = self.parts[part] = self.short(part)
            out += ids
        return out

    def short(self, text: str) -> list[int]:
        """Ids of a stretch with few parts: the best pair is looked for anew after every merge."""
        rank, parts = self.ranks.get, list(text)
        pairs = [rank(text[i:i + 2], NEVER) for i in range(len(text) - 1)]
        while pairs and (best := min(pairs)) != NEVER:
            i = pairs.index(best)
            parts[i] = part = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + part, NEVER)
            if i < len(pairs):
                pairs[i] = rank(part + parts[i + 1], NEVER)
        numbers = self.numbers
        try:
            return [numbers[part] for part in parts]
        except KeyError:  # a character that is no piece
            out: list[int] = []
        for part in parts:
            out += [numbers[part]] if part in numbers else self.spelled(part)
        return out

    def long(self, text: str) -> list[int]:
        """Ids of a stretch of any length: pairs wait in a heap, all pieces of the text are listed once."""
        n = len(text)
        wide = n + 1
        listed = {(end + 1 - size) * wide + end + 1: (-score, number) for end, (size, number, score) in self.automaton.iter(text)}
        after = list(range(1, n + 1))  # where the part that starts here ends, 0 if none starts here
        before = list(range(-1, n))  # where the part that ends here starts
        heap = [(listed[i * wide + i + 2][0], i, i + 1, i + 2) for i in range(n - 1) if i * wide + i + 2 in listed]
        heapq.heapify(heap)
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if after[start] != middle or after[middle] != end:
                continue
            after[start], after[middle], before[end] = end, 0, start
            if start and (spot := before[start] * wide + end) in listed:
                heapq.heappush(heap, (listed[spot][0], before[start], start, end))
            if end < n and (spot := start * wide + after[end]) in listed:
                heapq.heappush(heap, (listed[spot][0], start, end, after[end]))
        out: list[int] = []
        at = 0
        while at < n:
            piece = listed.get(at * wide + after[at])
            out += [piece[1]] if piece else self.spelled(text[at])
            at = after[at]
        return out


def declared(model: bytes) -> int:
    """The model type in the file's trainer settings."""
    return next((dict(_fields(value)).get(3, UNIGRAM) for number, value in _fields(model) if number == 2), UNIGRAM)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Adds piece_ids (array of int). Null and empty texts have no ids.

    Texts are read whole. Rows are kept as they are; an input column named piece_ids is replaced. An
    empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    run = lambda batch: {"piece_ids": [Pieces.of(model.value).encode(t).astype(np.int32) for t in texts(batch, text_col)]}
    return map_columns(docs, run, piece_ids=T.ArrayType(T.IntegerType()))


def decode_texts(docs: DataFrame, model_path: str, ids_col: str = "piece_ids") -> DataFrame:
    """Adds decoded (string), the text of an array of ids; a null array is the empty text, ids must be in the vocabulary."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    ids = lambda x: x.values.drop_null().to_numpy().tolist() if x.is_valid else []
    run = lambda batch: {"decoded": [Pieces.of(model.value).decode(ids(x)) for x in batch.column(ids_col)]}
    return map_columns(docs, run, decoded=T.StringType())


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_crc32, decoded_sha256, round_trip) of whole texts, encoded and decoded in one pass.

    ids_crc32 is of the ids as little-endian unsigned 32-bit numbers; round_trip says whether decoding gives
    the text (null: empty) back. Rows without or with a repeated id are digested like any others; other
    columns are not read. An empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        own = Pieces.of(model.value)
        given = texts(batch, text_col)
        found = [own.both_ways(t) for t in given]
        return {
            "n_pieces": [len(ids) // 4 for ids, _ in found], "ids_crc32": [zlib.crc32(ids) for ids, _ in found],
            "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, t in found], "round_trip": [t == g for (_, t), g in zip(found, given)],
        }

    added = {"n_pieces": T.LongType(), "ids_crc32": T.LongType(), "decoded_sha256": T.StringType(), "round_trip": T.BooleanType()}
    return map_columns(docs.select(id_col, text_col), run, drop=(text_col,), **added)


def pieces_report(docs: DataFrame) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    import public_tokenizers

    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
