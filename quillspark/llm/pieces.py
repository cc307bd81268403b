"""SentencePiece encoding and decoding of whole texts, for a merge-type model, in Arrow batches.

A merge-type model joins neighbours whose joint text is a piece, the best score first and the leftmost of equals. The
same pieces are found from left to right: take the longest piece that matches here (all matches come from one pass of an
Aho-Corasick automaton), accept it if it stands beside the piece before it, that is if merging the text of both anew
gives just these two, and go back where nothing fits; a bit for each place from which no way leads on keeps every place
from being tried twice. Any text whose neighbouring pieces are all compatible in this way is the merge's own result.

No piece spans two characters that stand side by side in no piece of the model, so texts are first cut at such places
and each kind of segment is encoded once per worker; the segments of a text need no more than its own bytes at once.

Defined results: null and empty text have the end id alone, or nothing without one; U+2581 in a text counts as a space,
as the library has it; characters outside the vocabulary become the ids of their bytes. Models with user-defined or
unused pieces, or with a normaliser other than identity, are not supported.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm import blocks, tokens

#: Beyond so many segments, or pairs of pieces, a worker forgets those it has not met since the last time.
_MAX_SEGMENTS, _MAX_PAIRS = 200_000, 150_000
#: Matches of a long segment are looked up for so many places at once.
_WINDOW = 4_096
_SPACE = "▁"

DECODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("text", T.StringType())])


class MergeModel:
    """The pieces of a model, and texts in them."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        all_ids = range(self.library.get_piece_size())
        odd = lambda k: self.library.is_control(k) or self.library.is_unknown(k) or self.library.is_byte(k) or self.library.is_unused(k)
        self.ids = {self.library.id_to_piece(k).replace(_SPACE, " "): k for k in all_ids if not odd(k)}
        self.scores = {piece: self.library.get_score(k) for piece, k in self.ids.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        #: Whether some piece has byte a before byte b.
        self.beside = np.zeros((256, 256), dtype=bool)
        for piece in self.ids:
            raw = np.frombuffer(piece.encode(), dtype=np.uint8)
            self.beside[raw[:-1], raw[1:]] = True
        self._pairs: dict[tuple[str, str], bool] = {}
        self._older_pairs: dict[tuple[str, str], bool] = {}
        self._segments: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """A short text by merging."""
        parts, score, never = list(text), self.scores.get, float("-inf")
        scores = [score(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == never:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k < len(scores):
                scores[k] = score(parts[k] + parts[k + 1], never)
            if k:
                scores[k - 1] = score(parts[k - 1] + parts[k], never)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether both stay as they are side by side; an empty left asks for the right one alone."""
        known = self._older_pairs.get((left, right))
        if known is None:
            known = self.merge(left + right) == [x for x in (left, right) if x]
        self._pairs[left, right] = known
        return known

    def split(self, text: str) -> list[str]:
        """Pieces, and characters that are none, of a text of any length, by backtracking."""
        matches = _Matches(self, text) if len(text) > _WINDOW else self.matches(text, len(text))
        failed = bytearray(len(text) // 8 + 1)
        known = self._pairs
        pieces: list[str] = []
        tried: list[int] = []  # which match each piece is
        at, end, before = 0, len(text), ""
        k = -1  # the longest match
        while at < end:
            lengths = matches[at]
            if k < 0:
                k += len(lengths)
            else:
                k -= 1
            while k >= 0:
                to = at + lengths[k]
                if not failed[to >> 3] >> (to & 7) & 1:
                    piece = text[at:to]
                    fits = known.get((before, piece))
                    if self.compatible(before, piece) if fits is None else fits:
                        break
                k -= 1
            if k >= 0:
                pieces.append(piece)
                tried.append(k)
                at, before, k = to, piece, -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(pieces.pop())
                before, k = pieces[-1] if pieces else "", tried.pop()
        return pieces

    def matches(self, text: str, places: int) -> list[list[int]]:
        """Lengths of the pieces that begin at each of the first places, ascending; a character alone always counts."""
        found = [[1] for _ in range(places)]
        for last, length in self.automaton.iter(text):
            if length > 1 and last - length + 1 < places:
                found[last - length + 1].append(length)
        return found

    def segment(self, raw: bytes) -> bytes:
        """Ids of a segment as little-endian unsigned 32-bit integers."""
        known = self.ids
        ids: list[int] = []
        for piece in self.split(raw.decode()):
            if piece in known:
                ids.append(known[piece])
            else:
                ids += [self.byte_ids[b] for b in piece.encode()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (spaces marked before each) one after another, and where each text's begin (one more at the end)."""
        starts, ends, before = self.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        if len(self._segments) > _MAX_SEGMENTS:
            self._older, self._segments = self._segments, {}
        if len(self._pairs) > _MAX_PAIRS:
            self._older_pairs, self._pairs = self._pairs, {}
        first, inverse, _ = tokens.distinct(data, starts, ends)
        raw, known, older = data.tobytes(), self._segments, self._older
        found: list[bytes] = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            key = raw[a:b]
            ids = known.get(key)
            if ids is None:
                ids = older.get(key) or self.segment(key)
                if len(key) < 200:
                    known[key] = ids
            found.append(ids)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        places = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(found), dtype="<u4")[blocks.ragged(places[inverse], lengths[inverse])]
        return ids, np.concatenate([[0], np.cumsum(lengths[inverse])])[before]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of segments, and how many come before each text (one more at the end)."""
        border = np.ones(len(data) + 1, dtype=bool)
        border[1:-1] = ~self.beside[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        border[offsets] = True
        places = np.flatnonzero(border)
        return places[:-1], places[1:], np.searchsorted(places[:-1], offsets)


class _Matches:
    """The matches of a long segment, window by window."""

    def __init__(self, model: MergeModel, text: str):
        self.model, self.text = model, text
        self.windows: dict[int, list[list[int]]] = {}

    def __getitem__(self, place: int) -> list[int]:
        number, inner = divmod(place, _WINDOW)
        if number not in self.windows:
            if len(self.windows) > 2:
                self.windows.clear()
            part = self.text[number * _WINDOW : (number + 1) * _WINDOW + self.model.longest - 1]
            self.windows[number] = self.model.matches(part, min(_WINDOW, len(part)))
        return self.windows[number][inner]


_MODELS: dict[str, MergeModel] = {}


def model_for(path: str) -> MergeModel:
    if path not in _MODELS:
        _MODELS[path] = MergeModel(path)
    return _MODELS[path]


def encode_texts(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges first..last of a column, with their ids and where each row's begin (one more at the end)."""
    model = model_for(path)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(column, _SPACE)).as_py():
        column = pc.replace_substring(column, _SPACE, " ")
    data, offsets = blocks.text_buffer(column)
    for first, last in blocks.slices(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        filled = np.flatnonzero(at[1:] > at[:-1])  # every text that isn't empty begins with a space of its own
        part = np.insert(part, at[filled], 0x20)
        at = at + np.searchsorted(filled, np.arange(len(at)))
        ids, begins = model.encode(part, at)
        yield first, last, ids, begins


def encode_documents(documents: DataFrame, path: str, *, end_id: int | None = None) -> DataFrame:
    """doc_id and ids (tokens.TOKENS) of documents (doc_id, text); ``end_id`` is appended to each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in batches:
            for first, last, ids, begins in encode_texts(batch.column("text"), path):
                raw, at = ids.tobytes(), (4 * begins).tolist()
                rows = [raw[a:b] + tail for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last].cast(pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, tokens.TOKENS)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of token rows (tokens.TOKENS), decoded by the library."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model_for(path).library
        for batch in batches:
            column = batch.column("ids")
            texts = [library.decode(np.frombuffer(x, dtype="<u4").tolist()) if x else "" for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column.cast(pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, DECODED)


def round_trip(documents: DataFrame, path: str, *, end_id: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal_digest) and text, encoded and decoded again, in one pass over the documents."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        library = model_for(path).library
        for batch in batches:
            for first, last, ids, begins in encode_texts(batch.column("text"), path):
                rows = [np.concatenate([ids[a:b], tail]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                found = [(len(x), decimal_digest(x), library.decode(x.tolist()) if len(x) else "") for x in rows]
                n, digests, texts = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "text"])

    return documents.select("doc_id", "text").mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, text string")


def decimal_digest(ids: np.ndarray) -> str:
    """Lower-case hex SHA-256 of ids in decimal, joined by one space."""
    digest = hashlib.sha256()
    for a in range(0, len(ids), 1 << 18):
        part = " ".join(map(str, ids[a : a + (1 << 18)].tolist()))
        digest.update((" " if a else "").encode() + part.encode())
    return digest.hexdigest()
