"""Token ids of whole texts with a public tokenizer, in Arrow batches.

Byte-pair merging never crosses a pre-token, and pre-tokens never cross ASCII white space nor a border between an ASCII
letter and ASCII punctuation other than the apostrophe (the pattern of the word tokenizer; its normaliser works on
neighbouring characters only). So texts are cut at those places, every distinct piece is encoded once per worker, and
the ids of a text are gathered from its pieces. Pieces are told apart by their bytes: those of up to 7 are a number,
longer ones meet by hash within a batch and are then compared. ``piecewise=False`` encodes whole texts; both give
equal ids.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from quillspark.llm import blocks

#: Ids of one text as little-endian unsigned 32-bit integers.
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])

_CACHES: dict[str, PieceCache] = {}
#: A worker forgets its pieces beyond so many, so many ids, or so many bytes of long pieces: about 80 MB in all.
_MAX_PIECES, _MAX_IDS, _MAX_BYTES = 400_000, 4_000_000, 16_000_000

_SPACE = blocks.byte_class(b" \t\n\r")
_LETTER = np.zeros(256, dtype=np.int8)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = 1
_PUNCT = np.zeros(256, dtype=np.int8)
_PUNCT[0x21:0x30] = _PUNCT[0x3A:0x41] = _PUNCT[0x5B:0x61] = _PUNCT[0x7B:0x7F] = 1
_PUNCT[0x27] = 0  # the apostrophe may begin a contraction


class PieceCache:
    """Ids of pieces, for one tokenizer in one worker; a piece's key is its bytes, short ones as a number."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[int | bytes, int] = {}
        self.held = 0
        self.starts = np.zeros(1 << 10, dtype=np.int64)
        self.lengths = np.zeros(1 << 10, dtype=np.int64)
        self.ids = np.zeros(1 << 12, dtype=np.uint32)
        self.n_ids = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def add(self, keys: list[int | bytes], pieces: list[str]) -> np.ndarray:
        """Encode new pieces, those of ASCII letters, one pre-token each, many to a call; return their places."""
        first = len(self.known)
        lengths = np.zeros(len(pieces), dtype=np.int64)
        is_plain = np.fromiter((x.isascii() and x.isalpha() for x in pieces), dtype=bool, count=len(pieces))
        plain, other = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        words = [pieces[k] for k in plain.tolist()]
        flat: list[int] = []
        for a in range(0, len(words), 64):
            encoded = self.tokenizer.encode(" ".join(words[a : a + 64]), add_special_tokens=False)
            flat += encoded.ids
            lengths[plain[a : a + 64]] = np.bincount(encoded.word_ids, minlength=len(words[a : a + 64]))
        for k, encoded in zip(other.tolist(), self.tokenizer.encode_batch_fast([pieces[k] for k in other.tolist()], add_special_tokens=False), strict=True):
            flat += encoded.ids
            lengths[k] = len(encoded)
        order = np.concatenate([plain, other])
        lengths = lengths[order]
        while first + len(keys) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.lengths[first : first + len(keys)] = lengths
        self.starts[first : first + len(keys)] = self.n_ids + np.cumsum(lengths) - lengths
        self.n_ids += len(flat)
        places = np.empty(len(keys), dtype=np.int64)
        places[order] = np.arange(first, first + len(keys))
        self.known.update(zip(keys, places.tolist(), strict=True))
        return places

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more at the end)."""
        lower = blocks.ASCII_LOWER[data]
        starts, ends, before = piece_spans(lower, offsets)
        if len(self.known) > _MAX_PIECES or self.n_ids > _MAX_IDS or self.held > _MAX_BYTES:
            self.clear()
        first, inverse, numbers = distinct(lower, starts, ends)
        raw = lower.tobytes()
        at, to = starts[first], ends[first]
        keys: list[int | bytes] = numbers.tolist()
        long = to - at > 7
        for k, a, b in zip(np.flatnonzero(long).tolist(), at[long].tolist(), to[long].tolist(), strict=True):
            keys[k] = raw[a:b]
        place = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            pieces = [raw[a:b].decode() for a, b in zip(at[new].tolist(), to[new].tolist(), strict=True)]
            place[new] = self.add([keys[k] for k in new.tolist()], pieces)
            self.held += int((to - at)[new][long[new]].sum())
        place = place[inverse]
        lengths = self.lengths[place]
        ids = self.ids[blocks.ragged(self.starts[place], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[before]


def distinct(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A piece of each kind, of which of them each piece is, and each kind's number, which for kinds of up to 7 bytes
    is their bytes and length. Equal bytes are one kind, others never."""
    lengths = ends - starts
    short = lengths < 8
    key = np.zeros(len(starts), dtype=np.uint64)
    key[short] = blocks.eights(lower)[starts[short]] & blocks.LOW_BYTES[lengths[short]] | lengths[short].astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(~short)
    key[long] = blocks.word_hashes(lower, starts[long], ends[long]) | np.uint64(1 << 63)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    like = first[inverse[long]]
    same = lengths[like] == lengths[long]
    same[same] = blocks.same_bytes(lower, starts[long][same], ends[long][same], lower, starts[like][same])
    if not same.all():  # different pieces with one hash: each kind of them by its bytes
        raw, kinds, more = lower.tobytes(), {}, []
        for k in long[~same].tolist():
            piece = raw[starts[k] : ends[k]]
            if piece not in kinds:
                kinds[piece] = len(first) + len(more)
                more.append(k)
            inverse[k] = kinds[piece]
        first = np.concatenate([first, np.array(more, dtype=np.int64)])
    return first, inverse, key[first]


def piece_spans(lower: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As blocks.word_spans, for the pieces of this module."""
    n = len(lower)
    inside = np.zeros(n + 1, dtype=bool)
    np.logical_not(_SPACE[lower], out=inside[:-1])
    border = np.ones(n + 1, dtype=bool)  # a piece may begin here and end before here
    letter, punct = _LETTER[lower], _PUNCT[lower]
    border[1:-1] = (letter[1:] & punct[:-1] | punct[1:] & letter[:-1]) != 0
    border[offsets] = True
    first = border.copy()
    first[1:] |= ~inside[:-1]
    starts = np.flatnonzero(first & inside)
    last = border[1:] | ~inside[1:]
    ends = np.flatnonzero(last & inside[:-1]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def cache_for(path: str) -> PieceCache:
    if path not in _CACHES:
        _CACHES[path] = PieceCache(path)
    return _CACHES[path]


def encode_texts(column: pa.Array, path: str, *, piecewise: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges first..last of a column, with their ids and where each row's begin (one more at the end)."""
    cache = cache_for(path)
    data, offsets = blocks.text_buffer(column)
    for first, last in blocks.slices(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        raw = part.tobytes()
        if piecewise and not any(s in raw for s in cache.special):
            ids, begins = cache.encode(part, at)
        else:  # special tokens' own strings may hold any characters
            each = [cache.whole(raw[a:b].decode()) for a, b in zip(at[:-1], at[1:], strict=True)]
            ids = np.concatenate(each) if each else np.zeros(0, dtype=np.uint32)
            begins = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        yield first, last, ids, begins
