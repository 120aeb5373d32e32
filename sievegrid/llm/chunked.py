"""Encoding by a tokenizer file of the `tokenizers` library, with the ids of recurring chunks kept.

A text is cut only where the tokenizer's own splitting can't reach across, so that the ids of the
chunks, put together, are the ids of the text. Cutting, telling chunks apart and putting ids together are array
operations over the bytes of many texts; the library encodes each chunk that a table bounded in bytes lacks.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of letters kept per worker process, at 50 bytes or so each; half of them at least are the latest.
KEPT_WORDS = 500_000
#: Longer chunks of letters, and those of other characters, are kept as Python objects: so many, of so many bytes at most.
KEPT_OTHERS, OTHER_BYTES = 20_000, 64
#: Bytes of a chunk in the table of words, a multiple of eight.
WIDTH = 24
#: Texts are encoded in groups of about this many bytes.
GROUP_BYTES = 2 << 20

# kinds of bytes; OTHER is all that may compose with, fold into or be white space to a neighbour: never cut beside it
OTHER, BLANK, SPACE, LETTER, MARK, DIGIT, APOSTROPHE, LEAD = range(8)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    for chars, k in (("\t\n\v\f\r", BLANK), (" ", SPACE), (string.ascii_letters, LETTER), (string.punctuation, MARK), (string.digits, DIGIT), ("'", APOSTROPHE)):
        kind[list(chars.encode())] = k
    kind[[0xC3, 0xC4, 0xC5]] = LEAD  # of two bytes: U+00C0 to U+017F
    return kind


KIND = _kinds()
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Byte-level vocabularies write each byte as a printable character: those that are none are numbered from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b if b in _PRINTABLE else 256 + n for b, n in zip([*_PRINTABLE, *sorted(set(range(256)) - set(_PRINTABLE))], [0] * len(_PRINTABLE) + list(range(256)), strict=False)}
#: Words are put together with line ends, which stay what they are.
_AS_CHARS = {b: c for b, c in BYTE_CHARS.items() if b != 10}

_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def drops_spaces(path: str) -> bool:
    """Whether a tokenizer lower-cases and drops white space, or leaves a single space to the word after it, as byte-level
    patterns of the GPT-2 kind do. Chunks are cut in one of these two ways; a file of another kind is an error."""
    parts = json.loads(Path(path).read_text())
    steps = [n.get("type") for n in (parts["normalizer"] or {}).get("normalizers", [])]
    split = parts["pre_tokenizer"] or {}
    if steps == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in split.get("pretokenizers", [])] == ["Split", "ByteLevel"] and split["pretokenizers"][0].get("invert"):
        return True
    if parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
        return False
    raise ValueError(f"no way to cut texts for {path}")


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (an array of strings without nulls) and the places between which each lies."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def _kinds_of(data: np.ndarray) -> np.ndarray:
    kind = KIND[data]
    lead = np.flatnonzero(kind == LEAD)
    first, second = data[lead], data[lead + 1]
    # all letters but for the signs of multiplication and division, and a capital that lower case makes two characters of
    letter = ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC4) & (second == 0xB0))
    kind[lead] = np.where(letter, LETTER, OTHER)
    kind[lead[letter] + 1] = LETTER
    return kind


class WordTable:
    """Chunks of letters and their ids as arrays. New ones form runs, sorted by hash, that are merged at times; a full
    table becomes the older half, whose entries move on when used."""

    def __init__(self, most: int = KEPT_WORDS):
        self.half = most // 2
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.older: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def keys(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each chunk, zeros behind them, as whole numbers, and a hash of these."""
        at = first[:, None] + np.arange(WIDTH)
        wide = np.where(np.arange(WIDTH) < size[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8).view(np.uint64)
        hashed = np.zeros(len(first), np.uint64)
        for k in range(wide.shape[1]):
            hashed = (hashed ^ wide[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        return wide, hashed

    def find(self, wide: np.ndarray, hashed: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Blobs of ids, and of each chunk which blob has its ids (-1: none) and where."""
        blobs, blob, place = [], np.full(len(hashed), -1), np.zeros((len(hashed), 2), np.int64)
        rest = np.argsort(hashed)
        for run in (*self.runs[::-1], *self.older):
            hashes, chunks, start, many, ids = run
            at = np.minimum(np.searchsorted(hashes, hashed[rest]), len(hashes) - 1)
            hit = (chunks[at] == wide[rest]).all(1)
            got, at = rest[hit], at[hit]
            blob[got], place[got] = len(blobs), np.stack([start[at], many[at]], 1)
            blobs.append(ids)
            rest = rest[~hit]
        return blobs, blob, place

    def add(self, wide: np.ndarray, hashed: np.ndarray, many: np.ndarray, ids: np.ndarray) -> None:
        """Different chunks, and one after another their ids; of two with one hash either may be missed later, and only that."""
        if not len(hashed):
            return
        order = np.argsort(hashed)
        self.runs.append((hashed[order], wide[order], (np.cumsum(many) - many)[order].astype(np.int32), many[order].astype(np.int32), ids.astype(np.uint32)))
        if len(self.runs) > 4 and len(self.runs[0][0]) < 4 * sum(len(r[0]) for r in self.runs[1:]):
            self.runs = [self._merged(self.runs)]
        elif len(self.runs) > 8:
            self.runs[1:] = [self._merged(self.runs[1:])]
        if sum(len(r[0]) for r in self.runs) > self.half:
            self.runs, self.older = [], [self._merged(self.runs)]

    @staticmethod
    def _merged(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        shift = np.cumsum([0, *[len(r[4]) for r in runs[:-1]]])
        hashes = np.concatenate([r[0] for r in runs])
        order = np.argsort(hashes)
        start = np.concatenate([r[2] + s for r, s in zip(runs, shift, strict=True)])
        return hashes[order], np.concatenate([r[1] for r in runs])[order], start[order].astype(np.int32), np.concatenate([r[3] for r in runs])[order], np.concatenate([r[4] for r in runs])


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … as many as many[0] says, then the same from first[1] on, and so forth."""
    end = np.cumsum(many)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - end + many, many)


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = WhitespaceSplit()
        self.at_spaces = drops_spaces(path)
        self.words = WordTable()
        self.others: dict[bytes, np.ndarray] = {}

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each text its ids, as little-endian unsigned 32-bit integers. texts: an array of strings without nulls."""
        first, size = 0, 0
        for n, length in enumerate(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
            size += int(length)
            if size >= GROUP_BYTES:
                yield from self._encode_group(texts.slice(first, n + 1 - first))
                first, size = n + 1, 0
        yield from self._encode_group(texts.slice(first))

    def _encode_group(self, texts: pa.Array) -> Iterator[bytes]:
        """Strings of special tokens, with their capitals, hold in raw text: where one may be, only white space cuts."""
        special = pc.match_substring(texts, "<|")
        if not pc.any(special).as_py():
            return iter(self._encode(texts, True))
        plain, other = iter(self._encode(texts.filter(pc.invert(special)), True)), iter(self._encode(texts.filter(special), False))
        return (next(other if s else plain) for s in special.to_pylist())

    def _encode(self, texts: pa.Array, fine: bool) -> list[bytes]:
        data, at = _text_bytes(texts)
        if not len(data):
            return [b""] * len(texts)
        kind = _kinds_of(data)
        if not fine:
            kind[kind >= LETTER] = APOSTROPHE
        elif self.at_spaces:
            data = LOWER[data]
        filled = at[:-1] < at[1:]
        first, after = at[:-1][filled], at[1:][filled]
        begin, keep = self._at_spaces(kind, first) if self.at_spaces else self._before_spaces(kind, first, after, fine)
        bounds = np.searchsorted(np.flatnonzero(begin), at)  # between which chunks each text lies
        kept = data if keep is None else data[keep]
        starts = np.flatnonzero(begin if keep is None else begin[keep])
        if not len(starts):
            return [b""] * len(texts)
        offsets = np.append(starts, len(kept)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))]).dictionary_encode()
        blob, place, n = self._ids(chunks.dictionary)
        code = np.asarray(chunks.indices)
        every = blob[spread(place[code], n[code])]
        cuts = np.append(0, np.cumsum(n[code]))[bounds]
        return [every[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @staticmethod
    def _inner(kind: np.ndarray) -> np.ndarray:
        """Between letters, punctuation and digits. Of the apostrophe some contractions hold fast."""
        known = (kind >= LETTER) & (kind <= DIGIT)
        return (kind[1:] != kind[:-1]) & known[1:] & known[:-1]

    @classmethod
    def _at_spaces(cls, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks begin, and the bytes that belong to any: white space is left out."""
        solid = (kind != BLANK) & (kind != SPACE)
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | cls._inner(kind)
        begin[first] = solid[first]
        return begin, solid

    @classmethod
    def _before_spaces(cls, kind: np.ndarray, first: np.ndarray, after: np.ndarray, fine: bool) -> tuple[np.ndarray, None]:
        """Where chunks begin: at white space after a word, at the last of a run before a word, which only a space
        belongs to; if not fine, at single spaces between words alone. All bytes belong to a chunk."""
        solid, blank = kind >= LETTER, (kind == BLANK) | (kind == SPACE)
        following = np.append(solid[1:], False)
        following[after - 1] = False
        begin = np.zeros(len(kind), bool)
        if fine:
            begin[1:] = solid[:-1] & blank[1:] | blank[:-1] & blank[1:] & following[1:] | (kind[:-1] == BLANK) & solid[1:] | cls._inner(kind)
        else:
            begin[1:] = solid[:-1] & (kind[1:] == SPACE) & following[1:]
        begin[first] = True
        return begin, None

    def _ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different chunks: ids of all, and where in them and how many each has."""
        at = np.frombuffer(chunks.buffers()[1], np.int32)[: len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[: at[-1]]
        first, size = at[:-1], np.diff(at)
        strange = np.append(0, np.cumsum(_kinds_of(data) != LETTER))
        space = (data[first] == 32) & (size > 1)
        word = (strange[at[1:]] - strange[first] == space) & (size <= WIDTH)
        words, others = np.flatnonzero(word), np.flatnonzero(~word)

        place, n = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        wide, hashed = self.words.keys(data, first[words], size[words])
        blobs, blob, of_words = self.words.find(wide, hashed)
        # what is new, or in the older half, which comes last
        missing, stale = np.flatnonzero(blob < 0), np.flatnonzero(blob == len(self.words.runs))
        many, ids = self._encode_words(data, first[words[missing]], size[words[missing]])
        of_words[missing] = np.stack([np.cumsum(many) - many, many], 1)
        blobs.append(ids)
        blob[missing] = len(blobs) - 1
        used = []
        for b, values in enumerate(blobs):
            mine = np.flatnonzero(blob == b)
            used.append(values[spread(of_words[mine, 0], of_words[mine, 1])])
            place[words[mine]] = sum(map(len, used[:-1])) + np.cumsum(of_words[mine, 1]) - of_words[mine, 1]
        n[words] = of_words[:, 1]
        if len(stale) and self.words.older:
            ids = np.concatenate([self.words.older[0][4][spread(*of_words[stale].T)], ids])
            missing, many = np.concatenate([stale, missing]), np.concatenate([of_words[stale, 1], many])
        self.words.add(wide[missing], hashed[missing], many, ids)

        of_others = self._encode_others([data[first[i] : at[i + 1]].tobytes() for i in others])
        n[others] = [len(x) for x in of_others]
        place[others] = sum(map(len, used)) + np.cumsum(n[others]) - n[others]
        return np.concatenate([*used, *of_others]), place, n

    def _encode_words(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk of letters has, and all of them. The tokenizer splits none further, so its model gets them
        many in one string, which is far less work for the library than a string each."""
        apart = np.full((size + 1).sum(), 10, np.uint8)
        inside = np.ones(len(apart), bool)
        inside[np.cumsum(size + 1) - 1] = False
        apart[inside] = data[spread(first, size)]
        ends = np.append(0, np.cumsum(size + 1))[[*range(0, len(size), 500), len(size)]]
        strings = [apart[a : b - 1].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if self.at_spaces:
            strings = [s.lower() if s.isascii() else s.decode().lower().encode() for s in strings]
        encoded = self.of_words.encode_batch([s.decode("latin-1").translate(_AS_CHARS) for s in strings], add_special_tokens=False)
        many = [np.bincount(np.array(e.word_ids, np.int64), minlength=min(500, len(size) - 500 * i)) for i, e in enumerate(encoded)]
        return np.concatenate([np.empty(0, np.int64), *many]), np.concatenate([np.empty(0, np.uint32), *[np.array(e.ids, np.uint32) for e in encoded]])

    def _encode_others(self, chunks: list[bytes]) -> list[np.ndarray]:
        known = self.others
        missing = [c for c in chunks if c not in known]
        for chunk, encoding in zip(missing, self.tokenizer.encode_batch_fast([c.decode() for c in missing], add_special_tokens=False), strict=True):
            known[chunk] = np.array(encoding.ids, np.uint32)
        found = [known[c] for c in chunks]
        for chunk in missing:
            if len(chunk) > OTHER_BYTES:
                del known[chunk]
        if len(known) > KEPT_OTHERS:
            known.clear()
        return found
