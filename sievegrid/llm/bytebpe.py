"""Byte-level BPE by ranks, as a reduction over a tree: halves are encoded, then joined at the seam.

Joining two encoded halves encodes a window of tokens around the seam anew and lets it grow until the
tokens outside can't change: a sequence of tokens is the encoding of its bytes if and only if each two
neighbours are the encoding of theirs. So it is enough to test the two pairs where the window ends.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sievegrid.llm.common import id_and_text

#: Results kept per worker process, for each kind.
KEPT = 300_000
KEPT_BYTES = 48

_CODERS: dict[tuple[str, str], TreeBPE] = {}


def coder(ranks_path: str, pattern: str) -> TreeBPE:
    """The coder of this process."""
    if (ranks_path, pattern) not in _CODERS:
        _CODERS[ranks_path, pattern] = TreeBPE(ranks_path, pattern)
    return _CODERS[ranks_path, pattern]


class TreeBPE:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.trees: dict[bytes, tuple[bytes, ...]] = {}
        self.windows: dict[bytes, tuple[bytes, ...]] = {}
        self.words: dict[str, tuple[str, int]] = {}

    def merged(self, part: bytes) -> tuple[bytes, ...]:
        """The merges themselves, lowest rank first: for windows, which are a few tokens long."""
        if (found := self.windows.get(part)) is not None:
            return found
        tokens, rank = [part[i : i + 1] for i in range(len(part))], self.ranks.get
        while len(tokens) > 1:
            best = min(range(len(tokens) - 1), key=lambda i: rank(tokens[i] + tokens[i + 1], 1 << 60))
            if tokens[best] + tokens[best + 1] not in self.ranks:
                break
            tokens[best : best + 2] = [tokens[best] + tokens[best + 1]]
        if len(self.windows) > KEPT:
            self.windows.clear()
        if len(part) <= KEPT_BYTES:
            self.windows[part] = tuple(tokens)
        return tuple(tokens)

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether these neighbours stay as they are when encoded together."""
        return self.merged(left + right) == (left, right)

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        n = 1
        while True:
            seam = self.merged(b"".join(left[-n:] + right[:n]))
            if (n >= len(left) or self.stable(left[-n - 1], seam[0])) and (n >= len(right) or self.stable(seam[-1], right[n])):
                return left[:-n] + seam + right[n:]
            n *= 2

    def tree(self, part: bytes) -> tuple[bytes, ...]:
        if len(part) == 1:
            return (part,)
        if (found := self.trees.get(part)) is None:
            half = len(part) // 2
            found = self.join(self.tree(part[:half]), self.tree(part[half:]))
            if len(part) <= KEPT_BYTES // 2:
                if len(self.trees) > KEPT:
                    self.trees.clear()
                self.trees[part] = found
        return found

    def piece(self, text: str) -> tuple[str, int]:
        """Of one match of the pattern: its ids, joined by commas, and how many. What is a token as it stands stays one."""
        part = text.encode()
        ids = [self.ranks[part]] if part in self.ranks else [self.ranks[token] for token in self.tree(part)]
        return ",".join(map(str, ids)), len(ids)

    def encode(self, text: str) -> list[int]:
        return [int(i) for word in self.pieces(text) for i in self.piece(word)[0].split(",")]

    def encode_joined(self, text: str) -> tuple[str, int]:
        """The ids of a whole text in one string, with commas, and how many; words that come again are looked up."""
        words, known = self.pieces(text), self.words
        if len(known) > KEPT:
            known.clear()
        passing = []
        for word in set(words).difference(known):
            known[word] = self.piece(word)
            if len(word) > KEPT_BYTES:
                passing.append(word)
        found = [known[word] for word in words]
        for word in passing:
            del known[word]
        return ",".join([ids for ids, _ in found]), sum([n for _, n in found])

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, put together up the tree."""
        if len(ids) > 4096:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of the whole text of every row; special tokens are ordinary text.

    Null text and empty text give no ids; rows without an id and repeated rows are encoded like others; an
    empty table gives no rows; other columns are not read. Rows are independent, nothing is shuffled.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of rows as encode() gives them; null ids give null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the bytes decoded from them.

    Both ways in one pass, so that the ids don't cross to the JVM; cases as in encode().
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                joined, n = bpe.encode_joined(text)
                n_tokens.append(n)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode([int(i) for i in joined.split(",")] if n else [])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
