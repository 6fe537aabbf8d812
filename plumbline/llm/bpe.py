"""Byte-level BPE: a segment tree over byte positions holds the leftmost minimum pair rank.

A piece of text starts as single bytes. Leaf ``i`` of the tree holds the rank of the pair that starts at live position
``i`` (or nothing), an inner node the smaller of its children, so the root is the leftmost pair of lowest rank. A merge
changes the leaves of the merged position, its neighbour to the left and the one it swallows: logarithmic time each, and
a piece of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

CACHED_PIECES = 150_000  # pieces per generation a worker remembers
LONGEST_CACHED = 64  # characters
_NONE = 1 << 62
_PLACE = (1 << 32) - 1


class Vocabulary(NamedTuple):
    """Ranks of byte strings, and the pattern that cuts a text into pieces."""

    ranks: dict[bytes, int]
    pattern: str


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return Vocabulary(ranks, pattern)


class Encoder:
    """Encodes pieces under a vocabulary; ids are ranks."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranks
        self.cut = regex.compile(vocabulary.pattern).findall
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.text_of = {rank: token for token, rank in self.ranks.items()}
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        size = len(ids)
        pair = self.pairs.get
        width = 1 << max(size - 2, 0).bit_length()
        tree = [_NONE] * (2 * width)
        for i in range(size - 1):
            rank = pair(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank << 32 | i
        for node in range(width - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        after = list(range(1, size + 1))
        before = list(range(-1, size))

        def put(place: int, value: int) -> None:
            node = width + place
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while (top := tree[1]) != _NONE:
            at = top & _PLACE
            gone = after[at]
            ids[at] = merged = top >> 32
            follower = after[at] = after[gone]
            if gone < size - 1:
                put(gone, _NONE)
            if follower < size:
                before[follower] = at
                rank = pair(merged << 32 | ids[follower])
                put(at, _NONE if rank is None else rank << 32 | at)
            else:
                put(at, _NONE)
            previous = before[at]
            if previous >= 0:
                rank = pair(ids[previous] << 32 | merged)
                put(previous, _NONE if rank is None else rank << 32 | previous)
        out, at = [], 0
        while at < size:
            out.append(ids[at])
            at = after[at]
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as little-endian 32-bit numbers, by way of two generations of remembered pieces."""
        known = self.old.get(piece)
        if known is None:
            known = b"".join([i.to_bytes(4, "little") for i in self.merge(piece.encode("utf-8"))])
        if len(piece) <= LONGEST_CACHED:
            if len(self.young) >= CACHED_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        get, make = self.young.get, self._piece
        parts = []
        for piece in self.cut(text):
            known = get(piece)
            if known is None:
                known = make(piece)
                get = self.young.get  # the young generation may be a new one
            parts.append(known)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a sequence of ids."""
        numbers = memoryview(ids).cast("I") if array("I", [1]).tobytes() == b"\x01\0\0\0" else array("I", ids)
        return b"".join(map(self.text_of.__getitem__, numbers))


_encoders: dict[int, Encoder] = {}


def encoder_of(shared: Broadcast) -> Encoder:
    """The encoder of a broadcast vocabulary, built once per worker."""
    if id(shared.value) not in _encoders:
        _encoders.clear()
        _encoders[id(shared.value)] = Encoder(shared.value)
    return _encoders[id(shared.value)]


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column.cast(pa.binary()):
        raw = value.as_py()
        yield raw.decode("utf-8", "replace") if raw else ""


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], digests: bool = False) -> DataFrame:
    """``keep`` columns of ``docs(text, ...)`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers).

    Each match of the vocabulary's pattern is encoded by itself; there are no special tokens. Null counts as empty and has
    no ids. With ``digests`` the ids are decoded again, and ``ids_sha256`` and ``decoded_sha256`` replace the ids. The
    vocabulary is broadcast; its size does not depend on the corpus. Kept columns with a name of the result are replaced;
    repeated rows are encoded one by one; an empty table stays empty.
    """
    made = ["ids_sha256", "decoded_sha256"] if digests else ["ids"]
    keep = [c for c in keep if c not in ("n_tokens", *made)]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.encode(text) for text in _texts(part.column("text"))]
                out = [*[part.column(c) for c in keep], pa.array([len(i) // 4 for i in ids], pa.int64())]
                if digests:
                    out.append(pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()))
                    out.append(pa.array([hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids], pa.string()))
                else:
                    out.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "n_tokens", *made])

    types = dict(docs.dtypes)
    fields = [*[f"`{c}` {types[c]}" for c in keep], "n_tokens bigint", *[f"{c} {'string' if digests else 'binary'}" for c in made]]
    return docs.select(*keep, *[c for c in ["text"] if c not in keep]).mapInArrow(run, ", ".join(fields))


def decode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs(ids, ...)`` with ``bytes``, what the ids stand for; null ids give null."""
    keep = [c for c in keep if c != "bytes"]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if i is None else encoder.decode(i) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.binary())], names=[*keep, "bytes"])

    types = dict(docs.dtypes)
    fields = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "bytes binary"])
    return docs.select(*keep, *[c for c in ["ids"] if c not in keep]).mapInArrow(run, fields)
