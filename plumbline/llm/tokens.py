"""Words of UTF-8 texts in Arrow columns as 64-bit hashes, without a Python object per word.

Everything works on the bytes of a whole Arrow column slice: a table classifies bytes, word borders are where the class
changes or a text ends, and a word's hash is a difference of running polynomial sums, mixed at the end. Two different
words share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import run_folder, spent_shuffles

U64 = np.uint64
SLICE_BYTES = 4 << 20  # texts handled together; one longer text is handled alone
BLOCK = 1 << 20  # bytes per running sum
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_classes(separators: str) -> np.ndarray:
    """True for the bytes of words: all but the given ASCII characters."""
    table = np.ones(256, bool)
    table[list(separators.encode("ascii"))] = False
    return table


SPACED = byte_classes(" \t\n\x0b\x0c\r")  # words are what stands between white space
ALPHANUMERIC = byte_classes("".join(chr(c) for c in range(128) if not chr(c).isalnum()))  # digits, letters, non-ASCII
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Words(NamedTuple):
    """Words of some texts: the text's number in the slice, byte start and stop within the slice, hash."""

    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit number (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, borders)`` of runs of rows of about ``limit`` bytes. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    count = len(column)
    if not count:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + count + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    at = 0
    while at < count:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, count)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int) -> np.ndarray:
    if base not in _powers:
        steps = np.full(BLOCK + 1, base, U64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=U64)
    return _powers[base]


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    powers, inverses = _power_table(_BASE), _power_table(_INVERSE)
    head, tail, back = (np.empty(len(start), U64) for _ in range(3))
    carry, scale, unscale = 0, 1, 1
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        size = len(part)
        run = np.zeros(size + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * powers[:size], out=run[1:])
        run = run * U64(scale) + U64(carry)
        a, b = np.searchsorted(start, [at, at + size])
        here = start[a:b] - at
        head[a:b] = run[here]
        back[a:b] = inverses[here] * U64(unscale)
        a, b = np.searchsorted(stop, [at, at + size], "right")
        tail[a:b] = run[stop[a:b] - at]
        carry = int(run[-1])
        scale = scale * int(powers[size]) & _MASK
        unscale = unscale * int(inverses[size]) & _MASK
    return mix((tail - head) * back)


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of spans in order that do not overlap, A-Z as a-z: those of words that were cut otherwise."""
    return _hashes(FOLD[data], start, stop)


def find_words(data: np.ndarray, borders: np.ndarray, classes: np.ndarray, fold: bool = True) -> Words:
    """Maximal runs of word bytes; A-Z count as a-z in the hash when ``fold``."""
    size = len(data)
    if not size:
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.empty(0, U64))
    inside = classes[data]
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    before[borders[:-1][borders[:-1] < size]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[borders[1:][borders[1:] > 0] - 1] = False
    stop = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(borders, start, "right") - 1
    return Words(row, start, stop, _hashes(FOLD[data] if fold else data, start, stop))


def grams(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within one text, and the index of its first word."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    out = np.full(count, size, U64)
    for k in range(size):
        out = mix(out * U64(0xD6E8FEB86659FD93) + hashes[k : k + count])
    first = np.flatnonzero(row[:count] == row[size - 1 :])
    return out[first], first


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors.

    The shuffles of the write end with it: nothing reads them again, and else they fill the executors' disks until the
    driver happens to collect its garbage.
    """
    path = run_folder(df.sparkSession, label)
    with spent_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
