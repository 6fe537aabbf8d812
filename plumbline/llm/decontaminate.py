"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents within a partition. Its words are numbered by the test vocabulary; words outside it cannot
be part of a test phrase, so they only separate runs, and runs shorter than the shortest phrase are left out. Over the
reversed question "which suffixes start with this phrase" the shard holds

* the Burrows-Wheeler transform of its word numbers as a wavelet tree of bit vectors with rank counts, and
* every eighth suffix position, reached from any suffix by following the transform backwards.

All phrases are searched together, one word backwards per step, so a step is a handful of array operations. Occurrences
of the phrases become word spans, spans are merged per document, and the hits are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import ALPHANUMERIC, find_words, settled, text_slices

WINDOW = 13
SHARD_BYTES = 32 << 20  # text per index
PHRASE_BYTES = 16 << 20  # test text per pass; a larger test set takes several passes
_I64 = np.int64


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        size = len(bits)
        padded = np.zeros((size // 64 + 1) * 64, np.uint8)
        padded[:size] = bits
        self.words = np.packbits(padded.reshape(-1, 8), bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below).astype(_I64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Ranks of symbols: one bit vector per bit of the symbols, high bit first, zeros before ones at every level."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            bits = (symbols >> shift & 1).astype(bool)
            zeros = int(len(symbols) - bits.sum())
            self.levels.append((shift, Bits(bits), zeros))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``at``."""
        low = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            low_ones, at_ones = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + low_ones, low - low_ones)
            at = np.where(one, zeros + at_ones, at - at_ones)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions, and their ranks there."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = bits.get(at)
            symbol |= one.astype(_I64) << shift
            low_ones, at_ones = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + low_ones, low - low_ones)
            at = np.where(one, zeros + at_ones, at - at_ones)
        return symbol, at - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again."""
    size = len(symbols)
    width = max(1, int(symbols.max(initial=0)).bit_length())
    step = max(1, 62 // width)
    packed = np.zeros(size, _I64)
    for k in range(step):  # a shorter suffix is padded with zeros: the unique last symbol is the only zero
        packed[: size - k] += symbols[k:] << (width * (step - 1 - k)) if k < size else 0
    order = np.argsort(packed, kind="stable")
    rank = np.empty(size, _I64)
    sorted_keys = packed[order]
    fresh = np.ones(size, bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first = np.flatnonzero(fresh)
    rank[order] = first[np.cumsum(fresh) - 1]
    while True:
        ends = np.append(first[1:], size)
        tied = np.flatnonzero(np.repeat(ends - first > 1, ends - first))
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(at + step < size, rank[np.minimum(at + step, size - 1)], -1)
        group = rank[at]
        again = np.lexsort((after, group))
        at, after, group = at[again], after[again], group[again]
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        starts = np.flatnonzero(new)
        rank[at] = tied[starts][np.cumsum(new) - 1]
        fresh[tied[starts]] = True
        first = np.flatnonzero(fresh)
        step *= 2


class FmIndex:
    """Counts and places of phrases in a sequence of numbers from 1 up; 0 ends the sequence."""

    SAMPLE = 8

    def __init__(self, symbols: np.ndarray, alphabet: int):
        symbols = np.append(symbols, 0).astype(_I64)
        self.size = len(symbols)
        order = suffix_order(symbols)
        self.tree = WaveletTree(symbols[order - 1], alphabet)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        kept = order % self.SAMPLE == 0
        self.kept = Bits(kept)
        self.places = order[kept]

    def search(self, phrases: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each phrase ``phrases[start : start + size]``; empty where it does not occur."""
        low, high = np.zeros(len(sizes), _I64), np.full(len(sizes), self.size, _I64)
        alive = np.flatnonzero(sizes > 0)
        back = 1
        while len(alive):
            word = phrases[starts[alive] + sizes[alive] - back]
            low[alive] = self.below[word] + self.tree.rank(word, low[alive])
            high[alive] = self.below[word] + self.tree.rank(word, high[alive])
            back += 1
            alive = alive[(high[alive] > low[alive]) & (sizes[alive] >= back)]
        return low, np.maximum(low, high)

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to a sampled one."""
        place = np.full(len(suffixes), -1, _I64)
        at, todo, walked = suffixes.copy(), np.arange(len(suffixes)), 0
        while len(todo):
            known = self.kept.get(at)
            place[todo[known]] = self.places[self.kept.rank(at[known])] + walked
            todo, at = todo[~known], at[~known]
            symbol, rank = self.tree.access(at)
            at = self.below[symbol] + rank
            walked += 1
        return place


class Phrases:
    """Test phrases of a block of items: vocabulary, distinct windows, and the items of each window."""

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int):
        ids: dict[str | None, int] = {}
        number_of = [ids.setdefault(i, len(ids)) for i in item_ids]  # rows with one id are one item
        words = []
        for first, _, data, borders in text_slices(pa.array(texts, pa.large_string())):
            found = find_words(data, borders, ALPHANUMERIC)
            words.append((found.row + first, found.hash))
        row = np.concatenate([w[0] for w in words]) if words else np.empty(0, _I64)
        hashes = np.concatenate([w[1] for w in words]) if words else np.empty(0, np.uint64)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        number = number.astype(_I64) + 2  # 1 separates runs
        count = np.bincount(row, minlength=len(item_ids))
        begin = np.cumsum(count) - count
        windows: dict[bytes, int] = {}
        parts, items = [], []
        for item, (at, size) in enumerate(zip(begin.tolist(), count.tolist())):
            for start in range(at, at + max(size - window, 0) + 1) if size else ():
                part = number[start : min(start + window, at + size)]
                known = windows.setdefault(part.tobytes(), len(windows))
                if known == len(parts):
                    parts.append(part)
                    items.append([])
                if number_of[item] not in items[known]:
                    items[known].append(number_of[item])
        self.sizes = np.array([len(p) for p in parts], _I64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate(parts) if parts else np.empty(0, _I64)
        self.item_count = np.array([len(i) for i in items], _I64)
        self.items = np.array([i for some in items for i in some], _I64)
        self.item_start = np.cumsum(self.item_count) - self.item_count
        self.item_ids = np.array(list(ids), object)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, 1 for others."""
        if not len(self.vocabulary):
            return np.ones(len(hashes), _I64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)


def _shard_hits(row: np.ndarray, word: np.ndarray, number: np.ndarray, phrases: Phrases):
    """``(row, start, stop, window)`` of every occurrence; ``word`` is a word's number within its text."""
    known = number > 1
    if not known.any() or not len(phrases.sizes):
        return (np.empty(0, _I64),) * 4
    joined = known[1:] & known[:-1] & (row[1:] == row[:-1])
    fresh = np.ones(len(row), bool)
    fresh[1:] = ~joined
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(row)))
    kept = np.flatnonzero(np.repeat(known[first] & (length >= phrases.sizes.min()), length))
    if not len(kept):
        return (np.empty(0, _I64),) * 4
    # one separator before every run
    border = fresh[kept]
    place = np.arange(len(kept)) + np.cumsum(border)
    symbols = np.ones(len(kept) + int(border.sum()), _I64)
    symbols[place] = number[kept]
    source = np.full(len(symbols), -1, _I64)
    source[place] = kept
    index = FmIndex(symbols, len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.words, phrases.starts, phrases.sizes)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    suffix = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = source[index.locate(suffix)]
    return row[at], word[at], word[at] + phrases.sizes[window], window


def _merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans per row, in order."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    shift = row * (int(stop.max()) + 1)  # keeps the rows apart, so one running maximum serves all
    reach = np.maximum.accumulate(stop + shift)
    fresh = np.ones(len(row), bool)
    fresh[1:] = start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - shift[last]


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            kept.append(part)
            size += sum(x.as_py() or 0 for x in (pa.compute.sum(pa.compute.binary_length(part.column("text"))),))
            if size >= limit:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size = [], 0
    if kept and sum(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_FOUND = "n_words bigint, spans array<struct<start: bigint, stop: bigint>>, items array<string>"


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _search(docs: DataFrame, phrases: Phrases, keep: list[str], shard_bytes: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for shard in _shards(batches, shard_bytes):
            rows, numbers, ordinals = [], [], []
            count = np.zeros(shard.num_rows, _I64)
            for first, end, data, borders in text_slices(shard.column("text")):
                found = find_words(data, borders, ALPHANUMERIC)
                size = np.bincount(found.row, minlength=end - first)
                count[first:end] = size
                rows.append(found.row + first)
                ordinals.append(np.arange(len(found.row)) - np.repeat(np.cumsum(size) - size, size))
                numbers.append(phrases.number(found.hash))
            row, start, stop, window = _shard_hits(*(np.concatenate(x) for x in (rows, ordinals, numbers)), phrases)
            span_row, start, stop = _merged(row, start, stop)
            pair = np.unique(np.stack([row, window], 1), axis=0) if len(row) else np.empty((0, 2), _I64)
            size = phrases.item_count[pair[:, 1]]
            item_row = np.repeat(pair[:, 0], size)
            at = np.repeat(phrases.item_start[pair[:, 1]], size) + np.arange(len(item_row)) - np.repeat(np.cumsum(size) - size, size)
            both = np.unique(np.stack([item_row, phrases.items[at]], 1), axis=0)
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], fields=list(_SPAN))
            items = pa.array(phrases.item_ids[both[:, 1]].tolist(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    *[shard.column(c) for c in keep],
                    pa.array(count),
                    _lists(spans, np.bincount(span_row, minlength=shard.num_rows)),
                    _lists(items, np.bincount(both[:, 0], minlength=shard.num_rows)),
                ],
                names=[*keep, "n_words", "spans", "items"],
            )

    types = dict(docs.dtypes)
    fields = ", ".join([*[f"`{c}` {types[c]}" for c in keep], _FOUND])
    return docs.select(*keep, *[c for c in ["text"] if c not in keep]).mapInArrow(run, fields)


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int = PHRASE_BYTES, nameless: bool = False) -> Iterator[Phrases]:
    """The test set in blocks of about ``block_bytes`` of text, so that no larger part of it is ever in one place."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items if nameless else items.where("item_id IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.distinct().toArrow()
        yield Phrases(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = PHRASE_BYTES,
    nameless: bool = False,
) -> DataFrame:
    """Occurrences of test phrases in the documents.

    ``docs(text, ...)`` and ``benchmark(item_id, text)``. Words are runs of letters, digits and non-ASCII characters,
    A-Z count as a-z. A phrase is ``window`` consecutive words of an item, or all words of a shorter item. Returns the
    ``keep`` columns (default: all) of every row with ``n_words``, ``spans`` (merged word spans covered by occurrences) and
    ``items`` (ids of the items with an occurring phrase, in no order). Null and empty texts have no words; items without
    words have no phrases; repeated rows are answered one by one; empty tables give no spans. Kept columns with a name of
    the result are replaced. Items without an id have no phrases either, unless ``nameless``: then they give spans, and
    only ``items`` is without them.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "spans", "items")]
    carried_text = [] if "text" in keep else ["text"]  # later passes search it again
    found = None
    for phrases in phrase_blocks(benchmark, window, block_bytes, nameless):
        if found is None:
            found = _search(docs, phrases, [*keep, *carried_text], shard_bytes)
            continue
        # further blocks of a large test set: settle the rows so far, then search their texts again
        carried = settled(found.withColumnsRenamed({"n_words": "_n", "spans": "_spans", "items": "_items"}), "searched")
        more = _search(carried, phrases, carried.columns, shard_bytes)
        found = more.select(
            *keep,
            *carried_text,
            "n_words",
            F.concat("_spans", "spans").alias("spans"),
            F.array_distinct(F.concat("_items", "items")).alias("items"),
        )
    named = F.filter("items", lambda i: i.isNotNull())
    found = found.withColumn("items", named) if nameless else found
    return found.select(*keep, "n_words", merge_spans(F.col("spans")).alias("spans"), "items")


def merge_spans(spans):
    """Union of spans that may touch or overlap (those of several searches)."""
    empty = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    last = lambda out: F.element_at(out, -1)

    def add(out, span):
        joins = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["stop"] >= span["start"])
        grown = F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["stop"], span["stop"]).alias("stop"))
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(span)))

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), empty, add))


def with_verdict(found: DataFrame) -> DataFrame:
    """Add ``n_hit``, ``n_items`` and ``contaminated``: some word is hit, and at least a twentieth of all."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )
