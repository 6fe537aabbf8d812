"""Ranked lexical search by dense blocked matrix products that are exact.

Items are cut into tiles, each with the compact vocabulary of its own terms. A document's impact on a term and a term's
weight are integers, so a score is an integer matrix product: weights of an item tile times impacts of a document tile.
The products run in float64 through BLAS; a vocabulary tile is so narrow that no partial sum reaches 2**53, where float64
stops being exact, and the sums of several vocabulary tiles are added as 64-bit integers. The result therefore does not
depend on the order in which BLAS adds. Every task keeps its best rows per item, ties by document id, and Spark merges
them in two steps.

Terms are compared byte by byte; hashes only find candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tokens import ALPHANUMERIC, FOLD, find_words, text_slices

BEST = 10
BLOCK_BYTES = 4 << 20  # item text per pass over the documents; more items take several passes
ITEM_TILE, DOCUMENT_TILE, VOCABULARY_TILE = 128, 256, 4096
SALTS = 64  # groups in which the tasks' best rows of an item are merged first
EXACT = 1 << 53
_LARGEST_IMPACT = 1_000_000  # impacts are below this: 10**9 * tf // (1000 * tf + 8 * m)
_I64 = np.int64


def _joined(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    borders = np.zeros(len(terms) + 1, _I64)
    np.cumsum([len(t) for t in terms], out=borders[1:])
    return np.array(bytearray(b"".join(terms)), np.uint8), borders


@dataclass
class Vocabulary:
    """Distinct terms sorted by hash, with their bytes one after the other."""

    hashes: np.ndarray
    bytes: np.ndarray
    borders: np.ndarray
    most: int  # terms that share a hash, at most

    @staticmethod
    def of(terms: list[bytes]) -> Vocabulary:
        hashes = find_words(*_joined(terms), ALPHANUMERIC).hash
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        most = int(np.unique(hashes, return_counts=True)[1].max()) if len(hashes) else 0
        return Vocabulary(hashes, *_joined([terms[i] for i in order]), most)

    def number(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of the term that each word equals, -1 for other words."""
        out = np.full(len(hashes), -1, _I64)
        if not len(self.hashes):
            return out
        lowest = np.searchsorted(self.hashes, hashes)
        for shift in range(self.most):
            at = np.minimum(lowest + shift, len(self.hashes) - 1)
            size = stop - start
            likely = np.flatnonzero((self.hashes[at] == hashes) & (np.diff(self.borders)[at] == size))
            if not len(likely):
                continue
            size, at = size[likely], at[likely]
            begin = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(begin, size)
            same = FOLD[data[np.repeat(start[likely], size) + step]] == self.bytes[np.repeat(self.borders[at], size) + step]
            equal = np.logical_and.reduceat(same, begin)
            out[likely[equal]] = at[equal]
        return out


class ItemBlock:
    """Items with their terms as numbers of one vocabulary."""

    def __init__(self, ids: pa.Array, texts: list[list[str | None]]):
        self.ids = ids
        terms: dict[bytes, int] = {}
        pairs: list[tuple[int, int]] = []
        for item, parts in enumerate(texts):
            for _, _, data, borders in text_slices(pa.array(parts, pa.large_string())):
                found = find_words(data, borders, ALPHANUMERIC)
                folded = FOLD[data].tobytes()
                for a, b in zip(found.start.tolist(), found.stop.tolist()):
                    pairs.append((item, terms.setdefault(folded[a:b], len(terms))))
        self.vocabulary = Vocabulary.of(list(terms))
        # terms were numbered as met; the vocabulary sorts them by hash
        place = {t: i for i, t in enumerate(self._terms())}
        moved = np.array([place[t] for t in terms], _I64)
        both = np.unique(np.array(pairs, _I64).reshape(-1, 2), axis=0)
        self.item, self.term = both[:, 0], moved[both[:, 1]] if len(both) else both[:, 1]

    def _terms(self) -> list[bytes]:
        data, borders = self.vocabulary.bytes.tobytes(), self.vocabulary.borders.tolist()
        return [data[a:b] for a, b in zip(borders, borders[1:])]

    def tiles(self, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """``(first item, item numbers, [(terms, weights of items by terms)])`` per item tile, cut into vocabulary tiles."""
        width = max(1, min(VOCABULARY_TILE, (EXACT - 1) // (max(1, int(weight.max(initial=1))) * _LARGEST_IMPACT)))
        for first in range(0, len(self.ids), ITEM_TILE):
            here = (self.item >= first) & (self.item < first + ITEM_TILE)
            used, column = np.unique(self.term[here], return_inverse=True)
            rows = min(ITEM_TILE, len(self.ids) - first)
            dense = np.zeros((rows, len(used)))
            dense[self.item[here] - first, column] = weight[used[column]]
            yield first, np.arange(first, first + rows), [(used[at : at + width], np.ascontiguousarray(dense[:, at : at + width])) for at in range(0, len(used), width)]


def _counted(data: np.ndarray, borders: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and ``(text, term, occurrences)`` of the terms that are in the vocabulary, in order."""
    found = find_words(data, borders, ALPHANUMERIC)
    n = np.bincount(found.row, minlength=len(borders) - 1)
    number = vocabulary.number(data, found.start, found.stop, found.hash)
    known = number >= 0
    key, tf = np.unique(found.row[known] * max(len(vocabulary.hashes), 1) + number[known], return_counts=True)
    return n, key // max(len(vocabulary.hashes), 1), key % max(len(vocabulary.hashes), 1), tf


def collection_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        holding, filled, words = np.zeros(len(vocabulary.hashes), _I64), 0, 0
        for batch in batches:
            for _, _, data, borders in text_slices(batch.column("text")):
                n, _, term, _ = _counted(data, borders, vocabulary)
                holding += np.bincount(term, minlength=len(holding))
                filled, words = filled + int((n > 0).sum()), words + int(n.sum())
        used = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], used])), pa.array(np.concatenate([[filled, words], holding[used]]))], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    numbers = {r["term"]: r["n"] for r in counted}  # at most the vocabulary of a block and two rows more
    holding = np.zeros(len(vocabulary.hashes), _I64)
    for term, n in numbers.items():
        if term >= 0:
            holding[term] = n
    return numbers.get(-2, 0), numbers.get(-1, 0), holding


def term_weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], _I64)


def length_norms(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """``10 + 90 * n * documents // words`` in whole numbers, also where 64 bits do not hold the product."""
    if 90 * documents * int(n.max(initial=0)) < 1 << 63:
        return 10 + 90 * n.astype(_I64) * documents // max(words, 1)
    return np.array([10 + 90 * x * documents // words for x in n.tolist()], _I64)


class Best:
    """The best rows per item so far: higher scores first, then smaller ids, rows without an id last."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.item, self.score, self.id = (np.empty(0, _I64) for _ in range(3))
        self.nameless = np.empty(0, bool)
        self.least = np.ones(items, _I64)  # a row below this cannot be among the best

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        item, score, ids = np.concatenate([self.item, item]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        nameless = np.concatenate([self.nameless, nameless])
        order = np.lexsort((ids, nameless, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank < self.best]
        self.item, self.score, self.id, self.nameless = item[rank < self.best], score[kept], ids[kept], nameless[kept]
        last = rank == self.best - 1
        self.least[item[last]] = np.maximum(score[order[last]], 1)


def _search(docs: DataFrame, block: ItemBlock, documents: int, words: int, weight: np.ndarray, best: int, id_type: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((block, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value
        tiles = list(block.tiles(weight))
        found = Best(len(block.ids), best)
        column = np.full(len(weight), -1, _I64)
        for batch in batches:
            for low, high, data, borders in text_slices(batch.column("text")):
                n, text, term, tf = _counted(data, borders, block.vocabulary)
                m = length_norms(n, documents, words)[text]
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                ids = batch.column("doc_id").slice(low, high - low)
                nameless = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                for at in range(0, high - low, DOCUMENT_TILE):
                    end = min(at + DOCUMENT_TILE, high - low)
                    a, b = np.searchsorted(text, [at, end])
                    for first, items, parts in tiles:
                        score = np.zeros((len(items), end - at), _I64)
                        for terms, weights in parts:
                            column[terms] = np.arange(len(terms))
                            place = column[term[a:b]]
                            here = np.flatnonzero(place >= 0)
                            impacts = np.zeros((len(terms), end - at))
                            impacts[place[here], text[a:b][here] - at] = impact[a:b][here]
                            column[terms] = -1
                            score += (weights @ impacts).astype(_I64)  # whole numbers below 2**53
                        item, document = np.nonzero(score >= found.least[items][:, None])
                        if len(item):
                            found.add(item + first, score[item, document], ids[at:end][document], nameless[at:end][document])
        ids = pa.array(found.id, pa.int64(), mask=found.nameless)
        yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(found.item)), ids, pa.array(found.score)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, f"item_id {id_type}, doc_id bigint, score bigint")


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemBlock]:
    """Items by id, in blocks of about ``block_bytes`` of text, so that no larger part of them is ever in one place."""
    texts = items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    for number in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        table = part.groupBy("item_id").agg(F.collect_list("text").alias("texts")).toArrow().combine_chunks()
        if table.num_rows:
            yield ItemBlock(table.column("item_id").combine_chunks(), table.column("texts").to_pylist())


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``best`` documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    ``docs(doc_id, text)`` and ``items(item_id, text)``; other columns are not read. Every row of ``docs`` is a document,
    repeated rows too; rows without an id rank behind those of the same score with one. Rows of ``items`` with one
    ``item_id`` (also those without any) are one item with the terms of all. Null and empty texts have no terms: such
    documents count in no statistic, such items have no rows. An item has fewer rows if fewer documents score above 0.
    """
    id_type = dict(items.dtypes)["item_id"]
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = None
    for block in item_blocks(items, block_bytes):
        documents, words, holding = collection_counts(docs, block.vocabulary)
        part = _search(docs, block, documents, words, term_weights(documents, holding), best, id_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.select("item_id", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).where("false")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")
