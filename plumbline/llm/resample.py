"""Importance resampling: which documents look like the target texts, by the ratio of two n-gram models.

Words and word pairs are hashed into a fixed number of buckets. One bag model is estimated from target texts, one from all
texts. A document's log weight is the sum over its features of the log ratio of both models; with Gumbel noise added, the
``k`` documents with the largest keys are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import SPACED, U64, find_words, grams, row_count, settled, text_slices

BUCKETS = 1 << 14
TARGET_ROWS = 20_000  # target texts used, at most about
SHARE = 0.5  # share of the documents that is sampled
SEED = 7


def _features(data: np.ndarray, borders: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    words = find_words(data, borders, SPACED)
    pairs, first = grams(words.hash, words.row, 2)
    bucket = np.concatenate([words.hash, pairs]) % U64(buckets)
    return bucket.astype(np.int64), np.concatenate([words.row, words.row[first]])


def count_buckets(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket in all texts: one partial table per task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, borders in text_slices(batch.column("text")):
                total += np.bincount(_features(data, borders, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed models per bucket."""
    share = lambda counts: (counts + 1) / (counts.sum() + len(counts))
    return np.log(share(target)) - np.log(share(raw))


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_features`` and ``log_weight`` of each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for first, end, data, borders in text_slices(batch.column("text")):
                bucket, row = _features(data, borders, len(ratio))
                weight = np.bincount(row, weights=ratio[bucket], minlength=end - first).astype(np.float64)
                count = np.bincount(row, minlength=end - first)
                ids = batch.column("doc_id").slice(first, end - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(count.astype(np.int64)), pa.array(weight)], names=["doc_id", "n_features", "log_weight"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_features bigint, log_weight double")


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, by counting in ever finer bins; only bins come to the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while low is not None and low < high:
        bins = F.least(F.floor((F.col(column) - low) / (high - low) * 1024), F.lit(1023))
        counted = (
            df.where(F.col(column).between(low, high))
            .groupBy(bins.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .collect()
        )
        for row in sorted(counted, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low


def resample(
    docs: DataFrame, target_ids: DataFrame, share: float = SHARE, seed: int = SEED, target_rows: int = TARGET_ROWS, buckets: int = BUCKETS
) -> DataFrame:
    """Sample ``ceil(share * rows)`` documents like the target texts.

    ``docs(doc_id, text)``; ``target_ids(doc_id)`` names the target texts, of which about ``target_rows`` are drawn by a
    hash of the id if there are more. Returns one row per input row: ``doc_id``, ``n_features``, ``log_weight``,
    ``gumbel_key`` and ``selected``. The noise is a function of doc_id and seed, so a repeated run or a lost executor
    changes nothing; rows with equal keys, such as repeated rows, are selected together. Null and empty texts have weight
    0. Without target texts all weights come from the raw model against an even one. An empty table stays empty.
    """
    ids = target_ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    count = row_count(ids)
    if count > target_rows:
        ids = ids.where(F.pmod(F.xxhash64("doc_id", F.lit("target sample")), F.lit(1 << 30)) < int(target_rows / count * (1 << 30)))
    target = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    ratio = log_ratio(count_buckets(target, buckets), count_buckets(docs, buckets))
    noise = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    scored = weigh(docs, ratio).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(noise)))
    scored = settled(scored, "weights")
    rows = row_count(scored)
    border = kth_largest(scored, "gumbel_key", math.ceil(share * rows)) if rows and share > 0 else None
    return scored.withColumn("selected", F.lit(False) if border is None else F.col("gumbel_key") >= border)
