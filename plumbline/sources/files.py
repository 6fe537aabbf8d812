"""Records of whole files with ordinals and byte spans, read in parallel over byte ranges.

Spark cuts files into ranges, and its line reader assigns every record to the range in which it begins. Each task numbers
the records of its ranges and adds up their bytes as they stream by; a second, column-pruned pass gives records and bytes
per range, whose prefix sums turn both into positions within the file. Nothing is shuffled but one row per range, and the
result is that of one sequential reader whatever the size of the ranges.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.guards import LimitError, refuse_when, require_between
from plumbline.sources.framing import MAX_EXCERPT

MAX_RAW, MAX_DECODED, MAX_SPANS = 1 << 20, 1 << 22, 1 << 16
BROADCAST_RANGES = 100_000  # ranges (one small row each) broadcast at most
_BOM = b"\xef\xbb\xbf"


def _borders(delimiter: bytes) -> bool:
    """Whether the delimiter can overlap itself; where it does, a range cannot tell how earlier bytes pair up."""
    return any(delimiter[:n] == delimiter[-n:] for n in range(1, len(delimiter)))


class _Runs:
    """Decoding of one record that is not valid UTF-8: replacement text, runs, and the first invalid bytes."""

    def __init__(self, raw: bytes):
        self.bad: list[tuple[int, int]] = []

        def note(error: UnicodeDecodeError) -> tuple[str, int]:
            self.bad.append((error.start, error.end))
            return "�", error.end

        codecs.register_error("plumbline-note", note)
        self.text = raw.decode("utf-8", "plumbline-note")
        at, self.runs = 0, 0
        for start, end in self.bad:
            self.runs += 1 + (start > at)
            at = end
        self.runs += at < len(raw)


_NUMBERED = "file string, block bigint, size bigint, n bigint, at bigint, raw binary, fixed string, runs int, bad_start bigint, bad_end bigint"


def _numbered(rows: DataFrame, width: int) -> DataFrame:
    """Add to each record its number and byte position within its range, and the decoding of invalid ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n, at = None, 0, 0
        for batch in batches:
            files, blocks = batch.column("file"), batch.column("block").to_numpy()
            raw = batch.column("raw")
            sizes = pa.compute.binary_length(raw).to_numpy().astype(np.int64) + width
            ranges = files.dictionary_encode()
            codes = ranges.indices.to_numpy()
            change = np.ones(batch.num_rows, bool)
            change[1:] = (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])
            first = np.flatnonzero(change)
            number, place = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows]):
                known = (files[a].as_py(), int(blocks[a]))
                if known != here:
                    here, n, at = known, 0, 0
                number[a:b] = n + np.arange(b - a)
                ends = at + np.cumsum(sizes[a:b])
                place[a:b] = ends - sizes[a:b]
                n, at = n + b - a, int(ends[-1])
            valid = batch.column("valid").to_numpy(zero_copy_only=False)
            fixed, runs, bad = [None] * batch.num_rows, (sizes > width).astype(np.int32), np.full((batch.num_rows, 2), -1, np.int64)
            for i in np.flatnonzero(~valid).tolist():
                decoded = _Runs(raw[i].as_py())
                fixed[i], runs[i], bad[i] = decoded.text, decoded.runs, decoded.bad[0]
            columns = [files, batch.column("block"), batch.column("size"), pa.array(number), pa.array(place), raw, pa.array(fixed, pa.string()), pa.array(runs), pa.array(bad[:, 0]), pa.array(bad[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "size", "n", "at", "raw", "fixed", "runs", "bad_start", "bad_end"])

    return rows.mapInArrow(run, _NUMBERED)


def frame_files(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str | None = None,
    decoding: str = "strict",
    raw_limit: int = MAX_RAW,
    decoded_limit: int = MAX_DECODED,
    span_limit: int = MAX_SPANS,
    excerpt: int = MAX_EXCERPT,
    pieces: bool = False,
) -> DataFrame:
    """Records of the files below ``path`` by LF/CRLF (a lone CR is content) or a literal delimiter.

    One row per record: ``file``, ``ordinal``, ``start``, ``end`` (content), ``delimiter_end``, ``unterminated``, ``text``,
    ``lossy``, ``spans`` (runs of valid bytes and replaced ones), and for rejected records ``reason`` (raw_limit,
    invalid_utf8 under strict decoding, decoded_limit, span_limit; else null), ``reason_start``, ``reason_end``, the first
    bytes as ``excerpt`` and ``excerpt_truncated``. Rejected records have no text. Files must not be compressed; an empty
    one has no records. Delimiters that can overlap themselves are refused. A byte order mark belongs to the first
    record; a file of nothing but a mark has none, as the reader passes over it.

    With ``pieces`` the files of a folder are the pieces of one file in the order of their names, as one sorted write
    leaves them: ``file`` is the folder, and ordinals and positions run on. Every piece but the last has to end with the
    delimiter; otherwise the query fails.
    """
    require_between("raw_limit", raw_limit, 1, MAX_RAW)
    require_between("decoded_limit", decoded_limit, 1, MAX_DECODED)
    require_between("span_limit", span_limit, 1, MAX_SPANS)
    require_between("excerpt", excerpt, 1, MAX_EXCERPT)
    if decoding not in ("strict", "lossy"):
        raise LimitError("decoding must be strict or lossy")
    separator = "\n" if delimiter is None else delimiter
    width = len(separator.encode())
    require_between("bytes of the delimiter", width, 1, MAX_EXCERPT)
    if _borders(separator.encode()):
        raise LimitError("a delimiter that can overlap itself has no borders at the edge of a byte range")
    metadata = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size")]
    rows = spark.read.option("lineSep", separator).text(path).select(*metadata, F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("valid"))
    ranges = rows.groupBy("file", "block", "size").agg(F.count(F.lit(1)).alias("n_range"), F.sum(F.octet_length("raw").cast("bigint") + width).alias("bytes_range"))
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    total = F.sum("bytes_range").over(whole)
    # what the lines add up to tells whether the last one was open, and whether the reader passed over a byte order mark
    beyond = total - F.col("size")
    mark = F.when(beyond.isin(-3, width - 3) & (beyond < 0), 3).otherwise(0).cast("bigint")
    ranges = ranges.select(
        F.col("file").alias("r_file"),
        F.col("block").alias("r_block"),
        F.coalesce(F.sum("n_range").over(before), zero).alias("n_before"),
        F.coalesce(F.sum("bytes_range").over(before), zero).alias("bytes_before"),
        F.sum("n_range").over(whole).alias("n_file"),
        mark.alias("mark"),
        (total + mark - F.col("size")).alias("over"),
        F.col("size").alias("bytes_file"),
    )
    ranges = _pieces(ranges) if pieces else ranges.withColumns({"whole": F.col("r_file"), "n_ahead": zero, "bytes_ahead": zero, "closed": F.lit(False)})
    counted = ranges.agg(F.count(F.lit(1))).first()[0]
    ranges = F.broadcast(ranges) if counted <= BROADCAST_RANGES else ranges
    placed = _numbered(rows, width).join(ranges, (F.col("file") == F.col("r_file")) & (F.col("block") == F.col("r_block")))
    ordinal = F.col("n_before") + F.col("n")
    marked = (F.col("mark") > 0) & (ordinal == 0)
    placed = placed.select(
        F.col("whole").alias("file"),
        refuse_when(F.col("closed") & (F.col("over") > 0), F.col("n_ahead") + ordinal, "a piece of a file ends within a record").alias("ordinal"),
        (F.col("bytes_ahead") + F.col("bytes_before") + F.col("at") + F.when(ordinal > 0, F.col("mark")).otherwise(0)).alias("start"),
        ((F.col("over") > 0) & (ordinal == F.col("n_file") - 1)).alias("unterminated"),
        F.when(marked, F.concat(F.lit(_BOM), F.col("raw"))).otherwise(F.col("raw")).alias("raw"),
        F.when(marked, F.concat(F.lit("﻿"), F.col("fixed"))).otherwise(F.col("fixed")).alias("fixed"),
        # the mark is valid bytes: a run of its own where none follows
        (F.col("runs") + F.when(marked & ((F.octet_length("raw") == 0) | (F.col("bad_start") == 0)), 1).otherwise(0)).alias("runs"),
        (F.col("bad_start") + F.when(marked, 3).otherwise(0)).alias("bad_start"),
        (F.col("bad_end") + F.when(marked, 3).otherwise(0)).alias("bad_end"),
    )
    return _judged(placed, delimiter is None, width, decoding, raw_limit, decoded_limit, span_limit, excerpt)


def _pieces(ranges: DataFrame) -> DataFrame:
    """Ranges with the folder as the whole file, what its pieces ahead hold, and whether another piece follows."""
    pieces = ranges.groupBy("r_file").agg(F.max("n_file").alias("n"), F.max("bytes_file").alias("bytes"))
    pieces = pieces.withColumn("whole", F.regexp_replace("r_file", "/[^/]*$", ""))
    by_name = Window.partitionBy("whole").orderBy("r_file")
    ahead = by_name.rowsBetween(Window.unboundedPreceding, -1)
    held = lambda name: F.coalesce(F.sum(name).over(ahead), F.lit(0).cast("bigint"))
    closed = F.lead("r_file").over(by_name).isNotNull()
    placed = pieces.select("r_file", "whole", held("n").alias("n_ahead"), held("bytes").alias("bytes_ahead"), closed.alias("closed"))
    return ranges.join(placed, "r_file")


def _judged(placed: DataFrame, lines: bool, width: int, decoding: str, raw_limit: int, decoded_limit: int, span_limit: int, excerpt: int) -> DataFrame:
    length = F.octet_length("raw").cast("bigint")
    last = lambda column: F.substring(column, F.octet_length(column), F.lit(1))
    cr = ~F.col("unterminated") & (length > 0) & (last(F.col("raw")) == F.lit(b"\r")) if lines else F.lit(False)
    content = F.when(cr, F.substring("raw", F.lit(1), F.octet_length("raw") - 1)).otherwise(F.col("raw"))
    fixed = F.when(cr, F.left("fixed", F.length("fixed") - 1)).otherwise(F.col("fixed"))
    # a lone CR that was the record's last run goes with the line end
    alone = cr & F.col("fixed").isNotNull() & (F.col("runs") > 1) & (F.substring(F.col("fixed"), F.length("fixed") - 1, F.lit(1)) == "�") & (F.col("bad_end") >= 0)
    runs = F.when(cr & (length == 1), 0).when(alone, F.col("runs") - 1).otherwise(F.col("runs"))
    cut = placed.select(
        "file", "ordinal", "start", "unterminated", content.alias("content"), (F.col("start") + length + F.when(F.col("unterminated"), 0).otherwise(width)).alias("delimiter_end"), fixed.alias("fixed"), runs.cast("int").alias("spans"), "bad_start", "bad_end"
    )
    size = F.octet_length("content").cast("bigint")
    end = F.col("start") + size
    invalid = F.col("fixed").isNotNull()
    text = F.coalesce("fixed", F.col("content").cast("string"))
    strict = F.lit(decoding == "strict")
    reason = (
        F.when(size > raw_limit, "raw_limit")
        .when(invalid & strict, "invalid_utf8")
        .when(F.octet_length(text) > decoded_limit, "decoded_limit")
        .when(F.col("spans") > span_limit, "span_limit")
    )
    judged = cut.withColumn("reason", reason)
    rejected, bad = F.col("reason").isNotNull(), F.col("reason") == "invalid_utf8"
    return judged.select(
        "file",
        "ordinal",
        "start",
        end.alias("end"),
        "delimiter_end",
        "unterminated",
        F.when(~rejected, text).alias("text"),
        (invalid & ~rejected).alias("lossy"),
        F.when(~rejected, F.col("spans")).alias("spans"),
        "reason",
        F.when(rejected, F.col("start") + F.when(bad, F.col("bad_start")).otherwise(0)).alias("reason_start"),
        F.when(rejected, F.when(bad, F.col("start") + F.col("bad_end")).otherwise(end)).alias("reason_end"),
        F.when(rejected, F.substring("content", 1, excerpt)).alias("excerpt"),
        (rejected & (size > excerpt)).alias("excerpt_truncated"),
    )


def strict_records(framed: DataFrame) -> DataFrame:
    """The records alone; the first rejected one fails the query and names its place."""
    at = F.concat(F.lit("malformed record: "), F.col("reason"), F.lit(" at "), F.col("reason_start").cast("string"))
    text = refuse_when(F.col("reason").isNotNull(), F.col("text"), at)
    return framed.withColumn("text", text).drop("reason", "reason_start", "reason_end", "excerpt", "excerpt_truncated")


def rejections(framed: DataFrame) -> DataFrame:
    """The rejected records with their place, reason and excerpt."""
    return framed.where("reason IS NOT NULL").drop("text", "lossy", "spans")
