"""Framing: byte spans, decoding and limits of records inside stored text or binary cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import items_table, let, offsets
from plumbline.functions.values import parse_json
from plumbline.guards import LimitError, refuse_when, require_between, require_kind

MAX_EXCERPT = 4096


def read_lines(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    """Records of text files as ``value``, by LF/CRLF or a literal delimiter; Spark splits large files.

    A lone CR is content. Line records carry no spans: files are read in parallel parts.
    """
    if not delimiter:
        raise LimitError("delimiter must not be empty")
    rows = spark.read.option("lineSep", delimiter).text(path)
    if delimiter != "\n":
        return rows
    value = F.col("value")
    return rows.withColumn("value", F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON value per line as a VARIANT ``value``; every line must be valid, blank ones included."""
    return read_lines(spark, path).select(parse_json(F.col("value")).alias("value"))


def frame_lines(df: DataFrame, key: str, text: str, delimiter: str | None = None) -> DataFrame:
    """Records of a text column by LF/CRLF (or a literal delimiter) with half-open byte spans.

    A document is one cell: it is split and measured inside its row and exploded afterwards, without a shuffle.
    """
    require_kind(df, text, "Text")
    separator = "\n" if delimiter is None else delimiter
    width = len(separator.encode())
    measured = let(
        F.split(text, f"\\Q{separator}\\E", -1),
        lambda parts: F.arrays_zip(
            parts.alias("part"),
            offsets(F.transform(parts, lambda p: (F.octet_length(p) + width).cast("bigint"))).alias("start"),
            F.transform(parts, lambda _, i: i == F.size(parts) - 1).alias("open"),
        ),
    )
    rows = items_table(df.select(key, text), measured, "_f", "ordinal")
    part, start, open_end = F.col("_f.part"), F.col("_f.start"), F.col("_f.open")
    cr = ~open_end & part.endswith("\r") if delimiter is None else F.lit(False)
    content = F.when(cr, F.left(part, F.length(part) - 1)).otherwise(part)
    # nothing follows a final delimiter, and empty text has no record
    return rows.where(~(open_end & (part == ""))).select(
        key,
        "ordinal",
        start.alias("start"),
        (start + F.octet_length(content)).alias("end"),
        (start + F.octet_length(part) + F.when(open_end, 0).otherwise(width)).alias("delimiter_end"),
        content.alias("text"),
        F.contains(content, F.lit("\ufffd")).alias("lossy"),
        open_end.alias("unterminated"),
    )


def frame_reject(df: DataFrame, data: str, raw_limit: int, decoded_limit: int, excerpt: int = MAX_EXCERPT) -> DataFrame:
    """Tag each byte record with a rejection ``reason`` (null when good) and a bounded head of rejected bytes.

    Good and rejected rows are two filters over this one pass.
    """
    require_between("raw_limit", raw_limit, 1, 1 << 20)
    require_between("decoded_limit", decoded_limit, 1, 1 << 22)
    require_between("excerpt", excerpt, 1, MAX_EXCERPT)
    require_kind(df, data, "Bytes")
    raw = F.col(data)
    text = raw.cast("string")
    valid = F.is_valid_utf8(text)
    reason = (
        F.when(F.octet_length(raw) > raw_limit, "raw_limit")
        .when(~valid, "invalid_utf8")
        .when(F.octet_length(text) > decoded_limit, "decoded_limit")
    )
    return df.withColumns(
        {
            "reason": reason,
            "text": F.when(reason.isNull(), text),
            "excerpt": F.when(reason.isNotNull(), F.substring(raw, 1, excerpt)),
            "excerpt_truncated": reason.isNotNull() & (F.octet_length(raw) > excerpt),
        }
    )


def strict_frames(df: DataFrame, data: str, raw_limit: int, decoded_limit: int) -> DataFrame:
    """Decoded records; the first malformed one fails the query."""
    tagged = frame_reject(df, data, raw_limit, decoded_limit)
    text = refuse_when(F.col("reason").isNotNull(), F.col("text"), F.concat(F.lit("malformed record: "), F.col("reason")))
    return tagged.withColumn("text", text).drop("reason", "excerpt", "excerpt_truncated")


def byte_range(data: Column, start: int, limit: int) -> Column:
    """Bytes [start, start + limit) of a binary column; a start past the end fails."""
    require_between("start", start, 0, 1 << 31)
    require_between("limit", limit, 1, 65_536)
    return refuse_when(F.octet_length(data) < start, F.substring(data, start + 1, limit), "range starts past the end")


def scan_excerpt(df: DataFrame, ordinal: str, start: int, rows: int) -> DataFrame:
    """At most a hundred original records from an ordinal on; the range is pruned by Parquet statistics."""
    require_between("start", start, 0, 1 << 62)
    require_between("rows", rows, 1, 100)
    return df.where((F.col(ordinal) >= start) & (F.col(ordinal) < start + rows))


def event_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Events of a line protocol: ``data`` lines joined by LF, a blank line ends an event, the open tail is dropped.

    Works inside the cell on arrays, so no shuffle is needed: blocks are what lies between blank lines.
    """
    clean = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    clean = F.when(clean.startswith("\ufeff"), F.substring(clean, F.lit(2), F.length(clean))).otherwise(clean)
    # an event ends with an empty line: its last line end is followed by another line end
    blocks = F.split(F.regexp_replace(clean, r"\A\n+", ""), r"\n\n+", -1)
    closed = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    is_data = lambda line: (line == "data") | line.startswith("data:")
    value = lambda line: F.regexp_replace(F.substring(line, F.lit(6), F.length(line)), r"\A ", "")

    def payload(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), is_data)
        return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, value), "\n"))

    events = F.filter(F.transform(closed, payload), lambda e: e.isNotNull())
    return items_table(df.select(key, events.alias("_e")), F.col("_e"), "event", "ordinal").drop("_e")
