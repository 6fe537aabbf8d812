"""Text, regular-expression and terminal-text functions.

The ``*_items`` functions return arrays; :func:`items_table` turns any of them into one row per item with its index,
a narrow step without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.guards import LimitError, refuse_when

MAX_PATTERN_BYTES = 16 * 1024
_ESCAPE = "\x1b"
# 7-bit CSI sequences and terminated OSC sequences
_TERMINAL = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)"


_COUNT = re.compile(r"\{\d+(?:,\d*)?\}")
_LOOKS = ("(?=", "(?!", "(?<=", "(?<!", "(?>")


def _class_end(regex: str, at: int) -> int:
    """Index behind the character class that opens at ``at``."""
    depth = 0
    while at < len(regex):
        depth += {"[": 1, "]": -1}.get(regex[at], 0)
        at += 2 if regex[at] == "\\" else 1
        if depth == 0:
            break
    return at


def _outside_dialect(regex: str) -> bool:
    """Whether a pattern looks around, refers back or repeats possessively. Escapes and classes are read as one piece."""
    at, repeated = 0, False
    while at < len(regex):
        char = regex[at]
        if char == "\\":
            kind = regex[at + 1 : at + 2]
            if kind and kind in "123456789" or regex.startswith("k<", at + 1):
                return True
            stop = "\\E" if kind == "Q" else "}" if regex[at + 2 : at + 3] == "{" and kind in "pPxN" else ""
            end = regex.find(stop, at + 2) if stop else at + 2
            at, repeated = len(regex) if end < 0 else end + len(stop), False
        elif char == "[":
            at, repeated = _class_end(regex, at), False
        elif char == "(":
            if regex.startswith(_LOOKS, at):
                return True
            at, repeated = at + (2 if regex.startswith("(?", at) else 1), False
        elif char in "*+?" or char == "{" and _COUNT.match(regex, at):
            if repeated and char == "+":
                return True
            at += _COUNT.match(regex, at).end() - at if char == "{" else 1
            repeated = not repeated  # the mark behind a repeat only says how it repeats
        else:
            at, repeated = at + 1, False
    return False


def pattern(regex: str) -> str:
    """Check a pattern and select Unicode classes and LF-only line ends.

    Look-around, atomic groups, possessive repeats and back-references are refused; they have no linear-time meaning.
    """
    if len(regex.encode()) > MAX_PATTERN_BYTES:
        raise LimitError("pattern exceeds 16 KiB")
    if _outside_dialect(regex):
        raise LimitError("look-around, back-references and possessive repeats are not supported")
    return f"(?Ud){regex}"


def _compiled(regex: str):
    """The pattern as the JVM reads it, which is what the queries run."""
    return SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern(regex))


def found_in(regex: str, text: str) -> bool:
    """Whether the pattern occurs in a text, decided while planning."""
    return _compiled(regex).matcher(text).find()


def _nonempty_pattern(regex: str) -> str:
    checked = pattern(regex)
    if found_in(regex, ""):
        raise LimitError("a pattern that matches empty text cannot split")
    return checked


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once per row.

    A lambda that mentions an outer expression evaluates it again for every element; a lambda variable does not.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


_BLOCK = 64


def offsets(sizes: Column) -> Column:
    """Start of each element when elements of these sizes lie one after the other (an exclusive running sum).

    Stays inside the row, so spans of a text need no shuffle. Sums are taken per block of elements first: the work
    is elements times block size, not elements squared.
    """
    total = lambda items: F.reduce(items, F.lit(0).cast("bigint"), lambda n, size: n + size)
    block = lambda index: F.call_function("div", index, F.lit(_BLOCK)).cast("int")

    def within(s: Column) -> Column:
        count = block(F.size(s) - 1) + 1
        blocks = F.transform(F.sequence(F.lit(1), count), lambda j: total(F.slice(s, (j - 1) * _BLOCK + 1, F.lit(_BLOCK))))
        heads = let(blocks, lambda b: F.transform(b, lambda _, j: total(F.slice(b, F.lit(1), j))))
        return let(
            heads,
            lambda h: F.transform(
                s, lambda _, i: F.get(h, block(i)) + total(F.slice(s, block(i) * _BLOCK + 1, i - block(i) * _BLOCK))
            ),
        )

    return let(sizes, lambda s: F.when(F.size(s) > 0, within(s)).otherwise(F.array().cast("array<bigint>")))


def line_items(text: Column) -> Column:
    """Lines by LF or CRLF; a lone CR is content, a final line end adds no empty line, empty text has no lines."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    # a final line end (or empty text) leaves an empty last piece
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def char_items(text: Column) -> Column:
    """Unicode scalars; empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def word_items(text: Column) -> Column:
    """Runs between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def split_items(text: Column, delimiter: str) -> Column:
    """Pieces between a literal delimiter; empty pieces stay, empty text is one empty piece."""
    if not delimiter:
        raise LimitError("delimiter must not be empty")
    return F.split(text, re.escape(delimiter) if "\\E" in delimiter else f"\\Q{delimiter}\\E", -1)


def regex_split_items(text: Column, regex: str) -> Column:
    return F.split(text, _nonempty_pattern(regex), -1)


def match_items(text: Column, regex: str) -> Column:
    """All non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern(regex)), F.lit(0))


def capture_items(text: Column, regex: str) -> Column:
    """Matches with their groups. A group that took no part is '' (the JVM function does not tell it apart)."""
    groups = _compiled(regex).matcher("").groupCount()
    columns = [F.regexp_extract_all(text, F.lit(pattern(regex)), F.lit(i)) for i in range(groups + 1)]
    zipped = F.arrays_zip(*[c.alias(f"g{i}") for i, c in enumerate(columns)])
    return F.transform(
        zipped,
        lambda m: F.struct(
            m["g0"].alias("match"), F.array(*[m[f"g{i}"] for i in range(1, groups + 1)]).alias("groups")
        ),
    )


def regex_test(text: Column, regex: str) -> Column:
    """Whether the pattern occurs anywhere."""
    return text.rlike(pattern(regex))


def items_table(df: DataFrame, items: Column, item: str = "item", index: str = "index") -> DataFrame:
    """One row per array element with its 0-based index; rows without elements disappear."""
    return df.select("*", F.posexplode(items).alias(index, item)).withColumn(index, F.col(index).cast("bigint"))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end); bounds outside the text fail."""
    bad = (start < 0) | (end < start) | (end > F.length(text))
    return refuse_when(bad, F.substring(text, start + 1, end - start), "slice bounds lie outside the text")


def slice_list(items: Column, start: Column, end: Column) -> Column:
    """Elements [start, end); bounds outside the list fail."""
    bad = (start < 0) | (end < start) | (end > F.size(items))
    return refuse_when(bad, F.slice(items, start + 1, end - start), "slice bounds lie outside the list")


def char_at(text: Column, index: Column) -> Column:
    bad = (index < 0) | (index >= F.length(text))
    return refuse_when(bad, F.substring(text, index + 1, F.lit(1)), "index lies outside the text")


def strip_ansi(text: Column) -> Column:
    """Text without CSI and OSC sequences; any other or incomplete escape fails."""
    clean = F.regexp_replace(text, _TERMINAL, "")
    return refuse_when(F.contains(clean, F.lit(_ESCAPE)), clean, "unsupported or incomplete terminal escape")


def ansi_spans(text: Column) -> Column:
    """Kept runs of :func:`strip_ansi` as half-open UTF-8 byte ranges in the input and in the output."""
    kept = F.transform(F.split(text, _TERMINAL, -1), lambda run: F.octet_length(run).cast("bigint"))
    cut = F.transform(F.regexp_extract_all(text, F.lit(_TERMINAL), F.lit(0)), lambda run: F.octet_length(run).cast("bigint"))
    # nothing was cut before the first run
    skipped = offsets(F.concat(cut, F.array(F.lit(0).cast("bigint"))))
    runs = F.arrays_zip(kept.alias("size"), offsets(kept).alias("out"), skipped.alias("skipped"))
    spans = F.transform(
        runs,
        lambda r: F.struct(
            (r["out"] + r["skipped"]).alias("input_start"),
            (r["out"] + r["skipped"] + r["size"]).alias("input_end"),
            r["out"].alias("output_start"),
            (r["out"] + r["size"]).alias("output_end"),
        ),
    )
    return F.filter(spans, lambda s: s["input_end"] > s["input_start"])


def decode_utf8(data: Column, lossy: bool = False) -> Column:
    """Text of Bytes; malformed UTF-8 fails, or is replaced by U+FFFD when ``lossy``."""
    raw = data.cast("string")
    return F.make_valid_utf8(raw) if lossy else F.validate_utf8(raw)
