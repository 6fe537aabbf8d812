import re

import pytest
from helpers import fails, rows, value
from pyspark.sql import functions as F

from plumbline.functions import text, values
from plumbline.guards import LimitError
from plumbline.operators.recipes import Recipe
from plumbline.sources import framing


@pytest.mark.parametrize(
    "cell, expected",
    [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n\nc", ["a", "b", "", "c"]), ("a\rb\n", ["a\rb"]), ("\n", [""]), ("終\r", ["終\r"])],
)
def test_lines(spark, cell, expected):
    assert value(spark, text.line_items(F.lit(cell))) == expected


def test_other_items(spark):
    assert value(spark, text.char_items(F.lit("a😀é"))) == ["a", "😀", "é"]
    assert value(spark, text.char_items(F.lit(""))) == []
    assert value(spark, text.word_items(F.lit("  a b \n"))) == ["a", "b"]
    assert value(spark, text.split_items(F.lit("a..b."), ".")) == ["a", "", "b", ""]
    assert value(spark, text.split_items(F.lit(""), ",")) == [""]
    assert value(spark, text.regex_split_items(F.lit("a1b22"), "[0-9]")) == ["a", "b", "", ""]
    assert value(spark, text.match_items(F.lit("ab12c3"), "[0-9]+")) == ["12", "3"]
    assert [tuple(r) for r in value(spark, text.capture_items(F.lit("k=v x=y"), "(\\w)=(\\w)"))] == [
        ("k=v", ["k", "v"]), ("x=y", ["x", "y"])]


@pytest.mark.parametrize("bad", ["(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "a++", "x" * 20000])
def test_patterns_outside_the_dialect(bad):
    with pytest.raises(LimitError):
        text.pattern(bad)


def test_splitting_on_nothing_is_refused():
    with pytest.raises(LimitError):
        text.regex_split_items(F.lit("a"), "x*")
    with pytest.raises(LimitError):
        text.split_items(F.lit("a"), "")


def test_unicode_classes(spark):
    assert value(spark, text.regex_test(F.lit("é"), r"^\w$"))
    assert value(spark, text.match_items(F.lit("a\rb"), "a.b")) == ["a\rb"]


def test_terminal_text(spark):
    raw = "\x1b[1;31mrot\x1b[0m \x1b]0;title\x07é\x1b]8;;u\x1b\\x"
    assert value(spark, text.strip_ansi(F.lit(raw))) == "rot éx"
    spans = [tuple(s) for s in value(spark, text.ansi_spans(F.lit(raw)))]
    data = raw.encode()
    assert b"".join(data[a:b] for a, b, _, _ in spans).decode() == "rot éx"
    assert [s[2:] for s in spans] == [(0, 3), (3, 4), (4, 6), (6, 7)]
    for bad in ("\x1b[12", "\x1bM", "\x1b]0;open", "\x1b"):
        fails(spark.range(1).select(text.strip_ansi(F.lit(bad))), "terminal escape")


def test_slices_are_strict(spark):
    assert value(spark, text.slice_text(F.lit("a😀b"), F.lit(1), F.lit(2))) == "😀"
    assert value(spark, text.char_at(F.lit("abc"), F.lit(2))) == "c"
    one = spark.range(1)
    fails(one.select(text.slice_text(F.lit("abc"), F.lit(1), F.lit(4))), "outside the text")
    fails(one.select(text.slice_list(F.array(F.lit(1)), F.lit(1), F.lit(0))), "outside the list")
    fails(one.select(values.element(F.array(F.lit(1)), F.lit(1))), "outside the list")


def test_utf8(spark):
    bad = F.unhex(F.lit("61FF62"))
    assert value(spark, text.decode_utf8(bad, lossy=True)) == "a�b"
    fails(spark.range(1).select(text.decode_utf8(bad)), "UTF")


def test_options_and_ranges(spark):
    assert value(spark, values.int_range(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))) == [0, 1, 2]
    assert value(spark, values.int_range(F.lit(3).cast("bigint"), F.lit(1).cast("bigint"))) == []
    minus = F.lit(-2).cast("bigint")
    assert value(spark, values.int_range(F.lit(5).cast("bigint"), F.lit(0).cast("bigint"), minus)) == [5, 3, 1]
    fails(spark.range(1).select(values.int_range(F.col("id"), F.col("id"), F.lit(0).cast("bigint"))), "must not be zero")
    m = F.create_map(F.lit("a"), F.lit(None).cast("int"))
    assert value(spark, values.entry(m, F.lit("a"))) is None
    fails(spark.range(1).select(values.entry(m, F.lit("b"))), "no such field")


@pytest.mark.parametrize("good", ["1", "null", '"a"', "[1, 2]", '{"a": {"b": []}}', " true "])
def test_json(spark, good):
    decoded = value(spark, F.struct(values.decode_json(F.lit(good))["ok"], values.decode_json(F.lit(good))["value"].isNotNull()))
    assert tuple(decoded) == (True, True)


@pytest.mark.parametrize("bad", ["", "{", '{"a": 1}}', "1 2", "1,2", "1] x", '1, "b": 2', "nope"])
def test_malformed_json(spark, bad):
    decoded = value(spark, values.decode_json(F.lit(bad)).dropFields("value"))
    assert decoded.ok is False and decoded.error.code == "JSON001" and bad not in (decoded.error.message, "x")
    fails(spark.range(1).select(values.parse_json(F.lit(bad))), "not valid JSON")


def test_recipe(spark):
    df = spark.createDataFrame([(1, "a,bb,,ccc,dd")], "id int, t string")
    recipe = Recipe("t", lambda c: text.split_items(c, ",")).filter(lambda x: x != "").skip(1).take(2).map(F.upper)
    assert rows(recipe.use(df), "index", "item") == [(0, "BB"), (1, "CCC")]


def frames_of(cell, delimiter=None):
    """Spans by a byte scan."""
    data, found, at = cell.encode(), [], 0
    pattern = re.compile(rb"\r?\n" if delimiter is None else re.escape(delimiter.encode()))
    for m in pattern.finditer(data):
        found.append((at, m.start(), m.end(), data[at : m.start()].decode(), False))
        at = m.end()
    if at < len(data):
        found.append((at, len(data), len(data), data[at:].decode(), True))
    return found


@pytest.mark.parametrize("delimiter", [None, "--"])
def test_frames_match_a_byte_scan(spark, delimiter):
    cells = ["", "a", "é\r\n終\n", "x\ry\n\n", "one--two--", "--", "tail\r", "\r\n"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, t string")
    got = rows(framing.frame_lines(df, "id", "t", delimiter), "id", "ordinal", "start", "end", "delimiter_end", "text", "unterminated")
    want = [(i, n, *frame) for i, c in enumerate(cells) for n, frame in enumerate(frames_of(c, delimiter))]
    assert got == sorted(want, key=repr)


def test_rejected_frames(spark):
    data = [(1, bytearray(b"ok")), (2, bytearray(b"a\xff")), (3, bytearray(b"123456"))]
    df = spark.createDataFrame(data, "id int, data binary")
    tagged = framing.frame_reject(df, "data", raw_limit=5, decoded_limit=100, excerpt=2)
    assert rows(tagged, "id", "reason", "text", "excerpt_truncated") == [
        (1, None, "ok", False), (2, "invalid_utf8", None, False), (3, "raw_limit", None, True)]
    assert [bytes(r[0]) for r in rows(tagged.where("id = 3"), "excerpt")] == [b"12"]
    fails(framing.strict_frames(df, "data", 5, 100), "malformed record")


def test_event_blocks(spark):
    body = "﻿data: a\ndata:b\n: note\n\nid: 1\n\n\ndata\n\ndata: open\n"
    df = spark.createDataFrame([(1, body), (2, body.replace("\n", "\r\n"))], "id int, t string")
    expected = [(0, "a\nb"), (1, "")]
    for i in (1, 2):
        assert rows(framing.event_blocks(df.where(f"id = {i}"), "id", "t"), "ordinal", "event") == expected


def test_byte_range(spark):
    data = F.encode(F.lit("hello"), "utf-8")
    assert bytes(value(spark, framing.byte_range(data, 1, 3))) == b"ell"
    fails(spark.range(1).select(framing.byte_range(data, 6, 1)), "past the end")


@pytest.mark.parametrize("regex", [r"\++", "[*+]+", r"\p{L}+", r"\p{Z}+", r"a+?", r"a{2}?", r"[\]+]+", r"\Q++\E", r"(?i)a+", r"(?<n>a)+", "[a[b+]]+", r"\\+"])
def test_patterns_of_the_dialect(spark, regex):
    assert text.pattern(regex).endswith(regex)


@pytest.mark.parametrize("regex", ["a++", "a?+", "a*+", r"\d{2}+", "(a)++", r"\1", r"(a)\k<n>", "(?=a)", "(?<!a)b", "(?>a)", r"[+]++"])
def test_patterns_outside_the_dialect(spark, regex):
    with pytest.raises(LimitError):
        text.pattern(regex)


def test_groups_are_counted_as_the_jvm_reads_them(spark):
    got = value(spark, text.capture_items(F.lit("ab 12"), r"(\p{L}+)\s(?<n>\d)"))
    assert got[0]["groups"] == ["ab", "1"]
    with pytest.raises(LimitError):
        text.regex_split_items(F.lit("x"), r"\p{N}*")
