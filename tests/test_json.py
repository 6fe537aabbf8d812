"""JSON: places of faults against a separate reader, exact numbers, contracts."""

import json
import re
from decimal import Decimal

import pytest
from helpers import fails, value
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import values
from plumbline.guards import KindError
from plumbline.operators import decoding
from plumbline.operators.contracts import list_of, map_of, option_of, record, scalar, union_of

NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
STRING = re.compile(r'"([^"\\\x00-\x1f]|\\(["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')


class Fault(Exception):
    pass


def read(t, i):
    """Recursive descent over one value; returns its end or raises at the offending character."""

    def blank(i):
        while i < len(t) and t[i] in " \t\r\n":
            i += 1
        return i

    def expect(i, mark):
        if t[i : i + 1] != mark:
            raise Fault(i)
        return i + 1

    i = blank(i)
    if t[i : i + 1] == "[":
        i = blank(i + 1)
        if t[i : i + 1] == "]":
            return i + 1
        while True:
            i = blank(read(t, i))
            if t[i : i + 1] == "]":
                return i + 1
            i = blank(expect(i, ","))
    if t[i : i + 1] == "{":
        i = blank(i + 1)
        if t[i : i + 1] == "}":
            return i + 1
        while True:
            name = STRING.match(t, i)
            if not name:
                raise Fault(i)
            i = blank(read(t, expect(blank(name.end()), ":")))
            if t[i : i + 1] == "}":
                return i + 1
            i = blank(expect(i, ","))
    for rule in (STRING, NUMBER, re.compile("true|false|null")):
        if found := rule.match(t, i):
            return found.end()
    raise Fault(i)


def place(t):
    try:
        end = read(t, 0)
        end = len(t) - len(t[end:].lstrip(" \t\r\n"))
        if end == len(t):
            return None
    except Fault as fault:
        (end,) = fault.args
    return t.count("\n", 0, end) + 1, end - (t.rfind("\n", 0, end) + 1) + 1


def decoded(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return df.select("i", values.decode_json(F.col("t")).alias("d")).select("i", "d.ok", "d.error").orderBy("i").collect()


@settings(max_examples=1, deadline=None)
@given(st.data())
def test_places_of_faults(spark, data):
    piece = st.sampled_from(["{", "}", "[", "]", ",", ":", '"a"', '"b\\n"', "1", "-2.5", "true", "null", " ", "\n", "x", '"', "-", "01", "é😀", '"é😀"'])
    texts = data.draw(st.lists(st.lists(piece, max_size=9).map("".join), min_size=300, max_size=300))
    texts += ["", "{", '{"a": 1}}', '{"a":\n  [1, 2,\n  ]}', '{"a" 1}', '{"a":1,}', '{,}', '[1}', "[" * 300, '"' + "\\n" * 60000 + '"x', "[" + "1," * 5000 + "]", "1\n2"]
    got = decoded(spark, texts)
    for text, row in zip(texts, got, strict=True):
        want = place(text)
        if want is None:
            assert row.ok or re.findall('"a"|"b', text), text  # a field given twice is the only other fault here
            continue
        assert not row.ok and (row.error.line, row.error.column) == want, (text, want, row.error)


def test_fault_without_a_place(spark):
    row, null = decoded(spark, ['{"x":1,"x":2}', None])
    assert (row.ok, row.error.code, row.error.line, row.error.column) == (False, "JSON001", None, None)
    assert (null.ok, null.error.line) == (False, None)


def test_one_parse_is_not_deceived(spark):
    cheats = ["1],[2", '1,"s"],[2', "1,2", '1,"', "", ",", "1,", '"a"],["', "1}", "[1],[2]"]
    assert not any(r.ok for r in decoded(spark, cheats))


@pytest.mark.parametrize(
    "text",
    ["1e2", "1.5E-3", "-2.50e1", "0e5", "1E+3", "123456789.125e-6", "1e36", "-0.1e-10", "12345678901234567890.5", "9223372036854775808", "1.10"],
)
def test_numbers_are_exact(spark, text):
    wrapped = f'{{"n": {text}, "s": "{text} \\" {text}"}}'
    row = spark.range(1).select(values.parse_json(F.lit(wrapped)).alias("v")).selectExpr("schema_of_variant(v) AS k", "to_json(v) AS j").collect()[0]
    assert "DECIMAL" in row.k and "DOUBLE" not in row.k
    back = json.loads(row.j, parse_float=Decimal, parse_int=Decimal)
    assert back["n"] == Decimal(text) and back["s"] == f'{text} " {text}'


@pytest.mark.parametrize("text", ["1" * 39, "1e40", "[1e-39]", "1e99999", "0." + "1" * 39])
def test_numbers_beyond_a_decimal_fail(spark, text):
    fails(spark.range(1).select(values.parse_json(F.lit(text))), "more digits")
    fails(spark.range(1).select(values.decode_json(F.lit(text))), "more digits")
    assert not decoded(spark, [text + "}"])[0].ok
    assert decoded(spark, [f'"{text}"'])[0].ok


ROW = record(
    "Row",
    amount=scalar("Int", low=0, high=100),
    price=scalar("Decimal", low=Decimal("0.5")).or_missing(),
    tag=option_of(scalar("Text", max_length=3)),
    items=list_of(record("Item", ok=scalar("Bool")), max_items=2).or_missing(),
    sizes=map_of(scalar("Int")).or_missing(),
    either=union_of(scalar("Int"), scalar("Text")).or_missing(),
)
GOOD = '{"amount": 5, "tag": null}'


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (GOOD, []),
        ('{"amount": 5, "price": 1, "tag": "abc", "items": [{"ok": true}], "sizes": {"a": 1}, "either": "x", "more": [1]}', []),
        ("null", ["", "expected Row"]),
        ("[]", ["", "expected Row"]),
        ("{}", ["/amount", "missing", "/tag", "missing"]),
        ('{"amount": 1.0, "tag": null}', ["/amount", "expected Int"]),
        ('{"amount": null, "tag": null}', ["/amount", "expected Int"]),
        ('{"amount": 101, "tag": "abcd"}', ["/amount", "bounds", "/tag", "length"]),
        ('{"amount": 1, "tag": null, "price": 4e-1}', ["/price", "bounds"]),
        ('{"amount": 1, "tag": null, "items": [{"ok": 1}, {}, null]}', ["/items/0/ok", "Bool", "/items/1/ok", "missing", "/items/2", "Item", "/items", "count"]),
        ('{"amount": 1, "tag": null, "sizes": {"a/b": "x"}}', ["/sizes/a~1b", "expected Int"]),
        ('{"amount": 1, "tag": null, "either": true}', ["/either", "alternative"]),
    ],
)
def test_contract(spark, text, found):
    got = value(spark, decoding.json_issues(ROW, values.parse_json(F.lit(text))))
    assert [i.path for i in got] == found[::2] and all(part in i.message for i, part in zip(got, found[1::2], strict=True))
    result = value(spark, decoding.decode_json(F.lit(text), ROW).dropFields("value"))
    assert result.ok == (not found) and (result.error is None) == (not found)
    if found:
        assert result.error.code == "JSON002"
        fails(spark.range(1).select(decoding.parse_json(F.lit(text), ROW)), "does not satisfy the contract")
    else:
        assert value(spark, decoding.parse_json(F.lit(text), ROW)) is not None


def test_contract_edges(spark):
    number = union_of(scalar("Int"), scalar("Decimal"))
    codes = [value(spark, decoding.decode_json(F.lit(t), number)["error"]) for t in ("1", "1.5", '"a"', "{")]
    assert [c and c.code for c in codes] == ["JSON003", None, "JSON002", "JSON001"] and (codes[3].line, codes[3].column) == (1, 2)
    assert value(spark, decoding.parse_json(F.lit(None).cast("string"), ROW)) is None
    with pytest.raises(KindError):
        decoding.json_issues(scalar("Instant"), F.parse_json(F.lit("1")))
