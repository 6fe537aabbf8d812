from decimal import Decimal
from fractions import Fraction

import pytest
from helpers import fails, rows, value
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import exact
from plumbline.guards import KindError, LimitError, require_same_kind


def lit(n, kind="bigint"):
    return F.lit(n).cast(kind)


def test_documented_results(spark):
    assert value(spark, lit(1) + lit(2) * lit(3)) == 7
    assert value(spark, F.lit("0.1").cast("decimal(18,2)") + F.lit("0.2").cast("decimal(18,2)")) == Decimal("0.3")
    assert value(spark, exact.exact_div(lit(1), lit(4))) == Decimal("0.25")
    assert value(spark, exact.exact_div(lit(1), lit(128))) == Decimal("0.0078125")
    assert value(spark, exact.exact_div(lit(-7), lit(8))) == Decimal("-0.875")
    assert value(spark, exact.div(lit(-7), lit(2))) == -3
    assert value(spark, exact.rem(lit(-7), lit(2))) == -1


def test_refusals(spark):
    one = spark.range(1)
    fails(one.select(exact.exact_div(lit(1), lit(3))), "no exact decimal result")
    fails(one.select(exact.exact_div(lit(1), lit(0))), "BY_ZERO")
    fails(one.select(exact.div(lit(1), lit(0))), "BY_ZERO")
    fails(one.select(exact.round_div(lit(1), lit(0), 1)), "BY_ZERO")
    fails(one.select(lit(2**63 - 1) + F.col("id") + 1), "ARITHMETIC_OVERFLOW")
    fails(one.select(exact.to_int(F.lit("1.5").cast("decimal(5,2)"))), "not integral")
    fails(one.select(exact.text_to_int(F.lit("1.0"))), "not an Int")
    fails(one.select(exact.to_decimal(F.lit("1.25"), 1)), "fractional digits")
    with pytest.raises(LimitError):
        exact.round_div(lit(1), lit(1), 17)


def test_exact_div_with_decimal_operands(spark):
    a, b = (F.lit(x).cast("decimal(18,2)") for x in ("1.50", "0.25"))
    assert value(spark, exact.exact_div(a, b, scale=2)) == 6


def test_large_operands_take_the_wide_path(spark):
    assert value(spark, exact.round_div(lit(9 * 10**17), lit(7), 1)) == Decimal("128571428571428571.4")
    assert value(spark, exact.exact_div(lit(10**17 + 1), lit(1 << 10))) == Decimal(10**17 + 1) / 1024


@settings(max_examples=1, deadline=None)
@given(st.data())
def test_round_div_is_half_even(spark, data):
    pairs = data.draw(
        st.lists(st.tuples(st.integers(-(10**12), 10**12), st.integers(-50, 50).filter(bool)), min_size=200, max_size=200)
    )
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = df.select("a", "b", exact.round_div(F.col("a"), F.col("b"), 2).alias("r")).collect()
    for a, b, r in got:
        # Fraction rounds half to even
        assert r == Decimal(round(Fraction(a * 100, b))) / 100, (a, b)


def test_half_even_and_half_up_differ_only_on_ties(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (5, 8), (1, 3)], "a bigint, b bigint")
    even = rows(df.select("a", "b", exact.round_div(F.col("a"), F.col("b"), 2).cast("string")))
    up = rows(df.select("a", "b", exact.round_div_half_up(F.col("a"), F.col("b"), 2).cast("string")))
    assert even == [(1, 3, "0.33"), (1, 8, "0.12"), (3, 8, "0.38"), (5, 8, "0.62")]
    assert up == [(1, 3, "0.33"), (1, 8, "0.13"), (3, 8, "0.38"), (5, 8, "0.63")]


def test_int_and_decimal_do_not_mix(spark):
    df = spark.range(1).select(F.col("id").alias("i"), F.lit("1").cast("decimal(5,0)").alias("d"))
    assert require_same_kind(df, "i", "i") == "Int"
    with pytest.raises(KindError):
        require_same_kind(df, "i", "d")


def test_wide_operands_from_columns(spark):
    df = spark.createDataFrame([(10**17 + 1, 1024), (10**17, 10**17), (7, 8), (0, 5)], "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    # used twice, so that common parts are shared between the two
    twice = df.select("a", "b", exact.exact_div(a, b).alias("q"), (exact.exact_div(a, b) + 1).alias("r"))
    for row in twice.collect():
        assert row.q == Decimal(row.a) / row.b and row.r == row.q + 1
    rounded = df.select("a", "b", exact.round_div(a * 9, b, 9).alias("q"), exact.round_div(a * 9, b, 9).alias("r"))
    assert [r.q for r in rounded.collect() if r.a == 7] == [Decimal("7.875")]


def test_decimal_operands_keep_their_digits(spark):
    decimal = lambda text, kind: F.lit(text).cast(kind)
    assert value(spark, exact.round_div(decimal("7.5", "decimal(3,1)"), decimal("2.5", "decimal(3,1)"), 1, operand_scale=1)) == 3
    assert value(spark, exact.round_div(decimal("-0.25", "decimal(4,2)"), decimal("0.1", "decimal(3,1)"), 0, operand_scale=2)) == -2
    assert value(spark, exact.exact_div(decimal("1.5", "decimal(3,1)"), decimal("-0.50", "decimal(4,2)"), scale=2)) == -3
    assert value(spark, exact.exact_div(lit(4 * 10**18), lit(2))) == 2 * 10**18
    assert value(spark, exact.exact_div(lit(1), lit(1 << 19))) == Decimal(1) / (1 << 19)
    assert value(spark, exact.exact_div(lit(-(10**18)), lit(1 << 12))) == Decimal(-(10**18)) / 4096
    one = spark.range(1)
    fails(one.select(exact.round_div(decimal("7.5", "decimal(3,1)"), lit(2), 1)), "fractional digits")
    fails(one.select(exact.exact_div(decimal("1.5", "decimal(3,1)"), decimal("0.5", "decimal(3,1)"))), "fractional digits")
    fails(one.select(exact.exact_div(lit(1), lit(1 << 20))), "no exact decimal result")


def test_text_keeps_all_digits_or_fails(spark):
    assert value(spark, exact.to_decimal(F.lit("12345678901234567890123"), 0)) == 12345678901234567890123
    assert value(spark, exact.to_decimal(F.lit("1.5000000000000000000000"), 1)) == Decimal("1.5")
    fails(spark.range(1).select(exact.to_decimal(F.lit("0.1234567890123456789"), 18)), "fractional digits")
    fails(spark.range(1).select(exact.to_decimal(F.lit("1e-9"), 6)), "fractional digits")


def _text_of(fraction, scale):
    n = round(fraction * 10**scale)
    digits = str(abs(n)).rjust(scale + 1, "0")
    whole, rest = digits[: len(digits) - scale], digits[len(digits) - scale :]
    return ("-" if n < 0 else "") + whole + ("." + rest if rest else "")


@pytest.mark.parametrize("scale", [0, 1, 9, 18, 40, 1024])
def test_round_div_text_against_fractions(spark, scale):
    pairs = [(1, 3), (-1, 3), (2, 3), (1, 8), (5, 2), (3, 2), (-5, 2), (0, -7), (-1, 10**18), (999999999, 10**9 + 7)]
    pairs += [(2**63 - 1, 3), (2**63 - 1, 2**63 - 1), (10**17, 2**62 + 1), (-(2**62), 9 * 10**18), (10**9 - 1, 10**9), (199, 200)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = df.select("a", "b", exact.round_div_text(F.col("a"), F.col("b"), scale)).collect()
    assert [r[2] for r in got] == [_text_of(Fraction(r.a, r.b), scale) for r in got]


def test_round_div_text_with_long_decimals(spark):
    pairs = [("1.5", "0.4"), ("-9999999999999999.99", "3.01"), ("0.01", "9999999999999999.99"), ("7.00", "0.07")]
    df = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in pairs], "a decimal(18,2), b decimal(18,2)")
    got = df.select("a", "b", exact.round_div_text(F.col("a"), F.col("b"), 45, operand_scale=2)).collect()
    assert [r[2] for r in got] == [_text_of(Fraction(r.a) / Fraction(r.b), 45) for r in got]
    long = spark.createDataFrame([(Decimal(10**35 + 1), Decimal(3 * 10**34 + 7))], "a decimal(36,0), b decimal(36,0)")
    (row,) = long.select(exact.round_div_text(F.col("a"), F.col("b"), 50)).collect()
    assert row[0] == _text_of(Fraction(10**35 + 1, 3 * 10**34 + 7), 50)


def test_exact_div_text(spark):
    pairs = [(1, 2**20), (-3, 2**40), (1, 2**62), (7, 5**26), (6, 3), (0, 9), (2**63 - 1, 2**62)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for a, b, text in df.select("a", "b", exact.exact_div_text(F.col("a"), F.col("b"))).collect():
        assert Fraction(text) == Fraction(a, b) and ("." not in text or text[-1] != "0")
    assert value(spark, exact.exact_div_text(lit(1), lit(2**20))) == "0.00000095367431640625"
    fails(spark.range(1).select(exact.exact_div_text(lit(1), lit(3))), "no exact decimal result")
    fails(spark.range(1).select(exact.exact_div_text(lit(1), lit(0))), "BY_ZERO")
    fails(spark.range(1).select(exact.round_div_text(lit(1), lit(0), 40)), "BY_ZERO")
    assert value(spark, exact.round_div_text(lit(None), lit(2), 3)) is None
    with pytest.raises(LimitError):
        exact.round_div_text(lit(1), lit(1), 1025)


def test_exact_div_text_divides_short_operands_without_a_fold(spark, monkeypatch):
    monkeypatch.setattr(exact, "_long_division", lambda *_: F.struct(*[F.raise_error(F.lit("folded")).cast("string").alias(n) for n in ("whole", "digits", "rest", "bottom")]))
    most = (2**63 - 1) // 10**9
    pairs = [(1, 2**33), (2**63 - 1, 2**33), (-7, 2**20 * 5**5), (7, -(5**14)), (0, -3), (-12, 4), (1000, 8), (most - 1, most - 1), (9, 2**27)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = df.select("a", "b", exact.exact_div_text(F.col("a"), F.col("b"))).collect()
    assert [r[2] for r in got] == [_text_of(Fraction(r.a, r.b), 40).rstrip("0").rstrip(".") if r.a % r.b else str(r.a // r.b) for r in got]
    fails(spark.createDataFrame([(1, 3 * 2**20)], df.schema).select(exact.exact_div_text(F.col("a"), F.col("b"))), "no exact decimal result")
    fails(spark.createDataFrame([(1, 2**34)], df.schema).select(exact.exact_div_text(F.col("a"), F.col("b"))), "folded")
