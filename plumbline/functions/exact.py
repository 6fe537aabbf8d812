"""Exact arithmetic on Int (BIGINT) and Decimal columns.

Int overflow and Decimal overflow beyond 38 digits fail the query (ANSI mode); nothing is rounded unless the caller
asks for it with :func:`round_div`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.guards import refuse_when, require_between

_WIDE = "decimal(38,0)"
_TOO_FINE = "operand has more fractional digits than its scale"
_LONG = (1 << 63) - 1
_SHORT = _LONG // 10**9  # divisors whose remainders can be scaled by nine digits within BIGINT


def div(a: Column, b: Column) -> Column:
    """Quotient truncated towards zero; division by zero fails."""
    return F.call_function("div", a, b)


def rem(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; division by zero fails."""
    return a % b


def _as_whole(value: Column, scale: int) -> Column:
    """``value * 10**scale`` as a whole decimal; a value with more than ``scale`` fractional digits is refused."""
    if scale == 0:
        return refuse_when(value % 1 != 0, value, _TOO_FINE)
    digits = min(19, 36 - 2 * scale)  # so that the product below keeps all digits
    unit = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
    shift = F.lit(Decimal(10**scale)).cast(f"decimal({scale + 1},0)")
    whole = (value.cast(f"decimal({digits + scale},{scale})") * shift).cast(f"decimal({digits + scale},0)")
    return refuse_when(value % unit != 0, whole, _TOO_FINE)


def exact_div(a: Column, b: Column, scale: int = 0) -> Column:
    """``a / b`` as a decimal with 19 fractional digits, failing unless the quotient is exact.

    Operands are Int, or Decimals with at most ``scale`` fractional digits; others are refused. The quotient is exact when
    the integer remainder of ``a * 10**19`` by ``b`` is zero; a finite quotient that needs more than 19 places is refused
    like 1/3 is. Most quotients end within nine places, which BIGINT arithmetic decides without wide decimals.
    """
    require_between("scale", scale, 0, 17)
    left, right = (_as_whole(x, scale).cast(_WIDE) for x in (a, b))
    long_left, long_right = left.try_cast("bigint"), right.try_cast("bigint")
    # null instead of a failure: a condition may be evaluated ahead of the branch it guards
    billionths = F.try_multiply(long_left, F.lit(10**9).cast("bigint"))
    short = F.coalesce(F.try_mod(billionths, long_right) == 0, F.lit(False))
    near = (div(billionths, long_right).cast("decimal(19,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(38,19)")
    top, bottom = F.abs(left), F.abs(right)
    tail = ((top % bottom).cast(_WIDE) * F.lit(Decimal(10**19)).cast(_WIDE)).cast(_WIDE)
    places = F.lpad((tail / bottom).cast("decimal(20,0)").cast("string"), 19, "0")
    sign = F.when((left < 0) != (right < 0), "-").otherwise("")
    written = F.concat(sign, div(top, bottom).cast("string"), F.lit("."), places).cast("decimal(38,19)")
    far = refuse_when(tail % bottom != 0, written, "division has no exact decimal result")
    return F.when(short, near).otherwise(far)


def round_div(a: Column, b: Column, scale: int, operand_scale: int = 0) -> Column:
    """``a / b`` rounded half-even to ``scale`` places, in integer arithmetic only.

    Operands are Int, or Decimals with at most ``operand_scale`` fractional digits; others are refused. Both are brought to
    whole numbers of that unit, so the quotient stays the same. It is truncated once and corrected by comparing twice the
    remainder with the divisor, so no value is rounded twice.
    """
    require_between("scale", scale, 0, 16)
    require_between("operand_scale", operand_scale, 0, 17)
    return _rounded_ratio(_as_whole(a, operand_scale), _as_whole(b, operand_scale), scale, half_even=True)


def round_div_half_up(a: Column, b: Column, scale: int) -> Column:
    """``a / b`` for nonnegative Int operands, ties away from zero."""
    return _rounded_ratio(a, b, scale, half_even=False)


def _rounded_ratio(a: Column, b: Column, scale: int, half_even: bool) -> Column:
    def magnitude(top: Column, bottom: Column) -> Column:
        whole = div(top, bottom)  # BIGINT; a quotient beyond 63 bits fails
        # up when twice the remainder exceeds the divisor, or equals it and the tie goes up (an odd quotient, or always)
        tie = whole % 2 if half_even else F.lit(1)
        return whole + ((top % bottom) * 2 + tie > bottom).cast("bigint")

    # BIGINT arithmetic where the scaled operands fit, 38-digit decimals elsewhere
    fits = (F.abs(a) < _LONG // 10**scale) & (F.abs(b) < _LONG // 2)
    narrow = magnitude(F.abs(a).cast("bigint") * 10**scale, F.abs(b).cast("bigint"))
    wide_top = (F.abs(a.cast(_WIDE)) * F.lit(Decimal(10**scale)).cast(_WIDE)).cast(_WIDE)
    size = F.when(fits, narrow).otherwise(magnitude(wide_top, F.abs(b.cast(_WIDE))))
    signed = F.when((a < 0) != (b < 0), -size).otherwise(size).cast("decimal(20,0)")
    unit = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
    return (signed * unit).cast(f"decimal(38,{scale})")


def _long_division(top: Column, bottom: Column, places: int) -> Column:
    """``{whole, digits, rest, bottom}`` of nonnegative whole numbers: ``places`` digits behind the point, as text.

    The remainder goes from limb to limb within the row. A limb is as wide as the divisor lets its product be: nine digits
    in BIGINT, eighteen in 38-digit decimals under a BIGINT divisor, two under a longer one.
    """

    def chain(x: Column, kind: str, width: int) -> Column:
        head = places % width
        widths = F.array(*[F.lit(w) for w in ([head] if head else []) + [width] * (places // width)]).cast("array<int>")
        power = lambda w: F.when(w == width, F.lit(Decimal(10**width))).otherwise(F.lit(Decimal(10**head)))
        if kind == "bigint":
            power = lambda w: F.when(w == width, F.lit(10**width)).otherwise(F.lit(10**head)).cast(kind)
        state = lambda rest, digits: F.struct(rest.cast(kind).alias("rest"), digits.alias("digits"))

        def over(divisor: Column) -> Column:
            def limb(left: Column, w: Column) -> Column:
                scaled = (left["rest"] * power(w)).cast(kind)
                return state(scaled % divisor, F.concat(left["digits"], F.lpad(div(scaled, divisor).cast("string"), w, F.lit("0"))))

            return F.reduce(widths, state(x["top"].cast(kind) % divisor, F.lit("")), limb)

        done = let(x["bottom"].cast(kind), over)
        return F.struct(done["rest"].cast(_WIDE).alias("rest"), done["digits"].alias("digits"))

    def divided(x: Column) -> Column:
        # lazily: only the branch of the row's own size runs
        short = (x["top"] <= _LONG) & (x["bottom"] < _SHORT)
        parts = (
            F.when(short, chain(x, "bigint", 9))
            .when(x["bottom"] <= _LONG, chain(x, _WIDE, 18))
            .otherwise(chain(x, _WIDE, 2))
        )
        whole = ((x["top"] - x["top"] % x["bottom"]) / x["bottom"]).cast(_WIDE)
        return let(
            parts,
            lambda d: F.struct(
                whole.cast("string").alias("whole"), d["digits"].alias("digits"), d["rest"].alias("rest"), x["bottom"].alias("bottom")
            ),
        )

    return let(F.struct(top.cast(_WIDE).alias("top"), bottom.cast(_WIDE).alias("bottom")), divided)


def _written(negative: Column, whole: Column, digits: Column) -> Column:
    """Decimal text; zero has no sign."""
    sign = F.when(negative & F.concat(whole, digits).rlike("[1-9]"), "-").otherwise("")
    return F.concat(sign, whole, F.when(F.length(digits) > 0, F.concat(F.lit("."), digits)).otherwise(""))


def round_div_text(a: Column, b: Column, scale: int, operand_scale: int = 0) -> Column:
    """``a / b`` rounded half-even to ``scale`` places (0 to 1024), as decimal text with exactly that many digits.

    For results that DECIMAL(38) cannot hold; operands as in :func:`round_div`. Quotients from 10**32 on fail.
    """
    require_between("scale", scale, 0, 1024)
    require_between("operand_scale", operand_scale, 0, 17)
    top, bottom = _as_whole(a, operand_scale), _as_whole(b, operand_scale)

    def rounded(d: Column) -> Column:
        all_digits = F.concat(d["whole"], d["digits"])
        odd = F.substring(all_digits, -1, 1).cast("int") % 2
        twice = d["rest"] - (d["bottom"] - d["rest"])  # the sign of twice the remainder less the divisor, within 38 digits
        up = (twice > 0) | ((twice == 0) & (odd == 1))
        kept = F.rtrim(all_digits, F.lit("9"))
        nines = F.repeat(F.lit("0"), F.length(all_digits) - F.length(kept))
        last = (F.substring(kept, -1, 1).cast("int") + 1).cast("string")
        body = F.when(F.length(kept) == 0, "1").otherwise(F.concat(F.substr(kept, F.lit(1), F.length(kept) - 1), last))
        digits = F.when(up, F.concat(body, nines)).otherwise(all_digits)
        return let(
            digits,
            lambda t: _written(
                (a < 0) != (b < 0), F.substr(t, F.lit(1), F.length(t) - scale), F.substr(t, F.length(t) - scale + 1, F.lit(scale))
            ),
        )

    return let(_long_division(F.abs(top), F.abs(bottom), scale), rounded)


def _short_digits(top: Column, bottom: Column) -> tuple[Column, Column]:
    """The places of ``top / bottom`` and what is left, for BIGINT operands and a divisor below ``_SHORT``.

    Such a divisor has at most 33 factors of two and fewer of five, so a quotient that ends does so within 36 places: four
    limbs of nine digits. They are written out rather than folded, so that Spark compiles them.
    """
    rest, limbs = top % bottom, []
    for _ in range(4):
        scaled = rest * 10**9
        limbs.append(F.lpad(div(scaled, bottom).cast("string"), 9, "0"))
        rest = scaled % bottom
    return F.when(top % bottom == 0, "").otherwise(F.rtrim(F.concat(*limbs), F.lit("0"))), rest


def exact_div_text(a: Column, b: Column, scale: int = 0) -> Column:
    """``a / b`` as decimal text with all its digits and none after the last nonzero one; fails where they never end.

    Operands as in :func:`exact_div`. A divisor of 36 digits holds at most 119 factors of two and fewer of five, so a
    quotient that ends does so within 120 places. Quotients from 10**32 on fail.
    """
    require_between("scale", scale, 0, 17)
    top, bottom = (F.abs(_as_whole(x, scale)) for x in (a, b))
    negative, endless = (a < 0) != (b < 0), "division has no exact decimal result"

    def ended(d: Column) -> Column:
        text = _written(negative, d["whole"], F.rtrim(d["digits"], F.lit("0")))
        return refuse_when(d["rest"] != 0, text, endless)

    narrow, divisor = top.try_cast("bigint"), bottom.try_cast("bigint")
    digits, rest = _short_digits(narrow, divisor)
    short = refuse_when(rest != 0, _written(negative, div(narrow, divisor).cast("string"), digits), endless)
    # lazily: only the branch of the row's own size runs
    return F.when(narrow.isNotNull() & (divisor < _SHORT), short).otherwise(let(_long_division(top, bottom, 126), ended))


def to_int(value: Column) -> Column:
    """Int from an integral Decimal; a fraction fails instead of being cut off."""
    whole = value.cast("bigint")
    return refuse_when(value % 1 != 0, whole, "number is not integral")


def text_to_int(value: Column) -> Column:
    """Int from Text made of an optional sign and digits."""
    return refuse_when(~value.rlike(r"\A[+-]?[0-9]+\z"), value.cast("bigint"), "text is not an Int")


def to_decimal(value: Column, scale: int = 6) -> Column:
    """Decimal from Int or Text; digits that do not fit ``scale`` fail."""
    narrow = value.cast(f"decimal(38,{scale})")
    text = value.cast("string")
    # what stands behind the point, without zeros at the end; powers of ten are compared by value
    digits = F.length(F.regexp_extract(text, r"\.([0-9]*?)0*$", 1))
    wide = value.cast("decimal(38,18)")
    lossy = F.when(text.rlike("[eE]"), narrow.cast("decimal(38,18)") != wide).otherwise(digits > scale)
    return refuse_when(lossy, narrow, "decimal needs more fractional digits")


def cents(value: Column) -> Column:
    """Minor units of a DOUBLE amount known to two places, as Int."""
    return F.round(value * 100).cast("bigint")
