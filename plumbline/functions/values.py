"""Options, records, maps and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.guards import refuse_when, required

# fixed diagnostic of undecodable JSON; it never echoes the input
JSON_CODE = "JSON001"
JSON_MESSAGE = "input is not valid JSON"


def is_some(value: Column) -> Column:
    return value.isNotNull()


def unwrap_or(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)


def has(record: Column, key: Column) -> Column:
    """Whether a map has the key, whatever its value."""
    return F.map_contains_key(record, key)


def keys(record: Column) -> Column:
    return F.map_keys(record)


def entry(record: Column, key: Column) -> Column:
    """Value under ``key``; a missing key fails, a null value is returned."""
    return refuse_when(~F.map_contains_key(record, key), record[key], "record has no such field")


def element(items: Column, index: Column) -> Column:
    """Element at a 0-based index; an index outside the list fails."""
    bad = (index < 0) | (index >= F.size(items))
    return refuse_when(bad, F.get(items, index), "index lies outside the list")


def int_range(start: Column, end: Column, step: Column | None = None) -> Column:
    """Integers from ``start`` towards ``end`` without it; the wrong direction is empty, step 0 fails."""
    step = F.lit(1).cast("bigint") if step is None else step
    last = end - F.signum(step).cast("bigint")
    towards = ((step > 0) & (start < end)) | ((step < 0) & (start > end))
    safe_step = refuse_when(step == 0, step, "step must not be zero")
    made = F.when(towards & (safe_step != 0), F.sequence(start, last, safe_step))
    return F.coalesce(made, F.when(safe_step != 0, F.array().cast("array<bigint>")))


# a string, a number, a name, a mark or white space; any other character is a token of its own
_TOKEN = (
    r'"(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
    r"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|[ \t\r\n]++|(?s:.)"
)
# what the parser would read as DOUBLE: an exponent, or more digits than a decimal has
_MAYBE_DOUBLE = r"[0-9][eE][-+0-9]|[0-9.]{39}"
_TOO_LONG = "JSON number has more digits than a Decimal holds"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _without_exponent(number: Column) -> Column:
    """A number token in plain digits, always with a point; exponents beyond three digits stay."""
    whole, part = F.regexp_extract(number, r"^-?([0-9]+)", 1), F.regexp_extract(number, r"\.([0-9]+)", 1)
    exponent = F.regexp_extract(number, r"[eE]([+-]?[0-9]{1,3})$", 1).try_cast("int")

    def plain(x: Column) -> Column:
        digits, point = x["digits"], x["point"]
        zeros = lambda n: F.repeat(F.lit("0"), n.cast("int"))
        body = (
            F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
            .when(point >= F.length(digits), F.concat(digits, zeros(point - F.length(digits)), F.lit(".0")))
            .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        )
        short = F.regexp_replace(F.regexp_replace(body, "^0+(?=[0-9])", ""), r"(\.[0-9]+?)0+$", "$1")
        return F.concat(F.when(F.startswith(number, F.lit("-")), "-").otherwise(""), short)

    parts = F.struct(F.concat(whole, part).alias("digits"), (F.length(whole) + exponent).alias("point"))
    return F.when(exponent.isNull(), number).otherwise(let(parts, plain))


def _inexact(number: Column) -> Column:
    """Whether a number token exceeds the 38 digits, or 38 places, of a decimal."""
    digits = F.regexp_replace(F.regexp_replace(number, "[-.]", ""), "^0+", "")
    places = F.length(F.regexp_extract(number, r"\.([0-9]+)", 1))
    return (F.length(digits) > 38) | (places > 38) | number.rlike("[eE]")


def _written_out(value: Column, body: Callable[[Column], Column]) -> Column:
    return body(value)


def _one_value(text: Column, hold: Callable) -> Column:
    """The VARIANT of text that is one JSON value and nothing else, or null.

    One parse. The parser stops after the first value, so the text goes into an array before its own MD5 digest: only
    text that is exactly one value leaves the digest in second place, and no text can hold its own digest.

    In a projection Spark computes the parse once; inside lambdas it does not, and ``hold`` is :func:`let`.
    """

    def alone(cell: Column) -> Column:
        marked = F.try_variant_get(cell, "$[1]", "string") == F.md5(text)
        # both sides of `get` are always evaluated, which is what lets Spark share the parse
        return F.get(F.array(F.try_variant_get(cell, "$[0]", "variant")), F.when(marked, F.lit(0)))

    return hold(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]'))), alone)


def _spelled_out(text: Column) -> Column:
    """The VARIANT of well-formed text with its numbers written without exponents; too long ones fail."""
    number = lambda t: t.rlike("^-?[0-9]")

    def read(tokens: Column) -> Column:
        value = let(F.array_join(tokens, ""), lambda plain: F.try_parse_json(plain))
        return refuse_when(F.exists(tokens, lambda t: number(t) & _inexact(t)), value, _TOO_LONG)

    return let(F.transform(_tokens(text), lambda t: F.when(number(t), _without_exponent(t)).otherwise(t)), read)


def _fault(text: Column) -> Column:
    """``{line, column}``, from 1, of the first token that no JSON text can have there; null where there is none, as for
    a field given twice. A fold over the tokens with the open brackets as a stack; only malformed text pays for it."""

    # what may come: v value, f value or ], o name or }, k name, c colon, a what follows a value
    def step(s: Column, token: Column) -> Column:
        first, stack = F.substring(token, 1, 1), s["stack"]
        top = F.substring(stack, -1, 1)
        below = F.substr(stack, F.lit(1), F.greatest(F.length(stack) - 1, F.lit(0)))
        want = s["want"]
        moved = lambda w, st=stack: F.struct(F.lit(w).alias("want"), st.alias("stack"))
        name = F.length(token) > 1  # a lone quotation mark opens a string that never ends
        text_token = (first == '"') & name
        scalar = text_token | first.rlike("[0-9]") | ((first == "-") & name) | token.isin("true", "false", "null")
        value = want.isin("v", "f")
        after = (
            F.when(value & scalar, moved("a"))
            .when(value & (token == "{"), moved("o", F.concat(stack, F.lit("{"))))
            .when(value & (token == "["), moved("f", F.concat(stack, F.lit("["))))
            .when(want.isin("f", "a") & (token == "]") & (top == "["), moved("a", below))
            .when(want.isin("o", "a") & (token == "}") & (top == "{"), moved("a", below))
            .when(want.isin("o", "k") & text_token, moved("c"))
            .when((want == "c") & (token == ":"), moved("v"))
            .when((want == "a") & (token == ",") & (top == "["), moved("v"))
            .when((want == "a") & (token == ",") & (top == "{"), moved("k"))
        )
        blank = first.isin(" ", "\t", "\r", "\n")
        at, length = s["at"], F.length(token)
        state = lambda place, w, st, bad: F.struct(place.alias("at"), w.alias("want"), st.alias("stack"), bad.alias("bad"))
        go_on = let(after, lambda m: F.when(m.isNull(), state(at, want, stack, F.lit(True))).otherwise(state(at + length, m["want"], m["stack"], F.lit(False))))
        return F.when(s["bad"], s).when(blank, state(at + length, want, stack, F.lit(False))).otherwise(go_on)

    start = F.struct(F.lit(0).alias("at"), F.lit("v").alias("want"), F.lit("").alias("stack"), F.lit(False).alias("bad"))
    none = F.lit(None).cast("int")

    def place(end: Column) -> Column:
        before = F.substr(text, F.lit(1), end["at"])
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        column = F.length(F.substring_index(before, "\n", -1)) + 1
        sound = ~end["bad"] & (end["want"] == "a") & (end["stack"] == "")
        pick = lambda x: F.when(sound, none).otherwise(x.cast("int"))
        return F.struct(pick(line).alias("line"), pick(column).alias("column"))

    return let(F.reduce(_tokens(text), start, step), place)


def parse_json(text: Column, hold: Callable = _written_out) -> Column:
    """VARIANT of JSON text; malformed input fails.

    Numbers are exact: BIGINT where they have neither point nor exponent and fit, decimals otherwise. A number that
    needs more than 38 digits or places fails.
    """

    def checked(value: Column) -> Column:
        malformed = F.raise_error(F.lit(JSON_MESSAGE))
        careful = F.when(text.rlike(_MAYBE_DOUBLE), _spelled_out(text)).otherwise(value)
        return F.when(value.isNull() & text.isNotNull(), malformed).otherwise(careful)

    return hold(_one_value(text, hold), checked)


def decode_json(text: Column, hold: Callable = _written_out) -> Column:
    """``{ok, value, error}`` for JSON text; JSON null decodes to a present value.

    An error has the line and column, in characters from 1, of the first token out of place (the end of the text where
    it ends too early); both are null where the tokens are sound, as for a field given twice, and for null text.
    """
    error = let(_fault(text), lambda f: json_error(JSON_CODE, JSON_MESSAGE, f["line"], f["column"]))

    def decoded(value: Column) -> Column:
        ok = value.isNotNull()
        kept = F.when(ok & text.rlike(_MAYBE_DOUBLE), _spelled_out(text)).otherwise(value)
        return F.struct(ok.alias("ok"), kept.alias("value"), F.when(~ok, error).alias("error"))

    return hold(_one_value(text, hold), decoded)


def json_error(code: str, message: str, line: Column | None = None, column: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(message).alias("message"),
        (none if line is None else line).alias("line"),
        (none if column is None else column).alias("column"),
    )


def json_field(value: Column, path: str, kind: str) -> Column:
    """A field of a VARIANT; a missing field or another kind fails."""
    return required(F.variant_get(value, path, kind), f"JSON value has no {path}")
