"""JSON text read against a contract: violations found in the parsed value itself, whatever its type turns out to be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import values
from plumbline.functions.text import let
from plumbline.guards import KindError, refuse_when
from plumbline.operators.contracts import _ISSUES, Contract, _child, _issue, _limit_checks, _none

CONTRACT_CODE, AMBIGUOUS_CODE = "JSON002", "JSON003"
CONTRACT_MESSAGE = "JSON does not satisfy the contract"
AMBIGUOUS_MESSAGE = "JSON number fits both Int and Decimal"

_TYPES = {"Int": "bigint", "Decimal": "decimal(38,18)", "Text": "string", "Bool": "boolean"}
_TAGS = {"Int": ["BIGINT"], "Decimal": ["BIGINT", "DECIMAL"], "Text": ["STRING"], "Bool": ["BOOLEAN"]}


def _tag(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))


def _field_path(name: str) -> str:
    if "'" in name and '"' in name:
        raise KindError("a JSON field name must not hold both kinds of quotation marks")
    return f"$['{name}']" if '"' in name else f'$["{name}"]'


def json_issues(contract: Contract, value: Column, path: Column | None = None) -> Column:
    """All violations of a VARIANT from :func:`values.parse_json`, as an array of (path, code, message).

    Whole numbers fit Decimal too, and numbers with a point or an exponent never fit Int. Where a union offers both Int
    and Decimal, a whole number is ambiguous and reported as such. Bounds of Decimals are compared at 18 places; numbers of
    more than 20 digits before the point violate them. Kinds that JSON does not have are refused while planning.
    """
    return let(value, lambda v: _inspect(contract, v, F.lit("") if path is None else path))


def _inspect(contract: Contract, value: Column, path: Column) -> Column:
    expected = lambda text: F.array(_issue(path, f"expected {text}")).cast(_ISSUES)
    if contract.kind == "Unknown":
        return _none()
    if contract.kind == "Option":
        return F.when(_tag(value) == "VOID", _none()).otherwise(_inspect(contract.item, value, path))
    if contract.kind == "Union":
        return _union(contract, value, path, expected)
    if contract.kind == "Record":
        parts = [_member(name, child, value, _child(path, name)) for name, child in contract.fields.items()]
        whole = F.concat(*parts) if parts else _none()
        return F.when(_tag(value) == "OBJECT", whole).otherwise(expected(contract.name))
    if contract.kind == "List":
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.flatten(F.transform(items, lambda x, i: _inspect(contract.item, x, _child(path, i.cast("string")))))
        limits = _limits(contract, items, path)
        return F.when(_tag(value) == "ARRAY", F.concat(each, limits)).otherwise(expected(contract.name))
    if contract.kind == "Map":
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        each = F.transform(
            entries,
            lambda e: F.concat(
                _limits(contract.key, e["key"], _child(path, e["key"])), _inspect(contract.item, e["value"], _child(path, e["key"]))
            ),
        )
        return F.when(_tag(value) == "OBJECT", F.flatten(each)).otherwise(expected(contract.name))
    if contract.kind not in _TYPES:
        raise KindError(f"JSON has no {contract.kind}")
    typed = F.try_variant_get(value, "$", _TYPES[contract.kind])
    found = _limits(contract, typed, path)
    if contract.kind == "Decimal" and (contract.low is not None or contract.high is not None or contract.enum):
        found = F.when(typed.isNull(), F.array(_issue(path, "number is outside the permitted bounds")).cast(_ISSUES)).otherwise(found)
    return F.when(_tag(value).isin(_TAGS[contract.kind]), found).otherwise(expected(contract.name))


def _limits(contract: Contract, typed: Column, path: Column) -> Column:
    checks = _limit_checks(contract, typed, contract.kind, path)
    return F.array_compact(F.array(*checks)).cast(_ISSUES) if checks else _none()


def _member(name: str, child: Contract, value: Column, path: Column) -> Column:
    missing = _none() if child.optional else F.array(_issue(path, "required field is missing")).cast(_ISSUES)
    inner = F.try_variant_get(value, _field_path(name), "variant")
    return let(inner, lambda x: F.when(x.isNull(), missing).otherwise(_inspect(child, x, path)))


def _union(contract: Contract, value: Column, path: Column, expected) -> Column:
    kinds = {a.kind for a in contract.alternatives}
    fits = F.lit(False)
    for alternative in contract.alternatives:
        fits = fits | (F.size(_inspect(alternative, value, path)) == 0)
    issue = F.struct(path.alias("path"), F.lit(AMBIGUOUS_CODE).alias("code"), F.lit(AMBIGUOUS_MESSAGE).alias("message"))
    result = F.when(fits, _none()).otherwise(expected(f"an alternative of {contract.name}"))
    if not {"Int", "Decimal"} <= kinds:
        return result
    numeric = [F.size(_inspect(a, value, path)) == 0 for a in contract.alternatives if a.kind in ("Int", "Decimal")]
    both = sum((fit.cast("int") for fit in numeric), F.lit(0)) > 1
    return F.when(both, F.array(issue).cast(_ISSUES)).otherwise(result)


def parse_json(text: Column, contract: Contract) -> Column:
    """VARIANT of JSON text that satisfies ``contract``; the first violation fails the query. Null text stays null."""

    def checked(value: Column) -> Column:
        def judged(found: Column) -> Column:
            first = F.get(found, F.lit(0))
            message = F.concat(F.lit(f"{CONTRACT_MESSAGE}: "), first["path"], F.lit(" "), first["message"])
            return refuse_when(value.isNotNull() & (F.size(found) > 0), value, message)

        return let(json_issues(contract, value), judged)

    return let(values.parse_json(text, let), checked)


def decode_json(text: Column, contract: Contract) -> Column:
    """``{ok, value, error}``: JSON001 with its place for malformed text, JSON002 for a value that violates ``contract``,
    JSON003 for an ambiguous one. Messages never repeat the input."""

    def judged(read: Column) -> Column:
        codes = F.transform(json_issues(contract, read["value"]), lambda i: i["code"])
        wrong = lambda code, message: values.json_error(code, message)

        def decide(c: Column) -> Column:
            error = (
                F.when(~read["ok"], read["error"])
                .when(F.array_contains(c, AMBIGUOUS_CODE), wrong(AMBIGUOUS_CODE, AMBIGUOUS_MESSAGE))
                .when(F.size(c) > 0, wrong(CONTRACT_CODE, CONTRACT_MESSAGE))
            )
            ok = read["ok"] & (F.size(c) == 0)
            return F.struct(ok.alias("ok"), F.when(ok, read["value"]).alias("value"), error.alias("error"))

        return let(F.when(read["ok"], codes).otherwise(F.array().cast("array<string>")), decide)

    return let(values.decode_json(text, let), judged)
