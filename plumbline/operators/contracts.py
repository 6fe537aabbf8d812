"""Value contracts: violation reports, strict checks, accepted/rejected splits, and contract compatibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import found_in, pattern
from plumbline.guards import KindError, kind_of, refuse_when

CODE = "TYP005"
_ISSUES = "array<struct<path:string,code:string,message:string>>"


@dataclass(frozen=True)
class Contract:
    """Kind and constraints of a value. ``fields`` for Record, ``item`` for List and Option, ``item`` and ``key``
    for Map, ``alternatives`` for Union. An ``optional`` record field may be missing."""

    name: str
    kind: str
    fields: Mapping[str, Contract] = field(default_factory=dict)
    item: Contract | None = None
    key: Contract | None = None
    alternatives: Sequence[Contract] = ()
    optional: bool = False
    enum: Sequence[Any] = ()
    low: Decimal | int | None = None
    high: Decimal | int | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_items: int | None = None
    max_items: int | None = None
    patterns: Sequence[str] = ()

    def or_missing(self) -> Contract:
        return replace(self, optional=True)


def scalar(kind: str, name: str | None = None, **limits: Any) -> Contract:
    return Contract(name or kind, kind, **limits)


def record(name: str, /, **fields: Contract) -> Contract:
    return Contract(name, "Record", fields=fields)


def list_of(item: Contract, name: str | None = None, **limits: Any) -> Contract:
    return Contract(name or f"List<{item.name}>", "List", item=item, **limits)


def map_of(value: Contract, key: Contract | None = None) -> Contract:
    return Contract(f"Map<Text,{value.name}>", "Map", item=value, key=key or scalar("Text"))


def option_of(item: Contract) -> Contract:
    return Contract(f"Option<{item.name}>", "Option", item=item)


def union_of(*alternatives: Contract, name: str | None = None) -> Contract:
    return Contract(name or "|".join(a.name for a in alternatives), "Union", alternatives=alternatives)


UNKNOWN = Contract("Unknown", "Unknown")


def _issue(path: Column, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(path.alias("path"), F.lit(CODE).alias("code"), text.alias("message"))


def _none() -> Column:
    return F.array().cast(_ISSUES)


def _join(*parts: Column) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _child(path: Column, key: Column | str) -> Column:
    if isinstance(key, str):
        return F.concat(path, F.lit("/" + key.replace("~", "~0").replace("/", "~1")))
    escaped = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(path, F.lit("/"), escaped)


def _bounds(noun: str, low: Any, high: Any) -> str:
    if low is not None and high is not None:
        return f"{noun} must be from {low} to {high}"
    return f"{noun} must be at least {low}" if high is None else f"{noun} must be at most {high}"


def _outside(value: Column, low: Any, high: Any) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (value < F.lit(low))
    if high is not None:
        bad = bad | (value > F.lit(high))
    return bad


def _limit_checks(contract: Contract, value: Column, kind: str, path: Column) -> list[Column]:
    checks: list[tuple[Column, str]] = []
    if contract.enum:
        allowed = ", ".join(str(v) for v in contract.enum)
        checks.append((~value.isin(list(contract.enum)), f"value is not allowed; expected one of {allowed}"))
    if kind in ("Int", "Decimal") and (contract.low is not None or contract.high is not None):
        hint = _bounds("number", contract.low, contract.high)
        checks.append((_outside(value, contract.low, contract.high), f"number is outside the permitted bounds; {hint}"))
    if kind == "Text" and (contract.min_length is not None or contract.max_length is not None):
        hint = _bounds("text length (characters)", contract.min_length, contract.max_length)
        bad = _outside(F.length(value), contract.min_length, contract.max_length)
        checks.append((bad, f"text length is outside the permitted bounds; {hint}"))
    if kind == "Text":
        checks += [(~value.rlike(pattern(p)), f"text does not match {p}") for p in contract.patterns]
    if kind == "List" and (contract.min_items is not None or contract.max_items is not None):
        hint = _bounds("item count", contract.min_items, contract.max_items)
        bad = _outside(F.size(value), contract.min_items, contract.max_items)
        checks.append((bad, f"item count is outside the permitted bounds; {hint}"))
    return [F.when(bad, _issue(path, message)) for bad, message in checks]


def issues(contract: Contract, value: Column, data_type: T.DataType, path: Column | None = None) -> Column:
    """All violations of ``value`` as an array of (path, code, message).

    The kind is compared with the column's type while planning, so only real value checks reach the rows.
    """
    return _inspect(contract, value, data_type, F.lit("") if path is None else path)


def _inspect(contract: Contract, value: Column, data_type: T.DataType, path: Column) -> Column:
    mismatch = F.array(_issue(path, f"expected {contract.name}"))
    if contract.kind == "Unknown":
        return _none()
    if contract.kind == "Option":
        return F.when(value.isNull(), _none()).otherwise(_inspect(contract.item, value, data_type, path))
    if contract.kind == "Union":
        tried = [_inspect(a, value, data_type, path) for a in contract.alternatives]
        fits = F.lit(False)
        for one in tried:
            fits = fits | (F.size(one) == 0)
        return F.when(fits, _none()).otherwise(F.array(_issue(path, f"expected an alternative of {contract.name}")))
    kind = kind_of(data_type)
    if kind != contract.kind:
        return mismatch
    parts: list[Column] = []
    if kind == "Record":
        present = {f.name: f.dataType for f in data_type.fields}
        for name, child in contract.fields.items():
            where = _child(path, name)
            missing = _none() if child.optional else F.array(_issue(where, "required field is missing"))
            if name not in present:
                parts.append(missing)
                continue
            inner = value[name]
            checked = _inspect(child, inner, present[name], where)
            nullable = child.kind in ("Option", "Union", "Unknown")
            parts.append(checked if nullable else F.when(inner.isNull(), missing).otherwise(checked))
    elif kind == "List" and not _unconstrained(contract.item, data_type.elementType):
        each = F.transform(
            value,
            lambda v, i: _inspect(contract.item, v, data_type.elementType, _child(path, i.cast("string"))),
        )
        parts.append(F.flatten(each))
    elif kind == "Map":
        each = F.transform(
            F.map_entries(value),
            lambda e: F.concat(
                _inspect(contract.key, e["key"], data_type.keyType, _child(path, e["key"])),
                _inspect(contract.item, e["value"], data_type.valueType, _child(path, e["key"])),
            ),
        )
        parts.append(F.flatten(each))
    limits = _limit_checks(contract, value, kind, path)
    if limits:
        parts.append(F.array_compact(F.array(*limits)).cast(_ISSUES))
    if not parts:
        return F.when(value.isNull(), mismatch).otherwise(_none())
    return F.when(value.isNull(), mismatch).otherwise(_join(*[p.cast(_ISSUES) for p in parts]))


def _unconstrained(contract: Contract, data_type: T.DataType) -> bool:
    return contract.kind == "Unknown"


def row_issues(df: DataFrame, contract: Contract) -> Column:
    """Violations of a whole row against a Record contract."""
    if contract.kind != "Record":
        raise KindError("rows are checked against a Record contract")
    known = [c for c in contract.fields if c in df.columns]
    row = F.struct(*known) if known else F.struct(F.lit(None).alias("_"))
    return issues(contract, row, T.StructType([df.schema[c] for c in known]))


def contract_check(df: DataFrame, contract: Contract, key: str, limit: int | None = None) -> DataFrame:
    """Violation report: key, path, code and message per violation. One narrow pass over the checked columns.

    With ``limit`` a row reports its first ``limit`` violations, and ``total`` and ``complete`` say what was left out.
    """
    found = df.select(key, row_issues(df, contract).alias("found"))
    if limit is None:
        return found.select(key, F.explode("found").alias("i")).select(key, "i.path", "i.code", "i.message")
    total = F.size("found")
    cut = found.select(key, total.alias("total"), (total <= limit).alias("complete"), F.explode(F.slice("found", 1, limit)).alias("i"))
    return cut.select(key, "i.path", "i.code", "i.message", "total", "complete")


def checked(df: DataFrame, contract: Contract) -> DataFrame:
    """The rows unchanged; the first violating row fails the query."""
    found = row_issues(df, contract)
    message = F.concat_ws(": ", F.get(found, F.lit(0))["path"], F.get(found, F.lit(0))["message"])
    # a filter, which stays whatever columns are read later
    return df.where(refuse_when(F.size(found) > 0, F.lit(True), message))


def valid_split(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their ``issues``: two filters over one tagged scan."""
    tagged = df.withColumn("issues", row_issues(df, contract))
    return tagged.where(F.size("issues") == 0).drop("issues"), tagged.where(F.size("issues") > 0)


def union_resolve(df: DataFrame, value: str, alternatives: Sequence[Contract]) -> Column:
    """Name of the first alternative the value fits, null where none does."""
    data_type = df.schema[value].dataType
    fits = [F.when(F.size(issues(a, F.col(value), data_type)) == 0, F.lit(a.name)) for a in alternatives]
    return F.coalesce(*fits)


def subtype(actual: Contract, required: Contract) -> bool:
    """Whether the values of ``actual`` are a subset of those of ``required``. Plans only, reads no data.

    Both are taken as sets of values: a union is the list of its members, a scalar a set of choices or a box of ranges.
    Each member of ``actual`` must lie in one member of ``required``.
    """
    return all(any(_covers(big, small) for big in _members(required)) for small in _members(actual))


def _members(contract: Contract) -> list[Contract]:
    return [m for a in contract.alternatives for m in _members(a)] if contract.kind == "Union" else [contract]


# the ranges that limit a value, and what of the value each of them measures
_RANGES = {
    "size of a number": ("low", "high", lambda v: v if isinstance(v, (int, Decimal)) and not isinstance(v, bool) else None),
    "length of a text": ("min_length", "max_length", lambda v: len(v) if isinstance(v, str) else None),
    "number of items": ("min_items", "max_items", lambda v: len(v) if isinstance(v, (list, tuple)) else None),
}


def _range(contract: Contract, name: str) -> tuple[Decimal, Decimal]:
    low, high = (getattr(contract, end) for end in _RANGES[name][:2])
    return Decimal("-Infinity") if low is None else Decimal(low), Decimal("Infinity") if high is None else Decimal(high)


def _admits(contract: Contract, value: Any) -> bool:
    """Whether a scalar value of the contract's kind keeps its limits."""
    for name, (_, _, measure) in _RANGES.items():
        low, high = _range(contract, name)
        if (measured := measure(value)) is not None and not low <= measured <= high:
            return False
    listed = not contract.enum or value in contract.enum
    return listed and not (isinstance(value, str) and not all(found_in(p, value) for p in contract.patterns))


def _covers(big: Contract, small: Contract) -> bool:
    """Inclusion of two contracts that are no unions."""
    if big.kind == "Unknown":
        return True
    if big.kind != small.kind:
        return False
    if small.enum:  # finitely many values: look at each that ``small`` really allows
        return all(_admits(big, v) for v in small.enum if _admits(small, v))
    boxes = ((_range(big, name), _range(small, name)) for name in _RANGES)
    if big.enum or not all(b[0] <= s[0] and s[1] <= b[1] for b, s in boxes) or not {*big.patterns} <= {*small.patterns}:
        return False
    return _PARTS.get(small.kind, lambda big, small: True)(big, small)


def _covers_fields(big: Contract, small: Contract) -> bool:
    def present(name: str) -> bool:
        return name in small.fields and (big.fields[name].optional or not small.fields[name].optional)

    return all(present(name) and subtype(small.fields[name], wanted) for name, wanted in big.fields.items())


# how the parts of a value take part: keys must be the same set, so that looking one up means the same
_PARTS = {
    "Record": _covers_fields,
    "List": lambda big, small: subtype(small.item, big.item),
    "Option": lambda big, small: subtype(small.item, big.item),
    "Map": lambda big, small: subtype(small.item, big.item) and subtype(small.key, big.key) and subtype(big.key, small.key),
}


def contract_of(df: DataFrame, name: str = "Row") -> Contract:
    """The structural contract of a table's schema: kinds without limits."""

    def of(data_type: T.DataType) -> Contract:
        kind = kind_of(data_type)
        if kind == "List":
            return list_of(of(data_type.elementType))
        if kind == "Map":
            return map_of(of(data_type.valueType), of(data_type.keyType))
        if kind == "Record":
            return record("Record", **{f.name: of(f.dataType) for f in data_type.fields})
        return scalar(kind)

    return record(name, **{f.name: of(f.dataType) for f in df.schema})
