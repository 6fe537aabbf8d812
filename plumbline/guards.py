"""Strictness helpers: refuse wrong kinds while planning and bad values while running.

A run-time refusal always sits inside the value expression it protects. A separate assertion column could be
pruned or reordered by the optimiser; a ``when(bad, raise_error(..)).otherwise(value)`` cannot.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KindError(TypeError):
    """A column has another kind than the operator accepts."""


class LimitError(ValueError):
    """An argument lies outside the permitted bounds."""


_KINDS: dict[str, tuple[type, ...]] = {
    "Int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "Decimal": (T.DecimalType,),
    "Float": (T.FloatType, T.DoubleType),
    "Text": (T.StringType,),
    "Bool": (T.BooleanType,),
    "Instant": (T.TimestampType, T.TimestampNTZType),
    "Duration": (T.DayTimeIntervalType,),
    "Bytes": (T.BinaryType,),
    "List": (T.ArrayType,),
    "Record": (T.StructType,),
    "Map": (T.MapType,),
    "Unknown": (T.VariantType,),
}


def kind_of(data_type: T.DataType) -> str:
    for kind, classes in _KINDS.items():
        if isinstance(data_type, classes):
            return kind
    return data_type.simpleString()


def column_kind(df: DataFrame, column: Column | str) -> str:
    """Kind of an expression over ``df``; resolved by the analyser, nothing runs."""
    return kind_of(df.select(column).schema[0].dataType)


def require_kind(df: DataFrame, column: Column | str, *kinds: str) -> str:
    found = column_kind(df, column)
    if found not in kinds:
        raise KindError(f"expected {' or '.join(kinds)}, found {found}")
    return found


def require_same_kind(df: DataFrame, *columns: Column | str) -> str:
    """Int and Decimal do not mix, and nothing else is converted silently either."""
    found = {column_kind(df, column) for column in columns}
    if len(found) != 1:
        raise KindError(f"operands have different kinds: {', '.join(sorted(found))}")
    return found.pop()


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise KindError(f"missing fields: {', '.join(missing)}")


def require_between(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise LimitError(f"{name} must be an integer from {low} to {high}")
    return value


def refuse_when(bad: Column, value: Column, message: str | Column) -> Column:
    """``value``, or a failed query when ``bad`` holds."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(bad, F.raise_error(text)).otherwise(value)


def required(column: Column, message: str) -> Column:
    """``column`` without nulls; a missing value fails instead of dropping its row."""
    return F.coalesce(column, F.raise_error(F.lit(message)))


def strict_bool(predicate: Column) -> Column:
    """A predicate must answer true or false for every row; null is a failure, not false."""
    return required(predicate, "predicate did not produce a Bool")
