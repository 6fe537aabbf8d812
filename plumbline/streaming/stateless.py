"""Per-event stream operators: narrow steps that need no state and work on batch tables as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.guards import require_between, require_columns, require_kind, required, strict_bool


def stream_filter(df: DataFrame, path: str, literal: object) -> DataFrame:
    """Events whose field equals the literal. A field absent from the schema or from an event fails."""
    require_columns(df, [path.split(".")[0]])
    # the first filter can be pushed into the scan, the second refuses the events without the field
    kept = df.where((F.col(path) == F.lit(literal)) | F.col(path).isNull())
    return kept.where(required(F.col(path), f"event has no {path}") == F.lit(literal))


def stream_map(df: DataFrame, *paths: str) -> DataFrame:
    """The named fields of each event."""
    require_columns(df, [path.split(".")[0] for path in paths])
    return df.select(*paths)


def stream_condition(df: DataFrame, predicate: Column) -> DataFrame:
    """Events for which the predicate is true; no answer is a failure."""
    require_kind(df, predicate, "Bool")
    return df.where(strict_bool(predicate))


def stream_limit(df: DataFrame, n: int, seq: str) -> DataFrame:
    """Events up to delivery sequence ``n``: a filter, so no state is kept and restarts change nothing."""
    require_between("n", n, 0, 1 << 62)
    return df.where(F.col(seq) <= n)


def stream_skip(df: DataFrame, n: int, seq: str) -> DataFrame:
    """Events after delivery sequence ``n``."""
    require_between("n", n, 0, 1 << 62)
    return df.where(F.col(seq) > n)
