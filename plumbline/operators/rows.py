"""Projection, filtering, branching, sorting, paging and set-like operators over one or two tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.exact import to_decimal
from plumbline.guards import (
    LimitError,
    KindError,
    require_between,
    require_columns,
    require_kind,
    require_same_kind,
    required,
    strict_bool,
)
from plumbline.operators.ordered import position


def map_rows(df: DataFrame, **outputs: Column) -> DataFrame:
    return df.select(*[column.alias(name) for name, column in outputs.items()])


def filter_rows(df: DataFrame, predicate: Column, reads: Sequence[str] = ()) -> DataFrame:
    """Rows whose predicate is true; a predicate without an answer fails.

    ``reads`` names the columns of a predicate that is undefined only where one of them is null. The scan then gets a
    filter it can push down - the predicate, or a null in one of the columns - and the check runs on what is left.
    """
    require_kind(df, predicate, "Bool")
    if reads:
        df = df.where(reduce(lambda kept, name: kept | F.col(name).isNull(), reads, predicate))
    return df.where(strict_bool(predicate))


def field(df: DataFrame, path: str) -> DataFrame:
    """One field of each record; an absent field is refused while planning."""
    require_columns(df, [path.split(".")[0]])
    return df.select(F.col(path).alias(path.split(".")[-1]))


def with_fields(df: DataFrame, **fields: Column) -> DataFrame:
    """Replace or add fields; the others stay as they are."""
    return df.withColumns(fields)


def compare(df: DataFrame, left: Column, right: Column) -> dict[str, Column]:
    """The six comparisons of two columns of one kind. Unlike kinds are unequal, never converted, and have no order."""
    try:
        require_same_kind(df, left, right)
    except KindError:
        return {"eq": F.lit(False), "ne": F.lit(True)}
    return {
        "eq": left == right,
        "ne": left != right,
        "lt": left < right,
        "le": left <= right,
        "gt": left > right,
        "ge": left >= right,
    }


def interval_filter(df: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    """Rows with start <= at < end. With literal bounds the predicate reaches the Parquet scan."""
    return df.where((F.col(at) >= start) & (F.col(at) < end))


def around_filter(df: DataFrame, at: str, center: str, radius_us: int) -> DataFrame:
    """Rows inside center - radius <= at < center + radius, bounds computed once while planning."""
    require_between("radius", radius_us, 1, 1 << 62)
    middle = F.unix_micros(F.lit(center).cast("timestamp"))
    return interval_filter(df, at, F.timestamp_micros(middle - radius_us), F.timestamp_micros(middle + radius_us))


# How a branch can end for a row.
OUTCOMES = ("success", "failed", "cancelled")


def fork(
    df: DataFrame,
    branches: Mapping[str, Column],
    outputs: Mapping[str, Column],
    errors: Mapping[str, Column] | None = None,
    cancelled: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Send each row to every branch whose condition holds, from one scan of the input.

    Branches are isolated: what goes wrong in one is an ``outcome`` of its row, not a failure of the query. ``errors`` gives
    a branch a channel of its own, a text where it failed and null where it did not; then no value is a value like any other
    and ``error`` holds the text. A branch without one is computed with ``try_`` functions, whose null means failure.
    ``cancelled`` tells for a branch which rows it gives up. Only a success has a ``result``. Conditions of a following fork
    can choose by outcome, see :func:`on`.
    """
    unknown = (set(errors or ()) | set(cancelled or ()) | set(outputs)) - set(branches)
    if unknown or set(outputs) != set(branches):
        raise LimitError(f"every branch needs an output, and only branches have one: {', '.join(sorted(unknown or set(branches) - set(outputs)))}")
    taken = F.array_compact(F.array(*[F.when(strict_bool(p), F.lit(name)) for name, p in branches.items()]))
    tagged = df.withColumn("branch", F.explode(taken))
    none = F.lit(None).cast("string")

    def of_branch(choose) -> Column:
        case = F
        for name in branches:
            case = case.when(F.col("branch") == name, choose(name))
        return case

    value = of_branch(lambda name: outputs[name])
    error = of_branch(lambda name: errors[name].cast("string") if errors and name in errors else F.when(outputs[name].isNull(), "no value").otherwise(none))
    stopped = of_branch(lambda name: strict_bool(cancelled[name]) if cancelled and name in cancelled else F.lit(False))
    outcome = F.when(stopped, "cancelled").when(error.isNotNull(), "failed").otherwise("success")
    judged = tagged.withColumns({"result": F.when(outcome == "success", value), "outcome": outcome})
    return judged.withColumn("error", F.when(outcome == "failed", error)) if errors else judged


def on(outcome: str, when: Column | None = None, column: str = "outcome") -> Column:
    """Condition of a branch that follows another fork: rows with this outcome, of successes also only ``when`` it holds."""
    if outcome not in OUTCOMES:
        raise LimitError(f"outcome must be one of {', '.join(OUTCOMES)}")
    if when is not None and outcome != "success":
        raise LimitError("only a success has a value to put a condition on")
    chosen = F.col(column) == outcome
    return chosen if when is None else F.when(chosen, strict_bool(when)).otherwise(False)


def sort_by(df: DataFrame, key: str, tie: str, numbered: bool = False) -> DataFrame:
    """Ascending by key; ``tie`` states the original order and makes the sort stable. Missing keys fail.

    ``numbered`` adds the global ``position`` instead of relying on the order of the output files.
    """
    require_kind(df, key, "Int", "Decimal", "Text", "Instant", "Duration")
    present = df.withColumn(key, required(F.col(key), "sort key is missing"))
    return position(present, key, tie) if numbered else present.orderBy(key, tie)


# positions up to this one are found by a bounded top-n instead of ordering the whole table
TOP_ROWS = 10_000


def first_positions(df: DataFrame, end: int, *order: Column | str) -> DataFrame:
    """At least the rows before position ``end`` under a total order, with their ``position``."""
    if end > TOP_ROWS:
        return position(df, *order)
    top = df.orderBy(*order).limit(end)
    return top.withColumn("position", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))


def take(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows under an order: a bounded top-n per task, then one merge."""
    require_between("n", n, 0, 1 << 31)
    return df.orderBy(*order).limit(n)


def skip(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """All rows but the first ``n`` under a total order."""
    require_between("n", n, 0, 1 << 62)
    return position(df, *order).where(F.col("position") >= n)


def _count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def slice_rows(df: DataFrame, start: int, end: int, *order: Column | str) -> DataFrame:
    """Rows [start, end) under a total order; an end past the table fails."""
    require_between("start", start, 0, end)
    # counted first: a check in the rows would vanish with them
    if end > _count(df):
        raise LimitError("slice bounds lie outside the list")
    return first_positions(df, end, *order).where((F.col("position") >= start) & (F.col("position") < end))


def concat(first: DataFrame, second: DataFrame, source: str = "part") -> DataFrame:
    """Append two tables of the same schema; ``source`` (0, 1) keeps their order. Nothing is widened."""
    mine, other = ({f.name: f.dataType for f in df.schema} for df in (first, second))
    if mine != other:
        raise KindError("concat needs two tables with the same fields and kinds")
    return first.withColumn(source, F.lit(0)).unionByName(second.withColumn(source, F.lit(1)))


def distinct_guard(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; an empty result means the keys are distinct."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def bounded_listing(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows with an envelope: returned, omitted, complete."""
    require_between("limit", limit, 1, 10_000)
    total = df.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    returned = F.least(total, F.lit(limit).cast("bigint"))
    return take(df, limit, *order).withColumns(
        {"returned": returned, "omitted": total - returned, "complete": total <= limit}
    )


def value_page(df: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    """Rows [offset, offset + limit) under a total order with count, total and the next offset (null at the end)."""
    require_between("offset", offset, 0, 1 << 62)
    require_between("limit", limit, 1, 1000)
    total = _count(df)
    if offset > total:
        raise LimitError("offset lies past the end of the list")
    placed = first_positions(df, offset + limit, *order)
    end = min(offset + limit, total)
    inside = (F.col("position") >= offset) & (F.col("position") < offset + limit)
    return placed.where(inside).withColumns(
        {
            "count": F.lit(end - offset).cast("bigint"),
            "total": F.lit(total).cast("bigint"),
            "next_offset": F.lit(end if end < total else None).cast("bigint"),
        }
    )


def shape_only(df: DataFrame) -> list[tuple[str, str]]:
    """Field names and kinds without reading data."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def as_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named fields as text cells; nulls are refused."""
    require_columns(df, columns)
    return df.select(*[required(F.col(c).cast("string"), f"{c} has no text").alias(c) for c in columns])


def csv_rows(df: DataFrame, columns: Sequence[str], line: str = "line") -> DataFrame:
    """One CSV record per row: every cell quoted, quotes doubled, records end with CRLF."""
    cells = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return df.withColumn(line, F.concat(F.concat_ws(",", *cells), F.lit("\r\n")))


def line_series(df: DataFrame, x: Column, y: Column, order: str) -> DataFrame:
    """Chart points with an exact decimal y; more than six fractional digits fail. Rows without a number are left out and
    counted in ``dropped``."""
    number = F.when(y.try_cast("decimal(38,6)").isNotNull(), to_decimal(y, 6))
    points = df.select(F.col(order), x.alias("x"), number.alias("y"))
    dropped = points.groupBy().agg(F.count_if(F.col("y").isNull()).alias("n")).scalar()
    return points.where(F.col("y").isNotNull()).withColumn("dropped", dropped)
