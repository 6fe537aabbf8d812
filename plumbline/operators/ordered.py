"""Ordered analytics per key that stay parallel when one key holds a large share of all rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here keys are counted first: a column-pruned scan
with map-side combining. Where no key has more than ``hot_rows`` rows, the plain window is used and nothing else is
planned. Otherwise the hot keys are cut into chunks of their integer order column: window functions run per
(key, chunk) and one small row per chunk carries the state over the chunk borders. Because the order column is a
unique integer within its key, a chunk of ``chunk_span`` order values never holds more than ``chunk_span`` rows,
whatever the data looks like.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.guards import require_columns, require_kind
from plumbline.session import reliable_checkpoint

HOT_ROWS = 1 << 22
CHUNK_SPAN = 1 << 22
CHUNK = "_chunk"
NULLS = "_null_keys"
MARKS = (CHUNK, NULLS)  # columns to drop once the ordered steps are done


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: at most ``rows / hot_rows`` of them, small enough to broadcast."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") > hot_rows).select(*keys)


def find_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys, or None where there are none. Counts keys now, so that the plan can depend on it."""
    hot = hot_keys(df, keys, hot_rows)
    return None if hot.isEmpty() else hot


def chunked(
    df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS, chunk_span: int = CHUNK_SPAN
) -> DataFrame:
    """Add ``_chunk`` where hot keys exist: null for ordinary keys, the order value's chunk number for hot ones."""
    return chunk_hot(df, keys, order, find_hot(df, keys, hot_rows) if keys else None, chunk_span)


def chunk_hot(
    df: DataFrame, keys: Sequence[str], order: str, hot: DataFrame | None, chunk_span: int = CHUNK_SPAN
) -> DataFrame:
    """:func:`chunked` for hot keys that are known already. Without keys the whole table is one hot key."""
    require_columns(df, [*keys, order])
    require_kind(df, order, "Int")
    span = F.lit(chunk_span).cast("bigint")
    number = F.call_function("div", F.col(order) - F.pmod(F.col(order).cast("bigint"), span), span)
    if not keys:
        return df.withColumn(CHUNK, number)
    if hot is None:
        return df
    marked = _mark_hot(df, hot, keys)
    chunks = marked.withColumn(CHUNK, F.when(F.col("_hot"), number)).drop("_hot")
    missing = hot.where(reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys]))
    return chunks if missing.isEmpty() else chunks.withColumn(NULLS, F.lit(True))


def co_located(df: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """Shuffle by key once, for steps that group by the key and more and then order within the key.

    Without hot keys one shuffle serves them all; with hot keys each step keeps its own finer partitioning.
    """
    return df.repartition(*keys) if keys and hot is None else df


def _mark_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _lookup(df, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys)


def _lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys where null equals null, as it does in a window partition."""
    return match_keys(df, table, keys, "left")


def match_keys(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys of ``df`` are kept."""
    renamed = table.withColumnsRenamed({key: f"_k_{key}" for key in keys})
    same = reduce(lambda a, b: a & b, [df[key].eqNullSafe(renamed[f"_k_{key}"]) for key in keys])
    return df.join(renamed, same, how).drop(*[f"_k_{key}" for key in keys])


def is_chunked(df: DataFrame) -> bool:
    return CHUNK in df.columns


def _within(df: DataFrame, keys: Sequence[str], *order: Column | str) -> WindowSpec:
    return Window.partitionBy(*keys, *([CHUNK] if is_chunked(df) else [])).orderBy(*order)


def _across(keys: Sequence[str]) -> WindowSpec:
    # one row per chunk of a hot key: order range / chunk_span rows
    return Window.partitionBy(*keys).orderBy(CHUNK)


def _per_chunk(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.where(F.col(CHUNK).isNotNull()).groupBy(*keys, CHUNK).agg(*aggregates)


def _attach(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    # plain equality keeps the partitioning of the windows; only a hot null key needs the null-safe join
    if NULLS in df.columns:
        return _lookup(df, carried, [*keys, CHUNK])
    return df.join(carried, [*keys, CHUNK], "left")


def with_previous(df: DataFrame, keys: Sequence[str], order: str, fields: Mapping[str, Column | str]) -> DataFrame:
    """Add, per output name, the value of the preceding row of the same key (null for the first row)."""
    record = F.struct(*[_column(value).alias(name) for name, value in fields.items()])
    local = df.withColumn("_before", F.lag(record).over(_within(df, keys, order)))
    before = F.col("_before")
    if is_chunked(df):
        tails = _per_chunk(df, keys, F.max_by(record, order).alias("_tail"))
        carried = tails.withColumn("_carried", F.lag("_tail").over(_across(keys))).drop("_tail")
        local = _attach(local, carried, keys)
        before = F.coalesce("_before", "_carried")
    return local.select(*df.columns, *[before[name].alias(name) for name in fields])


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column | str],
    maximum: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums (or maxima) per key, with or without the current row.

    Sums start at zero; a maximum before the first row is null.
    """
    aggregate = F.max if maximum else F.sum
    zero = F.lit(0).cast("bigint")
    start = (lambda value: value) if maximum else (lambda value: F.coalesce(value, zero))
    window = _within(df, keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = df.withColumns({f"_run_{name}": aggregate(_column(value)).over(window) for name, value in values.items()})
    result = {name: start(F.col(f"_run_{name}")) for name in values}
    if is_chunked(df):
        combine = F.greatest if maximum else (lambda a, b: a + b)
        before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
        totals = _per_chunk(df, keys, *[aggregate(_column(value)).alias(f"_all_{name}") for name, value in values.items()])
        carried = totals.select(*keys, CHUNK, *[aggregate(f"_all_{name}").over(before).alias(f"_carry_{name}") for name in values])
        local = _attach(local, carried, keys)
        result = {name: combine(value, start(F.col(f"_carry_{name}"))) for name, value in result.items()}
    return local.select(*df.columns, *[value.alias(name) for name, value in result.items()])


def with_totals(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Add aggregates over the whole key to each row, in the partitioning the ordered steps already use.

    Totals of hot keys - at most ``rows / hot_rows`` of them - are aggregated on the side and broadcast.
    """
    if not is_chunked(df):
        return df.withColumns({name: value.over(Window.partitionBy(*keys)) for name, value in totals.items()})
    ordinary = df.where(F.col(CHUNK).isNull())
    hot = df.where(F.col(CHUNK).isNotNull())
    small = hot.groupBy(*keys).agg(*[value.alias(name) for name, value in totals.items()])
    counted = ordinary.withColumns({name: value.over(Window.partitionBy(*keys)) for name, value in totals.items()})
    return counted.unionByName(_lookup(hot, F.broadcast(small), keys))


def with_neighbours(df: DataFrame, keys: Sequence[str], order: str, value: Column, before: str, after: str) -> DataFrame:
    """Add the nearest non-null ``value`` at or before each row and the nearest one at or after it."""
    # what follows is looked up against the order: a frame that ends after the row would be read again for every row
    so_far = (Window.unboundedPreceding, 0)
    local = df.withColumns(
        {
            "_near_b": F.last(value, ignorenulls=True).over(_within(df, keys, order).rowsBetween(*so_far)),
            "_near_a": F.last(value, ignorenulls=True).over(_within(df, keys, F.desc(order)).rowsBetween(*so_far)),
        }
    )
    result = {before: F.col("_near_b"), after: F.col("_near_a")}
    if is_chunked(df):
        known = F.when(value.isNotNull(), F.col(order))
        ends = _per_chunk(df, keys, F.max_by(value, known).alias("_end"), F.min_by(value, known).alias("_start"))
        until = (Window.unboundedPreceding, -1)
        earlier = _across(keys).rowsBetween(*until)
        later = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(*until)
        carried = ends.select(
            *keys,
            CHUNK,
            F.last("_end", ignorenulls=True).over(earlier).alias("_carry_b"),
            F.last("_start", ignorenulls=True).over(later).alias("_carry_a"),
        )
        local = _attach(local, carried, keys)
        result = {before: F.coalesce("_near_b", "_carry_b"), after: F.coalesce("_near_a", "_carry_a")}
    return local.select(*df.columns, *[column.alias(name) for name, column in result.items()])


def newest(
    df: DataFrame, keys: Sequence[str], order: str, n: int, rank: str = "_rank", ascending: bool = False
) -> DataFrame:
    """The ``n`` rows of each key with the highest order (lowest when ``ascending``), ranked 1.. from that end.

    The rank bound is applied before the shuffle (window group limit) and again per chunk, so at most ``n`` rows per
    chunk of a hot key meet in one task.
    """
    towards = F.asc(order) if ascending else F.desc(order)
    kept = df.withColumn(rank, F.row_number().over(_within(df, keys, towards))).where(F.col(rank) <= n)
    if not is_chunked(df):
        return kept
    ordinary = kept.where(F.col(CHUNK).isNull())
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(towards))
    hot = kept.where(F.col(CHUNK).isNotNull()).withColumn(rank, again).where(F.col(rank) <= n)
    return ordinary.unionByName(hot)


def islands(df: DataFrame, keys: Sequence[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of each key: a run begins at every row where ``starts`` holds."""
    flagged = df.withColumn("_starts", F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return with_running(flagged, keys, order, {name: "_starts"}).drop("_starts")


def position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Add the global 0-based position under a total ascending order, without a single-task sort.

    Rows are range-partitioned and sorted, the partition number is frozen by a reliable checkpoint (a second
    evaluation could sample other range bounds), and per-partition offsets - one row per partition - are broadcast.
    """
    keys = [_column(c) for c in order]
    temporary = [f"_key_{i}" for i in range(len(keys))]
    keyed = df.select("*", *[key.alias(t) for key, t in zip(keys, temporary)])
    runs = reliable_checkpoint(
        keyed.repartitionByRange(*temporary)
        .sortWithinPartitions(*temporary)
        .withColumn("_at", F.monotonically_increasing_id())  # partition number << 33 | row within the partition
    )
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = runs.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    return (
        runs.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (local + F.col("_offset")).cast("bigint").alias(name))
    )


def row_number_by(
    df: DataFrame,
    keys: Sequence[str],
    *order: Column | str,
    name: str = "number",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based row number per key under any total order; hot keys are numbered through :func:`position`."""
    local = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint")
    hot = find_hot(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(name, local)
    marked = _mark_hot(df, hot, keys)
    ordinary = marked.where(F.col("_hot").isNull()).drop("_hot").withColumn(name, local)
    placed = position(marked.where(F.col("_hot")).drop("_hot"), *keys, *order, name="_place")
    firsts = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    numbered = _lookup(placed, F.broadcast(firsts), keys).withColumn(name, F.col("_place") - F.col("_first"))
    return ordinary.unionByName(numbered.drop("_place", "_first"))


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
