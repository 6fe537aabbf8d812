"""Batch twins of the stateful stream operators, parallel also within a hot source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.guards import LimitError, require_between
from plumbline.operators.ordered import (
    match_keys,
    MARKS,
    HOT_ROWS,
    chunked,
    newest,
    with_previous,
    with_running,
    with_totals,
)
from plumbline.streaming.stateful import MAX_ACCUMULATED, MAX_WINDOW_BYTES, MAX_WINDOW_ITEMS


def rolling_window(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    size: str,
    items: int,
    size_limit: int = MAX_WINDOW_BYTES,
    hot_rows: int = HOT_ROWS,
    item: str | None = None,
) -> DataFrame:
    """Per source the newest items within an item and a byte bound, with what was omitted or rejected.

    Items above the byte bound are rejected. Of the rest the longest newest run fits: at most ``items`` rows per
    source reach the byte sum. With ``item`` the window itself is added, oldest first: ``window`` holds at most ``items``
    values of that column, whose sizes add up to ``size_limit`` at most.
    """
    require_between("items", items, 1, MAX_WINDOW_ITEMS)
    require_between("size_limit", size_limit, 1, MAX_WINDOW_BYTES)
    totals = df.groupBy(*keys).agg(
        F.count_if(F.col(size) <= size_limit).alias("_accepted"), F.count_if(F.col(size) > size_limit).alias("rejected")
    )
    used = dict.fromkeys([*keys, seq, size, *([item] if item else [])])
    fitting = df.where(F.col(size) <= size_limit).select(*used)
    recent = newest(chunked(fitting, keys, seq, hot_rows), keys, seq, items)
    backwards = Window.partitionBy(*keys).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    in_order = lambda rows: F.transform(F.array_sort(rows, lambda a, b: F.signum(a["seq"] - b["seq"]).cast("int")), lambda r: r["item"])
    held = [in_order(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(item).alias("item")))).alias("window")] if item else []
    window = (
        recent.withColumn("_bytes", F.sum(size).over(backwards))
        .where(F.col("_bytes") <= size_limit)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("kept"),
            F.min(seq).alias("first_seq"),
            F.max(seq).alias("last_seq"),
            F.sum(size).cast("bigint").alias("kept_bytes"),
            *held,
        )
    )
    kept = F.coalesce("kept", F.lit(0))
    return match_keys(totals, window, keys, "left").select(
        *keys,
        kept.alias("kept"),
        (F.col("_accepted") - kept).alias("omitted"),
        "rejected",
        "first_seq",
        "last_seq",
        F.coalesce("kept_bytes", F.lit(0)).alias("kept_bytes"),
        *([F.coalesce("window", F.array().cast(window.schema["window"].dataType)).alias("window")] if item else []),
    )


# The two loss reports of a window.
OMITTED, REJECTED = "Stream window omitted %d older items.", "Stream rejected %d invalid items."


def loss_cautions(omitted: Column, rejected: Column) -> Column:
    """The two loss reports of a window as text, none where nothing was lost."""
    older = F.when(omitted > 0, F.format_string(OMITTED, omitted))
    invalid = F.when(rejected > 0, F.format_string(REJECTED, rejected))
    return F.array_compact(F.array(older, invalid))


def _judged(
    df: DataFrame, keys: Sequence[str], arrival: str, seq: str, item: str, limit: int, overflow: str, hot_rows: int, epoch: str | None = None
) -> DataFrame:
    """Deliveries with ``_error`` (of the first wrong ones), ``_sequence`` (last accepted number) and ``_held``."""
    require_between("limit", limit, 1, MAX_ACCUMULATED)
    if overflow not in ("error", "drop-oldest"):
        raise LimitError("overflow must be error or drop-oldest")
    used = [*keys, arrival, seq, item, *([epoch] if epoch else [])]
    placed = chunked(df.select(*dict.fromkeys(used)), keys, arrival, hot_rows)
    fields = {"_seen": seq} | ({"_run": epoch} if epoch else {})
    before = with_previous(placed, keys, arrival, fields)
    step = F.col(seq) - F.col("_seen")
    regular = F.when(F.col("_seen").isNull(), F.col(seq) == 1).otherwise(step.isin(0, 1))
    full = F.lit(overflow == "error") & (F.col(seq) > limit)
    other_run = F.col("_seen").isNotNull() & ~F.col("_run").eqNullSafe(F.col(epoch)) if epoch else F.lit(False)
    error = (
        F.when(other_run, "ACC005")
        .when(~regular & F.col("_seen").isNull(), "ACC006")
        .when(~regular, "ACC003")
        .when(full, "ACC004")
    )
    judged = before.withColumn("_error", error)
    # what follows the first error of a source is not accepted, and a repeated delivery (step 0) is not an item
    failed = F.when(F.col("_error").isNotNull(), 1).otherwise(0).cast("bigint")
    counted = with_running(judged, keys, arrival, {"_errors": failed})
    accepted = (F.col("_errors") == 0) & (F.col("_seen").isNull() | (step == 1))
    # accepted numbers count 1, 2, 3..., so the last `limit` of them are the held items
    reached = with_totals(
        counted.withColumn("_accepted", accepted), keys, {"_sequence": F.max(F.when(F.col("_accepted"), F.col(seq)))}
    )
    return reached.withColumn("_held", F.col("_accepted") & (F.col(seq) > F.col("_sequence") - limit))


def _first_error(arrival: str) -> Column:
    return F.min(F.when(F.col("_error").isNotNull(), F.struct(F.col(arrival), F.col("_error").alias("code")))).alias("_stop")


def accumulate(
    df: DataFrame,
    keys: Sequence[str],
    arrival: str,
    seq: str,
    item: str,
    limit: int,
    overflow: str = "error",
    hot_rows: int = HOT_ROWS,
    epoch: str | None = None,
) -> DataFrame:
    """Checkpoint and history totals per source run after all deliveries.

    Deliveries must count 1, 2, 3...; repeating the last number changes nothing. The first other delivery ends the
    history: ACC005 if it belongs to another ``epoch`` of the source, ACC006 where nothing was accepted yet, ACC003 for a
    gap or backward step, ACC004 beyond the limit.
    """
    zero = F.lit(0).cast("bigint")
    folded = _judged(df, keys, arrival, seq, item, limit, overflow, hot_rows, epoch).groupBy(*keys).agg(
        F.count_if("_held").alias("items"),
        F.coalesce(F.max("_sequence"), zero).alias("sequence"),
        F.coalesce(F.sum(F.when(F.col("_held"), F.col(item))), zero).cast("bigint").alias("total"),
        _first_error(arrival),
    )
    return folded.select(
        *keys, "items", "sequence", (F.col("sequence") - F.col("items")).alias("dropped"), "total", F.col("_stop.code").alias("error")
    )


def accumulation(
    df: DataFrame,
    keys: Sequence[str],
    arrival: str,
    seq: str,
    item: str,
    limit: int,
    overflow: str = "error",
    epoch: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The history itself: per source its ``items`` in order, their ``checkpoint`` and the ``error`` that ended it.

    Items may be of any kind; a list holds at most ``limit`` of them. The checkpoint names version, epoch, sequence, limit,
    overflow and dropped; it is null where nothing was accepted. Rules as for :func:`accumulate`.
    """
    judged = _judged(df, keys, arrival, seq, item, limit, overflow, hot_rows, epoch)
    run = F.col(epoch).cast("string") if epoch else F.lit(None).cast("string")
    held = F.collect_list(F.when(F.col("_held"), F.struct(F.col(seq).alias("seq"), F.col(item).alias("item"))))
    folded = judged.groupBy(*keys).agg(
        held.alias("held"),
        F.max("_sequence").alias("sequence"),
        F.max(F.when(F.col("_accepted"), run)).alias("epoch"),
        _first_error(arrival),
    )
    ordered = F.array_sort("held", lambda a, b: (a["seq"] - b["seq"]).cast("int"))
    checkpoint = F.struct(
        F.lit(1).alias("version"),
        "epoch",
        "sequence",
        F.lit(limit).alias("limit"),
        F.lit(overflow).alias("overflow"),
        (F.col("sequence") - F.size("held")).alias("dropped"),
    )
    return folded.select(
        *keys,
        F.transform(ordered, lambda h: h["item"]).alias("items"),
        F.when(F.col("sequence").isNotNull(), checkpoint).alias("checkpoint"),
        F.col("_stop.code").alias("error"),
    )


RECORD_STATE = ("count", "sum", "peak")


def scan_records(
    df: DataFrame, keys: Sequence[str], order: str, value: str, state: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Scan whose state is (count, sum, peak) per key and whose outputs are the rows above every earlier value.

    The state is a running aggregate, so rows of one key are folded in parallel and carried over chunk borders.
    ``state`` holds what earlier rows left behind, one row per key, see :func:`record_state`.
    """
    placed = chunked(df, keys, order, hot_rows)
    peaked = with_running(placed, keys, order, {"_peak": value}, maximum=True, inclusive=False)
    running = with_running(peaked, keys, order, {"count": F.lit(1).cast("bigint"), "sum": value}).drop(*MARKS)
    if state is not None:
        earlier = state.select(*keys, *[F.col(n).alias(f"_s_{n}") for n in RECORD_STATE])
        zero = F.lit(0).cast("bigint")
        running = match_keys(running, earlier, keys, "left").withColumns(
            {
                "_peak": F.greatest("_peak", "_s_peak"),
                "count": F.col("count") + F.coalesce("_s_count", zero),
                "sum": F.col("sum") + F.coalesce("_s_sum", zero),
            }
        )
        running = running.drop(*[f"_s_{n}" for n in RECORD_STATE])
    return running.where(F.col("_peak").isNull() | (F.col(value) > F.col("_peak"))).drop("_peak")


def record_state(df: DataFrame, keys: Sequence[str], value: str, state: DataFrame | None = None) -> DataFrame:
    """State of :func:`scan_records` after these rows: partial states merge by addition and maximum."""
    fresh = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).cast("bigint").alias("sum"), F.max(value).alias("peak")
    )
    if state is None:
        return fresh
    merged = state.select(*fresh.columns).unionByName(fresh)
    return merged.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.max("peak").alias("peak")
    )


def _within_bounds(df, keys, order, size, produces, limits, debits, hot_rows) -> DataFrame:
    """Rows with running totals and whether each lies inside every limit; ``debits`` holds earlier charges per key."""
    charges = {
        "input_records": F.lit(1).cast("bigint"),
        "input_charge": F.col(size).cast("bigint"),
        "output_records": F.when(produces, 1).otherwise(0).cast("bigint"),
    }
    running = with_running(chunked(df, keys, order, hot_rows), keys, order, charges).drop(*MARKS)
    if debits is not None:
        earlier = debits.select(*keys, *[F.col(n).alias(f"_d_{n}") for n in charges])
        running = match_keys(running, earlier, keys, "left").select(
            *[c for c in running.columns if c not in charges],
            *[(F.col(n) + F.coalesce(f"_d_{n}", F.lit(0))).alias(n) for n in charges],
        )
    exceeded = F.coalesce(*[F.when(F.col(n) > limits[n], F.lit(n)) for n in charges if n in limits], F.lit(None).cast("string"))
    return running.withColumn("_exceeded", exceeded)


def scan_bounds(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    size: str,
    produces: Column,
    limits: dict[str, int],
    debits: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The accepted prefix of each key under cumulative limits, and one receipt row per key.

    ``limits`` may name input_records, input_charge (bytes) and output_records. The first row past a limit stops its
    key; running totals only grow, so every later row is past it too. The receipt names the exhausted dimension.
    """
    unknown = set(limits) - {"input_records", "input_charge", "output_records"}
    if unknown:
        raise LimitError(f"unknown limits: {', '.join(sorted(unknown))}")
    judged = _within_bounds(df, keys, order, size, produces, limits, debits, hot_rows)
    inside = F.col("_exceeded").isNull()
    receipts = judged.groupBy(*keys).agg(
        F.max(F.when(inside, F.col(order))).alias("position"),
        *[
            F.coalesce(F.max(F.when(inside, F.col(n))), F.lit(0)).cast("bigint").alias(n)
            for n in ("input_records", "input_charge", "output_records")
        ],
        F.min_by("_exceeded", F.when(~inside, F.col(order))).alias("exhausted"),
    )
    status = F.when(F.col("exhausted").isNull(), "complete").otherwise("stopped")
    prefix = judged.where(inside).drop("_exceeded", "input_records", "input_charge", "output_records")
    return prefix, receipts.withColumn("status", status)


def scan_continue(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    size: str,
    produces: Column,
    receipts: DataFrame,
    limits: dict[str, int],
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Continue every stopped key after its position under raised totals; earlier charges keep counting."""
    before = receipts.select(*keys, F.col("position").alias("_position"))
    rest = match_keys(df, before, keys).where(F.col("_position").isNull() | (F.col(order) > F.col("_position")))
    prefix, later = scan_bounds(rest.drop("_position"), keys, order, size, produces, limits, receipts, hot_rows)
    charges = ("input_records", "input_charge", "output_records")
    renamed = later.withColumnsRenamed({n: f"_{n}" for n in ("position", "exhausted", "status", *charges)})
    merged = match_keys(receipts, renamed, keys, "left").select(
        *keys,
        F.coalesce("_position", "position").alias("position"),
        # a key that accepted nothing more keeps its charges
        *[F.greatest(F.coalesce(f"_{n}", F.lit(0)), F.col(n)).alias(n) for n in charges],
        F.col("_exhausted").alias("exhausted"),
        F.coalesce("_status", F.lit("complete")).alias("status"),
    )
    return prefix, merged
