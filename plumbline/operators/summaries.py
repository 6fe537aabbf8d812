"""Aggregations: health and log summaries, histograms, roll-ups, footprints, previews."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.exact import div, round_div
from plumbline.functions.text import regex_test
from plumbline.guards import require_between, require_kind, required
from plumbline.operators.folds import SPAN, associative, reduce_rows
from plumbline.operators.lineage import reached_sets, single_roots
from plumbline.operators.ordered import chunk_hot, find_hot, match_keys, newest
from plumbline.session import TASK_ROWS


def sum_where(df: DataFrame, predicate: Column, value: Column) -> DataFrame:
    """Total rows, rows where the predicate holds, and the sum of ``value`` over those."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(predicate).alias("errors"),
        F.coalesce(F.sum(F.when(predicate, value)), F.lit(0)).cast("bigint").alias("sum_value"),
    )


def health_summary(
    df: DataFrame, seq: Column, failed: Column, duration_ms: Column, by: Sequence[str] = (), slow_ms: int = 500
) -> DataFrame:
    """State, counts and latency of a request table, overall or per group; one map-side combined aggregation."""
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(failed).alias("errors"),
        F.coalesce(F.sum(duration_ms), F.lit(0)).cast("bigint").alias("_sum"),
        F.greatest(F.coalesce(F.max(duration_ms), F.lit(0)), F.lit(0)).cast("bigint").alias("max_ms"),
        F.coalesce(F.max(seq), F.lit(0)).cast("bigint").alias("last"),
    )
    return _with_state(totals, slow_ms).drop("_sum")


def _with_state(totals: DataFrame, slow_ms: int) -> DataFrame:
    some = F.col("count") > 0
    safe_count = F.greatest(F.col("count"), F.lit(1))
    mean = F.when(some, round_div(F.col("_sum"), safe_count, 1)).otherwise(F.lit(0))
    percent = F.when(some, round_div(F.col("errors") * 100, safe_count, 1)).otherwise(F.lit(0))
    return totals.withColumns({"mean_ms": mean, "error_percent": percent}).withColumn(
        "state",
        F.when(~some, "WAITING")
        .when(F.col("errors") > 0, "DEGRADED")
        .when(F.col("mean_ms") > slow_ms, "SLOW")
        .otherwise("HEALTHY"),
    )


def log_summary(
    df: DataFrame, source: str, order: str, text: str, pattern: str, counters: dict[str, Column], examples: int = 2
) -> DataFrame:
    """Per source: lines, pattern matches, named counters, and previews of the first matching lines.

    Previews hold 160 characters; ``shortened_k`` tells whether more was cut off.
    """
    hit = regex_test(F.col(text), pattern)
    counts = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(hit).alias("matches"),
        *[F.count_if(condition).alias(name) for name, condition in counters.items()],
    )
    preview = F.struct(F.left(text, F.lit(160)).alias("preview"), (F.length(text) > 160).alias("shortened"))
    # keys are counted in the whole table, without matching the pattern once more
    hot = find_hot(df, [source])
    matching = chunk_hot(df.where(hit).select(source, order, preview.alias("_preview")), [source], order, hot)
    first = newest(matching, [source], order, examples, ascending=True)
    shown = first.groupBy(source).agg(
        *[F.max(F.when(F.col("_rank") == k, F.col("_preview"))).alias(f"_p{k}") for k in range(1, examples + 1)]
    )
    columns = [
        c
        for k in range(1, examples + 1)
        for c in (F.col(f"_p{k}.preview").alias(f"preview_{k}"), F.col(f"_p{k}.shortened").alias(f"shortened_{k}"))
    ]
    return match_keys(counts, shown, [source], "left").select(*counts.columns, *columns)


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins with exact integer membership; the maximum falls into the last bin.

    The extremes come from a scalar subquery, counts from a map-side combined aggregation of at most ``bins`` groups.
    """
    require_between("bins", bins, 1, 200)
    require_kind(df, value, "Int")
    numbers = df.select(value.cast("bigint").alias("n")).where(F.col("n").isNotNull())
    extent = numbers.groupBy().agg(F.struct(F.min("n").alias("low"), F.max("n").alias("high")).alias("e")).scalar()
    low, high = extent["low"], extent["high"]
    spread = F.greatest(high - low, F.lit(1))
    raw = div((F.col("n") - low) * bins, spread)
    counted = numbers.groupBy(F.least(F.lit(bins - 1), raw).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    # a single value gives one bin, an empty table none
    last = F.when(low.isNull(), -1).when(low == high, 0).otherwise(bins - 1)
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).where(F.col("bin") <= last)
    width = F.when(low == high, F.lit(0)).otherwise(round_div(high - low, F.lit(bins), 12)).cast("decimal(26,12)")
    edge = lambda k: (low.cast("decimal(20,0)") + (k * width).cast("decimal(30,12)")).cast("decimal(38,12)")
    total = numbers.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    return grid.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("lower"),
        edge(F.col("bin") + 1).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
        total.alias("total"),
    )


def rollup_counters(
    df: DataFrame, group: str, bucket: str, outcome: str, completed: Column, bytes_in: Column, duration: Column
) -> DataFrame:
    """Counters in total, per group and per bucket, with outcome counts as ``name=count`` text.

    Input rows are combined once per (group, bucket, outcome); the grouping sets expand only that small result.
    """
    base = df.groupBy(group, bucket, outcome).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(completed).alias("completed"),
        F.sum(bytes_in).alias("bytes_in"),
        F.sum(duration).alias("duration"),
        F.max(duration).alias("max_duration"),
    )
    sets = [[F.col(outcome)], [F.col(group), F.col(outcome)], [F.col(group), F.col(bucket), F.col(outcome)]]
    per_outcome = base.groupingSets(sets, group, bucket, outcome).agg(
        (2 - F.grouping(group).cast("int") - F.grouping(bucket).cast("int")).alias("depth"),
        *[F.sum(c).alias(c) for c in ("messages", "completed", "bytes_in", "duration")],
        F.max("max_duration").alias("max_duration"),
    )
    # at most one element per outcome name
    entries = F.array_sort(F.collect_list(F.concat(F.col(outcome), F.lit("="), F.col("messages").cast("string"))))
    return per_outcome.groupBy("depth", group, bucket).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("messages", "completed", "bytes_in", "duration")],
        F.max("max_duration").alias("max_duration"),
        F.array_join(entries, ",").alias("outcomes"),
    )


def footprint(references: DataFrame, sizes: DataFrame, root: str, item: str, size: str) -> DataFrame:
    """Per root: bytes of its distinct objects, how many of them other roots share, and the exclusive rest.

    An object without a size fails: its root would look smaller than it is.
    """
    pairs = references.select(root, item).distinct()
    holders = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("_roots"))
    return pairs.join(_sized(holders, sizes, item, size), item).groupBy(root).agg(*_held())


def _sized(holders: DataFrame, sizes: DataFrame, item: str, size: str) -> DataFrame:
    objects = match_keys(holders, sizes.select(item, F.col(size).alias("_size")), [item], "left")
    return objects.withColumn("_size", required(F.col("_size"), "object has no size"))


def _held() -> list[Column]:
    bytes_of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("_size"))), F.lit(0)).cast("bigint")
    return [
        F.count(F.lit(1)).alias("objects"),
        F.sum("_size").cast("bigint").alias("total_bytes"),
        bytes_of(F.col("_roots") > 1).alias("shared_bytes"),
        bytes_of(F.col("_roots") == 1).alias("exclusive_bytes"),
    ]


def footprint_closure(
    references: DataFrame, links: DataFrame, sizes: DataFrame, root: str, item: str, target: str, size: str
) -> DataFrame:
    """The footprint of what each root reaches: its ``references(root, item)`` and all that ``links(item, target)`` lead to.

    Every object counts once per root however many paths lead to it; shared are the objects that other roots reach too.
    Objects are sized by their sets of roots, and roots are told apart only to be summed up.
    """
    edges = links.select(F.col(item).alias("source"), F.col(target).alias("target"))
    roots, sets = reached_sets(edges, references.select(F.col(root).alias("root"), F.col(item).alias("node")))
    # by a stated number: roots, not sets, are the work, and tasks joined by the small size of their input would be few
    parts = max(sets.sparkSession.sparkContext.defaultParallelism, -(-sets.count() // TASK_ROWS))
    dealt = sets.withColumnRenamed("node", item).repartition(parts, item)
    holders = dealt.groupBy(item).agg(F.sum(F.bit_count("bits")).alias("_roots"))
    totals = single_roots(dealt.join(_sized(holders, sizes, item, size), item)).groupBy("number").agg(*_held())
    return totals.join(roots.withColumnRenamed("root", root), "number").select(root, *totals.columns[1:])


def domain_preview(df: DataFrame, value: str, order: str, limit: int = 64) -> DataFrame:
    """Distinct values in order of first appearance, at most ``limit``, with the full total and a complete flag."""
    distinct = df.groupBy(value).agg(F.min(order).alias("first_at"), F.count(F.lit(1)).alias("occurrences"))
    total = distinct.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        distinct.orderBy("first_at")
        .limit(limit)
        .withColumns({"total": total, "complete": total <= limit})
    )


def ordered_reduce(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lift: Column,
    initial: Column,
    step: Callable[[Column, Column], Column],
    fold_span: int = SPAN,
) -> DataFrame:
    """Left fold per key in ``order``: ``step(accumulator, item) -> accumulator`` over lifted rows.

    ``step`` must be associative with ``initial`` as its identity: runs of rows are folded on their own and joined. Where
    that gives another result than folding row by row, the query fails. Folds with unlike types: :func:`folds.reduce_rows`.
    """
    level = df.select(*keys, F.col(order).cast("bigint").alias("_at"), lift.alias("_value"))
    item = lambda x: x["_value"]
    return reduce_rows(level, keys, "_at", initial, lambda acc, x: step(acc, item(x)), associative(step, item), span=fold_span)


def count_items(df: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Rows, characters and UTF-8 bytes of a text column per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(F.length(text).cast("bigint")).alias("chars"),
        F.sum(F.octet_length(text).cast("bigint")).alias("bytes"),
    )
