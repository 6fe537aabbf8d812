"""Time and sequence analytics: counters, clusters, repeats, gaps, adapters and checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.exact import round_div_half_up, to_decimal
from plumbline.guards import refuse_when, require_between
from plumbline.operators.ordered import (
    match_keys,
    MARKS,
    CHUNK_SPAN,
    HOT_ROWS,
    chunk_hot,
    chunked,
    co_located,
    find_hot,
    islands,
    newest,
    row_number_by,
    with_neighbours,
    with_previous,
    with_running,
)

MAX_SERIES = 8
MAX_RECORDS = 20_000


def recent_n(df: DataFrame, n: int, seq: str, keys: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """The last ``n`` rows: by delivery sequence (``seq > last - n``), or the newest ``n`` of each key."""
    require_between("n", n, 1, 100_000)
    if not keys:
        last = df.groupBy().agg(F.max(seq).alias("last")).scalar()
        return df.where(F.col(seq) > last - n)
    return newest(chunked(df, keys, seq, hot_rows), keys, seq, n).drop(*MARKS, "_rank")


def log_tail(
    df: DataFrame, source: str, seq: str, at: str, tail: int = 200, since: Column | None = None, until: Column | None = None
) -> DataFrame:
    """The last ``tail`` rows of each source within [since, until], with a truncated flag and its reason."""
    require_between("tail", tail, 1, 5000)
    inside = df
    if since is not None:
        inside = inside.where(F.col(at) >= since)
    if until is not None:
        inside = inside.where(F.col(at) <= until)
    # one row more than asked for tells whether anything was left out
    kept = newest(chunked(inside, [source], seq), [source], seq, tail + 1)
    more = F.max("_rank").over(Window.partitionBy(source)) > tail
    return (
        kept.withColumn("truncated", more)
        .where(F.col("_rank") <= tail)
        .withColumn("reason", F.when(F.col("truncated"), "line_limit"))
        .drop(*MARKS, "_rank")
    )


# Texts that readers of these results look for, and the key format of label maps in label_key.
NO_RATE = {
    "cpu counters": "CPU counters unavailable",
    "cpu count": "CPU count unavailable",
    "cpu order": "CPU requires increasing sample time and system counter, nondecreasing usage, and a valid prior sample",
    "memory usage": "Memory usage unavailable",
    "memory cache": "Memory cache counter unavailable; working set cannot be derived",
    "memory order": "Memory cache exceeds usage; inconsistent sample",
    "memory limit": "Memory limit unavailable or zero",
}
CONNECTION_CAUTION = "Connection gap observed; events during disconnection were not observed."


def counter_rates(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    at_us: Column,
    cpu: Column,
    system: Column,
    cpus: Column,
    usage: Column,
    cache: Column,
    limit: Column,
) -> DataFrame:
    """CPU and memory percentages between consecutive samples, six decimals rounded half-up.

    A rate that cannot be derived is null and names its reason.
    """
    fields = {"_at": at_us, "_cpu": cpu, "_sys": system}
    base = df.withColumns({"_cpus": cpus, "_use": usage, "_cache": cache, "_limit": limit, **fields})
    before = with_previous(
        chunked(base, keys, order), keys, order, {"_at0": "_at", "_cpu0": "_cpu", "_sys0": "_sys"}
    )
    c = F.col
    missing = c("_cpu").isNull() | c("_cpu0").isNull() | c("_sys").isNull() | c("_sys0").isNull()
    no_cpus = c("_cpus").isNull() | (c("_cpus") == 0)
    advancing = (
        (c("_at0") > 0)
        & (c("_at") > c("_at0"))
        & (c("_cpu") >= c("_cpu0"))
        & (c("_sys") > c("_sys0"))
        & (c("_sys0") > 0)
        & c("_cpus").between(1, 1_000_000)
    )
    cpu_reason = (
        F.when(missing, NO_RATE["cpu counters"])
        .when(no_cpus, NO_RATE["cpu count"])
        .when(~F.coalesce(advancing, F.lit(False)), NO_RATE["cpu order"])
    )
    working = c("_use") - c("_cache")
    memory_reason = (
        F.when(c("_use").isNull(), NO_RATE["memory usage"])
        .when(c("_cache").isNull(), NO_RATE["memory cache"])
        .when(working < 0, NO_RATE["memory order"])
        .when(c("_limit").isNull() | (c("_limit") == 0), NO_RATE["memory limit"])
    )
    wide = "decimal(25,0)"
    rated = before.withColumns({"cpu_unavailable": cpu_reason, "memory_unavailable": memory_reason})
    cpu_share = round_div_half_up(
        ((c("_cpu") - c("_cpu0")).cast(wide) * c("_cpus") * 100).cast("decimal(31,0)"), c("_sys") - c("_sys0"), 6
    )
    memory_share = round_div_half_up((working.cast(wide) * 100).cast("decimal(31,0)"), c("_limit"), 6)
    return rated.select(
        *df.columns,
        F.when(c("cpu_unavailable").isNull(), cpu_share).alias("cpu_percent"),
        "cpu_unavailable",
        F.when(working >= 0, working).alias("working_set"),
        F.when(c("memory_unavailable").isNull(), memory_share).alias("memory_percent"),
        "memory_unavailable",
    )


def occurrence_number(
    df: DataFrame, keys: Sequence[str], *order: Column | str, name: str = "occurrence", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """0-based occurrence of equal keys in the given order, for stable ids of rows with one timestamp."""
    return row_number_by(df, keys, *order, name=name, hot_rows=hot_rows)


def event_clusters(
    df: DataFrame, keys: Sequence[str], at: str, gap_us: int, hot_rows: int = HOT_ROWS, chunk_span: int = CHUNK_SPAN
) -> DataFrame:
    """Clusters of events per key: an event joins while less than ``gap_us`` has passed since the cluster's last one.

    Events of one instant are combined before anything is ordered, so instants are unique within their key.
    """
    hot = find_hot(df, keys, hot_rows)
    instants = co_located(df.select(*keys, F.unix_micros(at).alias("_at")), keys, hot)
    instants = instants.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_n"))
    placed = chunk_hot(instants, keys, "_at", hot, chunk_span)
    before = with_previous(placed, keys, "_at", {"_before": "_at"})
    starts = F.col("_before").isNull() | (F.col("_at") - F.col("_before") >= gap_us)
    numbered = islands(before, keys, "_at", starts, "cluster")
    return numbered.groupBy(*keys, "cluster").agg(
        F.min("_at").alias("first_us"),
        F.max("_at").alias("last_us"),
        F.sum("_n").cast("bigint").alias("events"),
    )


def collapse_repeats(
    df: DataFrame, keys: Sequence[str], order: str, message: Sequence[str], keep: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Runs of identical consecutive messages as one row with count, first and last.

    With ``keep`` only the newest ``keep`` runs of a key are returned, and ``omitted`` counts its older ones.
    """
    record = F.struct(*message)
    hot = find_hot(df, keys, hot_rows)
    placed = chunk_hot(df.select(*keys, order, *message), keys, order, hot)
    before = with_previous(placed, keys, order, {"_before": record})
    starts = F.col("_before").isNull() | ~F.col("_before").eqNullSafe(record)
    numbered = islands(before, keys, order, starts, "run")
    runs = numbered.groupBy(*keys, "run", *message).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("first"), F.max(order).alias("last")
    )
    if keep is None:
        return runs.drop(*MARKS)
    total = F.count(F.lit(1)).alias("_runs")
    counted = runs.groupBy(*keys).agg(total).withColumn("omitted", F.greatest(F.col("_runs") - keep, F.lit(0)).cast("bigint"))
    # a key has at most as many runs as rows
    kept = newest(chunk_hot(runs, keys, "run", hot), keys, "run", keep).drop(*MARKS, "_rank")
    return match_keys(kept, counted.drop("_runs"), keys)


def gap_samples(df: DataFrame, keys: Sequence[str], seq: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Samples with a ``gap`` flag and the number of sequence values missing before each."""
    return _gaps(chunked(df, keys, seq, hot_rows), keys, seq)


def _gaps(placed: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    before = with_previous(placed, keys, seq, {"_before": seq})
    jump = F.col(seq) - F.col("_before") - 1
    missing = F.when(F.col("_before") > 0, F.greatest(jump, F.lit(0))).otherwise(F.lit(0))
    return before.withColumn("missing", missing.cast("bigint")).withColumn("gap", F.col("missing") > 0).drop(
        "_before", *MARKS
    )


def gap_coverage(
    df: DataFrame, keys: Sequence[str], seq: str, failed: Column, keep: int = 120, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per key over its last ``keep`` sequence values: samples, gaps, omitted, coverage [first, last + 1), errors."""
    # sequence values are unique, so the last `keep` of them are among the newest `keep` rows: each task drops the
    # rest before the shuffle
    recent = newest(chunked(df.withColumn("_failed", failed), keys, seq, hot_rows), keys, seq, keep).drop(*MARKS, "_rank")
    last = F.max(seq).over(Window.partitionBy(*keys))
    flagged = _gaps(recent.withColumn("_last", last).where(F.col(seq) > F.col("_last") - keep), keys, seq)
    totals = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("gap").alias("gaps"),
        F.sum("missing").alias("_missing"),
        F.min(seq).alias("coverage_start"),
        (F.max(seq) + 1).alias("coverage_end"),
        F.count_if("_failed").alias("errors"),
    )
    everything = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    omitted = (F.col("_all") - F.col("samples") + F.col("_missing")).cast("bigint")
    return match_keys(totals, everything, keys).select(
        *keys, "samples", "gaps", omitted.alias("omitted"), "coverage_start", "coverage_end", "errors"
    )


def sequence_audit(df: DataFrame, keys: Sequence[str], seq: str, arrival: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Classify each delivery against the one that arrived before it: first, next, duplicate, gap or backward."""
    before = with_previous(chunked(df, keys, arrival, hot_rows), keys, arrival, {"_before": seq})
    step = F.col(seq) - F.col("_before")
    verdict = (
        F.when(F.col("_before").isNull(), "first")
        .when(step == 1, "next")
        .when(step == 0, "duplicate")
        .when(step > 1, "gap")
        .otherwise("backward")
    )
    return before.withColumn("verdict", verdict).drop("_before", *MARKS)


def connection_gap(df: DataFrame, keys: Sequence[str], order: str, epoch: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mark rows whose source epoch differs from the one before: events between them were not observed."""
    before = with_previous(chunked(df, keys, order, hot_rows), keys, order, {"_before": epoch})
    changed = F.col("_before").isNotNull() & (F.col("_before") != F.col(epoch))
    return before.withColumn("caution", F.when(changed, CONNECTION_CAUTION)).drop("_before", *MARKS)


def label_key(labels: Column) -> Column:
    """Canonical text of a label map: ``length:key length:value`` pairs sorted by key, without separators."""
    pair = lambda e: F.concat(
        F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.length(e["value"]).cast("string"), F.lit(":"), e["value"]
    )
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), pair), "")


RANGE_RECORD = "struct<metric:map<string,string>,values:array<array<string>>>"
LOG_RECORD = "struct<stream:map<string,string>,values:array<array<string>>>"


def series_adapter(df: DataFrame, body: Column, start_us: int, end_us: int) -> DataFrame:
    """Samples of range-matrix records: one row per (series, instant) inside [start, end).

    ``NaN`` becomes a gap with value 0. Two values for one instant of a series fail, and so do instants and values with
    more than six fractional digits.
    """
    records = df.select(F.from_json(body, RANGE_RECORD, {"mode": "FAILFAST"}).alias("r"))
    pairs = records.select(label_key(F.col("r.metric")).alias("_key"), F.explode("r.values").alias("p"))
    micros = (to_decimal(F.get("p", F.lit(0)), 6).cast("decimal(20,6)") * 1_000_000).cast("bigint")
    text = F.get("p", F.lit(1))
    # numbers and flags rather than text, so the duplicate check aggregates by hash
    samples = pairs.select(
        F.when(F.col("_key") == "", "scalar").otherwise(F.col("_key")).alias("series"),
        micros.alias("at_us"),
        F.when(text == "NaN", F.lit(0)).otherwise(to_decimal(text, 6)).cast("decimal(38,6)").alias("value"),
        (text == "NaN").alias("gap"),
    ).where((F.col("at_us") >= start_us) & (F.col("at_us") < end_us))
    one = samples.groupBy("series", "at_us").agg(
        F.max("value").alias("value"), F.max("gap").alias("gap"), F.count(F.lit(1)).alias("_copies")
    )
    checked = refuse_when(F.col("_copies") > 1, F.col("at_us"), "series has two values for one instant")
    return one.select("series", checked.alias("at_us"), "value", "gap")


def log_adapter(df: DataFrame, body: Column, start_us: int, end_us: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events of log-stream records inside [start, end) with ids that tell equal instants apart."""
    records = df.select(F.from_json(body, LOG_RECORD, {"mode": "FAILFAST"}).alias("r"))
    pairs = records.select(label_key(F.col("r.stream")).alias("_key"), F.explode("r.values").alias("p"))
    events = pairs.select(
        F.when(F.col("_key") == "", "log").otherwise(F.col("_key")).alias("label"),
        F.get("p", F.lit(0)).cast("bigint").alias("at_ns"),
        F.get("p", F.lit(1)).alias("detail"),
    ).where((F.col("at_ns") >= start_us * 1000) & (F.col("at_ns") < end_us * 1000))
    numbered = occurrence_number(events, ["label", "at_ns"], "detail", hot_rows=hot_rows)
    text = lambda name: F.col(name).cast("string")
    return numbered.select(
        F.concat_ws("/", "label", text("at_ns"), text("occurrence")).alias("id"), "at_ns", "label", "detail"
    )


def timeline_check(
    samples: DataFrame,
    order: str,
    start_us: int,
    end_us: int,
    max_series: int = MAX_SERIES,
    max_records: int = MAX_RECORDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Violation counts per rule for samples (series, unit, id, at_us, arrival order); zero means the rule holds."""
    placed = chunked(samples, ["series"], order, hot_rows)
    before = with_previous(placed, ["series"], order, {"_before": "at_us"})
    # ids repeat within their series only: combine per (series, id), then the totals are one small row
    ids = before.groupBy("series", "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_before") > F.col("at_us")).alias("unsorted"),
        F.count_if((F.col("at_us") < start_us) | (F.col("at_us") >= end_us)).alias("outside"),
        F.min("unit").alias("unit_low"),
        F.max("unit").alias("unit_high"),
    )
    series = ids.groupBy("series").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") - 1).alias("repeated"),
        F.sum("unsorted").alias("unsorted"),
        F.sum("outside").alias("outside"),
        F.min("unit_low").alias("unit_low"),
        F.max("unit_high").alias("unit_high"),
    )
    total = series.agg(
        F.greatest(F.count(F.lit(1)) - max_series, F.lit(0)).alias("series_over_limit"),
        F.greatest(F.sum("n") - max_records, F.lit(0)).alias("records_over_limit"),
        F.sum("unsorted").alias("unsorted"),
        F.sum("repeated").alias("duplicate_ids"),
        F.sum("outside").alias("outside_range"),
        (F.min("unit_low") != F.max("unit_high")).cast("bigint").alias("mixed_units"),
    )
    rules = ["series_over_limit", "records_over_limit", "unsorted", "duplicate_ids", "outside_range", "mixed_units"]
    cells = [F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(0)).cast("bigint").alias("violations")) for r in rules]
    return total.select(F.inline(F.array(*cells)))


def timeline_model_check(
    declared: DataFrame,
    samples: DataFrame,
    events: DataFrame,
    coverage: DataFrame,
    order: str,
    start_us: int,
    end_us: int,
    max_series: int = MAX_SERIES,
    max_records: int = MAX_RECORDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Violation counts per rule of a whole timeline; zero means the rule holds.

    ``declared(id, unit)`` names the series, ``samples`` are as in :func:`timeline_check`, ``events(id, at_us, order)`` the
    events, ``coverage(start_us, end_us)`` what was observed: every piece must be an interval inside the range. Samples and
    events together keep the record limit; series ids are unique, and all series have one unit.
    """
    of_samples = timeline_check(samples, order, start_us, end_us, max_series, max_records, hot_rows)
    as_series = events.select(F.lit("events").alias("series"), F.lit("").alias("unit"), "id", "at_us", order)
    of_events = timeline_check(as_series, order, start_us, end_us, max_series, max_records, hot_rows)
    shared = ["unsorted", "duplicate_ids", "outside_range"]
    rows = of_samples.where(F.col("rule").isin(shared))
    rows = rows.unionByName(of_events.where(F.col("rule").isin(shared)).withColumn("rule", F.concat(F.lit("events_"), F.col("rule"))))
    one = lambda df, rule, count: df.agg(F.coalesce(count, F.lit(0)).cast("bigint").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    many, zero = F.count(F.lit(1)), F.lit(0)
    records = samples.select(F.lit(1).alias("n")).unionByName(events.select(F.lit(1).alias("n")))
    wrong = (F.col("start_us") < start_us) | (F.col("end_us") > end_us) | (F.col("start_us") > F.col("end_us"))
    for part in (
        one(declared, "series_over_limit", F.greatest(many - max_series, zero)),
        one(declared.groupBy("id").agg((many - 1).alias("repeated")), "duplicate_series", F.sum("repeated")),
        one(declared, "mixed_units", (F.min("unit") != F.max("unit")).cast("bigint")),
        one(records, "records_over_limit", F.greatest(many - max_records, zero)),
        one(coverage, "coverage_outside_range", F.count_if(F.coalesce(wrong, F.lit(True)))),
    ):
        rows = rows.unionByName(part)
    return rows


def nearest_join(
    cursors: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    at: str,
    sample: Column,
    hot_rows: int = HOT_ROWS,
    chunk_span: int = CHUNK_SPAN,
) -> DataFrame:
    """For each cursor instant the nearest sample of its series; of two equally near ones the earlier.

    Both sides are merged by instant and ordered once; no pair of cursor and sample is formed to be thrown away.
    """
    side = lambda df, is_cursor, value: df.select(
        *keys,
        F.unix_micros(at).alias("_at"),
        F.lit(is_cursor).alias("_cursor"),
        F.lit(not is_cursor).alias("_is_sample"),
        value.alias("_value"),
    )
    points = side(samples, False, sample)
    marks = side(cursors, True, F.lit(None).cast(points.schema["_value"].dataType))
    hot = find_hot(marks.select(*keys).unionByName(points.select(*keys)), keys, hot_rows)
    merged = (
        co_located(marks.unionByName(points), keys, hot)
        .groupBy(*keys, "_at")
        .agg(F.max("_cursor").alias("_cursor"), F.max("_is_sample").alias("_is_sample"), F.min("_value").alias("_value"))
        .withColumn("_s", F.when(F.col("_is_sample"), F.struct(F.col("_at").alias("at"), F.col("_value").alias("sample"))))
    )
    placed = chunk_hot(merged, keys, "_at", hot, chunk_span)
    found = with_neighbours(placed, keys, "_at", F.col("_s"), "_b", "_a")
    earlier = F.col("_a").isNull() | (F.col("_at") - F.col("_b.at") <= F.col("_a.at") - F.col("_at"))
    pick = F.when(F.col("_b").isNotNull() & earlier, F.col("_b")).otherwise(F.col("_a"))
    return found.where("_cursor").select(
        *keys,
        F.col("_at").alias("cursor_us"),
        pick["at"].alias("sample_us"),
        pick["sample"].alias("sample"),
        F.abs(pick["at"] - F.col("_at")).alias("distance_us"),
    )


def range_correlate(
    selections: DataFrame,
    sources: dict[str, DataFrame],
    at: str,
    start_us: str,
    end_us: str,
    bucket_us: int,
    hot_rows: int = HOT_ROWS,
    salts: int = 64,
) -> DataFrame:
    """Events of every source inside each selected interval [start, end).

    An equi-join on time buckets with the half-open predicate as residual: an interval takes one row per bucket it
    touches, an event exactly one, so no pair is produced twice. Events of a bucket with more than ``hot_rows`` rows
    are spread over ``salts`` parts, and only the intervals touching such a bucket are repeated per part.

    Both sides meet in the order of time, so that a written result repeats long runs and stays small.
    """
    merged = reduce(
        lambda a, b: a.unionByName(b), [rows.withColumn("source", F.lit(name)) for name, rows in sources.items()]
    )
    width = F.lit(bucket_us).cast("bigint")
    floor = lambda c: F.call_function("div", c - F.pmod(c, width), width)
    events = merged.withColumn("at_us", F.unix_micros(at)).withColumn("_bucket", floor(F.col("at_us")))
    nonempty = selections.where(F.col(start_us) < F.col(end_us))
    buckets = F.sequence(floor(F.col(start_us)), floor(F.col(end_us) - 1))
    wanted = nonempty.withColumn("_bucket", F.explode(buckets))
    on = ["_bucket"]
    hot = find_hot(events, on, hot_rows)
    if hot is not None:
        on.append("_salt")
        marked = hot.withColumn("_hot", F.lit(True))
        # by row number rather than by content, so that copies of one event spread too; any part is a right one
        part = F.when(F.col("_hot"), F.pmod("_row", F.lit(salts))).otherwise(0).cast("int")
        every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        # at most rows / hot_rows buckets are hot
        events = events.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(marked), "_bucket", "left")
        events = events.withColumn("_salt", part).drop("_hot", "_row")
        wanted = wanted.join(F.broadcast(marked), "_bucket", "left").withColumn("_salt", F.explode(every)).drop("_hot")
    inside = (F.col("at_us") >= F.col(start_us)) & (F.col("at_us") < F.col(end_us))
    # pairs, not rows, are the work: tasks joined by the small size of their input would leave most cores idle
    parts = int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a join that sorts by bucket keeps this order within one; the row number keeps Spark from dropping the sort as unneeded
    dealt = lambda df, time: (
        df.repartition(parts, *on).sortWithinPartitions(*on, time).withColumn("_row", F.monotonically_increasing_id()).where("_row >= 0").drop("_row")
    )
    return dealt(events, "at_us").join(dealt(wanted, start_us), on).where(inside).drop("_bucket", "_salt")


def running_total(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS, **sums: Column) -> DataFrame:
    """Running sums per key that include the current row."""
    return with_running(chunked(df, keys, order, hot_rows), keys, order, sums).drop(*MARKS)
