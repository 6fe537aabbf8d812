"""Hot keys, chunk borders and partition counts must not change any result."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from plumbline.operators import ordered, series, summaries
from plumbline.streaming import history

HOT = {"hot_rows": 20}


@pytest.fixture(scope="module")
def table(spark):
    """One key (and one null key) with most rows, several small keys, unique order values with holes."""
    rng = random.Random(7)
    data = []
    for key, n in (("big", 400), (None, 60), ("a", 7), ("b", 1), ("c", 19)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 1, 2, 50])
            data.append((key, at, rng.randint(0, 9), rng.choice(["x", "x", "y"])))
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, at bigint, v bigint, m string").repartition(3).cache()


def test_only_hot_keys_are_chunked(table):
    assert not ordered.is_chunked(ordered.chunked(table, ["key"], "at"))
    placed = ordered.chunked(table, ["key"], "at", 20, 16)
    per_chunk = placed.where("_chunk is not null").groupBy("key", "_chunk").count()
    assert {r.key for r in per_chunk.collect()} == {"big", None}
    assert per_chunk.agg(F.max("count")).first()[0] <= 16


def plain_and_chunked(table, function):
    plain = function(ordered.chunked(table, ["key"], "at"))
    cut = function(ordered.chunked(table, ["key"], "at", 20, 16)).drop(*ordered.MARKS)
    assert rows(plain) == rows(cut)
    return plain


def test_previous(table):
    found = plain_and_chunked(table, lambda df: ordered.with_previous(df, ["key"], "at", {"b": "v", "t": "at"}))
    assert found.where("b is null").count() == 5


def test_keys_without_nulls_join_by_equality(table):
    known = table.where("key is not null")
    assert ordered.NULLS not in ordered.chunked(known, ["key"], "at", 20, 16).columns
    plain_and_chunked(known, lambda df: ordered.with_previous(df, ["key"], "at", {"b": "v"}))
    plain_and_chunked(known, lambda df: ordered.with_running(df, ["key"], "at", {"s": "v"}))


def test_running_sum_and_maximum(table):
    plain_and_chunked(table, lambda df: ordered.with_running(df, ["key"], "at", {"n": F.lit(1).cast("bigint"), "s": "v"}))
    plain_and_chunked(table, lambda df: ordered.with_running(df, ["key"], "at", {"s": "v"}, inclusive=False))
    plain_and_chunked(table, lambda df: ordered.with_running(df, ["key"], "at", {"p": "v"}, maximum=True, inclusive=False))


def test_neighbours(table):
    rare = F.when(F.col("v") == 3, F.struct("at", "v"))
    plain_and_chunked(table, lambda df: ordered.with_neighbours(df, ["key"], "at", rare, "b", "a"))


def test_totals(table):
    plain_and_chunked(table, lambda df: ordered.with_totals(df, ["key"], {"n": F.count("v"), "top": F.max("at")}))


def test_newest(table):
    for ascending in (False, True):
        plain_and_chunked(table, lambda df: ordered.newest(df, ["key"], "at", 5, ascending=ascending))


def test_global_running_sum(table):
    unique = table.withColumn("n", F.col("at") * 10 + F.when(F.col("key").isNull(), 1).otherwise(F.length("key")))
    unique = unique.where("key is null or key in ('big', 'a')")
    found = ordered.with_running(ordered.chunked(unique, [], "n", chunk_span=64), [], "n", {"s": "v"})
    total = 0
    for row in sorted(found.collect(), key=lambda r: r.n):
        total += row.v
        assert row.s == total


def test_position_is_a_permutation_in_order(table):
    placed = ordered.position(table, "key", "at").collect()
    placed.sort(key=lambda r: r.position)
    assert [r.position for r in placed] == list(range(len(placed)))
    assert [(r.key or "", r.at) for r in placed] == sorted((r.key or "", r.at) for r in placed)


def test_row_numbers(table):
    few = ordered.row_number_by(table, ["key"], "m", "at")
    many = ordered.row_number_by(table, ["key"], "m", "at", hot_rows=20)
    assert rows(few) == rows(many)


def test_ordered_reduce_is_independent_of_spans(table):
    join = lambda a, b: F.concat(a, b)
    whole = summaries.ordered_reduce(table, ["key"], "at", F.col("m"), F.lit(""), join)
    small = summaries.ordered_reduce(table, ["key"], "at", F.col("m"), F.lit(""), join, fold_span=4)
    assert rows(whole) == rows(small)
    expected = "".join(r.m for r in sorted(table.where("key = 'c'").collect(), key=lambda r: r.at))
    assert whole.where("key = 'c'").first().result == expected


OPERATORS = {
    "repeats": lambda df, o: series.collapse_repeats(df, ["key"], "at", ["m"], 30, **o),
    "coverage": lambda df, o: series.gap_coverage(df, ["key"], "at", F.col("v") > 5, 300, **o),
    "gaps": lambda df, o: series.gap_samples(df, ["key"], "at", **o),
    "recent": lambda df, o: series.recent_n(df, 6, "at", ["key"], **o),
    "audit": lambda df, o: series.sequence_audit(df, ["key"], "v", "at", **o),
    "epochs": lambda df, o: series.connection_gap(df, ["key"], "at", "m", **o),
    "records": lambda df, o: history.scan_records(df, ["key"], "at", "v", **o),
    "window": lambda df, o: history.rolling_window(df, ["key"], "at", "v", 5, 8, **o),
    "bounds": lambda df, o: history.scan_bounds(df, ["key"], "at", "v", F.col("m") == "y", {"input_records": 30, "input_charge": 90, "output_records": 9}, **o)[1],
    "total": lambda df, o: series.running_total(df, ["key"], "at", s=F.col("v"), **o),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_hot_keys_and_partitions(spark, table, name, monkeypatch):
    known = table.where("key is not null")
    want = rows(OPERATORS[name](known, {}))
    monkeypatch.setattr(ordered.chunked, "__defaults__", (20, 16))
    monkeypatch.setattr(ordered.chunk_hot, "__defaults__", (16,))
    assert rows(OPERATORS[name](known, HOT)) == want
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(OPERATORS[name](known.coalesce(1), HOT)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def instants(table):
    return table.where("key is not null").withColumn("ts", F.timestamp_micros("at"))


@pytest.mark.parametrize("gap", [2, 50])
def test_clusters(table, gap):
    df = instants(table)
    plain = series.event_clusters(df, ["key"], "ts", gap)
    assert rows(plain) == rows(series.event_clusters(df, ["key"], "ts", gap, 20, 16))
    for key in ("big", "c"):
        times = sorted(r.at for r in df.where(F.col("key") == key).collect())
        clusters = 1 + sum(b - a >= gap for a, b in zip(times, times[1:]))
        assert plain.where(F.col("key") == key).count() == clusters


def test_nearest_sample_and_ties(spark, table):
    df = instants(table)
    cursors, samples = df.where("m = 'y'"), df.where("v > 6")
    plain = series.nearest_join(cursors, samples, ["key"], "ts", F.col("v"))
    assert rows(plain) == rows(series.nearest_join(cursors, samples, ["key"], "ts", F.col("v"), 20, 16))
    points = {}
    for r in samples.collect():
        points.setdefault(r.key, []).append(r.at)
    for r in plain.collect():
        best = min(points.get(r.key, []), key=lambda t: (abs(t - r.cursor_us), t), default=None)
        assert r.sample_us == best
    tie = spark.createDataFrame([("s", 10), ("s", 20)], "key string, at bigint").withColumn("ts", F.timestamp_micros("at"))
    cursor = spark.createDataFrame([("s", 15)], "key string, at bigint").withColumn("ts", F.timestamp_micros("at"))
    assert series.nearest_join(cursor, tie, ["key"], "ts", F.col("at")).first().sample_us == 10


def test_scan_continue_equals_one_run(table):
    df = table.where("key is not null")
    produces = F.col("m") == "y"
    low = {"input_records": 10, "input_charge": 45, "output_records": 4}
    high = {"input_records": 300, "input_charge": 700, "output_records": 90}
    first, receipts = history.scan_bounds(df, ["key"], "at", "v", produces, low)
    rest, continued = history.scan_continue(df, ["key"], "at", "v", produces, receipts, high)
    once, receipt = history.scan_bounds(df, ["key"], "at", "v", produces, high)
    assert rows(first.unionByName(rest)) == rows(once)
    columns = receipt.columns
    assert rows(continued, *columns) == rows(receipt, *columns)


@pytest.mark.parametrize("overflow", ["error", "drop-oldest"])
@pytest.mark.parametrize(
    "deliveries, expected",
    [
        ([1, 2, 3], (3, 3, 0, None)),
        ([1, 1, 2, 2, 3], (3, 3, 0, None)),
        ([2, 3], (0, 0, 0, "ACC006")),
        ([1, 2, 4, 5], (2, 2, 0, "ACC003")),
        ([1, 2, 1, 2], (2, 2, 0, "ACC003")),
        ([1, 2, 3, 4, 5, 6], {"error": (4, 4, 0, "ACC004"), "drop-oldest": (4, 6, 2, None)}),
    ],
)
def test_accumulation_rules(spark, deliveries, expected, overflow):
    want = expected[overflow] if isinstance(expected, dict) else expected
    data = [("s", i, seq, seq * 10) for i, seq in enumerate(deliveries)]
    df = spark.createDataFrame(data, "key string, at bigint, seq bigint, item bigint")
    for options in ({}, {"hot_rows": 2}):
        found = history.accumulate(df, ["key"], "at", "seq", "item", 4, overflow, **options).first()
        assert (found["items"], found.sequence, found.dropped, found.error) == want
        held = range(want[1] - want[0] + 1, want[1] + 1)
        assert found.total == sum(s * 10 for s in held)
