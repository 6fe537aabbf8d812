"""General folds and scans against a plain loop: hot keys, chunk borders, refusals, restarts and the end of a key."""

import random

import pytest
from helpers import fails, rows
from pyspark.sql import functions as F

from plumbline.operators import folds, summaries
from plumbline.plans import folds as plans
from plumbline.session import run_folder
from plumbline.streaming import history, runs, scans

CAP = plans.CAP


@pytest.fixture(scope="module")
def steps(spark):
    draw = random.Random(3)
    data = []
    for key, n in (("hot", 700), ("few", 5), (None, 90), ("one", 1)):
        at = 0
        for _ in range(n):
            at += draw.choice([1, 1, 2, 9])
            data.append((key, at, draw.choice(["purchase", "error"]), draw.randrange(40)))
    return spark.createDataFrame(data, "key string, at bigint, event_type string, k bigint").repartition(5).cache()


def plain(table, low=None):
    """Outputs and states of the level fold, row by row."""
    outputs, states = [], {}
    for r in sorted(table.collect(), key=lambda r: (str(r.key), r.at)):
        level, position, n, emitted = states.get(r.key, (0, None, 0, 0))
        level = max(0, min(CAP, level + (r.k if r.event_type == "purchase" else -7)))
        alarm = level in (0, CAP)
        if alarm:
            outputs.append((r.key, r.at, 0, ("empty" if level == 0 else "full", level)))
        states[r.key] = (level, r.at, n + 1, emitted + alarm)
    return sorted(outputs, key=repr), sorted(((k, (s[0],), *s[1:]) for k, s in states.items()), key=repr)


def found(scanned):
    outputs = [(r.key, r.at, r["index"], tuple(r.value)) for r in scanned.outputs.collect()]
    states = [(r.key, tuple(r.state), r.position, r.records, r.emitted) for r in scanned.states.collect()]
    return sorted(outputs, key=repr), sorted(states, key=repr)


@pytest.mark.parametrize("span", [folds.SPAN, 64, 8, 3])
def test_scan_is_independent_of_chunks(steps, span):
    scanned = scans.scan(steps, ["key"], "at", plans.level_fold(), plans.level_context(), span=span)
    assert found(scanned) == plain(steps)


def test_scan_continues_from_its_checkpoint(steps):
    fold, context = plans.level_fold(), plans.level_context()
    first = scans.scan(steps.where("at <= 300"), ["key"], "at", fold, context, span=16)
    again = scans.scan(steps, ["key"], "at", fold, context, before=first.states, span=16)  # the first rows are given again
    outputs = found(first)[0] + found(again)[0]
    assert (sorted(outputs, key=repr), found(again)[1]) == plain(steps)
    nothing = scans.scan(steps, ["key"], "at", fold, context, before=again.states)
    assert found(nothing) == ([], plain(steps)[1])


def test_end_and_receipts(steps):
    fold, context = plans.level_fold(), plans.level_context()
    states = scans.scan(steps, ["key"], "at", fold, context).states
    ended = {r.key: tuple(r.value) for r in scans.finish(states, ["key"], fold, context, scans.SELECTED_RANGE).collect()}
    assert ended == {k: ("selected_range", s[0] * 1000 + n) for k, s, _, n, _ in plain(steps)[1]}
    receipt = {r.key: (r.status, r.position, r.records, r.emitted, r.finish_applied) for r in scans.receipts(states, ["key"], True).collect()}
    assert receipt == {k: ("complete", at, n, e, True) for k, _, at, n, e in plain(steps)[1]}
    without = folds.Fold(fold.initial, fold.step, fold.outputs)
    assert scans.finish(states, ["key"], without, context).count() == 0


def test_large_keys_need_a_merge(steps):
    fold = plans.level_fold()
    alone = folds.Fold(fold.initial, fold.step, fold.outputs)
    assert found(scans.scan(steps, ["key"], "at", alone, plans.level_context())) == plain(steps)
    with pytest.raises(folds.FoldRefused, match="700 rows"):
        scans.scan(steps, ["key"], "at", alone, plans.level_context(), sequential_rows=600)
    with pytest.raises(folds.FoldRefused):
        folds.reduce_rows(steps, ["key"], "at", F.lit(0).cast("bigint"), lambda a, x: a - x["k"], sequential_rows=600)


def test_a_wrong_merge_fails(steps):
    fold = plans.level_fold()
    merge = folds.Merge(fold.merge.lift, lambda a, b: F.struct((a["add"] + b["add"]).alias("add"), b["low"].alias("low"), b["high"].alias("high")), fold.merge.apply)
    wrong = folds.Fold(fold.initial, fold.step, fold.outputs, merge=merge)
    for span in (folds.SPAN, 16):
        with pytest.raises(Exception, match=folds.DISAGREES):
            scans.scan(steps, ["key"], "at", wrong, plans.level_context(), span=span)
    minus = lambda a, b: a - b
    fails(summaries.ordered_reduce(steps, ["key"], "at", F.col("k"), F.lit(0).cast("bigint"), minus), folds.DISAGREES)


def test_reduce_with_unlike_types(spark, steps):
    expected = {}
    for r in sorted(steps.collect(), key=lambda r: r.at):
        expected[r.key] = (expected.get(r.key, 17) * 31 + r.k) % plans._MOD
    step = lambda a, x: (a * 31 + x["k"]) % plans._MOD
    start = F.lit(17).cast("bigint")
    for merge, span in ((None, folds.SPAN), (plans._affine(), folds.SPAN), (plans._affine(), 4)):
        got = folds.reduce_rows(steps, ["key"], "at", start, step, merge, span=span)
        assert {r.key: r.result for r in got.collect()} == expected
    wide = steps.withColumn("at", F.col("at") * 1_000_000_007)  # far more order values than rows
    got = folds.reduce_rows(wide, ["key"], "at", start, step, plans._affine(), span=8)
    assert {r.key: r.result for r in got.collect()} == expected
    assert folds.reduce_rows(steps.where("false"), ["key"], "at", start, step, plans._affine()).count() == 0


def test_chunks_are_wide_where_orders_are_sparse(steps):
    sparse = steps.withColumn("at", F.col("at") * 1_000_000)
    width = folds.chunk_width(sparse, ["key"], "at", 16)
    most = sparse.groupBy("key", F.floor(F.col("at") / width)).count().agg(F.max("count")).first()[0]
    assert width > 1_000_000 and 1 < most <= 16


def test_batches_equal_one_scan_after_a_restart(spark, steps):
    source, folder = run_folder(spark, "test"), run_folder(spark, "test")
    fold, context = plans.level_fold(), plans.level_context()
    for low, high in ((0, 100), (100, 900), (900, 10_000)):  # a restart per load
        steps.where((F.col("at") > low) & (F.col("at") <= high)).coalesce(1).write.mode("append").parquet(source)
        scans.scan_batches(runs.file_stream(spark, source, steps.schema), ["key"], "at", fold, context, folder, span=16)
        assert found(scans.batch_results(spark, folder, ["key"])) == plain(steps.where(F.col("at") <= high))


def test_bounds_continue_for_null_keys(spark):
    data = [(k, i, 1) for k in (None, 7) for i in range(10)]
    df = spark.createDataFrame(data, "key int, at bigint, size int")
    charge = F.lit(False)
    _, receipts = history.scan_bounds(df, ["key"], "at", "size", charge, {"input_records": 2})
    _, more = history.scan_continue(df, ["key"], "at", "size", charge, receipts, {"input_records": 4})
    assert rows(more, "key", "position", "input_records", "status") == [(7, 3, 4, "stopped"), (None, 3, 4, "stopped")]
