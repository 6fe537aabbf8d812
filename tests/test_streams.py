"""Streams equal their batch twins, over several micro-batches and across restarts."""

import pytest
from helpers import fails, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans import streams as plans
from plumbline.plans.common import events
from plumbline.plans.ordered import deliveries
from plumbline.session import run_folder
from plumbline.sources import datasets
from plumbline.streaming import history, publish, runs, stateful, stateless


def write_parts(df, order, folder, parts, start=0):
    """Several files, each later in order than the one before."""
    total = df.count()
    for i in range(start, parts):
        low, high = total * i // parts, total * (i + 1) // parts
        part = df.where((F.col(order) >= low) & (F.col(order) < high))
        part.coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def numbered(spark, sf):
    return deliveries(spark, sf).cache()


def stream_of(spark, folder, df):
    return runs.file_stream(spark, folder, df.schema, batch_bytes=1)  # one file per micro-batch


def test_accumulation_over_micro_batches(spark, numbered):
    folder = run_folder(spark, "test")
    write_parts(numbered, "event_id", folder, 4)
    for overflow in ("drop-oldest", "error"):
        stream = stateful.accumulate_stream(stream_of(spark, folder, numbered), ["user_id"], "event_id", "seq", "cents", 7, overflow)
        seen = runs.run_to_table(stream, "test")
        assert seen.count() > seen.select("user_id").distinct().count()
        state = F.struct("items", "sequence", "dropped", "total", "error")
        last = seen.groupBy("user_id").agg(F.max_by(state, "at").alias("s")).select("user_id", "s.*")
        twin = history.accumulate(numbered, ["user_id"], "event_id", "seq", "cents", 7, overflow)
        assert rows(last) == rows(twin, *last.columns)


def test_rolling_window_over_micro_batches(spark, numbered):
    folder = run_folder(spark, "test")
    write_parts(numbered, "event_id", folder, 3)
    sized = lambda df: df.select("user_id", "event_id", (F.col("cents") % 40).alias("size"))
    stream = stateful.rolling_window_stream(sized(stream_of(spark, folder, numbered)), ["user_id"], "event_id", "size", 6, 35)
    seen = runs.run_to_table(stream, "test")
    state = F.struct(*[c for c in seen.columns if c != "user_id"])
    last = seen.groupBy("user_id").agg(F.max_by(state, F.col("kept") + F.col("omitted") + F.col("rejected")).alias("s")).select("user_id", "s.*")
    twin = history.rolling_window(sized(numbered), ["user_id"], "event_id", "size", 6, 35)
    assert rows(last) == rows(twin, *last.columns)


def test_scan_restarts_from_its_checkpoint(spark, sf):
    df = events(spark, sf).select("event_id", "user_id", "cents").cache()
    source, folder = run_folder(spark, "test"), run_folder(spark, "test")
    outputs = T.StructType([T.StructField(n, T.LongType()) for n in ("event_id", "cents", "count", "sum")])

    def run():
        stream = stateful.scan_stream(
            stream_of(spark, source, df), ["user_id"], "event_id", plans._record_step, (0, 0, -1), "count bigint, sum bigint, peak bigint", outputs
        )
        return runs.run_to_table(stream, "test", folder)

    total = df.count()
    df.where(F.col("event_id") < total // 2).coalesce(1).write.parquet(source)
    half = run().count()
    df.where(F.col("event_id") >= total // 2).coalesce(1).write.mode("append").parquet(source)
    found = run()
    assert found.count() > half
    twin = history.scan_records(df, ["user_id"], "event_id", "cents")
    assert rows(found) == rows(twin, *found.columns)


def test_scan_by_batches_equals_one_scan(spark, sf):
    df = events(spark, sf).select("event_id", "user_id", "cents").cache()
    folder = run_folder(spark, "test")
    write_parts(df, "event_id", folder, 3)
    where = publish.scan_records_batches(stream_of(spark, folder, df), ["user_id"], "event_id", "cents")
    assert len(spark.read.parquet(f"{where}/state").select("generation").distinct().collect()) == 3
    twin = history.scan_records(df, ["user_id"], "event_id", "cents")
    assert rows(spark.read.parquet(f"{where}/outputs/generation=*"), *twin.columns) == rows(twin)
    state = spark.read.parquet(f"{where}/state/generation=2")
    assert rows(state) == rows(history.record_state(df, ["user_id"], "cents"), *state.columns)


def test_limits_hold_across_restarts(spark):
    df = spark.range(1, 21).select(F.col("id").alias("seq"))
    source, folder = run_folder(spark, "test"), run_folder(spark, "test")
    for part in (df.where("seq <= 6"), df.where("seq > 6")):
        part.coalesce(1).write.mode("append").parquet(source)
        kept = stateless.stream_limit(stateless.stream_skip(stream_of(spark, source, df), 3, "seq"), 9, "seq")
        found = runs.run_to_table(kept, "test", folder)
    assert sorted(r.seq for r in found.collect()) == list(range(4, 10))


def test_missing_fields_fail(spark):
    df = spark.createDataFrame([("a",), (None,)], "kind string")
    fails(stateless.stream_filter(df, "kind", "a"), "event has no kind")
    with pytest.raises(TypeError):
        stateless.stream_filter(df, "absent", "a")


def test_recording_and_following(spark):
    df = spark.range(100).select(F.col("id").alias("n"), (F.col("id") * 3).alias("v"))
    source, path, folder = (run_folder(spark, "test") for _ in range(3))
    followed = run_folder(spark, "test")
    for low, high in ((0, 40), (40, 100)):
        df.where(F.col("n").between(low, high - 1)).coalesce(1).write.mode("append").parquet(source)
        publish.dataset_record(stream_of(spark, source, df), path, "n", folder=folder)
        seen = runs.run_to_table(publish.dataset_follow(spark, path).select("ordinal", "n"), "test", followed)
        assert sorted(r.n for r in seen.collect()) == list(range(high))
    assert all(r.ordinal == r.n for r in datasets.records(spark, path).collect())
    assert datasets.inspect(spark, path).first().generations == 2


def test_repeating_a_generation_changes_nothing(spark):
    path = run_folder(spark, "test")
    df = spark.range(30).select(F.col("id").alias("n"))
    datasets.append(df.where("n < 10"), path, 0, "n")
    datasets.append(df.where("n >= 10"), path, 1, "n")
    anchor = datasets.prefix_digest(spark, path, 1)
    datasets.append(df.where("n >= 10"), path, 1, "n")
    assert datasets.prefix_digest(spark, path, 1) == anchor
    assert datasets.snapshot(spark, path, 1, anchor).count() == 30
    assert all(r.intact for r in datasets.verify(spark, path).collect())
    datasets.append(df.where("n >= 12"), path, 1, "n")
    with pytest.raises(ValueError):
        datasets.snapshot(spark, path, 1, anchor)
    assert datasets.snapshot(spark, path, 0, datasets.prefix_digest(spark, path, 0)).count() == 10
    with pytest.raises(TypeError):
        datasets.append(df.select(F.col("n").cast("string").alias("n")), path, 2, "n")


def test_pages(spark):
    path = run_folder(spark, "test")
    datasets.append(spark.range(60), path, 0, "id")
    last = datasets.page(spark, path, 50, 100)
    assert last.count() == 10 and last.first().extent_exhausted and last.first().next == 60
    assert datasets.page(spark, path).count() == 50
    assert datasets.page(spark, path, 60).count() == 0
    with pytest.raises(ValueError):
        datasets.page(spark, path, 61)


def test_fork_and_rollup_over_batches(spark, sf):
    df = events(spark, sf).select("event_id", "event_type", "cents").cache()
    folder = run_folder(spark, "test")
    write_parts(df, "event_id", folder, 3)
    paths = publish.fork_stream(stream_of(spark, folder, df), {"big": F.col("cents") > 3000, "all": F.lit(True)})
    assert spark.read.parquet(paths["all"]).count() == df.count()
    assert spark.read.parquet(paths["big"]).count() == df.where("cents > 3000").count()
    where = publish.live_rollup(stream_of(spark, folder, df), "event_id", 20, plans.health_of)
    last = df.agg(F.max("event_id")).first()[0]
    assert rows(publish.latest_rollup(spark, where)) == rows(plans.health_of(df.where(F.col("event_id") > last - 20)))


def test_only_committed_generations_are_read(spark, tmp_path):
    path = str(tmp_path / "d")
    datasets.append(spark.range(10), path, 0, "id")
    anchor = datasets.prefix_digest(spark, path, 0)
    spark.range(10, 20).withColumn("ordinal", F.col("id")).write.parquet(f"{path}/records/generation=1")  # no manifest row
    assert datasets.records(spark, path).count() == 10
    assert datasets.snapshot(spark, path, 5, anchor).count() == 10
    datasets.append(spark.range(10, 15), path, 1, "id")
    assert datasets.records(spark, path).count() == 15
    with pytest.raises(ValueError, match="only the last generation"):
        datasets.append(spark.range(5), path, 0, "id")


def test_histories_with_items_and_epochs(spark):
    data = [("a", 1, 1, "x", "r1"), ("a", 2, 2, "y", "r1"), ("a", 3, 2, "y", "r1"), ("a", 4, 3, "z", "r1"), ("a", 5, 4, "w", "r2"),
            ("b", 1, 2, "x", "r1"), (None, 1, 1, "n", None)]
    df = spark.createDataFrame(data, "k string, at bigint, seq bigint, item string, epoch string")
    for hot_rows in (2, 100):
        got = {r.k: r for r in history.accumulation(df, ["k"], "at", "seq", "item", 2, "drop-oldest", "epoch", hot_rows).collect()}
        assert got["a"]["items"] == ["y", "z"] and got["a"].error == "ACC005"
        assert tuple(got["a"].checkpoint) == (1, "r1", 3, 2, "drop-oldest", 1)
        assert got["b"]["items"] == [] and got["b"].checkpoint is None and got["b"].error == "ACC006"
        assert got[None]["items"] == ["n"] and got[None].error is None


def test_window_items_over_micro_batches_and_a_restart(spark, numbered):
    source, folder = run_folder(spark, "test"), run_folder(spark, "test")
    item = F.when(F.col("cents") % 5 > 0, F.concat(F.lit("é"), F.col("cents").cast("string"))).alias("item")
    sized = lambda df: df.select("user_id", "event_id", (F.col("cents") % 40).alias("size"), item)
    for start in (0, 2):  # two files, then a restart with two more
        write_parts(numbered, "event_id", source, 2 + start, start)
        stream = stateful.rolling_window_stream(sized(stream_of(spark, source, numbered)), ["user_id"], "event_id", "size", 6, 35, item="item")
        seen = runs.run_to_table(stream, "test", folder)
    state = F.struct("kept", "first_seq", "kept_bytes", "window")
    last = seen.groupBy("user_id").agg(F.max_by(state, F.col("kept") + F.col("omitted") + F.col("rejected")).alias("s")).select("user_id", "s.*")
    given = spark.read.parquet(source)
    twin = history.rolling_window(sized(given), ["user_id"], "event_id", "size", 6, 35, item="item")
    assert rows(last) == rows(twin, *last.columns)
    plain = {}
    for r in sorted(sized(given).collect(), key=lambda r: r.event_id):
        held = plain.setdefault(r.user_id, [])
        if r["size"] <= 35:
            held.append(r)
        while len(held) > 6 or sum(h["size"] for h in held) > 35:
            held.pop(0)
    assert {r.user_id: r.window for r in last.collect()} == {u: [h.item for h in held] for u, held in plain.items()}
    hot = history.rolling_window(sized(given), ["user_id"], "event_id", "size", 6, 35, hot_rows=20, item="item")
    assert rows(hot) == rows(twin)


@pytest.mark.parametrize("overflow", ["drop-oldest", "error"])
def test_accumulation_items_over_micro_batches_and_a_restart(spark, numbered, overflow):
    deliveries_ = numbered.withColumn("epoch", F.when(F.col("event_id") < 230, "one").otherwise("two")).withColumn("item", F.concat(F.lit("i"), F.col("cents").cast("string")))
    deliveries_ = deliveries_.where("user_id % 3 > 0 OR event_id < 230")
    source, folder = run_folder(spark, "test"), run_folder(spark, "test")
    early, later = deliveries_.where("event_id < 200"), deliveries_.where("event_id >= 200").cache()
    arguments = (["user_id"], "event_id", "seq", "item", 7, overflow)
    restored = history.accumulation(early, *arguments, epoch="epoch")
    for low, high in ((200, 500), (500, 10_000)):
        later.where((F.col("event_id") >= low) & (F.col("event_id") < high)).repartition(2).write.mode("append").parquet(source)
        stream = stateful.accumulation_stream(runs.file_stream(spark, source, later.schema), *arguments, "epoch", restored)
        seen = runs.run_to_table(stream, "test", folder)
    state = F.struct("items", "checkpoint", "error")
    last = seen.groupBy("user_id").agg(F.max_by(state, "at").alias("s")).select("user_id", "s.*")
    twin = history.accumulation(deliveries_, *arguments, epoch="epoch").join(last, "user_id", "left_semi")
    assert rows(last) == rows(twin, *last.columns)
    assert "ACC005" in {r.error for r in last.collect()} or overflow == "error"
