"""Streams that publish tables per micro-batch: dataset recording, forks and live roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.guards import LimitError, require_between, strict_bool
from plumbline.sources import committed, datasets
from plumbline.streaming import history
from plumbline.streaming.runs import run_batches


def dataset_record(stream: DataFrame, path: str, *order: Column | str, folder: str | None = None) -> str:
    """Record a stream into a dataset: each micro-batch becomes the generation of its batch id.

    A repeated batch replaces its own generation, so every event is stored once. What the stream begins with is the
    stream's choice: for datasets, see ``start`` of :func:`dataset_follow`.
    """

    def step(batch: DataFrame, batch_id: int, _: str) -> None:
        datasets.append(batch, path, batch_id, *order)

    run_batches(stream, "record", step, folder)
    return path


def dataset_follow(spark: SparkSession, path: str, start: str = "start", after: int | None = None) -> DataFrame:
    """Committed records of a dataset as a stream: ``generation``, ``ordinal`` and the fields.

    ``start="start"`` gives all generations, ``"next"`` only those committed from now on: the last commit is looked up when
    the stream is defined. To restart such a stream from its checkpoint, name that generation in ``after``. A generation
    without its manifest row is not seen, so neither are records whose writer failed before the commit.
    """
    if start not in ("start", "next"):
        raise LimitError("a stream begins at start or next")
    known = datasets.manifest(spark, path).agg(F.max("generation").alias("n")).first().n
    if known is None:
        raise LimitError("the dataset has no committed generation whose fields a stream could have")
    if after is None:
        after = known if start == "next" else committed.START
    schema = datasets.records(spark, path).schema
    return committed.follow(spark, path, schema, after)


def fork_stream(stream: DataFrame, branches: Mapping[str, Column], folder: str | None = None) -> dict[str, str]:
    """One input to several tables. The micro-batch is tagged once and written partitioned by branch and batch."""

    def step(batch: DataFrame, batch_id: int, where: str) -> None:
        taken = F.array_compact(F.array(*[F.when(strict_bool(p), F.lit(name)) for name, p in branches.items()]))
        tagged = batch.withColumn("branch", F.explode(taken))
        tagged.write.mode("overwrite").partitionBy("branch").parquet(f"{where}/batch={batch_id}")

    where = run_batches(stream, "fork", step, folder)
    return {name: f"{where}/batch=*/branch={name}" for name in branches}


def live_rollup(stream: DataFrame, seq: str, keep: int, rollup, folder: str | None = None) -> str:
    """Recompute ``rollup(recent)`` over the newest ``keep`` rows on every publication.

    The bounded history of one batch is read from the generation before it, which makes a repeated batch harmless.
    Returns the folder: ``history/generation=N`` and ``rollup/generation=N`` per batch.
    """
    require_between("keep", keep, 1, 100_000)

    def step(batch: DataFrame, batch_id: int, where: str) -> None:
        spark = batch.sparkSession
        known = batch
        if batch_id > 0:
            known = spark.read.schema(batch.schema).parquet(f"{where}/history/generation={batch_id - 1}").unionByName(batch)
        last = known.groupBy().agg(F.max(seq).alias("n")).scalar()
        recent = known.where(F.col(seq) > last - keep)
        recent.write.mode("overwrite").parquet(f"{where}/history/generation={batch_id}")
        stored = spark.read.schema(batch.schema).parquet(f"{where}/history/generation={batch_id}")
        rollup(stored).write.mode("overwrite").parquet(f"{where}/rollup/generation={batch_id}")

    return run_batches(stream, "rollup", step, folder)


def scan_records_batches(
    stream: DataFrame, keys: Sequence[str], order: str, value: str, folder: str | None = None
) -> str:
    """The scan of :func:`history.scan_records` over large micro-batches, parallel also inside a hot key.

    Each batch writes its outputs and the merged state as its own generation and starts from the state of the one
    before, so a repeated batch changes nothing. Returns the folder: ``outputs/generation=N`` and
    ``state/generation=N``. State is rewritten per batch; with many small keys :func:`stateful.scan_stream` touches
    less of it.
    """

    def step(batch: DataFrame, batch_id: int, where: str) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{where}/state/generation={batch_id - 1}") if batch_id > 0 else None
        outputs = history.scan_records(batch, keys, order, value, before)
        outputs.write.mode("overwrite").parquet(f"{where}/outputs/generation={batch_id}")
        state = history.record_state(batch, keys, value, before)
        state.write.mode("overwrite").parquet(f"{where}/state/generation={batch_id}")

    return run_batches(stream, "scan", step, folder)


def latest_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The roll-up of the last completed publication."""
    table = spark.read.option("basePath", f"{folder}/rollup").parquet(f"{folder}/rollup/generation=*")
    last = table.groupBy().agg(F.max("generation").alias("n")).scalar()
    return table.where(F.col("generation") == last).drop("generation")
