"""General scans: a user's step with state, context, outputs and a finish, over tables, streams and restarts.

``fold_rows`` does the work; here its result becomes outputs, a checkpoint per key, and the rows of the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from plumbline.operators.folds import SEQUENTIAL_ROWS, SPAN, Fold, fold_rows
from plumbline.operators.ordered import match_keys
from plumbline.session import run_folder
from plumbline.streaming.runs import run_batches

# How a scan may end.
NATURAL_END, SELECTED_RANGE = "natural_end", "selected_range"


@dataclass(frozen=True)
class Scanned:
    """``outputs(keys, at, index, value)`` and the checkpoint ``states(keys, state, position, records, emitted)``."""

    outputs: DataFrame
    states: DataFrame


def _outputs(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return folded.select(*keys, F.explode("outputs").alias("_o")).select(*keys, "_o.at", "_o.index", "_o.value")


def _states(folded: DataFrame, keys: Sequence[str], before: DataFrame | None) -> DataFrame:
    """Checkpoints after these rows. Keys without new rows keep theirs; counts go on from before."""
    fresh = folded.groupBy(*keys).agg(
        F.max_by("state", "chunk").alias("state"),
        F.max("position").alias("position"),
        F.sum("records").alias("records"),
        F.sum(F.size("outputs")).cast("bigint").alias("emitted"),
    )
    if before is None:
        return fresh
    both = before.select(fresh.columns).withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(
        F.max_by("state", "_new").alias("state"), F.max("position").alias("position"), F.sum("records").alias("records"), F.sum("emitted").alias("emitted")
    )


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    fold: Fold,
    context: Column | None = None,
    before: DataFrame | None = None,
    folder: str | None = None,
    sequential_rows: int = SEQUENTIAL_ROWS,
    span: int = SPAN,
) -> Scanned:
    """Run a scan over a table. ``before`` is the checkpoint of earlier rows; rows at or before its position are left out,
    so giving the same rows again changes nothing.

    The fold runs once: its result is written to ``folder`` (a fresh one by default) and read for both tables.
    """
    if fold.outputs is None:
        raise ValueError("a scan needs the type of its outputs")
    if before is not None:
        seen = before.select(*keys, F.col("position").alias("_position"))
        known = match_keys(df, seen, keys, "left") if keys else df.crossJoin(F.broadcast(seen))
        df = known.where(F.col("_position").isNull() | (F.col(order) > F.col("_position"))).drop("_position")
    folded = fold_rows(df, keys, order, fold, context, before, sequential_rows, span)
    path = folder or run_folder(df.sparkSession, "scan")
    folded.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(folded.schema).parquet(path)
    return Scanned(_outputs(stored, keys), _states(stored, keys, before))


def finish(states: DataFrame, keys: Sequence[str], fold: Fold, context: Column | None = None, kind: str = NATURAL_END) -> DataFrame:
    """Outputs of the end of every key (``at`` is null), from its checkpoint. None if the fold has no finish."""
    end = F.struct(F.lit(kind).alias("kind"), "position", "records")
    if fold.finish is None:
        made = F.array()
    else:
        made = fold.finish(F.col("state"), F.lit(None) if context is None else context, end)
    rows = states.select(*keys, F.posexplode(made.cast(f"array<{fold.outputs}>")).alias("index", "value"))
    return rows.select(*keys, F.lit(None).cast("bigint").alias("at"), "index", "value")


def receipts(states: DataFrame, keys: Sequence[str], finished: bool) -> DataFrame:
    """One row per key: how far the scan came, what it read and gave, and whether the end was applied."""
    return states.select(*keys, F.lit("complete" if finished else "open").alias("status"), "position", "records", "emitted", F.lit(finished).alias("finish_applied"))


def scan_batches(
    stream: DataFrame,
    keys: Sequence[str],
    order: str,
    fold: Fold,
    context: Column | None = None,
    folder: str | None = None,
    sequential_rows: int = SEQUENTIAL_ROWS,
    span: int = SPAN,
) -> str:
    """The scan over a stream: each micro-batch is a scan that starts from the checkpoint of the one before.

    A hot key is split as in a table. Rows of a key must arrive in order over micro-batches. Returns the folder:
    ``folds/generation=N`` and ``states/generation=N``; a repeated batch replaces its own. Restart with the same folder.
    """

    def step(batch: DataFrame, batch_id: int, where: str) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{where}/states/generation={batch_id - 1}") if batch_id else None
        done = scan(batch, keys, order, fold, context, before, f"{where}/folds/generation={batch_id}", sequential_rows, span)
        done.states.write.mode("overwrite").parquet(f"{where}/states/generation={batch_id}")

    return run_batches(stream, "scan", step, folder)


def batch_results(spark: SparkSession, folder: str, keys: Sequence[str]) -> Scanned:
    """Outputs of all micro-batches so far and the checkpoint of the last one."""
    folded = spark.read.option("basePath", f"{folder}/folds").parquet(f"{folder}/folds/generation=*").drop("generation")
    states = spark.read.option("basePath", f"{folder}/states").parquet(f"{folder}/states/generation=*")
    last = states.groupBy().agg(F.max("generation").alias("n")).scalar()
    return Scanned(_outputs(folded, keys), states.where(F.col("generation") == last).drop("generation"))


class TimedFoldProcessor(StatefulProcessor):
    """A fold whose keys end when event time has passed their last row by a gap: a timer then runs ``finish``.

    ``step(state, frame) -> (state, frame)`` sees a key's new rows in order, ``finish(state) -> frame`` its last state.
    """

    def __init__(self, order: str, time: str, gap_ms: int, step: Callable, ending: Callable, initial: tuple, schema: str, outputs: list[str]) -> None:
        self._order, self._time, self._gap = order, time, gap_ms
        self._step, self._ending, self._initial = step, ending, initial
        self._schema, self._outputs = schema, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", self._schema)
        self._end = handle.getValueState("end", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self._order, kind="stable")
        state, outputs = self._step(self._state.get() or self._initial, frame)
        self._state.update(state)
        end = int(frame[self._time].max()) + self._gap
        known = self._end.get()
        if known is not None and known[0] < end:
            self._handle.deleteTimer(known[0])
        if known is None or known[0] < end:
            self._end.update((end,))
            self._handle.registerTimer(end)
        yield self._keyed(key, outputs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        outputs = self._ending(self._state.get())
        self._state.clear()
        self._end.clear()
        yield self._keyed(key, outputs)

    def _keyed(self, key, outputs: pd.DataFrame) -> pd.DataFrame:
        frame = outputs[self._outputs].reset_index(drop=True)
        for i, value in enumerate(key):
            frame.insert(i, f"key{i}", value)
        return frame

    def close(self) -> None:
        pass


def scan_timed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    time: str,
    lateness: str,
    gap_ms: int,
    step: Callable,
    ending: Callable,
    initial: tuple,
    state_schema: str,
    output_schema: StructType,
) -> DataFrame:
    """A stream's scan whose keys end by timer: ``gap_ms`` of event time after a key's last row, ``ending(state)`` gives the
    outputs of its end and the state is dropped. A later row of the key starts anew. ``lateness`` delays the watermark.

    Rows of a key and micro-batch are put in order in one Python worker, within the bytes that a micro-batch admits; where
    keys can be hot use :func:`scan_batches`.
    """
    millis = f"{time}_unix_millis"  # names that begin with an underscore do not reach the processor
    rows = df.withWatermark(time, lateness).withColumn(millis, F.unix_millis(time))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    processor = TimedFoldProcessor(order, millis, gap_ms, step, ending, initial, state_schema, output_schema.fieldNames())
    fields = [f"key{i} {types[k]}" for i, k in enumerate(keys)] + [f"{f.name} {f.dataType.simpleString()}" for f in output_schema]
    result = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=", ".join(fields), outputMode="append", timeMode="EventTime"
    )
    return result.withColumnsRenamed({f"key{i}": k for i, k in enumerate(keys)})
