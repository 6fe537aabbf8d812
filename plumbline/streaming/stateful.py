"""Keyed stateful stream operators on ``transformWithStateInPandas``.

State is kept per source key in RocksDB. Rows of one key and micro-batch are put into order before they are applied;
how many that can be is bounded by the files admitted per micro-batch, and what stays in state is bounded by the
operator (a window, a limit, or a fixed-size fold state).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from plumbline.guards import LimitError, require_between

MAX_WINDOW_ITEMS = 10_000
MAX_WINDOW_BYTES = 64 * 1024 * 1024
MAX_ACCUMULATED = 100_000

WINDOW_SCHEMA = (
    "kept bigint, omitted bigint, rejected bigint, first_seq bigint, last_seq bigint, kept_bytes bigint"
)
ACCUMULATION_SCHEMA = "items bigint, sequence bigint, dropped bigint, total bigint, error string, at bigint"


def _ordered(frames: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")


class RollingWindowProcessor(StatefulProcessor):
    """Newest items of a source within an item and a byte bound; counts what was omitted or too large.

    State holds the window's items in order and nothing older: each arrival evicts by count and by bytes.
    """

    def __init__(self, seq: str, size: str, items: int, size_limit: int, item: str | None = None, item_type: str = "") -> None:
        self._seq, self._size, self._items, self._bytes = seq, size, items, size_limit
        self._item, self._type = item, item_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._window = handle.getListState("window", "seq bigint, size bigint" + (f", item {self._type}" if self._item else ""))
        self._counts = handle.getValueState("counts", "accepted bigint, rejected bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        accepted, rejected = self._counts.get() or (0, 0)
        held = [tuple(row) for row in self._window.get()] if self._window.exists() else []
        for frame in rows:
            values = frame[self._item].tolist() if self._item else ()
            arrived = list(zip(frame[self._seq].tolist(), frame[self._size].tolist(), *([values] if self._item else [])))
            fits = [row for row in arrived if row[1] <= self._bytes]
            accepted, rejected = accepted + len(fits), rejected + len(arrived) - len(fits)
            held = self._trim(held + fits)
        self._counts.update((int(accepted), int(rejected)))
        if held:
            self._window.put([(int(s), int(b), *rest) for s, b, *rest in held])
        yield pd.DataFrame(
            {
                **{f"key{i}": [value] for i, value in enumerate(key)},
                "kept": [len(held)],
                "omitted": [accepted - len(held)],
                "rejected": [rejected],
                "first_seq": pd.array([held[0][0] if held else None], dtype="Int64"),
                "last_seq": pd.array([held[-1][0] if held else None], dtype="Int64"),
                "kept_bytes": [int(sum(row[1] for row in held))],
                **({"window": [[row[2] for row in held]]} if self._item else {}),
            }
        )

    def _trim(self, rows: list[tuple]) -> list[tuple]:
        """The longest newest run within both bounds, oldest first."""
        rows.sort(key=lambda row: row[0])
        newest, total = rows[-self._items :], 0
        for at in range(len(newest) - 1, -1, -1):
            total += newest[at][1]
            if total > self._bytes:
                return newest[at + 1 :]
        return newest

    def close(self) -> None:
        pass


class AccumulateProcessor(StatefulProcessor):
    """Ordered history of a source with a checkpoint. The first irregular delivery ends it with an error code."""

    def __init__(self, arrival: str, seq: str, item: str, limit: int, drop_oldest: bool) -> None:
        self._arrival, self._seq, self._item = arrival, seq, item
        self._limit, self._drop_oldest = limit, drop_oldest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._history = handle.getListState("items", "item bigint")
        self._checkpoint = handle.getValueState("checkpoint", "sequence bigint, dropped bigint, error string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, dropped, error = self._checkpoint.get() or (0, 0, None)
        items = [row[0] for row in self._history.get()] if self._history.exists() else []
        arrived = _ordered(rows, self._arrival)
        sequence, item = arrived[self._seq].to_numpy(), arrived[self._item].to_numpy()
        if error is None:
            before = np.concatenate(([seen], sequence[:-1]))
            step = sequence - before
            # a repeat is harmless once something was accepted; any other step but one ends the history
            irregular = (step != 1) & ~((step == 0) & (before > 0))
            full = (sequence > self._limit) & (not self._drop_oldest)
            stops = np.flatnonzero(irregular | full)
            end = stops[0] if len(stops) else len(sequence)
            if len(stops):
                error = "ACC004" if not irregular[end] else "ACC003" if before[end] > 0 else "ACC006"
            accepted = step[:end] == 1
            if accepted.any():
                seen = int(sequence[:end][accepted][-1])
                items = [*items, *item[:end][accepted].tolist()][-self._limit :]
            dropped = seen - len(items)
        self._checkpoint.update((int(seen), int(dropped), error))
        if items:
            self._history.put([(int(i),) for i in items])
        yield pd.DataFrame(
            {
                **{f"key{i}": [value] for i, value in enumerate(key)},
                "items": [len(items)],
                "sequence": [seen],
                "dropped": [dropped],
                "total": [int(sum(items))],
                "error": [error],
                "at": [int(arrived[self._arrival].max())],
            }
        )

    def close(self) -> None:
        pass


class AccumulationProcessor(StatefulProcessor):
    """The history itself: items of any kind in list state, one list per source, under one epoch, with a full checkpoint.

    The first irregular delivery ends it: ACC005 another epoch, ACC006 nothing accepted yet, ACC003 a gap or backward step,
    ACC004 beyond the limit. A history can be restored: its items and checkpoint are then the state before the first row.
    """

    def __init__(self, arrival: str, seq: str, item: str, limit: int, drop_oldest: bool, epoch: str | None, item_type: str) -> None:
        self._arrival, self._seq, self._item, self._epoch = arrival, seq, item, epoch
        self._limit, self._drop_oldest, self._type = limit, drop_oldest, item_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._history = handle.getListState("items", f"item {self._type}")
        self._checkpoint = handle.getValueState("checkpoint", "sequence bigint, epoch string, error string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        sequence = None if pd.isna(row["sequence"]) else int(row["sequence"])
        self._checkpoint.update((sequence or 0, row["epoch"], row["error"]))
        if row["items"] is not None and len(row["items"]):
            self._history.put([(i,) for i in row["items"]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, run, error = self._checkpoint.get() or (0, None, None)
        items = [row[0] for row in self._history.get()] if self._history.exists() else []
        arrived = _ordered(rows, self._arrival)
        epochs = [None if pd.isna(e) else str(e) for e in arrived[self._epoch].tolist()] if self._epoch else [None] * len(arrived)
        fresh = []
        for sequence, item, epoch in zip(arrived[self._seq].tolist(), arrived[self._item].tolist(), epochs):
            if error is None:
                error = self._verdict(seen, run, sequence, epoch)
            if error is None and sequence != seen:
                fresh.append(item)
                seen, run = sequence, epoch
        items = [*items, *fresh][-self._limit :]
        self._checkpoint.update((int(seen), run, error))
        if fresh:
            self._history.put([(i,) for i in items])
        yield pd.DataFrame(
            {
                **{f"key{i}": [value] for i, value in enumerate(key)},
                "items": [items],
                "epoch": [run],
                "sequence": pd.array([seen or None], dtype="Int64"),
                "dropped": pd.array([seen - len(items) if seen else None], dtype="Int64"),
                "error": [error],
                "at": [int(arrived[self._arrival].max())],
            }
        )

    def _verdict(self, seen: int, run: str | None, sequence: int, epoch: str | None) -> str | None:
        if seen and run != epoch:
            return "ACC005"
        if not seen:
            return None if sequence == 1 else "ACC006"
        if sequence - seen not in (0, 1):
            return "ACC003"
        return "ACC004" if sequence > self._limit and not self._drop_oldest else None

    def close(self) -> None:
        pass


class FoldProcessor(StatefulProcessor):
    """``step(state, frame) -> (state, outputs)`` over the ordered rows of a key.

    ``state`` is a tuple, ``frame`` the key's rows of one micro-batch in order, ``outputs`` a frame.
    """

    def __init__(self, order: str, step: Callable, initial: tuple, state_schema: str, outputs: Sequence[str]) -> None:
        self._order, self._step, self._initial = order, step, initial
        self._schema, self._outputs = state_schema, list(outputs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", self._schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, outputs = self._step(self._state.get() or self._initial, _ordered(rows, self._order))
        self._state.update(state)
        frame = outputs[self._outputs].reset_index(drop=True)
        for i, value in enumerate(key):
            frame.insert(i, f"key{i}", value)
        yield frame

    def close(self) -> None:
        pass


def _transform(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str, mode: str, initial: DataFrame | None = None) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    key_schema = ", ".join(f"key{i} {types[k]}" for i, k in enumerate(keys))
    result = df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=f"{key_schema}, {schema}",
        outputMode=mode,
        timeMode="None",
        initialState=None if initial is None else initial.groupBy(*keys),
    )
    return result.withColumnsRenamed({f"key{i}": k for i, k in enumerate(keys)})


def rolling_window_stream(
    df: DataFrame, keys: Sequence[str], seq: str, size: str, items: int, size_limit: int = MAX_WINDOW_BYTES, item: str | None = None
) -> DataFrame:
    """Window summary per source after each micro-batch that touched it; with ``item`` the window's items in order."""
    require_between("items", items, 1, MAX_WINDOW_ITEMS)
    require_between("size_limit", size_limit, 1, MAX_WINDOW_BYTES)
    kind = df.schema[item].dataType.simpleString() if item else ""
    processor = RollingWindowProcessor(seq, size, items, size_limit, item, kind)
    schema = WINDOW_SCHEMA + (f", window array<{kind}>" if item else "")
    return _transform(df.select(*dict.fromkeys([*keys, seq, size, *([item] if item else [])])), keys, processor, schema, "append")


def accumulation_stream(
    df: DataFrame,
    keys: Sequence[str],
    arrival: str,
    seq: str,
    item: str,
    limit: int,
    overflow: str = "error",
    epoch: str | None = None,
    restored: DataFrame | None = None,
) -> DataFrame:
    """The history per source after each micro-batch that touched it: ``items`` in order, ``checkpoint`` (version, epoch,
    sequence, limit, overflow, dropped; null where nothing was accepted), ``error`` and ``at``, the last arrival.

    ``restored`` is the result of :func:`history.accumulation` over earlier deliveries: histories go on from there. Sources
    without deliveries in this stream give no row.
    """
    require_between("limit", limit, 1, MAX_ACCUMULATED)
    if overflow not in ("error", "drop-oldest"):
        raise LimitError("overflow must be error or drop-oldest")
    kind = df.schema[item].dataType.simpleString()
    processor = AccumulationProcessor(arrival, seq, item, limit, overflow == "drop-oldest", epoch, kind)
    columns = list(dict.fromkeys([*keys, arrival, seq, item, *([epoch] if epoch else [])]))
    schema = f"items array<{kind}>, epoch string, sequence bigint, dropped bigint, error string, at bigint"
    before = None if restored is None else restored.select(*keys, "items", "checkpoint.epoch", "checkpoint.sequence", "error")
    found = _transform(df.select(*columns), keys, processor, schema, "append", before)
    checkpoint = F.struct(F.lit(1).alias("version"), "epoch", "sequence", F.lit(limit).alias("limit"), F.lit(overflow).alias("overflow"), "dropped")
    return found.select(*keys, "items", F.when(F.col("sequence").isNotNull(), checkpoint).alias("checkpoint"), "error", "at")


def accumulate_stream(
    df: DataFrame, keys: Sequence[str], arrival: str, seq: str, item: str, limit: int, overflow: str = "error"
) -> DataFrame:
    """Checkpoint and history totals per source after each micro-batch that touched it."""
    require_between("limit", limit, 1, MAX_ACCUMULATED)
    if overflow not in ("error", "drop-oldest"):
        raise LimitError("overflow must be error or drop-oldest")
    processor = AccumulateProcessor(arrival, seq, item, limit, overflow == "drop-oldest")
    columns = list(dict.fromkeys([*keys, arrival, seq, item]))
    return _transform(df.select(*columns), keys, processor, ACCUMULATION_SCHEMA, "append")


def scan_stream(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    step: Callable,
    initial: tuple,
    state_schema: str,
    output_schema: StructType,
) -> DataFrame:
    """Checkpointed fold per key that emits ``step``'s outputs; the state has a fixed schema.

    ``step`` sees the ordered rows of a key and micro-batch as one frame and works on whole columns.
    """
    processor = FoldProcessor(order, step, initial, state_schema, output_schema.fieldNames())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in output_schema)
    return _transform(df, keys, processor, fields, "append")
