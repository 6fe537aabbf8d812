"""Ordered folds: a user's step over the rows of each key in order, parallel inside a key where a merge is declared.

A fold is ``step(state, context, item) -> (state, outputs)``, all of it Column expressions, so it runs in the JVM. Alone it
is serial: the rows of a key meet in one task, and a key with more than ``sequential_rows`` rows is refused. A declared
:class:`Merge` describes what a run of items does to a state as data: ``lift`` makes such a transition summary of one item,
``compose`` joins two neighbouring ones, ``apply`` takes a state across one. With it rows are cut into chunks of their
order, chunks are summarised, summaries are composed level by level until one row per key is left, and the states at all
chunk starts come back down the same levels. Every group holds at most ``SPAN`` elements at every level, whatever a key
holds. Then each chunk runs the step itself from its own start.

A merge is checked on all rows: where the step leaves a chunk in another state than the chunk's summary does, the query
fails.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import let
from plumbline.guards import LimitError, refuse_when, require_columns, require_kind
from plumbline.operators.ordered import match_keys
from plumbline.session import reliable_checkpoint

SPAN = 1 << 12
SEQUENTIAL_ROWS = 1 << 18
DISAGREES = "the declared merge does not agree with the step"

Step = Callable[[Column, Column, Column], tuple[Column, Column | None]]


class FoldRefused(LimitError):
    """A key is too large for a fold without a declared merge."""


@dataclass(frozen=True)
class Merge:
    """Transition summaries: ``apply(s, compose(a, b))`` must equal ``apply(apply(s, a), b)``."""

    lift: Callable[[Column, Column], Column]  # (context, item) -> summary
    compose: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]  # (state, summary) -> state


@dataclass(frozen=True)
class Fold:
    """A step with its initial state; ``outputs`` is the type of one output, ``finish`` gives those of the end.

    ``finish(state, context, end)`` returns an array of outputs; ``end`` has ``kind``, ``position`` and ``records``.
    """

    initial: Column
    step: Step
    outputs: str | None = None
    finish: Callable[[Column, Column, Column], Column] | None = None
    merge: Merge | None = None


def _type(df: DataFrame, column: Column) -> str:
    """The expression's type with everything in it nullable, as a step may leave out what the initial state has."""
    return _ddl(df.select(column.alias("c")).schema[0].dataType)


def _run(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column | None]], state: str, output: str | None) -> Column:
    """``(state, outputs)`` after all items. Items go in slices of about the root of their number, as appending to an
    array copies it."""
    if output is None:
        last = F.aggregate(items, start.cast(state), lambda s, x: step(s, x)[0].cast(state))
        return F.struct(last.alias("state"))
    many = f"array<{output}>"

    def one(acc: Column, x: Column) -> Column:
        after, more = step(acc["state"], x)
        return F.struct(after.cast(state).alias("state"), F.concat(acc["outputs"], more.cast(many)).alias("outputs"))

    def inner(s: Column, slice_: Column) -> Column:
        return F.aggregate(slice_, F.struct(s.alias("state"), F.array().cast(many).alias("outputs")), one)

    def outer(acc: Column, slice_: Column) -> Column:
        joined = lambda r: F.struct(r["state"].alias("state"), F.concat(acc["lists"], F.array(r["outputs"])).alias("lists"))
        return let(inner(acc["state"], slice_), joined)

    def sliced(all_items: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(all_items).cast("double"))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), width)
        slices = F.transform(starts, lambda at: F.slice(all_items, at, width))
        begin = F.struct(start.cast(state).alias("state"), F.array().cast(f"array<{many}>").alias("lists"))
        return F.aggregate(slices, begin, outer)

    return let(let(items, sliced), lambda r: F.struct(r["state"].alias("state"), F.flatten(r["lists"]).alias("outputs")))


def _composed(parts: Column, merge: Merge, lift: Callable[[Column], Column], summary: str) -> Column:
    """Summaries of a non-empty ordered array joined into one."""
    first = lift(F.get(parts, F.lit(0))).cast(summary)
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), first, lambda a, x: merge.compose(a, lift(x)).cast(summary))


def _up(name: str, span: int) -> Column:
    """Number of the run of ``span`` numbers that holds ``name``."""
    at, width = F.col(name), F.lit(span).cast("bigint")
    return F.call_function("div", at - F.pmod(at, width), width)


def _sorted(at: Column, **fields: Column) -> Column:
    record = F.struct(at.alias("at"), *[c.alias(n) for n, c in fields.items()])
    return F.array_sort(F.collect_list(record))


def chunk_width(df: DataFrame, keys: Sequence[str], order: str, span: int) -> int:
    """Order values per chunk: as many as leave at most ``span`` rows in each, found by counting; at least ``span``."""
    width = span
    low, high = df.agg(F.min(order), F.max(order)).first()
    while low is not None and (high - low) // width > span:
        wider = width * 64
        counted = df.withColumn("_at", F.col(order).cast("bigint")).groupBy(*keys, _up("_at", wider).alias("_chunk")).agg(F.count(F.lit(1)).alias("n"))
        if counted.agg(F.max("n")).first()[0] > span:
            break
        width = wider
    return width


def _levels(summaries: DataFrame, keys: Sequence[str], merge: Merge, kind: str, span: int) -> list[DataFrame]:
    """Tables ``keys, at, summary``: chunk summaries, and the summaries of runs of them until all of a key are one run."""
    tables = [reliable_checkpoint(summaries)]
    while True:
        below = tables[-1]
        low, high = below.agg(F.min("at"), F.max("at")).first()
        if low is None or high - high % span == low - low % span:  # Python's remainders are never negative
            return tables
        grouped = below.groupBy(*keys, _up("at", span).alias("up")).agg(_sorted(F.col("at"), summary=F.col("summary")).alias("parts"))
        joined = _composed(F.col("parts"), merge, lambda p: p["summary"], kind)
        tables.append(reliable_checkpoint(grouped.select(*keys, F.col("up").alias("at"), joined.alias("summary"))))


def _chunk_starts(tables: list[DataFrame], keys: Sequence[str], merge: Merge, starts: DataFrame, state: str, span: int) -> DataFrame:
    """``keys, at, start``: the state before every chunk, from the states before the keys' first rows."""
    output = f"struct<at: bigint, start: {state}>"
    above = None
    for table in reversed(tables):
        grouped = table.groupBy(*keys, _up("at", span).alias("up")).agg(_sorted(F.col("at"), summary=F.col("summary")).alias("parts"))
        if above is None:
            begun = match_keys(grouped, starts, keys) if keys else grouped.crossJoin(F.broadcast(starts))
        else:
            begun = match_keys(grouped, above.withColumnRenamed("at", "up"), [*keys, "up"])
        walk = _run(F.col("parts"), F.col("start"), lambda s, p: (merge.apply(s, p["summary"]), F.array(F.struct(p["at"].alias("at"), s.alias("start")))), state, output)
        above = begun.select(*keys, F.explode(walk["outputs"]).alias("o")).select(*keys, "o.at", "o.start")
    return above


def _ddl(kind: T.DataType) -> str:
    """Type text without the cut that ``simpleString`` makes in long records."""
    if isinstance(kind, T.StructType):
        return f"struct<{', '.join(f'`{f.name}`: {_ddl(f.dataType)}' for f in kind.fields)}>"
    if isinstance(kind, T.ArrayType):
        return f"array<{_ddl(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{_ddl(kind.keyType)}, {_ddl(kind.valueType)}>"
    return kind.simpleString()


def fold_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    fold: Fold,
    context: Column | None = None,
    states: DataFrame | None = None,
    sequential_rows: int = SEQUENTIAL_ROWS,
    span: int = SPAN,
) -> DataFrame:
    """Run a fold: one row per key and chunk with ``keys, chunk, state, outputs, records, position``.

    ``order`` is an integer that is unique within its key. An item has all columns but the keys. ``context`` is a value every
    step sees. ``states(keys, state)`` holds what earlier rows left behind; other keys start from ``fold.initial``. Outputs
    name their source: ``at`` (the order value), ``index`` and ``value``. Null keys are keys; an empty table has no rows.
    """
    require_columns(df, [*keys, order])
    require_kind(df, order, "Int")
    context = F.lit(None) if context is None else context
    state = _type(df, fold.initial)
    fields = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, F.col(order).cast("bigint").alias("_at"), F.struct(*fields).alias("_item"))
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if fold.merge is None and largest > sequential_rows:
        raise FoldRefused(f"a key has {largest} rows: a fold without a declared merge is refused beyond {sequential_rows}")
    output = None if fold.outputs is None else f"struct<at: bigint, index: int, value: {fold.outputs}>"
    known = None if states is None else states.select(*keys, F.col("state").cast(state).alias("_known"))

    def with_start(table: DataFrame) -> DataFrame:
        if known is None:
            return table.withColumn("start", fold.initial.cast(state))
        joined = match_keys(table, known, keys, "left") if keys else table.crossJoin(F.broadcast(known))
        return joined.withColumn("start", F.coalesce("_known", fold.initial.cast(state))).drop("_known")

    def step(s: Column, x: Column) -> tuple[Column, Column | None]:
        after, more = fold.step(s, context, x["item"])
        if output is None:
            return after, None
        return after, F.transform(more.cast(f"array<{fold.outputs}>"), lambda o, i: F.struct(x["at"].alias("at"), i.alias("index"), o.alias("value")))

    items = _sorted(F.col("_at"), item=F.col("_item")).alias("_items")
    if fold.merge is None or largest <= span:
        grouped = rows.groupBy(*keys).agg(items).withColumn("chunk", F.lit(0).cast("bigint"))
        begun, summary = with_start(grouped), None
        if fold.merge is not None:
            lift = lambda x: fold.merge.lift(context, x["item"])
            kind = _type(rows, fold.merge.lift(context, F.col("_item")))
            summary = _composed(F.col("_items"), fold.merge, lift, kind)
    else:
        lift = lambda x: fold.merge.lift(context, x["item"])
        kind = _type(rows, fold.merge.lift(context, F.col("_item")))
        cut = rows.withColumn("chunk", _up("_at", chunk_width(rows, keys, "_at", span)))
        grouped = cut.groupBy(*keys, "chunk").agg(items)
        tables = _levels(grouped.select(*keys, F.col("chunk").alias("at"), _composed(F.col("_items"), fold.merge, lift, kind).alias("summary")), keys, fold.merge, kind, span)
        starts = with_start(tables[-1].select(*keys).distinct())
        above = _chunk_starts(tables, keys, fold.merge, starts, state, span)
        below = match_keys(tables[0], above, [*keys, "at"]).withColumnRenamed("at", "chunk")
        begun, summary = match_keys(grouped, below, [*keys, "chunk"]), F.col("summary")
    ran = begun.withColumn("_ran", _run(F.col("_items"), F.col("start"), step, state, output))
    end = F.col("_ran")["state"]
    if summary is not None:
        end = refuse_when(~end.eqNullSafe(fold.merge.apply(F.col("start"), summary).cast(state)), end, DISAGREES)
    return ran.select(
        *keys,
        "chunk",
        end.alias("state"),
        *([] if output is None else [F.col("_ran")["outputs"].alias("outputs")]),
        F.size("_items").cast("bigint").alias("records"),
        F.element_at("_items", -1)["at"].alias("position"),
    )


def reduce_rows(
    df: DataFrame, keys: Sequence[str], order: str, initial: Column, step: Callable[[Column, Column], Column], merge: Merge | None = None, sequential_rows: int = SEQUENTIAL_ROWS, span: int = SPAN
) -> DataFrame:
    """Left fold ``(A, T) -> A`` per key in order: one row per key with ``result``. Items and accumulator may differ in type.

    Refused for keys of more than ``sequential_rows`` rows unless a merge is declared, which is checked as for
    :func:`fold_rows`.
    """
    fold = Fold(initial, lambda s, _, x: (step(s, x), None), merge=merge)
    folded = fold_rows(df, keys, order, fold, sequential_rows=sequential_rows, span=span)
    return folded.groupBy(*keys).agg(F.max_by("state", "chunk").alias("result"))


def associative(step: Callable[[Column, Column], Column], lift: Callable[[Column], Column]) -> Merge:
    """The merge of a step that is associative over lifted items: a run of items is the items' own result."""
    return Merge(lambda _, x: lift(x), step, step)
