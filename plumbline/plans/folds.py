"""General folds and scans: a bounded level per user with alarms and a closing row, over tables, streams and timers."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import folds
from plumbline.plans.common import E, events
from plumbline.plans.streams import event_stream
from plumbline.registry import query
from plumbline.session import load, run_folder
from plumbline.streaming import runs, scans

CAP = 60
_BIG = "bigint"


def level_fold() -> folds.Fold:
    """A level between 0 and a cap: purchases fill it by ``k``, other events drain 7. Reaching either bound is an output.

    What a run of events does to the level is itself "add, then clamp", which is what the merge composes.
    """
    change = lambda x: F.when(x["event_type"] == "purchase", x["k"]).otherwise(F.lit(-7)).cast(_BIG)
    clamp = lambda v, low, high: F.least(F.greatest(v, low), high)
    zero = F.lit(0).cast(_BIG)

    def step(state, context, x):
        level = clamp(state["level"] + change(x), zero, context["cap"])
        alarm = F.struct(F.when(level == 0, "empty").otherwise("full").alias("note"), level.alias("level"))
        return F.struct(level.alias("level")), F.when(level.isin(0) | (level == context["cap"]), F.array(alarm)).otherwise(F.array())

    def compose(a, b):
        return F.struct(
            (a["add"] + b["add"]).alias("add"),
            clamp(a["low"] + b["add"], b["low"], b["high"]).alias("low"),
            clamp(a["high"] + b["add"], b["low"], b["high"]).alias("high"),
        )

    return folds.Fold(
        initial=F.struct(zero.alias("level")),
        step=step,
        outputs="struct<note: string, level: bigint>",
        finish=lambda state, context, end: F.array(F.struct(end["kind"].alias("note"), (state["level"] * 1000 + end["records"]).alias("level"))),
        merge=folds.Merge(
            lift=lambda context, x: F.struct(change(x).alias("add"), zero.alias("low"), context["cap"].alias("high")),
            compose=compose,
            apply=lambda state, f: F.struct(clamp(state["level"] + f["add"], f["low"], f["high"]).alias("level")),
        ),
    )


def level_context():
    return F.struct(F.lit(CAP).cast(_BIG).alias("cap"))


def _with_end(scanned: scans.Scanned, keys) -> object:
    ended = scans.finish(scanned.states, keys, level_fold(), level_context())
    both = scanned.outputs.unionByName(ended)
    return both.select(*keys, F.col("at").alias("event_id"), "value.note", "value.level")


def _level_sql(key: str) -> str:
    return f"""WITH {E}, g AS (SELECT {key}, list(event_id ORDER BY event_id) AS ids, list(CASE WHEN event_type = 'purchase' THEN k ELSE -7 END ORDER BY event_id) AS steps FROM e GROUP BY 1),
    r AS (SELECT {key}, ids, list_reduce(list_prepend([0::BIGINT], [[s::BIGINT] FOR s IN steps]), lambda a, b: list_append(a, greatest(0, least({CAP}, a[-1] + b[1])))) AS levels FROM g),
    u AS (SELECT {key}, unnest(ids) AS event_id, unnest(levels[2:]) AS level FROM r)
    SELECT {key}, event_id, CASE WHEN level = 0 THEN 'empty' ELSE 'full' END AS note, level FROM u WHERE level IN (0, {CAP})
    UNION ALL SELECT {key}, NULL, 'natural_end', levels[-1] * 1000 + len(ids) FROM r"""


@query("scan_general", _level_sql("user_id"))
def scan_general(spark, sf):
    """Every alarm of every user's level, and a closing row per user."""
    df = events(spark, sf).select("user_id", "event_id", "event_type", "k")
    return _with_end(scans.scan(df, ["user_id"], "event_id", level_fold(), level_context()), ["user_id"])


@query("scan_general_hot", _level_sql("event_type"))
def scan_general_hot(spark, sf):
    """The same with few keys that hold all rows: each is cut into chunks, whose summaries are composed."""
    df = events(spark, sf).select("event_type", "event_id", F.col("event_type").alias("kind"), "k")
    fold = level_fold()
    rows = df.withColumnRenamed("event_type", "key").withColumnRenamed("kind", "event_type")
    scanned = scans.scan(rows, ["key"], "event_id", fold, level_context(), span=256)
    return _with_end(scanned, ["key"]).withColumnRenamed("key", "event_type")


@query("scan_general_batches", _level_sql("user_id"))
def scan_general_batches(spark, sf):
    """The same as a stream that is stopped half-way and started again from its checkpoint."""
    source, folder = run_folder(spark, "scan-source"), run_folder(spark, "scan-general")
    df = events(spark, sf).select("user_id", "event_id", "event_type", "k")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    for part in (half, ~half):
        events(spark, sf).where(part).select(df.columns).write.mode("append").parquet(source)
        stream = runs.file_stream(spark, source, df.schema)
        scans.scan_batches(stream, ["user_id"], "event_id", level_fold(), level_context(), folder)
    return _with_end(scans.batch_results(spark, folder, ["user_id"]), ["user_id"])


def _count_step(state, frame):
    rows, total = state
    return (rows + len(frame), total + int(frame["cents"].sum())), pd.DataFrame({"rows": [], "total": []}, dtype="int64")


def _count_end(state):
    return pd.DataFrame({"rows": [state[0]], "total": [state[1]]})


GAP_MS = 12 * 3600 * 1000


@query(
    "scan_timed",
    f"""WITH {E}, m AS (SELECT max(epoch_ms(ts)) AS water FROM e) SELECT user_id, count(*) AS rows, CAST(sum(cents) AS BIGINT) AS total
    FROM e, m GROUP BY user_id, water HAVING max(epoch_ms(ts)) + {GAP_MS} <= water""",
)
def scan_timed(spark, sf):
    """Users whose last event lies half a day of event time back are ended by a timer, which gives their closing row."""
    rows = event_stream(spark, sf).select("user_id", "event_id", "ts", "cents")
    outputs = T.StructType([T.StructField(n, T.LongType()) for n in ("rows", "total")])
    stream = scans.scan_timed(rows, ["user_id"], "event_id", "ts", "0 seconds", GAP_MS, _count_step, _count_end, (0, 0), "rows bigint, total bigint", outputs)
    return runs.run_to_table(stream, "scan-timed")


_MOD = 1_000_003


def _affine() -> folds.Merge:
    """What a run of items does to the accumulator: multiply and add."""
    return folds.Merge(
        lift=lambda _, x: F.struct(F.lit(31).cast(_BIG).alias("m"), x["k"].alias("c")),
        compose=lambda a, b: F.struct((a["m"] * b["m"] % _MOD).alias("m"), ((a["c"] * b["m"] + b["c"]) % _MOD).alias("c")),
        apply=lambda s, f: (s * f["m"] + f["c"]) % _MOD,
    )


@query(
    "reduce_unlike",
    f"""WITH {E} SELECT event_type, list_reduce(list_prepend(17::BIGINT, list(k ORDER BY event_id)), lambda a, x: (a * 31 + x) % {_MOD}) AS result FROM e GROUP BY 1""",
)
def reduce_unlike(spark, sf):
    """A fold whose accumulator is a number and whose items are events; not associative, but with a merge."""
    df = events(spark, sf).select("event_type", "event_id", "k", "ts")
    step = lambda a, x: (a * 31 + x["k"]) % _MOD
    return folds.reduce_rows(df, ["event_type"], "event_id", F.lit(17).cast(_BIG), step, _affine(), span=512)


@query(
    "reduce_serial",
    "SELECT conv_id, list_reduce(list_prepend(0::BIGINT, list(length(text) ORDER BY turn)), lambda a, x: x - a) AS result FROM conversations GROUP BY conv_id",
)
def reduce_serial(spark, sf):
    """A fold without a merge: alternating sums of a conversation's turn lengths."""
    df = load(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast(_BIG).alias("n"))
    return folds.reduce_rows(df, ["conv_id"], "turn", F.lit(0).cast(_BIG), lambda a, x: x["n"] - a)
