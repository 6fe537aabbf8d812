"""Datasets and streams: every stream runs as a Structured Streaming job over the event files."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import line_items
from plumbline.functions.values import json_field
from plumbline.plans.aggregates import _HEALTH, _STATE, health_of
from plumbline.plans.common import E, events, with_amounts
from plumbline.plans.ordered import AUDIT_SQL, DELIVERY, deliveries
from plumbline.registry import query
from plumbline.session import load, run_folder
from plumbline.sources import datasets, framing
from plumbline.streaming import history, publish, runs, stateful, stateless


def event_stream(spark, sf):
    path = f"{sf.rstrip('/')}/events.parquet"
    return with_amounts(runs.file_stream(spark, path, spark.read.parquet(path).schema))


def delivery_stream(spark, sf):
    """The delivery table written once and read back as a stream."""
    folder = run_folder(spark, "deliveries")
    deliveries(spark, sf).write.parquet(folder)
    return runs.file_stream(spark, folder, spark.read.parquet(folder).schema)


@query("stream_filter", f"WITH {E} SELECT event_id, user_id, cents FROM e WHERE event_type = 'purchase'")
def stream_filter(spark, sf):
    kept = stateless.stream_filter(event_stream(spark, sf), "event_type", "purchase")
    return runs.run_to_table(kept.select("event_id", "user_id", "cents"), "filter")


@query("stream_map", f"WITH {E} SELECT event_id, cents FROM e")
def stream_map(spark, sf):
    return runs.run_to_table(stateless.stream_map(event_stream(spark, sf), "event_id", "cents"), "map")


@query("stream_condition", f"WITH {E} SELECT event_id, k FROM e WHERE cents > k * 10")
def stream_condition(spark, sf):
    kept = stateless.stream_condition(event_stream(spark, sf), F.col("cents") > F.col("k") * 10)
    return runs.run_to_table(kept.select("event_id", "k"), "condition")


@query("stream_limit", f"WITH {E} SELECT event_id FROM e WHERE event_id + 1 <= 500")
def stream_limit(spark, sf):
    numbered = event_stream(spark, sf).withColumn("seq", F.col("event_id") + 1)
    return runs.run_to_table(stateless.stream_limit(numbered, 500, "seq").select("event_id"), "limit")


@query("stream_skip", f"WITH {E} SELECT event_id FROM e WHERE event_id + 1 > 500")
def stream_skip(spark, sf):
    numbered = event_stream(spark, sf).withColumn("seq", F.col("event_id") + 1)
    return runs.run_to_table(stateless.stream_skip(numbered, 500, "seq").select("event_id"), "skip")


@query(
    "stream_fork",
    f"WITH {E} SELECT event_id, 'large' AS branch FROM e WHERE cents > 2000 UNION ALL SELECT event_id, 'failed' FROM e WHERE event_type = 'error'",
)
def stream_fork(spark, sf):
    rows = event_stream(spark, sf).select("event_id", "cents", "event_type")
    paths = publish.fork_stream(rows, {"large": F.col("cents") > 2000, "failed": F.col("event_type") == "error"})
    both = [spark.read.schema("event_id bigint").parquet(path).withColumn("branch", F.lit(name)) for name, path in paths.items()]
    return both[0].unionByName(both[1])


# the longest newest run within 25 items and 240 bytes
_WINDOW = f"""WITH {E}, s AS (SELECT user_id, event_id AS seq, strlen(props) + k AS size FROM e),
    a AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS b FROM s WHERE size <= 100 WINDOW w AS (PARTITION BY user_id ORDER BY seq DESC)),
    t AS (SELECT user_id, count(*) FILTER (size <= 100) AS accepted, count(*) FILTER (size > 100) AS rejected FROM s GROUP BY 1),
    x AS (SELECT user_id, count(*) AS kept, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(size) AS BIGINT) AS kept_bytes FROM a WHERE n <= 25 AND b <= 100 GROUP BY 1)
    SELECT t.user_id, coalesce(kept, 0) AS kept, accepted - coalesce(kept, 0) AS omitted, rejected, first_seq, last_seq, coalesce(kept_bytes, 0) AS kept_bytes
    FROM t LEFT JOIN x ON t.user_id = x.user_id"""


def _sized(df):
    return df.select("user_id", F.col("event_id").alias("seq"), (F.octet_length("props").cast("bigint") + F.col("k")).alias("size"))


@query(
    "rolling_window",
    f"""SELECT *, CASE WHEN omitted > 0 THEN 'Stream window omitted ' || omitted || ' older items.' ELSE '' END ||
      CASE WHEN omitted > 0 AND rejected > 0 THEN ' ' ELSE '' END ||
      CASE WHEN rejected > 0 THEN 'Stream rejected ' || rejected || ' invalid items.' ELSE '' END AS cautions FROM ({_WINDOW})""",
)
def rolling_window(spark, sf):
    window = history.rolling_window(_sized(events(spark, sf)), ["user_id"], "seq", "size", 25, 100)
    cautions = history.loss_cautions(F.col("omitted"), F.col("rejected"))
    return window.withColumn("cautions", F.array_join(cautions, " "))


@query("rolling_window_stream", _WINDOW)
def rolling_window_stream(spark, sf):
    stream = stateful.rolling_window_stream(_sized(event_stream(spark, sf)), ["user_id"], "seq", "size", 25, 100)
    seen = runs.run_to_table(stream, "window")
    # one summary per micro-batch; the counts only grow, so the last one is the largest
    state = F.struct(*[c for c in seen.columns if c != "user_id"])
    total = F.col("kept") + F.col("omitted") + F.col("rejected")
    return seen.groupBy("user_id").agg(F.max_by(state, total).alias("s")).select("user_id", "s.*")


_WINDOW_ITEMS = f"""WITH {E}, s AS (SELECT user_id, event_id AS seq, strlen(props) + k AS size, event_type || ':' || cents AS item FROM e),
    a AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS b FROM s WHERE size <= 100 WINDOW w AS (PARTITION BY user_id ORDER BY seq DESC))
    SELECT user_id, string_agg(item, ',' ORDER BY seq) AS items, count(*) AS kept, CAST(sum(size) AS BIGINT) AS kept_bytes FROM a WHERE n <= 25 AND b <= 900 GROUP BY 1"""


def _sized_items(df):
    item = F.concat("event_type", F.lit(":"), F.col("cents").cast("string")).alias("item")
    return df.select("user_id", F.col("event_id").alias("seq"), (F.octet_length("props").cast("bigint") + F.col("k")).alias("size"), item).where("size <= 100")


def _window_items(window):
    return window.select("user_id", F.array_join("window", ",").alias("items"), "kept", "kept_bytes")


@query("rolling_window_items", _WINDOW_ITEMS)
def rolling_window_items(spark, sf):
    """The items of every user's window, oldest first."""
    return _window_items(history.rolling_window(_sized_items(events(spark, sf)), ["user_id"], "seq", "size", 25, 900, item="item"))


@query("rolling_window_items_stream", _WINDOW_ITEMS)
def rolling_window_items_stream(spark, sf):
    stream = stateful.rolling_window_stream(_sized_items(event_stream(spark, sf)), ["user_id"], "seq", "size", 25, 900, item="item")
    seen = runs.run_to_table(stream, "window-items")
    state = F.struct("window", "kept", "kept_bytes")
    return _window_items(seen.groupBy("user_id").agg(F.max_by(state, F.col("kept") + F.col("omitted")).alias("s")).select("user_id", "s.*"))


_ACCUMULATION = f"""WITH {DELIVERY}, w AS (SELECT *, lag(seq) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM d),
    j AS (SELECT *, CASE WHEN b IS NULL AND seq <> 1 THEN 'ACC006' WHEN b IS NOT NULL AND seq - b NOT IN (0, 1) THEN 'ACC003' @FULL@ END AS error FROM w),
    s AS (SELECT user_id, min(event_id) FILTER (error IS NOT NULL) AS stop, arg_min(error, event_id) FILTER (error IS NOT NULL) AS error FROM j GROUP BY 1),
    a AS (SELECT j.user_id, seq, cents, max(seq) OVER (PARTITION BY j.user_id) AS top FROM j JOIN s ON s.user_id = j.user_id
      WHERE (stop IS NULL OR event_id < stop) AND (b IS NULL OR seq = b + 1)),
    t AS (SELECT user_id, count(*) AS items, max(seq) AS sequence, CAST(sum(cents) AS BIGINT) AS total FROM a WHERE seq > top - 10 GROUP BY 1)
    SELECT s.user_id, coalesce(items, 0) AS items, coalesce(sequence, 0) AS sequence, coalesce(sequence - items, 0) AS dropped, coalesce(total, 0) AS total, error
    FROM s LEFT JOIN t ON t.user_id = s.user_id"""
_DROP_OLDEST = _ACCUMULATION.replace("@FULL@", "")


@query("accumulate", _DROP_OLDEST)
def accumulate(spark, sf):
    return history.accumulate(deliveries(spark, sf), ["user_id"], "event_id", "seq", "cents", 10, "drop-oldest")


@query("accumulate_bounded", _ACCUMULATION.replace("@FULL@", "WHEN seq > 10 THEN 'ACC004'"))
def accumulate_bounded(spark, sf):
    return history.accumulate(deliveries(spark, sf), ["user_id"], "event_id", "seq", "cents", 10, "error")


_ITEMS = f"""WITH {DELIVERY}, w AS (SELECT *, event_id // 4000 AS epoch, lag(seq) OVER u AS b, lag(event_id // 4000) OVER u AS e FROM d
      WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
    j AS (SELECT *, CASE WHEN b IS NOT NULL AND epoch <> e THEN 'ACC005' WHEN b IS NULL AND seq <> 1 THEN 'ACC006'
      WHEN b IS NOT NULL AND seq - b NOT IN (0, 1) THEN 'ACC003' END AS error FROM w),
    s AS (SELECT user_id, min(event_id) FILTER (error IS NOT NULL) AS stop, arg_min(error, event_id) FILTER (error IS NOT NULL) AS error FROM j GROUP BY 1),
    a AS (SELECT j.user_id, seq, cents, epoch, max(seq) OVER (PARTITION BY j.user_id) AS top FROM j JOIN s ON s.user_id = j.user_id
      WHERE (stop IS NULL OR event_id < stop) AND (b IS NULL OR seq = b + 1)),
    t AS (SELECT user_id, string_agg(cents::VARCHAR, ',' ORDER BY seq) AS items, max(seq) AS sequence, max(epoch)::VARCHAR AS epoch, max(seq) - count(*) AS dropped
      FROM a WHERE seq > top - 10 GROUP BY 1)
    SELECT s.user_id, coalesce(items, '') AS items, epoch, sequence, dropped, error FROM s LEFT JOIN t ON t.user_id = s.user_id"""


def _history(found):
    items = F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items")
    return found.select("user_id", items, "checkpoint.epoch", "checkpoint.sequence", "checkpoint.dropped", "error")


@query("accumulate_items", _ITEMS)
def accumulate_items(spark, sf):
    """Histories with their items, ended by another epoch of the source."""
    df = deliveries(spark, sf).withColumn("epoch", F.call_function("div", F.col("event_id"), F.lit(4000)))
    found = history.accumulation(df, ["user_id"], "event_id", "seq", "cents", 10, "drop-oldest", epoch="epoch")
    return _history(found)


@query("accumulate_items_stream", _ITEMS)
def accumulate_items_stream(spark, sf):
    """The same histories from a stream that goes on from the checkpoint of a batch over the first deliveries."""
    df = deliveries(spark, sf).withColumn("epoch", F.call_function("div", F.col("event_id"), F.lit(4000)))
    early = F.col("event_id") < 300
    before = history.accumulation(df.where(early), ["user_id"], "event_id", "seq", "cents", 10, "drop-oldest", epoch="epoch")
    folder = run_folder(spark, "later-deliveries")
    df.where(~early).write.parquet(folder)
    stream = runs.file_stream(spark, folder, df.schema)
    found = stateful.accumulation_stream(stream, ["user_id"], "event_id", "seq", "cents", 10, "drop-oldest", "epoch", before)
    seen = runs.run_to_table(found, "accumulation")
    state = F.struct("items", "checkpoint", "error")
    last = seen.groupBy("user_id").agg(F.max_by(state, "at").alias("s")).select("user_id", "s.*")
    return _history(before.join(last, "user_id", "left_anti").unionByName(last))


@query("accumulate_stream", _DROP_OLDEST)
def accumulate_stream(spark, sf):
    stream = stateful.accumulate_stream(delivery_stream(spark, sf), ["user_id"], "event_id", "seq", "cents", 10, "drop-oldest")
    seen = runs.run_to_table(stream, "accumulate")
    state = F.struct("items", "sequence", "dropped", "total", "error")
    return seen.groupBy("user_id").agg(F.max_by(state, "at").alias("s")).select("user_id", "s.*")


_RECORDS = f"""WITH {E}, w AS (SELECT event_id, user_id, cents, max(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak,
      count(*) OVER x AS "count", CAST(sum(cents) OVER x AS BIGINT) AS "sum" FROM e WINDOW x AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, user_id, cents, "count", "sum" FROM w WHERE peak IS NULL OR cents > peak"""


@query("scan", _RECORDS)
def scan(spark, sf):
    df = events(spark, sf).select("event_id", "user_id", "cents")
    return history.scan_records(df, ["user_id"], "event_id", "cents")


def _record_step(state, frame):
    count, total, peak = state
    value = frame["cents"].to_numpy()
    highest = np.maximum.accumulate(np.concatenate(([peak], value)))
    outputs = frame.assign(count=count + np.arange(1, len(frame) + 1), sum=total + value.cumsum())
    state = (count + len(frame), int(total + value.sum()), int(highest[-1]))
    return state, outputs[value > highest[:-1]]


@query("scan_stream", _RECORDS)
def scan_stream(spark, sf):
    rows = event_stream(spark, sf).select("event_id", "user_id", "cents")
    outputs = T.StructType([T.StructField(n, T.LongType()) for n in ("event_id", "cents", "count", "sum")])
    stream = stateful.scan_stream(
        rows, ["user_id"], "event_id", _record_step, (0, 0, -1), "count bigint, sum bigint, peak bigint", outputs
    )
    return runs.run_to_table(stream, "scan")


@query("scan_batches", _RECORDS)
def scan_batches(spark, sf):
    rows = event_stream(spark, sf).select("event_id", "user_id", "cents")
    folder = publish.scan_records_batches(rows, ["user_id"], "event_id", "cents")
    return spark.read.parquet(f"{folder}/outputs/generation=*").select("event_id", "user_id", "cents", "count", "sum")


_LIMITS = {"input_records": 40, "input_charge": 350, "output_records": 12}
_RAISED = {"input_records": 60, "input_charge": 500, "output_records": 20}


def _bounded_sql(limits):
    r, b, o = limits["input_records"], limits["input_charge"], limits["output_records"]
    return f"""WITH {E}, w AS (SELECT event_id, user_id, count(*) OVER x AS r, sum(strlen(props)) OVER x AS b, sum(CASE WHEN cents > 1000 THEN 1 ELSE 0 END) OVER x AS o
      FROM e WINDOW x AS (PARTITION BY user_id ORDER BY event_id)),
    j AS (SELECT *, CASE WHEN r > {r} THEN 'input_records' WHEN b > {b} THEN 'input_charge' WHEN o > {o} THEN 'output_records' END AS x FROM w)
    SELECT user_id, max(event_id) FILTER (x IS NULL) AS position, coalesce(max(r) FILTER (x IS NULL), 0) AS input_records,
      CAST(coalesce(max(b) FILTER (x IS NULL), 0) AS BIGINT) AS input_charge, CAST(coalesce(max(o) FILTER (x IS NULL), 0) AS BIGINT) AS output_records,
      arg_min(x, event_id) FILTER (x IS NOT NULL) AS exhausted, CASE WHEN count(x) = 0 THEN 'complete' ELSE 'stopped' END AS status
    FROM j GROUP BY 1"""


def _charged(spark, sf):
    size = F.octet_length("props").cast("bigint").alias("size")
    return events(spark, sf).select("event_id", "user_id", "cents", size)


@query("scan_bounds", _bounded_sql(_LIMITS))
def scan_bounds(spark, sf):
    return history.scan_bounds(_charged(spark, sf), ["user_id"], "event_id", "size", F.col("cents") > 1000, _LIMITS)[1]


@query("scan_continue", _bounded_sql(_RAISED))
def scan_continue(spark, sf):
    df, produces = _charged(spark, sf), F.col("cents") > 1000
    _, receipts = history.scan_bounds(df, ["user_id"], "event_id", "size", produces, _LIMITS)
    return history.scan_continue(df, ["user_id"], "event_id", "size", produces, receipts, _RAISED)[1]


@query("sequence_audit_stream", AUDIT_SQL)
def sequence_audit_stream(spark, sf):
    outputs = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("verdict", T.StringType())]
    )
    stream = stateful.scan_stream(
        delivery_stream(spark, sf), ["user_id"], "event_id", _audit_step, (None,), "seen bigint", outputs
    )
    return runs.run_to_table(stream, "audit")


def _audit_step(state, frame):
    seq = frame["seq"].to_numpy()
    (seen,) = state
    step = np.diff(seq, prepend=seq[0] if seen is None else seen)
    verdict = np.select([step == 1, step == 0, step > 1], ["next", "duplicate", "gap"], "backward")
    if seen is None:
        verdict = np.concatenate((["first"], verdict[1:]))
    return (int(seq[-1]),), frame.assign(verdict=verdict)


@query("live_rollup", f"WITH {E}, h AS (SELECT {_HEALTH} FROM e WHERE event_id > (SELECT max(event_id) FROM e) - 20) SELECT *, {_STATE} FROM h")
def live_rollup(spark, sf):
    rows = event_stream(spark, sf).select("event_id", "event_type", "cents")
    folder = publish.live_rollup(rows, "event_id", 20, health_of)
    return publish.latest_rollup(spark, folder)


def _three_generations(spark, sf):
    """Events written as a dataset of three generations split by time."""
    path = run_folder(spark, "dataset")
    df = events(spark, sf).select("event_id", "ts", "user_id", "cents")
    first, second = (F.lit(day).cast("timestamp") for day in ("2024-01-11", "2024-01-21"))
    number = F.when(F.col("ts") < first, 0).when(F.col("ts") < second, 1).otherwise(2)
    for generation in range(3):
        part = df.where(number == generation)
        datasets.append(part.drop("ts"), path, generation, "event_id")
    return path


@query(
    "dataset_page",
    f"""WITH {E}, o AS (SELECT event_id, user_id, cents, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM e)
    SELECT event_id, user_id, cents, ordinal, 280::BIGINT AS next, (SELECT count(*) FROM e) = 280 AS extent_exhausted FROM o WHERE ordinal >= 200 AND ordinal < 280""",
)
def dataset_page(spark, sf):
    return datasets.page(spark, _three_generations(spark, sf), 200, 80).drop("generation")


@query("dataset_snapshot", f"WITH {E} SELECT event_id, user_id, cents FROM e WHERE ts < TIMESTAMP '2024-01-21'")
def dataset_snapshot(spark, sf):
    path = _three_generations(spark, sf)
    anchor = datasets.prefix_digest(spark, path, 1)
    return datasets.snapshot(spark, path, 1, anchor).select("event_id", "user_id", "cents")


@query("dataset_inspect", "SELECT count(*) AS records, 3::BIGINT AS generations, 2::BIGINT AS last_generation, 'open' AS lifecycle FROM events")
def dataset_inspect(spark, sf):
    return datasets.inspect(spark, _three_generations(spark, sf)).drop("schema_digest")


@query("dataset_verify", "SELECT g::BIGINT AS generation, count(*) AS records, true AS intact FROM (SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS g FROM events) GROUP BY 1")
def dataset_verify(spark, sf):
    table = datasets.verify(spark, _three_generations(spark, sf))
    return table.withColumn("generation", F.col("generation").cast("bigint"))


@query("dataset_record", f"WITH {E} SELECT event_id, cents, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM e")
def dataset_record(spark, sf):
    path = publish.dataset_record(event_stream(spark, sf).select("event_id", "cents"), run_folder(spark, "recorded"), "event_id")
    return datasets.records(spark, path).select("event_id", "cents", "ordinal")


@query("scan_follow", f"WITH {E} SELECT event_id, cents FROM e WHERE cents > 1500")
def scan_follow(spark, sf):
    followed = publish.dataset_follow(spark, _three_generations(spark, sf))
    kept = stateless.stream_condition(followed, F.col("cents") > 1500)
    return runs.run_to_table(kept.select("event_id", "cents"), "follow")


@query("scan_follow_committed", f"WITH {E} SELECT event_id, cents, 2::BIGINT AS generation FROM e WHERE ts >= TIMESTAMP '2024-01-21'")
def scan_follow_committed(spark, sf):
    """A follower that begins behind two generations: it sees the third once that is committed, and never an orphan."""
    df = events(spark, sf).select("event_id", "ts", "user_id", "cents")
    path, folder = run_folder(spark, "dataset"), run_folder(spark, "follower")
    days = [F.lit(day).cast("timestamp") for day in ("2024-01-11", "2024-01-21")]
    parts = [df.where(F.col("ts") < days[0]), df.where((F.col("ts") >= days[0]) & (F.col("ts") < days[1])), df.where(F.col("ts") >= days[1])]
    for generation in (0, 1):
        datasets.append(parts[generation].drop("ts"), path, generation, "event_id")
    follower = lambda: publish.dataset_follow(spark, path, after=1).select("event_id", "cents", F.col("generation").cast("bigint"))
    runs.run_to_table(publish.dataset_follow(spark, path, "next").select("event_id", "cents", F.col("generation").cast("bigint")), "follower", folder)
    # records of a writer that failed before its commit
    orphan = parts[2].drop("ts").withColumn("ordinal", F.lit(10**9).cast("bigint"))
    orphan.write.parquet(f"{path}/records/generation=3")
    runs.run_to_table(follower(), "follower", folder)
    datasets.append(parts[2].drop("ts"), path, 2, "event_id")
    return runs.run_to_table(follower(), "follower", folder)


@query("dataset_record_next", f"WITH {E} SELECT event_id, cents, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM e WHERE ts >= TIMESTAMP '2024-01-11'")
def dataset_record_next(spark, sf):
    """A dataset recorded from another one, beginning with what is committed after the recording was set up."""
    df = events(spark, sf).select("event_id", "ts", "cents")
    path, copy, folder = run_folder(spark, "dataset"), run_folder(spark, "copy"), run_folder(spark, "recorder")
    days = [F.lit(day).cast("timestamp") for day in ("2024-01-11", "2024-01-21")]
    datasets.append(df.where(F.col("ts") < days[0]).drop("ts"), path, 0, "event_id")
    recorder = publish.dataset_follow(spark, path, "next").select("event_id", "cents")
    for generation, part in ((1, (F.col("ts") >= days[0]) & (F.col("ts") < days[1])), (2, F.col("ts") >= days[1])):
        datasets.append(df.where(part).drop("ts"), path, generation, "event_id")
        publish.dataset_record(recorder, copy, "event_id", folder=folder)
    return datasets.records(spark, copy).select("event_id", "cents", "ordinal")


@query("csv_files", "SELECT doc_id, text FROM documents")
def csv_files(spark, sf):
    """Documents exported as CSV files and read back; quotes and line ends inside cells survive."""
    path = run_folder(spark, "csv")
    docs = load(spark, sf, "documents").select("doc_id", "text")
    datasets.export_csv(docs, path)
    options = {"quote": '"', "escape": '"', "multiLine": True, "lineSep": "\r\n"}
    return spark.read.schema("doc_id bigint, text string").options(**options).csv(path)


@query(
    "text_files",
    "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(*) AS n FROM l GROUP BY line",
)
def text_files(spark, sf):
    """Document lines written as text files with CRLF ends and read back as records."""
    path = run_folder(spark, "text")
    lines = load(spark, sf, "documents").select(F.explode(line_items(F.col("text"))).alias("line"))
    lines.write.option("lineSep", "\r\n").text(path)
    return framing.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("json_files", f"WITH {E} SELECT user_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM e GROUP BY user_id")
def json_files(spark, sf):
    """Events written as one JSON value per line and read back, every line checked."""
    path = run_folder(spark, "json")
    events(spark, sf).select(F.to_json(F.struct("user_id", "k")).alias("line")).write.text(path)
    value = F.col("value")
    read = framing.read_json_lines(spark, path).select(
        json_field(value, "$.user_id", "bigint").alias("user_id"), json_field(value, "$.k", "bigint").alias("k")
    )
    return read.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
