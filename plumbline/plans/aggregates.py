"""Summaries, histograms, roll-ups, folds and journal states."""

from pyspark.sql import functions as F

from plumbline.operators import journal, series, summaries
from plumbline.plans.common import E, events, half_even, half_up, lines, plain
from plumbline.registry import query
from plumbline.session import load

_HEALTH = f"""count(*) AS "count", count(*) FILTER (event_type = 'error') AS errors,
    greatest(max(cents), 0) AS max_ms, max(event_id) AS last,
    {half_even("CAST(sum(cents) AS BIGINT)", "count(*)", 1)} AS mean_ms,
    {half_even("count(*) FILTER (event_type = 'error') * 100", "count(*)", 1)} AS error_percent"""
_STATE = "CASE WHEN errors > 0 THEN 'DEGRADED' WHEN mean_ms > 500 THEN 'SLOW' ELSE 'HEALTHY' END AS state"


def health_of(df, by=()):
    return plain(
        summaries.health_summary(df, F.col("event_id"), F.col("event_type") == "error", F.col("cents"), by)
    )


@query("health_summary", f"WITH {E}, h AS (SELECT {_HEALTH} FROM e) SELECT *, {_STATE} FROM h")
def health_summary(spark, sf):
    return health_of(events(spark, sf))


@query(
    "health_summary_by_user",
    f"WITH {E}, h AS (SELECT user_id, {_HEALTH} FROM e GROUP BY user_id) SELECT *, {_STATE} FROM h",
)
def health_summary_by_user(spark, sf):
    return health_of(events(spark, sf), ["user_id"])


@query(
    "sum_where",
    f"""WITH {E} SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors,
    CAST(sum(event_id) FILTER (event_type = 'error') AS BIGINT) AS sum_value FROM e""",
)
def sum_where(spark, sf):
    return summaries.sum_where(load(spark, sf, "events"), F.col("event_type") == "error", F.col("event_id"))


@query(
    "log_summary",
    """WITH d AS (SELECT doc_id, source, lang, text, regexp_matches(text, '(?i)licen[sc]e|secret|password') AS hit FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM d WHERE hit)
    SELECT d.source, count(*) AS lines, count(*) FILTER (hit) AS matches,
      count(*) FILTER (lang <> 'en') AS foreign_lines, count(*) FILTER (NOT ends_with(text, '.')) AS partial_lines,
      count(*) FILTER (contains(text, '\ufffd')) AS lossy_lines,
      any_value((SELECT left(r.text, 160) FROM r WHERE r.source = d.source AND n = 1)) AS preview_1,
      any_value((SELECT length(r.text) > 160 FROM r WHERE r.source = d.source AND n = 1)) AS shortened_1,
      any_value((SELECT left(r.text, 160) FROM r WHERE r.source = d.source AND n = 2)) AS preview_2,
      any_value((SELECT length(r.text) > 160 FROM r WHERE r.source = d.source AND n = 2)) AS shortened_2
    FROM d GROUP BY d.source""",
)
def log_summary(spark, sf):
    counters = {
        "foreign_lines": F.col("lang") != "en",
        "partial_lines": ~F.col("text").endswith("."),
        "lossy_lines": F.col("text").contains("\ufffd"),
    }
    docs = load(spark, sf, "documents")
    return summaries.log_summary(docs, "source", "doc_id", "text", "(?i)licen[sc]e|secret|password", counters)


@query(
    "histogram",
    """WITH n AS (SELECT CAST(l_quantity AS BIGINT) AS n FROM lineitem), x AS (SELECT min(n) AS lo, max(n) AS hi, count(*) AS total FROM n),
    c AS (SELECT least(7, ((n - lo) * 8) // (hi - lo)) AS bin, count(*) AS c FROM n, x GROUP BY 1)
    SELECT CAST(b.bin AS INT) AS bin, lo + b.bin * ((hi - lo) / 8.0)::DOUBLE AS lower, lo + (b.bin + 1) * ((hi - lo) / 8.0)::DOUBLE AS upper,
      coalesce(c.c, 0) AS "count", total
    FROM (SELECT unnest(range(8)) AS bin) b CROSS JOIN x LEFT JOIN c ON c.bin = b.bin""",
)
def histogram(spark, sf):
    return plain(summaries.histogram(lines(spark, sf), F.col("q"), 8))


@query(
    "rollup_counters",
    f"""WITH {E}, s AS (
      SELECT CASE WHEN GROUPING(event_type) = 1 THEN 0 WHEN GROUPING(day) = 1 THEN 1 ELSE 2 END AS depth, event_type AS grp, day AS bucket,
        count(*) AS messages, count(*) FILTER (outcome <> 'failed') AS completed, CAST(sum(strlen(props)) AS BIGINT) AS bytes_in,
        CAST(sum(cents) AS BIGINT) AS duration, max(cents) AS max_duration
      FROM (SELECT *, CAST(day(ts) AS INT) AS day, CASE WHEN k < 10 THEN 'failed' WHEN k < 50 THEN 'slow' ELSE 'ok' END AS outcome FROM e)
      GROUP BY GROUPING SETS ((), (event_type), (event_type, day))),
    o AS (SELECT depth, grp, bucket, string_agg(outcome || '=' || c, ',' ORDER BY outcome || '=' || c) AS outcomes FROM (
      SELECT CASE WHEN GROUPING(event_type) = 1 THEN 0 WHEN GROUPING(day) = 1 THEN 1 ELSE 2 END AS depth, event_type AS grp, day AS bucket,
        outcome, count(*) AS c
      FROM (SELECT *, CAST(day(ts) AS INT) AS day, CASE WHEN k < 10 THEN 'failed' WHEN k < 50 THEN 'slow' ELSE 'ok' END AS outcome FROM e)
      GROUP BY GROUPING SETS ((outcome), (event_type, outcome), (event_type, day, outcome))) GROUP BY ALL)
    SELECT s.*, o.outcomes FROM s JOIN o ON s.depth = o.depth AND s.grp IS NOT DISTINCT FROM o.grp AND s.bucket IS NOT DISTINCT FROM o.bucket""",
)
def rollup_counters(spark, sf):
    df = events(spark, sf).select(
        F.col("event_type").alias("grp"),
        F.dayofmonth("ts").alias("bucket"),
        F.when(F.col("k") < 10, "failed").when(F.col("k") < 50, "slow").otherwise("ok").alias("outcome"),
        F.octet_length("props").cast("bigint").alias("size"),
        "cents",
    )
    return summaries.rollup_counters(
        df, "grp", "bucket", "outcome", F.col("outcome") != "failed", F.col("size"), F.col("cents")
    )


@query(
    "footprint",
    """WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), h AS (SELECT l_partkey, count(*) AS roots FROM r GROUP BY 1)
    SELECT l_suppkey, count(*) AS objects, CAST(sum(p_size) AS BIGINT) AS total_bytes,
      CAST(coalesce(sum(p_size) FILTER (roots > 1), 0) AS BIGINT) AS shared_bytes,
      CAST(coalesce(sum(p_size) FILTER (roots = 1), 0) AS BIGINT) AS exclusive_bytes
    FROM r JOIN h USING (l_partkey) JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def footprint(spark, sf):
    references = load(spark, sf, "lineitem")
    sizes = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return summaries.footprint(references, sizes, "l_suppkey", "l_partkey", "p_size")


@query(
    "footprint_closure",
    """WITH RECURSIVE r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem UNION SELECT l_suppkey, l_partkey // 2 FROM r WHERE l_partkey // 2 > 0),
    h AS (SELECT l_partkey, count(*) AS roots FROM r GROUP BY 1)
    SELECT l_suppkey, count(*) AS objects, CAST(sum(p_size) AS BIGINT) AS total_bytes,
      CAST(coalesce(sum(p_size) FILTER (roots > 1), 0) AS BIGINT) AS shared_bytes,
      CAST(coalesce(sum(p_size) FILTER (roots = 1), 0) AS BIGINT) AS exclusive_bytes
    FROM r JOIN h USING (l_partkey) JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def footprint_closure(spark, sf):
    """Every part refers to the one with half its number: chains that meet, down to the first."""
    parts = load(spark, sf, "part")
    half = F.call_function("div", F.col("p_partkey"), F.lit(2))
    links = parts.select(F.col("p_partkey").alias("l_partkey"), half.alias("inner_part")).where("inner_part > 0")
    sizes = parts.select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return summaries.footprint_closure(load(spark, sf, "lineitem"), links, sizes, "l_suppkey", "l_partkey", "inner_part", "p_size")


@query(
    "reduce",
    "SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS result FROM conversations GROUP BY conv_id",
)
def reduce(spark, sf):
    talk = load(spark, sf, "conversations")
    lift = F.concat(F.col("role"), F.lit(":"), F.length("text").cast("string"))
    empty = F.lit("")
    join = lambda acc, item: F.when(acc == "", item).otherwise(F.concat(acc, F.lit("|"), item))
    return summaries.ordered_reduce(talk, ["conv_id"], "turn", lift, empty, join)


@query(
    "count",
    """SELECT lang, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes
    FROM documents GROUP BY lang""",
)
def count(spark, sf):
    return summaries.count_items(load(spark, sf, "documents"), ["lang"], "text")


@query("length", "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, len(string_split(text, chr(10))) AS pieces FROM documents")
def length(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id",
        F.length("text").cast("bigint").alias("chars"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        F.size(F.split("text", "\n", -1)).cast("bigint").alias("pieces"),
    )


# the journal read from events: node = user, run = k mod 3
_J = f"""{E}, j AS (SELECT event_id AS seq, user_id AS node, 'r' || (k % 3) AS run, event_type, cents,
  CASE event_type WHEN 'click' THEN 'Ready' WHEN 'view' THEN 'Stale' WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Running' END AS state,
  CASE WHEN event_type = 'view' AND cents > 1000 THEN 'StreamUpdated' END AS reason,
  CASE WHEN event_type = 'purchase' THEN 'h' || event_id END AS handle FROM e)"""


def journal_of(spark, sf):
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", "Ready").when(kind == "view", "Stale").when(kind == "error", "Failed").when(kind == "signup", "Running")
    )
    return events(spark, sf).select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("node"),
        F.concat(F.lit("r"), (F.col("k") % 3).cast("string")).alias("run"),
        "event_type",
        "cents",
        state.alias("state"),
        F.when((kind == "view") & (F.col("cents") > 1000), "StreamUpdated").alias("reason"),
        F.when(kind == "purchase", F.concat(F.lit("h"), F.col("event_id").cast("string"))).alias("handle"),
    )


@query(
    "unresolved_calls",
    f"""WITH {_J} SELECT node, run, max(seq) AS call_seq FROM j WHERE event_type IN ('signup', 'purchase')
    GROUP BY node, run HAVING arg_max(event_type, seq) = 'signup'""",
)
def unresolved_calls(spark, sf):
    df = journal_of(spark, sf)
    kind = F.col("event_type")
    return journal.unresolved_calls(df, "node", "run", "seq", kind == "signup", kind == "purchase")


@query(
    "latest_match",
    f"""WITH {_J}, o AS (SELECT node, arg_max(state, seq) AS state, arg_max(run, seq) AS run FROM j WHERE state IS NOT NULL GROUP BY node)
    SELECT j.node, arg_max(j.run, seq) AS run, arg_max(handle, seq) AS handle FROM j LEFT JOIN o ON j.node = o.node
    WHERE handle IS NOT NULL AND (o.node IS NULL OR (o.state = 'Ready' AND o.run = j.run)) GROUP BY j.node""",
)
def latest_match(spark, sf):
    df = journal_of(spark, sf)
    observations, results = df.where(F.col("state").isNotNull()), df.where(F.col("handle").isNotNull())
    return journal.latest_match(observations.select("node", "run", "seq", "state"), results.select("node", "run", "seq", "handle"), "node", "run", "seq", "state", "handle")


@query(
    "latest_state",
    f"""WITH {_J}, o AS (SELECT node, arg_max(state, seq) AS state,
        arg_max({{'r': reason}}, seq).r AS reason FROM j WHERE state IS NOT NULL GROUP BY node),
    v AS (SELECT node, max(cents) > 2000 AS available FROM j WHERE handle IS NOT NULL GROUP BY node),
    b AS (SELECT coalesce(o.node, v.node) AS node, o.state AS s, o.reason, o.node IS NOT NULL AS seen, available FROM o FULL JOIN v ON o.node = v.node),
    r AS (SELECT *, CASE WHEN s = 'Failed' THEN s WHEN (NOT seen OR s = 'Ready') AND coalesce(available, false) THEN 'Ready' ELSE 'Stale' END AS state FROM b)
    SELECT node, state, CASE WHEN state <> 'Stale' THEN NULL
      WHEN s = 'Ready' THEN CASE WHEN available IS NOT NULL THEN 'RestoreUnavailable' ELSE 'RestoreNotRetained' END
      WHEN s = 'Stale' THEN coalesce(reason, 'Unknown')
      WHEN NOT seen THEN CASE WHEN available IS NOT NULL THEN 'RestoreUnavailable' ELSE 'RestoreUnfinished' END
      ELSE 'RestoreUnfinished' END AS stale_reason FROM r""",
)
def latest_state(spark, sf):
    df = journal_of(spark, sf)
    retained = df.where(F.col("handle").isNotNull()).groupBy("node").agg((F.max("cents") > 2000).alias("available"))
    return journal.latest_state(df.where(F.col("state").isNotNull()), retained, "node", "seq", "state", "reason", "available")


@query(
    "run_history",
    f"""WITH {_J} SELECT node, run,
      coalesce(arg_max(state, seq) FILTER (state NOT IN ('Stale', 'Pending')), arg_min(state, seq) FILTER (state IS NOT NULL)) AS state,
      coalesce(max(seq) FILTER (state NOT IN ('Stale', 'Pending')), min(seq) FILTER (state IS NOT NULL)) AS at,
      arg_max(handle, seq) FILTER (handle IS NOT NULL) AS "value",
      coalesce(bool_or(handle IS NOT NULL AND cents > 3000), false) AS protected
    FROM j GROUP BY node, run HAVING count(state) > 0""",
)
def run_history(spark, sf):
    df = journal_of(spark, sf)
    protects = F.col("handle").isNotNull() & (F.col("cents") > 3000)
    return journal.run_history(df, "node", "run", "seq", "state", "handle", protects)


@query(
    "counter_rates",
    f"""WITH {E}, w AS (SELECT *, lag(cents) OVER x AS c0, lag(us) OVER x AS u0 FROM e WINDOW x AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, user_id,
      CASE WHEN c0 IS NOT NULL AND k % 8 > 0 AND us > u0 AND cents >= c0 THEN
        {half_up("(cents - c0) * (k % 8) * 100", "us - u0", 6)} END AS cpu_percent,
      CASE WHEN c0 IS NULL THEN 'CPU counters unavailable' WHEN k % 8 = 0 THEN 'CPU count unavailable'
        WHEN NOT (us > u0 AND cents >= c0) THEN 'CPU requires increasing sample time and system counter, nondecreasing usage, and a valid prior sample'
        END AS cpu_unavailable,
      CASE WHEN cents - k * 20 >= 0 THEN cents - k * 20 END AS working_set,
      CASE WHEN cents - k * 20 >= 0 AND k > 0 THEN {half_up("(cents - k * 20) * 100", "CASE WHEN k = 0 THEN 1 ELSE k * 1000 END", 6)} END AS memory_percent,
      CASE WHEN cents - k * 20 < 0 THEN 'Memory cache exceeds usage; inconsistent sample'
        WHEN k = 0 THEN 'Memory limit unavailable or zero' END AS memory_unavailable
    FROM w""",
)
def counter_rates(spark, sf):
    df = events(spark, sf).select("event_id", "user_id", "us", "cents", "k")
    c = F.col
    rated = series.counter_rates(
        df, ["user_id"], "event_id", c("us"), c("cents"), c("us"), c("k") % 8, c("cents"), c("k") * 20, c("k") * 1000
    )
    return plain(rated.drop("us", "cents", "k"))
