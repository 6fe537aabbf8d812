"""Ordered analytics and joins along time: clusters, repeats, gaps, adapters, nearest samples, correlation."""

from pyspark.sql import functions as F

from plumbline.operators import series
from plumbline.plans.common import E, events
from plumbline.registry import query
from plumbline.session import load

START, END = 1_704_412_800_000_000, 1_706_140_800_000_000  # 2024-01-05 and 2024-01-25, UTC microseconds


@query("recent_n", f"WITH {E} SELECT event_id, user_id, cents FROM e WHERE event_id > (SELECT max(event_id) FROM e) - 20")
def recent_n(spark, sf):
    return series.recent_n(events(spark, sf), 20, "event_id").select("event_id", "user_id", "cents")


@query(
    "recent_n_by_user",
    f"""WITH {E} SELECT event_id, user_id, cents FROM e
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""",
)
def recent_n_by_user(spark, sf):
    return series.recent_n(events(spark, sf), 20, "event_id", ["user_id"]).select("event_id", "user_id", "cents")


@query(
    "log_tail",
    """WITH t AS (SELECT event_id, event_type, row_number() OVER w AS n, count(*) OVER (PARTITION BY event_type) AS total
      FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'
      WINDOW w AS (PARTITION BY event_type ORDER BY event_id DESC))
    SELECT event_id, event_type, total > 200 AS truncated, CASE WHEN total > 200 THEN 'line_limit' END AS reason
    FROM t WHERE n <= 200""",
)
def log_tail(spark, sf):
    since, until = (F.timestamp_micros(F.lit(t).cast("bigint")) for t in (START, END))
    df = load(spark, sf, "events").select("event_id", "event_type", "ts")
    return series.log_tail(df, "event_type", "event_id", "ts", 200, since, until).drop("ts")


@query(
    "occurrence_number",
    """SELECT event_id, event_type, epoch_us(date_trunc('hour', ts)) AS hour_us, props AS detail,
      row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY props, event_id) - 1 AS occurrence
    FROM events""",
)
def occurrence_number(spark, sf):
    df = load(spark, sf, "events").select(
        "event_id", "event_type", F.unix_micros(F.date_trunc("hour", "ts")).alias("hour_us"), F.col("props").alias("detail")
    )
    return series.occurrence_number(df, ["event_type", "hour_us"], "detail", "event_id")


@query(
    "event_clusters",
    """WITH u AS (SELECT user_id, epoch_us(ts) AS us, count(*) AS n FROM events GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w >= 21600000000 THEN 1 ELSE 0 END AS s FROM u
      WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    c AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS cluster FROM f)
    SELECT user_id, cluster, min(us) AS first_us, max(us) AS last_us, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY 1, 2""",
)
def event_clusters(spark, sf):
    return series.event_clusters(load(spark, sf, "events"), ["user_id"], "ts", 6 * 3600 * 1_000_000)


@query(
    "collapse_repeats",
    """WITH f AS (SELECT event_id, user_id, event_type,
        CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM f)
    SELECT * FROM (SELECT user_id, run, event_type, count(*) AS "count", min(event_id) AS first, max(event_id) AS last FROM r GROUP BY ALL)""",
)
def collapse_repeats(spark, sf):
    return series.collapse_repeats(load(spark, sf, "events"), ["user_id"], "event_id", ["event_type"])


@query(
    "collapse_repeats_roles",
    """WITH f AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS s FROM conversations
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM f)
    SELECT * FROM (SELECT conv_id, run, role, count(*) AS "count", min(turn) AS first, max(turn) AS last FROM r GROUP BY ALL)""",
)
def collapse_repeats_roles(spark, sf):
    return series.collapse_repeats(load(spark, sf, "conversations"), ["conv_id"], "turn", ["role"])


@query(
    "gap_samples",
    """WITH w AS (SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events)
    SELECT event_id, event_type, CASE WHEN b > 0 THEN event_id - b - 1 ELSE 0 END AS missing,
      coalesce(b > 0 AND event_id > b + 1, false) AS gap FROM w""",
)
def gap_samples(spark, sf):
    df = load(spark, sf, "events").select("event_id", "event_type")
    return series.gap_samples(df, ["event_type"], "event_id")


@query(
    "gap_coverage",
    f"""WITH {E}, x AS (SELECT event_type, max(event_id) AS hi, count(*) AS total FROM e GROUP BY 1),
    w AS (SELECT e.event_type, event_id, cents, total, lag(event_id) OVER (PARTITION BY e.event_type ORDER BY event_id) AS b
      FROM e JOIN x ON e.event_type = x.event_type WHERE event_id > hi - 120)
    SELECT event_type, count(*) AS samples, count(*) FILTER (b > 0 AND event_id > b + 1) AS gaps,
      CAST(max(total) - count(*) + sum(CASE WHEN b > 0 THEN event_id - b - 1 ELSE 0 END) AS BIGINT) AS omitted,
      min(event_id) AS coverage_start, max(event_id) + 1 AS coverage_end, count(*) FILTER (cents > 5000) AS errors
    FROM w GROUP BY 1""",
)
def gap_coverage(spark, sf):
    return series.gap_coverage(events(spark, sf), ["event_type"], "event_id", F.col("cents") > 5000, 120)


# a delivery sequence per user: errors repeat the previous number, some views skip one
DELIVERY = f"""{E}, d AS (SELECT event_id, user_id, cents, strlen(props) AS size, CAST(sum(CASE WHEN event_type = 'error' THEN 0
  WHEN event_type = 'view' AND cents > 5000 THEN 2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq FROM e)"""


def delivery_step():
    kind = F.col("event_type")
    return F.when(kind == "error", 0).when((kind == "view") & (F.col("cents") > 5000), 2).otherwise(1).cast("bigint")


def deliveries(spark, sf):
    df = events(spark, sf).withColumn("size", F.octet_length("props").cast("bigint"))
    numbered = series.running_total(df, ["user_id"], "event_id", seq=delivery_step())
    return numbered.select("event_id", "user_id", "cents", "size", "seq")


AUDIT_SQL = f"""WITH {DELIVERY}, w AS (SELECT *, lag(seq) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM d)
    SELECT event_id, user_id, seq, CASE WHEN b IS NULL THEN 'first' WHEN seq = b + 1 THEN 'next' WHEN seq = b THEN 'duplicate'
      WHEN seq > b + 1 THEN 'gap' ELSE 'backward' END AS verdict FROM w"""


@query("sequence_audit", AUDIT_SQL)
def sequence_audit(spark, sf):
    return series.sequence_audit(deliveries(spark, sf), ["user_id"], "seq", "event_id").drop("cents", "size")


@query(
    "connection_gap",
    """WITH w AS (SELECT event_id, user_id, CAST(day(ts) AS INT) AS epoch,
      lag(day(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT event_id, user_id, epoch, CASE WHEN b <> epoch THEN
      'Connection gap observed; events during disconnection were not observed.' END AS caution FROM w""",
)
def connection_gap(spark, sf):
    df = load(spark, sf, "events").select("event_id", "user_id", F.dayofmonth("ts").alias("epoch"))
    return series.connection_gap(df, ["user_id"], "event_id", "epoch")


@query(
    "series_adapter",
    f"""WITH {E}, p AS (SELECT '10:event_type' || length(event_type) || ':' || event_type || '4:user' || length(user_id::VARCHAR) || ':' || user_id AS series,
        us AS at_us, CASE WHEN event_type = 'error' THEN 'NaN' ELSE printf('%d.%02d', cents // 100, cents % 100) END AS v FROM e)
    SELECT series, at_us, CASE WHEN v = 'NaN' THEN 0.0 ELSE CAST(v AS DOUBLE) END AS "value", v = 'NaN' AS gap
    FROM p WHERE at_us >= {START} AND at_us < {END}""",
)
def series_adapter(spark, sf):
    df = events(spark, sf)
    seconds = (F.col("us").cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(20,6)").cast("string")
    amount = F.format_string("%d.%02d", F.expr("cents div 100"), F.col("cents") % 100)
    value = F.when(F.col("event_type") == "error", "NaN").otherwise(amount)
    metric = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"))
    body = F.to_json(F.struct(metric.alias("metric"), F.array(F.array(seconds, value)).alias("values")))
    adapted = series.series_adapter(df.select(body.alias("body")), F.col("body"), START, END)
    return adapted.withColumn("value", F.col("value").cast("double"))


@query(
    "log_adapter",
    f"""WITH {E}, p AS (SELECT '10:event_type' || length(event_type) || ':' || event_type AS label, (us // 3600000000) * 3600000000000 AS at_ns, props AS detail FROM e
      WHERE us // 3600000000 * 3600000000 >= {START} AND us // 3600000000 * 3600000000 < {END})
    SELECT label || '/' || at_ns || '/' || (row_number() OVER (PARTITION BY label, at_ns ORDER BY detail) - 1) AS id, at_ns, label, detail FROM p""",
)
def log_adapter(spark, sf):
    hour_ns = F.unix_micros(F.date_trunc("hour", "ts")) * 1000
    stream = F.create_map(F.lit("event_type"), F.col("event_type"))
    values = F.array(F.array(hour_ns.cast("string"), F.col("props")))
    body = F.to_json(F.struct(stream.alias("stream"), values.alias("values")))
    df = load(spark, sf, "events").select(body.alias("body"))
    return series.log_adapter(df, F.col("body"), START, END)


@query(
    "timeline_check",
    f"""WITH {E}, s AS (SELECT event_type AS series, event_id AS arrival, CASE WHEN cents > 8000 THEN us - 7200000000 ELSE us END AS at_us,
        CAST(us // 60000000 AS VARCHAR) AS id, CASE WHEN k = 99 THEN 's' ELSE 'ms' END AS unit FROM e),
    w AS (SELECT *, lag(at_us) OVER (PARTITION BY series ORDER BY arrival) AS b FROM s),
    i AS (SELECT series, count(*) AS n, count(DISTINCT id) AS d FROM s GROUP BY 1)
    SELECT 'series_over_limit' AS rule, greatest((SELECT count(*) FROM i) - 4, 0) AS violations
    UNION ALL SELECT 'records_over_limit', greatest((SELECT count(*) FROM s) - 9000, 0)
    UNION ALL SELECT 'unsorted', (SELECT count(*) FROM w WHERE b > at_us)
    UNION ALL SELECT 'duplicate_ids', (SELECT CAST(sum(n - d) AS BIGINT) FROM i)
    UNION ALL SELECT 'outside_range', (SELECT count(*) FROM s WHERE at_us < {START} OR at_us >= {END})
    UNION ALL SELECT 'mixed_units', (SELECT CAST(count(DISTINCT unit) > 1 AS BIGINT) FROM s)""",
)
def timeline_check(spark, sf):
    c = F.col
    samples = events(spark, sf).select(
        c("event_type").alias("series"),
        c("event_id").alias("arrival"),
        F.when(c("cents") > 8000, c("us") - 7_200_000_000).otherwise(c("us")).alias("at_us"),
        F.expr("us div 60000000").cast("string").alias("id"),
        F.when(c("k") == 99, "s").otherwise("ms").alias("unit"),
    )
    return series.timeline_check(samples, "arrival", START, END, max_series=4, max_records=9000)


@query(
    "timeline_model_check",
    f"""WITH {E}, s AS (SELECT event_type AS series, event_id AS arrival, us AS at_us, CAST(us // 60000000 AS VARCHAR) AS id FROM e),
    i AS (SELECT series, count(*) AS n, count(DISTINCT id) AS d FROM s GROUP BY 1),
    v AS (SELECT event_id, CASE WHEN k > 90 THEN us - 7200000000 ELSE us END AS at_us, CAST(us // 3600000000 AS VARCHAR) AS id FROM e WHERE event_type = 'error'),
    w AS (SELECT *, lag(at_us) OVER (ORDER BY event_id) AS b FROM v),
    c AS (SELECT min(us) - 1 AS a, max(us) + 1 AS b FROM e GROUP BY us // 604800000000)
    SELECT 'unsorted' AS rule, (SELECT count(*) FROM (SELECT at_us, lag(at_us) OVER (PARTITION BY series ORDER BY arrival) AS b FROM s) WHERE b > at_us) AS violations
    UNION ALL SELECT 'duplicate_ids', (SELECT CAST(sum(n - d) AS BIGINT) FROM i)
    UNION ALL SELECT 'outside_range', (SELECT count(*) FROM s WHERE at_us < {START} OR at_us >= {END})
    UNION ALL SELECT 'events_unsorted', (SELECT count(*) FROM w WHERE b > at_us)
    UNION ALL SELECT 'events_duplicate_ids', (SELECT count(*) - count(DISTINCT id) FROM v)
    UNION ALL SELECT 'events_outside_range', (SELECT count(*) FROM v WHERE at_us < {START} OR at_us >= {END})
    UNION ALL SELECT 'series_over_limit', (SELECT greatest(count(*) - 4, 0) FROM (SELECT DISTINCT event_type, k = 99 FROM e))
    UNION ALL SELECT 'duplicate_series', (SELECT count(*) - count(DISTINCT event_type) FROM (SELECT DISTINCT event_type, k = 99 FROM e))
    UNION ALL SELECT 'mixed_units', (SELECT CAST(count(DISTINCT k = 99) > 1 AS BIGINT) FROM e)
    UNION ALL SELECT 'records_over_limit', (SELECT greatest((SELECT count(*) FROM s) + (SELECT count(*) FROM v) - 900, 0))
    UNION ALL SELECT 'coverage_outside_range', (SELECT count(*) FROM c WHERE a < {START} OR b > {END})""",
)
def timeline_model_check(spark, sf):
    """Series, samples, events and weekly coverage of the event table against all rules of a timeline."""
    df, c = events(spark, sf), F.col
    samples = df.select(
        c("event_type").alias("series"), c("event_id").alias("arrival"), c("us").alias("at_us"), F.expr("us div 60000000").cast("string").alias("id"), F.lit("ms").alias("unit")
    )
    declared = df.select(c("event_type").alias("id"), F.when(c("k") == 99, "s").otherwise("ms").alias("unit")).distinct()
    shifted = F.when(c("k") > 90, c("us") - 7_200_000_000).otherwise(c("us")).alias("at_us")
    errors = df.where("event_type = 'error'").select(F.expr("us div 3600000000").cast("string").alias("id"), shifted, c("event_id").alias("arrival"))
    weeks = df.groupBy(F.expr("us div 604800000000")).agg((F.min("us") - 1).alias("start_us"), (F.max("us") + 1).alias("end_us")).select("start_us", "end_us")
    return series.timeline_model_check(declared, samples, errors, weeks, "arrival", START, END, max_series=4, max_records=900)


@query(
    "nearest_join",
    f"""WITH {E}, c AS (SELECT DISTINCT user_id, us FROM e WHERE event_type = 'error'),
    s AS (SELECT user_id, us, min(event_id) AS id FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
    n AS (SELECT c.user_id, c.us, b.us AS b_us, b.id AS b_id, a.us AS a_us, a.id AS a_id
      FROM c ASOF LEFT JOIN s b ON c.user_id = b.user_id AND c.us >= b.us
      ASOF LEFT JOIN s a ON c.user_id = a.user_id AND c.us <= a.us),
    r AS (SELECT *, b_us IS NOT NULL AND (a_us IS NULL OR us - b_us <= a_us - us) AS earlier FROM n)
    SELECT user_id, us AS cursor_us, CASE WHEN earlier THEN b_us ELSE a_us END AS sample_us,
      CASE WHEN earlier THEN b_id ELSE a_id END AS sample, abs(CASE WHEN earlier THEN b_us ELSE a_us END - us) AS distance_us FROM r""",
)
def nearest_join(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    cursors, samples = df.where("event_type = 'error'"), df.where("event_type = 'purchase'")
    return series.nearest_join(cursors, samples, ["user_id"], "ts", F.col("event_id"))


@query(
    "range_correlate",
    f"""WITH {E}, w AS (SELECT event_id AS selection, us - 1800000000 AS from_us, us + 1800000000 AS to_us FROM e WHERE event_type = 'purchase' AND cents >= 6000)
    SELECT selection, from_us, to_us, event_id, event_type AS source, us AS at_us FROM w JOIN e ON us >= from_us AND us < to_us
    WHERE event_type IN ('error', 'signup')""",
)
def range_correlate(spark, sf):
    df = events(spark, sf)
    picked = df.where((F.col("event_type") == "purchase") & (F.col("cents") >= 6000))
    selections = picked.select(
        F.col("event_id").alias("selection"),
        (F.col("us") - 1_800_000_000).alias("from_us"),
        (F.col("us") + 1_800_000_000).alias("to_us"),
    )
    rows = df.select("event_id", "ts", "event_type")
    sources = {kind: rows.where(F.col("event_type") == kind).drop("event_type") for kind in ("error", "signup")}
    found = series.range_correlate(selections, sources, "ts", "from_us", "to_us", 3_600_000_000)
    return found.select("selection", "from_us", "to_us", "event_id", "source", "at_us")


@query(
    "code_lookup",
    f"""WITH {E}, c AS (SELECT event_id, CAST(CASE WHEN k < 50 THEN 400 + k ELSE 450 + k END AS INT) AS code FROM e)
    SELECT event_id, code, coalesce(s.name, 'Unassigned') AS name, CASE WHEN code < 500 THEN 'client-error' ELSE 'server-error' END AS class,
      CASE WHEN s.name IS NULL THEN 'unassigned' WHEN contains(s.name, 'Unused') THEN 'unused' WHEN contains(s.name, 'OBSOLETED') THEN 'obsolete' ELSE 'registered' END AS registration,
      coalesce(s.reference, '') AS reference, 'iana-2025-09-15' AS catalogue_version
    FROM c LEFT JOIN (VALUES @STATUSES@) AS s(code, name, reference) USING (code)""".replace(
        "@STATUSES@",
        ", ".join("({}, '{}', '{}')".format(*(str(v).replace("'", "''") for v in s)) for s in __import__(
            "plumbline.functions.codes", fromlist=["STATUSES"]
        ).STATUSES),
    ),
)
def code_lookup(spark, sf):
    from plumbline.functions.codes import code_lookup as lookup

    code = F.when(F.col("k") < 50, 400 + F.col("k")).otherwise(450 + F.col("k")).cast("int")
    return lookup(events(spark, sf).select("event_id", code.alias("code")), "code")


@query(
    "error_lookup",
    f"""WITH {E}, c AS (SELECT event_id, CASE WHEN k < 10 THEN 'HTTP00' || k WHEN k < 50 THEN 'HTTP_STATUS_' || (450 + k) ELSE 'HTTPD00' || (k % 4) END AS code FROM e)
    SELECT event_id, code, code IN ('HTTP001', 'HTTP002', 'HTTP003', 'HTTP004', 'HTTP005', 'HTTP006', 'HTTP007', 'HTTP008', 'HTTP009', 'HTTPD001', 'HTTPD002') OR starts_with(code, 'HTTP_STATUS_') AS known,
      CASE code WHEN 'HTTP001' THEN 'request' WHEN 'HTTP002' THEN 'credential' WHEN 'HTTP003' THEN 'transport' WHEN 'HTTP004' THEN 'timeout'
        WHEN 'HTTP005' THEN 'redirect' WHEN 'HTTP006' THEN 'size' WHEN 'HTTP007' THEN 'response' WHEN 'HTTP008' THEN 'status' WHEN 'HTTP009' THEN 'internal'
        WHEN 'HTTPD001' THEN 'domain-input' WHEN 'HTTPD002' THEN 'domain-limit'
        ELSE CASE WHEN starts_with(code, 'HTTP_STATUS_') THEN 'status-detail' ELSE 'unknown' END END AS category FROM c""",
)
def error_lookup(spark, sf):
    from plumbline.functions.codes import error_lookup as lookup

    k = F.col("k")
    code = (
        F.when(k < 10, F.concat(F.lit("HTTP00"), k.cast("string")))
        .when(k < 50, F.concat(F.lit("HTTP_STATUS_"), (450 + k).cast("string")))
        .otherwise(F.concat(F.lit("HTTPD00"), (k % 4).cast("string")))
    )
    return lookup(events(spark, sf).select("event_id", code.alias("code")), "code")
