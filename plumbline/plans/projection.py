"""Projection, filters, branching, sorting, set-like operators and table previews."""

from pyspark.sql import functions as F

from plumbline.functions.exact import cents
from plumbline.operators import rows, summaries
from plumbline.plans.common import LINE_KEYS, E, L, events, lines, plain
from plumbline.registry import query
from plumbline.session import load


@query("map", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * 2 AS doubled, year(o_orderdate)::INT AS y FROM orders")
def map_(spark, sf):
    orders = load(spark, sf, "orders")
    return rows.map_rows(
        orders, o_orderkey=F.col("o_orderkey"), doubled=cents(F.col("o_totalprice")) * 2, y=F.year("o_orderdate")
    )


@query(
    "filter",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'",
)
def filter_(spark, sf):
    orders = load(spark, sf, "orders")
    predicate = (F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "F")
    kept = rows.filter_rows(orders, predicate, reads=["o_totalprice", "o_orderstatus"])
    return kept.select("o_orderkey", "o_custkey")


@query("field", "SELECT o_orderpriority FROM orders")
def field_(spark, sf):
    return rows.field(load(spark, sf, "orders"), "o_orderpriority")


@query(
    "with_fields",
    "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders",
)
def with_fields_(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = rows.with_fields(orders, o_orderstatus=F.lower("o_orderstatus"), cents=cents(F.col("o_totalprice")))
    return changed.drop("o_totalprice")


@query(
    "compare",
    f"""WITH {L} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    q = l_linenumber AS eq, q <> l_linenumber AS ne, q < l_linenumber AS lt, q <= l_linenumber AS le,
    q > l_linenumber AS gt, q >= l_linenumber AS ge,
    (q > 10 AND p > 1000000) OR NOT (l_linenumber < 3) AS both_ways FROM l""",
)
def compare_(spark, sf):
    df = lines(spark, sf)
    found = rows.compare(df, F.col("q"), F.col("l_linenumber"))
    mixed = ((F.col("q") > 10) & (F.col("p") > 1_000_000)) | ~(F.col("l_linenumber") < 3)
    return df.select(*LINE_KEYS, *[c.alias(n) for n, c in found.items()], mixed.alias("both_ways"))


@query(
    "interval_filter",
    "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00'",
)
def interval_filter_(spark, sf):
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-05 00:00:00", "2024-01-12 12:00:00"))
    return rows.interval_filter(load(spark, sf, "events"), "ts", start, end).select("event_id", "user_id")


@query(
    "around_filter",
    "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-09 18:00:00' AND ts < TIMESTAMP '2024-01-10 06:00:00'",
)
def around_filter_(spark, sf):
    near = rows.around_filter(load(spark, sf, "events"), "ts", "2024-01-10 00:00:00", 6 * 3600 * 1_000_000)
    return near.select("event_id", "user_id")


@query(
    "fork",
    f"""WITH {E}
    SELECT event_id, 'broken' AS branch, CAST(NULL AS BIGINT) AS result, 'failed' AS outcome FROM e
    UNION ALL SELECT event_id, 'doubled', cents * 2, 'success' FROM e WHERE cents > 1000
    UNION ALL SELECT event_id, 'incremented', cents + 1, 'success' FROM e""",
)
def fork_(spark, sf):
    df = events(spark, sf)
    every = F.lit(True)
    branches = {"broken": every, "doubled": F.col("cents") > 1000, "incremented": every}
    outputs = {
        "broken": F.col("event_type").try_cast("bigint"),
        "doubled": F.try_multiply(F.col("cents"), F.lit(2)),
        "incremented": F.try_add(F.col("cents"), F.lit(1)),
    }
    return rows.fork(df, branches, outputs).select("event_id", "branch", "result", "outcome")


@query(
    "fork_outcomes",
    f"""WITH {E}, a AS (
      SELECT event_id, 'halved' AS branch, CASE WHEN k % 2 = 0 AND k <> 10 THEN k // 2 END AS result,
        CASE WHEN event_type = 'refund' THEN 'cancelled' WHEN k % 2 = 1 THEN 'failed' ELSE 'success' END AS outcome,
        CASE WHEN event_type <> 'refund' AND k % 2 = 1 THEN 'odd ' || k END AS error FROM e
      UNION ALL SELECT event_id, 'signed', -cents, 'success', NULL FROM e WHERE cents > 1000),
    b AS (SELECT *, CASE WHEN outcome = 'success' THEN result END AS value FROM a)
    SELECT event_id, branch AS source, 'kept' AS branch, value AS result FROM b WHERE outcome = 'success' AND (value IS NULL OR value > 4)
    UNION ALL SELECT event_id, branch, 'lost', event_id FROM b WHERE outcome = 'failed' AND error IS NOT NULL
    UNION ALL SELECT event_id, branch, 'stopped', -event_id FROM b WHERE outcome = 'cancelled'""",
)
def fork_outcomes(spark, sf):
    """A fork whose branches fail, give up or return none, and one after it that chooses by outcome."""
    df = events(spark, sf).select("event_id", "event_type", "k", "cents")
    odd = F.when(F.col("k") % 2 == 1, F.concat(F.lit("odd "), F.col("k").cast("string")))
    half = F.when(F.col("k") != 10, F.call_function("div", F.col("k"), F.lit(2)))
    first = rows.fork(
        df,
        {"halved": F.lit(True), "signed": F.col("cents") > 1000},
        {"halved": half, "signed": -F.col("cents")},
        errors={"halved": odd},
        cancelled={"halved": F.col("event_type") == "refund"},
    )
    seen = first.select("event_id", F.col("branch").alias("source"), F.col("result").alias("value"), "outcome", "error")
    large = F.col("value").isNull() | (F.col("value") > 4)
    second = rows.fork(
        seen,
        {"kept": rows.on("success", large), "lost": rows.on("failed") & F.col("error").isNotNull(), "stopped": rows.on("cancelled")},
        {"kept": F.col("value"), "lost": F.col("event_id"), "stopped": -F.col("event_id")},
        errors={"kept": F.lit(None)},
    )
    return second.select("event_id", "source", "branch", "result")


@query(
    "sort_by",
    """SELECT o_orderkey, row_number() OVER (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) - 1 AS position
    FROM orders""",
)
def sort_by_(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("price"))
    return rows.sort_by(orders, "price", "o_orderkey", numbered=True).drop("price")


@query("take", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def take_(spark, sf):
    first = rows.take(load(spark, sf, "orders"), 100, "o_orderdate", "o_orderkey")
    return first.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    "skip",
    """SELECT o_orderkey, position FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)
    WHERE position >= 1000""",
)
def skip_(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rows.skip(orders, 1000, "o_orderdate", "o_orderkey").select("o_orderkey", "position")


@query(
    "slice",
    """SELECT o_orderkey, position FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)
    WHERE position >= 200 AND position < 700""",
)
def slice_(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rows.slice_rows(orders, 200, 700, "o_orderdate", "o_orderkey").select("o_orderkey", "position")


@query(
    "concat",
    "SELECT 0 AS part, s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT 1, c_name, c_nationkey FROM customer",
)
def concat_(spark, sf):
    suppliers = load(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    customers = load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return rows.concat(suppliers, customers)


@query(
    "distinct_guard",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def distinct_guard_(spark, sf):
    return rows.distinct_guard(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "bounded_listing",
    """SELECT p_partkey, p_name, 50::BIGINT AS returned, (SELECT count(*) FROM part) - 50 AS omitted,
    (SELECT count(*) FROM part) <= 50 AS complete FROM part ORDER BY p_retailprice, p_partkey LIMIT 50""",
)
def bounded_listing_(spark, sf):
    listed = rows.bounded_listing(load(spark, sf, "part"), 50, "p_retailprice", "p_partkey")
    return listed.select("p_partkey", "p_name", "returned", "omitted", "complete")


@query(
    "value_page",
    """WITH t AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS position,
      count(*) OVER () AS total FROM part)
    SELECT p_partkey, p_size, position, 40::BIGINT AS "count", total,
      CASE WHEN 140 < total THEN 140::BIGINT END AS next_offset
    FROM t WHERE position >= 100 AND position < 140""",
)
def value_page_(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_size")
    return rows.value_page(part, 100, 40, "p_size", "p_partkey")


@query(
    "domain_preview",
    """WITH d AS (SELECT p_size AS v, min(p_partkey) AS first_at, count(*) AS occurrences FROM part GROUP BY 1)
    SELECT v, first_at, occurrences, (SELECT count(*) FROM d) AS total, (SELECT count(*) FROM d) <= 20 AS complete
    FROM d ORDER BY first_at LIMIT 20""",
)
def domain_preview_(spark, sf):
    part = load(spark, sf, "part").select(F.col("p_size").alias("v"), "p_partkey")
    return summaries.domain_preview(part, "v", "p_partkey", limit=20)


@query("as_table", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def as_table_(spark, sf):
    return rows.as_table(load(spark, sf, "part"), ["p_partkey", "p_name", "p_size"])


@query(
    "csv_export",
    """SELECT doc_id, '"' || doc_id || '","' || lang || '","' || replace(text, '"', '""') || '"' || chr(13) || chr(10) AS line
    FROM documents""",
)
def csv_export_(spark, sf):
    docs = rows.as_table(load(spark, sf, "documents"), ["doc_id", "lang", "text"])
    table = docs.withColumn("key", F.col("doc_id").cast("bigint"))
    return rows.csv_rows(table, ["doc_id", "lang", "text"]).select(F.col("key").alias("doc_id"), "line")


@query(
    "line_series",
    f"""WITH {E}, t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(cents AS VARCHAR) END AS reading FROM e)
    SELECT event_id, CAST(event_id AS VARCHAR) AS x, CAST(reading AS DOUBLE) AS y,
    (SELECT count(*) FROM t WHERE reading = 'n/a') AS dropped FROM t WHERE reading <> 'n/a'""",
)
def line_series_(spark, sf):
    df = events(spark, sf)
    reading = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("cents").cast("string"))
    return plain(rows.line_series(df, F.col("event_id").cast("string"), reading, "event_id"))
