"""Scalar functions over whole tables: exact arithmetic, time, text, options, JSON."""

from pyspark.sql import functions as F

from plumbline.functions import exact, temporal, text, values
from plumbline.functions.definitions import define
from plumbline.plans.common import LINE_KEYS, E, L, events, half_even, lines, plain
from plumbline.registry import query
from plumbline.session import load

_K = ", ".join(LINE_KEYS)


@query(
    "arithmetic",
    f"WITH {L} SELECT {_K}, q + p AS plus, q - p AS minus, q * p AS times, -q AS negated, (q * 1.25)::DOUBLE AS scaled FROM l",
)
def arithmetic(spark, sf):
    q, p = F.col("q"), F.col("p")
    scaled = q.cast("decimal(18,0)") * F.lit("1.25").cast("decimal(3,2)")
    df = lines(spark, sf).select(
        *LINE_KEYS, (q + p).alias("plus"), (q - p).alias("minus"), (q * p).alias("times"), (-q).alias("negated"), scaled.alias("scaled")
    )
    return plain(df)


@query("exact_div", f"WITH {L} SELECT {_K}, p::DOUBLE / (1 << l_linenumber) AS quotient, q::DOUBLE / 128 AS small FROM l")
def exact_div(spark, sf):
    power = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("l_linenumber"))
    df = lines(spark, sf).select(
        *LINE_KEYS,
        exact.exact_div(F.col("p"), power).alias("quotient"),
        exact.exact_div(F.col("q"), F.lit(128)).alias("small"),
    )
    return plain(df)


@query("div", f"WITH {L} SELECT {_K}, p // q AS quotient, -(p // q) AS negative FROM l")
def div(spark, sf):
    p, q = F.col("p"), F.col("q")
    return lines(spark, sf).select(*LINE_KEYS, exact.div(p, q).alias("quotient"), exact.div(-p, q).alias("negative"))


@query("rem", f"WITH {L} SELECT {_K}, p % q AS rest, -(p % q) AS negative FROM l")
def rem(spark, sf):
    p, q = F.col("p"), F.col("q")
    return lines(spark, sf).select(*LINE_KEYS, exact.rem(p, q).alias("rest"), exact.rem(-p, q).alias("negative"))


@query(
    "round_div",
    f"WITH {L} SELECT {_K}, {half_even('p', 'q', 2)} AS two, {half_even('p', '8', 0)} AS ties, -{half_even('p', 'q', 1)} AS negative FROM l",
)
def round_div(spark, sf):
    p, q = F.col("p"), F.col("q")
    df = lines(spark, sf).select(
        *LINE_KEYS,
        exact.round_div(p, q, 2).alias("two"),
        exact.round_div(p, F.lit(8), 0).alias("ties"),
        exact.round_div(-p, q, 1).alias("negative"),
    )
    return plain(df)


@query(
    "exact_div_decimal",
    f"WITH {L} SELECT {_K}, (p::DOUBLE / 25) AS quotient, -(q::DOUBLE * 2) AS negative FROM l",
)
def exact_div_decimal(spark, sf):
    """Decimal operands of unequal scales."""
    price, quarter = (F.col("p") / 100).cast("decimal(18,2)"), F.lit("0.25").cast("decimal(5,3)")
    half = F.lit("-0.5").cast("decimal(2,1)")
    df = lines(spark, sf).select(
        *LINE_KEYS,
        exact.exact_div(price, quarter, 2).alias("quotient"),
        exact.exact_div(F.col("q").cast("decimal(20,0)"), half, 1).alias("negative"),
    )
    return plain(df)


@query(
    "round_div_decimal",
    f"WITH {L} SELECT {_K}, {half_even('p', 'q * 50', 3)} AS rounded, -{half_even('p * 2', 'q * 5', 0)} AS negative FROM l",
)
def round_div_decimal(spark, sf):
    """Decimal operands of unequal scales, with ties and signs."""
    price, half = (F.col("p") / 100).cast("decimal(18,2)"), (F.col("q") / 2).cast("decimal(12,1)")
    tenth = (F.col("q") / -40).cast("decimal(12,3)")
    df = lines(spark, sf).select(
        *LINE_KEYS,
        exact.round_div(price, half, 3, operand_scale=2).alias("rounded"),
        exact.round_div(price, tenth, 0, operand_scale=3).alias("negative"),
    )
    return plain(df)


@query(
    "exact_div_text",
    f"""WITH {L}, x AS (SELECT {_K}, 20 + l_linenumber AS places, p, p::HUGEINT * CAST(power(5, 7) AS HUGEINT) AS a FROM l),
    y AS (SELECT {_K}, places, p, a * CAST(power(5, 13) AS HUGEINT) * CAST(power(5, l_linenumber) AS HUGEINT) AS n FROM x),
    z AS (SELECT {_K}, (n // CAST('1' || repeat('0', places) AS HUGEINT))::VARCHAR AS whole,
      rtrim(lpad((n % CAST('1' || repeat('0', places) AS HUGEINT))::VARCHAR, places, '0'), '0') AS digits FROM y)
    SELECT {_K}, whole || CASE WHEN digits = '' THEN '' ELSE '.' || digits END AS quotient FROM z""",
)
def exact_div_text(spark, sf):
    """Quotients that end only after 21 to 27 places."""
    power = F.call_function("shiftleft", F.lit(1 << 20).cast("bigint"), F.col("l_linenumber"))
    return lines(spark, sf).select(*LINE_KEYS, exact.exact_div_text(F.col("p"), power).alias("quotient"))


@query(
    "round_div_text",
    f"""WITH {L}, x AS (SELECT {_K}, p::HUGEINT * CAST('1' || repeat('0', 30) AS HUGEINT) AS t, q::HUGEINT * 7 AS b FROM l),
    y AS (SELECT {_K}, t // b + CASE WHEN 2 * (t % b) > b OR (2 * (t % b) = b AND (t // b) % 2 = 1) THEN 1 ELSE 0 END AS n FROM x)
    SELECT {_K}, (n // CAST('1' || repeat('0', 30) AS HUGEINT))::VARCHAR || '.'
      || lpad((n % CAST('1' || repeat('0', 30) AS HUGEINT))::VARCHAR, 30, '0') AS rounded FROM y""",
)
def round_div_text(spark, sf):
    return lines(spark, sf).select(*LINE_KEYS, exact.round_div_text(F.col("p"), F.col("q") * 7, 30).alias("rounded"))


@query("int", f"WITH {L} SELECT {_K}, p AS from_text, q AS from_decimal FROM l")
def int_(spark, sf):
    written = F.concat(F.lit("+"), F.col("p").cast("string"))
    whole = F.col("q").cast("decimal(20,3)")
    return lines(spark, sf).select(
        *LINE_KEYS, exact.text_to_int(written).alias("from_text"), exact.to_int(whole).alias("from_decimal")
    )


@query("decimal", f"WITH {L} SELECT {_K}, p / 100.0 AS from_text, q::DOUBLE AS from_int FROM l")
def decimal(spark, sf):
    written = F.format_string("%d.%02d", exact.div(F.col("p"), F.lit(100)), F.col("p") % 100)
    df = lines(spark, sf).select(
        *LINE_KEYS, exact.to_decimal(written, 2).alias("from_text"), exact.to_decimal(F.col("q"), 0).alias("from_int")
    )
    return plain(df)


@query(
    "text",
    f"""WITH {E} SELECT event_id, CAST(cents AS VARCHAR) AS from_int, printf('%d.%02d', cents // 100, cents % 100) AS from_decimal,
      CASE WHEN k > 50 THEN 'true' ELSE 'false' END AS from_bool, event_type || '/' || k AS joined FROM e""",
)
def text_(spark, sf):
    amount = (F.col("cents").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")
    return events(spark, sf).select(
        "event_id",
        F.col("cents").cast("string").alias("from_int"),
        amount.cast("string").alias("from_decimal"),
        (F.col("k") > 50).cast("string").alias("from_bool"),
        F.concat("event_type", F.lit("/"), F.col("k").cast("string")).alias("joined"),
    )


@define("Decimal", total="Int", parts="Int")
def share(total, parts):
    return exact.round_div(total, F.greatest(parts, F.lit(1)), 1)


@query("define", f"WITH {E} SELECT event_id, {half_even('cents', 'CASE WHEN k < 1 THEN 1 ELSE k END', 1)} AS share FROM e")
def define_(spark, sf):
    df = events(spark, sf)
    return plain(df.select("event_id", share.over(df, total=F.col("cents"), parts=F.col("k")).alias("share")))


_DAY = 86_400_000_000


@query("instant", f"WITH {E} SELECT event_id, us * 1000 - 7200000000000 AS shifted_ns, us AS utc_us FROM e")
def instant(spark, sf):
    local = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    zulu = temporal.instant_text(F.col("ts"))
    return load(spark, sf, "events").select(
        "event_id",
        temporal.instant_ns(local).alias("shifted_ns"),
        F.unix_micros(temporal.instant(zulu)).alias("utc_us"),
    )


@query(
    "instant_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
      WHEN epoch_us(ts) % 1000 = 0 THEN strftime(ts, '.%g') ELSE strftime(ts, '.%f') END || 'Z' AS written,
      strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS whole FROM events""",
)
def instant_text(spark, sf):
    return load(spark, sf, "events").select(
        "event_id",
        temporal.instant_text(F.col("ts")).alias("written"),
        temporal.instant_text(F.date_trunc("second", "ts")).alias("whole"),
    )


@query("duration", f"WITH {E} SELECT event_id, (k * 3600 + cents) * 1000000000 + 500000000 AS ns, -(k * 60) * 1000000000 AS negative FROM e")
def duration(spark, sf):
    k, cents = F.col("k").cast("string"), F.col("cents").cast("string")
    written = F.concat(F.lit("PT"), k, F.lit("H"), cents, F.lit(".5S"))
    return events(spark, sf).select(
        "event_id",
        temporal.duration_ns(written).alias("ns"),
        temporal.duration_ns(F.concat(F.lit("-PT"), k, F.lit("M"))).alias("negative"),
    )


@query(
    "duration_text",
    f"""WITH {E}, t AS (SELECT event_id, us % {_DAY} AS d FROM e),
    p AS (SELECT *, d // 3600000000 AS h, d // 60000000 % 60 AS m, d // 1000000 % 60 AS s, d % 1000000 AS f FROM t)
    SELECT event_id, 'PT' || CASE WHEN h <> 0 THEN h || 'H' ELSE '' END || CASE WHEN m <> 0 THEN m || 'M' ELSE '' END ||
      CASE WHEN s = 0 AND f = 0 AND (h <> 0 OR m <> 0) THEN ''
        ELSE s || CASE WHEN f > 0 THEN '.' || rtrim(printf('%06d', f), '0') ELSE '' END || 'S' END AS written FROM p""",
)
def duration_text(spark, sf):
    in_day = F.col("us") % _DAY
    return events(spark, sf).select("event_id", temporal.duration_text(in_day * 1000).alias("written"))


@query(
    "interval",
    f"WITH {E} SELECT event_id, us AS start_us, us + cents * 1000000 AS end_us, cents > 0 AS holds_start, us % 2 = 0 AND cents > 10 AS holds_later FROM e",
)
def interval(spark, sf):
    at = F.col("ts")
    end = temporal.plus(at, F.col("cents") * 1_000_000_000)
    span = temporal.interval(at, end)
    later = temporal.plus(at, F.lit(10_000_000_000).cast("bigint"))
    return events(spark, sf).select(
        "event_id",
        F.unix_micros(span["start"]).alias("start_us"),
        F.unix_micros(span["end"]).alias("end_us"),
        temporal.contains(span, at).alias("holds_start"),
        ((F.col("us") % 2 == 0) & temporal.contains(span, later)).alias("holds_later"),
    )


@query("around", f"WITH {E} SELECT event_id, us - (cents + 1) * 1000 AS start_us, us + (cents + 1) * 1000 AS end_us FROM e")
def around(spark, sf):
    span = temporal.around(F.col("ts"), (F.col("cents") + 1) * 1_000_000)
    return events(spark, sf).select(
        "event_id", F.unix_micros(span["start"]).alias("start_us"), F.unix_micros(span["end"]).alias("end_us")
    )


@query("from_epoch", f"WITH {E} SELECT event_id, us // 1000000 * 1000000 AS seconds_us, us // 1000 * 1000 AS millis_us, us AS nanos_us, us AS exact_us FROM e")
def from_epoch(spark, sf):
    us = F.col("us")
    exact_seconds = (us.cast("decimal(19,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(25,6)")
    cases = {
        "seconds_us": temporal.from_epoch(exact.div(us, F.lit(1_000_000)), "seconds"),
        "millis_us": temporal.from_epoch(exact.div(us, F.lit(1000)), "millis"),
        "nanos_us": temporal.from_epoch(us * 1000, "nanos"),
        "exact_us": temporal.from_epoch(exact_seconds, "seconds"),
    }
    return events(spark, sf).select("event_id", *[F.unix_micros(v).alias(n) for n, v in cases.items()])


@query("to_epoch", f"WITH {E} SELECT event_id, us / 1000000.0 AS seconds, us / 1000.0 AS millis, us * 1000 AS nanos FROM e")
def to_epoch(spark, sf):
    at = F.col("ts")
    nanos = temporal.to_epoch(at, "nanos").cast("bigint").alias("nanos")
    others = [temporal.to_epoch(at, unit).alias(unit) for unit in ("seconds", "millis")]
    return plain(load(spark, sf, "events").select("event_id", *others, nanos))


@query(
    "duration_units",
    f"WITH {E} SELECT event_id, cents * 10000000 AS from_seconds, cents * 1000000 AS from_millis, us % {_DAY} / 1000000.0 AS in_seconds, us % {_DAY} / 1000.0 AS in_millis FROM e",
)
def duration_units(spark, sf):
    hundredth = (F.col("cents").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(22,2)")
    in_day = F.col("us") % _DAY * 1000
    df = events(spark, sf).select(
        "event_id",
        temporal.duration(hundredth, "seconds").alias("from_seconds"),
        temporal.duration(F.col("cents"), "millis").alias("from_millis"),
        temporal.duration_in(in_day, "seconds").alias("in_seconds"),
        temporal.duration_in(in_day, "millis").alias("in_millis"),
    )
    return plain(df)


@query(
    "utc_parts",
    """SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute,
      second(ts) AS second, epoch_us(ts) % 1000000 * 1000 AS nanosecond, isodow(ts) AS weekday FROM events""",
)
def utc_parts(spark, sf):
    return load(spark, sf, "events").select("event_id", temporal.utc_parts(F.col("ts")).alias("p")).select("event_id", "p.*")


@query(
    "temporal_arithmetic",
    f"""WITH {E} SELECT event_id, us + cents * 1000 AS later_us, us - cents * 1000 AS earlier_us,
      (us - epoch_us(date_trunc('day', ts))) * 1000 AS since_ns, cents * 1500000 AS scaled_ns, (us % {_DAY})::DOUBLE / 64 AS ratio FROM e""",
)
def temporal_arithmetic(spark, sf):
    at, step = F.col("ts"), F.col("cents") * 1_000_000
    df = events(spark, sf).select(
        "event_id",
        F.unix_micros(temporal.plus(at, step)).alias("later_us"),
        F.unix_micros(temporal.minus(at, step)).alias("earlier_us"),
        temporal.since(at, F.date_trunc("day", "ts")).alias("since_ns"),
        temporal.scale(step, F.lit("1.5").cast("decimal(18,9)")).alias("scaled_ns"),
        exact.exact_div(F.col("us") % _DAY * 1000, F.lit(64_000)).alias("ratio"),
    )
    return plain(df)


def _items(spark, sf, items, table="documents", key="doc_id", name="text"):
    df = load(spark, sf, table).select(key, name)
    return text.items_table(df, items(F.col(name))).select(key, "index", "item")


def _unnest(expression, table="documents", key="doc_id"):
    return f"SELECT {key}, i AS index, x[i + 1] AS item FROM (SELECT {key}, {expression} AS x FROM {table}), unnest(range(len(x))) AS u(i)"


@query("iter_lines", _unnest(r"string_split(replace(text, '. ', '.' || chr(10)), chr(10))"))
def iter_lines(spark, sf):
    return _items(spark, sf, lambda t: text.line_items(F.replace(t, F.lit(". "), F.lit(".\r\n"))))


@query(
    "iter_chars",
    "WITH c AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) SELECT lang, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL",
)
def iter_chars(spark, sf):
    df = load(spark, sf, "documents").select("lang", F.explode(text.char_items(F.col("text"))).alias("ch"))
    return df.groupBy("lang", "ch").agg(F.count(F.lit(1)).alias("n"))


@query("iter_words", _unnest(r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"))
def iter_words(spark, sf):
    return _items(spark, sf, text.word_items)


@query("iter_split", _unnest("string_split(text, ', ')"))
def iter_split(spark, sf):
    return _items(spark, sf, lambda t: text.split_items(t, ", "))


@query("iter_regex_split", _unnest(r"regexp_split_to_array(text, '[,.] *[a-d]')"))
def iter_regex_split(spark, sf):
    return _items(spark, sf, lambda t: text.regex_split_items(t, "[,.] *[a-d]"))


@query("iter_matches", _unnest("regexp_extract_all(html, '<[a-z]+')", "pages", "page_id"))
def iter_matches(spark, sf):
    return _items(spark, sf, lambda t: text.match_items(t, "<[a-z]+"), "pages", "page_id", "html")


@query(
    "iter_captures",
    """SELECT page_id, i AS index, m[i + 1] AS match, a[i + 1] AS first, b[i + 1] AS second FROM (
      SELECT page_id, regexp_extract_all(html, 'href="/?([^"/]*)([^"]*)"', 0) AS m, regexp_extract_all(html, 'href="/?([^"/]*)([^"]*)"', 1) AS a,
        regexp_extract_all(html, 'href="/?([^"/]*)([^"]*)"', 2) AS b FROM pages), unnest(range(len(m))) AS u(i)""",
)
def iter_captures(spark, sf):
    found = _items(spark, sf, lambda t: text.capture_items(t, 'href="/?([^"/]*)([^"]*)"'), "pages", "page_id", "html")
    groups = F.col("item.groups")
    return found.select(
        "page_id", "index", "item.match", F.get(groups, F.lit(0)).alias("first"), F.get(groups, F.lit(1)).alias("second")
    )


@query("regex_test", r"SELECT doc_id, regexp_matches(text, '(?i)licen[sc]ed? under') AS licensed, regexp_matches(text, '\b[0-9]{3}-[0-9]{4}\b') AS phone FROM documents")
def regex_test(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id", text.regex_test(t, "(?i)licen[sc]ed? under").alias("licensed"), text.regex_test(t, r"\b[0-9]{3}-[0-9]{4}\b").alias("phone")
    )


@query(
    "regex_test_repeats",
    r"""SELECT doc_id, regexp_matches(text, '[*+]+') AS marks, regexp_matches(text, '\++') AS pluses, regexp_matches(text, '^\p{L}+ ') AS word_first
    FROM documents""",
)
def regex_test_repeats(spark, sf):
    """Repeats of escapes and classes, which are no possessive repeats."""
    t = F.col("text")
    tests = {"marks": "[*+]+", "pluses": r"\++", "word_first": r"^\p{L}+ "}
    return load(spark, sf, "documents").select("doc_id", *[text.regex_test(t, p).alias(name) for name, p in tests.items()])


@query("strip_ansi", "SELECT conv_id, turn, role || ': ' || text AS clean, 2::BIGINT AS runs, strlen(role) + 9 AS second_start FROM conversations")
def strip_ansi(spark, sf):
    colored = F.concat(F.lit("\x1b[1;31m"), F.col("role"), F.lit("\x1b[0m"), F.lit("\x1b]0;t\x07"), F.lit(": "), F.col("text"))
    talk = load(spark, sf, "conversations").select("conv_id", "turn", colored.alias("raw"))
    spans = text.ansi_spans(F.col("raw"))
    second = F.element_at(spans, 2)["input_start"] - F.octet_length(F.lit("\x1b[1;31m\x1b[0m\x1b]0;t\x07")) + 9
    return talk.select(
        "conv_id", "turn", text.strip_ansi(F.col("raw")).alias("clean"), F.size(spans).cast("bigint").alias("runs"), second.alias("second_start")
    )


@query("join_text", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ') AS joined FROM documents")
def join_text(spark, sf):
    words = text.word_items(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("joined"))


@query(
    "slice_text",
    "SELECT doc_id, substring(text, 2, 15) AS part, left(text, 1) AS initial, (string_split(text, ' '))[1] AS first_word FROM documents",
)
def slice_text(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id",
        text.slice_text(t, F.lit(1), F.least(F.lit(16), F.length(t))).alias("part"),
        text.char_at(t, F.lit(0)).alias("initial"),
        values.element(F.split(t, " "), F.lit(0)).alias("first_word"),
    )


@query(
    "index",
    """SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[8]::DOUBLE AS eighth, len(embedding)::INT AS size,
      (embedding[3] + embedding[4])::DOUBLE > 0 AS positive FROM embeddings""",
)
def index(spark, sf):
    v = F.col("embedding")
    middle = text.slice_list(v, F.lit(2), F.lit(4))
    return load(spark, sf, "embeddings").select(
        "vec_id",
        values.element(v, F.lit(0)).cast("double").alias("first"),
        values.element(v, F.lit(7)).cast("double").alias("eighth"),
        F.size(v).alias("size"),
        ((middle[0] + middle[1]).cast("double") > 0).alias("positive"),
    )


@query(
    "range",
    f"""WITH {L}, r AS (SELECT {_K}, range(l_linenumber::BIGINT, q) AS up, range(q, l_linenumber::BIGINT, -3) AS down FROM l)
    SELECT {_K}, len(up) AS n_up, coalesce(list_sum(up), 0)::BIGINT AS sum_up, len(down) AS n_down, coalesce(list_sum(down), 0)::BIGINT AS sum_down FROM r""",
)
def range_(spark, sf):
    low, high = F.col("l_linenumber").cast("bigint"), F.col("q")
    made = {"up": values.int_range(low, high), "down": values.int_range(high, low, F.lit(-3).cast("bigint"))}
    total = lambda items: F.reduce(items, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return lines(spark, sf).withColumns(made).select(
        *LINE_KEYS,
        F.size("up").cast("bigint").alias("n_up"),
        total(F.col("up")).alias("sum_up"),
        F.size("down").cast("bigint").alias("n_down"),
        total(F.col("down")).alias("sum_down"),
    )


_OPTION = f"{E}, o AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN cents END AS v FROM e)"


def _options(spark, sf):
    return events(spark, sf).select("event_id", F.when(F.col("event_type") != "error", F.col("cents")).alias("v"))


@query("some", f"WITH {_OPTION} SELECT event_id, v FROM o WHERE v IS NOT NULL")
def some(spark, sf):
    return _options(spark, sf).where(values.is_some(F.col("v")))


@query("none", f"WITH {_OPTION} SELECT event_id FROM o WHERE v IS NULL")
def none(spark, sf):
    return _options(spark, sf).where(~values.is_some(F.col("v"))).select("event_id")


@query("is_some", f"WITH {_OPTION} SELECT event_id, v IS NOT NULL AS present FROM o")
def is_some(spark, sf):
    return _options(spark, sf).select("event_id", values.is_some(F.col("v")).alias("present"))


@query("unwrap_or", f"WITH {_OPTION} SELECT event_id, coalesce(v, -1) AS v FROM o")
def unwrap_or(spark, sf):
    return _options(spark, sf).select("event_id", values.unwrap_or(F.col("v"), F.lit(-1).cast("bigint")).alias("v"))


def _maps(spark, sf):
    kind = F.col("event_type")
    pairs = F.array(F.struct(kind.alias("key"), F.col("cents").alias("value")), F.struct(F.lit("k").alias("key"), F.col("k").alias("value")))
    return events(spark, sf).select("event_id", F.map_from_entries(pairs).alias("m"))


@query(
    "has",
    f"WITH {E} SELECT event_id, event_type = 'error' AS has_error, true AS has_k, k AS entry FROM e",
)
def has(spark, sf):
    m = F.col("m")
    return _maps(spark, sf).select(
        "event_id", values.has(m, F.lit("error")).alias("has_error"), values.has(m, F.lit("k")).alias("has_k"), values.entry(m, F.lit("k")).alias("entry")
    )


@query("keys", f"WITH {E} SELECT event_id, event_type || ',k' AS names FROM e")
def keys(spark, sf):
    return _maps(spark, sf).select("event_id", F.array_join(values.keys(F.col("m")), ",").alias("names"))


@query(
    "iter_entries",
    f"WITH {E} SELECT event_id, 0::BIGINT AS index, event_type AS name, cents AS v FROM e UNION ALL SELECT event_id, 1, 'k', k FROM e",
)
def iter_entries(spark, sf):
    found = text.items_table(_maps(spark, sf), F.map_entries("m"))
    return found.select("event_id", "index", F.col("item.key").alias("name"), F.col("item.value").alias("v"))


@query("iter_keys", f"WITH {E} SELECT event_id, 0::BIGINT AS index, event_type AS item FROM e UNION ALL SELECT event_id, 1, 'k' FROM e")
def iter_keys(spark, sf):
    return text.items_table(_maps(spark, sf), F.map_keys("m")).drop("m")


@query("iter_values", f"WITH {E} SELECT event_id, 0::BIGINT AS index, cents AS item FROM e UNION ALL SELECT event_id, 1, k FROM e")
def iter_values(spark, sf):
    return text.items_table(_maps(spark, sf), F.map_values("m")).drop("m")


@query("iter_items", "SELECT vec_id, i AS index, embedding[i + 1]::DOUBLE AS item FROM embeddings, unnest(range(len(embedding))) AS u(i)")
def iter_items(spark, sf):
    found = text.items_table(load(spark, sf, "embeddings").select("vec_id", "embedding"), F.col("embedding"))
    return found.select("vec_id", "index", F.col("item").cast("double").alias("item"))


@query(
    "collect",
    "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS items, count(*) AS n FROM conversations GROUP BY conv_id",
)
def collect(spark, sf):
    from plumbline.operators.summaries import ordered_reduce

    talk = load(spark, sf, "conversations")
    empty = F.array().cast("array<string>")
    lists = ordered_reduce(talk, ["conv_id"], "turn", F.array("role"), empty, lambda acc, item: F.concat(acc, item))
    return lists.select("conv_id", F.array_join("result", ",").alias("items"), F.size("result").cast("bigint").alias("n"))


@query("iter_use", _unnest("list_slice(list_transform(string_split(text, ', '), lambda x: '- ' || x), 2, 4)"))
def iter_use(spark, sf):
    from plumbline.operators.recipes import Recipe

    recipe = Recipe("text", lambda t: text.split_items(t, ", ")).map(lambda x: F.concat(F.lit("- "), x)).skip(1).take(3)
    found = recipe.use(load(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", (F.col("index")).alias("index"), "item")


@query("parse_json", f"WITH {E} SELECT event_id, k FROM e")
def parse_json(spark, sf):
    parsed = values.parse_json(F.col("props"))
    return load(spark, sf, "events").select("event_id", values.json_field(parsed, "$.k", "bigint").alias("k"))


@query(
    "decode_json",
    f"WITH {E} SELECT event_id, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN k END AS k, CASE WHEN event_type = 'error' THEN 'JSON001' END AS code FROM e",
)
def decode_json(spark, sf):
    body = F.when(F.col("event_type") == "error", F.concat(F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    decoded = load(spark, sf, "events").select("event_id", values.decode_json(body).alias("d"))
    return decoded.select(
        "event_id", "d.ok", F.variant_get("d.value", "$.k", "bigint").alias("k"), F.col("d.error.code").alias("code")
    )


@query("parse_json_contract", f"WITH {E} SELECT event_id, k FROM e")
def parse_json_contract(spark, sf):
    from plumbline.operators import decoding
    from plumbline.operators.contracts import record, scalar

    body = record("Props", k=scalar("Int", low=0))
    parsed = decoding.parse_json(F.col("props"), body)
    return load(spark, sf, "events").select("event_id", values.json_field(parsed, "$.k", "bigint").alias("k"))


@query(
    "decode_json_contract",
    f"""WITH {E} SELECT event_id, event_type <> 'error' AND k < 50 AS ok, CASE WHEN event_type <> 'error' AND k < 50 THEN k END AS k,
      CASE WHEN event_type = 'error' THEN 'JSON001' WHEN k >= 50 THEN 'JSON002' END AS code,
      CASE WHEN event_type = 'error' THEN 2 END::INT AS line, CASE WHEN event_type = 'error' THEN length(props) + 3 END::INT AS "column"
    FROM e""",
)
def decode_json_contract(spark, sf):
    """Props within a list, on a second line; errors are closed once too often."""
    from plumbline.operators import decoding
    from plumbline.operators.contracts import list_of, record, scalar

    end = F.when(F.col("event_type") == "error", "}]").otherwise("]")
    body = F.concat(F.lit("[\n  "), F.col("props"), end)
    contract = list_of(record("Props", k=scalar("Int", high=49)), max_items=1)
    decoded = load(spark, sf, "events").select("event_id", decoding.decode_json(body, contract).alias("d"))
    return decoded.select(
        "event_id",
        "d.ok",
        F.variant_get("d.value", "$[0].k", "bigint").alias("k"),
        F.col("d.error.code").alias("code"),
        F.col("d.error.line").alias("line"),
        F.col("d.error.column").alias("column"),
    )
