"""Contracts, framing and byte-level reads."""

from decimal import Decimal

from pyspark.sql import functions as F

from plumbline.functions import text as text_functions
from plumbline.operators import contracts
from plumbline.operators.contracts import list_of, map_of, option_of, record, scalar, union_of
from plumbline.plans.common import E, events
from plumbline.registry import query
from plumbline.session import load, run_folder
from plumbline.sources import files, framing

ORDER = record(
    "Order",
    o_orderkey=scalar("Int", low=0),
    o_orderstatus=scalar("Text", "Status", enum=("F", "O")),
    price=scalar("Decimal", "Price", low=Decimal(5000), high=Decimal(450000)),
    o_orderpriority=scalar("Text", "Priority", patterns=("^[1-3]-",), min_length=5, max_length=8),
    note=scalar("Text").or_missing(),
    missing=scalar("Text"),
)

_STATUS = "value is not allowed; expected one of F, O"
_PRICE = "number is outside the permitted bounds; number must be from 5000 to 450000"
_LENGTH = "text length is outside the permitted bounds; text length (characters) must be from 5 to 8"
_VIOLATIONS = f"""
    SELECT o_orderkey, '/o_orderstatus' AS path, 'TYP005' AS code, '{_STATUS}' AS message FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT o_orderkey, '/price', 'TYP005', '{_PRICE}' FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 450000
    UNION ALL SELECT o_orderkey, '/o_orderpriority', 'TYP005', '{_LENGTH}' FROM orders WHERE length(o_orderpriority) NOT BETWEEN 5 AND 8
    UNION ALL SELECT o_orderkey, '/o_orderpriority', 'TYP005', 'text does not match ^[1-3]-' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')"""


def _orders(spark, sf):
    price = F.col("o_totalprice").cast("decimal(12,2)").alias("price")
    return load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", price, "o_orderpriority")


@query(
    "contract_check",
    f"{_VIOLATIONS} UNION ALL SELECT o_orderkey, '/missing', 'TYP005', 'required field is missing' FROM orders",
)
def contract_check(spark, sf):
    return contracts.contract_check(_orders(spark, sf), ORDER, "o_orderkey")


NESTED = record(
    "Document",
    doc_id=scalar("Int"),
    words=list_of(scalar("Text", "Word", max_length=30), "Words", min_items=5, max_items=2000),
    facts=map_of(scalar("Text", "Fact", max_length=3)),
    size=union_of(scalar("Int", "Small", high=500), scalar("Int", "Large", low=2000)),
    lang=option_of(scalar("Text", "Lang", enum=("en", "fr"))),
)


@query(
    "contract_check_nested",
    r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words, source, n_chars, lang FROM documents)
    SELECT doc_id, '/words/' || i AS path, 'TYP005' AS code, 'text length is outside the permitted bounds; text length (characters) must be at most 30' AS message
      FROM d, unnest(range(len(words))) AS u(i) WHERE length(words[i + 1]) > 30
    UNION ALL SELECT doc_id, '/words', 'TYP005', 'item count is outside the permitted bounds; item count must be from 5 to 2000' FROM d WHERE len(words) NOT BETWEEN 5 AND 2000
    UNION ALL SELECT doc_id, '/facts/source', 'TYP005', 'text length is outside the permitted bounds; text length (characters) must be at most 3' FROM d WHERE length(source) > 3
    UNION ALL SELECT doc_id, '/size', 'TYP005', 'expected an alternative of Small|Large' FROM d WHERE n_chars > 500 AND n_chars < 2000
    UNION ALL SELECT doc_id, '/lang', 'TYP005', 'value is not allowed; expected one of en, fr' FROM d WHERE lang NOT IN ('en', 'fr')""",
)
def contract_check_nested(spark, sf):
    c = F.col
    docs = load(spark, sf, "documents").select(
        "doc_id",
        text_functions.word_items(c("text")).alias("words"),
        F.create_map(F.lit("source"), c("source"), F.lit("lang"), c("lang")).alias("facts"),
        c("n_chars").alias("size"),
        "lang",
    )
    return contracts.contract_check(docs, NESTED, "doc_id")


@query("checked", "SELECT p_partkey, p_name, p_size FROM part")
def checked(spark, sf):
    part = record("Part", p_partkey=scalar("Int", low=0), p_name=scalar("Text", min_length=1), p_size=scalar("Int", low=1, high=50))
    return contracts.checked(load(spark, sf, "part").select("p_partkey", "p_name", "p_size"), part)


@query(
    "valid_split",
    f"""WITH v AS ({_VIOLATIONS}), n AS (SELECT o_orderkey, count(*) AS n FROM v GROUP BY 1)
    SELECT o.o_orderkey, CASE WHEN n IS NULL THEN 'accepted' ELSE 'rejected' END AS side, coalesce(n, 0)::INT AS problems FROM orders o LEFT JOIN n USING (o_orderkey)""",
)
def valid_split(spark, sf):
    fields = {name: c for name, c in ORDER.fields.items() if name != "missing"}
    accepted, rejected = contracts.valid_split(_orders(spark, sf), record("Order", **fields))
    left = accepted.select("o_orderkey", F.lit("accepted").alias("side"), F.lit(0).alias("problems"))
    return left.unionByName(rejected.select("o_orderkey", F.lit("rejected").alias("side"), F.size("issues").alias("problems")))


@query(
    "union_resolve",
    f"WITH {E} SELECT event_id, CASE WHEN cents <= 100 THEN 'Tiny' WHEN cents BETWEEN 50 AND 1000 THEN 'Small' WHEN cents >= 5000 THEN 'Huge' END AS alternative FROM e",
)
def union_resolve(spark, sf):
    options = [
        scalar("Text", "Word"),
        scalar("Int", "Tiny", high=100),
        scalar("Int", "Small", low=50, high=1000),
        scalar("Int", "Huge", low=5000),
    ]
    df = events(spark, sf).select("event_id", "cents")
    return df.select("event_id", contracts.union_resolve(df, "cents", options).alias("alternative"))


@query(
    "subtype",
    """SELECT true AS narrow_fits_wide, false AS wide_fits_narrow, false AS table_fits_wide,
      count(*) FILTER (WHERE o_totalprice < 0) AS violations FROM orders""",
)
def subtype(spark, sf):
    """Compatibility of table contracts, confirmed by checking the rows of the narrower table."""
    orders = _orders(spark, sf)
    narrow = record("Narrow", o_orderkey=scalar("Int", low=0), price=scalar("Decimal", low=Decimal(1000), high=Decimal(500000)))
    wide = record("Wide", o_orderkey=scalar("Int"), price=scalar("Decimal", low=Decimal(0)))
    # the structural contract of the table itself: kinds without limits
    structural = contracts.contract_of(orders)
    violations = orders.select(F.size(contracts.row_issues(orders, wide)).alias("n")).agg(F.sum("n").alias("violations"))
    return violations.select(
        F.lit(contracts.subtype(narrow, wide)).alias("narrow_fits_wide"),
        F.lit(contracts.subtype(wide, narrow)).alias("wide_fits_narrow"),
        F.lit(contracts.subtype(structural, wide)).alias("table_fits_wide"),
        "violations",
    )


_CRLF = "replace(text, '. ', '.' || chr(13) || chr(10))"


def _crlf():
    return F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n"))


@query(
    "frame_lines",
    f"""WITH p AS (SELECT doc_id, i AS ordinal, x[i + 1] AS part, i + 1 = len(x) AS unterminated FROM
        (SELECT doc_id, string_split({_CRLF}, chr(10)) AS x FROM documents), unnest(range(len(x))) AS u(i)),
    f AS (SELECT doc_id, ordinal, unterminated, CASE WHEN NOT unterminated AND ends_with(part, chr(13)) THEN left(part, length(part) - 1) ELSE part END AS text,
        strlen(part) + CASE WHEN unterminated THEN 0 ELSE 1 END AS size FROM p WHERE NOT (unterminated AND part = '')),
    s AS (SELECT *, CAST(sum(size) OVER (PARTITION BY doc_id ORDER BY ordinal) AS BIGINT) AS delimiter_end FROM f)
    SELECT doc_id, ordinal, delimiter_end - size AS start, delimiter_end - size + strlen(text) AS "end", delimiter_end, text,
      contains(text, '�') AS lossy, unterminated FROM s""",
)
def frame_lines(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", _crlf().alias("text"))
    return framing.frame_lines(docs, "doc_id", "text")


PIECE_BYTES = 1 << 25


def _written_parts(df, spark, label):
    """Texts written as the lines of eight files ``part=0..7``, by ascending doc_id; as many more lines as they hold.

    A file is a folder of pieces, one a task, of about ``PIECE_BYTES`` each: one task a file would write an eighth of all.
    """
    path = run_folder(spark, label)
    size = df.agg(F.sum(F.octet_length("text").cast("bigint") + 1)).first()[0] or 0
    parts = df.withColumn("part", F.col("doc_id") % 8).repartitionByRange(max(8, -(-size // PIECE_BYTES)), "part", "doc_id")
    parts.sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(path)
    return path


def _part():
    return F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint").alias("part")


_FILE_LINES = """d AS (SELECT doc_id % 8 AS part, string_agg(text@MARK@ || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1),
    p AS (SELECT part, i AS ordinal, x[i + 1] AS text FROM (SELECT part, string_split(body, chr(10)) AS x FROM d), unnest(range(len(x) - 1)) AS u(i)),
    s AS (SELECT *, CAST(sum(strlen(text) + 1) OVER (PARTITION BY part ORDER BY ordinal) AS BIGINT) AS delimiter_end FROM p)"""


@query(
    "frame_files",
    f"""WITH {_FILE_LINES.replace("@MARK@", "")} SELECT part, ordinal, delimiter_end - strlen(text) - 1 AS start,
      delimiter_end - 1 - CASE WHEN ends_with(text, chr(13)) THEN 1 ELSE 0 END AS "end", delimiter_end, false AS unterminated,
      CASE WHEN ends_with(text, chr(13)) THEN left(text, length(text) - 1) ELSE text END AS text FROM s""",
)
def frame_files(spark, sf):
    """Lines of text files read over byte ranges, with ordinals and spans within their file."""
    docs = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    framed = files.strict_records(files.frame_files(spark, _written_parts(docs, spark, "lines"), pieces=True))
    return framed.select(_part(), "ordinal", "start", "end", "delimiter_end", "unterminated", "text")


@query(
    "frame_files_rejected",
    f"""WITH {_FILE_LINES.replace("@MARK@", " || CASE WHEN lang = 'fr' THEN chr(1) ELSE '' END")},
    j AS (SELECT *, strlen(text) AS size, CASE WHEN strlen(text) > 900 THEN 'raw_limit' WHEN contains(text, chr(1)) THEN 'invalid_utf8' END AS reason FROM s)
    SELECT part, ordinal, delimiter_end - size - 1 AS start, delimiter_end - 1 AS "end", reason,
      CASE WHEN reason = 'raw_limit' THEN delimiter_end - size - 1 ELSE delimiter_end - 2 END AS reason_start, delimiter_end - 1 AS reason_end,
      least(size, 40)::INT AS excerpt_bytes, size > 40 AS excerpt_truncated FROM j WHERE reason IS NOT NULL""",
)
def frame_files_rejected(spark, sf):
    """French texts end with a byte that UTF-8 never holds; such lines and long ones are rejected beside the good ones."""
    bad = F.concat(F.encode("text", "utf-8"), F.lit(b"\xff")).cast("string")
    docs = load(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "fr", bad).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    framed = files.frame_files(spark, _written_parts(docs, spark, "damaged"), raw_limit=900, excerpt=40, pieces=True)
    lost = files.rejections(framed)
    return lost.select(_part(), "ordinal", "start", "end", "reason", "reason_start", "reason_end", F.octet_length("excerpt").alias("excerpt_bytes"), "excerpt_truncated")


@query(
    "frame_delimited",
    """WITH p AS (SELECT doc_id, i AS ordinal, x[i + 1] AS text, i + 1 = len(x) AS unterminated FROM
        (SELECT doc_id, string_split(text, ', ') AS x FROM documents), unnest(range(len(x))) AS u(i)),
    f AS (SELECT *, strlen(text) + CASE WHEN unterminated THEN 0 ELSE 2 END AS size FROM p WHERE NOT (unterminated AND text = '')),
    s AS (SELECT *, CAST(sum(size) OVER (PARTITION BY doc_id ORDER BY ordinal) AS BIGINT) AS delimiter_end FROM f)
    SELECT doc_id, ordinal, delimiter_end - size AS start, delimiter_end - size + strlen(text) AS "end", delimiter_end, text,
      contains(text, '�') AS lossy, unterminated FROM s""",
)
def frame_delimited(spark, sf):
    return framing.frame_lines(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", ", ")


# French documents get a byte that UTF-8 never holds in their middle
_DAMAGED = """d AS (SELECT doc_id, text, lang = 'fr' AS bad, strlen(text) + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS size FROM documents)"""


def _damaged(spark, sf):
    raw = F.encode("text", "utf-8")
    middle = F.floor(F.octet_length(raw) / 2).cast("int")
    broken = F.concat(F.substring(raw, F.lit(1), middle), F.lit(b"\xff"), F.substring(raw, middle + 1, F.octet_length(raw)))
    return load(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "fr", broken).otherwise(raw).alias("data"))


@query(
    "frame_reject",
    f"""WITH {_DAMAGED}, r AS (SELECT *, CASE WHEN size > 4000 THEN 'raw_limit' WHEN bad THEN 'invalid_utf8' END AS reason FROM d)
    SELECT doc_id, reason, CASE WHEN reason IS NULL THEN length(text) > 0 END AS decoded,
      CASE WHEN reason IS NOT NULL THEN least(size, 40)::INT END AS excerpt_bytes,
      reason IS NOT NULL AND size > 40 AS excerpt_truncated FROM r""",
)
def frame_reject(spark, sf):
    tagged = framing.frame_reject(_damaged(spark, sf), "data", raw_limit=4000, decoded_limit=1 << 20, excerpt=40)
    return tagged.select(
        "doc_id", "reason", (F.length("text") > 0).alias("decoded"), F.octet_length("excerpt").alias("excerpt_bytes"), "excerpt_truncated"
    )


@query("decode_utf8", f"WITH {_DAMAGED} SELECT doc_id, NOT bad AS strict_ok, bad AS replaced FROM d")
def decode_utf8(spark, sf):
    damaged = _damaged(spark, sf)
    valid = F.is_valid_utf8(F.col("data").cast("string"))
    # strict decoding fails the query on malformed bytes, so it only sees the valid ones here
    strict = F.when(valid, text_functions.decode_utf8(F.when(valid, F.col("data"))))
    lossy = text_functions.decode_utf8(F.col("data"), lossy=True)
    return damaged.select("doc_id", strict.isNotNull().alias("strict_ok"), lossy.contains("�").alias("replaced"))


@query(
    "event_blocks",
    r"""WITH b AS (SELECT conv_id, turn, i AS ordinal, x[i + 1] AS block FROM
        (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), '. ') AS x FROM conversations), unnest(range(len(x) - 1)) AS u(i))
    SELECT conv_id * 1000 + turn AS key, ordinal, block || chr(10) || role AS event FROM b JOIN conversations USING (conv_id, turn)""",
)
def event_blocks(spark, sf):
    # every sentence becomes an event of two data lines and a comment; the last one stays open
    talk = load(spark, sf, "conversations")
    sentence = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    wrap = lambda s: F.concat(F.lit("id: 7\ndata: "), s, F.lit("\n: note\ndata:"), F.col("role"))
    body = F.array_join(F.transform(F.split(sentence, r"\. "), wrap), "\n\n")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("key")
    return framing.event_blocks(talk.select(key, body.alias("body")), "key", "body")


@query("byte_range", "SELECT doc_id, hex(encode(text)[2:11]) AS head, octet_length(encode(text)) AS total FROM documents")
def byte_range(spark, sf):
    raw = F.encode("text", "utf-8")
    return load(spark, sf, "documents").select(
        "doc_id", F.hex(framing.byte_range(raw, 1, 10)).alias("head"), F.octet_length(raw).cast("bigint").alias("total")
    )


@query("scan_excerpt", "SELECT event_id, user_id FROM events WHERE event_id >= 500 AND event_id < 600")
def scan_excerpt(spark, sf):
    return framing.scan_excerpt(load(spark, sf, "events").select("event_id", "user_id"), "event_id", 500, 100)


@query("json_lines", f"WITH {E} SELECT event_id, i AS line, k + i AS k FROM e, unnest(range(3)) AS u(i)")
def json_lines(spark, sf):
    """Three JSON lines per event written into one text cell and read back, every line checked."""
    from plumbline.functions import values

    k = F.col("k")
    cell = F.concat_ws("\n", *[F.concat(F.lit('{"k": '), (k + i).cast("string"), F.lit("}")) for i in range(3)])
    found = text_functions.items_table(events(spark, sf).select("event_id", cell.alias("cell")), text_functions.line_items(F.col("cell")), index="line")
    return found.select("event_id", "line", values.json_field(values.parse_json(F.col("item")), "$.k", "bigint").alias("k"))


@query("typed_records", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 25")
def typed_records(spark, sf):
    return load(spark, sf, "part").where("p_size >= 25").select("p_partkey", "p_name", "p_size")
