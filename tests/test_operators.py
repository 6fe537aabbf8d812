from decimal import Decimal

import pytest
from helpers import fails, one, rows
from pyspark.sql import functions as F

from plumbline.functions import codes
from plumbline.functions.definitions import define
from plumbline.guards import KindError, LimitError
from plumbline.operators import contracts as c
from plumbline.operators import journal, lineage, series, summaries
from plumbline.operators import rows as r
from plumbline.sources import framing


def requests(spark, data):
    return spark.createDataFrame(data, "seq bigint, ms bigint, status int")


@pytest.mark.parametrize(
    "data, state, mean, percent",
    [
        ([], "WAITING", "0.0", "0.0"),
        ([(1, 100, 200), (2, 201, 200)], "HEALTHY", "150.5", "0.0"),
        ([(1, 500, 200)], "HEALTHY", "500.0", "0.0"),
        ([(1, 501, 200)], "SLOW", "501.0", "0.0"),
        ([(1, 900, 500), (2, 10, 200), (3, 10, 200)], "DEGRADED", "306.7", "33.3"),
    ],
)
def test_health(spark, data, state, mean, percent):
    df = requests(spark, data)
    h = summaries.health_summary(df, F.col("seq"), F.col("status") >= 500, F.col("ms")).first()
    assert (h.state, h.mean_ms, h.error_percent) == (state, Decimal(mean), Decimal(percent))
    assert h["count"] == len(data) and h.last == (data[-1][0] if data else 0)


@pytest.mark.parametrize("values, bins", [([], 4), ([5, 5], 4), ([0, 10, 5, 9], 3), (list(range(101)), 7), ([-3, 4], 200)])
def test_histogram(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = rows(summaries.histogram(df, F.col("v"), bins), "bin", "count", "total")
    if not values:
        assert got == []
        return
    low, high = min(values), max(values)
    if low == high:
        assert got == [(0, len(values), len(values))]
        return
    member = lambda n, i: (high - low) * i <= (n - low) * bins < (high - low) * (i + 1) or (i == bins - 1 and n == high)
    assert got == sorted(((i, sum(member(n, i) for n in values), len(values)) for i in range(bins)), key=repr)


def test_histogram_edges_are_exact(spark):
    df = spark.createDataFrame([(0,), (10,)], "v bigint")
    edges = rows(summaries.histogram(df, F.col("v"), 3), "lower", "upper")
    assert edges[1] == (Decimal("3.333333333333"), Decimal("6.666666666666"))
    with pytest.raises(LimitError):
        summaries.histogram(df, F.col("v"), 201)


def test_sorting_is_strict(spark):
    df = spark.createDataFrame([(2, "b"), (1, "é"), (3, None)], "n bigint, t string")
    assert [x.n for x in r.sort_by(df.where("t is not null"), "t", "n").collect()] == [2, 1]
    fails(r.sort_by(df, "t", "n"), "sort key is missing")
    with pytest.raises(KindError):
        r.sort_by(df.withColumn("d", F.lit(1.5)), "d", "n")


def test_filters_need_an_answer(spark):
    df = spark.createDataFrame([(1,), (None,)], "n bigint")
    fails(r.filter_rows(df, F.col("n") > 0), "did not produce a Bool")
    with pytest.raises(KindError):
        r.filter_rows(df, F.col("n"))
    with pytest.raises(KindError):
        r.field(df, "absent")


def test_unlike_kinds_are_unequal(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit("1").alias("b"))
    found = r.compare(df, F.col("a"), F.col("b"))
    assert set(found) == {"eq", "ne"} and one(df.select(found["eq"])) is False


def test_paging(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    page = r.value_page(df, 8, 5, "n").collect()
    assert [(p.n, p["count"], p.total, p.next_offset) for p in page] == [(8, 2, 10, None), (9, 2, 10, None)]
    assert r.value_page(df, 0, 4, "n").first().next_offset == 4
    with pytest.raises(LimitError, match="outside the list"):
        r.slice_rows(df, 5, 11, "n")
    assert [x.n for x in r.slice_rows(df, 3, 5, "n").orderBy("n").collect()] == [3, 4]
    listing = r.bounded_listing(df, 3, "n").first()
    assert (listing.returned, listing.omitted, listing.complete) == (3, 7, False)
    with pytest.raises(LimitError):
        r.value_page(df, 0, 1001, "n")


def test_concat_does_not_widen(spark):
    a, b = spark.range(2), spark.range(1).select(F.col("id").cast("int").alias("id"))
    with pytest.raises(KindError):
        r.concat(a, b)
    assert rows(r.concat(a, spark.range(1))) == [(0, 0), (0, 1), (1, 0)]


def test_counters(spark):
    data = [(1, 10, 100, 2), (2, 20, 150, 2), (3, 20, 140, 2), (4, 30, 160, 0), (5, 40, None, 2)]
    df = spark.createDataFrame(data, "n bigint, at bigint, cpu bigint, cpus bigint").withColumn("k", F.lit("c"))
    null, v = F.lit(None).cast("bigint"), F.col
    rated = series.counter_rates(df, ["k"], "n", v("at"), v("cpu"), v("at"), v("cpus"), F.lit(30).cast("bigint"), F.lit(10).cast("bigint"), F.lit(3).cast("bigint"))
    got = {x.n: (x.cpu_percent, x.cpu_unavailable) for x in rated.collect()}
    assert got[2] == (Decimal("1000.000000"), None)
    assert got[1][1] == "CPU counters unavailable" and got[5][1] == "CPU counters unavailable"
    assert got[3][1].startswith("CPU requires") and got[4][1] == "CPU count unavailable"
    assert rated.first().memory_percent == Decimal("666.666667")
    without = series.counter_rates(df, ["k"], "n", v("at"), v("cpu"), v("at"), v("cpus"), null, null, null).first()
    assert (without.memory_percent, without.memory_unavailable) == (None, "Memory usage unavailable")


def test_adapters(spark):
    body = '{"metric":{"job":"é","a":"1"},"values":[["1.5","2.25"],["2","NaN"],["9","1"]]}'
    df = spark.createDataFrame([(body,)], "b string")
    got = rows(series.series_adapter(df, F.col("b"), 0, 5_000_000))
    assert got == [("1:a1:13:job1:é", 1500000, Decimal("2.250000"), False), ("1:a1:13:job1:é", 2000000, Decimal("0"), True)]
    twice = df.unionByName(df)
    fails(series.series_adapter(twice, F.col("b"), 0, 5_000_000), "two values for one instant")
    logs = '{"stream":{},"values":[["5000","b"],["5000","a"],["7000","c"]]}'
    found = series.log_adapter(spark.createDataFrame([(logs,)], "b string"), F.col("b"), 0, 6)
    assert rows(found, "id", "detail") == [("log/5000/0", "a"), ("log/5000/1", "b")]


def test_journal(spark):
    data = [("n", "1", 1, "call"), ("n", "1", 2, "done"), ("n", "2", 3, "call"), ("m", "1", 4, "call"), ("m", "1", 6, "done"), ("m", "1", 7, "call")]
    df = spark.createDataFrame(data, "node string, run string, seq bigint, kind string")
    is_kind = lambda k: F.col("kind") == k
    assert rows(journal.unresolved_calls(df, "node", "run", "seq", is_kind("call"), is_kind("done"))) == [("m", "1", 7), ("n", "2", 3)]


def test_restored_states(spark):
    seen = [("a", 1, "Ready", None), ("b", 1, "Ready", None), ("c", 1, "Ready", None), ("d", 1, "Stale", "InputBehind"), ("e", 1, "Running", None), ("f", 1, "Failed", None), ("f", 2, "Skipped", None)]
    observations = spark.createDataFrame(seen, "node string, seq bigint, state string, reason string")
    retained = spark.createDataFrame([("a", True), ("b", False), ("x", True), ("y", False)], "node string, available boolean")
    assert rows(journal.latest_state(observations, retained, "node", "seq", "state", "reason", "available")) == sorted([
        ("a", "Ready", None), ("b", "Stale", "RestoreUnavailable"), ("c", "Stale", "RestoreNotRetained"), ("d", "Stale", "InputBehind"),
        ("e", "Stale", "RestoreUnfinished"), ("f", "Skipped", None), ("x", "Ready", None), ("y", "Stale", "RestoreUnavailable")], key=repr)


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")], "source string, target string")
    nodes = spark.createDataFrame([(n, "Ready") for n in "abcdxz"], "node string, state string")
    start = spark.createDataFrame([("b",)], "node string")
    assert rows(lineage.downstream(edges, start)) == [("b",), ("c",), ("d",)]
    stale = {x.node: x.state for x in lineage.mark_stale(nodes, edges, start).collect()}
    assert stale == {"a": "Ready", "b": "Stale", "c": "Stale", "d": "Stale", "x": "Ready", "z": "Ready"}
    levels = {x.node: x.level for x in lineage.execution_levels(nodes, edges).collect()}
    assert levels == {"a": 0, "b": 1, "c": 2, "d": 3, "x": 0, "z": 0}
    loop = edges.unionByName(spark.createDataFrame([("d", "b")], "source string, target string"))
    assert rows(lineage.downstream(loop, start)) == [("b",), ("c",), ("d",)]
    with pytest.raises(ValueError, match="cycle"):
        lineage.execution_levels(nodes, loop)
    with pytest.raises(ValueError, match="not listed"):
        lineage.execution_levels(nodes.where("node != 'x'"), edges)
    pair = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    with pytest.raises(ValueError, match="cycle"):
        lineage.execution_levels(nodes, pair)


def test_status_codes(spark):
    df = spark.createDataFrame([(404,), (418,), (104,), (510,), (599,)], "code int")
    found = {x.code: (x.name, x["class"], x.registration) for x in codes.code_lookup(df, "code").collect()}
    assert found[404] == ("Not Found", "client-error", "registered")
    assert found[418][2] == "unused" and found[104][2] == "temporary" and found[510][2] == "obsolete"
    assert found[599] == ("Unassigned", "server-error", "unassigned")
    fails(codes.code_lookup(spark.createDataFrame([(600,)], "code int"), "code"), "100 to 599")


def test_contracts(spark):
    item = c.record("Item", name=c.scalar("Text", min_length=1), qty=c.scalar("Int", low=1))
    order = c.record("Order", id=c.scalar("Int"), items=c.list_of(item, min_items=1), tag=c.scalar("Text").or_missing())
    df = spark.sql("""select 1 id, array(named_struct('name','a','qty',1), named_struct('name','','qty',0)) items, cast(null as string) tag
                      union all select 2, array(), 'x' union all select 3, null, 'y'""")
    assert rows(c.contract_check(df, order, "id"), "id", "path") == [
        (1, "/items/1/name"), (1, "/items/1/qty"), (2, "/items"), (3, "/items")]
    accepted, rejected = c.valid_split(df, order)
    assert accepted.count() == 0 and rejected.count() == 3
    fails(c.checked(df.where("id = 1"), order), "text length")
    text = c.record("T", id=c.scalar("Text"))
    assert rows(c.contract_check(df, text, "id"), "path", "message")[0] == ("/id", "expected Text")


def test_many_contract_issues(spark):
    df = spark.range(1).select("id", F.sequence(F.lit(1), F.lit(500)).alias("v"))
    contract = c.record("R", v=c.list_of(c.scalar("Int", low=1000)))
    assert c.contract_check(df, contract, "id").count() == 500


def test_subtypes():
    small, any_int = c.scalar("Int", low=1, high=5), c.scalar("Int")
    assert c.subtype(small, any_int) and not c.subtype(any_int, small)
    assert c.subtype(c.scalar("Int", enum=(2, 3)), small) and not c.subtype(c.scalar("Int", enum=(2, 9)), small)
    assert not c.subtype(any_int, c.scalar("Int", enum=(1,)))
    assert c.subtype(small, c.union_of(c.scalar("Text"), any_int))
    assert not c.subtype(c.union_of(c.scalar("Text"), any_int), any_int)
    need, may = c.record("A", x=any_int), c.record("B", x=any_int.or_missing())
    assert c.subtype(need, may) and not c.subtype(may, need)
    assert c.subtype(c.list_of(small, min_items=2), c.list_of(any_int, min_items=1))
    assert c.subtype(c.list_of(small), c.UNKNOWN)
    assert not c.subtype(c.scalar("Int"), c.scalar("Decimal"))


def test_timeline_rules(spark):
    data = [("s", "u", "1", 5, 1), ("s", "u", "1", 4, 2), ("t", "w", "1", 99, 3)]
    df = spark.createDataFrame(data, "series string, unit string, id string, at_us bigint, n bigint")
    found = dict(rows(series.timeline_check(df, "n", 0, 50, max_series=1, max_records=2)))
    assert found == {"series_over_limit": 1, "records_over_limit": 1, "unsorted": 1, "duplicate_ids": 1, "outside_range": 1, "mixed_units": 1}


def test_range_correlation_has_no_double_pairs(spark):
    events = spark.range(0, 1000, 7).select("id", F.timestamp_micros("id").alias("ts"))
    picks = spark.createDataFrame([(1, 0, 500), (2, 499, 501), (3, 600, 600)], "pick int, from_us bigint, to_us bigint")
    got = series.range_correlate(picks, {"e": events}, "ts", "from_us", "to_us", 64)
    want = sorted((p, t) for p, a, b in ((1, 0, 500), (2, 499, 501), (3, 600, 600)) for t in range(0, 1000, 7) if a <= t < b)
    assert sorted((x.pick, x.id) for x in got.collect()) == want
    salted = series.range_correlate(picks, {"e": events}, "ts", "from_us", "to_us", 64, hot_rows=9, salts=3)
    assert rows(salted, *got.columns) == rows(got)


def test_pages_beyond_the_top_rows(spark, monkeypatch):
    df = spark.range(60).select((F.col("id") * 7 % 60).alias("n"))
    near = rows(r.value_page(df, 20, 10, "n"))
    monkeypatch.setattr(r, "TOP_ROWS", 5)
    assert rows(r.value_page(df, 20, 10, "n")) == near


def test_pushed_filters_keep_the_check(spark):
    df = spark.createDataFrame([(1,), (5,)], "n bigint")
    assert rows(r.filter_rows(df, F.col("n") > 2, reads=["n"])) == [(5,)]
    with_null = df.unionByName(spark.createDataFrame([(None,)], "n bigint"))
    fails(r.filter_rows(with_null, F.col("n") > 2, reads=["n"]), "did not produce a Bool")


def test_definitions_check_kinds(spark):
    @define("Int", a="Int")
    def twice(a):
        return a * 2

    df = spark.range(3)
    assert rows(df.select(twice.over(df, a=F.col("id")))) == [(0,), (2,), (4,)]
    with pytest.raises(KindError):
        twice.over(df, a=F.lit("x"))
    with pytest.raises(KindError):
        twice.over(df, b=F.col("id"))


def test_shapes_without_data(spark):
    df = spark.range(1).select("id", F.array(F.lit("a")).alias("tags"))
    assert r.shape_only(df) == [("id", "bigint"), ("tags", "array<string>")]
    contract = c.contract_of(df)
    assert c.subtype(contract, c.record("R", tags=c.list_of(c.scalar("Text"))))
    assert not c.subtype(contract, c.record("R", tags=c.list_of(c.scalar("Int"))))


def test_text_and_json_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rstill two\n\nlast")
    assert sorted(x.value for x in framing.read_lines(spark, str(tmp_path)).collect()) == ["", "last", "one", "two\rstill two"]
    fails(framing.read_json_lines(spark, str(tmp_path)), "not valid JSON")


def test_guards_hold_whatever_is_read(spark):
    df = spark.createDataFrame([(1, 5), (2, -5)], "a bigint, b bigint")
    strict = c.checked(df, c.record("R", a=c.scalar("Int"), b=c.scalar("Int", low=0)))
    fails(strict.select("a"), "number is outside")
    with pytest.raises(Exception):
        strict.count()
    ten = spark.range(10).withColumnRenamed("id", "n")
    for bad in (lambda: r.slice_rows(ten, 20, 30, "n"), lambda: r.slice_rows(ten, 5, 30, "n").count(), lambda: r.value_page(ten, 50, 5, "n")):
        with pytest.raises(Exception):
            bad()


def test_every_violation_is_reported(spark):
    df = spark.createDataFrame([(1, [9] * 150)], "id bigint, v array<bigint>")
    contract = c.record("R", v=c.list_of(c.scalar("Int", high=1)))
    assert c.contract_check(df, contract, "id").count() == 150
    cut = c.contract_check(df, contract, "id", limit=20).collect()
    assert len(cut) == 20 and all(x.total == 150 and not x.complete for x in cut)


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 5), (1, 1)], "k bigint, seq bigint")
    got = {x.k: (x.samples, x.gaps) for x in series.gap_coverage(df, ["k"], "seq", F.lit(False)).collect()}
    assert got == {None: (3, 1), 1: (1, 0)}


def test_correlation_keeps_its_tasks_however_small_its_input(spark):
    events = spark.range(64).select(F.timestamp_micros("id").alias("ts"), "id").coalesce(1)
    picks = spark.range(64).select(F.col("id").alias("n"), (F.col("id") - 8).alias("from_us"), (F.col("id") + 8).alias("to_us")).coalesce(1)
    found = series.range_correlate(picks, {"e": events}, "ts", "from_us", "to_us", 4)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows(found, "n", "id") == sorted(((n, i) for n in range(64) for i in range(64) if n - 8 <= i < n + 8), key=repr)


def test_correlation_meets_in_the_order_of_time(spark):
    shuffled = (F.col("id") * 37) % 101
    events = spark.range(101).select(F.timestamp_micros(shuffled).alias("ts"), shuffled.alias("n")).coalesce(1)
    picks = spark.range(101).select(shuffled.alias("pick"), (shuffled - 5).alias("from_us"), (shuffled + 5).alias("to_us")).coalesce(1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        found = series.range_correlate(picks, {"e": events}, "ts", "from_us", "to_us", 16)
        parts = found.select("n", "pick").rdd.glom().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for pairs in parts:
        for bucket in range(7):
            own = [tuple(p) for p in pairs if p.n // 16 == bucket]
            assert own == sorted(own)
    assert sorted(tuple(p) for pairs in parts for p in pairs) == [(n, p) for n in range(101) for p in range(101) if p - 5 <= n < p + 5]
