"""Rules of a whole timeline on a small table."""

from plumbline.operators import series


def test_rules_of_a_timeline(spark):
    declared = spark.createDataFrame([("a", "ms"), ("b", "ms"), ("a", "s")], "id string, unit string")
    samples = spark.createDataFrame([("a", 1, 10, "x", "ms"), ("a", 2, 5, "y", "ms"), ("b", 1, 10, "x", "ms")], "series string, n bigint, at_us bigint, id string, unit string")
    events = spark.createDataFrame([("x", 10, 1), ("x", 20, 2), ("y", 15, 3), ("z", 100, 4)], "id string, at_us bigint, n bigint")
    coverage = spark.createDataFrame([(0, 50), (0, 100), (-1, 20), (50, 101), (60, 40), (None, 3)], "start_us bigint, end_us bigint")
    check = lambda *tables: {r.rule: r.violations for r in series.timeline_model_check(*tables, "n", 0, 100, 2, 5).collect()}
    assert check(declared, samples, events, coverage) == {
        "unsorted": 1,
        "duplicate_ids": 0,
        "outside_range": 0,
        "events_unsorted": 1,
        "events_duplicate_ids": 1,
        "events_outside_range": 1,
        "series_over_limit": 1,
        "duplicate_series": 1,
        "mixed_units": 1,
        "records_over_limit": 2,
        "coverage_outside_range": 4,
    }
    empty = [t.where("false") for t in (declared, samples, events, coverage)]
    assert set(check(*empty).values()) == {0} and len(check(*empty)) == 11
