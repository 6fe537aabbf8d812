"""Closures of references from many roots, and forks with outcomes, on small tables."""

import pytest
from helpers import fails, rows
from pyspark.sql import functions as F

from plumbline import session
from plumbline.guards import LimitError
from plumbline.operators import lineage, summaries
from plumbline.operators.rows import fork, on


def test_closure_of_many_roots(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("x", "e"), ("e", None), (None, "q"), ("a", "b")]
    e = spark.createDataFrame(edges, "source string, target string")
    starts = spark.createDataFrame([(1, "a"), (1, "a"), (2, "d"), (3, "x"), (None, "x"), (4, "lone"), (5, None)], "root int, node string")
    got = rows(lineage.reachable(e, starts))
    want = [(1, n) for n in "abcde"] + [(2, n) for n in "de"] + [(3, n) for n in "ex"] + [(None, n) for n in "ex"] + [(4, "lone"), (5, None)]
    assert got == sorted(want, key=repr)
    assert lineage.reachable(e, starts.where("false")).count() == 0
    with pytest.raises(ValueError, match="deeper"):
        lineage.reachable(e, starts, max_depth=2)


def test_footprint_counts_shared_subgraphs_once(spark):
    references = spark.createDataFrame([("r", 1), ("r", 2), ("s", 3)], "root string, item int")
    links = spark.createDataFrame([(1, 4), (2, 4), (4, 5), (3, 5), (3, 6)], "item int, to int")
    sizes = spark.createDataFrame([(i, 10**i) for i in range(1, 7)], "item int, size bigint")
    got = rows(summaries.footprint_closure(references, links, sizes, "root", "item", "to", "size"))
    assert got == [("r", 4, 110110, 100000, 10110), ("s", 3, 1101000, 100000, 1001000)]


def closed(edges, starts):
    """What the closure must give, pair by pair."""
    pairs, new = set(starts), set(starts)
    while new:
        new = {(r, t) for r, n in new for s, t in edges if n is not None and s == n and t is not None} - pairs
        pairs |= new
    return sorted(pairs, key=repr)


@pytest.mark.parametrize("cycle", [[], [(9, 3)]])
def test_closure_keeps_64_roots_a_row(spark, monkeypatch, cycle):
    edges = [(n, m) for n in range(10) for m in (n + 2, n + 3, n * 2) if n < m < 10] + [(20, 21), (21, 9)] + cycle
    starts = [(r, (r * 7) % 22) for r in range(200)] + [(r, 0) for r in range(0, 200, 2)] + [(None, 5), (7, None), (63, 12), (63, 12)]
    e, s = spark.createDataFrame(edges, "source int, target int"), spark.createDataFrame(starts, "root int, node int")
    monkeypatch.setattr(lineage, "_by_rounds", lineage._by_rounds if cycle else None)  # not needed without a cycle
    want = closed(edges, starts)
    roots, sets = lineage.reached_sets(e, s)
    assert rows(lineage.single_roots(sets).join(roots, "number"), "root", "node") == want
    assert sets.count() < len(want) / 8
    if not cycle:  # a node's roots are put together once
        assert sets.select("node", "word").distinct().count() == sets.count()


def test_closure_depth_is_that_of_the_shortest_paths(spark):
    chain = [(n, n + 1) for n in range(6)] + [(0, n) for n in range(2, 7)]
    e, s = spark.createDataFrame(chain, "source int, target int"), spark.createDataFrame([(1, 0)], "root int, node int")
    assert rows(lineage.reachable(e, s, max_depth=2)) == [(1, n) for n in range(7)]
    with pytest.raises(ValueError, match="deeper"):
        lineage.reachable(e, s, max_depth=1)


def test_footprint_of_closure_counts_like_pairs(spark):
    references = [(f"r{r}", (r * 11) % 40) for r in range(130)] + [("r1", 3), ("r1", 3), (None, 4)]
    links = [(n, n // 2) for n in range(2, 40)]
    r = spark.createDataFrame(references, "root string, item int")
    links_of, sizes = spark.createDataFrame(links, "item int, to int"), [(n, n * n + 1) for n in range(40)] + [(1, 5)]
    pairs = closed(links, references)
    got = rows(summaries.footprint_closure(r, links_of, spark.createDataFrame(sizes, "item int, size bigint"), "root", "item", "to", "size"))
    want = rows(summaries.footprint(spark.createDataFrame(pairs, "root string, item int"), spark.createDataFrame(sizes, "item int, size bigint"), "root", "item", "size"))
    assert got == want and len(got) == 131
    lacking = spark.createDataFrame(sizes[:1], "item int, size bigint")
    fails(summaries.footprint_closure(r, links_of, lacking, "root", "item", "to", "size"), "object has no size")


def test_a_branch_without_a_value_can_be_a_success(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "id int, v int")
    wrong = F.when(F.col("v") < 0, "negative")
    both = {"checked": F.lit(True), "tried": F.lit(True)}
    forked = fork(df, both, {"checked": F.col("v"), "tried": F.col("v")}, errors={"checked": wrong}, cancelled={"tried": F.col("id") == 2})
    assert rows(forked, "id", "branch", "result", "outcome", "error") == [
        (1, "checked", None, "success", None),
        (1, "tried", None, "failed", "no value"),
        (2, "checked", 5, "success", None),
        (2, "tried", None, "cancelled", None),
        (3, "checked", None, "failed", "negative"),
        (3, "tried", -1, "success", None),
    ]
    kept = forked.where(on("success", F.col("result").isNull() | (F.col("result") > 0)))
    assert rows(kept, "id", "branch") == [(1, "checked"), (2, "checked")]
    for make in (lambda: on("lost"), lambda: on("failed", F.lit(True)), lambda: fork(df, both, {"checked": F.col("v")})):
        with pytest.raises(LimitError):
            make()


def test_levels_run_in_tasks_of_bounded_rows(spark, monkeypatch):
    initial, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    usual, seen = [spark.conf.get(key, None) for key in (initial, size)], []
    levels = lineage._levels

    def watched(*tables):
        seen.append([spark.conf.get(key) for key in (initial, size)])
        return levels(*tables)

    monkeypatch.setattr(session, "TASK_ROWS", 2)
    monkeypatch.setattr(lineage, "_levels", watched)
    nodes = spark.createDataFrame([(n,) for n in "abcdea"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "b"), ("d", "c")], "source string, target string")
    assert rows(lineage.execution_levels(nodes, edges), "node", "level") == [("a", 0), ("b", 1), ("c", 2), ("d", 0), ("e", 0)]
    assert seen == [["8", session.TASK_BYTES]]  # 6 nodes and 5 edges, each with two ends
    for wrong in (("c", "a"), ("c", "q"), ("c", None)):
        with pytest.raises(ValueError, match="cycle|listed"):
            lineage.execution_levels(nodes, edges.union(spark.createDataFrame([wrong], edges.schema)))
    assert [spark.conf.get(key, None) for key in (initial, size)] == usual
