"""Closures and levels over a table of edges (source, target): target depends on source.

Each round is one join of the edges with the frontier, made distinct, and written to the shared folder, so the
plan does not grow and a lost executor costs no recomputation. The number of rounds is the depth of the graph.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.guards import require_between
from plumbline.operators.ordered import match_keys
from plumbline.session import reliable_checkpoint, settled, small_tasks


def downstream(edges: DataFrame, start: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """Every node reachable from the ``node`` column of ``start``, with the start nodes."""
    require_between("max_depth", max_depth, 1, 1_000_000)
    reached = reliable_checkpoint(start.select("node").distinct())
    frontier = reached
    for _ in range(max_depth):
        targets = edges.join(frontier.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"))
        found = targets.distinct().join(reached, "node", "left_anti")
        frontier = reliable_checkpoint(found)
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
    raise ValueError(f"closure is deeper than {max_depth}")


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """``root, node``: every node that each root of ``starts(root, node)`` reaches over ``edges(source, target)``, itself
    included. Cycles end by themselves; nodes without edges and null ones are leaves.
    """
    roots, sets = reached_sets(edges, starts, max_depth)
    return single_roots(sets).join(roots, "number").select("root", "node")


def reached_sets(edges: DataFrame, starts: DataFrame, max_depth: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """:func:`reachable` with the roots of a node as sets: ``number, root`` and ``node, word, bits``.

    Roots are numbered in their order; a row holds those of 64 numbers that reach a node, no root twice. Without cycles a
    node's sets are made once, when all that leads to it is known; with cycles (or where a path could be longer than
    ``max_depth``) all roots advance together, and known and new sets meet in every round.
    """
    require_between("max_depth", max_depth, 1, 1_000_000)
    with small_tasks(edges.sparkSession, starts.count()):
        roots = settled(_numbered(starts.select("root").distinct()), "roots")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("number").bitwiseAND(63).cast("int"))
        first = match_keys(starts.select("root", "node"), roots, ["root"]).select("node", F.shiftright("number", 6).alias("word"), bit.alias("bits"))
        steps = edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
        steps = settled(steps, "edges")
        levels = _source_levels(steps, max_depth)
        return roots, _by_rounds(steps, first, max_depth) if levels is None else _by_levels(levels, first)


def single_roots(sets: DataFrame) -> DataFrame:
    """One row per root ``number`` of each set."""
    # by bytes, whose set bits are looked up: a row then costs 8 steps and its roots instead of 64
    found = [f"CAST(array({', '.join(str(i) for i in range(8) if byte >> i & 1)}) AS array<int>)" for byte in range(256)]
    byte = F.call_function("shiftright", F.col("bits"), F.col("_byte")).bitwiseAND(255).cast("int")
    parts = sets.withColumn("_byte", F.explode(F.array([F.lit(i) for i in range(0, 64, 8)])))
    at = parts.withColumn("_bit", F.explode(F.get(F.expr(f"array({', '.join(found)})"), byte)))
    return at.withColumn("number", F.shiftleft("word", 6) + F.col("_byte") + F.col("_bit")).drop("_byte", "_bit", "word", "bits")


def _numbered(roots: DataFrame) -> DataFrame:
    # near one another where they lie near one another in their order; whole words stay within a partition
    ranged = roots.repartitionByRange("root").sortWithinPartitions("root")
    return ranged.withColumn("number", F.monotonically_increasing_id())


def _merged(sets: DataFrame) -> DataFrame:
    return sets.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def _passed_on(sets: DataFrame, steps: DataFrame) -> DataFrame:
    return sets.join(steps, F.col("node") == F.col("source")).select(F.col("target").alias("node"), "word", "bits")


def _by_rounds(steps: DataFrame, first: DataFrame, max_depth: int) -> DataFrame:
    reached = frontier = settled(_merged(first), "reached")
    none = F.lit(0).cast("bigint")
    for _ in range(max_depth):
        found = _passed_on(frontier, steps).withColumn("known", none)
        known = reached.select("node", "word", none.alias("bits"), F.col("bits").alias("known"))
        fresh = F.bit_or("bits").bitwiseAND(F.bitwise_not(F.bit_or("known"))).alias("bits")
        frontier = settled(found.unionByName(known).groupBy("node", "word").agg(fresh).where("bits != 0"), "reached")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
    raise ValueError(f"closure is deeper than {max_depth}")


def _source_levels(steps: DataFrame, max_depth: int) -> list[DataFrame] | None:
    """The edges by the longest path that leads to their source; None with a cycle or from ``max_depth`` levels on."""
    left, count, levels = steps, steps.count(), []
    while count:
        led_to = left.select(F.col("target").alias("node")).distinct()
        waits = F.col("node").isNotNull().alias("waits")
        marked = settled(left.join(led_to, F.col("source") == F.col("node"), "left").select("source", "target", waits), "edges")
        left, before = marked.where("waits").drop("waits"), count
        count = left.count()
        levels.append(marked.where("NOT waits").drop("waits"))
        if count == before or len(levels) >= max_depth:
            return None
    return levels


def _by_levels(levels: list[DataFrame], first: DataFrame) -> DataFrame:
    last = len(levels)  # of nodes that lead to nothing
    if not levels:
        return settled(_merged(first), "reached")
    ranked = reduce(DataFrame.unionByName, [edges.withColumn("level", F.lit(k)) for k, edges in enumerate(levels)])
    of_nodes = settled(ranked.select(F.col("source").alias("at"), "level").distinct(), "levels")
    level = F.coalesce("level", F.lit(last))
    to = of_nodes.select("at", F.col("level").alias("to_level"))
    to_level = F.coalesce("to_level", F.lit(last)).alias("to_level")
    steps = settled(ranked.join(to, F.col("target") == F.col("at"), "left").select("source", "target", "level", to_level), "edges")
    # at most levels ** 2 / 2 numbers, and no more than edges
    feeds = {row.to_level: sorted(row.levels) for row in steps.groupBy("to_level").agg(F.collect_set("level").alias("levels")).collect()}
    placed = _merged(first).join(of_nodes, F.col("node") == F.col("at"), "left").select("node", "word", "bits", level.alias("level"))
    # in the order of levels, so that a level reads its own pages
    placed = settled(placed.sortWithinPartitions("level"), "reached")
    reached: list[DataFrame] = []
    for k in range(last + 1):
        own = placed.where(F.col("level") == k).drop("level")
        if k in feeds:
            before = reduce(DataFrame.unionByName, [reached[j] for j in feeds[k]])
            found = _passed_on(before, steps.where(F.col("to_level") == k).select("source", "target"))
            own = settled(_merged(own.unionByName(found)), "reached")
        reached.append(own)
    return reduce(DataFrame.unionByName, reached)


def mark_stale(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Node table with the state of the whole closure set to Stale."""
    closure = downstream(edges, start).withColumn("_stale", F.lit(True))
    state = F.when(F.col("_stale"), "Stale").otherwise(F.col("state"))
    return nodes.join(closure, "node", "left").withColumn("state", state).drop("_stale")


def execution_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path level of each node: 0 without dependencies, else one more than its deepest dependency.

    Ordering by level puts every node after what it depends on. A node is placed when its last dependency has been, and the
    edges it leaves behind are taken out, so each edge and node is handled once. A cycle fails as soon as nothing more can
    be placed, and an edge of a node that is not listed fails at once.
    """
    with small_tasks(nodes.sparkSession, nodes.count() + 2 * edges.count()):
        return _levels(nodes, edges)


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    # dealt out first: combining before the shuffle would hold a whole input file's keys, most of which differ
    listed = reliable_checkpoint(nodes.select("node").repartition("node").distinct())
    left = reliable_checkpoint(edges.select("source", "target").repartition("source", "target").distinct())
    targets = lambda e: e.select(F.col("target").alias("node")).distinct()
    ends = left.select(F.col("source").alias("node")).distinct().unionByName(targets(left))
    if not ends.join(listed, "node", "left_anti").isEmpty():
        raise ValueError("an edge names a node that is not listed")
    frontier = reliable_checkpoint(listed.join(targets(left), "node", "left_anti"))
    layers, level = frontier.withColumn("level", F.lit(0)), 0
    while not left.isEmpty():
        if frontier.isEmpty():
            raise ValueError("graph has a cycle")
        level += 1
        placed = frontier.withColumnRenamed("node", "source")
        freed = targets(left.join(placed, "source", "left_semi"))
        left = reliable_checkpoint(left.join(placed, "source", "left_anti"))
        frontier = reliable_checkpoint(freed.join(targets(left), "node", "left_anti"))
        layers = layers.unionByName(frontier.withColumn("level", F.lit(level)))
    return layers


def recompute_set(nodes: DataFrame, default_policy: str = "Automatic") -> DataFrame:
    """Nodes that may start now.

    Pending nodes and explicit requests may. A stale node needs to be repeatable and then follows its policy: Manual
    never, Reactive always, Automatic only when pure, bounded and stale because of an input change.
    """
    policy = F.coalesce("policy", F.lit(default_policy))
    input_changed = F.coalesce(
        F.col("stale_reason").isin("DependencyRefreshed", "StreamUpdated", "InputBehind"), F.lit(False)
    )
    by_policy = (
        F.when(policy == "Reactive", True)
        .when(policy == "Automatic", F.col("pure") & F.col("bounded") & input_changed)
        .otherwise(False)
    )
    may = (
        F.col("requested")
        | (F.col("state") == "Pending")
        | ((F.col("state") == "Stale") & F.col("repeatable") & by_policy)
    )
    return nodes.where(may & (F.col("state") != "Running"))


def provenance_agree(
    inputs: DataFrame, keys: Sequence[str], facts: dict[str, Column], cautions: Sequence[Column], origins: Sequence[Column] = ()
) -> DataFrame:
    """Merged provenance per group, one row per kept item (kind, name, value).

    A fact stays when every input has it with one value; cautions and origins are united. Rows are combined per
    distinct item first, so a group of any size never meets in one task.
    """
    c = F.col
    set_rows = [F.struct(F.lit("caution").alias("kind"), v.alias("name"), F.lit("").alias("value")) for v in cautions]
    set_rows += [F.struct(F.lit("origin").alias("kind"), v.alias("name"), F.lit("").alias("value")) for v in origins]
    fact_aggs = []
    for i, value in enumerate(facts.values()):
        text = value.cast("string")
        fact_aggs += [F.min(text).alias(f"_l{i}"), F.max(text).alias(f"_h{i}"), F.count(text).alias(f"_n{i}")]
    agreed = inputs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), *fact_aggs)
    kept = [
        F.when(
            (c(f"_l{i}") == c(f"_h{i}")) & (c(f"_n{i}") == c("_all")),
            F.struct(F.lit("fact").alias("kind"), F.lit(name).alias("name"), c(f"_l{i}").alias("value")),
        )
        for i, name in enumerate(facts)
    ]
    fact_table = agreed.select(*keys, F.inline(F.array_compact(F.array(*kept))))
    if not set_rows:
        return fact_table
    sets = inputs.select(*keys, F.inline(F.array(*set_rows))).where(c("name").isNotNull()).distinct()
    return fact_table.unionByName(sets)


def policy_join(df: DataFrame, keys: Sequence[str], confidential: Column, unknown: Column, residence: Column) -> DataFrame:
    """Joined flow policy: any confidential or unknown input marks the result, the strictest residence holds."""
    return df.groupBy(*keys).agg(
        F.bool_or(confidential).alias("confidential"),
        F.bool_or(unknown).alias("unknown"),
        F.min(residence).alias("residence"),
    )
