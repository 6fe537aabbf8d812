"""Folds over a journal of work: calls, results, observations per (node, run), ordered by a unique sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unresolved_calls(df: DataFrame, node: str, run: str, seq: str, starts: Column, finishes: Column) -> DataFrame:
    """Calls whose (node, run) has no completion after them: the key's last start or finish is a start."""
    moves = df.where(starts | finishes).withColumn("_starts", starts)
    last = moves.groupBy(node, run).agg(F.max_by("_starts", seq).alias("_open"), F.max(seq).alias("call_seq"))
    return last.where("_open").drop("_open")


def latest_match(
    observations: DataFrame, results: DataFrame, node: str, run: str, seq: str, state: str, handle: str
) -> DataFrame:
    """Per node its last result that belongs to the node's latest observation, which must be Ready.

    A node without any observation keeps its last result.
    """
    latest = observations.groupBy(node).agg(
        F.max_by(F.struct(F.col(state).alias("state"), F.col(run).alias("run")), seq).alias("_latest")
    )
    # one row per (node, run) before the join, so a node with many results does not weigh on it
    last = results.groupBy(node, run).agg(F.max(seq).alias(seq), F.max_by(handle, seq).alias(handle))
    joined = last.join(latest, node, "left")
    matches = F.col("_latest").isNull() | ((F.col("_latest.state") == "Ready") & (F.col("_latest.run") == F.col(run)))
    return joined.where(matches).groupBy(node).agg(
        F.max_by(run, seq).alias(run), F.max_by(handle, seq).alias(handle)
    )


def latest_state(
    observations: DataFrame, retained: DataFrame, node: str, seq: str, state: str, reason: str, available: str
) -> DataFrame:
    """Restored state and stale reason per node from its last observation and its retained value, if any."""
    latest = observations.groupBy(node).agg(
        F.max_by(F.struct(F.col(state).alias("state"), F.col(reason).alias("reason")), seq).alias("_o")
    )
    joined = latest.join(retained.select(node, F.col(available).alias("_available")), node, "full")
    observed, seen = F.col("_o.state"), F.col("_o").isNotNull()
    ready = F.coalesce(F.col("_available"), F.lit(False))
    lost = F.when(F.col("_available").isNotNull(), "RestoreUnavailable")
    restored = (
        F.when(observed.isin("Failed", "Cancelled", "Skipped"), observed)
        .when((~seen | (observed == "Ready")) & ready, "Ready")
        .otherwise("Stale")
    )
    why = (
        F.when(restored != "Stale", F.lit(None).cast("string"))
        .when(observed == "Ready", F.coalesce(lost, F.lit("RestoreNotRetained")))
        .when(observed == "Stale", F.coalesce(F.col("_o.reason"), F.lit("Unknown")))
        .when(~seen, F.coalesce(lost, F.lit("RestoreUnfinished")))
        .otherwise("RestoreUnfinished")
    )
    return joined.select(node, restored.alias("state"), why.alias("stale_reason"))


def run_history(
    df: DataFrame, node: str, run: str, seq: str, state: str, handle: str, protects: Column
) -> DataFrame:
    """Per (node, run): its last state that is neither Stale nor Pending (else the first one), value and protection."""
    observed = F.col(state).isNotNull()
    settled = observed & ~F.col(state).isin("Stale", "Pending")
    record = F.struct(F.col(state).alias("state"), F.col(seq).alias("at"))
    last_settled = F.max_by(record, F.when(settled, F.col(seq)))
    first_seen = F.min_by(record, F.when(observed, F.col(seq)))
    folded = df.groupBy(node, run).agg(
        F.coalesce(F.when(F.max(settled), last_settled), first_seen).alias("_s"),
        F.max(observed).alias("_observed"),
        F.max_by(handle, F.when(F.col(handle).isNotNull(), F.col(seq))).alias("value"),
        F.coalesce(F.bool_or(protects), F.lit(False)).alias("protected"),
    )
    return folded.where("_observed").select(
        node, run, F.col("_s.state").alias("state"), F.col("_s.at").alias("at"), "value", "protected"
    )
