"""Shared inputs of the registered queries and the matching SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.exact import cents
from plumbline.session import load

# events with exact amounts: cents, microseconds since 1970, and the number inside props
E = """e AS (
  SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, props
  FROM events)"""

# lineitem with Int quantity and price in cents
L = """l AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS p
  FROM lineitem)"""
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_amounts(load(spark, sf_dir, "events"))


def with_amounts(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id",
        "ts",
        F.unix_micros("ts").alias("us"),
        "user_id",
        "event_type",
        cents(F.col("value")).alias("cents"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
        "props",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        *LINE_KEYS, F.col("l_quantity").cast("bigint").alias("q"), cents(F.col("l_extendedprice")).alias("p")
    )


def plain(df: DataFrame) -> DataFrame:
    """Exact decimals as DOUBLE for display; the engines print decimals of one value with different scales."""
    return df.select(
        *[F.col(f.name).cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema]
    )


def half_even(top: str, bottom: str, scale: int) -> str:
    """SQL for top / bottom rounded half-even, nonnegative integers."""
    t, b = f"(({top}) * {10**scale})", f"({bottom})"
    up = f"(2 * ({t} % {b}) > {b} OR (2 * ({t} % {b}) = {b} AND ({t} // {b}) % 2 = 1))"
    return f"(({t} // {b} + CASE WHEN {up} THEN 1 ELSE 0 END) / {10**scale}.0)::DOUBLE"


def half_up(top: str, bottom: str, scale: int) -> str:
    t, b = f"(({top})::HUGEINT * {10**scale})", f"({bottom})"
    return f"(({t} // {b} + CASE WHEN 2 * ({t} % {b}) >= {b} THEN 1 ELSE 0 END)::DOUBLE / {10**scale}.0)"
