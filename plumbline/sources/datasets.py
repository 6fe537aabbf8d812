"""Append-only datasets as Parquet generations with exact prefix reads.

Layout below one path::

    records/generation=N/part-*.parquet     rows with a contiguous ``ordinal``
    manifest/generation=N/part-*.parquet    one row: first, records, digest, schema digest, lifecycle

A generation becomes visible when its manifest row exists. Writing a generation again replaces it, which makes a
repeated micro-batch harmless. Ordinals are sorted inside files, so ranges are pruned by Parquet statistics.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.guards import KindError, require_between
from plumbline.operators.ordered import position
from plumbline.operators.rows import csv_rows

_MANIFEST = "generation bigint, first bigint, records bigint, digest bigint, schema_digest string, lifecycle string"


def schema_digest(df: DataFrame) -> str:
    """Digest of field names and kinds, independent of field order."""
    fields = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema if f.name not in ("generation", "ordinal"))
    return hashlib.sha256("\n".join(fields).encode()).hexdigest()


def content_digest(columns: list[str]) -> Column:
    """Order-independent aggregate over rows and their ordinals."""
    return F.bit_xor(F.xxhash64(*columns))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Committed generations; empty for a dataset that does not exist yet."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def append(df: DataFrame, path: str, generation: int, *order: Column | str, lifecycle: str = "open") -> None:
    """Write one generation. Its ordinals continue those of the generations before it, in the given total order.

    Only the last generation can be written again: another size would overlap the ordinals of later ones.
    """
    spark = df.sparkSession
    if not manifest(spark, path).where(F.col("generation") > generation).isEmpty():
        raise ValueError("only the last generation of a dataset can be replaced")
    earlier = manifest(spark, path).where(F.col("generation") < generation)
    known = earlier.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n"), F.max("schema_digest").alias("s")).first()
    if known.s is not None and known.s != schema_digest(df):
        raise KindError("dataset has another schema")
    placed = position(df, *order, name="ordinal").withColumn("ordinal", F.col("ordinal") + F.lit(known.n))
    target = f"{path}/records/generation={generation}"
    placed.sortWithinPartitions("ordinal").write.mode("overwrite").parquet(target)
    written = spark.read.parquet(target)
    line = written.agg(
        F.lit(generation).cast("bigint").alias("generation"),
        F.lit(known.n).cast("bigint").alias("first"),
        F.count(F.lit(1)).alias("records"),
        F.coalesce(content_digest(sorted(written.columns)), F.lit(0)).alias("digest"),
        F.lit(schema_digest(df)).alias("schema_digest"),
        F.lit(lifecycle).alias("lifecycle"),
    ).drop("generation")
    line.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/generation={generation}")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all committed generations with ``generation`` (a partition column) and ``ordinal``."""
    stored = spark.read.option("basePath", f"{path}/records").parquet(f"{path}/records/generation=*")
    return stored.join(manifest(spark, path).select("generation"), "generation", "left_semi")


def prefix_digest(spark: SparkSession, path: str, generation: int) -> str:
    """Anchor of the exact prefix up to a generation, its record count and digest, from the manifest alone."""
    upto = manifest(spark, path).where(F.col("generation") <= generation)
    found = upto.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n"), F.coalesce(F.bit_xor("digest"), F.lit(0)).alias("d")).first()
    return f"{found.n}:{found.d}"


def snapshot(spark: SparkSession, path: str, generation: int, anchor: str) -> DataFrame:
    """Rows of an exact prefix. A changed anchor is refused; it never becomes "latest"."""
    if prefix_digest(spark, path, generation) != anchor:
        raise ValueError("dataset prefix does not match its anchor")
    return records(spark, path).where(F.col("generation") <= generation)


def page(spark: SparkSession, path: str, start: int = 0, limit: int = 50) -> DataFrame:
    """Rows [start, start + limit) by exact ordinal, with the next ordinal and whether the extent ends here."""
    require_between("start", start, 0, 1 << 62)
    require_between("limit", limit, 1, 100)
    extent = manifest(spark, path).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first().n
    if start > extent:
        raise ValueError("page starts past the extent")
    end = min(start + limit, extent)
    rows = records(spark, path).where((F.col("ordinal") >= start) & (F.col("ordinal") < end))
    return rows.withColumns({"next": F.lit(end).cast("bigint"), "extent_exhausted": F.lit(end == extent)})


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """Records, generations, lifecycle and schema digest of the committed extent, from the manifest."""
    return manifest(spark, path).agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.count(F.lit(1)).alias("generations"),
        F.max("generation").alias("last_generation"),
        F.max_by("lifecycle", "generation").alias("lifecycle"),
        F.max("schema_digest").alias("schema_digest"),
    )


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Recount and rehash the stored rows of each generation against its manifest."""
    stored = records(spark, path)
    hashed = sorted(c for c in stored.columns if c != "generation")
    actual = stored.groupBy("generation").agg(
        F.count(F.lit(1)).alias("actual"), content_digest(hashed).alias("actual_digest")
    )
    ok = (F.col("records") == F.coalesce("actual", F.lit(0))) & (F.col("digest") == F.coalesce("actual_digest", F.lit(0)))
    return manifest(spark, path).join(actual, "generation", "left").select("generation", "records", ok.alias("intact"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files without a header: every cell quoted, quotes doubled, records end with CRLF.

    Records are written as text, because the CSV writer would turn a line feed inside a cell into CRLF.
    """
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    lines = csv_rows(cells, df.columns, "line").select(F.regexp_replace("line", r"\r\n\z", "").alias("line"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)
