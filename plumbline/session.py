"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Semantics the operators rely on. All are runtime settings, so a session created elsewhere can be adopted.
_SETTINGS = {
    # checked integers, failing casts, failing array indexes
    "spark.sql.ansi.enabled": "true",
    # instants are UTC; naive Parquet timestamps are read as UTC instants
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    # generated methods above the size the JVM compiles run interpreted; Spark then splits the expressions instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


TASK_ROWS, TASK_BYTES = 1 << 19, "4m"  # rows and compressed bytes of a shuffle partition under small_tasks


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator assumes and return the session."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; projection and filters of later steps reach the Parquet scan."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing to the shared folder, so a lost executor loses no data."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """While jobs run in here, shuffles that move about ``rows`` rows make tasks of a bounded number of them.

    By default Spark joins shuffle partitions up to 64 MB as compressed. Short keys shrink so well that such a task holds
    millions of rows and needs more than a GB to sort them.
    """
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    usual = int(spark.conf.get(initial, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {initial: str(max(usual, -(-rows // TASK_ROWS))), "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that start and end in here are removed as each ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one written table or one streaming run."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts the lineage, survives lost executors.

    Unlike a checkpoint it is compressed, and its columns and row groups are read by need. The shuffles of the write end with it.
    """
    path = run_folder(df.sparkSession, label)
    with spent_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
