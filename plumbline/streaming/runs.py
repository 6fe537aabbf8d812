"""Running streams to completion over the files that exist, with a checkpoint and a written result.

``availableNow`` processes everything present in rate-limited micro-batches and stops. The checkpoint folder makes a
restart continue after the last committed batch; pass the same ``folder`` to restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.session import configure, run_folder

BATCH_BYTES = 1 << 30
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Parquet files as a stream; ``batch_bytes`` bounds the files one micro-batch reads.

    The bound also limits what a stateful operator puts into order for one key, however hot the key is.

    The name is given as a glob because the file source takes a plain path for a directory; a single file works too.
    """
    configure(spark)
    folder, _, name = path.rstrip("/").rpartition("/")
    path = f"{folder}/{{{name}}}"
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)


def run_to_table(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Append every output row of a stream to Parquet and return that table."""
    spark = stream.sparkSession
    folder = folder or run_folder(spark, label)
    _stateful_settings(spark)
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_batches(
    stream: DataFrame, label: str, step: Callable[[DataFrame, int, str], None], folder: str | None = None, mode: str = "append"
) -> str:
    """Call ``step(batch, batch_id, folder)`` per micro-batch and return the folder.

    A batch may be repeated after a failure, so a step writes to a place named by its batch id and overwrites it.
    """
    spark = stream.sparkSession
    folder = folder or run_folder(spark, label)
    _stateful_settings(spark)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(lambda batch, batch_id: step(batch, batch_id, folder))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return folder


def _stateful_settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
