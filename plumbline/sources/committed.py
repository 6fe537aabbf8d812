"""A dataset's committed generations as a stream source whose offsets are generation numbers.

A generation counts once its manifest row is there; record files without one are never read. Splits are row groups of
record files, so a generation is read by as many tasks as it has groups. Listing and reading go through Arrow file systems
(local and mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "committed_generations"
ROW_GROUPS = 8  # row groups per split, at most
START = -1  # the offset before the first generation


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def _parts(system: fs.FileSystem, folder: str) -> list[str]:
    """Parquet files of one generation, in order; none while it is being written."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and re.match(r"part-.*\.parquet$", f.base_name))


def committed(path: str) -> list[int]:
    """Numbers of the generations that have a manifest row, ascending."""
    system, root = open_folder(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True))
    numbers = [int(m[1]) for f in found if (m := re.match(r"generation=(\d+)$", f.base_name))]
    return sorted(n for n in numbers if _parts(system, f"{root}/manifest/generation={n}"))


@dataclass
class Groups(InputPartition):
    """Some row groups of one record file."""

    generation: int
    file: str
    first: int
    stop: int


def _splits(path: str, after: int, last: int) -> list[Groups]:
    system, root = open_folder(path)
    out = []
    for generation in committed(path):
        if after < generation <= last:
            for file in _parts(system, f"{root}/records/generation={generation}"):
                count = pq.ParquetFile(system.open_input_file(file)).num_row_groups
                out.extend(Groups(generation, file, at, min(at + ROW_GROUPS, count)) for at in range(0, count, ROW_GROUPS))
    return out


def _batches(path: str, schema: pa.Schema, part: Groups) -> Iterator[pa.RecordBatch]:
    system, _ = open_folder(path)
    file = pq.ParquetFile(system.open_input_file(part.file))
    stored = [f.name for f in schema if f.name != "generation"]
    for batch in file.iter_batches(row_groups=list(range(part.first, part.stop)), columns=stored):
        columns = []
        for field in schema:
            if field.name == "generation":
                columns.append(pa.array([part.generation] * batch.num_rows, field.type))
            else:
                columns.append(batch.column(field.name).cast(field.type))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class _Batch(DataSourceReader):
    def __init__(self, path: str, schema: StructType, after: int) -> None:
        self.path, self.schema, self.after = path, schema, after

    def partitions(self) -> list[Groups]:
        numbers = committed(self.path)
        return _splits(self.path, self.after, numbers[-1]) if numbers else []

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _batches(self.path, _arrow(self.schema), partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, after: int) -> None:
        self.path, self.schema, self.after = path, schema, after

    def initialOffset(self) -> dict:
        return {"generation": self.after}

    def latestOffset(self) -> dict:
        numbers = committed(self.path)
        return {"generation": max(numbers[-1], self.after) if numbers else self.after}

    def partitions(self, start: dict, end: dict) -> list[Groups]:
        return _splits(self.path, start["generation"], end["generation"])

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, _arrow(self.schema), partition)

    def commit(self, end: dict) -> None:
        """Nothing is released: datasets only grow."""


class CommittedGenerations(DataSource):
    """Options ``path`` and ``after`` (the last generation that is not wanted); the schema is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(self.options["path"], schema, int(self.options.get("after", START)))

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(self.options["path"], schema, int(self.options.get("after", START)))


def follow(spark: SparkSession, path: str, schema: StructType, after: int = START) -> DataFrame:
    """The records of all generations behind ``after`` as a stream that also sees later ones, once they are committed."""
    spark.dataSource.register(CommittedGenerations)
    return spark.readStream.format(FORMAT).schema(schema).option("path", path).option("after", str(after)).load()
