"""Raw video frames as a Python data source: fixed-length frames of headerless files, read by ranges.

``spark.read.format("raw_frames").option("frame_bytes", n).load(folder)`` gives (path, number, frame). Planning
lists the files below the folder and cuts each into ranges of whole frames, so that an hours-long stream
is read by many tasks, and no row, batch or task holds more than a bounded number of frames. Files lie in
any file system that pyarrow opens by its address. What is left behind a file's last whole frame is no
frame; ``frame_faults`` reports it, from file sizes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from factloom.operators.rules import union, violations

SCHEMA = "path string, number long, frame binary"
#: Bytes of frames that a task reads, and that a batch holds.
SPLIT_BYTES = 64 << 20
_BATCH_BYTES = 4 << 20


def _located(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (pafs.LocalFileSystem(), address)


def listed(folder: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of every file, hidden ones and those of Spark's writers aside."""
    fs, root = _located(folder)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"NO_SUCH_FOLDER: {folder}")
    if info.is_file:
        return [("", info.size)]
    found = [(f.path[len(root.rstrip("/")) + 1 :], f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file]
    return sorted(x for x in found if not any(p.startswith((".", "_")) for p in x[0].split("/")))


@dataclass
class FrameRange(InputPartition):
    path: str
    first: int
    frames: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if int(options.get("frame_bytes", 0)) <= 0:
            raise ValueError("INVALID_PARAMETER: frame_bytes is a positive number")
        self.folder, self.frame_bytes = options["path"], int(options["frame_bytes"])
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[FrameRange]:
        each = max(1, self.split_bytes // self.frame_bytes)
        return [FrameRange(path, first, min(each, size // self.frame_bytes - first)) for path, size in listed(self.folder) for first in range(0, size // self.frame_bytes, each)]

    def read(self, partition: FrameRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no whole frame anywhere
            return
        fs, root = _located(self.folder)
        each = max(1, _BATCH_BYTES // self.frame_bytes)
        with fs.open_input_file(f"{root.rstrip('/')}/{partition.path}" if partition.path else root) as f:
            f.seek(partition.first * self.frame_bytes)
            for at in range(partition.first, partition.first + partition.frames, each):
                n = min(each, partition.first + partition.frames - at)
                data = f.read(n * self.frame_bytes)
                if len(data) != n * self.frame_bytes:
                    raise ValueError(f"TRUNCATED_FRAME: {partition.path} has changed since it was listed")
                frames = [data[i : i + self.frame_bytes] for i in range(0, len(data), self.frame_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(range(at, at + n), pa.int64()), pa.array(frames, pa.binary())], names=["path", "number", "frame"])


class RawFrames(DataSource):
    """Options: path, frame_bytes, and split_bytes for the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_frames(spark: SparkSession, folder: str, frame_bytes: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, number, frame) of every whole frame of the files below the folder."""
    spark.dataSource.register(RawFrames)
    return spark.read.format("raw_frames").option("frame_bytes", frame_bytes).option("split_bytes", split_bytes).load(folder)


def frame_faults(spark: SparkSession, folder: str, frame_bytes: int) -> DataFrame:
    """Files that are empty or end within a frame, as violations: from the listing that planning makes too,
    as scans leave empty files out; contents are not read."""
    sizes = spark.createDataFrame(listed(folder), "path string, length long")
    return union(
        violations(sizes, "NO_FRAMES", F.col("path"), F.col("length") == 0),
        violations(sizes, "TRUNCATED_FRAME", F.col("path"), F.col("length") % frame_bytes != 0, F.col("length") % frame_bytes),
    )
