"""Raw bytes of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 20


def read_bytes(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """path, offset, bytes: the files' content in pieces of ``chunk`` bytes; a file is one task's."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = c.as_buffer()
                for i in range(0, raw.size, chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([i], pa.int64()), pa.array([raw[i : i + chunk].to_pybytes()], pa.binary())], ["path", "offset", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "path string, offset bigint, bytes binary")
