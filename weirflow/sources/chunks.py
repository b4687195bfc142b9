"""Chunked directories: a table as files ``<base>-<digits>.<ext>``, in the order of their numbers."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from ..types import arrow_schema
from .arrow_ipc import ipc_options, local, read_ipc

# The extension of each chunked format.
EXTENSION = {"ipc": "arrow", "parquet": "parquet", "csv": "csv"}


def list_chunks(folder: str, base: str, fmt: str) -> list[str]:
    """Paths of the set's files by number (not by name); other files are ignored."""
    pattern = re.compile(rf"{re.escape(base)}-(\d+)\.{EXTENSION[fmt]}")
    found = [(int(m[1]), f) for f in os.listdir(local(folder)) if (m := pattern.fullmatch(f))]
    if not found:
        raise FormatError(f"no chunked table files found in '{folder}'")
    return [os.path.join(local(folder), f) for _, f in sorted(found)]


def infer_base(folder: str, fmt: str | None = None, base: str | None = None) -> tuple[str, str]:
    """Base and format of the only set in the folder that fits what is given."""
    by_extension = {v: k for k, v in EXTENSION.items()}
    sets = set()
    for f in os.listdir(local(folder)):
        if (m := re.fullmatch(r"(.+)-(\d+)\.(\w+)", f)) and m[3] in by_extension:
            kind = by_extension[m[3]]
            if fmt in (None, kind) and base in (None, m[1]):
                sets.add((m[1], kind))
    if not sets:
        raise FormatError(f"no chunked table files found in '{folder}'")
    if len(sets) > 1:
        raise FormatError(f"multiple chunk sets found in '{folder}', pass base=... or format=...")
    return sets.pop()


def read_chunks(spark: SparkSession, folder: str, base: str | None = None, fmt: str | None = None, columns: Sequence[str] | None = None, chunk: int | None = None, **options) -> DataFrame:
    """The set's rows with ``chunk_id``: the place of the row's file in number order.

    All files are one scan, so chunks are read in parallel; Parquet prunes to ``columns``, Arrow reads
    only their buffers, CSV drops the others after decoding.  ``chunk`` reads one file only.
    """
    if base is None or fmt is None:
        base, fmt = infer_base(folder, fmt, base)
    paths = list_chunks(folder, base, fmt)
    if chunk is not None:
        if not 0 <= chunk < len(paths):
            raise FormatError(f"chunk {chunk} is out of range, there are {len(paths)}")
        picked = [(chunk, paths[chunk])]
    else:
        picked = list(enumerate(paths))
    if fmt == "ipc":
        df = read_ipc(spark, "\n".join([p for _, p in picked]), columns=columns, ids="chunk")
        return df if chunk is None else df.withColumn("chunk_id", F.lit(chunk).cast("bigint"))
    place = F.create_map(*(x for k, p in picked for x in (F.lit(int(re.search(r"-(\d+)\.\w+$", p)[1])), F.lit(k))))
    number = F.regexp_extract(F.col("_metadata.file_name"), r"-(\d+)\.\w+$", 1).cast("int")
    if fmt == "parquet":
        df = spark.read.parquet(*(p for _, p in picked))
        names = df.columns
        if columns:
            unknown = [c for c in columns if c not in names]
            if unknown:
                raise FormatError(f"unknown column '{unknown[0]}'")
            names = [c for c in names if c in columns]
        return df.select(*names, place[number].cast("bigint").alias("chunk_id"))
    from ..functions.csv import decode_columns, infer_schema, read_text_columns

    raw = read_text_columns(spark, [p for _, p in picked], with_file=True, **options)
    names = [c for c in raw.columns if c != "_file"]
    schema = infer_schema(read_text_columns(spark, [picked[0][1]], **options))
    df = decode_columns(raw, schema, keep=["_file"])
    if columns:
        names = [c for c in names if c in columns]
    number = F.regexp_extract("_file", r"-(\d+)\.\w+$", 1).cast("int")
    return df.select(*names, place[number].cast("bigint").alias("chunk_id"))


def write_chunks(df: DataFrame, folder: str, base: str, fmt: str, chunk: str | None = None, n: int | None = None, start: int = 0, compression: str | None = None) -> list[str]:
    """Writes the table as chunks ``<base>-%010d.<ext>`` and returns their paths in order.

    ``chunk`` names an integer column that gives each row's chunk (0, 1, ...); else rows go round-robin
    to ``n`` chunks.  Each chunk is written by a task of its own; files are renamed when all are there.
    """
    os.makedirs(local(folder), exist_ok=True)
    if chunk is None:
        # the id's upper bits are the partition's number, the lower ones the row's place in it
        m = F.monotonically_increasing_id()
        df, chunk, drop = df.withColumn("_chunk", F.pmod(F.shiftright(m, 33) + m.bitwiseAND((1 << 33) - 1), F.lit(n or 1))), "_chunk", True
    else:
        drop = False
    if fmt == "ipc":
        return _write_ipc_chunks(df, folder, base, chunk, drop, start, compression)
    total = df.agg(F.max(chunk)).first()[0]
    if total is None:
        return []
    total = int(total) + 1
    # rows of a chunk are in one range, so a chunk's folder gets one file
    stage = os.path.join(local(folder), f"_{base}.staged")
    w = df.repartitionByRange(total, chunk).sortWithinPartitions(chunk).withColumn("_c", F.col(chunk))
    w = (w.drop(chunk) if drop else w).write.mode("overwrite").partitionBy("_c").option("compression", compression or "none")
    (w.parquet if fmt == "parquet" else w.option("header", True).option("emptyValue", "").csv)(stage)
    ext, out = EXTENSION[fmt], []
    for k in range(total):
        where = f"{stage}/_c={k}"
        if not os.path.isdir(where):
            continue
        files = sorted(f for f in os.listdir(where) if f.endswith(f".{ext}"))
        if len(files) != 1:
            raise FormatError(f"chunk {k} has {len(files)} files")
        final = os.path.join(local(folder), f"{base}-{start + k:010d}.{ext}")
        os.replace(os.path.join(where, files[0]), final)
        out.append(final)
    shutil.rmtree(stage)
    return out


def _write_ipc_chunks(df: DataFrame, folder: str, base: str, chunk: str, drop: bool, start: int, compression: str | None) -> list[str]:
    """One job: all rows of a chunk are in one partition, sorted; a task opens a file whenever the chunk changes.

    A file is written beside and renamed when it is whole, so a task that runs twice leaves one file.
    """
    ipc_options(compression)
    target = local(folder)
    schema = arrow_schema(df.drop(chunk).schema if drop else df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        temporary = os.path.join(target, f"_attempt-{TaskContext.get().taskAttemptId()}.tmp")
        now, writer, done = None, None, []

        def finish() -> None:
            if writer is not None:
                writer.close()
                os.replace(temporary, os.path.join(target, f"{base}-{start + now:010d}.arrow"))
                done.append(now)

        for b in batches:
            keys = b.column(chunk).to_numpy(zero_copy_only=False)
            body = b.drop_columns([chunk]) if drop else b
            body = body.cast(schema) if body.schema != schema else body
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if keys[lo] != now:
                    finish()
                    now, writer = int(keys[lo]), pa.ipc.new_file(temporary, schema, options=ipc_options(compression))
                writer.write_batch(body.slice(lo, hi - lo))
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["chunk"])

    written = df.repartition(F.col(chunk)).sortWithinPartitions(chunk).mapInArrow(run, "chunk bigint").collect()
    return [os.path.join(target, f"{base}-{start + k:010d}.arrow") for k in sorted(r["chunk"] for r in written)]
