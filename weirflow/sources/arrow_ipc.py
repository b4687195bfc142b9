"""Arrow IPC files and streams as a Spark data source, ``arrow_ipc``.

Reading: input partitions of about ``pack_bytes`` (128 MiB): runs of small files, or shares of a large
file's record batches, which the task finds in the file's footer; a stream is read by one task (its decoder
state is sequential).  The driver reads footers only where numbers of batches matter (``ids=true``,
``batch``, ``first``), several at a time.  Options: ``path`` (a file, or a directory whose files are read
in name order), ``layout`` (file, stream or auto), ``columns`` (comma-separated; the result keeps schema order),
``batch`` (one batch index), ``first`` (the first n batches), ``window_offset`` and ``window_rows`` (a row
window of each batch), ``window_bytes`` (batches are given on in windows of about that size),
``ids`` (``true`` adds batch_id and row_id, and window_id beside ``window_bytes``; ``chunk`` adds the file's
place as chunk_id), ``mmap``, ``limit_<cap>``.
Spark does not prune columns of Python data sources, so ``columns`` is what keeps a scan narrow.

Paths are on a file system that the driver and all executors mount.

Writing: one file per task, ``part-NNNNN.arrow``; written beside and renamed at commit, so a task
that is run twice leaves one file.  Options: ``layout``, ``compression`` (none or zstd), ``batch_rows`` (rows
of each record batch but a task's last; absent: as Spark hands them on).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import FormatError
from ..limits import DecodeLimits
from ..types import arrow_schema, readable_batch, spark_schema

#: Windows start at multiples of this many rows.
ALIGN = 512
#: Bytes of an input partition, and footers read at a time.
PACK_BYTES, FOOTERS = 128 << 20, 32
#: Batch numbers that a stream among several files is given room for.
STREAM_IDS = 1 << 20
MAGIC = b"ARROW1"
EXTENSIONS = (".arrow", ".ipc", ".feather")


def local(path: str) -> str:
    return path[len("file://") :] if path.startswith("file://") else path


def files_of(path: str) -> list[str]:
    """The files of a path; several paths are separated by line breaks and keep their order."""
    if "\n" in path:
        return [f for p in path.split("\n") for f in files_of(p)]
    path = local(path)
    if os.path.isdir(path):
        found = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(EXTENSIONS) and not f.startswith(("_", ".")))
        if not found:
            raise FormatError(f"no Arrow files found in '{path}'")
        return found
    if not os.path.exists(path):
        raise FormatError(f"no such file: '{path}'")
    return [path]


def layout_of(path: str, layout: str = "auto") -> str:
    if layout != "auto":
        return layout
    with open(path, "rb") as f:
        return "file" if f.read(len(MAGIC)) == MAGIC else "stream"


def _open(path: str, mmap: bool):
    return pa.memory_map(path) if mmap else pa.OSFile(path)


def projected(schema: pa.Schema, columns: str | list[str] | None) -> list[int] | None:
    """Field indexes of the asked columns, in schema order; an unknown name is an error."""
    if not columns:
        return None
    names = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns)
    unknown = [c for c in names if c not in schema.names]
    if unknown:
        raise FormatError(f"unknown column '{unknown[0]}'")
    return [i for i, n in enumerate(schema.names) if n in names]


def check_window(rows: int, offset: int, length: int) -> None:
    """A window starts at a multiple of ``ALIGN`` unless it is the whole batch, and ends inside it."""
    if offset < 0 or length < 0 or offset + length > rows:
        raise FormatError(f"window {offset}+{length} reaches past the batch's {rows} rows")
    if offset % ALIGN and not (offset == 0 and length == rows):
        raise FormatError(f"window offset {offset} is not a multiple of {ALIGN}")


def window_stride(rows: int, batch_bytes: int, target_bytes: int) -> int:
    """Rows of each window so that it has about ``target_bytes``: a multiple of ``ALIGN``, at most ``rows``."""
    if rows == 0:
        return ALIGN
    per_row = max(1, batch_bytes // rows)
    return min(rows, max(ALIGN, target_bytes // per_row // ALIGN * ALIGN))


class _Piece(NamedTuple):
    """Share ``share`` of ``shares`` of a file's batches; ``first`` is the number of the file's first batch."""

    path: str
    layout: str
    share: int
    shares: int
    first: int
    file_no: int


class _Pack(InputPartition):
    def __init__(self, pieces: list[_Piece]):
        super().__init__(tuple(pieces))
        self.pieces = pieces


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = dict(options), schema
        self.limits = DecodeLimits.from_options(options)
        self.mmap = str(options.get("mmap", "true")).lower() == "true"
        self.ids = str(options.get("ids", "false")).lower()
        self.pack = max(1, int(options.get("pack_bytes", PACK_BYTES)))
        self.wanted = self._wanted()

    def _wanted(self) -> tuple[int, int | None]:
        """The numbers of the batches to read, as a half-open range."""
        if "batch" in self.options:
            n = int(self.options["batch"])
            return n, n + 1
        n = self.options.get("first")
        if n is not None and int(n) < 0:
            raise FormatError(f"first is a number of batches, not {n}")
        return 0, None if n is None else int(n)

    def _batches(self, path: str) -> int:
        with _open(path, self.mmap) as f:
            return pa.ipc.open_file(f).num_record_batches

    def partitions(self) -> list[InputPartition]:
        paths = files_of(self.options["path"])
        kinds = [layout_of(p, self.options.get("layout", "auto")) for p in paths]
        low, high = self.wanted
        counted = self.ids == "true" or low or high is not None
        streams = kinds.count("stream")
        if streams and len(paths) > 1 and (low or high is not None):
            raise FormatError("batches of a stream are numbered by reading it: batch and first take one stream, or files")
        counts: list[int | None] = [None] * len(paths)
        if counted and not streams and high is not None:
            total = 0
            for i, p in enumerate(paths):  # no more footers than it takes
                counts[i] = self._batches(p)
                total += counts[i]
                if total >= high:
                    break
            if "batch" in self.options and not 0 <= low < total:
                raise FormatError(f"batch {low} is out of range, there are {total}")
        elif counted:
            with ThreadPoolExecutor(FOOTERS) as pool:
                counts = list(pool.map(lambda x: self._batches(x[0]) if x[1] == "file" else STREAM_IDS, zip(paths, kinds, strict=True)))
        packs: list[list[_Piece]] = [[]]
        first = filled = 0
        for no, (path, kind, n) in enumerate(zip(paths, kinds, counts, strict=True)):
            if high is not None and kind == "file" and (n is None or first >= high):
                break
            size = os.path.getsize(path)
            shares = 1 if kind == "stream" else max(1, -(-size // self.pack))
            shares = shares if n is None else max(1, min(shares, n))
            for share in range(shares):
                if n is not None and kind == "file" and (first + n * (share + 1) // shares <= low or high is not None and first + n * share // shares >= high):
                    continue
                if filled and filled + size / shares > self.pack:
                    packs.append([])
                    filled = 0
                packs[-1].append(_Piece(path, kind, share, shares, first, no))
                filled += size / shares
            first += n or 0
        return [_Pack(p) for p in packs]

    def _of(self, piece: _Piece, reader) -> Iterator[tuple[int, pa.RecordBatch]]:
        low, high = self.wanted
        if piece.layout == "stream":
            yield from ((piece.first + k, b) for k, b in islice(enumerate(reader), low, high))
            return
        n = reader.num_record_batches
        for k in range(n * piece.share // piece.shares, n * (piece.share + 1) // piece.shares):
            if piece.first + k >= low and (high is None or piece.first + k < high):
                yield piece.first + k, reader.get_batch(k)

    def read(self, partition: _Pack) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            with _open(piece.path, self.mmap) as f:
                opener = pa.ipc.open_file if piece.layout == "file" else pa.ipc.open_stream
                # a first look at the schema, then only the buffers of the asked columns are read
                fields = projected(opener(f).schema, self.options.get("columns"))
                f.seek(0)
                reader = opener(f, options=pa.ipc.IpcReadOptions(included_fields=fields))
                self.limits.check("fields", len(reader.schema))
                for number, batch in self._of(piece, reader):
                    self.limits.check("rows", batch.num_rows)
                    self.limits.check("frame_bytes", batch.nbytes)
                    yield from self._shaped(piece, number, batch)

    def _shaped(self, piece: _Piece, number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The windows of a batch that are asked for, with the columns of its numbers."""
        start, rows = 0, batch.num_rows
        if "window_rows" in self.options or "window_offset" in self.options:
            start = int(self.options.get("window_offset", 0))
            rows = int(self.options.get("window_rows", batch.num_rows - start))
            check_window(batch.num_rows, start, rows)
        stride = window_stride(batch.num_rows, batch.nbytes, int(self.options["window_bytes"])) if "window_bytes" in self.options else max(1, rows)
        for k, at in enumerate(range(start, start + rows, stride)):
            out = readable_batch(batch.slice(at, min(stride, start + rows - at)))
            n = out.num_rows
            if self.ids == "chunk":
                out = out.append_column("chunk_id", pa.array(np.full(n, piece.file_no, np.int64)))
            elif self.ids == "true":
                out = out.append_column("batch_id", pa.array(np.full(n, number, np.int64))).append_column("row_id", pa.array(np.arange(at, at + n, dtype=np.int64)))
                if "window_bytes" in self.options:
                    out = out.append_column("window_id", pa.array(np.full(n, k, np.int64)))
            yield out


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str, rows: int):
        self.temporary, self.final, self.rows = temporary, final, rows


def ipc_options(compression: str | None) -> pa.ipc.IpcWriteOptions:
    c = (compression or "none").lower()
    if c in ("none", "uncompressed"):
        return pa.ipc.IpcWriteOptions()
    if c == "zstd":
        return pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
    if c == "snappy":
        raise FormatError("snappy is not supported for Arrow IPC, use zstd")
    raise ValueError(f"unknown compression '{compression}'")


def resized(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``; the last may be shorter."""
    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= rows:
            held.append(b.slice(0, rows - n))
            yield pa.concat_batches(held)
            b, held, n = b.slice(rows - n), [], 0
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.concat_batches(held)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.folder, self.layout = local(options["path"]), options.get("layout", "file")
        self.compression, self.overwrite = options.get("compression"), overwrite
        ipc_options(self.compression)
        self.schema, self.batch_rows = arrow_schema(schema), int(options.get("batch_rows", 0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        final = os.path.join(self.folder, f"part-{ctx.partitionId():05d}.arrow")
        temporary = f"{self.folder}/_attempt-{ctx.taskAttemptId()}.tmp"
        rows, writer = 0, None
        for b in resized(iterator, self.batch_rows) if self.batch_rows else iterator:
            if not b.num_rows:
                continue
            if writer is None:
                os.makedirs(self.folder, exist_ok=True)
                writer = (pa.ipc.new_stream if self.layout == "stream" else pa.ipc.new_file)(temporary, self.schema, options=ipc_options(self.compression))
            writer.write_batch(b.cast(self.schema) if b.schema != self.schema else b)
            rows += b.num_rows
        if writer is not None:
            writer.close()
        return _Written(temporary, final, rows)

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None and m.rows]
        os.makedirs(self.folder, exist_ok=True)
        if self.overwrite:
            for f in os.listdir(self.folder):
                if f.endswith(".arrow"):
                    os.remove(os.path.join(self.folder, f))
        for m in done:
            os.replace(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class ArrowIpcSource(DataSource):
    """``spark.read.format("arrow_ipc")`` and ``df.write.format("arrow_ipc")``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        path = files_of(self.options["path"])[0]
        with _open(path, False) as f:
            s = (pa.ipc.open_file if layout_of(path, self.options.get("layout", "auto")) == "file" else pa.ipc.open_stream)(f).schema
        fields = projected(s, self.options.get("columns"))
        out = spark_schema(s if fields is None else pa.schema([s.field(i) for i in fields]))
        extra = {"true": ("batch_id", "row_id"), "chunk": ("chunk_id",)}.get(str(self.options.get("ids", "false")).lower(), ())
        if "batch_id" in extra and "window_bytes" in self.options:
            extra = (*extra, "window_id")
        out = StructType([*out.fields, *(StructField(n, LongType()) for n in extra)])
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(ArrowIpcSource)


def read_ipc(spark, path: str, **options):
    """A DataFrame over Arrow IPC; ``columns`` may be a list."""
    register(spark)
    given = {k: ",".join(v) if isinstance(v, (list, tuple)) else str(v) for k, v in options.items() if v is not None}
    return spark.read.format("arrow_ipc").options(**given).option("path", path).load()


def write_ipc(df, path: str, layout: str = "file", compression: str | None = None, mode: str = "overwrite", batch_rows: int = 0) -> None:
    register(df.sparkSession)
    df.write.format("arrow_ipc").mode(mode).option("path", path).option("layout", layout).option("compression", compression or "none").option("batch_rows", batch_rows).save()


def serialise(batches: list[pa.RecordBatch], schema: pa.Schema, compression: str | None = None) -> bytes:
    """One self-contained IPC stream of the batches."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=ipc_options(compression)) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def deserialise(data: bytes) -> pa.Table:
    """The table of a self-contained IPC stream; bytes behind its end are an error."""
    source = pa.BufferReader(data)
    table = pa.ipc.open_stream(source).read_all()
    if source.tell() != len(data):
        raise FormatError(f"{len(data) - source.tell()} trailing bytes after the stream's end")
    return table


def to_payloads(df, name: str = "payload"):
    """Each Arrow batch of the DataFrame as one binary row: a self-contained IPC stream."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([serialise([b], b.schema)], pa.binary())], [name])

    return df.mapInArrow(run, f"{name} binary")


def from_payloads(df, schema: StructType | str, name: str = "payload"):
    """The rows of IPC stream payloads."""

    def run(batches):
        for b in batches:
            for x in b.column(name):
                for out in deserialise(x.as_py()).to_batches():
                    yield readable_batch(out)

    return df.select(name).mapInArrow(run, schema)
