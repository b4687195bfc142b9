"""``read`` and ``write``: one surface over files, chunked directories, capture files, pipes and wires."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import uri as U
from .api_types import Message
from .errors import FlowError, FormatError, ProtocolError, TransportError
from .functions import csv as C
from .functions import json as J
from .limits import DecodeLimits
from .shared import shared_top
from .sources import arrow_ipc, chunks, frames
from .sources.arrow_ipc import local
from .streaming import wires
from .types import readable_batch


class Reader:
    """A source: ``dataframe()`` for Spark, iteration and ``read_all`` for Arrow batches on the driver."""

    def __init__(self, make, registry: frames.Registry | None = None, rows: int | None = None):
        self._make, self._registry, self._closed, self._drained = make, registry, False, False
        self._rows = rows or U.TEXT_BATCH

    def _check(self) -> None:
        if self._closed:
            raise FlowError("the reader is closed")

    def register_table(self, name: str) -> int:
        return self._names().register_table(name)

    def register_message(self, name: str) -> int:
        return self._names().register_message(name)

    def _names(self) -> frames.Registry:
        self._check()
        if self._registry is None:
            raise ProtocolError("names are registered on frames protocol sources only")
        return self._registry

    def dataframe(self) -> DataFrame:
        self._check()
        return self._make(self._registry)

    def __iter__(self) -> Iterator:
        df = self.dataframe()
        self._drained = True
        if self._registry is not None:
            for r in df.orderBy("file", "seq").toLocalIterator():
                yield Message(r["tag"], r["name"], bytes(r["payload"]), r["kind"])
            return
        ids = [c for c in ("chunk_id", "batch_id") if c in df.columns]
        yield from wires.local_batches(df, ids[0] if ids else None, self._rows)

    def read_all(self) -> pa.Table:
        """One table of all batches (message frames are skipped); an empty table when already drained."""
        self._check()
        if self._drained:
            return pa.table({})
        self._drained = True
        df = self.dataframe()
        if self._registry is not None:
            tables = [arrow_ipc.deserialise(bytes(r["payload"])) for r in df.filter("kind = 'table'").orderBy("file", "seq").toLocalIterator()]
            return pa.concat_tables(tables) if tables else pa.table({})
        return df.toArrow()

    def __arrow_c_stream__(self, requested_schema=None):
        t = self.read_all()
        if t.num_columns == 0:
            raise FlowError("empty source: it has no schema to export")
        self.close()
        return t.__arrow_c_stream__(requested_schema)

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def read(
    spark: SparkSession, uri: str, *, format: str | None = None, protocol: str | None = None, parallel: int = 0, accept: bool = False, tls_cert: str | None = None, tls_key: str | None = None, tls_ca: str | None = None,
    mmap: bool | None = None, out_of_core: bool = False, base: str | None = None, delimiter: str | None = None, header: bool | None = None, batch_size: int | None = None,
    schema: T.StructType | None = None, columns: Sequence[str] | None = None, policy: str = "error", limits: DecodeLimits | None = None, order: bool = False,
) -> Reader:
    """A Reader over the endpoint; arguments that do not apply to it are errors."""
    e, p = U.resolve_endpoint(uri), U.resolve_protocol(protocol)
    U.check_tls(e, accept, tls_cert, tls_key, tls_ca)
    given = any(x is not None for x in (format, delimiter, header, batch_size, mmap, base)) or out_of_core
    U.check_place(e, accept=accept, parallel=parallel, protocol=p, format_arguments=given)
    if e.wire and p == "frames":
        return Reader(lambda r: _received(spark, e, accept, r), frames.Registry())
    if e.wire:
        if schema is None:
            raise TransportError("a wire has no schema before its first batch, pass schema=...")
        if accept:
            return Reader(lambda _: _accepted(spark, e, max(1, parallel), order, (tls_cert, tls_key, None)))
        df = wires.read_wires(spark, e.scheme, e.address, schema, max(1, parallel), tls_ca)
        return Reader(lambda _: df.orderBy("seq_id", "row_id") if order else df)
    if p == "frames":
        if e.scheme == "stdio":
            raise TransportError("the frames protocol does not frame stdio here")
        return Reader(lambda r: frames.read_capture(spark, e.address, r), frames.Registry())
    if e.scheme == "stdio":
        if format not in (None, "csv", "ipc", "arrow"):
            raise FormatError("text on stdio is read in the csv format only")
        return Reader(lambda _: _stdin(spark, format, delimiter, header))
    if out_of_core and mmap:
        raise ValueError("a file is either mapped (mmap) or read by and by (out_of_core)")
    path = local(e.address)
    if os.path.isdir(path):
        fmt = U.FORMAT_NAMES.get(format) if format else None
        if format and fmt is None:
            raise ValueError(f"'{format}' is none of the formats {', '.join(U.FORMAT_NAMES)}")
        if fmt == "json":
            raise FormatError("directories of chunks hold arrow, parquet or csv files, no json")
        base, fmt = chunks.infer_base(path, fmt, base)
        U.check_format_arguments(fmt, delimiter, header, batch_size)
        text = {"delimiter": delimiter or ",", "header": True if header is None else header} if fmt == "csv" else {}
        return Reader(lambda _: chunks.read_chunks(spark, path, base, fmt, columns, **text))
    fmt = U.resolve_format(path, format)
    U.check_format_arguments(fmt, delimiter, header, batch_size)
    if not os.path.exists(path):
        raise FormatError(f"no such file: '{path}'")
    if fmt == "ipc":
        use = (os.path.getsize(path) >= U.MMAP_FROM if mmap is None else mmap) and not out_of_core
        caps = {f"limit_{k}": v for k, v in vars(limits).items()} if limits else {}
        return Reader(lambda _: arrow_ipc.read_ipc(spark, path, columns=list(columns) if columns else None, mmap=str(use).lower(), ids="true", **caps))
    if fmt == "parquet":
        return Reader(lambda _: _narrow(spark.read.parquet(path), columns))
    if fmt == "csv":
        return Reader(lambda _: _narrow(C.read_csv(spark, path, schema, delimiter or ",", header=True if header is None else header), columns), rows=batch_size)
    if schema is None:
        raise FormatError("reading JSON needs a schema, pass schema=...")
    how = J.read_ndjson if U.json_lines(path) else J.read_json_array
    return Reader(lambda _: _narrow(how(spark, path, schema, policy), columns), rows=batch_size)


def _narrow(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    from .operators.batches import select_columns

    return select_columns(df, columns) if columns else df


def _received(spark: SparkSession, e: U.Endpoint, accept: bool, registry: frames.Registry) -> DataFrame:
    """The frames of one peer until it ends, taken on the driver, as its state is one sequence."""
    from .streaming.connection import Connection

    c = Connection.open(e.scheme, e.address, registry, accept, timeout=60)
    rows = [(e.address, k, m.tag, m.name, m.kind, bytearray(m.payload)) for k, m in enumerate(c)]
    c.close()
    return spark.createDataFrame(rows, frames.FramesSource({}).schema())


def _accepted(spark: SparkSession, e: U.Endpoint, n: int, order: bool, tls: tuple) -> DataFrame:
    """Batches of n accepted peers; they are taken on the driver, where the listener is."""
    streams = [wires.read_wire(wires.open_wire(e.scheme, e.address, accept=True, timeout=60, tls=tls)) for _ in range(n)]
    got = [(b, s) for b, s, _ in wires.rotate(streams, ordered=order)]
    if order:
        got.sort(key=lambda x: -1 if x[1] is None else x[1])
    if not got:
        raise FlowError("empty source: it has no schema to export")
    return spark.createDataFrame(pa.Table.from_batches([readable_batch(b) for b, _ in got]))


def _shared_copy(spark: SparkSession, source) -> str:
    """The path of a file below the folder that executors share, with the bytes of ``source``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_top(spark)}/stdin-{uuid.uuid4().hex}.csv")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        while piece := source.read(1 << 20):
            out.write(piece)
    finally:
        out.close()
    return path.toString()


def _stdin(spark: SparkSession, fmt: str | None, delimiter: str | None, header: bool | None) -> DataFrame:
    if fmt == "csv":
        path = _shared_copy(spark, sys.stdin.buffer)
        return C.read_csv(spark, path, None, delimiter or ",", header=True if header is None else header)
    t = pa.ipc.open_stream(sys.stdin.buffer).read_all()
    return spark.createDataFrame(pa.Table.from_batches([readable_batch(b) for b in t.to_batches()]))


class Writer:
    """A target.  Several writes make one table; nothing written, no file."""

    def __init__(self, e: U.Endpoint, fmt: str | None, protocol: str, compression: str | None, delimiter: str | None, header: bool | None, parallel: int, accept: bool = False, tls: tuple = (None, None, None)):
        self._accept, self._tls = accept, tls
        self.endpoint, self.format, self.protocol, self.compression = e, fmt, protocol, compression
        self.delimiter, self.header, self.parallel = delimiter or ",", True if header is None else header, parallel
        self.registry = frames.Registry() if protocol == "frames" else None
        self._closed, self._tables, self._items, self._sent = False, [], [], 0
        self._wires: list[wires.WireWriter] = []
        self._connection = None

    def _check(self) -> None:
        if self._closed:
            raise FlowError("the writer is closed")

    def register_table(self, name: str) -> int:
        return self._names().register_table(name)

    def register_message(self, name: str) -> int:
        return self._names().register_message(name)

    def _names(self) -> frames.Registry:
        self._check()
        if self.registry is None:
            raise ProtocolError("names are registered on frames protocol targets only")
        return self.registry

    def write_message(self, name: str, payload: bytes) -> None:
        self._names().tag(name, "message")
        if self.endpoint.wire:
            self._peer().send_message(name, bytes(payload))
        else:
            self._items.append((name, bytes(payload)))

    def _wire(self):
        return wires.open_wire(self.endpoint.scheme, self.endpoint.address, self._accept, 60 if self._accept else None, True, self._tls)

    def _peer(self):
        if self._connection is None:
            from .streaming.connection import Connection

            self._connection = Connection(self._wire(), self.registry)
        return self._connection

    def write(self, data, name: str | None = None) -> None:
        self._check()
        if (self.registry is not None) != (name is not None):
            raise ValueError("frames protocol writes need name=..." if self.registry is not None else "name= applies to frames protocol targets only")
        if isinstance(data, DataFrame):
            if self.registry is None and not self.endpoint.wire and self.endpoint.scheme == "file":
                self._tables.append(data)
                return
            batches = list(wires.local_batches(data))
        else:
            try:
                t = data if isinstance(data, (pa.Table, pa.RecordBatch)) else pa.table(data)
            except (TypeError, ValueError, pa.ArrowInvalid) as x:
                raise FormatError("data must be a DataFrame or Arrow-compatible") from x
            batches = t.to_batches() if isinstance(t, pa.Table) else [t]
        if batches and not len(batches[0].schema):
            raise FormatError("a table with no columns cannot be written")
        if self.registry is not None and self.endpoint.wire:
            for b in batches:
                self._peer().send_table(name, b)
        elif self.registry is not None:
            self.registry.tag(name, "table")
            self._items += [(name, b) for b in batches]
        elif self.endpoint.wire:
            if not self._wires:
                self._wires = [wires.WireWriter(self._wire(), self.compression) for _ in range(max(1, self.parallel))]
            for b in batches:
                self._wires[self._sent % len(self._wires)].write(b, self._sent)
                self._sent += 1
        else:
            self._items += [(None, b) for b in batches]
            if self.endpoint.scheme == "stdio":
                self.flush()

    def flush(self) -> None:
        self._check()
        if self.endpoint.scheme == "stdio" and self._items:
            _print_batches([b for _, b in self._items], self.format, self.delimiter, self.header and not self._sent)
            self._sent += len(self._items)
            self._items = []

    def close(self) -> None:
        if self._closed:
            return
        try:
            for w in self._wires:
                w.close()
            if self._connection is not None:
                self._connection.close()
            if self.endpoint.scheme == "file" and self.registry is not None and self._items:
                frames.write_capture(self.endpoint.address, self.registry, self._items)
            elif self.endpoint.scheme == "file":
                self._finish()
        finally:
            self._closed = True

    def _finish(self) -> None:
        parts = list(self._tables)
        if self._items:
            spark = SparkSession.active()
            first = self._items[0][1].schema
            if any(len(b.schema) != len(first) for _, b in self._items):
                raise FormatError("a batch has another column count than the first")
            parts.append(spark.createDataFrame(pa.Table.from_batches([readable_batch(b) for _, b in self._items])))
        if not parts:
            return
        from .operators.batches import concat_batches

        write_file(concat_batches(parts), self.endpoint.address, self.format, self.compression, self.delimiter, self.header)

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def write_file(df: DataFrame, path: str, fmt: str, compression: str | None = None, delimiter: str = ",", header: bool = True) -> None:
    """One file at ``path``; large tables are better written as a folder or as chunks."""
    import glob
    import shutil

    stage, ext = f"{local(path)}.staged", {"ipc": "*.arrow", "parquet": "*.parquet"}.get(fmt, "*.txt")
    one = df.coalesce(1)
    if fmt == "ipc":
        arrow_ipc.write_ipc(one, stage, compression=compression)
    elif fmt == "parquet":
        one.write.mode("overwrite").option("compression", compression or "none").parquet(stage)
    elif fmt == "csv":
        C.write_csv(one, stage, delimiter, header=header)
    else:
        (J.write_ndjson if U.json_lines(path) else J.write_json_array)(one, stage)
    found = sorted(glob.glob(f"{stage}/{ext}"))
    if found:
        os.replace(found[0], local(path))
    shutil.rmtree(stage)


def _print_batches(batches: list[pa.RecordBatch], fmt: str | None, delimiter: str, header: bool) -> None:
    if fmt in (None, "ipc"):
        with pa.ipc.new_stream(sys.stdout.buffer, batches[0].schema) as w:
            for b in batches:
                w.write_batch(b)
        sys.stdout.buffer.flush()
        return
    df = SparkSession.active().createDataFrame(pa.Table.from_batches([readable_batch(b) for b in batches]))
    lines = C.encode_rows(df, delimiter) if fmt == "csv" else J.encode_objects(df)
    if fmt == "csv" and header:
        print(C.header_line(df, delimiter))
    for r in lines.toLocalIterator():
        print(r["line"])


def write(
    uri: str, *, format: str | None = None, protocol: str | None = None, parallel: int = 0, accept: bool = False, tls_cert: str | None = None, tls_key: str | None = None, tls_ca: str | None = None,
    compression: str | None = None, delimiter: str | None = None, header: bool | None = None,
) -> Writer:
    """A Writer to the endpoint; arguments that do not apply to it are errors."""
    e, p = U.resolve_endpoint(uri), U.resolve_protocol(protocol)
    U.check_tls(e, accept, tls_cert, tls_key, tls_ca)
    U.check_place(e, accept=accept, parallel=parallel, protocol=p, format_arguments=any(x is not None for x in (format, delimiter, header)), target=True)
    if compression not in (None, "zstd", "snappy", "none"):
        raise ValueError(f"compression is one of {', '.join(U.COMPRESSIONS)}, not '{compression}'")
    if e.wire or p == "frames":
        return Writer(e, None, p, compression, delimiter, header, parallel, accept, (tls_cert, tls_key, tls_ca))
    if e.scheme == "stdio":
        fmt = U.FORMAT_NAMES.get(format or "ipc")
        if fmt not in ("ipc", "csv", "json"):
            raise FormatError("text on stdio is written in the csv and json formats only")
        return Writer(e, fmt, p, compression, delimiter, header, parallel)
    if os.path.isdir(local(e.address)):
        raise FormatError("chunked directories are written with write_chunks")
    fmt = U.resolve_format(e.address, format)
    U.check_format_arguments(fmt, delimiter, header, None, compression)
    if fmt == "ipc" and compression == "snappy":
        raise FormatError("snappy is not supported for Arrow IPC, use zstd")
    return Writer(e, fmt, p, compression, delimiter, header, parallel)
