"""Wires (TCP, Unix sockets, HTTP, WebSocket) that carry Arrow streams, for batch and for Structured Streaming.

A peer connects or accepts; accepting peers share one listener per address in the process, and clients
that come early wait in its queue.  The streaming source spools every batch that it takes off a wire
into files numbered by sequence, so that a micro-batch can be read again after a failure.
"""

from __future__ import annotations

import os
import socket
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import TransportError
from ..limits import DecodeLimits
from ..sources.arrow_ipc import local
from ..types import readable_batch, spark_schema

SEQ_KEY = b"seq"
_listeners: dict[tuple[str, str], socket.socket] = {}
_lock = threading.Lock()


def _address(scheme: str, address: str):
    if scheme == "uds":
        return socket.AF_UNIX, address
    host, _, port = address.rpartition(":")
    if not port.isdigit():
        raise TransportError(f"'{address}' is not host:port")
    return socket.AF_INET, (host.strip("[]") or "127.0.0.1", int(port))


def listener(scheme: str, address: str) -> socket.socket:
    """The process's listener on an address; the first call opens it."""
    with _lock:
        key = (scheme, address)
        if key not in _listeners:
            family, where = _address(scheme, address)
            s = socket.socket(family, socket.SOCK_STREAM)
            if family == socket.AF_INET:
                s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            elif os.path.exists(where):
                os.remove(where)
            s.bind(where)
            s.listen(256)
            _listeners[key] = s
        return _listeners[key]


def close_listener(scheme: str, address: str) -> None:
    with _lock:
        s = _listeners.pop((scheme, address), None)
    if s is not None:
        s.close()


def open_wire(scheme: str, address: str, accept: bool = False, timeout: float | None = None, sending: bool = False, tls: tuple[str | None, str | None, str | None] = (None, None, None)):
    """A connected socket, or what looks like one.  ``sending`` says which way an HTTP body goes; ``tls`` is certificate, key and CA."""
    place, _, path = (address, "", "") if scheme == "uds" else address.partition("/")
    try:
        if accept:
            s = listener(scheme, place)
            s.settimeout(timeout)
            c, _ = s.accept()
        else:
            family, where = _address(scheme, place)
            c = socket.socket(family, socket.SOCK_STREAM)
            c.settimeout(timeout)
            c.connect(where)
        c.settimeout(None)
    except OSError as x:
        raise TransportError(f"{scheme}://{address}: {x}") from x
    if scheme in ("tcp", "uds"):
        return c
    from .web import HttpWire, WebSocketWire, tls_wrap

    if scheme in ("https", "wss"):
        c = tls_wrap(c, place.rpartition(":")[0].strip("[]"), accept, *tls)
    if scheme in ("http", "https"):
        return HttpWire(c, place, f"/{path}", accept, sending)
    return WebSocketWire(c, place, f"/{path}", accept)


class WireWriter:
    """Batches onto one wire as an Arrow stream; each may carry a sequence number in its metadata."""

    def __init__(self, wire: socket.socket, compression: str | None = None):
        from ..sources.arrow_ipc import ipc_options

        self.wire, self.file, self.writer = wire, wire.makefile("wb"), None
        self.options = ipc_options(compression)

    def write(self, batch: pa.RecordBatch, seq: int | None = None, meta: dict[str, str] | None = None) -> None:
        if self.writer is None:
            self.writer = pa.ipc.new_stream(pa.PythonFile(self.file, mode="w"), batch.schema, options=self.options)
        tags = {k.encode(): v.encode() for k, v in (meta or {}).items()} | ({SEQ_KEY: str(seq).encode()} if seq is not None else {})
        self.writer.write_batch(batch, custom_metadata=tags or None)
        self.file.flush()

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
        self.file.close()
        self.wire.close()


def read_wire(wire: socket.socket, limits: DecodeLimits | None = None) -> Iterator[tuple[pa.RecordBatch, int | None, dict[str, str]]]:
    """(batch, sequence number or None, other metadata) until the stream ends."""
    limits = limits or DecodeLimits()
    with wire, wire.makefile("rb") as f:
        try:
            reader = pa.ipc.open_stream(pa.PythonFile(f, mode="r"))
        except pa.ArrowInvalid:
            return  # closed before a schema came
        while True:
            try:
                batch, tags = reader.read_next_batch_with_custom_metadata()
            except StopIteration:
                return
            limits.check("rows", batch.num_rows)
            tags = {k.decode(): v.decode() for k, v in (tags or {}).items()}
            seq = tags.pop(SEQ_KEY.decode(), None)
            yield batch, None if seq is None else int(seq), tags


def rotate(streams: list[Iterator], ordered: bool = False) -> Iterator:
    """Batches of several streams in turn.  Ordered: ends when the stream in turn ends; else until all end."""
    alive = list(streams)
    while alive:
        for s in list(alive):
            try:
                yield next(s)
            except StopIteration:
                if ordered:
                    return
                alive.remove(s)


class _Stream(InputPartition):
    def __init__(self, index: int):
        super().__init__(index)
        self.index = index


class _WireReader(DataSourceReader):
    """One partition for each parallel connection."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Stream(i) for i in range(max(1, int(self.options.get("parallel", 1))))]

    def read(self, partition: _Stream) -> Iterator[pa.RecordBatch]:
        o = self.options
        wire = open_wire(o["scheme"], o["address"], timeout=float(o.get("timeout", 30)), tls=(None, None, o.get("tls_ca")))
        for k, (batch, seq, _) in enumerate(read_wire(wire, DecodeLimits.from_options(o))):
            batch = readable_batch(batch)
            n = batch.num_rows
            yield batch.append_column("stream_id", pa.array([partition.index] * n, pa.int64())).append_column("seq_id", pa.array([k if seq is None else seq] * n, pa.int64())).append_column("row_id", pa.array(range(n), pa.int64()))


class _SpoolReader(DataSourceStreamReader):
    """Takes batches off the wire into ``spool``; a micro-batch is a range of its files."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.spool = local(options["spool"])
        os.makedirs(self.spool, exist_ok=True)
        self.per_trigger = int(options.get("batches_per_trigger", 8))
        self._next = 1 + max((int(f.split(".")[0]) for f in os.listdir(self.spool) if f.endswith(".arrow")), default=-1)
        # how many batches were offered before a restart: offsets never go back
        self._mark = f"{self.spool}/.given"
        self._given = int(open(self._mark).read()) if os.path.exists(self._mark) else 0
        self._thread: threading.Thread | None = None
        self._broken: BaseException | None = None

    def _run(self) -> None:
        try:
            self._pump()
        except BaseException as x:  # told to the query by latestOffset
            self._broken = x

    def _pump(self) -> None:
        o = self.options
        wire = open_wire(o["scheme"], o["address"], accept=o.get("role") == "accept", timeout=float(o.get("timeout", 30)))
        for batch, seq, _ in read_wire(wire):
            batch = readable_batch(batch)
            n = batch.num_rows
            number = self._next
            batch = batch.append_column("seq_id", pa.array([number if seq is None else seq] * n, pa.int64())).append_column("row_id", pa.array(range(n), pa.int64()))
            temporary = f"{self.spool}/.{number}.tmp"
            with pa.ipc.new_file(temporary, batch.schema) as w:
                w.write_batch(batch)
            os.replace(temporary, f"{self.spool}/{number:010d}.arrow")
            self._next = number + 1

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        if self._thread is None:
            self._thread = threading.Thread(target=self._run, daemon=True)
            self._thread.start()
        if self._broken is not None and self._given >= self._next:
            raise TransportError(f"the wire broke after {self._next} batches: {self._broken}") from self._broken
        self._give(min(self._next, self._given + self.per_trigger))
        return {"batch": self._given}

    def _give(self, upto: int) -> None:
        if upto > self._given:
            self._given = upto
            with open(f"{self._mark}.tmp", "w") as f:
                f.write(str(upto))
            os.replace(f"{self._mark}.tmp", self._mark)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._give(end["batch"])
        return [_Stream(i) for i in range(start["batch"], end["batch"])]

    def read(self, partition: _Stream) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(f"{self.spool}/{partition.index:010d}.arrow") as f:
            yield from (b for b in map(pa.ipc.open_file(f).get_batch, range(1)))

    def commit(self, end: dict) -> None:
        """Files stay until the caller removes the spool: another query may start from it."""


@dataclass
class _Sent(WriterCommitMessage):
    batches: int


class _WireTaskWriter(DataSourceArrowWriter):
    """Each task opens a wire of its own and sends its batches, numbered within the task, so nothing goes through
    the driver.  A task that is run again sends again, over another wire: a peer takes a wire without a
    stream's end as void.
    """

    def __init__(self, options: dict):
        self.options = dict(options)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        o, n, w = self.options, 0, None
        part = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            if w is None:
                w = WireWriter(open_wire(o["scheme"], o["address"], timeout=float(o.get("timeout", 30)), sending=True, tls=(None, None, o.get("tls_ca"))), o.get("compression"))
            w.write(b, n, {"stream": str(part)})
            n += 1
        if w is not None:
            w.close()
        return _Sent(n)


class _WireStreamWriter(_WireTaskWriter, DataSourceStreamArrowWriter):
    """The same for each micro-batch of a stream; a replayed one has the same numbers."""

    def commit(self, messages: list, batchId: int) -> None:
        pass

    def abort(self, messages: list, batchId: int) -> None:
        pass


class WireSource(DataSource):
    """``arrow_wire``: options scheme (tcp, uds), address, parallel; for streams also role, spool, batches_per_trigger.

    Written to, every task connects to the address and sends its rows.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_wire"

    def schema(self) -> StructType:
        raise TransportError("a wire has no schema before its first batch, pass one")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WireReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _SpoolReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _WireTaskWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _WireStreamWriter(self.options)


def with_ids(schema: StructType | pa.Schema, stream: bool) -> StructType:
    s = spark_schema(schema) if isinstance(schema, pa.Schema) else schema
    extra = ["seq_id", "row_id"] if stream else ["stream_id", "seq_id", "row_id"]
    return StructType([*s.fields, *(StructField(n, LongType()) for n in extra)])


def read_wires(spark: SparkSession, scheme: str, address: str, schema: StructType, parallel: int = 1, tls_ca: str | None = None) -> DataFrame:
    """All batches of one or more connections, with stream_id, seq_id and row_id."""
    spark.dataSource.register(WireSource)
    return spark.read.format("arrow_wire").schema(with_ids(schema, False)).option("scheme", scheme).option("address", address).option("parallel", parallel).options(**({"tls_ca": tls_ca} if tls_ca else {})).load()


def stream_wire(spark: SparkSession, scheme: str, address: str, schema: StructType, spool: str, role: str = "connect", batches_per_trigger: int = 8) -> DataFrame:
    """An unbounded DataFrame over one wire, with seq_id and row_id."""
    spark.dataSource.register(WireSource)
    r = spark.readStream.format("arrow_wire").schema(with_ids(schema, True)).option("scheme", scheme).option("address", address)
    return r.option("spool", spool).option("role", role).option("batches_per_trigger", batches_per_trigger).load()


def send(df: DataFrame, scheme: str, address: str, parallel: int = 1, ordered: bool = True, compression: str | None = None, batch: str | None = None, tls_ca: str | None = None) -> int:
    """Sends a DataFrame's batches over ``parallel`` wires in rotation, with sequence numbers if ``ordered``.

    Batches come to the driver one at a time.  ``batch`` names the column whose values are batches; the
    rows of one are sent together.
    """
    writers = [WireWriter(open_wire(scheme, address, sending=True, tls=(None, None, tls_ca)), compression) for _ in range(parallel)]
    n = 0
    try:
        for b in local_batches(df, batch):
            writers[n % parallel].write(b, n if ordered else None)
            n += 1
    finally:
        for w in writers:
            w.close()
    return n


def local_batches(df: DataFrame, batch: str | None = None, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The rows on the driver as Arrow batches, fetched a partition at a time.

    Tasks pack their rows into Arrow streams, so no row becomes a Python object.  ``batch`` names the
    column whose values are batches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["b"])

    ordered = df.orderBy(batch) if batch else df
    held = schema.empty_table()

    def cut(t: pa.Table, end: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.slice(0, end).itercolumns()], schema=schema)

    for r in ordered.mapInArrow(packed, "b binary").toLocalIterator(prefetchPartitions=True):
        held = pa.concat_tables([held, pa.ipc.open_stream(bytes(r["b"])).read_all().cast(schema)])
        while held.num_rows:
            if batch:
                key = held.column(batch)
                end = held.num_rows if key[0].as_py() == key[-1].as_py() else _end_of_first(key)
                if end == held.num_rows:
                    break  # the batch may go on
            else:
                end = rows
                if held.num_rows < rows:
                    break
            yield cut(held, end)
            held = held.slice(end)
    while held.num_rows:
        end = held.num_rows if batch else min(rows, held.num_rows)
        yield cut(held, end)
        held = held.slice(end)


def _end_of_first(sorted_keys: pa.ChunkedArray) -> int:
    """How many of the sorted keys equal the first."""
    first, lo, hi = sorted_keys[0].as_py(), 0, len(sorted_keys)
    while lo < hi:
        mid = (lo + hi) // 2
        if sorted_keys[mid].as_py() == first:
            lo = mid + 1
        else:
            hi = mid
    return lo


def foreach_batch_sender(scheme: str, address: str):
    """A function for ``writeStream.foreachBatch`` that sends each micro-batch over one wire that stays open."""
    state: dict[str, WireWriter] = {}

    def write(df: DataFrame, epoch: int) -> None:
        if "w" not in state:
            state["w"] = WireWriter(open_wire(scheme, address, sending=True))
        for b in local_batches(df):
            state["w"].write(b, epoch)

    return write
