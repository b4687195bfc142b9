"""Tagged frames: tables and opaque messages on one stream.

A frame is ``[tag: 1 byte][length: 4 bytes, little-endian][payload]``.  Both peers register names in
the same order; tags follow it.  A table's first payload of a stream carries its schema, later ones
only batches, so a stream is decoded in sequence by one task; files are decoded in parallel.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import ProtocolError
from ..limits import DecodeLimits
from .arrow_ipc import from_payloads, local, serialise

HEADER = struct.Struct("<BI")
MOST_TYPES = 256
CHUNK = 1 << 20


@dataclass
class Registry:
    """Names in the order of their tags; kind is ``table`` or ``message``."""

    entries: list[tuple[str, str]] = field(default_factory=list)

    def _add(self, name: str, kind: str) -> int:
        if any(n == name for n, _ in self.entries):
            raise ProtocolError(f"'{name}' is already registered")
        if len(self.entries) >= MOST_TYPES:
            raise ProtocolError(f"at most {MOST_TYPES} names can be registered")
        self.entries.append((name, kind))
        return len(self.entries) - 1

    def register_table(self, name: str) -> int:
        return self._add(name, "table")

    def register_message(self, name: str) -> int:
        return self._add(name, "message")

    def tag(self, name: str, kind: str | None = None) -> int:
        for i, (n, k) in enumerate(self.entries):
            if n == name:
                if kind and k != kind:
                    raise ProtocolError(f"'{name}' is registered as a {k}, not a {kind}")
                return i
        raise ProtocolError(f"'{name}' is not registered")

    def at(self, tag: int) -> tuple[str, str]:
        if not 0 <= tag < len(self.entries):
            raise ProtocolError(f"unknown tag {tag}")
        return self.entries[tag]

    def option(self) -> str:
        return "\n".join(f"{k}:{n}" for n, k in self.entries)

    @classmethod
    def from_option(cls, text: str) -> Registry:
        return cls([(line.partition(":")[2], line.partition(":")[0]) for line in text.split("\n") if line])


def encode_frame(tag: int, payload: bytes) -> bytes:
    if not 0 <= tag < MOST_TYPES or len(payload) >= 1 << 32:
        raise ProtocolError("tag or payload is too large for a frame")
    return HEADER.pack(tag, len(payload)) + payload


def decode_frames(chunks: Iterable[bytes], limits: DecodeLimits | None = None) -> Iterator[tuple[int, bytes]]:
    """(tag, payload) of a stream in pieces of any size; a frame that the end cuts off is an error."""
    limits = limits or DecodeLimits()
    held = bytearray()
    for c in chunks:
        held += c
        at = 0
        while len(held) - at >= HEADER.size:
            tag, size = HEADER.unpack_from(held, at)
            limits.check("frame_bytes", size)
            if len(held) - at - HEADER.size < size:
                break
            yield tag, bytes(held[at + HEADER.size : at + HEADER.size + size])
            at += HEADER.size + size
        del held[:at]
    if held:
        raise ProtocolError("the stream ends inside a frame" + (" header" if len(held) < HEADER.size else ""))


def frame_column(tag: Column, payload: Column) -> Column:
    """The frame as a binary expression."""
    n = F.octet_length(payload)
    byte = lambda k: F.unhex(F.lpad(F.hex(F.shiftrightunsigned(n, 8 * k).bitwiseAND(255)), 2, "0"))
    return F.concat(F.unhex(F.lpad(F.hex(tag.cast("int").bitwiseAND(255)), 2, "0")), byte(0), byte(1), byte(2), byte(3), payload)


def parse_column(frame: Column) -> Column:
    """struct<tag, size, payload> of a binary column that is one frame; another length is an error."""
    num = lambda k: F.conv(F.hex(F.substring(frame, k, 1)), 16, 10).cast("bigint")
    size = num(2) + num(3) * 256 + num(4) * 65536 + num(5) * 16777216
    good = F.octet_length(frame) == size + HEADER.size
    payload = F.when(good, F.substring(frame, F.lit(HEADER.size + 1), size.cast("int"))).otherwise(F.raise_error(F.lit("the frame's length is not what its header says")).cast("binary"))
    return F.struct(num(1).cast("int").alias("tag"), size.alias("size"), payload.alias("payload"))


class StreamEncoder:
    """Frames of one stream: the first payload of each table holds schema and dictionaries, later ones batches only."""

    def __init__(self, registry: Registry):
        self.registry = registry
        self._open: dict[str, tuple[_Tape, pa.ipc.RecordBatchStreamWriter]] = {}
        self._schemas: dict[str, pa.Schema] = {}

    def message(self, name: str, payload: bytes) -> bytes:
        return encode_frame(self.registry.tag(name, "message"), payload)

    def table(self, name: str, batch: pa.RecordBatch) -> bytes:
        tag = self.registry.tag(name, "table")
        if len(batch.schema) == 0:
            raise ProtocolError("a table has no columns")
        if name not in self._open:
            tape = _Tape()
            self._open[name] = (tape, pa.ipc.new_stream(pa.PythonFile(tape, mode="w"), batch.schema))
        tape, writer = self._open[name]
        if self._schemas.setdefault(name, batch.schema) != batch.schema:
            raise ProtocolError(f"column count or types of '{name}' changed")
        writer.write_batch(batch)
        return encode_frame(tag, tape.take())


class _Tape:
    """A file object that keeps what is written until it is taken."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.closed = False

    def write(self, data) -> int:
        self.parts.append(bytes(data))
        return len(data)

    def take(self) -> bytes:
        out = b"".join(self.parts)
        self.parts = []
        return out

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True

    def writable(self) -> bool:
        return True

    def readable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False


class StreamDecoder:
    """Frames of one stream -> (seq, tag, name, kind, payload); a table's payload becomes a stream of its own."""

    def __init__(self, registry: Registry, limits: DecodeLimits | None = None):
        self.registry, self.limits = registry, limits or DecodeLimits()
        self._schema: dict[int, bytes] = {}

    def decode(self, frames: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, int, str, str, bytes]]:
        for seq, (tag, payload) in enumerate(frames):
            name, kind = self.registry.at(tag)
            if kind == "table":
                payload = self._whole(tag, payload)
            yield seq, tag, name, kind, payload

    def _whole(self, tag: int, payload: bytes) -> bytes:
        reader = pa.ipc.MessageReader.open_stream(pa.BufferReader(payload))
        parts = []
        while True:
            try:
                m = reader.read_next_message()
            except StopIteration:
                break
            if m.type == "schema":
                self._schema[tag] = m.serialize().to_pybytes()
            elif m.type == "dictionary":
                # dictionaries stand for the rest of the stream
                self._schema[tag] = self._schema.get(tag, b"") + m.serialize().to_pybytes()
            else:
                parts.append(m.serialize().to_pybytes())
        if tag not in self._schema:
            raise ProtocolError("a table's first payload has no schema")
        table = pa.ipc.open_stream(pa.BufferReader(self._schema[tag] + b"".join(parts))).read_all()
        self.limits.check("rows", table.num_rows)
        return serialise(table.to_batches(), table.schema)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _FramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        path = local(self.options["path"])
        if os.path.isdir(path):
            return [_File(os.path.join(path, f)) for f in sorted(os.listdir(path)) if not f.startswith(("_", "."))] or [_File("")]
        return [_File(path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        registry, limits = Registry.from_option(self.options["registry"]), DecodeLimits.from_options(self.options)
        with open(partition.path, "rb") as f:
            chunks = iter(lambda: f.read(CHUNK), b"")
            for row in StreamDecoder(registry, limits).decode(decode_frames(chunks, limits)):
                yield (os.path.basename(partition.path), *row)


class FramesSource(DataSource):
    """``spark.read.format("tagged_frames")``: one partition per capture file."""

    @classmethod
    def name(cls) -> str:
        return "tagged_frames"

    def schema(self) -> str:
        return "file string, seq bigint, tag int, name string, kind string, payload binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FramesReader(self.options)


def read_capture(spark: SparkSession, path: str, registry: Registry, **limits: int) -> DataFrame:
    """Rows file, seq, tag, name, kind, payload of capture files."""
    spark.dataSource.register(FramesSource)
    reader = spark.read.format("tagged_frames").option("path", path).option("registry", registry.option())
    return reader.options(**{f"limit_{k}": str(v) for k, v in limits.items()}).load()


def tables_of(frames: DataFrame, name: str, schema: StructType | str) -> DataFrame:
    """The rows of one registered table."""
    return from_payloads(frames.filter((F.col("kind") == "table") & (F.col("name") == name)), schema)


def messages_of(frames: DataFrame, name: str | None = None) -> DataFrame:
    """The message frames (of one name); tables are left out."""
    out = frames.filter("kind = 'message'")
    return out if name is None else out.filter(F.col("name") == name)


def write_capture(path: str, registry: Registry, items: Iterable[tuple[str, object]]) -> int:
    """Writes (name, RecordBatch or Table or bytes) to one capture file; returns the number of frames."""
    encoder, n = StreamEncoder(registry), 0
    with open(local(path), "wb") as f:
        for name, x in items:
            if isinstance(x, (bytes, bytearray)):
                f.write(encoder.message(name, bytes(x)))
                n += 1
            else:
                for b in x.to_batches() if isinstance(x, pa.Table) else [x]:
                    f.write(encoder.table(name, b))
                    n += 1
    return n


def write_captures(df: DataFrame, path: str, registry: Registry, name: str) -> None:
    """A folder of capture files of one table, one per task; batches are those of the Arrow transfer."""
    os.makedirs(local(path), exist_ok=True)
    target = local(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx, encoder, n = TaskContext.get(), StreamEncoder(registry), 0
        temporary = f"{target}/_attempt-{ctx.taskAttemptId()}"
        with open(temporary, "wb") as f:
            for b in batches:
                if b.num_rows:
                    f.write(encoder.table(name, b))
                    n += 1
        os.replace(temporary, f"{target}/part-{ctx.partitionId():05d}.frames")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["frames"])

    df.mapInArrow(run, "frames bigint").agg(F.sum("frames")).collect()


# -- small message bodies


def msgpack_decode(data: bytes) -> object:
    """A value of MessagePack (nil, booleans, numbers, strings, binary, arrays, maps)."""
    value, at = _unpack(memoryview(data), 0)
    if at != len(data):
        raise ProtocolError("trailing bytes after the value")
    return value


def _unpack(d: memoryview, i: int) -> tuple[object, int]:
    try:
        b = d[i]
    except IndexError:
        raise ProtocolError("the value is cut off") from None
    i += 1

    def number(fmt: str, at: int) -> tuple[object, int]:
        size = struct.calcsize(fmt)
        if at + size > len(d):
            raise ProtocolError("the value is cut off")
        return struct.unpack(fmt, d[at : at + size])[0], at + size

    def raw(n: int, at: int) -> tuple[bytes, int]:
        if at + n > len(d):
            raise ProtocolError("the value is cut off")
        return bytes(d[at : at + n]), at + n

    def many(n: int, at: int) -> tuple[list, int]:
        out = []
        for _ in range(n):
            v, at = _unpack(d, at)
            out.append(v)
        return out, at

    def pairs(n: int, at: int) -> tuple[dict, int]:
        flat, at = many(2 * n, at)
        return dict(zip(flat[::2], flat[1::2], strict=True)), at

    if b < 0x80:
        return b, i
    if b >= 0xE0:
        return b - 256, i
    if b < 0x90:
        return pairs(b & 15, i)
    if b < 0xA0:
        return many(b & 15, i)
    if b < 0xC0:
        v, i = raw(b & 31, i)
        return v.decode(), i
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], i
    if 0xCA <= b <= 0xD3:
        return number((">f", ">d", ">B", ">H", ">I", ">Q", ">b", ">h", ">i", ">q")[b - 0xCA], i)
    sized = {0xC4: (">B", raw), 0xC5: (">H", raw), 0xC6: (">I", raw), 0xD9: (">B", raw), 0xDA: (">H", raw), 0xDB: (">I", raw), 0xDC: (">H", many), 0xDD: (">I", many), 0xDE: (">H", pairs), 0xDF: (">I", pairs)}
    if b not in sized:
        raise ProtocolError(f"unsupported type byte {b:#x}")
    fmt, how = sized[b]
    n, i = number(fmt, i)
    v, i = how(n, i)
    return (v.decode() if b in (0xD9, 0xDA, 0xDB) else v), i


def protobuf_fields(data: bytes) -> dict[int, list]:
    """Raw fields of a protobuf message by number: integers for varints and fixed sizes, bytes for the rest."""
    out: dict[int, list] = {}
    i = 0

    def varint(at: int) -> tuple[int, int]:
        v = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ProtocolError("a varint is cut off or too long")
            b = data[at]
            at += 1
            v |= (b & 127) << shift
            if b < 128:
                return v, at
            shift += 7

    while i < len(data):
        key, i = varint(i)
        wire = key & 7
        if wire == 0:
            v, i = varint(i)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if i + size > len(data):
                raise ProtocolError("a field is cut off")
            v, i = int.from_bytes(data[i : i + size], "little"), i + size
        elif wire == 2:
            n, i = varint(i)
            if i + n > len(data):
                raise ProtocolError("a field is cut off")
            v, i = data[i : i + n], i + n
        else:
            raise ProtocolError(f"unsupported wire type {wire}")
        out.setdefault(key >> 3, []).append(v)
    return out
