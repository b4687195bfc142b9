import socket
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import weirflow.api as api
from weirflow.errors import ProtocolError
from weirflow.functions.bits import aligned, pack_bits, unpack_bits
from weirflow.sources.frames import Registry
from weirflow.sources.raw import read_bytes
from weirflow.streaming.connection import Connection, ParallelSender, receive_ordered


def registry():
    r = Registry()
    r.register_table("quotes")
    r.register_message("health")
    return r


def test_two_way():
    a, b = socket.socketpair()
    left, right = Connection(a, registry()), Connection(b, registry())
    left.send_message("health", b"ping")
    assert right.receive().payload == b"ping"
    right.send_table("quotes", pa.table({"px": [1.5, 2.5]}))
    right.finish()
    m = left.receive()
    assert m.is_table() and m.table["px"].to_pylist() == [1.5, 2.5] and left.receive() is None
    with pytest.raises(ProtocolError):
        left.send_message("quotes", b"x")


def test_parallel_frames_keep_their_order():
    pairs = [socket.socketpair() for _ in range(3)]
    sender = ParallelSender([Connection(a, registry()) for a, _ in pairs])
    for k in range(10):
        (sender.send_message("health", bytes([k])) if k % 2 else sender.send_table("quotes", pa.table({"k": [k]})))
    sender.close()
    got = list(receive_ordered([b for _, b in reversed(pairs)], registry()))
    assert [m.table["k"][0].as_py() if m.is_table() else m.payload[0] for m in got] == list(range(10))


def test_frames_over_a_wire(spark):
    s = socket.create_server(("127.0.0.1", 0))
    where = f"127.0.0.1:{s.getsockname()[1]}"
    s.close()
    from weirflow.streaming import wires

    wires.listener("tcp", where)

    def send():
        with api.write(f"tcp://{where}", protocol="frames") as w:
            w.register_table("quotes")
            w.register_message("health")
            w.write_message("health", b"1")
            w.write(pa.table({"px": [1.5]}), "quotes")

    t = threading.Thread(target=send, daemon=True)
    t.start()
    r = api.read(spark, f"tcp://{where}", protocol="frames", accept=True)
    r.register_table("quotes")
    r.register_message("health")
    assert [(m.kind, m.name) for m in r] == [("message", "health"), ("table", "quotes")]
    t.join(10)
    wires.close_listener("tcp", where)


def test_bits(spark):
    rows = [([True, False, True],), ([False] * 8 + [True],), ([],), (None,), ([None, True],)]
    df = spark.createDataFrame(rows, "f array<boolean>").select("f", pack_bits(F.col("f")).alias("b"))
    got = [None if r.b is None else bytes(r.b) for r in df.collect()]
    assert got == [b"\x05", b"\x00\x01", b"", None, b"\x02"]
    back = df.filter("f is not null").select(unpack_bits(F.col("b"), F.size("f")).alias("f")).collect()
    assert [r.f for r in back] == [[True, False, True], [False] * 8 + [True], [], [False, True]]
    assert [r[0] for r in spark.range(3).select(aligned(F.col("id") * 63)).collect()] == [0, 64, 128]


def test_raw_bytes(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(bytes(range(250)))
    got = read_bytes(spark, str(tmp_path / "x.bin"), chunk=100).orderBy("offset").collect()
    assert [len(r.bytes) for r in got] == [100, 100, 50] and b"".join(bytes(r.bytes) for r in got) == bytes(range(250))


def test_wire_carries_the_whole_table(spark, tmp_path, monkeypatch):
    from weirflow.plans import registry as plans
    from weirflow.streaming import wires

    sf = f"file://{tmp_path}"
    spark.range(2350).selectExpr("id event_id", "id / 4 value").write.parquet(f"{sf}/events.parquet")
    sent, write = [], wires.WireWriter.write
    monkeypatch.setattr(wires.WireWriter, "write", lambda self, b, seq=None, meta=None: (sent.append(b.num_rows), write(self, b, seq, meta)) and None)
    assert plans.QUERIES["wire_tcp_roundtrip"](spark, sf).count() == 2350
    events = plans.table(spark, sf, "events").select("event_id", "value")
    assert sum(sent) == events.count() == 2350
    assert [tuple(r) for r in plans.events_over_tcp(spark, sf).collect()] == sorted(tuple(r) for r in events.collect())
