import shutil
import socket
import subprocess
import threading

import pyarrow as pa
import pytest
from pyspark.sql import types as T

import weirflow.api as api
from weirflow.errors import TransportError
from weirflow.sources.frames import Registry
from weirflow.streaming import web, wires
from weirflow.streaming.connection import Connection

SCHEMA = T.StructType([T.StructField("v", T.LongType())])


def free():
    with socket.create_server(("127.0.0.1", 0)) as s:
        return f"127.0.0.1:{s.getsockname()[1]}"


@pytest.mark.parametrize("scheme", ["http", "ws"])
def test_connecting_writer(spark, scheme):
    where = free()
    wires.listener(scheme, where)

    def send():
        with api.write(f"{scheme}://{where}/feed") as w:
            for k in range(5):
                w.write(pa.table({"v": list(range(1000 * k, 1000 * k + 1000))}))

    t = threading.Thread(target=send, daemon=True)
    t.start()
    got = api.read(spark, f"{scheme}://{where}/feed", accept=True, schema=SCHEMA).dataframe()
    assert sorted(r.v for r in got.collect()) == list(range(5000))
    t.join(10)
    wires.close_listener(scheme, where)


@pytest.mark.parametrize("scheme", ["http", "ws"])
def test_accepting_writer(spark, scheme):
    where = free()
    wires.listener(scheme, where)

    def serve():
        with api.write(f"{scheme}://{where}", accept=True) as w:
            w.write(pa.table({"v": [1, 2, 3]}))

    threading.Thread(target=serve, daemon=True).start()
    got = api.read(spark, f"{scheme}://{where}", schema=SCHEMA).dataframe()
    assert sorted(r.v for r in got.collect()) == [1, 2, 3]
    wires.close_listener(scheme, where)


def test_websocket_frames_and_pings():
    a, b = socket.socketpair()
    box = {}
    t = threading.Thread(target=lambda: box.update(server=web.WebSocketWire(b, "h", "/", True)))
    t.start()
    client = web.WebSocketWire(a, "h", "/", False)
    t.join(5)
    server = box["server"]
    for n in (0, 1, 125, 126, 70_000):
        client.ping(b"x")
        client.sendall(bytes(n % 251 for _ in range(n)))
        got = b""
        while len(got) < n:
            got += server.recv(1000)
        assert got == bytes(n % 251 for _ in range(n))
    r = Registry()
    r.register_message("m")
    left, right = Connection(client, r), Connection(server, r)
    left.send_message("m", b"hello")
    assert right.receive().payload == b"hello"
    left.finish()
    assert right.receive() is None
    a, b = socket.socketpair()
    a.sendall(b"GET / HTTP/1.1\r\n\r\n")
    with pytest.raises(TransportError, match="no WebSocket"):
        web.WebSocketWire(b, "h", "/", True)


def test_http_refusals():
    a, b = socket.socketpair()
    a.sendall(b"DELETE / HTTP/1.1\r\n\r\n")
    with pytest.raises(TransportError, match="DELETE"):
        web.HttpWire(b, "h", "/", True, False)
    a, b = socket.socketpair()
    b.sendall(b"HTTP/1.1 404 Not Found\r\n\r\n")
    with pytest.raises(TransportError, match="404"):
        web.HttpWire(a, "h", "/", False, False)
    a, b = socket.socketpair()
    b.sendall(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc")
    assert web.HttpWire(a, "h", "/", False, False).makefile("rb").read() == b"abc"


@pytest.mark.skipif(not shutil.which("openssl"), reason="no openssl to make a certificate with")
@pytest.mark.parametrize("scheme", ["https", "wss"])
def test_tls(spark, tmp_path, scheme):
    cert, key = str(tmp_path / "c.pem"), str(tmp_path / "k.pem")
    subprocess.run(["openssl", "req", "-x509", "-newkey", "rsa:2048", "-nodes", "-keyout", key, "-out", cert, "-days", "2", "-subj", "/CN=127.0.0.1", "-addext", "subjectAltName=IP:127.0.0.1"], check=True, capture_output=True)
    where = free()
    wires.listener(scheme, where)

    def serve():
        with api.write(f"{scheme}://{where}", accept=True, tls_cert=cert, tls_key=key) as w:
            w.write(pa.table({"v": [7]}))

    threading.Thread(target=serve, daemon=True).start()
    assert [r.v for r in api.read(spark, f"{scheme}://{where}", schema=SCHEMA, tls_ca=cert).dataframe().collect()] == [7]
    wires.close_listener(scheme, where)
