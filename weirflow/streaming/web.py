"""HTTP/1.1 and WebSocket wires, with or without TLS, on the standard library.

Both look like sockets to the rest: ``recv``, ``sendall``, ``makefile``, ``close``.  An HTTP wire has one
direction: the connecting peer reads the body of its GET or writes the body of its POST; the accepting
peer the other way round.  A WebSocket wire has two; pings are answered while reading, and the
connecting peer masks its frames.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import socket
import ssl
import struct

from ..errors import TransportError

# Fixed value: the key suffix of the WebSocket handshake.
GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
MEDIA_TYPE = "application/vnd.apache.arrow.stream"
MOST_HEADER = 64 << 10


def tls_wrap(s: socket.socket, host: str, accept: bool, cert: str | None, key: str | None, ca: str | None) -> socket.socket:
    try:
        if accept:
            ctx = ssl.create_default_context(ssl.Purpose.CLIENT_AUTH)
            ctx.load_cert_chain(cert, key)
            return ctx.wrap_socket(s, server_side=True)
        return ssl.create_default_context(cafile=ca).wrap_socket(s, server_hostname=host)
    except (ssl.SSLError, OSError) as x:
        raise TransportError(f"tls with {host}: {x}") from x


class _In(io.RawIOBase):
    def __init__(self, recv):
        self._recv = recv

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self._recv(len(b))
        b[: len(data)] = data
        return len(data)


class _Out(io.RawIOBase):
    def __init__(self, send):
        self._send = send

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        data = bytes(b)
        if data:
            self._send(data)
        return len(data)


class _Wire:
    def makefile(self, mode: str):
        return io.BufferedReader(_In(self.recv), 1 << 16) if mode.startswith("r") else io.BufferedWriter(_Out(self.sendall), 1 << 16)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _headers(f) -> tuple[str, dict[str, str]]:
    lines, size = [], 0
    while True:
        line = f.readline(MOST_HEADER)
        size += len(line)
        if not line or size > MOST_HEADER:
            raise TransportError("the peer sent no whole header")
        line = line.rstrip(b"\r\n").decode("latin-1")
        if not line:
            break
        lines.append(line)
    if not lines:
        raise TransportError("the peer sent no header")
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class HttpWire(_Wire):
    """One body of a request or response."""

    def __init__(self, s: socket.socket, host: str, path: str, accept: bool, sending: bool):
        self._s, self._f, self._accept, self._sending = s, s.makefile("rb"), accept, sending
        self._left: int | None = None
        self._chunked = self._done = False
        if accept:
            line, head = _headers(self._f)
            method = line.split(" ")[0]
            if method != ("GET" if sending else "POST"):
                s.sendall(b"HTTP/1.1 405 Method Not Allowed\r\nContent-Length: 0\r\n\r\n")
                raise TransportError(f"the peer sent {method}")
            if sending:
                s.sendall(f"HTTP/1.1 200 OK\r\nContent-Type: {MEDIA_TYPE}\r\nTransfer-Encoding: chunked\r\nConnection: close\r\n\r\n".encode())
            else:
                self._body(head)
        else:
            more = "Transfer-Encoding: chunked\r\n" if sending else ""
            s.sendall(f"{'POST' if sending else 'GET'} {path} HTTP/1.1\r\nHost: {host}\r\nAccept: {MEDIA_TYPE}\r\nContent-Type: {MEDIA_TYPE}\r\n{more}Connection: close\r\n\r\n".encode())
            if not sending:
                line, head = _headers(self._f)
                if line.split(" ")[1:2] != ["200"]:
                    raise TransportError(f"the peer answered {line}")
                self._body(head)

    def _body(self, head: dict[str, str]) -> None:
        self._chunked = "chunked" in head.get("transfer-encoding", "").lower()
        self._left = 0 if self._chunked else int(head["content-length"]) if "content-length" in head else None

    def recv(self, n: int) -> bytes:
        if self._done:
            return b""
        if self._left == 0:
            if not self._chunked:
                self._done = True
                return b""
            size = int(self._f.readline(MOST_HEADER).split(b";")[0].strip() or b"0", 16)
            if size == 0:
                while self._f.readline(MOST_HEADER).strip():
                    pass
                self._done = True
                if self._accept:
                    self._s.sendall(b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\nConnection: close\r\n\r\n")
                return b""
            self._left = size
        data = self._f.read(n if self._left is None else min(n, self._left))
        if not data:
            if self._left:
                raise TransportError("the body is cut off")
            self._done = True
        elif self._left is not None:
            self._left -= len(data)
            if self._left == 0 and self._chunked:
                self._f.readline(MOST_HEADER)
        return data

    def sendall(self, data: bytes) -> None:
        self._s.sendall(b"%x\r\n" % len(data) + data + b"\r\n")

    def close(self) -> None:
        try:
            if not self._sending and self._accept:
                while self.recv(1 << 16):  # to the body's end, which is then answered
                    pass
            if self._sending and not self._done:
                self._done = True
                self._s.sendall(b"0\r\n\r\n")
                if not self._accept:
                    line, _ = _headers(self._f)
                    if line.split(" ")[1:2] != ["200"]:
                        raise TransportError(f"the peer answered {line}")
        finally:
            self._f.close()
            self._s.close()


class WebSocketWire(_Wire):
    """Binary frames both ways."""

    TEXT, BINARY, CLOSE, PING, PONG = 1, 2, 8, 9, 10

    def __init__(self, s: socket.socket, host: str, path: str, accept: bool):
        self._s, self._f, self._mask = s, s.makefile("rb"), not accept
        self._held, self._ended, self._closed = b"", False, False
        if accept:
            _, head = _headers(self._f)
            if head.get("upgrade", "").lower() != "websocket" or "sec-websocket-key" not in head:
                s.sendall(b"HTTP/1.1 400 Bad Request\r\nContent-Length: 0\r\n\r\n")
                raise TransportError("the peer asked for no WebSocket")
            s.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {self.answer(head['sec-websocket-key'])}\r\n\r\n".encode())
        else:
            key = base64.b64encode(os.urandom(16)).decode()
            s.sendall(f"GET {path} HTTP/1.1\r\nHost: {host}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
            line, head = _headers(self._f)
            if line.split(" ")[1:2] != ["101"] or head.get("sec-websocket-accept") != self.answer(key):
                raise TransportError(f"the peer answered {line}")

    @staticmethod
    def answer(key: str) -> str:
        return base64.b64encode(hashlib.sha1((key + GUID).encode()).digest()).decode()

    def _frame(self, kind: int, data: bytes) -> bytes:
        n = len(data)
        flag = 128 if self._mask else 0
        head = bytes([128 | kind, flag | (n if n < 126 else 126 if n < 65536 else 127)])
        if n >= 126:
            head += struct.pack(">H" if n < 65536 else ">Q", n)
        if not self._mask:
            return head + data
        mask = os.urandom(4)
        return head + mask + _masked(data, mask)

    def sendall(self, data: bytes) -> None:
        self._s.sendall(self._frame(self.BINARY, data))

    def ping(self, data: bytes = b"") -> None:
        self._s.sendall(self._frame(self.PING, data))

    def _exactly(self, n: int) -> bytes:
        data = self._f.read(n)
        if len(data) < n:
            raise TransportError("a frame is cut off")
        return data

    def recv(self, n: int) -> bytes:
        while not self._held and not self._ended:
            first = self._f.read(1)
            if not first:
                self._ended = True
                break
            b = self._exactly(1)[0]
            size = b & 127
            if size > 125:
                size = struct.unpack(">H" if size == 126 else ">Q", self._exactly(2 if size == 126 else 8))[0]
            if bool(b & 128) == self._mask:
                raise TransportError("frames must be masked by the connecting peer only")
            mask = self._exactly(4) if b & 128 else None
            data = self._exactly(size)
            data = _masked(data, mask) if mask else data
            kind = first[0] & 15
            if kind == self.PING:
                self._s.sendall(self._frame(self.PONG, data))
            elif kind == self.CLOSE:
                self._ended = True
            elif kind in (0, self.TEXT, self.BINARY):
                self._held = data
            elif kind != self.PONG:
                raise TransportError(f"unknown frame kind {kind}")
        out, self._held = self._held[:n], self._held[n:]
        return out

    def shutdown(self, how: int) -> None:
        self._s.sendall(self._frame(self.CLOSE, struct.pack(">H", 1000)))
        self._closed = True

    def close(self) -> None:
        try:
            if not self._closed:
                self._closed = True
                self._s.sendall(self._frame(self.CLOSE, struct.pack(">H", 1000)))
        except OSError:
            pass
        finally:
            self._f.close()
            self._s.close()


def _masked(data: bytes, mask: bytes) -> bytes:
    n = len(data)
    whole = int.from_bytes((mask * (n // 4 + 1))[:n], "little")
    return (int.from_bytes(data, "little") ^ whole).to_bytes(n, "little")
