"""Endpoints: schemes, formats, and which arguments apply where."""

from __future__ import annotations

import os
from dataclasses import dataclass

from .errors import FormatError, ProtocolError, TransportError

# Names and extensions of formats, and wire schemes.
FORMAT_NAMES = {"ipc": "ipc", "arrow": "ipc", "feather": "ipc", "parquet": "parquet", "csv": "csv", "json": "json"}
FORMAT_EXTENSIONS = {".arrow": "ipc", ".ipc": "ipc", ".feather": "ipc", ".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json"}
SCHEMES = ("file", "tcp", "ws", "wss", "http", "https", "uds", "quic", "wt")
TLS_SCHEMES = ("quic", "wt", "wss", "https")
#: Wires that the standard library can serve here.
SERVED = ("tcp", "uds", "http", "https", "ws", "wss")
PROTOCOLS = ("arrow", "frames")
TEXT_BATCH = 65_536
MMAP_FROM = 64 << 20


@dataclass(frozen=True)
class Endpoint:
    scheme: str  # file, stdio or a wire
    address: str

    @property
    def wire(self) -> bool:
        return self.scheme not in ("file", "stdio")


def resolve_endpoint(uri: str) -> Endpoint:
    if uri in ("stdio:", "stdio://"):
        return Endpoint("stdio", "")
    scheme, found, rest = uri.partition("://")
    if found:
        if scheme not in SCHEMES:
            raise TransportError(f"'{scheme}' is none of the schemes {', '.join(SCHEMES)}")
        return Endpoint(scheme, rest)
    return Endpoint("file", uri)


def resolve_protocol(protocol: str | None) -> str:
    p = protocol or "arrow"
    if p not in PROTOCOLS:
        raise ProtocolError(f"'{p}' is none of the protocols {', '.join(PROTOCOLS)}")
    return p


def resolve_format(path: str, fmt: str | None) -> str:
    if fmt is not None:
        if fmt not in FORMAT_NAMES:
            raise ValueError(f"'{fmt}' is none of the formats {', '.join(FORMAT_NAMES)}")
        return FORMAT_NAMES[fmt]
    kind = FORMAT_EXTENSIONS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise FormatError(f"the name '{path}' tells no format: say which by format=")
    return kind


def json_lines(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in (".jsonl", ".ndjson")


#: Which kind of file an argument shapes.
SHAPES = {"delimiter": {"csv"}, "header": {"csv"}, "batch_size": {"csv", "json"}, "compression": {"ipc", "parquet"}}
#: Which end of an encrypted wire holds an argument.
HELD_BY = {"tls_cert": "accepting", "tls_key": "accepting", "tls_ca": "connecting"}
COMPRESSIONS = ("zstd", "snappy", "none")


def _named(arguments: dict[str, object]) -> set[str]:
    return {name for name, value in arguments.items() if value not in (None, "")}


def check_tls(e: Endpoint, accept: bool, cert: str | None, key: str | None, ca: str | None) -> None:
    """An encrypted wire gets all that its end holds, and no other wire or end gets any of it."""
    end = "accepting" if accept else "connecting"
    given = _named({"tls_cert": cert, "tls_key": key, "tls_ca": ca})
    held = {name for name, holder in HELD_BY.items() if holder == end} if e.scheme in TLS_SCHEMES else set()
    if given - held:
        raise TransportError(f"no use for {' or '.join(sorted(given - held))} at the {end} end of {e.scheme}")
    if held - given:
        raise TransportError(f"the {end} end of {e.scheme} requires {' and '.join(sorted(held))}")


def check_format_arguments(fmt: str, delimiter: str | None, header: bool | None, batch_size: int | None = None, compression: str | None = None) -> None:
    """What shapes another kind of file is an error, and so is a value that no file can have."""
    for name in sorted(_named({"delimiter": delimiter, "header": header, "batch_size": batch_size, "compression": compression})):
        if fmt not in SHAPES[name]:
            raise ValueError(f"{name} shapes {' and '.join(sorted(SHAPES[name]))} files, this one is {fmt}")
    if compression is not None and compression not in COMPRESSIONS:
        raise ValueError(f"compression is one of {', '.join(COMPRESSIONS)}, not '{compression}'")
    if delimiter is not None and not (len(delimiter) == 1 and delimiter.isascii()):
        raise ValueError(f"'{delimiter}' is not one ASCII character, as a delimiter is")
    if batch_size is not None and batch_size < 1:
        raise ValueError("a batch has at least one row")


def check_place(e: Endpoint, *, accept: bool, parallel: int, protocol: str, format_arguments: bool, target: bool = False) -> None:
    """Arguments that do not apply to the endpoint are errors, so that a misspelt intent does not pass in silence."""
    verb = "written" if target else "read"
    if format_arguments and (e.wire or protocol == "frames"):
        raise ValueError(f"what is {verb} as {'frames' if protocol == 'frames' else 'a stream'} has no file's shape: leave the arguments of files out")
    if e.wire and e.scheme not in SERVED:
        raise TransportError(f"{e.scheme} is not served here, only {', '.join(SERVED)}")
    for name, given in (("accept", accept), ("parallel", parallel)):
        if given and not e.wire:
            raise TransportError(f"{name} is for wires, not for what is {verb} on {e.scheme}")
