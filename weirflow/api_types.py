"""Values that sources hand out."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa

from .errors import ProtocolError
from .sources import arrow_ipc


@dataclass(frozen=True)
class Message:
    """A frame: an opaque payload, or a table."""

    tag: int
    name: str
    payload: bytes
    kind: str

    def is_table(self) -> bool:
        return self.kind == "table"

    @property
    def table(self) -> pa.Table:
        if not self.is_table():
            raise ProtocolError("a message frame holds no table")
        return arrow_ipc.deserialise(self.payload)
