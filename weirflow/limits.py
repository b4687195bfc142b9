"""Caps that a source checks before it allocates anything; equal is allowed, one over is an error."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import FormatError

NO_LIMIT = (1 << 63) - 1
GIB = 1 << 30


@dataclass(frozen=True)
class DecodeLimits:
    """The default caps."""

    frame_bytes: int = 2 * GIB
    rows: int = 256 * 1024 * 1024
    buffers: int = 65_536
    fields: int = 65_536
    dictionary_entries: int = 256 * 1024 * 1024
    string_bytes: int = 2 * GIB
    decompressed_bytes: int = 4 * GIB

    @classmethod
    def unlimited(cls) -> DecodeLimits:
        return cls(**{f.name: NO_LIMIT for f in fields(cls)})

    @classmethod
    def from_options(cls, options) -> DecodeLimits:
        """From data source options named ``limit_<cap>``."""
        given = {f.name: int(options[f"limit_{f.name}"]) for f in fields(cls) if f"limit_{f.name}" in options}
        return cls(**given)

    def check(self, what: str, value: int) -> None:
        most = getattr(self, what)
        if value > most:
            raise FormatError(f"resource limit exceeded: {what} is {value}, at most {most} is allowed")
