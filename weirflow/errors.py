"""Errors: one root, and a class each for formats, transports and framing protocols."""


class FlowError(Exception):
    """Anything that this package raises about data or endpoints."""


class FormatError(FlowError):
    """A file or payload is not what its format asks for, or the format cannot do what is asked."""


class TransportError(FlowError):
    """An endpoint cannot be opened, or does not have the form that is asked."""


class ProtocolError(FlowError):
    """Frames, tags or registered names do not fit."""
