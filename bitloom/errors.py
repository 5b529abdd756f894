"""Typed errors."""


class BitloomError(Exception):
    """Base of all errors raised on purpose."""


class UnsupportedType(BitloomError):
    """A column whose type can't be packed into bits."""


class NullValues(BitloomError):
    """Nulls where none may be."""


class NonFinite(BitloomError):
    """NaN or infinite values where numbers are scaled."""


class OutOfRange(BitloomError):
    """A value, position, row or scale outside its range."""


class DuplicateKey(BitloomError):
    """Keys that must be unique aren't."""


class MissingKey(BitloomError):
    """A total join found no partner."""


class InvalidFormat(BitloomError):
    """Bytes or text that don't follow their format."""


class InvalidConfig(BitloomError):
    """Parameters that make no sense."""


class InvalidMetadata(BitloomError):
    """Layouts or tables that contradict each other."""
