"""Key encodings whose unsigned byte order is the order of what they encode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(1 << 63)


def unsigned_key(c: Column) -> Column:
    """Non-negative integers as 8 bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))


def signed_key(c: Column) -> Column:
    """Integers as 8 bytes, big-endian, with the sign bit flipped."""
    return F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(_SIGN))), 16, "0"))


def composite_key(*parts: Column) -> Column:
    """Fixed-width keys side by side."""
    return F.concat(*parts)


def key_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def unsigned_bytes(n: int) -> bytes:
    return n.to_bytes(8, "big")


def signed_bytes(n: int) -> bytes:
    return (n + (1 << 63)).to_bytes(8, "big")


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys that begin with prefix; None if there is none."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None
