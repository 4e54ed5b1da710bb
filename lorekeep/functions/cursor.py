"""Opaque paging cursors: base64 of a number's decimal text, or of a GUID's bytes."""

from __future__ import annotations

import base64
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(value: int | uuid.UUID) -> str:
    return base64.b64encode(value.bytes_le if isinstance(value, uuid.UUID) else str(value).encode()).decode()


def decode_int(cursor: str) -> int:
    value = int(base64.b64decode(cursor, validate=True).decode())
    if not -(1 << 31) <= value < 1 << 31:
        raise ValueError("not a 32-bit number")
    return value


def decode_guid(cursor: str) -> uuid.UUID:
    return uuid.UUID(bytes_le=base64.b64decode(cursor, validate=True))


def try_decode_int(cursor: str) -> int | None:
    try:
        return decode_int(cursor)
    except (ValueError, UnicodeDecodeError):
        return None


def try_decode_guid(cursor: str) -> uuid.UUID | None:
    try:
        return decode_guid(cursor)
    except ValueError:
        return None


def encoded(c: Column) -> Column:
    """encode() of an integer column."""
    return F.base64(F.encode(c.cast("string"), "UTF-8"))


def decoded(c: Column) -> Column:
    """try_decode_int() of a column: null where it isn't a cursor."""
    whole = F.when(F.length(c) % 4 == 0, c)  # Spark also takes text whose padding is missing
    return F.try_to_binary(whole, F.lit("base64")).cast("string").try_cast("int")
