"""Logical SQL types, their Spark types, and the canonical bytes of values."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from decimal import Decimal, InvalidOperation
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class SqlType(Enum):
    """Logical types; each value is the Spark type that carries it."""

    NULL = T.NullType()
    BOOL = T.BooleanType()
    INT8 = T.ByteType()
    INT16 = T.ShortType()
    INT32 = T.IntegerType()
    INT64 = T.LongType()
    UINT64 = T.DecimalType(20, 0)
    FLOAT32 = T.FloatType()
    FLOAT64 = T.DoubleType()
    DECIMAL = T.DecimalType(38, 18)
    TEXT = T.StringType()
    BLOB = T.BinaryType()
    DATE = T.DateType()
    DATETIME = T.TimestampNTZType()
    TIMESTAMP = T.TimestampType()

    @property
    def is_integral(self) -> bool:
        return self.name.startswith(("INT", "UINT"))

    @property
    def is_numeric(self) -> bool:
        return self.is_integral or self.name in ("BOOL", "FLOAT32", "FLOAT64", "DECIMAL")

    @property
    def is_temporal(self) -> bool:
        return self.name in ("DATE", "DATETIME", "TIMESTAMP")


U64 = 1 << 64


def as_u64(value: Any) -> int | None:
    """Unsigned 64-bit form of an integer, boolean or trimmed numeric text; negatives by two's complement."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, Decimal) and value == value.to_integral_value():
        value = int(value)
    if isinstance(value, (bytes, bytearray)):
        value = bytes(value).decode("utf-8", "replace")
    if isinstance(value, str):
        try:
            value = int(value.strip())
        except ValueError:
            return None
    if isinstance(value, int) and -(U64 >> 1) <= value < U64:
        return value % U64
    return None


def as_decimal(value: Any) -> Decimal | None:
    try:
        return Decimal(int(value)) if isinstance(value, bool) else Decimal(str(value).strip())
    except (InvalidOperation, ValueError):
        return None


def canonical_bytes(value: Any) -> bytes:
    """Bytes that sharding functions see; these forms never change."""
    if value is None:
        return b""
    if isinstance(value, bool):
        return bytes([value])
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, uuid.UUID):
        return value.bytes
    if isinstance(value, dt.datetime):
        return (value.isoformat(sep="T" if value.tzinfo else " ")).encode()
    if isinstance(value, (dict, list)):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()
    return str(value).encode()


def compare(a: Any, b: Any) -> int:
    """-1, 0 or 1: null first, numbers by exact value, text and bytes by their bytes."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    numbers = (int, float, Decimal)
    if isinstance(a, numbers) and isinstance(b, numbers):
        return (a > b) - (a < b)
    x, y = canonical_bytes(a), canonical_bytes(b)
    return (x > y) - (x < y)
