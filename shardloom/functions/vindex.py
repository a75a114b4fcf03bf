"""Sharding functions: from column values to keyspace ids.

Each has a scalar form, ``map`` (to a destination, on the driver, for
routing), and a column form, ``ksid`` (on executors, for writing); both give
the same bytes. A value that has no id gives nowhere, or a null.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Invalid
from ..keyrange import ALL, NOWHERE, Destination, KeyRange, successor, to_id, to_range
from ..shipping import ship_package
from ..types import as_u64, canonical_bytes
from . import des


def big_endian(number: int) -> bytes:
    return number.to_bytes(8, "big")


def number_column(c: Column) -> Column:
    """As a long with the bits of the unsigned form; null if it is no integer."""
    text = F.trim(c.cast("string"))
    above = text.try_cast("decimal(20,0)") - F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long")), F.when(text.rlike(r"^\d+$"), above.try_cast("long")))


def eight_bytes(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


class Vindex:
    """``cost`` orders alternatives; ``columns`` is how many values it takes."""

    kind = ""
    cost = 1
    unique = True
    columns = 1
    params: tuple[str, ...] = ()
    #: Whether ids keep the order of values, so that ranges and prefixes route.
    ordered = False
    partial = False

    def __init__(self, name: str, params: dict[str, str] | None = None):
        self.name, self.given = name, dict(params or {})
        for p in self.given:
            if p not in self.params:
                raise Invalid(f"vindex {name!r}: unknown parameter {p!r}")

    def id_of(self, *values: Any) -> bytes | None:
        raise NotImplementedError

    def map(self, *values: Any) -> Destination:
        ksid = self.id_of(*values)
        return NOWHERE if ksid is None else to_id(ksid)

    def verify(self, values: tuple, ksid: bytes) -> bool:
        return self.id_of(*values) == ksid

    def ksid(self, *columns: Column) -> Column:
        raise NotImplementedError

    def range(self, low: Any, high: Any) -> Destination:
        return ALL

    def prefix(self, text: str) -> Destination:
        return ALL


class Hash(Vindex):
    """DES with a zero key of the value as an unsigned 64-bit number."""

    kind = "hash"

    def id_of(self, value):
        number = as_u64(value)
        return None if number is None else big_endian(int(des.encrypt(np.array([number], np.uint64))[0]))

    def value_of(self, ksid: bytes) -> int:
        return int(des.decrypt(np.array([int.from_bytes(ksid, "big")], np.uint64))[0])

    def ksid(self, column):
        @F.pandas_udf("binary")
        def hashed(numbers: pd.Series) -> pd.Series:
            """Of decimal text: nullable longs would pass through floating point."""
            there = numbers.notna().to_numpy()
            ids = des.encrypt(np.array([int(n) for n in numbers[there]], np.int64).view(np.uint64)).astype(">u8").tobytes()
            out = np.full(len(numbers), None, dtype=object)
            out[there] = [ids[k : k + 8] for k in range(0, len(ids), 8)]
            return pd.Series(out)

        return hashed(number_column(column).cast("string"))


class XxHash(Vindex):
    """xxHash64 with seed 0 of the canonical bytes, little-endian."""

    kind = "xxhash"

    def id_of(self, value):
        return xxhash.xxh64_intdigest(canonical_bytes(value), 0).to_bytes(8, "little")

    def ksid(self, column):
        @F.pandas_udf("binary")
        def hashed(data: pd.Series) -> pd.Series:
            return pd.Series([xxhash.xxh64_digest(b"" if d is None else d, 0)[::-1] for d in data], dtype=object)

        return hashed(bytes_column(column))


def bytes_column(c: Column) -> Column:
    return c.cast("string").cast("binary")


class Binary(Vindex):
    """The canonical bytes themselves."""

    kind, cost, ordered = "binary", 0, True

    def id_of(self, value):
        return canonical_bytes(value)

    def ksid(self, column):
        return F.coalesce(bytes_column(column), F.lit(b""))

    def range(self, low, high):
        """Both ends count: the end of the range is the first id after the last value."""
        return to_range(b"" if low is None else canonical_bytes(low), b"" if high is None else canonical_bytes(high) + b"\x01")

    def prefix(self, text):
        return to_range(text.encode(), successor(text.encode()))


class BinaryMd5(Vindex):
    """MD5 of the canonical bytes."""

    kind = "binary_md5"

    def id_of(self, value):
        import hashlib

        return hashlib.md5(canonical_bytes(value)).digest()

    def ksid(self, column):
        return F.unhex(F.md5(F.coalesce(bytes_column(column), F.lit(b""))))


class Numeric(Vindex):
    """The unsigned 64-bit number, big-endian."""

    kind, cost, ordered = "numeric", 0, True

    def id_of(self, value):
        number = as_u64(value)
        return None if number is None else big_endian(number)

    def ksid(self, column):
        return eight_bytes(number_column(column))

    def range(self, low, high):
        bounds = [None if v is None else as_u64(v) for v in (low, high)]
        signed = any(v is not None and (u is None or str(v).strip().startswith("-")) for v, u in zip((low, high), bounds))
        if signed or low is None:  # values below zero have the highest ids
            return ALL
        # a value above needs no end: negative values would not match, and pruning keeps enough
        end = b"" if bounds[1] is None or bounds[1] + 1 >= 1 << 64 else big_endian(bounds[1] + 1)
        return to_range(big_endian(bounds[0]), end)


class ReverseBits(Vindex):
    """The unsigned 64-bit number with its bits in the other order, big-endian."""

    kind = "reverse_bits"

    def id_of(self, value):
        number = as_u64(value)
        return None if number is None else big_endian(int(f"{number:064b}"[::-1], 2))

    def value_of(self, ksid: bytes) -> int:
        return int(f"{int.from_bytes(ksid, 'big'):064b}"[::-1], 2)

    def ksid(self, column):
        bits = F.lpad(F.bin(number_column(column)), 64, "0")
        return F.unhex(F.lpad(F.conv(F.reverse(bits), 2, 16), 16, "0"))


class Null(Vindex):
    """One id for all values."""

    kind, cost = "null", 100

    def id_of(self, value):
        return bytes(8)

    def ksid(self, column):
        return F.lit(bytes(8))


class NumericStaticMap(Vindex):
    """Ids from a JSON map of values to numbers; others by ``fallback_type`` if that is hash."""

    kind, params = "numeric_static_map", ("json", "json_path", "fallback_type")

    def __init__(self, name, params=None):
        super().__init__(name, params)
        if "json_path" in self.given:
            with open(self.given["json_path"], encoding="utf-8") as source:
                text = source.read()
        else:
            text = self.given.get("json", "{}")
        self.numbers = {str(k): int(v) for k, v in json.loads(text).items()}
        fallback = self.given.get("fallback_type")
        if fallback not in (None, "hash"):
            raise Invalid(f"vindex {name!r}: unknown fallback {fallback!r}")
        self.fallback = Hash(name) if fallback else None

    def id_of(self, value):
        known = self.numbers.get(canonical_bytes(value).decode("utf-8", "replace"))
        return big_endian(known % (1 << 64)) if known is not None else self.fallback.id_of(value) if self.fallback else None

    def ksid(self, column):
        text, out = column.cast("string"), self.fallback.ksid(column) if self.fallback else F.lit(None).cast("binary")
        if not self.numbers:
            return out
        pairs = [x for k, v in self.numbers.items() for x in (F.lit(k), F.lit(big_endian(v % (1 << 64))))]
        return F.coalesce(F.element_at(F.create_map(*pairs), text), out)


class MultiColumn(Vindex):
    """Slices of the columns' own ids, eight bytes together; leading columns alone give a range."""

    kind, params, partial = "multicol", ("column_count", "column_bytes", "column_vindex"), True

    def __init__(self, name, params=None):
        super().__init__(name, params)
        self.columns = int(self.given.get("column_count", 0))
        if not 1 <= self.columns <= 8:
            raise Invalid(f"vindex {name!r}: column_count is from 1 to 8")
        given = self.given.get("column_bytes")
        even, more = divmod(8, self.columns)
        self.sizes = [int(x) for x in str(given).split(",")] if given else [even + (k < more) for k in range(self.columns)]
        if len(self.sizes) != self.columns or sum(self.sizes) != 8 or min(self.sizes) < 1:
            raise Invalid(f"vindex {name!r}: column_bytes must have {self.columns} sizes that add up to 8")
        kinds = [x.strip() or "hash" for x in str(self.given.get("column_vindex", "")).split(",")]
        self.parts = [create(kinds[k] if k < len(kinds) else "hash", f"{name}.{k}") for k in range(self.columns)]

    def slice_of(self, k: int, value) -> bytes | None:
        ksid = self.parts[k].id_of(value)
        return None if ksid is None else ksid[: self.sizes[k]].ljust(self.sizes[k], b"\0")

    def id_of(self, *values):
        slices = [self.slice_of(k, v) for k, v in enumerate(values)]
        return None if None in slices else b"".join(slices)

    def map(self, *values):
        ksid = self.id_of(*values)
        if ksid is None:
            return NOWHERE
        return to_id(ksid) if len(values) == self.columns else to_range(ksid, successor(ksid))

    def ksid(self, *columns):
        return F.concat(*[F.rpad(F.substring(p.ksid(c), 1, n), n, F.lit(b"\0")) for p, c, n in zip(self.parts, columns, self.sizes)])


class Lookup(Vindex):
    """Ids from a mapping table of ``from`` columns to an id.

    ``reader`` finds the shards that hold the ids of tuples of values; the engine sets it.
    """

    params = ("table", "from", "to", "write_only", "ignore_nulls", "autocommit", "no_verify", "read_lock", "batch_lookup")
    hashed = False
    consistent = False

    def __init__(self, name, params=None):
        super().__init__(name, params)
        if "table" not in self.given or "from" not in self.given:
            raise Invalid(f"vindex {name!r}: a lookup needs table and from")
        self.table = self.given["table"]
        self.from_columns = [c.strip() for c in self.given["from"].split(",")]
        self.to_column = self.given.get("to", "keyspace_id")
        self.columns = len(self.from_columns)
        flag = lambda p: str(self.given.get(p, "false")).lower() == "true"
        self.write_only, self.ignore_nulls = flag("write_only"), flag("ignore_nulls")
        self.reader: Callable[[list[tuple]], list[KeyRange]] | None = None

    def id_column(self, to: Column) -> Column:
        """The id that the table's last column stands for."""
        return Hash(self.name).ksid(to) if self.hashed else to

    def map(self, *values):
        return self.map_all([values])

    def map_all(self, rows: list[tuple]) -> Destination:
        """Where the rows of any of these values are, by one look at the table."""
        if self.write_only or self.reader is None:
            return ALL
        return Destination(ranges=frozenset(self.reader(rows))) if rows else NOWHERE


def _lookup(kind: str, unique: bool, hashed: bool = False, consistent: bool = False) -> type[Lookup]:
    return type(kind, (Lookup,), {"kind": kind, "unique": unique, "cost": 10 if unique else 20, "hashed": hashed, "consistent": consistent})


REGISTRY: dict[str, type[Vindex]] = {}


def register_vindex(cls: type[Vindex]) -> type[Vindex]:
    """Make a sharding function known by its ``kind``."""
    REGISTRY[cls.kind] = cls
    return cls


for _cls in (Hash, XxHash, Binary, BinaryMd5, Numeric, ReverseBits, Null, NumericStaticMap, MultiColumn):
    register_vindex(_cls)
for _unique in (False, True):
    _end = "_unique" if _unique else ""
    register_vindex(_lookup("lookup" + _end, _unique))
    register_vindex(_lookup("lookup_hash" + _end, _unique, hashed=True))
    register_vindex(_lookup("consistent_lookup" + _end, _unique, consistent=True))


def create(kind: str, name: str, params: dict[str, str] | None = None) -> Vindex:
    if kind not in REGISTRY:
        raise Invalid(f"unknown vindex kind {kind!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](name, params)


def ready(spark) -> None:
    """Let executors import this module."""
    ship_package(spark)
