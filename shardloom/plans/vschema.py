"""Logical schema: keyspaces, their tables and sharding functions, and routing rules."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from ..errors import Invalid, NotFound
from ..functions.vindex import Lookup, Vindex, create
from ..keyrange import KeyRange, check_cover, even_split


@dataclass
class ColumnVindex:
    columns: list[str]
    vindex: Vindex
    owner: bool = False  # the table keeps the lookup's rows


@dataclass
class Table:
    keyspace: str
    name: str
    kind: str = "normal"  # normal, reference or sequence
    vindexes: list[ColumnVindex] = field(default_factory=list)  # cheapest first
    columns: dict[str, str] = field(default_factory=dict)
    authoritative: bool = False
    auto_column: str | None = None
    sequence: str | None = None
    source: str | None = None
    #: Files of each shard by hash of the sharding columns; for keys without hot values.
    bucket_count: int = 0
    #: Columns that no two rows share, the primary key first.
    keys: list[list[str]] = field(default_factory=list)

    @property
    def full_name(self) -> str:
        return f"{self.keyspace}.{self.name}"

    @property
    def buckets(self) -> tuple[int, list[str]] | None:
        return (self.bucket_count, self.primary.columns) if self.bucket_count and self.primary and self.kind == "normal" else None

    @property
    def primary(self) -> ColumnVindex | None:
        return next((v for v in self.vindexes if v.vindex.unique and not isinstance(v.vindex, Lookup)), next((v for v in self.vindexes if v.vindex.unique), None))


@dataclass
class Keyspace:
    name: str
    sharded: bool
    dialect: str = "mysql"
    shards: list[KeyRange] = field(default_factory=lambda: [KeyRange()])
    vindexes: dict[str, Vindex] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)


class VSchema:
    """Checked when built; names are found without regard to case."""

    def __init__(self, declared: dict[str, Any]):
        self.keyspaces: dict[str, Keyspace] = {}
        for name, body in (declared.get("keyspaces") or {}).items():
            self.keyspaces[name.lower()] = self._keyspace(name, body or {})
        for ks in self.keyspaces.values():
            for table in ks.tables.values():
                self._check_references(ks, table)
        self.rules = {}
        for rule in (declared.get("routing_rules") or {}).get("rules", []):
            self.rules[rule["from_table"].lower()] = list(rule.get("to_tables", []))

    @staticmethod
    def load(text: str) -> VSchema:
        """From JSON or YAML text."""
        try:
            return VSchema(json.loads(text))
        except json.JSONDecodeError:
            import yaml

            return VSchema(yaml.safe_load(text))

    def _keyspace(self, name: str, body: dict) -> Keyspace:
        sharded = bool(body.get("sharded", False))
        shards = body.get("shards", 1)
        ranges = even_split(shards) if isinstance(shards, int) else check_cover([KeyRange.parse(str(s)) for s in shards])
        if not sharded and len(ranges) > 1:
            raise Invalid(f"unsharded keyspace {name!r} has one shard")
        ks = Keyspace(name, sharded, body.get("dialect", "mysql"), ranges)
        owners = {}
        for v, given in (body.get("vindexes") or {}).items():
            ks.vindexes[v] = create(given["type"], v, given.get("params"))
            owners[v] = given.get("owner")
            if owners[v] and owners[v] not in (body.get("tables") or {}):
                raise Invalid(f"vindex {v!r}: its owner {owners[v]!r} is no table of keyspace {name!r}")
        for t, given in (body.get("tables") or {}).items():
            ks.tables[t.lower()] = self._table(ks, t, given or {}, owners)
        return ks

    @staticmethod
    def _table(ks: Keyspace, name: str, body: dict, owners: dict) -> Table:
        kind = body.get("type") or "normal"
        if kind not in ("normal", "reference", "sequence"):
            raise Invalid(f"table {name!r}: unknown type {kind!r}")
        given = body.get("column_vindexes") or []
        if not ks.sharded and given:
            raise Invalid(f"table {name!r}: an unsharded keyspace has no column_vindexes")
        if ks.sharded and kind == "sequence":
            raise Invalid(f"sequence {name!r} may not live in a sharded keyspace")
        found = []
        for g in given:
            columns = g.get("columns") or ([g["column"]] if g.get("column") else [])
            if not columns:
                raise Invalid(f"table {name!r}: a column vindex names at least one column")
            if g.get("name") not in ks.vindexes:
                raise Invalid(f"table {name!r}: unknown vindex {g.get('name')!r}")
            vindex = ks.vindexes[g["name"]]
            if len(columns) != vindex.columns and not (vindex.partial and len(columns) < vindex.columns):
                raise Invalid(f"table {name!r}: vindex {vindex.name!r} takes {vindex.columns} column(s), not {len(columns)}")
            found.append(ColumnVindex([c.lower() for c in columns], vindex, owners.get(g["name"]) == name))
        found.sort(key=lambda v: v.vindex.cost)
        auto = body.get("auto_increment") or {}
        columns = {c["name"].lower(): c.get("type", "") for c in body.get("columns", [])}
        table = Table(ks.name, name, kind, found, columns, bool(body.get("column_list_authoritative")), (auto.get("column") or "").lower() or None, auto.get("sequence"), body.get("source"), int(body.get("buckets", 0)))
        table.keys = [[c.lower() for c in key] for key in ([body["primary_key"]] if body.get("primary_key") else []) + list(body.get("unique_keys") or [])]
        if ks.sharded and kind == "normal" and table.primary is None:
            raise Invalid(f"table {name!r} in a sharded keyspace needs a unique vindex")
        return table

    def _check_references(self, ks: Keyspace, table: Table) -> None:
        if table.sequence:
            if self.find(table.sequence, ks.name).kind != "sequence":
                raise Invalid(f"{table.full_name}: {table.sequence!r} is no sequence")
        if table.source:
            self.find(table.source, ks.name)

    def keyspace(self, name: str) -> Keyspace:
        if name.lower() not in self.keyspaces:
            raise NotFound(f"unknown keyspace {name!r}")
        return self.keyspaces[name.lower()]

    def find(self, name: str, default: str | None = None) -> Table:
        """The table of a name: by routing rule, by its keyspace, or the only one so called."""
        rules = getattr(self, "rules", {})
        for key in [name.lower(), *([f"{default}.{name}".lower()] if default and "." not in name else [])]:
            if key in rules:
                to = rules[key]
                if len(to) != 1:
                    raise Invalid(f"routing of table {name!r} is {'denied' if not to else 'ambiguous'}")
                return self._exact(to[0])
        if "." in name:
            return self._exact(name)
        if default and name.lower() in self.keyspace(default).tables:
            return self.keyspace(default).tables[name.lower()]
        there = [ks.tables[name.lower()] for ks in self.keyspaces.values() if name.lower() in ks.tables]
        if len(there) > 1:
            raise Invalid(f"table {name!r} exists in {len(there)} keyspaces")
        if not there:
            raise NotFound(f"unknown table {name!r}")
        return there[0]

    def _exact(self, name: str) -> Table:
        keyspace, _, table = name.partition(".")
        ks = self.keyspace(keyspace)
        if table.lower() not in ks.tables:
            raise NotFound(f"unknown table {name!r}")
        return ks.tables[table.lower()]
