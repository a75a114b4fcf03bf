"""Declared clusters: checked, applied again and again without harm, compared and split."""

from __future__ import annotations

import os
import re
import sys
from dataclasses import replace
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect.ddl import DIALECTS
from .engine import Engine
from .errors import Invalid
from .keyrange import KeyRange, check_cover, even_split
from .plans.vschema import VSchema
from .sources.store import SHARD, Store, Stored


def expanded(value: Any) -> Any:
    """``${NAME}`` from the environment, in all texts; a name that is not set is an error."""
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise Invalid(f"environment variable {m[1]!r} is not set")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", put, value)


def redacted(place: str) -> str:
    """A location without its password."""
    return re.sub(r"(://[^:/@]+):[^@/]*@", r"\1:***@", place)


def load_config(text: str) -> dict[str, Any]:
    import yaml

    config = expanded(yaml.safe_load(text) or {})
    check_config(config)
    return config


def check_config(config: dict[str, Any]) -> None:
    if not config.get("root"):
        raise Invalid("a cluster names its root folder")
    keyspaces = config.get("keyspaces") or {}
    if not keyspaces:
        raise Invalid("a cluster has at least one keyspace")
    for name, ks in keyspaces.items():
        if not re.fullmatch(r"[A-Za-z_][\w-]*", name):
            raise Invalid(f"bad keyspace name {name!r}")
        dialect = (ks or {}).get("dialect", "mysql")
        if dialect not in DIALECTS:
            raise Invalid(f"keyspace {name!r}: unknown dialect {dialect!r}")
        shards = (ks or {}).get("shards", 1)
        if isinstance(shards, int):
            even_split(shards)
        else:
            names = [str(s) for s in shards]
            if len(set(names)) < len(names):
                raise Invalid(f"keyspace {name!r}: a shard comes twice")
            check_cover([KeyRange.parse(s) for s in names])
    VSchema(config)


def apply(spark: SparkSession, config: dict[str, Any], strict: bool = False) -> tuple[Engine, list[str]]:
    """An engine for a declared cluster, and what changed; tables and their data stay."""
    check_config(config)
    vschema, store = VSchema(config), Store(spark, config["root"])
    report, new = [], {}
    for ks in vschema.keyspaces.values():
        for table in ks.tables.values():
            if table.full_name not in store.tables and table.columns:
                fields = ", ".join(f"`{c}` {t or 'string'}" for c, t in table.columns.items())
                new[table.full_name] = Stored(T.StructType.fromDDL(fields).json(), buckets=table.buckets, keys=table.keys)
                report.append(f"created table {table.full_name}")
        wanted = {s.name for s in ks.shards}
        for name, stored in store.tables.items():
            if name.startswith(ks.name + ".") and ks.sharded and not set(stored.shards) <= wanted | {"-"}:
                raise Invalid(f"{name} has data on shards that are not declared; split it first")
    if new:
        store.commit(new)
    return Engine(spark, vschema, store, strict), report or ["nothing changed"]


def schema_drift(engine: Engine) -> list[str]:
    """Shards whose files differ from the table's schema."""
    import json

    out = []
    for name, stored in engine.store.tables.items():
        want = {f.name: f.dataType.simpleString() for f in T.StructType.fromJson(json.loads(stored.schema)).fields}
        for shard, folders in stored.shards.items():
            for folder in folders:  # of a folder, one file's footer
                have = {f.name: f.dataType.simpleString() for f in engine.spark.read.parquet(folder).schema.fields}
                out += [f"{name}/{shard}: missing column {c}" for c in want.keys() - have.keys()]
                out += [f"{name}/{shard}: unexpected column {c}" for c in have.keys() - want.keys()]
                out += [f"{name}/{shard}: column {c} is {have[c]}, not {want[c]}" for c in want.keys() & have.keys() if want[c] != have[c]]
    return sorted(out)


def split(engine: Engine, keyspace: str, shards: list[str] | int) -> dict[str, int]:
    """Move a keyspace's rows to new shards and commit all its tables together; rows by table."""
    ks = engine.vschema.keyspace(keyspace)
    ranges = even_split(shards) if isinstance(shards, int) else check_cover([KeyRange.parse(s) for s in shards])
    old, ks.shards = ks.shards, ranges
    changes, counts = {}, {}
    try:
        for table in ks.tables.values():
            if table.kind == "reference" or table.full_name not in engine.store.tables:
                continue
            stored = engine.store.table(table.full_name)
            rows = engine.store.read(stored)
            folders = engine.store.write(table.full_name, engine.writer.checked(engine.writer.placed(table, rows)), stored)
            changes[table.full_name] = stored.of_folders(folders)
            counts[table.full_name] = rows.count()
        engine.store.commit(changes)
    except BaseException:
        ks.shards = old
        raise
    return counts


def compact(engine: Engine, name: str) -> None:
    """Rewrite each shard that has several folders as one."""
    table = engine.vschema.find(name)
    stored = engine.store.table(table.full_name)
    many = [s for s, f in stored.shards.items() if len(f) > 1]
    if many:
        folders = engine.store.write(table.full_name, engine.store.read(stored, many, with_shard=True), stored)
        engine.store.commit({table.full_name: replace(stored, shards={**stored.shards, **{s: [f] for s, f in folders.items()}})})


def status(engine: Engine):
    """Rows of each table on each shard."""
    rows = None
    for name, stored in sorted(engine.store.tables.items()):
        counts = engine.store.read(stored, with_shard=True).groupBy(F.lit(name).alias("table"), F.col(SHARD).alias("shard")).count()
        rows = counts if rows is None else rows.union(counts)
    return rows


def main(args: list[str]) -> int:
    """``python -m shardloom.ctl (apply | validate | status | vacuum | query SQL | explain SQL) CONFIG``"""
    if len(args) < 2:
        print(main.__doc__)
        return 2
    with open(args[-1], encoding="utf-8") as source:
        config = load_config(source.read())
    if args[0] == "validate":
        print("valid")
        return 0
    engine, report = apply(SparkSession.builder.getOrCreate(), config)
    if args[0] == "apply":
        print("\n".join(report))
    elif args[0] == "vacuum":
        print(engine.store.vacuum(), "folders deleted")
    elif args[0] == "status":
        status(engine).show(1000, False)
    else:
        out = engine.sql(("VEXPLAIN " if args[0] == "explain" else "") + args[1])
        out.show(1000, False) if hasattr(out, "show") else print(out.rows_affected)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
