"""Writes: inserts with routing of each row, upserts by key, updates and deletes, sequences, lookups, DDL.

A table's keys are those that its declaration or CREATE TABLE names, over all
shards; without any, no row is in conflict with another. Nulls never are.
Updates and deletes rewrite the shards that hold matching rows and no others;
the new files appear with the manifest that names them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..dialect import ddl
from ..dialect.text import Token, closing, joined, single_statement, split_commas, to_spark
from ..errors import AlreadyExists, Invalid, NotFound, Unsupported
from ..functions.vindex import Lookup
from ..keyrange import Destination, KeyRange, shard_column
from ..plans.coerce import NO, coerced
from ..plans.vschema import ColumnVindex, Table
from ..sources.store import SHARD, Stored

#: Values of a lookup that stand in the statement itself; more go as a table.
IN_STATEMENT = 100


def name_at(parts: list[Token], at: int) -> tuple[str, int]:
    names, end = [parts[at].name or ""], at + 1
    while end + 1 < len(parts) and parts[end].text == ".":
        names.append(parts[end + 1].name or "")
        end += 2
    return ".".join(names), end


def find_word(parts: list[Token], words: tuple[str, ...], start: int = 0) -> int:
    """Where one of the words stands outside all brackets; the length if nowhere."""
    depth = 0
    for i in range(start, len(parts)):
        depth += (parts[i].text == "(") - (parts[i].text == ")")
        if depth == 0 and parts[i].word in words:
            return i
    return len(parts)


@dataclass
class Conflict:
    """What an INSERT does with rows whose keys are there: fail, ignore, replace or update."""

    action: str = "fail"
    target: list[str] | None = None  # columns of the key that counts; all keys without it
    assigned: dict[str, list[Token]] = field(default_factory=dict)
    where: list[Token] = field(default_factory=list)
    new: str | None = None  # name of the new row in what is assigned

    @staticmethod
    def of(parts: list[Token], first: str, ignore: bool) -> tuple[Conflict, list[Token]]:
        """The conflict clause at a statement's end, and the statement without it."""
        depth, at = 0, len(parts)
        for i, t in enumerate(parts[:-1]):
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0 and t.word == "ON" and parts[i + 1].word in ("CONFLICT", "DUPLICATE"):
                at = i
        body, clause = parts[:at], parts[at:]
        if not clause:
            return Conflict("replace" if first == "REPLACE" else "ignore" if ignore else "fail"), body
        out, set_at = Conflict("update"), 4
        if clause[1].word == "CONFLICT":
            out.new = "excluded"
            do = find_word(clause, ("DO",))
            if clause[2].text == "(":
                out.target = [p[0].name.lower() for p in split_commas(clause[3 : closing(clause, 2)])]
            if clause[do + 1 : do + 2] and clause[do + 1].word == "NOTHING":
                return Conflict("ignore", out.target), body
            set_at, end = do + 3, find_word(clause, ("WHERE",), do)
            out.where = clause[end + 1 :]
            clause = clause[:end]
        elif len(body) > 2 and body[-2].word == "AS" and body[-1].name:
            out.new, body = body[-1].name, body[:-2]
        for piece in split_commas(clause[set_at:]):
            eq = next((i for i, t in enumerate(piece) if t.text == "="), None)
            if eq is None:
                raise Unsupported("an upsert sets columns")
            out.assigned[piece[eq - 1].name.lower()] = piece[eq + 1 :]
        return out, body

    def expression(self, tokens: list[Token], table: str) -> str:
        """In columns of the row that is there, and ``__new_`` columns of the new one."""
        out, i = [], 0
        quoted = lambda name: Token("quoted", f"`__new_{name.lower()}`")
        while i < len(tokens):
            t, after = tokens[i], tokens[i + 1 : i + 4]
            if t.word == "VALUES" and len(after) == 3 and after[0].text == "(" and after[2].text == ")":
                out.append(quoted(after[1].name))
                i += 4
            elif t.name and len(after) > 1 and after[0].text == "." and t.name.lower() in ((self.new or "").lower(), table.lower()):
                out.append(after[1] if t.name.lower() == table.lower() else quoted(after[1].name))
                i += 3
            else:
                out.append(t)
                i += 1
        return joined(out)


class Writer:
    def __init__(self, engine):
        self.engine = engine

    @property
    def spark(self):
        return self.engine.spark

    # placement

    def ksid_column(self, table: Table) -> Column:
        if table.kind == "reference" or table.primary is None:
            return F.lit(bytes(8))
        return table.primary.vindex.ksid(*[F.col(f"`{c}`") for c in table.primary.columns])

    def placed(self, table: Table, rows: DataFrame) -> DataFrame:
        """Rows with ``__shard``; null where a row has no shard."""
        ks = self.engine.vschema.keyspace(table.keyspace)
        if not ks.sharded or table.kind == "reference":
            return rows.withColumn(SHARD, F.lit("-"))
        return rows.withColumn("__ksid", self.ksid_column(table)).withColumn(SHARD, shard_column(F.col("__ksid"), ks.shards)).drop("__ksid")

    def load(self, table: Table, rows: DataFrame) -> None:
        placed = self.placed(table, rows)
        known = self.engine.store.tables.get(table.full_name)
        new = Stored(rows.schema.json(), buckets=table.buckets, indexes=dict(known.indexes) if known else {}, keys=known.keys if known and known.keys else table.keys)
        ks = self.engine.vschema.keyspace(table.keyspace)
        folders = self.engine.store.write(table.full_name, self.checked(placed), new, len(ks.shards) if ks.sharded else 1)
        new = new.of_folders(folders)
        self.engine.stage({table.full_name: new}, {(table.keyspace, s) for s in folders})

    @staticmethod
    def checked(placed: DataFrame) -> DataFrame:
        """Fails, when written, at a row that maps to no shard."""
        wrong = F.raise_error(F.lit("a row does not map to a single shard")).cast("string")
        return placed.withColumn(SHARD, F.coalesce(F.col(SHARD), wrong))

    def held(self, rows: DataFrame) -> DataFrame:
        """Rows written aside once, so that what follows sees the same ones."""
        path = f"{self.engine.store.root}/aside/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # INSERT

    def insert(self, parts: list[Token], args: Any = None):
        from ..engine import Result

        at = 1
        ignore = parts[at].word == "IGNORE"
        at += ignore
        at += parts[at].word == "INTO"
        name, at = name_at(parts, at)
        table = self.engine.vschema.find(name, self.engine.keyspace)
        sharded = self.engine.vschema.keyspace(table.keyspace).sharded
        columns = None
        if at < len(parts) and parts[at].text == "(" and parts[at + 1].word not in ("SELECT", "WITH"):
            end = closing(parts, at)
            columns = [p[0].name.lower() for p in split_commas(parts[at + 1 : end])]
            at = end + 1
        if parts[at].word == "SET":
            raise Unsupported("INSERT ... SET is not supported; list columns and values")
        rest, args = to_spark(parts[at:], args)
        conflict, body = Conflict.of(rest, parts[0].word, ignore)
        for piece in (*conflict.assigned.values(), conflict.where):  # expressions take no arguments
            piece[:] = [Token("string", literal(args[t.text[1:]])) if t.kind == "mark" else t for t in piece]
        stored = self.engine.data(table)
        schema = T.StructType(stored.fields)
        if columns is None:
            if sharded and not table.authoritative and self.engine.strict:
                raise Unsupported(f"INSERT into {table.full_name} must list its columns")
            columns = [f.name for f in schema.fields]
        if body[0].word in ("SELECT", "WITH", "("):
            if self.engine.strict and sharded:
                raise Unsupported("INSERT ... SELECT into a sharded table: rows must be routed one by one")
            rows = self.engine.query(body, args)
        else:
            self.check_values(body, len(columns), sharded)
            spark_body, given = to_spark(body, args)
            rows = self.spark.sql(joined(spark_body), args=given) if given else self.spark.sql(joined(spark_body))
        if len(rows.columns) != len(columns):
            raise Invalid(f"{len(rows.columns)} value(s) but {len(columns)} column(s)")
        rows = rows.toDF(*columns)
        kinds = {f.name.lower(): f for f in schema.fields}
        for c in columns:
            if c not in {k.lower() for k in kinds}:
                raise NotFound(f"{table.full_name} has no column {c!r}")
        if sharded and table.primary:
            missing = [c for c in table.primary.columns if c not in columns and c != table.auto_column]
            if missing:
                raise Unsupported(f"INSERT into {table.full_name} lacks its sharding column {missing[0]!r}")
        rows = rows.select(*[(F.col(f"`{f.name.lower()}`") if f.name.lower() in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        # numbered before it is written aside: files come back in any order
        rows, first = self.held(rows.withColumn("__at", F.monotonically_increasing_id())), None
        if table.auto_column and table.sequence:
            rows, first = self.filled(table, rows)
        return Result(self.settled(table, rows, conflict), first)

    def settled(self, table: Table, rows: DataFrame, conflict: Conflict) -> int:
        """Add rows (in the order of ``__at``) as their conflicts allow; how many rows that touched."""
        store, state = self.engine.store, self.engine.data(table).copy()
        keys = self.keys(table, conflict)
        alone, rows = self.one_of_each(rows, keys, conflict.action), rows.drop("__at")
        old = changed = None
        if conflict.action == "fail":
            for key in keys:
                if not self.there(table, state, key, rows).isEmpty():
                    raise AlreadyExists(f"duplicate entry for key ({', '.join(key)}) of {table.full_name}")
        elif conflict.action == "ignore":
            for key in keys:
                alone = alone.join(self.there(table, state, key, rows).select(*key), key, "left_anti")
            rows = self.held(alone.select(*rows.columns)) if keys else rows
        elif keys:
            rows = self.held(alone)
            if conflict.action == "replace":
                old = reduce(DataFrame.union, [self.there(table, state, key, rows) for key in keys])
                old = self.held(old.distinct() if len(keys) > 1 else old)
            else:
                old, changed, rows = self.matched(table, state, keys, rows, conflict)
        n = rows.count()
        touched = {r[SHARD]: r["n"] for r in old.groupBy(SHARD).agg(F.count(F.lit(1)).alias("n")).collect()} if old is not None else {}
        new = rows if changed is None else rows.unionByName(changed.drop(SHARD))
        changes = self.lookup_changes(table, old.drop(SHARD) if touched else None, new, conflict.action == "ignore")
        if touched:
            kept = store.read(state, sorted(touched), with_shard=True)
            for key in keys:
                kept = kept.join(old.select(*key).dropna(), key, "left_anti")
            kept = kept.select(*rows.columns, SHARD)
            folders = store.write(table.full_name, kept if changed is None else kept.unionByName(changed), state)
            for s in touched:
                state.shards[s] = [folders[s]] if s in folders else []
        folders = store.write(table.full_name, self.checked(self.placed(table, rows)), state) if n else {}
        for s, f in folders.items():
            state.shards.setdefault(s, []).append(f)
        self.engine.stage({**changes, table.full_name: state}, {(table.keyspace, s) for s in {*folders, *touched}})
        twice = 1 if self.engine.vschema.keyspace(table.keyspace).dialect != "mysql" and changed is not None else 2
        return n + sum(touched.values()) * (1 if conflict.action == "replace" else twice)

    def keys(self, table: Table, conflict: Conflict) -> list[list[str]]:
        """Keys that count for a statement; unique lookups that the table owns are keys too, which plain inserts leave to them."""
        keys = list(self.engine.data(table).keys or table.keys)
        if conflict.action != "fail":
            owned = [cv.columns for cv in table.vindexes if cv.owner and isinstance(cv.vindex, Lookup) and cv.vindex.unique]
            keys += [c for c in owned if c not in keys]
        if conflict.target is None:
            return keys
        if sorted(conflict.target) not in [sorted(k) for k in keys]:
            raise Unsupported(f"ON CONFLICT names ({', '.join(conflict.target)}), which is no key of {table.full_name}")
        return [conflict.target]

    def one_of_each(self, rows: DataFrame, keys: list[list[str]], action: str) -> DataFrame:
        """Of rows that share a key, the first (when replacing, the last); refused where none may be left out."""
        if action in ("fail", "update"):
            for key in keys:
                if not rows.dropna(subset=key).groupBy(*key).count().where("count > 1").isEmpty():
                    raise AlreadyExists(f"the statement has a key ({', '.join(key)}) twice")
            return rows.drop("__at")
        for key in keys:
            order = Window.partitionBy(*key).orderBy(F.col("__at").desc() if action == "replace" else "__at")
            null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in key])
            rows = rows.withColumn("__n", F.row_number().over(order)).where((F.col("__n") == 1) | null).drop("__n")
        return rows.drop("__at")

    def there(self, table: Table, state: Stored, key: list[str], rows: DataFrame) -> DataFrame:
        """Stored rows, with their shards, that have the key of one of these rows."""
        routed = table.primary is not None and not isinstance(table.primary.vindex, Lookup) and set(table.primary.columns) <= set(key)
        found = self.engine.store.read(state, self.shards_of(table, rows) if routed else None, with_shard=True)
        return found.join(rows.select(*key).dropna().distinct(), key, "left_semi").select(*found.columns)

    def matched(self, table: Table, state: Stored, keys: list[list[str]], rows: DataFrame, conflict: Conflict) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows that are there, the same as they become, and new rows that no row matches."""
        kinds = {f.name.lower(): f for f in state.fields}
        if missing := [c for c in conflict.assigned if c not in kinds]:
            raise NotFound(f"{table.full_name} lacks a column that is set")
        if moved := sorted(set(table.primary.columns if table.primary else []) & set(conflict.assigned)):
            raise Unsupported(f"an upsert of {moved[0]!r} would move the row to another shard")
        pairs = None
        for key in keys:
            fresh = rows.select(*[F.col(f"`{c}`").alias(f"__new_{c.lower()}") for c in rows.columns])
            now = self.there(table, state, key, rows)
            found = now.join(fresh, [now[c] == fresh[f"__new_{c}"] for c in key])
            pairs = found if pairs is None else pairs.union(found)
            rows = rows.join(now.select(*key), key, "left_anti").select(*rows.columns)
        pairs = self.held(pairs.distinct() if len(keys) > 1 else pairs)
        old = pairs.select(*[f"`{f.name}`" for f in state.fields], SHARD)
        if len(keys) > 1 and not old.groupBy(*keys[0]).count().where("count > 1").isEmpty():
            raise Unsupported("two new rows match the same row by different keys")
        values = {kinds[c].name: F.expr(conflict.expression(to_spark(e)[0], table.name)).cast(kinds[c].dataType) for c, e in conflict.assigned.items()}
        if conflict.where:
            wanted = F.coalesce(F.expr(conflict.expression(to_spark(conflict.where)[0], table.name)), F.lit(False))
            pairs = pairs.where(wanted)
            old = pairs.select(*old.columns)
        changed = pairs.select(*[(values[c] if c in values else F.col(f"`{c}`")).alias(c) for c in old.columns])
        return old, self.held(changed), self.held(rows)

    @staticmethod
    def check_values(body: list[Token], width: int, sharded: bool) -> None:
        if not body or body[0].word != "VALUES":
            raise Unsupported("INSERT takes VALUES or a query")
        for row in split_commas(body[1:]):
            if len(split_commas(row[1:-1])) != width:
                raise Invalid(f"{len(split_commas(row[1:-1]))} value(s) but {width} column(s)")
            if sharded and any(t.word and t.word not in ("NULL", "TRUE", "FALSE", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "X", "CAST", "AS") and not t.word.isdigit() for t in row if t.kind == "word") and "CAST" not in [t.word for t in row]:
                raise Unsupported("a value is not a constant")

    # sequences

    def reserve(self, name: str, count: int) -> int:
        """The first of ``count`` numbers of a sequence; its next number is committed at once."""
        table = self.engine.vschema.find(name, self.engine.keyspace)
        store = self.engine.store
        row = store.read(store.table(table.full_name)).where("id = 0").first()
        if row is None:
            raise NotFound(f"sequence {table.full_name} has no row with id 0")
        rows = self.spark.createDataFrame([(0, row["next_id"] + count)], "id long, next_id long")
        folders = store.write(table.full_name, rows.withColumn(SHARD, F.lit("-")))
        store.commit({table.full_name: Stored(rows.schema.json(), {s: [f] for s, f in folders.items()})})
        return row["next_id"]

    def filled(self, table: Table, numbered: DataFrame) -> tuple[DataFrame, int | None]:
        """Null automatic values from the sequence, by ``__at``: an offset for each partition, and the place within."""
        column, rows = table.auto_column, numbered
        empty = F.col(column).isNull()
        part = F.shiftright("__at", 33)
        sizes = {r["p"]: r["n"] for r in numbered.where(empty).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes:
            return rows, None
        first = self.reserve(table.sequence, sum(sizes.values()))
        at, pairs = first, []
        for p in sorted(sizes):
            pairs += [F.lit(p), F.lit(at)]
            at += sizes[p]
        place = F.row_number().over(Window.partitionBy(part, empty).orderBy("__at")) - 1
        number = F.element_at(F.create_map(*pairs), part) + place
        kind = rows.schema[column].dataType
        return self.held(numbered.withColumn(column, F.when(empty, number).otherwise(F.col(column)).cast(kind)).select(*rows.columns)), first

    # lookups

    def lookup_shards(self, vindex: Lookup, keyspace: str, rows: list[tuple]) -> list[KeyRange]:
        """Shards that hold the ids of any of these values, by one look at the table; it gives no more rows than shards or values."""
        table = self.engine.vschema.find(vindex.table, keyspace)
        ks, own = self.engine.vschema.keyspace(table.keyspace), self.engine.vschema.keyspace(keyspace).shards
        data, names = self.engine.data(table), vindex.from_columns
        typed = [tuple(coerced(v, data.types.get(c.lower())) for v, c in zip(row, names)) for row in rows]
        known = not any(v is NO for row in typed for v in row)
        shards = None
        if known and ks.sharded and table.primary and not isinstance(table.primary.vindex, Lookup) and set(table.primary.columns) <= set(names):
            # a sharded lookup: only where the values are
            where = Destination()
            for row in typed:
                place = [row[names.index(c)] for c in table.primary.columns]
                where |= table.primary.vindex.map(*place) if None not in place else Destination()
            shards = where.shards(ks.shards)
        found = self.engine.store.read(data, shards)
        if known and len(rows) > IN_STATEMENT:
            fields = {f.name.lower(): f for f in data.fields}
            wanted = self.spark.createDataFrame(typed, T.StructType([T.StructField(c, fields[c.lower()].dataType) for c in names]))
            found = found.join(F.broadcast(wanted.distinct()), names, "left_semi")
        elif len(names) == 1:
            found = found.where(F.col(f"`{names[0]}`").isin([r[0] for r in rows]))
        else:
            found = found.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(f"`{c}`") == F.lit(v) for c, v in zip(names, row)]) for row in rows]))
        shard = shard_column(vindex.id_column(F.col(f"`{vindex.to_column}`")), own)
        found = found.select(shard.alias("s"))
        # of a unique lookup, values in a statement have a row each at most: no exchange is worth it
        there = {r[0] for r in (found if vindex.unique and len(rows) <= IN_STATEMENT else found.distinct()).collect()}
        return [s for s in own if s.name in there]

    def lookup_changes(self, table: Table, old: DataFrame | None, new: DataFrame | None, ignore: bool = False, only: set[str] | None = None) -> dict[str, Stored]:
        """New states of the lookups that a table owns, for rows that go and come."""
        changes = {}
        for cv in table.vindexes:
            if not cv.owner or not isinstance(cv.vindex, Lookup) or (only is not None and not only & set(cv.columns)):
                continue
            target = self.engine.vschema.find(cv.vindex.table, table.keyspace)
            store, state = self.engine.store, self.engine.data(target).copy()
            if old is not None:
                gone = self.lookup_rows(table, cv, old)
                touched = self.shards_of(target, gone)
                now = store.read(state, touched, with_shard=True)
                kept = now.join(gone, [now[c].eqNullSafe(gone[c]) for c in gone.columns], "left_anti")
                folders = store.write(target.full_name, kept, state)
                for s in touched:
                    state.shards[s] = [folders[s]] if s in folders else []
            if new is not None:
                more = self.lookup_rows(table, cv, new)
                if not cv.vindex.ignore_nulls and more.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cv.vindex.from_columns])).count():
                    raise Invalid(f"a null in lookup {cv.vindex.name!r}")
                more = more.dropna(subset=cv.vindex.from_columns)
                if cv.vindex.unique:
                    keys = cv.vindex.from_columns
                    there = store.read(state, self.shards_of(target, more))
                    twice = more.groupBy(*keys).count().where("count > 1").count() + there.join(more.select(*keys).distinct(), keys, "left_semi").count()
                    if twice and not ignore:
                        raise AlreadyExists(f"duplicate entry in unique lookup {cv.vindex.name!r}")
                whole = more.select(*[(F.col(f"`{f.name}`") if f.name in more.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in state.fields])
                for s, f in store.write(target.full_name, self.checked(self.placed(target, whole)), state).items():
                    state.shards.setdefault(s, []).append(f)
            changes[target.full_name] = state
        return changes

    def shards_of(self, table: Table, rows: DataFrame) -> list[str]:
        """Shards of a table that these rows' sharding columns lead to; all if rows lack them."""
        shards = list(self.engine.data(table).shards)
        if len(shards) < 2 or table.primary is None or not set(table.primary.columns) <= set(rows.columns):
            return shards
        there = {r[0] for r in self.placed(table, rows).select(SHARD).distinct().collect()}
        return [s for s in shards if s in there]

    def lookup_rows(self, table: Table, cv: ColumnVindex, rows: DataFrame) -> DataFrame:
        to = self.ksid_column(table)
        if cv.vindex.hashed:
            to = F.col(f"`{table.primary.columns[0]}`").cast("long")
        return rows.select(*[F.col(f"`{c}`").alias(f) for c, f in zip(cv.columns, cv.vindex.from_columns)], to.alias(cv.vindex.to_column))

    # UPDATE and DELETE

    def update(self, parts: list[Token], args: Any = None):
        name, at = name_at(parts, 1)
        if parts[at].text == "," or find_word(parts, ("FROM", "JOIN")) < len(parts):
            raise Unsupported("an UPDATE of several tables is not supported across shards")
        table = self.engine.vschema.find(name, self.engine.keyspace)
        alias, at = self.alias(parts, at, "SET")
        where = find_word(parts, ("WHERE",), at)
        spark_set, given = to_spark(parts[at + 1 : where], args)
        assigned = {}
        for piece in split_commas(spark_set):
            eq = next(i for i, t in enumerate(piece) if t.text == "=")
            assigned[piece[eq - 1].name.lower()] = joined(piece[eq + 1 :])
        moved = table.primary and set(table.primary.columns) & set(assigned)
        if moved:
            raise Unsupported(f"an UPDATE of {sorted(moved)[0]!r} would move the row to another shard")
        return self.rewrite(table, alias, parts[where + 1 :], args, assigned)

    def delete(self, parts: list[Token], args: Any = None):
        if parts[1].word != "FROM":
            raise Unsupported("a DELETE of several tables is not supported across shards")
        name, at = name_at(parts, 2)
        if at < len(parts) and (parts[at].text == "," or parts[at].word in ("USING", "JOIN")):
            raise Unsupported("a DELETE of several tables is not supported across shards")
        table = self.engine.vschema.find(name, self.engine.keyspace)
        alias, at = self.alias(parts, at, "WHERE")
        return self.rewrite(table, alias, parts[at + 1 :], args, None)

    @staticmethod
    def alias(parts: list[Token], at: int, until: str) -> tuple[str | None, int]:
        alias = None
        while at < len(parts) and parts[at].word != until:
            alias = parts[at].name if parts[at].word != "AS" else alias
            at += 1
        return alias, at

    def rewrite(self, table: Table, alias: str | None, where: list[Token], args: Any, assigned: dict[str, str] | None):
        from ..engine import Result

        where, given = to_spark(where, args)
        probe = [Token("word", w) for w in ("SELECT", "1", "FROM")] + [Token("quoted", f"`{p}`") if i % 2 == 0 else Token("sign", ".") for i, p in enumerate([table.keyspace, ".", table.name])]
        if alias:
            probe += [Token("word", "AS"), Token("quoted", f"`{alias}`")]
        if where:
            probe += [Token("word", "WHERE"), *where]
        routes = self.engine.routes(probe, given)
        found = routes.pop(f"{table.keyspace}.{table.name}".lower())
        stored = self.engine.data(table)

        def marked(shards: list[str]) -> DataFrame:
            """Rows with ``__hit``: whether the condition holds; other tables may stand in its subqueries."""
            rows = self.engine.store.read(stored, shards, with_shard=True)
            test = [Token("sign", "("), *where, Token("sign", ")")] if where else [Token("word", "true")]
            text = [*single_statement("SELECT *, coalesce("), *test, *single_statement(f", false) AS __hit FROM __target AS `{alias or table.name}`")]
            return self.engine.run(text, given, routes, {"__target": rows}).alias(alias or table.name)

        rows = marked(found.shards)
        # a condition that chance or time decides is decided once
        sure = rows._jdf.queryExecution().analyzed().deterministic()
        rows = rows if sure else self.held(rows).alias(alias or table.name)
        for k, v in given.items():  # markers as literals: expressions take no arguments
            assigned = assigned and {c: e.replace(f":{k}", literal(v)) for c, e in assigned.items()}
        condition = F.col("__hit")
        counts = {r[SHARD]: r["n"] for r in rows.where(condition).groupBy(SHARD).agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = sorted(counts)
        if not touched:
            return Result(0)
        rows = marked(touched) if sure else rows.where(F.col(SHARD).isin(touched))
        old = rows.where(condition).drop("__hit")
        if assigned is None:
            kept, new, only = rows.where(~condition).drop("__hit"), None, None
        else:
            kinds = {f.name.lower(): f for f in rows.schema.fields}
            values = {kinds[c].name: F.expr(e).cast(kinds[c].dataType) for c, e in assigned.items() if c in kinds}
            if len(values) != len(assigned):
                raise NotFound(f"{table.full_name} lacks a column that is set")
            kept = rows.select(*[(F.when(condition, values[c]).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in rows.columns if c != "__hit"])
            new, only = old.withColumns(values), set(assigned)
        changes = self.lookup_changes(table, old.drop(SHARD), new.drop(SHARD) if new is not None else None, only=only)
        folders = self.engine.store.write(table.full_name, kept, stored)
        state = stored.copy()
        for s in touched:
            state.shards[s] = [folders[s]] if s in folders else []
        self.engine.stage({**changes, table.full_name: state}, {(table.keyspace, s) for s in touched})
        return Result(sum(counts.values()))

    # DDL

    def ddl(self, parts: list[Token], args: Any = None):
        """Statements that change tables; an open transaction is committed first, as they take effect at once."""
        from ..engine import Result

        statement, kind = parts[0].word, parts[1].word if len(parts) > 1 else ""
        if self.engine.staged is not None:
            self.engine.commit()
        there = any(t.word == "EXISTS" for t in parts[:5])  # IF EXISTS or IF NOT EXISTS
        if kind == "VIEW" or statement == "CREATE" and [t.word for t in parts[1:4]] == ["OR", "REPLACE", "VIEW"]:
            return self.view(statement, parts, args)
        if kind in ("INDEX", "UNIQUE") and statement in ("CREATE", "DROP", "ALTER"):
            return self.index(statement, parts)
        if kind in ("DATABASE", "SCHEMA") and statement in ("CREATE", "DROP"):
            (self.engine.create_keyspace if statement == "CREATE" else self.engine.drop_keyspace)(parts[-1].name, there)
            return Result(0)
        if statement != "TRUNCATE" and kind != "TABLE":
            raise Unsupported(f"cannot route: {joined(parts[:4])}")
        at = find_word(parts, ("TABLE",)) + 1 if kind == "TABLE" else 1
        while parts[at].word in ("IF", "NOT", "EXISTS", "TABLE"):
            at += 1
        if statement in ("DROP", "TRUNCATE"):
            for piece in split_commas(parts[at:]):
                self.emptied(name_at(piece, 0)[0], statement == "DROP", there)
            return Result(0)
        name, end = name_at(parts, at)
        if statement == "CREATE":
            return Result(0, warnings=self.create(name, parts[end:], there))
        if statement == "ALTER":
            return Result(0, warnings=self.alter(self.named(name), parts[end:]))
        raise Unsupported(f"cannot route: {joined(parts[:4])}")

    def named(self, name: str) -> Table:
        if "." not in name and not self.engine.keyspace:
            raise Invalid("no keyspace is in use")
        return self.engine.vschema.find(name, self.engine.keyspace)

    def create(self, name: str, body: list[Token], there: bool) -> list[str]:
        """A new, empty table; in an unsharded keyspace one that the schema does not have, too."""
        if "." not in name and not self.engine.keyspace:
            raise Invalid("no keyspace is in use")
        keyspace, _, own = (name if "." in name else f"{self.engine.keyspace}.{name}").partition(".")
        ks = self.engine.vschema.keyspace(keyspace)
        if not ks.sharded and own.lower() not in ks.tables:
            ks.tables[own.lower()] = Table(ks.name, own.lower())
        table = self.engine.vschema.find(f"{keyspace}.{own}")
        if table.full_name in self.engine.store.tables:
            if there:
                return []
            raise AlreadyExists(f"table {table.full_name} is already there")
        columns, warnings = ddl.spark_columns(body, ks.dialect)
        schema = T.StructType.fromDDL(columns)
        if missing := [c for c in (table.primary.columns if table.primary else []) if c not in schema.names]:
            raise Invalid(f"{table.full_name} lacks its sharding column {missing[0]!r}")
        keys = ddl.unique_keys(body)
        self.engine.store.commit({table.full_name: Stored(schema.json(), buckets=table.buckets, keys=keys or table.keys)})
        return warnings

    def emptied(self, name: str, gone: bool, there: bool) -> None:
        """A table without its rows, or without the table; its own lookups lose them too."""
        store = self.engine.store
        try:
            table = self.named(name)
            stored = store.table(table.full_name)
        except NotFound:
            if there:
                return
            raise NotFound(f"unknown table {name!r}") from None
        changes = {table.full_name: stored.of_folders({})}
        for cv in table.vindexes:
            lookup = self.engine.vschema.find(cv.vindex.table, table.keyspace).full_name if cv.owner and isinstance(cv.vindex, Lookup) else None
            if lookup in store.tables:
                changes[lookup] = store.table(lookup).of_folders({})
        if gone:
            del changes[table.full_name]
            store.tables = {n: t for n, t in store.tables.items() if n != table.full_name}
        store.commit(changes)

    def alter(self, table: Table, change: list[Token]) -> list[str]:
        """Columns that come, go, get another name or type, and keys; several changes, one after the other."""
        warnings: list[str] = []
        for piece in split_commas(change):
            words = [t.word for t in piece]
            stored = self.engine.data(table)
            schema = T.StructType(stored.fields)
            known = {f.name.lower(): f.name for f in schema.fields}
            fixed = {c for cv in table.vindexes for c in cv.columns} | {c for k in stored.keys for c in k} | {c.lower() for c in stored.order}
            at = 2 if len(words) > 1 and words[1] == "COLUMN" else 1
            at += 2 if words[at : at + 2] == ["IF", "EXISTS"] else 0

            def column(name: str, free: bool = True, known=known, fixed=fixed) -> str:
                if name.lower() not in known:
                    raise NotFound(f"{table.full_name} has no column {name!r}")
                if free and name.lower() in fixed:
                    raise Unsupported(f"column {name!r} is part of a sharding function, a key or an index")
                return known[name.lower()]

            def defined(body: list[Token], warnings=warnings) -> T.StructField:
                columns, more = ddl.spark_columns([Token("sign", "("), *body, Token("sign", ")")], self.engine.vschema.keyspace(table.keyspace).dialect)
                warnings += more
                return T.StructType.fromDDL(columns).fields[0]

            if words[0] == "ADD" and (keys := ddl.unique_keys([Token("sign", "("), *piece[1:], Token("sign", ")")])) and words[1] in ddl.CONSTRAINTS:
                self.check_unique(table, stored, keys[0])
                primary = "PRIMARY" in words
                new = replace(stored, keys=[*keys, *stored.keys] if primary else [*stored.keys, *keys])
            elif words[:3] == ["DROP", "PRIMARY", "KEY"] and stored.keys:
                new = replace(stored, keys=stored.keys[1:])
            elif words[0] == "ADD" and words[at - 1] != "CONSTRAINT" and words[1] not in ddl.CONSTRAINTS:
                f = defined(piece[at:])
                if f.name in known:
                    raise AlreadyExists(f"{table.full_name} already has a column {f.name!r}")
                new = replace(stored, schema=schema.add(f).json())
            elif words[0] == "DROP" and piece[at].name and words[1] not in ddl.CONSTRAINTS:
                if "EXISTS" in words and piece[at].name.lower() not in known:
                    continue
                gone = column(piece[at].name)
                new = self.rewritten(table, stored, [(f.name, F.col(f"`{f.name}`")) for f in schema.fields if f.name != gone])
            elif words[0] == "RENAME" and words[1] == "COLUMN" and words[3:4] == ["TO"]:
                was = column(piece[2].name)
                new = self.rewritten(table, stored, [(piece[4].name.lower() if f.name == was else f.name, F.col(f"`{f.name}`")) for f in schema.fields])
            elif words[0] in ("MODIFY", "CHANGE") or words[0] == "ALTER" and "TYPE" in words:
                was = column(piece[at].name)
                body = piece[at:] if words[0] == "MODIFY" else piece[at + 1 :] if words[0] == "CHANGE" else [piece[at], *piece[words.index("TYPE") + 1 :]]
                f = defined(body)
                new = self.rewritten(table, stored, [(f.name, F.col(f"`{g.name}`").cast(f.dataType)) if g.name == was else (g.name, F.col(f"`{g.name}`")) for g in schema.fields])
            else:
                raise Unsupported(f"cannot route: ALTER TABLE {joined(piece[:3])}")
            self.engine.store.commit({table.full_name: new})
        return warnings

    def rewritten(self, table: Table, stored: Stored, columns: list[tuple[str, Column]]) -> Stored:
        """The table with other columns, in new files: old ones would show a dropped column's values if its name came again."""
        rows = self.engine.store.read(stored, with_shard=True).select(*[c.alias(n) for n, c in columns], SHARD)
        new = replace(stored, schema=rows.drop(SHARD).schema.json())
        return new.of_folders(self.engine.store.write(table.full_name, rows, new))

    def check_unique(self, table: Table, stored: Stored, key: list[str]) -> None:
        if missing := [c for c in key if c not in stored.types]:
            raise NotFound(f"{table.full_name} has no column {missing[0]!r}")
        if not self.engine.store.read(stored).dropna(subset=key).groupBy(*key).count().where("count > 1").isEmpty():
            raise AlreadyExists(f"duplicate entry for key ({', '.join(key)}) of {table.full_name}")

    def view(self, statement: str, parts: list[Token], args: Any):
        """A view is its text: reads route its tables anew."""
        from ..engine import Result

        at = find_word(parts, ("VIEW",)) + 1
        while parts[at].word in ("IF", "NOT", "EXISTS"):
            at += 1
        name, end = name_at(parts, at)
        if "." not in name and not self.engine.keyspace:
            raise Invalid("no keyspace is in use")
        name = name if "." in name else f"{self.engine.keyspace}.{name}"
        ks = self.engine.vschema.keyspace(name.partition(".")[0])
        full = f"{ks.name}.{name.partition('.')[2].lower()}"
        if full.partition(".")[2] in ks.tables:
            raise Invalid(f"{full!r} is a table")
        if statement == "DROP":
            if full not in self.engine.store.tables and not any(t.word == "EXISTS" for t in parts[:at]):
                raise NotFound(f"unknown view {full!r}")
            self.engine.store.drop_entry(full)
            return Result(0)
        if statement != "CREATE" or parts[end].word != "AS":
            raise Unsupported(f"cannot route: {joined(parts[:4])}")
        if full in self.engine.store.tables and not any(t.word in ("REPLACE", "EXISTS") for t in parts[:at]):
            raise Invalid(f"view {full!r} is already there")
        if full not in self.engine.store.tables or parts[1].word == "OR":
            schema = self.engine.query(parts[end + 1 :], args).schema.json()
            self.engine.store.commit({full: Stored(schema, view=(self.engine.keyspace, joined(parts[end + 1 :])))})
        return Result(0)

    def index(self, statement: str, parts: list[Token]):
        """An index is an order of the files: its creation rewrites the table, later writes keep to it. A unique one is a key too."""
        from ..engine import Result

        store = self.engine.store
        if statement == "ALTER":
            old, to = parts[2].name, parts[-1].name
            owner = next((n for n, t in store.tables.items() if old in t.indexes and n.partition(".")[0] == (self.engine.keyspace or n.partition(".")[0])), None)
            if [t.word for t in parts[3:5]] != ["RENAME", "TO"]:
                raise Unsupported(f"cannot route: {joined(parts[:4])}")
            if owner is None:
                raise NotFound(f"unknown index {old!r}")
            state = store.table(owner)
            store.commit({owner: replace(state, indexes={to if n == old else n: c for n, c in state.indexes.items()})})
            return Result(0)
        on = find_word(parts, ("ON",))
        if on == len(parts):
            raise Unsupported(f"{statement} INDEX names its table")
        name, (table_name, end) = parts[on - 1].name, name_at(parts, on + 1)
        table = self.engine.vschema.find(table_name, self.engine.keyspace)
        state = self.engine.data(table).copy()
        if statement == "DROP":
            if name not in state.indexes:
                raise NotFound(f"{table.full_name} has no index {name!r}")
            gone = [c.lower() for c in state.indexes[name]]
            state.indexes = {n: c for n, c in state.indexes.items() if n != name}
            state.keys = state.keys[:1] + [k for k in state.keys[1:] if k != gone]
            store.commit({table.full_name: state})
            return Result(0)
        known = {f.name.lower(): f.name for f in state.fields}
        columns = [piece[0].name.lower() for piece in split_commas(parts[end + 1 : closing(parts, end)])]
        if name in state.indexes:
            raise AlreadyExists(f"{table.full_name} already has an index {name!r}")
        if missing := [c for c in columns if c not in known]:
            raise NotFound(f"{table.full_name} has no column {missing[0]!r}")
        if parts[1].word == "UNIQUE":
            self.check_unique(table, state, columns)
            state.keys = [*(state.keys or table.keys or [[]]), columns]
            state.keys = [k for k in state.keys if k]
        rows = store.read(state, with_shard=True)
        state.indexes = {**state.indexes, name: [known[c] for c in columns]}
        store.commit({table.full_name: state.of_folders(store.write(table.full_name, rows, state))})
        return Result(0)


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
