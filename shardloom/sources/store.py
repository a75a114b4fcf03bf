"""A versioned store of sharded tables.

Data are Parquet files below ``root``, written shard by shard; a manifest says
which folders hold each shard of each table. A commit writes the next numbered
manifest, which must not exist yet: all tables and shards of a transaction
appear at once, and of two writers that started from the same manifest one is
refused. Files go through Hadoop's file systems, as Spark's own do.

Who is first is decided by the file system: a link that must not exist yet on
local disks, a rename that does not overwrite elsewhere.

A table may be bucketed: each of its folders then holds files by hash of the
sharding columns, and reads go through a session table that says so. Joins and
groupings on those columns need no exchange, whichever shards are read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import OrderedDict
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, NotFound

SHARD, KSID = "__shard", "__ksid"
#: Parts of a shard that are written apart, so that few shards still make many tasks.
PARTS = 8
#: Shards up to which a task writes all of its rows where they are, with a file open for each shard.
OPEN_FILES = 16
#: Tables and parts of them whose plans are kept: their files are listed once.
REMEMBER = 256


@lru_cache(maxsize=1024)
def struct(schema: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(schema))


@dataclass
class Stored:
    """A table's schema and, for each shard, its folders.

    ``buckets`` (number, columns) holds for all folders. ``indexes`` are columns by index name: files are sorted by
    them, so that Parquet's statistics let scans skip row groups. ``keys`` are columns that no two rows share, the
    primary key first. A view has its keyspace and text in ``view``.
    """

    schema: str
    shards: dict[str, list[str]] = field(default_factory=dict)
    buckets: tuple[int, list[str]] | None = None
    indexes: dict[str, list[str]] = field(default_factory=dict)
    view: tuple[str | None, str] | None = None
    keys: list[list[str]] = field(default_factory=list)

    @property
    def fields(self) -> list[T.StructField]:
        return list(struct(self.schema).fields)

    @property
    def types(self) -> dict[str, T.DataType]:
        return {f.name.lower(): f.dataType for f in self.fields}

    @property
    def order(self) -> list[str]:
        return list(dict.fromkeys(c for columns in self.indexes.values() for c in columns))

    def copy(self) -> Stored:
        return replace(self, shards={k: list(v) for k, v in self.shards.items()})

    def of_folders(self, folders: dict[str, str]) -> Stored:
        """The same table with these folders alone."""
        return replace(self, shards={s: [f] for s, f in folders.items()})


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        self.version, self.tables = self.latest()
        #: Session tables of bucketed states that have all their partitions.
        self._complete: set[str] = set()
        self._frames: OrderedDict[tuple, DataFrame] = OrderedDict()

    # manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> tuple[int, dict[str, Stored]]:
        known = self.versions()
        if not known:
            return 0, {}
        return known[-1], self.manifest(known[-1])

    def refresh(self) -> None:
        self.version, self.tables = self.latest()

    def commit(self, tables: dict[str, Stored]) -> None:
        """Publish these tables' new states together."""
        new = {**self.tables, **tables}
        text = json.dumps({n: asdict(t) for n, t in new.items()})
        whole = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(whole, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if not self.published(whole, f"{self.root}/manifests/{self.version + 1}.json"):
                raise Conflict("another transaction was committed meanwhile")
        finally:
            self._fs.delete(whole, False)
        self.version, self.tables = self.version + 1, new

    def published(self, whole, target: str) -> bool:
        """Give a finished file its name, unless there is one; of several writers exactly one succeeds."""
        jvm = self.spark.sparkContext._jvm
        try:
            if self._fs.getScheme() == "file":
                plain = lambda path: jvm.java.io.File(self._path.getPathWithoutSchemeAndAuthority(path).toString()).toPath()
                jvm.java.nio.file.Files.createLink(plain(self._path(target)), plain(whole))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(whole, self._path(target), options)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def drop_entry(self, name: str) -> None:
        """Publish a state without this name."""
        self.tables = {n: t for n, t in self.tables.items() if n != name}
        self.commit({})

    # tables

    def table(self, name: str) -> Stored:
        if name not in self.tables:
            raise NotFound(f"table {name!r} has no data")
        return self.tables[name]

    def read(self, table: Stored, shards: list[str] | None = None, with_shard: bool = False) -> DataFrame:
        """Rows of the shards; folders of others are not even listed."""
        parts = [(s, table.shards.get(s, [])) for s in (table.shards if shards is None else shards)]
        key = (table.schema, str(table.buckets and sorted(table.shards.items())), str(parts), with_shard)
        if key not in self._frames:
            self._frames[key] = self.frame(table, parts, with_shard)
            while len(self._frames) > REMEMBER:
                self._frames.popitem(last=False)
        self._frames.move_to_end(key)
        return self._frames[key]

    def frame(self, table: Stored, parts: list[tuple[str, list[str]]], with_shard: bool) -> DataFrame:
        schema = struct(table.schema)
        if table.buckets and any(p for _, p in parts):
            found = self.bucketed(table).where(F.col(SHARD).isin([s for s, p in parts if p]))
            return found.select(*[F.col(f"`{c}`") for c in [*schema.names, *([SHARD] if with_shard else [])]])
        paths = [x for _, p in parts for x in p]
        if not paths:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(SHARD, F.lit("")) if with_shard else empty
        rows = self.spark.read.schema(schema).parquet(*paths)
        if not with_shard:
            return rows
        shard = F.regexp_extract(F.col("_metadata.file_path"), f"{SHARD}=([^/]+)/[^/]+$", 1)  # attached files have none
        return rows.select("*", F.when(shard == "", "-").otherwise(shard).alias(SHARD))

    @staticmethod
    def session_table(table: Stored) -> str:
        state = json.dumps([table.schema, sorted(table.shards.items()), table.buckets])
        return "buckets_" + hashlib.md5(state.encode()).hexdigest()

    def bucketed(self, table: Stored) -> DataFrame:
        """The session table of a bucketed state: a partition for each folder, none listed before it is read."""
        name = self.session_table(table)
        if name not in self._complete:
            number, columns = table.buckets
            by = ", ".join(f"`{c}`" for c in columns)
            fields = self.spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(table.schema).asNullable().toDDL()
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({fields}, {SHARD} STRING, __part INT) USING parquet PARTITIONED BY ({SHARD}, __part) "
                f"CLUSTERED BY ({by}) INTO {number} BUCKETS LOCATION '{self.root}/empty'"
            )
            parts = [f"PARTITION ({SHARD} = '{s}', __part = {k}) LOCATION '{f}'" for s, folders in table.shards.items() for k, f in enumerate(folders)]
            for k in range(0, len(parts), 500):
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(parts[k : k + 500])}")
            self._complete.add(name)
        return self.spark.table(name)

    @contextmanager
    def set_to(self, key: str, value: str):
        """A setting of the session meanwhile."""
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, value)
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, before)

    def write(self, name: str, rows: DataFrame, like: Stored | None = None, shards: int | None = None) -> dict[str, str]:
        """Write rows that have a ``__shard`` column, laid out as ``like``; the new folder of each shard that has any.

        Where so few ``shards`` are said to come that each task can hold a file of each open, no row is moved or sorted.
        """
        buckets, order = (like.buckets, like.order) if like else (None, [])
        folder = f"{self.root}/{name.replace('.', '/')}/{uuid.uuid4().hex}"
        if buckets:
            number, columns = buckets
            aside = f"writing_{uuid.uuid4().hex}"
            dealt = rows.repartition(number, *[F.col(f"`{c}`") for c in columns])  # as buckets are: one file of each
            dealt.write.format("parquet").partitionBy(SHARD).bucketBy(number, *columns).sortBy(*(order or columns)).option("path", folder).saveAsTable(aside)
            self.spark.sql(f"DROP TABLE {aside}")  # the files stay
        elif not order and shards is not None and shards <= OPEN_FILES:
            with self.set_to("spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
                rows.write.partitionBy(SHARD).parquet(folder)
        else:
            # not a file for each shard and task: rows meet by shard and part, and what is large is split by size
            hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))]
            rows = rows.withColumn("__part", F.pmod(F.xxhash64(*hashed), F.lit(PARTS))).hint("rebalance", SHARD, "__part").drop("__part")
            if order:
                rows = rows.sortWithinPartitions(SHARD, *[F.col(f"`{c}`") for c in order])
            rows.write.partitionBy(SHARD).parquet(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        mark = SHARD + "="
        decode = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {decode(n[len(mark) :]): f"{folder}/{n}" for n in found if n.startswith(mark)}

    def manifest(self, version: int) -> dict[str, Stored]:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return {n: Stored(**t) for n, t in json.loads(text).items()}

    def vacuum(self, keep: int = 10, hours: float = 24) -> int:
        """Delete what none of the last ``keep`` manifests names, and older manifests; the number of folders deleted.

        Session tables of such states of bucketed tables go too. Folders changed within ``hours`` stay: they may belong to a transaction that is still open.
        """
        versions = self.versions()
        states = [t for v in versions[-max(1, keep) :] for t in self.manifest(v).values()]
        named = {f for t in states for folders in t.shards.values() for f in folders}
        for old in self._complete - {self.session_table(t) for t in states if t.buckets}:
            self.spark.sql(f"DROP TABLE IF EXISTS {old}")
            self._complete.discard(old)
        self._frames.clear()
        jvm, gone = self.spark.sparkContext._jvm, 0
        before = jvm.java.lang.System.currentTimeMillis() - hours * 3_600_000
        bare = lambda f: jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(self._path(f)).toString()
        used = {bare(f) for f in named}

        def below(path):
            return [s for s in self._fs.listStatus(path) if s.isDirectory()]

        for keyspace in below(self._path(self.root)):
            name = keyspace.getPath().getName()
            if name == "manifests":
                continue
            # of inserts, written aside once; of tables, one folder of shards for each write
            writes = below(keyspace.getPath()) if name == "aside" else [w for table in below(keyspace.getPath()) for w in below(table.getPath())]
            for write in writes:
                if write.getModificationTime() >= before:
                    continue
                shards = below(write.getPath())
                left = [s for s in shards if bare(s.getPath().toString()) in used]
                for path in [s.getPath() for s in shards if s not in left] if left else [write.getPath()]:
                    gone += bool(self._fs.delete(path, True))
        for v in versions[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v}.json"), False)
        return gone
