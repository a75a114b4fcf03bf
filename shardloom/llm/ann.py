"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash of a table is floor((a.v + b) / width) for several Gaussian directions
a; a bucket is the tuple of them. A query visits buckets in the order of the
estimated chance that they hold a near neighbour, until the chances that its
tables have added up give the wanted recall. All tables' candidates are merged
and ranked by exact distance in double precision.

Queries are stored with the buckets they visit, in blocks of bounded size. Each
task hashes its rows, reads block after block, and compares what has met: no
vector is shuffled, and of a block of rows each query's nearest alone go on.

The estimate is fitted on a bounded sample (``Settings.sample`` rows of
smallest hash): how a near neighbour's projection follows from the query's.
Every row is hashed, in every table.

Vectors that are null, empty, zero, of another length than most (the smaller of
two lengths as frequent), or hold null or non-finite components take no part, as rows or queries. Equal
distances go to the smaller id; rows of equal ids and distances count once. A
query's own row is no candidate, nor is any row with its id. A query whose probes cannot
reach the aim, or that met fewer than ``k`` candidates, is held against all rows
in the same way. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configure, stored


@dataclass(frozen=True)
class Settings:
    tables: int = 12
    width: float = 2.5  # of a hash cell, in standard deviations of the projections
    bucket_rows: float = 20.0  # rows that a bucket should hold: sets the hashes of a table
    recall: float = 0.975
    sample: int = 2000
    reach: int = 2  # cells to either side that probes may go, of each hash
    most_probes: int = 1024  # of a table; a query that needs more is held against all rows
    queries_at_once: int = 512  # of a block
    rows_at_once: int = 1 << 13  # that are held against a block of queries together
    held_bytes: int = 64 << 20  # of vectors that a task holds while it reads the queries
    seed: int = 3


@dataclass
class Hashes:
    directions: np.ndarray  # (tables, hashes, size)
    offsets: np.ndarray  # (tables, hashes)
    centre: np.ndarray  # mean of the sample
    width: float
    follow: float  # slope of a near neighbour's projection by the query's
    spread: float  # its standard deviation
    deviation: float  # standard deviation of all rows' projections
    settings: Settings

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """(tables, rows, hashes)"""
        return np.einsum("nd,thd->tnh", vectors - self.centre, self.directions)

    def cells(self, projected: np.ndarray) -> np.ndarray:
        return np.floor((projected + self.offsets[:, None]) / self.width).astype(np.int64)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """Buckets (tuples along the last axis) as 64-bit numbers."""
        out = np.zeros(cells.shape[:-1], np.uint64)
        for k in range(cells.shape[-1]):
            out = (out ^ cells[..., k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def probes(self, vector: np.ndarray) -> list[np.ndarray] | None:
        """Bucket keys to visit in each table, best first; None if too few reach the aim."""
        s = self.settings
        aim = 1 - (1 - s.recall) ** (1 / s.tables)
        projected = self.projected(vector[None])[:, 0]
        cells = self.cells(projected[:, None])[:, 0]
        steps = np.arange(-s.reach, s.reach + 1)
        low = (cells[:, :, None] + steps) * self.width - self.offsets[:, :, None]
        mean = self.follow * projected[:, :, None]
        chance = normal((low + self.width - mean) / self.spread) - normal((low - mean) / self.spread)
        share = normal((low + self.width) / self.deviation) - normal(low / self.deviation)
        worth = chance / np.maximum(share, 1e-12)
        best, held, visited = np.ones((s.tables, 1)), np.ones((s.tables, 1)), np.zeros((s.tables, 1, 0), np.int64)
        every = np.arange(s.tables)[:, None]
        for h in range(chance.shape[1]):  # the likeliest of all hashes so far extend to the likeliest of one more
            holds = (held[:, :, None] * chance[:, None, h]).reshape(s.tables, -1)
            worths = (best[:, :, None] * worth[:, None, h]).reshape(s.tables, -1)
            n = min(s.most_probes, holds.shape[1])
            keep = np.argpartition(-holds, n - 1, axis=1)[:, :n]
            best, held = worths[every, keep], holds[every, keep]
            cell = cells[:, h, None] + steps[keep % len(steps)]
            visited = np.concatenate([visited[every, keep // len(steps)], cell[:, :, None]], 2)
        order = np.argsort(-best, axis=1)
        n = (np.cumsum(held[every, order], axis=1) < aim).sum(1) + 1
        if (n > best.shape[1]).any():
            return None
        return [self.keys(v[o[:m]]) for v, o, m in zip(visited, order, n)]


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, within 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def fit(vectors: np.ndarray, rows: int, k: int, s: Settings) -> Hashes:
    """Hashes for a table of so many rows, from sample vectors."""
    rng = np.random.default_rng(s.seed)
    centre = vectors.mean(0)
    x = vectors - centre
    scale = max(float(np.sqrt((x**2).sum(1).mean() / x.shape[1])), 1e-12)  # of a projection
    width = s.width * scale
    hashes = int(np.clip(np.round(np.log2(max(rows, 2) / s.bucket_rows) / cell_bits(s.width)), 1, 30))
    directions = rng.normal(size=(s.tables, hashes, x.shape[1]))
    offsets = rng.uniform(0, width, (s.tables, hashes))
    follow, spread = 1.0, scale
    if len(x) > k + 1:
        some = x[: min(len(x), 500)]
        apart = ((some**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * some @ x.T).clip(0)
        # the sample is thinner than the table: its nearest rows stand for the table's k nearest
        near = np.argsort(apart, axis=1)[:, 1:2]
        a, b = some, x[near].reshape(-1, x.shape[1])
        follow = float((a * b).sum() / max((a * a).sum(), 1e-12))
        spread = max(float(np.sqrt(((b - follow * a) ** 2).sum(1).mean() / x.shape[1])), 1e-3 * scale)
    root = np.sqrt(x.shape[1])
    # a Gaussian direction gives a vector's length as the deviation of its projection
    return Hashes(directions, offsets * root, centre, width * root, follow, spread * root, scale * root, s)


def cell_bits(width: float) -> float:
    """Entropy, in bits, of the cell of a standard normal variable."""
    edges = np.arange(-8, 8, width)
    p = normal(edges + width) - normal(edges)
    return float(-(p * np.log2(np.maximum(p, 1e-300))).sum())


def usable(vector: Column) -> Column:
    """A non-zero vector of finite components."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0), F.lit(False))


def best_rows(query_ids, queries, ids, vectors, met, k: int) -> tuple[np.ndarray, ...]:
    """Triples (query id, id, distance) with the ``k`` nearest of the rows that each query has ``met`` (a matrix).

    Products find them, differences give their distances. Rows of equal ids are
    no reason to leave out others: as many more are let through.
    """
    apart = (queries**2).sum(1)[:, None] + (vectors**2).sum(1) - 2 * queries @ vectors.T
    apart[~met | (query_ids[:, None] == ids)] = np.inf
    least = k + len(ids) - len(np.unique(ids))
    limit = np.partition(apart, least - 1, axis=1)[:, least - 1] if len(ids) > least else np.full(len(queries), np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(limit), limit, 0)) + (queries**2).sum(1) + (vectors**2).sum(1).max())
    q, r = np.nonzero((apart <= (limit + slack)[:, None]) & (apart < np.inf))
    d = np.empty(len(q))
    for start in range(0, len(q), 1 << 15):
        part = slice(start, start + (1 << 15))
        d[part] = np.sqrt(((queries[q[part]] - vectors[r[part]]) ** 2).sum(1))
    return query_ids[q], ids[r], d


def nearest(parts: list[tuple[np.ndarray, ...]], k: int) -> pa.RecordBatch:
    """Of triples, each query's ``k`` nearest; equal ones once."""
    q, r, d = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((r, d, q))
    q, r, d = q[order], r[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (d[1:] != d[:-1])
    q, r, d = q[new], r[new], d[new]
    first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1)) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    kept = place < k
    return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (q, r, d)], ["query_id", "vec_id", "score"])


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and vectors of one length, of a batch."""
    ids = batch.column("vec_id").to_numpy()
    return ids, batch.column("v").flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)


def top(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best of distinct (query, row) pairs."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def visits(queries: DataFrame, hashes, settings: Settings, everything: bool) -> DataFrame:
    """Queries in blocks: ``ids`` and ``data``, and the buckets they visit: ``table``, ``key`` and ``row`` of each, in the order of key.

    ``whole`` marks queries that are held against all rows: those whose probes
    cannot reach the aim, or (``everything``) all.
    """

    def block(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        h = hashes.value
        keys, tables, rows, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(ids), bool)
        for i, v in enumerate(vectors):
            probes = None if everything else h.probes(v)
            whole[i] = probes is None
            for t, found in enumerate(probes or []):
                keys.append(found)
                tables.append(np.full(len(found), t))
                rows.append(np.full(len(found), i))
        key, table, row = (np.concatenate(x) for x in (keys, tables, rows))
        order = np.lexsort((key, table))
        values = (ids, vectors, table[order].astype(np.int16), key[order], row[order].astype(np.int32), whole)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in values], ["ids", "data", "table", "key", "row", "whole"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = rows_of(batch)
            for start in range(0, len(ids), settings.queries_at_once):
                part = slice(start, start + settings.queries_at_once)
                yield block(ids[part], vectors[part])

    return queries.mapInArrow(blocks, "ids binary, data binary, table binary, key binary, row binary, whole binary")


def met_rows(asked: dict, keys: np.ndarray) -> np.ndarray:
    """(queries, rows): whether a query visits one of the buckets of a row; ``keys`` has those, by table."""
    met = np.repeat(np.frombuffer(asked["whole"], bool)[:, None], keys.shape[1], 1)
    table, key, row = (np.frombuffer(asked[n], kind) for n, kind in (("table", np.int16), ("key", np.int64), ("row", np.int32)))
    for t, own in enumerate(keys):
        part = slice(*np.searchsorted(table, [t, t + 1]))
        visited, who = key[part], row[part]
        first, last = (np.searchsorted(visited, own, side) for side in ("left", "right"))
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        met[who[at], np.repeat(np.arange(len(own)), n)] = True
    return met


def read_blocks(files: list[str]) -> Iterator[dict]:
    """The stored query blocks, one after the other, from the folder that all executors share."""
    for name in files:
        store, place = fs.FileSystem.from_uri(name)
        with store.open_input_file(place) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                yield batch.to_pylist()[0]


def against(vectors: DataFrame, asked: DataFrame, hashes, k: int, settings: Settings) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: of each block of rows and block of queries, the ``k`` nearest of those met.

    Vectors stay where they are read: the few queries come to them, block by block.
    """
    files = asked.inputFiles()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, held, n = hashes.value, [], 0

        def compared() -> Iterator[pa.RecordBatch]:
            ids, data = (np.concatenate([x[i] for x in held]) for i in range(2))
            keys = h.keys(h.cells(h.projected(data)))
            for block in read_blocks(files):
                query_ids = np.frombuffer(block["ids"], np.int64)
                queries, out = np.frombuffer(block["data"], np.float64).reshape(len(query_ids), -1), []
                for start in range(0, len(ids), settings.rows_at_once):
                    part = slice(start, start + settings.rows_at_once)
                    out.append(best_rows(query_ids, queries, ids[part], data[part], met_rows(block, keys[:, part]), k))
                yield nearest(out, k)

        for batch in batches:
            if batch.num_rows:
                held.append(rows_of(batch))
                n += held[-1][1].nbytes
            if n >= settings.held_bytes:
                yield from compared()
                held.clear()
                n = 0
        if held:
            yield from compared()

    return vectors.mapInArrow(near, "query_id long, vec_id long, score double")


def search(rows: DataFrame, is_query: Column, k: int = 10, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean distance) of the nearest found."""
    spark = rows.sparkSession
    configure(spark)
    vectors = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull()).where(usable(F.col("v")))
    sizes = vectors.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, total = sizes[0]
    vectors = vectors.where(F.size("v") == size)
    sample = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(settings.sample).toArrow()
    sample = np.concatenate([rows_of(b)[1] for b in sample.to_batches()])
    hashes = spark.sparkContext.broadcast(fit(sample, total, k, settings))  # of fixed size
    own, queries = vectors.select("vec_id", "v"), vectors.where(F.col("q")).select("vec_id", "v")

    def found(some: DataFrame, everything: bool) -> DataFrame:
        asked, _ = stored(visits(some, hashes, settings, everything), "visits")
        return stored(top(against(own, asked, hashes, k, settings), k).select("query_id", "rank", "vec_id", "score"), "neighbours")[0]

    best = found(queries, False)
    # queries that met too few rows, against all rows
    wanted = min(k, total - 1)
    enough = best.groupBy("query_id").count().where(F.col("count") >= wanted).select(F.col("query_id").alias("vec_id"))
    short, _ = stored(queries.join(enough, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        best = best.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").union(found(short, True))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
