"""SimHash near-duplicates by deletion-variant signatures.

Texts with 64-bit fingerprints of at most ``bits`` differing bits are linked.
A fingerprint is cut into (bits + 2) // 2 segments; of two linked ones, some
segment differs in at most one bit. Each segment is indexed under its variants
with one bit blanked; equal variants join, and the join verifies the distance.
Only distinct fingerprints are indexed, joined and connected, so that copies
cost nothing there. Components come from rounds of large and small stars, each
written to the shared folder.

A null text is the empty text; texts without words have fingerprint 0. Ids may
repeat or be null: each row has its own result, the smallest id of a component
ignores nulls and is null only where no row of it has an id. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configure, remove, stored, text_of

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Fingerprints whose variants one task makes.
INDEXED_BY_TASK = 50_000


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 of all shingles of so many words, A-Z lower-cased."""
    tokens = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for start in range(0, n, BLOCK):
        hashes = b"".join([digest(b" ".join(tokens[i : i + words]), SEED) for i in range(start, min(start + BLOCK, n))])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """The fingerprint as a long with the same 64 bits."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, size) of the (bits + 2) // 2 segments of a fingerprint, two at least."""
    n = max(2, (bits + 2) // 2)
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints (column ``fp`` of a table) of at most ``bits`` differing bits.

    The index is dealt out once, by place and what is left of the segment; only
    places that several fingerprints share are kept, and joined with themselves.
    """
    cuts = segments(bits)
    keys = []
    for k, (low, size) in enumerate(cuts):
        segment = F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << size) - 1))
        keys += [segment.bitwiseAND(F.lit(((1 << size) - 1) ^ (1 << bit))).bitwiseOR(F.lit((64 * k + bit) << 32)) for bit in range(size)]
    # few bytes become many rows: by a hash of its own, as a table dealt by fp already would stay as it is
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() // INDEXED_BY_TASK))
    index = prints.select("fp").repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(F.array(*keys)).alias("key"))
    met = index.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").select("key", "fp")
    met, _ = stored(met, "met")
    # small files may stand for many rows: no side is sent whole, and adaptive execution splits a hot key
    a, b = met.hint("merge").alias("a"), met.hint("merge").alias("b")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # a pair counts once: in the first segment that differs in at most one bit, and there, if it is equal, under the first blanked bit
    counts, before = F.lit(False), F.lit(True)
    for k, (low, size) in enumerate(cuts):
        differs = F.shiftrightunsigned(apart, low).bitwiseAND(F.lit((1 << size) - 1))
        place = F.shiftright("a.key", 32)
        counts = counts | before & ((place == 64 * k) | (F.floor(place / 64) == k) & (differs != 0))
        before = before & (F.bit_count(differs) > 1)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(apart) <= bits) & counts)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of each node of edges ``a``, ``b``.

    Large-star and small-star rounds until nothing changes; each round's edges
    are a table in the shared folder.
    """
    spark = edges.sparkSession

    def stars(directed: DataFrame, with_self: bool) -> DataFrame:
        """From (u, v): each v with u's smallest neighbour or u itself."""
        lowest = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = directed.join(lowest, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        if with_self:
            out = out.union(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, path = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = state(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        after, next_path = stored(stars(large, True), "links")
        remove(spark, path)
        last, seen = seen, state(after)
        now, path = after, next_path
        if seen == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def grouped(prints: DataFrame, bits: int = 3) -> DataFrame:
    """``fp`` and ``component_id`` of a table of (doc_id, fp) rows."""
    distinct, _ = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row."""
    configure(docs.sparkSession)
    prints, _ = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_column(text_of(text_col), words).alias("fp")), "fingerprints")
    out = prints.join(grouped(prints, bits), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays: that of the smallest id, nulls last; of equal ids one of them."""
    configure(docs.sparkSession)
    numbered, _ = stored(docs.withColumns({"__row": F.monotonically_increasing_id(), "__fp": fingerprint_column(text_of(text_col), words)}), "numbered")
    slim = numbered.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("__fp").alias("fp"), "__row")
    # smallest id and row of each fingerprint first: copies are folded before any join
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("__row"))
    best, _ = stored(slim.groupBy("fp").agg(F.min(order).alias("best")), "best")
    roots = components(links(best.select("fp"), bits)).withColumnRenamed("node", "fp")
    kept = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.__row").alias("__row"))
    return numbered.join(kept, "__row", "left_semi").drop("__row", "__fp")
