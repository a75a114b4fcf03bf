"""Near copies by the share of shingles that two texts have in common.

Two texts are linked where the Jaccard similarity of their sets of five-word
shingles is ``LEAST`` or more, or their SimHashes differ in few bits (see
``simhash``). All such pairs count, none is sampled: shingles have one order
for all texts, common ones last, and of two texts as similar as that, the first
fifth of one's shingles meets the first fifth of the other's. Pairs that meet
are held against each other by parities of their shingles, which show a least
count of those that they do not share (256 of them as part of the join, as many
as shingles after it), and then by their whole sets.

The smaller of two such sets needs only its first ninth: shingles that no set
has so early lead to no pair, however many texts hold them.

Neighbours in the groups that share a shingle are tried first; after that only
pairs whose ends are not connected yet, so that a group of many near copies
costs its size and not its square. Equal sets are folded before any join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configure, stored, text_of
from .simhash import SEED, components, fingerprint, links

WORDS = 5
#: Least similarity, as a ratio of whole numbers.
LEAST = (4, 5)
#: Texts whose shingles are counted for the order, and shingles that it knows to be common; any order gives the same links.
SAMPLE = 40_000
COMMON = 400_000
#: Neighbours to either side that a text is held against before all others.
AROUND = 3
#: Columns of a sketch: 256 parities, 64 in each.
SKETCH = ("k0", "k1", "k2", "k3")


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 of all shingles of so many words, A-Z lower-cased."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(tokens[i : i + words]), SEED) for i in range(max(1, len(tokens) - words + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles, of which a similar text has one among its own; ``common`` is sorted."""
    top, bottom = LEAST
    n = len(found) - -(-len(found) * top // bottom) + 1 if len(found) else 0
    often = np.zeros(len(found), np.int32)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        often = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, often))[:n]]


def parities(found: np.ndarray) -> bytes:
    """For each low part of a hash, whether an odd number of shingles has it; as many bits as shingles or more, a power of two."""
    bits = max(64, 1 << max(len(found) - 1, 0).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch(found: np.ndarray) -> np.ndarray:
    """As ``parities``, but always of 256 parts: two sketches differ in no more bits than the sets do in shingles."""
    odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_apart(x: bytes, y: bytes) -> int:
    """Shingles that just one of two sets has, at least: each changes one parity. The longer is folded."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a bounded sample of distinct texts hold, and in how many."""
    every = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([shingles(t, words).view(np.int64) for t in part], dtype=object)

    counted = some.select(F.explode(of("text")).alias("s")).groupBy("s").count().where(F.col("count") > 2)
    rows = counted.orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    common, counts = rows["s"].to_numpy().view(np.uint64), np.minimum(rows["count"].to_numpy(), 1 << 30).astype(np.int32)
    order = np.argsort(common)
    return common[order], counts[order]


def similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """The pairs of sets (``a``, ``b``) that are similar enough, with ``fa`` and ``fb``."""
    top, bottom = LEAST
    own = pairs.columns

    @F.pandas_udf("binary")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([shingles(t, words).tobytes() for t in part], dtype=object)

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both * bottom >= top * (len(x) + len(y) - both))
            yield pd.Series(out, dtype=bool)

    @F.pandas_udf("boolean")
    def may_be(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x, y, n, m in batches:  # of sizes n and m, similar sets have so many not in common at most
            yield pd.Series([least_apart(*p) * (top + bottom) <= (bottom - top) * (i + j) for *p, i, j in zip(x, y, n, m)], dtype=bool)

    a, b = (sets.select(F.col("key").alias(n), F.col("size").alias(f"n{n}"), F.col("odd").alias(f"o{n}")) for n in "ab")
    left = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(may_be("oa", "ob", "na", "nb")).select(*own)
    pairs, _ = stored(left, "maybe")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    whole_sets, _ = stored(texts.join(chosen.join(ends, "key").select("__row"), "__row", "left_semi").select("key", "fp", whole("text").alias("set")), "sets")
    a, b = (whole_sets.select(F.col("key").alias(n), F.col("fp").alias(f"f{n}"), F.col("set").alias(f"s{n}")) for n in "ab")
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(alike("sa", "sb")).select(*own, "fa", "fb")


def similar_sets(sets: DataFrame, texts: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """Pairs of ``similar`` that connect whatever similar sets connect.

    ``sets``: ``key``, ``size``, ``odd``, ``prefix`` and sketch of each distinct set; ``texts``: the
    rows by ``__row``; ``chosen``: a row of each set.
    """
    top, bottom = LEAST
    entries = sets.select("key", "size", F.posexplode("prefix").alias("place", "s"))
    # of two sets, the smaller has the shingle so early that what follows can be their common part
    early = F.col("place") * (top + bottom) <= F.col("size") * (bottom - top)
    met = Window.partitionBy("s")
    shared = entries.withColumns({"n": F.count(F.lit(1)).over(met), "any": F.max(early).over(met)}).where("n > 1 and any")
    shared, _ = stored(shared.select("s", "key", "size", "place"), "shared")

    def possible(p: str, q: str):
        """Sizes and places of a shingle leave enough others to have in common; holds for the first one shared."""
        size, place = (lambda x: F.col(f"{x}.size")), (lambda x: F.col(f"{x}.place"))
        rest = F.least(size(p) - place(p), size(q) - place(q))
        return rest * (top + bottom) >= (size(p) + size(q)) * top

    def ordered(p: str, q: str) -> tuple:
        return F.least(f"{p}.key", f"{q}.key").alias("a"), F.greatest(f"{p}.key", f"{q}.key").alias("b")

    # neighbours by size and by chance, and the smallest: they connect most of a group of near copies
    line, chance = met.orderBy("size", "key"), met.orderBy(F.xxhash64("key", F.lit(1)), "key")
    me = F.struct("key", "size", "place")
    around = [F.lag(me, k).over(w) for w in (line, chance) for k in range(1, AROUND + 1)]
    near = shared.select(me.alias("p"), F.array(F.first(me).over(line), *around).alias("near")).select("p", F.explode("near").alias("q"))
    near = near.where(F.col("q").isNotNull() & (F.col("p.key") != F.col("q.key")) & possible("p", "q"))
    tried, _ = stored(near.select(*ordered("p", "q")).distinct(), "tried")
    first, _ = stored(similar(tried, sets, texts, chosen, words), "similar")

    roots = components(first.select("a", "b")).withColumnRenamed("node", "key")
    rooted = shared.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = rooted.withColumns({"low": F.min("root").over(met), "high": F.max("root").over(met)}).where("low <> high").drop("low", "high")
    open_, _ = stored(open_.join(sets.select("key", *SKETCH).hint("merge"), "key"), "open")
    p, q = open_.hint("merge").alias("p"), open_.where(early).hint("merge").alias("q")
    smaller = F.struct("q.size", "q.key") < F.struct("p.size", "p.key")
    apart = (F.col("p.s") == F.col("q.s")) & (F.col("p.root") != F.col("q.root")) & smaller
    swapped = F.col("p.key") > F.col("q.key")
    roots = [F.when(swapped, F.col(f"{y}.root")).otherwise(F.col(f"{x}.root")).alias(n) for x, y, n in (("p", "q", "ra"), ("q", "p", "rb"))]
    bits = sum((F.bit_count(F.col(f"p.{k}").bitwiseXOR(F.col(f"q.{k}"))) for k in SKETCH), F.lit(0))
    alike = bits * (top + bottom) <= (F.col("p.size") + F.col("q.size")) * (bottom - top)
    others = p.join(q, apart & possible("p", "q") & alike).select(*ordered("p", "q"), *roots).distinct().join(tried, ["a", "b"], "left_anti")
    others, _ = stored(others, "others")
    # one pair of each two components connects them
    more = similar(others, sets, texts, chosen, words).groupBy("ra", "rb").agg(F.min_by(F.struct("a", "b", "fa", "fb"), "a").alias("x")).select("x.*")
    return first.union(more)


def without_near_copies(docs: DataFrame, bits: int = 3, bit_words: int = 3, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of linked texts stays: that of the smallest id, nulls last; of equal ids one of them."""
    configure(docs.sparkSession)
    text = text_of(text_col)
    common, counts = common_shingles(docs.select(text.alias("text")), words)

    @F.pandas_udf("fp long, key long, size int, odd binary, prefix array<long>, k0 long, k1 long, k2 long, k3 long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                found = shingles(t, words)
                rows.append((fingerprint(t, bit_words), xxhash.xxh64_intdigest(found.tobytes(), SEED), len(found), parities(found), prefix(found, common, counts).view(np.int64), *sketch(found).tolist()))
            fp, key, size, odd, first, *bits = zip(*rows) if rows else ((),) * 9
            yield pd.DataFrame({"fp": np.array(fp, np.uint64).view(np.int64), "key": np.array(key, np.uint64).view(np.int64), "size": np.array(size, np.int32), "odd": pd.Series(odd, dtype=object), "prefix": pd.Series(first, dtype=object)} | {k: np.array(b, np.int64) for k, b in zip(SKETCH, bits)})

    numbered, _ = stored(docs.withColumns({"__row": F.monotonically_increasing_id(), "__p": prints(text)}), "numbered")
    slim = numbered.select(F.col(f"`{id_col}`").alias("doc_id"), "__row", "__p.fp", "__p.key", "__p.size", "__p.odd", "__p.prefix", *[f"__p.{k}" for k in SKETCH])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("__row"))
    best, _ = stored(slim.groupBy("fp").agg(F.min(order).alias("best")), "best")

    # one row of each set stands for it; its prints are one component anyway
    chosen, _ = stored(slim.groupBy("key").agg(F.min("__row").alias("__row"), F.min("fp").alias("low"), F.max("fp").alias("high")), "chosen")
    several = slim.join(chosen.where("low <> high").select("key", "low"), "key").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    ones, _ = stored(slim.join(chosen.select("__row"), "__row", "left_semi").select("key", "size", "odd", "prefix", *SKETCH), "ones")
    texts = numbered.select("__row", "__p.key", "__p.fp", text.alias("text"))
    pairs = similar_sets(ones, texts, chosen.select("key", "__row"), words).select(F.col("fa").alias("a"), F.col("fb").alias("b"))

    roots = components(links(best.select("fp"), bits).union(pairs).union(several)).withColumnRenamed("node", "fp")
    kept = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.__row").alias("__row"))
    return numbered.join(kept, "__row", "left_semi").drop("__row", "__p")
