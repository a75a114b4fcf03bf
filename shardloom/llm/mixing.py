"""Mixing sources to target weights by systematic sampling, in SQL functions only.

Sources, in order of their code points with null last, get the weights in
turn. The whole mix is ``share`` of all sizes; a source's target stops at
``most`` times its size and what exceeds that is shared again by weight, until
no source is above. A document's expected copies are target over size of its
source. Within a source, in a fixed order, expected copies add up to a prefix
sum; with one random offset for the source, a document is emitted once for
each whole number that its interval crosses. So copies differ from their
expectation by less than one, and each source's total by about a document.

The order goes by size (in steps of a sixteenth of a doubling), then by a hash
of the id, then by id, size and a hash of the whole row. It is cut into blocks
by the first two. Their counts are summed by step and within each step, so that
no task sees more than one block, one step's blocks or one source's steps,
which are some hundreds each. Ids need not be unique or set.

Nulls: a null source is a source of its own, a null size counts as 0, null ids
come first in their block (``part`` may deal them out by another column). A source without any size has target 0 and no
copies. Repeated rows are rows of their own. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, text_of

KEYS = ("__no_source", "__source", "__step", "__part")


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def source_targets(docs: DataFrame, source: Column, size: Column, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row a source: ``__no_source``, ``__source``, ``source_size``, ``target``."""
    sums = (
        docs.groupBy(source.isNull().alias("__no_source"), F.coalesce(source, F.lit("")).alias("__source"))
        .agg(F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("source_size"))
        .withColumn("__rank", F.row_number().over(Window.orderBy("__no_source", "__source")) - 1)
        .withColumn("__weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int")))
        .withColumn("__cap", F.lit(float(most)) * F.col("source_size"))
    )
    # by rising cap for a weight, those capped come first: one is if the level that
    # the rest would share, with all before it capped, is above its own cap
    rising = Window.orderBy(F.col("__cap") / F.col("__weight"), "__no_source", "__source")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        sums.withColumn("__all", F.sum("source_size").over(everything))
        .withColumn("__level", (F.lit(float(share)) * F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(after))
        .withColumn("__capped", F.col("__level") * F.col("__weight") >= F.col("__cap"))
        .withColumn("__common", F.max(F.when(~F.col("__capped"), F.col("__level"))).over(everything))
    )
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("__common") * F.col("__weight"))
    return level.select("__no_source", "__source", "source_size", target.alias("target"))


def part_of(text: Column) -> Column:
    """One of 256 parts by hash."""
    return F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 2)


def with_copies(
    docs: DataFrame, id_col: str, source_col: str, size: Column, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    part: Column | None = None, counted: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``.

    ``counted`` may have the columns ``source_col``, ``__size`` and ``__part`` of the same rows in a
    table: ``docs`` is then read once, else three times.
    """
    source = F.col(f"`{source_col}`").cast("string")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # once: counting words is dear
    docs = docs.withColumns({"__size": F.coalesce(size.cast("long"), F.lit(0)), "__part": part_of(F.col(f"`{id_col}`").cast("string")) if part is None else part})
    counted = docs if counted is None else counted
    size = F.col("__size")
    targets = source_targets(counted, source, size, weights, share, most)
    power = F.length(F.bin(size)) - 1
    step = F.when(size == 0, F.lit(-1)).otherwise(power * 16 + F.floor(size * 16 / F.pow(F.lit(2.0), power)) - 16).cast("int")
    named = {"__no_source": source.isNull(), "__source": F.coalesce(source, F.lit("")), "__step": step}
    by_source, by_step = Window.partitionBy(*KEYS[:2]).orderBy("__step"), Window.partitionBy(*KEYS[:3]).orderBy("__part")
    first = Window.unboundedPreceding
    blocks = counted.withColumns(named).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__n"))
    steps = (
        blocks.groupBy(*KEYS[:3])
        .agg(F.sum("__n").alias("__in_step"))
        .withColumn("__below", F.coalesce(F.sum("__in_step").over(by_source.rowsBetween(first, -1)), F.lit(0)))
        .join(targets, list(KEYS[:2]))
    )
    blocks = (
        blocks.withColumn("__before", F.coalesce(F.sum("__n").over(by_step.rowsBetween(first, -1)), F.lit(0)))
        .join(steps, list(KEYS[:3]))
        .select(*KEYS, (F.col("__below") + F.col("__before")).alias("__before"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    )
    order = [F.col(f"`{id_col}`").asc_nulls_first(), "__size", F.xxhash64(*plain)]
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order)).cast("long")
    seeded = F.md5(F.concat(F.lit(seed), F.col("__no_source").cast("string"), F.lit("/"), F.col("__source")).cast("binary"))
    offset = F.conv(F.substring(seeded, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("__source_size") == 0, F.lit(0.0)).otherwise(F.col("__target") / F.col("__source_size"))
    crossed = lambda at: F.floor(at * F.col("__rate") + F.col("__offset"))
    return (
        docs.withColumns(named)
        .withColumn("__place", place)
        .join(blocks, list(KEYS))
        .withColumns({"__at": F.col("__before") + F.col("__place"), "__rate": rate, "__offset": offset})
        .withColumn("__copies", (crossed(F.col("__at")) - crossed(F.col("__at") - 1)).cast("long"))
        .drop(*KEYS, "__place", "__before", "__at", "__rate", "__offset")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row of ``with_copies`` as often as the mix takes it."""
    return (
        mixed.where(F.col("__copies") > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        .drop("__copy", "__copies", "__size", "__source_size", "__target")
    )
