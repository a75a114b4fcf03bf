"""Cross-entropy difference of matched target and background n-gram models.

Both models are bigram models over the tokens of one public tokenizer, with
the same vocabulary and smoothing: a bigram's estimate is drawn to the unigram
estimate by a number of pseudo-counts, a unigram's to the even one by
``Settings.even``. The background counts all documents, the target counts its
own texts. A document's score is its mean loss per token under the target less
that under the background: lower is nearer to the target.

The target never saw the document, so the background must not have either: a
document's own counts are left out of the background when it is scored; its
copies elsewhere count. Where most bigrams are frequent in the corpus, copies
change a loss little. The pseudo-counts are those of ``Settings.drawn`` under which the
background's tokens, each left out in turn, are likeliest; the sum is over the
counts of all documents.

Documents are tokenized once and stored in blocks of about
``Settings.block_tokens``. Each block's distinct bigrams are counted, summed
over all blocks, and the sums go back to the blocks that have the bigram; so a
frequent bigram costs a row in each block, not in each document. Unigram
counts go through the driver; there are as many as the vocabulary has tokens.
A block's texts are scored ``Settings.slice_tokens`` tokens at a time.

A null text is the empty text. A text without tokens has null losses and score
0. Each row gets its own score: repeated rows repeat, count as often and are
copies of each other; an empty table gives an empty result, an empty target is
the even model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding, ids_of
from .common import configure, stored, text_of


@dataclass(frozen=True)
class Settings:
    drawn: tuple[float, ...] = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0)
    even: float = 0.5
    block_tokens: int = 4_000_000
    slice_tokens: int = 250_000


def bigrams(ids: np.ndarray, starts: np.ndarray, start_token: int) -> np.ndarray:
    """Keys context << 32 | token of all tokens; a text's first has ``start_token`` as context."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[starts[starts < len(ids)]] = start_token
    return before << 32 | ids


def packing(vocabulary: int) -> np.dtype:
    """Two bytes an id where they suffice."""
    return np.dtype("<u2" if vocabulary < 1 << 16 else "<u4")


def laid_out(packed: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, where each text starts, and how many it has."""
    counts = np.array([len(p) // kind.itemsize for p in packed], np.int64)
    return np.frombuffer(b"".join(packed), kind).astype(np.int64), np.cumsum(counts) - counts, counts


def tokenized(texts: DataFrame, path: str, pattern: str, vocabulary: int, settings: Settings) -> DataFrame:
    """``doc_id``, ``ids`` and the ``block`` of each row of (doc_id, text), stored. Ids of documents are texts: no number is rounded."""
    packed_as = packing(vocabulary)
    limit = packed_as.itemsize * settings.block_tokens

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, pattern)
        block, held, part = 0, 0, TaskContext.get().partitionId()
        for rows in batches:
            packed, blocks = [], []
            for text in rows["text"]:
                ids = b"".join(np.array(p, packed_as).tobytes() for p in ids_of(enc, text))
                if held and held + len(ids) > limit:
                    block, held = block + 1, 0
                held += len(ids)
                packed.append(ids)
                blocks.append(part << 32 | block)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "block": blocks, "ids": packed})

    return stored(texts.mapInPandas(tokens, "doc_id string, block long, ids binary"), "ids")[0]


def block_counts(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """``block``, ``key``, ``n``: bigrams of each block, as far as a task has it; stored."""
    packed_as = packing(vocabulary)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(block, held):
            ids, starts, n = laid_out(held, packed_as)
            keys, times = np.unique(bigrams(ids, starts[n > 0], vocabulary), return_counts=True)
            return pd.DataFrame({"block": np.full(len(keys), block), "key": keys, "n": times})

        block, held = None, []
        for rows in batches:
            for b, ids in zip(rows["block"].tolist(), rows["ids"]):
                if b != block and held:
                    yield out(block, held)
                    held = []
                block = b
                held.append(ids)
        if held:
            yield out(block, held)

    return stored(tokens.select("block", "ids").mapInPandas(counts, "block long, key long, n long"), "bigrams")[0]


def unigram_counts(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each token comes, and how often it is a context; ``size`` rows at most."""
    last, context = np.zeros(size, np.float64), np.zeros(size, np.float64)
    for out, key in ((last, F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))), (context, F.shiftright("key", 32))):
        found = counts.groupBy(key.alias("token")).agg(F.sum("n").alias("n")).toPandas()
        out[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return last, context


def split_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and token of a bigram."""
    return keys >> 32, keys & 0xFFFFFFFF


def loss(n: np.ndarray, context: np.ndarray, last: np.ndarray, total: np.ndarray, size: int, drawn: float, even: float) -> np.ndarray:
    """-log P(token | context) of a bigram that comes ``n`` times, its context ``context``, its token ``last`` of ``total`` times."""
    return -np.log((n + drawn * (last + even) / (total + even * size)) / (context + drawn))


def own_counts(text: np.ndarray, what: np.ndarray) -> np.ndarray:
    """For each token, how many tokens of its text have the same ``what``."""
    _, at, times = np.unique(text << 32 | what, return_inverse=True, return_counts=True)
    return times[at]


def slices(n: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of texts of about ``most`` tokens."""
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // most)) + 1
    bounds = [0, *cuts.tolist(), len(n)]
    return (slice(a, b) for a, b in zip(bounds, bounds[1:]))


def likeliest(sums: DataFrame, known, size: int, s: Settings) -> float:
    """The candidate under which the background's tokens, each without itself, lose least; the smallest on ties."""

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, context = known.value[:2]
        total, lost = last.sum(), np.zeros(len(s.drawn))
        for rows in batches:
            before, token = split_key(rows["key"].to_numpy(np.int64))
            n = rows["background"].to_numpy(np.float64)
            for k, drawn in enumerate(s.drawn):
                lost[k] += (n * loss(n - 1, context[before] - 1, last[token] - 1, total - 1, size, drawn, s.even)).sum()
        yield pd.DataFrame({"drawn": np.array(s.drawn, np.float64), "lost": lost})

    if len(s.drawn) == 1:
        return s.drawn[0]
    found = sums.select("key", "background").mapInPandas(losses, "drawn double, lost double").groupBy("drawn").agg(F.sum("lost").alias("lost"))
    best = found.orderBy(F.round("lost", 3), "drawn").limit(1).collect()
    return best[0]["drawn"] if best else s.drawn[0]


def score_documents(docs: DataFrame, target: DataFrame, path: str, pattern: str, vocabulary: int, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score`` of each document.

    ``vocabulary`` is the number of ids of the rank file.
    """
    spark = docs.sparkSession
    configure(spark)
    tokens = tokenized(docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), text_of(text_col).alias("text")), path, pattern, vocabulary, settings)
    of_target = tokenized(target.select(F.lit("").alias("doc_id"), text_of(target_text).alias("text")), path, pattern, vocabulary, settings)
    counts, target_counts = block_counts(tokens, vocabulary), block_counts(of_target, vocabulary)
    known = spark.sparkContext.broadcast((*unigram_counts(counts, vocabulary + 1), *unigram_counts(target_counts, vocabulary + 1)))
    sums = counts.groupBy("key").agg(F.sum("n").alias("background"))
    targets = target_counts.groupBy("key").agg(F.sum("n").alias("target"))
    sums, _ = stored(sums.join(targets, "key", "left").select("key", "background", F.coalesce("target", F.lit(0)).alias("target")), "sums")
    drawn = likeliest(sums, known, vocabulary, settings)
    values = counts.select("block", "key").join(sums, "key")  # a block that two tasks had may have a bigram twice
    packed_as = packing(vocabulary)
    kind = docs.schema[id_col].dataType

    def scores(rows: pd.DataFrame, known_counts: pd.DataFrame) -> pd.DataFrame:
        last, context, target_last, target_context = known.value
        total, target_total = last.sum(), target_last.sum()
        ids, starts, n = laid_out(rows["ids"].tolist(), packed_as)
        keys, order = np.unique(known_counts["key"].to_numpy(), return_index=True)
        background = known_counts["background"].to_numpy(np.float64)[order]
        before, token = split_key(keys)
        of_target = loss(known_counts["target"].to_numpy(np.float64)[order], target_context[before], target_last[token], target_total, vocabulary, drawn, settings.even)
        all_bigrams = bigrams(ids, starts[n > 0], vocabulary)
        means = {"target_loss": np.full(len(n), np.nan), "background_loss": np.full(len(n), np.nan)}
        for some in slices(n, settings.slice_tokens):
            there = np.flatnonzero(n[some]) + some.start
            if not len(there):
                continue
            here = all_bigrams[starts[there[0]] : starts[there[-1]] + n[there[-1]]]
            at = np.searchsorted(keys, here)
            text = np.repeat(np.arange(len(there)), n[there])
            before, token = split_key(here)
            others = loss(
                background[at] - own_counts(text, at),
                context[before] - own_counts(text, before),
                last[token] - own_counts(text, token),
                total - n[there][text],
                vocabulary,
                drawn,
                settings.even,
            )
            first = starts[there] - starts[there[0]]
            for name, lost in (("target_loss", of_target[at]), ("background_loss", others)):
                means[name][there] = np.add.reduceat(lost, first) / n[there]
        out = {"doc_id": rows["doc_id"], "n_tokens": n, **means}
        return pd.DataFrame(out)

    scored = tokens.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(scores, "doc_id string, n_tokens long, target_loss double, background_loss double")
    empty = F.col("n_tokens") == 0
    losses = [F.when(~empty, F.col(c)).alias(c) for c in ("target_loss", "background_loss")]
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", *losses, F.when(empty, F.lit(0.0)).otherwise(F.col("target_loss") - F.col("background_loss")).alias("score"))
