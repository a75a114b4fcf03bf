"""Quality: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its value: P(grade >= k) = logistic(w.x - t[k]). A text gives
its expected grade and the probability of reaching a grade, for selection.

Features are the hashed words of a text and their shapes (case, digits,
signs), each counted by its share of the words, and the share of words that
repeat the word before. The model is fitted in numpy
on a bounded sample (``Settings.per_grade`` rows of each grade).

A null or empty text has no features. Each row gets its own result: repeated
rows repeat, an empty table gives an empty result. Without two grades in the
sample, the expected grade is the one there is (0 if none) and the tail is 1
if that grade reaches it, else 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, text_of
from .toxicity import labelled_sample

#: Chunks that a worker remembers, and the longest of them.
REMEMBER, LONGEST = 400_000, 64
#: A run of letters is looked at once, however long; the sign is among the lower case by its code.
RUN, LOWER = re.compile(r"(?:[^\W\d_]|÷)+"), re.compile(r"[a-zß-ÿ]")
SHAPES = ((RUN, lambda run: "w" if LOWER.search(run[0]) else run[0]), (re.compile(r"[^\W\d_]+"), "W"), (re.compile(r"\d+"), "9"))


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    per_grade: int = 2500  # bound of the rated sample: so many rows of each grade
    epochs: int = 30
    rate: float = 0.5
    decay: float = 1e-4
    shape_scale: float = 3.0
    held_back: float = 0.2
    seed: int = 11


def shape_of(word: str) -> str:
    """Runs of letters as w (any lower case) or W, digits as 9, signs as they are, once each."""
    for pattern, sign in SHAPES:
        word = pattern.sub(sign, word)
    return re.sub(r"(.)\1+", r"\1", word)


class Features(dict):
    """Packed buckets (word's above, shape's below) of a chunk between white space."""

    def __init__(self, buckets: int):
        super().__init__()
        self.half = buckets // 2 - 1  # the last bucket is that of repeats

    def __missing__(self, chunk: str) -> int:
        word = zlib.crc32(chunk.lower().strip(".,;:!?").encode()) % self.half
        both = word << 32 | (self.half + zlib.crc32(shape_of(chunk).encode()) % self.half)
        if len(self) < REMEMBER and len(chunk) <= LONGEST:
            self[chunk] = both
        return both

    def of(self, text: str) -> np.ndarray:
        return np.array(list(map(self.__getitem__, text.split())), dtype=np.int64)


@dataclass
class Model:
    settings: Settings
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than grades, ascending

    def value(self, packed: np.ndarray) -> float:
        if len(packed) == 0:
            return 0.0
        s = self.settings
        seen = self.weights[packed >> 32].mean() + s.shape_scale * self.weights[packed & 0xFFFFFFFF].mean()
        return float(seen + s.shape_scale * self.weights[-1] * repeats(packed))

    def tails(self, values: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k from 1."""
        return 1 / (1 + np.exp(-np.clip(values[:, None] - self.thresholds[None], -30, 30)))

    def expected(self, values: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, float)) if self.grades else np.zeros(0)
        return (self.grades[0] if self.grades else 0) + self.tails(values) @ steps

    def tail(self, values: np.ndarray, grade: float) -> np.ndarray:
        above = [k for k, g in enumerate(self.grades) if g >= grade]
        if not above:
            return np.zeros(len(values))
        return np.ones(len(values)) if above[0] == 0 else self.tails(values)[:, above[0] - 1]


def repeats(packed: np.ndarray) -> float:
    """Share of words that repeat the word before."""
    words = packed >> 32
    return float((words[1:] == words[:-1]).sum() / len(words))


def sparse_row(packed: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    if len(packed) == 0:
        return np.zeros(0, np.int64), np.zeros(0)
    ids, n = np.unique(np.concatenate([packed >> 32, packed & 0xFFFFFFFF]), return_counts=True)
    x = np.where(ids >= s.buckets // 2 - 1, s.shape_scale, 1.0) * n / len(packed)
    return np.append(ids, s.buckets - 1), np.append(x, s.shape_scale * repeats(packed))


def train(docs: list[np.ndarray], grades: np.ndarray, row_weights: np.ndarray, s: Settings) -> Model:
    """Adaptive gradient descent on the weighted log likelihood of the cumulative logits."""
    kinds = sorted({float(g) for g in grades})
    model = Model(s, kinds, np.zeros(s.buckets), np.zeros(max(0, len(kinds) - 1)))
    if len(kinds) < 2:
        return model
    rank = np.searchsorted(kinds, grades)
    share = [np.average(rank >= k, weights=row_weights) for k in range(1, len(kinds))]
    # thresholds are the first one and the logarithms of the steps to the next: they stay in order
    start = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    rows = [sparse_row(d, s) for d in docs]
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(rows))
    back = int(s.held_back * len(rows))
    held, used = order[:back], order[back:]
    weights, kept, best = model.weights, None, np.inf
    sums, free_sums = np.full(s.buckets, 1e-6), np.full(len(free), 1e-2)
    scale = row_weights / row_weights.mean()

    def cut(f):
        return np.concatenate([f[:1], f[0] + np.cumsum(np.exp(f[1:]))])

    def loss_and_slopes(value, k, t):
        """-log P(rank k), its slope by value, and by each threshold."""
        upper = 1.0 if k == 0 else 1 / (1 + np.exp(-np.clip(value - t[k - 1], -30, 30)))
        lower = 0.0 if k == len(t) else 1 / (1 + np.exp(-np.clip(value - t[k], -30, 30)))
        p = max(upper - lower, 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        by_t = np.zeros(len(t))
        if k > 0:
            by_t[k - 1] = du / p
        if k < len(t):
            by_t[k] = -dl / p
        return -np.log(p), -(du - dl) / p, by_t

    for _ in range(s.epochs):
        for i in rng.permutation(used):
            ids, x = rows[i]
            t = cut(free)
            _, slope, by_t = loss_and_slopes(float(weights[ids] @ x), int(rank[i]), t)
            grad = np.clip(scale[i] * slope, -3, 3) * x + s.decay * weights[ids]
            sums[ids] += grad**2
            weights[ids] -= s.rate * 0.2 * grad / np.sqrt(sums[ids])
            by_free = np.concatenate([[by_t.sum()], np.exp(free[1:]) * by_t[1:][::-1].cumsum()[::-1]]) * scale[i]
            free_sums += by_free**2
            free -= s.rate * 0.2 * by_free / np.sqrt(free_sums)
        t = cut(free)
        loss = np.mean([scale[i] * loss_and_slopes(float(weights[rows[i][0]] @ rows[i][1]), int(rank[i]), t)[0] for i in (held if len(held) else used)])
        if loss < best - 1e-4:
            best, kept = loss, (weights.copy(), t)
    model.weights, model.thresholds = kept
    model.weights = model.weights.astype(np.float32)
    return model


def fit(docs: DataFrame, ratings: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on documents (doc_id, text) by ``ratings`` (doc_id, grade); rows without a grade, or with one that is no number, are left out. Grades need not be whole."""
    grade = F.col("grade").cast("double")
    rows = ratings.withColumn("grade", grade).where(grade.isNotNull() & ~F.isnan(grade))
    sample, totals = labelled_sample(docs, rows, "grade", ["text"], settings.per_grade)
    ids = Features(settings.buckets)
    grades = sample["grade"].to_numpy(dtype=float)
    taken = {v: max(1, int((grades == v).sum())) for v in totals}
    return train([ids.of(t or "") for t in sample["text"]], grades, np.array([totals[float(g)] / taken[float(g)] for g in grades], float), settings)


def value_column(spark: SparkSession, text: Column, model: Model) -> Column:
    """w.x of a text column. The broadcast model has a fixed size, half a MB."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        ids = Features(own.settings.buckets)
        for texts in batches:
            yield pd.Series([own.value(ids.of(t)) for t in texts], dtype=float)

    return value(text)


def tail_column(value: Column, model: Model, grade: float) -> Column:
    """Probability that a text of this value reaches the grade."""
    above = [k for k, g in enumerate(model.grades) if g >= grade]
    if not above or above[0] == 0:
        return F.lit(1.0 if above else 0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(model.thresholds[above[0] - 1])) - value))


def expected_column(value: Column, model: Model) -> Column:
    total = F.lit(float(model.grades[0] if model.grades else 0))
    for below, grade in zip(model.grades, model.grades[1:]):
        total = total + F.lit(float(grade - below)) * tail_column(value, model, grade)
    return total


def rate_documents(docs: DataFrame, model: Model, grade: float, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``expected_grade``, ``tail`` (probability of ``grade`` or more) and ``selected`` (tail of at least ``least``)."""
    configure(docs.sparkSession)
    valued = docs.select(F.col(f"`{id_col}`").alias("doc_id"), value_column(docs.sparkSession, text_of(text_col), model).alias("value"))
    return valued.select("doc_id", expected_column(F.col("value"), model).alias("expected_grade"), tail_column(F.col("value"), model, grade).alias("tail")).select("*", (F.col("tail") >= least).alias("selected"))
