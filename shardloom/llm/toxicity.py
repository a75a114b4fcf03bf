"""Toxicity: a convolutional text classifier.

Words are hashed to embeddings (the sum of those of the word, its first four
and its last four letters); filters of several widths run over them, and each
filter's largest value over the whole text (max pooling) feeds a logistic
output. It is trained in numpy on all labelled rows: they are dealt into shards,
each epoch trains the same model on every shard, one task for each, and the
results' mean, by rows, is the next model. A part of the rows, by a hash of the
id, is held back: all of it chooses the epoch, scales to probabilities and
calibrates thresholds by language. What tasks return are sums of whole numbers
of a fixed size, so reruns agree and the driver holds no rows.

Scores depend on the text alone. A null or empty text has the score of a text
without words. Each row gets its own score: repeated rows repeat, an empty
table gives an empty result. Where one of the two labels is missing, every score
is the share of label 1 (0 without labelled rows).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, fresh_path, remove, stored, text_of

WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: A worker forgets its words between two batches once it knows more of them.
REMEMBER = 200_000
#: ... or once they have so many letters together.
LETTERS = 8_000_000
#: Different labels or grades of one sample.
MOST_LABELS = 1_000
#: Labelled rows, and bytes of text, of a shard, about.
SHARD_ROWS, SHARD_BYTES = 4096, 16 << 20
#: Parameters are summed as whole numbers of this fraction; logits are counted in steps of the other, up to MOST_LOGIT either way.
FRACTION, STEPS, MOST_LOGIT = 1 << 22, 1024, 30
#: Numbers of a row in which tasks return their sums.
PART = 1 << 13
#: Bits of the filter that leaves out most documents without a label before the join.
FILTER_BITS = 1 << 24
#: Thresholds tried.
TRIED = np.arange(0.3, 0.91, 0.05)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    size: int = 8  # of an embedding
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    epochs: int = 8
    rate: float = 0.01
    decay: float = 1e-4
    held_back: float = 0.25  # share of the labelled rows for scaling and thresholds
    threshold: float = 0.7
    least_labels: int = 30  # of label 1 for a language's own threshold
    seed: int = 7


class Vocabulary(dict):
    """Numbers of the words seen, and the embedding rows of each.

    Number 0 stands for no word. ``trim`` forgets all words once there are too many.
    """

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets
        self.parts: list[tuple[int, int, int]] = [(buckets, buckets, buckets)]
        self.letters = 0

    def __missing__(self, word: str) -> int:
        self.letters += len(word)
        self[word] = number = len(self.parts)
        kinds = (word, "^" + word[:4], "$" + word[-4:]) if len(word) > 4 else (word,)
        rows = [zlib.crc32(k.encode()) % self.buckets for k in kinds]
        self.parts.append((*rows, *[self.buckets] * (3 - len(rows))))
        return number

    def of(self, text: str) -> np.ndarray:
        return np.array(list(map(self.__getitem__, WORDS.findall(text.lower()))), dtype=np.int32)

    def rows(self) -> np.ndarray:
        return np.array(self.parts, dtype=np.int32)

    def trim(self) -> None:
        if len(self.parts) > REMEMBER or self.letters > LETTERS:
            self.letters = 0
            self.clear()
            del self.parts[1:]


def laid_out(docs: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' word numbers with ``gap`` empty words after each, and where each starts and ends.

    An end is one place past the last word, so that no filter, of a width up to
    ``gap``, sees another document from a place before it.
    """
    lengths = np.array([len(d) + gap for d in docs])
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()) + gap, np.int32)
    for start, d in zip(starts.tolist(), docs):
        flat[start : start + len(d)] = d
    return flat, np.stack([starts, starts + lengths - gap + 1], 1)


@dataclass
class Model:
    settings: Settings
    embeddings: np.ndarray  # the last row stands for no word and is zero
    filters: list[np.ndarray]  # of each width w: (w, size, filters)
    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def values(self, vectors: np.ndarray, flat: np.ndarray) -> Iterator[np.ndarray]:
        """Each width's filters at each place; ``vectors`` are those of the numbered words."""
        x = vectors[flat]
        n = len(flat) - max(self.settings.widths)
        for f in self.filters:
            value = x[:n] @ f[0]
            for k in range(1, len(f)):
                value += x[k : n + k] @ f[k]
            yield value

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return self.embeddings[rows].sum(1)

    def logits(self, docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        """By the largest value of each filter, at least 0, of each document."""
        flat, spans = laid_out(docs, max(self.settings.widths))
        pooled = np.concatenate([np.maximum.reduceat(v, spans.ravel(), axis=0)[::2] for v in self.values(vectors, flat)], 1)
        return np.maximum(pooled, 0) @ self.weights + self.bias

    def blocks(self, docs: list[np.ndarray], rows: np.ndarray, block: int = 400_000) -> np.ndarray:
        """``logits``; documents go in blocks of about so many words."""
        vectors = self.vectors(rows)
        out, start, words = [], 0, 0
        for i, d in enumerate(docs):
            words += len(d)
            if words > block or i == len(docs) - 1:
                out.append(self.logits(docs[start : i + 1], vectors))
                start, words = i + 1, 0
        return np.concatenate(out).astype(float) if out else np.zeros(0)

    def scores(self, docs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        z = self.blocks(docs, rows) * self.scale[0] + self.scale[1]
        # products in single precision differ a little with the block's size
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)

    def parameters(self) -> np.ndarray:
        return np.concatenate([self.embeddings.ravel(), *[f.ravel() for f in self.filters], self.weights, [self.bias]]).astype(float)

    def with_parameters(self, values: np.ndarray) -> Model:
        """A model of these; ``parameters`` of it gives them back, in single precision."""
        arrays, at = [], 0
        for old in (self.embeddings, *self.filters, self.weights):
            arrays.append(values[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return Model(self.settings, arrays[0], arrays[1:-1], arrays[-1], float(values[at]))


@dataclass
class Shard:
    """Labelled rows as ``learn`` takes them; ``used`` and ``held`` are places of those to learn from and held back."""

    number: int
    docs: list[np.ndarray]
    rows: np.ndarray
    labels: np.ndarray
    langs: list[str]
    used: np.ndarray
    held: np.ndarray


def start_model(counts: np.ndarray, totals: np.ndarray, s: Settings, rng) -> Model:
    """Small random embeddings; their first axis is how surely a word goes with a label.

    That is the log odds of documents with the word, in standard deviations,
    less two and a half of them: rare words start at zero. ``counts`` are the
    documents with each bucket by label, ``totals`` all of them.
    """
    z = (np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))) / np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    sure = np.sign(z) * np.maximum(np.abs(z) - 2.5, 0)
    embeddings = np.zeros((s.buckets + 1, s.size), np.float32)
    embeddings[:-1] = rng.normal(0, 0.01, (s.buckets, s.size))
    embeddings[:-1, 0] += np.clip(sure, -4, 4)
    filters = [rng.normal(0, 0.1, (w, s.size, s.filters)).astype(np.float32) for w in s.widths]
    for f in filters:
        f[:, 0, ::2] = 0.5 / len(f)
    out = rng.normal(0, 0.1, len(s.widths) * s.filters).astype(np.float32)
    out[::2] = 0.5
    return Model(s, embeddings, filters, out, 0.0)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.kept = rate, 0, {}

    def step(self, name, value, grad, rows=None) -> None:
        m, v = self.kept.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad**2
        value[at] -= self.rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-8)


def packed_shards(found: DataFrame, shards: int, both: bool, s: Settings) -> str:
    """Writes each shard as one row of one file, its words as embedding rows; returns the place."""
    spark = found.sparkSession
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("shard"))

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["place", "id"], ignore_index=True)
        words = Vocabulary(s.buckets)
        docs = [words.of(t or "") for t in own["text"]]
        keys = words.rows().astype(np.int64) @ np.array([1 << 42, 1 << 21, 1])
        back = own["back"].to_numpy(bool)
        used, held = (np.arange(len(own)),) * 2 if both else (np.flatnonzero(~back), np.flatnonzero(back))
        values = {"words": keys[np.concatenate(docs)], "lengths": np.array([len(d) for d in docs]), "labels": own["label"].to_numpy(), "used": used, "held": held}
        one = {k: [v.astype(np.int64).tobytes()] for k, v in values.items()}
        return pd.DataFrame({"number": [int(own["shard"][0])], **one, "langs": [[x or "" for x in own["lang"]]]})

    path = fresh_path(spark, "shards")
    rows = found.select(F.col("doc_id").cast("string").alias("id"), "text", "lang", F.col("label").cast("int").alias("label"), "back", place.alias("place"), F.pmod(place, F.lit(shards)).alias("shard"))
    packed = rows.groupBy("shard").applyInPandas(pack, "number int, words binary, lengths binary, labels binary, used binary, held binary, langs array<string>")
    packed.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)
    return path


def unpacked(row: dict, s: Settings) -> Shard:
    words, lengths, labels, used, held = (np.frombuffer(row[k], np.int64) for k in ("words", "lengths", "labels", "used", "held"))
    codes, keys = pd.factorize(words)
    rows = np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF], 1).astype(np.int32)
    docs = np.split((codes + 1).astype(np.int32), np.cumsum(lengths))[:-1]
    none = np.full((1, 3), s.buckets, np.int32)
    return Shard(int(row["number"]), docs, np.concatenate([none, rows]), labels.astype(float), list(row["langs"]), used, held)


def summed(data: DataFrame, work, s: Settings) -> np.ndarray:
    """The sum of ``work`` (of a shard, to whole numbers) over all shards: of each task's first, then of each part's."""

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for row in batch.to_dict("records"):
                own = work(unpacked(row, s))
                total = own if total is None else total + own
        if total is not None:
            parts = range(0, len(total), PART)
            yield pd.DataFrame({"part": list(parts), "sums": [total[k : k + PART].tobytes() for k in parts]})

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in rows["sums"])
        return pd.DataFrame({"part": rows["part"][:1], "sums": [total.tobytes()]})

    tasks = data.mapInPandas(of_task, "part int, sums binary")
    parts = {r["part"]: r["sums"] for r in tasks.groupBy("part").applyInPandas(of_part, "part int, sums binary").collect()}
    return np.concatenate([np.frombuffer(parts[k], np.int64) for k in sorted(parts)])


def bucket_counts(shard: Shard, s: Settings) -> np.ndarray:
    """Documents to learn from with each bucket, and all of them, by label."""
    counts, totals = np.zeros((2, s.buckets), np.int64), np.zeros(2, np.int64)
    for i in shard.used.tolist():
        y = int(shard.labels[i])
        counts[y, np.setdiff1d(shard.rows[np.unique(shard.docs[i])], s.buckets)] += 1
        totals[y] += 1
    return np.concatenate([counts.ravel(), totals])


def epoch(shard: Shard, model: Model, number: int) -> np.ndarray:
    """Counts of logits held back, by label; then rows, and parameters after an epoch times rows."""
    s = model.settings
    z = model.blocks([shard.docs[i] for i in shard.held], shard.rows)
    steps = np.rint((np.clip(z, -MOST_LOGIT, MOST_LOGIT) + MOST_LOGIT) * STEPS).astype(np.int64)
    width = 2 * MOST_LOGIT * STEPS + 1
    counts = np.bincount(steps + width * shard.labels[shard.held].astype(np.int64), minlength=2 * width)
    rng, adam = np.random.default_rng([s.seed, number, shard.number]), Adam(s.rate)
    own = model.with_parameters(model.parameters())
    if number < s.epochs and len(shard.used):
        for batch in np.array_split(rng.permutation(shard.used), max(1, len(shard.used) // 64)):
            learn(own, [shard.docs[i] for i in batch], shard.rows, shard.labels[batch], np.ones(len(batch)), adam)
    n = len(shard.used)
    return np.concatenate([counts, [n], np.rint(own.parameters() * n * FRACTION).astype(np.int64)])


def train(data: DataFrame, s: Settings) -> Model:
    """A model from the rows of ``packed_shards``, among which are both labels, to learn from and held back."""
    context = data.sparkSession.sparkContext
    counts = summed(data, lambda shard: bucket_counts(shard, s), s)
    model = start_model(counts[:-2].reshape(2, -1), counts[-2:], s, np.random.default_rng(s.seed))
    width = 2 * MOST_LOGIT * STEPS + 1
    best, kept = np.inf, None
    for number in range(s.epochs + 1):
        sent = context.broadcast(model)
        sums = summed(data, lambda shard, sent=sent, number=number: epoch(shard, sent.value, number), s)
        sent.unpersist()
        at = np.flatnonzero(sums[: 2 * width])
        scale = fitted_scale(at % width / STEPS - MOST_LOGIT, (at // width).astype(float), sums[at].astype(float))
        if scale[2] < best - 1e-4:
            best, kept = scale[2], model
            kept.scale = scale[:2]
        model = model.with_parameters(sums[2 * width + 1 :] / (float(sums[2 * width]) * FRACTION))
    kept.thresholds = language_thresholds(data, kept)
    return kept


def learn(model: Model, docs, rows, labels, weights, adam: Adam) -> None:
    """One step: gradients go to the place where each filter is largest."""
    s = model.settings
    words, inverse = np.unique(np.concatenate([*docs, np.zeros(1, np.int32)]), return_inverse=True)  # number 0 comes first
    cuts = np.cumsum([len(d) for d in docs])
    flat, spans = laid_out(np.split(inverse[:-1].astype(np.int32), cuts)[:-1], max(s.widths))
    own = rows[words]
    vectors = model.vectors(own)
    places, values = [], []
    for value in model.values(vectors, flat):
        at = np.stack([a + value[a:b].argmax(0) for a, b in spans.tolist()])
        places.append(at)
        values.append(np.take_along_axis(value, at, 0))
    pooled = np.maximum(np.concatenate(values, 1), 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
    error = ((p - labels) * weights / weights.sum()).astype(np.float32)
    to_pooled = error[:, None] * model.weights * (pooled > 0)
    adam.t += 1
    of_words = np.zeros_like(vectors)
    for i, f in enumerate(model.filters):
        g = to_pooled[:, i * s.filters : (i + 1) * s.filters]
        grad = np.zeros_like(f)
        for k in range(len(f)):
            ids = flat[places[i] + k]
            grad[k] = np.einsum("bf,bfe->ef", g, vectors[ids])
            np.add.at(of_words, ids.ravel(), (g[:, :, None] * f[k].T[None]).reshape(-1, s.size))
        adam.step(("filter", i), f, grad + s.decay * f)
    moved = np.flatnonzero(of_words.any(1))
    ids, where = np.unique(own[moved], return_inverse=True)
    total = np.zeros((len(ids), s.size), np.float32)
    np.add.at(total, where.ravel(), np.repeat(of_words[moved], 3, axis=0))
    real = ids < s.buckets
    adam.step("embeddings", model.embeddings, total[real] + s.decay * model.embeddings[ids[real]], ids[real])
    adam.step("weights", model.weights, pooled.T @ error + s.decay * model.weights)
    model.bias -= 0.5 * float(error.sum())


def fitted_scale(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset that make logits probabilities, by Newton steps, and the log loss."""
    at = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    prior = np.array([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (w * (p - y)) + prior * (at - (1, 0))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(prior), grad)
        at -= np.clip(step, -2, 2)
    at[0] = max(at[0], 1e-3)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ at, -30, 30))), 1e-6, 1 - 1e-6)
    return float(at[0]), float(at[1]), float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())


def language_thresholds(data: DataFrame, model: Model) -> dict[str, float]:
    """For each language with labels enough, the best F1's threshold, drawn halfway to the common one."""
    s, sent = model.settings, data.sparkSession.sparkContext.broadcast(model)
    numbers = [f"{k}{i}" for k in ("said", "true") for i in range(len(TRIED))]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                shard = unpacked(row, s)
                scores, y = sent.value.scores([shard.docs[i] for i in shard.held], shard.rows), shard.labels[shard.held]
                said = (scores[:, None] >= TRIED).astype(np.int64)
                own = pd.DataFrame(np.concatenate([said, said * (y[:, None] > 0)], 1), columns=numbers)
                own = own.assign(lang=[shard.langs[i] for i in shard.held], ones=y.astype(np.int64))
                yield own.groupby("lang", as_index=False).sum()[["lang", "ones", *numbers]]

    counted = data.mapInPandas(count, ", ".join(["lang string", "ones long", *[f"{n} long" for n in numbers]]))
    sums = counted.groupBy("lang").agg(*[F.sum(n).alias(n) for n in ("ones", *numbers)]).where(F.col("ones") >= s.least_labels)
    out = {}
    for row in sums.collect():
        f1 = [round(2 * row[f"true{i}"] / (row[f"said{i}"] + row["ones"] + 1e-9), 4) for i in range(len(TRIED))]
        best = max(range(len(TRIED)), key=lambda i: (f1[i], -abs(TRIED[i] - s.threshold)))
        out[row["lang"]] = round(float(TRIED[best] + s.threshold) / 2, 3)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: list[str], per_class: int) -> tuple[pd.DataFrame, dict]:
    """Documents of at most ``per_class`` rows of each label (those of smallest hash), and all labels' counts.

    The ids are chosen among ``labels`` (doc_id, label) alone; only they, of bounded
    number, meet the documents, by broadcast. Of an id's labels the smallest counts,
    and of its documents the one of smallest hash, so that reruns take the same.
    """
    totals = {r[0]: r[1] for r in labels.groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(totals) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different labels")
    hashed = labels.where(F.col("doc_id").isNotNull()).withColumn("__h", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")))
    chosen = None
    for v in sorted(totals):
        part = hashed.where(F.col(label) == F.lit(v)).orderBy("__h", "doc_id").limit(per_class).select("doc_id", label)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return pd.DataFrame(columns=["doc_id", label, *keep]), totals
    rows = sorted(((r["doc_id"], r[label]) for r in chosen.collect()), key=lambda r: r[1], reverse=True)
    ids = labels.sparkSession.createDataFrame(list(dict(rows).items()), chosen.schema)
    found = docs.select("doc_id", *keep).join(F.broadcast(ids), "doc_id")
    first = F.min(F.struct(F.xxhash64(*keep), *keep, label)).alias("first")
    return found.groupBy("doc_id").agg(first).select("doc_id", "first.*").toPandas().sort_values("doc_id", ignore_index=True), totals


def labelled_documents(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """All documents with a label: ``doc_id``, ``text``, ``lang``, ``label`` and whether they are held ``back``.

    Of an id's labels the smallest counts, and of its documents the one of smallest
    hash. A filter of fixed size goes before the join, so that few other texts are moved.
    """
    spark = docs.sparkSession
    own = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    kind = dict(docs.dtypes)["doc_id"]  # equal ids of another type need not have equal text
    same = kind == dict(labels.dtypes)["doc_id"]
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    if same:
        marks = own.select(F.shiftright(bit, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int")).alias("mark"))
        got = marks.groupBy("word").agg(F.bit_or("mark").alias("mark")).collect()
        bits = np.zeros(FILTER_BITS // 32, np.int64)
        bits[[r["word"] for r in got]] = [r["mark"] for r in got]
        sent = spark.sparkContext.broadcast(bits)

        @F.pandas_udf("boolean")
        def wanted(at: pd.Series) -> pd.Series:
            return pd.Series(sent.value[at.to_numpy() >> 5] >> (at.to_numpy() & 31) & 1 > 0)

        docs = docs.where(F.col("doc_id").isNotNull()).where(wanted(bit))
    found = docs.select("doc_id", "text", "lang").join(own, "doc_id")
    first = F.min(F.struct(F.xxhash64("text", "lang"), "text", "lang", "label")).alias("first")
    share = F.lit(round(s.held_back * 10_000))
    back = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("held")), F.lit(10_000)) < share
    return found.groupBy("doc_id").agg(first).select("doc_id", "first.text", "first.lang", "first.label", back.alias("back"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on documents (doc_id, text, lang) by ``labels`` (doc_id, label 0 or 1); rows without a label are left out."""
    spark = docs.sparkSession
    configure(spark)
    found, path = stored(labelled_documents(docs, labels.where(F.col("label").isin(0, 1)), settings), "labelled")
    counts = {(r["back"], int(r["label"])): r for r in found.groupBy("back", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect()}
    n, ones, size = sum(r["n"] for r in counts.values()), sum(r["n"] for k, r in counts.items() if k[1]), sum(r["size"] for r in counts.values())
    if ones in (0, n):
        remove(spark, path)
        s = settings
        return Model(s, np.zeros((s.buckets + 1, s.size), np.float32), [np.zeros((w, s.size, s.filters), np.float32) for w in s.widths], np.zeros(len(s.widths) * s.filters, np.float32), 0.0, constant=ones / n if n else 0.0)
    data = packed_shards(found, max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES)), len(counts) < 4, settings)
    remove(spark, path)
    try:
        return train(spark.read.parquet(data), settings)
    finally:
        remove(spark, data)


def score_column(spark: SparkSession, text: Column, model: Model) -> Column:
    """Score of a text column. The broadcast model has a fixed size, about 2 MB."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        words = Vocabulary(own.settings.buckets)
        for texts in batches:
            docs = [words.of(t) for t in texts]
            yield pd.Series(own.scores(docs, words.rows()))
            words.trim()

    return score(text)


def threshold_column(lang: Column, model: Model) -> Column:
    default = F.lit(model.settings.threshold)
    if not model.thresholds:
        return default
    known = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])
    return F.coalesce(F.element_at(known, F.coalesce(lang, F.lit(""))), default)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` (by the common threshold), the language's ``threshold`` and ``rejected`` by it."""
    configure(docs.sparkSession)
    scored = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        score_column(docs.sparkSession, text_of(text_col), model).alias("score"),
        threshold_column(F.col(f"`{lang_col}`"), model).alias("threshold"),
    )
    return scored.select("doc_id", "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))
