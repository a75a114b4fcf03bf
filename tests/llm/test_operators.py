"""Operators against slow versions of themselves, on what is rare, and as the queries run them."""

import math
import random
import re
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.llm import ann, bpe, lm, mixing, queries, quality, toxicity, vp8l, webp
from shardloom.llm.common import workspace
from shardloom.llm.queries import split_pattern, tokenizer_file

MULTI = tokenizer_file("byte_bpe_multi_50k.tiktoken")
TABLES = "/root/testdata/sf0.01"


# 4 and 9: long white space, and ids that are no floating-point numbers


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t\r\x0b\x1c\x1f\x85\xa0 　'.sé漢"), max_size=60), st.integers(2, 5), st.integers(2, 20))
def test_long_runs_are_matched_as_the_library_does(text, run, chunk):
    enc = bpe.encoding(MULTI, split_pattern())
    assert np.frombuffer(bpe.encode_text(enc, text, chunk, run), "<u4").tolist() == enc.encode_ordinary(text)


def test_white_space_without_end(spark):
    texts = ["a" + sign * 3_000_000 + "b" for sign in " \t\n"] + [" " * 1_200_000, "x" * 400_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(docs, MULTI, split_pattern()).collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]
    enc = bpe.encoding(MULTI, split_pattern())
    middle = "a" + " \n" * 150_000 + " b"
    assert np.frombuffer(bpe.encode_text(enc, middle), "<u4").tolist() == enc.encode_ordinary(middle)
    assert lm.score_documents(docs, docs, MULTI, split_pattern(), 50_256).count() == 5


def test_ids_of_documents_stay_as_they_are(spark):
    ids = [None, 2**53 + 1, 2**63 - 1, -5]
    docs = spark.createDataFrame([(i, f"some words {i}") for i in ids], "doc_id long, text string")
    scored = lm.score_documents(docs, docs, MULTI, split_pattern(), 50_256)
    assert {r.doc_id for r in scored.collect()} == set(ids) and scored.schema["doc_id"].dataType.simpleString() == "bigint"


# 2: nearest neighbours


def nearest_of(rows, k):
    """By brute force; rows are (id, vector, is query)."""
    out = {}
    for q, v, asked in rows:
        if asked:
            found = {(math.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum()), i) for i, w, _ in rows if i != q}
            out.setdefault(q, set()).update(found)
    return {q: sorted(found)[:k] for q, found in out.items()}


def test_neighbours_of_repeated_rows_and_of_other_lengths(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).tolist(), i % 9 == 0) for i in range(120)]
    rows += rows[:60] + [rows[3]] * 20
    df = spark.createDataFrame([(i, v) for i, v, _ in rows] + [(500 + i, [1.0] * 9) for i in range(7)] + [(None, [1.0] * 8)], "vec_id long, embedding array<double>").repartition(4)
    query = F.coalesce(F.col("vec_id") % 9 == 0, F.lit(False))
    want = nearest_of(rows, 10)
    exact = ann.Settings(most_probes=1, held_bytes=1000, rows_at_once=16, queries_at_once=3)  # probes reach no aim: all rows
    for some in (exact, ann.Settings(recall=0.999999, tables=20)):
        got = {}
        for x in ann.search(df, query, settings=some).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.score, x.vec_id))
        assert set(got) == set(want)
        if some is exact:
            assert all([(s, i) for _, s, i in sorted(got[q])] == [(pytest.approx(s), i) for s, i in found] for q, found in want.items())
        assert all([n for n, *_ in sorted(found)] == list(range(1, 11)) for found in got.values())


@pytest.mark.skipif(not Path(TABLES).is_dir(), reason="no test tables")
def test_recall(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").toPandas()
    data = np.array(rows["embedding"].tolist(), float)
    ids = rows["vec_id"].to_numpy()
    found = {}
    for x in queries.op2_multiprobe_neighbours(spark, TABLES).collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    hits = total = 0
    for q in found:
        at = int(np.flatnonzero(ids == q)[0])
        d = ((data - data[at]) ** 2).sum(1)
        d[at] = np.inf
        true = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, total = hits + len(true & found[q]), total + len(true)
    print(f"recall {hits / total:.4f} of {len(found)} queries")
    assert hits >= 0.95 * total


# 1: the classifier's forward pass and its gradients


def slow_logit(model, text):
    s = model.settings
    words = toxicity.WORDS.findall(text.lower())
    vocabulary = toxicity.Vocabulary(s.buckets)
    numbers = [vocabulary[w] for w in words]
    vectors = [sum(model.embeddings[k].astype(float) for k in vocabulary.parts[n]) for n in numbers] + [np.zeros(s.size)] * max(s.widths)
    pooled = []
    for f in model.filters:
        best = [0.0] * f.shape[2]
        for at in range(len(words) + 1):
            for c in range(f.shape[2]):
                value = sum(float(vectors[min(at + k, len(vectors) - 1)] @ f[k][:, c]) for k in range(len(f)))
                best[c] = max(best[c], value)
        pooled += best
    return float(np.dot(pooled, model.weights) + model.bias)


def random_model(seed=0, **more):
    s = toxicity.Settings(buckets=50, size=3, filters=2, **more)
    r = np.random.default_rng(seed)
    embeddings = r.normal(0, 1, (51, 3)).astype(np.float64)
    embeddings[-1] = 0
    return toxicity.Model(s, embeddings, [r.normal(0, 1, (w, 3, 2)) for w in s.widths], r.normal(0, 1, 6), 0.3)


def test_forward_pass():
    model, vocabulary = random_model(), toxicity.Vocabulary(50)
    texts = ["", "one", "two words", "the same word word word again", "eine längere Zeile mit mehr Wörtern, 42 of them!"]
    docs = [vocabulary.of(t) for t in texts]
    assert model.logits(docs, model.vectors(vocabulary.rows())).tolist() == pytest.approx([slow_logit(model, t) for t in texts], abs=1e-6)


def test_gradients():
    """Of one step without decay, against differences of the loss."""
    model, vocabulary = random_model(3, decay=0.0), toxicity.Vocabulary(50)
    texts, labels, weights = ["alpha beta gamma", "beta delta", "gamma gamma epsilon zeta"], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    docs = [vocabulary.of(t) for t in texts]
    rows = vocabulary.rows()

    def loss():
        p = 1 / (1 + np.exp(-model.logits(docs, model.vectors(rows))))
        return float(-(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weights.sum())

    seen = {}

    class Noted:
        t = 0

        def step(self, name, value, grad, rows=None):
            seen[name] = (np.array(grad), rows)

    bias = model.bias
    toxicity.learn(model, docs, rows, labels, weights, Noted())
    model.bias = bias
    for name, array in [("weights", model.weights), *[(("filter", i), f) for i, f in enumerate(model.filters)], ("embeddings", model.embeddings)]:
        grad, own = seen[name]
        at = list(np.ndindex(grad.shape))[:: max(1, grad.size // 12)]
        for place in at:
            real = (int(own[place[0]]), *place[1:]) if own is not None else place
            old = array[real]
            sides = []
            for change in (1e-5, -1e-5):
                array[real] = old + change
                sides.append(loss())
            array[real] = old
            assert grad[place] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=2e-4), (name, place)


def test_samples_do_not_depend_on_luck(spark):
    labels = spark.createDataFrame([(i % 20, i % 2 if i < 20 else 1) for i in range(40)], "doc_id long, label int")
    docs = spark.createDataFrame([(i % 20, f"text {i}", "en") for i in range(60)], "doc_id long, text string, lang string")
    got = [toxicity.labelled_sample(docs.repartition(n), labels.repartition(n), "label", ["text", "lang"], 50)[0].to_dict("records") for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 20 and {r["label"] for r in got[0] if r["doc_id"] % 2 == 0} == {0}


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """Of 2,800 rows of label 1, the 2,500 whose ids have the smallest hashes have one word, the others another."""
    r = random.Random(6)
    ids = spark.range(6000).selectExpr("id", "xxhash64(cast(id as string), 'sample') as h").collect()
    ones = [x.id for x in sorted(ids, key=lambda x: x.h) if x.id < 2800]
    marked = dict.fromkeys(ones[:2500], "foul") | dict.fromkeys(ones[2500:], "vile")
    rows = []
    for i in range(6000):
        words = [r.choice("alpha beta gamma delta omega sigma".split()) for _ in range(8)]
        rows.append((i, " ".join(words + ([marked[i]] if i in marked else [])), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = df.selectExpr("doc_id", "int(doc_id < 2800) as label")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 2000)
    model = toxicity.fit(df, labels)
    scored = {x.doc_id: x.predicted for x in toxicity.score_documents(df, model).collect()}
    assert np.mean([scored[i] for i in ones[2500:]]) > 0.95 and np.mean([scored[i] for i in ones[:2500]]) > 0.95
    assert np.mean([scored[i] for i in range(2800, 6000)]) < 0.02
    again = toxicity.fit(df.repartition(7), labels.repartition(3))
    assert (again.parameters() == model.parameters()).all() and (again.scale, again.thresholds) == (model.scale, model.thresholds)


# 6: ordinal regression


def test_ordinal_model_by_its_formulas():
    s = quality.Settings(buckets=64)
    r = np.random.default_rng(1)
    model = quality.Model(s, [1.0, 1.5, 2.5, 4.0], r.normal(size=64), np.array([-0.5, 0.25, 1.0]))
    ids = quality.Features(64)
    for text in ("", "good words here", "BAD bad 42 $$ bad bad"):
        packed = ids.of(text)
        want = 0.0
        for k, p in enumerate(packed.tolist()):
            want += model.weights[p >> 32] / len(packed) + s.shape_scale * model.weights[p & 0xFFFFFFFF] / len(packed)
            if k and p >> 32 == packed[k - 1] >> 32:
                want += s.shape_scale * model.weights[63] / len(packed)
        assert model.value(packed) == pytest.approx(want)
        reach = [1 / (1 + math.exp(-(want - t))) for t in model.thresholds]
        share = [1 - reach[0], reach[0] - reach[1], reach[1] - reach[2], reach[2]]
        assert model.expected(np.array([want]))[0] == pytest.approx(sum(g * p for g, p in zip(model.grades, share)))
        assert model.tail(np.array([want]), 1.5)[0] == pytest.approx(reach[0]) and model.tail(np.array([want]), 2)[0] == pytest.approx(reach[1])


def test_training_finds_the_likelihoods_maximum():
    """With one feature a text, fitted chances are near the shares of grades."""
    r = random.Random(5)
    ids, docs, grades = quality.Features(1 << 10), [], []
    for i in range(900):
        word = "abc"[i % 3]
        docs.append(ids.of(word * 4))
        grades.append(r.choices([0.5, 1.5, 2.5], [(6, 3, 1), (2, 6, 2), (1, 3, 6)][i % 3])[0])
    model = quality.train(docs, np.array(grades), np.ones(900), quality.Settings(buckets=1 << 10, held_back=0.0))
    assert model.grades == [0.5, 1.5, 2.5] and (np.diff(model.thresholds) > 0).all()
    for i in range(3):
        own = np.array(grades)[i::3]
        tails = model.tails(np.array([model.value(docs[i])]))[0]
        assert tails.tolist() == pytest.approx([(own >= 1.5).mean(), (own >= 2.5).mean()], abs=0.12)


def test_grades_need_not_be_whole(spark):
    rows = [(i, ("fine words " if i % 2 else "poor!! ") * 9, [1.5, 2.5][i % 2]) for i in range(200)] + [(900, "x", float("nan")), (901, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade double")
    model = quality.fit(df, df.select("doc_id", "grade"))
    got = {r.doc_id: r for r in quality.rate_documents(df, model, grade=2.5).collect()}
    assert model.grades == [1.5, 2.5] and got[1].selected and not got[0].selected and 1.5 <= got[0].expected_grade <= 2 <= got[1].expected_grade <= 2.5


def test_shapes_of_long_chunks_take_one_pass():
    slow = re.compile(r"[^\W\d_]*[a-zß-ÿ][^\W\d_]*")  # goes back over a run from each of its places
    r = random.Random(2)
    for _ in range(3000):
        chunk = "".join(r.choice("aBz÷ßÿÉ漢9٣_-.$éÀ×ı") for _ in range(r.randint(1, 9)))
        want = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "W", slow.sub("w", chunk)))
        assert quality.shape_of(chunk) == re.sub(r"(.)\1+", r"\1", want)
    began = time.process_time()
    assert {quality.shape_of(x * 20_000) for x in ("A", "漢", "÷", "a")} == {"W"} and quality.shape_of("A9" * 20_000) == "W9" * 20_000
    assert time.process_time() - began < 4


# 3: media


def slow_features(samples):
    n, s = len(samples), list(samples)
    mean = sum(s) * 100 // n
    deviation = math.isqrt(max(sum(x * x for x in s) * 10_000 // n - mean * mean, 0))
    step = sum(abs(a - b) for a, b in zip(s, s[1:])) * 100 // max(n - 1, 1)
    shares = [sum(x >> 4 == k for x in s) * 10_000 // n for k in range(16)]
    return f"mean={mean};sd={deviation};step={step};shares=" + ",".join(map(str, shares))


def chosen(data):
    out = []
    for start in range(0, len(data), webp.FRAME):
        out.append(min(webp.candidates(np.frombuffer(data[start : start + webp.FRAME], np.uint8)), key=lambda c: c[0])[2])
    return out


def test_media_round_trips_by_every_coding():
    r = random.Random(9)
    ramp = bytes(k * 3 % 256 for k in range(64 * 40))
    payloads = [b"", b"x", b"a line that comes again and again\n" * 400, b"ACGT" * 30 + bytes(r.choice(b"ACGT") for _ in range(6000)), ramp, bytes(r.randrange(256) for _ in range(9000)), "漢字と🙂".encode() * 90_000]
    payloads.append(b"".join(r.choice([b"alfa", b"beta", b"gama", b"zeta", b"iota", b"unde"]) for _ in range(5000)))
    used = set()
    for p in payloads:
        full = webp.padded(p)
        media = webp.write_media(full)
        assert webp.read_samples(media) == full and webp.features(full) == slow_features(full)
        for how in chosen(full):
            used |= {n for n in ("palette", "predictor", "copies", "cache_bits") if getattr(how, n) is not None and getattr(how, n) is not False and not (n == "cache_bits" and how.cache_bits == 0)}
    assert used == {"palette", "predictor", "copies", "cache_bits"}


@pytest.mark.skipif(not Path(TABLES).is_dir(), reason="no test tables")
def test_documents_use_more_than_literals(spark):
    texts = [r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("text").collect()]
    ways = [how for t in texts for how in chosen(webp.padded((t or "").encode()))]
    assert sum(how.copies is not False for how in ways) > 50 and any(how.palette is not None for how in ways) and any(how.cache_bits for how in ways)


class Stream:
    """Bits of a file, written by hand, lowest first."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]
        return self

    def bytes(self):
        return bytes(sum(b << k for k, b in enumerate(self.bits[i : i + 8])) for i in range(0, len(self.bits), 8))


def simple_code(s, *symbols):
    """A code of one or two symbols, as the format's simple form has it."""
    s.put(1, 1).put(len(symbols) - 1, 1).put(1, 1).put(symbols[0], 8)
    for other in symbols[1:]:
        s.put(other, 8)


def test_streams_written_by_hand():
    # 3 x 2 pixels, subtracted green, greens 10 and 20 by a code of one bit, red 1, blue 2, alpha 255
    s = Stream().put(0x2F, 8).put(2, 14).put(1, 14).put(1, 1).put(0, 3)
    s.put(1, 1).put(2, 2).put(0, 1)  # a transform: subtract green; no other
    s.put(0, 1).put(0, 1)  # no cache, one group of codes
    for symbols in ((10, 20), (1,), (2,), (255,), (0,)):
        simple_code(s, *symbols)
    for bit in (0, 1, 1, 0, 0, 1):
        s.put(bit, 1)
    green = np.array([[10, 20, 20], [10, 10, 20]], np.uint32)
    want = 0xFF000000 | (1 + green) << 16 | green << 8 | (2 + green)
    assert (vp8l.decode_vp8l(s.bytes()) == want).all()
    # 4 x 1 pixels by a palette of two colours, packed into one byte: indices 1, 0, 1, 1
    s = Stream().put(0x2F, 8).put(3, 14).put(0, 14).put(0, 1).put(0, 3)
    s.put(1, 1).put(3, 2).put(1, 8)  # a palette of two colours, each the difference from the one before
    s.put(0, 1)
    for symbols in ((5, 7), (0,), (9,), (255, 0), (0,)):
        simple_code(s, *symbols)
    # simple codes list their symbols; the smaller has the bit 0. First colour: green 5, alpha 255; then green 7, alpha 0
    s.put(0, 1).put(1, 1).put(1, 1).put(0, 1)
    s.put(0, 1).put(0, 1).put(0, 1)
    for symbols in ((0b1101,), (0,), (0,), (0,), (0,)):
        simple_code(s, *symbols)
    first, second = 0xFF000509, 0xFF000C12
    assert vp8l.decode_vp8l(s.bytes()).tolist() == [[second, first, second, second]]


# 8 and all: the queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    r = random.Random(12)
    words = "alpha beta gamma delta omega sigma kappa lambda".split()
    docs, labels = [], []
    for i in range(300):
        toxic, low = r.random() < 0.3, r.random() < 0.3
        text = [r.choice(words) for _ in range(r.choice([0, 3, 30, 90]))] + (["vile"] if toxic else [])
        docs.append((i if i % 17 else None, " ".join(w.upper() + "$$" if low else w for w in text) if i % 23 else None, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "é", "Z", None])))
        labels.append((i, int(not low), int(toxic)))
    spark.createDataFrame([*docs, *docs[:40]], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    g = np.random.default_rng(0)
    spark.createDataFrame([(i, g.normal(size=12).tolist()) for i in range(210)], "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_each_query_answers_for_every_row(spark, folder, name):
    out = queries.queries()[name](spark, folder)
    rows = out.collect()
    if name.startswith("op2"):
        assert len(rows) == 3 * 10 and {r.query_id for r in rows} == {0, 100, 200}
        return
    assert len(rows) == 340 and sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())


def test_mix_against_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder.removeprefix('file://')}/documents.parquet/*.parquet'")
    theirs = con.execute(queries.OP8_SQL)
    names = [d[0] for d in theirs.description]
    plain = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    want = sorted(plain(r) for r in theirs.fetchall())
    got = sorted(plain(r[n] for n in names) for r in queries.op8_systematic_mix(spark, folder).collect())
    assert got == want and any(r[0] == "None" for r in got)


def test_mix_counts_once_on_a_slim_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    size = mixing.word_count("text")
    part = mixing.part_of(F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    slim = docs.select("source", size.alias("__size"), part.alias("__part"))
    both = [sorted(map(str, mixing.with_copies(docs.repartition(n), "doc_id", "source", size, part=part, counted=c).collect())) for n, c in ((1, None), (4, slim), (7, slim))]
    assert both[0] == both[1] == both[2]


def test_a_workspace_leaves_nothing_behind(spark, folder):
    from shardloom.llm.common import shared_dir

    place = Path(shared_dir(spark).removeprefix("file://"))
    before = set(place.iterdir())
    with workspace(spark):
        assert queries.op5_simhash(spark, folder).count() == 340
    assert set(place.iterdir()) == before
