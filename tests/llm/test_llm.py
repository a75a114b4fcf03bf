"""Each operator against brute force, round trips or held-out labels, and on awkward tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.llm import ann, arrowfile, bpe, lm, mixing, pieces, quality, simhash, toxicity, vp8l, webp
from shardloom.llm.queries import split_pattern, tokenizer_file

MULTI = tokenizer_file("byte_bpe_multi_50k.tiktoken")
WORDS = tokenizer_file("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x" for i in range(60_000))
#: Nulls, empty and blank texts, ties, repeated rows, a long text, other scripts, and columns with clashing names.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a"), (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
    (2, "", "en", None), (3, None, None, "b"), (None, "no id, it's 2024 here", "fr", "a"), (4, " \t\n ", "de", "b"),
    (5, LONG, "en", "a"), (6, "naïve café Ωμέγα 漢字 🙂🙂  don't\n\n\nx", "fr", None), (7, "word", "en", "c"), (8, "a" * 300_000, "en", "c"),
]
CLASH = ("score", "ids", "fp", "size", "block", "key", "target", "h")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def rows_by(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=str)


# 3: media


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 14), st.integers(1, 14), st.integers(0, 2**32 - 1), st.booleans())
def test_vp8l_round_trips(height, width, seed, few):
    r = np.random.default_rng(seed)
    pixels = r.choice(np.array([0xFF102030, 0xFF102031, 0x00FFFFFF], np.uint32), (height, width)) if few else r.integers(0, 2**32, (height, width), dtype=np.uint64).astype(np.uint32)
    tiles = (vp8l.ceil_div(height, 2), vp8l.ceil_div(width, 2))
    modes, cross = r.integers(0, 14, tiles).astype(np.uint32) << 8, r.integers(0, 2**24, tiles).astype(np.uint32)
    ways = [
        vp8l.Choices(), vp8l.Choices(copies=True), vp8l.Choices(cache_bits=4, copies=True), vp8l.Choices(predictor=modes), vp8l.Choices(cross=cross),
        vp8l.Choices(groups=r.integers(0, 3, tiles), cache_bits=3, copies=True), vp8l.Choices(predictor=modes, cross=cross, subtract_green=True, cache_bits=5),
    ]
    if few:
        ways.append(vp8l.Choices(palette=np.unique(pixels), copies=True))
    for way in ways:
        assert (vp8l.decode_vp8l(vp8l.encode_vp8l(pixels, way)) == pixels).all()


def test_known_webp_file_and_damage():
    known = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")  # one transparent pixel, by another encoder
    assert vp8l.decode_vp8l(vp8l.riff_images(known)[0]).tolist() == [[0]]
    media = webp.write_media(webp.padded(b"some text " * 50))
    for bad in (b"RIFF", media[:40], media.replace(b"VP8L", b"XXXX")):
        with pytest.raises(ValueError):
            webp.read_samples(bad)


def test_media_digests(odd, none):
    got = {r.doc_id: r for r in webp.media_digests(odd).collect()}
    for doc_id, text, *_ in ROWS:
        data = (text or "").encode()
        full = data + bytes(-len(data) % 64 or (0 if data else 64))
        media = webp.write_media(full)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), webp.features(full))
    assert webp.media_digests(none).count() == 0


# 4: byte-level BPE


def test_bpe_against_whole_texts(odd, none):
    enc = bpe.encoding(MULTI, split_pattern())
    for r in bpe.encode_documents(odd, MULTI, split_pattern()).collect():
        text = next(t for d, t, *_ in ROWS if d == r.doc_id) or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert bpe.encode_documents(none, MULTI, split_pattern()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab1 '\n\tsé漢.!  "), max_size=80), st.integers(1, 9))
def test_safe_splits(text, chunk):
    enc = bpe.encoding(MULTI, split_pattern())
    assert "".join(bpe.split_safely(text, chunk)) == text
    assert np.frombuffer(bpe.encode_text(enc, text, chunk), "<u4").tolist() == enc.encode_ordinary(text)


# 10: word pieces


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=9), st.sets(st.text("abc", min_size=1, max_size=4), max_size=9), st.text("abc", min_size=1, max_size=12))
def test_pieces_against_greedy(initial, continuing, word):
    def greedy(w, at=0, n=0):
        while at < len(w):
            pieces_here = initial if at == 0 else continuing
            size = next((k for k in range(len(w) - at, 0, -1) if w[at : at + k] in pieces_here), 0)
            if not size:
                return 1
            at, n = at + size, n + 1
        return n

    machine = pieces.Automaton({p.encode() for p in initial}, {p.encode() for p in continuing})
    assert machine.count(word.encode()) == greedy(word)


def test_piece_counts(odd, none):
    machine = pieces.automaton(MULTI)
    for r in pieces.count_pieces(odd, MULTI).collect():
        words = pieces.WORDS.findall(next(t for d, t, *_ in ROWS if d == r.doc_id) or "")
        assert (r.n_words, r.n_pieces) == (len(words), sum(machine.count(w.encode()) for w in words))
    assert pieces.count_pieces(none, MULTI).count() == 0


# 5: SimHash


def slow_fingerprint(text, k=3):
    words = bytes(text or "", "utf-8").lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    root = {v: v for v in values}
    for v in sorted(values):
        for w in values:
            if bin(v ^ w).count("1") <= bits:
                a, b = root[v], root[w]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_links_lose_none(spark, bits):
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, bits + 2))) for b in base for _ in range(12)} | set(base)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    prints = spark.createDataFrame([(i, *v) for i, v in enumerate(signed)], "doc_id long, fp long")
    pairs = {(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(prints.select("fp"), bits).collect()}
    want = {frozenset((a, b)) for a in values for b in values if a < b and bin(a ^ b).count("1") <= bits}
    assert {frozenset(p) for p in pairs} == want and len(pairs) == len(want)
    ids = {v[0] % (1 << 64): i for i, v in enumerate(signed)}
    root = brute_components(values, bits)
    least = defaultdict(lambda: 10**9)
    for v, k in root.items():
        least[k] = min(least[k], ids[v])
    assert {r.fp % (1 << 64): r.component_id for r in simhash.grouped(prints, bits).collect()} == {v: least[root[v]] for v in values}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_on_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.fingerprint == f"{slow_fingerprint(next(t for d, t, *_ in ROWS if d == r.doc_id)):016x}"
    ids = {r.doc_id: r.component_id for r in got}
    assert ids[2] == ids[3] == ids[4] == 2 and ids[1] == 1 and ids[None] is None
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 5, 6, 7, 8]


# 8: mixing


def brute_targets(sizes, weights, share, most):
    total, capped = share * sum(sizes), set()
    while True:
        rest = sum(w for k, w in enumerate(weights) if k not in capped)
        level = (total - sum(most * sizes[k] for k in capped)) / rest if rest else 0
        over = {k for k, w in enumerate(weights) if k not in capped and level * w >= most * sizes[k]}
        if not over:
            return [most * s if k in capped else level * w for k, (s, w) in enumerate(zip(sizes, weights))]
        capped |= over


def test_mix(spark, odd, none):
    r = random.Random(1)
    docs = [(i, " ".join("w" * 1 for _ in range(r.choice([1, 5, 30, 200]))), r.choice(["a"] * 6 + ["b", "c", "é", None])) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    mixed = mixing.with_copies(df, "doc_id", "source", mixing.word_count("text"))
    got = mixed.collect()
    names = ["a", "b", "c", "é", None]
    sizes = [sum(x["__size"] for x in got if x.source == n) for n in names]
    targets = brute_targets(sizes, [3, 1, 2, 3, 1], 1.5, 2.0)
    for n, s, t in zip(names, sizes, targets):
        own = [x for x in got if x.source == n]
        assert own[0]["__source_size"] == s and own[0]["__target"] == pytest.approx(t)
        assert all(math.floor(t / s) <= x["__copies"] <= math.ceil(t / s) for x in own)
        assert sum(x["__size"] * x["__copies"] for x in own) == pytest.approx(t, abs=2 * 200)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.with_copies(df.repartition(2), "doc_id", "source", mixing.word_count("text")).collect()), key=str)
    assert mixing.emitted(mixed).count() == sum(x["__copies"] for x in got) and mixing.emitted(mixed).columns == df.columns
    strange = mixing.with_copies(odd, "doc_id", "source", mixing.word_count("text"))
    assert strange.count() == len(ROWS) and strange.where("__copies > 2 or __copies < 0").count() == 0
    assert mixing.with_copies(none, "doc_id", "source", mixing.word_count("text")).count() == 0
    assert "PythonUDF" not in mixed._jdf.queryExecution().toString()


# 7: Arrow files


def test_arrow_files(odd, none):
    words = arrowfile.tokenizer(WORDS)
    got = sorted(arrowfile.packed_documents(odd, WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    at = 0
    for r in got:
        text = next(t for d, t, *_ in ROWS if d == r.doc_id) or ""
        ids = words.library.encode(text, add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert arrowfile.packed_documents(none, WORDS).count() == 0


def test_sequences(tmp_path):
    import pyarrow as pa

    ids = np.arange(1000, dtype="<u2")
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as sink:
        w = arrowfile.SequenceWriter(sink, length=16, sequences=4)
        for k in range(0, 1000, 7):
            w.add(ids[k : k + 7].tobytes())
        w.close()
    reader = arrowfile.SequenceReader(pa.memory_map(str(tmp_path / "x.arrow")))
    assert reader.tokens(37, 500).tolist() == list(range(37, 537))
    assert reader.sequence(3)[0].tolist() == list(range(48, 64)) and reader.sequence(62)[1].sum() == 1000 - 62 * 16
    with pytest.raises(ValueError):
        reader.tokens(990, 20)


# 9: language models


def test_cross_entropy_difference(spark, odd, none):
    s = lm.Settings(block_tokens=40, slice_tokens=30)
    target = spark.createDataFrame([("the quick fox",), (None,), ("lazy dog the quick",)], "text string")
    docs = odd.where("length(coalesce(text, '')) < 1000")
    enc = bpe.encoding(MULTI, split_pattern())
    size = 50_256

    def grams(texts):
        ids = [enc.encode_ordinary(t or "") for t in texts]
        return Counter(b for e in ids for b in zip([size, *e], e))

    of_target, of_docs = grams(r.text for r in target.collect()), grams(r.text for r in docs.collect())

    def loss(model, b, drawn):
        last, context = sum(n for (_, w), n in model.items() if w == b[1]), sum(n for (v, _), n in model.items() if v == b[0])
        single = (last + s.even) / (sum(model.values()) + s.even * size)
        return -math.log((model[b] + drawn * single) / (context + drawn))

    drawn = min(s.drawn, key=lambda d: sum(n * loss(of_docs - Counter([b]), b, d) for b, n in of_docs.items()))
    got = lm.score_documents(docs, target, MULTI, split_pattern(), size, s).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = enc.encode_ordinary(next(t for d, t, *_ in ROWS if d == r.doc_id) or "")
        assert r.n_tokens == len(ids)
        if not ids:
            assert r.target_loss is None and r.score == 0
            continue
        of_others = of_docs - grams([enc.decode(ids)])
        means = [np.mean([loss(m, b, drawn) for b in zip([size, *ids], ids)]) for m in (of_target, of_others)]
        assert (r.target_loss, r.background_loss) == pytest.approx(tuple(means)) and r.score == pytest.approx(means[0] - means[1])
    assert lm.score_documents(none, target, MULTI, split_pattern(), size, s).count() == 0


def test_texts_with_copies_are_told_from_texts_without(spark):
    """However the rows lie in blocks and slices."""
    rng = np.random.default_rng(5)
    enc = bpe.encoding(MULTI, split_pattern())
    words = [w for w in (enc.decode([k]) for k in range(5_000, 9_000)) if w[0] == " " and w[1:].isalpha()][:400]  # one token each
    texts = ["".join(rng.choice(words, 60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:8])), "doc_id long, text string")
    target = spark.createDataFrame([("".join(words),)], "text string")
    found = []
    for s in (lm.Settings(), lm.Settings(block_tokens=500, slice_tokens=200)):
        got = {r.doc_id: r.background_loss for r in lm.score_documents(docs, target, MULTI, split_pattern(), 50_256, s).collect()}
        twice = [v for k, v in got.items() if k < 8 or k >= 80]
        assert len(got) == 88 and max(twice) < min(v for k, v in got.items() if 8 <= k < 80)
        found.append([got[k] for k in sorted(got)])
    assert found[0] == pytest.approx(found[1])


# 2: nearest neighbours


def test_neighbours(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(30, 16))
    data = (centres[r.integers(0, 30, 1500)] + 0.3 * r.normal(size=(1500, 16))).astype(np.float32)
    data[5] = data[6] = data[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    bad = [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [1.0] * 15 + [float("nan")], 0), (2300, [1.0] * 15 + [None], 0), (2400, [float("inf")] * 16, 0), (2500, [], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int").repartition(4)
    query = F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False))
    got = defaultdict(list)
    for x in ann.search(df, query).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    assert set(got) == set(range(0, 1500, 100))
    hits, exact = 0, data.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(1500), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(d[v] == s for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len(set(order) & {v for _, v, _ in found})
    assert hits >= 0.9 * 150 and [v for _, v, _ in got[100]][:2] == [5, 6]
    few = ann.search(df.where("vec_id in (0, 1, 2, 2000)"), query).collect()
    assert [(x["rank"]) for x in few] == [1, 2]
    assert ann.search(df.where("false"), query).count() == 0 and ann.search(df.where("vec_id = 0"), query).count() == 0


# 1 and 6: classifiers


def texts_with(r, n, marker):
    out = []
    for i in range(n):
        words = [r.choice("alpha beta gamma delta omega sigma kappa lambda".split()) for _ in range(r.randint(5, 60))]
        bad = r.random() < 0.3
        if bad:
            words.insert(r.randrange(len(words)), r.choice(marker))
        out.append((i, " ".join(words), "en" if i % 2 else "de", int(bad)))
    return out


def test_toxicity(spark, odd, none):
    rows = texts_with(random.Random(2), 500, ["foul", "vile"])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    model = toxicity.fit(df, df.where("doc_id < 350").select("doc_id", "label"))
    scored = {x.doc_id: x for x in toxicity.score_documents(df, model).collect()}
    held = [x for x in rows if x[0] >= 350]
    assert np.mean([scored[i].predicted == y for i, _, _, y in held]) > 0.95 and all(0 <= x.score <= 1 for x in scored.values())
    strange = toxicity.score_documents(odd, model).collect()
    assert len(strange) == len(ROWS) and all(0 <= x.score <= 1 for x in strange)
    assert len({x.score for x in strange if x.doc_id in (2, 3, 4)}) == 1
    assert toxicity.score_documents(none, model).count() == 0
    alone = toxicity.fit(df, df.where("label = 0").select("doc_id", "label"))
    assert {x.score for x in toxicity.score_documents(odd, alone).collect()} == {0.0}
    assert toxicity.fit(df, df.where("false").select("doc_id", "label")).constant == 0.0


def test_ordinal_quality(spark, odd, none):
    r = random.Random(3)
    rows = []
    for i in range(600):
        grade = r.randrange(4)
        rows.append((i, " ".join("good" if r.random() < grade / 3 else "poor!!" for _ in range(40)), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.fit(df, df.where("doc_id < 400").select("doc_id", "grade"))
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    got = {x.doc_id: x for x in quality.rate_documents(df, model, grade=2).collect()}
    assert np.mean([abs(got[i].expected_grade - g) < 0.75 for i, _, g in rows[400:]]) > 0.9
    assert np.mean([got[i].selected == (g >= 2) for i, _, g in rows[400:]]) > 0.9
    values = np.array([-3.0, 0.0, 2.0])
    assert (np.diff(model.tails(values), axis=1) < 0).all() and model.tail(values, 0).tolist() == [1, 1, 1] and model.tail(values, 9).tolist() == [0, 0, 0]
    assert quality.rate_documents(odd, model, grade=2).count() == len(ROWS) and quality.rate_documents(none, model, grade=2).count() == 0
    same = quality.fit(df, df.where("grade = 1").select("doc_id", "grade"))
    assert {(x.expected_grade, x.tail) for x in quality.rate_documents(odd, same, grade=1).collect()} == {(1.0, 1.0)}
