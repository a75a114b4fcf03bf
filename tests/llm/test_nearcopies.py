"""The pipeline's near-copy stage against all pairs of five-word shingle sets."""

import random

import corpus_pipeline

from shardloom.llm import nearcopies
from shardloom.llm.simhash import fingerprint


def slow_shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def linked(x, y):
    a, b = slow_shingles(x), slow_shingles(y)
    return (bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)) or bin(fingerprint(x or "") ^ fingerprint(y or "")).count("1") <= 3


def test_near_copies_against_all_pairs(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one", "One", "a b c d", "a  b c D", "a b c d e"]
    for size in (30, 60, 120, 400):
        for _ in range(6):
            base = [r.choice(words) for _ in range(size)]
            if r.random() < 0.5:
                base[:0] = "a line that is common to very many of the texts here".split()
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, 5, 9, 14):
                copy = list(base)
                for _ in range(edits):
                    copy[r.randrange(len(copy))] = r.choice(words)
                texts.append(" ".join(copy))
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if linked(texts[i], texts[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted(i for i in range(len(texts)) if find(i) == i)
    got = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(x.doc_id for x in got.collect()) == want


def test_only_some_texts_sampled(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SAMPLE", 10)
    r = random.Random(3)
    base = [[f"v{r.randrange(900)}" for _ in range(80)] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join([*b[:40], "changed", *b[41:]])) for i, b in enumerate(base)]
    got = nearcopies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == list(range(40))


def test_parities_never_exceed_the_difference():
    r = random.Random(8)
    for size in (0, 1, 5, 60, 64, 65, 300, 5000):
        words = [f"x{r.randrange(3000)}" for _ in range(size)]
        for other in (words[: size // 2], words, [*words, "y"], [f"z{i}" for i in range(700)]):
            a, b = (nearcopies.shingles(" ".join(w)) for w in (words, other))
            assert nearcopies.least_apart(nearcopies.parities(a), nearcopies.parities(b)) <= len(set(a.tolist()) ^ set(b.tolist()))
