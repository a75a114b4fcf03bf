"""The pipeline's stages on a small folder with awkward rows, against what each must do."""

import random
from collections import Counter

import corpus_pipeline

from shardloom.llm import bpe
from shardloom.llm.queries import quality_model, split_pattern, tokenizer_file, toxicity_model
from shardloom.llm.simhash import fingerprint


def make_folder(spark, path):
    r = random.Random(4)
    words = "alpha beta gamma delta omega sigma kappa lambda".split()
    docs, labels = [], []
    for i in range(400):
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        toxic, low = r.random() < 0.25, r.random() < 0.2
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(["foul", "vile"]))
        text = [w.upper() + "$$" for w in text] if low else text
        docs.append((i, " ".join(text), "en", f"s{i % 3}", 1))
        labels.append((i, int(not low), int(toxic)))
    docs += [(1000 + i, d[1], *d[2:]) for i, d in enumerate(docs[:60])] + [(5, *docs[5][1:]), (2000, None, None, None, None), (None, "alpha beta gamma", "en", "s0", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, labels


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, labels = make_folder(spark, folder)
    bad = {i for i, q, t in labels if t or not q}
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes, outs = now.columns, [], {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        outs[name] = now.collect()
        if name != "bpe":
            assert now.columns == columns
        sizes.append(len(outs[name]))
    texts = {d[0]: d[1] for d in docs}
    toxic = {t for i, q, x in labels if x for t in [texts[i]]}
    assert not [r for r in outs["toxicity"] if r.text in toxic] or len([r for r in outs["toxicity"] if r.text in toxic]) < 0.05 * len(toxic)
    clean = [d for d in docs if d[0] is not None and d[0] < 400 and d[0] not in bad]
    assert len({r.doc_id for r in outs["quality"]} & {d[0] for d in clean}) > 0.97 * len(clean)
    prints = [fingerprint(r.text or "") for r in outs["near_duplicates"]]
    assert all(bin(a ^ b).count("1") > 3 for k, a in enumerate(prints) for b in prints[:k])
    before = {r.doc_id for r in outs["quality"]}
    assert {r.doc_id for r in outs["near_duplicates"]} <= before and all(c == 1 for c in Counter(r.doc_id for r in outs["near_duplicates"]).values())
    copies = Counter(r.doc_id for r in outs["mix"])
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in outs["near_duplicates"]}
    enc = bpe.encoding(tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern())
    by_id = {r.doc_id: r.text for r in outs["mix"]}
    assert all(r.n_tokens == len(enc.encode_ordinary(by_id[r.doc_id] or "")) for r in outs["bpe"]) and sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, folder).count() == sizes[-1]


def test_empty_folder(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    assert toxicity_model(spark, f"file://{tmp_path}").constant == 0.0 and quality_model(spark, f"file://{tmp_path}").grades == []
