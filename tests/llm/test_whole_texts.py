"""Packed ids against a freshly loaded tokenizer, text by text."""

from tokenizers import Tokenizer

from shardloom.llm import arrowfile
from shardloom.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


def test_texts_are_encoded_whole(spark):
    spaces = [chr(c) for c in range(0x3100) if not chr(c).isalnum()]
    texts = [f"a{c}b. {c}" for c in spaces] + ["a\x1cb", "\x1f", "x <|endoftext|> y", "<|startoftext|>", "<|ENDOFTEXT|> <|EndOfText|>.", "a<|endoftext|>.", "İ. É! é. क़.", "it's. IT'S, 3! ²?"]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    words = arrowfile.WordTokens(PATH)
    for _ in range(2):  # again, with the parts remembered
        got = [arrowfile.np.frombuffer(b, arrowfile.DTYPE).tolist() for b in words.of(texts)]
        assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = arrowfile.packed_documents(docs, PATH).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows} == {i: (len(w) + 1, arrowfile.zlib.crc32(arrowfile.np.array([*w, 1], "<u4").tobytes())) for i, w in enumerate(want)}
