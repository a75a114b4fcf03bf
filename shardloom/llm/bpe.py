"""Byte-level BPE encoding and decoding with the tiktoken library.

``encode_column`` gives the ids of whole texts as packed little-endian
unsigned 32-bit integers (a null text has the ids of the empty text: none);
``decode_column`` gives the raw bytes of such ids (null: null). Runs of white
space that the library's pattern cannot match without overflowing its stack are
matched here. Texts keep their rows, so ties, repeated rows and extra columns need no care; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, text_of

#: A text is split so that one call of the library gets about so many characters.
CHUNK = 100_000

#: A match never holds a letter or digit and a space or line feed after it, so
#: that place always lies between two matches; so does that between a letter
#: and a digit. No lookahead of the pattern reaches across either.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")

#: Longer runs of white space (the library's: U+001C to U+001F are none) are matched here.
LONG_RUN = 100_000
#: Signs of such a run that go to the library as one piece.
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, kept by each Python worker."""
    import tiktoken

    key = (path, pattern)
    if key not in _ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def split_safely(text: str, chunk: int = CHUNK) -> list[str]:
    """Pieces of at least ``chunk`` characters, cut only where no match goes across.

    Where no safe place follows, the rest stays in one piece.
    """
    if len(text) <= chunk:
        return [text]
    pieces, start = [], 0
    while len(text) - start > chunk:
        cut = SAFE.search(text, start + chunk)
        if cut is None or cut.start() >= len(text):
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


@lru_cache(maxsize=8)
def long_runs(size: int) -> regex.Pattern:
    return regex.compile(SPACES + "{" + str(size) + ",}+")


def ids_of(enc, text: str, chunk: int = CHUNK, long_run: int = LONG_RUN) -> Iterator[list[int]]:
    """Ids of a text, part by part.

    Of a run of white space, the pattern takes all but the last sign as one
    match, which goes on with what follows; at the end of the text it takes all.
    """
    start = 0
    for run in long_runs(long_run).finditer(text) if len(text) >= long_run else ():
        for piece in split_safely(text[start : run.start()], chunk):
            yield enc.encode_ordinary(piece)
        start = run.end() if run.end() == len(text) else run.end() - 1
        yield enc._encode_single_piece(text[run.start() : start].encode())
    for piece in split_safely(text[start:], chunk):
        yield enc.encode_ordinary(piece)


def encode_text(enc, text: str, chunk: int = CHUNK, long_run: int = LONG_RUN) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    ids = [np.array(part, dtype="<u4") for part in ids_of(enc, text, chunk, long_run)]
    return (ids[0] if len(ids) == 1 else np.concatenate(ids)).tobytes()


def decode_ids(enc, packed: bytes) -> bytes:
    return enc.decode_bytes(np.frombuffer(packed, "<u4").tolist())


def encode_column(text: Column, path: str, pattern: str, chunk: int = CHUNK) -> Column:
    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path, pattern)
        for texts in batches:
            yield pd.Series([encode_text(enc, t or "", chunk) for t in texts], dtype=object)

    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path, pattern)
        for packed in batches:
            yield pd.Series([None if p is None else decode_ids(enc, p) for p in packed], dtype=object)

    return decode(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` bytes of each document; one worker does both."""
    configure(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, pattern)
        for texts in batches:
            ids = [encode_text(enc, t) for t in texts]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([decode_ids(enc, p) for p in ids], dtype=object)})

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), both(text_of(text_col)).alias("b")).select("doc_id", "b.ids", "b.decoded")
