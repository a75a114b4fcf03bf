"""Token ids in Arrow files of equal-length sequences, for zero-copy random access.

Documents in ascending order of their ids are tokenized, each ends with an end
id, and the stream is cut into sequences of ``LENGTH`` ids. A file is an Arrow
IPC file whose record batches hold two fixed-size lists: ``ids`` and ``mask``
(a bit each, set where there is an id; only a file's last sequence has others). Beside it, an
index file holds each document's id and length. Each task writes one pair of
files, batch by batch, into a folder of the shared store.

A null text is the empty text: it has the end id alone. Null ids come first;
rows of equal ids are in order of their texts' hash. An empty table gives no
file and an empty result.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configure, fresh_path, stored, text_of

LENGTH = 2048
SEQUENCES = 64  # of a record batch
#: Words whose ids a worker remembers, and the longest of them; others are tokenized each time.
REMEMBER, LONGEST = 700_000, 64
DTYPE = np.dtype("<u2")
MARKS = ".,;:!?"
#: White space to Python's split, but not to a tokenizer's pattern.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")

_TOKENIZERS: dict[str, WordTokens] = {}


class WordTokens:
    """The tokenizers library with its words' ids remembered.

    For a tokenizer that drops white space, the ids of a text are those of its
    parts between white space. A part's ids are in turn those of the part
    without a closing mark, and of the mark, since marks after a letter or
    digit are words of their own; and ASCII parts go by their lower case. Texts
    that hold an added token or ``NOT_SPACE`` go to the library whole.
    """

    def __init__(self, path: str):
        # a task has a core of its own: threads of the library's would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # a part in lower case may look like an added token, no part is one
        self.whole = Tokenizer.from_file(path)
        self.apart = (*NOT_SPACE, *(t.content for t in self.whole.get_added_tokens_decoder().values()))
        if self.library.get_vocab_size() > np.iinfo(DTYPE).max + 1:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.known: dict[str, bytes] = {}
        self.marks = dict(zip(MARKS, self.encode(list(MARKS))))

    def encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, DTYPE).tobytes() for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def core(self, part: str) -> str:
        if len(part) > 1 and part[-1] in self.marks and part[-2].isalnum():
            # normalized, a letter may end with a combining mark, which the closing mark would join
            if part.isascii() or unicodedata.normalize("NFC", part[:-1]).lower()[-1].isalnum():
                part = part[:-1]
        return part.lower() if part.isascii() else part

    def of(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.apart)]
        if odd:
            out = self.of_plain(["" if any(a in t for a in self.apart) else t for t in texts])
            for i in odd:
                out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, DTYPE).tobytes()
            return out
        return self.of_plain(texts)

    def of_plain(self, texts: list[str]) -> list[bytes]:
        split = [t.split() for t in texts]
        flat = list(chain.from_iterable(split))
        ids = list(map(self.known.get, flat))
        new = [i for i, v in enumerate(ids) if v is None]
        cores = {part: self.core(part) for part in {flat[i] for i in new}}
        bare = set(cores.values())
        found = {c: self.known[c] for c in bare if c in self.known}
        todo = list(bare.difference(found))
        found.update(zip(todo, self.encode(todo)))
        parts = {p: found[c] + (self.marks[p[-1]] if len(c) < len(p) else b"") for p, c in cores.items()}
        if len(self.known) < REMEMBER:
            for new_ids in (found, parts):
                self.known.update((part, v) for part, v in new_ids.items() if len(part) <= LONGEST)
        for i in new:
            ids[i] = parts[flat[i]]
        out, at = [], 0
        for words in split:
            out.append(b"".join(ids[at : at + len(words)]))
            at += len(words)
        return out


def tokenizer(path: str) -> WordTokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokens(path)
    return _TOKENIZERS[path]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Writes a stream of packed ids as record batches of fixed-size lists."""

    def __init__(self, sink, length: int = LENGTH, sequences: int = SEQUENCES):
        self.length, self.block = length, length * sequences
        self.schema = schema(length)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[bytes] = []
        self.held = 0  # ids that wait

    def add(self, packed: bytes) -> None:
        self.waiting.append(packed)
        self.held += len(packed) // DTYPE.itemsize
        if self.held >= self.block:
            ids = np.frombuffer(b"".join(self.waiting), DTYPE)
            whole = len(ids) // self.block * self.block
            for start in range(0, whole, self.block):
                self.write(ids[start : start + self.block], self.block)
            rest = ids[whole:]
            self.waiting, self.held = [rest.tobytes()], len(rest)

    def write(self, ids: np.ndarray, count: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:count] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids.astype(np.uint16), mask), self.schema)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.frombuffer(b"".join(self.waiting), DTYPE)
            full = np.zeros(-(-len(ids) // self.length) * self.length, DTYPE)
            full[: len(ids)] = ids
            self.write(full, len(ids))
        self.file.close()


class SequenceReader:
    """Random access to a file's sequences; a mapped file's ids are not copied."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batches: tuple[int, tuple[np.ndarray, np.ndarray]] | None = None
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids (a view of the buffer) and mask of a record batch, as (sequences, length)."""
        if self.batches is None or self.batches[0] != k:
            b = self.file.get_batch(k)
            self.batches = k, tuple(b.column(i).flatten().to_numpy(zero_copy_only=i == 0).reshape(-1, self.length) for i in (0, 1))
        return self.batches[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // self.rows)
        return ids[i % self.rows], mask[i % self.rows]

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Ids from ``start`` on, across sequences and batches."""
        out, size = [], self.rows * self.length
        while count > 0:
            k, at = divmod(start, size)
            ids, mask = (x.reshape(-1) for x in self.batch(k))
            part = ids[at : at + count]
            if len(part) == 0 or not mask[at : at + len(part)].all():
                raise ValueError("ids beyond the end of the file")
            out.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_files(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Write all documents; one row a file: ``place`` in order, ``file``, ``index``, ``n_tokens``.

    The rows are stored: a file that they name was closed by the task that reported it.
    """
    spark = docs.sparkSession
    configure(spark)
    text = text_of(text_col)
    ordered = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
    )
    end = np.array([end_id], DTYPE).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        writer, ids, counts, total = None, [], [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                store, place = opened(name)
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                sink = store.open_output_stream(place + ".arrow")
                writer = SequenceWriter(sink, length)
            for packed in words.of(batch.column("text").to_pylist()):
                packed += end
                writer.add(packed)
                counts.append(len(packed) // DTYPE.itemsize)
            ids.append(batch.column("doc_id"))
        if writer is not None:
            writer.close()
            sink.close()
            counts = np.array(counts, np.int64)
            total = int(counts.sum())
            table = pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "n_tokens": counts})
            with store.open_output_stream(place + ".index.arrow") as out, pa.ipc.new_file(out, table.schema) as index:
                index.write_table(table, max_chunksize=1 << 16)
            yield pa.RecordBatch.from_pydict({"place": pa.array([TaskContext.get().partitionId()], pa.int64()), "file": [name + ".arrow"], "index": [name + ".index.arrow"], "n_tokens": pa.array([total], pa.int64())})

    return stored(ordered.mapInArrow(write, "place long, file string, index string, n_tokens long"), "files")[0]


def read_files(files: DataFrame) -> DataFrame:
    """Each document of the files: ``doc_id``, ``start``, ``n_tokens`` and its ids' ``ids_crc32``."""
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                store, place = opened(row.file)
                _, index_place = opened(row.index)
                with store.open_input_file(place) as source, store.open_input_file(index_place) as index_source:
                    reader, index = SequenceReader(source), pa.ipc.open_file(index_source)
                    at = 0
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        counts = part.column("n_tokens").to_numpy()
                        starts = at + np.cumsum(counts) - counts
                        crc = [zlib.crc32(reader.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
                        at += int(counts.sum())
                        yield pd.DataFrame({"doc_id": part.column("doc_id").to_pandas(integer_object_nulls=True), "start": starts + row.before, "n_tokens": counts, "ids_crc32": crc})

    n = max(1, files.count())
    return placed.repartitionByRange(n, "place").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_documents(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_files(write_files(docs, path, end_id, folder))
