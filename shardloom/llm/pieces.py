"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match-first word pieces (MaxMatch) in one pass over a word's
bytes: a trie over the vocabulary, and for each node a failure link with the
number of pieces that following it pops. Only counts are kept, no pieces are
built. A word that the vocabulary cannot spell counts as one unknown piece.

Each row gets its own result: a null or empty text has no words and no
pieces; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, text_of

#: Words of a text: runs of letters, marks and digits, and single other signs.
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]")

#: Distinct chunks whose counts a worker remembers, and the longest of them; others are counted again.
REMEMBER, LONGEST = 400_000, 64


class Automaton:
    """Trie, failure links and popped-piece counts of a vocabulary.

    ``initial`` are pieces that start a word, ``continuing`` those that go on.
    """

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # node 0 starts a word, node 1 goes on
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for byte in piece:
                    child = self.next[node].get(byte)
                    if child is None:
                        child = self.next[node][byte] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    node = child
                if piece:
                    final[node] = True
        size = len(self.next)
        self.fail = [-1] * size  # -1: no way on
        self.pops = [0] * size
        todo = deque([0, 1])
        while todo:
            above = todo.popleft()
            for byte, node in self.next[above].items():
                todo.append(node)
                if final[node]:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                popped, at = self.pops[above], self.fail[above]
                while at != -1 and byte not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at != -1:
                    self.fail[node], self.pops[node] = self.next[at][byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 for a word that has no spelling."""
        step, fail, pops = self.next, self.fail, self.pops
        at = n = 0
        for byte in word:
            while (on := step[at].get(byte)) is None:
                if fail[at] == -1:
                    return 1
                n += pops[at]
                at = fail[at]
            at = on
        while at > 1:
            if fail[at] == -1:
                return 1
            n += pops[at]
            at = fail[at]
        return n


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Word-initial and continuing pieces of a rank file.

    Entries with a leading space start words; entries without go on; each
    single byte does both, so that every word has a spelling.
    """
    initial, continuing = ({bytes([b]) for b in range(256)} for _ in range(2))
    with open(path, "rb") as lines:
        for line in filter(bytes.strip, lines):
            token = base64.b64decode(line.split()[0])
            if token.startswith(b" "):
                initial.add(token[1:])
            else:
                continuing.add(token)
    return initial - {b""}, continuing


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(*vocabulary(path))
    return _AUTOMATA[path]


class Counts(dict):
    """Words and pieces of a chunk between white space, packed as one number."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, chunk: str) -> int:
        words = WORDS.findall(chunk)
        both = (len(words) << 32) + sum(self.machine.count(w.encode()) for w in words)
        if len(self) < REMEMBER and len(chunk) <= LONGEST:
            self[chunk] = both
        return both


def count_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_pieces`` of each whole text."""
    configure(docs.sparkSession)

    @F.pandas_udf("n_words long, n_pieces long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Counts(automaton(path))
        for texts in batches:
            sums = np.array([sum(map(known.__getitem__, t.split())) for t in texts], dtype=np.int64)
            yield pd.DataFrame({"n_words": sums >> 32, "n_pieces": sums & 0xFFFFFFFF})

    both = docs.select(F.col(f"`{id_col}`").alias("doc_id"), counts(text_of(text_col)).alias("both"))
    return both.select("doc_id", "both.n_words", "both.n_pieces")
