"""DES of 64-bit numbers with a key of zeros, on numpy arrays.

With such a key all round keys are zero; a round is the expansion, the S-boxes
and the permutation alone, and the last two are merged into eight tables.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the standard (FIPS 46-3).
S1 = (14, 4, 13, 1, 2, 15, 11, 8, 3, 10, 6, 12, 5, 9, 0, 7, 0, 15, 7, 4, 14, 2, 13, 1, 10, 6, 12, 11, 9, 5, 3, 8, 4, 1, 14, 8, 13, 6, 2, 11, 15, 12, 9, 7, 3, 10, 5, 0, 15, 12, 8, 2, 4, 9, 1, 7, 5, 11, 3, 14, 10, 0, 6, 13)
S2 = (15, 1, 8, 14, 6, 11, 3, 4, 9, 7, 2, 13, 12, 0, 5, 10, 3, 13, 4, 7, 15, 2, 8, 14, 12, 0, 1, 10, 6, 9, 11, 5, 0, 14, 7, 11, 10, 4, 13, 1, 5, 8, 12, 6, 9, 3, 2, 15, 13, 8, 10, 1, 3, 15, 4, 2, 11, 6, 7, 12, 0, 5, 14, 9)
S3 = (10, 0, 9, 14, 6, 3, 15, 5, 1, 13, 12, 7, 11, 4, 2, 8, 13, 7, 0, 9, 3, 4, 6, 10, 2, 8, 5, 14, 12, 11, 15, 1, 13, 6, 4, 9, 8, 15, 3, 0, 11, 1, 2, 12, 5, 10, 14, 7, 1, 10, 13, 0, 6, 9, 8, 7, 4, 15, 14, 3, 11, 5, 2, 12)
S4 = (7, 13, 14, 3, 0, 6, 9, 10, 1, 2, 8, 5, 11, 12, 4, 15, 13, 8, 11, 5, 6, 15, 0, 3, 4, 7, 2, 12, 1, 10, 14, 9, 10, 6, 9, 0, 12, 11, 7, 13, 15, 1, 3, 14, 5, 2, 8, 4, 3, 15, 0, 6, 10, 1, 13, 8, 9, 4, 5, 11, 12, 7, 2, 14)
S5 = (2, 12, 4, 1, 7, 10, 11, 6, 8, 5, 3, 15, 13, 0, 14, 9, 14, 11, 2, 12, 4, 7, 13, 1, 5, 0, 15, 10, 3, 9, 8, 6, 4, 2, 1, 11, 10, 13, 7, 8, 15, 9, 12, 5, 6, 3, 0, 14, 11, 8, 12, 7, 1, 14, 2, 13, 6, 15, 0, 9, 10, 4, 5, 3)
S6 = (12, 1, 10, 15, 9, 2, 6, 8, 0, 13, 3, 4, 14, 7, 5, 11, 10, 15, 4, 2, 7, 12, 9, 5, 6, 1, 13, 14, 0, 11, 3, 8, 9, 14, 15, 5, 2, 8, 12, 3, 7, 0, 4, 10, 1, 13, 11, 6, 4, 3, 2, 12, 9, 5, 15, 10, 11, 14, 1, 7, 6, 0, 8, 13)
S7 = (4, 11, 2, 14, 15, 0, 8, 13, 3, 12, 9, 7, 5, 10, 6, 1, 13, 0, 11, 7, 4, 9, 1, 10, 14, 3, 5, 12, 2, 15, 8, 6, 1, 4, 11, 13, 12, 3, 7, 14, 10, 15, 6, 8, 0, 5, 9, 2, 6, 11, 13, 8, 1, 4, 10, 7, 9, 5, 0, 15, 14, 2, 3, 12)
S8 = (13, 2, 8, 4, 6, 15, 11, 1, 10, 9, 3, 14, 5, 0, 12, 7, 1, 15, 13, 8, 10, 3, 7, 4, 12, 5, 6, 11, 0, 14, 9, 2, 7, 11, 4, 1, 9, 12, 14, 2, 0, 6, 10, 13, 15, 3, 5, 8, 2, 1, 14, 7, 4, 10, 8, 13, 15, 12, 9, 0, 3, 5, 6, 11)
P = (16, 7, 20, 21, 29, 12, 28, 17, 1, 15, 23, 26, 5, 18, 31, 10, 2, 8, 24, 14, 32, 27, 3, 9, 19, 13, 30, 6, 22, 11, 4, 25)

#: The first permutation: from bit 58 in steps of 8, and so on.
FIRST = [start - 8 * k for start in (58, 60, 62, 64, 57, 59, 61, 63) for k in range(8)]
LAST = [FIRST.index(k) + 1 for k in range(1, 65)]


def _round_tables() -> np.ndarray:
    tables = np.zeros((8, 64), np.uint64)
    for box, values in enumerate((S1, S2, S3, S4, S5, S6, S7, S8)):
        for six in range(64):
            row, column = (six >> 4 & 2) | (six & 1), six >> 1 & 15
            placed = values[16 * row + column] << (28 - 4 * box)
            tables[box, six] = sum(((placed >> (32 - bit)) & 1) << (31 - k) for k, bit in enumerate(P))
    return tables


def _byte_tables(permutation: list[int]) -> np.ndarray:
    """What each byte of the input sets in the output."""
    tables = np.zeros((8, 256), np.uint64)
    for to, source in enumerate(permutation):
        byte, bit = divmod(source - 1, 8)
        tables[byte, np.flatnonzero(np.arange(256) >> (7 - bit) & 1)] |= np.uint64(1 << (63 - to))
    return tables


ROUNDS, FIRST_TABLES, LAST_TABLES = _round_tables(), _byte_tables(FIRST), _byte_tables(LAST)


def _permuted(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(8):
        out |= tables[k][(x >> np.uint64(56 - 8 * k)) & np.uint64(255)]
    return out


def encrypt(numbers: np.ndarray) -> np.ndarray:
    """DES of each unsigned 64-bit number."""
    x = _permuted(np.asarray(numbers, np.uint64), FIRST_TABLES)
    left, right = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    for _ in range(16):
        wide = (right & np.uint64(1)) << np.uint64(33) | right << np.uint64(1) | right >> np.uint64(31)
        mixed = np.zeros_like(right)
        for k in range(8):
            mixed |= ROUNDS[k][(wide >> np.uint64(28 - 4 * k)) & np.uint64(63)]
        left, right = right, left ^ mixed
    return _permuted(right << np.uint64(32) | left, LAST_TABLES)


#: With equal round keys in both orders, DES is its own inverse.
decrypt = encrypt
