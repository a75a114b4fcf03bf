"""Media columns as lossless WebP.

A payload of 8-bit samples becomes one or more WebP files that follow one
another, at most ``FRAME`` samples in each, so that memory stays bounded however
long a payload is. A row of an image holds ``ROW`` samples: as grey pixels (one
sample each, in the green channel) or as colours (four each). For each image the
coding of least estimated size is taken: literals, back-references, a palette
with several samples a pixel, a predictor, subtracted green, or colours with a
cache. Decoding takes any lossless WebP (see ``vp8l``).

A null text is the empty text. Each row has its own media, so ties, repeated
rows, extra columns and empty tables need no care.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, text_of
from .vp8l import NEAR, Choices, back_references, cache_hits, code_bits, decode_vp8l, encode_vp8l, palette_forward, prefix_of, riff_images, to_riff

ROW = 64
#: Samples of one image: rows of ROW samples.
FRAME = ROW * 4096
#: Share of the plain size that back-references, predictors and subtracted green must save, as they take longer to read; a colour cache half of it.
WORTH = 0.125
#: Samples from which on colours may pay for their codes, and share of them that the cache must hold.
LEAST_COLOURS, LEAST_HITS = 4096, 0.2
#: Sizes of tiles and of the colour cache, as powers of two, and colours up to which a palette packs several samples.
TILE_BITS, CACHE_BITS, BUNDLED = 5, 9, 16


def padded(payload: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of ROW."""
    return payload + bytes(-len(payload) % ROW if payload else ROW)


def copied_bits(pixels: np.ndarray, copies: tuple[np.ndarray, ...]) -> float:
    """About how many bits grey pixels take with these back-references."""
    starts, lengths, back = copies
    edges = np.zeros(pixels.size + 1, np.int32)
    edges[starts] += 1
    edges[starts + lengths] -= 1
    samples = (pixels.ravel() >> 8).astype(np.uint8)
    left = samples[np.cumsum(edges[:-1]) == 0]
    length, distance = prefix_of(lengths), prefix_of(back + len(NEAR))
    codes = code_bits(np.concatenate([np.bincount(left, minlength=256), np.bincount(length[0])])) + code_bits(np.bincount(distance[0]))
    return codes + float(length[2].sum() + distance[2].sum())


def candidates(samples: np.ndarray) -> Iterator[tuple[float, np.ndarray, Choices]]:
    """Codings of samples: about how many bits each takes, its pixels, and how to code them. The plainest comes first."""
    counts = np.bincount(samples, minlength=256)
    grey = (samples.astype(np.uint32) << 8 | np.uint32(0xFF000000)).reshape(-1, ROW)
    plain = code_bits(counts)
    yield plain, grey, Choices()
    repeats = 8 * len(zlib.compress(samples, 1)) < plain * (1 - WORTH)  # a quick look at what they would save
    copies = back_references(grey.ravel()) if repeats else ((),)
    if len(copies[0]):
        yield copied_bits(grey, copies) + plain * WORTH, grey, Choices(copies=copies)
    used = np.flatnonzero(counts)
    if len(used) <= BUNDLED:
        colours = used.astype(np.uint32) << 8 | np.uint32(0xFF000000)
        bundled, table = palette_forward(grey, colours), 16.0 * len(used)
        yield code_bits(np.bincount((bundled.ravel() >> 8) & 255)) + table, grey, Choices(palette=colours)
        copies = back_references(bundled.ravel())
        if len(copies[0]):
            yield copied_bits(bundled, copies) + table, grey, Choices(palette=colours, copies=copies)
    for mode, step in ((1, 1), (2, ROW)):  # predicted from the left, or from above
        bits = code_bits(np.bincount(samples[step:] - samples[:-step], minlength=256)) if len(samples) > step else plain
        if bits + 200 < plain:
            modes = np.full((-(-len(grey) >> TILE_BITS), -(-ROW >> TILE_BITS)), mode << 8, np.uint32)
            yield bits + 200 + plain * WORTH, grey, Choices(predictor=modes, tile_bits=TILE_BITS)
    if len(samples) >= LEAST_COLOURS:
        colour = samples.view("<u4").astype(np.uint32).reshape(-1, ROW // 4)
        parts = samples.reshape(-1, 4)
        place, hits = cache_hits(colour.ravel(), CACHE_BITS)
        if hits.mean() > LEAST_HITS:
            rest = [code_bits(np.bincount(parts[~hits, k], minlength=256)) for k in (0, 2, 3)]
            yield code_bits(np.concatenate([np.bincount(parts[~hits, 1], minlength=256), np.bincount(place[hits])])) + sum(rest) + plain * WORTH / 2, colour, Choices(cache_bits=CACHE_BITS)
        less = [code_bits(np.bincount(parts[:, k] - parts[:, 1], minlength=256)) for k in (0, 2)]
        yield sum(less) + sum(code_bits(np.bincount(parts[:, k], minlength=256)) for k in (1, 3)) + plain * WORTH, colour, Choices(subtract_green=True)


def write_media(samples: bytes) -> bytes:
    """Samples (a positive multiple of ROW) as lossless WebP files."""
    files = []
    for start in range(0, len(samples), FRAME):
        part = np.frombuffer(samples, np.uint8, min(FRAME, len(samples) - start), start)
        _, pixels, how = min(candidates(part), key=lambda c: c[0])
        files.append(to_riff(encode_vp8l(pixels, how)))
    return b"".join(files)


def read_pixels(media: bytes) -> list[np.ndarray]:
    """ARGB pixel arrays of all images."""
    return [decode_vp8l(stream) for stream in riff_images(media)]


def read_samples(media: bytes) -> bytes:
    parts = []
    for pixels in read_pixels(media):
        if pixels.shape[1] == ROW // 4:
            parts.append(pixels.astype("<u4").tobytes())
        else:
            parts.append(((pixels >> 8) & 255).astype(np.uint8).tobytes())
    return b"".join(parts)


def features(samples: bytes) -> str:
    """Mean, standard deviation and mean step of the samples, and 16 shares of their range, in hundredths."""
    s = np.frombuffer(samples, np.uint8)
    shares = np.bincount(s >> 4, minlength=16) * 10_000 // len(s)
    step = np.abs(np.diff(s.astype(np.int16))).sum() * 100 // max(len(s) - 1, 1)
    mean = int(s.sum(dtype=np.int64)) * 100 // len(s)
    squares = int((s.astype(np.int64) ** 2).sum()) * 10_000 // len(s)
    deviation = int(np.sqrt(max(squares - mean * mean, 0)))
    return f"mean={mean};sd={deviation};step={step};shares=" + ",".join(map(str, shares.tolist()))


def media_column(payload: Column) -> Column:
    """The WebP files that store a binary column (null as empty), padded to ROW."""

    @F.pandas_udf("binary")
    def write(payloads: pd.Series) -> pd.Series:
        return pd.Series([write_media(padded(p or b"")) for p in payloads], dtype=object)

    return write(payload)


def samples_column(media: Column) -> Column:
    """The samples of a column of WebP files."""

    @F.pandas_udf("binary")
    def read(files: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else read_samples(m) for m in files], dtype=object)

    return read(media)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Media of each whole text, read back, and what it holds."""
    configure(docs.sparkSession)

    @F.pandas_udf(
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for media in files:
                samples = read_samples(media)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    text = text_of(text_col)
    media = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        media_column(text.cast("binary")).alias("media"),
    )
    return media.select("doc_id", "n_bytes", digests("media").alias("d")).select("doc_id", "n_bytes", "d.*")
