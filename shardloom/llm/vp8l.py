"""Lossless WebP (VP8L) in numpy: decoder for the whole format, and an encoder.

The decoder reads prefix codes of an image with one group of codes by looking
at every bit offset at once: each offset's symbol and end come from table
lookups, and then only the chain of true offsets is followed. Images with
several groups go symbol by symbol. Back-references, the colour cache and all
four transforms are inverted. Pixels are uint32 ARGB.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format.
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES, MAX_BITS = 24, 40, 15
CACHE_FACTOR = 0x1E35A7BD
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Offsets of the first 120 distance codes: the near pixels above or to the left, nearest first.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda at: (at[0] ** 2 + at[1] ** 2, abs(at[0]), at[0] < 0),
)

#: Each number of MAX_BITS bits with its bits in the other order.
REVERSED = np.zeros(1 << MAX_BITS, np.int64)
for _bit in range(MAX_BITS):
    REVERSED |= ((np.arange(1 << MAX_BITS) >> _bit) & 1) << (MAX_BITS - 1 - _bit)


def ceil_div(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


# ---------------------------------------------------------------- prefix codes


@dataclass
class Code:
    """A prefix code as lookup tables over the next ``bits`` bits."""

    bits: int
    symbol: np.ndarray
    length: np.ndarray

    @staticmethod
    def single(symbol: int) -> Code:
        return Code(0, np.array([symbol], np.int32), np.zeros(1, np.int32))

    @staticmethod
    def from_lengths(lengths: np.ndarray) -> Code:
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            return Code.single(0)
        if len(used) == 1:
            return Code.single(int(used[0]))
        used = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[used]
        bits = int(n[-1])
        spread = np.repeat(np.arange(len(used)), 1 << (bits - n))  # by the next bits, the first bit highest
        if len(spread) != 1 << bits:
            raise ValueError("prefix code is not complete")
        spread = spread[REVERSED[: 1 << bits] >> (MAX_BITS - bits)]
        return Code(bits, used.astype(np.int32)[spread], n.astype(np.int32)[spread])


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Used symbols, their lengths, and their codes with the first bit lowest.

    Codes are counted up in order of length and symbol: as fractions of one,
    each code is the sum of the widths of those before it.
    """
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used].astype(np.int64)
    width = np.int64(1) << (MAX_BITS - n)
    left = np.cumsum(width) - width  # aligned to MAX_BITS, first bit highest
    return used, n, REVERSED[left]


def huffman_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code lengths of at most ``limit`` bits; flatter counts where needed."""
    lengths = np.zeros(len(counts), np.int32)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = [int(counts[s]) for s in used]
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        above = [0] * (2 * len(used) - 1)
        node = len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            above[i] = above[j] = node
            heapq.heapreplace(heap, (a + b, node))
            node += 1
        depth = [0] * node
        for i in range(node - 2, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth) <= limit:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = [w // 2 + 1 for w in weights]


# ---------------------------------------------------------------- reading


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(16), 0, 8 * len(data)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return value

    def peek(self, n: int) -> int:
        start = self.at >> 3
        return (int.from_bytes(self.data[start : start + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        key = self.peek(code.bits)
        self.at += int(code.length[key])
        return int(code.symbol[key])


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths = np.zeros(max(alphabet, 256), np.int32)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code.from_lengths(lengths)
    of_lengths = np.zeros(19, np.int32)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    code = Code.from_lengths(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, at, last = np.zeros(alphabet, np.int32), 0, 8
    while at < alphabet and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            least, extra, value = ((3, 2, last), (3, 3, 0), (11, 7, 0))[s - 16]
            n = least + bits.read(extra)
            if at + n > alphabet:
                raise ValueError("code lengths run over")
            lengths[at : at + n] = value
            at += n
    return Code.from_lengths(lengths)


def prefix_value(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


def plain_distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tiles, tile_bits = 1, None, 0
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        tiles = (read_image(bits, ceil_div(width, tile_bits), ceil_div(height, tile_bits), False) >> 8) & 0xFFFF
        groups = int(tiles.max()) + 1
    cache = (1 << cache_bits) if cache_bits else 0
    alphabets = (256 + LENGTH_CODES + cache, 256, 256, 256, DISTANCE_CODES)
    codes = [[read_code(bits, n) for n in alphabets] for _ in range(groups)]
    if groups == 1:
        pixels = read_at_all_offsets(bits, codes[0], width, height, cache_bits)
    else:
        pixels = read_by_symbol(bits, codes, tiles, tile_bits, width, height, cache_bits)
    return pixels.reshape(height, width)


def read_by_symbol(bits, codes, tiles, tile_bits, width, height, cache_bits) -> np.ndarray:
    total = width * height
    out, cache, at = [0] * total, [0] * (1 << cache_bits), 0
    shift = 32 - cache_bits
    while at < total:
        y, x = divmod(at, width)
        green, red, blue, alpha, distance = codes[int(tiles[y >> tile_bits, x >> tile_bits])]
        s = bits.symbol(green)
        if s < 256:
            r = bits.symbol(red)
            b = bits.symbol(blue)
            new = [bits.symbol(alpha) << 24 | r << 16 | s << 8 | b]
        elif s < 256 + LENGTH_CODES:
            n = prefix_value(bits, s - 256)
            back = plain_distance(prefix_value(bits, bits.symbol(distance)), width)
            if back > at or at + n > total:
                raise ValueError("bad back-reference")
            new = [out[at - back + i % back] for i in range(n)]
        else:
            new = [cache[s - 256 - LENGTH_CODES]]
        out[at : at + len(new)] = new
        at += len(new)
        if cache_bits:
            for p in new:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
    if bits.at > bits.end:
        raise ValueError("the image ends early")
    return np.array(out, np.uint32)


def read_at_all_offsets(bits: Bits, codes: list[Code], width: int, height: int, cache_bits: int) -> np.ndarray:
    """Tokens of an image with one group of codes.

    For each bit offset, where the token that would start there ends; then the
    true chain of offsets from the first; then all tokens' values at once.
    """
    total = width * height
    first = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, offset=first).astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(16, np.uint32)])
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    ahead = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel()  # at least 24 bits from each offset
    size = len(ahead) - 80
    start = bits.at - 8 * first

    def look(code: Code, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        key = ahead[at] & np.uint32((1 << code.bits) - 1)
        return code.symbol[key], code.length[key]

    def run(at: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of length or distance prefixes s, and where their extra bits end."""
        extra = np.maximum((s - 2) >> 1, 0)
        at = np.minimum(at, size)
        far = np.minimum(at + 16, size + 16)
        more = (ahead[at].astype(np.int64) & 0xFFFF | (ahead[far].astype(np.int64) & 0xFFFF) << 16) & ((1 << extra.astype(np.int64)) - 1)
        return np.where(s < 4, s + 1, ((2 + (s & 1)).astype(np.int64) << extra) + more + 1), at + extra

    green, red, blue, alpha, distance = codes
    green_key = (ahead[: size + 1] & np.uint32((1 << green.bits) - 1)).astype(np.intp)
    after = green.length.take(green_key).astype(np.intp)
    after += np.arange(size + 1)
    np.minimum(after, size, out=after)
    for code in (red, blue, alpha):
        if code.bits:
            after = np.minimum(after + look(code, after)[1], size)
    only_literals = bool(green.symbol.max() < 256)
    if not only_literals:
        s = green.symbol[green_key]
        cached = np.flatnonzero(s >= 256 + LENGTH_CODES)
        after[cached] = np.minimum(cached + green.length[ahead[cached] & np.uint32((1 << green.bits) - 1)], size)
        copied = np.flatnonzero((s >= 256) & (s < 256 + LENGTH_CODES))
        ends = copied + green.length[ahead[copied] & np.uint32((1 << green.bits) - 1)]
        many, ends = run(ends, s[copied] - 256)
        ends = np.minimum(ends, size)
        d, n = look(distance, ends)
        back, ends = run(ends + n, d)
        after[copied] = np.minimum(ends, size)
        amount = np.ones(size + 1, np.int64)
        amount[copied] = many
        backs = np.zeros(size + 1, np.int64)
        backs[copied] = back

    # eight tokens at a time; beyond the last one the chain is cut again
    two = after.take(after)
    four = two.take(two)
    eight = memoryview(four.take(four))
    at, chain = start, []
    for _ in range(-(-total // 8)):
        chain.append(at)
        if at == size:
            break
        at = eight[at]
    chain = np.array(chain, np.intp)
    for step in (four, two, after):
        chain = np.stack([chain, step.take(chain)], -1)
    chain = chain.ravel()
    if only_literals:
        if len(chain) < total:
            raise ValueError("the image ends early")
        chain = chain[:total]
    else:
        got = np.cumsum(amount[chain])
        last = int(np.searchsorted(got, total))
        if last == len(got):
            raise ValueError("the image ends early")
        if got[last] != total:
            raise ValueError("bad back-reference")
        chain = chain[: last + 1]
    end = int(after[chain[-1]])
    bits.at = 8 * first + end
    if bits.at > bits.end or end == size:
        raise ValueError("the image ends early")

    own = green_key.take(chain)
    values, at = green.symbol.take(own).astype(np.uint32), chain
    pixel = values << 8
    if green.bits and any(code.bits for code in (red, blue, alpha)):
        at = at + green.length.take(own)
    for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
        if code.bits == 0:
            pixel |= np.uint32(int(code.symbol[0]) << shift)
        else:
            v, n = look(code, np.minimum(at, size))
            pixel |= v.astype(np.uint32) << np.uint32(shift)
            at = at + n
    if only_literals or (len(chain) == total and not cache_bits):
        return pixel
    return expand(values, pixel, amount[chain], backs[chain], width, total, cache_bits)


def expand(values, pixel, amount, backs, width, total, cache_bits) -> np.ndarray:
    """Pixels from literals, back-references and colour cache indices."""
    starts = np.concatenate([[0], np.cumsum(amount)[:-1]])
    literal, cached = values < 256, values >= 256 + LENGTH_CODES
    if len(starts) == total:
        return from_cache(values, pixel, cached, cache_bits)
    raw = bytearray(4 * total)
    out = np.frombuffer(raw, np.uint32)
    out[starts[literal]] = pixel[literal]
    cache = np.zeros(1 << cache_bits, np.uint32)
    done = 0

    def remember(until: int) -> None:
        nonlocal done
        if cache_bits and until > done:
            new = out[done:until]
            cache[(new * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)] = new  # the last of equal places stays
        done = until

    others = np.flatnonzero(~literal)
    for at, v, back, n in zip(starts[others].tolist(), values[others].tolist(), backs[others].tolist(), amount[others].tolist()):
        if v >= 256 + LENGTH_CODES:
            remember(at)
            out[at] = cache[v - 256 - LENGTH_CODES]
            continue
        back = plain_distance(back, width)
        if back > at:
            raise ValueError("bad back-reference")
        at, back, n = 4 * at, 4 * back, 4 * n
        if back >= n:
            raw[at : at + n] = raw[at - back : at - back + n]
        else:
            raw[at : at + n] = (raw[at - back : at] * (n // back + 1))[:n]
    return out


def from_cache(values, pixel, cached, cache_bits) -> np.ndarray:
    """Pixels without back-references: an index stands for the last literal of its place, as it leaves the cache as it is."""
    place = np.where(cached, values - (256 + LENGTH_CODES), (pixel * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
    order = np.argsort(place, kind="stable")
    places, of_cache = place[order], cached[order]
    first = np.diff(places.astype(np.int32), prepend=-1) != 0
    # where the last literal is; at the start of a place there is none, and the cache holds 0
    source = np.maximum.accumulate(np.where(~of_cache | first, np.arange(len(order)), 0))
    found = np.where(of_cache[source], np.uint32(0), pixel[order[source]])
    out = np.empty(len(order), np.uint32)
    out[order] = found
    return out


# ---------------------------------------------------------------- transforms


def channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) bytes in the order blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def joined(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts).view("<u4").reshape(parts.shape[:-1]).astype(np.uint32)


def predictions(mode: int, left, top, top_left, top_right):
    """Predicted channels by one of the fourteen modes; all are int32 (..., 4)."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.broadcast_to(np.array([0, 0, 0, 255], np.int32), left.shape)
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7):
        return mean(left, (top_left, top)[mode - 6])
    if mode in (8, 9):
        return mean(top, (top_left, top_right)[mode - 8])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        far_left = np.abs(top - top_left).sum(-1, keepdims=True)
        far_top = np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(far_left < far_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        half = mean(left, top)
        return np.clip(half + np.trunc((half - top_left) / 2).astype(np.int32), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255], np.int32), left.shape)


def tile_values(tiles: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(tiles, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def predict_forward(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = pixels.shape
    c = channels(pixels).astype(np.int32)
    flat = np.concatenate([np.zeros((width + 1, 4), np.int32), c.reshape(-1, 4), np.zeros((1, 4), np.int32)])
    n = height * width
    near = [flat[width + 1 + d : width + 1 + d + n].reshape(c.shape) for d in (-1, -width, -width - 1, -width + 1)]
    mode = tile_values((modes >> 8) & 15, bits, height, width)
    out = np.zeros_like(c)
    for m in np.unique(mode).tolist():
        at = mode == m
        out[at] = predictions(m, *(x[at] for x in near))
    out[:, 0] = near[1][:, 0]
    out[0] = near[0][0]
    out[0, 0] = (0, 0, 0, 255)
    return joined((c - out).astype(np.uint8))


def predict_inverse(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Row by row; a row whose modes do not look left is done at once."""
    height, width = pixels.shape
    out = channels(pixels).astype(np.int32)
    out[0, 0, 3] += 255
    out[0] = np.cumsum(out[0], 0) & 255
    mode = tile_values((modes >> 8) & 15, bits, height, width)
    for y in range(1, height):
        row, up = out[y], out[y - 1]
        row[0] = (row[0] + up[0]) & 255
        kinds = set(mode[y, 1:].tolist())
        if kinds == {1}:
            out[y] = np.cumsum(row, 0) & 255
            continue
        after = np.concatenate([up[1:], row[:1]])
        if kinds <= {0, 2, 3, 4, 8, 9, 14, 15} and not (kinds & {3, 9} and width == 1):
            for m in kinds:
                at = np.flatnonzero(mode[y] == m)
                at = at[at > 0]
                row[at] = (row[at] + predictions(m, up[at], up[at], up[at - 1], after[at])) & 255
            continue
        for x in range(1, width):
            row[x] = (row[x] + predictions(int(mode[y, x]), row[x - 1], up[x], up[x - 1], after[x])) & 255
    return joined(out.astype(np.uint8))


def cross_colour(pixels: np.ndarray, tiles: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """sign 1 inverts the transform, -1 applies it."""
    factor = channels(tile_values(tiles, bits, *pixels.shape)).view(np.int8).astype(np.int32)
    c = channels(pixels).copy()
    signed = lambda k: c[..., k].view(np.int8).astype(np.int32)
    green, old_red = signed(1), signed(2)
    red = c[..., 2] + sign * ((factor[..., 0] * green) >> 5)
    c[..., 2] = red & 255
    of_red = signed(2) if sign == 1 else old_red
    c[..., 0] = (c[..., 0] + sign * (((factor[..., 1] * green) >> 5) + ((factor[..., 2] * of_red) >> 5))) & 255
    return joined(c)


def green_added(pixels: np.ndarray, sign: int) -> np.ndarray:
    c = channels(pixels).copy()
    c[..., 0] += c[..., 1] * np.uint8(sign & 255)
    c[..., 2] += c[..., 1] * np.uint8(sign & 255)
    return joined(c)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def palette_inverse(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = palette_bits(len(table))
    index = (pixels >> 8) & 255
    if bits:
        each = 8 >> bits
        index = (index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)
        index = index.reshape(len(pixels), -1)[:, :width]
    return np.concatenate([table, np.zeros(256, np.uint32)])[index].astype(np.uint32)


def palette_forward(pixels: np.ndarray, table: np.ndarray) -> np.ndarray:
    order = np.argsort(table)
    index = order[np.searchsorted(table, pixels, sorter=order)].astype(np.uint32)
    bits = palette_bits(len(table))
    if bits:
        height, width = pixels.shape
        wide = ceil_div(width, bits) << bits
        index = np.pad(index, ((0, 0), (0, wide - width))).reshape(height, -1, 1 << bits)
        index = (index << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits))).sum(-1).astype(np.uint32)
    return index << 8 | np.uint32(0xFF000000)


# ---------------------------------------------------------------- whole images


def decode_vp8l(data: bytes) -> np.ndarray:
    """(height, width) ARGB pixels of a VP8L stream."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    wide, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in undo]:
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            n = bits.read(3) + 2
            undo.append((kind, wide, n, read_image(bits, ceil_div(wide, n), ceil_div(height, n), False)))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = joined(np.cumsum(channels(read_image(bits, size, 1, False)[0]), 0, dtype=np.uint8))
            undo.append((kind, wide, 0, table))
            wide = ceil_div(wide, palette_bits(size))
        else:
            undo.append((kind, wide, 0, None))
    pixels = read_image(bits, wide, height, True)
    for kind, wide, n, values in reversed(undo):
        if kind == PREDICTOR:
            pixels = predict_inverse(pixels, values, n)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, values, n, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = green_added(pixels, 1)
        else:
            pixels = palette_inverse(pixels, values, wide)
    return pixels


class Writer:
    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.puts([value], [n])

    def puts(self, values, sizes) -> None:
        self.values.append(np.asarray(values, np.uint64))
        self.sizes.append(np.asarray(sizes, np.int64))

    def bytes(self) -> bytes:
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((starts & 63) + sizes > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8").tobytes()[: int(ends[-1] + 7) >> 3]


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (len(used) == 0 or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        w.puts([1, 0, s > 1, s], [1, 1, 1, 8 if s > 1 else 1])
        return
    tokens: list[tuple[int, int, int]] = []
    edges = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]])
    last = 8
    for v, n in zip(lengths[edges[:-1]].tolist(), np.diff(edges).tolist()):
        while n:
            if v == 0 and n >= 3:
                k = min(n, 138)
                tokens.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            elif v and n >= 3 and last == v:
                k = min(n, 6)
                tokens.append((16, k - 3, 2))
            else:
                k = 1
                tokens.append((v, 0, 0))
                last = v or last
            n -= k
    own = huffman_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    code, size = code_tables(own)
    code, size = code.tolist(), size.tolist()
    values, sizes = [0, 15, *own[list(CODE_LENGTH_ORDER)].tolist(), 0], [1, 4, *[3] * 19, 1]
    for s, value, n in tokens:
        values += (code[s], value)
        sizes += (size[s], n)
    w.puts(values, sizes)


def code_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and its size of each symbol; a lone symbol takes no bits."""
    code, size = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    if np.count_nonzero(lengths) > 1:
        s, n, c = canonical(lengths)
        code[s], size[s] = c, n
    return code, size


def prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits' value and number of lengths or distances."""
    v = values.astype(np.int64) - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1))
    return symbol, v & ((1 << extra) - 1), extra


def back_references(flat: np.ndarray, least: int = 7, longest: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of repeats of earlier pixels, taken greedily.

    For each place, the last place before it whose ``least`` pixels have the same 16 bits of hash counts, if they are
    equal. Neighbours with the same distance make one longer repeat.
    """
    n, none = len(flat) - least + 1, (np.zeros(0, np.int64),) * 3
    if n < 2:
        return none
    mixed = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = mixed[:n].copy()
    for k in range(1, least):
        key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    slot = (key >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")  # by radix
    before, now = order[:-1], order[1:]
    same = key[before] == key[now]
    distance = np.zeros(n, np.int64)
    distance[now[same]] = (now - before)[same]
    there = np.flatnonzero(distance)
    if len(there) == 0:
        return none
    # runs of neighbours with one distance, and where the next repeat is
    goes_on = (np.diff(there) == 1) & (distance[there[1:]] == distance[there[:-1]])
    ends = np.append(np.flatnonzero(~goes_on), len(there) - 1)
    end = memoryview(there[np.repeat(ends, np.diff(ends, prepend=-1))])
    following = memoryview(np.searchsorted(there, np.arange(len(flat) + 1)))
    places, starts, lengths = memoryview(there), [], []
    i = 0
    while i < len(places):
        at = places[i]
        size = min(end[i] - at + least, longest)
        starts.append(at)
        lengths.append(size)
        i = following[at + size]
    starts, lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
    # equal hashes of 64 bits are all but surely equal pixels; a repeat that is none after all is left out
    back, at = distance[starts], np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    wrong = np.add.reduceat(flat[at] != flat[at - np.repeat(back, lengths)], np.cumsum(lengths) - lengths) > 0
    return starts[~wrong], lengths[~wrong], back[~wrong]


def cache_hits(flat: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in the colour cache, and whether the cache holds it there: every pixel enters, however it is coded."""
    place = ((flat * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
    order = np.argsort(place, kind="stable")
    before, now = order[:-1], order[1:]
    hits = np.zeros(len(flat), bool)
    hits[now] = (place[before] == place[now]) & (flat[before] == flat[now])
    return place, hits


@dataclass
class Tokens:
    """How an image is coded: green symbols of all tokens, other channels of literals, lengths and distances of copies."""

    starts: np.ndarray
    green: np.ndarray
    parts: np.ndarray  # channels of the first pixel
    literal: np.ndarray
    copied: np.ndarray
    length: tuple[np.ndarray, np.ndarray, np.ndarray]
    distance: tuple[np.ndarray, np.ndarray, np.ndarray]

    @staticmethod
    def of(flat: np.ndarray, cache_bits: int, copies: bool | tuple) -> Tokens:
        at, lengths, back = (back_references(flat) if copies is True else copies) if copies else (np.zeros(0, np.int64),) * 3
        starts = np.arange(len(flat))
        if len(at):
            inside = np.zeros(len(flat) + 1, np.int32)
            np.add.at(inside, at + 1, 1)
            np.add.at(inside, at + lengths, -1)
            starts = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        parts = channels(flat[starts]).astype(np.int64)
        green, copied = parts[:, 1].copy(), np.zeros(len(starts), bool)
        length = distance = (np.zeros(len(starts), np.int64),) * 3
        if len(at):
            rows = np.searchsorted(starts, at)
            copied[rows] = True
            length, distance = (spread(prefix_of(v), rows, len(starts)) for v in (lengths, back + len(NEAR)))
            green[rows] = 256 + length[0][rows]
        literal = ~copied
        if cache_bits:
            place, hits = cache_hits(flat, cache_bits)
            cached = hits[starts] & literal
            green[cached] = 256 + LENGTH_CODES + place[starts[cached]]
            literal &= ~cached
        return Tokens(starts, green, parts, literal, copied, length, distance)

    def streams(self):
        """(symbols, rows that have them) of the five codes."""
        every = np.ones(len(self.starts), bool)
        return (self.green, every), (self.parts[:, 2], self.literal), (self.parts[:, 0], self.literal), (self.parts[:, 3], self.literal), (self.distance[0], self.copied)


def spread(columns: tuple[np.ndarray, ...], rows: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    out = tuple(np.zeros(size, np.int64) for _ in columns)
    for whole, values in zip(out, columns):
        whole[rows] = values
    return out


def code_bits(counts: np.ndarray) -> float:
    """About how many bits symbols that come so often take with their own code, and the code itself."""
    used = counts[counts > 0].astype(float)
    total = used.sum()
    if len(used) < 2:
        return 12.0
    return float(total * np.log2(total) - (used * np.log2(used)).sum()) + 40 + 5.0 * len(used)


def write_image(w: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: bool | tuple = False, tiles: np.ndarray | None = None, tile_bits: int = 2) -> None:
    flat = np.ascontiguousarray(pixels, np.uint32).ravel()
    width = pixels.shape[1]
    if not (cache_bits or copies or tiles is not None):
        write_literals(w, channels(flat), main)
        return
    tokens = Tokens.of(flat, cache_bits, copies)
    group = np.zeros(len(tokens.starts), np.int64)
    w.puts(*(([1, cache_bits], [1, 4]) if cache_bits else ([0], [1])))
    if main:
        w.put(tiles is not None, 1)
        if tiles is not None:
            w.put(tile_bits - 2, 3)
            write_image(w, tiles.astype(np.uint32) << 8, False)
            group = tiles[(tokens.starts // width) >> tile_bits, (tokens.starts % width) >> tile_bits].astype(np.int64)
    alphabets = (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = []
    for g in range(1 if tiles is None else int(tiles.max()) + 1):
        own = group == g
        for (symbols, rows), n in zip(tokens.streams(), alphabets):
            lengths = huffman_lengths(np.bincount(symbols[rows & own], minlength=n))
            write_code(w, lengths)
            codes.append(code_tables(lengths))
    # one number of at most 60 bits a token: its code, a literal's other codes, a copy's extra bits and distance
    values, sizes = np.zeros(len(group), np.uint64), np.zeros(len(group), np.int64)

    def add(rows: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
        values[rows] |= value.astype(np.uint64) << sizes[rows].astype(np.uint64)
        sizes[rows] += size

    copied = np.flatnonzero(tokens.copied)
    for k, (symbols, there) in enumerate(tokens.streams()):
        for g in range(len(codes) // 5):
            code, size = codes[5 * g + k]
            if size.any():
                rows = np.flatnonzero(there & (group == g))
                add(rows, code[symbols[rows]], size[symbols[rows]])
        if k in (0, 4) and len(copied):
            _, extra, n = (tokens.length, tokens.distance)[k // 4]
            add(copied, extra[copied], n[copied])
    w.puts(values, sizes)


def write_literals(w: Writer, parts: np.ndarray, main: bool) -> None:
    """An image of literals alone, with one group of codes."""
    w.put(0, 2 if main else 1)
    values, sizes = [], []
    for k, n in ((1, 256 + LENGTH_CODES), (2, 256), (0, 256), (3, 256)):
        lengths = huffman_lengths(np.bincount(parts[:, k], minlength=n))
        write_code(w, lengths)
        code, size = code_tables(lengths)
        if size.any():
            values.append(code[parts[:, k]])
            sizes.append(size[parts[:, k]])
    write_code(w, np.zeros(DISTANCE_CODES, np.int32))
    if values:
        w.puts(np.stack(values, 1).ravel(), np.stack(sizes, 1).ravel())


@dataclass
class Choices:
    """What an encoder may use; the default is literals with prefix codes."""

    predictor: np.ndarray | None = None  # mode of each tile, as a pixel: mode << 8
    cross: np.ndarray | None = None  # red-to-blue << 16 | green-to-blue << 8 | green-to-red, of each tile
    subtract_green: bool = False
    palette: np.ndarray | None = None
    cache_bits: int = 0
    copies: bool | tuple = False  # or the repeats that were found
    groups: np.ndarray | None = None
    tile_bits: int = 2
    order: tuple[int, ...] = field(default=(PALETTE, PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN))


def encode_vp8l(pixels: np.ndarray, how: Choices | None = None) -> bytes:
    how = how or Choices()
    height, width = pixels.shape
    w = Writer()
    w.puts([SIGNATURE, width - 1, height - 1, 1, 0], [8, 14, 14, 1, 3])
    for kind in how.order:
        if kind == PALETTE and how.palette is not None:
            w.puts([1, PALETTE, len(how.palette) - 1], [1, 2, 8])
            steps = channels(how.palette)
            steps = np.concatenate([steps[:1], steps[1:] - steps[:-1]])
            write_image(w, joined(steps)[None], False)
            pixels = palette_forward(pixels, how.palette)
        elif kind == PREDICTOR and how.predictor is not None:
            w.puts([1, PREDICTOR, how.tile_bits - 2], [1, 2, 3])
            write_image(w, how.predictor, False)
            pixels = predict_forward(pixels, how.predictor, how.tile_bits)
        elif kind == CROSS_COLOUR and how.cross is not None:
            w.puts([1, CROSS_COLOUR, how.tile_bits - 2], [1, 2, 3])
            write_image(w, how.cross, False)
            pixels = cross_colour(pixels, how.cross, how.tile_bits, -1)
        elif kind == SUBTRACT_GREEN and how.subtract_green:
            w.puts([1, SUBTRACT_GREEN], [1, 2])
            pixels = green_added(pixels, -1)
    w.put(0, 1)
    write_image(w, pixels, True, how.cache_bits, how.copies, how.groups, how.tile_bits)
    return w.bytes()


def to_riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def riff_images(data: bytes) -> list[bytes]:
    """The VP8L streams of WebP files that follow one another."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        if end > len(data):
            raise ValueError("the file ends early")
        chunk, found = at + 12, None
        while chunk + 8 <= end and found is None:
            name, size = data[chunk : chunk + 4], struct.unpack_from("<I", data, chunk + 4)[0]
            found = data[chunk + 8 : chunk + 8 + size] if name == b"VP8L" else None
            chunk += 8 + size + (size & 1)
        if found is None:
            raise ValueError("no lossless image")
        out.append(found)
        at = end
    return out
