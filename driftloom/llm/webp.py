"""Lossless WebP (VP8L): an encoder with a few fixed choices and a full decoder.

The decoder reads what the format allows: simple and normal prefix codes, groups of them
chosen per tile, back-references with the short distance codes, the colour cache, and the
predictor, cross-colour, subtract-green and palette transforms. Runs of literals are
decoded with array operations where all literals of a channel have codes of one length,
as those of the encoder here do; other codes are read symbol by symbol.
"""

from __future__ import annotations

from functools import cache, lru_cache

import numpy as np

PREDICTOR, CROSS, GREEN, PALETTE = range(4)
# Fixed value of the format: order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40


@cache
def near_distances() -> tuple[tuple[int, int], ...]:
    """(x, y) of the 120 short distance codes: the pixels around, nearest first."""
    around = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(around, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)))


# ---------------------------------------------------------------- prefix codes


@lru_cache(4096)
def canonical(lengths: tuple[int, ...]) -> tuple[int, ...]:
    """Codes of the symbols, bits in the order they are read (first bit lowest)."""
    code, size, out = 0, 0, [0] * len(lengths)
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code, size = code << (n - size), n
        out[symbol] = int(f"{code:0{size}b}"[::-1], 2)
        code += 1
    return tuple(out)


class Code:
    """A prefix code for reading; a code of one symbol takes no bits."""

    def __init__(self, lengths: tuple[int, ...]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        self.width = 0 if self.only is not None else max(lengths, default=0)
        # of the literals, if all have one length (or there is one symbol)
        sizes = set(lengths[:LITERALS])
        self.even = 0 if self.only is not None else sizes.pop() if len(sizes) == 1 else None
        self.symbol, self.size = [0] * (1 << self.width), [0] * (1 << self.width)
        for s, code in enumerate(canonical(lengths)):
            if n := lengths[s] if self.only is None else 0:
                for at in range(code, 1 << self.width, 1 << n):
                    self.symbol[at], self.size[at] = s, n
        if self.only is not None:
            self.symbol = [self.only]
        self.table = np.array(self.symbol, np.int64)


@lru_cache(4096)
def code_of(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


# ---------------------------------------------------------------- reading


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def read(self, n: int) -> int:
        got = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return got

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        peek = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 3], "little") >> (self.at & 7) & ((1 << code.width) - 1)
        if not code.size[peek]:
            raise ValueError("no such prefix code")
        self.at += code.size[peek]
        return code.symbol[peek]

    def amount(self, prefix: int) -> int:
        """A length or distance from its prefix and extra bits."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


#: Codes read before, by their bits; and the sizes in bits of the first few of them.
_READ: dict[tuple[int, int, int], Code] = {}
_SIZES: dict[int, list[int]] = {}


def read_code(r: Reader, alphabet: int) -> Code:
    """The next prefix code. What it reads depends on its own bits only, so a code with
    the bits of one read before is that code."""
    start, sizes = r.at, _SIZES.setdefault(alphabet, [])
    ahead = int.from_bytes(r.data[start >> 3 : (start + 512) >> 3], "little") >> (start & 7)
    for n in sizes:
        known = _READ.get((alphabet, n, ahead & ((1 << n) - 1)))
        if known is not None:
            r.at += n
            return known
    code, n = parse_code(r, alphabet), r.at - start
    if n <= 480 and len(_READ) < 65536 and (n in sizes or len(sizes) < 4):
        if n not in sizes:
            sizes.append(n)
        _READ[alphabet, n, ahead & ((1 << n) - 1)] = code
    return code


def parse_code(r: Reader, alphabet: int) -> Code:
    if r.read(1):
        both, wide = r.read(1), r.read(1)
        symbols = [r.read(8 if wide else 1)] + ([r.read(8)] if both else [])
        lengths = [0] * alphabet
        for s in symbols:
            lengths[s] = 1
        return code_of(tuple(lengths))
    small = [0] * 19
    for k in LENGTH_ORDER[: 4 + r.read(4)]:
        small[k] = r.read(3)
    inner = code_of(tuple(small))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    lengths, last = [], 8
    while len(lengths) < alphabet and left > 0:
        left -= 1
        s = r.symbol(inner)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + r.read(2))
        else:
            lengths += [0] * (3 + r.read(3) if s == 17 else 11 + r.read(7))
    return code_of(tuple((lengths + [0] * alphabet)[:alphabet]))


def read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, row by row."""
    cache_bits = r.read(4) if r.read(1) else 0
    tile_bits, tiles, groups = 0, None, 1
    if main and r.read(1):
        tile_bits = r.read(3) + 2
        across = -(-width >> tile_bits)
        tiles = (read_image(r, across, -(-height >> tile_bits), False) >> 8) & 0xFFFF
        groups = int(tiles.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(r, n) for n in sizes] for _ in range(groups)]
    out, n = np.zeros(width * height, np.int64), width * height
    colours = np.zeros(1 << cache_bits, np.int64)
    at = kept = 0

    def remember(upto: int) -> None:
        nonlocal kept
        if cache_bits:
            new = out[kept:upto]
            colours[(new * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = new
        kept = upto

    bits = None
    while at < n:
        if tiles is not None:
            y, x = divmod(at, width)
            group = codes[int(tiles[(y >> tile_bits) * across + (x >> tile_bits)])]
        else:
            group = codes[0]
        green, red, blue, alpha, distance = group
        if tiles is None and None not in (evens := [c.even for c in group[:4]]):
            if bits is None:
                bits = np.unpackbits(np.frombuffer(r.data, np.uint8), bitorder="little")
            done = literal_run(r, bits, group, evens, out, at)
            at += done
            if at >= n:
                break
        s = r.symbol(green)
        if s < LITERALS:
            b, c, a = r.symbol(red), r.symbol(blue), r.symbol(alpha)
            out[at] = a << 24 | b << 16 | s << 8 | c
            at += 1
        elif s < LITERALS + LENGTHS:
            size, code = r.amount(s - LITERALS), r.amount(r.symbol(distance))
            if code > 120:
                back = code - 120
            else:
                x, y = near_distances()[code - 1]
                back = max(1, x + y * width)
            if back > at:
                raise ValueError("a back-reference before the image")
            size = min(size, n - at)
            if back >= size:
                out[at : at + size] = out[at - back : at - back + size]
            else:
                out[at : at + size] = np.resize(out[at - back : at], size)
            at += size
        else:
            remember(at)
            out[at] = colours[s - LITERALS - LENGTHS]
            at += 1
    return out


def literal_run(r: Reader, bits: np.ndarray, group: list[Code], evens: list[int], out: np.ndarray, at: int) -> int:
    """Decodes pixels up to the first that isn't four literals; returns how many."""
    green, red, blue, alpha, _ = group
    step = sum(evens)
    if step == 0:  # one symbol each: the rest of the image is one colour
        if green.only >= LITERALS:
            return 0
        out[at:] = alpha.only << 24 | red.only << 16 | green.only << 8 | blue.only
        return len(out) - at
    n = min(len(out) - at, (len(bits) - r.at) // step)
    rows = bits[r.at : r.at + n * step].reshape(n, step)
    head = rows[:, : green.width] if green.width <= step else None
    if evens[0] and head is None:
        return 0
    if evens[0]:
        peek = numbers(head)
        size = np.array(green.size)[peek]
        other = np.flatnonzero((size != evens[0]) | (green.table[peek] >= LITERALS))
        n = int(other[0]) if len(other) else n
    pixels, start = np.zeros(n, np.int64), 0
    for code, width, shift in zip((green, red, blue, alpha), evens, (8, 16, 0, 24), strict=True):
        if width:
            value = code.table[numbers(rows[:n, start : start + width])]
        else:
            value = code.only
        pixels |= value << shift
        start += width
    out[at : at + n] = pixels
    r.at += n * step
    return n


def numbers(bits: np.ndarray) -> np.ndarray:
    """The number that each row of bits spells, first bit lowest."""
    some = np.packbits(bits, axis=1, bitorder="little").astype(np.int64)
    return sum(some[:, k] << 8 * k for k in range(some.shape[1]))


# ---------------------------------------------------------------- transforms


def channels(argb: np.ndarray, width: int) -> np.ndarray:
    """(height, width, 4) of alpha, red, green, blue."""
    return argb.astype("<u4").view(np.uint8).reshape(-1, width, 4)[..., ::-1].astype(np.int32)


def packed(c: np.ndarray) -> np.ndarray:
    return c[..., ::-1].astype(np.uint8).reshape(-1).view("<u4").astype(np.int64)


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Prediction of a pixel's channels (last axis: alpha, red, green, blue) from its
    neighbours left, top, top-right and top-left."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, right)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left = np.abs(top - corner).sum(axis=-1, keepdims=True)  # left + top - corner, against left
        to_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = mean(left, top)
        diff = middle - corner
        return np.clip(middle + np.where(diff < 0, -(-diff // 2), diff // 2), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)


def tile_map(modes: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    across = -(-width >> bits)
    if len(modes) == 1:
        return np.broadcast_to(modes.reshape(1, 1), (height, width))
    return modes.reshape(-1, across)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]


def neighbours(c: np.ndarray, y: int, x: int) -> tuple[np.ndarray, ...]:
    """Left, top, top-right and top-left. The pixel right of a row's end is the first
    of the row itself, as the pixels lie one behind the other."""
    up = c[y - 1]
    right = up[x + 1] if x + 1 < c.shape[1] else c[y, 0]
    return c[y, x - 1], up[x], right, up[x - 1]


def undo_predictor(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Adds the predictions back. Black, left and top are sums along rows or columns,
    done whole where one of them holds for the entire image; others go pixel by pixel."""
    c = c.copy()
    c[0, 0] = (c[0, 0] + (255, 0, 0, 0)) & 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    c[:, 0] = np.cumsum(c[:, 0], axis=0) & 255
    if c.shape[0] == 1 or c.shape[1] == 1:
        return c
    used = np.unique(modes[1:, 1:]) if any(modes.strides) else modes[:1, 0]
    if len(used) == 1 and used[0] == 1:
        c[1:] = np.cumsum(c[1:], axis=1) & 255
    elif len(used) == 1 and used[0] == 2:
        c[:, 1:] = np.cumsum(c[:, 1:], axis=0) & 255
    elif len(used) == 1 and (used[0] == 0 or used[0] > 13):
        c[1:, 1:] = (c[1:, 1:] + (255, 0, 0, 0)) & 255
    else:
        for y in range(1, c.shape[0]):
            for x in range(1, c.shape[1]):
                c[y, x] = (c[y, x] + predict(int(modes[y, x]), *neighbours(c, y, x))) & 255
    return c


def do_predictor(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    out = c.copy()
    out[0, 0] = (c[0, 0] - (255, 0, 0, 0)) & 255
    out[0, 1:] = (c[0, 1:] - c[0, :-1]) & 255
    out[1:, 0] = (c[1:, 0] - c[:-1, 0]) & 255
    if c.shape[0] > 1 and c.shape[1] > 1:
        left, top, corner = c[1:, :-1], c[:-1, 1:], c[:-1, :-1]
        right = np.concatenate([c[:-1, 2:], c[1:, :1]], axis=1)
        if not any(modes.strides):
            out[1:, 1:] = (c[1:, 1:] - predict(int(modes[0, 0]), left, top, right, corner)) & 255
            return out
        for mode in np.unique(modes[1:, 1:]):
            at = modes[1:, 1:] == mode
            out[1:, 1:][at] = (c[1:, 1:] - predict(int(mode), left, top, right, corner))[at] & 255
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return ((x + 128) & 255) - 128


def cross(c: np.ndarray, factors: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (-1) what green and red say of red and blue. The
    factors' channels: red to blue, green to blue, green to red."""
    part = lambda f, v: signed(f) * signed(v) >> 5
    out = c.copy()
    red_blue, green_blue, green_red = factors[..., 1], factors[..., 2], factors[..., 3]
    out[..., 1] = (c[..., 1] + sign * part(green_red, c[..., 2])) & 255
    red = out[..., 1] if sign > 0 else c[..., 1]
    out[..., 3] = (c[..., 3] + sign * (part(green_blue, c[..., 2]) + part(red_blue, red))) & 255
    return out


def palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """(height, width) ARGB numbers of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    r = Reader(data[20 : 20 + size])
    if r.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, across = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS):
            bits = r.read(3) + 2
            tiles = read_image(r, -(-across >> bits), -(-height >> bits), False)
            undo.append((kind, across, bits, tiles))
        elif kind == GREEN:
            undo.append((kind, across, 0, None))
        else:
            n = r.read(8) + 1
            table = packed(np.cumsum(channels(read_image(r, n, 1, False), n), axis=1) & 255)
            bits = palette_bits(n)
            undo.append((kind, across, bits, table))
            across = -(-across >> bits)
    pixels, c = read_image(r, across, height, True), None
    for kind, wide, bits, extra in reversed(undo):
        if kind == PALETTE:
            index = (pixels if c is None else packed(c)).reshape(height, -1) >> 8 & 255
            per = 1 << bits
            step = 8 >> bits
            index = (index[:, :, None] >> (np.arange(per) * step)) & ((1 << step) - 1)
            index = index.reshape(height, -1)[:, :wide].reshape(-1)
            pixels, c = np.where(index < len(extra), extra[np.minimum(index, len(extra) - 1)], 0), None
            continue
        c = channels(pixels, wide) if c is None else c
        if kind == GREEN:
            c[..., 1:4:2] = (c[..., 1:4:2] + c[..., 2:3]) & 255
        elif kind == PREDICTOR:
            c = undo_predictor(c, tile_map(extra >> 8 & 255, wide, height, bits))
        else:
            c = cross(c, channels(tile_map(extra, wide, height, bits).reshape(-1), wide), 1)
    return (pixels if c is None else packed(c)).reshape(height, width)


# ---------------------------------------------------------------- writing


class Writer:
    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(few_bits(value, n))

    def bits(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint8)


@lru_cache(1 << 16)
def few_bits(value: int, n: int) -> np.ndarray:
    return np.array([value >> k & 1 for k in range(n)], np.uint8)


#: Lengths of the codes that the encoder uses: literals alike, so that they can be read
#: in arrays; lengths and distances share the rest of the code space.
GREEN_LENGTHS = (9,) * LITERALS + (5,) * 8 + (6,) * 16
BYTE_LENGTHS = (8,) * 256
DISTANCE_LENGTHS = (5,) * 24 + (6,) * 16
FARTHEST = (1 << 20) - 120  # the largest distance that these 40 codes reach


@cache
def header_bits(lengths: tuple[int, ...]) -> np.ndarray:
    """A normal prefix code: its lengths, with runs stored as repeats."""
    w, items, k = Writer(), [], 0
    while k < len(lengths):
        run = next((j for j in range(k, len(lengths)) if lengths[j] != lengths[k]), len(lengths)) - k
        if lengths[k] == 0:  # 17 stands for 3 to 10 zeros, 18 for 11 to 138
            while run >= 3:
                n = min(run, 138)
                items.append((18, n - 11, 7) if n > 10 else (17, n - 3, 3))
                k, run = k + n, run - n
            items += [(0, 0, 0)] * run
            k += run
            continue
        items.append((lengths[k], 0, 0))
        k, run = k + 1, run - 1
        while run >= 3:
            n = min(run, 6)
            items.append((16, n - 3, 2))
            k, run = k + n, run - n
        items += [(lengths[k - 1], 0, 0)] * run
        k += run
    kinds = sorted({s for s, _, _ in items})
    size = max(1, (len(kinds) - 1).bit_length())
    short = (1 << size) - len(kinds)  # so many can have one bit less
    inner = [0] * 19
    for j, s in enumerate(kinds):
        inner[s] = size - 1 if j < short and size > 1 else size
    codes = canonical(tuple(inner))
    w.put(0, 1)
    w.put(15, 4)
    for s in LENGTH_ORDER:
        w.put(inner[s], 3)
    w.put(0, 1)
    for s, extra, n in items:
        w.put(codes[s], inner[s])
        w.put(extra, n)
    return w.bits()


def put_code(w: Writer, lengths: tuple[int, ...], only: int | None) -> None:
    if only is None:
        w.parts.append(header_bits(lengths))
    else:
        w.put(0b101, 3)  # simple, one symbol, of 8 bits
        w.put(only, 8)


def prefix_of(amount: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number of a length or distance."""
    if amount <= 4:
        return amount - 1, 0, 0
    v = amount - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


@cache
def _bit_table(lengths: tuple[int, ...]) -> np.ndarray:
    """Bits of the codes of the literals, one row each."""
    n, codes = lengths[0], canonical(lengths)[:LITERALS]
    return (np.array(codes)[:, None] >> np.arange(n) & 1).astype(np.uint8)


def repeats(argb: np.ndarray, least: int = 8) -> list[tuple[int, int, int]]:
    """(start, length, distance) of runs that can be copied: pixels equal to the one
    before, and rows of eight or more pixels equal to those at an earlier place."""
    out = []
    same = np.concatenate([[0], argb[1:] == argb[:-1], [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(same))
    for a, b in zip(edges[::2] + 1, edges[1::2] + 1, strict=True):
        if b - a >= least:
            out.append((int(a), int(b - a), 1))
    # blocks of eight pixels, compared with the blocks before them
    n = len(argb) // least
    if n > 1:
        blocks = np.ascontiguousarray(argb[: n * least].astype("<u4")).view(f"V{4 * least}")
        _, first, inverse = np.unique(blocks, return_index=True, return_inverse=True)
        source = first[inverse.reshape(-1)]
        at = 0
        for k in np.flatnonzero(source < np.arange(n)):
            start, back = int(k) * least, int(k - source[k]) * least
            if back > FARTHEST or start < at or any(a < start + least and start < a + s for a, s, _ in out if a + s > start):
                continue
            size = least
            while start + size < len(argb) and argb[start + size] == argb[start + size - back]:
                size += 1
            size = min([size, *(a - start for a, _, _ in out if a >= start)])
            if size >= least:
                out.append((start, size, back))
                at = start + size
    return sorted(out)


@lru_cache(256)
def near_codes(width: int) -> dict[int, int]:
    """The short code of each distance that has one in an image of that width."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(near_distances())))}


def put_image(w: Writer, argb: np.ndarray, width: int, main: bool, copies: bool, cache_bits: int = 0) -> None:
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)  # one group of prefix codes
    c = [argb >> s & 255 for s in (8, 16, 0, 24)]
    runs = repeats(argb) if copies and not cache_bits else []
    only = [int(x[0]) if (x == x[0]).all() else None for x in c]
    if runs or cache_bits:
        only[0] = None
    green = GREEN_LENGTHS
    if cache_bits:  # cached colours take the place of half the literals' code space
        green = (10,) * LITERALS + (6,) * 8 + (7,) * 16 + (cache_bits + 1,) * (1 << cache_bits)
    for x, lengths in zip(only, (green, BYTE_LENGTHS, BYTE_LENGTHS, BYTE_LENGTHS), strict=True):
        put_code(w, lengths, x)
    put_code(w, DISTANCE_LENGTHS, None if runs else 0)
    tables = [None if x is not None else _bit_table(k) for x, k in zip(only, (green, BYTE_LENGTHS, BYTE_LENGTHS, BYTE_LENGTHS), strict=True)]

    def literals(a: int, b: int) -> None:
        rows = [t[x[a:b]] for t, x in zip(tables, c, strict=True) if t is not None]
        if rows and b > a:
            w.parts.append(np.concatenate(rows, axis=1).reshape(-1))

    if cache_bits:
        codes, seen = canonical(green), {}
        for k, v in enumerate(argb.tolist()):
            slot = (v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)
            if seen.get(slot, 0) == v:
                s = LITERALS + LENGTHS + slot
                w.put(codes[s], green[s])
            else:
                literals(k, k + 1)
            seen[slot] = v
        return
    codes, far = canonical(green), canonical(DISTANCE_LENGTHS)
    near = near_codes(width)
    at = 0
    for start, size, back in runs:
        literals(at, start)
        at = start + size
        while size:
            n = min(size, 4096)
            prefix, extra, bits = prefix_of(n)
            w.put(codes[LITERALS + prefix], green[LITERALS + prefix])
            w.put(extra, bits)
            prefix, extra, bits = prefix_of(near.get(back, back + 120))
            w.put(far[prefix], DISTANCE_LENGTHS[prefix])
            w.put(extra, bits)
            size -= n
    literals(at, len(argb))


def encode(argb: np.ndarray, transforms: tuple[int, ...] = (PREDICTOR, CROSS, GREEN), mode: int | np.ndarray = 2, factors: tuple[int, int, int] = (0, 0, 8), copies: bool = True, cache_bits: int = 0) -> bytes:
    """A lossless WebP file of (height, width) ARGB numbers. ``mode``: the predictor, or
    one for each tile of 512 (a number) or 4 pixels (an array). ``PALETTE`` alone is
    used if the colours fit."""
    height, width = argb.shape
    if not (1 <= height <= 1 << 14 and 1 <= width <= 1 << 14):
        raise ValueError("a side must have 1 to 16,384 pixels")
    w, pixels, across = Writer(), argb.reshape(-1).astype(np.int64), width
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == PALETTE:
            table, index = np.unique(pixels, return_inverse=True)
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            w.put(len(table) - 1, 8)
            deltas = channels(table, len(table)).copy()
            deltas[:, 1:] = (deltas[:, 1:] - deltas[:, :-1]) & 255
            put_image(w, packed(deltas), len(table), False, False)
            bits = palette_bits(len(table))
            per, step = 1 << bits, 8 >> bits
            index = index.reshape(height, across)
            index = np.pad(index, ((0, 0), (0, -across % per))).reshape(height, -1, per)
            across = index.shape[1]
            pixels = ((index << (np.arange(per) * step)).sum(axis=-1) << 8 | 0xFF << 24).reshape(-1)
            continue
        c = channels(pixels, across)
        if kind == GREEN:
            c[..., 1] = (c[..., 1] - c[..., 2]) & 255
            c[..., 3] = (c[..., 3] - c[..., 2]) & 255
        else:
            bits = 2 if kind == PREDICTOR and isinstance(mode, np.ndarray) else 9
            shape = (-(-height >> bits), -(-across >> bits))
            if kind == PREDICTOR:
                modes = mode.reshape(shape) if isinstance(mode, np.ndarray) else np.full(shape, mode)
                tiles = (modes.astype(np.int64) << 8 | 0xFF << 24).reshape(-1)
                c = do_predictor(c, tile_map(tiles >> 8 & 255, across, height, bits))
            else:
                tiles = np.full(shape, 0xFF << 24 | factors[0] << 16 | factors[1] << 8 | factors[2], np.int64).reshape(-1)
                c = cross(c, channels(tile_map(tiles, across, height, bits).reshape(-1), across), -1)
            w.put(bits - 2, 3)
            put_image(w, tiles, shape[1], False, False)
        pixels = packed(c)
    w.put(0, 1)
    put_image(w, pixels, across, True, copies, cache_bits)
    body = np.packbits(w.bits(), bitorder="little").tobytes()
    body += bytes(len(body) & 1)
    size = len(body)
    return b"RIFF" + (size + 12).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body
