"""Media columns: lossless WebP (the VP8L bitstream) written and read in numpy and plain Python.

``decode`` reads any VP8L stream: simple and normal prefix codes, meta prefix images, back-references, the
colour cache, and the predictor, cross-colour, subtract-green and palette transforms; it returns an array of
ARGB pixels.  Prefix codes are decoded without a bit loop: the code length at every bit position is looked up at
once, and the chain of positions is then followed.  ``encode`` writes such streams; its options choose the tools.

``store_payloads`` keeps a text as 8-bit grey samples in images 64 pixels wide (of at most IMAGE_BYTES; a longer
text becomes several images one after another), reads the stored bytes back and computes features from the
pixels.

Defined cases: null text is empty; an empty text is 64 zero samples; equal texts give equal values; repeated
rows are stored each; an empty table gives an empty result; a truncated or foreign stream raises ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE_BYTES = 1 << 20
WIDTH = 64
GAIN = 0.75

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH_MULTIPLIER = 0x1E35A7BD
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LEFT, ABOVE = 1, 2  # two of the predictor's modes

#: Short distances name neighbours (x left, y up), nearest first.
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


_REVERSED = np.zeros(1 << 15, np.int64)
for _k in range(15):
    _REVERSED |= ((np.arange(1 << 15) >> _k) & 1) << (14 - _k)


# Prefix codes -----------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code for the counts; counts are flattened until none exceeds the limit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        n = len(used)
        parent = [0] * (2 * n - 1)
        for k in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = k
            heapq.heapreplace(heap, (a + b, k))
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            out[used] = depth[:n]
            return out
        weights = [max(1, w >> 1) for w in weights]


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as they're written, least significant bit first, and their sizes (a lone symbol takes no bits)."""
    used = np.flatnonzero(lengths)
    codes, sizes = np.zeros(len(lengths), np.int64), lengths.copy()
    if len(used) < 2:
        sizes[:] = 0
        return codes, sizes
    order = used[np.argsort(lengths[used], kind="stable")]
    ls = lengths[order]
    top = int(ls[-1])
    starts = np.concatenate(([0], np.cumsum(1 << (top - ls))[:-1])) >> (top - ls)
    if int((1 << (top - ls)).sum()) != 1 << top:
        raise ValueError("not a complete prefix code")
    codes[order] = _REVERSED[starts] >> (15 - ls)
    return codes, sizes


class Code:
    """A prefix code to read: tables of symbol and size by the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.lone = int(used[0]) if len(used) == 1 else None
        self.most = int(used[-1]) if len(used) else 0
        if len(used) < 2:
            if not len(used):
                self.lone = 0
            self.bits, self.symbol, self.size = 0, np.zeros(1, np.int32) + self.lone, np.zeros(1, np.uint8)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        ls = lengths[order]
        top = self.bits = int(ls[-1])
        wide = 1 << (top - ls)
        if int(wide.sum()) != 1 << top:
            raise ValueError("not a complete prefix code")
        by_next = _REVERSED[: 1 << top] >> (15 - top)
        self.symbol = np.repeat(order, wide)[by_next].astype(np.int32)
        self.size = np.repeat(ls, wide)[by_next].astype(np.uint8)


# Bits -------------------------------------------------------------------------------------------------------


class BitWriter:
    def __init__(self):
        self.values, self.sizes, self.done = [], [], []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._close()
        self.done.append((values.astype(np.int64), sizes.astype(np.int64)))

    def _close(self) -> None:
        if self.values:
            self.done.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        """Fields lie in disjoint bits, so the 16-bit words they touch can be summed."""
        self._close()
        v, n = (np.concatenate(x) for x in zip(*self.done, strict=True))
        end = np.cumsum(n)
        start = end - n
        word, total = start >> 4, int(end[-1])
        x = v << (start & 15)
        words = np.zeros((total >> 4) + 4, np.int64)
        for k in range(3 if int(n.max()) > 16 else 2):
            words[: len(words)] += np.bincount(word + k, (x >> (16 * k)) & 0xFFFF, len(words))[: len(words)].astype(np.int64)
        return words.astype("<u2").tobytes()[: (total + 7) >> 3]


class BitReader:
    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at, self.n = raw, at, 8 * len(raw)

    def get(self, size: int) -> int:
        p = self.at
        if p + size > self.n:
            raise ValueError("truncated stream")
        self.at = p + size
        return (int.from_bytes(self.raw[p >> 3 : (p + size + 7) >> 3], "little") >> (p & 7)) & ((1 << size) - 1)

    def symbol(self, code: Code) -> int:
        if code.lone is not None:
            return code.lone
        p = self.at
        x = (int.from_bytes(self.raw[p >> 3 : (p >> 3) + 3], "little") >> (p & 7)) & ((1 << code.bits) - 1)
        self.at = p + int(code.size[x])
        if self.at > self.n:
            raise ValueError("truncated stream")
        return int(code.symbol[x])


def prefix_of(value):
    """(prefix symbol, extra bits, their value) of lengths and distances, arrays of at least 1."""
    v = np.asarray(value, np.int64) - 1
    high = np.where(v > 3, np.floor(np.log2(np.maximum(v, 1) + 0.5)).astype(np.int64), 0)
    extra = np.where(v > 3, high - 1, 0)
    second = (v >> extra) & 1
    return np.where(v > 3, 2 * high + second, v), extra, np.where(v > 3, v & ((1 << extra) - 1), 0)


# Writing ----------------------------------------------------------------------------------------------------


def _write_lone(w: BitWriter, symbol: int) -> None:
    w.put(5, 3)  # a simple code, of one symbol, of 8 bits
    w.put(symbol, 8)


def write_lengths(w: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        w.put(1, 1)
        w.put(max(0, len(used) - 1), 1)
        w.put(1, 1)
        w.put(int(used[0]) if len(used) else 0, 8)
        if len(used) == 2:
            w.put(int(used[1]), 8)
        return
    items = []
    edges = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    each = iter(zip(lengths[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True))
    prev, at, stop = 8, 0, 0
    while True:
        if at == stop:
            if (new := next(each, None)) is None:
                break
            x, at, stop = new
        run = stop - at
        if x == 0 and run >= 3:
            run = min(run, 138)
            items.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        elif x == prev and run >= 3:
            run = min(run, 6)
            items.append((16, run - 3, 2))
        else:
            run = 1
            items.append((x, 0, 0))
            prev = x or prev
        at += run
    own = code_lengths(np.bincount([s for s, _, _ in items], minlength=19), 7)
    codes, sizes = canonical(own)
    count = max(k for k, s in enumerate(LENGTH_ORDER) if own[s] or k < 4) + 1
    w.put(0, 1)
    w.put(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        w.put(int(own[s]), 3)
    w.put(0, 1)
    for s, extra, size in items:
        w.put(int(codes[s]), int(sizes[s]))
        w.put(extra, size)


def find_copies(pixels: np.ndarray, least: int = 16) -> list[tuple[int, int, int]]:
    """Greedy (position, length, distance) of earlier occurrences, found by hashes of 16 pixels and verified."""
    n = len(pixels)
    if n < least + 1:
        return []
    x = pixels.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    h = x * np.uint64(0x9E3779B97F4A7C15)
    for step in (1, 2, 4, 8):
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + (h[step:] ^ (h[step:] >> np.uint64(29)))
    order = np.argsort((h >> np.uint64(48)).astype(np.uint16), kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return []
    here, before = order[same + 1], order[same]
    by = np.argsort(here)
    out, free = [], 0
    for p, q in zip(here[by].tolist(), before[by].tolist(), strict=True):
        if p < free:
            continue
        most = min(4096, n - p)
        differ = np.flatnonzero(pixels[p : p + most] != pixels[q : q + most])
        size = int(differ[0]) if len(differ) else most
        if size >= least:
            out.append((p, size, p - q))
            free = p + size
    return out


@functools.lru_cache(64)
def _near(width: int) -> dict[int, int]:
    return {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEIGHBOURS))) if x + y * width >= 1}


def _copy_fields(found, width: int):
    """Prefix symbol, extra size and extra value of the lengths, and of the distances, of copies."""
    near = _near(width)
    return prefix_of([n for _, n, _ in found]), prefix_of([near.get(d, d + 120) for _, _, d in found])


def _write_green(w: BitWriter, pix: np.ndarray, found, width: int) -> None:
    """Pixels that differ in green alone: one field a literal, four a copy."""
    green = ((pix >> 8) & 255).astype(np.int64)
    counts, n_dist = np.zeros(280, np.int64), np.zeros(40, np.int64)
    if found:
        spot = np.array(found, np.int64)
        cover = np.zeros(len(pix) + 1, np.int8)
        cover[spot[:, 0]] += 1
        cover[spot[:, 0] + spot[:, 1]] -= 1
        keep = np.cumsum(cover[:-1], dtype=np.int8) == 0
        before = np.cumsum(keep)[spot[:, 0]] - keep[spot[:, 0]]
        green = green[keep]
        (ls, le, lv), (ds, de, dv) = _copy_fields(found, width)
        counts += np.bincount(ls + 256, minlength=280)
        n_dist += np.bincount(ds, minlength=40)
    counts[:256] += np.bincount(green, minlength=256)
    lengths = code_lengths(counts, 15)
    write_lengths(w, lengths)
    for shift in (16, 0, 24):
        _write_lone(w, (int(pix[0]) >> shift) & 255)
    d_lengths = code_lengths(n_dist, 15)
    write_lengths(w, d_lengths)
    codes, n = canonical(lengths)
    values, sizes = codes[green], n[green]
    if found:
        d_codes, d_n = canonical(d_lengths)
        at = np.repeat(before, 4)
        values = np.insert(values, at, np.stack((codes[ls + 256], lv, d_codes[ds], dv), 1).ravel())
        sizes = np.insert(sizes, at, np.stack((n[ls + 256], le, d_n[ds], de), 1).ravel())
    w.put_all(values, sizes)


def _cache_slot(argb: int, bits: int) -> int:
    return ((argb * HASH_MULTIPLIER) & 0xFFFFFFFF) >> (32 - bits)


def write_image(w: BitWriter, argb: np.ndarray, top: bool, cache_bits: int = 0, groups: np.ndarray | None = None, group_bits: int = 0, copies: bool = True) -> None:
    """Pixels as tokens under prefix codes.  groups: code group of each tile (only for the main image)."""
    height, width = argb.shape
    pix = argb.ravel().astype(np.int64)
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(int(groups is not None), 1)
        if groups is not None:
            w.put(group_bits - 2, 3)
            write_image(w, ((groups.astype(np.int64) >> 8) << 16) | ((groups.astype(np.int64) & 255) << 8) | 0xFF000000, False)
    found = find_copies(pix) if copies else []
    if groups is None and not cache_bits and ((pix ^ pix[0]) & 0xFFFF00FF == 0).all():
        _write_green(w, pix, found, width)
        return
    covered = np.zeros(len(pix) + 1, np.int32)
    for p, size, _ in found:
        covered[p] += 1
        covered[p + size] -= 1
    literal = np.cumsum(covered[:-1]) == 0
    at = np.flatnonzero(literal)
    n_lit = len(at)
    where = np.concatenate((at, np.array([p for p, _, _ in found], np.int64)))
    sym = np.zeros((len(where), 4), np.int64)
    extra_v, extra_n = np.zeros((len(where), 2), np.int64), np.zeros((len(where), 2), np.int64)
    kind = np.zeros(len(where), np.int8)  # 0 literal, 1 copy, 2 from the cache
    v = pix[at]
    for k, shift in enumerate((8, 16, 0, 24)):
        sym[:n_lit, k] = (v >> shift) & 255
    if found:
        (ls, le, lv), (ds, de, dv) = _copy_fields(found, width)
        kind[n_lit:] = 1
        sym[n_lit:, 0], sym[n_lit:, 1] = ls + 256, ds
        extra_n[n_lit:], extra_v[n_lit:] = np.stack((le, de), 1), np.stack((lv, dv), 1)
    order = np.argsort(where, kind="stable")
    where, sym, kind, extra_v, extra_n = where[order], sym[order], kind[order], extra_v[order], extra_n[order]
    if cache_bits:
        cache, done = [0] * (1 << cache_bits), 0
        for k, p in enumerate(where.tolist()):
            for x in pix[done:p].tolist():
                cache[_cache_slot(x, cache_bits)] = x
            done = p
            if kind[k] == 0 and cache[slot := _cache_slot(int(pix[p]), cache_bits)] == pix[p]:
                kind[k], sym[k, 0] = 2, 280 + slot
    g = np.zeros(len(where), np.int64) if groups is None else groups[(where // width) >> group_bits, (where % width) >> group_bits]
    n_groups = int(groups.max()) + 1 if groups is not None else 1
    sizes_of = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    values, sizes = np.zeros((len(where), 6), np.int64), np.zeros((len(where), 6), np.int64)
    for x in range(n_groups):
        mine = g == x
        lit, copy = mine & (kind == 0), mine & (kind == 1)
        for k, alphabet in enumerate(sizes_of):
            rows = mine if k == 0 else lit if k < 4 else copy
            col = 1 if k == 4 else k
            lengths = code_lengths(np.bincount(sym[rows, col], minlength=alphabet), 15)
            write_lengths(w, lengths)
            codes, n = canonical(lengths)
            to = 0 if k == 0 else 2 if k == 4 else k + 1
            values[rows, to], sizes[rows, to] = codes[sym[rows, col]], n[sym[rows, col]]
        values[copy, 1], sizes[copy, 1] = extra_v[copy, 0], extra_n[copy, 0]
        values[copy, 3], sizes[copy, 3] = extra_v[copy, 1], extra_n[copy, 1]
    w.put_all(values.ravel(), sizes.ravel())


def _split(argb):
    x = argb.astype(np.int64)
    return [(x >> s) & 255 for s in (24, 16, 8, 0)]


def _join(a, r, g, b):
    return ((a & 255) << 24) | ((r & 255) << 16) | ((g & 255) << 8) | (b & 255)


def _signed(x):
    return ((x & 255) ^ 128) - 128


def encode(argb: np.ndarray, subtract_green: bool = False, palette: bool = False, predictor: tuple[int, np.ndarray] | None = None, cross: tuple[int, np.ndarray] | None = None, cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None, copies: bool = True) -> bytes:
    """A WebP file of the ARGB pixels (height x width).  predictor, cross, groups: (tile bits, value of each tile)."""
    x = argb.astype(np.int64)
    height, width = x.shape
    w = BitWriter()
    for v, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    if palette:
        colours, index = np.unique(x, return_inverse=True)
        index = index.reshape(x.shape)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        steps = [np.diff(c, prepend=0) for c in _split(colours)]
        write_image(w, _join(*steps)[None, :], False)
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        per = 1 << bits
        padded = np.zeros((height, -(-width // per) * per), np.int64)
        padded[:, :width] = index
        packed = sum(padded[:, k::per] << (k * 8 // per) for k in range(per))
        x = (packed << 8) | 0xFF000000
    if cross:
        w.put(1, 1)
        w.put(CROSS_COLOUR, 2)
        w.put(cross[0] - 2, 3)
        write_image(w, cross[1], False)
        a, r, g, b = _split(x)
        e = _tiles(cross[1], cross[0], *x.shape)
        _, rb, gb, gr = _split(e)
        b = b - ((_signed(gb) * _signed(g)) >> 5) - ((_signed(rb) * _signed(r)) >> 5)
        r = r - ((_signed(gr) * _signed(g)) >> 5)
        x = _join(a, r, g, b)
    if subtract_green:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        a, r, g, b = _split(x)
        x = _join(a, r - g, g, b - g)
    if predictor:
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(predictor[0] - 2, 3)
        write_image(w, (predictor[1].astype(np.int64) << 8) | 0xFF000000, False)
        mode = _only(predictor[1])
        if mode in (LEFT, ABOVE):
            guess = np.empty_like(x)
            guess[0, 0], guess[0, 1:], guess[1:, 0] = 0xFF000000, x[0, :-1], x[:-1, 0]
            guess[1:, 1:] = x[1:, :-1] if mode == LEFT else x[:-1, 1:]
            x = _join(*(a - b for a, b in zip(_split(x), _split(guess), strict=True)))
        else:
            modes = _tiles(predictor[1].astype(np.int64), predictor[0], *x.shape).tolist()
            rows, out = x.tolist(), np.zeros_like(x)
            for i in range(x.shape[0]):
                for j in range(x.shape[1]):
                    out[i, j] = _add(rows[i][j], _guess(rows, modes[i][j], i, j), -1)
            x = out
    w.put(0, 1)
    write_image(w, x, True, cache_bits, groups[1] if groups else None, groups[0] if groups else 0, copies)
    body = w.bytes()
    pad = len(body) % 2
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad


# Reading ----------------------------------------------------------------------------------------------------


def read_code(r: BitReader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        lengths[r.get(8 if wide else 1)] = 1
        if two:
            lengths[r.get(8)] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for s in LENGTH_ORDER[: 4 + r.get(4)]:
        own[s] = r.get(3)
    code = Code(own)
    left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else alphabet
    at, prev = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[at] = s
            at += 1
            prev = s or prev
            continue
        run = 3 + r.get(2) if s == 16 else 3 + r.get(3) if s == 17 else 11 + r.get(7)
        if at + run > alphabet:
            raise ValueError("code lengths overrun")
        lengths[at : at + run] = prev if s == 16 else 0
        at += run
    return Code(lengths)


def read_value(r: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.get(extra) + 1


def read_distance(r: BitReader, code: Code, width: int) -> int:
    d = read_value(r, r.symbol(code))
    if d > 120:
        return d - 120
    x, y = NEIGHBOURS[d - 1]
    return max(1, x + y * width)


def read_image(r: BitReader, height: int, width: int, top: bool) -> np.ndarray:
    """The pixels (int64 ARGB) of an entropy-coded image."""
    cache_bits = r.get(4) if r.get(1) else 0
    groups, group_bits = None, 0
    if top and r.get(1):
        group_bits = r.get(3) + 2
        tiles = read_image(r, -(-height // (1 << group_bits)), -(-width // (1 << group_bits)), False)
        groups = (tiles >> 8) & 0xFFFF
    n_groups = int(groups.max()) + 1 if groups is not None else 1
    alphabets = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(r, a) for a in alphabets] for _ in range(n_groups)]
    if n_groups == 1 and not cache_bits:
        return _read_plain(r, codes[0], height * width, width).reshape(height, width)
    out, cache, n = [], [0] * (1 << cache_bits if cache_bits else 1), height * width
    while len(out) < n:
        p = len(out)
        c = codes[0] if groups is None else codes[int(groups[(p // width) >> group_bits, (p % width) >> group_bits])]
        s = r.symbol(c[0])
        if s < 256:
            red, blue, alpha = r.symbol(c[1]), r.symbol(c[2]), r.symbol(c[3])
            new = [(alpha << 24) | (red << 16) | (s << 8) | blue]
        elif s < 280:
            size = read_value(r, s - 256)
            back = read_distance(r, c[4], width)
            if back > p or p + size > n:
                raise ValueError("back-reference outside the image")
            new = [out[p - back + k % back] for k in range(size)]
        else:
            new = [cache[s - 280]]
        out += new
        if cache_bits:
            for x in new:
                cache[_cache_slot(x, cache_bits)] = x
    return np.array(out, np.int64).reshape(height, width)


def _read_plain(r: BitReader, codes: list[Code], n: int, width: int) -> np.ndarray:
    """One code group and no colour cache.  Sizes of a whole literal pixel are looked up at every bit position;
    a size of 0 marks what isn't a literal."""
    out = np.zeros(n, np.int64)
    start = r.at >> 3
    raw = np.frombuffer(r.raw, np.uint8)[start:]
    green, live = codes[0], [c.lone is None for c in codes[1:4]]
    if green.lone is not None and green.lone < 256 and not any(live):
        out[:] = (codes[3].lone << 24) | (codes[1].lone << 16) | (green.lone << 8) | codes[2].lone
        return out
    if green.lone is not None or any(live):
        return _read_by_pixel(r, codes, n, width)
    spread = np.concatenate((raw, np.zeros(18, np.uint8))).astype(np.uint32)
    window = spread[:-2] | (spread[1:-1] << np.uint32(8)) | (spread[2:] << np.uint32(16))
    mask = np.uint32((1 << green.bits) - 1)
    literal_size = np.where(green.symbol < 256, green.size, 0).astype(np.uint8)
    table = np.empty((len(window), 8), np.uint8)
    for k in range(8):
        table[:, k] = literal_size[(window >> np.uint32(k)) & mask]
    one = table.ravel()
    # Sizes of 2, 4 and 8 literals in a row, 0 where something else is among them.
    eight, here = one, np.arange(len(one), dtype=np.int32)
    for _ in range(3):
        then = eight[np.minimum(here + eight, len(one) - 1)]
        eight = np.where((eight > 0) & (then > 0), eight + then, 0).astype(np.uint8)
    step1, step8 = one.tobytes(), eight.tobytes()
    p, end, done, room = r.at - 8 * start, 8 * len(raw), 0, n
    spots: list[int] = []
    strides: list[int] = []
    runs: list[tuple[int, int, int]] = []  # (pixel, first of its strides, first of its spots)
    copies: list[tuple[int, int, int]] = []
    push, leap = spots.append, strides.append
    while room > 0:
        runs.append((done, len(strides), len(spots)))
        before = room
        while room >= 8 and p < end and (s := step8[p]):
            leap(p)
            p += s
            room -= 8
        while room > 0 and p < end and (s := step1[p]):
            push(p)
            p += s
            room -= 1
        done += before - room
        if room > 0 and p >= end or p > end:
            raise ValueError("truncated stream")
        if room > 0:
            r.at = p + 8 * start
            size = read_value(r, r.symbol(green) - 256)
            back = read_distance(r, codes[4], width)
            if back > done or size > room:
                raise ValueError("back-reference outside the image")
            copies.append((done, size, back))
            done += size
            room -= size
            p = r.at - 8 * start
    r.at = p + 8 * start
    rest = (codes[3].lone << 24) | (codes[1].lone << 16) | codes[2].lone
    colour = (green.symbol.astype(np.int64) << 8) | rest

    def seen(q):
        return colour[(window[q >> 3] >> (q & 7).astype(np.uint32)) & mask]

    leaps, q = np.empty((len(strides), 8), np.int64), np.array(strides, np.int64)
    for k in range(8):
        leaps[:, k] = seen(q)
        q = q + one[q]
    leaps, singles = leaps.ravel(), seen(np.array(spots, np.int64))
    for i, (at, j, k) in enumerate(runs):
        _, j_end, k_end = runs[i + 1] if i + 1 < len(runs) else (0, len(strides), len(spots))
        m = 8 * (j_end - j)
        out[at : at + m] = leaps[8 * j : 8 * j_end]
        out[at + m : at + m + k_end - k] = singles[k:k_end]
        if i < len(copies):
            at, size, back = copies[i]
            while size > 0:  # an overlapping copy doubles what it has
                m = min(size, back)
                out[at : at + m] = out[at - back : at - back + m]
                at, size, back = at + m, size - m, back + m if m == back else back
    return out


def _read_by_pixel(r: BitReader, codes: list[Code], n: int, width: int) -> np.ndarray:
    out: list[int] = []
    while len(out) < n:
        s = r.symbol(codes[0])
        if s < 256:
            red, blue, alpha = r.symbol(codes[1]), r.symbol(codes[2]), r.symbol(codes[3])
            out.append((alpha << 24) | (red << 16) | (s << 8) | blue)
            continue
        size = read_value(r, s - 256)
        back, p = read_distance(r, codes[4], width), len(out)
        if back > p or p + size > n:
            raise ValueError("back-reference outside the image")
        out += [out[p - back + k % back] for k in range(size)]
    return np.array(out, np.int64)


def _tiles(values: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return values[(np.arange(height) >> bits)[:, None], (np.arange(width) >> bits)[None, :]]


def _channels(x: int):
    return (x >> 24) & 255, (x >> 16) & 255, (x >> 8) & 255, x & 255


def _pack(c):
    return (c[0] << 24) | (c[1] << 16) | (c[2] << 8) | c[3]


def _add(x: int, y: int, sign: int = 1) -> int:
    return _pack([(a + sign * b) & 255 for a, b in zip(_channels(x), _channels(y), strict=True)])


def _mean(x: int, y: int) -> int:
    return _pack([(a + b) >> 1 for a, b in zip(_channels(x), _channels(y), strict=True)])


def _clip(v: int) -> int:
    return 0 if v < 0 else min(v, 255)


def _guess(rows, mode: int, i: int, j: int) -> int:
    """Prediction of pixel (i, j) from the finished pixels of rows."""
    if i == 0:
        return 0xFF000000 if j == 0 else rows[0][j - 1]
    up = rows[i - 1]
    if j == 0:
        return up[0]
    left, above, corner = rows[i][j - 1], up[j], up[j - 1]
    right = up[j + 1] if j + 1 < len(up) else rows[i][0]
    match mode:
        case 1:
            return left
        case 2:
            return above
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _mean(_mean(left, right), above)
        case 6:
            return _mean(left, corner)
        case 7:
            return _mean(left, above)
        case 8:
            return _mean(corner, above)
        case 9:
            return _mean(above, right)
        case 10:
            return _mean(_mean(left, corner), _mean(above, right))
        case 11:
            cl, ca, cc = _channels(left), _channels(above), _channels(corner)
            to_left = sum(abs(a - c) for a, c in zip(ca, cc, strict=True))
            to_above = sum(abs(a - c) for a, c in zip(cl, cc, strict=True))
            return left if to_left < to_above else above
        case 12:
            return _pack([_clip(a + b - c) for a, b, c in zip(_channels(left), _channels(above), _channels(corner), strict=True)])
        case 13:
            return _pack([_clip(m + int((m - c) / 2)) for m, c in zip(_channels(_mean(left, above)), _channels(corner), strict=True)])
        case _:
            return 0xFF000000


def _only(modes: np.ndarray) -> int:
    """The mode of all tiles, -1 if there are several."""
    return int(modes.flat[0]) if (modes == modes.flat[0]).all() else -1


def _undo_predictor(x: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    mode = _only((modes >> 8) & 15)
    if mode in (LEFT, ABOVE):  # running sums by channel: along the edge, then away from it
        channels = _split(x)
        channels[0][0, 0] += 0xFF
        for c in channels:
            if mode == LEFT:
                c[:, 0] = np.cumsum(c[:, 0])
                np.cumsum(c, axis=1, out=c)
            else:
                c[0] = np.cumsum(c[0])
                np.cumsum(c, axis=0, out=c)
        return _join(*channels)
    tile = _tiles((modes >> 8) & 15, bits, *x.shape).tolist()
    rows = x.tolist()
    for i in range(len(rows)):
        for j in range(len(rows[i])):
            rows[i][j] = _add(rows[i][j], _guess(rows, tile[i][j], i, j))
    return np.array(rows, np.int64)


def _undo_cross(x: np.ndarray, bits: int, elements: np.ndarray) -> np.ndarray:
    a, r, g, b = _split(x)
    _, rb, gb, gr = _split(_tiles(elements, bits, *x.shape))
    r = (r + ((_signed(gr) * _signed(g)) >> 5)) & 255
    b = b + ((_signed(gb) * _signed(g)) >> 5) + ((_signed(rb) * _signed(r)) >> 5)
    return _join(a, r, g, b)


def _undo_palette(x: np.ndarray, colours: np.ndarray, bits: int, width: int) -> np.ndarray:
    per = 1 << bits
    size = 8 // per
    index = (x >> 8) & 255
    out = np.empty((x.shape[0], x.shape[1] * per), np.int64)
    for k in range(per):
        out[:, k::per] = (index >> (k * size)) & ((1 << size) - 1)
    full = np.zeros(256, np.int64)
    full[: len(colours)] = colours
    return full[out[:, :width]]


def decode(raw: bytes) -> np.ndarray:
    """ARGB pixels (uint32, height x width) of a WebP file with a lossless image."""
    if raw[:4] != b"RIFF" or raw[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", raw[16:20])[0]
    body = raw[20 : 20 + size]
    if len(body) < size:
        raise ValueError("truncated stream")
    r = BitReader(body)
    if r.get(8) != SIGNATURE:
        raise ValueError("bad signature")
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while r.get(1):
        kind = r.get(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.get(3) + 2
            data = read_image(r, -(-height // (1 << bits)), -(-now // (1 << bits)), False)
            undo.append((kind, bits, data, now))
        elif kind == PALETTE:
            n = r.get(8) + 1
            steps = read_image(r, 1, n, False)[0]
            colours = _join(*(np.cumsum(c) for c in _split(steps)))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, bits, colours, now))
            now = -(-now // (1 << bits))
        else:
            undo.append((kind, 0, None, now))
    x = read_image(r, height, now, True)
    for kind, bits, data, wide in reversed(undo):
        if kind == PREDICTOR:
            x = _undo_predictor(x, bits, data)
        elif kind == CROSS_COLOUR:
            x = _undo_cross(x, bits, data)
        elif kind == SUBTRACT_GREEN:
            a, red, g, b = _split(x)
            x = _join(a, red + g, g, b + g)
        else:
            x = _undo_palette(x, data, bits, wide)
    return x.astype(np.uint32)


# Columns ----------------------------------------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def _bits(values: np.ndarray) -> float:
    """What an ideal code of the samples takes."""
    n = np.bincount(values.ravel(), minlength=256)
    n = n[n > 0]
    return float((n * np.log2(n.sum() / n)).sum())


def best_predictor(grey: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The left or upper neighbour as prediction, if the differences take less than GAIN of what the samples take."""
    plain, found = GAIN * _bits(grey), None
    for mode in (LEFT, ABOVE):
        step = grey.copy()
        step[1:, 0] -= grey[:-1, 0]
        step[:, 1:] -= grey[:, :-1]
        if mode == ABOVE:
            step[1:, 1:] = grey[1:, 1:] - grey[:-1, 1:]
        bits = _bits(step & 255)
        if bits < plain:
            plain, found = bits, mode
    tiles = -(-grey.shape[0] // 512), -(-grey.shape[1] // 512)
    return None if found is None else (9, np.full(tiles, found, np.int64))


def store(payload: bytes) -> list[bytes]:
    """Lossless WebP files of grey samples; a few distinct values go by a palette, which packs several a pixel, others
    by the difference to a neighbour where that shrinks them."""
    out = []
    for at in range(0, len(payload), IMAGE_BYTES):
        grey = np.frombuffer(payload[at : at + IMAGE_BYTES], np.uint8).reshape(-1, WIDTH).astype(np.int64)
        few = np.count_nonzero(np.bincount(grey.ravel(), minlength=256)) <= 16
        out.append(encode(grey * 0x010101 | 0xFF000000, subtract_green=not few, palette=few, predictor=None if few else best_predictor(grey)))
    return out


def load(stored: bytes) -> np.ndarray:
    """Grey samples of the files that follow one another in stored."""
    out, at = [], 0
    while at < len(stored):
        size = 8 + struct.unpack("<I", stored[at + 4 : at + 8])[0]
        out.append((decode(stored[at : at + size]) & 255).astype(np.uint8).ravel())
        at += size
    return np.concatenate(out)


def feature_of(samples: np.ndarray) -> str:
    """Mean (in 1/256), and how many samples of each 1000 lie in each of eight equal ranges."""
    share = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    return f"m{int(samples.sum(dtype=np.int64)) * 256 // len(samples)}:" + "-".join(map(str, share.tolist()))


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Per row: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and media)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for i in range(0, len(texts), 512):
                cols: list[list] = [[] for _ in range(8)]
                for t in texts[i : i + 512]:
                    media = b"".join(store(payload_of(t or b"")))
                    back = load(media)
                    raw = back.tobytes()
                    row = (len(t or b""), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(back), media)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 512), *made[: 8 if with_media else 7]], names[: 9 if with_media else 8])

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    types = ["long", "long", "long", "string", "long", "long", "string", "string", "binary"]
    schema = ", ".join(f"{n} {t}" for n, t in list(zip(names, types, strict=True))[: 9 if with_media else 8])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
