"""Removal of repeated byte strings by a column-wise multi-document suffix construction.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.  Three
steps, each over whole texts in blocks, with keys dealt to shards by range:

1. *Candidates.*  Every string of ``length`` bytes has a key, the least hash of the K-byte strings inside it.
   Equal strings have equal keys, so a string whose key occurs in one document alone can't repeat elsewhere and
   needs no more work.  This loses no repeat.
2. *Construction.*  What remains is cut into segments of consecutive strings with one key; equal segments are merged
   (smallest document id), and a key with one segment left needs no order.  A symbol is PACKED bytes, so each other
   segment is one string of symbols a phase and a round moves that many bytes.  A shard inserts one symbol per string
   each round, from the last symbol to the first, and updates the collection's Burrows-Wheeler transform, the common
   prefix lengths and the suffix identifiers, which are read and rewritten in sequence (``Column``: a file of the
   task's own, deleted with it, unless it is small).
   Suffixes whose common prefixes reach ``length`` form a class of equal strings; its smallest id is sent back.
3. *Removal.*  The document's owner marks, merges and cuts the covered bytes.

A very common passage costs each block one segment, however often it occurs.  A block sends a shard one row of plain
binary columns, so there are never more rows than keys, and both sides read them as arrays.

Defined cases: null text is empty; a text shorter than ``length`` keeps every byte; rows with equal ids count as
one document and never remove each other's bytes; rows with a null id are kept whole and remove nothing; empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U, binary_column, buffers, decode_table, gather, mix, n_blocks, pack_blocks, pieces, shard_of, text_bytes, tidy, with_block

K = 16
SHARD_BYTES = 8_000_000
BATCH_SEGMENTS = 1024
SEEDS = 8
FILE_BYTES = 1 << 16
#: Bytes a symbol, the first that divides the length: strings of 50 bytes are 5 symbols, at each of 10 phases.
PACKED = (10, 8, 6, 5, 4, 3, 2, 1)
PIECE = 1 << 16
ZSTD = pa.Codec("zstd", 1)


# Candidates -------------------------------------------------------------------------------------------------


def window_keys(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """For each position the least hash of the K-byte strings within the ``length`` bytes that start there; each
    seed is another hash."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = eights(data).copy()
    h = mix(x[: len(data) - K + 1] * U(0x9E3779B97F4A7C15) + (x[8 : len(data) - K + 9] ^ (x[8 : len(data) - K + 9] >> U(31))) * U(0xD6E8FEB86659FD93 + 2 * seed))
    want, have = length - K + 1, 1
    while 2 * have <= want:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < want:
        h = np.minimum(h[: have - want], h[want - have :])
    return h[:n]


def eights(data: np.ndarray, past: int = 0) -> np.ndarray:
    """The eight bytes that start at each position (and at ``past`` more) as one number, zeros behind the last: a view
    of all offsets into the bytes."""
    padded = np.concatenate((data, np.zeros(7 + past, np.uint8)))
    return np.ndarray((len(data) + past,), "<u8", padded, 0, (1,))


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, seed: int = 0):
    """Runs of string starts with one key inside one document, of at most length - K + 1 starts:
    (first position, number of starts, key, document) arrays.  A key has 47 bits, the upper ones of 64: keys that meet
    by chance only send a segment more to the construction."""
    most = length - K + 1
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64, np.int64)]
    for i, j in pieces(offsets, PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        v = window_keys(data[a:b], length, seed)
        if not len(v):
            continue
        begin = offsets[i:j] - a
        stop = np.maximum(begin, offsets[i + 1 : j + 1] - a - length + 1)  # behind the document's last string
        cut = np.zeros(len(v) + 1, bool)
        cut[1:-1] = v[1:] != v[:-1]
        cut[begin[begin <= len(v)]] = True
        cut[stop[stop <= len(v)]] = True
        cut[-1] = True
        at = np.flatnonzero(cut)
        n, at = np.diff(at), at[:-1]
        doc = np.searchsorted(begin, at, "right") - 1
        inside = at < stop[doc]
        at, n, doc = at[inside], n[inside], doc[inside]
        if len(n) and n.max() > most:
            parts = -(-n // most)
            within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            left = np.repeat(n, parts) - within * most
            at, n, doc = np.repeat(at, parts) + within * most, np.minimum(left, most), np.repeat(doc, parts)
        # Least hashes crowd near zero, and keys are dealt by range.
        for o, x in zip(out, (at + a, n, mix(v[at]) & ~U(0x1FFFF), doc + i), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


# Construction -----------------------------------------------------------------------------------------------


class Column:
    """A sequence that is written and read from start to end; from FILE_BYTES on it is a file."""

    def __init__(self, dtype):
        self.dtype, self.file, self.held = dtype, None, None

    def write(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values, self.dtype)
        if values.nbytes <= FILE_BYTES:
            self.held = values
            return
        self.held = None
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0)
        self.file.write(values.data)
        self.file.truncate()

    def read(self) -> np.ndarray:
        if self.held is not None:
            return self.held
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.dtype)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = self.held = None


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for each pair (lo < hi), by minima over powers of two."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    row, width = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(row[lo[here]], row[hi[here] - width])
        row = np.minimum(row[:-width], row[width:]) if len(row) > width else row
        width *= 2
    return out


def sorted_suffixes(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
    """All suffixes of the strings in order: (string, start, common prefix with the one before).

    ``sym`` is the transform: the symbol before each suffix, plus one (0: none).  The k-th occurrence of a symbol
    in it belongs to the k-th suffix that begins with that symbol, which tells where the round's new suffixes go.
    """
    m = len(ends)
    most = int(sizes.max(initial=0))
    wide = np.uint8 if most < 255 else np.int32
    kind = np.uint16 if int(flat.max(initial=0)) < 65535 else np.int32
    flat = np.concatenate((flat, [0])).astype(kind) + kind(1)
    sym_file, lcp_file, id_file = Column(kind), Column(wide), Column(np.int64)
    sym_file.write(np.where(sizes > 0, flat[np.maximum(ends - 1, 0)], 0))
    lcp_file.write(np.zeros(m, wide))
    id_file.write((np.arange(m, dtype=np.int64) << 32) | sizes)
    at = np.arange(m)  # where each string's longest suffix so far stands
    for j in range(1, most + 1):
        sym, lcp, ident = sym_file.read(), lcp_file.read(), id_file.read()
        fresh = np.full(len(sym), -1, np.int32)
        live = np.flatnonzero(sizes >= j)
        fresh[at[live]] = live
        order = np.argsort(sym, kind="stable")
        order = order[np.searchsorted(sym[order], 1) :]
        who = fresh[order]
        new = who >= 0
        n = len(order)
        nsym, nlcp, nid = np.empty(m + n, kind), np.empty(m + n, wide), np.empty(m + n, np.int64)
        nsym[:m], nlcp[:m], nid[:m] = sym[:m], lcp[:m], ident[:m]
        old = m + np.flatnonzero(~new)
        nsym[old], nlcp[old], nid[old] = sym[m:], lcp[m:], ident[m:]
        spot = np.flatnonzero(new)
        s = who[spot]
        left = sizes[s] - j
        nid[m + spot] = (s.astype(np.int64) << 32) | left
        nsym[m + spot] = np.where(left > 0, flat[np.maximum(ends[s] - j - 1, 0)], 0)
        at[s] = m + spot
        check = np.zeros(n + 1, bool)
        check[spot] = True
        check[spot + 1] = True
        t = np.flatnonzero(check[:n])
        head = (t == 0) | (sym[order[t]] != sym[order[np.maximum(t - 1, 0)]])
        nlcp[m + t[head]] = 0
        t = t[~head]
        nlcp[m + t] = range_minima(lcp, order[t - 1] + 1, order[t] + 1) + 1
        for f, x in ((sym_file, nsym), (lcp_file, nlcp), (id_file, nid)):
            f.write(x)
    ident, lcp = id_file.read(), lcp_file.read().astype(np.int64)
    for f in (sym_file, lcp_file, id_file):
        f.close()
    return ident >> 32, ident & 0xFFFFFFFF, lcp


def _words(flat: np.ndarray, q: int) -> np.ndarray:
    """A number for the q bytes at each position, equal where they are; past the end zeros follow."""
    if q <= 8:
        x = eights(flat)
        return x & U((1 << 8 * q) - 1)
    _, half = np.unique(_words(flat, q // 2), return_inverse=True)
    half = np.concatenate((half, np.zeros(q // 2, half.dtype))).astype(np.uint64)
    return (half[: len(flat)] << U(32)) | half[q // 2 :]


def class_minima(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes (in order of segment and start) the least id among its equals."""
    q = next(x for x in PACKED if length % x == 0)
    first = ends - sizes
    n_sym = np.maximum(0, (sizes[:, None] - np.arange(q)[None, :]) // q).ravel()
    sub_ends = np.cumsum(n_sym)
    at = np.repeat((first[:, None] + np.arange(q)[None, :]).ravel() - q * (sub_ends - n_sym), n_sym) + q * np.arange(int(sub_ends[-1]))
    _, symbols = np.unique(_words(flat, q)[at], return_inverse=True)
    string, start, lcp = sorted_suffixes(symbols, sub_ends, n_sym)
    string, start = string // q, string % q + q * start
    head = np.flatnonzero(lcp * q < length)
    least = np.minimum.reduceat(docs[string], head) if len(head) else docs[:0]
    value = np.repeat(least, np.diff(head, append=len(lcp)))
    n = sizes - length + 1
    base = np.cumsum(n) - n
    whole = start < n[string]
    out = np.empty(int(n.sum()), np.int64)
    out[base[string[whole]] + start[whole]] = value[whole]
    return out


def least_ids(data: np.ndarray, pos: np.ndarray, size: np.ndarray, docs: np.ndarray, key: np.ndarray, length: int, seed: int = 0):
    """For each string of ``length`` bytes in the segments the least id among its equals: (values, first of each
    segment's values, number of its strings).

    Equal segments are merged; the strings of a key with one segment are equal to its own alone.  Other keys are taken
    together, about BATCH_SEGMENTS segments at a time.  A key with more (a very common K-byte string in many
    surroundings) is cut again by the keys of another hash.
    """
    by = np.argsort(key, kind="stable")
    order, head = equal_stretches(key[by], *(x[by] for x in digests(data, pos, size)))
    order = by[order]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(head) - 1
    one = order[head]  # one of each distinct segment, in order of key
    least = np.minimum.reduceat(docs[order], np.flatnonzero(head)) if len(one) else docs[:0]
    edge = np.flatnonzero(np.concatenate(([True], key[one][1:] != key[one][:-1], [True]))) if len(one) else np.zeros(1, np.int64)
    n = size[one] - length + 1
    base = np.cumsum(n) - n
    values = np.repeat(least, n)
    many = np.flatnonzero(np.diff(edge) > 1)
    rows = gather(np.arange(len(one)), edge[many], np.diff(edge)[many])  # the segments of keys with several
    edge = np.concatenate(([0], np.cumsum(np.diff(edge)[many])))
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + BATCH_SEGMENTS, "right")) - 1)
        here = rows[edge[i] : edge[j]]
        mine = one[here]
        flat, ends = gather(data, pos[mine], size[mine]), np.cumsum(size[mine])
        if len(mine) > BATCH_SEGMENTS and seed < SEEDS:
            p, m, again, doc = runs_of(flat, np.concatenate(([0], ends)), length, seed + 1)
            got, first, count = least_ids(flat, p, m + length - 1, least[here][doc], again, length, seed + 1)
            got = gather(got, first, count)
        else:
            got = class_minima(flat, ends, size[mine], least[here], length)
        values[gather(np.arange(len(values)), base[here], n[here])] = got
        i = j
    return values, base[of], n[of]


# Blocks -----------------------------------------------------------------------------------------------------


class Block:
    """The documents of one block, in an order that doesn't depend on how they arrived."""

    def __init__(self, t: pa.Table, length: int):
        docs = decode_table(t.column("payload"))
        ids = docs.column("doc_id").to_numpy(zero_copy_only=False) if not docs.column("doc_id").null_count else np.array([np.nan if x is None else x for x in docs.column("doc_id").to_pylist()], object)
        self.known = np.array([x is not None for x in docs.column("doc_id").to_pylist()]) if docs.column("doc_id").null_count else np.ones(len(docs), bool)
        ids = np.array([int(x) if k else -1 for x, k in zip(ids, self.known, strict=True)], np.int64)
        data, offsets = buffers(docs.column("text"))
        order = np.lexsort((np.diff(offsets), ids, ~self.known))
        if not (order == np.arange(len(order))).all():
            docs = docs.take(order)
            data, offsets = buffers(docs.column("text"))
        self.table = docs
        self.ids, self.known, self.data, self.offsets = ids[order], self.known[order], data, offsets
        self.pos, self.n, self.key, self.doc = runs_of(data, offsets, length)
        keep = self.known[self.doc]
        if not keep.all():
            self.pos, self.n, self.key, self.doc = (x[keep] for x in (self.pos, self.n, self.key, self.doc))
        self.length = length

    def keys(self):
        """Distinct keys in order, and which of them more than one document of the block has."""
        self.order = np.argsort(self.key, kind="stable")
        k, d = self.key[self.order], self.ids[self.doc[self.order]]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        head = np.flatnonzero(first)
        if not len(head):
            return k, np.zeros(0, bool)
        self.times = np.diff(head, append=len(k))
        return k[head], np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)

    def segments(self, bits: np.ndarray):
        """Runs with shared keys (bits: by distinct key), merged where their bytes are equal: (run of each segment's
        first member, least id, segment of each run or -1), segments in order of key."""
        of_run = np.full(len(self.pos), -1, np.int64)
        if not len(self.pos):
            return self.pos, self.ids[self.doc], of_run
        self.keys()
        on = self.order[np.repeat(bits.astype(bool), self.times)]  # by key, and by document under a key
        k = self.key[on]
        order, head = equal_stretches(k, *digests(self.data, self.pos[on], self.n[on] + self.length - 1))
        of_run[on[order]] = np.cumsum(head) - 1
        first = on[order[head]]
        return first, self.ids[self.doc[first]], of_run


def equal_stretches(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of stretches (given in order of key) in which equal ones follow each other, in their own order, and
    where another one begins.  (One number sorts fastest; where its 40 bits of the digest meet by chance, equal
    stretches may not be merged, which costs a little work.)"""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    order = np.argsort((np.cumsum(new).astype(np.uint64) << U(40)) | (a >> U(24)), kind="stable")
    a, b = a[order], b[order]
    new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def digests(data: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each stretch; overlapping stretches are fine."""
    a, b = mix(size.astype(np.uint64) + U(0x243F6A8885A308D3)), mix(size.astype(np.uint64) + U(0x13198A2E03707344))
    x = eights(data, int(size.max(initial=0)) + 8)
    for c in range(0, int(size.max(initial=0)), 8):
        left = np.clip(size - c, 0, 8).astype(np.uint64)
        word = np.where(left > 0, x[pos + c] & (~U(0) >> (U(64) - U(8) * np.maximum(left, U(1)))), U(0))
        a, b = mix(a * U(0xD6E8FEB86659FD93) + word), mix(b * U(0xD6E8FEB86659FD93) + word)
    return a, b


ROW = "shard int, block int, "


def rows_of(block: int, keys: np.ndarray, shards: int, cols: dict[str, tuple[np.ndarray, np.ndarray | None]]) -> pa.Table:
    """One row a shard: shard, block and the shard's part of each column.  keys are in order; a column is an array
    with an item a key, or with as many items a key as the second array says, which travels compressed."""
    shard = shard_of(keys, shards)
    head = np.flatnonzero(np.diff(shard, prepend=-1))
    edge = np.append(head, len(keys))
    out = []
    for values, each in cols.values():
        out.append(binary_column(values, edge) if each is None else zipped(values, np.concatenate(([0], np.cumsum(each)))[edge]))
    return pa.table([pa.array(shard[head], pa.int32()), pa.array(np.full(len(head), block), pa.int32()), *out], names=["shard", "block", *cols])


def short_keys(keys: np.ndarray) -> np.ndarray:
    """The upper six bytes of each key, one key a row."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def long_keys(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def zipped(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Binary cells over values[edge[i]:edge[i + 1]], each compressed by itself."""
    view = memoryview(np.ascontiguousarray(values)).cast("B")
    width = values.itemsize
    return pa.array([ZSTD.compress(view[width * a : width * b], asbytes=True) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())


def unzipped(cells: pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of compressed cells of the given sizes."""
    return np.frombuffer(b"".join(ZSTD.decompress(x.as_buffer(), int(n), asbytes=True) for x, n in zip(cells, sizes, strict=True)), np.uint8)


def packed_bits(bits: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Binary cells of the bits edge[i]:edge[i + 1], eight to a byte."""
    n = np.diff(edge)
    start = np.concatenate(([0], np.cumsum(-(-n // 8))))
    wide = np.zeros(8 * int(start[-1]), bool)
    wide[np.arange(len(bits)) + np.repeat(8 * start[:-1] - edge[:-1], n)] = bits
    return binary_column(np.packbits(wide), start)


def in_order(t: pa.Table, kinds: dict[str, str]) -> list[np.ndarray]:
    """The binary columns of one block's rows, put together in order of shard."""
    t = t.sort_by("shard")
    return [buffers(t.column(c))[0].view(k) for c, k in kinds.items()]


def repeated(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) if with_bytes,
    text (their whole characters) if with_text, and the columns named in carry as they are."""
    if length < K:
        raise ValueError(f"length must be at least {K}")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carry{k}") for k, c in enumerate(carry or [])])
    total = text_bytes(src)
    blocks, shards = n_blocks(total), max(64, -(-total // SHARD_BYTES))
    packed = pack_blocks(with_block(src, blocks), src.columns)

    small = "u1" if 2 * length - K < 256 else "<u4"  # the size of a segment

    def told(b: Block, t: pa.Table) -> np.ndarray:
        """The bits of a block's keys, in order, from the rows of all shards."""
        bits = np.unpackbits(in_order(t, {"bits": "u1"})[0]).astype(bool)
        n = np.diff(np.flatnonzero(np.concatenate(([True], np.diff(shard_of(b.keys()[0], shards)) > 0, [True])))) if len(b.pos) else np.zeros(0, np.int64)
        start = np.cumsum(-(-n // 8)) - -(-n // 8)
        return gather(bits, 8 * start, n)

    @tidy
    def ask(t: pa.Table) -> pa.Table:
        keys, many = Block(t, length).keys()
        return rows_of(t.column("block")[0].as_py(), keys, shards, {"keys": (short_keys(keys | (many.astype(np.uint64) << U(16))), None)})

    @tidy
    def share(t: pa.Table) -> pa.Table:
        raw, at = buffers(t.column("keys"))
        flat = long_keys(raw)
        many, flat = (flat & U(1 << 16)) > 0, flat & ~U(0x1FFFF)
        order = np.argsort(flat, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        n = np.diff(head, append=len(flat))
        shared = np.empty(len(flat), bool)
        shared[order] = np.repeat((n > 1) | np.logical_or.reduceat(many[order], head), n)
        return pa.table([t.column("shard"), t.column("block"), packed_bits(shared, at // 6)], names=["shard", "block", "bits"])

    @tidy
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return empty_cut
        b = Block(left, length)
        first, least, _ = b.segments(told(b, right))
        size = b.n[first] + length - 1
        return rows_of(left.column("block")[0].as_py(), b.key[first], shards, {"keys": (short_keys(b.key[first]), None), "size": (size.astype(small), None), "least": (least.astype("<i8"), None), "bytes": (gather(b.data, b.pos[first], size), size)})

    @tidy
    def build(t: pa.Table) -> pa.Table:
        (key, at), (size, _), (docs_, _) = (buffers(t.column(c)) for c in ("keys", "size", "least"))
        size, at = size.view(small).astype(np.int64), at // 6
        data = unzipped(t.column("bytes"), np.diff(np.concatenate(([0], np.cumsum(size)))[at]))
        values, base, n = least_ids(data, np.cumsum(size) - size, size, docs_.view("<i8"), long_keys(key), length)
        # Runs of one id: a segment's first string begins one.
        begin = np.zeros(len(values) + 1, bool)
        begin[base] = True
        begin[1:-1] |= values[1:] != values[:-1]
        begin[-1] = True
        edge = np.flatnonzero(begin)
        lo, hi = np.searchsorted(edge, base), np.searchsorted(edge, base + n)
        runs = hi - lo
        ends = np.concatenate(([0], np.cumsum(runs)))[at]
        out = [binary_column(gather(x, lo, runs), ends) for x in (values[edge[:-1]].astype("<i8"), np.diff(edge).astype(small))]
        return pa.table([t.column("shard"), t.column("block"), *out], names=["shard", "block", "least", "times"])

    @tidy
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return empty
        b = Block(left, length)
        first, _, of_run = b.segments(told(b, right.filter(pc.is_valid(right.column("bits")))))
        n = b.n[first]
        values, times = in_order(right.filter(pc.is_valid(right.column("least"))), {"least": "<i8", "times": small})
        values = np.repeat(values, times)
        base = np.cumsum(n) - n
        on = np.flatnonzero(of_run >= 0)
        seg = of_run[on]
        n_on = b.n[on]
        hit = gather(values, base[seg], n_on) < np.repeat(b.ids[b.doc[on]], n_on)
        starts = (np.arange(len(hit)) + np.repeat(b.pos[on] - (np.cumsum(n_on) - n_on), n_on))[hit]
        change = np.bincount(starts, minlength=len(b.data) + 1) - np.bincount(starts + length, minlength=len(b.data) + 1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.zeros(len(gone) + 1, bool)
        edge[b.offsets] = True
        opens = gone & (np.concatenate(([True], ~gone[:-1])) | edge[: len(gone)]) if len(gone) else gone
        removed, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(opens)))
        n_removed, n_spans = np.diff(removed[b.offsets]), np.diff(spans[b.offsets])
        kept = b.data[~gone]
        at = b.offsets - removed[b.offsets]
        texts = [kept[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
        ids = pa.array([i if k else None for i, k in zip(b.ids.tolist(), b.known.tolist(), strict=True)], pa.int64())
        cols = [ids, pa.array(np.diff(b.offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
        if with_bytes:
            cols.append(pa.array(texts, pa.binary()))
        if with_text:
            cols.append(pa.array([x.decode("utf-8", "ignore") for x in texts], pa.string()))
        return pa.table(cols + [b.table.column(f"carry{k}") for k in range(len(carry or []))], names=schema.names)

    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes + ", text string" * with_text)
    for c in carry or []:
        schema = schema.add(c, src.schema[f"carry{carry.index(c)}"].dataType)
    empty = to_arrow_schema(schema).empty_table()
    empty_cut = to_arrow_schema(T._parse_datatype_string(ROW + "keys binary, size binary, least binary, bytes binary")).empty_table()

    shared = packed.groupBy("block").applyInArrow(ask, ROW + "keys binary").groupBy("shard").applyInArrow(share, ROW + "bits binary")
    cuts = packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(cut, ROW + "keys binary, size binary, least binary, bytes binary")
    least = cuts.groupBy("shard").applyInArrow(build, ROW + "least binary, times binary")
    replies = shared.unionByName(least, allowMissingColumns=True)
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(remove, schema)
