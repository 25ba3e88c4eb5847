"""Packing along a space-filling curve.

A document's token ids are hashed into a vector of DIMS components (each the sum of pseudo-random values of its
ids, over the root of their number); each component is put on a grid by the normal distribution function, and the
cell's Hilbert index is the document's key.  Documents are range-sorted by key, so neighbours on the curve share
sequences.  Every range packs its documents one behind the other into sequences of ``size`` ids and cuts its last
sequence into powers of two, which need no padding: nothing is padded at all.

The bounds of the ranges come from a sample that grows with their number (PER_RANGE documents a range, SAMPLE at
least; 24 bytes each come to the driver); they balance the tasks and decide nothing else.  Equal keys (copies) are
dealt by a hash of the id, so a large group of copies spans many ranges.

Defined cases: null text is empty and gives its end id alone; repeated rows are packed each; an empty table gives
no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, binary_column, buffers, gather, mix, tidy
from .word_bpe import WordEncoder

DIMS, BITS = 4, 10
SAMPLE, PER_RANGE = 4000, 20
RANGE_BYTES = 32_000_000
BATCH_IDS = 1 << 22
_CACHE: dict = {}


def encoder(path: str) -> tuple[WordEncoder, np.ndarray]:
    """The tokenizer of a Python worker and the axes of its ids: DIMS values of variance 1 for each."""
    if path not in _CACHE:
        enc = WordEncoder(path)
        grid = mix(np.arange(enc.size_of_vocabulary * DIMS, dtype=np.uint64) + U(1))
        _CACHE[path] = enc, np.ascontiguousarray((((grid >> U(11)).astype(np.float64) / 2**53 - 0.5) * np.sqrt(12)).reshape(-1, DIMS).T)
    return _CACHE[path]


def hilbert_index(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n x dims): Gray-code untangling of the axes from the top bit down."""
    x = x.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(flat: np.ndarray, offsets: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents with the ids flat[offsets[i]:offsets[i + 1]]."""
    n = np.diff(offsets)
    v = np.zeros((len(n), len(axes)))
    full = np.flatnonzero(n)
    if len(full):
        for d, axis in enumerate(axes):
            v[full, d] = np.add.reduceat(axis[flat], offsets[:-1][full]) / np.sqrt(n[full])
    cell = (1 / (1 + np.exp(-1.702 * v / 2)) * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
    return hilbert_index(cell)


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document with the id of its end behind it."""
    ends = offsets + np.arange(len(offsets))
    out = np.full(int(ends[-1]), end_id, flat.dtype)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = flat
    return out, ends


def tail_sizes(n: int, size: int) -> list[int]:
    """Lengths of the sequences of a range of n ids: full ones, then powers of two."""
    out = [size] * (n // size)
    rest = n % size
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as binary)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col).alias("tie"), F.col(text_col).cast("string").alias("text"))
    total, count = src.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = max(64, -(-(total or 0) // RANGE_BYTES))
    sample = max(SAMPLE, PER_RANGE * ranges)

    def encoded(batches, bounds, bare):
        enc, axes = encoder(path)
        for b in batches:
            if not b.num_rows:
                continue
            flat, offsets = with_end(*enc.encode(b.column(2)), end_id)
            keys = curve_keys(flat, offsets, axes)
            if bare:
                yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(1), pa.array(np.diff(offsets))], ["hkey", "tie", "n"])
                continue
            at = _range_of(bounds, keys, b.column(1).to_numpy(zero_copy_only=False))
            edge = [0]
            while edge[-1] < len(keys):  # an Arrow column of binary holds less than 2 GB
                edge.append(max(edge[-1] + 1, int(np.searchsorted(offsets, offsets[edge[-1]] + BATCH_IDS, "right")) - 1))
            for x, y in zip(edge, edge[1:]):
                ids = binary_column(flat[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                yield pa.RecordBatch.from_arrays([pa.array(at[x:y], pa.int32()), pa.array(keys[x:y]), b.column(1).slice(x, y - x), b.column(0).slice(x, y - x), ids], ["range", "hkey", "tie", "doc_id", "ids"])

    keep = max(1, -(-count // sample)) if count else 1
    seen = src.where(F.pmod(F.xxhash64("tie"), F.lit(keep)) == 0)
    seen = seen.mapInArrow(lambda bs: encoded(bs, None, True), "hkey long, tie long, n long")
    known = seen.groupBy("hkey", "tie").agg(F.sum("n").alias("n")).orderBy("tie").limit(2 * sample).toArrow()
    bounds = _bounds(*(known.column(c).to_numpy() for c in ("hkey", "tie", "n")), ranges)
    dealt = src.mapInArrow(lambda bs: encoded(bs, bounds, False), "range int, hkey long, tie long, doc_id long, ids binary")

    @tidy
    def lay(t: pa.Table) -> pa.Table:
        hkey, tie, doc = (t.column(c).to_numpy() for c in ("hkey", "tie", "doc_id"))
        raw, offsets = buffers(t.column("ids"))
        null = np.asarray(t.column("doc_id").is_null())
        doc = np.where(null, -1, doc).astype(np.int64)
        order = np.lexsort((doc, tie, hkey))
        kind = np.dtype(encoder(path)[0].dtype)
        ids, offsets = raw.view(kind), offsets // kind.itemsize
        n = np.diff(offsets)[order]
        ends = np.cumsum(n)
        flat = gather(ids, offsets[:-1][order], n).astype("<u4")
        seq = np.concatenate(([0], np.cumsum(tail_sizes(len(flat), size))))
        cuts = np.union1d(seq, ends)
        at, length = cuts[:-1], np.diff(cuts)
        of, line = np.searchsorted(ends, at, "right"), np.searchsorted(seq, at, "right") - 1
        view = memoryview(flat).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), cuts[1:].tolist(), strict=True)]
        base = t.column("range")[0].as_py() << 32
        cols = [pa.array(doc[order][of], pa.int64(), mask=null[order][of]), at - (ends - n)[of], length, pa.array(crc, pa.int64()), n[of], base + line, at - seq[line]]
        if with_ids:
            cols.append(pa.array([bytes(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), cuts[1:].tolist(), strict=True)], pa.binary()))
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names=names[: len(cols)])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = ", ".join(f"{n} long" for n in names[:7]) + ", ids binary" * with_ids
    return dealt.groupBy("range").applyInArrow(lay, schema)


def _bounds(keys: np.ndarray, tie: np.ndarray, n: np.ndarray, ranges: int) -> np.ndarray:
    """Rows (key, tie) that cut the sampled documents into ranges of equally many ids, in order."""
    if not len(keys):
        return np.zeros((0, 2), np.int64)
    order = np.lexsort((tie, keys))
    share = np.cumsum(n[order])
    at = np.searchsorted(share, share[-1] * np.arange(1, ranges) / ranges)
    return np.unique(np.stack((keys, tie), 1)[order[at]], axis=0)


def _range_of(b: np.ndarray, keys, tie) -> np.ndarray:
    if not len(b):
        return np.zeros(len(keys), np.int64)
    lo, hi = np.searchsorted(b[:, 0], keys, "left"), np.searchsorted(b[:, 0], keys, "right")
    out = lo.copy()
    for i in np.flatnonzero(hi > lo).tolist():  # keys that are bounds themselves: the tie decides
        out[i] += np.searchsorted(b[lo[i] : hi[i], 1], tie[i], "left")
    return out
