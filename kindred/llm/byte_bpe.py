"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: one displacement per bucket of about
four entries, one slot per entry, no empty slot) resolves whole pre-tokens that are entries themselves.  Tier
two: any other pre-token is merged by a heap of candidate pairs over a doubly linked list of its bytes, in
O(n log n) for a pre-token of n bytes.

Defined cases: null text is empty; an empty text has no ids; repeated rows are encoded each; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, span_hashes

_STEP = 0x9E3779B97F4A7C15
MEMO_ENTRIES = 600_000
_CACHE: dict = {}


def hashes_of(items: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    ends = np.cumsum(sizes)
    return span_hashes(np.frombuffer(b"".join(items), np.uint8), ends - sizes, ends)


class MinimalPerfectHash:
    """Maps each of n distinct keys to its own slot in 0..n-1; ``find`` tells a key from a stranger by its bytes."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = hashes_of(keys)
        bucket = (h % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate(([0], np.cumsum(sizes)))
        taken = np.zeros(n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        slots = np.empty(n, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        tries = np.arange(256, dtype=np.uint64)
        for b in by_size[: int((sizes > 1).sum())]:
            mine = order[first[b] : first[b + 1]]
            base = 0
            while True:
                at = self._slot(h[mine][None, :], (tries + U(base))[:, None])
                free = ~taken[at].any(axis=1)
                if len(mine) > 1 and free.any():
                    s = np.sort(at, axis=1)
                    free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if free.any():
                    d = int(np.flatnonzero(free)[0])
                    self.shift[b] = base + d
                    slots[mine] = at[d]
                    taken[at[d]] = True
                    break
                base += 256
        rest = np.flatnonzero(~taken)  # buckets of one key take what is left, stored as -1 - slot
        alone = by_size[int((sizes > 1).sum()) : int((sizes > 0).sum())]
        self.shift[alone] = -1 - rest[: len(alone)]
        slots[order[first[alone]]] = rest[: len(alone)]
        self.entry = np.empty(n, np.int64)
        self.entry[slots] = np.arange(n)
        self.keys = keys

    def _slot(self, h, d):
        return (mix(h + (d + U(1)) * U(_STEP)) % U(self.n)).astype(np.int64)

    def find(self, items: list[bytes]) -> np.ndarray:
        """Index of each item among the keys, -1 for strangers."""
        if not items:
            return np.zeros(0, np.int64)
        h = hashes_of(items)
        d = self.shift[(h % U(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0).astype(np.uint64)))
        got = self.entry[slot]
        keys = self.keys
        return np.fromiter((e if keys[e] == x else -1 for e, x in zip(got.tolist(), items, strict=True)), np.int64, len(items))


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank merges first, the leftmost of equal ones."""
    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i] if part[i] is not None else -1
        if j < 0 or len(part[i]) + len(part[j]) != size:
            continue
        part[i] += part[j]
        part[j] = None
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
        if (p := left[i]) >= 0 and (r := ranks.get(part[p] + part[i])) is not None:
            heapq.heappush(heap, (r, p, len(part[p]) + len(part[i])))
    return [ranks[x] for x in part if x is not None]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.first = MinimalPerfectHash(list(self.ranks))
        self.ids = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.vocab[v] = k
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Resolve pre-tokens that aren't held yet; what is held is bounded by MEMO_ENTRIES and a batch."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        new = [p for p in pieces if p not in self.memo]
        raw = [p.encode() for p in new]
        for p, x, e in zip(new, raw, self.first.find(raw).tolist(), strict=True):
            ids = [int(self.ids[e])] if e >= 0 else heap_merge(x, self.ranks)
            self.memo[p] = np.array(ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit words."""
        cut = [self.split(t) for t in texts]
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        self.learn(set().union(*cut) if cut else ())
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CACHE:
        _CACHE[path, pattern] = Codec(path, pattern)
    return _CACHE[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded as binary if with_ids) of each row."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), ["" if t is None else t for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_bytes):
                    size += len(texts[end])
                    end += 1
                ids = c.encode_batch(texts[at:end])
                back = [c.decode(x) for x in ids]
                sha = [pa.array([hashlib.sha256(x).hexdigest() for x in y], pa.string()) for y in (ids, back)]
                cols = [keys.slice(at, end - at), pa.array([len(x) // 4 for x in ids], pa.int64()), *sha]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
                at = end

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
