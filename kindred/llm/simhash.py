"""SimHash near-duplicates by a binary trie self-join.

A fingerprint bit is set if more than half of the hashes of a text's word shingles have it.  Equal fingerprints
are merged first (the smallest document id stands for them).  The distinct ones form a binary trie; node pairs
are walked down together from the root, each step adds the differing bit to the pair's errors, and a pair beyond
the budget is dropped with all that lies below it.  Pairs of few leaves are finished by counting bits.

The trie is dealt out by its top levels: the task of prefix p has the subtree of p and those of the prefixes
above p within the budget, and starts from these pairs with the bits they already differ in.  Pairs that are
already connected are not looked at again, and a task returns one link a leaf, so that a dense group never
becomes all its pairs; components are then found by ``components``.

``slices`` > 1 walks a trie for each slice of a longer fingerprint and accepts a pair by the distance of the
whole: with 8 slices of 32 bits two texts at a whole distance of 15 % still share a slice within 3 bits
almost surely.  ``near_limit`` gives that distance for a wanted shingle similarity.

Defined cases: null text is empty; a text without words has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; rows with a null id have a fingerprint and no component; repeated
rows share theirs; empty tables give empty results.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, buffers, lowered, materialize, mix, pieces, spans, tidy
from .components import components

LEAVES = 20_000
CHUNK = 1_000_000


# Fingerprints -----------------------------------------------------------------------------------------------


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int):
    """XXH64 (seed 42) of each document's word shingles and the number of them by document."""
    n_docs = len(offsets) - 1
    low = lowered(data)
    s, e, d = spans(low, offsets)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    size = e - s
    start = np.cumsum(size + 1) - size - 1
    text = np.full(int(start[-1] + size[-1]), 0x20, np.uint8)
    total = int(size.sum())
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    text[within + np.repeat(start, size)] = low[within + np.repeat(s, size)]
    n_words = np.bincount(d, minlength=n_docs)
    first = np.cumsum(n_words) - n_words
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    last = np.minimum(at + words - 1, np.repeat(first + n_words - 1, n))
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(raw[a:b], 42) for a, b in zip(start[at].tolist(), (start[last] + size[last]).tolist(), strict=True)], np.uint64), n


def fingerprints(texts, words: int, lanes: int = 1) -> np.ndarray:
    """64 * lanes fingerprint bits of each text, as an array (texts x lanes) of uint64."""
    data, offsets = buffers(texts)
    out = np.zeros((len(offsets) - 1, lanes), np.uint64)
    for i, j in pieces(offsets, 1 << 19):
        h, n = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        head = (np.cumsum(n) - n)[full]
        for lane in range(lanes):
            x = h if lane == 0 else mix(h + U(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            votes = _votes(x, head, n[full])
            bits = (2 * votes > n[full][:, None]).astype(np.uint8)
            out[i + full, lane] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def _votes(hashes: np.ndarray, head: np.ndarray, n: np.ndarray, step: int = 100_000) -> np.ndarray:
    """How many of each document's hashes have each of the 64 bits, most significant first."""
    out = np.zeros((len(head), 64), np.int64)
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(raw), step):
        b = min(a + step, len(raw))
        i, j = np.searchsorted(head, a, "right") - 1, np.searchsorted(head, b, "left")
        cut = np.maximum(head[i:j], a) - a
        out[i:j] += np.add.reduceat(np.unpackbits(raw[a:b], axis=1), cut, axis=0, dtype=np.int32)
    return out


def near_limit(similarity: float, bits: int, spare: float = 1.5) -> int:
    """Bits in which fingerprints of texts with this Jaccard similarity of shingles differ, and spare standard
    deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + spare * math.sqrt(bits * p * (1 - p)))


# The trie ---------------------------------------------------------------------------------------------------


class Trie:
    """Binary trie over sorted keys; a node of depth d is the range of keys that share their first d bits."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.bits, self.levels = keys, bits, {}

    def level(self, d: int):
        """(prefix, first key, end) of the nodes of depth d."""
        if d not in self.levels:
            p = self.keys >> U(self.bits - d) if d else np.zeros_like(self.keys)
            lo = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)
            self.levels = {k: v for k, v in self.levels.items() if abs(k - d) < 40}
            self.levels[d] = (p[lo], lo, np.concatenate((lo[1:], [len(p)])).astype(np.int64))
        return self.levels[d]

    def children(self, d: int):
        prefix, _, _ = self.level(d)
        below, _, _ = self.level(d + 1)
        out = []
        for bit in (0, 1):
            want = (prefix << U(1)) | U(bit)
            at = np.searchsorted(below, want)
            out.append(np.where(below[np.minimum(at, len(below) - 1)] == want, at, -1))
        return out


def join(trie: Trie, depth: int, a: np.ndarray, b: np.ndarray, errors: np.ndarray, budget: int, accept) -> None:
    """Walk node pairs of a depth down; ``accept(i, j)`` gets positions of keys within the budget (i != j).
    A pair of a node with itself stands for the pairs inside it."""
    stack = [(depth, a, b, errors)]
    kids: dict[int, list] = {}
    while stack:
        d, a, b, e = stack.pop()
        if len(a) > CHUNK:
            for i in range(0, len(a), CHUNK):
                stack.append((d, a[i : i + CHUNK], b[i : i + CHUNK], e[i : i + CHUNK]))
            continue
        _, lo, hi = trie.level(d)
        na, nb = hi[a] - lo[a], hi[b] - lo[b]
        done = (na * nb <= 4) | (d == trie.bits)
        if done.any():
            _finish(trie, lo[a[done]], na[done], lo[b[done]], nb[done], budget, accept)
            a, b, e = a[~done], b[~done], e[~done]
        if not len(a):
            continue
        if d not in kids:
            kids[d] = trie.children(d)
        c0, c1 = kids[d]
        twin = a == b
        x, y, z = a[~twin], b[~twin], e[~twin]
        s, f = a[twin], e[twin]
        na = np.concatenate((c0[s], c1[s], c0[s], c0[x], c1[x], c0[x], c1[x]))
        nb = np.concatenate((c0[s], c1[s], c1[s], c0[y], c1[y], c1[y], c0[y]))
        ne = np.concatenate((f, f, f + 1, z, z, z + 1, z + 1))
        keep = (na >= 0) & (nb >= 0) & (ne <= budget)
        stack.append((d + 1, na[keep], nb[keep], ne[keep]))


def _finish(trie: Trie, la, na, lb, nb, budget: int, accept) -> None:
    size = na * nb
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at] - size[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        if to == at + 1 and size[at] > 4 * CHUNK:  # one pair of large leaves: by rows
            rows = np.arange(na[at])
            for r in range(0, len(rows), max(1, int(CHUNK // nb[at]))):
                i = np.repeat(la[at] + rows[r : r + max(1, int(CHUNK // nb[at]))], nb[at])
                _count(trie, i, np.tile(np.arange(lb[at], lb[at] + nb[at]), len(i) // int(nb[at])), budget, accept)
        else:
            n = size[at:to]
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(nb[at:to], n)
            _count(trie, np.repeat(la[at:to], n) + k // width, np.repeat(lb[at:to], n) + k % width, budget, accept)
        at = to


def _count(trie: Trie, i, j, budget: int, accept) -> None:
    # A node paired with itself meets each of its pairs twice and every key once with itself.
    ok = np.bitwise_count(trie.keys[i] ^ trie.keys[j]) <= budget
    i, j = i[ok], j[ok]
    if len(i):
        accept(i[i != j], j[i != j])


class Union:
    """Components of positions 0..n-1 under links given in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                return
            parent = np.arange(len(self.root))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.root = parent[self.root]


def star(node: np.ndarray, root: np.ndarray) -> pa.Table:
    """Links (a, b) of each position to the smallest node of its component.  Tasks that see one group name one node for
    it, so their links are equal rows and a dense group doesn't come with a link a node from every task."""
    least = node.copy()
    np.minimum.at(least, root, node)
    b = least[root]
    linked = np.flatnonzero(b != node)
    return pa.table([pa.array(node[linked], pa.int64()), pa.array(b[linked], pa.int64())], names=["a", "b"])


def link_keys(keys: np.ndarray, prints: np.ndarray | None, bits: int, top: int, prefix: int, budget: int, limit: int | None) -> np.ndarray:
    """Root of each position (keys sorted): those of the subtree of ``prefix`` against it and the subtrees above."""
    trie, union = Trie(keys, bits), Union(len(keys))
    nodes, _, _ = trie.level(top)
    mine = np.flatnonzero(nodes == U(prefix))
    if len(mine):
        above = np.flatnonzero(nodes >= U(prefix))
        err = np.bitwise_count(nodes[above] ^ U(prefix)).astype(np.int8)

        def accept(i, j):
            if prints is not None:
                open_ = union.root[i] != union.root[j]
                i, j = i[open_], j[open_]
                for x in range(0, len(i), 200_000):
                    p, q = i[x : x + 200_000], j[x : x + 200_000]
                    good = np.bitwise_count(prints[p] ^ prints[q]).sum(1, dtype=np.int64) <= limit
                    union.add(p[good], q[good])
                return
            union.add(i, j)

        join(trie, top, np.repeat(mine, len(above)), above, err, budget, accept)
    return union.root


def trie_links(classes: DataFrame, lanes: int, slices: int, budget: int, limit: int | None, count: int) -> DataFrame:
    """Links (a, b) that connect the fingerprints (node long, fp binary) of ``classes``; one a leaf and task."""
    bits = 64 * lanes // slices
    top = min(16, max(4, math.ceil(math.log2(max(1, count / LEAVES)))), bits)
    n_top = 1 << top
    flips = np.array(sorted(sum(1 << i for i in c) for k in range(min(budget, top) + 1) for c in itertools.combinations(range(top), k)), np.int64)

    def route(batches):
        held, size = [], 0

        def emit():
            node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            for t in range(slices):
                w = fp.view(">u8").reshape(-1, lanes) if slices == 1 else fp.view(f">u{bits // 8}").reshape(-1, slices)
                key = w[:, t].astype(np.uint64)
                head = (key >> U(bits - top)).astype(np.int64)
                order = np.argsort(head, kind="stable")
                edge = np.searchsorted(head[order], np.arange(n_top + 1))
                rows = [[], [], []]
                for b in range(n_top):
                    part = order[edge[b] : edge[b + 1]]
                    if len(part):
                        near = b ^ flips  # the tasks that need subtree b
                        for a in near[near <= b]:
                            for r, v in zip(rows, (t * n_top + int(a), node[part].tobytes(), fp[part].tobytes()), strict=True):
                                r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["task", "nodes", "prints"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, 8 * lanes)))
                size += b.num_rows
            if size >= 200_000:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    @tidy
    def solve(t: pa.Table) -> pa.Table:
        task = t.column("task")[0].as_py()
        node = np.frombuffer(b"".join(t.column("nodes").to_pylist()), np.int64)
        raw = np.frombuffer(b"".join(t.column("prints").to_pylist()), np.uint8).reshape(-1, 8 * lanes)
        lane = np.ascontiguousarray(raw).view(">u8").reshape(-1, lanes).astype(np.uint64)
        key = lane[:, 0] if slices == 1 else np.ascontiguousarray(raw).view(f">u{bits // 8}").reshape(-1, slices)[:, task // n_top].astype(np.uint64)
        order = np.lexsort((node, key))
        root = link_keys(key[order], lane[order] if limit is not None else None, bits, top, task % n_top, budget, limit)
        return star(node[order], root)

    sent = classes.select("node", "fp").where("node is not null").mapInArrow(route, "task int, nodes binary, prints binary")
    return sent.groupBy("task").applyInArrow(solve, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, lanes: int = 1, slices: int = 1, budget: int = 3, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (binary, 8 * lanes bytes), component_id of each row of docs."""

    def run(batches):
        for b in batches:
            f = fingerprints(b.column(1), words, lanes).astype(">u8")
            raw = f.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i : i + 8 * lanes] for i in range(0, len(raw), 8 * lanes)], pa.binary())], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(src.mapInArrow(run, "doc_id long, fp binary"), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = components(trie_links(classes, lanes, slices, budget, limit, classes.count()))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
