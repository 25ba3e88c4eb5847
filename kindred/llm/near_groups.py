"""Near-duplicate groups by the exact Jaccard similarity of word shingles.

Texts of equal shingle sets are one node.  Candidates come from the binary trie self-join of ``simhash``, over slices of
the nodes' SimHash fingerprints, and from minimum hashes, since the tries alone miss pairs.  A node has BANDS keys, each made of ROWS minimum hashes of its set; two
sets of similarity s share a key with chance 1 - (1 - s**ROWS)**BANDS, which at 0.8 leaves out one pair in some
1.7 million, for short and long texts alike.  (The tries of ``simhash`` would need 6 of 32 bits a slice to be as good
as exhaustive, where they prune hardly anything.)  Nodes that share a key are candidates if their sizes allow the
similarity and their SimHash fingerprints differ in at most ``bit_limit`` bits, six standard deviations above the
mean; this only keeps candidate components small.

Each candidate component then goes to one task with the shingle hashes of its texts (of one text a node, and of no
text outside a component), where a search from text to text over an inverted index finds the true groups: two texts
are linked if and only if the shingles they share are at least ``similarity`` of all they have together.

Bounds: a candidate component is held by one task, at 8 bytes a distinct shingle; the pairs under one key are
compared until they are connected, so dissimilar texts under one key cost their square in bit counts.

Defined cases: as in ``simhash``; texts without words are equal to each other and to nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, buffers, decode_table, encode_table, materialize, mix, pieces, tidy
from .components import components
from .simhash import Union, fingerprints, near_limit, shingle_hashes, star, trie_links

#: Slices of the fingerprint that the tries are walked for, and the bits that a slice may differ in.
LANES, SLICES, BUDGET = 4, 8, 3
BANDS, ROWS = 20, 3
KEYS_PER_TASK = 200_000
GROUP_BYTES = 8_000_000
#: Odd factors: the least product with a set's hashes is the minimum of one permutation.
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(texts, words: int):
    """The sorted distinct shingle hashes of each text."""
    data, offsets = buffers(texts)
    for i, j in pieces(offsets):
        h, n = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
        ends = np.cumsum(n)
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            yield np.unique(h[a:b])


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set (sets x BANDS); those of an empty set are zero."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = mix(np.concatenate([sets[i] for i in full]))
    head = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    for band in range(BANDS):
        key = np.full(len(full), band, np.uint64)
        for f in _FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = mix(key + np.minimum.reduceat(flat * f, head) * U(0x9E3779B97F4A7C15))
        out[full, band] = key
    return out


def bit_limit(similarity: float, bits: int) -> int:
    """Bits by which fingerprints of similar texts may differ.  The mean of short texts lies above that of long ones
    (0.1875 of the bits for 4 and 5 shingles at 0.8, not 0.1515), hence the quarter more."""
    p = 1.25 * near_limit(similarity, 1 << 20, 0) / (1 << 20)
    return min(bits, int(bits * p + 6 * (bits * p * (1 - p)) ** 0.5))


def true_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Group number of each set: components of the pairs with at least this Jaccard similarity."""
    n = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(token, np.cumsum(n)[:-1])
    flat = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(token, kind="stable")
    token, flat = token[order], flat[order]
    v = int(token[-1]) + 1 if len(token) else 0
    edge = np.searchsorted(token, np.arange(v + 1))
    group, left, indexed = np.full(len(sets), -1), len(sets), len(sets)
    for first in range(len(sets)):
        if group[first] >= 0:
            continue
        group[first], queue = first, [first]
        left -= 1
        while queue and left:
            if left < indexed // 2:  # the index is kept to texts without a group
                open_ = group[flat] < 0
                token, flat, indexed = token[open_], flat[open_], left
                edge = np.searchsorted(token, np.arange(v + 1))
            at = queue.pop()
            a, b = edge[own[at]], edge[own[at] + 1]
            size = b - a
            meets = flat[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)]
            who, shared = np.unique(meets, return_counts=True)
            near = who[(shared >= similarity * (n[who] + n[at] - shared) - 1e-9) & (group[who] < 0)]
            group[near] = first
            left -= len(near)
            queue += near.tolist()
    return group


def verified(texts: DataFrame, words: int, similarity: float, tasks: int) -> DataFrame:
    """node, root of texts (candidate, node, text): the true groups inside each candidate component."""

    def send(batches):
        held, size = [], 0

        def emit():
            part, candidate, node, raw = zip(*held, strict=True)
            t = pa.table([pa.array(part, pa.int32()), pa.array(candidate, pa.int64()), pa.array(node, pa.int64()), pa.array(raw, pa.binary())], names=["part", "candidate", "node", "raw"]).sort_by("part")
            p = t.column("part").to_numpy()
            edge = [*np.flatnonzero(np.diff(p, prepend=-1)).tolist(), len(p)]
            for a, b in zip(edge, edge[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([int(p[a])], pa.int32()), pa.array([encode_table(t.slice(a, b - a).combine_chunks())], pa.binary())], ["part", "payload"])

        for b in batches:
            for part, candidate, node, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(3), words), strict=True):
                held.append((part, candidate, node, s.tobytes()))
                size += s.nbytes
                if size >= 12_000_000:
                    yield from emit()
                    held, size = [], 0
        if held:
            yield from emit()

    @tidy
    def solve(t: pa.Table) -> pa.Table:
        t = decode_table(t.column("payload"))
        candidate, node = t.column("candidate").to_numpy(), t.column("node").to_numpy()
        raw = t.column("raw").combine_chunks()
        order = np.lexsort((node, candidate))
        order = order[np.concatenate(([True], node[order][1:] != node[order][:-1]))]  # repeated rows
        c = candidate[order]
        edge = [*np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))).tolist(), len(c)]
        root = np.empty(len(order), np.int64)
        for a, b in zip(edge, edge[1:]):
            rows = order[a:b]
            root[a:b] = node[rows[true_groups([np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in rows], similarity)]]
        return pa.table([pa.array(node[order], pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])

    part = F.pmod(F.xxhash64("candidate"), F.lit(tasks)).cast("int").alias("part")
    return texts.select(part, "candidate", "node", "text").mapInArrow(send, "part int, payload binary").groupBy("part").applyInArrow(solve, "node long, root long")


def near_groups(docs: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), component_id (the smallest id of the group), kept (has the smallest id
    and of that the smallest text_hash in the group; null if the id is null) of each row of docs."""

    def run(batches):
        for b in batches:
            f = fingerprints(b.column(2), words, LANES).astype(">u8").tobytes()
            sets = list(shingle_sets(b.column(2), words))
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            w = 8 * LANES
            bands = [k.tobytes() for k in band_keys(sets)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([f[i : i + w] for i in range(0, len(f), w)], pa.binary()), pa.array(bands, pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "text_hash", "node", "fp", "bands", "n"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    prints = materialize(src.mapInArrow(run, "doc_id long, text_hash long, node long, fp binary, bands binary, n long"), "prints")
    classes = materialize(prints.where("doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("n").alias("n")), "classes")
    found = materialize(components(candidate_links(classes, similarity)).join(classes.where("n > 0"), "node").select("node", F.col("component").alias("candidate"), "one.doc_id", "one.text_hash", "n"), "candidates")
    total = found.agg(F.sum("n")).first()[0] or 0
    texts = src.join(found, ["doc_id", "text_hash"]).select("candidate", "node", "text")
    roots = materialize(verified(texts, words, similarity, max(24, -(-8 * total // GROUP_BYTES))), "roots")
    named = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "one")
    least = named.groupBy("root").agg(F.min("one").alias("least"))
    named = named.join(least, "root").select("node", "least")
    has_id = F.col("doc_id").isNotNull()
    kept = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return prints.join(named, "node", "left").select("doc_id", "text_hash", F.when(has_id, F.col("least.doc_id")).alias("component_id"), F.when(has_id, kept).alias("kept"))


def candidate_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of nodes that may be similar: those of the trie self-join over SLICES slices of the fingerprints,
    and those of the minimum hashes, which have the pairs that the tries miss."""
    full = classes.where("n > 0")
    tries = trie_links(full.select("node", "fp"), LANES, SLICES, BUDGET, bit_limit(similarity, 64 * LANES), classes.count())
    return tries.select("a", "b").unionAll(key_links(full, similarity).select("a", "b"))


def key_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of nodes that share a key of minimum hashes: a forest over all such pairs, by task."""
    tasks = max(24, -(-BANDS * classes.count() // KEYS_PER_TASK))
    limit = bit_limit(similarity, 64 * LANES)

    def route(batches):
        held, size = [], 0

        def emit():
            node, n, fp, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            rows, keys = np.repeat(np.arange(len(node)), BANDS), keys.ravel()
            task = (keys % U(tasks)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            edge = np.searchsorted(task[order], np.arange(tasks + 1))
            for t in range(tasks):
                part = order[edge[t] : edge[t + 1]]
                if len(part):
                    of, at = np.unique(rows[part], return_inverse=True)  # a node's fingerprint is sent once a task
                    raw = [x.tobytes() for x in (keys[part], at.astype(np.int32), node[of], n[of], fp[of])]
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], ["task", "keys", "at", "nodes", "n", "prints"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), *(np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (2, 3))))
                size += b.num_rows
            if size >= 50_000:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    @tidy
    def solve(t: pa.Table) -> pa.Table:
        keys, at, node, n, fp = ([np.frombuffer(x, k) for x in t.column(c).to_pylist()] for c, k in (("keys", np.uint64), ("at", np.int32), ("nodes", np.int64), ("n", np.int64), ("prints", np.uint64)))
        base = np.cumsum([0, *(len(x) for x in node[:-1])])
        at = np.concatenate([a.astype(np.int64) + b for a, b in zip(at, base, strict=True)])
        keys, node, n, fp = np.concatenate(keys), np.concatenate(node), np.concatenate(n), np.concatenate(fp).reshape(-1, LANES)
        order = np.lexsort((node[at], keys))
        keys, at = keys[order], at[order]
        union = Union(len(node))
        first, step = np.arange(len(keys)), 0
        while len(first):
            step += 1
            first = first[first + step < len(keys)]
            first = first[keys[first] == keys[first + step]]
            i, j = at[first], at[first + step]
            open_ = union.root[i] != union.root[j]
            i, j = i[open_], j[open_]
            good = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[good], j[good]
            good = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= limit
            union.add(i[good], j[good])
        return star(node, union.root)

    sent = classes.where("n > 0").select("node", "n", "fp", "bands").mapInArrow(route, "task int, keys binary, at binary, nodes binary, n binary, prints binary")
    return sent.groupBy("task").applyInArrow(solve, "a long, b long")
