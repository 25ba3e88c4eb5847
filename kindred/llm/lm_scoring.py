"""LM scoring by deleted interpolation.

A text's tokens are its words (A-Z lower-cased, cut at ASCII white space) and one end; the end of the text before
is the first word's context.  The probability of word w after word v is

    l2 * c(v, w) / c(v)  +  l1 * c(w) / N  +  l0 / (V + 1)

with weights l that depend on the bucket of c(v) (its binary order of magnitude).  The weights are learned by
expectation-maximisation on counts of a held-out part of the training texts (the fold HELD_FOLD of crc32(id)
modulo 10), for which the estimates are formed without that part; afterwards every training text counts.

Words and word pairs go by 64-bit hashes.  Blocks of documents send their distinct keys with training counts to
shards, which add them up and answer in the order asked, so a common word costs one entry a block.  Held-out
counts are gathered by bucket and by the logarithms of c(v,w)/c(v) and c(w)/N in steps of 1/16 octave: a table of
bounded size, whatever the corpus.

Defined cases: null text is empty; an empty text is its end alone; a row with a null id trains and is scored (its
id counts as an empty text); without training tokens every word has probability 1; repeated rows count each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, binary_column, buffers, decode_table, fold_of, lowered, materialize, mix, n_blocks, pack_blocks, pieces, shard_of, span_hashes, spans, text_bytes, tidy

HELD_FOLD = 1
BUCKETS = 24
STEPS = 16  # per octave
SHARD_BYTES = 8_000_000
END = U(0x8F1BBCDCCA62C1D7)
ROW = "shard int, block int, "


def tokens_of(texts):
    """(hash of each token, of its context, document) with one end a text, and the number of tokens by text."""
    data, offsets = buffers(texts)
    n_docs = len(offsets) - 1
    h, d = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in pieces(offsets):
        low = lowered(data[offsets[i] : offsets[j]])
        s, e, doc = spans(low, offsets[i : j + 1] - offsets[i])
        h.append(span_hashes(low, s, e))
        d.append(doc + i)
    h, d = np.concatenate(h), np.concatenate(d)
    n = np.bincount(d, minlength=n_docs) + 1 if n_docs else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n_docs), n)
    word = np.full(len(doc), END, np.uint64)
    word[np.arange(len(h)) + d] = h
    context = np.concatenate(([END], word[:-1])) if len(word) else word
    return word, context, doc, n


def key_of_words(h: np.ndarray) -> np.ndarray:
    return mix(h) | U(1)


def key_of_pairs(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * U(0x9E3779B97F4A7C15) + (w ^ (w >> U(29))) * U(0xD6E8FEB86659FD93)) & ~U(1)


class Block:
    """Documents of a block in an order of their own; word and pair keys with places into the distinct keys."""

    def __init__(self, t: pa.Table):
        docs = decode_table(t.column("payload"))
        ids = docs.column("doc_id").to_pylist()
        sizes = [len(x) if x is not None else -1 for x in docs.column("text").to_pylist()]
        crc = [zlib.crc32(x) if x else 0 for x in docs.column("text").cast(pa.large_binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, sizes[k], crc[k]))
        docs = docs.take(order)
        self.ids = docs.column("doc_id")
        fold = docs.column("fold").to_numpy()
        word, context, self.doc, self.n = tokens_of(docs.column("text"))
        self.fold = fold[self.doc] if len(fold) else np.zeros(0, np.int64)
        self.doc_fold = fold
        keys = np.concatenate((key_of_words(word), key_of_pairs(context, word), key_of_words(context[:1])))
        self.keys, at = np.unique(keys, return_inverse=True)
        m = len(word)
        self.word, self.pair = at[:m], at[m : 2 * m]
        self.context = np.concatenate((at[2 * m :], self.word[:-1])) if m else self.word

    def counts(self):
        """Training counts of the distinct keys, and those of the held fold."""
        out = []
        for part in (self.fold != 0, self.fold == HELD_FOLD):
            out.append(np.bincount(self.word[part], minlength=len(self.keys)) + np.bincount(self.pair[part], minlength=len(self.keys)))
        return out


def narrow(x: np.ndarray, edge: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Cells of counts in one byte each where they fit, and cells of the larger ones in eight."""
    big = x >= 255
    return binary_column(np.where(big, 255, x).astype(np.uint8), edge), binary_column(x[big].astype("<i8"), np.concatenate(([0], np.cumsum(big)))[edge])


def widen(small, big) -> np.ndarray:
    """The counts of all cells one behind the other."""
    out = buffers(small)[0].astype(np.int64)
    out[out == 255] = buffers(big)[0].view("<i8")
    return out


def ratio_step(a: np.ndarray, b) -> np.ndarray:
    """log2(b / a) in steps, from 1; 0 where a is 0."""
    with np.errstate(divide="ignore"):
        return np.where(a > 0, 1 + np.rint(np.log2(np.maximum(b, 1) / np.maximum(a, 1)) * STEPS), 0).astype(np.int64)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else its order of magnitude."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def learn_weights(table: np.ndarray, counts: np.ndarray, vocabulary: int, rounds: int = 100) -> np.ndarray:
    """Weights (BUCKETS x 3) by expectation-maximisation; table rows: (bucket, step of p2, step of p1)."""
    out = np.tile(np.array([0.6, 0.3, 0.1]), (BUCKETS, 1))
    out[0] = (0.0, 0.75, 0.25)
    p = np.stack([np.where(s > 0, 2.0 ** (-(s - 1) / STEPS), 0.0) for s in (table[:, 1], table[:, 2])] + [np.full(len(table), 1 / (vocabulary + 1))], 1)
    for _ in range(rounds):
        part = out[table[:, 0]] * p
        part *= (counts / np.maximum(part.sum(1), 1e-300))[:, None]
        mass = np.stack([np.bincount(table[:, 0], part[:, k], BUCKETS) for k in range(3)], 1).astype(np.float64)
        mass += np.array([0.0, 0.01, 0.01])  # no bucket is left without a way to unseen words
        seen = np.bincount(table[:, 0], counts, BUCKETS) > 0
        new = mass / mass.sum(1, keepdims=True)
        moved = np.abs(new - out)[seen].max(initial=0)
        out[seen] = new[seen]
        if moved < 1e-7:
            break
    for b in range(1, BUCKETS):  # a bucket without held-out counts takes the weights of the one below
        if not np.bincount(table[:, 0], counts, BUCKETS)[b]:
            out[b] = out[b - 1] if b > 1 else out[b]
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), fold_of(id_col, mod).cast("int").alias("fold"))
    total = text_bytes(src)
    blocks, shards = n_blocks(total), max(64, -(-total // SHARD_BYTES))
    # The held fold has blocks of its own, after the others, so that learning reads these alone.
    held_blocks = -(-blocks // mod)
    h = F.xxhash64("doc_id", "text")  # many texts of one id, or of none, span many blocks
    src = src.withColumn("block", F.when(F.col("fold") == HELD_FOLD, blocks + F.pmod(h, F.lit(held_blocks))).otherwise(F.pmod(h, F.lit(blocks))).cast("int"))
    cols = ["doc_id", "text", "fold"]

    counts = ["train", "train_big", "held", "held_big"]
    answer = ", ".join(f"{c} binary" for c in counts)

    @tidy
    def ask(t: pa.Table) -> pa.Table:
        """One row a shard with keys: there are never more rows than keys, and both sides read them as arrays."""
        b = Block(t)
        train, held = b.counts()
        shard = shard_of(b.keys, shards)
        head = np.flatnonzero(np.diff(shard, prepend=-1))
        edge = np.append(head, len(b.keys))
        block = np.full(len(head), t.column("block")[0].as_py())
        return pa.table([pa.array(shard[head], pa.int32()), pa.array(block, pa.int32()), binary_column(b.keys.astype("<u8"), edge), *narrow(train, edge), *narrow(held, edge)], names=["shard", "block", "keys", *counts])

    @tidy
    def add(t: pa.Table) -> pa.Table:
        raw, at = buffers(t.column("keys"))
        u, of = np.unique(raw.view("<u8"), return_inverse=True)
        sums = [np.bincount(of, widen(t.column(c), t.column(f"{c}_big")), len(u)).astype(np.int64) for c in ("train", "held")]
        is_word = (u & U(1)) == 1
        words = [int((sums[0][is_word] > 0).sum()), int(sums[0][is_word].sum()), int(sums[1][is_word].sum())]
        n = len(t)
        return pa.table([t.column("shard"), t.column("block"), *narrow(sums[0][of], at // 8), *narrow(sums[1][of], at // 8), *(pa.array([v] + [0] * (n - 1), pa.int64()) for v in words)], names=["shard", "block", *counts, "words", "tokens", "held_tokens"])

    packed = pack_blocks(src, cols)
    replies = packed.groupBy("block").applyInArrow(ask, ROW + "keys binary, " + answer).groupBy("shard").applyInArrow(add, ROW + answer + ", words long, tokens long, held_tokens long")
    replies = materialize(replies, "counts")
    vocabulary, tokens, held_tokens = (x or 0 for x in replies.agg(F.sum("words"), F.sum("tokens"), F.sum("held_tokens")).first())
    replies = replies.select("shard", "block", *counts)

    def answered(t: pa.Table):
        """Training and held-out counts of a block's keys, in order of shard and so of key."""
        t = t.sort_by("shard")
        return tuple(widen(t.column(c), t.column(f"{c}_big")) for c in ("train", "held"))

    @tidy
    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table([pa.array([], k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.int64())], names=["bucket", "s2", "s1", "n"])
        b = Block(left)
        train, held = answered(right)
        rest = train - held
        v, w, vw = rest[b.context], rest[b.word], rest[b.pair]
        rows = np.stack((bucket_of(v), ratio_step(vw, v), ratio_step(w, float(max(1, tokens - held_tokens)))), 1)
        u, n = np.unique(rows, axis=0, return_counts=True)
        return pa.table([*(pa.array(u[:, k], pa.int32()) for k in range(3)), pa.array(n, pa.int64())], names=["bucket", "s2", "s1", "n"])

    learn = pack_blocks(src.where(F.col("fold") == HELD_FOLD), cols)
    found = learn.groupBy("block").cogroup(replies.where(F.col("block") >= blocks).groupBy("block")).applyInArrow(tally, "bucket int, s2 int, s1 int, n long")
    found = np.array([tuple(r) for r in found.groupBy("bucket", "s2", "s1").agg(F.sum("n")).collect()], np.int64).reshape(-1, 4)
    weights = learn_weights(found[:, :3], found[:, 3].astype(np.float64), vocabulary)

    @tidy
    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        b = Block(left)
        train, _ = answered(right)
        v, w, vw = train[b.context], train[b.word], train[b.pair]
        lam = weights[bucket_of(v)]
        p = lam[:, 0] * vw / np.maximum(v, 1) + lam[:, 1] * w / max(tokens, 1) + lam[:, 2] / (vocabulary + 1)
        n_docs = len(b.n)
        with np.errstate(divide="ignore"):
            per = np.log10(p) if tokens else np.zeros(len(p))
        base = np.log10((w + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        cols_ = [b.ids, pa.array(b.doc_fold == 0), pa.array(b.n, pa.int64()), pa.array(np.bincount(b.doc, w > 0, n_docs).astype(np.int64)), pa.array(np.full(n_docs, tokens), pa.int64()), pa.array(np.bincount(b.doc, base, n_docs)), pa.array(np.bincount(b.doc, per, n_docs))]
        return pa.table(cols_, names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(judge, schema)
