"""Toxicity by a factorization machine over hashed terms.

score(text) = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct terms i of the text.  The pairwise
part learns combinations (an insult together with a mention of a group) that a linear sum misses.  Terms are
runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased, hashed to 2**BITS cells; cells that tell
nothing about the label (chi-square, or seen in too few texts) have no weight.

The machine is fitted on the driver, on at most SAMPLE labelled rows, taken in the order of a hash of doc_id;
what the driver gets is counts of texts by term cell, then for each row which of the at most CELLS kept cells it has,
never a text.  Scoring covers every row and every whole text.

Defined cases: null text is empty; an empty text gets the score of the bias; a labelled row without a document
is ignored; several labels of one document count as their maximum; no labels at all: every score is 0.0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, fold_of, lowered, pieces, span_hashes, spans

BITS = 18
SAMPLE = 20_000
CELLS = 2048
RANK = 4
ROUNDS = 150

_BREAK = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[_a:_b] = False


def term_cells(texts, bits: int = BITS):
    """For each text its distinct term cells: (document index, cell) arrays sorted by document."""
    data, offsets = buffers(texts)
    out_d, out_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in pieces(offsets):
        part = lowered(data[offsets[i] : offsets[j]])
        s, e, d = spans(part, offsets[i : j + 1] - offsets[i], _BREAK)
        key = np.unique(((d + i) << bits) | (span_hashes(part, s, e) >> np.uint64(64 - bits)).astype(np.int64))
        out_d.append(key >> bits)
        out_c.append(key & ((1 << bits) - 1))
    return np.concatenate(out_d), np.concatenate(out_c)


class FactorizationMachine:
    """Weights by cell: slot[cell] is 0 for cells without weights, else a row of w and v."""

    def __init__(self, slot, bias, w, v):
        self.slot, self.bias, self.w, self.v = slot, bias, w, v

    def margins(self, doc: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
        at = self.slot[cell]
        doc, at = doc[at > 0], at[at > 0]
        z = self.bias + np.bincount(doc, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            z += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return z

    def scores(self, texts) -> np.ndarray:
        d, c = term_cells(texts)
        return 1 / (1 + np.exp(-np.clip(self.margins(d, c, len(texts)), -30, 30)))


def telling_cells(pos: np.ndarray, seen: np.ndarray, n: int, positive: float, cells: int = CELLS) -> np.ndarray:
    """The cells that tell most about the label by chi-square; pos, seen: texts of label 1 and all texts by cell."""
    p, q = (positive + 1) / (n + 2), (pos + 1) / (seen + 2)
    gain = np.where(seen >= max(3, n / 5000), seen * (q - p) ** 2 / (p * (1 - p)), 0)
    keep = np.argsort(-gain, kind="stable")[:cells]
    return keep[gain[keep] > 3.84]


def fit_machine(doc: np.ndarray, cell: np.ndarray, y: np.ndarray, keep: np.ndarray | None = None, bits: int = BITS, cells: int = CELLS, rank: int = RANK, rounds: int = ROUNDS) -> FactorizationMachine | None:
    """Full-batch Adam on the logistic loss with a small ridge; deterministic.  keep: the cells that get weights."""
    n = len(y)
    if not n:
        return None
    p = (y.sum() + 1) / (n + 2)
    if keep is None:
        keep = telling_cells(np.bincount(cell, y[doc], 1 << bits), np.bincount(cell, minlength=1 << bits).astype(float), n, y.sum(), cells)
    slot = np.zeros(1 << bits, np.int32)
    slot[keep] = np.arange(1, len(keep) + 1)
    at = slot[cell]
    doc, at = doc[at > 0], at[at > 0]
    m = len(keep) + 1
    rng = np.random.default_rng(7)
    theta = np.concatenate(([np.log(p / (1 - p))], np.zeros(m), rng.normal(0, 0.02, m * rank)))
    g1, g2 = np.zeros_like(theta), np.zeros_like(theta)
    ridge = np.concatenate(([0.0], np.full(m, 1e-5), np.full(m * rank, 1e-4)))
    for t in range(1, rounds + 1):
        w, v = theta[1 : m + 1], theta[m + 1 :].reshape(m, rank)
        z = theta[0] + np.bincount(doc, w[at], n)
        sums = []
        for f in range(rank):
            x = v[at, f]
            s = np.bincount(doc, x, n)
            sums.append(s)
            z += 0.5 * (s * s - np.bincount(doc, x * x, n))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = [np.array([err.sum()]), np.bincount(at, err[doc], m)]
        gv = np.empty((m, rank))
        for f in range(rank):
            gv[:, f] = np.bincount(at, err[doc] * (sums[f][doc] - v[at, f]), m)
        g = np.concatenate([*grad, gv.ravel()]) + ridge * theta
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g
        theta -= 0.08 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.999**t)) + 1e-9)
    w, v = theta[1 : m + 1].copy(), theta[m + 1 :].reshape(m, rank).copy()
    w[0], v[0] = 0, 0
    return FactorizationMachine(slot, float(theta[0]), w, v)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, held_out_mod: int = 5) -> FactorizationMachine | None:
    """Fit on at most ``sample`` labelled rows whose crc32(id) modulo held_out_mod isn't 0."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(fold_of("doc_id", held_out_mod) != 0).withColumn("k", F.xxhash64("doc_id"))
    # A share of the labels by their hash, so that no task sends many more than are wanted.
    share = -(-(sample + 10 * math.isqrt(sample)) * (1 << 30) // max(1, known.count()))
    known = known.where(F.pmod("k", F.lit(1 << 30)) < min(1 << 30, share)).orderBy("k", "doc_id").limit(sample).select("doc_id", "toxic")

    def sums(batches):
        """Texts of label 1 and all texts, by cell (row -1: texts without regard to cells)."""
        pos, seen = np.zeros((1 << BITS) + 1, np.int64), np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            toxic = b.column(2).to_numpy()
            d, c = term_cells(b.column(1))
            pos[:-1] += np.bincount(c, toxic[d], 1 << BITS).astype(np.int64)
            seen[:-1] += np.bincount(c, minlength=1 << BITS)
            pos[-1], seen[-1] = pos[-1] + int(toxic.sum()), seen[-1] + len(toxic)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(pos[at]), pa.array(seen[at])], ["cell", "pos", "seen"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    got = src.join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    found = got.mapInArrow(sums, "cell long, pos long, seen long").groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("seen").alias("seen")).toArrow()
    pos, seen = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    cell = found.column("cell").to_numpy()
    pos[cell], seen[cell] = found.column("pos").to_numpy(), found.column("seen").to_numpy()
    if not seen[-1]:
        return None
    keep = telling_cells(pos[:-1], seen[:-1], int(seen[-1]), pos[-1])
    slot = np.full(1 << BITS, -1, np.int64)
    slot[keep] = np.arange(len(keep))

    def cells(batches):
        """The kept cells of each text: at most CELLS numbers of two bytes."""
        for b in batches:
            d, c = term_cells(b.column(1))
            d, c = d[slot[c] >= 0], slot[c[slot[c] >= 0]]
            edge = np.searchsorted(d, np.arange(b.num_rows + 1))
            rows = [c[x:y].astype("<u2").tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], ["doc_id", "toxic", "cells"])

    rows = sorted(map(tuple, got.mapInArrow(cells, "doc_id long, toxic int, cells binary").collect()), key=lambda r: (r[0], r[1], bytes(r[2])))
    parts = [keep[np.frombuffer(r[2], "<u2")] for r in rows]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit_machine(doc, np.concatenate(parts).astype(np.int64), np.array([r[1] for r in rows], float), keep)


def score(docs: DataFrame, machine: FactorizationMachine | None, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with the column ``name`` (double), which replaces one of that name; all others stay as they are."""
    from pyspark.sql.functions import pandas_udf

    held = docs.sparkSession.sparkContext.broadcast(machine)

    @pandas_udf("double")
    def judge(texts):
        import pandas as pd

        m = held.value
        return pd.Series(np.zeros(len(texts)) if m is None else m.scores(pa.array(texts, pa.large_string(), from_pandas=True)))

    return docs.withColumn(name, judge(F.col(text_col).cast("string")))


def score_ids(docs: DataFrame, machine: FactorizationMachine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score alone, without moving texts back to the JVM."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = held.value
        for b in batches:
            s = np.zeros(b.num_rows) if m is None else m.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
