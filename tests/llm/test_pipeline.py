"""Each stage of the pipeline against a brute-force version, and the whole."""

import functools
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402

from kindred.llm import common, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_bytes long, n_removed string, kept_sha256 string, toxicity string, text_hash string, node long, other0 string"
RNG = random.Random(11)
WORDS = [f"word{i}" for i in range(300)] + ["Ünï", "漢字"]
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@functools.cache
def rows():
    base, long = text(100), text(20_000)
    near = base.replace(base.split()[50], "changed")
    half = " ".join(base.split()[:50]) + " " + text(50)
    texts = [base, base, near, half, None, "", " \t ", "one", "two words", long, long + " end", PASSAGE, text(20) + " " + PASSAGE + " " + text(20), "you vile idiot " + text(12), "漢字" * 60, "x" * 4000]
    texts += [text(RNG.randint(1, 150)) for _ in range(25)] + ["you vile idiot " + text(RNG.randint(3, 30)) for _ in range(15)]
    out = [(i, t) for i, t in enumerate(texts)] + [(0, base), (3, text(30)), (None, base), (None, None), (None, PASSAGE)]
    return [(i, t, "en", f"s{k % 3}", len(t or ""), k, "r", "k", "t", "h", 1, "o") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    labels = [(r[0], int("idiot" in (r[1] or ""))) for r in rows() if r[0] is not None] + [(None, 1), (999, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path)


def as_rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_columns_stay(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()


def test_toxicity_stage(spark, docs, sf_dir):
    got = as_rows(corpus_pipeline.toxicity_stage(spark, docs, sf_dir))
    machine = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    scores = machine.scores(pa.array([r[1] for r in rows()], pa.large_string()))
    assert got == sorted(str(r) for r, s in zip(rows(), scores, strict=True) if s < 0.5)
    assert not any("idiot" in r for r in got) and len(got) > 40


def test_machine_against_the_pair_sum(spark, docs, sf_dir):
    machine = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    doc, cell = toxicity.term_cells(pa.array([r[1] for r in rows()]))
    z = machine.margins(doc, cell, len(rows()))
    for i in range(len(rows())):
        at = [a for a in machine.slot[cell[doc == i]] if a]
        want = machine.bias + sum(machine.w[a] for a in at) + sum(float(machine.v[a] @ machine.v[b]) for k, a in enumerate(at) for b in at[k + 1 :])
        assert abs(want - z[i]) < 1e-6 * (1 + abs(want))
    assert np.abs(machine.v[1:]).sum() > 0


def shingles(t):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\t", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup_stage(spark, docs, sf_dir):
    have = rows()
    known = [r for r in have if r[0] is not None]
    sets = [shingles(r[1]) for r in known]
    root = list(range(len(known)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, r in enumerate(known):
        groups.setdefault(find(i), []).append(r)
    got = corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()
    kept = [tuple(r) for r in got if r["doc_id"] is not None]
    assert all(k in known for k in kept) and len(kept) == len(groups)
    for g in groups.values():
        mine = [k for k in kept if k in g]
        assert len(mine) == 1 and mine[0][0] == min(r[0] for r in g)
    assert sorted(str(tuple(r)) for r in got if r["doc_id"] is None) == sorted(str(r) for r in have if r[0] is None)


def test_suffix_dedup_stage(spark, docs, sf_dir):
    have = [(r, (r[1] or "").encode()) for r in rows()]
    first = {}
    for r, t in have:
        if r[0] is not None:
            for p in range(len(t) - 49):
                s = t[p : p + 50]
                first[s] = min(first.get(s, r[0]), r[0])
    want = []
    for r, t in have:
        gone = bytearray(len(t))
        if r[0] is not None:
            for p in range(len(t) - 49):
                if first[t[p : p + 50]] < r[0]:
                    gone[p : p + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
        want.append(str((r[0], left, *r[2:4], len(left), *r[5:])))
    assert as_rows(corpus_pipeline.suffix_dedup_stage(spark, docs, sf_dir)) == sorted(want)


def test_packing_stage(spark, docs, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(str((r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1)) for r in rows())
    pieces = corpus_pipeline.packing_stage(spark, docs, sf_dir).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == [sum(q["length"] for q in ps[:k]) for k in range(len(ps))] and sum(p["length"] for p in ps) <= 2048
    assert sorted(str((p["doc_id"], p["doc_tokens"])) for p in pieces if p["start"] == 0) == want
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_empty_tables(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_run(spark, docs, sf_dir):
    """The stages one after the other; folders that are no longer read are deleted."""
    before = common.written()
    got = as_rows(corpus_pipeline.run(spark, sf_dir))
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, sf_dir).collect(), SCHEMA)
    assert got == as_rows(corpus_pipeline.packing_stage(spark, step, sf_dir)) and got
    assert common.written() >= before + 1


def test_dropped_folders(spark):
    mark = common.written()
    a = common.materialize(spark.range(5), "a")
    b = common.materialize(a.where("id > 1"), "b")
    common.drop_written(spark, mark, keep=1)
    assert common.written() == mark + 1 and b.count() == 3 and not any(Path(f.removeprefix("file:")).exists() for f in a.inputFiles())
    assert b.agg(F.sum("id")).first()[0] == 9
