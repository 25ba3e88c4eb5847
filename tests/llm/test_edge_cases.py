"""Nulls, very long values, ties, repeated rows and huge numbers, where the other tests have none."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from kindred.llm import common, knn_join, lm_scoring, suffix_dedup, toxicity, url_filter

RNG = random.Random(21)


def test_knn_null_ids_and_huge_components(spark):
    rows = [(i, [RNG.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(None, [0.5] * 4), (100, [1e30, 0.0, 0.0, 0.0]), (101, [-1e30, 1.0, 2.0, 3.0]), (120, [1e17, 1e17, 0.0, 0.0]), (121, None), (122, [1.0, None, 0.0, 0.0]), (123, [float("nan")] * 4), (124, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn_join.top_k(knn_join.integer_vectors(df), 5).collect()
    low, high = -(1 << 63), (1 << 63) - 1
    whole = lambda x: min(high, max(low, int(np.floor(64 * x))))
    known = {i: [whole(x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in known if i % 20 == 0):
        scores = [(min(knn_join.TOP, max(-knn_join.TOP, sum(a * b for a, b in zip(known[q], v, strict=True)))), i) for i, v in known.items() if i != q]
        for rank, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:5], 1):
            want.add((q, rank, i, s))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_url_accuracy_and_long_urls(spark):
    """Urls of the undecided domain look like the blocked or like the allowed ones; the trees tell them apart."""
    word = lambda: "".join(RNG.choice("abcdefghij") for _ in range(6))
    bad = lambda d: f"http://{word()}{RNG.randint(100, 999)}.{d}/{RNG.randint(10**6, 10**7)}?a={RNG.randint(1, 99)}&b={RNG.randint(1, 99)}"
    good = lambda d: f"http://{word()}.{d}/fr/{word()}/{word()}"
    urls = [(bad("net"), None) for _ in range(300)] + [(good("org"), None) for _ in range(300)] + [(bad("com"), "block") for _ in range(100)] + [(good("com"), "allow") for _ in range(100)]
    urls += [("http://x.com/" + "a1" * 60_000, None), (None, None), ("http://x.net/" + "a" * 60_000, "block"), urls[0]]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, [("block", "net/"), ("allow", "org/fr/")]).collect()}
    assert len(got) == len(urls)
    told = [got[i] == v for i, (_, v) in enumerate(urls) if v]
    assert np.mean(told) >= 0.95 and got[len(urls) - 1] == got[0] == "block"


def test_toxicity_rows(spark):
    """Repeated rows and equal texts have one score; a very long text and a null one have one, too."""
    rows = [(i, "vile idiot you" if i % 3 == 0 else "kind words here", int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, "vile idiot " + "word " * 100_000), (1001, None), (0, rows[0][1]), (None, "vile idiot you")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 0), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    scored = toxicity.score_ids(docs, machine).collect()
    by_text = {t: {s["score"] for s, (_, x) in zip(sorted(scored, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), [(None, "vile idiot you"), (0, rows[0][1]), *[(r[0], r[1]) for r in rows], (1000, "long"), (1001, None)], strict=True) if x == t} for t in ("vile idiot you", "kind words here", "long", None)}
    assert all(len(v) == 1 for v in by_text.values()) and by_text["vile idiot you"].pop() > 0.5 > by_text["kind words here"].pop() and by_text["long"].pop() > 0.5


@pytest.mark.parametrize("op", [lm_scoring.score, suffix_dedup.repeated])
def test_texts_of_one_id_span_blocks(spark, op):
    df = spark.createDataFrame([(None if i % 2 else 7, f"text {i} " + "same words again and again " * 4) for i in range(200)], "doc_id long, text string")
    placed = common.with_block(df, 64).select("doc_id", "block").distinct().groupBy("doc_id").count().collect()
    assert all(r["count"] > 32 for r in placed)
    assert op(df).count() == 200


def test_shared_folder_is_needed_on_a_cluster():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(RuntimeError):
        common.shared_dir(spark)
