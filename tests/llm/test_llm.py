"""Each operator against a brute-force version, with nulls, empty and long texts, ties and repeated rows, empty
tables and extra columns with clashing names."""

import functools
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from kindred.llm import byte_bpe, common, components, knn_join, lm_scoring, packing, simhash, suffix_dedup, token_counts, toxicity, url_filter, webp_lossless

SCHEMA = "doc_id long, text string, block int, fold int, n long, component_id long, payload string"
RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(40)] + ["Ünï", "漢字", "the", "THE"]
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def _text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@functools.cache
def cases():
    long = _text(30_000)
    base = _text(80)
    texts = [None, "", " ", "one", "one two", base, base, base + " tail", base.replace("w1", "w2", 1), long, long + " end", _text(5) + PASSAGE + _text(4), PASSAGE, "a\tb\nc\rd\x0be\x0cf\x1cg\x85h\xa0i", "é" * 400, "ab" * 600, "<|endoftext|> x"] + [_text(RNG.randint(1, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, base), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x") for i, t in cases()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(r):
    return str(tuple(r))


def test_hashes_and_spans():
    texts = pa.array(["ab  c", None, "", " x", "yz ab"])
    data, off = common.buffers(texts)
    s, e, d = common.spans(data, off)
    assert [bytes(data[a:b]) for a, b in zip(s, e)] == [b"ab", b"c", b"x", b"yz", b"ab"] and d.tolist() == [0, 0, 3, 4, 4]
    h = common.span_hashes(data, s, e)
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    assert (common.span_hashes(data, s, e, step=1) == h).all()
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 99).astype(np.uint64))
    assert (common.unplanes(common.planes(keys)) == keys).all()


# 1 LM scoring


def _tokens(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return common_split(low) + [None]


def common_split(t):
    out, cur = [], ""
    for c in t:
        if c in " \t\n\x0b\x0c\r":
            out += [cur] if cur else []
            cur = ""
        else:
            cur += c
    return out + ([cur] if cur else [])


def _fold(i, mod):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod


def test_lm_scoring(docs):
    rows = cases()
    uni, pair, held_u, held_p = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        f = _fold(i, 10)
        if f:
            w = _tokens(t)
            uni.update(w)
            pair.update(zip([None, *w], w))
            if f == lm_scoring.HELD_FOLD:
                held_u.update(w)
                held_p.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)
    got = {_key((r["doc_id"], r["n_tokens"])): r for r in lm_scoring.score(docs).collect()}
    total = 0
    for i, t in rows:
        w = _tokens(t)
        r = got[_key((i, len(w)))]
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert r["train_tokens"] == n and r["held_out"] == (_fold(i, 10) == 0)
        assert r["n_known"] == sum(uni[x] > 0 for x in w) and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0 and math.isfinite(r["score"])
        total += r["score"]
    events = Counter()
    for (a, b), c in held_p.items():
        va, vb, vab = uni[a] - held_u[a], uni[b] - held_u[b], pair[a, b] - held_p[a, b]
        step = lambda x, y: int(np.asarray(lm_scoring.ratio_step(np.array([x]), y))[0])
        events[int(lm_scoring.bucket_of(np.array([va]))[0]), step(vab, va), step(vb, n - sum(held_u.values()))] += c
    lam = lm_scoring.learn_weights(np.array(list(events)).reshape(-1, 3), np.array(list(events.values()), float), v)
    assert np.allclose(lam.sum(1), 1)
    expect = 0
    for _, t in rows:
        w = _tokens(t)
        for a, b in zip([None, *w], w):
            x = lam[int(lm_scoring.bucket_of(np.array([uni[a]]))[0])]
            expect += math.log10(x[0] * pair[a, b] / max(uni[a], 1) + x[1] * uni[b] / n + x[2] / (v + 1))
    assert total == pytest.approx(expect, rel=1e-9)


def test_lm_probabilities_sum_to_one():
    lam = lm_scoring.learn_weights(np.array([[3, 1, 81], [3, 0, 81], [0, 0, 64]]), np.array([5.0, 3, 2]), 100)
    assert np.allclose(lam.sum(1), 1) and (lam[:, 2] > 0).all() and lam[3, 0] > 0.4


def test_lm_empty(none):
    assert lm_scoring.score(none).collect() == []


# 2 suffix dedup


def _brute_repeats(rows, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        if i is not None:
            for p in range(len(t) - length + 1):
                s = t[p : p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in data:
        g = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - length + 1):
                if first[t[p : p + length]] < i:
                    g[p : p + length] = b"\1" * length
        kept = bytes(c for c, z in zip(t, g) if not z)
        out.append((i, len(t), sum(g), sum(1 for p in range(len(t)) if g[p] and (not p or not g[p - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def test_suffix_dedup(docs):
    got = suffix_dedup.repeated(docs)
    assert sorted(str(tuple(r)) for r in got.collect()) == _brute_repeats(cases())
    full = suffix_dedup.repeated(docs, with_bytes=True, with_text=True, carry=["fold", "payload"]).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["fold"] == 2 and r["payload"] == "x" for r in full)
    assert "kept" not in got.columns


def test_suffix_dedup_empty(none):
    assert suffix_dedup.repeated(none).collect() == []


def test_sorted_suffixes(monkeypatch):
    for limit in (1, 1 << 20):  # in files, then in memory
        monkeypatch.setattr(suffix_dedup, "FILE_BYTES", limit)
        for t in range(15):
            strs = [bytes(RNG.choice(b"ab" if t % 2 else b"abc\xff\x00") for _ in range(RNG.randint(0, 30))) for _ in range(RNG.randint(1, 9))]
            flat, sizes = np.frombuffer(b"".join(strs) or b"x", np.uint8), np.array([len(s) for s in strs])
            string, start, lcp = suffix_dedup.sorted_suffixes(flat, np.cumsum(sizes), sizes)
            suffixes = [strs[a][b:] for a, b in zip(string, start)]
            assert suffixes == sorted(suffixes) and len(suffixes) == sizes.sum() + len(strs)
            for i in range(1, len(suffixes)):
                x, y = suffixes[i - 1 : i + 1]
                assert lcp[i] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("batch", [2, 1024])
def test_least_ids(monkeypatch, batch):
    """Keys with more segments than a batch are cut again, and lose nothing."""
    monkeypatch.setattr(suffix_dedup, "BATCH_SEGMENTS", batch)
    core = b"a common string of some length, "
    segs = [bytes(RNG.choice(b"xy") for _ in range(RNG.randint(10, 20))) + core + bytes(RNG.choice(b"pq") for _ in range(RNG.randint(10, 20))) for _ in range(60)]
    segs += segs[:10]
    ids = np.array([RNG.randint(0, 50) for _ in segs])
    size = np.array([len(x) for x in segs])
    data = np.frombuffer(b"".join(segs), np.uint8)
    pos = np.cumsum(size) - size
    values, base, n = suffix_dedup.least_ids(data, pos, size, ids, np.ones(len(segs), np.uint64), 40)
    least = {}
    for x, i in zip(segs, ids.tolist()):
        for p in range(len(x) - 39):
            least[x[p : p + 40]] = min(least.get(x[p : p + 40], 99), i)
    for k, x in enumerate(segs):
        assert values[base[k] : base[k] + n[k]].tolist() == [least[x[p : p + 40]] for p in range(len(x) - 39)]


# 3 url filter

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?x=1&y=2", "http://example.net/de/", "https://x.example.com/de/9#f", "https://b.org/fr/1", "http://badnet/x", "http://n.net", "http://net/x", "x://h?a://b/c", "http://e.org#/fr/", "http://u:p@h.example.org:80/fr/a/b"]
    urls += [f"http://{a}.example.{t}/{p}/{k}" for k in range(30) for a in ("shop", "www") for t in ("com", "net", "org") for p in ("de", "en", "fr")]
    df = spark.createDataFrame([(i, u, "h", "v", 1) for i, u in enumerate(urls)] + [(3, urls[3], "h", "v", 1)], "page_id long, url string, host string, verdict string, u int")
    rows = url_filter.judge(df, RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        u = urls[r["page_id"]] or ""
        host = path = ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
            host, tail = rest[:cut].lower(), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
        fits = [(len(t), t, v) for v, t in RULES for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "block" if r["score"] >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0), RULES).collect() == []
    assert {r["verdict"] for r in url_filter.judge(df.where("page_id < 3"), RULES).collect()} == {"allow"}


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 7))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    bias, trees = url_filter.fit_trees(x, y)

    def value(t, r):
        return t if not isinstance(t, tuple) else value(t[2] if r[t[0]] <= t[1] else t[3], r)

    z = np.array([bias + sum(value(t, r) for t in trees) for r in x])
    assert ((z > 0) == (y > 0)).mean() > 0.95


# 4 toxicity


def test_toxicity_pairs(spark):
    """Insult and group mention are harmless alone, and toxic together; an additive model can't tell."""
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"x{rng.randint(0, 500)}" for _ in range(20)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words).title(), int(a and b), 0.0))
    rows += [(3000, None, 0, 0.0), (3001, "", 0, 0.0), (3002, "insult group", 1, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, toxicity double")
    labels = df.select("doc_id", "toxic").unionAll(df.select("doc_id", "toxic").limit(5))
    m = toxicity.fit(df.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_ids(df, m).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(got[r[0]] >= 0.5) == r[2] for r in held]) > 0.97
    assert 0 <= got[3000] == got[3001] < 0.5 <= got[3002] <= 1
    assert {r["toxicity"] for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score_ids(df.limit(0), m).collect() == []
    assert toxicity.fit(df.limit(0), labels) is None


# 5 SimHash


def _fingerprint(t, words=3):
    w = _tokens(t)[:-1]
    sh = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = cases()
    fps = {i: _fingerprint(t) for i, t in rows if i is not None}
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if comp[j] < comp[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    comp[i], changed = comp[j], True
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert int.from_bytes(r["fp"], "big") == fps[r["doc_id"]] and r["component_id"] == comp[r["doc_id"]]
        else:
            assert r["component_id"] is None


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("bits,budget", [(16, 3), (32, 2), (64, 3)])
def test_trie_join(bits, budget):
    rng = np.random.default_rng(bits)
    keys = np.sort(rng.integers(0, 1 << min(bits, 62), 300).astype(np.uint64))
    near = keys ^ (np.uint64(1) << rng.integers(0, bits, 300).astype(np.uint64))
    keys = np.sort(np.concatenate((keys, near, keys[:20])))
    d = np.bitwise_count(keys[:, None] ^ keys[None, :])
    expect = {(i, j) for i, j in zip(*np.nonzero(d <= budget)) if i < j}
    found = set()
    trie = simhash.Trie(keys, bits)
    z = np.zeros(1, np.int64)
    simhash.join(trie, 0, z, z, z.astype(np.int8), budget, lambda i, j: found.update((min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())))
    assert found == expect


def test_sliced_near_duplicates(spark):
    rng = random.Random(9)
    rows = []
    for g in range(60):
        w = [f"t{rng.randint(0, 3000)}" for _ in range(300)]
        rows.append((g * 10, " ".join(w)))
        for k in range(1, 4):
            x = list(w)
            for _ in range(2 * k):  # 5 shingles of 296 each
                x[rng.randrange(300)] = "other"
            rows.append((g * 10 + k, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, 5, 4, 8, 3, simhash.near_limit(0.8, 256)).collect()
    assert np.mean([r["component_id"] == r["doc_id"] // 10 * 10 for r in got]) > 0.98
    assert all(r["component_id"] // 10 == r["doc_id"] // 10 for r in got)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(500, k) for k in range(501, 700)]
    comp = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in comp.items() if k in linked}


# 6 packing


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in cases():
        want[i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    pieces = packing.pack(docs, path, with_ids=True).collect()
    seqs: dict = {}
    for r in pieces:
        raw = bytes(r["ids"])
        assert zlib.crc32(raw) == r["ids_crc32"] and len(raw) == 4 * r["length"] > 0
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # a power of two: no padding
    by: dict = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for i in {i for i, _ in cases()} - {7, None}:
        ids = b"".join(x for _, x, _ in sorted(by[i]))
        assert want[i, tuple(np.frombuffer(ids, "<u4").tolist())] == 1 and {n for _, _, n in by[i]} == {len(ids) // 4}
    assert sum(r["length"] for r in pieces) == sum(len(k[1]) * c for k, c in want.items())
    assert packing.pack(none, path).collect() == []


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        h = packing.hilbert_index(grid, bits)
        assert sorted(h.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(h)], axis=0)).sum(1) == 1).all()


def test_tail_sizes():
    for n in (0, 1, 2047, 2048, 5000, 4095):
        s = packing.tail_sizes(n, 2048)
        assert sum(s) == n and all(x & (x - 1) == 0 and x <= 2048 for x in s)


# 7 token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, none, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    want = sorted(str((i, len((t or "").encode()), n := count(t or ""), n > 1024)) for i, t in cases())
    assert sorted(str(tuple(r)) for r in token_counts.count_tokens(docs, path).collect()) == want
    assert token_counts.count_tokens(none, path).collect() == []


def test_safe_pieces():
    tok = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(200):
        t = "".join(RNG.choice("ab1 \n\t\x85'sé!<|endoftext|>") for _ in range(RNG.randint(0, 80)))
        p = token_counts.safe_pieces(t, 10)
        assert "".join(p) == t and sum(tok(p)) == tok([t])[0]


# 8 kNN join


@pytest.mark.parametrize("block,group,per", [(8192, 4096, 2048), (16, 4, 20)])
def test_knn_join(spark, monkeypatch, block, group, per):
    monkeypatch.setattr(knn_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(knn_join, "GROUP_ROWS", group)
    monkeypatch.setattr(knn_join, "ROWS_PER_PIVOT", per)
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 1, (5, 8))
    rows = [(i, [float(x) for x in np.float32(centre[i % 5] + rng.normal(0, 0.05, 8))], 0) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(60)] + [(400, None, 0), (420, [1.0, None] + [0.0] * 6, 0), (440, [float("nan")] * 8, 0), (460, [float("inf")] * 8, 0), (480, [0.5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in knn_join.top_k(knn_join.integer_vectors(df), k=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    vs = {i: [math.floor(64 * x) for x in np.float32(v).astype(float)] for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in vs if i % 20 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(vs[q], v)), i) for i, v in vs.items() if i != q))[:7]
        assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
    assert set(got) == {i for i in vs if i % 20 == 0}


def test_knn_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn_join.top_k(knn_join.integer_vectors(df)).collect() == []


# 9 WebP


def test_webp_tools():
    rng = np.random.default_rng(1)
    for t in range(45):
        h, w = rng.integers(1, 30, 2)
        x = rng.choice(rng.integers(0, 1 << 32, rng.choice([1, 2, 3, 9, 40])), (h, w)).astype(np.int64)
        if t % 3 == 0:
            x = np.tile(x[:1], (h, 1))
        tiles = lambda b, h=h, w=w: (-(-h // (1 << b)), -(-w // (1 << b)))
        kw: dict = {"subtract_green": bool(t % 2)}
        if t % 4 == 1:
            kw["predictor"] = (2, rng.integers(0, 14, tiles(2)))
        if t % 5 == 1:
            kw["cross"] = (3, rng.integers(0, 1 << 32, tiles(3)))
        if t % 3 == 1:
            kw["cache_bits"] = int(rng.integers(1, 12))
        if t % 4 == 2:
            kw["groups"] = (2, rng.integers(0, 3, tiles(2)))
        if t % 7 == 2:
            kw = {"palette": True}
        assert (webp_lossless.decode(webp_lossless.encode(x, **kw)) == x).all(), (t, kw)


def test_webp_fixed_stream():
    """A stream put together by hand: 2 x 1 pixels, one simple code each, green 7 or 9."""
    w = webp_lossless.BitWriter()
    for v, n in ((0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1), (1, 1), (1, 1), (1, 1), (7, 8), (9, 8)):
        w.put(v, n)
    for s in (3, 5, 255, 0):
        for v, n in ((1, 1), (0, 1), (1, 1), (s, 8)):
            w.put(v, n)
    w.put(1, 1)
    w.put(0, 1)
    body = w.bytes()
    raw = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp_lossless.decode(raw).tolist() == [[0xFF030905, 0xFF030705]]
    with pytest.raises(ValueError):
        webp_lossless.decode(raw[:-3])
    with pytest.raises(ValueError):
        webp_lossless.decode(b"RIFF0000WEBPVP8 ")


def test_webp_column(docs, none):
    rows = webp_lossless.store_payloads(docs, with_media=True).collect()
    by = {}
    for i, t in cases():
        by.setdefault(i, []).append((t or "").encode())
    for r in rows:
        raw = next(t for t in by[r["doc_id"]] if len(t) == r["n_bytes"])
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        media = bytes(r["media"])
        assert webp_lossless.load(media).tobytes() == payload and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
    assert len(rows) == len(cases()) and webp_lossless.store_payloads(none).collect() == []
    for t in (b"ab" * 700, bytes(range(256)) * 9, b"x" * 3_000_000, b"0123456789" * 50):
        payload = webp_lossless.payload_of(t)
        assert webp_lossless.load(b"".join(webp_lossless.store(payload))).tobytes() == payload


# 10 byte BPE


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_perfect_hash(codec):
    f = codec.first
    assert sorted(f.entry.tolist()) == list(range(f.n)) and (f.find(f.keys) == np.arange(f.n)).all()
    assert (f.find([b"no such entry here", b"\xff\xfe\xfd\xfc"]) == -1).all()
    for n in (1, 2, 3, 50):
        keys = [f"k{i}".encode() for i in range(n)]
        g = byte_bpe.MinimalPerfectHash(keys)
        assert g.find([*keys, b"zz"]).tolist() == [*range(n), -1]


def test_byte_bpe(docs, none, codec):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    odd = ["".join(RNG.choice("ab 1\n\t\x1c\x85\xa0\u3000é漢!?'sІЖ😀<|>") for _ in range(RNG.randint(0, 60))) for _ in range(400)] + ["a" * 3000, "the" * 900]
    for t in odd:
        ids = codec.encode_batch([t])[0]
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and codec.decode(ids) == t.encode()
    want = []
    for i, t in cases():
        ids = enc.encode_ordinary(t or "")
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    got = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)
    assert byte_bpe.encode_decode(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []
