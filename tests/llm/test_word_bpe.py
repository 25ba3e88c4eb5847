"""Ids of the word tokenizer against the library itself."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from kindred.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def same(enc, texts):
    flat, at = enc.encode(pa.array(texts, pa.string()))
    want = enc.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in want]


def test_random_texts():
    enc, rng = word_bpe.WordEncoder(PATH), random.Random(5)
    assert enc.merges is not None
    pool = [chr(c) for c in range(0x260)] + list("ÀéÉœŒßİıǅΣσςΑあ漢字🙂́\u0085 ‍") + list("aaaeeettt   '''sstd  <|>..,,00112") * 8 + ["<|endoftext|>", "'s", "'LL"]
    same(enc, ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)])


def test_contractions_and_runs():
    enc = word_bpe.WordEncoder(PATH)
    same(enc, [None, "", " ", "don't 'tis ''s x's's 'LLama ,'s 'r 're're 'd1 1'd", "aaaaaaa aaaa!!!! ......", "x" * 200, "a" * 70 + " " + "ab" * 40, "É" * 30, "x" * 300_000])


def test_tables_start_anew():
    enc, rng = word_bpe.WordEncoder(PATH), random.Random(1)
    enc.words = word_bpe.HashTable(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    for _ in range(5):
        same(enc, [" ".join(word() for _ in range(60)) for _ in range(3)])
    assert enc.words.most >= enc.words.n


def test_table_against_a_dict():
    table, keys = word_bpe.HashTable(10), np.unique(np.random.default_rng(2).integers(1, 1 << 63, 500, dtype=np.uint64))
    keys[:50] = np.arange(1, 51)  # all in one place
    table.add(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1 << 40)) == -1).all()
