"""Prediction from neighbours: whole arrays against the pixel by pixel rule, and where the stored form uses it."""

import random

import numpy as np
import pytest

from kindred.llm import webp_lossless as W


@pytest.mark.parametrize("mode", [W.LEFT, W.ABOVE])
@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (13, 21)])
def test_against_the_rule(mode, shape):
    x = np.random.default_rng(3).integers(0, 1 << 32, shape, dtype=np.uint32)
    tiles = np.full((1, 1), mode)
    assert (W.decode(W.encode(x, predictor=(9, tiles))) == x).all()
    residual = np.random.default_rng(4).integers(0, 1 << 32, shape, dtype=np.int64)
    rows = residual.tolist()
    for i in range(shape[0]):
        for j in range(shape[1]):
            rows[i][j] = W._add(rows[i][j], W._guess(rows, mode, i, j))
    assert W._undo_predictor(residual, 9, tiles << 8).tolist() == rows


def test_stored_form():
    ramp = bytes((i * 3 + i // 64) % 251 for i in range(64 * 600))
    rng = random.Random(1)
    column = bytes(rng.randrange(256) for _ in range(64))
    drift = b"".join(bytes((c + r) % 256 for c in column) for r in range(90))
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(3000)).encode()
    for payload, used in ((ramp, W.LEFT), (drift, W.ABOVE), (W.payload_of(text), None)):
        grey = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(np.int64)
        found = W.best_predictor(grey)
        assert (None if found is None else int(found[1].flat[0])) == used
        stored = W.store(payload)
        assert W.load(b"".join(stored)).tobytes() == payload
        if used:
            assert len(b"".join(stored)) < len(W.encode(grey * 0x010101 | 0xFF000000, subtract_green=True, copies=False))
