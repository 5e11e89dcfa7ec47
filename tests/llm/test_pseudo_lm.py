"""Short rows in numpy, against their plain forms."""

import numpy as np

from bytelens.llm import pseudo_lm as M


def test_short_rows_are_reduced_as_whole_arrays_would_be():
    z = (np.random.default_rng(1).standard_normal((3 * M.BLOCK + 7, M.HEAD)) * 200).astype(np.float32)
    assert np.array_equal(M.highest(z), z.max(axis=1, keepdims=True))
    assert M.highest(z[:0]).shape == (0, 1)
    plain = np.exp(z - z.max(axis=1, keepdims=True))
    before = z.copy()
    assert np.allclose(M.softmax(z), plain / plain.sum(axis=1, keepdims=True), atol=1e-6) and np.array_equal(z, before)


def test_a_step_moves_each_embedding_by_the_sum_of_its_gradients():
    rng = np.random.default_rng(2)
    counts = np.arange(M.FINE)[::-1]
    prior, p = M.Vocabulary(counts), M.initial()
    p["top"][:] = rng.standard_normal(p["top"].shape)
    sums = {k: np.full_like(v, 1e-4) for k, v in p.items()}
    ctx, target = np.array([[3, 3, 5, M.VOCAB], [5, 3, 9, 9]], np.int32), np.array([1, 40], np.int32)
    start = {k: v.copy() for k, v in p.items()}
    M.step(p, sums, prior, ctx, target)
    _, h = M.hidden(start, ctx)
    d1 = M.softmax(h @ start["top"] + prior.top)
    d1[[0, 1], target // M.HEAD] -= 1
    dx = ((d1 / 2 @ start["top"].T * (1 - h * h)) @ start["w1"].T).reshape(8, M.DIM)  # the lower level starts at zero
    for word in (3, 5, 9, M.VOCAB):
        g = dx[ctx.ravel() == word].sum(axis=0)
        assert np.allclose(p["emb"][word], start["emb"][word] - M.RATE * g / np.sqrt(1e-4 + g * g + 1e-8), atol=1e-4)
    assert np.array_equal(p["emb"][4], start["emb"][4])
