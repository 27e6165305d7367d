"""Kernels of the pairwise losses."""

import numpy as np

from groupstats.operators import evaluate


def test_kernels_share_one_logarithm_and_take_any_gap():
    gap, width = np.array([0.0, 2.5, -2.5, 800.0, -800.0, np.inf, -np.inf]), np.full(7, 5.0)
    label = np.array([0.3, -0.3, 800.0, -800.0, 1.0, 1.0, -1.0])
    with np.errstate(over="raise", invalid="raise"):
        entropy, clipped = evaluate._entropy(gap, label, width), evaluate._clipped(gap, label, width)
        up, down = evaluate._softplus(gap)
    lowest, first = np.log(evaluate.SMALLEST_PROBABILITY), 1 / (1 + np.exp(-np.clip(label, -700, 700)))
    finite = np.clip(gap, -1000, 1000)
    losses = [np.maximum(-np.logaddexp(0, s * finite), lowest) for s in (-1, 1)]
    assert np.allclose(entropy, -first * losses[0] - (1 - first) * losses[1])
    assert np.allclose(up[:5], np.logaddexp(0, gap[:5])) and np.allclose(down[:5], np.logaddexp(0, -gap[:5]))
    one, two = (np.clip(width + s * np.logaddexp(0, s * finite) * np.tanh(label), 0, width) for s in (1, -1))
    assert np.allclose(clipped, one + two)
