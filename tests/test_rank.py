from __future__ import annotations

import numpy as np
import pytest

from lexigrid.operators.rank import hard_threshold, svht_rank


def test_known_coefficients():
    assert hard_threshold(1.0, True) == pytest.approx(4 / np.sqrt(3))
    assert hard_threshold(1.0, False) == pytest.approx(2.858, abs=0.003)


@pytest.mark.parametrize("noise", [None, 1.0])
def test_finds_planted_rank(noise):
    rng = np.random.default_rng(0)
    m = 30 * rng.normal(size=(200, 3)) @ rng.normal(size=(3, 100)) / 10 + rng.normal(size=(200, 100))
    assert svht_rank(np.linalg.svd(m, compute_uv=False), 200, 100, noise) == 3
    assert svht_rank([], 3, 2) == 0
