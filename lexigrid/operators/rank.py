"""Choice of the number of latent dimensions from singular values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def marchenko_pastur_median(beta: float, steps: int = 20_000) -> float:
    """Median of the Marchenko-Pastur law of aspect ratio beta, by the trapezoid rule on a substitution that removes the square-root ends."""
    low, high = (1 - np.sqrt(beta)) ** 2, (1 + np.sqrt(beta)) ** 2
    angle = np.linspace(0, np.pi, steps)
    x = (low + high) / 2 - (high - low) / 2 * np.cos(angle)
    density = ((high - low) / 2 * np.sin(angle)) ** 2 / (2 * np.pi * beta * np.maximum(x, 1e-12))
    mass = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(angle))])
    return float(np.interp(mass[-1] / 2, mass, x))


def hard_threshold(beta: float, known_noise: bool) -> float:
    """Optimal coefficient for singular values: of noise times the square root of the longer side if the noise is known, else of the median singular value."""
    b = beta + 1
    coefficient = float(np.sqrt(2 * b + 8 * beta / (b + np.sqrt(b * b + 12 * beta))))
    return coefficient if known_noise else coefficient / float(np.sqrt(marchenko_pastur_median(beta)))


def svht_rank(values: Sequence[float], rows: int, columns: int, noise: float | None = None) -> int:
    """How many singular values of a rows x columns matrix rise over the optimal hard threshold."""
    s = np.asarray(values, float)
    if not len(s):
        return 0
    beta = min(rows, columns) / max(rows, columns)
    cut = hard_threshold(beta, noise is not None) * (np.median(s) if noise is None else noise * np.sqrt(max(rows, columns)))
    return int((s > cut).sum())
