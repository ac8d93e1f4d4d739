"""Starting centers of a model."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame

from tickfold.config import ModelConfig
from tickfold.functions.stats import UNIFORM_DIGITS
from tickfold.operators.kmeans import center_sums, fit_kmeans


def uniform_draw(seed: int, *keys: int) -> float:
    """The number ``stats.uniform`` gives for the same seed and keys."""
    text = "|".join(str(v) for v in (seed, *keys))
    head = hashlib.md5(text.encode()).hexdigest()[:UNIFORM_DIGITS]
    return int(head, 16) / float(16**UNIFORM_DIGITS)


def random_centers(q: int, dims: int, seed: int) -> np.ndarray:
    """q centers, uniform in the unit cube."""
    return np.array([[uniform_draw(seed, i, j) for j in range(dims)] for i in range(q)])


def kmeans_centers(points: DataFrame, cfg: ModelConfig) -> np.ndarray:
    """k-means with k = q; fewer distinct points leave centers at the origin."""
    found, _ = fit_kmeans(points, cfg.q, cfg.init_iterations, cfg.seed)
    return np.vstack([found, np.zeros((cfg.q - len(found), cfg.dims))])


@dataclass(frozen=True)
class WarmCenters:
    """Centers with weights that forget at a given rate."""

    centers: np.ndarray
    weights: np.ndarray

    def moved(self, points: DataFrame, decay: float = 1.0, per_point: bool = False):
        """Centers after one more batch, which is read once.

        The old weights count ``decay`` as much as before, per batch or, with
        ``per_point``, per arriving point.
        """
        return self.moved_by(center_sums(points, self.centers).collect(), decay, per_point)

    def moved_by(self, rows, decay: float = 1.0, per_point: bool = False):
        """As ``moved``, from the sums of the batch: one row per center that got points."""
        arrived = sum(r["n"] for r in rows)
        weights = self.weights * (decay ** (arrived if per_point else 1))
        centers = self.centers.copy()
        for r in rows:
            i, n = r["pos"], r["n"]
            total = weights[i] + n
            share = n / max(total, 1e-16)
            centers[i] = (1.0 - share) * centers[i] + share * np.array(r["cf1x"]) / n
            weights[i] = total
        return WarmCenters(centers, weights)._revived()

    def _revived(self):
        """A center that has lost all weight restarts next to the heaviest one."""
        hi, lo = int(self.weights.argmax()), int(self.weights.argmin())
        if not self.weights[lo] < 1e-8 * self.weights[hi]:
            return self
        centers, weights = self.centers.copy(), self.weights.copy()
        weights[hi] = weights[lo] = (weights[hi] + weights[lo]) / 2.0
        nudge = 1e-14 * np.maximum(np.abs(centers[hi]), 1.0)
        centers[lo] = centers[hi] - nudge
        centers[hi] = centers[hi] + nudge
        return WarmCenters(centers, weights)


def cold_centers(cfg: ModelConfig) -> WarmCenters:
    return random_warm_centers(cfg.q, cfg.dims, 0.0, cfg.seed)


def random_warm_centers(k: int, dims: int, weight: float, seed: int) -> WarmCenters:
    """Centers drawn from a standard normal distribution."""
    inverse = NormalDist().inv_cdf
    centers = [
        [inverse(max(uniform_draw(seed, i, j), 1e-15)) for j in range(dims)] for i in range(k)
    ]
    return WarmCenters(np.array(centers), np.full(k, float(weight)))
