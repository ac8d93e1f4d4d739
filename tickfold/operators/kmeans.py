"""k-means building blocks on whole tables: assignment, center update, cost."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.operators.absorb import absorb, partial_sums
from tickfold.operators.nearest import Model, nearest


def center_sums(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """``pos, n, cf1x, cf2x`` of the points nearest to each center.

    One row per center; a column ``weight`` counts a point several times.
    """
    if "point_id" not in points.columns:
        points = points.withColumn("point_id", F.lit(0).cast("bigint"))
    return partial_sums(absorb(points, Model.of_centers(centers)), len(centers[0]))


def moved_centers(sums, centers: np.ndarray) -> np.ndarray:
    """Centers at the mean of their points; those without points stay."""
    out = np.array(centers, dtype=float)
    for r in sums:
        out[r["pos"]] = np.array(r["cf1x"]) / r["n"]
    return out


def lloyd(points: DataFrame, centers, iterations: int, tol: float = 1e-4) -> np.ndarray:
    """Iterate from given centers until none moves by more than ``tol``."""
    centers = np.asarray(centers, dtype=float)
    for _ in range(iterations):
        new = moved_centers(center_sums(points, centers).collect(), centers)
        shift = np.sqrt(np.square(new - centers).sum(axis=1)).max()
        centers = new
        if shift <= tol:
            break
    return centers


def fit_kmeans(
    points: DataFrame, k: int, iterations: int, seed: int, weight: str | None = None
) -> tuple[np.ndarray, float]:
    """Centers and cost (within-set sum of squared errors) of Spark's k-means."""
    columns = [array_to_vector("x").alias("features")]
    estimator = KMeans(k=k, maxIter=iterations, seed=seed)
    if weight:
        columns.append(F.col(weight).cast("double").alias("w"))
        estimator = estimator.setWeightCol("w")
    fitted = estimator.fit(points.select(*columns))
    return np.array(fitted.clusterCenters()), fitted.summary.trainingCost


def wssse(points: DataFrame, centers) -> DataFrame:
    """Sum of squared distances to the nearest center: one row, ``wssse``."""
    model = centers if isinstance(centers, DataFrame) else Model.of_centers(centers)
    return nearest(points, model).agg(F.sum("nearest.d2").alias("wssse"))
