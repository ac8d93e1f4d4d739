"""Standardisation by batch moments, and projection to principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.functions import vectors as V
from tickfold.operators.features import NARROW, broadcast_if_small


def _per_dim(function: str, dims: int):
    calls = ", ".join(f"{function}(x[{i}])" for i in range(dims))
    return F.expr(f"array({calls})").alias(function)


def moments(points: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and sample deviation per dimension, in one pass."""
    if dims <= NARROW:
        row = points.agg(
            F.count("*").alias("n"), _per_dim("avg", dims), _per_dim("stddev_samp", dims)
        ).first()
        n, mu, sd = row["n"], row["avg"], row["stddev_samp"]
    else:
        summary = Summarizer.metrics("count", "mean", "std").summary(array_to_vector("x"))
        row = points.agg(summary.alias("s"), F.count("*").alias("n")).first()
        n = row["n"]
        mu, sd = (row["s"]["mean"].toArray(), row["s"]["std"].toArray()) if n else (None, None)
    if not n:
        return 0, np.zeros(dims), np.zeros(dims)
    # The deviation of one row is undefined (null): that dimension maps to zero.
    clean = [0.0 if s is None or s != s else float(s) for s in sd]
    return n, np.array(mu, dtype=float), np.array(clean)


def moments_by(points: DataFrame, key: str, dims: int) -> DataFrame:
    """``key, mu, sd`` for every value of the key at once."""
    if dims <= NARROW:
        return points.groupBy(key).agg(
            _per_dim("avg", dims).alias("mu"), _per_dim("stddev_samp", dims).alias("sd")
        )
    long = points.select(key, F.posexplode("x").alias("dim", "v"))
    each = long.groupBy(key, "dim").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"))
    rows = each.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("dim", "mu", "sd"))).alias("m")
    )
    return rows.select(key, F.col("m.mu").alias("mu"), F.col("m.sd").alias("sd"))


def standardize(points: DataFrame, key: str, dims: int) -> DataFrame:
    """z-score every point by the moments of its own batch ``key``.

    Dimensions without spread, and batches of one row, become zero. The moments
    are one row per batch; as long as those are few they are broadcast, so the
    points stay where they are, even if one batch holds most of them.
    """
    stats = broadcast_if_small(moments_by(points, key, dims), row_bytes=16 * dims + 32)
    z = F.transform(
        F.arrays_zip("x", "mu", "sd"),
        lambda e: F.when(e["sd"] > 0, (e["x"] - e["mu"]) / e["sd"]).otherwise(0.0),
    )
    return points.join(stats, key).withColumn("x", z).drop("mu", "sd")


def standardize_with(points: DataFrame, mu, sd) -> DataFrame:
    """z-score by given moments."""
    centred = V.subtract(F.col("x"), V.literal(mu))
    inverse = V.literal([1.0 / s if s > 0 else 0.0 for s in sd])
    return points.withColumn("x", F.zip_with(centred, inverse, lambda a, b: a * b))


def fit_projection(points: DataFrame, k: int) -> PCAModel:
    """Principal axes, fitted once so that micro-clusters of all ticks compare."""
    vectors = points.select(array_to_vector("x").alias("features"))
    return PCA(k=k, inputCol="features", outputCol="projected").fit(vectors)


def fit_scaled_projection(points: DataFrame, dims: int, k: int) -> PCAModel:
    """Principal axes of the standardised points, for a model that scales its batches."""
    _, mu, sd = moments(points, dims)
    return fit_projection(standardize_with(points, mu, sd), k)


def project(points: DataFrame, model: PCAModel) -> DataFrame:
    """Coordinates on the principal axes, replacing ``x``."""
    out = model.transform(points.withColumn("features", array_to_vector("x")))
    return out.withColumn("x", vector_to_array("projected")).drop("features", "projected")
