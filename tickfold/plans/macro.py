"""Macro-clusters: k-means over the weighted centroids of micro-clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.operators.features import centroids, weights
from tickfold.operators.kmeans import fit_kmeans, lloyd
from tickfold.operators.nearest import Model, nearest
from tickfold.operators.sampling import random_sample, systematic_sample
from tickfold.plans.history import horizon

CENTERS = "cluster int, center array<double>, weight double"


def _as_points(mcs: DataFrame) -> DataFrame:
    return centroids(mcs).select("pos", F.col("centroid").alias("x"), "n")


def macro_clusters(mcs: DataFrame, k: int, iterations: int = 20, seed: int = 0) -> DataFrame:
    """k-means on the centroids, each counting as many points as it stands for."""
    points = _as_points(mcs)
    centers, _ = fit_kmeans(points, k, iterations, seed, weight="n")
    return _described(points, centers)


def sampled_macro_clusters(
    mcs: DataFrame,
    k: int,
    draws: int,
    iterations: int = 20,
    seed: int = 0,
    systematic: bool = False,
    tol: float = 1e-4,
) -> DataFrame:
    """k-means on ``draws`` centroids sampled by weight, from k sampled centers.

    The sample is kept as a count per centroid. ``systematic`` takes evenly
    spaced quantiles instead of random ones.
    """
    points = _as_points(mcs)
    weighted = weights(points)
    if systematic:
        drawn = systematic_sample(weighted, "pos", draws).select("pos", "hits")
    else:
        drawn = random_sample(weighted, "pos", draws, seed)
        drawn = drawn.groupBy("pos").agg(F.count("*").alias("hits"))
    sample = points.join(drawn.where("hits > 0"), "pos").withColumn("weight", F.col("hits"))
    sample = sample.select(F.col("pos").cast("bigint").alias("point_id"), "x", "weight").persist()
    start = random_sample(weighted, "pos", k, seed + 1).join(points, "pos").orderBy("draw")
    start = np.array([r["x"] for r in start.collect()])
    centers = lloyd(sample, start, iterations, tol)
    out = _described(points, centers)
    sample.unpersist()
    return out


def _described(points: DataFrame, centers: np.ndarray) -> DataFrame:
    spark = points.sparkSession
    table = [(i, [float(v) for v in c]) for i, c in enumerate(centers)]
    named = spark.createDataFrame(table, "cluster int, center array<double>")
    held = nearest(points, Model.of_centers(centers)).groupBy("nearest.pos")
    held = held.agg(F.sum("n").cast("double").alias("weight"))
    held = held.withColumnRenamed("pos", "cluster")
    return named.join(held, "cluster", "left").select(
        "cluster", "center", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )


def weighted_lloyd(x: np.ndarray, w: np.ndarray, k: int, iterations: int):
    """k-means of one small group, started from the heaviest distinct rows."""
    order = np.lexsort((np.arange(len(w)), -w))
    _, first = np.unique(x[order], axis=0, return_index=True)
    centers = x[order][np.sort(first)[:k]].copy()
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(iterations):
        label = np.square(x[:, None, :] - centers[None]).sum(axis=2).argmin(axis=1)
        new = centers.copy()
        for c in range(len(centers)):
            member = label == c
            if member.any():
                new[c] = (x[member] * w[member, None]).sum(axis=0) / w[member].sum()
        if np.array_equal(new, centers):
            break
        centers = new
    label = np.square(x[:, None, :] - centers[None]).sum(axis=2).argmin(axis=1)
    return centers, np.bincount(label, weights=w, minlength=len(centers))


def offline_sweep(
    snapshots: DataFrame,
    requests: DataFrame,
    ticks: list[int] | DataFrame,
    dims: int,
    k: int,
    iterations: int = 20,
) -> DataFrame:
    """Macro-clusters of many horizons in one job: ``tc, h, cluster, center, weight``.

    All horizons are subtracted together; then every horizon, at most q rows, is
    clustered in a task of its own.
    """
    mcs = centroids(horizon(snapshots, requests, ticks, dims))

    def cluster(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        x = np.stack(rows["centroid"].to_numpy())
        centers, weight = weighted_lloyd(x, rows["n"].to_numpy(dtype=float), k, iterations)
        return pd.DataFrame(
            {
                "tc": key[0],
                "h": key[1],
                "cluster": np.arange(len(centers), dtype=np.int32),
                "center": list(centers),
                "weight": weight,
            }
        )

    slim = mcs.select("tc", "h", "pos", "centroid", "n")
    return slim.groupBy("tc", "h").applyInPandas(cluster, f"tc bigint, h bigint, {CENTERS}")
