"""Nearest-centroid search: points against a model, or a model against itself."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickfold.config import MAX_MODEL_BYTES, run_dir
from tickfold.operators.spatial import closest_pair_by_leaf, nearest_other_by_leaf

# Centroids of a block, and blocks that one pass over the points ships.
BLOCK_ROWS = 4096
PASS_BLOCKS = 8
# Distances a task holds at once: few enough to stay in its cache.
TILE = 262_144


@dataclass(frozen=True)
class Model:
    """The part of the micro-clusters that assignment needs."""

    pos: np.ndarray
    mc_id: np.ndarray
    centroid: np.ndarray
    rmsd: np.ndarray

    @property
    def dims(self) -> int:
        return self.centroid.shape[1]

    @staticmethod
    def of_centers(centers) -> "Model":
        centers = np.asarray(centers, dtype=float)
        pos = np.arange(len(centers))
        return Model(pos, pos, centers, np.full(len(centers), np.inf))

    @staticmethod
    def of_rows(rows) -> "Model":
        rows = sorted(rows, key=lambda r: r["pos"])
        return Model(
            np.array([r["pos"] for r in rows], dtype=np.int64),
            np.array([r["mc_id"] for r in rows], dtype=np.int64),
            np.array([r["centroid"] for r in rows], dtype=float),
            np.array([r["rmsd"] for r in rows], dtype=float),
        )


def model_blocks(mcs: DataFrame):
    """The micro-clusters in blocks of at most ``BLOCK_ROWS``, by ascending ``pos``.

    The table is walked in the order of its rows, each block after the last row of
    the one before, so equal and negative ``pos`` are all met. Of rows that are equal
    in every field one is enough.
    """
    slim = mcs.select(
        F.col("pos").cast("int").alias("pos"),
        F.col("mc_id").cast("bigint").alias("mc_id"),
        "centroid",
        (F.col("rmsd") if "rmsd" in mcs.columns else F.lit(float("inf"))).alias("rmsd"),
    ).where(F.col("centroid").isNotNull())
    order = F.struct(*slim.columns)
    rest = slim
    while rows := rest.orderBy(order).limit(BLOCK_ROWS).collect():
        yield Model.of_rows(rows)
        if len(rows) < BLOCK_ROWS:
            return
        last = rows[-1]
        rest = slim.where(
            order > F.struct(
                F.lit(last["pos"]).cast("int").alias("pos"),
                F.lit(last["mc_id"]).cast("bigint").alias("mc_id"),
                F.array(*(F.lit(float(v)) for v in last["centroid"])).alias("centroid"),
                F.lit(float(last["rmsd"])).alias("rmsd"),
            )
        )


def whole_model(mcs: DataFrame, max_bytes: int = MAX_MODEL_BYTES) -> Model | None:
    """All micro-clusters as one model that travels with the task code.

    Raises where they are more than a task should hold; none gives None.
    """
    blocks, size = [], 0
    for block in model_blocks(mcs):
        blocks.append(block)
        size += block.centroid.nbytes
        if size > max_bytes:
            raise ValueError("more micro-clusters than a model that fits every task")
    if not blocks:
        return None
    fields = ("pos", "mc_id", "centroid", "rmsd")
    return Model(*(np.concatenate([getattr(b, f) for b in blocks]) for f in fields))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as an n x d matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest_rows(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest center and the exact squared distance, per row of ``x``.

    Matrix products rank the centers; rows whose best two are too close for the
    rounding of that are decided by exact differences, first center winning.
    """
    best = np.empty(len(x), dtype=np.int64)
    gap = np.empty(len(x))
    norm = np.einsum("ij,ij->i", centers, centers)
    double = np.ascontiguousarray(-2.0 * centers.T)
    step = max(1, TILE // len(centers))
    for lo in range(0, len(x), step):
        scores = x[lo : lo + step] @ double
        scores += norm
        rows = np.arange(len(scores))
        pick = scores.argmin(axis=1)
        low = scores[rows, pick]
        scores[rows, pick] = np.inf
        best[lo : lo + step] = pick
        gap[lo : lo + step] = scores.min(axis=1) - low
    close = np.nonzero(gap <= 1e-10 * (np.einsum("ij,ij->i", x, x) + norm.max()))[0]
    step = max(1, TILE // centers.size)
    for lo in range(0, len(close), step):
        rows = close[lo : lo + step]
        exact = np.square(x[rows, None, :] - centers[None]).sum(axis=2)
        best[rows] = exact.argmin(axis=1)
    diff = x - centers[best]
    return best, np.einsum("ij,ij->i", diff, diff)


NEAREST = "struct<d2:double,pos:int,mc_id:bigint,rmsd:double>"


def _matches(model: Model, index: np.ndarray, d2: np.ndarray) -> pa.Array:
    found = np.isfinite(d2)
    return pa.StructArray.from_arrays(
        [
            pa.array(d2),
            pa.array(model.pos[index], pa.int32()),
            pa.array(model.mc_id[index], pa.int64()),
            pa.array(model.rmsd[index]),
        ],
        names=["d2", "pos", "mc_id", "rmsd"],
        mask=pa.array(~found),
    )


def _nearest_udf(model: Model):
    @F.arrow_udf(NEAREST)
    def nearest(x: pa.Array) -> pa.Array:
        return _matches(model, *nearest_rows(matrix_of(x), model.centroid))

    return nearest


def _nearest_other_udf(model: Model, later_only: bool):
    @F.arrow_udf(NEAREST)
    def nearest_other(pos: pa.Array, x: pa.Array) -> pa.Array:
        asked = np.nonzero(x.is_valid().to_numpy(zero_copy_only=False))[0]
        own = pos.to_numpy(zero_copy_only=False)[asked]
        points = matrix_of(x.drop_null())
        index = np.zeros(len(x), dtype=np.int64)
        d2 = np.full(len(x), np.inf)
        few = max(1, TILE // max(1, model.centroid.size))
        for at in range(0, len(points), few):
            part = slice(at, at + few)
            exact = np.square(points[part, None, :] - model.centroid[None]).sum(axis=2)
            # Either the slots after this one, or all at a distance from it.
            others = model.pos[None] > own[part, None] if later_only else exact > 0.0
            exact[~others] = np.inf
            index[asked[part]] = exact.argmin(axis=1)
            d2[asked[part]] = exact.min(axis=1)
        return _matches(model, index, d2)

    return nearest_other


def nearest(points: DataFrame, mcs: DataFrame | Model) -> DataFrame:
    """Add ``nearest`` (d2, pos, mc_id, rmsd); the lowest ``pos`` wins ties.

    The model travels with the task code, one block at a time: no shuffle and
    no pairs are made.
    """
    blocks = [mcs] if isinstance(mcs, Model) else model_blocks(mcs)
    return _least_of(points, (_nearest_udf(b)(F.col("x")) for b in blocks))


def _more_than_a_block(mcs: DataFrame) -> bool:
    return mcs.select("pos").limit(BLOCK_ROWS + 1).count() > BLOCK_ROWS


def nearest_other(
    mcs: DataFrame, later_only: bool = False, where: Column | None = None
) -> DataFrame:
    """Add ``nearest``: the closest other micro-cluster of the same table.

    With ``later_only`` just those with a higher ``pos`` count, so that the
    minimum over all rows is the closest pair; without it, those at distance
    zero do not count. Rows that fail ``where`` are not looked up. A table of more
    than a block is searched leaf by leaf.
    """
    if not later_only and _more_than_a_block(mcs):
        return nearest_other_by_leaf(mcs, where)
    asked = F.col("centroid") if where is None else F.when(where, F.col("centroid"))
    found = (_nearest_other_udf(b, later_only)(F.col("pos"), asked) for b in model_blocks(mcs))
    return _least_of(mcs.where(F.col("centroid").isNotNull()), found)


def _least_of(df: DataFrame, found) -> DataFrame:
    """The least of the blocks' answers, a few blocks in a pass.

    What the passes before found is written to the shared folder, so that the driver and
    the tasks hold no more than ``PASS_BLOCKS`` blocks at a time.
    """
    best, found = F.lit(None).cast(NEAREST), iter(found)
    held = list(islice(found, PASS_BLOCKS))
    while True:
        # Structs compare field by field: distance first, then slot. Nulls are skipped.
        now = df.withColumn("nearest", F.least(best, *held) if held else best)
        held = list(islice(found, PASS_BLOCKS))
        if not held:
            return now
        path = run_dir(df.sparkSession, "nearest")
        now.write.parquet(path)
        df = df.sparkSession.read.schema(now.schema).parquet(path)
        best = F.col("nearest")


def closest_pair(mcs: DataFrame) -> DataFrame:
    """One row ``d2, pos_a, pos_b`` with pos_a < pos_b; the first pair wins ties."""
    if _more_than_a_block(mcs):
        return closest_pair_by_leaf(mcs)
    best = nearest_other(mcs, later_only=True).where(F.col("nearest").isNotNull())
    pair = F.struct(
        F.col("nearest.d2").alias("d2"),
        F.col("pos").alias("pos_a"),
        F.col("nearest.pos").alias("pos_b"),
    )
    return best.agg(F.min(pair).alias("p")).where("p is not null").select("p.*")


def classify(assigned: DataFrame, t_factor: float) -> DataFrame:
    """Boundary test: ``inside`` is 1 within ``t_factor`` times the rmsd, else 0."""
    dist = F.sqrt("nearest.d2")
    inside = F.when(dist <= t_factor * F.col("nearest.rmsd"), 1).otherwise(0)
    return assigned.withColumn("dist", dist).withColumn("inside", inside)


def inliers(classified: DataFrame) -> DataFrame:
    return classified.where("inside = 1")


def outliers(classified: DataFrame) -> DataFrame:
    return classified.where("inside = 0")
