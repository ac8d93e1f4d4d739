"""One pass of a batch over the model: partial features, and what is left over."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.operators.features import sum_features
from tickfold.operators.nearest import Model, matrix_of, nearest_rows

# A row with ``pos`` is a partial sum for that slot; one without is an outlier, with
# n > 1 a weighted one. ``cf2x`` of a single point is left out.
WORK = "pos int, point_id bigint, n bigint, cf1x array<double>, cf2x array<double>"

VECTOR = pa.list_(pa.float64())


def vectors_to_arrow(rows) -> pa.Array:
    """A matrix, or a list of equally long vectors and Nones, as a list column."""
    if isinstance(rows, np.ndarray):
        ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))
    return pa.array([None if r is None else list(r) for r in rows], VECTOR)


def _work_batch(pos, point_id, n, cf1x, cf2x) -> pa.RecordBatch:
    size = len(n)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(size, pa.int32()) if pos is None else pa.array(pos, pa.int32()),
            pa.nulls(size, pa.int64()) if point_id is None else pa.array(point_id, pa.int64()),
            pa.array(n, pa.int64()),
            vectors_to_arrow(cf1x),
            pa.nulls(size, VECTOR) if cf2x is None else vectors_to_arrow(cf2x),
        ],
        names=["pos", "point_id", "n", "cf1x", "cf2x"],
    )


class _Sums:
    """Per-slot sums of one task."""

    def __init__(self, q: int, dims: int):
        self.n = np.zeros(q)
        self.cf1x = np.zeros((q, dims))
        self.cf2x = np.zeros((q, dims))

    def add(self, index, x, w):
        q = len(self.n)
        self.n += np.bincount(index, w, q)
        for j in range(x.shape[1]):
            v = x[:, j] if w is None else x[:, j] * w
            self.cf1x[:, j] += np.bincount(index, v, q)
            self.cf2x[:, j] += np.bincount(index, v * x[:, j], q)

    def batch(self, pos):
        used = np.nonzero(self.n > 0)[0]
        n = np.rint(self.n[used]).astype(np.int64)
        return _work_batch(pos[used], None, n, self.cf1x[used], self.cf2x[used])


def absorb(
    points: DataFrame,
    model: Model,
    t_factor: float = float("inf"),
    mu=None,
    sd=None,
) -> DataFrame:
    """Assign every point and sum up, inside the task that reads it.

    Each task emits at most one row per slot, plus the points outside the
    boundary of their micro-cluster. The
    default boundary is infinite: plain nearest-center sums. A column ``weight``
    (whole numbers) counts a row several times.
    """
    columns = ["point_id", "x"] + (["weight"] if "weight" in points.columns else [])
    weighted = len(columns) == 3
    shift = None if mu is None else np.asarray(mu, dtype=float)
    inverse = None if sd is None else np.array([1.0 / s if s > 0 else 0.0 for s in sd])

    def run(batches):
        sums = _Sums(len(model.pos), model.dims)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix_of(batch.column(1))
            if shift is not None:
                x = (x - shift) * inverse
            w = batch.column(2).to_numpy() if weighted else None
            index, d2 = nearest_rows(x, model.centroid)
            inside = np.sqrt(d2) <= t_factor * model.rmsd[index]
            if inside.all():
                sums.add(index, x, w)
                continue
            sums.add(index[inside], x[inside], w[inside] if weighted else None)
            rest = np.nonzero(~inside)[0]
            ids = batch.column(0).to_numpy()[rest]
            many = w[rest] if weighted else np.ones(len(rest), np.int64)
            if weighted:
                n = many[:, None]
                yield _work_batch(None, ids, many.astype(np.int64), n * x[rest], n * np.square(x[rest]))
            else:
                yield _work_batch(None, ids, many, x[rest], None)
        yield sums.batch(model.pos)

    return points.select(*columns).mapInArrow(run, WORK)


def partial_sums(work: DataFrame, dims: int) -> DataFrame:
    """Features of the absorbed points per slot: ``pos, n, cf1x, cf2x``."""
    return sum_features(work.where("pos is not null"), ["pos"], dims, times=False)


def left_over(work: DataFrame) -> DataFrame:
    return work.where("pos is null")
