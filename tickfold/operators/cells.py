"""Outliers grouped by what they are: a grid of cells that coarsens until few are left.

Which groups come out, and their sums, depend on the points alone: not on partitions, on
tasks or on the order of rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickfold.operators.features import _sum_elements

# Coordinates of a cell. Points of more dimensions are projected on that many axes.
AXES = 6
# A sum is kept as two whole numbers: that of the higher parts of the values and that of
# the rest. Both stay below 2^62, whatever the order they are added up in.
SUM_BITS = 62


def _signs(axis: int, dims: int) -> list[float]:
    """A direction with components 1 or -1, the same everywhere."""
    return [1.0 if zlib.crc32(f"{axis},{i}".encode()) & 1 else -1.0 for i in range(dims)]


def cell_width(rmsd: np.ndarray, dims: int, t_factor: float) -> float:
    """Width of the first cells: a power of two near the boundary of a usual micro-cluster."""
    known = rmsd[np.isfinite(rmsd) & (rmsd > 0)]
    reach = t_factor * float(np.median(known)) if len(known) else 1.0
    if not 0.0 < reach < math.inf:
        reach = 1.0
    # Across the diagonal of a cell of as many dimensions it is at most the boundary.
    return 2.0 ** math.floor(math.log2(reach / math.sqrt(min(dims, AXES))))


def cell_of(x: Column, dims: int, width: float) -> Column:
    """Whole coordinates of the cell of a point."""
    if dims <= AXES:
        return F.transform(x, lambda v: F.floor(v / F.lit(width)))
    wide = width * math.sqrt(dims)
    axes = F.array(*[F.array(*[F.lit(s) for s in _signs(j, dims)]) for j in range(AXES)])
    return F.transform(
        axes,
        lambda a: F.floor(
            F.aggregate(F.zip_with(a, x, lambda s, v: s * v), F.lit(0.0), lambda acc, p: acc + p)
            / F.lit(wide)
        ),
    )


def halvings(steps: int, axes: int) -> list[int]:
    """How often each axis has been halved after so many steps, one axis a step."""
    return [(steps + axes - 1 - j) // axes for j in range(axes)]


def _coarser(cell: str, before: int, after: int, axes: int) -> Column:
    """Cells halved towards zero, so that all meet there in the end."""
    divisors = [
        2 ** min(b - a, SUM_BITS) for a, b in zip(halvings(before, axes), halvings(after, axes))
    ]
    return F.expr(f"zip_with({cell}, array({', '.join(f'{d}L' for d in divisors)}), (c, d) -> c div d)")


def _parts(name: str, scale: float, rest_bits: int) -> dict[str, str]:
    """SQL of the two whole parts of element ``{i}`` of a column."""
    scaled = f"{name}[{{i}}] * {scale!r}D"
    high = f"floor({scaled})"
    return {f"{name}_high": high, f"{name}_low": f"floor(({scaled} - {high}) * {float(2**rest_bits)!r}D)"}


def _scale(largest: float, n: int) -> float:
    """Power of two that brings the sum of ``n`` values up to ``largest`` below 2^62."""
    bits = SUM_BITS - math.ceil(math.log2(n + 1)) - math.frexp(largest)[1]
    return 2.0 ** max(-900, min(900, bits))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_outliers(
    outliers: DataFrame, width: float, dims: int, most: int, scratch: str
) -> tuple[DataFrame, int]:
    """At most ``most`` groups of outliers ``point_id, n, cf1x, cf2x``, in the same columns.

    ``cf2x`` may be null for single points. Points of a cell are one group, under the
    smallest of their ids. While there are more cells than asked for, one axis after the
    other is halved. Sums are formed on the map side: a cell with most of the points is one
    row for each task. Returns the groups and the number of halvings. Cells are written
    below ``scratch``, a shared folder that the caller removes.
    """
    full = outliers.select(
        "point_id", "n", "cf1x", F.coalesce("cf2x", F.transform("cf1x", lambda v: v * v)).alias("cf2x")
    )
    mean = F.transform("cf1x", lambda v: v / F.col("n"))
    top = full.agg(
        F.sum("n").alias("total"),
        *[F.max(F.array_max(F.transform(c, lambda v: F.abs(v) / F.col("n")))).alias(c) for c in ("cf1x", "cf2x")],
    ).first()
    n, axes = int(top["total"] or 0), min(dims, AXES)
    rest_bits = SUM_BITS - math.ceil(math.log2(n + 1))
    scales = {c: _scale(top[c] or 0.0, n) for c in ("cf1x", "cf2x")}
    arrays = {k: v for c in scales for k, v in _parts(c, scales[c], rest_bits).items()}
    cells = _sum_elements(
        full.withColumn("cell", cell_of(mean, dims, width)), ["cell"], arrays, {"n": "n"}, dims, least=("point_id",)
    )
    cells, steps = _written(cells, f"{scratch}/cells-0"), 0
    count = cells.count()
    sums = {k: f"{k}[{{i}}]" for k in arrays}
    while count > most:
        # A step leaves half of the cells at least, so none is skipped that would do.
        ahead = steps + math.ceil(math.log2(count / most))
        coarse = cells.withColumn("cell", _coarser("cell", steps, ahead, axes))
        fewer = _sum_elements(coarse, ["cell"], sums, {"n": "n"}, dims, least=("point_id",))
        cells, steps = _written(fewer, f"{scratch}/cells-{ahead}"), ahead
        count = cells.count()

    def value(c):
        return F.expr(
            f"zip_with({c}_high, {c}_low, (h, l) -> (h + l / {float(2**rest_bits)!r}D) / {scales[c]!r}D) as {c}"
        )

    return cells.select("point_id", "n", value("cf1x"), value("cf2x")), steps
