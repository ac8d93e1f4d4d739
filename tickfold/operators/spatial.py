"""Nearest other centroid in a large table, leaf by leaf of a k-d tree.

Centroids that lie together are one leaf. A centroid looks through its own leaf first, and
then only through those whose bounding box is nearer than what it has found. No task holds
the table, and no pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickfold.config import run_dir

# Centroids of a leaf. There are at most ``MAX_LEAVES``; beyond that leaves grow.
LEAF_ROWS = 512
MAX_LEAVES = 8192
# Bytes of the sampled centroids whose medians cut the space, and how many a cut takes.
SAMPLE_BYTES = 16 << 20
ROWS_A_LEAF = 8
# Visitors of a leaf that one task takes.
VISITORS = 65_536
# Differences a task holds at a time.
TILE = 262_144

FOUND = "cid bigint, d2 double, pos int, mc_id bigint, rmsd double"
MEMBER = "cid bigint, centroid array<double>, pos int, mc_id bigint, rmsd double, asked boolean, leaf int"


class Cuts:
    """Planes of a balanced tree: node ``i`` has the children ``2i + 1`` and ``2i + 2``."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(2**depth - 1, np.int64)
        self.cut = np.zeros(2**depth - 1)
        parts = [sample]
        for level in range(depth):
            following = []
            for i, rows in enumerate(parts, start=2**level - 1):
                if len(rows):
                    self.axis[i] = int(np.ptp(rows, axis=0).argmax())
                    self.cut[i] = np.median(rows[:, self.axis[i]])
                right = rows[:, self.axis[i]] >= self.cut[i]
                following += [rows[~right], rows[right]]
            parts = following

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.axis[node]] >= self.cut[node])
        return (node - (2**self.depth - 1)).astype(np.int32)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _nearest_in(x: np.ndarray, members: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest member not at distance zero, by least ``pos`` of several."""
    order = np.lexsort((members["mc_id"].to_numpy(), members["pos"].to_numpy()))
    centers = _matrix(members["centroid"])[order]
    index, d2 = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    few = max(1, TILE // max(1, centers.size))
    for at in range(0, len(x), few):
        part = slice(at, at + few)
        exact = np.square(x[part, None, :] - centers[None]).sum(axis=2)
        exact[exact == 0.0] = np.inf
        index[part], d2[part] = exact.argmin(axis=1), exact.min(axis=1)
    return order[index], d2


def _found(cid, x: np.ndarray, members: pa.Table) -> pa.Table:
    index, d2 = _nearest_in(x, members)
    hit = np.isfinite(d2)
    at = pa.array(index[hit])
    return pa.table({
        "cid": pa.array(np.asarray(cid)[hit], pa.int64()),
        "d2": pa.array(d2[hit]),
        **{c: members[c].combine_chunks().take(at) for c in ("pos", "mc_id", "rmsd")},
    })


def _members(distinct: DataFrame, count: int) -> tuple[DataFrame, int]:
    """The distinct centroids with their leaf, stored, and the number of leaves."""
    dims = len(distinct.select("centroid").first()[0])
    most = max(1, min(MAX_LEAVES, SAMPLE_BYTES // (8 * dims * ROWS_A_LEAF)))
    depth = max(0, min(int(np.ceil(np.log2(max(1, count / LEAF_ROWS)))), int(np.log2(most))))
    rows = distinct.orderBy(F.xxhash64("cid"), "cid").limit(2**depth * ROWS_A_LEAF).select("centroid")
    cuts = Cuts(np.array([r["centroid"] for r in rows.collect()], float).reshape(-1, dims), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = cuts.leaf_of(_matrix(batch.column("centroid")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    columns = ["cid", "centroid", "pos", "mc_id", "rmsd", "asked"]
    return _stored(distinct.select(*columns).mapInArrow(run, MEMBER), "leaves"), 2**depth


def _own_leaf(members: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        asked = group.filter(group["asked"])
        return _found(asked["cid"].to_numpy(), _matrix(asked["centroid"]), group)

    return members.groupBy("leaf").applyInArrow(run, FOUND)


def _boxes(members: DataFrame) -> list:
    """Smallest box around each leaf; as many numbers as a bounded number of leaves has."""

    def run(group: pa.Table) -> pa.Table:
        x = _matrix(group["centroid"])
        return pa.table({
            "leaf": group["leaf"].combine_chunks()[:1],
            "low": pa.array([x.min(axis=0).tolist()]),
            "high": pa.array([x.max(axis=0).tolist()]),
        })

    boxes = members.groupBy("leaf").applyInArrow(run, "leaf int, low array<double>, high array<double>")
    return boxes.collect()


def visits(members: DataFrame, known: DataFrame, bound: float = np.inf) -> DataFrame:
    """Rows ``leaf, cid, centroid``: which other leaves a centroid has to look through."""
    boxes = _boxes(members)
    numbers = np.array([b["leaf"] for b in boxes], np.int32)
    low, high = (np.array([b[c] for b in boxes], float) for c in ("low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = max(1, TILE // max(1, low.size))
        for whole in batches:
            for at in range(0, whole.num_rows, few):
                batch = whole.slice(at, few)
                x = _matrix(batch.column("centroid"))
                outside = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0.0)
                gap = np.square(outside).sum(axis=2)
                reach = np.minimum(batch.column("d2").to_numpy(zero_copy_only=False), bound)
                # Ties count, and rounding must not hide one.
                near = gap <= (reach * (1 + 1e-9))[:, None]
                near &= batch.column("leaf").to_numpy()[:, None] != numbers[None]
                row, leaf = np.nonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[leaf]), *(batch.column(c).take(pa.array(row)) for c in ("cid", "centroid"))],
                    names=["leaf", "cid", "centroid"],
                )

    asked = members.where("asked").join(known.select("cid", "d2"), "cid", "left")
    rows = asked.select("cid", "centroid", "leaf", F.coalesce("d2", F.lit(float("inf"))).alias("d2"))
    return rows.mapInArrow(run, "leaf int, cid bigint, centroid array<double>")


def _visited(members: DataFrame, visitors: DataFrame, parts: int) -> DataFrame:
    def run(asked: pa.Table, group: pa.Table) -> pa.Table:
        return _found(asked["cid"].to_numpy(), _matrix(asked["centroid"]), group)

    copies = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = visitors.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int"))
    left = dealt.groupBy("leaf", "part")
    # Leaves that nobody visits have an empty side.
    return left.cogroup(copies.groupBy("leaf", "part")).applyInArrow(run, FOUND)


def _distinct(stored: DataFrame) -> DataFrame:
    """One row for equal centroids: the first of them is the one that can be found."""
    first = F.min(
        F.struct(F.col("pos").cast("int").alias("pos"), F.col("mc_id").cast("bigint").alias("mc_id"), "rmsd")
    ).alias("f")
    grouped = stored.groupBy("centroid").agg(first, F.max("_asked").alias("asked"), F.min("_rid").alias("cid"))
    return grouped.select("cid", "centroid", "f.*", "asked")


def _search(stored: DataFrame, globally: bool) -> DataFrame:
    """``cid, centroid, d2, pos, mc_id, rmsd``: the nearest of each distinct centroid asked for.

    With ``globally`` only those that may be the nearest of all are looked for further.
    """
    distinct = _stored(_distinct(stored), "centroids")
    count = distinct.count()
    members, leaves = _members(distinct, count)
    known = _stored(_own_leaf(members), "own-leaf")
    found = known
    if leaves > 1:
        bound = np.inf
        if globally:
            least = known.agg(F.min("d2")).first()[0]
            bound = np.inf if least is None else least
        parts = -(-count // VISITORS)
        found = known.unionByName(_visited(members, visits(members, known, bound), parts))
    best = found.groupBy("cid").agg(F.min(F.struct("d2", "pos", "mc_id", "rmsd")).alias("nearest"))
    return members.select("cid", "centroid").join(best, "cid")


def nearest_other_by_leaf(mcs: DataFrame, where: Column | None = None) -> DataFrame:
    """Adds ``nearest`` (d2, pos, mc_id, rmsd) to rows that have a ``centroid``.

    Those at distance zero don't count, the lowest ``pos`` wins ties, and rows that fail
    ``where`` are not looked up.
    """
    asked = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    stored = _numbered(mcs, asked)
    best = _search(stored, False).select("centroid", F.col("nearest").alias("_nearest"))
    nearest = F.when(F.col("_asked"), F.col("_nearest")).alias("nearest")
    return stored.join(best, "centroid", "left").select(*[f"`{c}`" for c in mcs.columns], nearest)


def closest_pair_by_leaf(mcs: DataFrame) -> DataFrame:
    """One row ``d2, pos_a, pos_b`` with pos_a < pos_b; the first pair wins ties."""
    stored = _numbered(mcs.drop("ids"), F.lit(True))
    # Equal centroids are at distance zero: the first two of each.
    equal = stored.groupBy("centroid").agg(F.min("pos").alias("a"), F.count_distinct("pos").alias("n"))
    equal = equal.where("n > 1").select("centroid", "a").join(stored, "centroid").where("pos > a")
    pairs = equal.groupBy("centroid", "a").agg(F.min("pos").alias("b"))
    pairs = pairs.select(F.struct(F.lit(0.0).alias("d2"), F.col("a").alias("pos_a"), F.col("b").alias("pos_b")).alias("p"))
    own = _distinct(stored).select("centroid", F.col("pos").alias("own"))
    apart = _search(stored, True).select("centroid", "nearest").join(own, "centroid").select(
        F.struct(
            F.col("nearest.d2").alias("d2"),
            F.least("own", "nearest.pos").alias("pos_a"),
            F.greatest("own", "nearest.pos").alias("pos_b"),
        ).alias("p")
    )
    return pairs.unionByName(apart).agg(F.min("p").alias("p")).where("p is not null").select("p.*")


def _numbered(mcs: DataFrame, asked: Column) -> DataFrame:
    """The rows that have a centroid, numbered and stored; a missing deviation is infinite."""
    extra = [] if "rmsd" in mcs.columns else [F.lit(float("inf")).alias("rmsd")]
    number = F.monotonically_increasing_id().alias("_rid")
    full = mcs.where(F.col("centroid").isNotNull())
    return _stored(full.select("*", *extra, asked.alias("_asked"), number), "mcs")
