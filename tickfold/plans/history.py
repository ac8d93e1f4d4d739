"""Questions to the snapshots: as-of ticks, horizons, centers, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickfold.functions.pyramid import retained
from tickfold.operators.features import centroids
from tickfold.operators.lineage import subtract_related

# 8 bytes each. The pyramid keeps about alpha^l ticks per order of magnitude,
# so a catalog of this size stands for far more ticks than a clock can count.
MAX_CATALOG = 1_000_000

# Requests that travel to every task; more meet the snapshots by a shuffle.
MAX_BROADCAST_REQUESTS = 100_000


# Ticks are merged with requests in ranges of 2 ** RANGE_BITS positions; ranges of ranges
# cover all 64-bit ticks in this many levels.
RANGE_BITS = 16
LEVELS = 4


class SnapshotMissing(LookupError):
    """The asked tick has no snapshot."""


def catalog_of(snapshots: DataFrame) -> list[int]:
    """Ticks that have a snapshot, ascending: the partitions, not their rows."""
    rows = snapshots.select("tc").distinct().limit(MAX_CATALOG + 1).collect()
    if len(rows) > MAX_CATALOG:
        raise ValueError("too many snapshots; apply the retention rule first")
    return sorted(r["tc"] for r in rows)


def request_frame(spark: SparkSession, requests: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(requests, "tc bigint, h bigint")


def ticks_of(snapshots: DataFrame) -> DataFrame:
    """Ticks that have a snapshot, as a table ``tc`` of any size."""
    return snapshots.select(F.col("tc").cast("bigint").alias("tc")).where("tc is not null").distinct()


def _latest(asked: DataFrame, known: DataFrame, level: int = 1) -> DataFrame:
    """``at, found``: for every row of ``asked`` (``at``) the last ``value`` of ``known`` up to it.

    Both are merged in order inside ranges of positions, so a group holds at most two rows
    per position. What a range starts with, the last value of the ranges before it, is the
    same question about the numbers of the ranges. ``value`` must not fall with ``at``.
    """
    rows = asked.select("at", F.lit(None).cast("bigint").alias("value"), F.lit(True).alias("ask")).union(
        known.select("at", "value", F.lit(False))
    )
    # A tick comes before the request for its own position.
    if level == LEVELS:
        order = Window.orderBy("at", "ask")
        return rows.withColumn("found", F.last("value", True).over(order)).where("ask").select("at", "found")
    part = F.shiftright("at", RANGE_BITS)
    heads = known.groupBy(part.alias("at")).agg(F.max("value").alias("value"))
    starts = asked.select((part - 1).alias("at")).distinct()
    before = _latest(starts, heads, level + 1).select((F.col("at") + 1).alias("part"), F.col("found").alias("before"))
    order = Window.partitionBy("part").orderBy("at", "ask")
    here = rows.withColumn("part", part).withColumn("found", F.last("value", True).over(order)).where("ask")
    return here.join(before, "part").select("at", F.coalesce("found", "before").alias("found"))


def _with_latest(requests: DataFrame, ticks: DataFrame, limit: Column, name: str) -> DataFrame:
    """Adds the latest tick up to ``limit``, or null. Equal limits are looked up once."""
    placed = requests.withColumn("at", limit.cast("bigint"))
    asked = placed.select("at").where("at is not null").distinct()
    known = ticks.select(F.col("tc").alias("at"), F.col("tc").alias("value"))
    found = _latest(asked, known).withColumnRenamed("found", name)
    return placed.join(found, "at", "left").drop("at")


def as_of(requests: DataFrame, ticks: list[int] | DataFrame) -> DataFrame:
    """Add ``t1, t2`` to requests ``tc, h``.

    ``t1`` is the latest tick up to ``tc`` and ``t2`` the latest up to
    ``t1 - h``, or the earliest one if the history is shorter than that. Both
    are -1 if nothing is as old as ``tc``.

    A list of ticks travels with the plan. A table of ticks (``tc``, see ``ticks_of``) has
    no limit: it is merged with the requests and nothing of it goes to the driver.
    """
    if isinstance(ticks, DataFrame):
        ticks = ticks_of(ticks)
        first = ticks.agg(F.min("tc")).scalar()
        with_t1 = _with_latest(requests, ticks, F.col("tc"), "t1")
        both = _with_latest(with_t1, ticks, F.col("t1") - F.col("h"), "t2")
        t2 = F.coalesce("t2", first)
    else:
        known = F.array(*[F.lit(t).cast("bigint") for t in ticks]).cast("array<bigint>")

        def latest(limit):
            return F.array_max(F.filter(known, lambda t: t <= limit))

        first = F.lit(min(ticks) if ticks else None).cast("bigint")
        both = requests.withColumn("t1", latest(F.col("tc")))
        t2 = F.coalesce(latest(F.col("t1") - F.col("h")), first)
    return both.withColumn("t2", F.when(F.col("t1").isNull(), -1).otherwise(t2).cast("bigint")).withColumn(
        "t1", F.coalesce("t1", F.lit(-1).cast("bigint"))
    )


def snapshot_at(snapshots: DataFrame, tc: int) -> DataFrame:
    """The micro-clusters of exactly that tick."""
    found = snapshots.where(F.col("tc") == tc)
    if found.isEmpty():
        raise SnapshotMissing(f"no snapshot of tick {tc}")
    return found


def horizon(snapshots: DataFrame, requests: DataFrame, ticks: list[int] | DataFrame, dims: int) -> DataFrame:
    """Micro-clusters of the last ``h`` ticks before ``tc``, for all requests at once.

    The snapshot of ``t2`` is subtracted from that of ``t1`` where it is old
    enough; if the history is shorter than the horizon the whole newer snapshot
    is the answer. Columns: ``tc, h, t1, t2`` and those of a snapshot.
    """
    asked = as_of(requests.select("tc", "h").distinct(), ticks)
    if requests.limit(MAX_BROADCAST_REQUESTS + 1).count() <= MAX_BROADCAST_REQUESTS:
        asked = F.broadcast(asked)
    body = [c for c in snapshots.columns if c != "tc"]
    newer = (
        asked.withColumnRenamed("tc", "at")
        .join(snapshots.select(F.col("tc").alias("t1"), *body), "t1")
        .select(F.col("at").alias("tc"), "h", "t1", "t2", *body)
    )
    older = (
        asked.where("t1 - h >= t2 and t1 >= 0")
        .withColumnRenamed("tc", "at")
        .join(snapshots.select(F.col("tc").alias("t2"), *body), "t2")
        .select(F.col("at").alias("tc"), "h", *body)
    )
    return subtract_related(newer, older, ["tc", "h"], dims)


def centers_at(snapshots: DataFrame, tc: int) -> DataFrame:
    """Centers of the snapshot of one tick: ``tc, pos, center``."""
    return _centers(snapshot_at(snapshots, tc), ["tc", "pos"])


def horizon_centers(
    snapshots: DataFrame, requests: DataFrame, ticks: list[int] | DataFrame, dims: int
) -> DataFrame:
    """Centers of the horizons: ``tc, h, pos, center``."""
    return _centers(horizon(snapshots, requests, ticks, dims), ["tc", "h", "pos"])


def _centers(mcs: DataFrame, keys: list[str]) -> DataFrame:
    return centroids(mcs).select(*keys, F.col("centroid").alias("center"))


def keep_retained(snapshots: DataFrame, now: int, alpha: int, l: int) -> DataFrame:  # noqa: E741
    """Snapshots the pyramidal time frame still holds at tick ``now``."""
    return snapshots.where(retained(F.col("tc"), now, alpha, l))


def keep_unexpired(snapshots: DataFrame, now: int, window_time: int) -> DataFrame:
    """Snapshots inside the window that ends at ``now``."""
    return snapshots.where(F.col("tc") >= now - window_time + 1)


def horizon_report(
    snapshots: DataFrame, requests: DataFrame, ticks: list[int] | DataFrame, dims: int
) -> DataFrame:
    """Non-empty micro-clusters and points in each asked horizon."""
    return (
        horizon(snapshots, requests, ticks, dims)
        .groupBy("tc", "h", "t1", "t2")
        .agg(
            F.count(F.when(F.col("n") > 0, 1)).alias("mc_count"),
            F.sum("n").alias("n_points"),
        )
    )
