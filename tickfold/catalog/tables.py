"""The given tables as points and micro-clusters."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickfold.functions.pyramid import retained_ticks
from tickfold.operators.features import cumulative, features_of_points, with_rmsd, with_times
from tickfold.plans.history import catalog_of, keep_retained
from tickfold.sources.clock import EventClock
from tickfold.sources.points import read_table_points

CLOCK = EventClock("ts", datetime(2024, 1, 1), timedelta(days=1))
EMBEDDING_DIMS = 64
LINEITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_points(spark, d) -> DataFrame:
    """``point_id, x = [value, hour], tc`` = day, ``mc_id`` = hour, ``event_type``."""
    return read_table_points(
        table(spark, d, "events"),
        ["value", F.hour("ts")],
        "event_id",
        {
            "tc": CLOCK.tick(),
            "mc_id": F.hour("ts").cast("bigint"),
            "event_type": F.col("event_type"),
        },
    )


def event_vectors(events: DataFrame) -> DataFrame:
    """Only what the online model needs of an event."""
    return read_table_points(events, ["value", F.hour("ts")], "event_id")


def embedding_points(spark, d) -> DataFrame:
    """``point_id, x`` (64 dimensions), ``label``."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("point_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        "label",
    )


def lineitem_points(spark, d) -> DataFrame:
    """``x`` = quantity, price, discount, tax, with the two flags. No key, no order."""
    return read_table_points(
        table(spark, d, "lineitem"),
        LINEITEM_COLUMNS,
        F.lit(0),
        {"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus")},
    )


def label_clusters(spark, d) -> DataFrame:
    """One micro-cluster per label of the embeddings, with centroid and rmsd."""
    by_label = features_of_points(embedding_points(spark, d), ["label"], EMBEDDING_DIMS)
    numbered = by_label.withColumn("pos", F.col("label").cast("int"))
    numbered = numbered.withColumn("mc_id", F.col("label").cast("bigint"))
    return with_rmsd(numbered.drop("label"))


def flag_clusters(spark, d) -> DataFrame:
    """One micro-cluster per pair of flags of the line items, in letter order."""
    by_flags = features_of_points(
        lineitem_points(spark, d), ["l_returnflag", "l_linestatus"], len(LINEITEM_COLUMNS)
    )
    pos = F.ascii("l_returnflag") * 128 + F.ascii("l_linestatus")
    return with_rmsd(by_flags.withColumn("pos", pos).withColumn("mc_id", pos.cast("bigint")))


def hourly_deltas(spark, d) -> DataFrame:
    """Features of every hour of the day (``mc_id``) and day (``tc``)."""
    return with_times(features_of_points(event_points(spark, d), ["mc_id", "tc"], 2), "tc")


def daily_snapshots(spark, d) -> tuple[DataFrame, list[int]]:
    """Running hourly micro-clusters after each day, and the days.

    In the second half of the days the afternoon hours have been merged into the
    morning ones, so micro-clusters there carry two ids.
    """
    deltas = hourly_deltas(spark, d)
    ticks = catalog_of(deltas)
    half = ticks[len(ticks) // 2]
    running = cumulative(deltas, ticks, 2)
    merged = F.when(F.col("tc") > half, F.col("mc_id") % 12).otherwise(F.col("mc_id"))
    grouped = running.withColumn("pos", merged.cast("int")).groupBy("tc", "pos").agg(
        F.sort_array(F.collect_list("mc_id")).alias("ids"),
        *[F.sum(c).alias(c) for c in ("n", "cf1t", "cf2t")],
        *[F.expr(f"array(sum({c}[0]), sum({c}[1])) as {c}") for c in ("cf1x", "cf2x")],
    )
    snapshots = grouped.select(
        "tc", "pos", F.col("ids")[0].alias("mc_id"), "n", "cf1x", "cf2x", "cf1t", "cf2t", "ids"
    )
    return snapshots, ticks


def kept_snapshots(spark, d) -> tuple[DataFrame, list[int]]:
    """The daily snapshots a pyramid of alpha 2 and l 1 holds after the last day."""
    snapshots, ticks = daily_snapshots(spark, d)
    kept = keep_retained(snapshots, ticks[-1], 2, 1)
    return kept, retained_ticks(ticks, ticks[-1], 2, 1)
