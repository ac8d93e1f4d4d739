"""Text forms of centers and snapshots, and replay of points as text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickfold.functions import vectors as V

RULE = "=" * 59


def center_line(center: Column, run_num: int) -> Column:
    """``v1,v2,...,vd_run``"""
    return F.concat(V.join_text(center), F.lit(f"_{run_num}"))


def write_centers(centers: DataFrame, path: str, run_num: int) -> None:
    """Centers as text lines below ``path/run=<run>/tc=<tick>``.

    Only the written ticks of that run are replaced, so a repeated write leaves
    no duplicates.
    """
    (
        centers.select(
            center_line(F.col("center"), run_num).alias("value"),
            F.lit(run_num).alias("run"),
            "tc",
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "tc")
        .text(path)
    )


def snapshot_text(mcs: DataFrame) -> DataFrame:
    """One readable block per micro-cluster, in the column ``value``."""

    def bracket(text: Column) -> Column:
        return F.concat(F.lit("["), text, F.lit("]"))

    lines = [
        F.lit(RULE + " "),
        F.concat(F.lit("MicroCluster IDs = "), bracket(V.join_text("ids"))),
        F.concat(F.lit("CF2X = "), bracket(V.join_text("cf2x"))),
        F.concat(F.lit("CF1X = "), bracket(V.join_text("cf1x"))),
        F.concat(F.lit("CF2T = "), F.col("cf2t").cast("string")),
        F.concat(F.lit("CF1T = "), F.col("cf1t").cast("string")),
        F.concat(F.lit("N = "), F.col("n").cast("string")),
    ]
    return mcs.withColumn("value", F.concat_ws("\n", *lines))


def export_snapshots(mcs: DataFrame, path: str, first: int, last: int) -> None:
    """Readable text of the ticks ``first..last``, one folder per tick."""
    (
        snapshot_text(mcs.where(F.col("tc").between(first, last)))
        .select("value", "tc")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("tc")
        .text(path)
    )


def replay_points(points: DataFrame, target: str, options: dict[str, str]) -> None:
    """Send points as comma-separated text records to ``kafka`` or a ``text`` folder."""
    records = points.select(V.join_text("x").alias("value"))
    records.write.format(target).options(**options).mode("append").save()
