"""Streaming k-means with forgetting."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickfold.operators.kmeans import center_sums
from tickfold.plans.initial import WarmCenters, random_warm_centers
from tickfold.plans.ledger import Ledger


class StreamingKMeans:
    """k centers that follow a stream.

    ``half_life`` points (or batches) halve the weight of the past. Centers are
    stored per batch below ``root``; a new instance continues from them.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        k: int = 5,
        dims: int = 34,
        half_life: float = 1000.0,
        per_point: bool = True,
        seed: int = 0,
        initial: np.ndarray | None = None,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.decay = math.exp(math.log(0.5) / half_life)
        self.per_point = per_point
        if initial is None:
            self._first = random_warm_centers(k, dims, 0.0, seed)
        else:
            self._first = WarmCenters(np.asarray(initial, dtype=float), np.zeros(len(initial)))
        self._ledger = Ledger(spark, self.root)
        self._last: tuple[int, WarmCenters, int] | None = None

    def _before(self, batch_id: int) -> tuple[WarmCenters, int]:
        if self._last and self._last[0] < batch_id:
            return self._last[1], self._last[2]
        done = [b for b in self._ledger.ticks_below(f"{self.root}/centers") if b < batch_id]
        if not done:
            return self._first, 0
        rows = self.spark.read.parquet(f"{self.root}/centers/tc={done[-1]}").collect()
        rows = sorted(rows, key=lambda r: r["pos"])
        warm = WarmCenters(
            np.array([r["center"] for r in rows]), np.array([r["weight"] for r in rows])
        )
        return warm, rows[0]["n_total"]

    def update(self, points: DataFrame, batch_id: int) -> WarmCenters:
        """Centers after this batch; an empty one changes nothing."""
        warm, total = self._before(batch_id)
        rows = center_sums(points, warm.centers).collect()
        if not rows:
            return warm
        n = sum(r["n"] for r in rows)
        moved = warm.moved_by(rows, self.decay, self.per_point)
        frame = self.to_frame(moved, total + n)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centers/tc={batch_id}")
        for old in self._ledger.ticks_below(f"{self.root}/centers"):
            if old < batch_id - 1:
                self._ledger.drop(f"{self.root}/centers/tc={old}")
        self._last = (batch_id, moved, total + n)
        return moved

    def to_frame(self, warm: WarmCenters, n_total: int) -> DataFrame:
        rows = [
            (i, [float(v) for v in c], float(w), int(n_total))
            for i, (c, w) in enumerate(zip(warm.centers, warm.weights))
        ]
        return self.spark.createDataFrame(
            rows, "pos int, center array<double>, weight double, n_total bigint"
        )

    def start(self, points: DataFrame, checkpoint: str, trigger: dict | None = None
              ) -> StreamingQuery:
        def fold(batch: DataFrame, batch_id: int) -> None:
            self.update(batch, batch_id)

        writer = points.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
