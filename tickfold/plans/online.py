"""The online model: one call of ``step`` per batch, state kept in a ledger."""

from __future__ import annotations

import time

import numpy as np
from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tickfold.config import ModelConfig, run_dir
from tickfold.operators.absorb import absorb, left_over, partial_sums
from tickfold.operators.cells import cell_width, group_outliers
from tickfold.operators.features import sum_features
from tickfold.operators.lineage import subtract_related
from tickfold.operators.nearest import Model
from tickfold.operators.scaling import moments, project, standardize_with
from tickfold.plans import initial
from tickfold.plans.ledger import Ledger
from tickfold.plans.settle import (
    DELTA_STAGE,
    OUTLIER_STAGE,
    STATE_STAGE,
    Rule,
    desk_rows,
    refresh,
    settle,
)
from tickfold.sources.points import read_text_points, reject_reason

class OnlineModel:
    """Micro-clusters of a stream.

    Every non-empty batch is one tick of the clock, or, where batches are cut by event
    time, a part of one. All of the state is in the
    ledger below ``root``; an instance only remembers the last commit record, so
    a new one continues where the ledger ends.
    """

    def __init__(
        self,
        spark: SparkSession,
        config: ModelConfig,
        root: str | None = None,
        projection: PCAModel | None = None,
    ):
        """``projection`` takes the scaled points to ``config.dims`` principal axes."""
        self.spark = spark
        self.config = config
        self.projection = projection
        self.input_dims = projection.pc.numRows if projection else config.dims
        self.ledger = Ledger(spark, root or run_dir(spark, "model"))
        self._last: tuple[Row, Model | None] | None = None

    # -- state ---------------------------------------------------------------

    @property
    def meta(self) -> Row | None:
        """Commit record of the newest tick."""
        return self._last[0] if self._last else self.ledger.latest()

    @property
    def current_time(self) -> int:
        return self.meta["tc"] if self.meta else 0

    @property
    def total_points(self) -> int:
        return self.meta["n_total"] if self.meta else 0

    def micro_clusters(self) -> DataFrame:
        meta = self.meta
        return self.ledger.state(meta["tc"], meta["part"])

    def batch_delta(self) -> DataFrame:
        """What the newest step alone brought."""
        meta = self.meta
        return self.ledger.delta(meta["tc"], meta["part"])

    def _before(self, batch_id: int, source: str) -> tuple[Row | None, Model | None]:
        last = self._last and self._last[0]
        if last and (last["source"] != source or last["batch_id"] < batch_id):
            return self._last
        meta = self.ledger.last_before(batch_id, source)
        if meta is None:
            return None, None
        return meta, self.ledger.model(meta["tc"], meta["part"])[0] if meta["initialized"] else None

    # -- one tick ------------------------------------------------------------

    def step(
        self, points: DataFrame, batch_id: int, tick: int | None = None, source: str = ""
    ) -> Row | None:
        """Fold one batch of points ``x`` into the model; None if it is empty.

        Outliers are placed in the order of ``point_id``; without that column, in
        reading order.
        Calling again with the same ``source`` and ``batch_id`` repeats the step from
        the state before it and replaces what was written; a batch of another source
        follows the newest step.

        ``tick`` is the event time of the batch. The clock moves there, but never back:
        a batch that comes late, or that belongs to the current tick, is one more part of
        that. Points may carry an event time ``tc`` of their own, by which late ones are
        counted. The record says how many points were late (``n_late``) and how many were
        unusable and left out (``n_rejected``).
        """
        cfg, began = self.config, time.perf_counter()
        meta, model = self._before(batch_id, source)
        now = meta["tc"] if meta else 0
        tc = now + 1 if tick is None else max(now, tick)
        part = meta["part"] + 1 if meta and tc == now else 0
        if "point_id" not in points.columns:
            points = points.withColumn("point_id", F.monotonically_increasing_id())
        bad = reject_reason(self.input_dims).isNotNull()
        late = F.col("tc") < tc if "tc" in points.columns else F.lit(tick is not None and tick < tc)
        # Counted by the first pass over the batch, whichever that is.
        seen = Observation()
        points = points.observe(
            seen,
            F.count(F.when(bad, 1)).alias("n_rejected"),
            F.count(F.when(~bad & late, 1)).alias("n_late"),
        )
        points = points.where(~bad).select("point_id", "x")
        n, mu, sd = self._scale(points, meta)
        if n == 0:
            return None
        context = {
            "tc": tc,
            "part": part,
            "batch_id": batch_id,
            "source": source,
            "mu": None if mu is None else [float(v) for v in mu],
            "sd": None if sd is None else [float(v) for v in sd],
        }
        if self.projection is not None:
            if mu is not None:
                points, mu, sd = standardize_with(points, mu, sd), None, None
            points = project(points, self.projection)
        if model is None:
            if mu is not None:
                points = standardize_with(points, mu, sd)
            done = self._initialize(points, n, meta, context)
        else:
            done = self._maintain(points, mu, sd, meta, model, context)
        if done is None:
            return None
        model, done["next_id"] = self.ledger.model(tc, part) if done["initialized"] else (None, 0)
        row = self.ledger.commit({**done, **seen.get, "ms": int(1000 * (time.perf_counter() - began))})
        self._last = (row, model)
        self.ledger.prune(tc, cfg.alpha, cfg.l, cfg.window_time)
        return row

    def _scale(self, points, meta):
        """Moments to standardise by; the count is None where no pass was needed."""
        cfg = self.config
        if cfg.scaling == "none":
            return None, None, None
        if cfg.scaling == "fixed" and meta and meta["mu"]:
            return None, np.array(meta["mu"]), np.array(meta["sd"])
        return moments(points, self.input_dims)

    def _maintain(self, points, mu, sd, meta, model, context) -> dict | None:
        cfg, tc = self.config, context["tc"]
        state = self.ledger.state(meta["tc"], meta["part"])
        state, model = self._without_expired(state, model, meta["tc"], tc)

        grouped = cfg.outliers == "partitioned"
        work = absorb(points, model, cfg.t_factor, mu, sd)
        # Read twice below, and the batch is not to be assigned twice. If an
        # executor is lost, its part is computed again from the source.
        work = work.persist()
        try:
            size = work.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                F.coalesce(F.sum(F.when(F.col("pos").isNull(), F.col("n"))), F.lit(0)).alias("out"),
                F.count(F.when(F.col("pos").isNull(), 1)).alias("out_rows"),
                F.count("*").alias("rows"),
            ).first()
            if size["n"] == 0:
                return None
            desk = desk_rows(state, STATE_STAGE, next_id=meta["next_id"])
            if grouped:
                # What one task places is bounded by the settings, not by the batch.
                desk = desk.union(desk_rows(partial_sums(work, cfg.dims), DELTA_STAGE))
                scratch = f"{self.ledger.root}/scratch/tc={tc}"
                if size["out_rows"]:
                    width = cell_width(model.rmsd, cfg.dims, cfg.t_factor)
                    groups, _ = group_outliers(left_over(work), width, cfg.dims, cfg.max_groups, scratch)
                    desk = desk.unionByName(desk_rows(groups, OUTLIER_STAGE))
                self._write(settle(desk, self._rule(tc)), context)
                self.ledger.drop(scratch)
            elif size["rows"] <= cfg.chunk_rows:
                # Few enough for one task as they are: no need to add them up first.
                stage = f"if(pos is null, {OUTLIER_STAGE}, {DELTA_STAGE})"
                self._write(settle(desk.union(desk_rows(work, stage)), self._rule(tc)), context)
            else:
                desk = desk.union(desk_rows(partial_sums(work, cfg.dims), DELTA_STAGE))
                self._settle(desk, left_over(work), size["out_rows"], context)
        finally:
            work.unpersist()
            state.unpersist()
        return self._record(context, meta, size["n"], size["out"], True)

    def _without_expired(self, state, model, before, tc):
        """Take the ticks that leave the sliding window out of the model.

        Usually that is one; after a gap in time it may be several or none.
        """
        cfg = self.config
        if not cfg.remove_expired:
            return state, model
        edge = 1 - cfg.window_time
        expired = [t for t in self.ledger.ticks("delta") if before + edge < t <= tc + edge]
        if not expired:
            return state, model
        deltas = self.ledger.snapshots("delta").where(F.col("tc").isin(expired))
        gone = sum_features(deltas, ["mc_id"], cfg.dims)
        gone = gone.withColumn("pos", F.col("mc_id")).withColumn("ids", F.array("mc_id"))
        state = refresh(subtract_related(state, gone, [], cfg.dims, drop_ids=False)).persist()
        rows = state.select("pos", "mc_id", "centroid", "rmsd").collect()
        return state, Model.of_rows(rows)

    def _settle(self, desk, outliers, rows, context):
        """Place the outliers, at most ``chunk_rows`` of them in one task."""
        tc = context["tc"]
        rule = self._rule(tc)
        chunks = max(1, -(-rows // self.config.chunk_rows))
        if chunks == 1:
            full = desk.unionByName(desk_rows(outliers, OUTLIER_STAGE)) if rows else desk
            self._write(settle(full, rule), context)
            return
        # More than one task should take: cut them in order and hand the slots
        # on from chunk to chunk. Same result, as placing is a fold.
        scratch = f"{self.ledger.root}/scratch/tc={tc}"
        (
            outliers.repartitionByRange(chunks, "point_id")
            .withColumn("chunk", F.spark_partition_id())
            .write.mode("overwrite")
            .partitionBy("chunk")
            .parquet(f"{scratch}/outliers")
        )
        stored = self.spark.read.parquet(f"{scratch}/outliers")
        for chunk in range(chunks):
            rest = stored.where(F.col("chunk") == chunk)
            full = desk.unionByName(desk_rows(rest, OUTLIER_STAGE))
            last = chunk == chunks - 1
            done = settle(full, rule, last)
            if last:
                self._write(done, context)
            else:
                done.write.mode("overwrite").parquet(f"{scratch}/desk-{chunk}")
                desk = self.spark.read.parquet(f"{scratch}/desk-{chunk}")
        self.ledger.drop(scratch)

    def _rule(self, tc: int) -> Rule:
        cfg = self.config
        return Rule(tc, cfg.t_factor, cfg.recursive_outliers, cfg.m_last_points, cfg.delta)

    def _write(self, done: DataFrame, context: dict) -> None:
        kind = F.when(F.col("stage") == STATE_STAGE, "state").otherwise("delta")
        self.ledger.write(
            done.select(
                "pos", "mc_id", "n", "cf1x", "cf2x", "cf1t", "cf2t", "ids", "centroid",
                "rmsd", "next_id", kind.alias("kind"),
                F.lit(context["tc"]).cast("bigint").alias("tc"),
                F.lit(context["part"]).cast("bigint").alias("part"),
            )
        )

    def _record(self, context, meta, n_batch, n_outliers, initialized) -> dict:
        return {
            **context,
            "n_batch": int(n_batch),
            "n_total": int(n_batch) + (meta["n_total"] if meta else 0),
            "n_outliers": int(n_outliers),
            "initialized": initialized,
        }

    # -- first ticks ---------------------------------------------------------

    def _initialize(self, points, n, meta, context) -> dict | None:
        cfg, tc = self.config, context["tc"]
        mode = cfg.init_mode
        seen = meta["n_total"] if meta else 0
        if mode == "kmeans":
            points = self._buffered(points, context)
            total = points.count()
            n_batch = total - seen
        else:
            n_batch = points.count() if n is None else n
            total = seen + n_batch
        if n_batch == 0:
            return None

        if mode == "random":
            centers = initial.random_centers(cfg.q, cfg.dims, cfg.seed)
        elif mode == "kmeans":
            if total < cfg.min_init_points:
                return self._record(context, meta, n_batch, 0, False)
            centers = initial.kmeans_centers(points, cfg)
        else:
            centers = self._warm_centers(points, meta, context)
            # Only this batch is assigned, so it must be large enough by itself.
            if n_batch < cfg.min_init_points:
                return self._record(context, meta, n_batch, 0, False)
        self._found_model(points, centers, context)
        return self._record(context, meta, n_batch, 0, True)

    def _buffered(self, points, context) -> DataFrame:
        """Points of all steps so far, this one stored first."""
        tc, part, root = context["tc"], context["part"], self.ledger.path("buffer")
        points.select("point_id", "x").write.mode("overwrite").parquet(f"{root}/tc={tc}/part={part}")
        stored = self.spark.read.schema("point_id bigint, x array<double>, tc bigint, part bigint")
        upto = (F.col("tc") < tc) | ((F.col("tc") == tc) & (F.col("part") <= part))
        return stored.parquet(root).where(upto)

    def _warm_centers(self, points, meta, context) -> np.ndarray:
        """Move the provisional centers of a streaming k-means by this batch."""
        cfg = self.config
        root = self.ledger.path("warm")
        if meta is None:
            warm = initial.cold_centers(cfg)
        else:
            rows = self.spark.read.parquet(f"{root}/tc={meta['tc']}/part={meta['part']}").orderBy("pos").collect()
            warm = initial.WarmCenters(
                np.array([r["center"] for r in rows]), np.array([r["weight"] for r in rows])
            )
        warm = warm.moved(points)
        table = [(i, [float(v) for v in c], float(w))
                 for i, (c, w) in enumerate(zip(warm.centers, warm.weights))]
        frame = self.spark.createDataFrame(table, "pos int, center array<double>, weight double")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{root}/tc={context['tc']}/part={context['part']}")
        return warm.centers

    def _found_model(self, points, centers, context) -> None:
        """First micro-clusters: one per center, with the points nearest to it."""
        cfg = self.config
        arrived = partial_sums(absorb(points, Model.of_centers(centers)), cfg.dims)
        rows = [(i, i, [float(v) for v in c]) for i, c in enumerate(centers)]
        empty = self.spark.createDataFrame(rows, "pos int, mc_id bigint, centroid array<double>")
        zeros = f"array_repeat(0D, {cfg.dims})"
        empty = empty.selectExpr(
            "*", "0 as n", "0 as cf1t", "0 as cf2t", f"{zeros} as cf1x", f"{zeros} as cf2x",
            "array(mc_id) as ids", "0 as rmsd",
        )
        desk = desk_rows(empty, STATE_STAGE, next_id=cfg.q).unionByName(
            desk_rows(arrived, DELTA_STAGE)
        )
        self._write(settle(desk, self._rule(context["tc"])), context)


def initialize_from(model: OnlineModel, points: DataFrame) -> bool:
    """Start a model from stored points instead of the stream, as tick 1.

    True once the model is initialised; false if there were too few points, which
    then stay buffered.
    """
    row = model.step(points, batch_id=0, source="stored points")
    return bool(row and row["initialized"])


def initialize_from_file(model: OnlineModel, path: str, sep: str = ",") -> bool:
    """As ``initialize_from``, with points of a text file or folder; false if it is absent."""
    if not model.ledger.exists(path):
        return False
    return initialize_from(model, read_text_points(model.spark, path, sep))
