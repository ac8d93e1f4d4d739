"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickfold.catalog import tables as T
from tickfold.config import ModelConfig, run_dir
from tickfold.functions import stats
from tickfold.functions import vectors as V
from tickfold.functions.pyramid import order_of, retained
from tickfold.operators import features as feat
from tickfold.operators import kmeans, nearest, sampling, scaling
from tickfold.operators.absorb import absorb, left_over, partial_sums
from tickfold.operators.cells import cell_width, group_outliers
from tickfold.operators.lineage import lineage, subtract_related
from tickfold.plans import history, macro
from tickfold.plans.initial import WarmCenters, random_centers
from tickfold.plans.online import OnlineModel, initialize_from_file
from tickfold.plans.settle import (
    DELTA_STAGE,
    OUTLIER_STAGE,
    STATE_STAGE,
    Rule,
    desk_rows,
    settle,
)
from tickfold.sources import exports
from tickfold.sources import points as src
from tickfold.streaming import runner
from tickfold.streaming.kmeans import StreamingKMeans

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r(c, digits: int = 6) -> Column:
    """Rounded for comparison, shifted off exact ties, which engines round differently.

    Adding zero turns -0.0 into 0.0.
    """
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value + F.lit(3.1 * 10.0 ** -(digits + 2)), digits) + F.lit(0.0)


def flat(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Two-dimensional features as plain columns."""
    return df.select(
        *keys,
        "n",
        r(F.col("cf1x")[0], digits).alias("s1_0"),
        r(F.col("cf1x")[1], digits).alias("s1_1"),
        r(F.col("cf2x")[0], digits).alias("s2_0"),
        r(F.col("cf2x")[1], digits).alias("s2_1"),
        *[c for c in ("cf1t", "cf2t") if c in df.columns],
    )


def long_vector(df: DataFrame, *keys: str, vector: str = "centroid") -> DataFrame:
    rows = df.select(*keys, F.posexplode(vector).alias("dim", "value"))
    return rows.withColumn("value", r("value"))


def frame_of(spark, centers) -> DataFrame:
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


# -- sources and parsing ------------------------------------------------------


@query
def parse_points(spark: SparkSession, d: str) -> DataFrame:
    p = T.event_points(spark, d)
    lines = p.select("point_id", F.concat(V.join_text("x"), F.lit("\n")).alias("value"))
    parsed = src.valid_points(src.points_of_lines(lines), 2)
    return long_vector(parsed, "point_id", vector="x")


@query
def drop_label(spark, d):
    p = T.embedding_points(spark, d)
    text = F.concat_ws(" ", V.join_text("x", " "), F.col("label").cast("string"))
    parsed = src.points_of_lines(p.select(text.alias("value")), " ", label_last=True)
    parsed = src.valid_points(parsed, T.EMBEDDING_DIMS)
    long = parsed.select("label", F.posexplode("x").alias("dim", "v"))
    sums = long.groupBy(F.col("label").cast("int").alias("label"), "dim")
    return sums.agg(F.count("*").alias("n"), r(F.sum("v")).alias("total"))


@query
def parse_rejects(spark, d):
    p = T.event_points(spark, d)
    value = F.col("x")[0].cast("string")
    line = (
        F.when(F.col("event_type") == "error", F.concat_ws(",", value, "event_type"))
        .when(F.col("event_type") == "view", value)
        .otherwise(V.join_text("x"))
    )
    parsed = src.points_of_lines(p.select("point_id", line.alias("value")))
    reason = F.coalesce(src.reject_reason(2), F.lit("accepted"))
    return parsed.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query
def text_round_trip(spark, d):
    path = run_dir(spark, "text")
    exports.replay_points(T.event_points(spark, d), "text", {"path": path})
    back = src.valid_points(src.read_text_points(spark, path), 2)
    a, b = F.col("x")[0], F.col("x")[1]
    return back.agg(
        F.count("*").alias("n"), r(F.sum(a), 4).alias("a"), r(F.sum(b), 4).alias("b"),
        r(F.sum(a * b), 4).alias("ab"),
    )


@query
def replay_points(spark, d):
    path = run_dir(spark, "replay")
    exports.replay_points(T.lineitem_points(spark, d), "text", {"path": path})
    back = src.valid_points(src.read_text_points(spark, path), 4)
    return back.agg(
        F.count("*").alias("n"),
        *[r(F.sum(F.col("x")[i]), 2).alias(f"s{i}") for i in range(4)],
    )


# -- scaling ------------------------------------------------------------------


@query
def standardize_batch(spark, d):
    z = scaling.standardize(T.event_points(spark, d), "tc", 2)
    return z.select("point_id", "tc", r(F.col("x")[0]).alias("z0"), r(F.col("x")[1]).alias("z1"))


@query
def standardize_lineitem(spark, d):
    p = T.lineitem_points(spark, d)
    _, mu, sd = scaling.moments(p, 4)
    z = scaling.standardize_with(p, mu, sd)
    return z.groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        *[r(F.avg(F.col("x")[i])).alias(f"z{i}") for i in range(4)],
        *[r(F.max(F.col("x")[i])).alias(f"top{i}") for i in range(4)],
    )


@query
def pca_project(spark, d):
    p = T.embedding_points(spark, d)
    out = scaling.project(p, scaling.fit_projection(p, 3))
    return out.select(
        "point_id", *[r(F.abs(F.col("x")[i]), 4).alias(f"axis{i}") for i in range(3)]
    )


@query
def pca_rotation(spark, d):
    """All principal axes: a rotation, which keeps every length."""
    p = T.embedding_points(spark, d)
    out = scaling.project(p, scaling.fit_projection(p, T.EMBEDDING_DIMS))
    return out.select("point_id", r(V.squared_norm("x")).alias("norm2"))


# -- assignment ---------------------------------------------------------------


def _assigned(spark, d, t_factor=1.0):
    found = nearest.nearest(T.embedding_points(spark, d), T.label_clusters(spark, d))
    return nearest.classify(found, t_factor)


@query
def assign_nearest(spark, d):
    return _assigned(spark, d).select(
        "point_id", F.col("nearest.mc_id").alias("mc_id"), r("nearest.d2").alias("d2")
    )


@query
def classify_boundary(spark, d):
    return _assigned(spark, d).select(
        "point_id", F.col("nearest.mc_id").alias("mc_id"), "inside", r("dist").alias("dist")
    )


@query
def inliers_only(spark, d):
    return nearest.inliers(_assigned(spark, d)).select(
        "point_id", F.col("nearest.mc_id").alias("mc_id")
    )


@query
def outliers_only(spark, d):
    return nearest.outliers(_assigned(spark, d)).select("point_id", r("dist").alias("dist"))


@query
def assign_totals(spark, d):
    found = nearest.nearest(T.lineitem_points(spark, d), T.flag_clusters(spark, d))
    return found.groupBy(F.col("nearest.pos").alias("pos")).agg(
        F.count("*").alias("n"), r(F.sum("nearest.d2") / 1e6, 2).alias("d2_millions")
    )


@query
def absorb_batch(spark, d):
    """The single pass of the online step: sums of inliers, count of outliers."""
    model = nearest.whole_model(T.label_clusters(spark, d))
    work = absorb(T.embedding_points(spark, d), model, t_factor=1.0)
    kept = partial_sums(work, T.EMBEDDING_DIMS).select(
        "pos", "n", r(V.total("cf1x")).alias("s1"), r(V.total("cf2x")).alias("s2")
    )
    out = left_over(work).agg(
        F.lit(-1).alias("pos"), F.count("*").alias("n"),
        r(F.sum(V.total("cf1x"))).alias("s1"),
        r(F.sum(V.squared_norm("cf1x"))).alias("s2"),
    )
    return kept.unionByName(out)


# -- cluster features ---------------------------------------------------------


@query
def cf_by_cluster(spark, d):
    f = feat.features_of_points(T.event_points(spark, d), ["event_type", "tc"], 2)
    return flat(f, "event_type", "tc")


@query
def cf_by_label(spark, d):
    f = feat.features_of_points(T.embedding_points(spark, d), ["label"], T.EMBEDDING_DIMS)
    both = F.arrays_zip("cf1x", "cf2x")
    long = f.select("label", "n", F.posexplode(both).alias("dim", "v"))
    return long.select(
        "label", "n", "dim", r("v.cf1x").alias("s1"), r("v.cf2x").alias("s2")
    )


@query
def cf_lineitem(spark, d):
    f = feat.features_of_points(
        T.lineitem_points(spark, d), ["l_returnflag", "l_linestatus"], 4
    )
    return f.select(
        "l_returnflag", "l_linestatus", "n",
        *[r(F.col("cf1x")[i], 2).alias(f"s1_{i}") for i in range(4)],
        # Sums of squares for each point, as the sums have more digits than a double.
        *[r(F.col("cf2x")[i] / F.col("n"), 1).alias(f"m2_{i}") for i in range(4)],
    )


@query
def cf_time_features(spark, d):
    return T.hourly_deltas(spark, d).select("mc_id", "tc", "n", "cf1t", "cf2t")


@query
def batch_totals(spark, d):
    return feat.batch_totals(T.event_points(spark, d))


@query
def centroids(spark, d):
    return long_vector(feat.centroids(T.label_clusters(spark, d)), "mc_id")


@query
def mc_weights(spark, d):
    w = feat.weights(T.label_clusters(spark, d))
    return w.select("mc_id", "n", r("weight").alias("weight"))


def _fine_clusters(spark, d):
    """Micro-clusters of ten minutes: many of a single point. Values in cents."""
    events = T.table(spark, d, "events")
    minute = F.hour("ts") * 60 + F.minute("ts")
    p = src.read_table_points(
        events,
        [F.round(F.col("value") * 100), F.hour("ts")],
        "event_id",
        {"pos": ((T.CLOCK.tick() - 1) * 144 + F.floor(minute / 10)).cast("int")},
    )
    f = feat.features_of_points(p, ["pos"], 2)
    return feat.with_rmsd(f.withColumn("mc_id", F.col("pos").cast("bigint")))


@query
def mc_rmsd(spark, d):
    return _fine_clusters(spark, d).select("pos", "n", r("rmsd", 4).alias("rmsd"))


@query
def mc_rmsd_by_label(spark, d):
    return T.label_clusters(spark, d).select("mc_id", "n", r("rmsd").alias("rmsd"))


@query
def nearest_other(spark, d):
    found = nearest.nearest_other(T.label_clusters(spark, d))
    return found.select(
        "pos", F.col("nearest.pos").alias("other"), r("nearest.d2").alias("d2")
    )


@query
def closest_pair(spark, d):
    pair = nearest.closest_pair(T.label_clusters(spark, d))
    return pair.select("pos_a", "pos_b", r("d2").alias("d2"))


@query
def distance_to_mean(spark, d):
    """From each micro-cluster to the mean of all points."""
    mcs = T.label_clusters(spark, d)
    everything = feat.features_of_points(T.embedding_points(spark, d), [], T.EMBEDDING_DIMS)
    mean = everything.select(feat.centroid_of(F.col("n"), F.col("cf1x"))).first()[0]
    found = feat.squared_distance_to(mcs, V.literal(mean))
    return found.select("mc_id", r("d2").alias("d2"))


@query
def slot_lookup(spark, d):
    """Slot of each part key among the labels; most are no label."""
    asked = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("mc_id")).distinct()
    return feat.slots_of(T.label_clusters(spark, d), asked).select("mc_id", "pos")


@query
def merge_closest(spark, d):
    mcs = T.label_clusters(spark, d)
    pair = nearest.closest_pair(mcs)
    mcs = feat.with_times(mcs.withColumn("ids", F.array("mc_id")), 1)
    merged = feat.merge_pair(mcs, pair, T.EMBEDDING_DIMS)
    return merged.select(
        "pos", "mc_id", "n", V.join_text("ids").alias("ids"), "cf1t",
        r(V.total("cf1x")).alias("s1"), r(V.total("cf2x")).alias("s2"),
    )


def _last_tick(deltas):
    return deltas.agg(F.max("tc")).scalar()


@query
def state_update(spark, d):
    """All days but the last as the state, the last day as the batch."""
    deltas = T.hourly_deltas(spark, d)
    last = _last_tick(deltas)
    state = feat.sum_features(deltas.where(F.col("tc") < last), ["mc_id"], 2)
    return flat(feat.update_state(state, deltas.where(F.col("tc") == last)), "mc_id", digits=4)


@query
def stale_split(spark, d):
    """Mean arrival time of each user's events, and whether it is ten days old."""
    return _stamps(spark, d, 1_000_000)


@query
def stale_split_quantile(spark, d):
    """As ``stale_split``, by the arrival of the third newest event."""
    return _stamps(spark, d, 3)


def _stamps(spark, d, m):
    events = T.table(spark, d, "events")
    per_tick = events.groupBy("user_id", T.CLOCK.tick().alias("tc"))
    deltas = feat.with_times(per_tick.agg(F.count("*").alias("n")), "tc")
    mcs = deltas.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("n", "cf1t", "cf2t")])
    stamp = stats.recency_stamp(F.col("n"), F.col("cf1t"), F.col("cf2t"), m)
    mcs = mcs.withColumn("stamp", stamp)
    now = mcs.agg(F.max("stamp")).scalar()
    stale = (F.col("n") == 0) | (F.col("stamp") < now - 10)
    return mcs.select(
        "user_id", "n", r("stamp", 4).alias("stamp"), stale.cast("int").alias("stale")
    )


# -- snapshots and horizons ---------------------------------------------------


@query
def cumulative_snapshots(spark, d):
    deltas = T.hourly_deltas(spark, d)
    running = feat.cumulative(deltas, history.catalog_of(deltas), 2)
    return flat(running, "mc_id", "tc", digits=4)


@query
def pyramid_retention(spark, d):
    """For every day as "now": which days still have their snapshot."""
    ticks = T.event_points(spark, d).select("tc").distinct()
    now = F.explode(F.sequence("tc", F.lit(history.catalog_of(ticks)[-1]))).alias("now")
    pairs = ticks.select("tc", now)
    return pairs.select(
        "now", "tc", order_of(F.col("tc"), 2).alias("tick_order"),
        retained(F.col("tc"), F.col("now"), 2, 1).cast("int").alias("kept"),
    )


def _requests(spark, ticks):
    asked = [(tc, h) for tc in ticks for h in (1, 6, 12)]
    return history.request_frame(spark, asked)


@query
def asof_snapshots(spark, d):
    snapshots, _ = T.kept_snapshots(spark, d)
    every_day = history.catalog_of(T.event_points(spark, d))
    return history.as_of(_requests(spark, every_day), history.ticks_of(snapshots))


@query
def lineage_join(spark, d):
    snapshots, ticks = T.daily_snapshots(spark, d)
    newer = snapshots.where(F.col("tc") > ticks[0]).withColumn("first_tc", F.lit(ticks[0]))
    older = snapshots.where(F.col("tc") == ticks[0]).withColumn("first_tc", F.lit(ticks[0]))
    # Every later day against the first one.
    newer = newer.withColumn("pos", (F.col("tc") * 100 + F.col("pos")).cast("int"))
    pairs = lineage(newer, older, ["first_tc"])
    return pairs.select(
        F.floor(F.col("pos") / 100).alias("tc"), (F.col("pos") % 100).alias("pos"), "old_pos"
    )


def _horizons(spark, d):
    kept, ticks = T.kept_snapshots(spark, d)
    every_day = history.catalog_of(T.event_points(spark, d))
    asked = _requests(spark, [t for t in every_day if t >= ticks[0]])
    return kept, asked, ticks


@query
def horizon_subtract(spark, d):
    kept, asked, ticks = _horizons(spark, d)
    h = history.horizon(kept, asked, ticks, 2)
    out = flat(h.withColumn("ids", V.join_text("ids")), "tc", "h", "t1", "t2", "pos", "ids",
               digits=4)
    return out


@query
def horizon_centers(spark, d):
    kept, asked, ticks = _horizons(spark, d)
    c = history.horizon_centers(kept, asked, ticks, 2)
    return c.select(
        "tc", "h", "pos", r(F.col("center")[0], 4).alias("c0"), r(F.col("center")[1], 4).alias("c1")
    )


@query
def horizon_report(spark, d):
    kept, asked, ticks = _horizons(spark, d)
    return history.horizon_report(kept, asked, ticks, 2)


@query
def snapshot_centers(spark, d):
    snapshots, ticks = T.daily_snapshots(spark, d)
    return long_vector(history.centers_at(snapshots, ticks[-1]), "tc", "pos", vector="center")


@query
def sliding_remove(spark, d):
    """The newest state without the day that leaves a window of six."""
    snapshots, ticks = T.daily_snapshots(spark, d)
    expired = ticks[-1] + 1 - 6
    state = history.snapshot_at(snapshots, ticks[-1])
    gone = T.hourly_deltas(spark, d).where(F.col("tc") == expired)
    gone = gone.withColumn("pos", F.col("mc_id").cast("int")).withColumn("ids", F.array("mc_id"))
    left = feat.with_rmsd(subtract_related(state, gone, [], 2, drop_ids=False))
    return left.select(
        "pos", "n", "cf1t", "cf2t",
        *[r(F.col(f"cf{j}x")[i], 4).alias(f"s{j}_{i}") for j in (1, 2) for i in (0, 1)],
        r("rmsd", 4).alias("rmsd"),
    )


@query
def expire_snapshots(spark, d):
    snapshots, ticks = T.daily_snapshots(spark, d)
    kept = history.keep_unexpired(snapshots, ticks[-1], 6)
    return kept.groupBy("tc").agg(F.count("*").alias("mcs"), F.sum("n").alias("n"))


# -- text exports -------------------------------------------------------------


@query
def centers_text(spark, d):
    snapshots, ticks = T.daily_snapshots(spark, d)
    path = run_dir(spark, "centers")
    centers = feat.centroids(snapshots).select("tc", F.col("centroid").alias("center"))
    exports.write_centers(centers, path, run_num=1)
    stored = spark.read.text(path)
    parts = F.split("value", "[,_]")
    return stored.select(
        F.col("tc").cast("bigint").alias("tc"), F.col("run").cast("int").alias("run"),
        r(parts[0].cast("double")).alias("c0"), r(parts[1].cast("double")).alias("c1"),
        parts[2].cast("int").alias("run_suffix"),
    )


@query
def snapshot_text(spark, d):
    """Ids, time features and count as they stand in the exported text."""
    snapshots, ticks = T.daily_snapshots(spark, d)
    path = run_dir(spark, "snapshot-text")
    exports.export_snapshots(snapshots, path, ticks[0], ticks[-1])
    lines = spark.read.text(path)
    kind = F.split("value", " = ")
    return lines.where(F.col("value").rlike("^(MicroCluster IDs|CF2T|CF1T|N) = ")).select(
        F.col("tc").cast("bigint").alias("tc"), kind[0].alias("field"), kind[1].alias("content")
    )


# -- k-means parts ------------------------------------------------------------


def _label_centers(spark, d):
    return nearest.whole_model(T.label_clusters(spark, d)).centroid


@query
def wssse(spark, d):
    cost = kmeans.wssse(T.embedding_points(spark, d), T.label_clusters(spark, d))
    return cost.select(r("wssse").alias("wssse"))


@query
def lloyd_step(spark, d):
    centers = _label_centers(spark, d)
    sums = kmeans.center_sums(T.embedding_points(spark, d), centers)
    moved = sums.withColumn("centroid", feat.centroid_of(F.col("n"), F.col("cf1x")))
    return long_vector(moved, "pos", "n")


@query
def lloyd_iterations(spark, d):
    """Three rounds from the label centroids."""
    p = T.embedding_points(spark, d).persist()
    centers = kmeans.lloyd(p, _label_centers(spark, d), 3, tol=0.0)
    p.unpersist()
    return long_vector(frame_of(spark, centers), "cluster", vector="center")


def _quarter_centers(points):
    """Starting centers: mean value and hour in each quarter of the day."""
    by_quarter = points.groupBy(F.floor(F.col("x")[1] / 6).alias("quarter"))
    rows = by_quarter.agg(*[F.avg(F.col("x")[i]).alias(f"c{i}") for i in range(2)])
    return np.array([[q["c0"], q["c1"]] for q in rows.orderBy("quarter").collect()])


@query
def streaming_kmeans_step(spark, d):
    """One step over all events, from centers that stand for 500 points each."""
    p = T.event_points(spark, d)
    start = _quarter_centers(p)
    warm = WarmCenters(start, np.full(len(start), 500.0)).moved(p, decay=0.5)
    rows = [(i, float(c[0]), float(c[1]), float(w))
            for i, (c, w) in enumerate(zip(warm.centers, warm.weights))]
    out = spark.createDataFrame(rows, "pos int, c0 double, c1 double, weight double")
    return out.select("pos", r("c0").alias("c0"), r("c1").alias("c1"), r("weight").alias("weight"))


@query
def streaming_kmeans(spark, d):
    """Centers after all days, the past halving every 1000 points."""
    p = T.event_points(spark, d)
    model = StreamingKMeans(
        spark, run_dir(spark, "streaming-kmeans"), half_life=1000.0, initial=_quarter_centers(p)
    )
    events = T.table(spark, d, "events")
    warm = None
    total = 0
    for tick in history.catalog_of(p):
        part = T.event_vectors(events.where(T.CLOCK.within(tick)))
        warm, total = model.update(part, tick), total + 1
    rows = [(i, float(c[0]), float(c[1]), float(w), total)
            for i, (c, w) in enumerate(zip(warm.centers, warm.weights))]
    out = spark.createDataFrame(rows, "pos int, c0 double, c1 double, weight double, ticks int")
    return out.select("pos", r("c0", 4).alias("c0"), r("c1", 4).alias("c1"),
                      r("weight", 4).alias("weight"), "ticks")


@query
def weighted_systematic_sample(spark, d):
    w = feat.weights(T.label_clusters(spark, d))
    s = sampling.systematic_sample(w, "mc_id", 5000)
    return s.select("mc_id", F.col("hits").cast("bigint").alias("hits"))


@query
def weighted_random_sample(spark, d):
    w = feat.weights(T.label_clusters(spark, d))
    s = sampling.random_sample(w, "mc_id", 5000, seed=7)
    return s.groupBy("mc_id").agg(F.count("*").alias("hits"))


@query
def kmeans_batch(spark, d):
    p = T.embedding_points(spark, d)
    centers, cost = kmeans.fit_kmeans(p, 2, 20, seed=1)
    out = long_vector(frame_of(spark, centers), "cluster", vector="center")
    return out.withColumn("wssse", F.lit(round(cost, 4)))


# -- starting a model ---------------------------------------------------------


def _started(spark, d, **settings):
    model = OnlineModel(spark, ModelConfig(q=20, dims=2, seed=3, **settings))
    model.step(T.event_points(spark, d), batch_id=0)
    return flat(model.micro_clusters(), "pos", "mc_id", digits=4)


@query
def init_random(spark, d):
    """All events assigned to random centers, after standardising them."""
    return _started(spark, d, min_init_points=0)


@query
def random_start_centers(spark, d):
    """The random centers an empty model over the embeddings starts from, by label."""
    points = T.embedding_points(spark, d)
    centers = random_centers(10, T.EMBEDDING_DIMS, 3)
    found = nearest.nearest(points, nearest.Model.of_centers(centers))
    return found.groupBy(F.col("nearest.pos").alias("pos")).agg(
        F.count("*").alias("n"), r(F.sum("nearest.d2"), 4).alias("d2")
    )


@query
def init_kmeans(spark, d):
    return _started(spark, d, min_init_points=500, init="kmeans")


@query
def init_streaming_kmeans(spark, d):
    return _started(spark, d, min_init_points=500, init="streaming_kmeans")


@query
def init_from_file(spark, d):
    path = run_dir(spark, "init-file")
    exports.replay_points(T.event_points(spark, d), "text", {"path": path})
    model = OnlineModel(spark, ModelConfig(q=20, dims=2, seed=3, min_init_points=0))
    initialize_from_file(model, path)
    return flat(model.micro_clusters(), "pos", "mc_id", digits=4)


# -- the online model ---------------------------------------------------------

STREAM = ModelConfig(
    q=50, dims=2, min_init_points=500, delta=5, m_last_points=20, l=10, seed=1
)


# Groups that outliers of a day are put into, where they are grouped.
FEW_GROUPS = 24


def _last_day(spark, d):
    """The hourly micro-clusters before the last day, their model, and that day's pass."""
    deltas = T.hourly_deltas(spark, d)
    ticks = history.catalog_of(deltas)
    before = feat.sum_features(deltas.where(F.col("tc") < ticks[-1]), ["mc_id"], 2)
    state = feat.with_rmsd(before.withColumn("pos", F.col("mc_id").cast("int")))
    state = state.withColumn("ids", F.array("mc_id"))
    model = nearest.whole_model(state)
    batch = T.event_points(spark, d).where(F.col("tc") == ticks[-1])
    return state, model, absorb(batch, model, t_factor=1.0), ticks[-1]


def _groups(work, model):
    scratch = run_dir(work.sparkSession, "cells")
    return group_outliers(left_over(work), cell_width(model.rmsd, 2, 0.125), 2, FEW_GROUPS, scratch)[0]


def _placed(spark, d, recursive: bool, grouped: bool = False):
    state, model, work, tick = _last_day(spark, d)
    rest = _groups(work, model) if grouped else left_over(work)
    desk = desk_rows(state, STATE_STAGE, next_id=100)
    desk = desk.unionByName(desk_rows(partial_sums(work, 2), DELTA_STAGE))
    desk = desk.unionByName(desk_rows(rest, OUTLIER_STAGE))
    done = settle(desk, Rule(tick, 1.0, recursive, m_last_points=20, delta=tick))
    return flat(done.where(F.col("stage") == STATE_STAGE), "pos", "mc_id", digits=4)


@query
def outlier_maintenance(spark, d):
    """Last day placed on the hourly micro-clusters of the days before it.

    None of them counts as stale, so every outlier joins a founded one or merges two.
    """
    return _placed(spark, d, recursive=True)


@query
def outlier_maintenance_flat(spark, d):
    """As ``outlier_maintenance``, but no outlier joins a founded micro-cluster."""
    return _placed(spark, d, recursive=False)


@query
def outlier_groups(spark, d):
    """The last day's outliers as groups of a grid, coarse enough for a few of them."""
    _, model, work, _ = _last_day(spark, d)
    return flat(_groups(work, model), "point_id", digits=4)


@query
def outliers_grouped(spark, d):
    """As ``outlier_maintenance``, with the outliers grouped before they are placed."""
    return _placed(spark, d, recursive=True, grouped=True)


@query
def outliers_grouped_flat(spark, d):
    """As ``outliers_grouped``; every group founds a micro-cluster."""
    return _placed(spark, d, recursive=False, grouped=True)


@query
def online_stream(spark, d):
    """Micro-clusters after streaming all events, cut into days."""
    model = OnlineModel(spark, STREAM)
    schema = T.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    points = src.read_table_points(
        stream, ["value", F.hour("ts")], "event_id", {"tc": T.CLOCK.tick()}
    )
    q = runner.start(
        points, model, run_dir(spark, "checkpoint"), trigger={"availableNow": True}
    )
    q.awaitTermination()
    return flat(model.micro_clusters(), "pos", "mc_id", digits=4)


def _replayed(spark, d, config=STREAM, on_tick=None):
    model = OnlineModel(spark, config)
    events = T.table(spark, d, "events")
    rows = runner.replay(events, T.CLOCK, T.event_vectors, model, on_tick)
    return model, rows


# Spans of five days in the order in which they arrive.
ARRIVAL = (3, 1, 2, 5, 4, 6)


@query
def late_ticks(spark, d):
    """Records of a stream whose spans of five days come out of order, with rejects.

    A late span is a part of the tick that the clock stands at.
    """
    model = OnlineModel(spark, replace(STREAM, scaling="none", init="random", min_init_points=0))
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    events = src.read_table_points(
        T.table(spark, d, "events"), [value, F.hour("ts")], "event_id",
        {"tc": F.ceil(T.CLOCK.tick() / 5).cast("bigint")},
    )
    rows = [
        model.step(events.where(F.col("tc") == tick), number, tick, "arrival")
        for number, tick in enumerate(ARRIVAL)
    ]
    fields = ("tc", "part", "n_batch", "n_total", "n_late", "n_rejected")
    return spark.createDataFrame(
        [tuple(row[f] for f in fields) for row in rows], ", ".join(f"{f} bigint" for f in fields)
    )


@query
def online_tick_totals(spark, d):
    """What the ledger says arrived in each day, unscaled; nothing may be lost.

    The days before the model starts count with the day it starts.
    """
    model, _ = _replayed(spark, d, replace(STREAM, scaling="none", t_factor=1.0))
    deltas = model.ledger.snapshots("delta")
    return deltas.groupBy("tc").agg(
        F.sum("n").alias("n"),
        r(F.sum(F.col("cf1x")[0]), 4).alias("s1_0"), r(F.sum(F.col("cf2x")[0]), 4).alias("s2_0"),
        F.sum("cf1t").alias("cf1t"), F.sum("cf2t").alias("cf2t"),
    )


@query
def online_partitioned(spark, d):
    """As ``online_tick_totals``, with outliers grouped by cells."""
    config = replace(STREAM, scaling="none", t_factor=1.0, outliers="partitioned")
    model, _ = _replayed(spark, d, config)
    deltas = model.ledger.snapshots("delta")
    return deltas.groupBy("tc").agg(
        F.sum("n").alias("n"), r(F.sum(F.col("cf1x")[0]), 4).alias("s1_0"),
    )


# -- macro-clusters -----------------------------------------------------------


@query
def macro_kmeans(spark, d):
    snapshots, ticks = T.daily_snapshots(spark, d)
    mcs = history.snapshot_at(snapshots, ticks[-1])
    out = macro.macro_clusters(mcs, 5, seed=1)
    return out.select("cluster", "weight", r(F.col("center")[0], 4).alias("c0"),
                      r(F.col("center")[1], 4).alias("c1"))


@query
def macro_sampled(spark, d):
    snapshots, ticks = T.daily_snapshots(spark, d)
    mcs = history.snapshot_at(snapshots, ticks[-1])
    out = macro.sampled_macro_clusters(mcs, 5, 5000, seed=1, tol=0.0)
    return out.select("cluster", "weight", r(F.col("center")[0], 4).alias("c0"),
                      r(F.col("center")[1], 4).alias("c1"))


@query
def offline_sweep(spark, d):
    """Macro-clusters of every horizon."""
    kept, asked, ticks = _horizons(spark, d)
    out = macro.offline_sweep(kept, asked, ticks, 2, k=5)
    return out.select("tc", "h", "cluster", "weight", r(F.col("center")[0], 4).alias("c0"),
                      r(F.col("center")[1], 4).alias("c1"))
