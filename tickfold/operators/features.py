"""Additive cluster features: (n, sum x, sum x^2, sum t, sum t^2) per micro-cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickfold.functions import vectors as V
from tickfold.operators.nearest import nearest_other

# Up to this many dimensions each gets its own aggregate, inside generated code;
# above it, one aggregate runs over (key, dimension).
NARROW = 16

# Size up to which a counted table is copied to every executor.
MAX_BROADCAST_BYTES = 64 << 20

SUMMED = ("n", "cf1x", "cf2x", "cf1t", "cf2t")


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a small table for broadcast, after counting its rows.

    A larger one is returned as it is: the planner then shuffles both sides and
    splits skewed partitions.
    """
    df = df.persist()
    return F.broadcast(df) if df.count() * row_bytes <= MAX_BROADCAST_BYTES else df


def combine(name: str, sign: str, other: str) -> str:
    """SQL of a feature plus or minus another one; null if either is."""
    if name in ("cf1x", "cf2x"):
        return f"zip_with({name}, {other}, (a, b) -> a {sign} b)"
    return f"{name} {sign} {other}"


def _sum_elements(df, keys, arrays, scalars, dims, gather=(), least=()) -> DataFrame:
    """Sum array columns element by element, and scalars, per key.

    ``arrays`` maps a result to the SQL of its element ``{i}``. Both forms combine
    on the map side, so only one row per key and task is shuffled, however many
    rows a key has. The lists named in ``gather`` are concatenated, of the columns in
    ``least`` the minimum is kept.
    """
    if dims <= NARROW:
        sums = [F.expr(f"sum({c})").alias(name) for name, c in scalars.items()]
        sums += [F.expr(f"flatten(collect_list({c}))").alias(c) for c in gather]
        sums += [F.min(c).alias(c) for c in least]
        sums += [
            F.expr(f"sum({element.format(i=i)})").alias(f"_{name}_{i}")
            for name, element in arrays.items()
            for i in range(dims)
        ]
        packed = [
            f"array({', '.join(f'_{name}_{i}' for i in range(dims))}) as {name}"
            for name in arrays
        ]
        return df.groupBy(*keys).agg(*sums).selectExpr(*keys, *scalars, *gather, *least, *packed)

    fields = ", ".join(f"'{name}', {e.format(i='i')}" for name, e in arrays.items())
    long = df.selectExpr(
        *keys,
        *[f"{c} as {name}" for name, c in scalars.items()],
        *gather,
        *least,
        f"posexplode(transform(sequence(0, {dims - 1}), i -> named_struct({fields}))) as (dim, v)",
    )
    per_dim = long.groupBy(*keys, "dim").agg(
        *[F.expr(f"sum(case when dim = 0 then {s} end)").alias(s) for s in scalars],
        *[
            F.expr(f"flatten(collect_list(case when dim = 0 then {c} end))").alias(c)
            for c in gather
        ],
        *[F.min(c).alias(c) for c in least],
        *[F.expr(f"sum(v.{name})").alias(name) for name in arrays],
    )
    rows = per_dim.groupBy(*keys).agg(
        *[F.sum(s).alias(s) for s in scalars],
        *[F.expr(f"flatten(collect_list({c}))").alias(c) for c in gather],
        *[F.min(c).alias(c) for c in least],
        F.sort_array(F.collect_list(F.struct("dim", *arrays))).alias("_v"),
    )
    return rows.selectExpr(*keys, *scalars, *gather, *least, *[f"_v.{name} as {name}" for name in arrays])


def features_of_points(points: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """``n, cf1x, cf2x`` of the points ``x`` of each key."""
    arrays = {"cf1x": "x[{i}]", "cf2x": "x[{i}] * x[{i}]"}
    return _sum_elements(points, keys, arrays, {"n": "1L"}, dims)


def sum_features(
    df: DataFrame, keys: list[str], dims: int, times: bool = True, gather: tuple = ()
) -> DataFrame:
    """Add up features that are already there: merges, deltas, partial results."""
    scalars = {c: c for c in (("n", "cf1t", "cf2t") if times else ("n",))}
    arrays = {"cf1x": "cf1x[{i}]", "cf2x": "cf2x[{i}]"}
    return _sum_elements(df, keys, arrays, scalars, dims, gather)


def with_times(features: DataFrame, tc) -> DataFrame:
    """Time moments of a batch whose points all arrived at tick ``tc``."""
    t = (F.col(tc) if isinstance(tc, str) else F.lit(tc)).cast("bigint")
    return features.withColumn("cf1t", F.col("n") * t).withColumn(
        "cf2t", F.col("n") * t * t
    )


def batch_totals(points: DataFrame, tick: str = "tc") -> DataFrame:
    """Points per tick and running total; ticks without points do not appear."""
    counts = points.groupBy(tick).agg(F.count("*").alias("n_batch"))
    # The window runs over one row per tick, not over points.
    return counts.withColumn("n_total", F.sum("n_batch").over(Window.orderBy(tick)))


def centroid_of(n: Column, cf1x: Column) -> Column:
    """Null while the micro-cluster is empty."""
    return F.when(n > 0, V.divide(cf1x, n.cast("double")))


def rmsd_of(n: Column, cf1x: Column, cf2x: Column) -> Column:
    """Root mean square deviation from the centroid, for n > 1.

    Rounding can leave a tiny negative number under the root, hence the clamp.
    """
    size = n.cast("double")
    variance = V.total(cf2x) / size - V.squared_norm(cf1x) / (size * size)
    return F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0))))


def centroids(mcs: DataFrame) -> DataFrame:
    """Centroids of the non-empty micro-clusters."""
    return mcs.where("n > 0").withColumn("centroid", centroid_of(F.col("n"), F.col("cf1x")))


def weights(mcs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of the points, among the non-empty micro-clusters (of each ``by``)."""
    full = mcs.where("n > 0")
    if not by:
        everything = full.agg(F.sum("n")).scalar()
        return full.withColumn("weight", F.col("n") / everything)
    totals = full.groupBy(*by).agg(F.sum("n").alias("_all"))
    return full.join(totals, by).withColumn("weight", F.col("n") / F.col("_all")).drop("_all")


def squared_distance_to(mcs: DataFrame, point: Column) -> DataFrame:
    """Add ``d2``, from the centroid of each micro-cluster to a point."""
    return mcs.withColumn("d2", V.squared_distance(F.col("centroid"), point))


def slots_of(mcs: DataFrame, ids: DataFrame) -> DataFrame:
    """Slot ``pos`` of each asked ``mc_id``, -1 for those that are not there."""
    slots = broadcast_if_small(mcs.select("mc_id", "pos"), row_bytes=16)
    found = ids.join(slots, "mc_id", "left")
    return found.withColumn("pos", F.coalesce("pos", F.lit(-1)))


def with_rmsd(mcs: DataFrame) -> DataFrame:
    """Add ``centroid`` and ``rmsd``.

    A single point has no deviation; the distance to the closest other
    micro-cluster stands in for it.
    """
    n, cf1x, cf2x = F.col("n"), F.col("cf1x"), F.col("cf2x")
    full = mcs.withColumn("centroid", centroid_of(n, cf1x))
    full = nearest_other(full, where=n == 1).withColumn(
        "rmsd",
        F.when(n == 1, F.coalesce(F.sqrt("nearest.d2"), F.lit(float("inf")))).otherwise(
            rmsd_of(n, cf1x, cf2x)
        ),
    )
    return full.drop("nearest")


def merge_pair(mcs: DataFrame, pair: DataFrame, dims: int) -> DataFrame:
    """Fold the micro-cluster ``pos_b`` of ``pair`` into ``pos_a``.

    Features are added and the ids appended; the other rows stay as they are.
    """
    to, gone = (pair.select(c).scalar() for c in ("pos_a", "pos_b"))
    moved = mcs.withColumn("into", F.when(F.col("pos") == gone, to).otherwise(F.col("pos")))
    first = F.struct(F.col("pos") != F.col("into"), "pos", "mc_id", "ids")
    names = moved.groupBy("into").agg(F.sort_array(F.collect_list(first)).alias("m"))
    names = names.select(
        F.col("into").alias("pos"),
        F.col("m")[0]["mc_id"].alias("mc_id"),
        F.flatten(F.col("m.ids")).alias("ids"),
    )
    sums = sum_features(moved, ["into"], dims).withColumnRenamed("into", "pos")
    return names.join(sums, "pos")


def update_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Add the features of a batch to the micro-clusters with the same ``mc_id``."""
    names = [c for c in state.columns if c in SUMMED]
    b = batch.selectExpr("mc_id", *[f"{c} as b_{c}" for c in names])
    joined = state.join(b, "mc_id", "left")
    plus = {c: f"coalesce({combine(c, '+', f'b_{c}')}, {c}) as {c}" for c in names}
    return joined.selectExpr(*[plus.get(c, c) for c in state.columns])


def cumulative(
    deltas: DataFrame, ticks: list[int], dims: int, key: str = "mc_id"
) -> DataFrame:
    """Per-tick features to running features: the snapshots of a whole history.

    ``deltas`` has one row per micro-cluster and tick. Each of the ``ticks`` gets
    a snapshot, listing every micro-cluster seen so far.
    """
    known = F.array(*[F.lit(t).cast("bigint") for t in ticks])
    span = deltas.groupBy(key).agg(F.min("tc").alias("first_tc"))
    grid = span.select(
        key, F.explode(F.filter(known, lambda t: t >= F.col("first_tc"))).alias("tc")
    )
    full = grid.join(deltas, [key, "tc"], "left")
    upto = f"over (partition by {key} order by tc rows unbounded preceding)"
    if dims > NARROW:
        filled = full.withColumn(
            "v",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.lit(dims - 1)),
                    lambda i: F.struct(
                        i.alias("dim"),
                        F.get("cf1x", i).alias("cf1x"),
                        F.get("cf2x", i).alias("cf2x"),
                    ),
                )
            ),
        ).select(key, "tc", "n", "cf1t", "cf2t", "v.*")
        by_dim = f"over (partition by {key}, dim order by tc rows unbounded preceding)"
        running = filled.select(
            key,
            "tc",
            "dim",
            *[F.expr(f"coalesce(sum({c}) {by_dim}, 0)").alias(c)
              for c in ("n", "cf1t", "cf2t", "cf1x", "cf2x")],
        )
        packed = running.groupBy(key, "tc").agg(
            F.max("n").alias("n"),
            F.max("cf1t").alias("cf1t"),
            F.max("cf2t").alias("cf2t"),
            F.sort_array(F.collect_list(F.struct("dim", "cf1x", "cf2x"))).alias("v"),
        )
        return packed.select(
            key, "tc", "n", "cf1t", "cf2t",
            F.col("v.cf1x").alias("cf1x"), F.col("v.cf2x").alias("cf2x"),
        )
    sums = [
        F.array(*[F.expr(f"coalesce(sum({c}[{i}]) {upto}, 0D)") for i in range(dims)]).alias(c)
        for c in ("cf1x", "cf2x")
    ]
    counts = [F.expr(f"coalesce(sum({c}) {upto}, 0)").alias(c) for c in ("n", "cf1t", "cf2t")]
    return full.select(key, "tc", *counts, *sums)
