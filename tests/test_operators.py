import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickfold.functions import stats
from tickfold.operators import features as feat
from tickfold.operators import kmeans, nearest, sampling, scaling
from tickfold.config import run_dir
from tickfold.operators.absorb import absorb, left_over, partial_sums
from tickfold.operators.cells import cell_width, group_outliers
from tickfold.operators import founding
from tickfold.operators.founding import Slots
from tickfold.operators.nearest import Model
from tickfold.plans import macro
from tickfold.plans.initial import WarmCenters, random_centers


def clusters(spark, centers, rmsd=1.0):
    rows = [(i, 10 + i, [float(v) for v in c], float(rmsd)) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "pos int, mc_id bigint, centroid array<double>, rmsd double")


def brute(points, centers):
    d2 = np.square(np.asarray(points)[:, None] - np.asarray(centers)[None]).sum(axis=2)
    return d2.argmin(axis=1), d2.min(axis=1)


def test_nearest_equals_brute_force_in_one_and_many_blocks(spark, make_points, monkeypatch):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(300, 5)), rng.normal(size=(40, 5))
    index, d2 = brute(x, c)
    for block in (4096, 7):
        monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
        got = nearest.nearest(make_points(x), clusters(spark, c)).orderBy("point_id").collect()
        assert [g["nearest"]["pos"] for g in got] == index.tolist()
        assert [g["nearest"]["mc_id"] for g in got] == (index + 10).tolist()
        np.testing.assert_allclose([g["nearest"]["d2"] for g in got], d2)


def test_first_slot_wins_ties_and_rounding_does_not_decide(spark, make_points):
    # Far from the origin the matrix form loses the digits that matter here.
    base = 1e6
    centers = [[base, 0], [base + 1e-3, 0], [base, 0], [base + 1e-3, 0]]
    x = [[base + 4.9e-4, 0], [base + 5.1e-4, 0], [base, 5], [base - 1, 0]]
    got = nearest.nearest(make_points(x), clusters(spark, centers)).orderBy("point_id").collect()
    assert [g["nearest"]["pos"] for g in got] == [0, 1, 0, 0]


def test_nearest_without_any_cluster_is_null(spark, make_points):
    got = nearest.nearest(make_points([[1, 2]]), clusters(spark, [])).first()
    assert got["nearest"] is None


def test_closest_pair_and_nearest_other(spark, monkeypatch):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(25, 3))
    c[20] = c[4]
    for block in (4096, 6):
        monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
        pair = nearest.closest_pair(clusters(spark, c)).first()
        assert (pair["pos_a"], pair["pos_b"], pair["d2"]) == (4, 20, 0.0)
        others = nearest.nearest_other(clusters(spark, c)).orderBy("pos").collect()
        d2 = np.square(c[:, None] - c[None]).sum(axis=2)
        d2[d2 == 0] = np.inf
        assert [o["nearest"]["pos"] for o in others] == d2.argmin(axis=1).tolist()
    assert nearest.closest_pair(clusters(spark, c[:1])).isEmpty()


def test_boundary_is_inclusive(spark, make_points):
    found = nearest.nearest(make_points([[3, 0], [3.1, 0]]), clusters(spark, [[0, 0]], rmsd=1.5))
    got = nearest.classify(found, 2.0).orderBy("point_id").collect()
    assert [g["inside"] for g in got] == [1, 0]
    assert nearest.inliers(nearest.classify(found, 2.0)).count() == 1
    assert nearest.outliers(nearest.classify(found, 2.0)).first()["dist"] == 3.1


@pytest.mark.parametrize("dims", [3, 20])
def test_features_narrow_and_wide(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(200, dims))
    key = rng.integers(4, size=200)
    rows = [(int(k), [float(v) for v in r]) for k, r in zip(key, x)]
    points = spark.createDataFrame(rows, "k int, x array<double>").repartition(3)
    f = feat.with_times(feat.features_of_points(points, ["k"], dims), 7)
    for r in f.collect():
        mine = x[key == r["k"]]
        assert (r["n"], r["cf1t"], r["cf2t"]) == (len(mine), 7 * len(mine), 49 * len(mine))
        np.testing.assert_allclose(r["cf1x"], mine.sum(axis=0))
        np.testing.assert_allclose(r["cf2x"], np.square(mine).sum(axis=0))
    whole = feat.sum_features(f, [], dims).first()
    assert whole["n"] == 200 and whole["cf1t"] == 1400
    np.testing.assert_allclose(whole["cf2x"], np.square(x).sum(axis=0))


@pytest.mark.parametrize("dims", [2, 18])
def test_cumulative_is_the_sum_of_deltas(spark, dims):
    rows = [
        (m, t, n, [float(n)] * dims, [float(m)] * dims, n * t, n * t * t)
        for m, t, n in [(1, 1, 3), (1, 3, 2), (2, 3, 4), (1, 5, 1), (3, 5, 6)]
    ]
    deltas = spark.createDataFrame(
        rows, "mc_id int, tc bigint, n bigint, cf1x array<double>, cf2x array<double>, "
        "cf1t bigint, cf2t bigint")
    got = {(r["mc_id"], r["tc"]): r for r in feat.cumulative(deltas, [1, 3, 5], dims).collect()}
    assert set(got) == {(1, 1), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5)}
    assert [got[1, t]["n"] for t in (1, 3, 5)] == [3, 5, 6]
    assert got[2, 5]["n"] == 4 and got[2, 5]["cf2t"] == 36
    assert got[1, 5]["cf1x"] == [6.0] * dims


def test_rmsd_cases(spark):
    rows = [(0, 1, [0.0, 0.0], [0.0, 0.0]), (1, 1, [3.0, 4.0], [9.0, 16.0]),
            (2, 2, [20.0, 0.0], [250.0, 0.0]), (3, 3, [0.3, 0.3], [0.03, 0.03]),
            (4, 0, [0.0, 0.0], [0.0, 0.0])]
    mcs = spark.createDataFrame(rows, "pos int, n bigint, cf1x array<double>, cf2x array<double>")
    got = {r["pos"]: r for r in feat.with_rmsd(mcs.withColumn("mc_id", F.col("pos"))).collect()}
    assert got[1]["rmsd"] == pytest.approx(math.hypot(2.9, 3.9))  # the closest other one
    assert got[2]["rmsd"] == 5.0
    assert got[3]["rmsd"] == pytest.approx(0.0, abs=1e-8)  # clamped, not NaN
    assert 4 not in got  # no centroid, no deviation


def test_merge_and_update(spark):
    rows = [(i, i, 1 + i, [float(i)], [float(i)], i, i, [i, 10 + i]) for i in range(3)]
    mcs = spark.createDataFrame(
        rows, "pos int, mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>, "
        "cf1t bigint, cf2t bigint, ids array<bigint>")
    pair = spark.createDataFrame([(0, 2)], "pos_a int, pos_b int")
    got = {r["pos"]: r for r in feat.merge_pair(mcs, pair, 1).collect()}
    assert set(got) == {0, 1}
    assert got[0]["n"] == 4 and got[0]["ids"] == [0, 10, 2, 12] and got[0]["cf1x"] == [2.0]
    batch = mcs.where("pos = 1").drop("ids")
    new = {r["pos"]: r for r in feat.update_state(mcs, batch).collect()}
    assert new[1]["n"] == 4 and new[0]["n"] == 1 and new[1]["ids"] == [1, 11]


def test_scaling_edge_cases(spark):
    rows = [(1, 0, [1.0, 5.0]), (1, 1, [3.0, 5.0]), (2, 2, [9.0, 9.0])]
    points = spark.createDataFrame(rows, "tc int, point_id bigint, x array<double>")
    got = {r["point_id"]: r["x"] for r in scaling.standardize(points, "tc", 2).collect()}
    assert got[0] == pytest.approx([-math.sqrt(0.5), 0.0]) and got[2] == [0.0, 0.0]
    n, mu, sd = scaling.moments(points.where("tc = 2"), 2)
    assert (n, list(mu), list(sd)) == (1, [9.0, 9.0], [0.0, 0.0])
    assert scaling.moments(points.where("tc = 3"), 2)[0] == 0
    same = scaling.standardize_with(points.where("tc = 1"), [2.0, 5.0], [math.sqrt(2), 0.0])
    assert {r["point_id"]: r["x"] for r in same.collect()}[0] == pytest.approx(got[0])


def test_wide_scaling_matches(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 20)) * 3 + 1
    points = spark.createDataFrame(
        [(1, i, [float(v) for v in r]) for i, r in enumerate(x)],
        "tc int, point_id bigint, x array<double>")
    _, mu, sd = scaling.moments(points, 20)
    np.testing.assert_allclose(mu, x.mean(axis=0))
    np.testing.assert_allclose(sd, x.std(axis=0, ddof=1))
    z = [r["x"] for r in scaling.standardize(points, "tc", 20).orderBy("point_id").collect()]
    np.testing.assert_allclose(z, (x - mu) / sd)


def test_projection_equals_eigenvectors(spark, make_points):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 4)) * [5, 2, 1, 0.1]
    got = scaling.project(make_points(x), scaling.fit_projection(make_points(x), 2))
    got = np.array([r["x"] for r in got.orderBy("point_id").collect()])
    _, vectors = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(np.abs(got), np.abs(x @ vectors[:, [3, 2]]), atol=1e-8)


def test_recency_stamp_branches(spark):
    rows = [(0, 0, 0), (4, 12, 40), (100, 1000, 10400), (100, 1000, 10000)]
    df = spark.createDataFrame(rows, "n bigint, t1 bigint, t2 bigint").coalesce(1)
    got = [r[0] for r in df.select(
        stats.recency_stamp(F.col("n"), F.col("t1"), F.col("t2"), 20)).collect()]
    # Normal(10, 2) at 1 - 20/200; no spread leaves the mean.
    assert got == pytest.approx([0.0, 3.0, 10 + 2 * 1.2815515655446004, 10.0])


def test_uniform_is_the_same_on_both_sides(spark):
    df = spark.range(3).withColumn("u", stats.uniform(4, F.col("id"), F.lit(2)))
    from tickfold.plans.initial import uniform_draw

    assert [r["u"] for r in df.orderBy("id").collect()] == [uniform_draw(4, i, 2) for i in range(3)]
    centers = random_centers(50, 4, 1)
    assert centers.min() >= 0 and centers.max() < 1 and abs(centers.mean() - 0.5) < 0.1


def test_absorb_splits_every_point_once(spark, make_points):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(500, 3)) * 2, rng.normal(size=(9, 3))
    model = Model(np.arange(9), np.arange(9), c, np.full(9, 0.6))
    index, d2 = brute(x, c)
    inside = np.sqrt(d2) <= 2.0 * 0.6
    work = absorb(make_points(x), model, 2.0)
    for r in partial_sums(work, 3).collect():
        mine = x[inside & (index == r["pos"])]
        assert r["n"] == len(mine)
        np.testing.assert_allclose(r["cf2x"], np.square(mine).sum(axis=0))
    out = left_over(work).orderBy("point_id").collect()
    assert [r["point_id"] for r in out] == np.nonzero(~inside)[0].tolist()
    assert out[0]["cf1x"] == x[~inside][0].tolist()


@pytest.mark.parametrize("dims", [2, 9, 20])
def test_groups_of_outliers_depend_on_the_points_alone(spark, make_points, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(600, dims)) * 5
    x[::3] = x[0]  # a third of the points are equal
    x[7] *= 1e6
    model = Model(np.arange(4), np.arange(4), np.zeros((4, dims)), np.full(4, 0.1))
    width = cell_width(model.rmsd, dims, 0.5)
    seen = []
    for parts in (1, 2, 7, 50):
        groups, steps = group_outliers(left_over(absorb(make_points(x, parts=parts), model, 0.5)), width, dims, 25, run_dir(spark, "cells"))
        rows = groups.orderBy("point_id").collect()
        assert 2 <= len(rows) <= 25 and steps > 0
        assert sum(r["n"] for r in rows) == 600
        np.testing.assert_allclose(np.sum([r["cf1x"] for r in rows], axis=0), x.sum(axis=0), rtol=1e-12)
        np.testing.assert_allclose(np.sum([r["cf2x"] for r in rows], axis=0), np.square(x).sum(axis=0), rtol=1e-12)
        seen.append(rows)
    assert all(rows == seen[0] for rows in seen)  # to the last bit


def test_groups_of_few_or_no_outliers(spark, make_points):
    points = make_points([[9.0, 9.0], [9.0, 9.01], [-9.0, 9.0]]).selectExpr(
        "point_id", "1L as n", "x as cf1x", "cast(null as array<double>) as cf2x"
    )
    groups, steps = group_outliers(points, 1.0, 2, 10, run_dir(spark, "cells"))
    assert [(r["point_id"], r["n"]) for r in groups.orderBy("point_id").collect()] == [(0, 2), (2, 1)] and steps == 0
    assert group_outliers(points, 1.0, 2, 1, run_dir(spark, "cells"))[0].select("n").collect()[0][0] == 3
    assert group_outliers(points.limit(0), 1.0, 2, 10, run_dir(spark, "cells"))[0].collect() == []


def test_closest_pair_of_slots_is_kept_up_to_date():
    rng = np.random.default_rng(8)
    q = 30
    centroid = rng.integers(0, 12, size=(q, 2)).astype(float)
    centroid[5] = np.nan
    n = np.ones(q, np.int64)
    slots = Slots(n, centroid.copy(), centroid**2, centroid, np.zeros(q), np.zeros(q, bool), 1.0)
    for _ in range(200):
        d2 = np.square(centroid[:, None] - centroid[None]).sum(axis=2)
        d2[np.isnan(d2) | ~np.triu(np.ones((q, q), bool), 1)] = np.inf
        assert slots._closest() == divmod(int(d2.argmin()), q)
        for moved in rng.integers(0, q, 3):
            centroid[moved] = rng.integers(0, 12, 2)
            slots._moved.add(int(moved))


def test_few_slots_need_three_looks_an_outlier(monkeypatch):
    rng = np.random.default_rng(9)
    q, many, looks = 40, 400, []
    x = np.round(rng.normal(size=(many, 2)) * 9, 1)
    start = np.round(rng.normal(size=(q, 2)) * 9, 1)

    def placed():
        n = np.ones(q, np.int64)
        stale = np.arange(q) < 3
        slots = Slots(n, start.copy(), start**2, start.copy(), np.full(q, 0.1), stale, 1.0)
        where = [slots.place(1, p, p * p) for p in x]
        slots.refresh()
        return where, slots

    for name in ("_distances", "_distances_to"):
        plain = getattr(Slots, name, None)
        monkeypatch.setattr(
            Slots, name, lambda *a, plain=plain: (looks.append(1), plain(*a))[1], raising=False
        )
    where, slots = placed()
    assert len(looks) <= 3 * many + 2 * q
    assert any(into == -1 for _, into in where) and any(into not in (-1, None) for _, into in where)
    monkeypatch.setattr(founding, "FEW_SLOTS", 0)
    others, many_slots = placed()
    assert where == others
    np.testing.assert_allclose(slots.centroid, many_slots.centroid, rtol=1e-12)
    np.testing.assert_allclose(slots.rmsd, many_slots.rmsd, rtol=1e-9)


def test_weighted_sums_count_repeats(spark, make_points):
    points = make_points([[0, 1], [0, 3], [9, 9]]).withColumn("weight", F.col("point_id") + 1)
    got = kmeans.center_sums(points, np.array([[0.0, 0.0], [9.0, 9.0]])).orderBy("pos").collect()
    assert [(r["n"], r["cf1x"]) for r in got] == [(3, [0.0, 7.0]), (3, [27.0, 27.0])]


def test_lloyd_and_cost(spark, make_points):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(50, 2)), rng.normal(size=(50, 2)) + 10])
    centers = kmeans.lloyd(make_points(x), [[1, 1], [5, 5], [900, 900]], 20)
    np.testing.assert_allclose(centers[0], x[:50].mean(axis=0))
    np.testing.assert_allclose(centers[1], x[50:].mean(axis=0))
    assert centers[2].tolist() == [900, 900]
    fitted, cost = kmeans.fit_kmeans(make_points(x), 2, 20, seed=1)
    assert kmeans.wssse(make_points(x), fitted).first()[0] == pytest.approx(cost)


def test_streaming_centers_follow_the_published_rule(spark, make_points):
    warm = WarmCenters(np.array([[0.0], [10.0]]), np.array([4.0, 0.0]))
    moved = warm.moved(make_points([[1], [2], [11]]), decay=0.5)
    # 4 * 0.5 old points at 0 and two new ones: (0 * 2 + 3) / 4.
    np.testing.assert_allclose(moved.centers, [[0.75], [11.0]])
    np.testing.assert_allclose(moved.weights, [4.0, 1.0])
    per_point = warm.moved(make_points([[1], [2], [11]]), decay=0.5, per_point=True)
    np.testing.assert_allclose(per_point.weights, [4 * 0.5**3 + 2, 1.0])


def test_dying_center_restarts_at_the_heaviest(spark, make_points):
    warm = WarmCenters(np.array([[0.0], [1e6]]), np.array([1.0, 0.0]))
    moved = warm.moved(make_points([[1.0], [1.0]]))
    np.testing.assert_allclose(moved.weights, [1.5, 1.5])
    np.testing.assert_allclose(moved.centers, [[2 / 3], [2 / 3]])
    assert moved.centers[0] > moved.centers[1]


def test_samples(spark):
    w = spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 0.2, 0.3, 0.4])],
                              "id bigint, weight double")
    hits = {r["id"]: r["hits"] for r in sampling.systematic_sample(w, "id", 10).collect()}
    assert hits == {0: 1, 1: 2, 2: 3, 3: 4}
    drawn = sampling.random_sample(w, "id", 4000, 1).groupBy("id").count().collect()
    assert sum(r["count"] for r in drawn) == 4000
    for r in drawn:
        assert abs(r["count"] / 4000 - 0.1 * (r["id"] + 1)) < 0.03
    # Weights that do not add to one are shares all the same.
    short = w.withColumn("weight", F.col("weight") * 0.3)
    hits = {r["id"]: r["hits"] for r in sampling.systematic_sample(short, "id", 10).collect()}
    assert sum(hits.values()) == 10


def test_macro_clusters_weigh_their_members(spark):
    rows = [(0, 90, [0.0], [0.0]), (1, 10, [10.0], [10.0]), (2, 50, [5000.0], [0.0]),
            (3, 0, [0.0], [0.0])]
    mcs = spark.createDataFrame(rows, "pos int, n bigint, cf1x array<double>, cf2x array<double>")
    for out in (macro.macro_clusters(mcs, 2, seed=1),
                macro.sampled_macro_clusters(mcs, 2, 3000, seed=3, systematic=True)):
        got = sorted((r["center"][0], r["weight"]) for r in out.collect())
        assert got[0] == (pytest.approx(0.1, abs=0.02), 100.0)
        assert got[1] == (pytest.approx(100.0), 50.0)


def test_blocks_meet_negative_and_equal_positions(spark, monkeypatch, make_points):
    from tickfold.operators import nearest as near

    monkeypatch.setattr(near, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near, "PASS_BLOCKS", 2)
    rows = [(p, 100 + i, [float(i), 0.0], 1.0) for i, p in enumerate([-10, -7, -7, -7, -7, 0, 0, 0, 0, 3, 4])]
    mcs = spark.createDataFrame(rows, "pos int, mc_id bigint, centroid array<double>, rmsd double")
    seen = [int(i) for block in near.model_blocks(mcs) for i in block.mc_id]
    assert sorted(seen) == [100 + i for i in range(len(rows))]
    assert len(near.whole_model(mcs).pos) == len(rows)
    with pytest.raises(ValueError):
        near.whole_model(mcs, max_bytes=20)
    found = near.nearest(make_points([[i, 0.0] for i in range(len(rows))]), mcs).collect()
    assert {(r["point_id"], r["nearest"]["mc_id"], r["nearest"]["d2"]) for r in found} == {
        (i, 100 + i, 0.0) for i in range(len(rows))
    }


def test_weights_of_outliers(spark):
    from tickfold.operators.absorb import absorb
    from tickfold.operators.nearest import Model

    model = Model(np.arange(1), np.arange(1), np.zeros((1, 1)), np.ones(1))
    points = spark.createDataFrame([(1, [9.0], 7), (2, [0.5], 3)], "point_id bigint, x array<double>, weight bigint")
    work = absorb(points, model, 1.0).collect()
    assert sum(r["n"] for r in work) == 10
    out = next(r for r in work if r["pos"] is None)
    assert (out["n"], out["cf1x"], out["cf2x"]) == (7, [63.0], [567.0])


def test_draws_from_many_weighted_rows(spark, monkeypatch):
    rows = [(i, 0.0 if i % 7 == 3 else float((i * 37) % 11 + 1)) for i in range(400)] + [(400, 900.0), (401, 0.0)]
    weighted = spark.createDataFrame(rows, "k bigint, weight double").repartition(5)

    def drawn():
        return sorted(tuple(r) for r in sampling.random_sample(weighted, "k", 3000, seed=5).collect())

    by_edges = drawn()
    monkeypatch.setattr(sampling, "MAX_EDGES", 10)
    assert drawn() == by_edges
    assert len(by_edges) == 3000 and all(rows[k][1] > 0 for _, k in by_edges)


def test_draws_from_a_million_weighted_rows(spark):
    # The weight of row i makes its interval (i^2, (i + 1)^2], so a draw shows its row.
    n = 1_000_000
    weighted = spark.range(n).select("id", (2.0 * F.col("id") + 1).alias("weight"))
    drawn = sampling.random_sample(weighted, "id", 200_000, seed=2)
    u = sampling.uniform(2, F.col("draw"))
    place = F.sqrt(u) * n
    far = drawn.where((place < F.col("id") - 1e-3) | (place > F.col("id") + 1 + 1e-3))
    assert drawn.count() == 200_000 and far.isEmpty()
