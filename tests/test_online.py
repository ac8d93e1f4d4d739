import numpy as np
import pytest
from naive import Naive
from pyspark.sql import functions as F

from tickfold.config import ModelConfig, run_dir
from tickfold.plans.initial import random_centers
from tickfold.plans.online import OnlineModel, initialize_from, initialize_from_file


def drifting(ticks, size, dims=2, seed=0, jump=0.6):
    """Batches of a few moving blobs with some far outliers."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(3, dims)) * 4
    out = []
    for _ in range(ticks):
        centers = centers + rng.normal(size=centers.shape) * jump
        rows = centers[rng.integers(3, size=size)] + rng.normal(size=(size, dims)) * 0.5
        far = rng.random(size) < 0.15
        rows[far] += rng.normal(size=(far.sum(), dims)) * 6
        out.append(rows)
    return out


def check_same(model, naive):
    rows = model.micro_clusters().orderBy("pos").collect()
    assert len(rows) == len(naive.mcs)
    for row, mc in zip(rows, naive.mcs):
        assert list(row["ids"]) == mc.ids and row["mc_id"] == mc.ids[0]
        assert (row["n"], row["cf1t"], row["cf2t"]) == (mc.n, mc.t1, mc.t2)
        np.testing.assert_allclose(row["cf1x"], mc.s1, atol=1e-8)
        np.testing.assert_allclose(row["cf2x"], mc.s2, atol=1e-8)
        np.testing.assert_allclose(row["centroid"], mc.centroid, atol=1e-8)
        np.testing.assert_allclose(row["rmsd"], mc.rmsd, atol=1e-6)
    delta = {r["mc_id"]: r for r in model.batch_delta().collect()}
    assert set(delta) == set(naive.delta_now)
    for ident, mc in naive.delta_now.items():
        assert delta[ident]["n"] == mc.n and delta[ident]["cf2t"] == mc.t2
        np.testing.assert_allclose(delta[ident]["cf1x"], mc.s1, atol=1e-8)


CASES = {
    "plain": dict(q=6),
    "stale soon": dict(q=6, delta=1, m_last_points=4),
    "everything stale": dict(q=5, delta=-1, t_factor=0.8),
    "nothing stale": dict(q=6, delta=50, t_factor=0.7),
    "no recursion": dict(q=6, recursive_outliers=False, t_factor=1.0),
    "one slot": dict(q=1, t_factor=0.5),
    "two slots": dict(q=2, t_factor=0.5, delta=1),
    "unscaled": dict(q=6, scaling="none", t_factor=1.0),
    "window": dict(q=6, remove_expired=True, window_time=3, t_factor=1.0, l=1),
}


@pytest.mark.parametrize("name", CASES)
def test_every_tick_equals_the_sequential_algorithm(spark, make_points, name):
    settings = CASES[name]
    cfg = ModelConfig(dims=2, seed=5, **settings)
    naive = Naive(
        random_centers(cfg.q, 2, 5), cfg.t_factor, cfg.m_last_points, cfg.delta,
        cfg.recursive_outliers, cfg.scaling == "batch",
        cfg.window_time if cfg.remove_expired else None,
    )
    model = OnlineModel(spark, cfg)
    outliers = 0
    for i, rows in enumerate(drifting(4, 40, seed=len(name))):
        row = model.step(make_points(rows, first_id=1000 * i), i)
        outliers += naive.step(rows.tolist())
        assert row["n_outliers"] <= 40 and row["next_id"] == naive.next_id
        check_same(model, naive)
    assert outliers > 0
    assert model.total_points == 160 and model.current_time == 4


def test_wide_vectors_follow_the_same_rules(spark, make_points):
    cfg = ModelConfig(q=5, dims=20, seed=2, t_factor=1.0, delta=2)
    naive = Naive(random_centers(5, 20, 2), 1.0, delta=2)
    model = OnlineModel(spark, cfg)
    for i, rows in enumerate(drifting(3, 30, dims=20, seed=9)):
        model.step(make_points(rows, 100 * i), i)
        naive.step(rows.tolist())
        check_same(model, naive)


def test_chunks_of_outliers_give_the_same_result(spark, make_points):
    batches = drifting(3, 60, seed=4)
    results = []
    for chunk_rows in (1000, 7):
        cfg = ModelConfig(q=6, dims=2, t_factor=0.5, delta=1, seed=1, chunk_rows=chunk_rows)
        model = OnlineModel(spark, cfg)
        for i, rows in enumerate(batches):
            meta = model.step(make_points(rows, 100 * i), i)
        assert meta["n_outliers"] > 7
        state = model.micro_clusters().orderBy("pos").collect()
        results.append([(r["mc_id"], r["n"], r["ids"], [round(v, 9) + 0.0 for v in r["centroid"]],
                         round(r["rmsd"], 6)) for r in state])
        assert "scratch" not in model.ledger.folders(model.ledger.root) or not (
            model.ledger.folders(f"{model.ledger.root}/scratch")
        )
    assert results[0] == results[1]


def test_partitioning_does_not_matter(spark, make_points):
    rows = drifting(1, 80, seed=8)[0]
    states = []
    for parts in (1, 5):
        model = OnlineModel(spark, ModelConfig(q=8, dims=2, t_factor=0.8, seed=1))
        model.step(make_points(rows[:40], 0, parts), 0)
        model.step(make_points(rows[40:], 40, parts), 1)
        state = model.micro_clusters().orderBy("pos").collect()
        states.append([(r["mc_id"], r["n"], tuple(r["ids"])) for r in state])
    assert states[0] == states[1]


@pytest.mark.parametrize("recursive", [True, False])
def test_grouped_outliers_do_not_know_the_layout(spark, make_points, recursive):
    """Neither partitions nor the bound of a chunk change the micro-clusters."""
    batches = drifting(3, 150, seed=8, jump=3.0)
    states = []
    for parts, chunk_rows in ((2, 200_000), (7, 9), (50, 1)):
        cfg = ModelConfig(q=8, dims=2, t_factor=0.4, delta=1, seed=1, scaling="none", outliers="partitioned",
                          recursive_outliers=recursive, chunk_rows=chunk_rows, max_groups=20)
        model = OnlineModel(spark, cfg)
        for i, rows in enumerate(batches):
            meta = model.step(make_points(rows, 1000 * i, parts), i)
        assert meta["n_outliers"] > 20
        state = model.micro_clusters().orderBy("pos").collect()
        states.append([(r["mc_id"], r["n"], tuple(r["ids"]), [round(v, 9) for v in r["cf1x"]],
                        [round(v, 9) for v in r["cf2x"]], r["cf1t"]) for r in state])
    assert states[0] == states[1] == states[2]


def test_repeated_batch_replaces_its_tick(spark, make_points):
    batches = drifting(3, 40, seed=3)
    cfg = ModelConfig(q=5, dims=2, t_factor=1.0, seed=1)
    once = OnlineModel(spark, cfg)
    for i, rows in enumerate(batches):
        once.step(make_points(rows, 100 * i), i)
    root = run_dir(spark, "again")
    for i, rows in enumerate(batches):
        # A new instance each time, and every batch delivered twice.
        OnlineModel(spark, cfg, root).step(make_points(rows, 100 * i), i)
        OnlineModel(spark, cfg, root).step(make_points(rows, 100 * i), i)
    again = OnlineModel(spark, cfg, root)
    assert again.current_time == 3 and again.total_points == 120
    key = lambda m: [(r["mc_id"], r["n"]) for r in m.micro_clusters().orderBy("pos").collect()]
    assert key(once) == key(again)


def test_a_tick_that_died_before_its_commit_is_not_seen(spark, make_points):
    batches = drifting(2, 30, seed=3)
    model = OnlineModel(spark, ModelConfig(q=4, dims=2, seed=1))
    for i, rows in enumerate(batches):
        model.step(make_points(rows, 100 * i), i)
    model.ledger.drop(model.ledger.path("meta", 2))
    late = OnlineModel(spark, model.config, model.ledger.root)
    assert late.current_time == 1 and late.ledger.ticks() == [1]
    assert late.step(make_points(batches[1], 100), 1)["n_total"] == 60
    assert late.ledger.ticks() == [1, 2]


@pytest.mark.parametrize("mode", ["exact", "partitioned"])
def test_no_point_is_lost(spark, make_points, mode):
    cfg = ModelConfig(q=4, dims=2, t_factor=0.3, delta=100, seed=1, scaling="none",
                      outliers=mode, chunk_rows=9)
    model = OnlineModel(spark, cfg)
    batches = drifting(3, 200, seed=6)
    for i, rows in enumerate(batches):
        model.step(make_points(rows, 1000 * i, parts=6), i)
        delta = model.batch_delta().agg(
            F.sum("n"), F.sum(F.col("cf1x")[0]), F.sum(F.col("cf2x")[1]), F.sum("cf1t")
        ).first()
        assert delta[0] == 200 and delta[3] == 200 * (i + 1)
        np.testing.assert_allclose(delta[1:3], [rows[:, 0].sum(), np.square(rows[:, 1]).sum()])
    # Nothing went stale, so the model holds every point.
    assert model.micro_clusters().agg(F.sum("n")).first()[0] == 600


def test_empty_and_tiny_batches(spark, make_points):
    model = OnlineModel(spark, ModelConfig(q=3, dims=2, seed=1))
    empty = spark.createDataFrame([], "point_id bigint, x array<double>")
    assert model.step(empty, 0) is None and model.current_time == 0
    assert model.step(make_points([[1, 2]]), 1)["n_batch"] == 1
    assert model.step(empty, 2) is None
    assert model.step(make_points([[5, 5], [5, 5]]), 3)["tc"] == 2
    assert model.total_points == 3


@pytest.mark.parametrize("scaling", ["none", "fixed"])
def test_empty_batch_without_moments(spark, make_points, scaling):
    model = OnlineModel(spark, ModelConfig(q=3, dims=2, seed=1, scaling=scaling))
    empty = spark.createDataFrame([], "point_id bigint, x array<double>")
    model.step(make_points([[1, 2], [3, 4], [0, 1]]), 0)
    assert model.step(empty, 1) is None
    assert model.step(make_points([[9, 9]], 10), 2)["tc"] == 2


def test_unusable_rows_are_left_out(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None),
            (5, [2.0, float("inf")]), (6, [3.0, 4.0])]
    points = spark.createDataFrame(rows, "point_id bigint, x array<double>")
    model = OnlineModel(spark, ModelConfig(q=2, dims=2))
    assert model.step(points, 0)["n_batch"] == 2


def test_kmeans_start_waits_for_enough_points(spark, make_points):
    cfg = ModelConfig(q=4, dims=2, min_init_points=70, seed=1, scaling="none")
    model = OnlineModel(spark, cfg)
    batches = drifting(3, 40, seed=2)
    assert not model.step(make_points(batches[0]), 0)["initialized"]
    assert model.ledger.ticks() == []
    done = model.step(make_points(batches[1], 100), 1)
    assert done["initialized"] and done["n_total"] == 80
    state = model.micro_clusters().agg(F.sum("n"), F.sum("cf1t")).first()
    assert tuple(state) == (80, 160)
    assert model.step(make_points(batches[2], 200), 2)["n_total"] == 120


def test_kmeans_start_with_fewer_distinct_points_than_slots(spark, make_points):
    cfg = ModelConfig(q=5, dims=2, min_init_points=4, seed=1, scaling="none")
    model = OnlineModel(spark, cfg)
    model.step(make_points([[1, 1], [1, 1], [9, 9], [9, 9]]), 0)
    state = model.micro_clusters().orderBy("pos").collect()
    assert sorted(r["n"] for r in state) == [0, 0, 0, 2, 2]
    assert sorted(tuple(r["centroid"]) for r in state if r["n"]) == [(1.0, 1.0), (9.0, 9.0)]


def test_streaming_kmeans_start_needs_one_large_batch(spark, make_points):
    cfg = ModelConfig(q=3, dims=2, min_init_points=70, init="streaming_kmeans", seed=1)
    model = OnlineModel(spark, cfg)
    batches = drifting(2, 40, seed=2) + drifting(1, 75, seed=3)
    assert not model.step(make_points(batches[0]), 0)["initialized"]
    # Two small batches have enough points together, but neither has by itself.
    assert not model.step(make_points(batches[1], 100), 1)["initialized"]
    assert model.step(make_points(batches[2], 200), 2)["initialized"]
    # Only the batch that completes the start is assigned.
    assert model.micro_clusters().agg(F.sum("n")).first()[0] == 75
    assert model.total_points == 155


def test_start_from_stored_points(spark, make_points):
    model = OnlineModel(spark, ModelConfig(q=3, dims=2, min_init_points=10, seed=1))
    assert not initialize_from(model, make_points(drifting(1, 5)[0]))
    model = OnlineModel(spark, ModelConfig(q=3, dims=2, min_init_points=10, seed=1))
    assert initialize_from(model, make_points(drifting(1, 30)[0]))
    assert model.current_time == 1 and model.ledger.ticks() == [1]
    assert model.step(make_points(drifting(1, 20, seed=1)[0], 100), 0)["tc"] == 2


def test_start_from_a_file(spark, tmp_path):
    model = OnlineModel(spark, ModelConfig(q=3, dims=2, min_init_points=10, seed=1))
    assert not initialize_from_file(model, str(tmp_path / "absent")) and model.meta is None
    lines = [f"{a},{b}" for a, b in drifting(1, 30)[0]]
    (tmp_path / "points.txt").write_text("\n".join(lines))
    assert initialize_from_file(model, str(tmp_path / "points.txt"))
    assert model.total_points == 30


def test_old_snapshots_are_pruned_by_the_pyramid(spark, make_points):
    cfg = ModelConfig(q=2, dims=2, alpha=2, l=0, window_time=3, scaling="none", seed=1)
    model = OnlineModel(spark, cfg)
    kept_now = {}
    for i in range(9):
        model.step(make_points([[i, 0], [0, i]], 10 * i), i)
        kept_now[i + 1] = model.ledger.ticks()
    life = {1: 4, 2: 8, 3: 4, 4: 16, 5: 4, 6: 8, 7: 4, 8: 32, 9: 4}
    for now, kept in kept_now.items():
        assert kept == [t for t in range(1, now + 1) if now < t + life[t] or t >= now - 1]
    assert model.ledger.ticks("delta") == [6, 7, 8, 9]
    assert model.ledger.expire(9, 2) == len([t for t in kept_now[9] if t < 8])
    assert model.ledger.ticks() == [8, 9]


def test_window_after_a_gap_in_time(spark, make_points):
    cfg = ModelConfig(q=3, dims=2, seed=1, scaling="none", remove_expired=True, window_time=4,
                      delta=99, l=3)
    model = OnlineModel(spark, cfg)
    sizes = {1: 10, 2: 11, 3: 12, 5: 13, 9: 14}
    rng = np.random.default_rng(1)
    held = []
    for tick, size in sizes.items():
        model.step(make_points(rng.normal(size=(size, 2)), 100 * tick), tick, tick)
        held.append(model.micro_clusters().agg(F.sum("n")).first()[0])
    # A tick is taken out when it is three ticks old.
    assert held == [10, 21, 33, 12 + 13, 14]


def test_projected_stream_equals_projected_points(spark, make_points):
    from tickfold.operators import scaling

    batches = drifting(3, 40, dims=5, seed=12)
    pca = scaling.fit_scaled_projection(make_points(batches[0]), 5, 2)
    model = OnlineModel(spark, ModelConfig(q=5, dims=2, seed=1, t_factor=1.0), projection=pca)
    naive = Naive(random_centers(5, 2, 1), 1.0, scale=False)
    axes = pca.pc.toArray()
    for i, rows in enumerate(batches):
        model.step(make_points(rows, 100 * i), i)
        z = (rows - rows.mean(axis=0)) / rows.std(axis=0, ddof=1)
        naive.step((z @ axes).tolist())
        check_same(model, naive)


def test_settings_are_checked():
    for bad in (dict(q=0), dict(init="x"), dict(scaling="x"), dict(outliers="x"), dict(alpha=1),
                dict(window_time=0)):
        with pytest.raises(ValueError):
            ModelConfig(**{"q": 2, "dims": 2, **bad})
    with pytest.raises(ValueError):
        ModelConfig(q=1_000_000, dims=1000)
