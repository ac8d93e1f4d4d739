"""What the physical plans must look like for large inputs."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickfold.operators import features, scaling
from tickfold.operators.absorb import absorb, partial_sums
from tickfold.operators.nearest import Model, nearest
from tickfold.plans.history import horizon, request_frame
from tickfold.plans.ledger import Ledger
from tickfold.sources.clock import EventClock
from tickfold.sources.points import read_table_points


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), f"t{i % 3}", float(i), "x")
            for i in range(100)]
    path = str(tmp_path / "events")
    spark.createDataFrame(
        rows, "id bigint, at timestamp_ntz, kind string, v double, other string"
    ).write.parquet(path)
    return spark.read.parquet(path)


CLOCK = EventClock("at", datetime(2024, 1, 1), timedelta(days=1))


def test_a_tick_reads_its_time_range_and_two_columns(events):
    part = read_table_points(events.where(CLOCK.within(2)), ["v"], "id")
    plan = plan_of(part)
    assert "GreaterThanOrEqual(at" in plan and "LessThan(at" in plan
    assert "ReadSchema: struct<id:bigint,at:timestamp_ntz,v:double>" in plan
    assert part.count() == 24


def test_assignment_moves_no_points(events):
    points = read_table_points(events, ["v"], "id")
    model = Model.of_centers(np.array([[0.0], [50.0]]))
    assert "Exchange" not in plan_of(nearest(points, model))
    work = absorb(points, model)
    assert "Exchange" not in plan_of(work)
    # One exchange, of rows that were already summed up in their task.
    plan = plan_of(partial_sums(work, 1))
    assert plan.count("Exchange") == 1
    assert plan.index("Exchange") < plan.index("MapInArrow")


def test_features_combine_before_the_exchange(events):
    points = read_table_points(events, ["v"], "id", {"kind": F.col("kind")})
    plan = plan_of(features.features_of_points(points, ["kind"], 1))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    assert plan.index("Exchange") < plan.index("partial_sum")


def test_standardising_broadcasts_counted_moments_only(events, monkeypatch):
    points = read_table_points(events, ["v"], "id", {"tc": CLOCK.tick()})
    plan = plan_of(scaling.standardize(points, "tc", 1))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    small = sorted(map(str, scaling.standardize(points, "tc", 1).collect()))
    monkeypatch.setattr(features, "MAX_BROADCAST_BYTES", 0)
    points.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = scaling.standardize(points, "tc", 1)
        assert "BroadcastHashJoin" not in plan_of(big)
        assert sorted(map(str, big.collect())) == small
    finally:
        points.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snapshots_are_read_by_partition(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "root"))
    rows = [(0, 0, 1, [1.0], [1.0], t, t * t, [0], [1.0], 0.0, "state", t, 0) for t in (1, 2, 3)]
    ledger.write(spark.createDataFrame(
        rows, "pos int, mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>, "
        "cf1t bigint, cf2t bigint, ids array<bigint>, centroid array<double>, rmsd double, "
        "kind string, tc bigint, part bigint"))
    for t in (1, 2, 3):
        folder = tmp_path / "root" / "meta" / f"tc={t}"
        folder.mkdir(parents=True)
        (folder / "record-0.json").write_text("{}")
    plan = plan_of(ledger.snapshots().where("tc = 2"))
    assert "PartitionFilters" in plan and "tc" in plan.split("PartitionFilters")[1][:120]
    assert ledger.ticks() == [1, 2, 3]


def test_horizons_join_on_keys_only(spark):
    snaps = spark.createDataFrame(
        [(t, 0, 0, 1, [1.0], [1.0], 1, 1, [0]) for t in (1, 2)],
        "tc bigint, pos int, mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>, "
        "cf1t bigint, cf2t bigint, ids array<bigint>")
    plan = plan_of(horizon(snaps, request_frame(spark, [(2, 1)]), [1, 2], 1))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_horizon_moves_each_row_once(spark):
    """Two exchanges, one for each side; ids are not exploded next to vectors."""
    fields = "pos int, mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint, ids array<bigint>, tc bigint"
    rows = [(0, 0, 9 * t, [1.0 * t], [1.0 * t], t, t * t, [0], t) for t in (1, 2, 3)]
    snapshots = spark.createDataFrame(rows, fields)
    asked = request_frame(spark, [(3, 1)])
    found = horizon(snapshots, asked, [1, 2, 3], 1)
    assert found.select("n", "cf1x").collect()[0] == (9, [1.0])
    plan = plan_of(found)
    assert plan.count("Exchange hashpartitioning") <= 4 and "Generate" not in plan
