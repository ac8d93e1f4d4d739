import os
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tickfold.config import ModelConfig, run_dir
from tickfold.plans.online import OnlineModel
from tickfold.sources import exports
from tickfold.sources import points as src
from tickfold.sources.clock import EventClock
from tickfold.streaming import runner
from tickfold.streaming.kmeans import StreamingKMeans

NOW = {"availableNow": True}


def write_batches(folder, batches):
    """One text file per batch, with ascending times so that they stream in order."""
    os.makedirs(folder, exist_ok=True)
    start = len(os.listdir(folder))
    for i, rows in enumerate(batches, start):
        path = os.path.join(folder, f"part-{i:04d}.txt")
        with open(path, "w") as f:
            f.write("".join(",".join(str(v) for v in r) + "\n" for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def stream(spark, folder):
    return src.stream_text_points(spark, "text", {"path": folder, "maxFilesPerTrigger": "1"})


def test_stream_equals_steps_and_continues_after_restart(spark, tmp_path, make_points):
    rng = np.random.default_rng(0)
    batches = [np.round(rng.normal(size=(30, 2)) * (1 + i), 3) for i in range(5)]
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    root, centers = run_dir(spark, "model"), str(tmp_path / "centers")
    cfg = ModelConfig(q=4, dims=2, seed=1, t_factor=1.0, delta=2)
    hook = runner.centers_hook(centers, h=1, run_num=3, start_tick=2)
    write_batches(folder, batches[:3])
    runner.start(stream(spark, folder), OnlineModel(spark, cfg, root), checkpoint, hook,
                 NOW).awaitTermination()
    assert OnlineModel(spark, cfg, root).current_time == 3
    write_batches(folder, batches[3:])
    runner.start(stream(spark, folder), OnlineModel(spark, cfg, root), checkpoint, hook,
                 NOW).awaitTermination()
    streamed = OnlineModel(spark, cfg, root)
    assert streamed.current_time == 5 and streamed.total_points == 150

    direct = OnlineModel(spark, cfg)
    for i, rows in enumerate(batches):
        direct.step(make_points(rows, 100 * i, parts=1), i)
    state = lambda m: [(r["mc_id"], r["n"], r["ids"]) for r in
                       m.micro_clusters().orderBy("pos").collect()]
    assert state(streamed) == state(direct)

    text = spark.read.text(centers)
    assert {r["tc"] for r in text.select("tc").distinct().collect()} == {2, 3, 4, 5}
    assert all(r["value"].endswith("_3") for r in text.collect())


def test_event_time_ticks_cut_a_batch(spark, tmp_path):
    origin = datetime(2024, 1, 1)
    rows = [(i, origin + timedelta(hours=7 * i), float(i % 5)) for i in range(40)]
    table = spark.createDataFrame(rows, "id bigint, at timestamp_ntz, v double")
    table.coalesce(1).write.parquet(str(tmp_path / "t"))
    clock = EventClock("at", origin, timedelta(days=2))
    cfg = ModelConfig(q=3, dims=1, seed=1)
    live = spark.readStream.schema(table.schema).parquet(str(tmp_path / "t"))
    points = src.read_table_points(live, ["v"], "id", {"tc": clock.tick()})
    model = OnlineModel(spark, cfg)
    runner.start(points, model, str(tmp_path / "c"), trigger=NOW).awaitTermination()
    assert model.current_time == 6 and model.total_points == 40

    stored = spark.read.parquet(str(tmp_path / "t"))
    again = OnlineModel(spark, cfg)
    metas = runner.replay(stored, clock, lambda d: src.read_table_points(d, ["v"], "id"), again)
    assert [m["tc"] for m in metas] == [1, 2, 3, 4, 5, 6]
    key = lambda m: [tuple(r) for r in m.micro_clusters().select("mc_id", "n", "cf1t").collect()]
    assert sorted(key(model)) == sorted(key(again))
    # Everything is done: a second replay has nothing to do.
    assert runner.replay(stored, clock, lambda d: d, again) == []


def test_a_gap_in_time_is_a_gap_in_ticks(spark, make_points):
    model = OnlineModel(spark, ModelConfig(q=2, dims=1, seed=1))
    assert model.step(make_points([[1], [2]]), 3, tick=3)["tc"] == 3
    assert model.step(make_points([[1], [2]]), 9, tick=9)["tc"] == 9
    # The clock never goes back, and late points do not move it.
    row = model.step(make_points([[1], [2], [3]]), 10, tick=5)
    assert (row["tc"], row["part"], row["n_late"]) == (9, 1, 3)


def test_late_ticks_are_parts_of_the_current_one(spark, make_points, tmp_path):
    root = str(tmp_path / "m")
    config = ModelConfig(q=3, dims=1, seed=1, scaling="none")
    seen, rows = [], [[1.0], [2.0], [7.0]]
    for number, tick in enumerate((5, 3, 4, 6, 6, 2)):
        for _ in range(2):  # each batch delivered twice, to a new instance
            row = OnlineModel(spark, config, root).step(make_points(rows, 10 * number), number, tick)
        seen.append((row["tc"], row["part"], row["n_late"], row["n_total"]))
    assert seen == [(5, 0, 0, 3), (5, 1, 3, 6), (5, 2, 3, 9), (6, 0, 0, 12), (6, 1, 0, 15), (6, 2, 3, 18)]
    ledger = OnlineModel(spark, config, root).ledger
    assert ledger.ticks() == [5, 6]
    counts = {r["tc"]: r["sum(n)"] for r in ledger.snapshots().groupBy("tc").sum("n").collect()}
    assert counts == {5: 9, 6: 18}
    deltas = {r["tc"]: (r["n"], r["t"]) for r in ledger.snapshots("delta").groupBy("tc").agg(
        F.sum("n").alias("n"), F.sum("cf1t").alias("t")).collect()}
    assert deltas == {5: (9, 45), 6: (9, 54)}
    # Of tick 5 only the last state is kept, of tick 6 the last two.
    assert ledger.parts(5) == [2] and ledger.parts(6) == [1, 2]


def test_rejects_are_counted_in_the_pass(spark, tmp_path):
    points = spark.createDataFrame(
        [(1, [1.0]), (2, None), (3, [float("nan")]), (4, [2.0]), (5, [1.0, 2.0])], "point_id bigint, x array<double>"
    )
    for i, scaling in enumerate(("batch", "none", "fixed")):
        model = OnlineModel(spark, ModelConfig(q=2, dims=1, scaling=scaling), str(tmp_path / scaling))
        for number in range(2):
            row = model.step(points, number)
            assert (row["n_batch"], row["n_rejected"], row["n_late"]) == (2, 3, 0) and row["ms"] >= 0


def test_a_replay_is_not_repeated_after_its_records_are_pruned(spark, make_points, tmp_path):
    origin = datetime(2024, 1, 1)
    rows = [(i, origin + timedelta(hours=i), float(i % 5)) for i in range(60)]
    table = spark.createDataFrame(rows, "id bigint, at timestamp_ntz, v double")
    clock = EventClock("at", origin, timedelta(days=1))
    model = OnlineModel(spark, ModelConfig(q=3, dims=1, seed=1, alpha=2, l=1), str(tmp_path / "m"))
    again = lambda m: runner.replay(table, clock, lambda d: src.read_table_points(d, ["v"], "id"), m)
    assert [m["tc"] for m in again(model)] == [1, 2, 3]
    for tick in (1000, 1001):
        model.step(make_points([[1], [2]], tick), tick, tick=tick, source="live")
    assert model.ledger.ticks() == [1000, 1001]
    assert again(OnlineModel(spark, model.config, str(tmp_path / "m"))) == [] and model.total_points == 64
    # More of the history comes in later: only its new tick is folded, into the current one.
    more = table.union(spark.createDataFrame([(99, origin + timedelta(days=5), 1.0)], table.schema))
    row, = runner.replay(more, clock, lambda d: src.read_table_points(d, ["v"], "id"),
                         OnlineModel(spark, model.config, str(tmp_path / "m")))
    assert (row["tc"], row["part"], row["n_late"], row["n_total"]) == (1001, 1, 1, 65)


def test_late_points_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "id bigint, tc bigint, v double"
    for rows in ([(1, 5, 1.0), (2, 5, 2.0)], [(3, 3, 1.0), (4, 6, 2.0), (5, 5, 3.0)], [(6, 4, 9.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        model = OnlineModel(spark, ModelConfig(q=2, dims=1, scaling="none"), str(tmp_path / "m"))
        live = spark.readStream.schema(schema).parquet(folder)
        points = live.select(F.col("id").alias("point_id"), F.array("v").alias("x"), "tc")
        records = []
        runner.start(points, model, str(tmp_path / "c"), lambda m, row: records.append(row), NOW).awaitTermination()
        last = [(r["tc"], r["part"], r["n_batch"], r["n_late"]) for r in records]
    assert last == [(6, 1, 1, 1)]
    assert model.total_points == 6 and model.ledger.ticks() == [5, 6]


def test_streaming_kmeans_continues(spark, tmp_path):
    rng = np.random.default_rng(2)
    batches = [rng.normal(size=(20, 2)) + 5 * (np.arange(20)[:, None] % 2) for _ in range(4)]
    folder, root = str(tmp_path / "in"), str(tmp_path / "model")
    start = [[0.0, 0.0], [5.0, 5.0]]
    make = lambda: StreamingKMeans(spark, root, half_life=50.0, initial=start)
    for part in (batches[:2], batches[2:]):
        write_batches(folder, part)
        make().start(stream(spark, folder), str(tmp_path / "c"), NOW).awaitTermination()
    centers, weights = np.array(start), np.zeros(2)
    for rows in batches:
        rows = np.array([[float(str(v)) for v in r] for r in rows])
        label = np.square(rows[:, None] - centers[None]).sum(axis=2).argmin(axis=1)
        weights = weights * 0.5 ** (len(rows) / 50.0)
        for c in range(2):
            n = (label == c).sum()
            if n:
                share = n / (weights[c] + n)
                centers[c] = (1 - share) * centers[c] + share * rows[label == c].mean(axis=0)
                weights[c] += n
    warm, total = make()._before(10**9)
    np.testing.assert_allclose(warm.centers, centers)
    np.testing.assert_allclose(warm.weights, weights)
    assert total == 80


def test_parse_edge_cases(spark):
    lines = ["1,2", " 3 , 4 \n", "5,x", "6", "7,8,9", "NaN,1", "", "1e3,-2.5"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "id int, value string")
    got = {r["id"]: r for r in src.points_of_lines(df).withColumn(
        "reason", src.reject_reason(2)).collect()}
    assert got[0]["x"] == [1.0, 2.0] and got[1]["x"] == [3.0, 4.0] and got[7]["x"] == [1000.0, -2.5]
    assert [got[i]["reason"] for i in range(8)] == [
        None, None, "not a number", "wrong length", "wrong length", "not finite",
        "wrong length", None]
    assert src.rejected_points(src.points_of_lines(df), 2).count() == 5
    labelled = src.points_of_lines(df.where("id = 4"), label_last=True).first()
    assert labelled["x"] == [7.0, 8.0] and labelled["label"] == 9.0


def test_text_files_round_trip(spark, tmp_path, make_points):
    rows = np.random.default_rng(1).normal(size=(50, 3))
    path = str(tmp_path / "points")
    exports.replay_points(make_points(rows), "text", {"path": path})
    back = src.read_text_points(spark, path)
    assert back.select("point_id").distinct().count() == 50
    got = sorted(tuple(r["x"]) for r in back.collect())
    assert got == sorted(tuple(r) for r in rows.tolist())


def test_repeated_export_leaves_no_duplicates(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.5]), (2, [3.0, 4.0])], "tc bigint, center array<double>")
    path = str(tmp_path / "centers")
    exports.write_centers(df, path, 1)
    exports.write_centers(df.where("tc = 2"), path, 1)
    exports.write_centers(df.where("tc = 2"), path, 2)
    got = sorted((r["run"], r["tc"], r["value"]) for r in spark.read.text(path).collect())
    assert got == [(1, 1, "1.0,2.5_1"), (1, 2, "3.0,4.0_1"), (2, 2, "3.0,4.0_2")]


def test_snapshot_text(spark):
    row = (3, [1, 4], [9.0], [3.0], 18, 6, 2)
    df = spark.createDataFrame(
        [row], "tc bigint, ids array<bigint>, cf2x array<double>, cf1x array<double>, "
        "cf2t bigint, cf1t bigint, n bigint")
    lines = exports.snapshot_text(df).first()["value"].split("\n")
    assert lines[1:] == ["MicroCluster IDs = [1,4]", "CF2X = [9.0]", "CF1X = [3.0]", "CF2T = 18",
                         "CF1T = 6", "N = 2"]


def test_sources_follow_each_other(spark, tmp_path, make_points):
    """A source that counts its batches anew goes on from the newest tick."""
    model = OnlineModel(spark, ModelConfig(q=4, dims=1, scaling="none"), str(tmp_path / "m"))
    assert model.step(make_points([[1], [2]]), 5, source="a")["tc"] == 1
    assert model.step(make_points([[1], [2], [3]], 10), 6, source="a")["n_total"] == 5
    again = OnlineModel(spark, model.config, str(tmp_path / "m"))
    assert again.step(make_points([[1]], 20), 0, source="b")["n_total"] == 6
    repeated = OnlineModel(spark, model.config, str(tmp_path / "m"))
    row = repeated.step(make_points([[1], [2]], 20), 0, source="b")
    assert (row["tc"], row["n_total"]) == (3, 7)


def test_gap_longer_than_a_snapshot_lives(spark, tmp_path, make_points):
    config = ModelConfig(q=4, dims=1, scaling="none", alpha=2, l=1)
    model = OnlineModel(spark, config, str(tmp_path / "m"))
    for tick in (1, 2, 100):
        model.step(make_points([[1], [2]], tick), tick, tick=tick)
    again = OnlineModel(spark, config, str(tmp_path / "m"))
    row = again.step(make_points([[1], [2], [3]], 100), 100, tick=100)
    assert (row["tc"], row["n_total"]) == (100, 7)
