from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickfold.config import ModelConfig
from tickfold.functions.pyramid import max_retained, order_of, retained, retained_ticks
from tickfold.plans import history, macro
from tickfold.plans.online import OnlineModel

SNAPSHOT = ("tc bigint, pos int, mc_id bigint, n bigint, cf1x array<double>, "
            "cf2x array<double>, cf1t bigint, cf2t bigint, ids array<bigint>")


def snap(spark, rows):
    table = [(tc, pos, ids[0], n, [float(n)], [float(n)], n, n, ids) for tc, pos, n, ids in rows]
    return spark.createDataFrame(table, SNAPSHOT)


def replayed(last, alpha, l):
    """Write and delete tick by tick."""
    kept = set()
    for tc in range(1, last + 1):
        order = 0
        while tc % alpha ** (order + 1) == 0:
            order += 1
        kept.add(tc)
        kept.discard(tc - (alpha**l + 1) * alpha ** (order + 1))
    return kept


@pytest.mark.parametrize("alpha,l", [(2, 1), (2, 2), (2, 10), (3, 1), (10, 1), (5, 0)])
def test_retention_equals_writing_and_deleting(spark, alpha, l):
    for now in (1, 26, 243, 1000):
        want = replayed(now, alpha, l)
        assert set(retained_ticks(range(1, now + 1), now, alpha, l)) == want
        ticks = spark.range(1, now + 1).withColumnRenamed("id", "tc")
        got = ticks.where(retained(F.col("tc"), now, alpha, l)).collect()
        assert {r["tc"] for r in got} == want
        assert len(want) <= max_retained(now, alpha, l)


def test_order_is_exact_for_powers(spark):
    ticks = spark.createDataFrame([(243,), (1000,), (2**40,), (7,)], "tc bigint")
    def order(alpha):
        return [r[0] for r in ticks.select(order_of(F.col("tc"), alpha)).collect()]
    assert order(3) == [5, 0, 0, 0] and order(10) == [0, 3, 0, 0] and order(2) == [0, 3, 40, 0]


def test_as_of(spark):
    asked = history.request_frame(spark, [(10, 3), (10, 100), (5, 1), (1, 1), (8, 0)])
    got = {(r["tc"], r["h"]): (r["t1"], r["t2"]) for r in history.as_of(asked, [2, 4, 8]).collect()}
    assert got == {(10, 3): (8, 4), (10, 100): (8, 2), (5, 1): (4, 2), (1, 1): (-1, -1),
                   (8, 0): (8, 8)}
    none = history.as_of(asked, []).collect()
    assert all((r["t1"], r["t2"]) == (-1, -1) for r in none)


def test_horizon_subtracts_relatives_and_their_ids(spark):
    s = snap(spark, [(4, 0, 10, [0]), (4, 1, 20, [1]), (4, 2, 5, [2]),
                     (8, 0, 40, [0, 1]), (8, 1, 7, [3]), (8, 2, 9, [2, 4])])
    asked = history.request_frame(spark, [(9, 2), (9, 50), (3, 1)])
    rows = history.horizon(s, asked, [4, 8], 1).collect()
    got = {(r["h"], r["pos"]): (r["n"], r["ids"], r["cf1x"]) for r in rows}
    assert got == {
        (2, 0): (10, [], [10.0]), (2, 1): (7, [3], [7.0]), (2, 2): (4, [4], [4.0]),
        # The history is shorter than 50 ticks: all of it.
        (50, 0): (40, [0, 1], [40.0]), (50, 1): (7, [3], [7.0]), (50, 2): (9, [2, 4], [9.0]),
    }
    report = {r["h"]: (r["mc_count"], r["n_points"])
              for r in history.horizon_report(s, asked, [4, 8], 1).collect()}
    assert report == {2: (3, 21), 50: (3, 56)}


def test_missing_snapshot(spark):
    s = snap(spark, [(4, 0, 10, [0])])
    assert history.snapshot_at(s, 4).count() == 1
    with pytest.raises(history.SnapshotMissing):
        history.snapshot_at(s, 5)


def test_keep_rules(spark):
    s = snap(spark, [(t, 0, 1, [0]) for t in range(1, 11)])
    assert history.catalog_of(history.keep_unexpired(s, 10, 3)) == [8, 9, 10]
    assert history.catalog_of(history.keep_retained(s, 10, 2, 0)) == sorted(replayed(10, 2, 0))


def test_horizon_of_a_live_model_is_the_sum_of_its_deltas(spark, make_points):
    rng = np.random.default_rng(1)
    # Nothing goes stale, so no micro-cluster is given up.
    model = OnlineModel(spark, ModelConfig(q=4, dims=2, delta=99, t_factor=0.7, seed=1,
                                           scaling="none"))
    sizes = [30, 25, 35, 20]
    for i, size in enumerate(sizes):
        model.step(make_points(rng.normal(size=(size, 2)) * (1 + i), 100 * i), i)
    ledger = model.ledger
    asked = history.request_frame(spark, [(4, h) for h in (1, 2, 3)])
    h = history.horizon(ledger.snapshots(), asked, ledger.ticks(), 2)
    deltas = {r["tc"]: r for r in ledger.snapshots("delta").groupBy("tc").agg(
        F.sum("n").alias("n"), F.sum(F.col("cf1x")[0]).alias("s")).collect()}
    for r in h.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("cf1x")[0]).alias("s")).collect():
        span = range(4 - r["h"] + 1, 5)
        assert r["n"] == sum(deltas[t]["n"] for t in span) == sum(sizes[t - 1] for t in span)
        assert r["s"] == pytest.approx(sum(deltas[t]["s"] for t in span))
    swept = macro.offline_sweep(ledger.snapshots(), asked, ledger.ticks(), 2, k=2).collect()
    by_h = {}
    for r in swept:
        by_h[r["h"]] = by_h.get(r["h"], 0) + r["weight"]
    assert by_h == {1: 20, 2: 55, 3: 80}


def test_as_of_merges_ticks_of_any_number(spark):
    edges = [-(1 << 62), -70_000, -1, 0, 1, 65_535, 65_536, 1 << 17, 1 << 33, (1 << 62) + 5]
    asked = [(t + d, h) for t in edges for d in (-1, 0, 1) for h in (0, 1, 65_536, 1 << 34)] + [(None, 1), (3, None)]
    asked += asked[:5]  # repeated requests stay

    def expected(tc, h):
        at = bisect_right(edges, tc) if tc is not None else 0
        if not at:
            return tc, h, -1, -1
        t1 = edges[at - 1]
        older = bisect_right(edges, t1 - h) if h is not None else 0
        return tc, h, t1, edges[older - 1] if older else edges[0]

    def key(row):
        return tuple((v is not None, v or 0) for v in row)

    requests = spark.createDataFrame(asked, "tc bigint, h bigint")
    ticks = spark.createDataFrame([(t,) for t in edges + edges[:3]] + [(None,)], "tc bigint")
    want = sorted((expected(*r) for r in asked), key=key)
    for known in (ticks, edges):
        assert sorted((tuple(r) for r in history.as_of(requests, known).collect()), key=key) == want
    none = history.as_of(requests, ticks.where("false")).select("t1", "t2").distinct()
    assert [tuple(r) for r in none.collect()] == [(-1, -1)]
    assert history.as_of(requests.where("false"), ticks).count() == 0


def test_as_of_a_million_ticks(spark):
    ticks = spark.range(0, 3_000_000, 3).select(F.col("id").alias("tc"))
    requests = spark.range(1, 3_000_000, 7).select(F.col("id").alias("tc"), F.lit(100_000).cast("bigint").alias("h"))
    out = history.as_of(requests, ticks)
    t1 = F.col("tc") - F.col("tc") % 3
    t2 = F.greatest(F.col("t1") - 100_000 - F.pmod(F.col("t1") - 100_000, F.lit(3)), F.lit(0))
    right = out.agg(F.count("*").alias("rows"), F.count_if((F.col("t1") == t1) & (F.col("t2") == t2)).alias("good")).first()
    assert right.rows == right.good == requests.count()
    # The plan does not grow with the ticks.
    few = history.as_of(requests, spark.range(0, 30, 3).select(F.col("id").alias("tc")))
    size, least = (len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (out, few))
    assert size < 1.05 * least
