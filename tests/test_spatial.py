"""Nearest centroids of a large table against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickfold.operators import nearest as near
from tickfold.operators import spatial


def table(spark, x, parts=4):
    rng = np.random.default_rng(len(x))
    pos = rng.permutation(len(x)) - 5  # some below zero
    rows = [(int(p), int(p) + 100, None if v is None else [float(c) for c in v], float(i))
            for i, (p, v) in enumerate(zip(pos, x))]
    return pos, spark.createDataFrame(rows, "pos int, mc_id bigint, centroid array<double>, rmsd double").repartition(parts)


def brute(pos, x):
    out = {}
    for p, v in zip(pos, x):
        if v is None:
            continue
        some = [(float(np.square(np.subtract(v, w)).sum()), int(o)) for o, w in zip(pos, x) if w is not None]
        out[int(p)] = min((s for s in some if s[0] > 0), default=None)
    return out


def cloud(seed, n, dims):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)) * [1, 1000, 0.01, 5, 1, 1, 1][:dims], 2)
    x[rng.random(n) < 0.3] = x[0]  # equal centroids, and ties of rounded ones
    return [None if i % 50 == 7 else v for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("dims", [1, 2, 7])
def test_nearest_other_by_leaf(spark, monkeypatch, dims):
    monkeypatch.setattr(near, "BLOCK_ROWS", 50)
    monkeypatch.setattr(spatial, "LEAF_ROWS", 8)
    monkeypatch.setattr(spatial, "VISITORS", 100)
    x = cloud(dims, 260, dims)
    pos, mcs = table(spark, x)
    got = {r["pos"]: r for r in near.nearest_other(mcs).collect()}
    want = brute(pos, x)
    assert set(got) == set(want)
    for p, best in want.items():
        assert (got[p]["nearest"]["d2"], got[p]["nearest"]["pos"]) == best
        assert got[p]["nearest"]["mc_id"] == best[1] + 100
    some = near.nearest_other(mcs.withColumn("leaf", F.lit("x")), where=F.col("pos") % 3 == 0).collect()
    assert all((r["nearest"] is not None) == (r["pos"] % 3 == 0) for r in some) and len(some) == len(want)


@pytest.mark.parametrize("equal", [True, False])
def test_closest_pair_by_leaf(spark, monkeypatch, equal):
    monkeypatch.setattr(near, "BLOCK_ROWS", 50)
    monkeypatch.setattr(spatial, "LEAF_ROWS", 8)
    x = cloud(3, 200, 2) if equal else np.random.default_rng(4).normal(size=(200, 2)).tolist()
    pos, mcs = table(spark, x)
    pairs = [
        (float(np.square(np.subtract(v, w)).sum()), int(p), int(o))
        for p, v in zip(pos, x) for o, w in zip(pos, x) if v is not None and w is not None and p < o
    ]
    assert tuple(near.closest_pair(mcs.drop("rmsd") if equal else mcs).first()) == min(pairs)


def test_alike_centroids_have_no_other(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_ROWS", 5)
    _, mcs = table(spark, [[1.0, 2.0]] * 9)
    assert all(r["nearest"] is None for r in near.nearest_other(mcs).collect())
    assert tuple(near.closest_pair(mcs).first()) == (0.0, -5, -4)


def test_few_leaves_are_visited(spark):
    """20,000 centroids in a plane: far fewer distances than pairs."""
    x = np.random.default_rng(5).random((20_000, 2))
    _, mcs = table(spark, x.tolist())
    stored = spatial._numbered(mcs, F.lit(True))
    members, leaves = spatial._members(spatial._stored(spatial._distinct(stored), "c"), 20_000)
    sizes = members.groupBy("leaf").count()
    assert leaves == 64 and sizes.agg(F.max("count")).first()[0] < 4 * spatial.LEAF_ROWS
    visitors = spatial.visits(members, spatial._own_leaf(members)).groupBy("leaf").count()
    work = visitors.withColumnRenamed("count", "v").join(sizes, "leaf").agg(F.sum(F.expr("v * count"))).first()[0]
    own = sizes.agg(F.sum(F.expr("count * count"))).first()[0]
    assert work + own < 20_000**2 / 20
