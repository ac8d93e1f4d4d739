"""Times of the headline operations; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickfold.catalog import tables as T  # noqa: E402
from tickfold.catalog.queries import QUERIES, STREAM  # noqa: E402
from tickfold.operators.absorb import absorb, partial_sums  # noqa: E402
from tickfold.operators.nearest import Model  # noqa: E402
from tickfold.plans import history, macro  # noqa: E402
from tickfold.plans.initial import random_centers  # noqa: E402
from tickfold.plans.online import OnlineModel  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 5

# Registered queries that read the larger tables or shuffle.
TIMED = [
    "standardize_batch", "standardize_lineitem", "assign_nearest", "assign_totals",
    "cf_by_cluster", "cf_lineitem", "mc_rmsd", "cumulative_snapshots", "horizon_subtract",
    "offline_sweep", "lloyd_step", "init_random",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tickfold-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the call site of every column expression costs driver time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def median_of(fn, runs: int = RUNS) -> float:
    fn()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        fn()
        times.append(time.perf_counter() - start)
    return statistics.median(times)


def main() -> None:
    spark = session()
    out: dict[str, float] = {}
    facts: dict[str, float] = {}

    def assign_and_sum(points, centers):
        model = Model.of_centers(centers)
        return lambda: partial_sums(absorb(points, model), model.dims).collect()

    lineitem = T.lineitem_points(spark, SF_DIR)
    scale = np.array([50.0, 1e5, 0.1, 0.08])
    seconds = median_of(assign_and_sum(lineitem, random_centers(100, 4, 1) * scale))
    out["assign_cf_lineitem_4d_q100"] = seconds
    facts["lineitem_points_per_sec"] = lineitem.count() / seconds

    embedded = T.embedding_points(spark, SF_DIR)
    tenfold = embedded.select(F.explode(F.array_repeat("x", 10)).alias("x"))
    tenfold = tenfold.withColumn("point_id", F.lit(0).cast("bigint")).repartition(int(CPUS))
    tenfold = tenfold.persist()
    size = tenfold.count()
    seconds = median_of(assign_and_sum(tenfold, random_centers(100, 64, 1) - 0.5))
    out["assign_cf_embeddings_64d_q100"] = seconds
    facts["embedding_points_per_sec"] = size / seconds
    tenfold.unpersist()

    model = OnlineModel(spark, STREAM)
    events = T.table(spark, SF_DIR, "events")
    steps, total = [], 0
    for tick in history.catalog_of(events.select(T.CLOCK.tick().alias("tc"))):
        start = time.perf_counter()
        row = model.step(T.event_vectors(events.where(T.CLOCK.within(tick))), tick, tick)
        took = time.perf_counter() - start
        if tick == 1 or not row["initialized"]:
            out["online_init"] = out.get("online_init", 0.0) + took
        else:
            steps.append(took)
        # The record's own time, added up, at ticks that lie ever further apart.
        if row["initialized"]:
            facts.setdefault("ms_init", row["ms"])
            total += row["ms"]
        if row["tc"] in (5, 10, 20):
            facts[f"ms_to_tick_{row['tc']}"] = total
    out["online_step_median"] = statistics.median(steps)
    out["online_step_p95"] = float(np.percentile(steps, 95))

    ledger, last = model.ledger, model.current_time
    snapshots, ticks = ledger.snapshots(), ledger.ticks()
    for h in (1, 6, 12):
        asked = history.request_frame(spark, [(last, h)])
        out[f"horizon_h{h}"] = median_of(
            lambda asked=asked: history.horizon(snapshots, asked, ticks, 2).collect()
        )
    mcs = history.horizon(snapshots, history.request_frame(spark, [(last, 6)]), ticks, 2)
    mcs = mcs.persist()
    for k in (5, 10):
        out[f"macro_k{k}"] = median_of(lambda k=k: macro.macro_clusters(mcs, k).collect(), 3)
    mcs.unpersist()

    for name in TIMED:
        query = QUERIES[name]
        out[name] = median_of(
            lambda query=query: query(spark, SF_DIR).write.format("noop").mode("overwrite").save(),
            2,
        )
    line = {
        "metric": "total time of the headline operations",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": {name: round(v, 4) for name, v in out.items()},
        "facts": {name: round(v) for name, v in facts.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
