"""Drive an online model from a stream, or from a stored history in tick order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickfold.plans.history import catalog_of, horizon_centers, request_frame
from tickfold.plans.online import OnlineModel
from tickfold.sources.clock import EventClock
from tickfold.sources.exports import write_centers

Hook = Callable[[OnlineModel, Row], None]


# Room for the ticks of one batch when they are numbered for replay.
TICKS_PER_BATCH = 1 << 20
# Source of the batches of a replay; their numbers are the ticks of the history.
REPLAY = "replay"


def start(
    points: DataFrame,
    model: OnlineModel,
    checkpoint: str,
    on_tick: Hook | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the online model on a streaming DataFrame.

    Every batch is a tick; if the points carry an event-time tick ``tc``, a batch
    is cut by it, in ascending order. Points of ticks that are over come late: they are
    folded into the tick the clock stands at, and counted. A batch that is repeated after a failure
    starts from the state before it and overwrites its own output. ``on_tick``
    runs after the tick is committed, in the same batch, so it too is repeated
    with it.
    """

    def step(part: DataFrame, number: int, tick: int | None = None) -> None:
        row = model.step(part, number, tick, source=checkpoint)
        if row is not None and on_tick is not None:
            on_tick(model, row)

    def fold(batch: DataFrame, batch_id: int) -> None:
        first = batch_id * TICKS_PER_BATCH
        if "tc" not in batch.columns:
            step(batch, first)
            return
        batch = batch.persist()
        # The clock as this batch met it, also when the batch is repeated.
        before = model.ledger.last_before(first, checkpoint)
        now = before["tc"] if before else 0
        ticks = catalog_of(batch)
        if any(tick <= now for tick in ticks):
            step(batch.where(F.col("tc") <= now), first, now)
        for i, tick in enumerate((t for t in ticks if t > now), start=1):
            step(batch.where(F.col("tc") == tick), first + i, tick)
        batch.unpersist()

    writer = points.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def replay(
    history: DataFrame,
    clock: EventClock,
    to_points: Callable[[DataFrame], DataFrame],
    model: OnlineModel,
    on_tick: Hook | None = None,
) -> list[Row]:
    """Fold a stored history into the model, tick by tick of its event time.

    Each tick reads its own range of the time column, so a table laid out by time
    is read once. Ticks that replays of this model have committed are skipped, which
    makes an interrupted replay continue, however much other sources have brought since.
    On a model that is ahead of the history, ticks that are over are folded into the
    current one.
    """
    done = model.ledger.position(REPLAY)
    ticks = catalog_of(history.select(clock.tick().alias("tc")))
    ticks = [t for t in ticks if done is None or t > done]
    rows = []
    for tick in ticks:
        row = model.step(to_points(history.where(clock.within(tick))), tick, tick, REPLAY)
        if row is not None:
            rows.append(row)
            if on_tick is not None:
                on_tick(model, row)
    return rows


def centers_hook(path: str, h: int, run_num: int, start_tick: int) -> Hook:
    """Write the centers of the last ``h`` ticks from ``start_tick`` on."""

    def hook(model: OnlineModel, row: Row) -> None:
        if not row["initialized"] or row["tc"] < start_tick:
            return
        ledger = model.ledger
        asked = request_frame(model.spark, [(row["tc"], h)])
        found = horizon_centers(
            ledger.snapshots(), asked, ledger.ticks(), model.config.dims
        )
        write_centers(found.select("tc", F.col("center")), path, run_num)

    return hook
