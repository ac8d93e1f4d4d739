"""Event time to ticks, for sources that carry a timestamp."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventClock:
    """Tick t covers [origin + (t-1) * width, origin + t * width)."""

    column: str
    origin: datetime
    width: timedelta

    def tick(self) -> Column:
        micros = F.unix_micros(F.col(self.column).cast("timestamp"))
        start = F.unix_micros(self._literal(self.origin).cast("timestamp"))
        width = int(self.width.total_seconds() * 1_000_000)
        return (F.floor((micros - start) / F.lit(width)) + 1).cast("bigint")

    def within(self, tick: int) -> Column:
        """Range test on the bare column, so that the scan can skip by statistics."""
        begin = self.origin + (tick - 1) * self.width
        return (F.col(self.column) >= self._literal(begin)) & (
            F.col(self.column) < self._literal(begin + self.width)
        )

    @staticmethod
    def _literal(moment: datetime) -> Column:
        return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
