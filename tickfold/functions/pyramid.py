"""Pyramidal time frame: which ticks keep their snapshot, and for how long."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TICK = 2**63 - 1


def _powers(alpha: int) -> list[int]:
    powers, p = [], alpha
    while p <= MAX_TICK:
        powers.append(p)
        p *= alpha
    return powers


def order_of(tc: Column, alpha: int) -> Column:
    """Largest i such that alpha^i divides the tick, in integer arithmetic."""
    powers = F.array(*[F.lit(p).cast("bigint") for p in _powers(alpha)])
    return F.size(F.filter(powers, lambda p: tc % p == 0))


def order_of_tick(tc: int, alpha: int) -> int:
    order = 0
    while tc % alpha == 0:
        tc //= alpha
        order += 1
    return order


def lifetime_of_tick(tc: int, alpha: int, l: int) -> int:  # noqa: E741
    return (alpha**l + 1) * alpha ** (order_of_tick(tc, alpha) + 1)


def retained(tc: Column, now, alpha: int, l: int) -> Column:  # noqa: E741
    """True while the snapshot of ``tc`` is still kept at tick ``now``.

    A snapshot of order i lives (alpha^l + 1) * alpha^(i + 1) ticks.
    """
    lifetime = (alpha**l + 1) * F.pow(F.lit(float(alpha)), order_of(tc, alpha) + 1)
    return (tc >= 1) & (tc <= F.lit(now)) & (F.lit(now) < tc + lifetime)


def retained_ticks(ticks, now: int, alpha: int, l: int) -> list[int]:  # noqa: E741
    return [t for t in ticks if 1 <= t <= now < t + lifetime_of_tick(t, alpha, l)]


def max_retained(now: int, alpha: int, l: int) -> int:  # noqa: E741
    """Upper bound of the number of snapshots kept at tick ``now``."""
    orders, p = 1, alpha
    while p <= now:
        orders += 1
        p *= alpha
    return orders * (alpha**l + 1) * alpha
