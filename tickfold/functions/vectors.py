"""Column expressions over ``array<double>`` vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def divide(a, scalar: Column) -> Column:
    return F.transform(a, lambda x: x / scalar)


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def squared_distance(a, b) -> Column:
    return squared_norm(subtract(a, b))


def zeros(dims: int) -> Column:
    return F.array_repeat(F.lit(0.0), dims)


def literal(values) -> Column:
    """A numeric sequence as an ``array<double>`` literal."""
    return F.array(*[F.lit(float(v)) for v in values])


def join_text(a, sep: str = ",") -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), sep)
