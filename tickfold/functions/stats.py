"""Uniform draws that do not depend on partitioning, and the recency stamp."""

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits of an md5 are 52 bits: the mantissa of a double.
UNIFORM_DIGITS = 13


def uniform(seed: int, *keys: Column) -> Column:
    """Draw from [0, 1) that is a function of the seed and the keys only.

    ``rand(seed)`` depends on the partition a row falls in; this does not, so a
    retried or repartitioned job draws the same numbers.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    head = F.substring(F.md5(text), 1, UNIFORM_DIGITS)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(16**UNIFORM_DIGITS))


# Rational approximation of the normal quantile (Wichura 1988, algorithm AS 241): numerator
# and denominator near the middle and in two parts of the tail, highest power first. Fixed values.
CENTRAL = (
    (2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987,
     13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665),
    (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597,
     5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0),
)
NEAR_TAIL = (
    (0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684,
     3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835),
    (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008,
     0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0),
)
FAR_TAIL = (
    (2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124,
     0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103),
    (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133,
     0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0),
)


def _ratio(x, coefficients):
    """A quotient of two polynomials, of numbers, arrays or columns."""
    top, bottom = (functools.reduce(lambda value, c: value * x + c, part) for part in coefficients)
    return top / bottom


def _quantile(p, choose, log, sqrt):
    """Normal quantile for 0 < p < 1, of arrays or columns."""
    q = p - 0.5
    r = sqrt(-log(choose(q <= 0, p, 1.0 - p)))
    tail = choose(r <= 5.0, _ratio(r - 1.6, NEAR_TAIL), _ratio(r - 5.0, FAR_TAIL))
    middle = q * _ratio(0.180625 - q * q, CENTRAL)
    return choose((q <= 0.425) & (q >= -0.425), middle, choose(q < 0, -tail, tail))


def normal_quantile(p: Column) -> Column:
    """Normal quantile as an expression, for 0 < p < 1."""
    return _quantile(p, lambda c, a, b: F.when(c, a).otherwise(b), F.ln, F.sqrt)


def recency_stamps(n, cf1t, cf2t, m_last_points: int) -> np.ndarray:
    """Arrival time of the ``m_last_points``-th newest point, from the time moments.

    Small micro-clusters use their mean arrival time; larger ones the quantile
    1 - m/(2n) of a normal distribution with the mean and deviation of the
    arrival times.
    """
    n = np.asarray(n, dtype=float)
    size = np.where(n > 0, n, 1.0)
    mean = np.where(n > 0, np.asarray(cf1t, dtype=float) / size, 0.0)
    spread = np.sqrt(np.maximum(np.asarray(cf2t, dtype=float) / size - mean * mean, 0.0))
    large = n >= 2 * m_last_points
    p = np.where(large, 1.0 - m_last_points / (2.0 * size), 0.5)
    return np.where(large, mean + spread * _quantile(p, np.where, np.log, np.sqrt), mean)


def recency_stamp(n: Column, cf1t: Column, cf2t: Column, m_last_points: int) -> Column:
    """``recency_stamps`` as an expression of columns."""
    size = F.when(n > 0, n).otherwise(1).cast("double")
    mean = F.when(n > 0, cf1t / size).otherwise(0.0)
    spread = F.sqrt(F.greatest(cf2t / size - mean * mean, F.lit(0.0)))
    quantile = normal_quantile(1.0 - m_last_points / (2.0 * size))
    return F.when(n >= 2 * m_last_points, mean + spread * quantile).otherwise(mean)


def is_stale(n: Column, stamp: Column, tc, delta: int) -> Column:
    """A micro-cluster that may be given up: empty, or older than ``delta`` ticks."""
    return (n == 0) | (stamp < F.lit(tc) - F.lit(delta))
