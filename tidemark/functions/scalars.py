"""Scalar column helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def clip(x, lo=None, hi=None) -> Column:
    """Bound x; a null bound does not bound, a null value stays null."""
    x = _c(x)
    out = x
    if hi is not None:
        out = F.least(out, _c(hi))
    if lo is not None:
        out = F.greatest(out, _c(lo))
    return F.when(x.isNotNull(), out)


def flag(cond: Column) -> Column:
    """0/1 where an unknown comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def div(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def sign(x) -> Column:
    return F.signum(_c(x))


def norm_cdf(x) -> Column:
    """Standard normal distribution function.

    Spark has no erf; Hart's (1968) rational approximation in the form published by West
    ("Better approximations to cumulative normal functions", 2005) is accurate to 1e-15.  The argument
    is written out many times: pass a column, not a long expression.
    """
    x = _c(x).cast("double")
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    # fixed values: numerator and denominator coefficients of the approximation
    num = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376]
    den = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]

    def poly(cs):
        acc = F.lit(cs[0])
        for c in cs[1:]:
            acc = acc * z + F.lit(c)
        return acc

    mid = e * poly(num) / poly(den)
    tail = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    upper = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, mid).otherwise(tail)
    return F.when(x.isNull(), F.lit(None)).when(x > 0, 1 - upper).otherwise(upper)


def unit_hash(*cols) -> Column:
    """Uniform (0,1) number from the md5 of the joined text: the same on every engine and under
    every partitioning.  52 bits are used, so the value is exact in a double."""
    text = F.concat_ws(":", *[_c(c).cast("string") for c in cols])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def normal_hash(*cols) -> Column:
    """Standard normal number by Box-Muller on two hash draws."""
    u = unit_hash(*cols, F.lit("u"))
    v = unit_hash(*cols, F.lit("v"))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)
