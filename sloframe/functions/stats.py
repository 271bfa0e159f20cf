"""Closed-form statistics as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation 7.1.26 of the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, absolute error below 1.5e-7."""
    t = 1.0 / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(2.0 ** 0.5))


def spearman_p(rho: Column, n: Column, small_sample: bool = False) -> Column:
    """p-value of a rank correlation from t taken as normal.

    ``small_sample`` scales t by the usual correction when more than two degrees
    of freedom are left.
    """
    t = F.abs(rho * F.sqrt((n - 2) / (1.0 - rho * rho)))
    if small_sample:
        df = (n - 2).cast("double")
        t = F.when(df > 2, t * F.sqrt(1.0 - 1.0 / (4.0 * df) - 7.0 / (120.0 * df * df))).otherwise(t)
    return F.when(F.abs(rho) >= 1.0, F.lit(0.0)).when(n < 3, F.lit(1.0)).otherwise(two_sided_p(t))


def hash32(key: Column) -> Column:
    """Uniform integer 0..2^32-1 from md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def hash60(key: Column) -> Column:
    """Like ``hash32`` with 60 bits, for picks from very long lists."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint")


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; 0 for fewer than three pairs or no variance."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= 3) & (vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx * vy)).otherwise(F.lit(0.0))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Struct(lower, upper) of the Wilson score interval."""
    # No rows give NULL, not a failing division.
    n = F.when(n > 0, n)
    p = successes / n
    denom = 1.0 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / denom
    return F.struct((centre - half).alias("lower"), (centre + half).alias("upper"))


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def two_proportion_z(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    n1, n2 = F.when(n1 > 0, n1), F.when(n2 > 0, n2)
    pooled = (s1 + s2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1.0 / n1 + 1.0 / n2))
    return F.when(se > 0, (s1 / n1 - s2 / n2) / se).when(se.isNotNull(), F.lit(0.0))
