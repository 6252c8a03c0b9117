"""Normal distribution as column expressions (Spark SQL has no ``erf``)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _poly(x: Column, coefficients: list[float]) -> Column:
    """Horner form, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


# Hart's rational approximation of the normal tail (numerator and
# denominator, highest power first).
_HART_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
_HART_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]


def norm_cdf(x: Column) -> Column:
    """Accurate to about 1e-14; beyond |x| = 7.07 by a continued fraction."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near = bell * _poly(a, _HART_NUM) / _poly(a, _HART_DEN)
    fraction = a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + 0.65))))
    far = bell / fraction / math.sqrt(2 * math.pi)
    tail = F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


# Acklam's rational approximation of the normal quantile.
_ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
             1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
             6.680131188771972e+01, -1.328068155288572e+01, 1.0]
_ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
             -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
             3.754408661907416e+00, 1.0]


def norm_ppf(p: Column) -> Column:
    """Normal quantile, relative error below 1.2e-9."""
    q = p - 0.5
    r = q * q
    middle = _poly(r, _ACKLAM_A) * q / _poly(r, _ACKLAM_B)

    def tail(x: Column) -> Column:
        s = F.sqrt(-2 * F.log(x))
        return _poly(s, _ACKLAM_C) / _poly(s, _ACKLAM_D)

    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)
