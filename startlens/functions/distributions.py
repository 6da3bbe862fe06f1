"""Tail probabilities for the significance tests, as column expressions.

Spark SQL has no incomplete beta, log-gamma or erfc. Both tails are built
from its own functions, so a plan with p-values holds no Python: continued
fractions are folded from the last term to the first by ``aggregate`` over a
descending sequence, and the only gamma values needed, ratios
Gamma(a + 1/2) / Gamma(a), come from their asymptotic series (DLMF 5.11.13),
shifted to large arguments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ln(Gamma(z + 1/2) / Gamma(z)) - ln(z) / 2 as a series in odd powers of 1/z.
_RATIO_SERIES = [(1, -1 / 8), (3, 1 / 192), (5, -1 / 640), (7, 17 / 14336), (9, -31 / 18432)]
_SHIFT = 16
_MOST_TERMS = 100_000


def log_gamma_half_ratio(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)) for a > 0."""
    z = a + F.lit(float(_SHIFT))
    out = F.log(z) * 0.5
    for power, c in _RATIO_SERIES:
        out = out + F.lit(c) / F.pow(z, F.lit(float(power)))
    for k in range(_SHIFT):
        out = out - F.log1p(F.lit(0.5) / (a + F.lit(float(k))))
    return out


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """1 / (1 + d1 / (1 + d2 / ...)), DLMF 8.17.22. It needs a number of terms in
    proportion to the square root of the larger parameter."""
    terms = F.least(F.lit(_MOST_TERMS), F.lit(200) + F.ceil(F.sqrt(F.greatest(a, b)) * 6).cast("int"))

    def fold(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.lit(1.0) + F.when(k % 2 == 1, odd).otherwise(even) / acc

    return F.lit(1.0) / F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), fold)


def t_test_p_value(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for Student's t; null without degrees of freedom. It is the
    regularised incomplete beta function I_x(dof / 2, 1/2) at x = dof / (dof + t^2)."""
    t, dof = t.cast("double"), dof.cast("double")
    a, b = dof / 2.0, F.lit(0.5)
    x = dof / (dof + t * t)
    y = t * t / (dof + t * t)
    # x^a y^b / B(a, b); ln x is taken as -log1p, which keeps its digits for many degrees of freedom
    front = F.exp(-a * F.log1p(t * t / dof) + log_gamma_half_ratio(a)) * F.sqrt(y) / math.sqrt(math.pi)
    value = F.when(x < (a + 1.0) / (a + b + 2.0), front * _beta_fraction(a, b, x) / a).otherwise(F.lit(1.0) - front * _beta_fraction(b, a, y) / b)
    known = ~F.isnan(t) & ~F.isnan(dof) & (dof > 0)
    return F.when(known, F.when(F.abs(t) == float("inf"), 0.0).when(t == 0, 1.0).otherwise(value))


def chi2_p_value(chi2: Column, dof: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, erfc(sqrt(chi2 / 2));
    1 with none."""
    chi2 = chi2.cast("double")
    y = chi2 / 2.0
    # small values: the series of the lower tail; large ones: the fraction of the upper tail
    series = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, k: F.lit(1.0) + acc * 2.0 * y / (2.0 * k.cast("double") + 1.0))
    lower = F.lit(2.0 / math.sqrt(math.pi)) * F.sqrt(y) * F.exp(-y) * series
    fraction = F.aggregate(
        F.sequence(F.lit(120), F.lit(1), F.lit(-1)), y + 241.0,
        lambda acc, k: y + 2.0 * k.cast("double") - 1.5 - k.cast("double") * (k.cast("double") - 0.5) / acc,
    )
    upper = F.exp(-y) * F.sqrt(y) / F.lit(math.sqrt(math.pi)) / fraction
    tail = F.when(chi2 <= 0, 1.0).when(chi2 == float("inf"), 0.0).when(y < 2.0, F.lit(1.0) - lower).otherwise(upper)
    return F.when(~F.isnan(chi2) & dof.isNotNull(), F.when(dof == 0, 1.0).otherwise(tail))
