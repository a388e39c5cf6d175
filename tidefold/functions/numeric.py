"""Column helpers: finite values, rounding, normal distribution."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column | str) -> Column:
    """x as a double, null where it is NaN or infinite; statistics below leave nulls out."""
    x = col(x).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF), x)


def rounded(x: Column | str, digits: int = 6) -> Column:
    """x rounded, with -0.0 as 0.0."""
    return F.round(col(x), digits) + F.lit(0.0)


def guarded_ln(x: Column) -> Column:
    """Natural logarithm with ln(0) = -Infinity; null for negative and null x."""
    return F.when(x == 0, F.lit(-INF)).otherwise(F.ln(x))


#: Coefficients of the rational approximation of the normal tail (J. F. Hart, 1968), highest power first.
TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SQRT_2_PI = 2.506628274631
SWITCH = 7.07106781186547


def norm_cdf(x: Column | str) -> Column:
    """Standard normal distribution function in built-in arithmetic, to about 1e-14."""
    return F.get(F.transform(F.array(col(x)), _normal), 0)  # names x, so that a long expression is evaluated once


def _normal(x: Column) -> Column:
    a = F.abs(x)
    decay = F.exp(-a * a / 2)

    def poly(coefficients):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + c
        return out

    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + k / fraction
    tail = F.when(a > 37, 0.0).when(a < SWITCH, decay * poly(TAIL_TOP) / poly(TAIL_BOTTOM)).otherwise(decay / fraction / SQRT_2_PI)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_cdf_sql(x: str) -> str:
    """The same function as SQL text."""

    def poly(coefficients):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * abs({x}) + {c!r})"
        return out

    fraction = f"(abs({x}) + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = f"(abs({x}) + {k} / {fraction})"
    decay = f"exp(-({x}) * ({x}) / 2)"
    tail = f"CASE WHEN abs({x}) > 37 THEN 0.0 WHEN abs({x}) < {SWITCH} THEN {decay} * {poly(TAIL_TOP)} / {poly(TAIL_BOTTOM)} ELSE {decay} / {fraction} / {SQRT_2_PI} END"
    return f"CASE WHEN ({x}) > 0 THEN 1 - ({tail}) ELSE ({tail}) END"


def trial_quantile(n_trials: int) -> float:
    """Expected maximum of n_trials standard normals, approximated through two quantiles; 0 for one trial or none."""
    if n_trials <= 1:
        return 0.0
    gamma, ppf = 0.5772156649015329, NormalDist().inv_cdf
    return (1 - gamma) * ppf(1 - 1 / n_trials) + gamma * ppf(1 - 1 / (n_trials * math.e))


def expected_max_sr(n_trials: int, sr_std: float) -> float:
    """Sharpe ratio that the best of n_trials skill-less strategies is expected to show."""
    if sr_std < 0:
        raise ValueError("sr_std must not be negative")
    return sr_std * trial_quantile(n_trials)
