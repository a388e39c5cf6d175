"""Return statistics as aggregate columns, for any groupBy(...).agg(...).

Non-finite and null values are left out. Where a statistic is undefined the
result is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import finite, norm_cdf, trial_quantile


def per_period_sharpe(returns: Column | str, risk_free: float = 0.0) -> Column:
    """Mean over sample deviation. Equal values: 0 if they are 0, else null. Tested by extremes, not by a deviation of 0, which rounding hides."""
    x = finite(returns) - risk_free
    ratio = F.try_divide(F.avg(x), F.stddev_samp(x))
    return F.when(F.min(x) == F.max(x), F.when(F.max(x) == 0, 0.0)).otherwise(ratio)


def sharpe_ratio(returns: Column | str, *, periods_per_year: float = 252, risk_free: float = 0.0) -> Column:
    return per_period_sharpe(returns, risk_free) * math.sqrt(periods_per_year)


def skew(x: Column | str) -> Column:
    """Population skewness; 0 for fewer than three or equal values."""
    x = finite(x)
    return F.when((F.count(x) < 3) | (F.min(x) == F.max(x)), 0.0).otherwise(F.coalesce(F.skewness(x), F.lit(0.0)))


def pearson_kurtosis(x: Column | str) -> Column:
    """Population kurtosis, 3 for a normal; 3 for fewer than three or equal values."""
    x = finite(x)
    return F.when((F.count(x) < 3) | (F.min(x) == F.max(x)), 3.0).otherwise(F.coalesce(F.kurtosis(x) + 3, F.lit(3.0)))


def sharpe_spread(sr: Column, skewness: Column, kurtosis: Column) -> Column:
    """n - 1 times the variance of a Sharpe ratio estimate, kept off zero."""
    return F.greatest(1 - skewness * sr + (kurtosis - 1) / 4 * sr * sr, F.lit(1e-12))


def sharpe_variance(returns: Column | str, risk_free: float = 0.0) -> Column:
    n = F.count(finite(returns))
    sr = per_period_sharpe(returns, risk_free)
    return F.when(n > 1, sharpe_spread(sr, skew(returns), pearson_kurtosis(returns)) / (n - 1)).otherwise(F.lit(float("inf")))


def psr_z(returns: Column | str, *, sr_benchmark: float = 0.0, risk_free: float = 0.0, skewness: float | None = None, kurtosis: float | None = None) -> Column:
    """Standard score of the probabilistic Sharpe ratio; null for fewer than three values."""
    n = F.count(finite(returns))
    sr = per_period_sharpe(returns, risk_free)
    g3 = skew(returns) if skewness is None else F.lit(float(skewness))
    g4 = pearson_kurtosis(returns) if kurtosis is None else F.lit(float(kurtosis))
    z = (sr - sr_benchmark) * F.sqrt((n - 1).cast("double")) / F.sqrt(sharpe_spread(sr, g3, g4))
    return F.when(n >= 3, z)


def probabilistic_sharpe_ratio(returns: Column | str, **how) -> Column:
    """Probability that the true per-period Sharpe ratio exceeds the benchmark."""
    return norm_cdf(psr_z(returns, **how))


def dsr_z(returns: Column | str, *, n_trials: int, risk_free: float = 0.0, skewness: float | None = None, kurtosis: float | None = None) -> Column:
    """As psr_z, against the Sharpe ratio that the best of n_trials is expected to show.

    The benchmark is that ratio's own deviation times a constant of n_trials,
    so the deviation cancels and only the constant is taken off.
    """
    return psr_z(returns, risk_free=risk_free, skewness=skewness, kurtosis=kurtosis) - trial_quantile(n_trials)


def deflated_sharpe_ratio(returns: Column | str, **how) -> Column:
    return norm_cdf(dsr_z(returns, **how))


def hits(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("double")


def f1_binary(y_true: Column | str, y_pred: Column | str) -> Column:
    """F1 of class 1 over the pairs that are both known; 0 without any positive, null without rows."""
    t, p = finite(y_true), finite(y_pred)
    tp, fp, fn = hits((t == 1) & (p == 1)), hits((t != 1) & (p == 1)), hits((t == 1) & (p != 1))
    return F.when(F.count(t + p) > 0, F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))


def frac_positive(x: Column | str) -> Column:
    """Share of values above 0; unknown values count as not above."""
    return F.avg(F.when(finite(x) > 0, 1.0).otherwise(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over pairs that are both known; null where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.when((F.min(x) == F.max(x)) | (F.min(y) == F.max(y)), F.lit(None)).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
