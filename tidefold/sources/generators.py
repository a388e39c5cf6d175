"""Toy series. The numpy draws fix published results; the Spark form scales and takes its noise from a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PHI = 0.08
LAGS = 16  # PHI ** 16 is below double precision


def toy_panel(spark: SparkSession, n: int = 1200, seed: int = 42) -> DataFrame:
    """(series_id, t, close, ret): one AR(1) series of returns and its price."""
    noise = np.random.default_rng(seed).normal(0.0, 0.01, n)
    noise[0] = 0.0  # drawn, but the series starts at rest
    ret = np.convolve(noise, PHI ** np.arange(LAGS))[:n]
    close = 100 * np.exp(np.cumsum(ret))
    return spark.createDataFrame([(0, i, float(c), float(r)) for i, (c, r) in enumerate(zip(close, ret, strict=True))], "series_id int, t long, close double, ret double")


def autoregressive(noise: DataFrame, order: str = "pos", eps: str = "eps") -> DataFrame:
    """(series_id, pos, ret, close): AR(1) returns from given noise, for any number of series; the first return is 0.

    A return is the weighted sum of the last noise terms, which a window of
    fixed width gives, so no row waits for the one before it.
    """
    w = Window.partitionBy("series_id").orderBy(order)
    term = F.when(F.row_number().over(w) > 1, F.col(eps)).otherwise(0.0)
    df = noise.select("series_id", order, term.alias("_e"))
    ret = F.col("_e")
    for k in range(1, LAGS):
        ret = ret + PHI**k * F.coalesce(F.lag("_e", k).over(w), F.lit(0.0))
    df = df.withColumn("ret", ret)
    return df.select("series_id", order, "ret", (100 * F.exp(F.sum("ret").over(w.rowsBetween(Window.unboundedPreceding, 0)))).alias("close"))


def overlap_local(spark: SparkSession, n: int = 800, *, n_regimes: int = 32, horizon: int = 40, seed: int = 42) -> DataFrame:
    """(series_id, pos, n, t1_pos, x0, x1, y): labels constant within regimes, so that neighbours in time give them away."""
    rng = np.random.default_rng(seed)
    block = n // n_regimes
    regime = np.minimum(np.arange(n) // max(block, 1), n_regimes - 1)
    y = rng.integers(0, 2, n_regimes)[regime]
    x1 = rng.normal(0.0, 1e-4, n)
    x0 = np.linspace(0.0, 1.0, n) * 20
    rows = [(0, i, n, min(i + horizon, n - 1), float(x0[i]), float(x1[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "series_id int, pos long, n long, t1_pos long, x0 double, x1 double, y int")


def future_column(spark: SparkSession, n: int = 800, *, horizon: int = 30, seed: int = 42) -> DataFrame:
    """(series_id, pos, n, t1_pos, lag1, noise, x_leak, y): x_leak is the return that defines the label."""
    rng = np.random.default_rng(seed)
    future = rng.normal(0.0, 1.0, n)
    y = (future > 0).astype(int)
    lag1 = np.append(0, y[:-1]).astype(float)
    noise = rng.normal(0.0, 1.0, n)
    rows = [(0, i, n, min(i + horizon, n - 1), float(lag1[i]), float(noise[i]), float(future[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "series_id int, pos long, n long, t1_pos long, lag1 double, noise double, x_leak double, y int")
