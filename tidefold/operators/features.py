"""Causal features, alignment before splitting, and the position overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .axis import by_pos, series
from .labels import binary_target
from .slices import framed, prefix_scan

FEATURES = ("ret_lag1", "ret_lag2", "ret_lag5", "rv_5", "rv_20", "mom_10", "mom_20", "dev_ma20")


def full_window(x: Column, function, k: int, window: WindowSpec | None = None) -> Column:
    """function(x) over the last k rows, null unless all k values are known."""
    frame = (window or by_pos()).rowsBetween(-(k - 1), 0)
    return F.when(F.count(x).over(frame) == k, function(x).over(frame))


def causal_features(axis: DataFrame, ret: str = "ret", slice_rows: int | None = None) -> DataFrame:
    """axis with the eight features. The return is that of the bar itself; nothing looks ahead.

    With `slice_rows`, series are worked on in slices of so many rows (and 20
    rows before them), so that one long series is spread over the tasks.
    """
    close, r = F.col("close"), F.col(ret)

    def build(df: DataFrame, window: WindowSpec) -> DataFrame:
        lag = lambda c, k: F.lag(c, k).over(window)
        momentum = lambda k: F.ln(close) - F.ln(lag(close, k))
        return df.select(
            *df.columns,
            r.alias("ret_lag1"),
            lag(r, 1).alias("ret_lag2"),
            lag(r, 4).alias("ret_lag5"),
            full_window(r, F.stddev_samp, 5, window).alias("rv_5"),
            full_window(r, F.stddev_samp, 20, window).alias("rv_20"),
            momentum(10).alias("mom_10"),
            momentum(20).alias("mom_20"),
            (F.try_divide(close, full_window(close, F.avg, 20, window)) - 1).alias("dev_ma20"),
        )

    return framed(axis, build, back=20, rows=slice_rows)


def with_log_return(axis: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """axis with ret, the log return of each bar; null for the first."""
    return framed(axis, lambda df, window: df.withColumn("ret", F.ln("close") - F.ln(F.lag("close", 1).over(window))), back=1, rows=slice_rows)


def align_xy(df: DataFrame, features: tuple[str, ...] = FEATURES, horizon: int = 10, slice_rows: int | None = None) -> DataFrame:
    """(series_id, pos, n, features, y, fwd, t1_pos): rows whose features and fwd are finite, numbered anew.

    A label ends where its old end has landed; ends that were dropped become
    the last position. Done before splitting, so positions are dense.
    """
    complete = finite("fwd").isNotNull()
    for f in features:
        complete = complete & finite(f).isNotNull()
    kept = df.where(complete).select("series_id", F.col("pos").alias("_old"), *features, "fwd", F.least(F.col("pos") + horizon, F.col("n") - 1).alias("_end"))
    if slice_rows is None:
        kept = kept.withColumn("pos", (F.row_number().over(series().orderBy("_old")) - 1).cast("long")).withColumn("n", F.count("*").over(series()))
    else:
        sizes = kept.groupBy("series_id").agg(F.count("*").alias("n"))
        kept = prefix_scan(kept, {"pos": ("sum", F.lit(1))}, ["series_id"], "_old", rows=slice_rows).withColumn("pos", F.col("pos") - 1).join(sizes, "series_id")
    landed = kept.select("series_id", F.col("_old").alias("_end"), F.col("pos").alias("_at"))
    out = kept.join(landed, ["series_id", "_end"], "left")
    return out.select("series_id", "pos", "n", *features, binary_target(F.col("fwd")).cast("int").alias("y"), "fwd", F.coalesce("_at", F.col("n") - 1).alias("t1_pos"))


def position_from_proba(p: Column) -> Column:
    """1 from one half on, else -1."""
    return F.when(p >= 0.5, 1.0).otherwise(-1.0)


def overlay_return(p: Column, fwd: Column) -> Column:
    return position_from_proba(p) * fwd


def long_enough(axis: DataFrame, least: int = 300) -> DataFrame:
    """Series with at least `least` known closes."""
    known = F.count("close").over(Window.partitionBy("series_id"))
    return axis.withColumn("_known", known).where(F.col("_known") >= least).drop("_known")
