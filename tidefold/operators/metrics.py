"""Statistics that need an order or ranks first, per group of rows.

Each takes a DataFrame and grouping keys and returns one row per group; the
plain aggregates are in functions.stats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.stats import pearson
from .slices import matched, slice_of


def average_rank(value: str, keys: list[str], known: Column | None = None) -> Column:
    """Rank from 1 within the keys; equal values share the mean of their ranks. One sort gives both the rank and the number of equals.

    With `known`, ranks are among the rows where it is true, and null elsewhere.
    """
    order = [value] if known is None else [F.when(known, 0).otherwise(1), value]
    w = Window.partitionBy(*keys).orderBy(*order)
    rank = F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
    return rank if known is None else F.when(known, rank)


def turnover(df: DataFrame, keys: list[str], position: str = "position", order: str = "pos", slice_rows: int | None = None) -> DataFrame:
    """(keys, turnover): mean absolute change between successive known positions; null for fewer than two.

    With `slice_rows`, changes are added up within slices of so many values of
    the order (a whole number), and those between slices from their ends.
    """
    known = df.select(*keys, order, finite(position).alias("_x")).where(F.col("_x").isNotNull())
    if slice_rows is None:
        step = F.abs(F.col("_x") - F.lag("_x", 1).over(Window.partitionBy(*keys).orderBy(order)))
        return known.withColumn("_step", step).groupBy(*keys).agg(F.avg("_step").alias("turnover"))
    own = [*keys, "_slice"]
    known = known.withColumn("_slice", slice_of(order, slice_rows))
    known = known.withColumn("_step", F.abs(F.col("_x") - F.lag("_x", 1).over(Window.partitionBy(*own).orderBy(order))))
    ends = known.groupBy(*own).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("_sum"), F.count("_step").alias("_n"), F.min_by("_x", order).alias("_first"), F.max_by("_x", order).alias("_last"))
    border = F.abs(F.col("_first") - F.lag("_last", 1).over(Window.partitionBy(*keys).orderBy("_slice")))
    ends = ends.withColumn("_border", border)
    return ends.groupBy(*keys).agg(F.try_divide(F.sum("_sum") + F.coalesce(F.sum("_border"), F.lit(0.0)), F.sum("_n") + F.count("_border")).alias("turnover"))


def max_drawdown(df: DataFrame, keys: list[str], returns: str = "ret", order: str = "pos", slice_rows: int | None = None) -> DataFrame:
    """(keys, max_drawdown): the lowest wealth over its running peak, less 1. The peak starts at the first wealth, not at 1.

    With `slice_rows`, wealth and peak run within slices of so many values of
    the order, and the wealth and peak of earlier slices are joined to them.
    From where wealth overflows on, falls are unknown and left out.
    """
    known = df.select(*keys, order, finite(returns).alias("_x")).where(F.col("_x").isNotNull())
    own = keys if slice_rows is None else [*keys, "_slice"]
    if slice_rows is not None:
        known = known.withColumn("_slice", slice_of(order, slice_rows))
    w = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("_wealth", F.product(1 + F.col("_x")).over(w)).withColumn("_peak", F.max("_wealth").over(w))
    if slice_rows is not None:
        low = known.groupBy(*own).agg(F.max_by("_wealth", order).alias("_all"), F.max("_wealth").alias("_top"), F.min("_wealth").alias("_bottom"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
        low = low.withColumn("_scale", F.coalesce(F.product("_all").over(before), F.lit(1.0)))
        # a negative scale turns the largest wealth into the smallest
        low = low.withColumn("_above", F.max(F.greatest(F.col("_scale") * F.col("_top"), F.col("_scale") * F.col("_bottom"))).over(before))
        known = matched(known, low.select(*own, "_scale", "_above"), own)
        known = known.withColumn("_wealth", F.col("_scale") * F.col("_wealth"))
        known = known.withColumn("_peak", F.greatest("_above", F.max("_wealth").over(w)))
    # one window keeps an infinite wealth, slices may come back from it: the fall is not -1 then
    fall = F.when(F.col("_peak") == float("inf"), float("nan")).otherwise(F.col("_wealth") / F.greatest(F.col("_peak"), F.lit(1e-16)) - 1)
    known = known.withColumn("_fall", fall)
    return known.groupBy(*keys).agg(F.min("_fall").alias("max_drawdown"))


def information_coefficient(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """(keys, ic): Spearman correlation of the pairs that are both known; null for fewer than three or constant sides."""
    known = df.select(*keys, finite(y_true).alias("_t"), finite(y_pred).alias("_p")).where(F.col("_t").isNotNull() & F.col("_p").isNotNull())
    known = known.withColumn("_rt", average_rank("_t", keys)).withColumn("_rp", average_rank("_p", keys))
    return known.groupBy(*keys).agg(F.when(F.count("*") >= 3, pearson(F.col("_rt"), F.col("_rp"))).alias("ic"))


def roc_auc(df: DataFrame, keys: list[str], y_true: str = "y_true", score: str = "score") -> DataFrame:
    """(keys, auc): rank-sum area under the curve, ties averaged; null unless both classes occur."""
    known = df.select(*keys, finite(y_true).alias("_t"), finite(score).alias("_p")).where(F.col("_t").isNotNull() & F.col("_p").isNotNull())
    known = known.withColumn("_r", average_rank("_p", keys))
    ones, n = F.sum(F.when(F.col("_t") == 1, 1).otherwise(0)).cast("double"), F.count("*")
    ranks = F.sum(F.when(F.col("_t") == 1, F.col("_r")).otherwise(0.0))
    return known.groupBy(*keys).agg(F.try_divide(ranks - ones * (ones + 1) / 2, ones * (n - ones)).alias("auc"))


def matthews(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """(keys, mcc): Matthews correlation for any number of classes; 0 where it is undefined."""
    known = df.select(*keys, finite(y_true).alias("_t"), finite(y_pred).alias("_p")).where(F.col("_t").isNotNull() & F.col("_p").isNotNull())
    sides = known.select(*keys, F.inline(F.array(F.struct(F.lit("t").alias("_side"), F.col("_t").alias("_c")), F.struct(F.lit("p").alias("_side"), F.col("_p").alias("_c")))), F.when(F.col("_t") == F.col("_p"), 0.5).otherwise(0.0).alias("_hit"))
    by_class = sides.groupBy(*keys, "_c").agg(F.sum("_hit").alias("_hit"), F.sum(F.when(F.col("_side") == "t", 1.0).otherwise(0.0)).alias("_nt"), F.sum(F.when(F.col("_side") == "p", 1.0).otherwise(0.0)).alias("_np"))
    square = lambda a, b: F.sum(F.col(a) * F.col(b))
    out = by_class.groupBy(*keys).agg(F.sum("_hit").alias("_c"), F.sum("_nt").alias("_s"), square("_nt", "_np").alias("_tp"), square("_nt", "_nt").alias("_tt"), square("_np", "_np").alias("_pp"))
    s2 = F.col("_s") * F.col("_s")
    mcc = F.try_divide(F.col("_c") * F.col("_s") - F.col("_tp"), F.sqrt((s2 - F.col("_pp")) * (s2 - F.col("_tt"))))
    return out.select(*keys, F.coalesce(mcc, F.lit(0.0)).alias("mcc"))


def balanced_accuracy(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """(keys, balanced_accuracy): mean recall over the classes that occur."""
    known = df.select(*keys, finite(y_true).alias("_t"), finite(y_pred).alias("_p")).where(F.col("_t").isNotNull() & F.col("_p").isNotNull())
    recall = known.groupBy(*keys, "_t").agg(F.avg(F.when(F.col("_t") == F.col("_p"), 1.0).otherwise(0.0)).alias("_recall"))
    return recall.groupBy(*keys).agg(F.avg("_recall").alias("balanced_accuracy"))
