"""Series of bars and their position axis.

Bars are a long DataFrame (series_id, t, close) of any number of series;
everything is keyed by series_id, so series spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .slices import prefix_scan


def series():
    """Window over the rows of each series."""
    return Window.partitionBy("series_id")


def by_pos():
    return series().orderBy("pos")


def bars(df: DataFrame, series: Column | str, t: Column | str, close: Column | str) -> DataFrame:
    """(series_id, t, close) with non-finite closes as null."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(series).alias("series_id"), as_col(t).alias("t"), finite(close).alias("close"))


def with_positions(df: DataFrame, order: tuple[str, ...] = ("t",), slice_of: Column | None = None) -> DataFrame:
    """df with pos (0, 1, ... in time order) and n (rows of the series).

    With `slice_of`, a coarser time that grows with the order, rows are
    numbered within slices and slices by their counts, so that one very long
    series is numbered by many tasks. Rows of a series that are equal in all
    of `order` raise when the plan runs, as their positions would be arbitrary.
    """
    now = F.struct(*order)
    checked = lambda w: F.when(F.lag(now).over(w.orderBy(*order)) == now, F.raise_error(F.lit("a series has several rows at one time")).cast("int")).otherwise(F.row_number().over(w.orderBy(*order)))
    if slice_of is None:
        return df.withColumn("pos", (checked(series()) - 1).cast("long")).withColumn("n", F.count("*").over(series()))
    df = df.withColumn("_slice", slice_of)
    sizes = df.groupBy("series_id", "_slice").agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_before", F.sum("_size").over(series().orderBy("_slice")) - F.col("_size")).withColumn("n", F.sum("_size").over(series()))
    inner = checked(Window.partitionBy("series_id", "_slice"))
    df = df.withColumn("_inner", inner).join(sizes, ["series_id", "_slice"])
    return df.withColumn("pos", (F.col("_before") + F.col("_inner") - 1).cast("long")).drop("_slice", "_size", "_before", "_inner")


def _line(axis: DataFrame, lookups: DataFrame, value: str, marks_first: bool, bucket: Callable[[Column], Column] | None, tasks: int | None) -> DataFrame:
    """Marks (with pos) and look-ups (with their columns as _name) on one time line: _order, and _bucket of the time."""
    kind = 0 if marks_first else 1
    names = lookups.columns
    marks = axis.select("series_id", F.col("t").alias("_t"), "pos", F.lit(kind).alias("_kind"), *[F.lit(None).cast(lookups.schema[c].dataType).alias(f"_{c}") for c in names])
    asks = lookups.select("series_id", F.col(value).alias("_t"), F.lit(None).cast("long").alias("pos"), F.lit(1 - kind).alias("_kind"), *[F.col(c).alias(f"_{c}") for c in names])
    line = marks.unionByName(asks)
    if tasks and not bucket:
        line = line.repartition(tasks, "series_id")
    line = line.withColumn("_order", F.struct("_t", "_kind", "pos"))
    return line.withColumn("_bucket", bucket(F.col("_t")) if bucket else F.lit(0))


def long_series(frames: list[DataFrame], rows: int = 1 << 19) -> Column:
    """Whether series_id has more than `rows` rows in all frames together.

    Look-ups of long series go by buckets, those of the others need none. Rows
    are counted at once; the long series, of which there are no more than all
    rows / `rows`, are named in the condition.
    """
    keys = frames[0].select("series_id")
    for f in frames[1:]:
        keys = keys.unionByName(f.select("series_id"))
    some = [r[0] for r in keys.groupBy("series_id").count().where(F.col("count") > rows).select("series_id").collect()]
    known = F.coalesce(F.col("series_id").isin([x for x in some if x is not None]), F.lit(False))
    return known | F.col("series_id").isNull() if None in some else known


def first_at_or_after(axis: DataFrame, lookups: DataFrame, value: str = "t1", bucket: Callable[[Column], Column] | None = None, tasks: int | None = None) -> DataFrame:
    """lookups with t1_pos: the first position whose t is at or after `value`, the last position if there is none.

    Both sides are put on one time line per series and read backwards: one
    sort, no inequality join. Exact matches are the position itself. `bucket`
    gives a coarser time that grows with the time: lines are then read within
    buckets, and the first mark of later buckets is carried to them over empty
    ones, so that a long series is spread over the tasks (see `long_series`).
    Without it, series are dealt to so many `tasks`, if that is given.
    """
    names = lookups.columns
    line = _line(axis, lookups, value, False, bucket, tasks)
    if bucket:
        line = prefix_scan(line, {"_next": ("last", F.col("pos")), "_last": ("top", F.col("pos"))}, ["series_id"], "_order", part="_bucket", backward=True)
    else:
        ahead = series().orderBy("_order").rowsBetween(0, Window.unboundedFollowing)
        line = line.withColumn("_next", F.first("pos", ignorenulls=True).over(ahead)).withColumn("_last", F.max("pos").over(series()))
    return line.where(F.col("_kind") == 0).select(*[F.col(f"_{c}").alias(c) for c in names], F.coalesce("_next", "_last").alias("t1_pos"))


def last_at_or_before(axis: DataFrame, lookups: DataFrame, value: str = "t", bucket: Callable[[Column], Column] | None = None, tasks: int | None = None) -> DataFrame:
    """lookups with as_of_pos: the last position whose t is at or before `value`, null if there is none (the leak-free merge). `bucket` and `tasks` as in first_at_or_after."""
    names = lookups.columns
    line = _line(axis, lookups, value, True, bucket, tasks)
    if bucket:
        line = prefix_scan(line, {"_back": ("last", F.col("pos"))}, ["series_id"], "_order", part="_bucket")
    else:
        line = line.withColumn("_back", F.last("pos", ignorenulls=True).over(series().orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)))
    return line.where(F.col("_kind") == 1).select(*[F.col(f"_{c}").alias(c) for c in names], F.col("_back").alias("as_of_pos"))


def resolve_label_ends(axis: DataFrame, ends: DataFrame | None, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """(series_id, pos, n, t1_pos) of every row of the axis.

    `ends` is (series_id, pos, t1_pos) or (series_id, pos, t1 as a time), or
    None for point labels. A row without an end, or a t1_pos outside the
    series, raises when the plan runs; t1_pos = n is read as the last row.
    """
    rows = axis.select("series_id", "pos", "n")
    if ends is None:
        return rows.withColumn("t1_pos", F.col("pos"))
    if "t1_pos" not in ends.columns:
        ends = first_at_or_after(axis, ends.select("series_id", "pos", "t1"), bucket=bucket)
    rows = rows.join(ends.select("series_id", "pos", "t1_pos"), ["series_id", "pos"], "left")
    end = F.when(F.col("t1_pos").isNull(), F.raise_error(F.lit("t1 is missing for some rows"))).when((F.col("t1_pos") < 0) | (F.col("t1_pos") > F.col("n")), F.raise_error(F.lit("t1 is out of range"))).otherwise(F.least("t1_pos", F.col("n") - 1))
    return rows.withColumn("t1_pos", end.cast("long"))
