"""Scans, frames and ranks of series and groups that are too long for one task.

A long series is cut into slices of positions (or a group into ranges of
values). What a row needs of earlier slices is their totals, so a scan has two
levels: within each slice, and over one row per slice. What it needs of near
rows is copied over the border. Results equal those of windows over the whole
series, up to the rounding of sums and products.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .store import stored

#: Rows of a slice.
SLICE = 1 << 16


def slice_of(order: str, rows: int) -> Column:
    return F.floor(F.col(order) / F.lit(rows))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet each other, as they do in windows; the right side's keys go."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def framed(df: DataFrame, build: Callable[[DataFrame, WindowSpec], DataFrame], back: int = 0, ahead: int = 0, rows: int | None = None, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """build(df, window), a window in order of pos that sees at least `back` rows before each row and `ahead` after.

    Without `rows` it sees the whole series. With it, a slice has so many
    positions, and rows near a border are also copied to the slices beyond it
    (halo rows), where they are seen but not returned. pos must be 0, 1, ..
    without gaps, and `build` must keep it and all keys.
    """
    if rows is None:
        return build(df, Window.partitionBy(*keys).orderBy("pos"))
    place = lambda p: F.floor(p / F.lit(rows))
    seen = F.sequence(place(F.greatest(F.col("pos") - ahead, F.lit(0))), place(F.col("pos") + back))
    out = build(df.withColumn("_slice", F.explode(seen)), Window.partitionBy(*keys, "_slice").orderBy("pos"))
    return out.where(F.col("_slice") == place(F.col("pos"))).drop("_slice")


#: How the totals of slices are found from their rows, added up over slices, and joined with what a row's own slice has.
_KINDS = {
    "sum": (lambda x, o: F.sum(x), F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "product": (lambda x, o: F.product(x), F.product, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * b)),
    "max": (lambda x, o: F.max(x), F.max, lambda a, b: F.greatest(a, b)),
    "min": (lambda x, o: F.min(x), F.min, lambda a, b: F.least(a, b)),
    "last": (lambda x, o: F.max_by(x, F.when(x.isNotNull(), o)), lambda x: F.last(x, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
    "top": (lambda x, o: F.max(x), F.max, lambda a, b: a),
}


def prefix_scan(df: DataFrame, scans: dict[str, tuple[str, Column]], keys: list[str], order: str = "pos", *, rows: int = SLICE, part: str | None = None, inclusive: bool = True, backward: bool = False) -> DataFrame:
    """df with a running value for each of `scans`: name -> (sum, product, max, min or last known; of what), or top: the largest of all rows of the keys.

    `inclusive` or not of the row itself; nulls are passed over, and before
    the first known value the result is null. `backward` scans from the end. Slices are `rows` values of
    `order` wide, or the values of the column `part`, which must rise with
    the order. `order` has no ties within the keys. A product that has
    overflowed stays infinite, as it does in one window, though later factors
    would bring it back.
    """
    for kind, _ in scans.values():
        if kind not in _KINDS:
            raise ValueError(f"unknown scan {kind!r}")
    names = df.columns
    df = df.withColumns({"_part": F.col(part) if part else slice_of(order, rows), **{f"_x_{n}": x for n, (_, x) in scans.items()}})
    own = [*keys, "_part"]
    along = (lambda c: F.col(c).desc()) if backward else F.col
    inner = Window.partitionBy(*own).orderBy(along(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy(along("_part")).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    total = lambda kind, x, o: F.min_by(x, F.when(x.isNotNull(), o)) if backward and kind == "last" else _KINDS[kind][0](x, o)
    over = {n: Window.partitionBy(*keys) if kind == "top" else before for n, (kind, _) in scans.items()}
    df = df.withColumns({n: F.col(f"_x_{n}") if kind == "top" else _KINDS[kind][1](F.col(f"_x_{n}")).over(inner) for n, (kind, _) in scans.items()})
    products = [n for n, (kind, _) in scans.items() if kind == "product"]
    if products:
        df = df.withColumns({f"_m_{n}": F.max(F.abs(n)).over(inner.rowsBetween(Window.unboundedPreceding, 0)) for n in products})
    totals = df.groupBy(*own).agg(*[total(kind, F.col(f"_x_{n}"), F.col(order)).alias(f"_t_{n}") for n, (kind, _) in scans.items()], *[F.max(f"_m_{n}").alias(f"_m_{n}") for n in products])
    totals = totals.select(*own, *[_KINDS[kind][1](F.col(f"_t_{n}")).over(over[n]).alias(f"_c_{n}") for n, (kind, _) in scans.items()], *[F.greatest(f"_m_{n}", F.abs(f"_t_{n}")).alias(f"_m_{n}") for n in products])
    carried = {n: F.abs(F.coalesce(f"_c_{n}", F.lit(1.0))) * F.col(f"_m_{n}") for n in products}  # the largest product on the way
    totals = totals.select(*own, *[f"_c_{n}" for n in scans], *[F.max(carried[n]).over(before).alias(f"_o_{n}") for n in products])
    df = matched(df, totals, own)

    def joined(n: str, kind: str) -> Column:
        out = _KINDS[kind][2](F.col(f"_c_{n}"), F.col(n))
        return out if kind != "product" else F.when(F.greatest(carried[n], f"_o_{n}") == float("inf"), F.signum(out) * float("inf")).otherwise(out)

    return df.select(*names, *[joined(n, kind).alias(n) for n, (kind, _) in scans.items()])


# --- ranges of values -------------------------------------------------------


def in_ranges(df: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """df with _range (0, 1, ..), which rises with the value: ranges of about equally many rows, their bounds from one approximate pass.

    Equal values are in one range. `ranges` defaults to four times the shuffle
    partitions; the result of what is built on ranges does not depend on it.
    """
    ranges = ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = [i / ranges for i in range(1, ranges)]
    found = df.select(F.percentile_approx(F.col(value).cast("double"), asked, max(1000, 10 * ranges)).alias("b")).first()["b"] if asked else None
    bounds = sorted({x for x in found or () if abs(x) < float("inf")})
    if not bounds:
        return df.withColumn("_range", F.lit(0))
    made = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_in_ranges", outputCol="_range").transform(df.withColumn("_in_ranges", F.col(value).cast("double")))
    return made.withColumn("_range", F.col("_range").cast("int")).drop("_in_ranges")


def value_ranks(df: DataFrame, keys: list[str], value: str, ranges: int | None = None, weight: str | None = None, **counts: Column) -> DataFrame:
    """(keys, value, n, counts.., rank, total): each different known value once, its rows and their average rank from 1 among `total`.

    Rows are counted by value before anything is ordered, so a value that is
    that of a third of all rows is one row; then values are numbered within
    ranges, and ranges by their counts. No task sees a group. The counts are
    stored, as bounds of ranges, ranks and totals are all found from them. A
    row counts as `weight` rows, if that is given.
    """
    n = F.sum(weight) if weight else F.count("*")
    distinct = stored(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"), *[c.alias(k) for k, c in counts.items()]), "values").df
    placed = in_ranges(distinct, value, ranges)
    out = prefix_scan(placed, {"_below": ("sum", F.col("n"))}, keys, value, part="_range", inclusive=False)
    totals = distinct.groupBy(*keys).agg(F.sum("n").alias("total"))
    rank = F.coalesce("_below", F.lit(0)) + (F.col("n") + 1) / 2
    return matched(out.withColumn("rank", rank), totals, keys).select(*keys, value, "n", *counts, "rank", "total")


def rank_sums(counted: DataFrame, keys: list[str], value: str, weights: list[str], ranges: int | None = None) -> DataFrame:
    """(keys, total, squares, and for each weight w its sum, w, and off_w) of different values, each with its rows as `n`.

    With d the average rank of a value less the mean of all ranks: squares is
    the sum of n * d * d, off_w that of w * d. Ranks are taken within ranges of
    values and summed there; what lies before a range moves these sums, so no
    rank is joined to a value.
    """
    own = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = F.coalesce(F.sum("n").over(own), F.lit(0)) + (F.col("n") + 1) / 2
    parts = in_ranges(counted, value, ranges).withColumn("_d", d).groupBy(*keys, "_range").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("_d")).alias("_nd"), F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("_ndd"),
        *[a for w in weights for a in (F.sum(w).alias(w), F.sum(F.col(w) * F.col("_d")).alias(f"off_{w}"))],
    )
    whole = Window.partitionBy(*keys)  # one row per range
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("total", F.sum("_n").over(whole)).withColumn("_c", before - (F.col("total") + 1) / 2)
    squares = F.sum(F.col("_ndd") + 2 * F.col("_c") * F.col("_nd") + F.col("_c") * F.col("_c") * F.col("_n"))
    return parts.groupBy(*keys).agg(F.sum("_n").alias("total"), squares.alias("squares"), *[a for w in weights for a in (F.sum(w).alias(w), F.sum(F.col(f"off_{w}") + F.col("_c") * F.col(w)).alias(f"off_{w}"))])


def auc_by_ranges(df: DataFrame, keys: list[str], y_true: str = "y_true", score: str = "score", ranges: int | None = None) -> DataFrame:
    """metrics.roc_auc of groups of any size, from the ranks of values."""
    from ..functions.numeric import finite

    known = df.select(*keys, finite(y_true).alias("_t"), finite(score).alias("_p")).where(F.col("_t").isNotNull() & F.col("_p").isNotNull())
    counted = stored(known.groupBy(*keys, "_p").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_t") == 1, 1).otherwise(0)).alias("_ones")), "values").df
    ones, n = F.col("_ones").cast("double"), F.col("total")
    ranked = F.col("off__ones") + ones * (n + 1) / 2
    return rank_sums(counted, keys, "_p", ["_ones"], ranges).select(*keys, F.try_divide(ranked - ones * (ones + 1) / 2, ones * (n - ones)).alias("auc"))


def ic_by_ranges(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred", ranges: int | None = None) -> DataFrame:
    """metrics.information_coefficient of groups of any size.

    Equal pairs are counted first. Ranks of predictions join them by value,
    and are summed by the true value before that is ranked: one join, not two.
    """
    from ..functions.numeric import finite

    known = df.select(*keys, finite(y_true).alias("_t"), finite(y_pred).alias("_p")).where(F.col("_t").isNotNull() & F.col("_p").isNotNull())
    pairs = stored(known.groupBy(*keys, "_t", "_p").agg(F.count("*").alias("_n")), "pairs").df
    off = F.col("rank") - (F.col("total") + 1) / 2  # ranks of all values have the mean (total + 1) / 2
    pairs = matched(pairs, value_ranks(pairs, keys, "_p", ranges, "_n").select(*keys, "_p", off.alias("_off")), [*keys, "_p"])
    sums = [F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_off")).alias("_sum"), F.sum(F.col("_n") * F.col("_off") * F.col("_off")).alias("_squares")]
    counted = stored(pairs.groupBy(*keys, "_t").agg(*sums), "values").df
    ic = F.try_divide(F.col("off__sum"), F.sqrt("squares") * F.sqrt("_squares"))
    return rank_sums(counted, keys, "_t", ["_sum", "_squares"], ranges).select(*keys, F.when(F.col("total") >= 3, ic).alias("ic"))
