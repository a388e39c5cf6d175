"""Interval labels: forward returns, vertical and triple barriers, meta-labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import finite, guarded_ln
from .axis import by_pos, series
from .slices import framed


def fixed_horizon_returns(axis: DataFrame, horizon: int, *, kind: str = "log", slice_rows: int | None = None) -> DataFrame:
    """axis with fwd: the return over the next `horizon` bars, null for the last ones. With `slice_rows`, in slices of a long series."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    if kind not in ("log", "simple"):
        raise ValueError(f"unknown kind {kind!r}")
    now = finite("close")

    def build(df: DataFrame, window: WindowSpec) -> DataFrame:
        ahead = F.lead(now, horizon).over(window)
        return df.withColumn("fwd", F.ln(ahead) - F.ln(now) if kind == "log" else F.try_divide(ahead, now) - 1)

    return framed(axis, build, ahead=horizon, rows=slice_rows)


def vertical_barrier(axis: DataFrame, horizon: int, events: DataFrame | None = None, *, by_join: bool = False) -> DataFrame:
    """(series_id, pos, t, t1_pos, t1): where each event's label ends, `horizon` bars on or at the last bar.

    Events are rows (series_id, t) of which those on the axis count; without
    them every bar is one. An event at the last bar has no label. `by_join`
    looks the end up by its position, for series too long for one task.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    if by_join:
        df = t1_from_horizon(axis, horizon).join(axis.select("series_id", "pos", "t"), ["series_id", "pos"])
        df = df.where(F.col("pos") < F.col("n") - 1).join(axis.select("series_id", F.col("pos").alias("t1_pos"), F.col("t").alias("t1")), ["series_id", "t1_pos"])
        df = df.select("series_id", "pos", "t", "t1_pos", "t1")
        return df if events is None else df.join(events.select("series_id", "t").distinct(), ["series_id", "t"], "left_semi")
    df = axis.select("series_id", "pos", "t", "n", F.least(F.col("pos") + horizon, F.col("n") - 1).alias("t1_pos"), F.coalesce(F.lead("t", horizon).over(by_pos()), F.max("t").over(series())).alias("t1"))
    df = df.where(F.col("pos") < F.col("n") - 1).drop("n")
    return df if events is None else df.join(events.select("series_id", "t").distinct(), ["series_id", "t"], "left_semi")


def t1_from_horizon(axis: DataFrame, horizon: int) -> DataFrame:
    """(series_id, pos, n, t1_pos) of every bar; labels end at the last bar at the latest."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    return axis.select("series_id", "pos", "n", F.least(F.col("pos") + horizon, F.col("n") - 1).alias("t1_pos"))


def label_lifetime(rows: DataFrame) -> DataFrame:
    """rows with lifetime, in bars."""
    return rows.withColumn("lifetime", F.col("t1_pos") - F.col("pos"))


#: Blocks of a level hold so many of the level below.
FAN = 8


def extremes(axis: DataFrame, levels: int, least: float | None = None) -> DataFrame:
    """(series_id, level, block, lo, hi): the least and greatest known close of blocks of 8, 64, .. bars, and (level 0) each bar's own.

    Closes below `least` count as unknown. One pass: a bar gives a row per level, added up before the shuffle.
    """
    close = finite("close") if least is None else F.when(finite("close") >= least, finite("close"))
    bars = axis.select("series_id", "pos", close.alias("close"))
    level = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")
    above = bars.select("series_id", "pos", "close", level).withColumn("block", F.floor(F.col("pos") / F.pow(F.lit(float(FAN)), "level")))
    above = above.groupBy("series_id", "level", "block").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
    return bars.select("series_id", F.lit(0).alias("level"), F.col("pos").alias("block"), F.col("close").alias("lo"), F.col("close").alias("hi")).unionByName(above)


def covering_blocks(first: Column, last: Column, levels: int) -> Column:
    """Array of (level, block): the fewest blocks that make up the positions first..last, some 14 a level and what is left of the top one."""
    blocks = lambda level, a, b: F.when(b > a, F.transform(F.sequence(a, b - 1), lambda i: F.struct(F.lit(level).alias("level"), i.alias("block"))))
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    a, b, parts = first.cast("long"), (last + 1).cast("long"), []
    for level in range(levels):
        up, down = F.ceil(a / FAN), F.floor(b / FAN)
        ends = up >= down  # no block of the next level is inside
        parts += [blocks(level, a, F.when(ends, b).otherwise(up * FAN)), F.when(~ends, blocks(level, down * FAN, b))]
        a, b = F.when(ends, F.lit(0)).otherwise(up), F.when(ends, F.lit(0)).otherwise(down)
    parts.append(blocks(levels, a, b))
    return F.concat(*[F.coalesce(p, none) for p in parts])


def first_touch(index: DataFrame, asks: DataFrame, touched: Column, levels: int) -> DataFrame:
    """asks with q: the first position of pos + 1 .. t1_pos that `touched` holds for, null if there is none.

    `touched` is a condition on a row of asks and on lo and hi, which must hold
    for a block if it holds for one of its bars. The blocks that cover the
    path are looked up, and of the first one that is touched the first of
    its eight parts that is, down to a bar: tens of rows for each event
    however long the path, all found by equi-joins on (series, level, block).
    """
    names = asks.columns
    key = ["series_id", "level", "block"]
    size = F.pow(F.lit(float(FAN)), "level")
    at = asks.withColumn("_b", F.explode(covering_blocks(F.col("pos") + 1, F.col("t1_pos"), levels))).select(*names, "_b.level", "_b.block")
    for level in range(levels, -1, -1):
        hit = at.join(index, key).where(touched)
        first = hit.groupBy(*names).agg(F.min_by(F.struct("level", "block"), F.col("block") * size).alias("_b"))
        if level == 0:
            found = first.select(*names, F.col("_b.block").alias("q"))
            break
        # blocks of this level give way to their parts, smaller ones wait
        parts = F.when(F.col("_b.level") == level, F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.struct((F.col("_b.level") - 1).alias("level"), (F.col("_b.block") * FAN + i).alias("block")))).otherwise(F.array("_b"))
        at = first.withColumn("_b", F.explode(parts)).select(*names, "_b.level", "_b.block")
    return asks.join(found, names, "left")


def nearby_touch(axis: DataFrame, asks: DataFrame, touched: Column, bucket: int = 64) -> DataFrame:
    """asks with q as first_touch has it, and _close, the close there or else at t1_pos: for paths of tens of bars, each of which is looked at.

    Bars are joined by buckets of positions, with the path as residual
    condition; events off the axis give no row.
    """
    names = asks.columns
    spread = asks.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("pos") / bucket), F.floor(F.col("t1_pos") / bucket))))
    close = finite("close")
    path = axis.select("series_id", F.floor(F.col("pos") / bucket).alias("_bucket"), F.col("pos").alias("q"), close.alias("lo"), close.alias("hi"))
    path = spread.join(path, ["series_id", "_bucket"]).where(F.col("q").between(F.col("pos"), F.col("t1_pos")))
    at = F.struct("q", "lo")
    found = path.groupBy(*names).agg(F.min(F.when((F.col("q") > F.col("pos")) & touched, at)).alias("_hit"), F.max(F.when(F.col("q") == F.col("t1_pos"), at)).alias("_last")).where(F.col("_last").isNotNull())
    return found.select(*names, F.col("_hit.q").alias("q"), F.coalesce("_hit.q", "t1_pos").alias("_end"), F.when(F.col("_hit").isNotNull(), F.col("_hit.lo")).otherwise(F.col("_last.lo")).alias("_close"))


def triple_barrier(axis: DataFrame, events: DataFrame, pt: float, sl: float, *, min_ret: float = 0.0, side: bool = False, log_returns: bool = True, levels: int = 0) -> DataFrame:
    """(series_id, pos, t1_pos, ret, bin, barrier): the first barrier that each event's path touches.

    events: (series_id, pos, t1_pos) and, with `side`, side of 1 or -1, which
    signs the path. A width of 0 switches a barrier off; the event's own bar
    never touches. Touches at the same bar count as vertical. Without a touch
    the label ends at t1_pos; its bin is the sign of the return, 0 below
    min_ret. With `side` the bin is 1 or 0. A t1_pos before its event or off
    the axis raises. Events whose price is unknown or
    not positive are left out, and events without a bar.

    Paths of tens of bars are looked at bar by bar. For longer ones give
    `levels`, one for each power of eight of the horizon: a path is then
    walked over blocks of 8, 64, .. bars by their least and greatest close. A
    return is a rising function of the close, so a block has a touch if the
    return at its least or greatest close is one.
    """
    if pt < 0 or sl < 0:
        raise ValueError("pt and sl must not be negative")
    own = events.where(F.col("t1_pos").isNotNull())
    ends_before = F.when(F.col("t1_pos") < F.col("pos"), F.raise_error(F.lit("t1 precedes the event")))
    own = own.select("series_id", "pos", "t1_pos", F.coalesce(ends_before.cast("long"), F.lit(0)).alias("_ok"), (F.col("side").cast("double") if side else F.lit(1.0)).alias("side"))
    if side:
        own = own.where(F.col("side").isNotNull())
        own = own.withColumn("side", F.when(F.abs("side") == 1, F.col("side")).otherwise(F.raise_error(F.lit("side must be 1 or -1")).cast("double")))
    off = F.when((F.col("t1_pos") >= F.col("n")) | (F.col("t1_pos") < 0), F.raise_error(F.lit("t1 is not on the axis")).cast("long"))
    start = axis.select("series_id", "pos", "n", finite("close").alias("p0"))
    own = own.join(start, ["series_id", "pos"]).where(F.col("p0") > 0)
    own = own.select("series_id", "pos", (F.coalesce(off, F.col("t1_pos")) + F.col("_ok")).alias("t1_pos"), "side", "p0")

    def ret(close: Column) -> Column:
        ratio = close / F.col("p0")
        return F.col("side") * (guarded_ln(ratio) if log_returns else ratio - 1)

    up = lambda r: (r >= pt) & F.lit(pt > 0)
    down = lambda r: (r <= -sl) & F.lit(sl > 0)
    either = [test(ret(F.col(c))) for c in ("lo", "hi") for test in (up, down)]
    # the label ends where a barrier is touched, or at t1
    if levels:
        any_of = F.lit(False)
        for test in either:
            any_of = any_of | F.coalesce(test, F.lit(False))
        touched = first_touch(extremes(axis, levels, 0.0 if log_returns else None), own, any_of, levels).withColumn("_end", F.coalesce("q", "t1_pos"))
        touched = touched.join(axis.select("series_id", F.col("pos").alias("_end"), finite("close").alias("_close")), ["series_id", "_end"])
    else:
        touched = nearby_touch(axis, own, F.coalesce(either[0] | either[1], F.lit(False)))
    touched = touched.withColumn("ret", ret(F.col("_close")))
    hit = F.col("q").isNotNull()
    barrier = F.when(hit & up(F.col("ret")) & ~down(F.col("ret")), "upper").when(hit & down(F.col("ret")) & ~up(F.col("ret")), "lower").otherwise("vertical")
    touched = touched.select("series_id", "pos", F.col("_end").alias("t1_pos"), "ret", barrier.alias("barrier"))
    raw = F.when(F.col("barrier") == "upper", 1).when(F.col("barrier") == "lower", -1).when(F.abs("ret") < min_ret, 0).otherwise(F.signum("ret").cast("int"))
    label = F.when(raw > 0, 1).when(raw.isNotNull(), 0) if side else raw
    return touched.select("series_id", "pos", "t1_pos", "ret", label.cast("int").alias("bin"), "barrier")


def meta_label(axis: DataFrame, events: DataFrame, sides: DataFrame, pt: float, sl: float, **how) -> DataFrame:
    """triple_barrier over the events that `sides` (series_id, pos, side) has a side for; bin 1 where following the side pays."""
    own = events.drop("side").join(sides.where(F.col("side").isNotNull()).select("series_id", "pos", "side"), ["series_id", "pos"])
    return triple_barrier(axis, own, pt, sl, side=True, **how)


def binary_target(fwd: Column) -> Column:
    """1 if the forward return is positive, else 0; null stays null."""
    return F.when(fwd.isNotNull(), F.when(fwd > 0, 1).otherwise(0))
