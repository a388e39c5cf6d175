"""Cross-validation splits as relations.

A split is rows (split_id, series_id, pos, role). All splits of a protocol
are one relation, made by one plan for all series at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .axis import series
from .slices import SLICE, slice_of

SPLIT = ["split_id", "series_id"]
#: Rows of the table of splits and tested groups, which is broadcast (16 bytes each).
MOST_ASSIGNED = 1_000_000
#: Groups of a split as bits of a long.
MOST_BITS = 62


def group_edges(n: int, groups: int) -> list[int]:
    """First positions of equal groups of 0..n-1, and n. Integer division differs from this for some sizes."""
    if groups < 2 or groups > n:
        raise ValueError("groups must be between 2 and n")
    return [math.floor(i * (n / groups)) for i in range(groups)] + [n]


def group_of(groups: int) -> Column:
    """The equal group of a row, from its pos and n."""
    if groups < 2:
        raise ValueError("at least 2 groups are needed")
    width = F.col("n") / F.lit(float(groups))
    inner = F.array(*[F.floor(F.lit(float(i)) * width) for i in range(1, groups)])
    few = F.when(F.col("n") < groups, F.raise_error(F.lit("more groups than rows")).cast("int"))
    return F.coalesce(few, F.size(F.filter(inner, lambda e: e <= F.col("pos"))))


def equal_groups(rows: DataFrame, groups: int) -> DataFrame:
    """rows with group_id."""
    return rows.withColumn("group_id", group_of(groups))


def contiguous_segments(rows: DataFrame, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """(keys, seg_start, seg_end): maximal runs of successive positions; repeated positions count once.

    Runs are found within slices of positions, and those that meet at a
    border are joined, so that no task sees all rows of the keys. `more` are
    largest values over each run, by name; with it, no position may repeat.
    """
    more = more or {}
    rows = rows.select(*keys, "pos", *[c.alias(n) for n, c in more.items()]) if more else rows.select(*keys, "pos").distinct()
    rows = rows.withColumn("_slice", slice_of("pos", SLICE))
    own = [*keys, "_slice"]
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*own).orderBy("pos"))
    parts = rows.withColumn("_island", island).groupBy(*own, "_island").agg(F.min("pos").alias("seg_start"), F.max("pos").alias("seg_end"), *[F.max(n).alias(n) for n in more])
    in_order = Window.partitionBy(*keys).orderBy("seg_start")  # one row per run and slice
    new = F.when(F.lag("seg_end").over(in_order) == F.col("seg_start") - 1, 0).otherwise(1)
    parts = parts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(in_order))
    return parts.groupBy(*keys, "_run").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), *[F.max(n).alias(n) for n in more]).drop("_run")


def embargo_bars(rows: DataFrame, *, embargo_pct: float = 0.0, embargo_bars: int | None = None, embargo_lifetime_frac: float | None = None) -> DataFrame:
    """(series_id, embargo): bars, else a part of the median label lifetime (rounded up), else a part of the rows (rounded down)."""
    return rows.groupBy("series_id").agg(embargo_size(embargo_pct, embargo_bars, embargo_lifetime_frac).alias("embargo"))


def embargo_size(embargo_pct: float = 0.0, embargo_bars: int | None = None, embargo_lifetime_frac: float | None = None) -> Column:
    """The embargo of a series, as an aggregate over its rows."""
    for v in (embargo_pct, embargo_bars, embargo_lifetime_frac):
        if v is not None and v < 0:
            raise ValueError("embargo must not be negative")
    if embargo_bars is not None:
        size = F.first(F.lit(int(embargo_bars)))
    elif embargo_lifetime_frac is not None:
        lifetime = F.greatest(F.col("t1_pos") - F.col("pos"), F.lit(0))
        size = F.ceil(F.lit(float(embargo_lifetime_frac)) * F.percentile(lifetime, F.lit(0.5)))
    else:
        size = F.floor(F.count("*") * F.lit(float(embargo_pct)))
    return size.cast("long")


def info_segments(rows: DataFrame, test: DataFrame, embargo: DataFrame | None = None) -> DataFrame:
    """(split_id, series_id, seg_start, seg_end, info_end, embargo): test segments and how far their labels reach."""
    test = test.select(*SPLIT, "pos").distinct().join(rows.select("series_id", "pos", "t1_pos"), ["series_id", "pos"])
    out = contiguous_segments(test, SPLIT, {"_reach": F.col("t1_pos")})
    out = out.select(*SPLIT, "seg_start", "seg_end", F.greatest("seg_end", "_reach").alias("info_end"))
    return out.withColumn("embargo", F.lit(0)) if embargo is None else out.join(embargo, "series_id")


def group_segments(rows: DataFrame, assigned: DataFrame, n_groups: int, embargo: DataFrame | None = None) -> DataFrame:
    """info_segments of splits whose test sets are equal groups; assigned: (split_id, group_id), which is broadcast.

    A group is known by its first and last position and the furthest label
    end, so there is one row per (series, group) and no test row is expanded;
    groups of a split that follow each other are one segment.
    """
    extents = equal_groups(rows, n_groups).groupBy("series_id", "group_id").agg(F.min("pos").alias("seg_start"), F.max("pos").alias("seg_end"), F.max("t1_pos").alias("_reach"))
    tested = extents.join(F.broadcast(assigned), "group_id")
    follows = F.lag("group_id").over(Window.partitionBy(*SPLIT).orderBy("group_id")) == F.col("group_id") - 1  # a few rows each
    tested = tested.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(Window.partitionBy(*SPLIT).orderBy("group_id")))
    out = tested.groupBy(*SPLIT, "_run").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.max("_reach").alias("_reach"))
    out = out.select(*SPLIT, "seg_start", "seg_end", F.greatest("seg_end", "_reach").alias("info_end"))
    return out.withColumn("embargo", F.lit(0)) if embargo is None else out.join(embargo, "series_id")


def judged_by(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(split_id, series_id, pos, role): every row of the series of each split as test, train, or null where purging or embargo takes it.

    The contiguous test segments of each (split, series) are few and travel as
    one array, so rows meet them in one join (whose small side Spark
    broadcasts, or whose long series it splits) and are judged where they stand.
    """
    segments = segments.groupBy(*SPLIT).agg(F.collect_list(F.struct("seg_start", "seg_end", "info_end", "embargo")).alias("_segments"))
    pos, t1 = F.col("pos"), F.col("t1_pos")
    tested = F.exists("_segments", lambda s: pos.between(s["seg_start"], s["seg_end"]))
    seen = lambda s: (pos <= s["info_end"]) & (s["seg_start"] <= t1)  # noqa: E731  the closed label interval meets what the segment's labels see
    after = lambda s: pos.between(s["seg_end"] + 1, s["seg_end"] + s["embargo"])
    role = F.when(tested, "test").when(~F.exists("_segments", lambda s: seen(s) | after(s)), "train")
    return rows.select("series_id", "pos", "t1_pos").join(segments, "series_id").select(*SPLIT, "pos", role.alias("role"))


def judged_by_groups(rows: DataFrame, assigned: DataFrame, n_groups: int, **embargo) -> DataFrame:
    """(split_id, series_id, pos, role) of the rows of splits whose test sets are equal groups; what purging or embargo takes is left out.

    Equal to judged_by with group_segments. A series is one row with the
    extents of its groups, which its rows meet in one join, before they are
    multiplied by the splits. Which groups take a row out of training, if they
    are tested, does not depend on the split: these are bits of a number, and
    a split, whose groups are bits too (assigned is broadcast), is compared
    with it. Only for labels that end before their row does it matter where a
    segment of several groups begins: they are also taken out by a split that
    tests all groups from the one in which the label ends to the first whose
    labels reach the row.
    """
    if n_groups > MOST_BITS:
        return judged_by(rows, group_segments(rows, assigned, n_groups, embargo_bars(rows, **embargo))).where(F.col("role").isNotNull())
    grouped = equal_groups(rows, n_groups).select("series_id", "pos", "t1_pos", F.col("group_id").alias("_group"))
    own = lambda g, c: F.when(F.col("_group") == g, F.col(c))
    extents = [a for g in range(n_groups) for a in (F.min(own(g, "pos")).alias(f"_s{g}"), F.max(own(g, "pos")).alias(f"_e{g}"), F.max(own(g, "t1_pos")).alias(f"_r{g}"))]
    known = grouped.groupBy("series_id").agg(*extents, embargo_size(**embargo).alias("_embargo"))
    bits = lambda when: sum((F.when(when(g), F.lit(1 << g)).otherwise(F.lit(0)).cast("long") for g in range(n_groups)), F.lit(0).cast("long"))
    pos, t1 = F.col("pos"), F.col("t1_pos")
    start, end, reach = (lambda g: F.col(f"_s{g}")), (lambda g: F.col(f"_e{g}")), (lambda g: F.col(f"_r{g}"))
    known = known.withColumn("_present", bits(lambda g: start(g).isNotNull()))
    met = grouped.join(known, "series_id")
    begun = lambda g: F.coalesce(start(g) <= t1, F.lit(True))  # noqa: E731  an unknown end is taken for any
    ahead = lambda g: (start(g) > pos) & begun(g)
    behind = lambda g: (end(g) < pos) & ((reach(g) >= pos) & begun(g) | (pos - end(g) <= F.col("_embargo")))
    late = bits(lambda g: (end(g) < pos) & (reach(g) >= pos) & ~begun(g))
    last = F.greatest(*[F.when(start(g) <= t1, F.lit(1 << g)).otherwise(F.lit(0)).cast("long") for g in range(n_groups)])
    span = 2 * late.bitwiseAND(-late) - last  # the bits from the last group that has begun to the first that is late
    span = F.when((t1 < pos) & (late != 0) & (last != 0) & (span.bitwiseAND(F.col("_present")) == span), span).otherwise(F.lit(0).cast("long"))
    met = met.select("series_id", "pos", bits(lambda g: F.col("_group") == g).alias("_own"), bits(lambda g: ahead(g) | behind(g)).alias("_taken"), span.alias("_span"), "_present")
    sets = assigned.groupBy("split_id").agg(F.sum(F.expr("shiftleft(1L, group_id)")).alias("_set"))
    has = lambda c: F.col("_set").bitwiseAND(F.col(c)) != 0
    trained = ~has("_taken") & ((F.col("_span") == 0) | (F.col("_set").bitwiseAND(F.col("_span")) != F.col("_span")))
    out = met.join(F.broadcast(sets), has("_present") & (has("_own") | trained))
    return out.select(*SPLIT, "pos", F.when(has("_own"), "test").otherwise("train").alias("role"))


def judged(rows: DataFrame, test: DataFrame, embargo: DataFrame | None = None) -> DataFrame:
    """judged_by for test rows of any kind."""
    return judged_by(rows, info_segments(rows, test, embargo))


def purge_train(rows: DataFrame, test: DataFrame, embargo: DataFrame | None = None) -> DataFrame:
    """(split_id, series_id, pos): the training rows that survive purging and embargo.

    rows: (series_id, pos, t1_pos), all rows of the series; test: (split_id,
    series_id, pos). Per contiguous test segment, rows whose labels overlap
    it, and `embargo` rows after it, go. Series without test rows in a split
    keep all their rows out of that split's relation.
    """
    return judged(rows, test, embargo).where("role = 'train'").select(*SPLIT, "pos")


def purged_kfold(rows: DataFrame, n_splits: int = 5, **embargo) -> DataFrame:
    """Contiguous folds in time order, each purged and embargoed. rows: (series_id, pos, n, t1_pos)."""
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    assigned = rows.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("split_id"), F.col("id").cast("int").alias("group_id"))
    return judged_by_groups(rows, assigned, n_splits, **embargo)


def combos(n_groups: int, n_test_groups: int) -> list[tuple[int, ...]]:
    if n_groups < 2 or not 1 <= n_test_groups < n_groups:
        raise ValueError("1 <= n_test_groups < n_groups and n_groups >= 2 are needed")
    return list(combinations(range(n_groups), n_test_groups))


def n_splits(n_groups: int, n_test_groups: int) -> int:
    return math.comb(n_groups, n_test_groups)


def n_paths(n_groups: int, n_test_groups: int) -> int:
    return math.comb(n_groups - 1, n_test_groups - 1)


def path_assignment(spark, n_groups: int, n_test_groups: int) -> DataFrame:
    """(split_id, group_id, path_id): the path that each tested group of each split belongs to, by its order of appearance."""
    if n_splits(n_groups, n_test_groups) * n_test_groups > MOST_ASSIGNED:
        raise ValueError(f"{n_splits(n_groups, n_test_groups)} splits are too many; choose fewer groups")
    rows = [(i, g) for i, c in enumerate(combos(n_groups, n_test_groups)) for g in c]
    df = spark.createDataFrame(rows, "split_id int, group_id int")
    return df.withColumn("path_id", F.row_number().over(Window.partitionBy("group_id").orderBy("split_id")) - 1)


def cpcv(rows: DataFrame, n_groups: int = 6, n_test_groups: int = 2, **embargo) -> DataFrame:
    """Combinatorial purged splits: every choice of test groups is a split; neighbouring groups form one segment."""
    assigned = path_assignment(rows.sparkSession, n_groups, n_test_groups).select("split_id", "group_id")
    return judged_by_groups(rows, assigned, n_groups, **embargo)


def placed_on_paths(rows: DataFrame, predictions: DataFrame, n_groups: int, n_test_groups: int) -> DataFrame:
    """(path_id, series_id, pos, n, value): each prediction on its path. Predictions that carry n and group_id are not joined to the rows."""
    if not {"n", "group_id"} <= set(predictions.columns):
        predictions = predictions.join(equal_groups(rows, n_groups).select("series_id", "pos", "n", "group_id"), ["series_id", "pos"])
    assigned = path_assignment(rows.sparkSession, n_groups, n_test_groups)
    return predictions.join(F.broadcast(assigned), ["split_id", "group_id"]).select("path_id", "series_id", "pos", "n", "value")


def uncovered() -> Column:
    """An aggregate over a path of a series: raises unless each position is there once, else 0."""
    wrong = (F.count("*") != F.max("n")) | (F.count_distinct("pos") != F.max("n"))
    return F.when(wrong, F.raise_error(F.lit("a path does not cover every row once")).cast("int")).otherwise(0)


def reconstruct_paths(rows: DataFrame, predictions: DataFrame, n_groups: int, n_test_groups: int) -> DataFrame:
    """(path_id, series_id, pos, value) from predictions (split_id, series_id, pos, value) on all test rows.

    Each path covers each row of a series once; where it does not, the plan
    raises. Rows are counted by path, so no task sees a series.
    """
    placed = placed_on_paths(rows, predictions, n_groups, n_test_groups)
    checked = placed.groupBy("path_id", "series_id").agg(uncovered().alias("_wrong"))
    return placed.join(checked, ["path_id", "series_id"]).select("path_id", "series_id", (F.col("pos") + F.col("_wrong")).alias("pos"), "value")


def naive_kfold(rows: DataFrame, n_splits: int = 5, *, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Folds of shuffled rows, without purging: INVALID for overlapping labels, for comparison only.

    The order is that of md5(seed:pos) within each series, so it does not
    depend on partitions. The first n mod k folds have one row more.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("pos").cast("string"))) if shuffle else F.col("pos")
    place = F.row_number().over(series().orderBy(key, "pos")) - 1
    return _every_role(rows.select("series_id", "pos", "n", place.alias("_place")), n_splits)


def naive_kfold_permuted(rows: DataFrame, n_splits: int = 5, *, seed: int = 42) -> DataFrame:
    """As naive_kfold, with numpy's legacy shuffle, which published results depend on.

    That order depends on the length of a series and the seed alone, so it is
    made once for each length, in the tasks, and joined by length and position.
    A task holds the order of one length (16 bytes a row of the longest series).
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                order = np.arange(n)
                np.random.RandomState(seed).shuffle(order)
                for at in range(0, n, 1 << 16):
                    part = order[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array(np.arange(at, at + len(part)), pa.int64())], ["n", "pos", "_place"])

    lengths = rows.select(F.col("n").cast("long").alias("n")).distinct()
    table = lengths.mapInArrow(orders, "n long, pos long, _place long")
    return _every_role(rows.select("series_id", "pos", F.col("n").cast("long").alias("n")).join(table, ["n", "pos"]), n_splits)


def _every_role(placed: DataFrame, n_splits: int) -> DataFrame:
    base, more = F.floor(F.col("n") / n_splits), F.col("n") % n_splits
    fold = F.when(F.col("_place") < more * (base + 1), F.floor(F.col("_place") / (base + 1))).otherwise(more + F.floor((F.col("_place") - more * (base + 1)) / F.greatest(base, F.lit(1))))
    ids = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    df = placed.withColumn("_fold", fold.cast("int")).withColumn("split_id", ids)
    return df.select(*SPLIT, "pos", F.when(F.col("_fold") == F.col("split_id"), "test").otherwise("train").alias("role"))


def walk_forward(rows: DataFrame, n_splits: int = 5, *, max_train_size: int | None = None) -> DataFrame:
    """Expanding training windows (or the last max_train_size rows) before each of n_splits test blocks; no purging."""
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    size = F.floor(F.col("n") / (n_splits + 1))
    few = F.when(F.col("n") < n_splits + 1, F.raise_error(F.lit("more folds than rows")).cast("long"))
    df = rows.select("series_id", "pos", "n", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split_id"))
    df = df.withColumn("_start", F.coalesce(few, F.col("n") - (n_splits - F.col("split_id")) * size)).withColumn("_end", F.col("_start") + size)
    train = F.col("pos") < F.col("_start")
    if max_train_size is not None:
        train = train & (F.col("pos") >= F.col("_start") - max_train_size)
    role = F.when(train, "train").when((F.col("pos") >= F.col("_start")) & (F.col("pos") < F.col("_end")), "test")
    return df.withColumn("role", role).where(F.col("role").isNotNull()).select(*SPLIT, "pos", "role")


def counted_by(rows: DataFrame, segments: DataFrame, bucket: int = 64) -> DataFrame:
    """(split_id, series_id, n_samples, n_test, n_train_purged), without a row for each row of each split.

    Positions from a segment's start to the end of what its labels see, and
    of its embargo, are taken whole, so their union is counted by end points.
    Of the rows before a segment, those whose labels reach it are taken; they
    lie within the longest label of it, and are looked up by buckets of
    positions. rows: all rows of the series, at positions 0, 1, .. (labels that
    end before their row, which no interval holds, are judged one by one).
    """
    reach = F.greatest("t1_pos", "pos")
    size = rows.groupBy("series_id").agg(F.count("*").alias("n_samples"), F.max("pos").alias("_top"), F.max(reach - F.col("pos")).alias("_longest"))
    seg = segments.join(size, "series_id")
    in_order = Window.partitionBy(*SPLIT).orderBy("seg_start")  # segments
    seg = seg.withColumn("_cover", F.least(F.greatest("info_end", F.col("seg_end") + F.col("embargo")), "_top"))
    seg = seg.withColumn("_before", F.coalesce(F.max("_cover").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    total = seg.groupBy(*SPLIT).agg(
        F.first("n_samples").alias("n_samples"),
        F.sum(F.col("seg_end") - F.col("seg_start") + 1).alias("n_test"),
        F.sum(F.greatest(F.col("_cover") - F.greatest(F.col("seg_start") - 1, "_before"), F.lit(0))).alias("_covered"),
    )
    gaps = seg.select(*SPLIT, "seg_start", F.greatest(F.col("_before") + 1, F.col("seg_start") - F.col("_longest")).alias("_from")).where(F.col("_from") < F.col("seg_start"))
    place = lambda c: F.floor(c / F.lit(bucket))
    gaps = gaps.withColumn("_bucket", F.explode(F.sequence(place(F.col("_from")), place(F.col("seg_start") - 1))))
    ends = rows.select("series_id", "pos", reach.alias("_end"), place(F.col("pos")).alias("_bucket"))
    reaching = gaps.join(ends, ["series_id", "_bucket"]).where((F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("seg_start")) & (F.col("_end") >= F.col("seg_start")))
    reaching = reaching.groupBy(*SPLIT).agg(F.count("*").alias("_reaching"))
    odd = rows.where(F.col("t1_pos") < F.col("pos"))
    # such a row counts as covered where its position is; it is trained on if its label is not seen
    covered = (F.col("pos") >= F.col("seg_start")) & (F.col("pos") <= F.col("info_end"))
    inside = F.max(F.when(covered, 1).otherwise(0))
    taken = F.max(F.when(F.col("pos").between(F.col("seg_start"), F.col("seg_end") + F.col("embargo")) | (F.col("pos") <= F.col("info_end")) & (F.col("seg_start") <= F.col("t1_pos")), 1).otherwise(0))
    odd = odd.select("series_id", "pos", "t1_pos").join(segments, "series_id").groupBy(*SPLIT, "pos").agg((inside - taken).alias("_kept"))
    odd = odd.where("_kept > 0").groupBy(*SPLIT).agg(F.count("*").alias("_kept"))
    out = total.join(reaching, SPLIT, "left").join(odd, SPLIT, "left")
    dropped = F.col("_covered") - F.col("n_test") + F.coalesce("_reaching", F.lit(0)) - F.coalesce("_kept", F.lit(0))
    return out.select(*SPLIT, "n_samples", "n_test", (F.col("n_samples") - F.col("n_test") - dropped).alias("n_train_purged"))


def overlap_fraction(rows: DataFrame, test: DataFrame) -> DataFrame:
    """(split_id, series_id, overlap): share of the untested rows whose labels overlap the test set's; 0 without such rows."""
    free = F.col("n_samples") - F.col("n_test")
    return counted_by(rows, info_segments(rows, test)).select(*SPLIT, F.coalesce(F.try_divide(free - F.col("n_train_purged"), free), F.lit(0.0)).alias("overlap"))


def _preview(counts: DataFrame) -> DataFrame:
    naive = F.col("n_samples") - F.col("n_test")
    return counts.select(*SPLIT, "n_samples", "n_test", naive.alias("n_train_naive"), "n_train_purged", (naive - F.col("n_train_purged")).alias("n_dropped"))


def purge_preview(rows: DataFrame, test: DataFrame, embargo: DataFrame | None = None) -> DataFrame:
    """(split_id, series_id, n_samples, n_test, n_train_naive, n_train_purged, n_dropped)."""
    return _preview(counted_by(rows, info_segments(rows, test, embargo)))


def cpcv_preview(rows: DataFrame, n_groups: int = 6, n_test_groups: int = 2, **embargo) -> DataFrame:
    """purge_preview of all combinatorial splits, from the extents of the groups."""
    assigned = path_assignment(rows.sparkSession, n_groups, n_test_groups).select("split_id", "group_id")
    return _preview(counted_by(rows, group_segments(rows, assigned, n_groups, embargo_bars(rows, **embargo))))
