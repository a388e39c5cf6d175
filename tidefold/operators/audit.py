"""Leakage audit of a feature table: overlapping labels, look-ahead columns, unsafe timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.stats import pearson
from .folds import overlap_fraction
from .axis import by_pos


def adjacent_overlap(rows: DataFrame) -> DataFrame:
    """(series_id, n_overlaps, fraction, median_lifetime): labels that reach their successor, of all with one."""
    inner = F.col("pos") < F.col("n") - 1
    reach = F.when(inner & (F.col("t1_pos") >= F.col("pos") + 1), 1).otherwise(0)
    count, pairs = F.sum(reach), F.sum(F.when(inner, 1).otherwise(0))
    lifetime = F.greatest(F.col("t1_pos") - F.col("pos"), F.lit(0))
    return rows.groupBy("series_id").agg(count.alias("n_overlaps"), F.coalesce(F.try_divide(count, pairs), F.lit(0.0)).alias("fraction"), F.percentile(lifetime, F.lit(0.5)).alias("median_lifetime"))


def duplicate_times(df: DataFrame, name: str = "duplicate_index_on_X") -> DataFrame:
    """(series_id, hazard, n_duplicates): a hazard for each series in which a time occurs twice."""
    doubles = df.groupBy("series_id", "t").count().where(F.col("count") > 1)
    return doubles.groupBy("series_id").agg(F.lit(name).alias("hazard"), F.sum(F.col("count") - 1).alias("n_duplicates"))


def merge_hazards(merges: dict[str, DataFrame]) -> DataFrame | None:
    """duplicate_times of each merged table, under duplicate_index:name; None without tables."""
    out = None
    for name, df in merges.items():
        part = duplicate_times(df, f"duplicate_index:{name}")
        out = part if out is None else out.unionByName(part)
    return out


def late_features(df: DataFrame, times: dict[str, Column], label_start: str = "label_start") -> DataFrame:
    """(series_id, feature, late, late_share): whether a feature's time is after the start of the label.

    `times` gives each feature's time, as a column or, for one time of the
    whole feature, a literal: that is compared with the earliest start, which
    comes to the same as any row being late.
    """
    late = lambda t: F.when(t > F.col(label_start), 1.0).otherwise(0.0)
    agg = df.groupBy("series_id").agg(*[F.avg(late(t)).alias(f"_{i}") for i, t in enumerate(times.values())])
    each = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"_{i}").alias("late_share")) for i, name in enumerate(times)])
    return agg.select("series_id", F.inline(each)).withColumn("late", F.col("late_share") > 0).select("series_id", "feature", "late", "late_share")


def future_correlations(df: DataFrame, features: list[str], y: str = "y", least_pairs: int = 10) -> DataFrame:
    """(series_id, feature, corr_next, corr_now): correlation of each feature with the next and the same row's label, from one pass.

    Fewer than `least_pairs` known pairs, and constant sides, give 0.
    """
    df = df.withColumn("_y", finite(y)).withColumn("_y1", F.lead("_y", 1).over(by_pos()))
    exprs = []
    for i, f in enumerate(features):
        x = finite(F.expr(f"try_cast(`{f}` AS DOUBLE)"))
        for name, target in (("n", F.col("_y1")), ("s", F.col("_y"))):
            pairs = F.count(F.when(x.isNotNull() & target.isNotNull(), 1))
            exprs.append(F.when(pairs >= least_pairs, F.coalesce(pearson(x, target), F.lit(0.0))).otherwise(0.0).alias(f"_{name}{i}"))
    agg = df.groupBy("series_id").agg(*exprs)
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_n{i}").alias("corr_next"), F.col(f"_s{i}").alias("corr_now")) for i, f in enumerate(features)])
    return agg.select("series_id", F.inline(each))


def score(adjacent: Column, split: Column, n_columns: Column, n_hazards: Column) -> Column:
    """Weighted sum of what was found, at most 1."""
    return F.least(F.lit(1.0), 0.4 * adjacent + 0.3 * split + F.least(F.lit(0.4), 0.15 * n_columns) + F.least(F.lit(0.2), 0.1 * n_hazards))


def audit_leakage(rows: DataFrame, features: list[str], *, y: str | None = "y", test: DataFrame | None = None, feature_times: dict[str, Column] | None = None, merges: dict[str, DataFrame] | None = None, future_corr_threshold: float = 0.75) -> DataFrame:
    """One row per series: score, fractions, future_columns, hazards and notes.

    rows: (series_id, pos, n, t1_pos, features, and y, t, label_start where
    given). A feature is a future column if its correlation with the next
    label, or else with the row's own, reaches the threshold, or if its time
    is after the start of a label.
    """
    out = adjacent_overlap(rows)
    if test is not None:
        split = overlap_fraction(rows, test).groupBy("series_id").agg(F.max("overlap").alias("split_overlap"))
        out = out.join(split, "series_id", "left")
    else:
        out = out.withColumn("split_overlap", F.lit(0.0))
    flagged = None
    if y is not None and features:
        c = future_correlations(rows, features, y)
        flagged = c.where((F.abs("corr_next") >= future_corr_threshold) | (F.abs("corr_now") >= future_corr_threshold)).select("series_id", "feature")
    if feature_times:
        late = late_features(rows, feature_times).where("late").select("series_id", "feature")
        flagged = late if flagged is None else flagged.unionByName(late)
    if flagged is not None:
        flagged = flagged.groupBy("series_id").agg(F.array_sort(F.collect_set("feature")).alias("future_columns"))  # at most one entry per feature
        out = out.join(flagged, "series_id", "left")
    else:
        out = out.withColumn("future_columns", F.lit(None).cast("array<string>"))
    hazards = duplicate_times(rows) if "t" in rows.columns else None
    more = merge_hazards(merges or {})
    hazards = more if hazards is None else hazards if more is None else hazards.unionByName(more)
    if hazards is not None:
        out = out.join(hazards.groupBy("series_id").agg(F.array_sort(F.collect_set("hazard")).alias("hazards")), "series_id", "left")
    else:
        out = out.withColumn("hazards", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    out = out.withColumn("future_columns", F.coalesce("future_columns", none)).withColumn("hazards", F.coalesce("hazards", none)).na.fill(0.0, ["split_overlap"])
    notes = F.array_compact(
        F.array(
            F.when(F.col("fraction") > 0.05, F.lit("labels overlap their successors: use purged splits")),
            F.when(F.size("future_columns") > 0, F.lit("columns that know the future inflate every protocol")),
        )
    )
    total = score(F.col("fraction"), F.col("split_overlap"), F.size("future_columns"), F.size("hazards"))
    return out.select("series_id", total.alias("score"), F.col("n_overlaps"), F.col("fraction").alias("adjacent_overlap_fraction"), F.col("split_overlap").alias("split_overlap_fraction"), "median_lifetime", "future_columns", "hazards", notes.alias("notes"))


def report(row) -> str:
    """A printable summary of one row of audit_leakage."""
    lines = [f"leakage score {row['score']:.3f}", f"  overlapping neighbours: {row['n_overlaps']} ({row['adjacent_overlap_fraction']:.3f})", f"  overlap with the test set: {row['split_overlap_fraction']:.3f}", f"  median label lifetime: {row['median_lifetime']:g}"]
    lines += [f"  future columns: {', '.join(row['future_columns']) or 'none'}", f"  hazards: {', '.join(row['hazards']) or 'none'}", *[f"  note: {n}" for n in row["notes"]]]
    return "\n".join(lines)
