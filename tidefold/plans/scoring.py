"""Scores per fold, per path and per protocol, from one relation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.numeric import finite
from ..operators import metrics
from ..operators.features import overlay_return, position_from_proba
from ..operators.folds import placed_on_paths, uncovered

METRICS = ("auc", "mcc", "f1", "balanced_acc", "ic", "sharpe", "dsr", "max_dd", "turnover", "frac_sharpe_pos")


def with_overlay(predictions: DataFrame) -> DataFrame:
    """predictions (.., pos, y, p, fwd) with prediction, position and strat, the return of following them."""
    p = F.col("p")
    return predictions.select("*", F.when(p >= 0.5, 1).otherwise(0).alias("prediction"), position_from_proba(p).alias("position"), overlay_return(p, F.col("fwd")).alias("strat"))


def fold_metrics(predictions: DataFrame, keys: list[str], *, n_trials: int = 20, periods_per_year: float = 252) -> DataFrame:
    """(keys, n_test, the ten METRICS): one row per group of predictions (keys, pos, y of 0 or 1, p, fwd).

    Ranks, changes of position and wealth are columns over windows of the same
    keys, so that one shuffle serves all of them and the aggregation.
    """
    df = with_overlay(predictions)
    df = df.select(*keys, "pos", "prediction", "strat", finite("y").alias("y"), finite("p").alias("p"), finite("fwd").alias("fwd"), finite("position").alias("_x"), finite("strat").alias("_s"))
    labelled, paired = F.col("y").isNotNull() & F.col("p").isNotNull(), F.col("fwd").isNotNull() & F.col("p").isNotNull()
    in_order = Window.partitionBy(*keys).orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_auc", metrics.average_rank("p", keys, labelled))
    df = df.withColumn("_rp", metrics.average_rank("p", keys, paired)).withColumn("_rf", metrics.average_rank("fwd", keys, paired))
    df = df.withColumn("_step", F.abs(F.col("_x") - F.last("_x", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))))
    df = df.withColumn("_wealth", F.product(1 + F.col("_s")).over(so_far))
    df = df.withColumn("_fall", F.col("_wealth") / F.greatest(F.max("_wealth").over(so_far), F.lit(1e-16)) - 1)
    one, zero, up = F.col("y") == 1, F.col("y") == 0, F.col("prediction") == 1
    ones, n = stats.hits(labelled & one), stats.hits(labelled)
    tp, fp, fn, tn = stats.hits(one & up), stats.hits(zero & up), stats.hits(one & ~up), stats.hits(zero & ~up)
    total, true, called = tp + fp + fn + tn, (tp + fn, tn + fp), (tp + fp, tn + fn)
    mcc = F.try_divide((tp + tn) * total - true[0] * called[0] - true[1] * called[1], F.sqrt((total * total - called[0] * called[0] - called[1] * called[1]) * (total * total - true[0] * true[0] - true[1] * true[1])))
    recall = [F.try_divide(hit, t) for hit, t in zip((tp, tn), true, strict=True)]
    occurring = sum((F.when(t > 0, 1.0).otherwise(0.0) for t in true), F.lit(0.0))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_test"),
        F.try_divide(F.sum(F.when(one, F.col("_auc")).otherwise(0.0)) - ones * (ones + 1) / 2, ones * (n - ones)).alias("auc"),
        F.when(total > 0, F.coalesce(mcc, F.lit(0.0))).alias("mcc"),
        stats.f1_binary("y", "prediction").alias("f1"),
        F.try_divide(F.coalesce(recall[0], F.lit(0.0)) + F.coalesce(recall[1], F.lit(0.0)), occurring).alias("balanced_acc"),
        F.when(stats.hits(paired) >= 3, stats.pearson(F.col("_rp"), F.col("_rf"))).alias("ic"),
        stats.sharpe_ratio("strat", periods_per_year=periods_per_year).alias("sharpe"),
        stats.deflated_sharpe_ratio("strat", n_trials=n_trials).alias("dsr"),
        F.min("_fall").alias("max_dd"),
        F.avg("_step").alias("turnover"),
    )
    positive = F.when(F.col("sharpe") > 0, 1.0).otherwise(0.0)
    return out.withColumn("frac_sharpe_pos", positive).select(*keys, "n_test", *METRICS)


def enough_rows(splits: DataFrame, keys: list[str], least_train: int = 20, least_test: int = 5) -> DataFrame:
    """splits without folds of fewer rows than these."""
    sizes = splits.groupBy(*keys).agg(F.sum(F.when(F.col("role") == "train", 1).otherwise(0)).alias("_a"), F.sum(F.when(F.col("role") == "test", 1).otherwise(0)).alias("_b"))
    good = sizes.where((F.col("_a") >= least_train) & (F.col("_b") >= least_test)).select(*keys)
    return splits.join(good, keys, "left_semi")


def path_metrics(rows: DataFrame, predictions: DataFrame, n_groups: int, n_test_groups: int, *, n_trials: int = 20, periods_per_year: float = 252) -> DataFrame:
    """(series_id, path_id, sharpe, dsr) of the reconstructed paths of combinatorial predictions."""
    carried = [c for c in ("n", "group_id") if c in predictions.columns]
    strat = with_overlay(predictions).select("split_id", "series_id", "pos", *carried, F.col("strat").alias("value"))
    paths = placed_on_paths(rows, strat, n_groups, n_test_groups)
    sharpe, dsr = stats.sharpe_ratio("value", periods_per_year=periods_per_year), stats.deflated_sharpe_ratio("value", n_trials=n_trials)
    found = paths.groupBy("series_id", "path_id").agg(sharpe.alias("sharpe"), dsr.alias("dsr"), uncovered().alias("_wrong"))
    return found.select("series_id", "path_id", (F.col("sharpe") + F.col("_wrong")).alias("sharpe"), "dsr")


def deviation(x: str):
    """Sample deviation, 0 for a single value."""
    return F.when(F.count(finite(x)) > 1, F.stddev_samp(finite(x))).when(F.count(finite(x)) == 1, 0.0)


def protocol_summary(scores: DataFrame, keys: list[str], paths: DataFrame | None = None) -> DataFrame:
    """(keys, n_scores, means and deviations over folds); Sharpe figures come from `paths` (keys, sharpe, dsr) where given."""
    mean = lambda c: F.avg(finite(c))
    out = scores.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n_scores"),
        mean("auc").alias("auc_mean"),
        deviation("auc").alias("auc_std"),
        mean("mcc").alias("mcc_mean"),
        mean("sharpe").alias("sharpe_mean"),
        deviation("sharpe").alias("sharpe_std"),
        mean("dsr").alias("dsr_mean"),
        stats.frac_positive("sharpe").alias("frac_paths_sharpe_gt_0"),
        mean("ic").alias("ic_mean"),
        mean("max_dd").alias("max_dd_mean"),
    )
    if paths is None:
        return out
    own = paths.groupBy(*keys).agg(F.count("*").cast("int").alias("n_scores"), mean("sharpe").alias("sharpe_mean"), deviation("sharpe").alias("sharpe_std"), mean("dsr").alias("dsr_mean"), stats.frac_positive("sharpe").alias("frac_paths_sharpe_gt_0"))
    return out.select(*keys, *[c for c in out.columns if c not in keys and c not in own.columns]).join(own, keys).select(*out.columns)


def protocol_auc(aucs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_folds_scored, auc_mean, auc_std, auc_min, auc_max) from one auc per fold; unscored folds do not count."""
    auc = finite("auc")
    return aucs.groupBy(*keys).agg(F.count(auc).cast("int").alias("n_folds_scored"), F.avg(auc).alias("auc_mean"), F.coalesce(deviation("auc"), F.lit(0.0)).alias("auc_std"), F.min(auc).alias("auc_min"), F.max(auc).alias("auc_max"))
