"""The two experiments: what leaks do to each protocol, and protocols compared on a panel."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, axis, features, folds, labels, learn, metrics
from ..sources import generators
from . import scoring


@dataclass(frozen=True)
class Config:
    mode: str = "toy"
    seed: int = 42
    n_toy: int = 1200
    horizon: int = 10
    n_splits: int = 5
    n_groups: int = 6
    n_test_groups: int = 2
    embargo_grid: tuple[float, ...] = (0.0, 0.01, 0.05)
    n_trials: int = 20
    periods_per_year: int = 252
    model: str = "logistic"


def load_config(path: str | None = None) -> Config:
    """Settings from a YAML file, whose unknown names are errors; defaults where there is no file."""
    if path is None or not os.path.exists(path):
        return Config()
    import yaml

    with open(path) as f:
        given = yaml.safe_load(f) or {}
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def protocols(rows: DataFrame, *, n_splits: int, n_groups: int, n_test_groups: int, embargo_pct: float, seed: int, numpy_shuffle: bool) -> DataFrame:
    """(protocol, split_id, series_id, pos, role): the splits of the four protocols in one relation."""
    naive = folds.naive_kfold_permuted(rows, n_splits, seed=seed) if numpy_shuffle else folds.naive_kfold(rows, n_splits, seed=seed)
    each = {
        "naive_kfold_INVALID": naive,
        "timeseries_split": folds.walk_forward(rows, n_splits),
        "purged_kfold": folds.purged_kfold(rows, n_splits, embargo_pct=embargo_pct),
        "cpcv": folds.cpcv(rows, n_groups, n_test_groups, embargo_pct=embargo_pct),
    }
    tagged = [df.select(F.lit(k).alias("protocol"), F.col("split_id").cast("int").alias("split_id"), "series_id", "pos", "role") for k, df in each.items()]
    return reduce(DataFrame.unionByName, tagged)


def leakage_grid(rows: DataFrame, columns: list[str], model: str, *, seed: int = 42, embargo_pct: float = 0.01) -> DataFrame:
    """protocol_auc of one model over all protocols of a labelled series; folds whose test labels are all equal are not scored."""
    splits = protocols(rows, n_splits=5, n_groups=6, n_test_groups=2, embargo_pct=embargo_pct, seed=seed, numpy_shuffle=True)
    splits = splits.withColumn("split_id", F.concat_ws(":", "protocol", F.col("split_id").cast("string"))).drop("protocol")
    if model == "knn":
        scored = learn.knn_proba(rows, splits, columns)
    elif model == "logistic":
        scored = learn.grouped_logistic(rows.withColumn("fwd", F.lit(0.0)), splits, columns)
    elif model == "rf":
        scored = learn.folds_proba(rows, splits, columns, lambda: learn.make_model("rf", seed=seed, n_estimators=80, min_samples_leaf=3))
    else:
        scored = learn.folds_proba(rows, splits, columns, lambda: learn.make_model(model, seed=seed))
    aucs = metrics.roc_auc(scored, ["split_id"], "y", "p").withColumn("protocol", F.element_at(F.split("split_id", ":"), 1))
    return scoring.protocol_auc(aucs, ["protocol"])


def synthetic_leakage(spark: SparkSession, n: int = 800, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(grid, audit): AUC by protocol with local overlap, with a future column and without it, and the audit of the latter table."""
    local = generators.overlap_local(spark, n, seed=seed)
    future = generators.future_column(spark, n, seed=seed)
    runs = [("overlap_local", "knn", local, ["x0", "x1"]), ("future_column", "logistic", future, ["lag1", "noise", "x_leak"]), ("future_column_dropped", "logistic", future, ["lag1", "noise"])]
    parts = [leakage_grid(rows, cols, model, seed=seed).select(F.lit(name).alias("dgp"), F.lit(model).alias("model"), F.lit("TOY").alias("label"), "protocol", "n_folds_scored", "auc_mean", "auc_std", "auc_min", "auc_max") for name, model, rows, cols in runs]
    return reduce(DataFrame.unionByName, parts), audit.audit_leakage(future, ["lag1", "noise", "x_leak"])


def aligned_panel(panel: DataFrame, horizon: int) -> DataFrame:
    """Features, labels and dense positions of a panel (series_id, t, close) with or without ret."""
    rows = axis.with_positions(panel)
    rows = rows if "ret" in panel.columns else features.with_log_return(rows)
    return features.align_xy(labels.fixed_horizon_returns(features.causal_features(rows), horizon), horizon=horizon)


def benchmark(panel: DataFrame, config: Config = Config(), *, tag: str = "toy_synthetic", numpy_shuffle: bool = False) -> DataFrame:
    """One row per series, protocol and embargo: the figures of protocol_summary, embargo_pct, tag, label, n_samples_aligned, model, ablation and notes.

    All protocols' folds of all series are fitted in one job. Combinatorial
    Sharpe figures are those of its paths; if a fold was too small to be
    scored they fall back to the folds, and `notes` says so.
    """
    rows = aligned_panel(panel, config.horizon).cache()
    default = config.embargo_grid[1] if len(config.embargo_grid) > 1 else 0.01
    splits = protocols(rows, n_splits=config.n_splits, n_groups=config.n_groups, n_test_groups=config.n_test_groups, embargo_pct=default, seed=config.seed, numpy_shuffle=numpy_shuffle)
    for e in config.embargo_grid:
        own = folds.purged_kfold(rows, config.n_splits, embargo_pct=e)
        splits = splits.unionByName(own.select(F.lit(embargo_name(e)).alias("protocol"), F.col("split_id").cast("int").alias("split_id"), "series_id", "pos", "role"))
    keys = ["protocol", "series_id", "split_id"]
    splits = scoring.enough_rows(splits, keys)
    predictions = learn.grouped_logistic(rows, splits, list(features.FEATURES), keys).cache()
    scores = scoring.fold_metrics(predictions, keys, n_trials=config.n_trials, periods_per_year=config.periods_per_year)
    summary = scoring.protocol_summary(scores, ["protocol", "series_id"]).withColumn("notes", F.lit(None).cast("string"))
    combos = predictions.where("protocol = 'cpcv'").drop("protocol")
    whole = combos.groupBy("series_id").agg(F.countDistinct("split_id").alias("k")).where(F.col("k") == folds.n_splits(config.n_groups, config.n_test_groups)).select("series_id")
    complete = combos.join(whole, "series_id", "left_semi")
    paths = scoring.path_metrics(rows, complete, config.n_groups, config.n_test_groups, n_trials=config.n_trials, periods_per_year=config.periods_per_year)
    by_path = scoring.protocol_summary(scores.where("protocol = 'cpcv'"), ["protocol", "series_id"], paths.withColumn("protocol", F.lit("cpcv"))).withColumn("notes", F.lit(None).cast("string"))
    rest = summary.join(by_path.select("protocol", "series_id"), ["protocol", "series_id"], "left_anti")
    note = F.when(F.col("protocol") == "cpcv", F.lit("paths incomplete: figures are per fold"))
    out = rest.withColumn("notes", note).unionByName(by_path)
    share = F.when(F.col("protocol").isin("purged_kfold", "cpcv"), F.lit(float(default))).otherwise(F.lit(0.0))
    ablation = F.lit(None).cast("string")
    for e in config.embargo_grid:
        own = F.col("protocol") == embargo_name(e)
        share, ablation = F.when(own, F.lit(float(e))).otherwise(share), F.when(own, F.lit("embargo")).otherwise(ablation)
    out = out.join(rows.groupBy("series_id").agg(F.count("*").alias("n_samples_aligned")), "series_id")
    label = "TOY" if tag.startswith("toy") else "DOWNLOADED"
    more = [share.alias("embargo_pct"), F.lit(tag).alias("tag"), F.lit(label).alias("label"), "n_samples_aligned", F.lit(config.model).alias("model"), ablation.alias("ablation"), "notes"]
    return out.select("series_id", *[c for c in summary.columns if c not in ("series_id", "notes")], *more)


def embargo_name(embargo_pct: float) -> str:
    return f"purged_kfold_embargo_{embargo_pct:.2%}"


PROTOCOLS = ("naive_kfold_INVALID", "timeseries_split", "purged_kfold", "cpcv")


def in_order_of_protocols(table: DataFrame) -> DataFrame:
    return table.where(F.col("protocol").isin(*PROTOCOLS)).orderBy(F.array_position(F.array(*map(F.lit, PROTOCOLS)), F.col("protocol")))


def figure_data(grid: DataFrame, dgp: str) -> DataFrame:
    """Rows behind a bar chart of one experiment, in the order of its bars."""
    return in_order_of_protocols(grid.where(F.col("dgp") == dgp)).select("protocol", "auc_mean", "auc_std")


def sharpe_figure(table: DataFrame) -> DataFrame:
    """Rows behind the bar chart of Sharpe ratios by protocol on the synthetic panel, in the order of its bars."""
    return in_order_of_protocols(table.where(F.col("tag") == "toy_synthetic")).select("protocol", "sharpe_mean", "sharpe_std")


def embargo_figure(table: DataFrame) -> DataFrame:
    """Points of the line of AUC by embargo, in percent of the rows, on the synthetic panel."""
    own = table.where((F.col("tag") == "toy_synthetic") & (F.col("ablation") == "embargo"))
    return own.orderBy("embargo_pct").select((F.col("embargo_pct") * 100).alias("embargo_percent"), "auc_mean")
