"""Classifiers for scored folds: a factory over Spark ML, exact k-nearest-neighbours, and many small fits at once."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import SPLIT
from .slices import in_ranges, prefix_scan
from .store import Stored, stored


#: Rows of a task of a boosted fit: it has some 240 passes, each of a task for each partition.
TASK_ROWS = 1 << 17


@dataclass
class Classifier:
    """fit(df, features) and predict_proba(df); `fallback_from` names the model that this one stands in for."""

    name: str
    seed: int = 42
    fallback_from: str | None = None
    how: dict = field(default_factory=dict)
    fitted: object = None
    features: list[str] = field(default_factory=list)
    centre: dict = field(default_factory=dict)

    def estimator(self, n: int):
        how = dict(self.how)
        common = {"labelCol": "y", "featuresCol": "_x"}
        if self.name == "logistic":
            c = how.pop("C", 1.0)
            return LogisticRegression(**common, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=how.pop("max_iter", 200), **how)
        if self.name == "random_forest":
            return RandomForestClassifier(**common, seed=self.seed, numTrees=how.pop("n_estimators", 100), minInstancesPerNode=how.pop("min_samples_leaf", 5), maxDepth=how.pop("max_depth", 20), **how)
        return GBTClassifier(**common, seed=self.seed, maxIter=how.pop("n_estimators", 80), maxDepth=how.pop("max_depth", 3), stepSize=how.pop("learning_rate", 0.1), **how)

    def assembled(self, df: DataFrame) -> DataFrame:
        """Features as one vector, for the logistic model centred and scaled by population deviations (1 where that is 0)."""
        scaled = [((F.col(f) - self.centre[f][0]) / self.centre[f][1] if f in self.centre else F.col(f)).cast("double").alias(f"_f{i}") for i, f in enumerate(self.features)]
        return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(scaled))], outputCol="_x").transform(df.select("*", *scaled))

    def fit(self, df: DataFrame, features: list[str]) -> Classifier:
        self.features = list(features)
        aggs = [F.count("*")]
        if self.name == "logistic":
            aggs += [a for f in features for a in (F.avg(f), F.stddev_pop(f))]
        n, *moments = df.agg(*aggs).first()
        if moments:
            self.centre = {f: (moments[2 * i], moments[2 * i + 1] or 1.0) for i, f in enumerate(features)}
        train = self.assembled(df).select("_x", F.col("y").cast("double"))
        if self.name == "gbm":  # partitions by the rows, not by what was shuffled before
            train = train.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
        self.fitted = self.estimator(n).fit(train)
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with p, the probability of class 1."""
        out = self.fitted.transform(self.assembled(df))
        return out.select(*df.columns, vector_to_array("probability")[1].alias("p"))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction."""
        return self.predict_proba(df).withColumn("prediction", (F.col("p") >= 0.5).cast("int")).drop("p")


def make_model(name: str = "logistic", *, seed: int = 42, **how) -> Classifier:
    """A model by name, in any case: logistic, rf or random_forest, gbm, xgboost (falls back to gbm), lstm (needs torch)."""
    kind = name.lower()
    if kind in ("logistic", "logreg"):
        return Classifier("logistic", seed, how=how)
    if kind in ("rf", "random_forest"):
        return Classifier("random_forest", seed, how=how)
    if kind == "gbm":
        return Classifier("gbm", seed, how=how)
    if kind in ("xgboost", "xgb"):
        return Classifier("gbm", seed, fallback_from="xgboost", how=how)
    if kind == "lstm":
        raise ImportError("the lstm model needs torch, which this engine does not ship; use logistic, random_forest or gbm")
    raise ValueError(f"unknown model {name!r}")


def folds_proba(rows: DataFrame, splits: DataFrame, features: list[str], factory, parallelism: int = 4) -> DataFrame:
    """(split_id, series_id, pos, y, p) on test rows: one Spark ML fit per fold, a few at a time from driver threads.

    For few large folds. Folds without both classes in training are skipped.
    """
    both = splits.join(rows.select("series_id", "pos", "y", *features), ["series_id", "pos"]).cache()
    ids = [r[0] for r in both.where("role = 'train'").groupBy("split_id").agg(F.countDistinct("y").alias("k")).where("k > 1").select("split_id").collect()]

    def one(i):
        own = both.where(F.col("split_id") == i)
        model = factory().fit(own.where("role = 'train'"), features)
        return model.predict_proba(own.where("role = 'test'")).select(*SPLIT, "pos", "y", "p")

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, sorted(ids)))
    both.unpersist()  # all fits are done
    if not parts:
        return both.limit(0).select(*SPLIT, "pos", "y", F.lit(0.0).alias("p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def newton_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights and intercept that minimise c * log loss + half the squared weights; the intercept is free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    pull = np.diag([*np.ones(x.shape[1]), 0.0])
    w = np.zeros(a.shape[1])
    loss = lambda w: c * np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ w)).sum() + 0.5 * w[:-1] @ w[:-1]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = c * a.T @ (p - y) + pull @ w
        h = c * (a * (p * (1 - p))[:, None]).T @ a + pull + 1e-12 * np.eye(len(w))
        step, size = np.linalg.solve(h, g), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-8:
            size /= 2
        w = w - size * step
        if np.abs(g).max() < 1e-10:
            break
    return w


def _newton_state(frames: Iterator[pd.DataFrame], keys: list[str], d: int, c: float) -> Iterator[pd.DataFrame]:
    """What a fold tries next, from the sums over its rows at the weights `w` that it tried.

    Weights that do not raise the loss become the base of a new Newton step;
    others halve the step from the last base. A fold is done when its step is
    so small that what is left of the error after it is beyond double
    precision, as each step squares the error.
    """
    upper = np.triu_indices(d + 1)
    pull = np.diag([*np.ones(d), 0.0])
    for df in frames:
        rows = []
        for r in df.itertuples(index=False):
            w, base, step, size, base_loss = np.array(r.w), np.array(r.base), np.array(r.step), r.size, r.base_loss
            sums = np.array(r.sums)
            loss = c * sums[0] + 0.5 * w[:-1] @ w[:-1]
            done = False
            if loss <= base_loss + 1e-13 * abs(base_loss) or size <= 1e-8:
                h = np.zeros((d + 1, d + 1))
                h[upper] = c * sums[d + 2 :]
                h = h + np.triu(h, 1).T + pull + 1e-12 * np.eye(d + 1)
                step = np.linalg.solve(h, c * sums[1 : d + 2] + pull @ w)
                base, base_loss, size = w, loss, 1.0
                done = bool(np.abs(step).max() < 1e-6)
            else:
                size /= 2
            rows.append((*[getattr(r, k) for k in keys], (base - size * step).tolist(), base.tolist(), step.tolist(), size, base_loss, done))
        yield pd.DataFrame(rows, columns=[*keys, "w", "base", "step", "size", "base_loss", "done"])


#: Numbers in the weights of all folds (4 MB) from which on rows are placed by fold, and folds of a task then.
MANY_WEIGHTS, TASK_FOLDS = 1 << 19, 1 << 13


def newton_weights(train: DataFrame, keys: list[str], d: int, c: float = 1.0, rounds: int = 60) -> Stored:
    """(keys, w) of the logistic fit of each fold: weights and, last, the intercept, as newton_logistic has them.

    train: (keys, y, x0 .. x{d-1}). A round is one pass for all folds: gradient
    and Hessian are sums, added up in the tasks before the shuffle, so a fold
    of any size and any number of folds are fitted alike; what is solved per
    fold is one small system. The weights of a round are a stored table, joined
    to the rows by their size (broadcast where they are few). Where they are
    many, the rows are put in order of the folds once, on disk, and only
    weights are shuffled in a round.
    """
    zero = F.array(*[F.lit(0.0)] * (d + 1))
    state = stored(train.select(*keys).distinct().select("*", zero.alias("w"), zero.alias("base"), zero.alias("step"), F.lit(1.0).alias("size"), F.lit(float("inf")).alias("base_loss"), F.lit(False).alias("done")), "newton")
    x = [F.col(f"x{j}") for j in range(d)] + [F.lit(1.0)]
    folds = state.df.count()
    placed = folds * (d + 1 + len(keys)) >= MANY_WEIGHTS
    if placed:
        parts = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), folds // TASK_FOLDS)
        train = train.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)
    for _ in range(rounds):
        open_ = state.df.where("NOT done")
        if open_.isEmpty():
            break
        z = sum((F.col("w")[j] * x[j] for j in range(d)), F.col("w")[d])
        at = train.join(open_.select(*keys, "w"), keys).withColumn("_z", z)
        p = 1 / (1 + F.exp(-F.greatest(F.least("_z", F.lit(500.0)), F.lit(-500.0))))
        # log(1 + exp(v)) without overflow, v being -z for label 1 and z for label 0
        v = F.when(F.col("y") == 1, -F.col("_z")).otherwise(F.col("_z"))
        at = at.withColumn("_loss", F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))).withColumn("_p", p)
        off, curve = F.col("_p") - F.col("y"), F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum("_loss"), *[F.sum(off * x[j]) for j in range(d + 1)], *[F.sum(curve * x[i] * x[j]) for i in range(d + 1) for j in range(i, d + 1)]]
        found = at.groupBy(*keys).agg(*[s.alias(f"_s{i}") for i, s in enumerate(sums)]).select(*keys, F.array(*[f"_s{i}" for i in range(len(sums))]).alias("sums"))
        asked = found.join(open_, keys)
        moved = asked.select(*keys, "sums", "w", "base", "step", "size", "base_loss").mapInPandas(lambda frames: _newton_state(frames, keys, d, c), state.df.schema)
        new = stored(moved.unionByName(state.df.where("done")), "newton")
        state.drop()
        state = new
    if placed:
        train.unpersist()
    return state


def grouped_logistic(rows: DataFrame, splits: DataFrame, features: list[str], keys: list[str] | None = None, c: float = 1.0) -> DataFrame:
    """(keys, pos, y, fwd, p) on test rows: the logistic fits of all folds, by Newton steps that all folds take together.

    Features are centred and scaled by the training rows of each fold.
    Folds without both classes in training are left out.
    """
    keys = keys or SPLIT
    both = splits.join(rows.select("series_id", "pos", F.col("y").cast("int").alias("y"), F.col("fwd").cast("double").alias("fwd"), *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]), ["series_id", "pos"])
    names = [f"x{j}" for j in range(len(features))]
    train = both.where("role = 'train'").select(*keys, "y", *names)
    flat = lambda x: F.min(x) == F.max(x)
    scale = train.groupBy(*keys).agg(*[F.avg(x).alias(f"_m{x}") for x in names], *[F.when(flat(x) | (F.stddev_pop(x) == 0), 1.0).otherwise(F.stddev_pop(x)).alias(f"_d{x}") for x in names], F.min("y").alias("_a"), F.max("y").alias("_b"))
    scale = stored(scale.where("_a < _b").drop("_a", "_b"), "scale").df
    scaled = [((F.col(x) - F.col(f"_m{x}")) / F.col(f"_d{x}")).alias(x) for x in names]
    fitted_rows = stored(train.join(scale, keys).select(*keys, "y", *scaled), "fold-rows")
    weights = newton_weights(fitted_rows.df, keys, len(names), c).df.select(*keys, "w")
    fitted_rows.drop()
    test = both.where("role = 'test'").join(scale, keys).join(weights, keys).select(*keys, "pos", "y", "fwd", "w", *scaled)
    z = sum((F.col("w")[j] * F.col(x) for j, x in enumerate(names)), F.col("w")[len(names)])
    return test.select(*keys, "pos", "y", "fwd", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias("p"))


def knn_proba(rows: DataFrame, splits: DataFrame, features: list[str], k: int = 11, cell: int = 32, range_rows: int = 1 << 18) -> DataFrame:
    """(split_id, series_id, pos, y, p): share of label 1 among the k nearest training rows of the same split, ties by position.

    Exact. The training rows of each split and series are put in order of the
    first feature, by ranges of its values of `range_rows` rows or so (so no
    task sees a series of more), and cut into cells of `cell` rows. A test row is compared with the cell it falls in
    and those beside it, which hold k rows at least. What is nearer than the
    k-th of these can lie only in cells whose first feature comes that near;
    these alone are visited besides, and there are none for one feature
    without ties. Of equal training rows the k first are enough.
    """
    if cell < k:
        raise ValueError("a cell holds k rows at least")
    f = [f"_f{i}" for i in range(len(features))]
    both = splits.join(rows.select("series_id", "pos", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, f, strict=True)]), ["series_id", "pos"])
    y_type = rows.schema["y"].dataType
    both = stored(both.select(*SPLIT, "pos", "y", *f, F.when(F.col("role") == "train", 1).otherwise(0).alias("_train")), "neighbours").df
    ranges = -(-both.count() // range_rows)
    copy = F.row_number().over(Window.partitionBy(*SPLIT, *f).orderBy("pos"))
    if ranges <= 1:
        both = both.repartition(*SPLIT)  # serves all windows and cells, as no series is long
    train = both.where("_train = 1").withColumn("_copy", copy).where(F.col("_copy") <= k).drop("_copy")

    def counted(points: DataFrame) -> DataFrame:
        """points (keys, _v, _train, _tie, ..) with _before: training rows before each in order of _v and _tie."""
        placed = in_ranges(points, "_v", max(1, ranges)).withColumn("_order", F.struct("_v", "_tie"))
        if ranges <= 1:
            out = placed.withColumn("_before", F.sum("_train").over(Window.partitionBy(*SPLIT).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)))
        else:
            out = prefix_scan(placed, {"_before": ("sum", F.col("_train"))}, SPLIT, "_order", part="_range", inclusive=False)
        return out.withColumn("_before", F.coalesce("_before", F.lit(0))).drop("_range", "_order")

    line = train.unionByName(both.where("_train = 0")).withColumn("_v", F.col("_f0")).withColumn("_tie", F.struct(F.col("_train").alias("kind"), "pos", F.lit(0).alias("side")))
    line = counted(line).withColumn("_cell", F.floor(F.col("_before") / cell)).drop("_v", "_tie")
    row = F.struct(F.col("pos").alias("at"), "y", *f)
    cells = line.where("_train = 1").groupBy(*SPLIT, "_cell").agg(F.collect_list(row).alias("_rows"), F.min("_f0").alias("_lo"), F.max("_f0").alias("_hi"))
    beside = F.abs(F.col("_cell") - F.col("_home")) <= 1
    only = lambda c: F.when(beside, F.col(c))
    near = cells.withColumn("_home", F.explode(F.sequence(F.col("_cell") - 2, F.col("_cell") + 2))).groupBy(*SPLIT, "_home").agg(
        F.flatten(F.collect_list(only("_rows"))).alias("_rows"), F.min(only("_lo")).alias("_lo"), F.max(only("_hi")).alias("_hi"), F.min("_cell").alias("_first"), F.max("_cell").alias("_last")
    )

    def pair(r):
        distance = sum(((F.col(c) - r[c]) * (F.col(c) - r[c]) for c in f), F.lit(0.0))
        return F.struct(distance.alias("d"), r["at"].alias("at"), r["y"].alias("y"))

    nearest = lambda pairs: F.slice(F.sort_array(pairs), 1, k)
    share = F.aggregate("_near", F.lit(0.0), lambda acc, x: acc + x["y"]) / F.size("_near")
    result = lambda df: df.select(*SPLIT, "pos", F.col("y").cast(y_type).alias("y"), share.alias("p"))
    test = line.where("_train = 0").withColumnRenamed("_cell", "_home")
    found = test.join(near, [*SPLIT, "_home"]).withColumn("_near", nearest(F.transform("_rows", pair)))
    reach, gap = F.try_element_at("_near", F.lit(k))["d"], lambda c: (F.col("_f0") - F.col(c)) * (F.col("_f0") - F.col(c))
    more = (F.col("_first") < F.col("_home") - 1) & (gap("_lo") <= reach) | (F.col("_last") > F.col("_home") + 1) & (gap("_hi") <= reach)
    found = stored(found.select(*SPLIT, "pos", "y", *f, "_home", "_near", reach.alias("_reach"), F.coalesce(more, F.lit(False)).alias("_more")), "neighbours").df
    asking = found.where("_more")
    if asking.isEmpty():
        return result(found)
    # how many training rows lie before the interval that may hold nearer ones, and up to its end
    margin = F.sqrt("_reach") * (1 + 1e-12)
    ends = asking.select(*SPLIT, "pos", F.lit(0).alias("_train"), F.inline(F.array(F.struct((F.col("_f0") - margin).alias("_v"), F.lit(-1).alias("side")), F.struct((F.col("_f0") + margin).alias("_v"), F.lit(1).alias("side")))))
    points = train.select(*SPLIT, "pos", "_train", F.col("_f0").alias("_v"), F.lit(0).alias("side")).unionByName(ends)
    points = counted(points.withColumn("_tie", F.struct(F.col("side").alias("kind"), "pos", F.col("side").alias("side"))))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("_before")))
    spans = points.where("side <> 0").groupBy(*SPLIT, "pos").agg(F.floor(of(-1) / cell).alias("_from"), F.floor((of(1) - 1) / cell).alias("_to"))
    wanted = asking.join(spans, [*SPLIT, "pos"]).withColumn("_cell", F.explode(F.sequence("_from", F.greatest("_from", "_to"))))
    wanted = wanted.where(F.abs(F.col("_cell") - F.col("_home")) > 1)
    visited = wanted.join(cells, [*SPLIT, "_cell"]).select(*SPLIT, "pos", "y", nearest(F.transform("_rows", pair)).alias("_near"))
    merged = visited.unionByName(found.select(*SPLIT, "pos", "y", "_near")).groupBy(*SPLIT, "pos", "y").agg(nearest(F.flatten(F.collect_list("_near"))).alias("_near"))
    return result(merged)
