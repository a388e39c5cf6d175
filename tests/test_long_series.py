"""What is done in slices or ranges equals what windows over whole series give; one series holds a third of the rows."""

import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidefold.operators import axis, features, folds, labels, learn, metrics, slices


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    rows = [("long", i, float(x)) for i, x in enumerate(np.exp(rng.normal(0, 0.1, 200).cumsum()))]
    rows += [(f"s{k}", i, float(x)) for k in range(8) for i, x in enumerate(np.exp(rng.normal(0, 0.1, 50).cumsum()))]
    rows = [(s, i, None if i % 17 == 5 else x) for s, i, x in rows] + [("one", 0, 1.0), (None, 0, 2.0), (None, 1, 3.0)]
    df = spark.createDataFrame(rows, "series_id string, t long, close double")
    return axis.with_positions(axis.bars(df, "series_id", "t", "close")).cache()


def same(a, b, on):
    """Rows by key, floats within rounding."""
    a, b = ({tuple(r[k] for k in on): r.asDict() for r in df.collect()} for df in (a, b))
    assert set(a) == set(b)
    for k, r in a.items():
        for c, v in r.items():
            assert v == pytest.approx(b[k][c], rel=1e-9, abs=1e-12, nan_ok=True) if isinstance(v, float) else v == b[k][c], (k, c)


def test_scans(spark, bars):
    x = F.col("close")
    kinds = {"a": ("sum", x), "b": ("product", x), "c": ("max", x), "d": ("min", -x), "e": ("last", F.when(x > 1, x))}
    for inclusive in (True, False):
        w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        whole = bars.select("*", F.sum(x).over(w).alias("a"), F.product(x).over(w).alias("b"), F.max(x).over(w).alias("c"), F.min(-x).over(w).alias("d"), F.last(F.when(x > 1, x), ignorenulls=True).over(w).alias("e"))
        same(slices.prefix_scan(bars, kinds, ["series_id"], rows=7, inclusive=inclusive), whole, ["series_id", "pos"])
    assert slices.prefix_scan(bars.limit(0), kinds, ["series_id"]).count() == 0
    with pytest.raises(ValueError):
        slices.prefix_scan(bars, {"a": ("median", x)}, ["series_id"])


@pytest.mark.parametrize("rows", [3, 16, 1000])
def test_features_labels_and_alignment(bars, rows):
    plain = labels.fixed_horizon_returns(features.causal_features(features.with_log_return(bars)), 4)
    sliced = labels.fixed_horizon_returns(features.causal_features(features.with_log_return(bars, rows), slice_rows=rows), 4, slice_rows=rows)
    same(sliced, plain, ["series_id", "pos"])
    known = ("ret_lag1", "ret_lag2")
    same(features.align_xy(sliced, known, 4, slice_rows=rows), features.align_xy(plain, known, 4).where("series_id IS NOT NULL"), ["series_id", "pos"])
    keyed = bars.where("series_id IS NOT NULL")
    same(labels.vertical_barrier(keyed, 4, by_join=True), labels.vertical_barrier(keyed, 4), ["series_id", "pos"])


def test_turnover_and_drawdown(spark, bars):
    rng = np.random.default_rng(0)
    rows = [(k, i, float(x)) for k, n in ((0, 300), (1, 40), (2, 1), (3, 5)) for i, x in enumerate(rng.normal(0, 0.5, n))]
    rows += [(4, i, x) for i, x in enumerate([0.1, -3.0, 0.2, -2.5, 0.1, None, -0.5])]  # wealth below zero and back
    df = spark.createDataFrame(rows, "k int, pos long, x double")
    for size in (2, 7, 1000):
        same(metrics.turnover(df, ["k"], "x", slice_rows=size), metrics.turnover(df, ["k"], "x"), ["k"])
        same(metrics.max_drawdown(df, ["k"], "x", slice_rows=size), metrics.max_drawdown(df, ["k"], "x"), ["k"])


def test_overflow_stays(spark):
    """Wealth that overflows within a slice, or at its end, and would come back below the largest double."""
    up = [8.0] * 340 + [4.0, 2.0, 1.5, 0.9, 1.5, 0.5, 0.5, 0.5, 1.1, 0.25] + [0.9] * 9
    rows = [(k, i, x) for k, sign in ((0, 1.0), (1, -1.0)) for i, x in enumerate([sign, *up])] + [(2, i, x) for i, x in enumerate([1.0, 2.0, 0.5])]
    df = spark.createDataFrame(rows, "k int, pos long, x double")
    for inclusive in (True, False):
        w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        for size in (4, 7, 50):
            same(slices.prefix_scan(df, {"a": ("product", F.col("x"))}, ["k"], rows=size, inclusive=inclusive), df.select("*", F.product("x").over(w).alias("a")), ["k", "pos"])
    rise = df.where("k <> 1").withColumn("x", F.col("x") - 1)
    for size in (4, 7, 50):
        same(metrics.max_drawdown(rise, ["k"], "x", slice_rows=size), metrics.max_drawdown(rise, ["k"], "x"), ["k"])


def test_ranks_by_ranges(spark):
    """Ties within and across keys, a value that a third of the rows have, NaN and nulls, a null key, one group only."""
    rng = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else i % 3, float(v), float(y), 0.5 if i % 3 == 0 else float(s)) for i, (v, y, s) in enumerate(zip(rng.integers(0, 40, 600), rng.integers(0, 2, 600), rng.normal(size=600), strict=True))]
    rows += [(0, float("nan"), 1.0, 0.1), (0, 3.0, None, 0.2), (0, 3.0, 1.0, None), (9, 1.0, 1.0, 1.0), (9, 2.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double, y double, s double")
    for ranges in (1, 2, 9, 64, None):
        same(slices.auc_by_ranges(df, ["k"], "y", "s", ranges), metrics.roc_auc(df, ["k"], "y", "s"), ["k"])
        same(slices.ic_by_ranges(df, ["k"], "v", "s", ranges), metrics.information_coefficient(df, ["k"], "v", "s"), ["k"])
    assert slices.auc_by_ranges(df, [], "y", "s").first().auc == pytest.approx(metrics.roc_auc(df, [], "y", "s").first().auc)
    assert slices.value_ranks(df.limit(0), ["k"], "v").count() == 0


def test_rank_sums_join_no_values(spark):
    """Sums of ranks are made where the ranks are: a join, and a shuffle of all values for it, was there before."""
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("y"), (F.col("id") * 7 % 101).cast("double").alias("s"))
    got = slices.auc_by_ranges(df, ["k"], "y", "s", 9)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    same(got, metrics.roc_auc(df, ["k"], "y", "s"), ["k"])


def windows(df):
    """Partition keys of the windows of a plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"(\w+)#", m)) for m in re.findall(r"Window \[.*?\], \[(.*?)\], \[", text)]


def test_no_window_of_rows_is_keyed_by_the_series_alone(spark):
    bars = spark.range(100).select((F.col("id") % 1).alias("series_id"), F.col("id").alias("pos"), F.rand(1).alias("close"))
    sliced = features.causal_features(features.with_log_return(bars, 16), slice_rows=16)
    assert windows(features.causal_features(bars, "close"))[0] == {"series_id"}
    assert windows(sliced) and all("_slice" in w for w in windows(sliced))


def test_newton_steps_together_equal_one_fold_at_a_time(spark):
    """Weights within 1e-9, for a fold with a third of all rows, one that is separable, one of one class and one that needs damping."""
    rng = np.random.default_rng(2)
    rows, tests = [], []
    for k, n in enumerate((400, 30, 25, 60, 8)):
        x = rng.normal(size=(n, 3)) * [1, 50, 1e-3]
        y = (x[:, 0] + rng.normal(size=n) * 0.7 > 0).astype(int)
        if k == 1:
            y = (x[:, 0] > 0).astype(int)
        if k == 2:
            y[:] = 1
        if k == 3:
            y[:] = 0
            y[:2], x[0] = 1, [30.0, 900.0, 0.5]
        if k == 4:
            x[:, 1] = 7.0  # does not vary
        rows += [(f"k{k}", i, int(v), 0.0, *map(float, r)) for i, (v, r) in enumerate(zip(y, x, strict=True))]
        tests += [(0, f"k{k}", i, "train" if i % 4 else "test") for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, pos long, y int, fwd double, a double, b double, c double")
    splits = spark.createDataFrame(tests, "split_id int, series_id string, pos long, role string")
    got = {(r.series_id, r.pos): r.p for r in learn.grouped_logistic(df, splits, ["a", "b", "c"], c=2.0).collect()}
    expected = {}
    for k in range(5):
        own = [r for r in rows if r[0] == f"k{k}"]
        x, y, test = np.array([r[4:] for r in own]), np.array([r[2] for r in own]), np.array([r[1] % 4 == 0 for r in own])
        if len(set(y[~test])) < 2:
            continue
        mean, dev = x[~test].mean(0), np.where(np.ptp(x[~test], 0) > 0, x[~test].std(0), 1)
        w = learn.newton_logistic((x[~test] - mean) / dev, y[~test], 2.0)
        expected |= {(f"k{k}", own[i][1]): 1 / (1 + np.exp(-((x[i] - mean) / dev @ w[:-1] + w[-1]))) for i in np.flatnonzero(test)}
    assert set(got) == set(expected) and len({k for k, _ in got}) == 4
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-9
    assert learn.grouped_logistic(df, splits.limit(0), ["a"]).count() == 0


def test_rows_of_many_folds_are_shuffled_once(spark, monkeypatch):
    """With weights too large to broadcast, a round's join reads rows that lie by fold already; weights are the same."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, int(y), float(x)) for k in range(40) for y, x in zip(rng.integers(0, 2, 30), rng.normal(size=30), strict=True)], "k int, y int, x0 double")
    before = {r.k: r.w for r in learn.newton_weights(df, ["k"], 1).df.collect()}
    asked = []
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: asked.append(a) or repartition(self, *a))
    monkeypatch.setattr(learn, "MANY_WEIGHTS", 1, raising=False)
    monkeypatch.setattr(learn, "TASK_FOLDS", 8, raising=False)
    after = {r.k: r.w for r in learn.newton_weights(df, ["k"], 1).df.collect()}
    assert asked == [(5, "k")]
    assert set(after) == set(before) and all(after[k] == pytest.approx(before[k], rel=1e-9, abs=1e-12) for k in before)


def test_newton_in_purged_folds(spark, bars):
    rows = bars.where("close IS NOT NULL AND series_id = 'long'").select("series_id", "pos", "close")
    rows = rows.withColumn("y", (F.pmod(F.hash("pos"), F.lit(2))).cast("int")).withColumn("fwd", F.lit(0.0)).withColumn("n", F.lit(200))
    splits = folds.walk_forward(rows, 3)
    assert learn.grouped_logistic(rows, splits, ["close"]).count() == splits.where("role = 'test'").count()


def brute_neighbours(rows, splits, k):
    """(split, series, pos) -> share of label 1 among the k nearest."""
    data = {(s, p): (x, y) for s, p, y, *x in rows}
    out = {}
    for split, s in {(a, b) for a, b, _, _ in splits}:
        train = [p for a, b, p, r in splits if (a, b, r) == (split, s, "train")]
        for p in [p for a, b, p, r in splits if (a, b, r) == (split, s, "test")]:
            own = data[s, p][0]
            near = sorted((sum((u - v) ** 2 for u, v in zip(own, data[s, q][0], strict=True)), q) for q in train)[:k]
            if near:
                out[split, s, p] = sum(data[s, q][1] for _, q in near) / len(near)
    return out


@pytest.mark.parametrize(("d", "range_rows"), [(1, 1 << 18), (1, 90), (2, 100), (3, 1 << 18)])
def test_neighbours_are_brute_force(spark, d, range_rows):
    """Cells, borders, ties by the hundred, a series of a third of the rows, one of few rows, and features that follow time."""
    rng = np.random.default_rng(d)
    rows = [("long", i, int(rng.integers(0, 2)), *map(float, rng.normal(size=d))) for i in range(260)]
    rows += [("ties", i, int(rng.integers(0, 2)), *map(float, rng.integers(0, 2, d))) for i in range(200)]
    rows += [("time", i, i % 2, *[float(i // 3)] * d) for i in range(150)]
    rows += [("few", i, i % 2, *map(float, rng.normal(size=d))) for i in range(7)]
    splits = [(j, s, i, "test" if lo <= i < lo + 40 else "train") for s, n in (("long", 260), ("ties", 200), ("time", 150), ("few", 7)) for j, lo in enumerate((0, 60, n - 40)) for i in range(n) if i % 13 or lo == 0]
    names = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame(rows, "series_id string, pos long, y int, " + ", ".join(f"{c} double" for c in names))
    s = spark.createDataFrame(splits, "split_id int, series_id string, pos long, role string")
    got = {(r.split_id, r.series_id, r.pos): r.p for r in learn.knn_proba(df, s, names, 5, cell=5, range_rows=range_rows).collect()}
    expected = brute_neighbours(rows, splits, 5)
    assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k]) for k in got)
    assert learn.knn_proba(df.limit(0), s, names).count() == 0


def test_last_position_of_a_long_series_needs_no_join_by_series(spark):
    marks = spark.createDataFrame([(s, 10 * i, i) for s, n in ((0, 60), (1, 5), (None, 40)) for i in range(n)], "series_id long, t long, pos long")
    asks = spark.createDataFrame([(s, t) for s in (0, 1, 2, None) for t in (-1, 0, 7, 40, 41, 390, 595, None)], "series_id long, at long")
    want = axis.first_at_or_after(marks, axis.last_at_or_before(marks, asks, "at"), "at")
    tens = lambda t: F.floor(t / 100)
    got = axis.first_at_or_after(marks, axis.last_at_or_before(marks, asks, "at", tens), "at", tens)
    one = axis.first_at_or_after(marks, asks, "at", tens)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # with the totals of buckets
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want)
    assert key(axis.first_at_or_after(marks, axis.last_at_or_before(marks, asks, "at", tasks=3), "at", tasks=3)) == key(want)
    for rows, many in ((44, {0, None}), (60, {0}), (100, set())):
        long = axis.long_series([marks, asks], rows)
        assert {r[0] for r in marks.where(long).select("series_id").distinct().collect()} == many
        assert marks.where(long).count() + marks.where(~long).count() == marks.count()
