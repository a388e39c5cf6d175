"""Trees of many folds at once against one fold at a time in plain Python."""

import numpy as np
import pytest

from tidefold.operators import trees


def brute_tree(bins, g, h, depth, least, value):
    """A function from a row of bins to the leaf's value: the split of largest gain, ties by feature and bin."""
    best = None
    total = g.sum() ** 2 / h.sum()
    if depth:
        for f in range(bins.shape[1]):
            for b in sorted(set(bins[:, f].tolist())):
                left = bins[:, f] <= b
                if min(left.sum(), (~left).sum()) < least:
                    continue
                gain = round(g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - total, 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, f, b)
    if best is None:
        v = value(g.sum(), h.sum())
        return lambda row: v
    _, f, b = best
    left = bins[:, f] <= b
    low, high = (brute_tree(bins[s], g[s], h[s], depth - 1, least, value) for s in (left, ~left))
    return lambda row: low(row) if row[f] <= b else high(row)


@pytest.fixture(scope="module")
def data(spark):
    """Four folds: one with a third of the rows, one whose labels are one class in training."""
    rng = np.random.default_rng(6)
    rows, splits = [], []
    for s, n in (("long", 160), ("a", 90), ("b", 90), ("one", 60)):
        x = np.round(rng.normal(size=(n, 3)), 1)
        y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int) if s != "one" else np.ones(n, int)
        y = np.where(rng.random(n) < 0.1, 1 - y, y) if s != "one" else y
        rows += [(s, i, int(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, x, strict=True))]
        splits += [(0, s, i, "test" if i % 4 == 1 else "train") for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, pos long, y int, a double, b double, c double")
    sp = spark.createDataFrame(splits, "split_id int, series_id string, pos long, role string")
    own = trees._prepared(df, sp, ["a", "b", "c"], ["split_id", "series_id"], 8).collect()
    return df, sp, own


def folds_of(own):
    for s in sorted({r.series_id for r in own}):
        part = {role: [r for r in own if r.series_id == s and r.role == role] for role in ("train", "test")}
        yield s, *[(np.array([r.bins for r in part[k]]), np.array([r.y for r in part[k]], float), [r.pos for r in part[k]]) for k in ("train", "test")]


def test_one_tree_without_drawing_is_brute_force(data):
    df, sp, own = data
    shape = trees.Shape(trees=1, depth=3, bins=8, features=3, bootstrap=False)
    got = {(r.series_id, r.pos): r.p for r in trees.grouped_forest(df, sp, ["a", "b", "c"], shape=shape).collect()}
    expected = {}
    for s, (bins, y, _), (test, _, pos) in folds_of(own):
        tree = brute_tree(bins, y, np.ones(len(y)), 3, 5, lambda g, h: g / h)
        expected |= {(s, p): tree(r) for p, r in zip(pos, test, strict=True)}
    assert {s for s, _ in expected} == {"long", "a", "b"} and set(got) == set(expected)
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_boosting_is_brute_force(data):
    df, sp, own = data
    shape = trees.Shape(trees=3, depth=2, bins=8, rate=0.3)
    got = {(r.series_id, r.pos): r.p for r in trees.grouped_boosting(df, sp, ["a", "b", "c"], shape=shape).collect()}
    for s, (bins, y, _), (test, _, pos) in folds_of(own):
        score, ahead = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), np.full(len(test), np.log(y.mean() / (1 - y.mean())))
        for _ in range(3):
            p = 1 / (1 + np.exp(-score))
            tree = brute_tree(bins, y - p, p * (1 - p), 2, 5, lambda g, h: g / h)
            score, ahead = (v + 0.3 * np.array([tree(r) for r in x]) for v, x in ((score, bins), (ahead, test)))
        for q, v in zip(pos, ahead, strict=True):
            assert got[s, q] == pytest.approx(1 / (1 + np.exp(-v)), rel=1e-6)


def test_a_drawn_forest_learns_and_agrees_with_itself(data):
    df, sp, _ = data
    shape = trees.Shape(trees=15, depth=4, bins=8, features=2)
    runs = [{(r.series_id, r.pos): (r.p, r.y) for r in trees.grouped_forest(df, sp.repartition(n), ["a", "b", "c"], shape=shape).collect()} for n in (1, 5)]
    assert set(runs[0]) == set(runs[1]) and all(v[0] == pytest.approx(runs[1][k][0]) for k, v in runs[0].items())  # means are added up in any order
    right = [(p > 0.5) == y for p, y in runs[0].values()]
    assert np.mean(right) > 0.8
    assert trees.grouped_forest(df, sp.limit(0), ["a"], shape=shape).count() == 0
