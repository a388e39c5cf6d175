"""The deep forest against a plain recursion over the same draws, with large nodes and without."""

import numpy as np
import pytest

from tidefold.operators import forest, trees


def grow(bins, y, w, node, tree, shape, few, level=0):
    h, g = w.sum(), (w * y).sum()
    best = None
    for f in forest.lots(shape.seed, tree, np.array([node]), bins.shape[1], few)[0].tolist() if level < shape.depth else []:
        for b in range(shape.bins):
            left = bins[:, f] <= b
            hl, gl = w[left].sum(), (w * y)[left].sum()
            if min(hl, h - hl) >= shape.least:
                gain = round(gl * gl / hl + (g - gl) ** 2 / (h - hl) - g * g / h, 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, f, b)
    if best is None:
        return lambda row: g / h
    _, f, b = best
    left = bins[:, f] <= b
    low, high = (grow(bins[s], y[s], w[s], 2 * node + k, tree, shape, few, level + 1) for k, s in enumerate((left, ~left)))
    return lambda row: low(row) if row[f] <= b else high(row)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(500, 4)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) ^ (rng.random(500) < 0.1)).astype(int)
    data = [(f"s{i % 7}", i, int(v), i % 4 == 1, *map(float, r)) for i, (v, r) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(data, "series_id string, pos long, y int, late boolean, a double, b double, c double, d double")


@pytest.mark.parametrize("small", [10_000, 60, 5])
def test_every_node_is_split_as_by_recursion(spark, rows, small):
    shape = trees.Shape(trees=5, depth=6, bins=8, least=3)
    got = {r.pos: (r.p, r.y) for r in forest.deep_forest(rows, "late", list("abcd"), ["series_id", "pos", "y"], shape, small).collect()}
    own = rows.selectExpr("*", f"xxhash64({shape.seed}, series_id, pos) AS h").toPandas()
    names = rows.where("NOT late").selectExpr(*[f"{c} AS x{j}" for j, c in enumerate("abcd")])
    cut = trees.bin_edges(names, [], 4, 8).first()[0]
    bins = np.stack([np.searchsorted(e, own[c]) for e, c in zip(cut, "abcd", strict=True)], axis=1)
    late = own.late.to_numpy()
    parts = []
    for t in range(5):
        w = forest.drawn(own.h.to_numpy(), t, True)
        on = ~late & (w > 0)
        tree = grow(bins[on], own.y.to_numpy()[on], w[on].astype(float), 1, t, shape, 2)
        parts.append([tree(r) for r in bins[late]])
    expected = dict(zip(own.pos[late].tolist(), np.mean(parts, axis=0), strict=True))
    assert set(got) == set(expected) and all(got[k][0] == pytest.approx(v) for k, v in expected.items())
    assert np.mean([(p > 0.5) == y for p, y in got.values()]) > 0.8


def test_no_training_rows_and_none_at_all(rows):
    shape = trees.Shape(trees=2, depth=3, bins=8)
    one = forest.deep_forest(rows.where("late"), "late", list("abcd"), ["pos"], shape).collect()
    assert len(one) == 125 and all(r.p is None for r in one)
    assert forest.deep_forest(rows.limit(0), "late", ["a"], ["pos"], shape).count() == 0


def test_forest_model_scores_every_late_row(spark):
    import __spark_entry__ as e

    out = e.queries()["forest_model"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and out.p.between(0, 1).all()
