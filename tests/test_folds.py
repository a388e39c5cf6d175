import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.operators import folds


def rows(spark, n, horizon=0):
    return spark.createDataFrame([(0, i, n, min(i + horizon, n - 1)) for i in range(n)], "series_id int, pos long, n long, t1_pos long")


def marked(spark, positions):
    return spark.createDataFrame([(0, 0, int(p)) for p in positions], "split_id int, series_id int, pos long")


def sets(df, role):
    out = {}
    for r in df.where(F.col("role") == role).collect():
        out.setdefault(r.split_id, set()).add(r.pos)
    return out


def brute_purge(n, t1, test, embargo):
    test = sorted(test)
    segments, start = [], test[0]
    for a, b in zip(test, [*test[1:], None], strict=True):
        if b != a + 1:
            segments.append((start, a))
            start = b
    keep = set(range(n)) - set(test)
    for s, e in segments:
        reach = max(e, max(t1[i] for i in test if s <= i <= e))
        keep -= {i for i in keep if i <= reach and s <= t1[i] or e < i <= e + embargo}
    return keep


def test_exact_membership(spark):
    r = rows(spark, 20, 4)
    kept = {x.pos for x in folds.purge_train(r, marked(spark, range(8, 12))).collect()}
    assert kept == {0, 1, 2, 3, 16, 17, 18, 19}


def test_embargo(spark):
    r = rows(spark, 30)
    test = marked(spark, range(10, 15))
    without = {x.pos for x in folds.purge_train(r, test).collect()}
    with_ = {x.pos for x in folds.purge_train(r, test, folds.embargo_bars(r, embargo_bars=3)).collect()}
    assert without - with_ == {15, 16, 17} and 18 in with_
    with pytest.raises(ValueError):
        folds.embargo_bars(r, embargo_pct=-1)


def test_purge_is_brute_force(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        n = 60
        t1 = [min(n - 1, i + int(rng.integers(0, 9))) for i in range(n)]
        r = spark.createDataFrame([(0, i, n, t1[i]) for i in range(n)], "series_id int, pos long, n long, t1_pos long")
        test = sorted(rng.choice(n, 15, replace=False).tolist())
        got = {x.pos for x in folds.purge_train(r, marked(spark, test), folds.embargo_bars(r, embargo_bars=2)).collect()}
        assert got == brute_purge(n, t1, test, 2)


def test_segments(spark):
    df = spark.createDataFrame([(0, p) for p in (0, 1, 2, 8, 9, 15, 9)], "series_id int, pos long")
    assert sorted((r.seg_start, r.seg_end) for r in folds.contiguous_segments(df, ["series_id"]).collect()) == [(0, 2), (8, 9), (15, 15)]


@pytest.mark.parametrize("k", [2, 5, 14, 20])
def test_group_edges(spark, k):
    n = 122
    assert folds.group_edges(n, k) == np.linspace(0, n, k + 1, dtype=int).tolist()
    got = [r.group_id for r in folds.equal_groups(rows(spark, n), k).orderBy("pos").collect()]
    assert [got.index(g) for g in range(k)] == folds.group_edges(n, k)[:-1]


def test_every_splitter(spark):
    r = rows(spark, 100, 8)
    made = {"purged": (folds.purged_kfold(r, 5, embargo_pct=0.01), 5), "cpcv": (folds.cpcv(r, 5, 2), 10), "naive": (folds.naive_kfold(r, 4), 4), "walk": (folds.walk_forward(r, 4), 4), "numpy": (folds.naive_kfold_permuted(r, 4), 4)}
    for df, k in made.values():
        train, test = sets(df, "train"), sets(df, "test")
        assert set(test) == set(range(k))
        for i in test:
            assert test[i] and not test[i] & train.get(i, set()) and test[i] | train.get(i, set()) <= set(range(100))


def test_cpcv_covers(spark):
    r = rows(spark, 60)
    split = folds.cpcv(r, 6, 2)
    test = sets(split, "test")
    assert len(test) == folds.n_splits(6, 2) == 15 and folds.n_paths(6, 2) == 5
    assert all(sum(p in s for s in test.values()) == 5 for p in range(60))
    values = split.where("role = 'test'").select("split_id", "series_id", "pos", F.col("pos").cast("double").alias("value"))
    paths = {}
    for x in folds.reconstruct_paths(r, values, 6, 2).collect():
        assert x.value == x.pos
        paths.setdefault(x.path_id, []).append(x.pos)
    assert len(paths) == 5 and all(sorted(p) == list(range(60)) for p in paths.values())
    with pytest.raises(Exception, match="cover"):
        folds.reconstruct_paths(r, values.where("pos <> 3"), 6, 2).collect()


def test_no_training_label_sees_the_test(spark):
    r = rows(spark, 50, 6)
    df = folds.purged_kfold(r, 5)
    train, test = sets(df, "train"), sets(df, "test")
    for i, s in test.items():
        reach = min(max(s) + 6, 49)
        assert s == set(range(min(s), max(s) + 1))
        assert not [p for p in train[i] if p <= reach and min(p + 6, 49) >= min(s)]


def test_preview(spark):
    r = rows(spark, 40, 5)
    (x,) = folds.purge_preview(r, marked(spark, range(10, 20)), folds.embargo_bars(r, embargo_bars=2)).collect()
    assert (x.n_test, x.n_train_naive, x.n_train_purged, x.n_dropped) == (10, 30, 20, 10)


def test_bad_input(spark):
    r = rows(spark, 10)
    for call in (lambda: folds.purged_kfold(r, 1), lambda: folds.cpcv(r, 3, 3), lambda: folds.naive_kfold(r, 1), lambda: folds.walk_forward(r, 1), lambda: folds.group_edges(3, 5)):
        with pytest.raises(ValueError):
            call()
