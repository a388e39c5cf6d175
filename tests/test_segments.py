"""Segments from groups, and counts from end points, against every row of every split."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.operators import folds


@pytest.fixture(scope="module")
def rows(spark):
    """Six series, one with a third of the rows; some labels are long, a few end before their row."""
    rng = np.random.default_rng(8)
    out = []
    for s, n in (("long", 120), *[(f"s{i}", 48) for i in range(4)], ("odd", 60)):
        for p in range(n):
            t1 = min(n - 1, p + int(rng.integers(0, 6 if p % 9 else 25)))
            out.append((s, p, n, max(0, p - 9) if s == "odd" and p % 4 == 0 else t1))
    return spark.createDataFrame(out, "series_id string, pos long, n long, t1_pos long").cache()


def counted(rows, test, embargo):
    """(split, series) -> (samples, tested, trained on), row by row."""
    n = Counter(r.series_id for r in rows.collect())
    roles = Counter((r.split_id, r.series_id, r.role) for r in folds.judged(rows, test, embargo).collect())
    return {(i, s): (n[s], roles[i, s, "test"], roles[i, s, "train"]) for i, s, _ in roles}


@pytest.mark.parametrize(("seed", "embargo"), [(0, 0), (1, 3), (2, 40)])
def test_counts_are_those_of_rows(spark, rows, seed, embargo):
    rng = np.random.default_rng(seed)
    test = []
    for i in range(5):
        for s, n in {(r.series_id, r.n) for r in rows.collect()}:
            for _ in range(rng.integers(1, 5)):
                a = int(rng.integers(0, n))
                test += [(i, s, p) for p in range(a, min(n, a + int(rng.integers(1, 12))))]
    test = spark.createDataFrame(test, "split_id int, series_id string, pos long")
    e = folds.embargo_bars(rows, embargo_bars=embargo)
    for bucket in (1, 5, 64):
        got = {(r.split_id, r.series_id): (r.n_samples, r.n_test, r.n_train_purged) for r in folds.counted_by(rows, folds.info_segments(rows, test, e), bucket).collect()}
        assert got == counted(rows, test, e)


@pytest.mark.parametrize(("groups", "tested"), [(2, 1), (6, 2), (7, 3), (5, 4)])
def test_groups_are_as_their_rows(spark, rows, groups, tested):
    """Splits, and their preview, from one row per group equal those from all test rows."""
    assigned = folds.path_assignment(spark, groups, tested).select("split_id", "group_id")
    test = folds.equal_groups(rows, groups).join(assigned, "group_id").select("split_id", "series_id", "pos")
    e = folds.embargo_bars(rows, embargo_pct=0.05)
    key = lambda df: sorted(map(tuple, df.collect()))
    segments = ["split_id", "series_id", "seg_start", "seg_end", "info_end", "embargo"]
    assert key(folds.group_segments(rows, assigned, groups, e).select(*segments)) == key(folds.info_segments(rows, test, e).select(*segments))
    assert key(folds.cpcv(rows, groups, tested, embargo_pct=0.05)) == key(folds.judged(rows, test, e).where("role IS NOT NULL"))
    assert key(folds.cpcv_preview(rows, groups, tested, embargo_pct=0.05)) == key(folds.purge_preview(rows, test, e))
    assert key(folds.purged_kfold(rows, groups)) == key(folds.judged(rows, folds.equal_groups(rows, groups).select(F.col("group_id").alias("split_id"), "series_id", "pos")).where("role IS NOT NULL"))


def test_runs_across_slices(spark, monkeypatch):
    """Runs that span many slices, end at their borders or are single rows."""
    from tidefold.operators import slices

    monkeypatch.setattr(folds, "SLICE", 4)
    assert slices.SLICE > 4
    rng = np.random.default_rng(3)
    held = {k: sorted(set(rng.integers(0, 90, 70).tolist()) | set(range(20, 45))) for k in range(3)}
    df = spark.createDataFrame([(k, p) for k, ps in held.items() for p in ps + ps[:5]], "series_id int, pos long")
    expected = []
    for k, ps in held.items():
        for p in ps:
            if p - 1 in ps:
                expected[-1] = (k, expected[-1][1], p)
            else:
                expected.append((k, p, p))
    assert sorted(map(tuple, folds.contiguous_segments(df, ["series_id"]).collect())) == sorted(expected)
    reach = {(r.series_id, r.seg_start): r.m for r in folds.contiguous_segments(df.distinct(), ["series_id"], {"m": F.col("pos") * 2}).collect()}
    assert reach == {(k, a): 2 * b for k, a, b in expected}


def test_groups_as_bits(spark):
    """Splits by bits equal those by segments, also with labels that end early, or far, and rows that are missing; no segments are collected."""
    rng = np.random.default_rng(3)
    data = [(k, i, n, int(max(0, min(n - 1, i + rng.integers(-20, 25))))) for k, n in enumerate((12, 40, 61)) for i in range(n) if k < 2 or not 20 <= i < 31]
    rows = spark.createDataFrame(data, "series_id int, pos long, n long, t1_pos long")
    for groups, tested, how in ((6, 2, {"embargo_bars": 3}), (7, 4, {})):
        assigned = folds.path_assignment(spark, groups, tested).select("split_id", "group_id")
        want = folds.judged_by(rows, folds.group_segments(rows, assigned, groups, folds.embargo_bars(rows, **how))).where("role IS NOT NULL")
        got = folds.cpcv(rows, groups, tested, **how)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "collect_list" not in got._jdf.queryExecution().toString()
