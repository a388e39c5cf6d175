import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.operators import axis, labels


def make(spark, closes, series=0):
    return axis.with_positions(spark.createDataFrame([(series, i, float(c)) for i, c in enumerate(closes)], "series_id int, t long, close double"))


def events(spark, pairs, sides=None):
    if sides is None:
        return spark.createDataFrame([(0, a, b) for a, b in pairs], "series_id int, pos long, t1_pos long")
    return spark.createDataFrame([(0, a, b, float(s)) for (a, b), s in zip(pairs, sides, strict=True)], "series_id int, pos long, t1_pos long, side double")


def test_fixed_horizon(spark):
    a = make(spark, [100, 110, 121, 133.1])
    log = [r.fwd for r in labels.fixed_horizon_returns(a, 1).orderBy("pos").collect()]
    simple = [r.fwd for r in labels.fixed_horizon_returns(a, 1, kind="simple").orderBy("pos").collect()]
    assert log[0] == pytest.approx(math.log(1.1)) and simple[0] == pytest.approx(0.1)
    assert log[-1] is None
    with pytest.raises(ValueError):
        labels.fixed_horizon_returns(a, 0)
    with pytest.raises(ValueError):
        labels.fixed_horizon_returns(a, 1, kind="other")


@pytest.mark.parametrize(("end", "barrier", "sign"), [(130, "upper", 1), (70, "lower", -1)])
def test_trend_touches_one_side(spark, end, barrier, sign):
    a = make(spark, np.linspace(100, end, 16))
    own = labels.vertical_barrier(a, 10).where("pos < 5")
    rows = labels.triple_barrier(a, own, 0.1, 0.1).collect()
    assert len(rows) == 5 and all(r.barrier == barrier and r.bin == sign and r.t1_pos > r.pos for r in rows)


def test_quiet_path_is_vertical(spark):
    a = make(spark, 100 + 0.5 * np.sin(np.linspace(0, 6, 30)))
    rows = labels.triple_barrier(a, labels.vertical_barrier(a, 5).where("pos < 8"), 0.5, 0.5).collect()
    assert len(rows) == 8 and {r.barrier for r in rows} == {"vertical"} and {r.bin for r in rows} <= {-1, 0, 1}


def test_constructed_paths(spark):
    (up,) = labels.triple_barrier(make(spark, [100, 105, 110, 120, 90, 80]), events(spark, [(0, 5)]), 0.12, 0.12).collect()
    assert (up.barrier, up.bin, up.t1_pos) == ("upper", 1, 3)
    (down,) = labels.triple_barrier(make(spark, [100, 95, 85, 120]), events(spark, [(0, 3)]), 0.12, 0.10).collect()
    assert (down.barrier, down.bin, down.t1_pos) == ("lower", -1, 2)


def test_meta_label(spark):
    a = make(spark, [100, 101, 102, 111, 112])
    for side, expected in ((1, 1), (-1, 0)):
        sides = spark.createDataFrame([(0, 0, float(side))], "series_id int, pos long, side double")
        (r,) = labels.meta_label(a, events(spark, [(0, 4)]), sides, 0.08, 0.08).collect()
        assert r.bin == expected


def brute(close, pos, end, pt, sl, min_ret, side):
    up = down = None
    path = [side * math.log(close[q] / close[pos]) for q in range(pos, end + 1)]
    for q in range(pos + 1, end + 1):
        r = path[q - pos]
        up = q if up is None and pt > 0 and r >= pt else up
        down = q if down is None and sl > 0 and r <= -sl else down
    first = min(x for x in (up, down, end) if x is not None)
    kind = "upper" if up == first and up != down else "lower" if down == first and up != down else "vertical"
    r = path[first - pos]
    return kind, first, 1 if kind == "upper" else -1 if kind == "lower" else 0 if abs(r) < min_ret else int(np.sign(r))


def test_triple_barrier_is_brute_force(spark):
    rng = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 200)))
    pairs = [(i, min(199, i + int(rng.integers(0, 40)))) for i in range(0, 199, 3)]
    got = {r.pos: (r.barrier, r.t1_pos, r.bin) for r in labels.triple_barrier(make(spark, close), events(spark, pairs), 0.08, 0.05, min_ret=0.01, levels=1).collect()}
    assert got == {p: brute(close, p, e, 0.08, 0.05, 0.01, 1) for p, e in pairs}


def test_bad_input(spark):
    a = make(spark, [100, 101, 102])
    with pytest.raises(ValueError):
        labels.triple_barrier(a, events(spark, [(0, 2)]), -1, 0.1)
    with pytest.raises(Exception, match="t1 precedes"):
        labels.triple_barrier(a, events(spark, [(2, 1)]), 0.1, 0.1).collect()
    with pytest.raises(Exception, match="side must be"):
        labels.triple_barrier(a, events(spark, [(0, 1)], [2]), 0.1, 0.1, side=True).collect()
    with pytest.raises(Exception, match="not on the axis"):
        labels.triple_barrier(a, events(spark, [(0, 3)]), 0.1, 0.1).collect()
    twice = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0)], "series_id int, t long, close double")
    for slice_of in (None, F.col("t") % 2):
        with pytest.raises(Exception, match="several rows"):
            axis.with_positions(twice, slice_of=slice_of).collect()


def test_zero_and_unknown_prices(spark):
    a = make(spark, [100, 0, 100, float("nan"), 100])
    got = {r.pos: (r.barrier, r.bin) for r in labels.triple_barrier(a, events(spark, [(0, 2), (1, 2), (2, 4)]), 0.1, 0.1).collect()}
    assert got == {0: ("lower", -1), 2: ("vertical", 0)}


def test_label_ends(spark):
    a = make(spark, [1, 2, 3, 4])
    ends = spark.createDataFrame([(0, i, t) for i, t in enumerate([1, 2, 9, 9])], "series_id int, pos long, t1 long")
    assert [r.t1_pos for r in axis.resolve_label_ends(a, ends).orderBy("pos").collect()] == [1, 2, 3, 3]
    assert [r.t1_pos for r in axis.resolve_label_ends(a, None).orderBy("pos").collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="missing"):
        axis.resolve_label_ends(a, ends.where("pos > 0")).collect()
