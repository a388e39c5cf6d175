"""The walk over blocks against a look at every bar."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.operators import labels


def brute(close, pos, t1, pt, sl, side, log):
    def ret(q):
        c = close[q]
        if c is None or (log and c < 0):
            return None
        x = c / close[pos]
        return side * ((math.log(x) if x else -math.inf) if log else x - 1)

    for q in range(pos + 1, t1 + 1):
        r = ret(q)
        if r is not None and ((pt and r >= pt) or (sl and r <= -sl)):
            return q, "upper" if pt and r >= pt else "lower", r
    return t1, "vertical", ret(t1)


@pytest.mark.parametrize(("levels", "log", "pt", "sl"), [(0, True, 0.3, 0.4), (1, True, 0.3, 0.4), (2, False, 0.5, 0.2), (3, True, 0.0, 0.6), (4, True, 1.0, 0.0), (5, False, 0.7, 0.7)])
def test_walk_is_brute_force(spark, levels, log, pt, sl):
    """One series has a third of the bars; unknown, zero and negative closes; both sides; events at and far before their ends."""
    rng = np.random.default_rng(levels)
    bars, events, expected = [], [], {}
    for s, n in (("long", 1200), *[(f"s{i}", 240) for i in range(10)]):
        close = [float(x) for x in np.exp(rng.normal(0, 0.02, n).cumsum())]
        for i in rng.integers(0, n, n // 20):
            close[i] = (None, 0.0, -1.0)[int(i) % 3]
        bars += [(s, i, n, c) for i, c in enumerate(close)]
        for pos in set(rng.integers(0, n, n // 8).tolist()):
            t1 = min(n - 1, pos + int(rng.integers(0, n)))
            side = float(rng.choice([-1, 1]))
            events.append((s, pos, t1, side))
            if close[pos] is not None and close[pos] > 0:
                expected[s, pos] = brute(close, pos, t1, pt, sl, side, log)
    axis = spark.createDataFrame(bars, "series_id string, pos long, n long, close double")
    ev = spark.createDataFrame(events, "series_id string, pos long, t1_pos long, side double")
    got = {(r.series_id, r.pos): r for r in labels.triple_barrier(axis, ev, pt, sl, side=True, log_returns=log, levels=levels).collect()}
    assert set(got) == set(expected)
    for k, (q, barrier, r) in expected.items():
        assert (got[k].t1_pos, got[k].barrier) == (q, barrier), k
        assert got[k].ret == (r if r is None or math.isinf(r) else pytest.approx(r))
    assert labels.triple_barrier(axis, ev.limit(0), pt, sl).count() == 0


def test_a_path_of_10000_bars_takes_tens_of_blocks(spark):
    for first, last in ((1, 10_000), (12_345, 22_344), (8, 8), (7, 6), (0, 4095), (511, 513), (1, 100_000)):
        blocks = [tuple(b) for b in spark.range(1).select(labels.covering_blocks(F.lit(first), F.lit(last), 4).alias("b")).first().b]
        covered = sorted(p for level, b in blocks for p in range(b * 8**level, (b + 1) * 8**level))
        assert covered == list(range(first, last + 1)) and len(blocks) <= 14 * 4 + (last - first) // 4096 + 1
