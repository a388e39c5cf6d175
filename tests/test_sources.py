"""Checksums in chunks, cache and notes, and the published shuffle."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidefold import catalog
from tidefold.operators import axis, folds
from tidefold.sources import files


def test_checksums_in_chunks(spark, tmp_path):
    contents = {"empty.bin": b"", "one.bin": b"x", "odd name.bin": bytes(range(256)) * 1021, "edge.bin": b"a" * (1 << 16)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    del contents["empty.bin"]  # Spark does not list it
    expected = {n.replace(" ", "%20"): (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    for chunk in (1000, 1 << 16):
        got = {r.file.replace(" ", "%20"): (r.bytes, r.sha256) for r in files.checksums(spark, str(tmp_path), chunk).collect()}
        assert got == expected
    rows = {r.file: r.sha256 for r in catalog.source_checksums(spark, DATA).collect()}
    assert rows["orders.parquet"] == hashlib.sha256(open(f"{DATA}/orders.parquet", "rb").read()).hexdigest()


def test_cache_and_notes(spark, tmp_path):
    bars = spark.createDataFrame([("a", 1, 2.0), ("b", 2, None)], "series_id string, t int, close double")
    files.save_bars(bars, str(tmp_path / "bars"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "bars")).collect())) == [("a", 1, 2.0), ("b", 2, None)]
    files.save_notes(spark, ["first", "", "third"], str(tmp_path / "notes"))
    assert [r.value for r in spark.read.text(str(tmp_path / "notes")).collect()] == ["first", "", "third"]


def test_published_shuffle_of_many_lengths(spark):
    """Each length has numpy's order, also that of a series with a third of the rows; equal lengths share one."""
    sizes = {"long": 100, "a": 20, "b": 20, "c": 33, "d": 7}
    rows = spark.createDataFrame([(s, p, n) for s, n in sizes.items() for p in range(n)], "series_id string, pos long, n long")
    got = {}
    for r in folds.naive_kfold_permuted(rows, 4, seed=3).where("role = 'test'").collect():
        got.setdefault((r.series_id, r.split_id), set()).add(r.pos)
    for s, n in sizes.items():
        order = np.arange(n)
        np.random.RandomState(3).shuffle(order)
        parts = [set(x.tolist()) for x in np.array_split(order, 4)]
        assert [got[s, i] for i in range(4)] == parts
    assert folds.naive_kfold_permuted(rows.limit(0), 4).count() == 0


def test_look_ups_by_buckets(spark):
    """Empty buckets, ties of time, look-ups before, between, at and after all marks, a series without marks."""
    rng = np.random.default_rng(4)
    marks, asks = [], []
    for s, n, top in (("long", 90, 1000), ("a", 12, 300), ("b", 1, 150)):
        marks += [(s, int(t), p) for p, t in enumerate(sorted(rng.integers(100, top, n).tolist()))]
        asks += [(s, i, int(t)) for i, t in enumerate(rng.integers(0, top + 200, 60).tolist())]
    asks.append(("none", 0, 5))
    m = spark.createDataFrame(marks, "series_id string, t long, pos long")
    a = spark.createDataFrame(asks, "series_id string, k long, at long")
    for width in (1, 7, 64, 5000):
        bucket = lambda t, w=width: F.floor(t / F.lit(w))
        back = {(r.series_id, r.k): r.as_of_pos for r in axis.last_at_or_before(m, a, "at", bucket).collect()}
        ahead = {(r.series_id, r.k): r.t1_pos for r in axis.first_at_or_after(m, a, "at", bucket).collect()}
        for s, k, at in asks:
            own = [(t, p) for x, t, p in marks if x == s]
            assert back[s, k] == max((p for t, p in own if t <= at), default=None)
            assert ahead[s, k] == min((p for t, p in own if t >= at), default=max((p for _, p in own), default=None))
