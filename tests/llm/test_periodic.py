"""Periodic runs against a search of all lags."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidefold.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All runs by (start, period): every lag, longest stretches, smallest period first."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(6, 4 * q) and not any(q % p == 0 and a <= s and s + size <= a + b for a, b, p in out):
                out.append((s, size, q))
            i += 1 if i == s else 0
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("settled", [0.01, 0.0, 1.0])
def test_runs_are_brute_force(settled):
    rng = np.random.default_rng(1)
    for _ in range(250):
        texts = []
        for _ in range(rng.integers(1, 4)):
            w = rng.integers(0, rng.integers(1, 5), rng.integers(0, 30)).tolist()
            for _ in range(rng.integers(0, 4)):
                w += (rng.integers(0, 4, rng.integers(1, 9)).tolist() * rng.integers(1, 8))[: rng.integers(1, 60)]
            texts.append(w)
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        expected, at = [], 0
        for w in texts:
            expected += [(s + at, n, q) for s, n, q in brute(w)]
            at += len(w)
        got = periodic.find_runs(np.array(sum(texts, []), np.int64), doc.astype(np.int64), periodic.Shape(settled=settled))
        assert [tuple(r) for r in got.tolist()] == expected


def test_a_long_loop_is_found_in_little_time():
    loop = np.random.default_rng(0).integers(0, 50, 30_000)
    words = np.concatenate([np.arange(1000) + 100, np.tile(loop, 5), loop[:77]])
    got = periodic.find_runs(words.astype(np.int64), np.zeros(len(words), np.int64)).tolist()
    assert got[0] == [1000, 150_077, 30_000] and [1000, 150_077, 30_000] in got
    with pytest.raises(ValueError):
        periodic.find_runs(words, words, periodic.Shape(times=2))


def test_odd_texts(spark):
    texts = [None, "", " \n\t ", "a a a a a", "a a a a a a", "x y " * 9, "a b " * 5000 + "c", " lead a b a b a b a b trail", "tie tie tie tie tie tie", "tie tie tie tie tie tie", "\x0b\x0cz\x1cz " * 7]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, runs int").withColumn("_text", F.lit("clash")).withColumn("n_words", F.lit(0))
    out = periodic.periodic_runs(df, ["doc_id", "_text", "runs"])
    assert out.columns == ["doc_id", "_text", "n_words", "runs", "collapsed"]
    for r in out.collect():
        w = WORD.findall(texts[r.doc_id] or "")
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), brute(w) if len(w) < 500 else [(0, 10_000, 2)], kept(w, brute(w)) if len(w) < 500 else "a b c")
    assert periodic.periodic_runs(df.limit(0), ["doc_id"]).count() == 0
    bad = spark.sql("SELECT CAST(X'FF20FF20FF20FF20FF20FF2061' AS STRING) AS text")
    assert [tuple(x) for x in periodic.periodic_runs(bad, []).select("runs").first()[0]] == [(0, 6, 1)]


def test_query_is_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, DATA).collect()}
    found = 0
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        w, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 2000:
            continue
        runs, r = brute(w), rows[d.doc_id]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert (r.runs_sha256, r.collapsed_sha256) == (sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(kept(w, runs)))
        found += bool(runs)
    assert found > 10 and len(rows) == 200
