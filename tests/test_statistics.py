from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.functions import numeric, stats
from tidefold.operators import audit, learn, metrics
from tidefold.sources import files, generators


def frame(spark, values):
    return spark.createDataFrame([(0, i, None if v is None else float(v)) for i, v in enumerate(values)], "series_id int, pos long, ret double")


def one(df, *aggs):
    return df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()


def test_sharpe_edges(spark):
    assert one(frame(spark, [0.0] * 50), stats.sharpe_ratio("ret"))[0] == 0
    assert one(frame(spark, [0.01] * 50), stats.sharpe_ratio("ret"))[0] is None
    assert one(frame(spark, [0.1] * 50), stats.sharpe_ratio("ret"))[0] is None
    x = 0.001 + 0.01 * np.random.default_rng(0).normal(size=2000)
    got = one(frame(spark, [*x, float("nan"), float("inf"), None]), stats.sharpe_ratio("ret"))[0]
    assert got > 0 and got == pytest.approx(x.mean() / x.std(ddof=1) * np.sqrt(252))
    assert one(frame(spark, []), stats.sharpe_ratio("ret"))[0] is None


def test_deflation(spark):
    x = 0.002 + 0.01 * np.random.default_rng(1).normal(size=800)
    trials = (1, 10, 100, 1000)
    got = list(one(frame(spark, x), *[stats.deflated_sharpe_ratio("ret", n_trials=n) for n in trials], stats.probabilistic_sharpe_ratio("ret")))
    assert got[0] == pytest.approx(got[4]) and got[:4] == sorted(got[:4], reverse=True) and got[0] - got[3] > 0.05
    assert numeric.expected_max_sr(1, 0.1) == 0 < numeric.expected_max_sr(5, 0.1) < numeric.expected_max_sr(50, 0.1)
    with pytest.raises(ValueError):
        numeric.expected_max_sr(5, -1)
    y = 0.01 + 0.005 * np.random.default_rng(2).normal(size=400)
    assert one(frame(spark, y), stats.probabilistic_sharpe_ratio("ret"))[0] > 0.95


def test_norm_cdf(spark):
    xs = np.linspace(-9, 9, 181).tolist() + [-40.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numeric.norm_cdf("x").alias("p"))
    assert all(abs(r.p - NormalDist().cdf(r.x)) < 1e-12 for r in df.collect())


def test_drawdown_turnover_ic(spark):
    assert metrics.max_drawdown(frame(spark, [0.1, -0.5, 0.2, -0.1]), ["series_id"]).first().max_drawdown == pytest.approx(-0.5)
    assert metrics.max_drawdown(frame(spark, [-0.5]), ["series_id"]).first().max_drawdown == 0
    assert metrics.turnover(frame(spark, [1, 1, -1, -1, 1]), ["series_id"], "ret").first().turnover == 1.0
    df = spark.createDataFrame([(0, float(i), float(i), float(-i)) for i in range(20)], "series_id int, a double, b double, c double")
    assert metrics.information_coefficient(df, ["series_id"], "a", "b").first().ic > 0.99
    assert metrics.information_coefficient(df, ["series_id"], "a", "c").first().ic < -0.99


def test_classification(spark):
    df = spark.createDataFrame([(0, int(t), int(p)) for t, p in zip("000111", "001110", strict=True)], "k int, y_true int, y_pred int")
    assert df.agg(stats.f1_binary("y_true", "y_pred")).first()[0] == pytest.approx(2 / 3)
    assert metrics.matthews(df, ["k"]).first().mcc == pytest.approx(1 / 3)
    assert metrics.balanced_accuracy(df, ["k"]).first().balanced_accuracy == pytest.approx(2 / 3)


def test_auc_is_pairwise(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 6, 60)
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, s, strict=True)], "k int, y_true int, score double")
    d = s[y == 1][:, None] - s[y == 0][None, :]
    assert metrics.roc_auc(df, ["k"]).first().auc == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())
    assert metrics.roc_auc(df.where("y_true = 1"), ["k"]).first().auc is None


def audit_rows(spark, n, horizon, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    leak = [*y[1:], y[-2]]
    return spark.createDataFrame([(0, i, n, min(i + horizon, n - 1), float(leak[i]), float(rng.normal()), int(y[i])) for i in range(n)], "series_id int, pos long, n long, t1_pos long, x_leak double, noise double, y int")


def test_audit(spark):
    r = audit.audit_leakage(audit_rows(spark, 200, 5), ["x_leak", "noise"]).first()
    assert r.future_columns == ["x_leak"] and r.score > 0 and "x_leak" in audit.report(r)
    point, wide = (audit.adjacent_overlap(audit_rows(spark, 100, h)).first() for h in (0, 20))
    assert wide.fraction > point.fraction and wide.median_lifetime >= 10
    future = generators.future_column(spark)
    r = audit.audit_leakage(future, ["lag1", "noise", "x_leak"]).first()
    assert (round(r.score, 9), r.future_columns, r.median_lifetime) == (0.55, ["x_leak"], 30.0)
    late = audit_rows(spark, 30, 2).withColumn("label_start", F.col("pos"))
    r = audit.audit_leakage(late, ["noise"], feature_times={"f": F.col("pos") + 3}).first()
    assert r.future_columns == ["f"]
    double = spark.createDataFrame([(0, t) for t in (0, 1, 1, 2)], "series_id int, t long")
    assert audit.duplicate_times(double).first().hazard == "duplicate_index_on_X"


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    p = np.array([r.p for r in learn.make_model("Logistic").fit(df, ["a", "b"]).predict_proba(df).collect()])
    z = (x - x.mean(0)) / x.std(0)
    w = learn.newton_logistic(z, y)
    assert np.abs(p - 1 / (1 + np.exp(-(z @ w[:2] + w[2])))).max() < 1e-5
    assert learn.make_model("xgboost").fallback_from == "xgboost"
    with pytest.raises(ImportError):
        learn.make_model("lstm")
    with pytest.raises(ValueError):
        learn.make_model("other")


def test_price_files(spark, tmp_path):
    bars = spark.createDataFrame([("2020-01-02", 1.0, 2.0), ("2020-01-03", 1.5, 2.5)], "date string, close double, adj_close double")
    bars.write.parquet(str(tmp_path / "AA.parquet"))
    bars.drop("adj_close").write.csv(str(tmp_path / "B-C.csv"), header=True)
    got = sorted((r.series_id, str(r.t), r.close) for r in files.load_prices(spark, str(tmp_path), ["AA", "B/C", "NONE"]).collect())
    assert got == [("AA", "2020-01-02", 2.0), ("AA", "2020-01-03", 2.5), ("B/C", "2020-01-02", 1.0), ("B/C", "2020-01-03", 1.5)]
    assert files.load_prices(spark, str(tmp_path), ["NONE"]) is None
    text = tmp_path / "f.txt"
    text.write_bytes("Café preamble\n,Mkt,SMB\n20200102, 1.5, -0.5, 0.1, 0.01\n20200103, x, 1, 2, 3\n\nCopyright\n".encode("latin-1"))
    rows = [tuple(r) for r in files.load_factors(spark, str(text)).collect()]
    assert [str(r[0]) for r in rows] == ["2020-01-02", "2020-01-03"] and rows[0][1:] == pytest.approx((0.015, -0.005, 0.001, 0.0001)) and rows[1][1] is None
    out = audit.audit_leakage(generators.future_column(spark, 50), ["x_leak"])
    files.save_csv(out, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).first().future_columns == "x_leak"
    assert files.checksums(spark, str(text)).first().bytes == text.stat().st_size


def test_boosted_fit_has_tasks_by_rows(spark, monkeypatch):
    """A boosted fit has hundreds of passes: few rows in many partitions must not be a task each in every pass."""
    seen = []

    class Fit:
        def fit(self, train):
            seen.append((train.rdd.getNumPartitions(), train.count()))

    monkeypatch.setattr(learn.Classifier, "estimator", lambda self, n: Fit())
    monkeypatch.setattr(learn, "TASK_ROWS", 100)
    df = spark.range(0, 1000, 1, 50).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    learn.make_model("gbm").fit(df, ["x"])
    assert seen == [(10, 1000)]
