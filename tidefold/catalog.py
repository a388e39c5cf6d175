"""Registered queries over the test tables, and the SQL that checks them.

Bars are the positive values of `events`, one series per user in order of ts.
Float results are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import stats
from .functions.numeric import norm_cdf, norm_cdf_sql, rounded, trial_quantile
from .operators import audit, axis, features, folds, forest, labels, learn, metrics, slices, trees
from .operators.store import stored
from .plans import scoring
from .sources import files, generators

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, event_id, close, pos, n)."""
    e = _table(spark, sf_dir, "events").where("value > 0")
    return axis.with_positions(e.select(F.col("user_id").alias("series_id"), F.col("ts").alias("t"), "event_id", F.col("value").alias("close")), ("t", "event_id"))


def _rows(spark: SparkSession, sf_dir: str, horizon: int = 5) -> DataFrame:
    """(series_id, pos, n, t1_pos) of all bars."""
    return labels.t1_from_horizon(_bars(spark, sf_dir), horizon)


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, pos, ret): simple returns on a scale that keeps wealth positive."""
    b = _bars(spark, sf_dir)
    return b.select("series_id", "pos", ((F.col("close") - 245) / 5000).alias("ret"))


BARS = "bars AS (SELECT user_id AS series_id, ts AS t, event_id, value AS close, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > 0)"
ROWS = f"{BARS}, lab AS (SELECT series_id, pos, n, least(pos + 5, n - 1) AS t1_pos FROM bars)"
RETURNS = f"{BARS}, ret AS (SELECT series_id, pos, (close - 245) / 5000 AS r FROM bars)"
R6 = lambda x: f"round({x}, 6) + 0.0"


# --- labels ---------------------------------------------------------------

FWD = "WITH " + BARS + " SELECT series_id, pos, {} AS fwd FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)"


@query(FWD.format(R6("ln(lead(close, 5) OVER w) - ln(close)")))
def fixed_horizon_log(spark, sf_dir):
    return labels.fixed_horizon_returns(_bars(spark, sf_dir), 5).select("series_id", "pos", rounded("fwd").alias("fwd"))


@query(FWD.format(R6("lead(close, 5) OVER w / close - 1")))
def fixed_horizon_simple(spark, sf_dir):
    return labels.fixed_horizon_returns(_bars(spark, sf_dir), 5, kind="simple").select("series_id", "pos", rounded("fwd").alias("fwd"))


@query(f"WITH {BARS} SELECT a.series_id, a.pos, b.pos AS t1_pos, b.t AS t1 FROM bars a JOIN bars b ON b.series_id = a.series_id AND b.pos = least(a.pos + 7, a.n - 1) WHERE a.pos < a.n - 1")
def vertical_barrier(spark, sf_dir):
    return labels.vertical_barrier(_bars(spark, sf_dir), 7).select("series_id", "pos", "t1_pos", "t1")


@query(f"WITH {ROWS} SELECT series_id, pos, t1_pos FROM lab")
def t1_from_horizon(spark, sf_dir):
    return _rows(spark, sf_dir).select("series_id", "pos", "t1_pos")


@query(f"WITH {ROWS} SELECT series_id, pos, t1_pos - pos AS lifetime FROM lab")
def label_lifetime(spark, sf_dir):
    return labels.label_lifetime(_rows(spark, sf_dir)).select("series_id", "pos", "lifetime")


def _barrier_sql(pt: float, sl: float, min_ret: float, horizon: int, side: str, log: bool) -> str:
    ret = "ln(b.close / e.p0)" if log else "(b.close / e.p0 - 1)"
    label = "CASE WHEN raw > 0 THEN 1 ELSE 0 END" if side != "1.0" else "raw"
    return f"""
WITH {BARS}, ev AS (
  SELECT series_id, pos, least(pos + {horizon}, n - 1) AS t1_pos, close AS p0, {side} AS side FROM bars WHERE pos < n - 1
), p AS (
  SELECT e.series_id, e.pos, e.t1_pos, b.pos AS q, e.side * {ret} AS r
  FROM ev e JOIN bars b ON b.series_id = e.series_id AND b.pos BETWEEN e.pos AND e.t1_pos
), h AS (
  SELECT series_id, pos, t1_pos, min(q) FILTER (q > pos AND r >= {pt}) AS up, min(q) FILTER (q > pos AND r <= -{sl}) AS dn FROM p GROUP BY ALL
), t AS (
  SELECT *, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 'upper' WHEN dn IS NOT NULL AND (up IS NULL OR dn < up) THEN 'lower' ELSE 'vertical' END AS barrier,
         least(coalesce(up, t1_pos), coalesce(dn, t1_pos)) AS q FROM h
), o AS (
  SELECT t.series_id, t.pos, t.q AS t1_pos, p.r AS ret, barrier,
         CASE barrier WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE CASE WHEN abs(p.r) < {min_ret} THEN 0 ELSE sign(p.r) END END AS raw
  FROM t JOIN p ON p.series_id = t.series_id AND p.pos = t.pos AND p.q = t.q
)
SELECT series_id, pos, t1_pos, {R6("ret")} AS ret, ({label})::INTEGER AS bin, barrier FROM o"""


def _events(bars: DataFrame, horizon: int) -> DataFrame:
    return labels.vertical_barrier(bars, horizon).select("series_id", "pos", "t1_pos")


@query(_barrier_sql(0.8, 0.6, 0.1, 9, "1.0", True))
def triple_barrier(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return labels.triple_barrier(b, _events(b, 9), 0.8, 0.6, min_ret=0.1).withColumn("ret", rounded("ret"))


@query(_barrier_sql(1.0, 0.5, 0.0, 9, "1.0", False))
def triple_barrier_simple(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return labels.triple_barrier(b, _events(b, 9), 1.0, 0.5, log_returns=False).withColumn("ret", rounded("ret"))


@query(_barrier_sql(0.8, 0.6, 0.0, 9, "CASE WHEN close > 245 THEN -1.0 ELSE 1.0 END", True))
def meta_label(spark, sf_dir):
    b = _bars(spark, sf_dir)
    sides = b.select("series_id", "pos", F.when(F.col("close") > 245, -1.0).otherwise(1.0).alias("side"))
    return labels.meta_label(b, _events(b, 9), sides, 0.8, 0.6).withColumn("ret", rounded("ret"))


# --- axis -----------------------------------------------------------------


@query(f"WITH {BARS}, l AS (SELECT user_id AS series_id, event_id, ts + INTERVAL 1 DAY AS t1 FROM events WHERE value > 0) SELECT l.series_id, l.event_id, coalesce(min(b.pos) FILTER (b.t >= l.t1), max(b.pos)) AS t1_pos FROM l JOIN bars b USING (series_id) GROUP BY ALL")
def forward_as_of(spark, sf_dir):
    b = _bars(spark, sf_dir)
    asks = b.select("series_id", "event_id", (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("t1"))
    return axis.first_at_or_after(b.select("series_id", "t", "pos"), asks).select("series_id", "event_id", "t1_pos")


@query(f"WITH {BARS}, l AS (SELECT user_id AS series_id, event_id, ts - INTERVAL 1 DAY AS t0 FROM events WHERE value > 0) SELECT l.series_id, l.event_id, max(b.pos) FILTER (b.t <= l.t0) AS as_of_pos FROM l JOIN bars b USING (series_id) GROUP BY ALL")
def backward_as_of(spark, sf_dir):
    b = _bars(spark, sf_dir)
    asks = b.select("series_id", "event_id", (F.col("t") - F.expr("INTERVAL 1 DAY")).alias("t0"))
    return axis.last_at_or_before(b.select("series_id", "t", "pos"), asks, "t0").select("series_id", "event_id", "as_of_pos")


@query(f"WITH {BARS} SELECT series_id, event_id, pos, n FROM bars")
def positions_by_slices(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("value > 0")
    e = e.select(F.col("user_id").alias("series_id"), F.col("ts").alias("t"), "event_id")
    return axis.with_positions(e, ("t", "event_id"), F.date_trunc("month", "t")).select("series_id", "event_id", "pos", "n")


# --- features -------------------------------------------------------------

FEATURES = f"""
{BARS}, q AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY series_id ORDER BY pos)) AS ret FROM bars),
feat AS (
  SELECT series_id, pos, n, close, ret, ret AS ret_lag1, lag(ret, 1) OVER w AS ret_lag2, lag(ret, 4) OVER w AS ret_lag5,
         CASE WHEN count(ret) OVER w5 = 5 THEN stddev_samp(ret) OVER w5 END AS rv_5,
         CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS rv_20,
         ln(close) - ln(lag(close, 10) OVER w) AS mom_10, ln(close) - ln(lag(close, 20) OVER w) AS mom_20,
         close / CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END - 1 AS dev_ma20,
         ln(lead(close, 10) OVER w) - ln(close) AS fwd
  FROM q WINDOW w AS (PARTITION BY series_id ORDER BY pos), w5 AS (PARTITION BY series_id ORDER BY pos ROWS 4 PRECEDING), w20 AS (PARTITION BY series_id ORDER BY pos ROWS 19 PRECEDING)
)"""
ALIGNED = f"""
{FEATURES}, kept AS (
  SELECT *, pos AS old, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS new, count(*) OVER (PARTITION BY series_id) AS m FROM feat
  WHERE fwd IS NOT NULL AND ret_lag1 IS NOT NULL AND ret_lag2 IS NOT NULL AND ret_lag5 IS NOT NULL AND rv_5 IS NOT NULL AND rv_20 IS NOT NULL AND mom_10 IS NOT NULL AND mom_20 IS NOT NULL AND dev_ma20 IS NOT NULL
), al AS (
  SELECT k.series_id, k.new AS pos, k.m AS n, k.ret_lag1, k.mom_10, CASE WHEN k.fwd > 0 THEN 1 ELSE 0 END AS y, k.fwd, coalesce(e.new, k.m - 1) AS t1_pos
  FROM kept k LEFT JOIN kept e ON e.series_id = k.series_id AND e.old = least(k.old + 10, k.n - 1)
)"""


@query(f"WITH {FEATURES} SELECT series_id, pos, " + ", ".join(f"{R6(f)} AS {f}" for f in features.FEATURES) + " FROM feat")
def causal_features(spark, sf_dir):
    df = features.causal_features(features.with_log_return(_bars(spark, sf_dir)))
    return df.select("series_id", "pos", *[rounded(f).alias(f) for f in features.FEATURES])


def _aligned(spark, sf_dir):
    df = features.causal_features(features.with_log_return(_bars(spark, sf_dir)))
    return features.align_xy(labels.fixed_horizon_returns(df, 10), horizon=10)


@query(f"WITH {ALIGNED} SELECT series_id, pos, n, y, {R6('fwd')} AS fwd, t1_pos FROM al")
def align_xy(spark, sf_dir):
    return _aligned(spark, sf_dir).select("series_id", "pos", "n", "y", rounded("fwd").alias("fwd"), "t1_pos")


@query(f"WITH {BARS} SELECT series_id, count(*) AS bars FROM bars GROUP BY series_id HAVING count(*) >= 60")
def long_series(spark, sf_dir):
    return features.long_enough(_bars(spark, sf_dir), 60).groupBy("series_id").agg(F.count("*").alias("bars"))


# --- splits ---------------------------------------------------------------


def _group_sql(k: int, n: str = "n", pos: str = "pos") -> str:
    return "(" + " + ".join(f"CASE WHEN floor({i}::DOUBLE * ({n} / {k}::DOUBLE)) <= {pos} THEN 1 ELSE 0 END" for i in range(1, k)) + ")"


def _purge_sql(test: str, embargo: str) -> str:
    """Training rows for a CTE te(split_id, series_id, pos), given an embargo expression over lab."""
    return f"""
{ROWS}, te AS ({test}), isl AS (
  SELECT te.split_id, te.series_id, te.pos, lab.t1_pos, te.pos - row_number() OVER (PARTITION BY te.split_id, te.series_id ORDER BY te.pos) AS g FROM te JOIN lab USING (series_id, pos)
), emb AS (SELECT series_id, {embargo} AS e FROM lab GROUP BY series_id), seg AS (
  SELECT split_id, series_id, min(pos) AS s, max(pos) AS z, greatest(max(pos), max(t1_pos)) AS info FROM isl GROUP BY split_id, series_id, g
), tr AS (
  SELECT k.split_id, lab.series_id, lab.pos FROM lab JOIN (SELECT DISTINCT split_id, series_id FROM te) k USING (series_id)
  WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.split_id = k.split_id AND te.series_id = lab.series_id AND te.pos = lab.pos)
    AND NOT EXISTS (SELECT 1 FROM seg JOIN emb USING (series_id) WHERE seg.split_id = k.split_id AND seg.series_id = lab.series_id
                    AND ((lab.pos <= info AND s <= lab.t1_pos) OR lab.pos BETWEEN z + 1 AND z + e))
)"""


KFOLD_TEST = f"SELECT {_group_sql(5)} AS split_id, series_id, pos FROM lab"
CPCV_ASSIGN = "asg AS (SELECT split_id, unnest([a, b]) AS group_id FROM (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS split_id FROM range(6) x(a), range(6) z(b) WHERE a < b))"


@query(f"WITH {BARS} SELECT series_id, pos, {_group_sql(7)} AS group_id FROM bars")
def equal_groups(spark, sf_dir):
    return folds.equal_groups(_bars(spark, sf_dir), 7).select("series_id", "pos", "group_id")


SEGMENTS = f"WITH {BARS}, h AS (SELECT series_id, pos, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS g FROM bars WHERE close > 150) SELECT series_id, min(pos) AS seg_start, max(pos) AS seg_end FROM h GROUP BY series_id, g"


@query(SEGMENTS)
def contiguous_segments(spark, sf_dir):
    return folds.contiguous_segments(_bars(spark, sf_dir).where("close > 150"), ["series_id"])


@query(f"WITH {ROWS} SELECT series_id, floor(count(*) * 0.05)::BIGINT AS by_share, ceil(0.7 * median(greatest(t1_pos - pos, 0)))::BIGINT AS by_lifetime, 3::BIGINT AS by_bars FROM lab GROUP BY series_id")
def embargo_spec(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    each = {"by_share": {"embargo_pct": 0.05}, "by_lifetime": {"embargo_lifetime_frac": 0.7}, "by_bars": {"embargo_bars": 3}}
    out = None
    for name, how in each.items():
        part = folds.embargo_bars(rows, **how).withColumnRenamed("embargo", name)
        out = part if out is None else out.join(part, "series_id")
    return out


SCATTERED = "SELECT 0 AS split_id, series_id, pos FROM lab WHERE pos % 17 BETWEEN 3 AND 6"


def _scattered(rows):
    return rows.where("pos % 17 BETWEEN 3 AND 6").select(F.lit(0).alias("split_id"), "series_id", "pos")


@query(f"WITH {_purge_sql(SCATTERED, 'any_value(2)')} SELECT * FROM tr")
def purge_train(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return folds.purge_train(rows, _scattered(rows), folds.embargo_bars(rows, embargo_bars=2))


ROLES = "SELECT split_id, series_id, pos, 'train' AS role FROM tr UNION ALL SELECT split_id, series_id, pos, 'test' FROM te"


@query(f"WITH {_purge_sql(KFOLD_TEST, 'floor(count(*) * 0.1)')} {ROLES}")
def purged_kfold(spark, sf_dir):
    return folds.purged_kfold(_rows(spark, sf_dir), 5, embargo_pct=0.1)


CPCV_TEST = f"SELECT split_id, series_id, pos FROM (SELECT *, {_group_sql(6)} AS group_id FROM lab) JOIN asg USING (group_id)"


@query(f"WITH {CPCV_ASSIGN}, {_purge_sql(CPCV_TEST, 'floor(count(*) * 0.02)')} {ROLES}")
def cpcv_splits(spark, sf_dir):
    return folds.cpcv(_rows(spark, sf_dir), 6, 2, embargo_pct=0.02)


ROLE_COUNTS = f"{CPCV_ASSIGN}, sizes AS (SELECT split_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY split_id) - 1 AS path_id FROM asg)"


@query(f"WITH {BARS}, {ROLE_COUNTS} SELECT split_id, group_id, path_id, count(*) AS n_rows FROM (SELECT {_group_sql(6)} AS group_id FROM bars) JOIN sizes USING (group_id) GROUP BY ALL")
def cpcv_path_assignment(spark, sf_dir):
    groups = folds.equal_groups(_bars(spark, sf_dir), 6).groupBy("group_id").agg(F.count("*").alias("n_rows"))
    return folds.path_assignment(spark, 6, 2).join(groups, "group_id").select("split_id", "group_id", "path_id", "n_rows")


@query(f"WITH {BARS}, {ROLE_COUNTS} SELECT path_id, series_id, pos, {R6('close * (split_id + 1)')} AS value FROM (SELECT *, {_group_sql(6)} AS group_id FROM bars) JOIN sizes USING (group_id)")
def cpcv_reconstruct(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    assigned = folds.path_assignment(spark, 6, 2).select("split_id", "group_id")
    made = folds.equal_groups(bars, 6).join(F.broadcast(assigned), "group_id").select("split_id", "series_id", "pos", (F.col("close") * (F.col("split_id") + 1)).alias("value"))
    return folds.reconstruct_paths(bars, made, 6, 2).withColumn("value", rounded("value"))


@query(f"""WITH {BARS}, s AS (SELECT series_id, pos, n, unnest(range(4)) AS split_id FROM bars), b AS (SELECT *, n - (4 - split_id) * (n // 5) AS start, n // 5 AS size FROM s)
SELECT split_id, series_id, pos, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role FROM b WHERE (pos < start AND pos >= start - 30) OR (pos >= start AND pos < start + size)""")
def walk_forward(spark, sf_dir):
    return folds.walk_forward(_bars(spark, sf_dir), 4, max_train_size=30)


@query(f"""WITH {BARS}, o AS (SELECT series_id, pos, n, row_number() OVER (PARTITION BY series_id ORDER BY md5('42:' || pos), pos) - 1 AS place FROM bars),
f AS (SELECT *, CASE WHEN place < (n % 5) * (n // 5 + 1) THEN place // (n // 5 + 1) ELSE n % 5 + (place - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS fold FROM o)
SELECT k AS split_id, series_id, pos, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS role FROM f, range(5) t(k)""")
def naive_kfold(spark, sf_dir):
    return folds.naive_kfold(_bars(spark, sf_dir), 5)


@query(f"""WITH {_purge_sql(KFOLD_TEST, 'any_value(4)')}, a AS (SELECT split_id, series_id, count(*) AS n_test FROM te GROUP BY ALL), b AS (SELECT split_id, series_id, count(*) AS c FROM tr GROUP BY ALL), m AS (SELECT series_id, count(*) AS n_samples FROM lab GROUP BY ALL)
SELECT split_id, series_id, n_samples, n_test, n_samples - n_test AS n_train_naive, coalesce(c, 0) AS n_train_purged, n_samples - n_test - coalesce(c, 0) AS n_dropped FROM a JOIN m USING (series_id) LEFT JOIN b USING (split_id, series_id)""")
def purge_preview(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    test = rows.select(folds.group_of(5).alias("split_id"), "series_id", "pos")
    return folds.purge_preview(rows, test, folds.embargo_bars(rows, embargo_bars=4))


@query(f"""WITH {_purge_sql(KFOLD_TEST, 'any_value(0)')}, a AS (SELECT split_id, series_id, count(*) AS n_test FROM te GROUP BY ALL), b AS (SELECT split_id, series_id, count(*) AS c FROM tr GROUP BY ALL), m AS (SELECT series_id, count(*) AS n FROM lab GROUP BY ALL)
SELECT split_id, series_id, {R6('(n - n_test - coalesce(c, 0))::DOUBLE / (n - n_test)')} AS overlap FROM a JOIN m USING (series_id) LEFT JOIN b USING (split_id, series_id)""")
def split_overlap(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    test = rows.select(folds.group_of(5).alias("split_id"), "series_id", "pos")
    return folds.overlap_fraction(rows, test).withColumn("overlap", rounded("overlap"))


# --- statistics -----------------------------------------------------------

MOMENTS = f"""{RETURNS}, mo AS (
  SELECT series_id, count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sd, min(r) = max(r) AS flat,
         (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * avg(r) ^ 3) / var_pop(r) ^ 1.5 AS g3,
         (avg(r ^ 4) - 4 * avg(r) * avg(r ^ 3) + 6 * avg(r) ^ 2 * avg(r * r) - 3 * avg(r) ^ 4) / var_pop(r) ^ 2 AS g4 FROM ret GROUP BY series_id
), z AS (SELECT series_id, n, mu / sd AS sr, g3, g4, greatest(1 - g3 * mu / sd + (g4 - 1) / 4 * (mu / sd) ^ 2, 1e-12) AS inner_ FROM mo WHERE n >= 3 AND NOT flat)"""


def _by_series(spark, sf_dir):
    return _returns(spark, sf_dir).groupBy("series_id")


@query(f"WITH {MOMENTS} SELECT series_id, {R6('sr * sqrt(252)')} AS sharpe, {R6('inner_ / (n - 1)')} AS sr_variance FROM z")
def sharpe_by_series(spark, sf_dir):
    return _by_series(spark, sf_dir).agg(rounded(stats.sharpe_ratio("ret")).alias("sharpe"), rounded(stats.sharpe_variance("ret")).alias("sr_variance"))


@query(f"WITH {RETURNS} SELECT count(*) AS n, {R6('(avg(r) - 0.001) / stddev_samp(r) * sqrt(12)')} AS sharpe FROM ret")
def sharpe(spark, sf_dir):
    return _returns(spark, sf_dir).agg(F.count("*").alias("n"), rounded(stats.sharpe_ratio("ret", periods_per_year=12, risk_free=0.001)).alias("sharpe"))


@query(f"WITH {MOMENTS} SELECT series_id, {R6('g3')} AS skew, {R6('g4')} AS kurtosis FROM z")
def skew_kurtosis(spark, sf_dir):
    return _by_series(spark, sf_dir).agg(rounded(stats.skew("ret")).alias("skew"), rounded(stats.pearson_kurtosis("ret")).alias("kurtosis"))


PSR_Z = "(sr * sqrt(n - 1) / sqrt(inner_))"
DSR_Z = f"({PSR_Z} - {trial_quantile(20)!r})"


@query(f"WITH {MOMENTS}, y AS (SELECT series_id, {PSR_Z} AS v FROM z) SELECT series_id, {R6('v')} AS psr_z, {R6(norm_cdf_sql('v'))} AS psr FROM y")
def psr(spark, sf_dir):
    return _by_series(spark, sf_dir).agg(rounded(stats.psr_z("ret")).alias("psr_z"), rounded(stats.probabilistic_sharpe_ratio("ret")).alias("psr"))


@query(f"WITH {MOMENTS}, y AS (SELECT series_id, {DSR_Z} AS v FROM z) SELECT series_id, {R6('v')} AS dsr_z, {R6(norm_cdf_sql('v'))} AS dsr FROM y")
def dsr(spark, sf_dir):
    return _by_series(spark, sf_dir).agg(rounded(stats.dsr_z("ret", n_trials=20)).alias("dsr_z"), rounded(stats.deflated_sharpe_ratio("ret", n_trials=20)).alias("dsr"))


@query(f"WITH v AS (SELECT event_id, value / 100 - 2.5 AS x FROM events) SELECT event_id, {R6(norm_cdf_sql('x'))} AS phi FROM v")
def normal_cdf(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", rounded(norm_cdf(F.col("value") / 100 - 2.5)).alias("phi"))


AVG_RANK = "rank() OVER (PARTITION BY series_id ORDER BY {0}) + (count(*) OVER (PARTITION BY series_id, {0}) - 1) / 2.0"
PAIRS = f"{BARS}, pr AS (SELECT series_id, floor(close / 25) AS a, floor(lead(close) OVER (PARTITION BY series_id ORDER BY pos) / 25) AS b FROM bars), kn AS (SELECT * FROM pr WHERE b IS NOT NULL)"


@query(f"WITH {PAIRS}, rk AS (SELECT series_id, {AVG_RANK.format('a')} AS ra, {AVG_RANK.format('b')} AS rb FROM kn) SELECT series_id, CASE WHEN count(*) >= 3 THEN {R6('corr(ra, rb)')} END AS ic FROM rk GROUP BY series_id")
def ic_spearman(spark, sf_dir):
    b = _bars(spark, sf_dir)
    df = b.select("series_id", F.floor(F.col("close") / 25).alias("y_pred"), F.floor(F.lead("close").over(Window.partitionBy("series_id").orderBy("pos")) / 25).alias("y_true"))
    return metrics.information_coefficient(df, ["series_id"]).withColumn("ic", rounded("ic"))


CLASSES = "j AS (SELECT lang AS series_id, quality AS y, toxic AS p, n_chars AS s FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


def _classes(spark, sf_dir):
    df = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return df.where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("lang").alias("series_id"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"), F.col("n_chars").alias("score"))


@query(f"WITH {CLASSES}, r AS (SELECT series_id, y, {AVG_RANK.format('s')} AS k FROM j) SELECT series_id, {R6('(sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y <> 1), 0)')} AS auc FROM r GROUP BY series_id")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_classes(spark, sf_dir), ["series_id"]).withColumn("auc", rounded("auc"))


CONFUSION = f"{CLASSES}, c AS (SELECT series_id, sum(y * p)::DOUBLE AS tp, sum((1 - y) * p)::DOUBLE AS fp, sum(y * (1 - p))::DOUBLE AS fn, sum((1 - y) * (1 - p))::DOUBLE AS tn FROM j GROUP BY series_id)"


@query(f"""WITH {CONFUSION} SELECT series_id, {R6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1,
{R6('coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)')} AS mcc,
{R6('CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn) ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END')} AS balanced_accuracy FROM c""")
def classification(spark, sf_dir):
    df = _classes(spark, sf_dir)
    out = df.groupBy("series_id").agg(rounded(stats.f1_binary("y_true", "y_pred")).alias("f1"))
    out = out.join(metrics.matthews(df, ["series_id"]), "series_id").join(metrics.balanced_accuracy(df, ["series_id"]), "series_id")
    return out.select("series_id", "f1", rounded("mcc").alias("mcc"), rounded("balanced_accuracy").alias("balanced_accuracy"))


@query(f"WITH {BARS}, p AS (SELECT series_id, CASE WHEN close > 245 THEN 1.0 ELSE -1.0 END AS x, pos FROM bars), d AS (SELECT series_id, abs(x - lag(x) OVER (PARTITION BY series_id ORDER BY pos)) AS s FROM p) SELECT series_id, {R6('avg(s)')} AS turnover FROM d GROUP BY series_id")
def turnover(spark, sf_dir):
    df = _bars(spark, sf_dir).withColumn("position", F.when(F.col("close") > 245, 1.0).otherwise(-1.0))
    return metrics.turnover(df, ["series_id"]).withColumn("turnover", rounded("turnover"))


DRAWDOWN = "SELECT series_id, pos, product(1 + r) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS v FROM ret"


@query(f"WITH {RETURNS}, w AS ({DRAWDOWN}), d AS (SELECT series_id, v / greatest(max(v) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 1e-16) - 1 AS f FROM w) SELECT series_id, {R6('min(f)')} AS max_drawdown FROM d GROUP BY series_id")
def max_drawdown(spark, sf_dir):
    return metrics.max_drawdown(_returns(spark, sf_dir), ["series_id"]).withColumn("max_drawdown", rounded("max_drawdown"))


# --- long series ----------------------------------------------------------

#: Orders as bars, of which a third is one series.
LONG_BARS = "bars AS (SELECT series_id, t, o_orderkey, close, row_number() OVER (PARTITION BY series_id ORDER BY t, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS series_id, o_orderdate AS t, o_orderkey, o_totalprice / 1000 AS close FROM orders WHERE o_totalprice > 0))"
SLICE_ROWS = 1024


def _long_bars(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").where("o_totalprice > 0")
    o = o.select(F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")).cast("long").alias("series_id"), F.col("o_orderdate").alias("t"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("close"))
    return axis.with_positions(o, ("t", "o_orderkey"), F.date_trunc("month", "t"))


@query(f"""WITH {LONG_BARS} SELECT series_id, pos, {R6('sum(close / 997) OVER w')} AS total, {R6('product(1 + (close - 150) / 50000) OVER w')} AS wealth, {R6('max(close) OVER w')} AS peak,
{R6('last_value(CASE WHEN close > 300 THEN close END IGNORE NULLS) OVER w')} AS last_high FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def scan_by_slices(spark, sf_dir):
    c = F.col("close")
    scans = {"total": ("sum", c / 997), "wealth": ("product", 1 + (c - 150) / 50000), "peak": ("max", c), "last_high": ("last", F.when(c > 300, c))}
    df = slices.prefix_scan(_long_bars(spark, sf_dir), scans, ["series_id"], rows=SLICE_ROWS)
    return df.select("series_id", "pos", *[rounded(x).alias(x) for x in scans])


LONG_FEATURES = FEATURES.replace(BARS, LONG_BARS)


def _long_features(spark, sf_dir):
    df = features.causal_features(features.with_log_return(_long_bars(spark, sf_dir), SLICE_ROWS), slice_rows=SLICE_ROWS)
    return labels.fixed_horizon_returns(df, 10, slice_rows=SLICE_ROWS)


@query(f"WITH {LONG_FEATURES} SELECT series_id, pos, " + ", ".join(f"{R6(f)} AS {f}" for f in (*features.FEATURES, "fwd")) + " FROM feat")
def features_by_slices(spark, sf_dir):
    return _long_features(spark, sf_dir).select("series_id", "pos", *[rounded(f).alias(f) for f in (*features.FEATURES, "fwd")])


@query(f"WITH {ALIGNED.replace(BARS, LONG_BARS)} SELECT series_id, pos, n, y, {R6('fwd')} AS fwd, t1_pos FROM al")
def align_by_slices(spark, sf_dir):
    return features.align_xy(_long_features(spark, sf_dir), horizon=10, slice_rows=SLICE_ROWS).select("series_id", "pos", "n", "y", rounded("fwd").alias("fwd"), "t1_pos")


@query(f"WITH {LONG_BARS} SELECT a.series_id, a.pos, b.pos AS t1_pos, b.t AS t1 FROM bars a JOIN bars b ON b.series_id = a.series_id AND b.pos = least(a.pos + 30, a.n - 1) WHERE a.pos < a.n - 1")
def vertical_barrier_long(spark, sf_dir):
    return labels.vertical_barrier(_long_bars(spark, sf_dir), 30, by_join=True).select("series_id", "pos", "t1_pos", "t1")


LONG_HORIZON = 3000


@query(f"""WITH {LONG_BARS}, ev AS (SELECT series_id, pos, least(pos + {LONG_HORIZON}, n - 1) AS t1_pos, close AS p0 FROM bars WHERE pos < n - 1 AND pos % 5 = 0),
h AS (SELECT e.series_id, e.pos, e.t1_pos, p0, min(b.pos) AS q FROM ev e LEFT JOIN bars b ON b.series_id = e.series_id AND b.pos > e.pos AND b.pos <= e.t1_pos AND (ln(b.close / p0) >= 1.2 OR ln(b.close / p0) <= -3.5) GROUP BY ALL),
o AS (SELECT h.series_id, h.pos, coalesce(q, t1_pos) AS t1_pos, ln(b.close / p0) AS ret, CASE WHEN q IS NULL THEN 'vertical' WHEN ln(b.close / p0) > 0 THEN 'upper' ELSE 'lower' END AS barrier FROM h JOIN bars b ON b.series_id = h.series_id AND b.pos = coalesce(q, t1_pos))
SELECT series_id, pos, t1_pos, {R6('ret')} AS ret, sign(ret)::INTEGER AS bin, barrier FROM o""")
def triple_barrier_long(spark, sf_dir):
    """Paths of up to 3,000 bars, by blocks of 8 to 4,096."""
    b = _long_bars(spark, sf_dir)
    events = labels.t1_from_horizon(b, LONG_HORIZON).where((F.col("pos") < F.col("n") - 1) & (F.col("pos") % 5 == 0)).select("series_id", "pos", "t1_pos")
    return labels.triple_barrier(b, events, 1.2, 3.5, levels=4).withColumn("ret", rounded("ret"))


@query(f"""WITH {LONG_BARS}, w AS (SELECT series_id, pos, CASE WHEN close > 150 THEN 1.0 ELSE -1.0 END AS x, product(1 + (close - 150) / 5000) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS v FROM bars),
d AS (SELECT series_id, abs(x - lag(x) OVER (PARTITION BY series_id ORDER BY pos)) AS s, v / greatest(max(v) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 1e-16) - 1 AS f FROM w)
SELECT series_id, {R6('avg(s)')} AS turnover, {R6('min(f)')} AS max_drawdown FROM d GROUP BY series_id""")
def drawdown_by_slices(spark, sf_dir):
    df = _long_bars(spark, sf_dir).select("series_id", "pos", F.when(F.col("close") > 150, 1.0).otherwise(-1.0).alias("position"), ((F.col("close") - 150) / 5000).alias("ret"))
    out = metrics.turnover(df, ["series_id"], slice_rows=SLICE_ROWS).join(metrics.max_drawdown(df, ["series_id"], slice_rows=SLICE_ROWS), "series_id")
    return out.select("series_id", rounded("turnover").alias("turnover"), rounded("max_drawdown").alias("max_drawdown"))


#: Line items of which a third is one group.
GROUPED = "g AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS series_id, l_extendedprice AS p, floor(l_quantity / 7) AS q, l_discount AS d, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"


def _grouped(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey")).cast("long").alias("series_id"),
        F.col("l_extendedprice").alias("p"), F.floor(F.col("l_quantity") / 7).alias("q"), F.col("l_discount").alias("d"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
    )


@query(f"WITH {GROUPED} SELECT series_id, p, count(*) AS n, {R6('any_value(r)')} AS rank FROM (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY p) + (count(*) OVER (PARTITION BY series_id, p) - 1) / 2.0 AS r FROM g) GROUP BY series_id, p")
def rank_by_ranges(spark, sf_dir):
    return slices.value_ranks(_grouped(spark, sf_dir), ["series_id"], "p", 32).select("series_id", "p", "n", rounded("rank").alias("rank"))


WHOLE_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
AUC_OF_RANKS = "(sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y <> 1), 0)"


@query(f"""WITH {GROUPED}, r AS (SELECT series_id, y, {AVG_RANK.format('p')} AS k, {AVG_RANK.format('p')} AS a, {AVG_RANK.format('q')} AS b FROM g), w AS (SELECT y, {WHOLE_RANK.format('d')} AS k, {WHOLE_RANK.format('p')} AS a, {WHOLE_RANK.format('q')} AS b FROM g)
SELECT series_id, {R6(AUC_OF_RANKS)} AS auc, CASE WHEN count(*) >= 3 THEN {R6('corr(a, b)')} END AS ic FROM r GROUP BY series_id UNION ALL SELECT NULL, {R6(AUC_OF_RANKS)}, {R6('corr(a, b)')} FROM w""")
def auc_by_ranges(spark, sf_dir):
    """AUC and information coefficient of each group, and (null) of the whole table as one."""
    g = _grouped(spark, sf_dir)
    own = slices.auc_by_ranges(g, ["series_id"], "y", "p").join(slices.ic_by_ranges(g, ["series_id"], "p", "q"), "series_id")
    whole = slices.auc_by_ranges(g, [], "y", "d").crossJoin(slices.ic_by_ranges(g, [], "p", "q"))  # one row each
    out = own.unionByName(whole.select(F.lit(None).cast("long").alias("series_id"), "auc", "ic"))
    return out.select("series_id", rounded("auc").alias("auc"), rounded("ic").alias("ic"))


ASKED = f"{LONG_BARS}, asks AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS series_id, l_orderkey, l_linenumber, l_shipdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""WITH {ASKED}, l AS (SELECT series_id, t, max(pos) AS hi, min(pos) AS lo FROM bars GROUP BY ALL), z AS (SELECT series_id, max(pos) AS top FROM bars GROUP BY ALL),
b AS (SELECT a.*, l.hi AS as_of_pos FROM asks a ASOF LEFT JOIN l ON a.series_id = l.series_id AND a.at >= l.t),
f AS (SELECT b.*, l.lo AS nxt FROM b ASOF LEFT JOIN l ON b.series_id = l.series_id AND b.at <= l.t)
SELECT f.series_id, l_orderkey, l_linenumber, as_of_pos, coalesce(nxt, top) AS t1_pos FROM f LEFT JOIN z USING (series_id)""")
def as_of_by_buckets(spark, sf_dir):
    """For each line item, the last order of its series up to its shipment and the first one from then on; long series by days."""
    marks = stored(_long_bars(spark, sf_dir).select("series_id", "t", "pos"), "marks").df
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")).cast("long").alias("series_id"))
    asks = _table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("series_id", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at"))
    asks = stored(asks, "asks").df
    tasks = 1 + (marks.count() + asks.count()) // (1 << 20)

    def found(marks, asks, bucket):
        return axis.first_at_or_after(marks, axis.last_at_or_before(marks, asks, "at", bucket, tasks), "at", bucket, tasks)

    long = axis.long_series([marks, asks])
    whole = found(marks.where(~long), asks.where(~long), None)
    out = whole.unionByName(found(marks.where(long), asks.where(long), lambda t: F.date_trunc("day", t)))
    return out.select("series_id", "l_orderkey", "l_linenumber", "as_of_pos", "t1_pos")


@query()
def naive_kfold_published(spark, sf_dir):
    """Shuffled folds in numpy's order, one order for each length of a series."""
    return folds.naive_kfold_permuted(_bars(spark, sf_dir), 5)


LONG_ROWS = ROWS.replace(BARS, LONG_BARS).replace("FROM bars)", "FROM bars WHERE n >= 6)")
LONG_CPCV = _purge_sql(CPCV_TEST, "floor(count(*) * 0.02)").replace(ROWS, LONG_ROWS)


def _long_rows(spark, sf_dir):
    return labels.t1_from_horizon(_long_bars(spark, sf_dir).where("n >= 6"), 5)


@query(f"WITH {CPCV_ASSIGN}, {LONG_CPCV} {ROLES}")
def cpcv_long(spark, sf_dir):
    return folds.cpcv(_long_rows(spark, sf_dir), 6, 2, embargo_pct=0.02)


@query(f"""WITH {CPCV_ASSIGN}, {LONG_CPCV}, a AS (SELECT split_id, series_id, count(*) AS n_test FROM te GROUP BY ALL), b AS (SELECT split_id, series_id, count(*) AS c FROM tr GROUP BY ALL), m AS (SELECT series_id, count(*) AS n_samples FROM lab GROUP BY ALL)
SELECT split_id, series_id, n_samples, n_test, n_samples - n_test AS n_train_naive, coalesce(c, 0) AS n_train_purged, n_samples - n_test - coalesce(c, 0) AS n_dropped FROM a JOIN m USING (series_id) LEFT JOIN b USING (split_id, series_id)""")
def cpcv_preview(spark, sf_dir):
    return folds.cpcv_preview(_long_rows(spark, sf_dir), 6, 2, embargo_pct=0.02)


# --- audit ----------------------------------------------------------------


@query(f"WITH {ROWS} SELECT series_id, count(*) FILTER (pos < n - 1 AND t1_pos >= pos + 1) AS n_overlaps, {R6('coalesce(count(*) FILTER (pos < n - 1 AND t1_pos >= pos + 1)::DOUBLE / nullif(count(*) FILTER (pos < n - 1), 0), 0)')} AS fraction, median(greatest(t1_pos - pos, 0)) AS median_lifetime FROM lab GROUP BY series_id")
def adjacent_overlap(spark, sf_dir):
    return audit.adjacent_overlap(_rows(spark, sf_dir)).withColumn("fraction", rounded("fraction"))


@query("WITH d AS (SELECT user_id AS series_id, ts::DATE AS t, count(*) AS c FROM events GROUP BY ALL HAVING count(*) > 1) SELECT series_id, 'duplicate_index:daily' AS hazard, sum(c - 1)::BIGINT AS n_duplicates FROM d GROUP BY series_id")
def duplicate_hazard(spark, sf_dir):
    daily = _table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.to_date("ts").alias("t"))
    return audit.merge_hazards({"daily": daily})


TIMES = f"{BARS}, ft AS (SELECT series_id, t AS label_start, t + CASE WHEN close > 400 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS f, t - INTERVAL 1 HOUR AS g FROM bars)"


@query(f"WITH {TIMES} SELECT series_id, 'f' AS feature, count(*) FILTER (f > label_start) > 0 AS late, {R6('avg(CASE WHEN f > label_start THEN 1.0 ELSE 0.0 END)')} AS late_share FROM ft GROUP BY series_id UNION ALL SELECT series_id, 'g', count(*) FILTER (g > label_start) > 0, {R6('avg(CASE WHEN g > label_start THEN 1.0 ELSE 0.0 END)')} FROM ft GROUP BY series_id")
def feature_time_flag(spark, sf_dir):
    b = _bars(spark, sf_dir).withColumn("label_start", F.col("t"))
    late = F.when(F.col("close") > 400, F.col("t") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("t"))
    return audit.late_features(b, {"f": late, "g": F.col("t") - F.expr("INTERVAL 1 HOUR")}).withColumn("late_share", rounded("late_share"))


CORR = f"""{BARS}, fc AS (SELECT series_id, close AS x_now, lead(close) OVER w AS x_next, CASE WHEN close > 245 THEN 1.0 ELSE 0.0 END AS y, lead(CASE WHEN close > 245 THEN 1.0 ELSE 0.0 END) OVER w AS y1 FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos))"""


def _corr_sql(x: str) -> str:
    c = lambda y: R6(f"CASE WHEN count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) >= 10 THEN coalesce(CASE WHEN NOT isnan(corr({x}, {y})) THEN corr({x}, {y}) END, 0) ELSE 0 END")
    return f"SELECT series_id, '{x}' AS feature, {c('y1')} AS corr_next, {c('y')} AS corr_now FROM fc GROUP BY series_id"


@query(f"WITH {CORR} {_corr_sql('x_now')} UNION ALL {_corr_sql('x_next')}")
def future_corr(spark, sf_dir):
    df = _audit_rows(spark, sf_dir)
    return audit.future_correlations(df, ["x_now", "x_next"]).select("series_id", "feature", rounded("corr_next").alias("corr_next"), rounded("corr_now").alias("corr_now"))


def _audit_rows(spark, sf_dir):
    b = _bars(spark, sf_dir).withColumn("t1_pos", F.least(F.col("pos") + 5, F.col("n") - 1))
    ahead = F.lead("close").over(Window.partitionBy("series_id").orderBy("pos"))
    return b.withColumn("x_now", F.col("close")).withColumn("x_next", ahead).withColumn("y", F.when(F.col("close") > 245, 1.0).otherwise(0.0))


@query(f"""WITH {CORR}, co AS ({_corr_sql('x_now')} UNION ALL {_corr_sql('x_next')}), fl AS (SELECT series_id, list_sort(list(feature)) AS cols FROM co WHERE abs(corr_next) >= 0.75 OR abs(corr_now) >= 0.75 GROUP BY series_id),
ad AS (SELECT series_id, coalesce(count(*) FILTER (pos < n - 1 AND least(pos + 5, n - 1) >= pos + 1)::DOUBLE / nullif(count(*) FILTER (pos < n - 1), 0), 0) AS a FROM bars GROUP BY series_id)
SELECT series_id, {R6('least(1, 0.4 * a + least(0.4, 0.15 * coalesce(len(cols), 0)))')} AS score, coalesce(array_to_string(cols, '|'), '') AS future_columns FROM ad LEFT JOIN fl USING (series_id)""")
def leakage_score(spark, sf_dir):
    found = audit.audit_leakage(_audit_rows(spark, sf_dir), ["x_now", "x_next"])
    return found.select("series_id", rounded("score").alias("score"), F.array_join("future_columns", "|").alias("future_columns"))


@query(f"""WITH {_purge_sql(SCATTERED, 'any_value(0)')}{CORR.removeprefix(BARS)}{TIMES.removeprefix(BARS)}, co AS ({_corr_sql('x_now')} UNION ALL {_corr_sql('x_next')}),
fl AS (SELECT series_id, feature FROM co WHERE abs(corr_next) >= 0.75 OR abs(corr_now) >= 0.75 UNION SELECT series_id, 'f' FROM ft WHERE f > label_start),
fn AS (SELECT series_id, count(*) AS cols FROM fl GROUP BY series_id),
ad AS (SELECT series_id, count(*) AS n_rows, coalesce(count(*) FILTER (pos < n - 1 AND t1_pos >= pos + 1)::DOUBLE / nullif(count(*) FILTER (pos < n - 1), 0), 0) AS a FROM lab GROUP BY series_id),
ov AS (SELECT series_id, n_rows - te_n AS free, te_n, tr_n FROM ad JOIN (SELECT series_id, count(*) AS te_n FROM te GROUP BY series_id) USING (series_id) LEFT JOIN (SELECT series_id, count(*) AS tr_n FROM tr GROUP BY series_id) USING (series_id)),
hz AS (SELECT series_id, count(*) AS hazards FROM (SELECT DISTINCT series_id FROM (SELECT user_id AS series_id, ts::DATE AS t, count(*) AS c FROM events GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT DISTINCT series_id FROM (SELECT series_id, t, count(*) AS c FROM bars GROUP BY ALL HAVING count(*) > 1)) GROUP BY series_id),
o2 AS (SELECT series_id, a, coalesce((free - coalesce(tr_n, 0))::DOUBLE / nullif(free, 0), 0) AS split, coalesce(cols, 0) AS cols, coalesce(hazards, 0) AS hazards FROM ad LEFT JOIN ov USING (series_id) LEFT JOIN fn USING (series_id) LEFT JOIN hz USING (series_id))
SELECT series_id, {R6('least(1, 0.4 * a + 0.3 * split + least(0.4, 0.15 * cols) + least(0.2, 0.1 * hazards))')} AS score, {R6('split')} AS split_overlap_fraction, cols::INTEGER AS n_columns, hazards::INTEGER AS n_hazards FROM o2""")
def leakage_terms(spark, sf_dir):
    """The audit with all its terms: a test set, times of features and merged tables."""
    rows = _audit_rows(spark, sf_dir).withColumn("label_start", F.col("t"))
    late = F.when(F.col("close") > 400, F.col("t") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("t"))
    daily = _table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.to_date("ts").alias("t"))
    found = audit.audit_leakage(rows, ["x_now", "x_next"], test=_scattered(rows), feature_times={"f": late}, merges={"daily": daily})
    return found.select("series_id", rounded("score").alias("score"), rounded("split_overlap_fraction").alias("split_overlap_fraction"), F.size("future_columns").alias("n_columns"), F.size("hazards").alias("n_hazards"))


# --- models and protocols -------------------------------------------------

KNN = f"""WITH {_purge_sql(KFOLD_TEST, 'any_value(0)')}, lb AS (SELECT series_id, pos, close AS x, CASE WHEN lead(close) OVER (PARTITION BY series_id ORDER BY pos) > close THEN 1 ELSE 0 END AS y FROM bars),
pr AS (SELECT te.split_id, te.series_id, te.pos, a.y, b.y AS yn, row_number() OVER (PARTITION BY te.split_id, te.series_id, te.pos ORDER BY (a.x - b.x) * (a.x - b.x), tr.pos) AS k
       FROM te JOIN lb a USING (series_id, pos) JOIN tr ON tr.split_id = te.split_id AND tr.series_id = te.series_id JOIN lb b ON b.series_id = tr.series_id AND b.pos = tr.pos)
SELECT split_id, series_id, pos, y, {R6('avg(yn)')} AS p FROM pr WHERE k <= 11 GROUP BY split_id, series_id, pos, y"""


@query(KNN)
def knn_proba(spark, sf_dir):
    b = _bars(spark, sf_dir)
    up = F.when(F.lead("close").over(Window.partitionBy("series_id").orderBy("pos")) > F.col("close"), 1).otherwise(0)
    rows = b.select("series_id", "pos", "n", F.col("close").alias("x"), up.alias("y"), F.least(F.col("pos") + 5, F.col("n") - 1).alias("t1_pos"))
    return learn.knn_proba(rows, folds.purged_kfold(rows, 5), ["x"]).withColumn("p", rounded("p"))


def _scored(spark, sf_dir):
    """Predictions by a rule, on the equal groups of the aligned rows, so that SQL can follow."""
    rows = _aligned(spark, sf_dir)
    p = 0.5 - 0.4 * F.col("mom_10") / (1 + F.abs("mom_10"))
    return rows.where("n >= 20").select(folds.group_of(4).alias("split_id"), "series_id", "pos", "y", "fwd", p.alias("p"))


SCORED = f"{ALIGNED}, sc AS (SELECT {_group_sql(4)} AS split_id, series_id, pos, y, fwd, 0.5 - 0.4 * mom_10 / (1 + abs(mom_10)) AS p FROM al WHERE n >= 20)"
FOLDS = f"""{SCORED}, st AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h, CASE WHEN p >= 0.5 THEN 1.0 ELSE -1.0 END AS w, CASE WHEN p >= 0.5 THEN fwd ELSE -fwd END AS s FROM sc),
rk AS (SELECT *, rank() OVER (PARTITION BY split_id, series_id ORDER BY p) + (count(*) OVER (PARTITION BY split_id, series_id, p) - 1) / 2.0 AS rp,
       rank() OVER (PARTITION BY split_id, series_id ORDER BY fwd) + (count(*) OVER (PARTITION BY split_id, series_id, fwd) - 1) / 2.0 AS rf,
       abs(w - lag(w) OVER (PARTITION BY split_id, series_id ORDER BY pos)) AS tv FROM st),
fm AS (SELECT split_id, series_id, count(*) AS n_test,
  (sum(rp) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc,
  coalesce(2.0 * sum(y * h) / nullif(2 * sum(y * h) + sum((1 - y) * h) + sum(y * (1 - h)), 0), 0) AS f1,
  CASE WHEN min(s) = max(s) THEN NULL ELSE avg(s) / stddev_samp(s) * sqrt(252) END AS sharpe,
  CASE WHEN count(*) >= 3 AND min(rp) <> max(rp) AND min(rf) <> max(rf) THEN corr(rp, rf) END AS ic, avg(tv) AS turnover FROM rk GROUP BY split_id, series_id)"""


FOLD_DSR_Z = f"((sharpe / sqrt(252)) * sqrt(n_test - 1) / sqrt(greatest(1 - g3 * sharpe / sqrt(252) + (g4 - 1) / 4 * (sharpe / sqrt(252)) ^ 2, 1e-12)) - {trial_quantile(20)!r})"


@query(f"""WITH {FOLDS}, more AS (SELECT split_id, series_id, sum(y * h)::DOUBLE AS tp, sum((1 - y) * h)::DOUBLE AS fp, sum(y * (1 - h))::DOUBLE AS fn, sum((1 - y) * (1 - h))::DOUBLE AS tn,
  (avg(s ^ 3) - 3 * avg(s) * avg(s * s) + 2 * avg(s) ^ 3) / var_pop(s) ^ 1.5 AS g3, (avg(s ^ 4) - 4 * avg(s) * avg(s ^ 3) + 6 * avg(s) ^ 2 * avg(s * s) - 3 * avg(s) ^ 4) / var_pop(s) ^ 2 AS g4 FROM st GROUP BY ALL),
we AS (SELECT split_id, series_id, pos, product(1 + s) OVER (PARTITION BY split_id, series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS v FROM st),
dd AS (SELECT split_id, series_id, min(f) AS max_dd FROM (SELECT split_id, series_id, v / greatest(max(v) OVER (PARTITION BY split_id, series_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 1e-16) - 1 AS f FROM we) GROUP BY ALL),
al2 AS (SELECT *, {FOLD_DSR_Z} AS dz FROM fm JOIN more USING (split_id, series_id) JOIN dd USING (split_id, series_id))
SELECT split_id, series_id, n_test, {R6('auc')} AS auc, {R6('f1')} AS f1, {R6('sharpe')} AS sharpe, {R6('ic')} AS ic, {R6('turnover')} AS turnover,
{R6('coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)')} AS mcc,
{R6('CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn) ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END')} AS balanced_acc,
CASE WHEN n_test >= 3 THEN {R6(norm_cdf_sql('dz'))} END AS dsr, {R6('max_dd')} AS max_dd, CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS frac_sharpe_pos FROM al2""")
def fold_metrics(spark, sf_dir):
    df = scoring.fold_metrics(_scored(spark, sf_dir), ["split_id", "series_id"])
    return df.select("split_id", "series_id", "n_test", *[rounded(c).alias(c) for c in scoring.METRICS if c != "frac_sharpe_pos"], "frac_sharpe_pos")


@query(f"""WITH {FOLDS} SELECT split_id, count(*)::INTEGER AS n_scores, {R6('avg(auc)')} AS auc_mean, {R6('CASE WHEN count(auc) > 1 THEN stddev_samp(auc) WHEN count(auc) = 1 THEN 0 END')} AS auc_std, {R6('avg(sharpe)')} AS sharpe_mean,
{R6('avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END)')} AS frac_paths_sharpe_gt_0, {R6('avg(ic)')} AS ic_mean FROM fm GROUP BY split_id""")
def protocol_summary(spark, sf_dir):
    df = scoring.protocol_summary(scoring.fold_metrics(_scored(spark, sf_dir), ["split_id", "series_id"]), ["split_id"])
    return df.select("split_id", "n_scores", *[rounded(c).alias(c) for c in ("auc_mean", "auc_std", "sharpe_mean", "frac_paths_sharpe_gt_0", "ic_mean")])


PATHS = f"""{SCORED}, grp AS (SELECT *, {_group_sql(6)} AS group_id FROM al WHERE n >= 20), {ROLE_COUNTS},
pt AS (SELECT path_id, series_id, pos, CASE WHEN (pos * 7 + split_id * 3) % 11 >= 5 THEN fwd ELSE -fwd END AS s FROM grp JOIN sizes USING (group_id)),
p0 AS (SELECT series_id, path_id, count(*) AS n_test, CASE WHEN min(s) = max(s) THEN NULL ELSE avg(s) / stddev_samp(s) * sqrt(252) END AS sharpe,
  (avg(s ^ 3) - 3 * avg(s) * avg(s * s) + 2 * avg(s) ^ 3) / var_pop(s) ^ 1.5 AS g3, (avg(s ^ 4) - 4 * avg(s) * avg(s ^ 3) + 6 * avg(s) ^ 2 * avg(s * s) - 3 * avg(s) ^ 4) / var_pop(s) ^ 2 AS g4 FROM pt GROUP BY ALL),
pm AS (SELECT *, CASE WHEN n_test >= 3 THEN {norm_cdf_sql(FOLD_DSR_Z)} END AS dsr FROM p0)"""


def _combined(spark, sf_dir):
    """(rows, predictions on every tested row of the combinatorial splits by a rule that differs between splits)."""
    rows = _aligned(spark, sf_dir).where("n >= 20")
    assigned = folds.path_assignment(spark, 6, 2).select("split_id", "group_id")
    tested = folds.equal_groups(rows, 6).join(F.broadcast(assigned), "group_id")  # one row per split and group
    p = 0.5 + ((F.col("pos") * 7 + F.col("split_id") * 3) % 11 - 5) / 20
    return rows, tested.select("split_id", "series_id", "pos", "n", "group_id", "y", "fwd", p.alias("p"))


@query(f"WITH {PATHS} SELECT series_id, path_id, {R6('sharpe')} AS sharpe, {R6('dsr')} AS dsr FROM pm")
def path_metrics(spark, sf_dir):
    return scoring.path_metrics(*_combined(spark, sf_dir), 6, 2).select("series_id", "path_id", rounded("sharpe").alias("sharpe"), rounded("dsr").alias("dsr"))


@query(f"""WITH {PATHS} SELECT series_id, count(*)::INTEGER AS n_scores, {R6('avg(sharpe)')} AS sharpe_mean, {R6('CASE WHEN count(sharpe) > 1 THEN stddev_samp(sharpe) WHEN count(sharpe) = 1 THEN 0 END')} AS sharpe_std,
{R6('avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END)')} AS frac_paths_sharpe_gt_0, {R6('avg(dsr)')} AS dsr_mean FROM pm GROUP BY series_id""")
def path_summary(spark, sf_dir):
    """Protocol figures with the Sharpe part taken from the reconstructed paths."""
    rows, predictions = _combined(spark, sf_dir)
    scores = scoring.fold_metrics(predictions, ["split_id", "series_id"])
    df = scoring.protocol_summary(scores, ["series_id"], scoring.path_metrics(rows, predictions, 6, 2))
    return df.select("series_id", "n_scores", *[rounded(c).alias(c) for c in ("sharpe_mean", "sharpe_std", "frac_paths_sharpe_gt_0", "dsr_mean")])


@query(f"WITH {FOLDS} SELECT split_id, count(auc)::INTEGER AS n_folds_scored, {R6('avg(auc)')} AS auc_mean, {R6('coalesce(CASE WHEN count(auc) > 1 THEN stddev_samp(auc) END, 0)')} AS auc_std, {R6('min(auc)')} AS auc_min, {R6('max(auc)')} AS auc_max FROM fm GROUP BY split_id")
def protocol_auc(spark, sf_dir):
    df = scoring.protocol_auc(metrics.roc_auc(_scored(spark, sf_dir), ["split_id", "series_id"], "y", "p"), ["split_id"])
    return df.select("split_id", "n_folds_scored", *[rounded(c).alias(c) for c in ("auc_mean", "auc_std", "auc_min", "auc_max")])


def _newton_sql(steps: int = 12) -> str:
    """The fit of one scaled feature per fold, Newton steps written out."""
    one = """n{k} AS MATERIALIZED (SELECT split_id, series_id, a - (gb_ * -hab + ga * hbb) / det AS a, b - (ga * -hab + gb_ * haa) / det AS b FROM (
  SELECT *, haa * hbb - hab * hab AS det FROM (
    SELECT split_id, series_id, any_value(a) AS a, any_value(b) AS b, sum((p - y) * x) + any_value(a) AS ga, sum(p - y) AS gb_, sum(p * (1 - p) * x * x) + 1 AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) AS hbb
    FROM (SELECT f.*, a, b, 1 / (1 + exp(-(a * x + b))) AS p FROM f JOIN n{j} USING (split_id, series_id)) GROUP BY split_id, series_id)))"""
    return f"""WITH {_purge_sql(KFOLD_TEST, 'any_value(0)')}, lb AS (SELECT series_id, pos, close AS x, CASE WHEN lead(close) OVER (PARTITION BY series_id ORDER BY pos) > close THEN 1 ELSE 0 END AS y FROM bars),
sc AS MATERIALIZED (SELECT split_id, series_id, avg(x) AS m, CASE WHEN min(x) = max(x) THEN 1 ELSE stddev_pop(x) END AS s FROM tr JOIN lb USING (series_id, pos) GROUP BY split_id, series_id HAVING min(y) < max(y)),
f AS MATERIALIZED (SELECT split_id, series_id, y, (x - m) / s AS x FROM tr JOIN lb USING (series_id, pos) JOIN sc USING (split_id, series_id)),
n0 AS MATERIALIZED (SELECT split_id, series_id, 0::DOUBLE AS a, 0::DOUBLE AS b FROM sc), {', '.join(one.format(j=i, k=i + 1) for i in range(steps))}
SELECT split_id, series_id, te.pos, y, {R6(f'1 / (1 + exp(-(a * (x - m) / s + b)))')} AS p FROM te JOIN lb USING (series_id, pos) JOIN sc USING (split_id, series_id) JOIN n{steps} USING (split_id, series_id)"""


@query(_newton_sql())
def newton_folds(spark, sf_dir):
    """Logistic fits on the price alone, of the purged folds of all series together."""
    b = _bars(spark, sf_dir)
    up = F.when(F.lead("close").over(Window.partitionBy("series_id").orderBy("pos")) > F.col("close"), 1).otherwise(0)
    rows = b.select("series_id", "pos", "n", F.col("close").alias("x"), up.alias("y"), F.lit(0.0).alias("fwd"), F.least(F.col("pos") + 5, F.col("n") - 1).alias("t1_pos"))
    return learn.grouped_logistic(rows, folds.purged_kfold(rows, 5), ["x"]).select("split_id", "series_id", "pos", "y", rounded("p").alias("p"))


@query()
def logistic_folds(spark, sf_dir):
    """Logistic probabilities on all features of every series' purged folds, fitted together."""
    rows = _aligned(spark, sf_dir).where("n >= 30")
    splits = scoring.enough_rows(folds.purged_kfold(rows, 3, embargo_pct=0.01), ["split_id", "series_id"], 10, 5)
    return learn.grouped_logistic(rows, splits, list(features.FEATURES))


STUMPS = f"""WITH {_purge_sql(KFOLD_TEST, 'any_value(0)')}, lb AS (SELECT series_id, pos, floor(close / 25) AS x, CASE WHEN lead(close) OVER (PARTITION BY series_id ORDER BY pos) > close THEN 1 ELSE 0 END AS y FROM bars),
tot AS (SELECT split_id, series_id, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS g FROM tr JOIN lb USING (series_id, pos) GROUP BY ALL HAVING min(y) < max(y)),
c AS (SELECT split_id, series_id, x, count(*) AS c, sum(y) AS s FROM tr JOIN lb USING (series_id, pos) GROUP BY ALL),
cum AS (SELECT split_id, series_id, x, (sum(c) OVER w)::DOUBLE AS nl, (sum(s) OVER w)::DOUBLE AS gl FROM c WINDOW w AS (PARTITION BY split_id, series_id ORDER BY x)),
gain AS (SELECT cum.*, gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n AS gain FROM cum JOIN tot USING (split_id, series_id) WHERE nl >= 5 AND n - nl >= 5),
best AS (SELECT *, row_number() OVER (PARTITION BY split_id, series_id ORDER BY round(gain, 9) DESC, x) AS k FROM gain WHERE gain > 1e-12)
SELECT split_id, series_id, te.pos, y, {R6('CASE WHEN b.x IS NULL THEN g / n WHEN lb.x <= b.x THEN gl / nl ELSE (g - gl) / (n - nl) END')} AS p
FROM te JOIN lb USING (series_id, pos) JOIN tot USING (split_id, series_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (split_id, series_id)"""


@query(STUMPS)
def tree_folds(spark, sf_dir):
    """One split of each purged fold of all series, grown together; edges of bins are all values, so SQL can follow."""
    b = _bars(spark, sf_dir)
    up = F.when(F.lead("close").over(Window.partitionBy("series_id").orderBy("pos")) > F.col("close"), 1).otherwise(0)
    rows = b.select("series_id", "pos", "n", F.floor(F.col("close") / 25).alias("x"), up.alias("y"), F.least(F.col("pos") + 5, F.col("n") - 1).alias("t1_pos"))
    shape = trees.Shape(trees=1, depth=1, bins=128, bootstrap=False)
    return trees.grouped_forest(rows, folds.purged_kfold(rows, 5), ["x"], shape=shape).select("split_id", "series_id", "pos", "y", rounded("p").alias("p"))


def _pooled_model(name: str, **how):
    def run(spark, sf_dir):
        rows = _aligned(spark, sf_dir).withColumn("_late", F.col("pos") >= F.floor(F.col("n") * 0.7)).cache()  # a fit reads its rows several times
        model = learn.make_model(name, **how).fit(rows.where(~F.col("_late") & (F.col("t1_pos") < F.floor(F.col("n") * 0.7))), list(features.FEATURES))
        rows.unpersist()
        return model.predict_proba(rows.where("_late")).select("series_id", "pos", "y", "p")

    return run


QUERIES["logistic_model"] = _pooled_model("logistic")


@query()
def forest_model(spark, sf_dir):
    """A forest on the first 70 % of every series; the deep trees' small nodes are grown in one task each."""
    rows = _aligned(spark, sf_dir).withColumn("_late", F.col("pos") >= F.floor(F.col("n") * 0.7))
    rows = rows.where(F.col("_late") | (F.col("t1_pos") < F.floor(F.col("n") * 0.7)))
    return forest.deep_forest(rows, "_late", list(features.FEATURES), ["series_id", "pos", "y"])


QUERIES["boosted_model"] = _pooled_model("xgboost")


# --- sources --------------------------------------------------------------

DAILY = "SELECT event_type AS series_id, ts::DATE AS t, {} FROM events GROUP BY ALL"
OHLCV = "arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*)::DOUBLE AS volume"


def _daily(spark, sf_dir):
    e = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("t"))
    return e.agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))


@query(DAILY.format(OHLCV))
def source_chart_json(spark, sf_dir):
    """Daily bars written as chart payloads, one JSON text per series, and parsed back."""
    d = _daily(spark, sf_dir).withColumn("ts", F.unix_timestamp(F.col("t").cast("timestamp")))
    fields = ("open", "high", "low", "close", "volume")
    g = d.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("ts", *fields))).alias("b"))
    quote = F.array(F.struct(*[F.col("b")[f].alias(f) for f in fields]))
    result = F.struct(F.col("b")["ts"].alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators"))
    text = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    return files.parse_chart(g.select("series_id", text.alias("value"))).select("series_id", F.col("date").alias("t"), *fields)


@query("SELECT ts::DATE AS date, " + OHLCV + " FROM events GROUP BY ts::DATE")
def source_daily_csv(spark, sf_dir):
    """Daily bars as text columns under a vendor's header, typed again."""
    e = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("t"))
    d = e.agg(F.min_by("value", "event_id").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "event_id").alias("c"), F.count("*").cast("double").alias("v"))
    raw = d.select(*[F.col(a).cast("string").alias(b) for a, b in zip("tohlcv", ("Date", " Open", "High ", "Low", "Close", "Volume"), strict=True)])
    return files.parse_stooq(raw)


@query("SELECT date, round(a / 100, 8) AS mkt_rf, round(b / 100, 8) AS smb, round(c / 100, 8) AS hml, round(d / 100, 8) AS rf FROM (SELECT ts::DATE AS date, max(value) AS a, min(value) AS b, arg_max(value, event_id) AS c, arg_min(value, event_id) AS d FROM events GROUP BY 1)")
def source_factor_text(spark, sf_dir):
    """Factor lines between a preamble and a footer."""
    e = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("t"))
    d = e.agg(F.max("value").alias("a"), F.min("value").alias("b"), F.max_by("value", "event_id").alias("c"), F.min_by("value", "event_id").alias("d"))
    line = F.concat(F.date_format("t", "yyyyMMdd"), *[F.concat(F.lit(",  "), F.col(c).cast("string")) for c in "abcd"])
    preamble = d.limit(1).select(F.lit("Daily returns, in percent").alias("value"))
    lines = preamble.unionByName(d.select(line.alias("value"))).unionByName(d.limit(1).select(F.lit("Copyright").alias("value")))
    return files.parse_factors(lines).select("date", *[F.round(c, 8).alias(c) for c in files.FACTOR_COLUMNS[1:]])


@query()
def source_checksums(spark, sf_dir):
    return files.checksums(spark, f"{sf_dir}/*.parquet")


EPS = f"{BARS}, no AS (SELECT series_id, pos, CASE WHEN pos = 0 THEN 0 ELSE (close - 245) / 25000 END AS e FROM bars)"


@query(f"WITH {EPS}, ar AS (SELECT a.series_id, a.pos, sum(b.e * 0.08 ^ (a.pos - b.pos)) AS ret FROM no a JOIN no b ON b.series_id = a.series_id AND b.pos BETWEEN a.pos - 15 AND a.pos GROUP BY ALL) SELECT series_id, pos, {R6('ret')} AS ret, {R6('100 * exp(sum(ret) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING))')} AS close FROM ar")
def autoregressive_panel(spark, sf_dir):
    noise = _bars(spark, sf_dir).select("series_id", "pos", ((F.col("close") - 245) / 25000).alias("eps"))
    return generators.autoregressive(noise).select("series_id", "pos", rounded("ret").alias("ret"), rounded("close").alias("close"))


# --- flagship -------------------------------------------------------------

OVERLAY = f"""WITH {BARS}, f AS (SELECT series_id, pos, ln(close) - ln(lag(close, 5) OVER w) AS m, ln(lead(close, 5) OVER w) - ln(close) AS fwd FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
s AS (SELECT series_id, CASE WHEN m < 0 THEN fwd ELSE -fwd END AS r FROM f WHERE m IS NOT NULL AND fwd IS NOT NULL)
SELECT series_id, count(*) AS n_bars, {R6('avg(r) / stddev_samp(r) * sqrt(252)')} AS sharpe, {R6('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM s GROUP BY series_id"""


@query(OVERLAY)
def reversal_overlay(spark, sf_dir):
    """Sharpe ratio per series of betting against the last five bars over the next five."""
    df = labels.fixed_horizon_returns(_bars(spark, sf_dir), 5)
    past = F.ln("close") - F.ln(F.lag("close", 5).over(Window.partitionBy("series_id").orderBy("pos")))
    df = df.withColumn("m", past).where("m IS NOT NULL AND fwd IS NOT NULL")
    df = df.withColumn("r", features.overlay_return(F.when(F.col("m") < 0, 1.0).otherwise(0.0), F.col("fwd")))
    return df.groupBy("series_id").agg(F.count("*").alias("n_bars"), rounded(stats.sharpe_ratio("r")).alias("sharpe"), rounded(stats.frac_positive("r")).alias("hit_rate"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversal_overlay(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
