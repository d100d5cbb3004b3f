"""Registered queries: training matrices, models, plateau selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barflow.operators import indicators as I
from barflow.operators import labels as L
from barflow.operators import matrices as X
from barflow.operators import models as M
from barflow.operators import plateau as P
from barflow.plans.ordered import Series, with_position
from barflow.queries.base import SQL, TICKS_SQL, bar_series, bars, bars_sql, micros, query, r, show, sql_round, table, ticks
from barflow.queries.indicator_queries import lag, recursive_ema, roll
from barflow.queries.join_queries import news
from barflow.queries.label_queries import LABEL_SQL, SIGNALS_SQL, funded_bars, s3
from barflow.session import reliable_checkpoint


def matrix(kind, spark, sf):
    return X.training_matrix(kind, funded_bars(spark, sf), bar_series(), "15m", news(spark, sf).drop("score"))


# The SQL of a matrix joins the SQL of its indicators, which round their columns for comparison; these are the digits.
_DIGITS = {"frac_diff_d40": 5, "trend_strength": 5, "vol_regime": 5, "vwap_dist": 7}
_BARRIER = {**X.BARRIERS, "trend": (4.0, 2.0, X.TREND_BARS["15m"])}
_INDICATORS = ["fractional_diff", "trend_flags", "rsi", "macd", "bollinger", "roc", "flow_imbalance", "session_vwap", "liquidity_proximity", "donchian", "keltner", "adx", "funding_zscore",
               "atr", "price_shape"]


def _zscore(n: int) -> str:
    z = f"(ofi - {roll('avg(ofi)', n)}) / CASE WHEN {roll('stddev_samp(ofi)', n)} = 0 THEN 1e-9 ELSE {roll('stddev_samp(ofi)', n)} END"
    return f"CASE WHEN {z} < -3 THEN -3 WHEN {z} > 3 THEN 3 ELSE {z} END"


def _matrix_sql(kind: str) -> str:
    pt, sl, bars_ahead = _BARRIER[kind]
    labels = LABEL_SQL.replace("1.5 * a THEN -1", f"1.5 * a THEN {1 if pt <= sl else -1}").replace("2.5 * a", f"{pt}*a").replace("1.5 * a", f"{sl}*a").replace("b.i + 12", f"b.i + {bars_ahead}")
    wide = f"""{labels}, {recursive_ema('m5', 'bars', 'close', 2 / 6)}, {recursive_ema('m13', 'bars', 'close', 2 / 14)}, {recursive_ema('k10', 'bars', 'close', 2 / 11)},
    c0 AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, 2 * taker_buy_base - volume AS ofi, {roll('avg(close)', 10)} AS s10, {roll('stddev_samp(close)', 10)} AS d10 FROM trs),
    c1 AS (SELECT *, {roll('stddev_samp(ret)', 7)} AS volatility, {_zscore(10)} AS ofi_z10, {_zscore(20)} AS ofi_z20, (close - {roll('min(low)', 30)}) / close AS support, (close - {roll('min(low)', 15)}) / close AS micro,
      {roll('avg(volume)', 7)} AS v7, {roll('avg(volume)', 5)} AS v5, {roll('avg(volume)', 20)} AS v20, {roll('avg(tr)', 5)} AS a5, {', '.join(f"close / nullif({lag('close', n)}, 0) - 1 AS r{n}" for n in (5, 10))} FROM c0),
    cu AS (SELECT c1.symbol, c1.ts, round(volatility, 6) + 0.0 AS volatility, round(ofi_z{10 if kind == 'scalping' else 20}, 6) + 0.0 AS ofi_z, round(support, 6) + 0.0 AS dist_to_support, round(micro, 6) + 0.0 AS dist_to_micro_supp,
      CAST(coalesce(volume < v7 * 0.7, FALSE) AS BIGINT) AS volume_drop, CAST(coalesce(volume > {'v5 * 2.0' if kind == 'scalping' else 'v20 * 1.5'}, FALSE) AS BIGINT) AS volume_surge, round(r5, 6) + 0.0 AS roc_5, round(r10, 6) + 0.0 AS roc_10,
      round(m5.y - m13.y, 6) + 0.0 AS macd_fast, round((close - (s10 - 2 * d10)) / CASE WHEN 4 * d10 = 0 THEN 1e-4 ELSE 4 * d10 END, 6) + 0.0 AS bb10,
      round((close - (k10.y - 1.5 * a5)) / CASE WHEN 3 * a5 = 0 THEN 1e-9 ELSE 3 * a5 END, 6) + 0.0 AS kc10, (ts // 3600000000) % 24 AS hour, (ts // 86400000000 + 3) % 7 AS day_of_week,
      round(taker_buy_base / CASE WHEN volume = 0 THEN 0.0001 ELSE volume END, 6) + 0.0 AS taker_buy_ratio, round(volume / CASE WHEN trades_count = 0 THEN 1 ELSE trades_count END, 6) + 0.0 AS avg_trade_size
      FROM c1 JOIN m5 USING (symbol, i) JOIN m13 USING (symbol, i) JOIN k10 USING (symbol, i)),
    """ + ", ".join(f"f_{n} AS ({SQL['indicator_' + n]})" for n in _INDICATORS) + f", f_news AS ({SQL['join_news_sentiment']})"
    own = {"return_lag1": "ret_lag_1", "return_lag2": "ret_lag_2", "return_lag3": "ret_lag_3", "return_lag5": "ret_lag_5", "atr_pct": "range_pct", "trend_alignment": "sma_align", "oi_change_pct": "0.0::DOUBLE",
           "fear_greed_norm": "0.5::DOUBLE", "signal_macd": "CASE WHEN macd_hist > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END", "signal_don": s3("don_pos_20 > 0.95", "don_pos_20 < 0.05"),
           "signal_rsi": s3("rsi_7 < 25", "rsi_7 > 75") if kind == "scalping" else s3("rsi_14 < 30", "rsi_14 > 70"), "volume_surge": "cu.volume_surge", "volume_drop": "cu.volume_drop", "ofi_z": "cu.ofi_z"}
    own |= {"bb_pb": "bb10", "kc_pos": "kc10", "signal_bb": s3("bb10 < 0.1", "bb10 > 0.9")} if kind == "scalping" else {"signal_bb": s3("bb_pb < 0.1", "bb_pb > 0.9")}
    value = lambda c: f"coalesce({own.get(c, c)}, 0)" if kind in X.NEEDED else own.get(c, c)
    needed = " AND ".join(f"({own.get(c, c)}) IS NOT NULL" for c in (["atr_14"] if kind in X.NEEDED else X.FEATURES[kind]))
    joins = " ".join(f"JOIN {t} USING (symbol, ts)" for t in ["cu", *[f"f_{n}" for n in _INDICATORS], "f_news"])
    target = "label = -1" if kind == "futures" else "label = 1"
    return f"""{wide}, lb AS (SELECT symbol, ts, CAST(label AS BIGINT) AS label, t1 FROM lab WHERE label <> 0)
    SELECT symbol, ts, {', '.join(f'{value(c)} AS {c}' for c in X.FEATURES[kind])}, label, t1, CAST({target} AS BIGINT) AS target FROM lb {joins} WHERE {needed}"""


def _matrix_rows(kind, spark, sf):
    d = matrix(kind, spark, sf)
    kinds = dict(d.dtypes)
    shown = [r(c, _DIGITS.get(c, 6)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("bigint").alias(c) for c in X.FEATURES[kind]]
    return d.select("symbol", micros("ts").alias("ts"), *shown, F.col("label").cast("bigint").alias("label"), micros("t1").alias("t1"), F.col("target").cast("bigint").alias("target"))


for _kind in X.FEATURES:
    query(f"training_matrix_{_kind}", _matrix_sql(_kind))(lambda spark, sf, _k=_kind: _matrix_rows(_k, spark, sf))


@query("sequence_frame", f"""WITH {TICKS_SQL}, {bars_sql()}, e AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1), g AS (SELECT symbol, unnest(range(a, z + 1, 900000000)) AS ts FROM e),
  j AS (SELECT g.symbol, g.ts, last_value(close IGNORE NULLS) OVER w AS close, last_value(volume IGNORE NULLS) OVER w AS volume, last_value(taker_buy_base IGNORE NULLS) OVER w AS tb FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts)),
  k AS (SELECT *, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 0) AS ret FROM j)
  SELECT symbol, ts, {sql_round('close, volume')}, round(ret, 6) + 0.0 AS ret, round(tb / CASE WHEN volume = 0 THEN 0.0001 ELSE volume END, 6) + 0.0 AS taker_buy_ratio, round(2 * tb - volume, 6) + 0.0 AS ofi FROM k""")
def sequence_frame(spark, sf):
    d = X.sequence_frame(funded_bars(spark, sf), bar_series(), "15m").withColumnRenamed("return", "ret")
    return show(d, "close", "volume", "ret", "taker_buy_ratio", "ofi")


@query("regime_clusters")
def regime_clusters(spark, sf):
    """Rows and mean volatility per regime, per symbol."""
    f = I.add_features(bars(spark, sf), bar_series(), I.regime_features()).select("symbol", "ts", *M.REGIME_COLUMNS).dropna()
    f = reliable_checkpoint(f)
    d = M.fit_regimes(f)(f)
    return d.groupBy("symbol", F.col("regime").cast("bigint").alias("regime")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("rv"), 4).alias("mean_rv"))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(x[:, 0] * 0.03 - x[:, 1] * 0.02 + x[:, 2])))


@query("model_batch_scores", f"""WITH {TICKS_SQL}, s AS (SELECT id, 1 / (1 + exp(-(volume * 0.03 - price * 0.02 + 0))) AS p FROM ticks) SELECT id, round(p, 6) + 0.0 AS p, CASE WHEN p > 0.52 THEN 1.0::DOUBLE WHEN p < 0.48 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS signal FROM s""")
def model_batch_scores(spark, sf):
    t = ticks(spark, sf).select("id", "volume", "price")
    d = M.score_batches(t, _logistic, ["volume", "price", "absent_feature"], expected=3)
    return d.select("id", r("p").alias("p"), M.model_signal("p").alias("signal"))


@query("model_scores_fail_closed", f"WITH {TICKS_SQL} SELECT symbol, count(*) AS blocked FROM ticks GROUP BY 1")
def model_scores_fail_closed(spark, sf):
    d = M.score_batches(ticks(spark, sf).select("symbol", "volume"), _logistic, ["volume"], expected=3)
    return d.where(F.col("p").isNull()).groupBy("symbol").agg(F.count(F.lit(1)).alias("blocked"))


def _by_length(texts: list[str]) -> list[tuple[str, float]]:
    return [("POSITIVE" if len(t) > 1000 else "bearish" if len(t) > 300 else "neutral", len(t) / (len(t) + 900.0)) for t in texts]


@query("text_model_scores", """SELECT doc_id, CASE WHEN length(text) > 1000 THEN ROUND(length(text) / (length(text) + 900.0::DOUBLE), 3) WHEN length(text) > 300 THEN -ROUND(length(text) / (length(text) + 900.0::DOUBLE), 3) ELSE 0.0::DOUBLE END AS tone FROM documents""")
def text_model_scores(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return M.score_texts(d, "text", _by_length).select("doc_id", "tone")


@query("walk_forward_classifier")
def walk_forward_classifier(spark, sf):
    """AUC and precision of boosted trees on purged walk-forward folds of the futures matrix."""
    s = bar_series()
    m = reliable_checkpoint(with_position(matrix("futures", spark, sf), s, out="row"))
    folds = L.walk_forward_folds(m.select("symbol", "ts", "t1"), s)
    d = M.walk_forward_classifier(m, folds, X.FEATURES["futures"], ["symbol"], iterations=5)
    return d.select("fold", *[r(c, 4).alias(c) for c in ("auc_roc", "win_precision", "win_rate_pct")], "n_high_conf")


@query("plateau_winners", """WITH t AS (SELECT p_brand AS study, p_partkey AS trial, p_size AS a, p_retailprice AS b, p_type AS c, p_size * 3 + length(p_name) * 10 + p_retailprice / 100 AS v FROM part),
  bd AS (SELECT study, count(*) AS n, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM t GROUP BY 1 HAVING count(*) >= 8),
  x AS (SELECT t.*, n, (a - la) / CASE WHEN ha = la THEN 1.0::DOUBLE ELSE ha - la END AS xa, (b - lb) / CASE WHEN hb = lb THEN 1.0::DOUBLE ELSE hb - lb END AS xb FROM t JOIN bd USING (study)),
  d AS (SELECT i.study, i.trial, i.v, j.trial AS o, j.v AS ov, 0.0::DOUBLE + (i.xa - j.xa) * (i.xa - j.xa) + (i.xb - j.xb) * (i.xb - j.xb) + CASE WHEN i.c = j.c THEN 0 ELSE 2 END AS d2 FROM x i JOIN x j ON i.study = j.study AND i.trial <> j.trial),
  k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY study, trial ORDER BY d2, o) <= 5),
  sc AS (SELECT study, trial, any_value(v) AS v, median(ov) - 0.5 * coalesce(stddev_samp(ov), 0) AS score FROM k GROUP BY 1, 2),
  g AS (SELECT study, count(*) AS n_trials, arg_max(trial, (score, -trial)) AS pt, max(score) AS ps, arg_max(v, (score, -trial)) AS pv, arg_max(trial, (v, -trial)) AS st, arg_max(score, (v, -trial)) AS ss, max(v) AS sv FROM sc GROUP BY 1)
  SELECT study, n_trials, pt AS plateau_trial, round(ps, 6) + 0.0 AS plateau_score, st AS spike_trial, round(ss, 6) + 0.0 AS spike_score, round(pv / sv, 6) + 0.0 AS recovery,
    CASE WHEN pt = st THEN 'tie' WHEN ps > ss AND pv / sv >= 0.85 THEN 'plateau' ELSE 'spike' END AS recommendation FROM g""")
def plateau_winners(spark, sf):
    t = table(spark, sf, "part").select(
        F.col("p_brand").alias("study"), F.col("p_partkey").alias("trial"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.col("p_type").alias("c"),
        (F.col("p_size") * 3 + F.length("p_name") * 10 + F.col("p_retailprice") / 100).alias("v"))
    d = P.plateau_winners(t, ["study"], "trial", "v", ["a", "b"], ["c"])
    return show(d, "n_trials", "plateau_trial", "plateau_score", "spike_trial", "spike_score", "recovery", "recommendation", keys=("study",))
