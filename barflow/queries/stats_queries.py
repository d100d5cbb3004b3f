"""Registered queries: cross-series statistics and model metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import stats as S
from barflow.plans.ordered import Series
from barflow.queries.base import TICKS_SQL, bar_series, bars, bars_sql, micros, query, r, show, sql_round, table, ticks
from barflow.queries.indicator_queries import lag
from barflow.queries.label_queries import funded_bars

HOUR = f"WITH {TICKS_SQL}, {bars_sql('1h')}, rt AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM bars)"
PAIRS = HOUR + ", fx AS (SELECT a.symbol, a.ts, a.ret, f.ret AS fr FROM rt a JOIN rt f ON f.ts = a.ts AND f.symbol = 'click' WHERE a.ret IS NOT NULL AND f.ret IS NOT NULL)"


def _rets(spark, sf, tf="1h"):
    return S.returns(bars(spark, sf, tf), bar_series(tf))


@query("factor_betas", PAIRS + " SELECT symbol, count(*) AS n, round(CASE WHEN symbol = 'click' THEN 1 ELSE coalesce(covar_pop(ret, fr) / nullif(var_pop(fr), 0), 0) END, 6) + 0.0 AS beta FROM fx GROUP BY 1")
def factor_betas(spark, sf):
    return show(S.factor_betas(_rets(spark, sf), "click"), "n", "beta", keys=("symbol",))


@query("portfolio_beta", PAIRS + """, be AS (SELECT symbol, CASE WHEN symbol = 'click' THEN 1 ELSE coalesce(covar_pop(ret, fr) / nullif(var_pop(fr), 0), 0) END AS beta FROM fx GROUP BY 1),
  po AS (SELECT user_id AS book, event_type AS symbol, sum(value) AS notional, CASE WHEN avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) > 50 THEN 1 ELSE -1 END AS sg FROM events GROUP BY 1, 2),
  g AS (SELECT book, count(*) AS n_positions, sum(sg * notional * coalesce(beta, 1)) / sum(notional) AS ab FROM po LEFT JOIN be USING (symbol) GROUP BY 1)
  SELECT book, n_positions, round(ab, 6) + 0.0 AS aggregate_beta, abs(ab) > 0.3 AS breach FROM g""")
def portfolio_beta(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    pos = e.groupBy(F.col("user_id").alias("book"), F.col("event_type").alias("symbol")).agg(
        F.sum("value").alias("notional"), F.when(F.avg(k) > 50, "long").otherwise("short").alias("side")
    )
    d = S.portfolio_beta(pos, S.factor_betas(_rets(spark, sf), "click"), 0.3, ["book"])
    return show(d, "n_positions", "aggregate_beta", "breach", keys=("book",))


@query("benchmark_correlation", f"""WITH {TICKS_SQL}, {bars_sql('1h')}, l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 168),
  rt AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM l),
  g AS (SELECT a.symbol, corr(a.ret, f.ret) AS c, count(*) AS n FROM rt a JOIN rt f ON f.ts = a.ts AND f.symbol = 'click' WHERE a.symbol <> 'click' AND a.ret IS NOT NULL AND f.ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
  SELECT symbol, n, round(c, 6) + 0.0 AS corr, c < 0.3 AS breakdown FROM g""")
def benchmark_correlation(spark, sf):
    return show(S.benchmark_correlation(bars(spark, sf, "1h"), bar_series("1h"), "click"), "n", "corr", "breakdown", keys=("symbol",))


CORR_SQL = HOUR + """, v AS (SELECT symbol, ts, ret FROM rt WHERE ret IS NOT NULL), k AS (SELECT ts FROM v GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM v)),
  w AS (SELECT v.* FROM v JOIN k USING (ts)), pr AS (SELECT a.symbol AS x, b.symbol AS y, corr(a.ret, b.ret) AS c, count(*) AS n FROM w a JOIN w b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2)"""


@query("mean_pairwise_correlation", CORR_SQL + " SELECT (SELECT count(DISTINCT symbol) FROM w) AS n_series, max(n) AS n_times, round(avg(c), 6) + 0.0 AS mean_corr FROM pr")
def mean_pairwise_correlation(spark, sf):
    d = S.mean_pairwise_correlation(_rets(spark, sf))
    return show(d, "n_series", "n_times", "mean_corr", keys=())


@query("risk_parity_weights", CORR_SQL + """, a AS (SELECT symbol, stddev_samp(ret) AS vol, least(avg(taker_buy_base) / avg(volume), 1) AS p FROM rt GROUP BY 1),
  q AS (SELECT symbol, (p - 0.5) * 2 / greatest(vol, 1e-9) * greatest(1 - (SELECT avg(c) FROM pr), 0) AS w FROM a)
  SELECT symbol, round(w / (SELECT sum(abs(w)) FROM q), 6) + 0.0 AS weight FROM q""")
def risk_parity_weights(spark, sf):
    rets = _rets(spark, sf)
    assets = rets.groupBy("symbol").agg(
        F.stddev_samp("ret").alias("vol"), F.least(F.avg("taker_buy_base") / F.avg("volume"), F.lit(1.0)).alias("prob")
    )
    return show(S.risk_parity(assets, S.mean_pairwise_correlation(rets)), "weight", keys=("symbol",))


@query("ou_calibration", HOUR + f""", x AS (SELECT *, {lag('close')} AS p FROM bars),
  g AS (SELECT symbol, count(*) AS n, regr_slope(close, p) AS b, regr_intercept(close, p) AS a, sqrt(greatest(regr_syy(close, p) / regr_count(close, p) - regr_slope(close, p) * regr_sxy(close, p) / regr_count(close, p), 0)) AS rs,
    avg(close) AS m, stddev_pop(close) AS sd, arg_max(close, ts) AS last FROM x GROUP BY 1),
  h AS (SELECT *, CASE WHEN b > 0 AND b < 1 THEN -ln(b) ELSE 0 END AS theta, CASE WHEN b > 0 AND b < 1 THEN a / (1 - b) ELSE m END AS mu FROM g),
  k AS (SELECT *, CASE WHEN b > 0 AND b < 1 THEN rs / sqrt((1 - b * b) / (2 * theta)) ELSE sd END AS sigma FROM h)
  SELECT symbol, n, {sql_round('theta, mu, sigma')}, CAST(CASE WHEN NOT (b > 0 AND b < 1) THEN 0 WHEN last - mu > 2 * sigma THEN -1 WHEN last - mu < -2 * sigma THEN 1 ELSE 0 END AS BIGINT) AS signal FROM k""")
def ou_calibration(spark, sf):
    return show(S.ou_calibration(bars(spark, sf, "1h"), bar_series("1h")), "n", "theta", "mu", "sigma", "signal", keys=("symbol",))


@query("quant_matrix", f"""WITH {TICKS_SQL}, {bars_sql('1h')}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rk FROM bars QUALIFY rk <= 200),
  x AS (SELECT *, {lag('close')} AS p, close / nullif({lag('close')}, 0) - 1 AS ret FROM l),
  g AS (SELECT symbol, count(*) AS n, covar_samp(close, p) / nullif(var_pop(p), 0) AS b, covar_pop(close, p) AS cp, var_pop(p) AS vx, var_pop(CASE WHEN p IS NOT NULL THEN close END) AS vy,
    avg(CASE WHEN p IS NOT NULL THEN close END) AS my, avg(p) AS mx, avg(close) AS m, arg_max(close, ts) AS last,
    stddev_samp(CASE WHEN rk <= 5 THEN ret END) * 100 AS v5, CASE WHEN count(*) > 60 THEN stddev_samp(CASE WHEN rk <= 60 THEN ret END) * 100 ELSE 0 END AS v60 FROM x GROUP BY 1 HAVING count(*) >= 50),
  h AS (SELECT *, CASE WHEN abs(1 - b) > 1e-9 THEN (my - b * mx) / (1 - b) ELSE m END AS mu, sqrt(greatest(vy - 2 * b * cp + b * b * vx, 0)) AS sg FROM g),
  k AS (SELECT *, CASE WHEN sg > 0 THEN (last - mu) / sg ELSE 0 END AS ou_dev FROM h)
  SELECT symbol, n, round(ou_dev, 6) + 0.0 AS ou_dev, round(v60, 6) + 0.0 AS vol60, CASE WHEN v5 > v60 * 1.8 THEN 'HIGH' ELSE 'NORMAL' END AS vol_flag,
    CASE WHEN ou_dev <= -2.5 THEN 'OVERSOLD' WHEN ou_dev >= 2.5 THEN 'OVERBOUGHT' ELSE 'NEUTRAL' END AS signal FROM k""")
def quant_matrix(spark, sf):
    return show(S.quant_matrix(bars(spark, sf, "1h"), bar_series("1h")), "n", "ou_dev", "vol60", "vol_flag", "signal", keys=("symbol",))


@query("pair_spread", f"""WITH {TICKS_SQL}, {bars_sql('1h')}, j AS (SELECT a.ts, a.close AS a, b.close AS b FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol = 'click' AND b.symbol = 'view'),
  h AS (SELECT regr_slope(a, b) AS hr, count(*) AS n FROM j), s AS (SELECT ts, a - hr * b AS sp, n, hr FROM j, h),
  g AS (SELECT any_value(n) AS n, any_value(hr) AS hr, (arg_max(sp, ts) - avg(sp)) / stddev_pop(sp) AS z FROM s)
  SELECT n, round(hr, 6) + 0.0 AS hedge_ratio, round(z, 6) + 0.0 AS z_score, CAST(CASE WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 ELSE 0 END AS BIGINT) AS signal FROM g WHERE n >= 30""")
def pair_spread(spark, sf):
    return show(S.pair_spread(bars(spark, sf, "1h"), "click", "view"), "n", "hedge_ratio", "z_score", "signal", keys=())


@query("rolling_win_loss", """WITH t AS (SELECT o_orderpriority AS strategy, o_orderkey AS id, o_orderdate AS ts, o_totalprice - 250000 AS pnl FROM orders),
  g AS (SELECT *, avg(CASE WHEN pnl > 0 THEN pnl END) OVER w AS aw, avg(CASE WHEN pnl < 0 THEN -pnl END) OVER w AS al, count(*) OVER w AS n, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS wr
    FROM t WINDOW w AS (PARTITION BY strategy ORDER BY ts, id ROWS 49 PRECEDING))
  SELECT strategy, id, round(wr, 6) + 0.0 AS win_rate, round(CASE WHEN n >= 5 AND aw IS NOT NULL AND al IS NOT NULL THEN greatest(0.5, least(5, aw / al)) ELSE 1.5 END, 6) + 0.0 AS win_loss_ratio FROM g""")
def rolling_win_loss(spark, sf):
    t = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("strategy"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") - 250000).alias("pnl"),
    )
    s = Series.sampled(t, ["strategy"], ["ts", "id"])
    return show(S.win_loss(t, s), "win_rate", "win_loss_ratio", keys=("strategy", "id"))


@query("tail_risk", HOUR + """, wt AS (SELECT user_id AS book, event_type AS symbol, sum(value) / sum(sum(value)) OVER (PARTITION BY user_id) AS weight FROM events GROUP BY 1, 2),
  sc AS (SELECT book, ts, sum(ret * weight) AS x FROM rt JOIN wt USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2), q AS (SELECT book, quantile_cont(x, 0.05) AS v FROM sc GROUP BY 1)
  SELECT book, count(*) AS n_scenarios, round(any_value(v), 6) + 0.0 AS var, round(avg(CASE WHEN x <= v THEN x END), 6) + 0.0 AS cvar, round(avg(x), 6) + 0.0 AS expected_return FROM sc JOIN q USING (book) GROUP BY 1""")
def tail_risk(spark, sf):
    e = table(spark, sf, "events")
    per = e.groupBy(F.col("user_id").alias("book"), F.col("event_type").alias("symbol")).agg(F.sum("value").alias("_v"))
    tot = e.groupBy(F.col("user_id").alias("book")).agg(F.sum("value").alias("_t"))
    w = per.join(tot, "book").select("book", "symbol", (F.col("_v") / F.col("_t")).alias("weight"))
    return show(S.tail_risk(_rets(spark, sf), w), "n_scenarios", "var", "cvar", "expected_return", keys=("book",))


def _scored(spark, sf):
    """Labelled documents: a score from the text length against the quality label, per language."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("lang", "doc_id", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 700.0)).alias("p"))


SCORED_SQL = "WITH sc AS (SELECT lang, doc_id, quality AS y, n_chars / (n_chars + 700.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id))"


@query("classifier_metrics", SCORED_SQL + """, rk AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS rnk FROM sc),
  g AS (SELECT lang, sum(rnk) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS np, count(*) FILTER (y <> 1) AS nn, count(*) FILTER (p >= 0.6) AS n_high_conf, avg(CASE WHEN p >= 0.6 THEN (y = 1)::INT END) * 100 AS wp, avg((y = 1)::INT) * 100 AS wr FROM rk GROUP BY 1)
  SELECT lang, round((sr - np * (np + 1) / 2.0::DOUBLE) / nullif(np * nn, 0), 6) + 0.0 AS auc_roc, round(wp, 6) + 0.0 AS win_precision, round(wr, 6) + 0.0 AS win_rate_pct, n_high_conf FROM g""")
def classifier_metrics(spark, sf):
    return show(S.classifier_metrics(_scored(spark, sf), ["lang"]), "auc_roc", "win_precision", "win_rate_pct", "n_high_conf", keys=("lang",))


def _bets(spark, sf):
    """Ticks as model outputs: probability from the flow, return from the price."""
    return ticks(spark, sf).select(
        "symbol", "ts", "id", (F.col("volume") / 100.0).alias("p"), ((F.col("price") - 50) / 500 + F.col("volume") / 10000).alias("r"),
        F.when(F.col("taker") > 25, 1).when(F.col("taker") < 5, 0).otherwise(-1).alias("signal"),
    )


BETS_SQL = f"WITH {TICKS_SQL}, bets AS (SELECT symbol, us AS ts, id, volume / 100.0 AS p, (price - 50) / 500 + volume / 10000 AS r, CASE WHEN taker > 25 THEN 1 WHEN taker < 5 THEN 0 ELSE -1 END AS signal FROM ticks)"
GRID = "[" + ", ".join(repr(t) for t in S.threshold_grid()) + "]"


def _grid_sql(score: str, src: str = "bets", key: str = "symbol") -> str:
    return f"""gr AS (SELECT unnest({GRID}) AS threshold),
  gs AS (SELECT {key}, threshold, count(*) FILTER (p > threshold) AS n_trades, avg(CASE WHEN p > threshold THEN r ELSE 0 END) AS pnl_mean, stddev_pop(CASE WHEN p > threshold THEN r ELSE 0 END) AS pnl_std,
    sqrt(avg(CASE WHEN p > threshold AND r < 0 THEN r * r ELSE 0 END)) AS dstd, sum(CASE WHEN p > threshold THEN r ELSE 0 END) AS pnl FROM {src} CROSS JOIN gr GROUP BY {key}, threshold),
  sco AS (SELECT *, CASE WHEN n_trades >= 5 THEN {score} END AS score FROM gs)"""


@query("threshold_scores", f"{BETS_SQL}, {_grid_sql('pnl_mean / (dstd + 1e-9)')} SELECT symbol, round(threshold, 6) + 0.0 AS threshold, n_trades, round(score, 6) + 0.0 AS score, round(pnl_mean, 6) + 0.0 AS pnl_mean, round(pnl_std, 6) + 0.0 AS pnl_std FROM sco")
def threshold_scores(spark, sf):
    return show(S.threshold_scores(_bets(spark, sf), ["symbol"], "sortino"), "n_trades", "score", "pnl_mean", "pnl_std", keys=("symbol", "threshold"))


@query("best_threshold", f"{BETS_SQL}, {_grid_sql('pnl_mean / (pnl_std + 1e-9)')} SELECT symbol, round(arg_max(threshold, (score, -threshold)), 6) + 0.0 AS best_threshold, round(max(score), 6) + 0.0 AS score, arg_max(n_trades, (score, -threshold)) AS n_trades FROM sco GROUP BY 1")
def best_threshold(spark, sf):
    d = S.best_threshold(S.threshold_scores(_bets(spark, sf), ["symbol"]), ["symbol"])
    return show(d, "best_threshold", "score", "n_trades", keys=("symbol",))


@query("rolling_threshold", f"""{BETS_SQL}, nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) - 1 AS pos FROM bets),
  rf AS (SELECT DISTINCT symbol, pos // 100 AS at FROM nb WHERE pos >= 1000), wi AS (SELECT rf.symbol, rf.at, p, r, rf.symbol || '#' || rf.at AS k FROM rf JOIN nb ON nb.symbol = rf.symbol AND nb.pos >= rf.at * 100 - 1000 AND nb.pos < rf.at * 100),
  {_grid_sql('pnl_mean / (pnl_std + 1e-9)', 'wi', 'k')}, bt AS (SELECT k, arg_max(threshold, (score, -threshold)) FILTER (score IS NOT NULL) AS t FROM sco GROUP BY 1)
  SELECT nb.symbol, nb.ts, nb.id, round(CASE WHEN pos < 1000 THEN 0.5 ELSE coalesce(t, 0.5) END, 6) + 0.0 AS dynamic_threshold FROM nb LEFT JOIN bt ON bt.k = nb.symbol || '#' || (pos // 100)""")
def rolling_threshold(spark, sf):
    b = _bets(spark, sf)
    s = Series.sampled(b, ["symbol"], ["ts", "id"])
    return show(S.rolling_threshold(b, s), "dynamic_threshold", keys=("symbol", "ts", "id"))


@query("approval_sortino", f"""{BETS_SQL}, th AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7]::DOUBLE[]) AS threshold), a AS (SELECT symbol, threshold, r * signal AS x FROM bets CROSS JOIN th WHERE signal <> 0 AND p >= threshold),
  g AS (SELECT symbol, threshold, count(*) AS n, avg(x) AS m, count(*) FILTER (x < 0) AS nn, stddev_pop(x) FILTER (x < 0) AS sd FROM a GROUP BY 1, 2)
  SELECT symbol, threshold, n AS n_trades, round(CASE WHEN n < 10 THEN 0 WHEN nn = 0 THEN m * sqrt(252) * 10 WHEN sd = 0 THEN 0 ELSE m / sd * sqrt(252) END, 5) + 0.0 AS sortino FROM g""")
def approval_sortino(spark, sf):
    d = S.approval_sortino(_bets(spark, sf), ["symbol"], [0.5, 0.55, 0.6, 0.65, 0.7])
    return d.select("symbol", "threshold", "n_trades", r("sortino", 5).alias("sortino"))


@query("probabilistic_sharpe", HOUR + """, m AS (SELECT symbol, avg(ret) AS mu, count(ret) AS n, stddev_samp(ret) AS sd FROM rt GROUP BY 1),
  k AS (SELECT symbol, any_value(n) AS n, any_value(mu / sd) AS sr, avg((ret - mu) ** 3) / avg((ret - mu) ** 2) ** 1.5 AS sk, avg((ret - mu) ** 4) / avg((ret - mu) ** 2) ** 2 AS ku FROM rt JOIN m USING (symbol) WHERE ret IS NOT NULL GROUP BY 1),
  z AS (SELECT *, sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) / sqrt(2.0::DOUBLE) AS x FROM k), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(x)) AS t FROM z)
  SELECT symbol, n, round(sr, 6) + 0.0 AS sr, round(0.5 * (1 + sign(x) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))), 6) + 0.0 AS psr FROM t""")
def probabilistic_sharpe(spark, sf):
    return show(S.probabilistic_sharpe(_rets(spark, sf), ["symbol"]), "n", "sr", "psr", keys=("symbol",))


@query("scenario_classes", f"""WITH {TICKS_SQL}, {bars_sql()}, d AS (SELECT *, ts // 86400000000 AS day, (taker_buy_base / CASE WHEN volume = 0 THEN 1 ELSE volume END - 0.5) / 100 AS funding_rate FROM bars),
  e AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol, day ORDER BY ts), 0) - 1 AS ret FROM d),
  g AS (SELECT symbol, day, count(*) AS n, stddev_samp(ret) AS vol, avg(funding_rate) AS f, arg_max(close, ts) / nullif(arg_min(close, ts), 0) - 1 AS total_return FROM e GROUP BY 1, 2)
  SELECT symbol, day, n, round(vol, 6) + 0.0 AS vol, round(total_return, 6) + 0.0 AS total_return, CASE WHEN n < 10 THEN 'COMPOSITE' WHEN abs(f) > 0.0005 THEN 'FUNDING_SQUEEZE' WHEN vol > 0.03 THEN 'VOLATILE'
    WHEN total_return > 0.05 THEN 'TRENDING_UP' WHEN total_return < -0.05 THEN 'TRENDING_DOWN' WHEN vol < 0.005 THEN 'RANGING' ELSE 'COMPOSITE' END AS scenario FROM g""")
def scenario_classes(spark, sf):
    d = funded_bars(spark, sf).withColumn("day", F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)))
    return show(S.classify_scenarios(d, ["symbol", "day"]), "n", "vol", "total_return", "scenario", keys=("symbol", "day"))
