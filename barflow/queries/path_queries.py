"""Registered queries: path-dependent indicators and the trade ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import ledger as L
from barflow.operators import paths as P
from barflow.operators import signals as S
from barflow.plans.ordered import Series, with_position
from barflow.queries.base import bar_series, bars, query, show, sql_round
from barflow.queries.indicator_queries import TR_SQL, WITH_BARS, lag, roll
from barflow.queries.label_queries import SIGNALS_SQL, funded_bars
from barflow.session import reliable_checkpoint

STRATEGIES = ["signal_rsi", "signal_macd", "signal_bb", "signal_ensemble", "signal_vwap", "signal_donchian", "signal_keltner", "signal_ensemble_b"]


@query("indicator_supertrend", WITH_BARS + f""", {TR_SQL}, st0 AS (SELECT symbol, i, ts, close, {lag('close')} AS prev, (high + low) / 2 + 3.0 * {roll('avg(tr)', 10)} AS bu, (high + low) / 2 - 3.0 * {roll('avg(tr)', 10)} AS bl FROM trs),
  st(symbol, i, ts, fu, fl, pu, pl, d, pd) AS (SELECT symbol, i, ts, bu, bl, NULL::DOUBLE, NULL::DOUBLE, 1, NULL::INT FROM st0 WHERE i = 0 UNION ALL
    SELECT b.symbol, b.i, b.ts, CASE WHEN b.bu IS NULL THEN s.fu WHEN s.fu IS NULL OR b.bu < s.fu OR b.prev > s.fu THEN b.bu ELSE s.fu END,
      CASE WHEN b.bl IS NULL THEN s.fl WHEN s.fl IS NULL OR b.bl > s.fl OR b.prev < s.fl THEN b.bl ELSE s.fl END, s.fu, s.fl,
      CASE WHEN s.fu IS NOT NULL AND b.close > s.fu THEN 1 WHEN s.fl IS NOT NULL AND b.close < s.fl THEN -1 ELSE s.d END, s.d FROM st s JOIN st0 b ON b.symbol = s.symbol AND b.i = s.i + 1)
  SELECT symbol, ts, round(CASE WHEN i > 0 THEN CASE WHEN d = 1 THEN fl ELSE fu END END, 6) + 0.0 AS supertrend, d::DOUBLE AS supertrend_dir, CASE WHEN d = 1 AND pd = -1 THEN 1.0::DOUBLE WHEN d = -1 AND pd = 1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS signal_supertrend FROM st""")
def indicator_supertrend(spark, sf):
    return show(P.supertrend(bars(spark, sf), bar_series()), "supertrend", "supertrend_dir", "signal_supertrend")


@query("zigzag_pivots", WITH_BARS + """, z(symbol, i, up, ph, pl, pt, pk, e_h, e_l, e_t, e_k) AS (SELECT symbol, i, TRUE, high, low, ts, 'unknown', NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::VARCHAR FROM bars WHERE i = 0 UNION ALL
    SELECT b.symbol, b.i, n.up, CASE WHEN n.mv THEN b.high ELSE z.ph END, CASE WHEN n.mv THEN b.low ELSE z.pl END, CASE WHEN n.mv THEN b.ts ELSE z.pt END, CASE WHEN n.mv THEN CASE WHEN n.up THEN 'high' ELSE 'low' END ELSE z.pk END,
      CASE WHEN n.up <> z.up THEN z.ph END, CASE WHEN n.up <> z.up THEN z.pl END, CASE WHEN n.up <> z.up THEN z.pt END, CASE WHEN n.up <> z.up THEN z.pk END
    FROM z JOIN bars b ON b.symbol = z.symbol AND b.i = z.i + 1,
      LATERAL (SELECT CASE WHEN z.up THEN b.high > z.ph OR z.ph > b.low / 0.95 ELSE b.low < z.pl OR z.pl < b.high / 1.05 END AS mv, CASE WHEN z.up THEN b.high > z.ph OR NOT z.ph > b.low / 0.95 ELSE NOT b.low < z.pl AND z.pl < b.high / 1.05 END AS up) n),
  o AS (SELECT symbol, e_t AS ts, CASE WHEN e_k = 'low' THEN e_l ELSE e_h END AS price, e_k AS kind FROM z WHERE e_t IS NOT NULL
    UNION ALL SELECT symbol, arg_max(pt, i), CASE WHEN arg_max(pk, i) = 'low' THEN arg_max(pl, i) ELSE arg_max(ph, i) END, arg_max(pk, i) FROM z GROUP BY symbol)
  SELECT symbol, ts, round(price, 6) + 0.0 AS price, kind FROM o""")
def zigzag_pivots(spark, sf):
    return show(P.zigzag(bars(spark, sf), bar_series()), "price", "kind")


def strategy_bars(spark, sf):
    """Signals of every strategy, one row per (symbol, strategy, bar)."""
    numbered = with_position(funded_bars(spark, sf), bar_series(), size="_n")
    d = S.strategy_frame(numbered, bar_series())
    d = d.select("symbol", "ts", "_pos", "_n", "close", "funding_rate", F.col("vol_size_mult").alias("size_mult"), F.col("signal_mtf_filter").alias("side_filter"), *STRATEGIES)
    return L.melt_signals(reliable_checkpoint(d), STRATEGIES)


def strategy_series():
    s = bar_series()
    return Series(("symbol", "strategy"), s.order, s.cuts, s.rows)


# The ledger as a loop over bars: state of a series after each bar, with the trade that ended on it.  ``lb`` has one row for each bar of a series.
def _melted(by: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT symbol, '{x}' AS strategy, i, ts, close, funding_rate, vol_size_mult AS mult, signal_mtf_filter AS side, {x} AS signal FROM signals" for x in STRATEGIES)
    return f"lb0 AS MATERIALIZED ({parts})"


_PNL = "(({z}) - m.px) / m.px * m.dir * m.size - m.size * 0.0004 - m.size * {fee} - m.fund"


def _ledger_sql(slip: str = "least(0.005, 0.001 * sqrt(greatest({size}, 1.0) / 50000.0))") -> str:
    """``st``: position, equity and the trade closed at each bar; ``t``: all trades; ``eq``: equity at each bar."""
    z = f"n.close * (1 - ({slip.format(size='m.size')}) * m.dir)"
    return f"""
  keyed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY symbol, strategy, fold) AS k, lag(signal, 1, 0.0::DOUBLE) OVER (PARTITION BY symbol, strategy, fold ORDER BY i) AS s, max(i) OVER (PARTITION BY symbol, strategy, fold) AS last FROM lb),
  st(k, i, dir, held, e, px, size, fund, eq, x_e, x_dir, x_px, x_out, x_size, x_fees, x_fund, x_pnl) AS (
    SELECT k, -1::BIGINT, 0, 0, -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 10000.0::DOUBLE, NULL::BIGINT, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT k FROM keyed)
    UNION ALL
    SELECT k, i, CASE WHEN opens THEN nd ELSE hd END, CASE WHEN opens THEN 0 ELSE held END, CASE WHEN opens THEN i ELSE e END, CASE WHEN opens THEN close * (1 + ({slip.format(size='nsize')}) * nd) ELSE px END,
      CASE WHEN opens THEN nsize ELSE size END, CASE WHEN opens THEN 0.0 ELSE fund END, eq, CASE WHEN ends THEN e END, dir, px, zout, size, fees, fund, pnl
    FROM (SELECT *, hd = 0 AND abs(s) > 0.1 AND eq > 0 AND NOT (s > 0.1 AND side < 0) AND NOT (s < -0.1 AND side > 0) AS opens, CASE WHEN s > 0 THEN 1 ELSE -1 END AS nd, eq * 0.1 * mult AS nsize
      FROM (SELECT m.*, n.i, n.s, n.close, n.side, n.mult, {z} AS zout, m.size * 0.0004 + m.size * 0.0002 AS fees, {_PNL.format(z=z, fee='0.0002')} AS pnl, m.ends0 AS ends,
          CASE WHEN m.ends0 THEN 0 ELSE m.dir END AS hd, m.eq0 + CASE WHEN m.ends0 THEN {_PNL.format(z=z, fee='0.0002')} ELSE 0 END AS eq
        FROM keyed n JOIN LATERAL (SELECT st.k, st.dir, st.e, st.px, st.size, st.eq AS eq0, st.fund + CASE WHEN st.dir <> 0 THEN abs(n.funding_rate) * st.size ELSE 0 END AS fund, st.held + 1 AS held,
            st.dir <> 0 AND ((st.dir = 1 AND n.s < -0.1) OR (st.dir = -1 AND n.s > 0.1) OR st.held + 1 >= 48) AS ends0 FROM st WHERE st.k = n.k AND st.i = n.i - 1) m ON TRUE))),
  t AS (SELECT k, i AS x, x_e AS e, x_dir AS dir, x_px AS px, x_out AS out, x_size AS size, x_fees AS fees, x_fund AS fund, x_pnl AS pnl, eq AS equity, FALSE AS forced FROM st WHERE x_e IS NOT NULL
    UNION ALL SELECT m.k, m.i, m.e, m.dir, m.px, {z}, m.size, m.size * 0.0004 + m.size * 0.0004, m.fund, {_PNL.format(z=z, fee='0.0004')}, m.eq + {_PNL.format(z=z, fee='0.0004')}, TRUE
      FROM st m JOIN keyed n ON n.k = m.k AND n.i = m.i WHERE m.i = n.last AND m.dir <> 0),
  eq AS (SELECT st.k, st.i, coalesce(f.equity, st.eq) AS equity FROM st LEFT JOIN t f ON f.forced AND f.k = st.k AND f.x = st.i WHERE st.i >= 0),
  rets AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY k ORDER BY i), 0) - 1 AS r, max(equity) OVER (PARTITION BY k ORDER BY i) AS peak FROM eq),
  cv AS (SELECT k, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS dn, min((equity - peak) / peak) AS dd, arg_max(equity, i) / arg_min(equity, i) AS grown, count(*) AS n FROM rets GROUP BY k),
  mo AS (SELECT k, count(*) AS n_trades, sum(pnl) AS pnl, sum(fees + fund) AS fees, avg(CASE WHEN pnl > 0 THEN 100.0::DOUBLE ELSE 0 END) AS wins, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS g, abs(sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END)) AS l FROM t GROUP BY k),
  pf AS (SELECT k, n_trades, ROUND(pnl, 2) AS total_pnl, ROUND(pnl + fees, 2) AS gross_pnl, ROUND(fees, 2) AS total_fees, ROUND(wins, 1) AS win_rate_pct, ROUND(CASE WHEN sd > 0 THEN sqrt(8760) * m / sd ELSE 0 END, 3) AS sharpe,
    ROUND(CASE WHEN dn > 0 THEN sqrt(8760) * m / dn ELSE 0 END, 3) AS sortino, ROUND(CASE WHEN abs(dd) > 0 THEN (pow(grown, 8760.0 / n) - 1) / abs(dd) ELSE 0 END, 3) AS calmar, ROUND(dd * 100, 2) AS max_drawdown_pct,
    CASE WHEN l > 0 THEN ROUND(g / l, 2) ELSE 'inf'::DOUBLE END AS profit_factor FROM mo JOIN cv USING (k))"""


_PF = "n_trades, total_pnl, gross_pnl, total_fees, win_rate_pct, sharpe, sortino, calmar, max_drawdown_pct, profit_factor"
_NAMED = "JOIN (SELECT DISTINCT k, symbol, strategy, fold FROM keyed) USING (k)"


def _backtest_sql(**how) -> str:
    return f"{SIGNALS_SQL}, {_melted()}, lb AS (SELECT *, 0 AS fold FROM lb0), {_ledger_sql(**how)}"


_FOLDS = """sz AS (SELECT *, greatest(48, n // 7) AS len FROM (SELECT symbol, strategy, count(*) AS n FROM lb0 GROUP BY 1, 2)),
  lb AS (SELECT symbol, strategy, lb0.i - (f + 1) * len AS i, ts, close, funding_rate, mult, side, signal, f AS fold FROM lb0 JOIN sz USING (symbol, strategy), range(5) t(f)
    WHERE lb0.i >= (f + 1) * len AND lb0.i < least((f + 2) * len, n) AND least((f + 2) * len, n) - (f + 1) * len >= 20)"""


@query("trade_ledger", f"""{_backtest_sql()} SELECT a.symbol, a.strategy, a.ts AS entry_ts, z.ts AS exit_ts, dir::BIGINT AS direction, {sql_round('px', 6).replace('AS px', 'AS entry_price')}, round(out, 6) + 0.0 AS exit_price,
    round(size, 6) + 0.0 AS size, round(fees, 6) + 0.0 AS fees, round(fund, 6) + 0.0 AS funding, round(pnl, 6) + 0.0 AS pnl, round(equity, 6) + 0.0 AS equity, forced
  FROM t JOIN keyed a ON a.k = t.k AND a.i = t.e JOIN keyed z ON z.k = t.k AND z.i = t.x""")
def trade_ledger(spark, sf):
    s = strategy_series()
    t = L.size_trades(L.position_trades(strategy_bars(spark, sf), s), s)
    return show(t, "entry_ts", "exit_ts", "direction", "entry_price", "exit_price", "size", "fees", "funding", "pnl", "equity", "forced", keys=("symbol", "strategy"))


@query("backtest_performance", f"{_backtest_sql()} SELECT symbol, strategy, {_PF} FROM pf {_NAMED}")
def backtest_performance(spark, sf):
    return L.backtest(strategy_bars(spark, sf), strategy_series())[1]


@query("backtest_performance_flat_slippage", f"{_backtest_sql(slip='0.0005')} SELECT symbol, strategy, {_PF} FROM pf {_NAMED}")
def backtest_performance_flat_slippage(spark, sf):
    return L.backtest(strategy_bars(spark, sf), strategy_series(), slippage=0.0005)[1]


@query("backtest_walk_forward", f"""{SIGNALS_SQL}, {_melted()}, {_FOLDS}, {_ledger_sql()}, fs AS (SELECT symbol, strategy, fold, coalesce(sharpe, 0) AS sharpe, coalesce(total_pnl, 0) AS total_pnl FROM (SELECT DISTINCT k, symbol, strategy, fold FROM keyed) LEFT JOIN pf USING (k))
  SELECT symbol, strategy, count(*) AS n_folds, ROUND(avg(sharpe), 3) AS wf_mean_sharpe, ROUND(stddev_pop(sharpe), 3) AS wf_std_sharpe, ROUND(avg(total_pnl), 2) AS wf_mean_pnl,
    ROUND(avg(CASE WHEN total_pnl > 0 THEN 1.0::DOUBLE ELSE 0 END), 2) AS wf_consistency, ROUND(arg_max(total_pnl, fold) - arg_min(total_pnl, fold), 2) AS wf_decay FROM fs GROUP BY 1, 2""")
def backtest_walk_forward(spark, sf):
    return L.walk_forward(strategy_bars(spark, sf), strategy_series())
