"""Registered queries: bars and indicator columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.operators import indicators as I
from barflow.functions.numeric import nonzero
from barflow.plans.ordered import Series, windowed
from barflow.plans.recurrence import ewm_series, linear_recurrence
from barflow.queries.base import TICKS_SQL, bar_series, bars, bars_sql, micros, query, r, show, sql_round, table, ticks

WITH_BARS = f"WITH RECURSIVE {TICKS_SQL}, {bars_sql()}"
OHLCV = "open, high, low, close, volume, quote_volume, trades_count, taker_buy_base, taker_buy_quote"


def _bars_out(df):
    return show(df, *OHLCV.split(", "))


def _bars_select(cte: str) -> str:
    rounded = sql_round("open, high, low, close, volume, quote_volume, taker_buy_base, taker_buy_quote")
    return f"SELECT symbol, ts, {rounded}, trades_count FROM {cte}"


for _name, _tf in [("hourly", "1h"), ("15m", "15m"), ("weekly", "1w"), ("monthly", "1mo"), ("second", "1s")]:
    query(f"bars_{_name}", f"WITH {TICKS_SQL}, {bars_sql(_tf)} {_bars_select('bars')}")(
        lambda spark, sf, _tf=_tf: _bars_out(bars(spark, sf, _tf))
    )


@query(
    "bars_cascade",
    "WITH " + ", ".join([TICKS_SQL, *[bars_sql(t, f"b_{t}") for t in ("5m", "1h", "4h", "1d", "1w", "1mo")]])
    + " UNION ALL ".join(
        f" SELECT '{t}' AS timeframe, * FROM ({_bars_select('b_' + t)})" for t in ("5m", "1h", "4h", "1d", "1w", "1mo")
    ),
)
def bars_cascade(spark, sf):
    """Every timeframe from one-minute bars, each built on the coarsest finer one."""
    out = B.resample_all(bars(spark, sf, "1m"), ["5m", "1h", "4h", "1d", "1w", "1mo"])
    return show(out, *OHLCV.split(", "), keys=("symbol", "timeframe", "ts"))


@query(
    "bars_seconds_to_minutes",
    f"""WITH {TICKS_SQL}, {bars_sql('1m')}
    {_bars_select('bars')} WHERE ts >= epoch_us(TIMESTAMP '2024-01-25 00:00:00')""",
)
def bars_seconds_to_minutes(spark, sf):
    newest = F.lit("2024-02-01").cast("timestamp")
    return _bars_out(B.seconds_to_minutes(bars(spark, sf, "1s"), newest, 7))


@query(
    "tick_intensity_features",
    f"""WITH {TICKS_SQL}, {bars_sql('1s', 'secs')}, {bars_sql('1h', 'hours')},
    d AS (SELECT *, ts - ts % 3600000000 AS bar, greatest(volume, 0.0) AS vol FROM secs),
    e AS (SELECT *, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol, bar ORDER BY ts), 0) - 1, 0) AS ret,
            row_number() OVER (PARTITION BY symbol, bar ORDER BY ts) - 1 AS j,
            count(*) OVER (PARTITION BY symbol, bar) AS n,
            row_number() OVER (PARTITION BY symbol, bar ORDER BY vol DESC, ts) AS big FROM d),
    f AS (SELECT symbol, bar, count(*) AS tick_seconds_count, avg(trades_count) AS tick_count_mean,
            quantile_cont(trades_count, 0.95) AS tick_count_p95,
            sum(taker_buy_base) / CASE WHEN sum(volume) = 0 THEN 1e-12 ELSE sum(volume) END AS taker_imbalance,
            coalesce(sum(taker_buy_base) FILTER (j >= n // 2), 0) / greatest(coalesce(sum(vol) FILTER (j >= n // 2), 0), 1e-12)
            - coalesce(sum(taker_buy_base) FILTER (j < greatest(1, n // 2)), 0)
              / greatest(coalesce(sum(vol) FILTER (j < greatest(1, n // 2)), 0), 1e-12) AS taker_imbalance_drift,
            sum((high - low) / greatest(close, 1e-12)) AS intra_bar_volatility,
            sum(vol) FILTER (big <= greatest(1, n // 10)) / CASE WHEN sum(volume) = 0 THEN 1e-12 ELSE sum(volume) END AS volume_concentration,
            sum(sign(ret) * vol) AS signed_volume_drift
          FROM e GROUP BY 1, 2)
    SELECT h.symbol, h.ts, round(h.close, 6) + 0.0 AS close, coalesce(tick_seconds_count, 0) AS tick_seconds_count,
      {', '.join(f'round(coalesce({c}, 0), 6) + 0.0 AS {c}' for c in ('tick_count_mean', 'tick_count_p95', 'taker_imbalance', 'taker_imbalance_drift', 'intra_bar_volatility', 'volume_concentration', 'signed_volume_drift'))}
    FROM hours h LEFT JOIN f ON h.symbol = f.symbol AND h.ts = f.bar""",
)
def tick_intensity_features(spark, sf):
    cols = ["tick_seconds_count", "tick_count_mean", "tick_count_p95", "taker_imbalance", "taker_imbalance_drift",
            "intra_bar_volatility", "volume_concentration", "signed_volume_drift"]
    f = B.tick_intensity(bars(spark, sf, "1s"), "1h")
    return show(B.align_to_bars(bars(spark, sf, "1h"), f, cols), "close", *cols)


def _snapshots(spark, sf):
    """Top-of-book rows from the event stream: bid = price, ask a fixed share above, sizes from the payload."""
    return ticks(spark, sf).select(
        "symbol", "ts", "id", F.col("price").alias("p_bid"), (F.col("price") * 1.001 + 0.01).alias("p_ask"),
        F.col("volume").alias("v_bid"), (100.0 - F.col("taker")).alias("v_ask"),
    )


SNAP_SQL = f"""WITH {TICKS_SQL}, {bars_sql('1h', 'hours')},
snap AS (SELECT symbol, us AS ts, id, price AS p_bid, price * 1.001 + 0.01 AS p_ask, volume AS v_bid, 100.0 - taker AS v_ask FROM ticks),
bk AS (SELECT *, (p_bid + p_ask) / 2 AS mid, v_bid + v_ask AS depth FROM snap),
bf AS (SELECT *, CASE WHEN depth > 0 THEN (p_bid * v_ask + p_ask * v_bid) / depth ELSE mid END AS microprice,
         CASE WHEN mid > 0 THEN (p_ask - p_bid) / mid * 10000 ELSE 0 END AS spread_bps,
         CASE WHEN depth > 0 THEN (v_bid - v_ask) / depth ELSE 0 END AS book_imbalance,
         coalesce((v_bid - lag(v_bid) OVER w) - (v_ask - lag(v_ask) OVER w), 0.0) AS ofi
       FROM bk WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
bg AS (SELECT *, sum(ofi) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ofi_sum FROM bf)"""


@query("orderbook_snapshot_features",
       SNAP_SQL + f" SELECT symbol, ts, id, {sql_round('microprice, spread_bps, book_imbalance, ofi, ofi_sum')} FROM bg")
def orderbook_snapshot_features(spark, sf):
    snap = _snapshots(spark, sf)
    s = Series.sampled(snap, ["symbol"], ["ts", "id"])
    return show(B.book_flow(snap, s), "microprice", "spread_bps", "book_imbalance", "ofi", "ofi_sum", keys=("symbol", "ts", "id"))


@query("orderbook_bar_features", SNAP_SQL + f""",
f AS (SELECT symbol, ts - ts % 3600000000 AS bar, arg_max(microprice, ts) AS l2_microprice, arg_max(spread_bps, ts) AS l2_spread_bps,
  avg(book_imbalance) AS l2_imbalance, arg_max(ofi_sum, ts) AS l2_ofi5, quantile_cont(spread_bps, 0.95) AS l2_spread_p95, count(*) AS l2_count
  FROM bg GROUP BY 1, 2),
j AS (SELECT h.symbol, h.ts, h.close, coalesce(l2_microprice, 0) AS l2_microprice, coalesce(l2_spread_bps, 0) AS l2_spread_bps,
  coalesce(l2_imbalance, 0) AS l2_imbalance, coalesce(l2_ofi5, 0) AS l2_ofi5, coalesce(l2_spread_p95, 0) AS l2_spread_p95, coalesce(l2_count, 0) AS l2_count
  FROM hours h LEFT JOIN f ON h.symbol = f.symbol AND h.ts = f.bar)
SELECT symbol, ts, l2_count, {sql_round('l2_microprice, l2_spread_bps, l2_imbalance, l2_ofi5, l2_spread_p95')},
  round(CASE WHEN close > 0 THEN (l2_microprice - close) / close ELSE 0 END, 6) + 0.0 AS l2_micro_vs_close FROM j""")
def orderbook_bar_features(spark, sf):
    snap = _snapshots(spark, sf)
    s = Series.sampled(snap, ["symbol"], ["ts", "id"])
    out = B.book_features(snap, s, "1h", bars(spark, sf, "1h"))
    return show(out, "l2_count", "l2_microprice", "l2_spread_bps", "l2_imbalance", "l2_ofi5", "l2_spread_p95", "l2_micro_vs_close")


# --- indicators -----------------------------------------------------------------------------------

W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def roll(expr: str, n: int, need: int | None = None) -> str:
    """SQL for an aggregate call over the last n rows, guarded by a count of its first argument."""
    arg = expr[expr.index("(") + 1 : expr.rindex(")")].split(",")[0]
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({arg}) {frame} >= {n if need is None else need} THEN {expr} {frame} END"


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def recursive_ema(name: str, src: str, col: str, alpha: float, start: int = 0) -> str:
    """Recursive CTE (symbol, i, y): the exponential average written as the loop it is."""
    return f"""{name}(symbol, i, y) AS (
      SELECT symbol, i, {col} FROM {src} WHERE i = {start}
      UNION ALL
      SELECT s.symbol, s.i, {1 - alpha!r} * e.y + {alpha!r} * s.{col} FROM {name} e JOIN {src} s ON s.symbol = e.symbol AND s.i = e.i + 1)"""


TR_SQL = f"""trs AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars)"""


def feature_query(name: str, features, cols: str, sql: str, digits: int = 6):
    def run(spark, sf):
        return show(I.add_features(bars(spark, sf), bar_series(), *features()), *cols.split(", "), digits=digits)

    run.__name__ = name
    query(name, sql)(run)


feature_query(
    "indicator_rsi", lambda: [I.rsi(14), I.rsi(7)], "rsi_14, rsi_7",
    WITH_BARS + f""", d AS (SELECT *, close - {lag('close')} AS dd FROM bars),
    gl AS (SELECT *, greatest(dd, 0) AS g, greatest(-dd, 0) AS l FROM d WHERE dd IS NOT NULL),
    """ + ", ".join(recursive_ema(f"{v}{n}", "gl", v, 1 / n, 1) for n in (14, 7) for v in ("g", "l")) + """
    SELECT b.symbol, b.ts, """ + ", ".join(
        f"round(CASE WHEN l{n}.y = 0 AND g{n}.y > 0 THEN 100 WHEN l{n}.y = 0 THEN NULL ELSE 100 - 100 / (1 + g{n}.y / l{n}.y) END, 6) + 0.0 AS rsi_{n}"
        for n in (14, 7)) + """
    FROM bars b """ + " ".join(f"LEFT JOIN {v}{n} ON {v}{n}.symbol = b.symbol AND {v}{n}.i = b.i" for n in (14, 7) for v in ("g", "l")),
)

MACD_SQL = (WITH_BARS + ", " + recursive_ema("f12", "bars", "close", 2 / 13) + ", " + recursive_ema("s26", "bars", "close", 2 / 27)
            + """, line AS (SELECT b.symbol, b.i, b.ts, b.close, f.y - s.y AS macd FROM bars b JOIN f12 f USING (symbol, i) JOIN s26 s USING (symbol, i)), """
            + recursive_ema("sig", "line", "macd", 2 / 10))
feature_query(
    "indicator_macd", lambda: [I.macd()], "macd, macd_signal, macd_hist",
    MACD_SQL + " SELECT l.symbol, l.ts, round(macd, 6) + 0.0 AS macd, round(y, 6) + 0.0 AS macd_signal, round(macd - y, 6) + 0.0 AS macd_hist FROM line l JOIN sig USING (symbol, i)",
)
BB_SQL = f"""bb0 AS (SELECT *, {roll('avg(close)', 20)} AS sma_20, {roll('stddev_samp(close)', 20)} AS std_20 FROM bars),
bb1 AS (SELECT *, sma_20 + 2 * std_20 AS bb_upper, sma_20 - 2 * std_20 AS bb_lower FROM bb0),
bb AS (SELECT *, (close - bb_lower) / CASE WHEN bb_upper - bb_lower = 0 THEN 0.0001 ELSE bb_upper - bb_lower END AS bb_pb FROM bb1)"""
feature_query(
    "indicator_bollinger", lambda: [I.bollinger()], "sma_20, std_20, bb_upper, bb_lower, bb_pb",
    f"{WITH_BARS}, {BB_SQL} SELECT symbol, ts, {sql_round('sma_20, std_20, bb_upper, bb_lower, bb_pb')} FROM bb",
)
feature_query(
    "indicator_roc", lambda: [I.roc(3, 7, 14)], "roc_3, roc_7, roc_14",
    f"{WITH_BARS} SELECT symbol, ts, " + ", ".join(f"round(close / nullif({lag('close', p)}, 0) - 1, 6) + 0.0 AS roc_{p}" for p in (3, 7, 14)) + " FROM bars",
)
feature_query(
    "indicator_atr", lambda: [I.atr()], "tr, atr_14",
    f"{WITH_BARS}, {TR_SQL} SELECT symbol, ts, round(tr, 6) + 0.0 AS tr, round({roll('avg(tr)', 14)}, 6) + 0.0 AS atr_14 FROM trs",
)
feature_query(
    "indicator_adx", lambda: [I.adx()], "plus_di, minus_di, dx, adx_14",
    f"""{WITH_BARS}, {TR_SQL},
    mv AS (SELECT *, {roll('avg(tr)', 14)} AS atr, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM trs),
    dm AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM mv),
    di AS (SELECT *, 100 * ({roll('avg(p)', 14)}) / CASE WHEN atr = 0 THEN 0.0001 ELSE atr END AS plus_di,
                     100 * ({roll('avg(m)', 14)}) / CASE WHEN atr = 0 THEN 0.0001 ELSE atr END AS minus_di FROM dm),
    dxs AS (SELECT *, 100 * abs(plus_di - minus_di) / CASE WHEN plus_di + minus_di = 0 THEN 0.0001 ELSE plus_di + minus_di END AS dx FROM di)
    SELECT symbol, ts, {sql_round('plus_di, minus_di, dx')}, round({roll('avg(dx)', 14)}, 6) + 0.0 AS adx_14 FROM dxs""",
)
feature_query(
    "indicator_flow_imbalance", lambda: [I.flow_imbalance()], "ofi, ofi_z",
    f"""{WITH_BARS}, o AS (SELECT *, taker_buy_base - (volume - taker_buy_base) AS ofi FROM bars),
    z AS (SELECT *, {roll('avg(ofi)', 20)} AS m, {roll('stddev_samp(ofi)', 20)} AS sd FROM o),
    q AS (SELECT *, (ofi - m) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS zz FROM z)
    SELECT symbol, ts, round(ofi, 6) + 0.0 AS ofi, round(CASE WHEN zz < -3 THEN -3 WHEN zz > 3 THEN 3 ELSE zz END, 6) + 0.0 AS ofi_z FROM q""",
)


@query("indicator_cumulative_flow",
       f"{WITH_BARS} SELECT symbol, ts, round(sum(2 * taker_buy_base - volume) OVER (PARTITION BY symbol ORDER BY ts), 4) + 0.0 AS ofi_cumulative FROM bars")
def indicator_cumulative_flow(spark, sf):
    return show(I.add_cumulative_flow(bars(spark, sf), bar_series()), "ofi_cumulative", digits=4)


VWAP_SQL = """vw0 AS (SELECT *, sum((high + low + close) / 3 * volume) OVER d AS pv, sum(volume) OVER d AS v FROM bars
      WINDOW d AS (PARTITION BY symbol, ts // 86400000000 ORDER BY ts)),
    vw AS (SELECT *, pv / CASE WHEN v = 0 THEN 1e-9 ELSE v END AS vwap FROM vw0),
    vwd AS (SELECT *, (close - vwap) / CASE WHEN vwap = 0 THEN 1e-9 ELSE vwap END AS vwap_dist FROM vw)"""


@query("indicator_session_vwap", f"{WITH_BARS}, {VWAP_SQL} SELECT symbol, ts, {sql_round('vwap, vwap_dist', 7)} FROM vwd")
def indicator_session_vwap(spark, sf):
    return show(I.add_session_vwap(bars(spark, sf)), "vwap", "vwap_dist", digits=7)


DON_SQL = f"""dn0 AS (SELECT *, {roll('max(high)', 20)} AS don_upper_20, {roll('min(low)', 20)} AS don_lower_20 FROM bars),
dn AS (SELECT *, (close - don_lower_20) / CASE WHEN don_upper_20 - don_lower_20 = 0 THEN 1e-9 ELSE don_upper_20 - don_lower_20 END AS don_pos_20 FROM dn0)"""
feature_query(
    "indicator_donchian", lambda: [I.donchian()], "don_upper_20, don_lower_20, don_pos_20",
    f"{WITH_BARS}, {DON_SQL} SELECT symbol, ts, {sql_round('don_upper_20, don_lower_20, don_pos_20')} FROM dn",
)
KELT_SQL = f"""{recursive_ema('e20', 'bars', 'close', 2 / 21)}, {TR_SQL},
    kt AS (SELECT t.symbol, t.i, t.ts, t.close, {roll('avg(tr)', 10)} AS a FROM trs t),
    kc0 AS (SELECT kt.*, y AS mid, y + 2.0 * a AS kc_upper, y - 2.0 * a AS kc_lower FROM kt JOIN e20 USING (symbol, i)),
    kc AS (SELECT *, (close - kc_lower) / CASE WHEN kc_upper - kc_lower = 0 THEN 1e-9 ELSE kc_upper - kc_lower END AS kc_pos,
             (kc_upper - kc_lower) / CASE WHEN mid = 0 THEN 1e-9 ELSE mid END AS kc_width FROM kc0)"""
feature_query(
    "indicator_keltner", lambda: [I.keltner()], "kc_upper, kc_lower, kc_pos, kc_width",
    f"{WITH_BARS}, {KELT_SQL} SELECT symbol, ts, {sql_round('kc_upper, kc_lower, kc_pos, kc_width')} FROM kc",
)


@query("indicator_funding_zscore", f"""{WITH_BARS},
    fr AS (SELECT *, (taker_buy_base / CASE WHEN volume = 0 THEN 1 ELSE volume END - 0.5) / 100 AS funding_rate FROM bars),
    z AS (SELECT *, {roll('avg(funding_rate)', 168, 1)} AS m, {roll('stddev_samp(funding_rate)', 168, 1)} AS sd FROM fr),
    q AS (SELECT *, (funding_rate - m) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS zz FROM z)
    SELECT symbol, ts, round(CASE WHEN zz < -4 THEN -4 WHEN zz > 4 THEN 4 ELSE zz END, 6) + 0.0 AS funding_z,
      CAST(CASE WHEN funding_rate > 0.001 THEN 1 ELSE 0 END AS BIGINT) AS funding_positive,
      CAST(CASE WHEN funding_rate < -0.0005 THEN 1 ELSE 0 END AS BIGINT) AS funding_negative FROM q""")
def indicator_funding_zscore(spark, sf):
    d = bars(spark, sf).withColumn("funding_rate", (F.col("taker_buy_base") / nonzero("volume", 1.0) - 0.5) / 100)
    return show(I.add_features(d, bar_series(), I.funding_zscore()), "funding_z", "funding_positive", "funding_negative")


feature_query(
    "indicator_liquidity_proximity", lambda: [I.liquidity_proximity()], "dist_to_supply, dist_to_demand, liq_proximity",
    f"""{WITH_BARS}, {TR_SQL},
    q AS (SELECT *, {roll('avg(tr)', 14)} AS a0, {roll('max(high)', 48)} AS hi, {roll('min(low)', 48)} AS lo FROM trs),
    s AS (SELECT *, (hi - close) / CASE WHEN a0 = 0 THEN 1e-9 ELSE a0 END AS s0, (close - lo) / CASE WHEN a0 = 0 THEN 1e-9 ELSE a0 END AS d0 FROM q),
    c AS (SELECT *, CASE WHEN s0 < 0 THEN 0 WHEN s0 > 10 THEN 10 ELSE s0 END AS dist_to_supply, CASE WHEN d0 < 0 THEN 0 WHEN d0 > 10 THEN 10 ELSE d0 END AS dist_to_demand FROM s)
    SELECT symbol, ts, {sql_round('dist_to_supply, dist_to_demand')}, round(1 / (1 + least(dist_to_supply, dist_to_demand)), 6) + 0.0 AS liq_proximity FROM c""",
)


@query("indicator_standardise", f"""{WITH_BARS},
    st AS (SELECT symbol, avg(close) AS m, stddev_samp(close) AS s, avg(volume) AS mv, stddev_samp(volume) AS sv FROM bars GROUP BY 1)
    SELECT b.symbol, b.ts, round(CASE WHEN s > 0 THEN (close - m) / s ELSE 0 END, 6) + 0.0 AS close_norm,
      round(CASE WHEN sv > 0 THEN (volume - mv) / sv ELSE 0 END, 6) + 0.0 AS volume_norm FROM bars b JOIN st USING (symbol)""")
def indicator_standardise(spark, sf):
    return show(I.standardise(bars(spark, sf), ["close", "volume"]), "close_norm", "volume_norm")


ICHI_SQL = f"""ic0 AS (SELECT *, ({roll('max(high)', 9)} + {roll('min(low)', 9)}) / 2 AS ichimoku_tenkan,
      ({roll('max(high)', 26)} + {roll('min(low)', 26)}) / 2 AS ichimoku_kijun, ({roll('max(high)', 52)} + {roll('min(low)', 52)}) / 2 AS sb FROM bars),
    ic1 AS (SELECT *, (ichimoku_tenkan + ichimoku_kijun) / 2 AS sa FROM ic0),
    ic AS (SELECT *, {lag('sa', 26)} AS ichimoku_senkou_a, {lag('sb', 26)} AS ichimoku_senkou_b,
      lead(close, 26) OVER (PARTITION BY symbol ORDER BY ts) AS ichimoku_chikou FROM ic1)"""
feature_query(
    "indicator_ichimoku", lambda: [I.ichimoku()],
    "ichimoku_tenkan, ichimoku_kijun, ichimoku_senkou_a, ichimoku_senkou_b, ichimoku_chikou, signal_ichimoku",
    f"""{WITH_BARS}, {ICHI_SQL}
    SELECT symbol, ts, {sql_round('ichimoku_tenkan, ichimoku_kijun, ichimoku_senkou_a, ichimoku_senkou_b, ichimoku_chikou')},
      CASE WHEN close > greatest(ichimoku_senkou_a, ichimoku_senkou_b) AND ichimoku_tenkan > ichimoku_kijun THEN 1.0::DOUBLE
           WHEN close < least(ichimoku_senkou_a, ichimoku_senkou_b) AND ichimoku_tenkan < ichimoku_kijun THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS signal_ichimoku FROM ic""",
)
feature_query(
    "indicator_macd_divergence", lambda: [I.macd_divergence()], "macd_cl_cross, macd_divergence, signal_macd_div",
    MACD_SQL + f""", mx AS (SELECT *, {roll('max(macd)', 5)} AS mh, {roll('min(macd)', 5)} AS ml, {roll('max(close)', 5)} AS ph, {roll('min(close)', 5)} AS pl, {lag('macd')} AS pm FROM line),
    my AS (SELECT *, {lag('mh', 5)} AS mh5, {lag('ml', 5)} AS ml5 FROM mx),
    mz AS (SELECT *, CASE WHEN macd > 0 AND pm <= 0 THEN 1.0::DOUBLE WHEN macd < 0 AND pm >= 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS macd_cl_cross,
      CASE WHEN close <= pl AND macd > ml5 THEN 1.0::DOUBLE WHEN close >= ph AND macd < mh5 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS macd_divergence FROM my)
    SELECT symbol, ts, macd_cl_cross, macd_divergence, CASE WHEN macd_cl_cross <> 0 THEN macd_cl_cross ELSE macd_divergence END AS signal_macd_div FROM mz""",
)
feature_query(
    "indicator_kalman", lambda: [I.kalman()], "price_kalman",
    WITH_BARS + """, kf(symbol, i, ts, x, p) AS (
      SELECT symbol, i, ts, close, 1.0::DOUBLE * (1 - 1.0 / (1.0 + 1.0)) + 0.01 FROM bars WHERE i = 0
      UNION ALL
      SELECT b.symbol, b.i, b.ts, k.x + k.p / (k.p + 1.0) * (b.close - k.x), k.p * (1 - k.p / (k.p + 1.0)) + 0.01
      FROM kf k JOIN bars b ON b.symbol = k.symbol AND b.i = k.i + 1)
    SELECT symbol, ts, round(x, 6) + 0.0 AS price_kalman FROM kf""",
)
_FW = ", ".join(repr(w) for w in I.fractional_weights())
feature_query(
    "indicator_fractional_diff", lambda: [I.fractional_diff()], "frac_diff_d40",
    f"""{WITH_BARS}, wts AS (SELECT unnest([{_FW}]) AS w, unnest(range({len(I.fractional_weights())})) AS k),
    dot AS (SELECT b.symbol, b.i, sum(p.close * w) AS y, count(*) AS n FROM bars b CROSS JOIN wts JOIN bars p ON p.symbol = b.symbol AND p.i = b.i - k GROUP BY 1, 2)
    SELECT b.symbol, b.ts, round(CASE WHEN n = {len(I.fractional_weights())} THEN y END, 5) + 0.0 AS frac_diff_d40 FROM bars b JOIN dot USING (symbol, i)""",
    digits=5,
)
REGIME_SQL = f"""rt0 AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM trs), rt AS (SELECT *, {lag('ret')} AS prv FROM rt0),
    rf0 AS (SELECT *, {roll('stddev_samp(ret)', 24)} * sqrt(8760) AS rv, {roll('sum(ret)', 24)} AS rsum, {roll('avg(tr)', 14)} AS a, {roll('avg(volume)', 24)} AS vm,
      {roll('stddev_samp(volume)', 24)} AS vs, count(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING) AS nr,
      corr(ret, prv) OVER (PARTITION BY symbol ORDER BY ts ROWS 22 PRECEDING) AS ac FROM rt),
    rf AS (SELECT symbol, ts, rv, abs(rsum) / CASE WHEN rv = 0 THEN 1e-9 ELSE rv END AS trend_str, a / CASE WHEN close = 0 THEN 1e-9 ELSE close END AS atr_n,
      (volume - vm) / CASE WHEN vs = 0 THEN 1e-9 ELSE vs END AS vol_z, CASE WHEN nr >= 24 THEN ac END AS ret_ac1 FROM rf0)"""
feature_query(
    "indicator_regime_features", lambda: [I.regime_features()], "rv, trend_str, atr_n, vol_z, ret_ac1",
    f"{WITH_BARS}, {TR_SQL}, {REGIME_SQL} SELECT symbol, ts, {sql_round('rv, trend_str, atr_n, vol_z, ret_ac1', 5)} FROM rf", digits=5,
)
feature_query(
    "indicator_trend_flags", lambda: [I.trend_flags()], "trend_strength, vol_regime, is_trending, is_volatile",
    f"""{WITH_BARS}, {recursive_ema('e12', 'bars', 'close', 2 / 13)}, {recursive_ema('e26', 'bars', 'close', 2 / 27)}, {TR_SQL},
    rt AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM trs),
    q AS (SELECT *, {roll('avg(tr)', 14)} AS a, {roll('stddev_samp(ret)', 7)} AS v7, {roll('stddev_samp(ret)', 100, 10)} AS v100 FROM rt),
    s AS (SELECT q.symbol, q.ts, abs(e12.y - e26.y) / CASE WHEN a = 0 THEN 1e-9 ELSE a END AS trend_strength, v7 / CASE WHEN v100 = 0 THEN 1e-9 ELSE v100 END AS vol_regime
      FROM q JOIN e12 USING (symbol, i) JOIN e26 USING (symbol, i))
    SELECT symbol, ts, {sql_round('trend_strength, vol_regime', 5)}, CAST(CASE WHEN trend_strength > 1.5 THEN 1 ELSE 0 END AS BIGINT) AS is_trending,
      CAST(CASE WHEN vol_regime > 1.5 THEN 1 ELSE 0 END AS BIGINT) AS is_volatile FROM s""", digits=5,
)
_SHAPE = ("ret, log_ret, dist_sma_7, dist_sma_30, sma_align, stoch_k, ret_lag_1, ret_lag_2, ret_lag_3, ret_lag_5, volume_momentum, "
          "volume_surge, volume_drop, dist_low_15, dist_low_30, range_pct")
feature_query(
    "indicator_price_shape", lambda: [I.price_shape()], _SHAPE,
    f"""{WITH_BARS}, a AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, ln(close / nullif({lag('close')}, 0)) AS log_ret FROM bars),
    q AS (SELECT *, close / {roll('avg(close)', 7)} - 1 AS dist_sma_7, close / {roll('avg(close)', 30)} - 1 AS dist_sma_30,
      {roll('avg(close)', 50)} AS s50, {roll('avg(close)', 200)} AS s200, {roll('min(low)', 14)} AS l14, {roll('max(high)', 14)} AS h14,
      {roll('avg(volume)', 14)} AS v14, {roll('avg(volume)', 20)} AS v20, close / {roll('min(low)', 15)} - 1 AS dist_low_15, close / {roll('min(low)', 30)} - 1 AS dist_low_30,
      {', '.join(f"{lag('ret', k)} AS ret_lag_{k}" for k in (1, 2, 3, 5))}, (high - low) / close AS range_pct FROM a),
    s AS (SELECT *, 100 * (close - l14) / CASE WHEN h14 - l14 = 0 THEN 0.0001 ELSE h14 - l14 END AS stoch_k, volume / nullif(v14, 0) AS volume_momentum FROM q)
    SELECT symbol, ts, {sql_round('ret, log_ret, dist_sma_7, dist_sma_30, stoch_k, ret_lag_1, ret_lag_2, ret_lag_3, ret_lag_5, volume_momentum, dist_low_15, dist_low_30, range_pct')},
      {', '.join(f'CAST(CASE WHEN {c} THEN 1 ELSE 0 END AS BIGINT) AS {n}' for n, c in (('sma_align', 's50 > s200'), ('volume_surge', 'volume > v20 * 1.5'), ('volume_drop', 'volume < v20 * 0.5')))}
    FROM s""",
)
MICRO_SQL = f"""mi0 AS (SELECT *, coalesce(close / nullif({lag('close')}, 0) - 1, 0) AS ret, taker_buy_base / CASE WHEN volume = 0 THEN 0.0001 ELSE volume END AS share FROM bars),
    mi1 AS (SELECT *, coalesce(abs(ret) / nullif(close * volume, 0), 0) AS raw, (2 * share - 1) * volume AS sv,
      abs(volume * least(greatest(share, 0), 1) - volume * (1 - least(greatest(share, 0), 1))) / nullif(volume * least(greatest(share, 0), 1) + volume * (1 - least(greatest(share, 0), 1)), 0) AS imb FROM mi0),
    mi AS (SELECT *, coalesce({roll('avg(raw)', 30, 7)}, 0) AS amihud_illiq, {roll('covar_samp(ret, sv)', 60, 15)} AS cv, {roll('var_samp(sv)', 60, 15)} AS vr,
      coalesce({roll('avg(imb)', 50, 12)}, 0) AS vpin FROM mi1)"""
feature_query(
    "indicator_microstructure", lambda: [I.amihud(), I.kyle_lambda(), I.vpin()], "amihud_illiq, kyle_lambda, vpin",
    f"{WITH_BARS}, {MICRO_SQL} SELECT symbol, ts, {sql_round('amihud_illiq, vpin')}, round(CASE WHEN vr > 1e-12 THEN cv / vr ELSE 0 END, 6) + 0.0 AS kyle_lambda FROM mi",
)


@query("indicator_on_balance_flow", f"""{WITH_BARS}, a AS (SELECT *, coalesce(sign(close - {lag('close')}), 0) AS dir, coalesce(volume - {lag('volume')}, 0) AS volume_delta,
      row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rk FROM bars),
    o AS (SELECT *, sum(dir * volume) OVER (PARTITION BY symbol ORDER BY ts) AS obv FROM a)
    SELECT symbol, ts, {sql_round('obv, volume_delta', 4)} FROM o WHERE rk <= 1000""")
def indicator_on_balance_flow(spark, sf):
    return show(I.add_on_balance(bars(spark, sf), bar_series(), last_rows=1000), "obv", "volume_delta", digits=4)


feature_query(
    "indicator_volatility_size", lambda: [I.volatility_size(), I.annual_volatility()], "vol_size_mult, signal_mtf_filter, hist_vol, vol_scale",
    f"""{WITH_BARS}, a AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, ln(close / nullif({lag('close')}, 0)) AS lr FROM bars),
    q AS (SELECT *, {roll('stddev_samp(ret)', 5, 2)} AS v5, greatest({roll('stddev_samp(ret)', 60, 10)}, 1e-9) AS v60n, {roll('stddev_samp(ret)', 60, 10)} AS v60,
      {roll('avg(close)', 200, 50)} AS s200, coalesce({roll('stddev_samp(lr)', 30)} * sqrt(8760), 0) AS hist_vol FROM a)
    SELECT symbol, ts, CASE WHEN v60 IS NOT NULL AND v5 / v60n > 1.8 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS vol_size_mult,
      CASE WHEN close > s200 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal_mtf_filter, round(hist_vol, 6) + 0.0 AS hist_vol,
      round(least(greatest(0.5 / greatest(hist_vol, 0.05), 0.25), 3.0), 6) + 0.0 AS vol_scale FROM q""",
)


@query("bars_densified", f"""{WITH_BARS}, ends AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1),
    grid AS (SELECT symbol, unnest(range(a, z + 1, 900000000)) AS ts FROM ends),
    j AS (SELECT g.symbol, g.ts, b.close, b.volume FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts)
    SELECT symbol, ts, round(last_value(close IGNORE NULLS) OVER w, 6) + 0.0 AS close, round(last_value(volume IGNORE NULLS) OVER w, 6) + 0.0 AS volume
    FROM j {W}""")
def bars_densified(spark, sf):
    return show(B.densify(bars(spark, sf), "15m", ["close", "volume"]), "close", "volume")


@query("causality_audit", f"""{WITH_BARS}, {VWAP_SQL},
    a AS (SELECT *, ts < {lag('ts')} AS back, CASE WHEN ts // 86400000000 > {lag('ts')} // 86400000000 THEN abs(vwap - {lag('vwap')}) / CASE WHEN close = 0 THEN 1e-9 ELSE close END END AS jump,
      2 * taker_buy_base - volume AS ofi FROM vw),
    g AS (SELECT symbol, count(*) AS n, coalesce(sum(CASE WHEN back THEN 1 ELSE 0 END), 0) AS backs, max(jump) AS jump, min(ofi) AS lo, max(ofi) AS hi FROM a GROUP BY 1)
    SELECT symbol, 'monotone' AS "check", backs = 0 AS ok FROM g UNION ALL
    SELECT symbol, 'vwap_resets', coalesce(NOT (n > 100 AND jump < 1e-4), TRUE) FROM g UNION ALL
    SELECT symbol, 'flow_varies', coalesce(NOT (n > 100 AND lo = hi), TRUE) FROM g""")
def causality_audit(spark, sf):
    d = I.add_session_vwap(bars(spark, sf)).withColumn("ofi", 2 * F.col("taker_buy_base") - F.col("volume"))
    return I.causal_checks(d, bar_series())


@query("lagged_window_tensor", f"""{WITH_BARS}, t AS (SELECT symbol, ts, i, count(*) OVER p AS np, sum(close) OVER p AS sp, sum(volume) OVER p AS sv,
      first_value(close) OVER p AS oldest, count(*) OVER f AS nf, sum(close) OVER f AS sf, last_value(close) OVER f AS farthest FROM bars
      WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING))
    SELECT symbol, ts, np AS past_len, nf AS future_len, round(sp, 4) + 0.0 AS past_close_sum, round(sv, 4) + 0.0 AS past_volume_sum, round(oldest, 4) + 0.0 AS oldest_close,
      round(sf, 4) + 0.0 AS future_sum, round(farthest, 4) + 0.0 AS farthest_close FROM t WHERE np = 168 AND nf = 24""")
def lagged_window_tensor(spark, sf):
    d = I.lagged_windows(bars(spark, sf), bar_series(), ["close", "volume"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return d.select(
        "symbol", micros().alias("ts"), F.size("past").cast("bigint").alias("past_len"), F.size("future").cast("bigint").alias("future_len"),
        r(total(F.col("past.close")), 4).alias("past_close_sum"), r(total(F.col("past.volume")), 4).alias("past_volume_sum"),
        r(F.element_at("past.close", 1), 4).alias("oldest_close"), r(total(F.col("future")), 4).alias("future_sum"),
        r(F.element_at("future", -1), 4).alias("farthest_close"),
    )


@query("ema_over_ticks", f"""WITH RECURSIVE {TICKS_SQL}, o AS (SELECT symbol, us AS ts, id, price, row_number() OVER (PARTITION BY symbol ORDER BY us, id) - 1 AS i FROM ticks),
    {recursive_ema('e', 'o', 'price', 0.1)} SELECT o.symbol, ts, id, round(y, 6) + 0.0 AS ema FROM o JOIN e USING (symbol, i)""")
def ema_over_ticks(spark, sf):
    """A recurrence straight over the raw stream: irregular time, equal-depth cuts."""
    t = ticks(spark, sf)
    s = Series.sampled(t, ["symbol"], ["ts", "id"])
    return show(ewm_series(t, s, "price", 0.1, "ema"), "ema", keys=("symbol", "ts", "id"))


@query("linear_recurrence_varying_decay", f"""WITH RECURSIVE {TICKS_SQL}, o AS (SELECT symbol, us AS ts, id, price, volume / 100.0 AS a, row_number() OVER (PARTITION BY symbol ORDER BY us, id) - 1 AS i FROM ticks),
    e(symbol, i, y) AS (SELECT symbol, i, price FROM o WHERE i = 0 UNION ALL SELECT o.symbol, o.i, o.a * e.y + o.price FROM e JOIN o ON o.symbol = e.symbol AND o.i = e.i + 1)
    SELECT o.symbol, ts, id, round(y, 5) + 0.0 AS y FROM o JOIN e USING (symbol, i)""")
def linear_recurrence_varying_decay(spark, sf):
    t = ticks(spark, sf)
    s = Series.sampled(t, ["symbol"], ["ts", "id"])
    return show(linear_recurrence(t, s, F.col("volume") / 100.0, F.col("price"), "y"), "y", keys=("symbol", "ts", "id"), digits=5)
