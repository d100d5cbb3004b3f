"""Indicators against pandas twins on blocks of 60 rows, and causality by truncation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import indicators as I
from barflow.operators import paths, signals
from barflow.plans.ordered import Series

S60 = Series.on_grid(["symbol"], "ts", 3600, rows=60)


def run(df, *features, s=S60):
    return I.add_features(df, s, *features).toPandas().sort_values(["symbol", "ts"], ignore_index=True)


def by_symbol(pdf, fn):
    p = pdf.sort_values(["symbol", "ts"], ignore_index=True)
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in p.groupby("symbol", sort=True)], ignore_index=True)


def same(got, want, tol=1e-7):
    assert np.allclose(got.astype(float), want.astype(float), atol=tol, rtol=1e-7, equal_nan=True)


def true_range(g):
    prev = g.close.shift(1)
    return pd.concat([g.high - g.low, (g.high - prev).abs(), (g.low - prev).abs()], axis=1).max(axis=1)


def twin_rsi(g):
    d = g.close.diff()
    up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    return 100 - 100 / (1 + up / down)


def twin_macd_hist(g):
    line = g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()
    return line - line.ewm(span=9, adjust=False).mean()


def twin_adx(g):
    up, down = g.high.diff(), -g.low.diff()
    p = up.where((up > down) & (up > 0), 0.0).rolling(14).mean()
    m = down.where((down > up) & (down > 0), 0.0).rolling(14).mean()
    a = true_range(g).rolling(14).mean()
    pdi, mdi = 100 * p / a, 100 * m / a
    return (100 * (pdi - mdi).abs() / (pdi + mdi).replace(0, 1e-4)).rolling(14).mean()


def twin_keltner(g):
    mid, a = g.close.ewm(span=20, adjust=False).mean(), true_range(g).rolling(10).mean()
    return (g.close - (mid - 2 * a)) / (4 * a).replace(0, 1e-9)


def twin_kalman(g):
    x, p, out = g.close.iloc[0], 1.0, []
    for z in g.close:
        k = p / (p + 1.0)
        x, p = x + k * (z - x), p * (1 - k) + 0.01
        out.append(x)
    return pd.Series(out)


def twin_fractional(g):
    w = np.array(I.fractional_weights()[::-1])
    v = g.close.to_numpy()
    return pd.Series([np.nan if i < len(w) - 1 else w @ v[i - len(w) + 1 : i + 1] for i in range(len(v))])


def twin_autocorrelation(g):
    return g.close.pct_change().rolling(24).apply(lambda x: pd.Series(x).autocorr(1))


def twin_kyle(g):
    ret = g.close.pct_change().fillna(0.0)
    sv = (2 * g.taker_buy_base / g.volume.replace(0, 1e-4) - 1) * g.volume
    var = sv.rolling(60, min_periods=15).var()
    return (ret.rolling(60, min_periods=15).cov(sv) / var.where(var > 1e-12)).fillna(0.0)


CASES = [
    (I.rsi(14), "rsi_14", twin_rsi), (I.macd(), "macd_hist", twin_macd_hist), (I.adx(), "adx_14", twin_adx), (I.keltner(), "kc_pos", twin_keltner),
    (I.kalman(), "price_kalman", twin_kalman), (I.fractional_diff(), "frac_diff_d40", twin_fractional), (I.regime_features(), "ret_ac1", twin_autocorrelation),
    (I.kyle_lambda(), "kyle_lambda", twin_kyle), (I.bollinger(), "std_20", lambda g: g.close.rolling(20).std()),
    (I.ichimoku(), "ichimoku_senkou_b", lambda g: ((g.high.rolling(52).max() + g.low.rolling(52).min()) / 2).shift(26)),
    (I.ichimoku(), "ichimoku_chikou", lambda g: g.close.shift(-26)), (I.roc(7), "roc_7", lambda g: g.close.pct_change(7)),
    (I.volatility_size(), "vol_size_mult", lambda g: pd.Series(np.where(
        g.close.pct_change().rolling(5, min_periods=2).std() / g.close.pct_change().rolling(60, min_periods=10).std().clip(lower=1e-9) > 1.8, 0.5, 1.0))),
]


@pytest.mark.parametrize("feature,column,twin", CASES, ids=[c[1] for c in CASES])
def test_matches_pandas(walk, feature, column, twin):
    df, pdf = walk
    same(run(df, feature)[column], by_symbol(pdf, twin))


def test_many_features_in_one_pass_equal_single_passes(walk):
    df, _ = walk
    together = run(df, I.rsi(14), I.macd(), I.adx(), I.donchian())
    for f, c in ((I.rsi(14), "rsi_14"), (I.macd(), "macd"), (I.donchian(), "don_pos_20")):
        same(together[c], run(df, f)[c])


CAUSAL = [I.rsi(14), I.macd(), I.bollinger(), I.atr(), I.adx(), I.flow_imbalance(), I.donchian(), I.keltner(), I.funding_zscore(), I.liquidity_proximity(),
          I.macd_divergence(), I.kalman(), I.fractional_diff(), I.regime_features(), I.trend_flags(), I.price_shape(), I.amihud(), I.kyle_lambda(), I.vpin()]


def test_values_do_not_change_when_the_future_is_cut(walk):
    df, _ = walk
    cut = pd.Timestamp("2025-01-10")
    whole = run(df, *CAUSAL)
    part = run(df.where(F.col("ts") < F.lit(cut)), *CAUSAL)
    whole = whole[whole.ts < cut].reset_index(drop=True)
    for c in whole.select_dtypes("number").columns:
        same(part[c], whole[c])


def test_flat_series_has_no_rsi_and_rising_has_100(spark):
    ts = pd.date_range("2025-01-01", periods=30, freq="1h")
    flat = pd.DataFrame({"symbol": "F", "ts": ts, "close": 5.0})
    up = pd.DataFrame({"symbol": "U", "ts": ts, "close": np.arange(30.0) + 1})
    got = run(spark.createDataFrame(pd.concat([flat, up])), I.rsi(14))
    assert got[got.symbol == "F"]["rsi_14"].isna().all()
    assert (got[got.symbol == "U"]["rsi_14"].iloc[1:] == 100).all()


def twin_supertrend(g, period=10, mult=3.0):
    a, mid = mult * true_range(g).rolling(period).mean(), (g.high + g.low) / 2
    bu, bl, c = (mid + a).to_numpy(), (mid - a).to_numpy(), g.close.to_numpy()
    fu, fl, d, rows = bu[0], bl[0], 1, [(np.nan, 1.0)]
    for i in range(1, len(c)):
        pu, pl = fu, fl
        if not np.isnan(bu[i]):
            fu = bu[i] if np.isnan(pu) or bu[i] < pu or c[i - 1] > pu else pu
            fl = bl[i] if np.isnan(pl) or bl[i] > pl or c[i - 1] < pl else pl
        d = 1 if not np.isnan(pu) and c[i] > pu else -1 if not np.isnan(pl) and c[i] < pl else d
        rows.append((fl if d == 1 else fu, float(d)))
    return pd.DataFrame(rows, columns=["line", "dir"])


def test_supertrend_over_many_blocks(walk):
    df, pdf = walk
    for rows in (25, 60, 5000):
        got = paths.supertrend(df, Series.on_grid(["symbol"], "ts", 3600, rows=rows)).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
        want = by_symbol(pdf, twin_supertrend)
        same(got["supertrend"], want["line"])
        same(got["supertrend_dir"], want["dir"])


def twin_zigzag(g, dev):
    high, low, ts = g.high.to_numpy(), g.low.to_numpy(), g.ts
    up, last, kind, out = True, 0, "unknown", []
    for i in range(1, len(g)):
        if up:
            if high[i] > high[last]:
                last, kind = i, "high"
            elif high[last] > low[i] / (1 - dev):
                out.append((last, kind))
                last, kind, up = i, "low", False
        elif low[i] < low[last]:
            last, kind = i, "low"
        elif low[last] < high[i] / (1 + dev):
            out.append((last, kind))
            last, kind, up = i, "high", True
    out.append((last, kind))
    return [(ts[i], k, low[i] if k == "low" else high[i]) for i, k in out]


def test_zigzag_over_many_blocks(walk):
    df, pdf = walk
    for rows in (20, 77, 5000):
        got = paths.zigzag(df, Series.on_grid(["symbol"], "ts", 3600, rows=rows), 0.02).toPandas()
        for sym, g in pdf.groupby("symbol"):
            want = twin_zigzag(g.reset_index(drop=True), 0.02)
            mine = got[got.symbol == sym].sort_values("ts")
            assert list(zip(mine.ts, mine.kind, mine.price)) == want


def test_recent_rows_and_decay(spark, walk):
    df, pdf = walk
    got = I.recent_rows(df, S60, 100).groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("a")).toPandas().set_index("symbol")
    assert got["n"].to_dict() == {"HOT": 100, "COLD": 90}
    assert got.loc["HOT", "a"] == pdf[pdf.symbol == "HOT"].ts.sort_values().iloc[-100]
    d = signals.decay_signal(df.withColumn("s", F.when(F.col("volume") > 50, 1.0).when(F.col("volume") < 20, -1.0).otherwise(0.0)), S60, "s").toPandas()
    ok = d.dropna(subset=["bars_held"])
    assert np.allclose(ok.decayed_signal.abs(), np.exp(-0.1 * ok.bars_held.astype(float)))
    assert (ok.should_exit == (ok.decayed_signal.abs() < 0.2)).all()


def test_cross_section_needs_three_assets(walk):
    df, _ = walk
    got = signals.cross_sectional_momentum(df, S60).toPandas()
    assert (got.momentum_signal == 0).all()


def test_fractional_weights_stop_at_width():
    w = I.fractional_weights()
    assert len(w) == 100 and w[0] == 1.0 and math.isclose(w[1], -0.4)
