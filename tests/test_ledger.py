"""The block-parallel ledger against a plain loop, and its invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import ledger as G
from barflow.plans.ordered import Series


def market(spark, n=400, seed=1, hot=1.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "symbol": "A", "ts": pd.date_range("2025-01-01", periods=n, freq="1h"), "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.02 * hot, n))),
        "signal": rng.choice([0.0, 0.05, 1.0, -1.0, 0.33, -0.33], n, p=[0.6, 0.2, 0.05, 0.05, 0.05, 0.05]), "funding_rate": rng.normal(0, 1e-4, n),
        "size_mult": rng.choice([1.0, 0.5], n), "side_filter": rng.choice([1.0, -1.0, 0.0], n),
    })
    return spark.createDataFrame(pdf), pdf


def loop(pdf, hold, slippage=None, initial=10_000.0):
    """The ledger rules as the obvious per-bar loop."""
    slip = lambda size: slippage if slippage is not None else min(0.005, 0.001 * math.sqrt(max(size, 1) / 50_000))
    equity, pos, trades, curve = initial, None, [], []
    signal = pdf.signal.shift(1).fillna(0.0).to_numpy()
    for i, row in enumerate(pdf.itertuples()):
        s = signal[i]
        if pos:
            pos["fund"] += abs(row.funding_rate) * pos["size"]
            pos["held"] += 1
            if (pos["dir"] == 1 and s < -0.1) or (pos["dir"] == -1 and s > 0.1) or pos["held"] >= hold:
                out = row.close * (1 - slip(pos["size"]) * pos["dir"])
                pnl = (out - pos["px"]) / pos["px"] * pos["dir"] * pos["size"] - pos["size"] * (0.0004 + 0.0002) - pos["fund"]
                equity += pnl
                trades.append((pos["i"], i, pos["dir"], pnl, False))
                pos = None
        if pos is None and abs(s) > 0.1 and equity > 0:
            if not ((s > 0 and row.side_filter < 0) or (s < 0 and row.side_filter > 0)):
                d, size = (1 if s > 0 else -1), equity * 0.1 * row.size_mult
                pos = {"dir": d, "px": row.close * (1 + slip(size) * d), "size": size, "i": i, "held": 0, "fund": 0.0}
        curve.append(equity)
    if pos:
        i = len(pdf) - 1
        out = pdf.close.iloc[-1] * (1 - slip(pos["size"]) * pos["dir"])
        pnl = (out - pos["px"]) / pos["px"] * pos["dir"] * pos["size"] - pos["size"] * 0.0008 - pos["fund"]
        equity += pnl
        trades.append((pos["i"], i, pos["dir"], pnl, True))
        curve[-1] = equity
    return trades, curve


@pytest.mark.parametrize("rows", [30, 5000])
@pytest.mark.parametrize("slippage", [None, 0.0005])
def test_ledger_equals_loop(spark, rows, slippage):
    df, pdf = market(spark)
    s = Series.on_grid(["symbol"], "ts", 3600, rows=rows)
    t = G.size_trades(G.position_trades(df, s, 20), s, slippage=slippage)
    got = t.toPandas().sort_values(["exit_pos", "entry_pos"], ignore_index=True)
    trades, curve = loop(pdf, 20, slippage)
    assert [(a, z, d, f) for a, z, d, _, f in trades] == list(zip(got.entry_pos, got.exit_pos, got.direction, got.forced))
    assert np.allclose(got.pnl, [x[3] for x in trades])
    eq = G.bar_equity(df, t, s).orderBy("ts").toPandas()["equity"]
    assert np.allclose(eq, curve)
    assert math.isclose(got.pnl.sum(), eq.iloc[-1] - 10_000.0, rel_tol=1e-9)


def test_at_most_one_open_position(spark):
    df, _ = market(spark, seed=2)
    s = Series.on_grid(["symbol"], "ts", 3600, rows=40)
    got = G.position_trades(df, s, 15).orderBy("entry_pos").toPandas()
    assert (got.entry_pos.iloc[1:].to_numpy() >= got.exit_pos.iloc[:-1].to_numpy()).all()
    assert ((got.exit_pos - got.entry_pos) <= 15).all()


def test_nothing_trades_after_ruin(spark):
    ts = pd.date_range("2025-01-01", periods=12, freq="1h")
    close = [1.0, 1.0, 1.0, 60.0, 60.0, 60.0] + [60.0] * 6
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": ts, "close": close, "signal": [-1.0, 0, 1.0, 0, -1.0, 1, -1, 1, -1, 1, -1, 1]}))
    s = Series.on_grid(["symbol"], "ts", 3600, rows=5)
    for slippage in (None, 0.0):
        got = G.size_trades(G.position_trades(df, s, 48), s, share=0.5, slippage=slippage).toPandas()
        assert len(got) == 1 and got.equity.iloc[0] < 0


def test_backtest_and_walk_forward_tables(spark):
    df, pdf = market(spark, 500)
    s = Series.on_grid(["symbol"], "ts", 3600, rows=60)
    trades, perf = G.backtest(df, s, 20)
    row = perf.first()
    want, curve = loop(pdf, 20)
    assert row["n_trades"] == len(want) == trades.count()
    rets = pd.Series(curve).pct_change().dropna()
    assert row["sharpe"] == pytest.approx(round(math.sqrt(8760) * rets.mean() / rets.std(), 3), abs=1e-3)
    dd = (pd.Series(curve) / pd.Series(curve).cummax() - 1).min()
    assert row["max_drawdown_pct"] == pytest.approx(round(dd * 100, 2), abs=0.01)
    wf = G.walk_forward(df, s, 5, 20).first()
    size = max(48, 500 // 7)
    pnls = [sum(t[3] for t in loop(pdf.iloc[(i + 1) * size : min((i + 2) * size, 500)].reset_index(drop=True), 20)[0]) for i in range(5)]
    assert wf["n_folds"] == 5 and wf["wf_mean_pnl"] == pytest.approx(np.mean(pnls), abs=0.01)
    assert wf["wf_decay"] == pytest.approx(pnls[-1] - pnls[0], abs=0.01)


def test_strategies_are_separate_series(spark):
    df, _ = market(spark)
    wide = df.withColumns({"s1": F.col("signal"), "s2": -F.col("signal")}).drop("signal")
    long = G.melt_signals(wide, ["s1", "s2"])
    s = Series(("symbol", "strategy"), ("ts",), Series.on_grid(["symbol"], "ts", 3600, rows=50).cuts, 50)
    got = G.position_trades(long.withColumn("side_filter", F.lit(0.0)), s, 20).toPandas()
    a, b = (got[got.strategy == x].sort_values("entry_pos") for x in ("s1", "s2"))
    assert list(a.entry_pos) == list(b.entry_pos) and list(a.direction) == [-d for d in b.direction]


def test_trailing_stop_has_no_holding_limit(spark):
    import datetime as dt

    from barflow.operators.trades import trailing_stops

    start = dt.datetime(2025, 1, 1)
    rng = np.random.default_rng(5)
    closes = {"A": [100.0] * 60 + [90.0, 95.0], "B": list(100 * np.exp(np.cumsum(rng.normal(0, 0.004, 300)))), "C": []}
    bars = [(k, start + dt.timedelta(hours=i), float(c)) for k, v in closes.items() for i, c in enumerate(v)]
    trades = [(n, k, start + dt.timedelta(hours=int(i)), 100.0 + n % 3, d) for n, (k, i, d) in enumerate((k, i, d) for k in "ABC" for i in (0, 7, 50, 61, 299, 400) for d in (1, -1))]
    df = spark.createDataFrame(trades, "id long, symbol string, entry_bar timestamp, entry_price double, direction int")
    got = {r["id"]: r for r in trailing_stops(df, spark.createDataFrame(bars, "symbol string, ts timestamp, close double"), Series.on_grid(["symbol"], "ts", 3600), 2.0).collect()}
    assert len(got) == len(trades)
    for n, k, bar, entry, d in trades:
        at = int((bar - start).total_seconds() // 3600)
        high = low = entry
        stop = None
        for i in range(at + 1, len(closes[k])) if at < len(closes[k]) else ():
            c = closes[k][i]
            high, low = max(high, c), min(low, c)
            if (c <= high * 0.98) if d > 0 else (c >= low * 1.02):
                stop = (start + dt.timedelta(hours=i), c)
                break
        r = got[n]
        assert (r["stop_ts"], r["stop_price"]) == (stop or (None, None))
        best, worst = (high / entry - 1, low / entry - 1) if d > 0 else (1 - low / entry, 1 - high / entry)
        assert abs(r["mfe_pct"] - 100 * max(best, 0)) < 1e-9 and abs(r["mae_pct"] - 100 * min(worst, 0)) < 1e-9
    assert got[0]["stop_ts"] == start + dt.timedelta(hours=60)
