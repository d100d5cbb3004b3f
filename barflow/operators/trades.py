"""Economics, risk and performance of trade tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.numeric import flag, ratio
from barflow.plans.ordered import Series, fill_gaps, running, windowed
from barflow.plans.quantiles import exact_quantiles
from barflow.plans.ranges import first_passage, pyramid, range_extrema_of, slot_of
from barflow.session import reliable_checkpoint

# fixed values: (maker, taker) fee per preset
FEE_PRESETS = {
    "spot": (0.001, 0.001),
    "spot_bnb": (0.00075, 0.00075),
    "futures": (0.0002, 0.0004),
    "futures_vip1": (0.00016, 0.0004),
    "futures_vip2": (0.00014, 0.00035),
    "scalping": (0.0002, 0.0004),
}
PER_YEAR = 8760


def fee_columns(preset: str | Column) -> tuple[Column, Column]:
    """(maker, taker) of a preset column; unknown presets pay futures fees."""
    preset = F.lit(preset) if isinstance(preset, str) else preset
    pick = lambda i: F.coalesce(
        F.create_map(*[x for k, v in FEE_PRESETS.items() for x in (F.lit(k), F.lit(v[i]))])[preset], F.lit(FEE_PRESETS["futures"][i])
    )
    return pick(0), pick(1)


def with_pnl(trades: DataFrame) -> DataFrame:
    """PnL net of fees and funding, and return on size."""
    raw = F.try_divide(F.col("exit_price") - F.col("entry_price"), "entry_price") * F.col("direction") * F.col("size")
    d = trades.withColumn("pnl", raw - F.col("fees") - F.col("funding"))
    return d.withColumn("return_pct", F.when(F.col("size") > 0, F.col("pnl") / F.col("size")).otherwise(0.0))


def equity_curve(trades: DataFrame, s: Series, initial: float = 10_000.0) -> DataFrame:
    """Equity after each trade."""
    return running(trades, s, {"equity": ("sum", F.col("pnl"))}).withColumn("equity", F.col("equity") + initial)


def performance(trades: DataFrame, equity: DataFrame, s: Series, per_year: float = PER_YEAR) -> DataFrame:
    """Trade counts, money, win rate, Sharpe, Sortino, Calmar, max drawdown and profit factor per series.

    ``per_year`` annualises whatever the bar length, as the summary it reproduces does.
    """
    keys = list(s.keys)
    d = windowed(equity, s, lambda x, b: x.withColumn("_r", ratio("equity", b.lag("equity")) - 1), back=1)
    d = running(d, s, {"_peak": ("max", F.col("equity"))})
    at = F.struct(*s.order)
    curve = d.groupBy(*keys).agg(
        F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_sd"), F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))).alias("_dn"),
        F.min(F.try_divide(F.col("equity") - F.col("_peak"), "_peak")).alias("max_drawdown"), F.count(F.lit(1)).alias("_n"),
        F.min_by("equity", at).alias("_first"), F.max_by("equity", at).alias("_last"),
    )
    return summary(trades, curve, keys, per_year)


def summary(trades: DataFrame, curve: DataFrame, keys: Sequence[str], per_year: float = PER_YEAR) -> DataFrame:
    """The performance table from trades and one row per series about its equity.

    ``curve``: mean ``_m``, deviation ``_sd`` and downside deviation ``_dn`` of the returns, ``max_drawdown``, number ``_n`` of values, ``_first`` and ``_last``.
    """
    pnl = F.col("pnl")
    gain, loss = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.abs(F.sum(F.when(pnl < 0, pnl).otherwise(0.0)))
    money = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("pnl").alias("total_pnl"), F.sum(F.col("fees") + F.col("funding")).alias("total_fees"),
        (F.avg(flag(pnl > 0)) * 100).alias("win_rate_pct"), gain.alias("_g"), loss.alias("_l"),
    )
    j = money.join(curve, keys)
    scale = math.sqrt(per_year)
    sharpe = F.when(F.col("_sd") > 0, scale * F.col("_m") / F.col("_sd")).otherwise(0.0)
    sortino = F.when(F.col("_dn") > 0, scale * F.col("_m") / F.col("_dn")).otherwise(0.0)
    annual = F.pow(F.try_divide("_last", "_first"), per_year / F.col("_n")) - 1
    mdd = F.abs("max_drawdown")
    return j.select(
        *keys, "n_trades", F.round("total_pnl", 2).alias("total_pnl"), F.round(F.col("total_pnl") + F.col("total_fees"), 2).alias("gross_pnl"),
        F.round("total_fees", 2).alias("total_fees"), F.round("win_rate_pct", 1).alias("win_rate_pct"), F.round(sharpe, 3).alias("sharpe"),
        F.round(sortino, 3).alias("sortino"), F.round(F.when(mdd > 0, annual / mdd).otherwise(0.0), 3).alias("calmar"),
        F.round(F.col("max_drawdown") * 100, 2).alias("max_drawdown_pct"),
        F.when(F.col("_l") > 0, F.round(F.col("_g") / F.col("_l"), 2)).otherwise(F.lit(float("inf"))).alias("profit_factor"),
    )


# --- execution cost and sizing expressions ---------------------------------------------------------

def impact_slippage(size: Column, depth: Column) -> Column:
    """Square-root impact as a fraction, at most 0.5 %."""
    share = F.greatest(size, F.lit(1.0)) / F.greatest(depth, F.lit(1.0))
    return F.least(F.lit(0.005), 0.001 * F.sqrt(share))


def linear_slippage_bps(size: Column, book_volume: Column, lam: float = 0.5) -> Column:
    return F.when(book_volume <= 0, 1e4).otherwise(lam * F.try_divide(size, F.greatest(book_volume, F.lit(1e-12))) * 1e4)


def total_cost_bps(size: Column, book_volume: Column, fee_bps: float = 4.0, lam: float = 0.5) -> Column:
    return linear_slippage_bps(size, book_volume, lam) + fee_bps


def executed_price(mid: Column, side: Column, cost_bps: Column) -> Column:
    f = cost_bps / 1e4
    return F.when(side == "buy", mid * (1 + f)).otherwise(mid * (1 - f))


def pnl_after_cost(pnl: Column, cost_bps: Column, book_volume: Column) -> Column:
    """PnL less the round-trip cost, which scales with its absolute value."""
    return pnl - F.when(book_volume > 0, 2 * (cost_bps / 1e4) * F.abs(pnl)).otherwise(0.0)


def liquidation_price(entry: Column, leverage: Column, long: Column, maintenance: float = 0.005, taker: float = 0.0004,
                      funding: Column | None = None) -> Column:
    """Isolated-margin liquidation price; null for a non-positive entry or leverage."""
    acc = funding if funding is not None else F.lit(0.0)
    ok = (entry > 0) & (leverage > 0)
    lev = F.when(ok, leverage)
    up = (entry * (1 - 1 / lev + taker) + acc) / (1 - maintenance - taker)
    down = (entry * (1 + 1 / lev - taker) + acc) / (1 + maintenance + taker)
    return F.when(ok, F.when(long, up).otherwise(down))


def kelly_fraction(p_win: Column, win_loss: Column, half: bool = True, cap: float = 0.25, floor: float = 0.005) -> Column:
    f = (p_win * (win_loss + 1) - 1) / F.when(win_loss > 0, win_loss)
    sized = f * 0.5 if half else f
    return F.when((win_loss <= 0) | (p_win <= 0), floor).when(f <= 0, 0.0).otherwise(F.greatest(F.lit(floor), F.least(sized, F.lit(cap))))


def kelly_size(capital: Column, fraction: Column, vol_scale: Column) -> Column:
    return F.round(F.greatest(capital * fraction * vol_scale, F.lit(0.0)), 2)


def size_from_stop(entry: Column, stop: Column, risk: Column, max_notional: float | None = None) -> Column:
    gap = F.abs(entry - stop)
    size = F.round(F.try_divide(risk, gap) * entry, 2)
    value = F.when((gap == 0) | (entry <= 0) | (risk <= 0), 0.0).otherwise(size)
    return F.least(value, F.lit(max_notional)) if max_notional is not None else value


def maker_quotes(mid: Column, inventory: Column, vol: Column, gamma: float = 0.1, k: float = 1.5, time_left: float = 1.0) -> dict[str, Column]:
    """Reservation price and optimal spread of an inventory-averse market maker."""
    var = vol * vol
    reserve = mid - inventory * gamma * var * time_left
    spread = gamma * var * time_left + (2 / gamma) * math.log(1 + gamma / k)
    return {"reservation_price": reserve, "optimal_spread": spread, "optimal_bid": reserve - spread / 2, "optimal_ask": reserve + spread / 2}


def book_walk(levels: str, size: Column, buy: Column, mid: Column) -> Column:
    """Fill of ``size`` against an array of (price, qty) levels: struct(fill_size, avg_price, slippage_bps, levels_used)."""
    zero = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("notional"), F.lit(0.0).alias("filled"), F.lit(0).alias("used"))
    start = F.struct(size.cast("double").alias("left"), zero["notional"].alias("notional"), zero["filled"].alias("filled"), zero["used"].alias("used"))

    def step(a, lv):
        take = F.least(a["left"], lv["qty"])
        go = a["left"] > 0
        return F.struct(
            F.when(go, a["left"] - take).otherwise(a["left"]).alias("left"),
            F.when(go, a["notional"] + take * lv["price"]).otherwise(a["notional"]).alias("notional"),
            F.when(go, a["filled"] + take).otherwise(a["filled"]).alias("filled"),
            F.when(go, a["used"] + 1).otherwise(a["used"]).alias("used"),
        )

    end = F.aggregate(F.col(levels), start, step)
    avg = F.try_divide(end["notional"], end["filled"])
    rel = F.try_divide(avg, mid)
    slip = F.when(buy, (rel - 1) * 1e4).otherwise((1 - rel) * 1e4)
    out = lambda fill, price, bps, used: F.struct(
        fill.alias("fill_size"), price.alias("avg_price"), bps.alias("slippage_bps"), used.alias("levels_used")
    )
    none = out(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0))
    empty = out(F.lit(0.0), F.lit(0.0), F.lit(1e4), end["used"])
    return F.when(size <= 0, none).when((F.size(levels) == 0) | (end["filled"] <= 0), empty).otherwise(
        out(end["filled"], avg, slip, end["used"])
    )


def trailing_stops(trades: DataFrame, bars: DataFrame, s: Series, percent: float = 2.0) -> DataFrame:
    """First bar after the entry bar, however far, at which price has fallen ``percent`` from its best since entry (risen, for shorts).

    A stop is the first passage of price through the limit of the entry price or that of a later close.  The latter is the same for all trades that open
    on a bar: the least, over the bars after it, of the first passage from theirs, a running minimum from the end.  ``mfe_pct`` and ``mae_pct`` are the
    extremes up to the stop, or to the last bar.  Bars (one a grid step) and trades meet in blocks of a pyramid only, so no task needs a series.
    A trade whose ``entry_bar`` is no bar with a close gets no stop.
    """
    keys, c = list(s.keys), F.col
    slot = lambda ts: slot_of(F.col(ts), s.cuts.step_seconds)
    limits = lambda price: (F.when(c("_long"), c(price) * (1 - percent / 100)), F.when(~c("_long"), c(price) * (1 + percent / 100)))
    closes = bars.select(*keys, "ts", c("close").cast("double").alias("close")).where("close is not null").withColumn("_slot", slot("ts"))
    closes = reliable_checkpoint(closes)
    p = pyramid(closes, keys, c("_slot"), {"lo": ("min", "close"), "hi": ("max", "close")})
    both = closes.withColumn("_long", F.explode(F.array(F.lit(True), F.lit(False))))
    falls = first_passage(both, p, c("_slot"), *limits("close"), "_fall")
    sides = Series((*keys, "_long"), ("ts",), s.cuts, s.rows)
    after = running(falls, sides, {"_after": ("min", c("_fall"))}, exclusive=True, reverse=True).select(*keys, "_slot", "_long", c("ts").alias("_bar"), "_after")

    t = trades.withColumns({"_row": F.monotonically_increasing_id(), "_long": c("direction") > 0, "_slot": slot("entry_bar")})
    t = first_passage(t, p, c("_slot") + 1, *limits("entry_price"), "_own").join(after, [*keys, "_slot", "_long"], "left")
    t = t.withColumn("_stop", F.when(c("_bar") == c("entry_bar"), F.least("_own", "_after")))
    hit = closes.select(*keys, c("_slot").alias("_stop"), c("ts").alias("stop_ts"), c("close").alias("stop_price"))
    t = reliable_checkpoint(t.join(hit, [*keys, "_stop"], "left"))
    seen = F.when(c("_bar") == c("entry_bar"), F.coalesce("_stop", F.lit(p.base + p.slots)))
    d = range_extrema_of(t, p, c("_slot") + 1, seen, {"lo": ("min", "close"), "hi": ("max", "close")}, ["_row"])
    entry = c("entry_price")
    up, down = F.try_divide(F.greatest(entry, c("hi")), entry) - 1, F.try_divide(F.least(entry, c("lo")), entry) - 1
    best, worst = F.when(c("_long"), up).otherwise(-down), F.when(c("_long"), down).otherwise(-up)
    pct = lambda move, fold: F.coalesce(100 * fold(move, F.lit(0.0)), F.lit(0.0))
    return d.select(*trades.columns, "stop_ts", "stop_price", pct(best, F.greatest).alias("mfe_pct"), pct(worst, F.least).alias("mae_pct"))


def close_trades(trades: DataFrame) -> DataFrame:
    """PnL, percent of the invested amount and exit reason (kept if given) of closed trades."""
    move = F.col("exit_price") - F.col("entry_price")
    pnl = F.when(F.coalesce("side", F.lit("LONG")) == "LONG", move).otherwise(-move) * F.col("amount")
    d = trades.withColumn("pnl", pnl).withColumn("pnl_percent", F.try_divide(F.col("pnl"), F.col("invested")) * 100)
    return d.withColumn("exit_reason", F.coalesce("exit_reason", exit_reason(F.lit("CLOSED"), F.col("pnl"))))


def exit_reason(status: Column, pnl: Column) -> Column:
    """Reason inferred from the result: null while open, unknown without a result."""
    return (
        F.when(F.upper(F.coalesce(status, F.lit(""))) == "OPEN", None).when(pnl.isNull(), "unknown")
        .when(pnl > 0, "TP").when(pnl < 0, "SL").otherwise("flat")
    )


def backfill_trades(trades: DataFrame) -> DataFrame:
    """Fill mode, exit reason and excursions of legacy rows; only absent values are touched."""
    return trades.withColumns({
        "mode_inferred": F.col("mode").isNull(), "mode": F.coalesce("mode", F.lit("testnet")),
        "exit_reason": F.coalesce("exit_reason", exit_reason(F.col("status"), F.col("pnl"))),
        "mfe_pct": F.coalesce("mfe_pct", F.lit(0.0)), "mae_pct": F.coalesce("mae_pct", F.lit(0.0)),
    })


def pnl_history(trades: DataFrame, s: Series, since: Column) -> DataFrame:
    """Recent results of each strategy with their cumulative sum."""
    return running(trades.where(F.col("ts") >= since), s, {"cumulative": ("sum", F.col("pnl"))})


def sharpe_degradation(trades: DataFrame, baseline: DataFrame, s: Series, last: int = 100, share: float = 0.5,
                       per_year: float = PER_YEAR) -> DataFrame:
    """Sharpe of the last trades (0 below ten) against a share of the backtest's."""
    from barflow.operators.indicators import recent_rows

    live = recent_rows(trades, s, last).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("_m"), F.stddev_pop("pnl").alias("_sd")
    )
    value = F.when((F.col("n") >= 10) & (F.col("_sd") > 0), math.sqrt(per_year) * F.col("_m") / F.col("_sd")).otherwise(0.0)
    d = baseline.join(live.withColumn("live_sharpe", value), list(s.keys), "left").withColumn("live_sharpe", F.coalesce("live_sharpe", F.lit(0.0)))
    bt = F.col("backtest_sharpe")
    return d.select(*s.keys, "n", "backtest_sharpe", "live_sharpe", ((bt > 0) & (F.col("live_sharpe") < bt * share)).alias("degraded"))


def breaker_state(trades: DataFrame, s: Series, brier: DataFrame, daily_limit: float = 3.0, max_losses: int = 5,
                  latency_limit: float = 500.0, drawdown_limit: float = 0.08, brier_limit: float = 2.0,
                  initial: float = 10_000.0, risk_unit: float = 100.0, window_minutes: int = 5) -> DataFrame:
    """First tripped breaker per series, tested in fixed order, over ``trades(ts, id, pnl, latency_ms)``.

    Daily result in risk units of the newest day, losses since the last win, p99 latency of the newest
    minutes, deepest drawdown of the equity curve, and calibration z-score ``brier(brier_z)``.
    """
    keys = list(s.keys)
    ends = trades.groupBy(*keys).agg(
        F.max("ts").alias("_end"), F.max(F.when(F.col("pnl") > 0, F.struct(*s.order))).alias("_win"), F.count(F.lit(1)).alias("n_trades")
    )
    d = trades.join(ends, keys)
    day = F.to_date("ts") == F.to_date("_end")
    after = F.col("_win").isNull() | (F.struct(*s.order) > F.col("_win"))
    agg = d.groupBy(*keys).agg(
        (F.sum(F.when(day, F.col("pnl")).otherwise(0.0)) / risk_unit).alias("daily_r"), F.sum(flag(after)).cast("bigint").alias("losses")
    )
    fresh = d.where(F.unix_micros("ts") >= F.unix_micros("_end") - window_minutes * 60_000_000)
    p99 = exact_quantiles(fresh, keys, "latency_ms", [0.99], "_q").select(*keys, F.get("_q", F.lit(0)).alias("latency_p99"))
    curve = running(running(trades, s, {"_eq": ("sum", F.col("pnl"))}).withColumn("_eq", F.col("_eq") + initial), s, {"_peak": ("max", F.col("_eq"))})
    dd = curve.groupBy(*keys).agg(F.max(F.try_divide(F.col("_peak") - F.col("_eq"), "_peak")).alias("drawdown"))
    j = ends.select(*keys, "n_trades").join(agg, keys).join(p99, keys, "left").join(dd, keys).join(brier, keys, "left")
    trigger = (
        F.when(F.col("daily_r") <= -daily_limit, "daily_loss").when(F.col("losses") >= max_losses, "consecutive_losses")
        .when(F.col("latency_p99") > latency_limit, "latency_p99").when(F.col("drawdown") >= drawdown_limit, "drawdown")
        .when(F.abs("brier_z") >= brier_limit, "calibration")
    )
    return j.select(*keys, "n_trades", "daily_r", "losses", "latency_p99", "drawdown", trigger.alias("trigger"), trigger.isNotNull().alias("paused"))
