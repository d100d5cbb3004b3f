"""Indicator columns over bar series.

Every indicator is a :class:`Feature`: how many rows it looks back (and ahead)
plus the columns it adds inside a haloed block.  ``add_features`` runs any number of
them in one pass over the data, so a full feature set costs the same two shuffles
as a single indicator.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.numeric import at_least, clip, flag, log, nonzero, quotient, ratio, sign3
from barflow.plans.ordered import Block, Series, running, windowed
from barflow.plans.recurrence import decayed_scan, ewm, ewm_back, span_alpha


@dataclass(frozen=True)
class Feature:
    apply: Callable[[DataFrame, Block], DataFrame]
    back: int
    ahead: int = 0


def add_features(df: DataFrame, s: Series, *features: Feature) -> DataFrame:
    """Apply features in order (later ones may use columns of earlier ones)."""

    def run(d: DataFrame, b: Block) -> DataFrame:
        for f in features:
            d = f.apply(d, b)
        return d

    return windowed(df, s, run, back=sum(f.back for f in features), ahead=sum(f.ahead for f in features))


def true_range(b: Block) -> Column:
    """Largest of the bar range and the distances to the previous close (null distances are skipped)."""
    prev = b.lag("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def _tr(d: DataFrame, b: Block) -> DataFrame:
    return d.withColumn("tr", true_range(b))


def bar_return(b: Block, periods: int = 1, col: str = "close") -> Column:
    return ratio(col, b.lag(col, periods)) - 1


def rsi(period: int = 14, out: str | None = None) -> Feature:
    """Wilder relative strength index."""
    out = out or f"rsi_{period}"

    def add(d, b):
        d = d.withColumn("_d", F.col("close") - b.lag("close"))
        d = ewm(d, b, F.greatest(F.col("_d"), F.lit(0.0)), 1 / period, "_gain", skip=1)
        d = ewm(d, b, F.greatest(-F.col("_d"), F.lit(0.0)), 1 / period, "_loss", skip=1)
        value = (
            F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), 100.0)
            .when(F.col("_loss") == 0, None)
            .otherwise(100 - 100 / (1 + F.try_divide("_gain", "_loss")))
        )
        return d.withColumn(out, value).drop("_d", "_gain", "_loss")

    return Feature(add, ewm_back(1 / period) + 1)


def ema(span: int, out: str, col: str = "close") -> Feature:
    return Feature(lambda d, b: ewm(d, b, col, span_alpha(span), out), ewm_back(span_alpha(span)))


def macd(fast: int = 12, slow: int = 26, signal: int = 9, prefix: str = "") -> Feature:
    """MACD line, its signal line and their difference."""
    line, sig, hist = f"{prefix}macd", f"{prefix}macd_signal", f"{prefix}macd_hist"

    def add(d, b):
        d = ewm(d, b, "close", span_alpha(fast), "_fast")
        d = ewm(d, b, "close", span_alpha(slow), "_slow")
        d = d.withColumn(line, F.col("_fast") - F.col("_slow"))
        d = ewm(d, b, line, span_alpha(signal), sig)
        return d.withColumn(hist, F.col(line) - F.col(sig)).drop("_fast", "_slow")

    return Feature(add, ewm_back(span_alpha(slow)) + ewm_back(span_alpha(signal)))


def bollinger(n: int = 20, prefix: str = "") -> Feature:
    """Mean, sample deviation, +/-2 sigma bands and position inside them."""

    def add(d, b):
        d = d.withColumns({f"sma_{n}": b.roll(F.avg, "close", n), f"std_{n}": b.roll(F.stddev_samp, "close", n)})
        d = d.withColumns({
            f"{prefix}bb_upper": F.col(f"sma_{n}") + 2 * F.col(f"std_{n}"),
            f"{prefix}bb_lower": F.col(f"sma_{n}") - 2 * F.col(f"std_{n}"),
        })
        width = nonzero(F.col(f"{prefix}bb_upper") - F.col(f"{prefix}bb_lower"), 1e-4)
        return d.withColumn(f"{prefix}bb_pb", (F.col("close") - F.col(f"{prefix}bb_lower")) / width)

    return Feature(add, n)


def roc(*periods: int) -> Feature:
    return Feature(lambda d, b: d.withColumns({f"roc_{p}": bar_return(b, p) for p in periods}), max(periods))


def atr(period: int = 14) -> Feature:
    return Feature(lambda d, b: _tr(d, b).withColumn(f"atr_{period}", b.roll(F.avg, "tr", period)), period + 1)


def adx(period: int = 14) -> Feature:
    """Directional movement with simple means; adds tr and atr as well."""

    def add(d, b):
        d = _tr(d, b).withColumn(f"atr_{period}", b.roll(F.avg, "tr", period))
        up, down = F.col("high") - b.lag("high"), b.lag("low") - F.col("low")
        d = d.withColumn("_up", up).withColumn("_down", down)
        d = d.withColumns({
            "_plus": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
            "_minus": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0),
        })
        a = nonzero(f"atr_{period}", 1e-4)
        d = d.withColumns({
            "plus_di": 100 * (b.roll(F.avg, "_plus", period) / a),
            "minus_di": 100 * (b.roll(F.avg, "_minus", period) / a),
        })
        total = nonzero(F.col("plus_di") + F.col("minus_di"), 1e-4)
        d = d.withColumn("dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total)
        return d.withColumn(f"adx_{period}", b.roll(F.avg, "dx", period)).drop("_up", "_down", "_plus", "_minus")

    return Feature(add, 2 * period + 1)


def flow_imbalance(n: int = 20) -> Feature:
    """Signed taker flow and its rolling z-score (the cumulative form is :func:`add_cumulative_flow`)."""

    def add(d, b):
        d = d.withColumn("ofi", F.col("taker_buy_base") - (F.col("volume") - F.col("taker_buy_base")))
        sd = nonzero(b.roll(F.stddev_samp, "ofi", n), 1e-9)
        return d.withColumn("ofi_z", clip((F.col("ofi") - b.roll(F.avg, "ofi", n)) / sd, -3, 3))

    return Feature(add, n)


def add_cumulative_flow(df: DataFrame, s: Series) -> DataFrame:
    """Running total of signed taker flow over the whole series."""
    return running(df, s, {"ofi_cumulative": ("sum", 2 * F.col("taker_buy_base") - F.col("volume"))})


def add_session_vwap(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """VWAP anchored at midnight UTC; the frame never leaves one (series, day)."""
    w = Window.partitionBy(*keys, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = df.withColumn("vwap", F.sum(typical * F.col("volume")).over(w) / nonzero(F.sum("volume").over(w), 1e-9))
    return d.withColumn("vwap_dist", (F.col("close") - F.col("vwap")) / nonzero("vwap", 1e-9))


def donchian(n: int = 20) -> Feature:
    def add(d, b):
        d = d.withColumns({f"don_upper_{n}": b.roll(F.max, "high", n), f"don_lower_{n}": b.roll(F.min, "low", n)})
        width = nonzero(F.col(f"don_upper_{n}") - F.col(f"don_lower_{n}"), 1e-9)
        return d.withColumn(f"don_pos_{n}", (F.col("close") - F.col(f"don_lower_{n}")) / width)

    return Feature(add, n)


def keltner(span: int = 20, mult: float = 2.0, atr_period: int = 10) -> Feature:
    def add(d, b):
        d = ewm(d, b, "close", span_alpha(span), "_mid").withColumn("_ktr", true_range(b))
        half = mult * b.roll(F.avg, "_ktr", atr_period)
        d = d.withColumns({"kc_upper": F.col("_mid") + half, "kc_lower": F.col("_mid") - half})
        width = F.col("kc_upper") - F.col("kc_lower")
        return d.withColumns({
            "kc_pos": (F.col("close") - F.col("kc_lower")) / nonzero(width, 1e-9),
            "kc_width": width / nonzero("_mid", 1e-9),
        }).drop("_mid", "_ktr")

    return Feature(add, ewm_back(span_alpha(span)) + atr_period + 1)


def funding_zscore(n: int = 168, col: str = "funding_rate") -> Feature:
    def add(d, b):
        sd = nonzero(b.roll(F.stddev_samp, col, n, 1), 1e-9)
        return d.withColumns({
            "funding_z": clip((F.col(col) - b.roll(F.avg, col, n, 1)) / sd, -4, 4),
            "funding_positive": flag(F.col(col) > 0.001),
            "funding_negative": flag(F.col(col) < -0.0005),
        })

    return Feature(add, n)


def liquidity_proximity(atr_period: int = 14, lookback: int = 48) -> Feature:
    def add(d, b):
        d = d.withColumn("_ltr", true_range(b))
        a = nonzero(b.roll(F.avg, "_ltr", atr_period), 1e-9)
        d = d.withColumns({
            "dist_to_supply": clip((b.roll(F.max, "high", lookback) - F.col("close")) / a, 0, 10),
            "dist_to_demand": clip((F.col("close") - b.roll(F.min, "low", lookback)) / a, 0, 10),
        })
        return d.withColumn("liq_proximity", 1 / (1 + F.least("dist_to_supply", "dist_to_demand"))).drop("_ltr")

    return Feature(add, max(atr_period + 1, lookback))


def standardise(df: DataFrame, columns: list[str], keys=("symbol",)) -> DataFrame:
    """Z-score of whole columns per series; constant columns become 0."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    d = df.join(stats, list(keys))
    for c in columns:
        d = d.withColumn(
            f"{c}_norm",
            F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0),
        )
    return d.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def ichimoku(tenkan: int = 9, kijun: int = 26, senkou: int = 52, shift: int = 26) -> Feature:
    """Five lines and the cloud signal.  The lagging line reads the future close; the signal does not."""

    def add(d, b):
        mid = lambda n: (b.roll(F.max, "high", n) + b.roll(F.min, "low", n)) / 2
        d = d.withColumns({"ichimoku_tenkan": mid(tenkan), "ichimoku_kijun": mid(kijun), "_sb": mid(senkou)})
        d = d.withColumn("_sa", (F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2)
        d = d.withColumns({
            "ichimoku_senkou_a": b.lag("_sa", shift), "ichimoku_senkou_b": b.lag("_sb", shift),
            "ichimoku_chikou": b.lead("close", shift),
        })
        top = F.greatest("ichimoku_senkou_a", "ichimoku_senkou_b")
        low = F.least("ichimoku_senkou_a", "ichimoku_senkou_b")
        t, k = F.col("ichimoku_tenkan"), F.col("ichimoku_kijun")
        return d.withColumn(
            "signal_ichimoku", sign3((F.col("close") > top) & (t > k), (F.col("close") < low) & (t < k))
        ).drop("_sa", "_sb")

    return Feature(add, senkou + shift, shift)


def macd_divergence(fast: int = 12, slow: int = 26, lookback: int = 5) -> Feature:
    """Zero-line crossings and price / MACD divergences."""

    def add(d, b):
        d = ewm(d, b, "close", span_alpha(fast), "_f")
        d = ewm(d, b, "close", span_alpha(slow), "_s").withColumn("_line", F.col("_f") - F.col("_s"))
        d = d.withColumns({"_mh": b.roll(F.max, "_line", lookback), "_ml": b.roll(F.min, "_line", lookback)})
        line, prev = F.col("_line"), b.lag("_line")
        bear = (F.col("close") >= b.roll(F.max, "close", lookback)) & (line < b.lag("_mh", lookback))
        bull = (F.col("close") <= b.roll(F.min, "close", lookback)) & (line > b.lag("_ml", lookback))
        d = d.withColumns({
            "macd_cl_cross": sign3((line > 0) & (prev <= 0), (line < 0) & (prev >= 0)),
            "macd_divergence": sign3(bull, bear),
        })
        combined = F.when(F.col("macd_cl_cross") != 0, F.col("macd_cl_cross")).otherwise(F.col("macd_divergence"))
        return d.withColumn("signal_macd_div", combined).drop("_f", "_s", "_line", "_mh", "_ml")

    return Feature(add, ewm_back(span_alpha(slow)) + 2 * lookback)


def kalman_gains(n: int, q: float = 0.01, obs: float = 1.0, p0: float = 1.0) -> list[float]:
    """Gain of a scalar random-walk filter at positions 0..n-1 (independent of the data)."""
    gains, p = [], p0
    for _ in range(n):
        k = p / (p + obs)
        gains.append(k)
        p = p * (1 - k) + q
    return gains


def kalman(out: str = "price_kalman", col: str = "close", q: float = 0.01, obs: float = 1.0, p0: float = 1.0) -> Feature:
    """Filtered level of a random walk observed with noise, started at the first value."""
    warm = 256
    gains = kalman_gains(warm, q, obs, p0)
    rates = [0.0, *[-math.log1p(-k) for k in gains[1:]]]
    cum = [sum(rates[: i + 1]) for i in range(warm)]
    rate, level = rates[-1], cum[-1]
    late = warm - 1

    def add(d, b):
        cum_lit, gain_lit = F.array(*map(F.lit, cum)), F.array(*map(F.lit, gains))

        def total(p):
            return F.when(p > late, level + (p - late) * F.lit(rate)).otherwise(
                F.get(cum_lit, F.greatest(p, F.lit(0)).cast("int"))
            )

        p = F.col("_pos")
        k = F.when(p == 0, 1.0).when(p > late, gains[-1]).otherwise(F.get(gain_lit, F.least(p, F.lit(late)).cast("int")))
        return decayed_scan(d, b, p, total, k * F.col(col), out)

    return Feature(add, math.ceil(40 / rate) + warm)


def fractional_weights(d: float = 0.4, cutoff: float = 1e-4, width: int = 100) -> list[float]:
    """Binomial weights of (1 - B)^d, newest first, until they fall below the cutoff or the width cap."""
    w = [1.0]
    while len(w) < width:
        k = len(w)
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < cutoff:
            break
        w.append(nxt)
    return w


def fractional_diff(d: float = 0.4, col: str = "close", out: str | None = None) -> Feature:
    weights = fractional_weights(d)
    n = len(weights)
    out = out or f"frac_diff_d{int(d * 100):02d}"

    def add(df, b):
        oldest_first = F.array(*[F.lit(w) for w in reversed(weights)])
        past = F.collect_list(col).over(b.frame(-(n - 1), 0))
        df = df.withColumn("_past", past)
        dot = F.aggregate(F.zip_with("_past", oldest_first, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        return df.withColumn(out, F.when(F.size("_past") == n, dot)).drop("_past")

    return Feature(add, n)


def regime_features(n: int = 24, atr_period: int = 14, per_year: float = 8760) -> Feature:
    """Volatility, trend strength, relative ATR, volume z and lag-1 autocorrelation of returns."""

    def add(d, b):
        d = d.withColumns({"_ret": bar_return(b), "_rtr": true_range(b)})
        d = d.withColumn("_prev", b.lag("_ret"))
        sd = nonzero(b.roll(F.stddev_samp, "volume", n), 1e-9)
        full = F.count("_ret").over(b.frame(-(n - 1), 0)) >= n
        d = d.withColumn("rv", b.roll(F.stddev_samp, "_ret", n) * math.sqrt(per_year))
        return d.withColumns({
            "trend_str": F.abs(b.roll(F.sum, "_ret", n)) / nonzero("rv", 1e-9),
            "atr_n": b.roll(F.avg, "_rtr", atr_period) / nonzero("close", 1e-9),
            "vol_z": (F.col("volume") - b.roll(F.avg, "volume", n)) / sd,
            # the n-1 pairs whose both ends lie inside the frame
            "ret_ac1": F.when(full, F.corr("_ret", "_prev").over(b.frame(-(n - 2), 0))),
        }).drop("_ret", "_rtr", "_prev")

    return Feature(add, n + 2)


def trend_flags() -> Feature:
    """EMA gap over ATR, short / long volatility ratio and their > 1.5 flags."""

    def add(d, b):
        d = ewm(d, b, "close", span_alpha(12), "_e12")
        d = ewm(d, b, "close", span_alpha(26), "_e26")
        d = d.withColumns({"_ftr": true_range(b), "_ret": bar_return(b)})
        a = nonzero(b.roll(F.avg, "_ftr", 14), 1e-9)
        vol100 = nonzero(b.roll(F.stddev_samp, "_ret", 100, 10), 1e-9)
        d = d.withColumns({
            "trend_strength": F.abs(F.col("_e12") - F.col("_e26")) / a,
            "vol_regime": b.roll(F.stddev_samp, "_ret", 7) / vol100,
        })
        return d.withColumns({
            "is_trending": flag(F.col("trend_strength") > 1.5), "is_volatile": flag(F.col("vol_regime") > 1.5)
        }).drop("_e12", "_e26", "_ftr", "_ret")

    return Feature(add, ewm_back(span_alpha(26)) + 102)


def price_shape() -> Feature:
    """Moving-average distances, stochastic %K, lagged returns, volume and range shape columns.

    Distances to a level of zero, and the range over a close of zero, are infinite (0 / 0: NaN), and so is the log return to zero.
    """

    def add(d, b):
        d = d.withColumns({"ret": bar_return(b), "log_ret": log(ratio("close", b.lag("close")))})
        low14, high14 = b.roll(F.min, "low", 14), b.roll(F.max, "high", 14)
        vol20 = b.roll(F.avg, "volume", 20)
        return d.withColumns({
            **{f"dist_sma_{n}": quotient("close", b.roll(F.avg, "close", n)) - 1 for n in (7, 30)},
            "sma_align": flag(b.roll(F.avg, "close", 50) > b.roll(F.avg, "close", 200)),
            "stoch_k": 100 * (F.col("close") - low14) / nonzero(high14 - low14, 1e-4),
            **{f"ret_lag_{k}": b.lag("ret", k) for k in (1, 2, 3, 5)},
            "volume_momentum": ratio("volume", b.roll(F.avg, "volume", 14)),
            "volume_surge": flag(F.col("volume") > vol20 * 1.5),
            "volume_drop": flag(F.col("volume") < vol20 * 0.5),
            **{f"dist_low_{n}": quotient("close", b.roll(F.min, "low", n)) - 1 for n in (15, 30)},
            "range_pct": quotient(F.col("high") - F.col("low"), "close"),
        })

    return Feature(add, 202)


def amihud(n: int = 30) -> Feature:
    """Rolling mean of absolute return per traded value."""

    def add(d, b):
        value = F.col("close") * F.col("volume")
        raw = F.coalesce(F.try_divide(F.abs(F.coalesce(bar_return(b), F.lit(0.0))), value), F.lit(0.0))
        d = d.withColumn("_raw", raw)
        return d.withColumn("amihud_illiq", F.coalesce(b.roll(F.avg, "_raw", n, max(1, n // 4)), F.lit(0.0))).drop("_raw")

    return Feature(add, n + 1)


def kyle_lambda(n: int = 60) -> Feature:
    """Rolling slope of return on signed volume; 0 while the variance vanishes."""

    def add(d, b):
        share = F.col("taker_buy_base") / nonzero("volume", 1e-4)
        d = d.withColumns({
            "_ret": F.coalesce(bar_return(b), F.lit(0.0)), "_sv": (2 * share - 1) * F.col("volume")
        })
        w, need = b.frame(-(n - 1), 0), max(2, n // 4)
        ok = F.count("_sv").over(w) >= need
        d = d.withColumns({
            "_cov": F.when(ok, F.covar_samp("_ret", "_sv").over(w)), "_var": F.when(ok, F.var_samp("_sv").over(w))
        })
        slope = F.when(F.col("_var") > 1e-12, F.try_divide("_cov", "_var"))
        return d.withColumn("kyle_lambda", F.coalesce(slope, F.lit(0.0))).drop("_ret", "_sv", "_cov", "_var")

    return Feature(add, n + 1)


def vpin(n: int = 50) -> Feature:
    """Rolling mean of the absolute buy / sell imbalance of each bar."""

    def add(d, b):
        share = clip(F.col("taker_buy_base") / nonzero("volume", 1e-4), 0.0, 1.0)
        buy = F.col("volume") * share
        sell = F.col("volume") * (1 - share)
        d = d.withColumn("_imb", F.try_divide(F.abs(buy - sell), buy + sell))
        return d.withColumn("vpin", F.coalesce(b.roll(F.avg, "_imb", n, max(1, n // 4)), F.lit(0.0))).drop("_imb")

    return Feature(add, n)


def add_on_balance(df: DataFrame, s: Series, last_rows: int) -> DataFrame:
    """On-balance style flow (running total of signed volume) and volume change; last rows of each series."""
    d = windowed(
        df, s,
        lambda x, b: x.withColumns({
            "_dir": F.coalesce(F.signum(F.col("close") - b.lag("close")), F.lit(0.0)),
            "volume_delta": F.coalesce(F.col("volume") - b.lag("volume"), F.lit(0.0)),
        }),
        back=1,
    )
    return recent_rows(running(d, s, {"obv": ("sum", F.col("_dir") * F.col("volume"))}).drop("_dir"), s, last_rows)


def recent_rows(df: DataFrame, s: Series, n: int) -> DataFrame:
    """Last ``n`` rows of every series by position from the end (no per-series sort)."""
    flipped = s.cut(df)
    keys = [*s.keys, "_cut"]
    sizes = flipped.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*s.keys).orderBy(F.col("_cut").desc())
    after = sizes.select(*keys, (F.sum("_n").over(later) - F.col("_n")).alias("_after")).where(F.col("_after") < n)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in s.order])
    return (
        flipped.join(after, keys).withColumn("_rk", F.row_number().over(w))
        .where(F.col("_after") + F.col("_rk") <= n).drop("_cut", "_after", "_rk")
    )


def volatility_size() -> Feature:
    """Half size when short volatility exceeds 1.8 times the long one; side filter by SMA 200."""

    def add(d, b):
        d = d.withColumn("_ret", bar_return(b))
        short = b.roll(F.stddev_samp, "_ret", 5, 2)
        long = at_least(b.roll(F.stddev_samp, "_ret", 60, 10), 1e-9)
        return d.withColumns({
            "vol_size_mult": F.when(F.try_divide(short, long) > 1.8, 0.5).otherwise(1.0),
            "signal_mtf_filter": F.when(F.col("close") > b.roll(F.avg, "close", 200, 50), 1.0).otherwise(-1.0),
        }).drop("_ret")

    return Feature(add, 201)


def annual_volatility(n: int = 30, per_year: float = 8760) -> Feature:
    """Annualised deviation of log returns (0 until there are n, NaN with a return to zero among them) and the volatility-scaled size."""

    def add(d, b):
        d = d.withColumn("_lr", log(ratio("close", b.lag("close"))))
        vol = F.coalesce(b.roll(F.stddev_samp, "_lr", n) * math.sqrt(per_year), F.lit(0.0))
        d = d.withColumn("hist_vol", vol)
        size = clip(0.5 / F.greatest("hist_vol", F.lit(0.05)), 0.25, 3.0)
        return d.withColumn("vol_scale", size).drop("_lr")

    return Feature(add, n + 1)


def causal_checks(df: DataFrame, s: Series, min_rows: int = 100) -> DataFrame:
    """(series, check, ok) look-ahead audit of a frame with vwap and ofi.

    Time must not go back; VWAP must jump at some midnight (a cumulative one never
    does); flow must not be constant.  The last two only judge long enough series.
    """

    def add(d, b):
        new_day = F.to_date("ts") > F.to_date(b.lag("ts"))
        jump = F.abs(F.col("vwap") - b.lag("vwap")) / nonzero("close", 1e-9)
        return d.withColumns({"_back": F.col("ts") < b.lag("ts"), "_jump": F.when(new_day, jump)})

    agg = windowed(df, s, add, back=1).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(flag(F.col("_back"))).alias("_backs"),
        F.max("_jump").alias("_jump"), F.min("ofi").alias("_lo"), F.max("ofi").alias("_hi"),
    )
    long = F.col("_n") > min_rows
    return agg.select(
        *s.keys,
        (F.col("_backs") == 0).alias("monotone"),
        F.coalesce(~(long & (F.col("_jump") < 1e-4)), F.lit(True)).alias("vwap_resets"),
        F.coalesce(~(long & (F.col("_lo") == F.col("_hi"))), F.lit(True)).alias("flow_varies"),
    ).unpivot(list(s.keys), ["monotone", "vwap_resets", "flow_varies"], "check", "ok")


def lagged_windows(df: DataFrame, s: Series, columns: list[str], past: int = 168, future: int = 24) -> DataFrame:
    """Fixed-length history (and target) arrays per row; rows without a full window are dropped."""

    def add(d, b):
        return d.withColumns({
            "past": F.collect_list(F.struct(*columns)).over(b.frame(-(past - 1), 0)),
            "future": F.collect_list("close").over(b.frame(1, future)),
        })

    d = windowed(df, s, add, back=past, ahead=future)
    return d.where((F.size("past") == past) & (F.size("future") == future))
