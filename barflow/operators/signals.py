"""Trading signals in {-1, 0, +1} (or a mean of them) as row rules over indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.numeric import at_least, ratio, sign3
from barflow.operators import indicators as I
from barflow.operators.indicators import Feature, add_features
from barflow.plans.ordered import Series, running, windowed

# fixed values: thresholds of the row rules, as (column, long below/above, short above/below)
RSI_LONG, RSI_SHORT = 30, 70
BAND_LONG, BAND_SHORT = 0.1, 0.9
VWAP_DISTANCE = 0.005
DONCHIAN_LONG, DONCHIAN_SHORT = 0.98, 0.02
FUNDING_SHORT, FUNDING_LONG = 0.001, -0.0005
FLOW_Z = 1.5

# fixed values: strategies allowed in each regime (0 ranging, 1 trending, 2 volatile)
REGIME_STRATEGIES = {
    0: ["RSI_MeanReversion", "BB_Reversion", "VWAP_Reversion"],
    1: ["MACD_Momentum", "Donchian_Breakout", "Keltner_Breakout"],
    2: ["Funding_Arb"],
}
# fixed values: signal column behind each strategy name
STRATEGY_SIGNAL = {
    "RSI_MeanReversion": "signal_rsi",
    "BB_Reversion": "signal_bb",
    "VWAP_Reversion": "signal_vwap",
    "MACD_Momentum": "signal_macd",
    "Donchian_Breakout": "signal_donchian",
    "Keltner_Breakout": "signal_donchian",
    "Funding_Arb": "signal_funding",
}


def _mean(*cols: str) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return total / len(cols)


def row_rules(d: DataFrame) -> DataFrame:
    """The signals that need nothing but columns of the same row."""
    c = F.col
    d = d.withColumns({
        "signal_rsi": sign3(c("rsi_14") < RSI_LONG, c("rsi_14") > RSI_SHORT),
        "signal_macd": F.when(c("macd_hist") > 0, 1.0).otherwise(-1.0),
        "signal_bb": sign3(c("bb_pb") < BAND_LONG, c("bb_pb") > BAND_SHORT),
        "signal_vwap": sign3(c("vwap_dist") < -VWAP_DISTANCE, c("vwap_dist") > VWAP_DISTANCE),
        "signal_donchian": sign3(c("don_pos_20") > DONCHIAN_LONG, c("don_pos_20") < DONCHIAN_SHORT),
        "signal_keltner": sign3(c("kc_pos") > 1, c("kc_pos") < 0),
        "signal_funding": sign3(c("funding_rate") < FUNDING_LONG, c("funding_rate") > FUNDING_SHORT),
        "signal_ofi": sign3(c("ofi_z") > FLOW_Z, c("ofi_z") < -FLOW_Z),
    })
    return d.withColumns({
        "signal_ensemble": _mean("signal_rsi", "signal_macd", "signal_bb"),
        "signal_ensemble_b": _mean("signal_vwap", "signal_donchian", "signal_keltner", "signal_funding", "signal_ofi"),
    })


def window_rules(vote: str | None = None, regime: str | None = None) -> Feature:
    """Signals that look at neighbouring rows; ``vote`` and ``regime`` are optional input columns."""

    def add(d: DataFrame, b) -> DataFrame:
        c = F.col
        d = d.withColumn("_squeeze", (c("bb_pb") < 0.15) & c("kc_pos").between(0.1, 0.9))
        was = F.coalesce(b.lag("_squeeze"), F.lit(False))
        surge = c("volume") > b.roll(F.avg, "volume", 20, 5) * 1.5
        prev = b.lag("close")
        d = d.withColumn(
            "signal_vol_breakout", sign3(was & (c("close") > prev) & surge, was & (c("close") < prev) & surge)
        ).drop("_squeeze")
        sma50 = b.roll(F.avg, "close", 50, 10)
        mom5 = c("close") / at_least(b.lag("close", 5), 1e-9) - 1
        bull = c(vote) > 0 if vote else F.lit(True)
        bear = c(vote) < 0 if vote else F.lit(True)
        mu, sd = b.roll(F.avg, "close", 200, 50), at_least(b.roll(F.stddev_samp, "close", 200, 50), 1e-9)
        d = d.withColumns({
            "signal_elliott_proxy": sign3(
                (mom5 > 0.02) & (c("close") > sma50) & bull, (mom5 < -0.02) & (c("close") < sma50) & bear
            ),
            "_dev": (c("close") - mu) / sd,
        })
        ranging = c(regime) == 0 if regime else F.lit(True)
        calm = F.coalesce((F.abs("_dev") < 2).cast("double"), F.lit(0.0))
        return d.withColumns({
            "signal_ou_entry": sign3(ranging & (c("_dev") < -1.5), ranging & (c("_dev") > 1.5)),
            "ou_filter": c("signal_ensemble_b") * calm,
        }).drop("_dev")

    return Feature(add, 201)


def signal_frame(df: DataFrame, s: Series, vote: str | None = None, regime: str | None = None) -> DataFrame:
    """All rule-based signals of a bar table (which must carry ``funding_rate``), in one pass."""
    d = I.add_session_vwap(df, s.keys)
    return add_features(
        d, s,
        I.rsi(14), I.macd(), I.bollinger(), I.donchian(), I.keltner(), I.flow_imbalance(), I.ichimoku(),
        I.macd_divergence(), I.volatility_size(), Feature(lambda x, b: row_rules(x), 0), window_rules(vote, regime),
    )


def strategy_frame(df: DataFrame, s: Series) -> DataFrame:
    """The signals of the row rules with the side filter and size factor of the ledger, and nothing else to compute."""
    d = I.add_session_vwap(df, s.keys)
    return add_features(
        d, s, I.rsi(14), I.macd(), I.bollinger(), I.donchian(), I.keltner(), I.flow_imbalance(), I.volatility_size(), Feature(lambda x, b: row_rules(x), 0),
    )


def route_by_regime(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Strongest approved signal of the row's regime (first wins ties), else the mean of the approved ones."""
    name, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for code, strategies in REGIME_STRATEGIES.items():
        options = [F.struct(F.lit(n).alias("name"), F.col(STRATEGY_SIGNAL[n]).cast("double").alias("value")) for n in strategies]
        best = options[0]
        for o in options[1:]:
            best = F.when(F.abs(o["value"]) > F.abs(best["value"]), o).otherwise(best)
        total = F.lit(0.0)
        for o in options:
            total = total + o["value"]
        fires = best["value"] != 0
        here = F.col(regime) == code
        name = F.when(here, F.when(fires, best["name"]).otherwise("Ensemble")).otherwise(name)
        value = F.when(here, F.when(fires, best["value"]).otherwise(total / len(options))).otherwise(value)
    return df.withColumns({"strategy": name, "routed_signal": value})


def cross_sectional_momentum(
    df: DataFrame, s: Series, lookback: int = 7, top: float = 0.3, bottom: float = 0.3, min_assets: int = 3,
) -> DataFrame:
    """Percentile rank of the N-bar return among all series at one time, scaled to [-1, 1] at both ends."""
    d = windowed(df, s, lambda x, b: x.withColumn("ret_n", I.bar_return(b, lookback)), back=lookback)
    # one row per series and time, so a group is at most the number of series
    ranked = Window.partitionBy("ts").orderBy("ret_n")
    ties = Window.partitionBy("ts", "ret_n")
    n = F.count("ret_n").over(Window.partitionBy("ts"))
    nulls = F.sum(F.col("ret_n").isNull().cast("int")).over(Window.partitionBy("ts"))
    # nulls sort first: take them out of the rank
    avg_rank = F.rank().over(ranked) - nulls + (F.count("ret_n").over(ties) - 1) / 2
    d = d.withColumns({"_n": n, "_pct": F.when(F.col("ret_n").isNotNull(), avg_rank / n)})
    sig = (
        F.when((F.col("_n") < min_assets) | F.col("_pct").isNull(), 0.0)
        .when(F.col("_pct") <= bottom, -(bottom - F.col("_pct")) / bottom)
        .when(F.col("_pct") >= 1.0 - top, (F.col("_pct") - (1.0 - top)) / top)
        .otherwise(0.0)
    )
    return d.withColumn("momentum_signal", sig).drop("_n", "_pct")


def decay_signal(
    df: DataFrame, s: Series, signal: str, rate: float = 0.1, exit_below: float = 0.2,
) -> DataFrame:
    """Signal strength fading with the bars since its side was entered, and whether it should be exited.

    A position starts where the sign of the signal changes; zero carries the last side.
    """
    side = F.when(F.col(signal) != 0, F.signum(signal))
    d = running(df, s, {"_side": ("last", side)})
    d = windowed(
        d, s,
        lambda x, b: x.withColumn(
            "_entry", F.when(F.col("_side").isNotNull() & ~F.coalesce(b.lag("_side").eqNullSafe(F.col("_side")), F.lit(False)), F.col("_pos"))
        ).withColumn("_at", F.col("_pos")),
        back=1,
    )
    d = running(d, s, {"_since": ("last", F.col("_entry"))})
    held = F.col("_at") - F.col("_since")
    decayed = F.col("_side") * F.exp(-rate * held)
    return d.withColumns({
        "bars_held": held, "decayed_signal": decayed, "should_exit": F.abs(decayed) < exit_below
    }).drop("_side", "_entry", "_since", "_at")


def trainer_donchian(pos: str = "don_pos_20") -> Column:
    """Looser breakout thresholds used when building training features."""
    return sign3(F.col(pos) > 0.95, F.col(pos) < 0.05)


def vote_filter(signal: str, prob: str, threshold: float = 0.55) -> Column:
    """Pass a signal only where the meta model is confident; a missing probability blocks it."""
    return F.when(F.coalesce(F.col(prob) >= threshold, F.lit(False)), F.col(signal)).otherwise(0.0)
