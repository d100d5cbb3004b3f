"""Training matrices: bars to features, joins, labels and the columns a model is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.numeric import flag, sign3
from barflow.operators import alignment as A
from barflow.operators import indicators as I
from barflow.operators import labels as L
from barflow.operators.derive import calendar, taker_features
from barflow.operators.indicators import Feature, add_features
from barflow.operators.signals import trainer_donchian
from barflow.plans.ordered import Series, with_position

# fixed values: feature columns of each model
FEATURES = {
    "base": [
        "frac_diff_d40", "volatility", "dist_sma_7", "dist_sma_30", "rsi_14", "macd", "macd_hist", "volume_momentum", "stoch_k",
        "return_lag1", "return_lag2", "return_lag3", "return_lag5", "atr_pct", "taker_buy_ratio", "avg_trade_size", "hour", "day_of_week",
        "roc_14", "roc_3", "roc_7", "bb_pb", "news_sentiment", "ofi_z", "vwap_dist", "liq_proximity", "trend_strength", "vol_regime",
        "is_trending", "is_volatile", "signal_rsi", "signal_macd", "signal_bb", "oi_change_pct", "fear_greed_norm",
    ],
    "trend": [
        "frac_diff_d40", "macd", "macd_signal", "macd_hist", "trend_alignment", "volume_surge", "atr_14", "adx_14", "don_pos_20", "kc_pos",
        "kc_width", "vwap_dist", "ofi_z", "funding_z", "taker_buy_ratio", "avg_trade_size", "signal_macd", "signal_don", "trend_strength",
        "vol_regime", "is_trending", "is_volatile", "news_sentiment",
    ],
    "futures": [
        "frac_diff_d40", "rsi_14", "dist_to_support", "volume_drop", "hour", "roc_5", "ofi_z", "funding_z", "funding_positive",
        "funding_negative", "dist_to_supply", "liq_proximity", "signal_rsi", "trend_strength", "vol_regime", "is_trending", "is_volatile",
        "news_sentiment",
    ],
    "scalping": [
        "frac_diff_d40", "rsi_7", "macd_fast", "volume_surge", "dist_to_micro_supp", "taker_buy_ratio", "avg_trade_size", "hour", "roc_3",
        "roc_5", "roc_10", "bb_pb", "ofi_z", "vwap_dist", "kc_pos", "signal_rsi", "signal_bb", "trend_strength", "vol_regime", "is_trending",
        "is_volatile", "news_sentiment",
    ],
}
# fixed values: columns whose nulls drop a row (all features where none are named); other nulls of the matrix become 0
NEEDED = {"trend": ["atr_14", "close", "t1"]}
# fixed values: barrier parameters (upper, lower, bars); the trend horizon depends on the timeframe
BARRIERS = {"base": (4.0, 2.0, 24), "futures": (4.0, 2.0, 12), "scalping": (1.5, 1.5, 5)}
# fixed values: bars of the trend horizon by timeframe
TREND_BARS = {"1m": 240, "15m": 192, "1h": 96, "4h": 48, "1d": 20, "1w": 12}


def _volume_flag(out: str, n: int, factor: float, above: bool) -> Feature:
    def add(d, b):
        mean = b.roll(F.avg, "volume", n) * factor
        return d.withColumn(out, flag(F.col("volume") > mean if above else F.col("volume") < mean))

    return Feature(add, n)


def _floor_distance(out: str, n: int) -> Feature:
    return Feature(lambda d, b: d.withColumn(out, F.try_divide(F.col("close") - b.roll(F.min, "low", n), "close")), n)


def _returns() -> Feature:
    def add(d, b):
        d = d.withColumn("return", I.bar_return(b))
        return d.withColumns({"volatility": b.roll(F.stddev_samp, "return", 7), **{f"return_lag{k}": b.lag("return", k) for k in (1, 2, 3, 5)}})

    return Feature(add, 9)


def _rules(columns: dict) -> Feature:
    return Feature(lambda d, b: d.withColumns(columns), 0)


def _features(kind: str) -> list[Feature]:
    c = F.col
    common = [I.fractional_diff(), _returns(), I.atr(14), I.trend_flags()]
    if kind == "base":
        shape = _rules({"volume_momentum": c("volume_momentum"), "atr_pct": c("range_pct")})
        signals = _rules({
            "signal_rsi": sign3(c("rsi_14") < 30, c("rsi_14") > 70), "signal_macd": F.when(c("macd_hist") > 0, 1.0).otherwise(-1.0),
            "signal_bb": sign3(c("bb_pb") < 0.1, c("bb_pb") > 0.9),
        })
        return [*common, I.rsi(14), I.macd(), I.bollinger(20), I.roc(3, 7, 14), I.flow_imbalance(20), I.liquidity_proximity(), I.price_shape(), shape, signals]
    if kind == "trend":
        align = Feature(lambda d, b: d.withColumn("trend_alignment", flag(b.roll(F.avg, "close", 50) > b.roll(F.avg, "close", 200))), 200)
        signals = _rules({"signal_macd": F.when(c("macd_hist") > 0, 1.0).otherwise(-1.0), "signal_don": trainer_donchian()})
        return [*common, I.macd(), I.adx(14), I.flow_imbalance(20), I.donchian(20), I.keltner(), I.funding_zscore(), align, _volume_flag("volume_surge", 20, 1.5, True), signals]
    if kind == "futures":
        signals = _rules({"signal_rsi": sign3(c("rsi_14") < 30, c("rsi_14") > 70)})
        return [*common, I.rsi(14), I.roc(5), I.flow_imbalance(20), I.funding_zscore(), I.liquidity_proximity(), signals, _floor_distance("dist_to_support", 30), _volume_flag("volume_drop", 7, 0.7, False)]
    if kind == "scalping":
        fast = I.macd(5, 13, 3)
        signals = _rules({"macd_fast": c("macd"), "signal_rsi": sign3(c("rsi_7") < 25, c("rsi_7") > 75), "signal_bb": sign3(c("bb_pb") < 0.1, c("bb_pb") > 0.9)})
        return [*common, I.rsi(7), fast, I.bollinger(10), I.roc(3, 5, 10), I.flow_imbalance(10), I.keltner(10, 1.5, 5), _volume_flag("volume_surge", 5, 2.0, True), _floor_distance("dist_to_micro_supp", 15), signals]
    raise ValueError(f"unknown matrix {kind!r}")


def training_matrix(
    kind: str, bars: DataFrame, s: Series, timeframe: str, news: DataFrame | None = None, open_interest: DataFrame | None = None,
    fear_greed: DataFrame | None = None,
) -> DataFrame:
    """Features, ``label``, ``t1`` and ``target`` of one model for all series at once.

    Timeouts are dropped and so are rows with a null in any feature the model uses, but for the trend matrix, which only needs a range and a
    label and has 0 for what is still unknown.  ``bars`` must carry ``funding_rate`` for the trend and futures matrices.
    """
    d = with_position(taker_features(calendar(bars)), s)
    if kind in ("base", "trend", "scalping"):
        d = I.add_session_vwap(d, s.keys)
    d = add_features(d, s, *_features(kind))
    d = A.merge_news_sentiment(d, news) if news is not None else d.withColumn("news_sentiment", F.lit(0.0))
    if kind == "base":
        d = A.merge_open_interest(d, open_interest, s, timeframe) if open_interest is not None else d.withColumn("oi_change", F.lit(0.0))
        d = A.merge_fear_greed(d, fear_greed, timeframe) if fear_greed is not None else d.withColumn("fear_greed", F.lit(0.5))
        d = d.withColumnsRenamed({"oi_change": "oi_change_pct", "fear_greed": "fear_greed_norm"})
    pt, sl, horizon = (4.0, 2.0, TREND_BARS.get(timeframe, 96)) if kind == "trend" else BARRIERS[kind]
    d = L.triple_barrier(d, s, pt, sl, horizon)
    d = L.binary_target(d, -1 if kind == "futures" else 1)
    columns = FEATURES[kind]
    d = d.dropna(subset=NEEDED.get(kind, columns)).select(*s.keys, *s.order, *columns, "label", "t1", "target")
    return d.fillna(0, subset=columns) if kind in NEEDED else d


def sequence_frame(bars: DataFrame, s: Series, timeframe: str) -> DataFrame:
    """Dense, forward-filled feature frame for a sequence model (absent sources are 0)."""
    from barflow.operators.bars import densify

    columns = ["open", "high", "low", "close", "volume", "trades_count", "taker_buy_base", "funding_rate"]
    d = densify(bars, timeframe, columns, s.keys)
    d = d.withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0)))
    d = add_features(taker_features(calendar(d)), s, I.flow_imbalance(20), Feature(lambda x, b: x.withColumn("return", F.coalesce(I.bar_return(b), F.lit(0.0))), 1))
    return d.withColumn("sentiment_score", F.lit(0.0)).where(F.col("close").isNotNull())
