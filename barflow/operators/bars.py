"""Ticks to bars, bars to longer bars, and per-bar feature aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.numeric import at_least, ratio
from barflow.plans.ordered import Series, running, windowed

# fixed values: length of each timeframe token in seconds
TIMEFRAME_SECONDS = {
    "1s": 1, "1m": 60, "5m": 300, "15m": 900, "1h": 3_600, "4h": 14_400, "1d": 86_400, "1w": 604_800,
    "1mo": 2_592_000,
}
_MONDAY = 4 * 86_400  # 1970-01-05, the first Monday of the epoch


def bar_start(ts: str | Column, timeframe: str) -> Column:
    """Left edge of the bar a timestamp falls in (weeks start on Monday, months on the 1st)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if timeframe == "1mo":
        return F.date_trunc("month", ts)
    width = TIMEFRAME_SECONDS[timeframe] * 1_000_000
    shift = _MONDAY * 1_000_000 if timeframe == "1w" else 0
    micros = F.unix_micros(ts) - F.lit(shift)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)) + F.lit(shift))


def bars_from_ticks(ticks: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """OHLCV bars from trades ``(keys, ts, id, price, volume, taker)``; empty bars are absent.

    A plain partial + final aggregate: what is shuffled is one row per map task, key and bar.
    """
    at = F.struct("ts", "id")
    return (
        ticks.withColumn("_bar", bar_start("ts", timeframe))
        .groupBy(*keys, F.col("_bar").alias("bar"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"),
            F.sum(F.col("price") * F.col("volume")).alias("quote_volume"),
            F.count(F.lit(1)).alias("trades_count"),
            F.sum("taker").alias("taker_buy_base"),
            F.sum(F.col("price") * F.col("taker")).alias("taker_buy_quote"),
        )
        .withColumnRenamed("bar", "ts")
    )


def resample_bars(
    bars: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",), sums: Sequence[str] | None = None,
) -> DataFrame:
    """Longer bars from shorter ones; rows with a null price are gap markers and are dropped."""
    sums = sums or ["volume", "quote_volume", "trades_count", "taker_buy_base", "taker_buy_quote"]
    return (
        bars.dropna(subset=["open", "high", "low", "close"])
        .groupBy(*keys, bar_start("ts", timeframe).alias("_bar"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .withColumnRenamed("_bar", "ts")
    )


def resample_all(bars: DataFrame, timeframes: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Several timeframes as one table; each is built from the coarsest one before it that divides it."""
    made: dict[str, DataFrame] = {}
    for tf in sorted(timeframes, key=TIMEFRAME_SECONDS.__getitem__):
        base = "1d" if tf == "1mo" else tf
        parents = [p for p in made if TIMEFRAME_SECONDS[base] % TIMEFRAME_SECONDS[p] == 0 and p not in ("1w", "1mo")]
        made[tf] = resample_bars(made[parents[-1]] if parents else bars, tf, keys)
    out = None
    for tf, df in made.items():
        df = df.withColumn("timeframe", F.lit(tf))
        out = df if out is None else out.unionByName(df)
    return out


def seconds_to_minutes(bars: DataFrame, newest: Column, max_days: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One-minute bars of the last ``max_days`` before ``newest``; the filter reaches the scan."""
    return resample_bars(bars.where(F.col("ts") >= newest - F.make_dt_interval(F.lit(max_days))), "1m", keys)


def tick_intensity(seconds: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per-bar microstructure of finer rows ``(ts, high, low, close, volume, trades_count, taker_buy_base)``.

    The frames stay inside one bar of one series, so a task never needs more than a bar.
    """
    part = [*keys, "bar"]
    w = Window.partitionBy(*part).orderBy("ts")
    whole = Window.partitionBy(*part)
    by_volume = Window.partitionBy(*part).orderBy(F.col("vol").desc(), F.col("ts").asc())
    d = (
        seconds.withColumn("bar", bar_start("ts", timeframe))
        .withColumn("vol", at_least("volume", 0.0))
        .withColumn("ret", F.coalesce(ratio("close", F.lag("close").over(w)) - 1, F.lit(0.0)))
        .withColumn("i", F.row_number().over(w) - 1)
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("big", F.row_number().over(by_volume))
    )
    half = F.floor(F.col("n") / 2)
    first = F.col("i") < F.greatest(F.lit(1), half)
    last = F.col("i") >= half
    top = F.col("big") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    pick = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    agg = d.groupBy(*part).agg(
        F.count(F.lit(1)).alias("tick_seconds_count"),
        F.avg("trades_count").alias("tick_count_mean"),
        F.percentile("trades_count", F.lit(0.95)).alias("tick_count_p95"),
        F.sum("taker_buy_base").alias("_taker"),
        F.sum("volume").alias("_vol"),
        F.sum((F.col("high") - F.col("low")) / F.greatest(F.col("close"), F.lit(1e-12))).alias("intra_bar_volatility"),
        F.sum(F.signum("ret") * F.col("vol")).alias("signed_volume_drift"),
        pick(first, "taker_buy_base").alias("_t1"), pick(last, "taker_buy_base").alias("_t2"),
        pick(first, "vol").alias("_v1"), pick(last, "vol").alias("_v2"),
        pick(top, "vol").alias("_top"),
    )
    vol = F.when(F.col("_vol") == 0, 1e-12).otherwise(F.col("_vol"))
    floor12 = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    return agg.select(
        *part, "tick_seconds_count", "tick_count_mean", "tick_count_p95",
        (F.col("_taker") / vol).alias("taker_imbalance"),
        (F.col("_t2") / floor12("_v2") - F.col("_t1") / floor12("_v1")).alias("taker_imbalance_drift"),
        "intra_bar_volatility", (F.col("_top") / vol).alias("volume_concentration"), "signed_volume_drift",
    )


def align_to_bars(bars: DataFrame, features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Left-join per-bar features onto bars with the stable-schema promise: absent means 0."""
    f = features.withColumnRenamed("bar", "ts")
    joined = bars.join(f, [*keys, "ts"], "left")
    return joined.select(*bars.columns, *[F.coalesce(F.col(c), F.lit(0).cast(dict(f.dtypes)[c])).alias(c) for c in columns])


def book_columns(df: DataFrame) -> DataFrame:
    """Mid, micro-price, spread and imbalance of top-of-book rows ``(p_bid, p_ask, v_bid, v_ask)``."""
    depth = F.col("v_bid") + F.col("v_ask")
    mid = (F.col("p_bid") + F.col("p_ask")) / 2
    micro = F.when(depth > 0, (F.col("p_bid") * F.col("v_ask") + F.col("p_ask") * F.col("v_bid")) / depth).otherwise(mid)
    return (
        df.withColumn("mid", mid)
        .withColumn("microprice", micro)
        .withColumn("spread_bps", F.when(mid > 0, (F.col("p_ask") - F.col("p_bid")) / mid * 10_000).otherwise(0.0))
        .withColumn("book_imbalance", F.when(depth > 0, (F.col("v_bid") - F.col("v_ask")) / depth).otherwise(0.0))
    )


def book_flow(df: DataFrame, s: Series, flow_rows: int = 5) -> DataFrame:
    """Snapshot features plus the volume-difference flow and its rolling sum over ``flow_rows`` snapshots."""

    def add(d, b):
        d = d.withColumn(
            "ofi",
            F.coalesce((F.col("v_bid") - b.lag("v_bid")) - (F.col("v_ask") - b.lag("v_ask")), F.lit(0.0)),
        )
        return d.withColumn("ofi_sum", b.roll(F.sum, "ofi", flow_rows, 1))

    return windowed(book_columns(df), s, add, back=flow_rows)


def book_features(snapshots: DataFrame, s: Series, timeframe: str, bars: DataFrame) -> DataFrame:
    """Order-book features per bar.  A bar without snapshots reports ``micro_vs_close`` = -1, as price 0 would."""
    keys = list(s.keys)
    at = F.struct(*s.order)
    f = (
        book_flow(snapshots, s)
        .groupBy(*keys, bar_start("ts", timeframe).alias("bar"))
        .agg(
            F.max_by("microprice", at).alias("l2_microprice"),
            F.max_by("spread_bps", at).alias("l2_spread_bps"),
            F.avg("book_imbalance").alias("l2_imbalance"),
            F.max_by("ofi_sum", at).alias("l2_ofi5"),
            F.percentile("spread_bps", F.lit(0.95)).alias("l2_spread_p95"),
            F.count(F.lit(1)).alias("l2_count"),
        )
    )
    out = align_to_bars(
        bars, f, ["l2_microprice", "l2_spread_bps", "l2_imbalance", "l2_ofi5", "l2_spread_p95", "l2_count"], keys
    )
    gap = F.try_divide(F.col("l2_microprice") - F.col("close"), "close")
    return out.withColumn("l2_micro_vs_close", F.when(F.col("close") > 0, gap).otherwise(0.0))


def news_features(
    news: DataFrame, bars: DataFrame, timeframe: str, decay: float = 0.5, lags: int = 6,
) -> DataFrame:
    """Tone per bar, its 24 h z-score and a decayed tone, for ``news(symbol, ts, tone)`` on ``bars(symbol, ts)``."""
    per_day = max(2, 86_400 // TIMEFRAME_SECONDS[timeframe])
    agg = news.groupBy("symbol", bar_start("ts", timeframe).alias("bar")).agg(
        F.avg("tone").alias("news_mean"), F.max(F.abs("tone")).alias("news_max_abs"), F.count("tone").alias("news_count")
    )
    base = align_to_bars(bars, agg, ["news_mean", "news_max_abs", "news_count"])
    s = Series.on_grid(["symbol"], "ts", TIMEFRAME_SECONDS[timeframe])

    def add(d, b):
        mean = b.roll(F.avg, "news_mean", per_day, 2)
        sd = F.coalesce(b.roll(F.stddev_samp, "news_mean", per_day, 2), F.lit(0.0))
        z = (F.col("news_mean") - mean) / F.when(sd == 0, 1.0).otherwise(sd)
        z = F.coalesce(z, F.lit(0.0))
        d = d.withColumn("news_z24", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)))
        # only bars that exist before this one carry weight
        num, den = F.lit(0.0), F.lit(0.0)
        for k in range(1, lags + 1):
            num = num + F.coalesce(b.lag("news_mean", k), F.lit(0.0)) * decay**k
            den = den + F.when(F.col("_pos") >= k, decay**k).otherwise(0.0)
        return d.withColumn("news_decayed", F.coalesce(F.try_divide(num, den), F.lit(0.0)))

    return windowed(base, s, add, back=max(per_day, lags))


def densify(df: DataFrame, timeframe: str, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Complete the bar grid of every series and carry the last known values forward."""
    step = TIMEFRAME_SECONDS[timeframe]
    ends = df.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    # generate day by day so that no single row explodes into a whole history
    day = F.lit(86_400 * 1_000_000)
    days = ends.withColumn(
        "_day", F.explode(F.sequence(F.floor(F.unix_micros("_a") / day), F.floor(F.unix_micros("_z") / day)))
    )
    width = step * 1_000_000
    lo = F.greatest(F.unix_micros("_a"), F.expr(f"_day * 86400000000L"))
    # first grid point of this day, counted from the series start
    lo = F.unix_micros("_a") + F.ceil((lo - F.unix_micros("_a")) / width) * width
    hi = F.least(F.unix_micros("_z"), F.expr("_day * 86400000000L + 86399999999L"))
    grid = (
        days.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
        .select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(width))).alias("_at"))
        .select(*keys, F.timestamp_micros("_at").alias("ts"))
    )
    s = Series.on_grid(keys, "ts", step)
    joined = grid.join(df, [*keys, "ts"], "left")
    filled = running(joined, s, {f"_f_{c}": ("last", F.col(c)) for c in columns})
    return filled.select(*keys, "ts", *[F.col(f"_f_{c}").alias(c) for c in columns])
