"""Joins that bring other series onto bars or trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions import text as T
from barflow.functions.numeric import clip, quotient, ratio
from barflow.operators.bars import TIMEFRAME_SECONDS
from barflow.plans.asof import asof_join
from barflow.plans.ordered import Series, running, windowed
from barflow.plans.ranges import range_extrema
from barflow.session import reliable_checkpoint


def merge_funding(bars: DataFrame, funding: DataFrame, keys: Sequence[str] = ("symbol",), fill: bool = True,
                  tolerance: Column | None = None) -> DataFrame:
    """Last known funding rate per bar; ``fill`` turns "none yet" into 0."""
    d = asof_join(bars, funding, keys, "ts", "ts", ["funding_rate"], tolerance=tolerance)
    return d.withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0))) if fill else d


def merge_open_interest(bars: DataFrame, oi: DataFrame, s: Series, timeframe: str) -> DataFrame:
    """Change of open interest at the exact bar time, clipped to +/-1; 0 when absent or for short timeframes."""
    if timeframe not in ("1h", "4h", "1d", "1w"):
        return bars.withColumn("oi_change", F.lit(0.0))
    change = windowed(
        oi, s, lambda d, b: d.withColumn("oi_change", clip(ratio("open_interest", b.lag("open_interest")) - 1, -1, 1)), back=1
    )
    d = bars.join(change.select(*s.keys, "ts", "oi_change"), [*s.keys, "ts"], "left")
    return d.withColumn("oi_change", F.coalesce("oi_change", F.lit(0.0)))


def merge_fear_greed(bars: DataFrame, index: DataFrame, timeframe: str = "1d") -> DataFrame:
    """Daily index / 100 by calendar date, 0.5 when absent (or for other timeframes)."""
    if timeframe != "1d":
        return bars.withColumn("fear_greed", F.lit(0.5))
    day = index.select(F.to_date("ts").alias("_day"), (F.col("value") / 100).alias("fear_greed"))
    d = bars.withColumn("_day", F.to_date("ts")).join(day, "_day", "left").drop("_day")
    return d.withColumn("fear_greed", F.coalesce("fear_greed", F.lit(0.5)))


def hourly_sentiment(news: DataFrame) -> DataFrame:
    """(hour, sentiment, last_hour) of a news table.

    One measure is used for the whole table: tone if any is non-zero, else tanh(score / 50),
    else sentiment, else keyword balance of the title.
    """
    has = lambda c: c in news.columns
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if has(c) else F.lit(0.0)
    title = "title" if has("title") else "summary" if has("summary") else None
    hourly = news.where(F.col("ts").isNotNull()).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.avg(num("tone")).alias("_tone"), F.avg(F.tanh(num("score") / 50)).alias("_score"),
        F.avg(num("sentiment")).alias("_sent"),
        F.avg(T.keyword_tone(title) if title else F.lit(0.0)).alias("_kw"),
        *[F.sum(F.abs(num(c))).alias(f"_any_{c}") for c in ("tone", "score", "sentiment")],
    )
    # at this point there is one row per hour, so a frame over all of them stays small
    everything = Window.partitionBy(F.lit(0))
    any_of = lambda c: F.sum(f"_any_{c}").over(everything) > 0
    return hourly.select(
        "hour",
        F.when(any_of("tone"), F.col("_tone")).when(any_of("score"), F.col("_score"))
        .when(any_of("sentiment"), F.col("_sent")).otherwise(F.col("_kw")).alias("sentiment"),
        F.max("hour").over(everything).alias("last_hour"),
    )


def merge_news_sentiment(bars: DataFrame, news: DataFrame, causal: bool = False) -> DataFrame:
    """Mean sentiment of the hour a bar starts in.

    Hours without news inside the covered range count as 0; after the last covered hour its value
    is carried.  Hours are labelled by their start, so a bar sees news from later in its own
    hour; ``causal`` makes an hour visible only once it is over.
    """
    h = hourly_sentiment(news)
    if causal:
        h = h.withColumns({c: F.col(c) + F.expr("INTERVAL 1 HOUR") for c in ("hour", "last_hour")})
    h = h.withColumnRenamed("hour", "_hour")
    last = h.agg(F.max("last_hour")).scalar()
    d = bars.withColumn("_hour", F.least(F.date_trunc("hour", "ts"), last)).join(h.select("_hour", "sentiment"), "_hour", "left")
    return d.withColumn("news_sentiment", F.coalesce("sentiment", F.lit(0.0))).drop("_hour", "sentiment")


def trailing_mean(df: DataFrame, s: Series, value: str, seconds: float, out: str) -> DataFrame:
    """Mean over the trailing (t - seconds, t] by prefix sums: prefix at t minus prefix as of t - seconds."""
    d = running(df, s, {"_sum": ("sum", F.col(value)), "_cnt": ("sum", F.when(F.col(value).isNotNull(), 1).otherwise(0))})
    # both sides of the join below are made of the sums, and each is read for the carries and for the match
    d = reliable_checkpoint(d)
    ts = s.order[0]
    before = d.select(*s.keys, F.col(ts).alias("_at"), F.col("_sum").alias("_psum"), F.col("_cnt").alias("_pcnt"), *s.order[1:])
    d = d.withColumn("_from", F.timestamp_micros(F.unix_micros(ts) - F.lit(int(seconds * 1_000_000))))
    j = asof_join(d, before, s.keys, "_from", "_at", ["_psum", "_pcnt"], right_tie=s.order[1:])
    n = F.col("_cnt") - F.coalesce("_pcnt", F.lit(0))
    total = F.col("_sum") - F.coalesce("_psum", F.lit(0.0))
    return j.withColumn(out, F.when(n > 0, total / n)).drop("_sum", "_cnt", "_psum", "_pcnt", "_from")


def merge_series(bars: DataFrame, points: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Several macro series ``points(metric, ts, value)`` onto bars with a single as-of join.

    The series are pivoted, filled forward, and carried together.
    """
    wide = points.groupBy("ts").pivot("metric", list(metrics)).agg(F.avg("value")).withColumn("_all", F.lit(0))
    s = Series.sampled(wide, ["_all"], ["ts"])
    filled = running(wide, s, {f"_f_{m}": ("last", F.col(f"`{m}`")) for m in metrics})
    filled = reliable_checkpoint(filled.select("_all", "ts", *[F.col(f"_f_{m}").alias(m) for m in metrics]))
    d = asof_join(bars.withColumn("_all", F.lit(0)), filled, ["_all"], "ts", "ts", list(metrics))
    return d.drop("_all")


def training_frame(bars: DataFrame, funding: DataFrame | None = None, news: DataFrame | None = None,
                   macro: DataFrame | None = None, metrics: Sequence[str] = ()) -> DataFrame:
    """Bars with funding, 24 h news mean and macro series, all as of the bar time; absent sources are skipped."""
    # every as-of join reads its sides for the carries and for the match
    d = reliable_checkpoint(bars)
    if funding is not None:
        d = asof_join(d, funding, ["symbol"], "ts", "ts", ["funding_rate"])
    if news is not None:
        s = Series.sampled(news, ["symbol"], ["ts", "id"])
        mean = reliable_checkpoint(trailing_mean(news, s, "score", 86_400, "news_24h"))
        d = asof_join(reliable_checkpoint(d), mean, ["symbol"], "ts", "ts", ["news_24h"], right_tie=["id"])
    if macro is not None and metrics:
        d = merge_series(reliable_checkpoint(d), macro, metrics)
    return d


def merge_channel_signal(bars: DataFrame, messages: DataFrame, tie: Sequence[str] = ("id",)) -> DataFrame:
    """Latest keyword signal of a message channel, carried forward; 0 before the first message."""
    m = messages.withColumn("channel_signal", T.channel_signal("text")).withColumn("_all", F.lit(0))
    d = asof_join(bars.withColumn("_all", F.lit(0)), m, ["_all"], "ts", "ts", ["channel_signal"], right_tie=list(tie))
    return d.drop("_all").withColumn("channel_signal", F.coalesce("channel_signal", F.lit(0.0)))


def tag_coins(news: DataFrame, title: str = "title") -> DataFrame:
    """One row per matched coin and one ALL row per article."""
    return news.withColumn("coin", F.explode(T.coin_tags(title)))


def trace_trades(trades: DataFrame, signals: DataFrame, models: DataFrame, seconds: float = 60) -> DataFrame:
    """Each trade with the closest signal of its strategy within ``seconds`` (earlier wins ties) and audit flags.

    ``models(strategy, trained_at)`` has one row per strategy.
    """
    sig = signals.select("strategy", "ts", F.col("id").alias("signal_id"))
    gap = F.make_dt_interval(secs=F.lit(float(seconds)))
    d = asof_join(
        trades, sig, ["strategy"], "ts", "ts", ["signal_id"], right_tie=["signal_id"], tolerance=gap,
        direction="nearest", prefer="earlier", matched_ts="signal_ts",
    )
    d = d.join(models, "strategy", "left")
    return d.withColumns({
        "untraced": F.col("signal_id").isNull(),
        "missing_model": F.col("trained_at").isNull(),
        "before_training": F.coalesce(F.col("ts") < F.col("trained_at"), F.lit(False)),
    })


def audit_trades(traced: DataFrame, signals: DataFrame) -> DataFrame:
    """Counts per strategy, including strategies whose signals never led to a trade (orphans)."""
    per = traced.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_trades"),
        *[F.sum(F.col(c).cast("bigint")).alias(f"n_{c}") for c in ("untraced", "missing_model", "before_training")],
        F.count_distinct("signal_id").alias("n_signals_used"),
    )
    used = traced.where(F.col("signal_id").isNotNull()).select("signal_id").distinct()
    orphans = (
        signals.join(used, signals["id"] == used["signal_id"], "left_anti").groupBy("strategy")
        .agg(F.count(F.lit(1)).alias("n_orphans"))
    )
    d = per.join(orphans, "strategy", "full_outer")
    counts = [c for c in d.columns if c != "strategy"]
    return d.select("strategy", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts])


def coverage_grid(symbols: DataFrame, timeframes: Sequence[str]) -> DataFrame:
    """Every (symbol, timeframe) that should exist; each symbol row unfolds into the timeframe list."""
    return symbols.select("symbol", F.explode(F.array(*[F.lit(t) for t in timeframes])).alias("timeframe"))


def coverage_gaps(grid: DataFrame, present: DataFrame, now: Column) -> DataFrame:
    """Status of each cell: missing, stale (lag above three bars) or present, with its first and last bar."""
    seconds = F.create_map(*[F.lit(x) for kv in TIMEFRAME_SECONDS.items() for x in kv])
    d = grid.join(present, ["symbol", "timeframe"], "left")
    lag = (F.unix_micros(now) - F.unix_micros("last_ts")) / 1_000_000
    return d.withColumn("lag_s", lag).withColumn(
        "status",
        F.when(F.col("last_ts").isNull(), "missing")
        .when(F.col("lag_s") > F.coalesce(seconds[F.col("timeframe")], F.lit(3600)) * 3, "stale").otherwise("present"),
    )


def coverage_summary(cells: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    of = lambda v: F.sum((F.col("status") == v).cast("bigint"))
    return cells.agg(
        n.alias("total"), *[of(v).alias(v) for v in ("present", "stale", "missing")],
        F.round(100 * of("present") / n, 1).alias("pct_present"),
    )


def excursions(trades: DataFrame, bars: DataFrame, step_seconds: float, keys: Sequence[str] = ("symbol",),
               trade_id: str = "trade_id") -> DataFrame:
    """Best and worst unrealised result between entry and exit: MFE >= 0, MAE <= 0, as fractions of entry (an entry at zero: infinite, or NaN).

    Rows of one trade, direction and entry price are parts of one trade: one row, with the extremes of all of them.  A trade without an exit has no row.
    """
    ids = [trade_id, "direction", "entry_price"]
    d = range_extrema(
        trades.where(F.col("exit_ts").isNotNull()), bars, keys, F.col("entry_ts"), F.col("exit_ts"), step_seconds,
        {"_hi": ("max", "high"), "_lo": ("min", "low")}, ids,
    ).dropDuplicates(ids)
    up = quotient("_hi", "entry_price") - 1
    down = quotient("_lo", "entry_price") - 1
    long = F.col("direction") > 0
    return d.withColumns({
        "mfe": F.greatest(F.when(long, up).otherwise(-down), F.lit(0.0)),
        "mae": F.least(F.when(long, down).otherwise(-up), F.lit(0.0)),
    }).drop("_hi", "_lo")
