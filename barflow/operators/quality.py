"""Bar validation, coverage and the pre-training gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.numeric import flag
from barflow.operators.bars import TIMEFRAME_SECONDS
from barflow.plans.ordered import Series, runs, windowed

# fixed values: minutes after which the newest bar of a timeframe counts as old
FRESHNESS_MINUTES = {"1m": 4, "5m": 20, "15m": 60, "1h": 240, "4h": 960, "1d": 4_320, "1w": 20_160, "1mo": 86_400}
PRICES = ("open", "high", "low", "close")
TOLERANCE = 1e-9


class DataQualityError(ValueError):
    """Raised by :func:`enforce` when a validation report carries a hard error."""


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """One row per key: the last (first) by ``order``.

    An aggregate with map-side combine instead of a ranked window, so a key with millions
    of copies never meets in one task.
    """
    pick = F.min_by if first else F.max_by
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*keys, "_r.*").select(*df.columns)


def bar_gaps(df: DataFrame, s: Series, timeframe: str) -> DataFrame:
    """(series, gap_start, gap_end, missing_bars) where consecutive bars are more than 1.5 steps apart."""
    step = TIMEFRAME_SECONDS[timeframe]

    def add(d, b):
        return d.withColumn("gap_start", b.lag("ts")).withColumn(
            "_delta", (F.unix_micros("ts") - F.unix_micros("gap_start")) / 1_000_000
        )

    d = windowed(df, s, add, back=1).where(F.col("_delta") > 1.5 * step)
    return d.select(*s.keys, "gap_start", F.col("ts").alias("gap_end"), (F.bround(F.col("_delta") / step) - 1).cast("bigint").alias("missing_bars"))


def zero_volume_runs(df: DataFrame, s: Series, min_bars: int = 60) -> DataFrame:
    """(series, run_start, run_end, bars) of at least ``min_bars`` consecutive bars without volume."""
    r = runs(df, s, F.col("volume") == 0).where("volume = 0")
    return (
        r.groupBy(*s.keys, "run_id")
        .agg(F.min("ts").alias("run_start"), F.max("ts").alias("run_end"), F.count(F.lit(1)).alias("bars"))
        .where(F.col("bars") >= min_bars).drop("run_id")
    )


def validate_bars(
    df: DataFrame, s: Series, timeframe: str, arrival: str = "id", max_move: float = 0.5, max_zero_bars: int = 60,
) -> tuple[DataFrame, DataFrame]:
    """(clean bars, one report row per series).

    Bounds count rows per rule, so one row can count several times.  Duplicate times keep
    the row that arrived last.
    """
    missing = [c for c in (*PRICES, "volume", "ts") if c not in df.columns]
    if missing:
        raise DataQualityError(f"missing columns: {missing}")
    keys = list(s.keys)
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    bad_price = F.lit(False)
    for p in PRICES:
        bad_price = bad_price | (F.col(p) <= 0)
    rules = {
        "bad_price": bad_price,
        "negative_volume": F.col("volume") < 0,
        "high_below_low": F.col("high") < F.col("low"),
        "high_below_body": F.col("high") < top - TOLERANCE,
        "low_above_body": F.col("low") > bottom + TOLERANCE,
    }
    arrived = Series(s.keys, (arrival,), Series.sampled(df, keys, [arrival]).cuts, s.rows)
    order = windowed(df, arrived, lambda d, b: d.withColumn("_back", F.col("ts") < b.lag("ts")), back=1)
    raw = order.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows_in"), *[F.sum(flag(c)).cast("bigint").alias(n) for n, c in rules.items()],
        (F.sum(flag(F.col("_back"))) == 0).alias("monotonic"),
    )
    clean = keep_last(df, [*keys, "ts"], [arrival])

    def moves(d, b):
        return d.withColumn("_move", F.abs(F.try_divide(F.col("close"), b.lag("close")) - 1))

    spikes = windowed(clean, s, moves, back=1).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows_out"), F.sum(flag(F.col("_move") > max_move)).cast("bigint").alias("spikes")
    )
    gaps = bar_gaps(clean, s, timeframe).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gaps"), F.sum("missing_bars").alias("missing_bars")
    )
    zero = zero_volume_runs(clean, s, max_zero_bars).groupBy(*keys).agg(F.count(F.lit(1)).alias("_runs"))
    report = raw.join(spikes, keys).join(gaps, keys, "left").join(zero, keys, "left")
    zero_runs = F.when(F.col("n_rows_out") > max_zero_bars, F.coalesce("_runs", F.lit(0))).otherwise(0)
    bounds = F.lit(0)
    for n in rules:
        bounds = bounds + F.col(n)
    report = report.select(
        *keys, "n_rows_in", "n_rows_out", (F.col("n_rows_in") - F.col("n_rows_out")).alias("duplicates"), *rules,
        "monotonic", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("missing_bars", F.lit(0)).alias("missing_bars"),
        zero_runs.cast("bigint").alias("zero_volume_runs"), "spikes",
        ((bounds > 0) | ~F.col("monotonic")).alias("hard_error"),
    )
    return clean, report


def enforce(report: DataFrame, mode: str = "enforce") -> None:
    """``enforce`` raises on any hard error, ``warn`` and ``off`` let everything pass."""
    if mode == "enforce":
        bad = report.where("hard_error").limit(1).count()
        if bad:
            raise DataQualityError("hard data-quality errors in at least one series")


def month_coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last month and row count per key."""
    month = F.date_format("ts", "yyyy-MM")
    return df.groupBy(*keys).agg(
        F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count_distinct(month).alias("months"),
        F.count(F.lit(1)).alias("rows"),
    )


def null_density(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    total = F.lit(0)
    for c in columns:
        total = total + flag(F.col(c).isNull())
    return df.groupBy(*keys).agg((F.sum(total) / (F.count(F.lit(1)) * len(columns))).alias("nan_pct"))


def class_balance(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Number of classes and share of the rarest one."""
    per = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_classes"), (F.min("_n") / F.sum("_n")).alias("minority_pct")
    )


def freshness(df: DataFrame, timeframe: str, now: Column, keys: Sequence[str], factor: float = 2.0) -> DataFrame:
    """Newest bar per key and whether it is older than the tolerance of its timeframe."""
    minutes = FRESHNESS_MINUTES.get(timeframe, 60) * factor
    cutoff = F.timestamp_micros(F.unix_micros(now) - F.lit(int(minutes * 60_000_000)))
    return df.groupBy(*keys).agg(F.max("ts").alias("last_ts")).withColumn("stale", F.col("last_ts") < cutoff)


def validation_gate(
    fresh: DataFrame, balance: DataFrame, nulls: DataFrame, drift: DataFrame, keys: Sequence[str],
    min_class: float = 0.10, max_nan: float = 0.05,
) -> DataFrame:
    """APPROVE / WARN / BLOCK per key with the first failing rule; drift only warns.

    Inputs are one row per key: ``stale``; ``n_classes, minority_pct``; ``nan_pct``; ``n_drifted``.
    """
    keys = list(keys)
    d = fresh.join(balance, keys, "left").join(nulls, keys, "left").join(drift, keys, "left")
    reason = (
        F.when(F.col("stale"), "stale data")
        .when(F.col("n_classes") < 2, "only one class")
        .when(F.col("minority_pct") < min_class, "label imbalance")
        .when(F.col("nan_pct") > max_nan, "null density")
        .when(F.col("n_drifted") > 0, "distribution drift")
    )
    d = d.withColumn("reason", reason)
    decision = (
        F.when(F.col("reason").isNull(), "APPROVE").when(F.col("reason") == "distribution drift", "WARN").otherwise("BLOCK")
    )
    return d.withColumn("decision", decision)


def go_no_go(coverage: DataFrame, last_rows: DataFrame, models: DataFrame, risk: DataFrame, keys: Sequence[str],
             max_drawdown: float = 5.0) -> DataFrame:
    """Decision summary per key: coverage, newest features, and the list of hard blockers."""
    keys = list(keys)
    d = coverage.join(last_rows, keys, "left").join(models, keys, "left").join(risk, keys, "left")
    blockers = F.array(
        F.when(F.coalesce("rows", F.lit(0)) == 0, "no rows"),
        F.when(~F.coalesce("model_exists", F.lit(False)), "model not trained"),
        F.when(F.coalesce("circuit_breaker", F.lit(False)), "circuit breaker active"),
        F.when(F.coalesce("drawdown_pct", F.lit(0.0)) > max_drawdown, "drawdown above limit"),
    )
    d = d.withColumn("blockers", F.filter(blockers, lambda x: x.isNotNull()))
    return d.withColumn("go", F.size("blockers") == 0)
