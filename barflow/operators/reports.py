"""Summary tables over results, trades, ledgers and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.numeric import flag
from barflow.functions.text import log_signature
from barflow.operators.bars import TIMEFRAME_SECONDS
from barflow.plans.ordered import Series, running

RATIOS = ("win_rate_pct", "sharpe", "sortino", "calmar", "max_drawdown_pct", "profit_factor")
BUCKETS = ("pure_rule", "ml_driven", "meta_filtered")
# fixed values: log lines that count, and the exception names of raw tracebacks
LEVEL_PATTERN = r"(?i)(?:^|\s)-\s+(WARNING|ERROR|CRITICAL|FATAL)\s+-\s"
TRACEBACK_PATTERN = r"\b(?:[A-Z][A-Za-z]+Error|FatalError|SystemExit|KeyboardInterrupt):\s"


def series_inventory(df: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table; each count is answered from file footers where the source allows it."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def latest_times(stores: Sequence[DataFrame], now: Column, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Newest bar per series over several stores, hours behind ``now`` and whether that is over 1.5 bars."""
    keys = list(keys)
    out = None
    for df in stores:
        m = df.groupBy(*keys).agg(F.max("ts").alias("ts"))
        out = m if out is None else out.unionByName(m)
    seconds = F.create_map(*[F.lit(x) for kv in TIMEFRAME_SECONDS.items() for x in kv])
    d = out.groupBy(*keys).agg(F.max("ts").alias("last_ts"))
    behind = (F.unix_micros(now) - F.unix_micros("last_ts")) / 1_000_000
    return d.select(
        *keys, "last_ts", (behind / 3600).alias("gap_hours"),
        (behind > 1.5 * F.coalesce(seconds[F.col("timeframe")], F.lit(3600))).alias("needs_recovery"),
    )


def plain_name(c: str = "strategy") -> Column:
    """Strategy without its A_ / B_ group prefix."""
    return F.trim(F.regexp_replace(F.col(c), "^[AB]_", ""))


def strategy_summary(results: DataFrame, walk_forward: DataFrame) -> DataFrame:
    """Per strategy over symbols: summed trades and money, mean ratios, symbols, and its walk-forward row."""
    avg3 = lambda c: (F.round(F.avg(c), 3) + 0.0).alias(c)
    d = results.withColumn("strategy", plain_name()).where("strategy <> ''").groupBy("strategy").agg(
        F.sum("n_trades").cast("bigint").alias("n_trades"),
        *[F.round(F.sum(c), 2).alias(c) for c in ("total_pnl", "gross_pnl", "total_fees")],
        F.round(F.round(F.avg("win_rate_pct"), 3), 1).alias("win_rate_pct"),
        *[avg3(c) for c in RATIOS if c != "win_rate_pct"], F.count_distinct("symbol").alias("symbols"),
    )
    wf = walk_forward.groupBy("strategy").agg(*[F.max_by(c, "ts").alias(c) for c in ("wf_mean_sharpe", "wf_consistency")])
    return d.join(wf, "strategy", "left")


def _cell_means(results: DataFrame, walk_forward: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    avg3 = lambda c, out: (F.round(F.avg(c), 3) + 0.0).alias(out)
    d = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_trades").cast("bigint").alias("n_trades"), F.round(F.sum("total_pnl"), 2).alias("total_pnl"),
        avg3("sharpe", "sharpe_avg"), avg3("win_rate_pct", "win_rate_avg"), avg3("max_drawdown_pct", "maxdd_avg"), avg3("profit_factor", "profit_factor_avg"),
    )
    wf = walk_forward.groupBy(*keys).agg(avg3("wf_mean_sharpe", "wf_sharpe_avg"), avg3("wf_consistency", "wf_consistency_avg"))
    return d.join(wf, keys, "left")


def stability_matrix(results: DataFrame, walk_forward: DataFrame) -> DataFrame:
    """Long (strategy, timeframe) matrix of means over symbols."""
    return _cell_means(results.withColumn("strategy", plain_name()), walk_forward, ["strategy", "timeframe"])


def best_timeframes(matrix: DataFrame) -> DataFrame:
    """Timeframe with the highest walk-forward Sharpe (else Sharpe); the larger name on a tie."""
    score = F.coalesce("wf_sharpe_avg", "sharpe_avg")
    d = matrix.where(score.isNotNull()).groupBy("strategy").agg(
        F.max_by("timeframe", F.struct(score, "timeframe")).alias("best_timeframe"), F.max(score).alias("score")
    )
    return d


def pivot_matrix(matrix: DataFrame, value: str, timeframes: Sequence[str]) -> DataFrame:
    """Wide view of one measure, one column per timeframe."""
    return matrix.groupBy("strategy").pivot("timeframe", list(timeframes)).agg(F.first(value))


def bucket_of(strategy: Column, uses_model: Column) -> Column:
    return F.when(F.endswith(strategy, F.lit("_MetaFiltered")), "meta_filtered").when(
        F.coalesce(uses_model, F.lit(False)), "ml_driven"
    ).otherwise("pure_rule")


def bucket_compare(results: DataFrame, walk_forward: DataFrame, registry: DataFrame) -> DataFrame:
    """Means per bucket (rules, models, meta-filtered); every bucket appears even without strategies.

    ``registry(strategy, uses_model)`` has one row per strategy.
    """
    tag = lambda d: d.withColumn("strategy", plain_name()).join(registry, "strategy", "left").withColumn(
        "bucket", bucket_of(F.col("strategy"), F.col("uses_model"))
    )
    d = _cell_means(tag(results), tag(walk_forward), ["bucket"])
    spark = results.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket"))
    d = names.join(d, "bucket", "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_cells", "n_trades", "total_pnl")})


def group_means(results: DataFrame) -> DataFrame:
    """Mean Sharpe, win rate and PnL of group A and group B strategies."""
    d = results.withColumn("group", F.regexp_extract("strategy", "^([AB])_", 1)).where("`group` <> ''")
    return d.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("sharpe", "win_rate_pct", "total_pnl")]
    )


def portfolio_snapshot(trades: DataFrame, day_start: Column, keys: Sequence[str] = ("mode",)) -> DataFrame:
    """Open and closed counts; live, closed and today's PnL."""
    st = F.upper(F.coalesce("status", F.lit("")))
    money = lambda cond, c: F.sum(F.when(cond, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.sum(flag(st == "OPEN")).cast("bigint").alias("n_open"), F.sum(flag(st == "CLOSED")).cast("bigint").alias("n_closed"),
        money(st == "OPEN", "unrealized_pnl").alias("live_pnl"), money(st == "CLOSED", "pnl").alias("closed_pnl"),
        money((st == "CLOSED") & (F.col("closed_at") >= day_start), "pnl").alias("today_pnl"),
    )


def balance_events(deposits: DataFrame, pnl: DataFrame) -> DataFrame:
    """One ledger of (account, ts, id, kind, amount) from deposits and closed-trade results."""
    tag = lambda d, k: d.select("account", "ts", "id", F.lit(k).alias("kind"), "amount")
    return tag(deposits, "deposit").unionByName(tag(pnl, "revenue"))


def balance_summary(events: DataFrame, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Deposits against revenue: equity is both, pnl is equity minus deposits."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("amount")).otherwise(0.0))
    d = events.groupBy(*keys).agg(
        of("deposit").alias("deposits_total"), F.sum(flag(F.col("kind") == "deposit")).cast("bigint").alias("deposits_count"),
        of("revenue").alias("revenue_total"),
    )
    d = d.withColumn("equity", F.col("deposits_total") + F.col("revenue_total"))
    return d.withColumn("pnl", F.round(F.col("equity") - F.col("deposits_total"), 6))


def balance_curve(events: DataFrame, s: Series) -> DataFrame:
    """Running equity after every ledger event."""
    return running(events, s, {"equity": ("sum", F.col("amount"))})


def pattern_stats(outcomes: DataFrame, keys: Sequence[str] = ("model", "scenario", "pattern")) -> DataFrame:
    """Occurrences, wins, losses, mean result and win rate per observed pattern."""
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("won"))).cast("bigint").alias("wins"),
        F.sum(flag(~F.col("won"))).cast("bigint").alias("losses"), F.round(F.avg("pnl"), 4).alias("avg_pnl"),
        F.round(F.avg(flag(F.col("won"))) * 100, 1).alias("win_rate"),
    )


def training_summary(events: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Totals per model and the newest run's accuracy, loss and Sharpe."""
    at = F.struct("ts", "id")
    return events.groupBy(*keys).agg(
        F.sum("bars_trained").alias("bars_trained"), F.count(F.lit(1)).alias("cycles"), F.max("ts").alias("last_trained"),
        *[F.max_by(c, at).alias(c) for c in ("accuracy", "loss", "sharpe")],
    )


def paper_summary(trades: DataFrame) -> DataFrame:
    return trades.agg(
        F.count(F.lit(1)).alias("total_trades"), F.round(F.coalesce(F.sum("pnl"), F.lit(0.0)), 2).alias("total_pnl"),
        F.round(F.coalesce(F.avg("pnl"), F.lit(0.0)), 4).alias("avg_pnl"), F.max("exit_ts").alias("last_exit"),
    )


def log_severity(line: Column, benign: str | None = None) -> Column:
    """critical / warning from the level marker, critical for raw tracebacks, null for lines that do not count."""
    level = F.upper(F.regexp_extract(line, LEVEL_PATTERN, 1))
    kind = (
        F.when(level.isin("ERROR", "CRITICAL", "FATAL"), "critical").when(level == "WARNING", "warning")
        .when(line.rlike(TRACEBACK_PATTERN), "critical")
    )
    return F.when(~line.rlike(benign), kind) if benign else kind


def error_signatures(lines: DataFrame, since: Column | None = None, benign: str | None = None, width: int | None = None) -> DataFrame:
    """Error groups of ``lines(file, ts, id, line)``: count, first and last time, newest sample; ``width`` cuts the sample for display."""
    d = lines.withColumn("kind", log_severity(F.col("line"), benign)).where(F.col("kind").isNotNull())
    if since is not None:
        d = d.where(F.col("ts") >= since)
    return d.groupBy("kind", "file", log_signature("line").alias("signature")).agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max_by(F.trim(F.col("line")) if width is None else F.substring(F.trim(F.col("line")), 1, width), F.struct("ts", "id")).alias("sample"),
    )
