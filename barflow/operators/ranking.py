"""Latest-N, scores, rankings and gates over run histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.numeric import flag
from barflow.operators.indicators import recent_rows
from barflow.plans.ordered import Series

MAX_FIELDS = ("wf_max_dd", "overfit_ratio")
DELTA_FIELDS = ("accuracy_test", "auc_roc", "win_precision")


def latest_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Newest ``n`` rows of a table (a distributed top-n, no global sort)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def last_successful(runs: DataFrame, s: Series, n: int) -> DataFrame:
    """Last ``n`` runs per cell that finished with an artifact and without error or cancellation."""
    ok = F.col("error").isNull() & F.col("artifact_path").isNotNull() & ~F.coalesce("cancelled", F.lit(False))
    return recent_rows(runs.where(ok), s, n)


def to_percent(c: str) -> Column:
    """Fractions in [0, 1] become percent, larger values are percent already."""
    v = F.col(c).try_cast("double")
    return F.when((v >= 0) & (v <= 1), v * 100).otherwise(v)


def composite_score(acc: Column, auc: Column, win: Column) -> Column:
    """0.5 accuracy + 0.3 (50 + (auc - 0.5) 100) + 0.2 win rate, over the parts that are present."""
    parts = [(acc, 0.5), (50.0 + (auc - 0.5) * 100.0, 0.3), (win, 0.2)]
    num, den = F.lit(0.0), F.lit(0.0)
    for value, weight in parts:
        num = num + F.coalesce(value * weight, F.lit(0.0))
        den = den + F.when(value.isNotNull(), weight).otherwise(0.0)
    return F.when(den > 0, num / den)


def present(c: str) -> Column:
    """A zero metric counts as missing, as in the history's scoring."""
    return F.when(F.col(c) != 0, F.col(c))


def rankings(cells: DataFrame, top: int = 5, bottom: int = 5) -> DataFrame:
    """Rank, TOP_i and BOT_i badges by score (ties by key, then timeframe)."""
    d = cells.where(F.col("score").isNotNull()).withColumn("score", F.round("score", 3))
    # one row per model and timeframe: the ranked table is small by nature
    best = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "key", "timeframe")
    worst = Window.partitionBy(F.lit(0)).orderBy(F.col("score").asc(), F.col("key").desc(), F.col("timeframe").desc())
    d = d.withColumns({"rank": F.row_number().over(best), "_back": F.row_number().over(worst)})
    badge = lambda kind, c, n: F.when(F.col(c) <= n, F.concat(F.lit(kind), F.col(c).cast("string")))
    return d.withColumns({"top_badge": badge("TOP_", "rank", top), "bottom_badge": badge("BOT_", "_back", bottom)}).drop("_back")


def bake_off(cells: DataFrame, metric: str, retire_share: float = 0.20, smaller_is_better: bool = False) -> DataFrame:
    """keep / review / retire per cell: bottom share of populated cells goes, cells without a value need review.

    ``cells`` carries the latest metric value and ``retired`` (already retired by the gate).
    """
    v = F.col(metric)
    order = v.asc_nulls_last() if smaller_is_better else v.desc_nulls_last()
    everything = Window.partitionBy(F.lit(0))
    d = cells.withColumns({
        "rank": F.row_number().over(everything.orderBy(order, "model", "tf")), "_n": F.count(v).over(everything)
    })
    cutoff = F.floor(F.col("_n") * F.lit(1.0 - retire_share))
    rec = (
        F.when(F.coalesce("retired", F.lit(False)), "retire").when(v.isNull(), "review")
        .when((F.col("rank") > cutoff) & (F.col("rank") <= F.col("_n")), "retire").otherwise("keep")
    )
    return d.withColumn("recommendation", rec).drop("_n")


def slope_missed(scores: str) -> Column:
    """True when per-fold scores decline: slope over mean below -0.02 and last fold below the first."""
    n = F.size(scores).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    mean = total(F.col(scores)) / n
    mid = (n - 1) / 2
    top = total(F.transform(scores, lambda y, i: (i - mid) * (y - mean)))
    slope = top / (n * (n * n - 1) / 12)
    return F.when(
        F.size(scores) >= 3, (mean > 0) & (slope / mean < -0.02) & (F.element_at(scores, -1) < F.get(scores, F.lit(0)))
    ).otherwise(F.lit(False))


def threshold_misses(runs: DataFrame, thresholds: DataFrame, fields: Sequence[str], run_keys: Sequence[str]) -> DataFrame:
    """Missed fields per run against ``thresholds(model, field, bound)``; null values count as missed."""
    keys = list(run_keys)
    long = runs.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(keys, list(fields), "field", "value")
    # keep absent metrics: unpivot retains null values
    d = long.join(thresholds, ["model", "field"])
    upper = F.col("field").isin(*MAX_FIELDS)
    missed = F.col("value").isNull() | F.when(upper, F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    per = d.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(missed, F.col("field")))).alias("missed"))
    return runs.join(per, keys, "left").withColumn("missed", F.coalesce("missed", F.array().cast("array<string>")))


def kpi_gate(runs_with_misses: DataFrame, s: Series, limit: int = 3) -> DataFrame:
    """Retire a cell when each of its last ``limit`` successful runs missed something."""
    recent = last_successful(runs_with_misses, s, limit)
    failed = F.size("missed") > 0
    d = recent.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum(flag(failed)).cast("bigint").alias("n_failures"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("missed")))).alias("_all"),
    )
    retire = (F.col("n_runs") >= limit) & (F.col("n_failures") >= limit)
    return d.select(*s.keys, "n_runs", "n_failures", retire.alias("retire"),
                    F.when(retire, F.array_join("_all", ",")).otherwise("").alias("missed_fields"))


def winning_parameters(runs: DataFrame, keys: Sequence[str] = ("model", "tf")) -> DataFrame:
    """Hyper-parameters of the best-scored run per cell (the newest on a tie)."""
    return runs.where(F.col("score").isNotNull()).groupBy(*keys).agg(
        F.max_by("hp", F.struct("score", "ts")).alias("hp"), F.max("score").alias("score")
    )


def model_grid(models: DataFrame, latest: DataFrame, retired: DataFrame) -> DataFrame:
    """Every (model, timeframe) a model may run on, with its latest run and retired flag.

    ``models(model, applicable ARRAY, experimental ARRAY)``.
    """
    d = models.withColumn("tf", F.explode(F.array_union("applicable", "experimental"))).select(
        "model", "tf", F.array_contains("experimental", F.col("tf")).alias("experimental")
    )
    d = d.join(latest, ["model", "tf"], "left").join(retired.withColumn("retired", F.lit(True)), ["model", "tf"], "left")
    return d.withColumn("retired", F.coalesce("retired", F.lit(False)))


def with_baseline_deltas(runs: DataFrame, keys: Sequence[str] = ("model", "tf"), fields: Sequence[str] = DELTA_FIELDS) -> DataFrame:
    """The first run of a cell is its baseline (or the one flagged ``is_baseline``); others get deltas to it."""
    keys = list(keys)
    pick = F.min_by if "is_baseline" not in runs.columns else F.max_by
    order = F.col("ts") if "is_baseline" not in runs.columns else F.col("is_baseline").cast("int")
    base = runs.groupBy(*keys).agg(
        pick("run_id", order).alias("baseline_run"), *[pick(f, order).alias(f"_b_{f}") for f in (*fields, "score")]
    )
    d = runs.drop("is_baseline").join(base, keys)
    own = F.col("run_id") == F.col("baseline_run")
    d = d.withColumn("is_baseline", own)
    return d.withColumns({
        f"d_{f}": F.when(~own, F.col(f) - F.col(f"_b_{f}")) for f in (*fields, "score")
    }).drop(*[f"_b_{f}" for f in (*fields, "score")])


def regressions(before: DataFrame, after: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Strategies whose value fell below old x (1 - tolerance) (or old - tolerance when old <= 0)."""
    d = before.select("strategy", F.col("value").alias("old")).join(after.select("strategy", F.col("value").alias("new")), "strategy")
    bound = F.when(F.col("old") > 0, F.col("old") * (1 - tolerance)).otherwise(F.col("old") - tolerance)
    return d.withColumn("regressed", F.col("new") < bound)


def resolve_pins(auto: DataFrame, manual: DataFrame, default: str = "1h") -> DataFrame:
    """Effective timeframe per strategy: manual, else automatic, else the default."""
    d = auto.select("strategy", F.col("timeframe").alias("auto")).join(
        manual.select("strategy", F.col("timeframe").alias("manual")), "strategy", "full_outer"
    )
    set_ = lambda c: F.when(F.col(c) != "", F.col(c))
    return d.select("strategy", F.coalesce("auto", F.lit("")).alias("auto"), F.coalesce("manual", F.lit("")).alias("manual"),
                    F.coalesce(set_("manual"), set_("auto"), F.lit(default)).alias("effective"))


def ranked_strategies(results: DataFrame, min_trades: int = 30, fallback: int = 10) -> DataFrame:
    """Cells with enough trades by Sharpe, then profit factor; a lower bar applies when none reaches the first."""
    # one row per backtest cell
    everything = Window.partitionBy(F.lit(0))
    d = results.withColumn("_q", F.max(flag(F.col("n_trades") >= min_trades)).over(everything))
    d = d.where(F.col("n_trades") >= F.when(F.col("_q") == 1, min_trades).otherwise(fallback)).drop("_q")
    order = everything.orderBy(F.col("sharpe").desc(), F.col("profit_factor").desc_nulls_last(), "strategy", "symbol", "timeframe")
    return d.withColumn("rank", F.row_number().over(order))
