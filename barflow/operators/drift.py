"""Distribution baselines and drift checks, for all features of all cells at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.plans.quantiles import order_statistics, quantiles_of_counts, value_counts
from barflow.session import reliable_checkpoint

# fixed values: thresholds of the drift report and features that may pause trading
PSI_WARN, PSI_PAUSE, WASSERSTEIN_WARN = 0.10, 0.25, 0.15
HARD_FEATURES = [
    "ofi_z", "ofi", "funding_z", "macd_hist", "macd_signal", "frac_diff_d40", "atr_14", "rsi_14", "kc_pos", "kc_width",
    "don_pos_20", "vwap_dist", "trend_strength", "vol_regime", "taker_buy_ratio",
]
Z_LIMIT = 2.58
# Shuffled bytes of value counts for one task: they compress well, so that tasks of Spark's default size would need gigabytes for their hash tables and sorts.
COUNT_BYTES = "1m"


def melt(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form (keys, feature, value) of numeric columns; nulls are dropped."""
    d = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])
    return d.unpivot(list(keys), list(features), "feature", "value").where(F.col("value").isNotNull())


def _bin_of(edges: str, x) -> "F.Column":
    """0-based bin of x in ascending edges; the last bin is closed on the right."""
    below = F.size(F.filter(edges, lambda e: e <= x))
    return F.least(below, F.size(edges) - 1) - 1


def counted(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one reduction that all measures come from: (keys, feature, value, ``_n``), settled; counts are returned as they are.

    Equal values combine before the shuffle, so a hot value is one row a task, and the values of a hot feature spread over all tasks.
    """
    return long if "_n" in long.columns else _small_tasks(value_counts(long, [*keys, "feature"], "value"))


def _small_tasks(df: DataFrame) -> DataFrame:
    """A checkpoint whose tasks read at most ``COUNT_BYTES`` of value counts, as far as there are shuffle partitions."""
    conf, size = df.sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = conf.get(size, None)
    try:
        conf.set(size, COUNT_BYTES)
        return reliable_checkpoint(df)
    finally:
        conf.set(size, held) if held is not None else conf.unset(size)


def baseline(long: DataFrame, keys: Sequence[str], n_bins: int = 10, min_values: int = 10) -> DataFrame:
    """Per (keys, feature): mean, std, q05, q95, n, ``bin_edges`` and ``bin_props``.  ``long`` is read once."""
    counts = counted(long, keys)
    keys = [*keys, "feature"]
    probs = [0.05, 0.95, *[i / n_bins for i in range(n_bins + 1)]]
    q = quantiles_of_counts(counts, keys, "value", probs, "q").where(F.col("n") >= min_values)
    mean = counts.groupBy(*keys).agg((F.sum(F.col("value") * F.col("_n")) / F.sum("_n")).alias("mean"))
    away = F.col("value") - F.col("mean")
    moments = counts.join(F.broadcast(mean), keys).groupBy(*keys, "mean").agg(F.sqrt(F.try_divide(F.sum(away * away * F.col("_n")), F.sum("_n") - 1)).alias("std"))
    edges = F.array_distinct(F.array_sort(F.slice("q", 3, n_bins + 1)))
    q = q.withColumn("_e", edges)
    head = F.slice("_e", 1, F.greatest(F.size("_e") - 1, F.lit(1)))
    last = F.element_at("_e", -1) + 1e-9
    q = q.withColumn("bin_edges", F.concat(head, F.array(last)))
    stats = q.join(moments, keys).select(
        *keys, "mean", "std", F.get("q", F.lit(0)).alias("q05"), F.get("q", F.lit(1)).alias("q95"), "n", "bin_edges"
    )
    stats = _small_tasks(stats)  # one row per feature, used twice below
    return stats.join(bin_shares(counts, stats, keys), keys)


def bin_shares(counts: DataFrame, edges: DataFrame, keys: Sequence[str], clip: bool = False) -> DataFrame:
    """Share of counted values per bin of ``edges(keys, bin_edges)`` as an array ``bin_props`` (zeros kept)."""
    e = edges.select(*keys, "bin_edges")
    x = F.col("value")
    d = counts.join(F.broadcast(e), list(keys))  # one row a feature; a join by the few keys would put a whole feature into one task
    if clip:
        lo, hi = F.get("bin_edges", F.lit(0)), F.element_at("bin_edges", -1)
        eps = F.greatest(F.lit(1e-9), (hi - lo) * 1e-6)
        x = F.greatest(lo + eps, F.least(hi - eps, x))
    by_bin = d.groupBy(*keys, _bin_of("bin_edges", x).alias("_bin")).agg(F.sum("_n").alias("_n"))
    # at most one row per bin from here on
    by_bin = by_bin.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_m"), F.sum("_n").alias("_t"))
    d = by_bin.join(e, list(keys))
    share = F.transform(
        F.sequence(F.lit(0), F.size("bin_edges") - 2), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)) / F.col("_t")
    )
    return d.select(*keys, share.alias("bin_props"))


def psi(base: DataFrame, long: DataFrame, keys: Sequence[str], floor: float = 1e-4) -> DataFrame:
    """Population stability index of actual values (or their counts) against a baseline, per (keys, feature)."""
    counts = counted(long, keys)
    keys = [*keys, "feature"]
    actual = bin_shares(counts, base, keys, clip=True).withColumnRenamed("bin_props", "_actual")
    d = base.join(actual, keys)
    term = F.zip_with(
        "_actual", "bin_props",
        lambda p, q: (F.greatest(p, F.lit(floor)) - F.greatest(q, F.lit(floor)))
        * F.ln(F.greatest(p, F.lit(floor)) / F.greatest(q, F.lit(floor))),
    )
    return d.select(*keys, F.aggregate(term, F.lit(0.0), lambda a, x: a + x).alias("psi"))


def wasserstein_relative(base: DataFrame, long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Earth mover's distance between baseline bin midpoints and actual values (or their counts), over the edge span.

    The distance is the area between both distribution functions F and G.  F is a step function with steps at the midpoints, so between two of them G
    crosses it once, at an order statistic of the actual values.  With these crossings, the area is a sum of partial moments
    E[max(t - X, 0)] at midpoints and crossings, which come from the counts and sums of the values between these thresholds.
    """
    counts = counted(long, keys)
    keys, c = [*keys, "feature"], F.col
    usable = base.where(F.size("bin_edges") > 1)
    mid = F.zip_with("bin_edges", F.slice("bin_edges", 2, F.size("bin_edges")), lambda a, b: (a + b) / 2)
    steps = usable.withColumns({"_mid": F.slice(mid, 1, F.size("bin_edges") - 1), "_u": F.transform("bin_props", lambda p: p / F.aggregate("bin_props", F.lit(0.0), lambda a, x: a + x))})
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    # height of F after each midpoint
    upto = F.transform(F.sequence(F.lit(1), F.size("_mid")), lambda i: F.aggregate(F.slice("_u", 1, i), F.lit(0.0), lambda a, x: a + x))
    steps = steps.join(total, keys).select(*keys, "bin_edges", "_mid", "_t", upto.alias("_f"))
    steps = steps.withColumn("_ranks", F.transform("_f", lambda f: F.greatest(F.least(F.ceil(f * c("_t")), c("_t")) - 1, F.lit(0)).cast("bigint")))
    held = order_statistics(counts, keys, "value", steps.select(*keys, "_ranks")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_held"))  # one a bin
    clamp = lambda x, i: F.greatest(F.get("_mid", i), F.least(F.get("_mid", i + 1), x))
    crossing = F.transform(F.slice("_ranks", 1, F.size("_mid") - 1), lambda r, i: clamp(F.try_element_at("_held", r), i))
    steps = _small_tasks(steps.join(held, keys).withColumn("_cross", crossing).withColumn("_marks", F.array_sort(F.array_distinct(F.concat("_mid", "_cross")))))
    at = F.size(F.filter("_marks", lambda m: m <= c("value")))
    # values count from the first midpoint, so that narrow spans of large values keep their digits
    origin = F.get("_mid", F.lit(0))
    parts = counts.join(F.broadcast(steps.select(*keys, "_marks", "_mid")), keys).groupBy(*keys, at.alias("_at")).agg(F.sum("_n").alias("_n"), F.sum(c("_n") * (c("value") - origin)).alias("_s"))
    parts = parts.groupBy(*keys).agg(F.collect_list(F.struct("_at", "_n", "_s")).alias("_parts"))  # one more than marks at most
    d = steps.join(parts, keys)

    def below(t: Column) -> Column:
        """E[max(t - X, 0)] at a mark t: parts up to the one that begins at t."""
        rank = F.array_position("_marks", t)
        return F.aggregate("_parts", F.lit(0.0), lambda a, p: a + F.when(p["_at"] < rank, (t - origin) * p["_n"] - p["_s"]).otherwise(0.0)) / c("_t")

    mean = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["_s"]) / c("_t")
    last = F.element_at("_mid", -1)

    def area(x: Column, i: Column) -> Column:
        lo, hi, f = F.get("_mid", i), F.get("_mid", i + 1), F.get("_f", i)
        return f * (2 * x - lo - hi) - 2 * below(x) + below(lo) + below(hi)

    inner = F.aggregate(F.transform("_cross", area), F.lit(0.0), lambda a, x: a + x)
    raw = below(origin) + inner + (mean - (last - origin) + below(last))
    span = F.element_at("bin_edges", -1) - F.get("bin_edges", F.lit(0))
    return d.select(*keys, F.when(span > 0, raw / span).otherwise(raw).alias("wasserstein_rel"))


def drift_report(
    base: DataFrame, long: DataFrame, keys: Sequence[str], hard: Sequence[str] = tuple(HARD_FEATURES), min_values: int = 30,
) -> DataFrame:
    """Severity ok / warn / pause per (keys, feature); only hard features can pause.  ``long`` is read once, ``base`` too."""
    k = [*keys, "feature"]
    base = reliable_checkpoint(base)  # a baseline is a small stored table; every measure below reads it
    counts = counted(long, keys)
    enough = counts.groupBy(*k).agg(F.sum("_n").alias("n_actual")).where(F.col("n_actual") >= min_values)
    d = psi(base, counts, keys).join(wasserstein_relative(base, counts, keys), k).join(enough, k)
    is_hard = F.col("feature").isin(list(hard))
    severity = (
        F.when(F.col("psi") >= PSI_PAUSE, F.when(is_hard, "pause").otherwise("warn"))
        .when((F.col("psi") >= PSI_WARN) | (F.col("wasserstein_rel") >= WASSERSTEIN_WARN), "warn").otherwise("ok")
    )
    return d.withColumns({"severity": severity, "is_hard": is_hard})


def mean_shift(base: DataFrame, long: DataFrame, keys: Sequence[str], min_values: int = 10) -> DataFrame:
    """z-test of the mean against a baseline without bins."""
    k = [*keys, "feature"]
    now = long.groupBy(*k).agg(F.avg("value").alias("_m"), F.count(F.lit(1)).alias("n_actual")).where(F.col("n_actual") >= min_values)
    d = now.join(base.select(*k, "mean", "std"), k)
    z = F.abs(F.col("_m") - F.col("mean")) / (F.greatest("std", F.lit(1e-9)) / F.sqrt("n_actual"))
    return d.select(*k, "n_actual", z.alias("z"), (z > Z_LIMIT).alias("drifted"))


def pause_state(polls: DataFrame, keys: Sequence[str], confirm_after: int = 3) -> DataFrame:
    """Halt decision per cell from its poll history ``(ts, pause_count, enforce_pause_count)``.

    An enforce-tier pause in the newest poll halts at once, any other pause only after
    ``confirm_after`` consecutive paused polls.  The streak is counted from the last clean poll.
    """
    keys = list(keys)
    clean = polls.groupBy(*keys).agg(
        F.max(F.when(F.col("pause_count") == 0, F.col("ts"))).alias("_clean"),
        F.max_by("pause_count", "ts").alias("pause_count"), F.max_by("enforce_pause_count", "ts").alias("_enforce"),
    )
    after = polls.select(*keys, "ts").join(clean, keys).where(F.col("_clean").isNull() | (F.col("ts") > F.col("_clean")))
    streak = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("_streak"))
    d = clean.join(streak, keys, "left").withColumn("consecutive", F.coalesce("_streak", F.lit(0)))
    tier = (
        F.when(F.col("pause_count") == 0, "clean").when(F.col("_enforce") > 0, "immediate")
        .when(F.col("consecutive") >= confirm_after, "confirmed").otherwise("watch")
    )
    d = d.withColumn("tier", tier)
    return d.select(*keys, "pause_count", "consecutive", "tier", F.col("tier").isin("immediate", "confirmed").alias("paused"))
