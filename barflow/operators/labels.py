"""Outcome labels for bars and leak-free splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.indicators import true_range
from barflow.plans.ordered import Block, Series, fill_gaps, windowed, with_position
from barflow.plans.ranges import first_passage, pyramid
from barflow.session import reliable_checkpoint


def _range_column(df: DataFrame, s: Series, atr_col: str) -> DataFrame:
    """Barrier unit ``_atr``: the given column filled backward then forward, else a 14-bar mean true range."""
    if atr_col not in df.columns:
        def add(d: DataFrame, b: Block) -> DataFrame:
            return d.withColumn("_tr", true_range(b)).withColumn("_atr", b.roll(F.avg, "_tr", 14, 1)).drop("_tr")

        return windowed(df, s, add, back=15)
    d = fill_gaps(df, s, atr_col, "_fill")
    filled = F.col("_fill")
    # a series without a single value has no barriers at all: fail instead of labelling everything 0
    checked = F.when(filled.isNull(), F.raise_error(F.lit(f"column {atr_col} has no value in a series"))).otherwise(filled)
    return d.withColumn("_atr", checked.cast("double")).drop("_fill")


def _first_hit(df: DataFrame, s: Series, up: Column, down: Column, horizon: int, label: str) -> DataFrame:
    """First future bar within ``horizon`` that touches close + up or close - down."""

    def add(d: DataFrame, b: Block) -> DataFrame:
        ahead = F.collect_list(F.struct("ts", "high", "low")).over(b.frame(1, horizon))
        d = d.withColumns({"_ahead": ahead, "_hi": F.col("close") + up, "_lo": F.col("close") - down, "_tight": up <= down})
        touch = F.filter("_ahead", lambda x: (x["high"] >= F.col("_hi")) | (x["low"] <= F.col("_lo")))
        d = d.withColumn("_hit", F.get(touch, F.lit(0)))
        top, bottom = F.col("_hit.high") >= F.col("_hi"), F.col("_hit.low") <= F.col("_lo")
        value = (
            F.when(F.col("_hit").isNull(), 0)
            .when(top & bottom, F.when(F.col("_tight"), 1).otherwise(-1))
            .when(top, 1).otherwise(-1)
        )
        return d.withColumns({
            label: value,
            "t1": F.coalesce(F.col("_hit.ts"), F.get("_ahead", F.size("_ahead") - 1)["ts"], F.col("ts")),
            "_seen": F.size("_ahead"),
        }).drop("_ahead", "_hi", "_lo", "_tight", "_hit")

    return windowed(df, s, add, back=0, ahead=horizon)


def _first_passage(df: DataFrame, s: Series, up: Column, down: Column, horizon: int, label: str) -> DataFrame:
    """The same for long horizons: the touch is looked up in a pyramid of highs and lows over row positions, so no row carries its future.

    A touch that lies beyond the horizon is none; then ``t1`` is the last bar inside it.
    """
    keys, c = list(s.keys), F.col
    rows = df.drop("t1")
    d = reliable_checkpoint(rows.withColumns({"_hi": c("close") + up, "_lo": c("close") - down, "_tight": up <= down}))
    p = pyramid(d, keys, c("_pos"), {"lo": ("min", "low"), "hi": ("max", "high")})
    ends = d.groupBy(*keys).agg(F.max("_pos").alias("_last"))
    met = d.select(*keys, c("_pos").alias("_at"), c("ts").alias("t1"), c("low").alias("_l"), c("high").alias("_h"))
    d = first_passage(d, p, c("_pos") + 1, c("_lo"), c("_hi"), "_touch").join(ends, keys)
    hit = c("_touch") <= c("_pos") + horizon
    d = d.withColumns({"_at": F.when(hit, c("_touch")).otherwise(F.least(c("_pos") + horizon, c("_last"))), "_is": F.coalesce(hit, F.lit(False))})
    d = d.join(met, [*keys, "_at"], "left")
    top, bottom = c("_h") >= c("_hi"), c("_l") <= c("_lo")
    value = F.when(~c("_is"), 0).when(top & bottom, F.when(c("_tight"), 1).otherwise(-1)).when(top, 1).otherwise(-1)
    return d.withColumns({label: value, "_seen": F.least(F.lit(horizon), c("_last") - c("_pos"))}).select(
        *[x for x in df.columns if x not in (label, "t1", "_seen")], label, "t1", "_seen"
    )


def triple_barrier(
    df: DataFrame, s: Series, pt: float = 2.5, sl: float = 1.5, max_bars: int = 12, atr_col: str = "atr_14",
) -> DataFrame:
    """Adds ``label`` (+1 upper first, -1 lower first, 0 timeout) and ``t1``, when it resolved.

    If one bar touches both barriers the closer one counts (upper on equal distance).
    """
    d = _range_column(df if "_pos" in df.columns else with_position(df, s), s, atr_col)
    d = _first_hit(d, s, pt * F.col("_atr"), sl * F.col("_atr"), max_bars, "label").drop("_atr", "_seen")
    return d if "_pos" in df.columns else d.drop("_pos")


def event_time_labels(
    df: DataFrame, s: Series, k_tp: float = 2.0, k_sl: float = 2.0, horizon: int = 240, atr_col: str = "atr_14",
    vol_window: int = 100,
) -> DataFrame:
    """Barriers scaled by ATR relative to its own mean; rows without a full horizon ahead get label 0."""
    had = "_pos" in df.columns
    d = _range_column(df if had else with_position(df, s), s, atr_col)

    def norm(x: DataFrame, b: Block) -> DataFrame:
        mean = b.roll(F.avg, "_atr", vol_window, 1)
        return x.withColumn("_mean", mean).withColumn(
            "vol_norm", F.when(F.col("_mean") > 0, F.col("_atr") / F.col("_mean")).otherwise(1.0)
        ).drop("_mean")

    d = windowed(d, s, norm, back=vol_window)
    unit = F.col("_atr") * F.col("vol_norm")
    d = _first_passage(d, s, k_tp * unit, k_sl * unit, horizon, "label")
    return d.withColumn("label", F.when(F.col("_seen") < horizon, 0).otherwise(F.col("label"))).drop(
        "_atr", "_seen", *([] if had else ["_pos"])
    )


def label_shares(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Class distribution of labels in percent."""
    pct = lambda v: F.round(F.avg((F.col("label") == v).cast("double")) * 100, 1)
    return df.groupBy(*keys).agg(
        pct(1).alias("long_pct"), pct(-1).alias("short_pct"), pct(0).alias("timeout_pct"), F.count("label").alias("total")
    )


def binary_target(df: DataFrame, positive: int = 1) -> DataFrame:
    """Drop timeouts; target is 1 for the positive label, else 0."""
    return df.where(F.col("label") != 0).withColumn("target", (F.col("label") == positive).cast("int"))


def leak_audit(df: DataFrame, train_end: Column, test_start: Column | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per series: train rows whose label resolves at or after the start of the test period."""
    start = test_start if test_start is not None else train_end + F.expr("INTERVAL '0.000001' SECOND")
    train = F.col("ts") <= train_end
    bad = train & (F.col("t1") >= start)
    return df.groupBy(*keys).agg(
        F.sum(bad.cast("bigint")).alias("n_violations"),
        F.min_by("t1", F.when(bad, F.col("ts"))).alias("first_violation"),
        F.coalesce(F.max(F.when(bad, F.col("t1"))), F.max(F.when(train, F.col("t1")))).alias("purge_until"),
    )


def purge_overlap(df: DataFrame, train_end: Column, test_start: Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Where a series leaks, keep only rows that resolve before the test period; other series are untouched."""
    leaks = leak_audit(df, train_end, test_start, keys).where("n_violations > 0").select(*keys, F.lit(True).alias("_leaks"))
    return df.join(leaks, list(keys), "left").where(F.col("_leaks").isNull() | (F.col("t1") < test_start)).drop("_leaks")


def _numbered(df: DataFrame, s: Series, n_splits: int) -> DataFrame:
    """Positions plus rows per series and fold length.

    The fold edges are looked up in the same table, so it is settled once instead of
    recomputing the labels for every branch.
    """
    d = with_position(df.drop("_pos").select(*s.keys, *dict.fromkeys([*s.order, "ts", "t1"])), s, size="_n")
    return reliable_checkpoint(d.withColumn("_len", F.expr(f"_n div {n_splits}")))


def _fold_edges(numbered: DataFrame, s: Series, n_splits: int, at: str) -> DataFrame:
    """One row per series and fold: first and last value of ``at`` inside the test fold."""
    fold = F.least(F.expr("_pos div greatest(_len, 1)"), F.lit(n_splits - 1))
    return numbered.withColumn("fold", fold.cast("int")).groupBy(*s.keys, "fold").agg(
        F.min_by(at, "_pos").alias("_first"), F.max_by(at, "_pos").alias("_last")
    )


def walk_forward_folds(df: DataFrame, s: Series, n_splits: int = 5, embargo: float = 0.01) -> DataFrame:
    """Long table (series, fold, role, row): train strictly before the embargo and resolved before the test fold."""
    d = _numbered(df, s, n_splits)
    edges = _fold_edges(d, s, n_splits, "ts").select(*s.keys, "fold", "_first")
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).join(edges, [*s.keys, "fold"])
    start = F.col("fold") * F.col("_len")
    stop = F.when(F.col("fold") == n_splits - 1, F.col("_n")).otherwise(start + F.col("_len"))
    gap = F.floor(F.col("_n") * F.lit(embargo))
    has_train = start - gap > 0
    test = (F.col("_pos") >= start) & (F.col("_pos") < stop)
    train = (F.col("_pos") < start - gap) & (F.col("t1") < F.col("_first"))
    d = d.withColumn("role", F.when(test & has_train, "test").when(train, "train")).where(F.col("role").isNotNull())
    # a fold whose train side is emptied by purging is skipped altogether
    some = d.where("role = 'train'").select(*s.keys, "fold").distinct()
    return d.join(some, [*s.keys, "fold"], "left_semi").select(*s.keys, "fold", "role", F.col("_pos").alias("row"))


def two_sided_folds(df: DataFrame, s: Series, n_splits: int = 5, embargo: float = 0.01, bidirectional: bool = True) -> DataFrame:
    """Purged k-fold with train rows on both sides; rows are numbered in resolution-time order."""
    by_t1 = Series(s.keys, ("t1", *s.order), s.cuts, s.rows)
    d = _numbered(df, by_t1, n_splits)
    edges = _fold_edges(d, s, n_splits, "t1")
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).join(edges, [*s.keys, "fold"])
    start = F.col("fold") * F.col("_len")
    stop = F.when(F.col("fold") == n_splits - 1, F.col("_n")).otherwise(start + F.col("_len"))
    gap = F.floor(F.col("_n") * F.lit(embargo))
    p = F.col("_pos")
    test = (p >= start) & (p < stop)
    left = (p < start) & (F.col("t1") < F.col("_first"))
    in_gap = (stop + gap < F.col("_n")) & (p < stop + gap)
    right = (p >= stop) & ~in_gap
    if bidirectional:
        right = right & (F.col("t1") > F.col("_last"))
    return (
        d.withColumn("role", F.when(test, "test").when(left | right, "train")).where(F.col("role").isNotNull())
        .select(*s.keys, "fold", "role", p.alias("row"))
    )


def meta_labels(df: DataFrame, prob: str = "prob", long_at: float = 0.52, short_at: float = 0.48) -> DataFrame:
    """Did the primary model's direction agree with the outcome?  Undecided rows are dropped."""
    side = F.when(F.col(prob) > long_at, 1).when(F.col(prob) < short_at, -1).otherwise(0)
    return df.withColumn("side", side).where("side <> 0").withColumn("meta", (F.col("side") == F.col("label")).cast("int"))
