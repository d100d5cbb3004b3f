"""Signals to trades: position timing, sizing, equity and walk-forward tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions.numeric import ratio
from barflow.operators.trades import FEE_PRESETS, PER_YEAR, summary
from barflow.plans.ordered import Block, Series, running, with_halo, with_position
from barflow.session import reliable_checkpoint

THRESHOLD = 0.1


def melt_signals(df: DataFrame, signals: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per bar and strategy; a bar's shared columns (its position too) are kept."""
    rest = [c for c in df.columns if c not in signals]
    return df.select(*rest, *[F.col(c).cast("double").alias(c) for c in signals]).unpivot(rest, list(signals), "strategy", "signal")


# Columns of a trade that do not depend on its size.
_TIMED = ["entry_pos", "exit_pos", "entry_us", "exit_us", "direction", "entry_close", "exit_close", "size_mult", "funding_share", "forced", "n_bars"]
# Trades whose equity is followed together.
SEGMENT = 64


def candidates(df: DataFrame, s: Series, max_hold: int = 48) -> DataFrame:
    """The trade that every bar would start if no position were open there: exit on the next opposite signal or after ``max_hold`` bars.

    The signal acts one bar later.  ``side_filter`` blocks entries against its sign; what is still open on a series' last bar closes there
    (``forced``).  Optional columns: funding_rate, size_mult, side_filter.  All columns come from windows inside haloed blocks.
    """
    optional = {"funding_rate": 0.0, "size_mult": 1.0, "side_filter": 0.0}
    d = df if {"_pos", "_n"} <= set(df.columns) else with_position(df.drop("_pos"), s, size="_n")
    for c, v in optional.items():
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit(v)).cast("double")) if c in d.columns else d.withColumn(c, F.lit(v))
    keys, c = list(s.keys), F.col
    b = Block(s.keys)
    blocked = with_halo(d.select(*keys, "_pos", "_n", F.unix_micros("ts").alias("_us"), "close", "signal", *optional), s, 1, max_hold)
    x = blocked.withColumn("_s", F.coalesce(b.lag("signal"), F.lit(0.0))).where(F.col("_pos") >= F.col("_blk") * s.rows)
    upto = b.frame(Window.unboundedPreceding, 0)
    x = x.withColumn("_bar", F.struct(c("_pos").alias("pos"), c("_us").alias("us"), c("close").cast("double").alias("close"), F.sum(F.abs("funding_rate")).over(upto).alias("fund")))
    # later rows come first in this order, so that frames over them grow row by row
    w = Window.partitionBy(*b.part).orderBy(c("_pos").desc())
    later, from_here = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    next_bar = lambda when: F.last(F.when(when, c("_bar")), ignorenulls=True).over(later)
    x = x.withColumns({
        "_long": next_bar(c("_s") > THRESHOLD), "_short": next_bar(c("_s") < -THRESHOLD), "_end": F.first("_bar").over(from_here), "_late": F.lag("_bar", max_hold).over(w),
    })
    side = F.when((c("_s") > THRESHOLD) & ~(c("side_filter") < 0), 1).when((c("_s") < -THRESHOLD) & ~(c("side_filter") > 0), -1)
    x = x.where("_core").withColumn("direction", side).where("direction is not null")
    flip = F.when(c("direction") == 1, c("_short")).otherwise(c("_long"))
    flips = flip.isNotNull() & (flip["pos"] <= c("_pos") + max_hold)
    x = x.withColumns({"_exit": F.when(flips, flip).when(c("_late").isNotNull(), c("_late")).otherwise(c("_end")), "forced": ~F.coalesce(flips, F.lit(False)) & c("_late").isNull()})
    return x.select(
        *keys, "_blk", c("_pos").alias("entry_pos"), c("_exit.pos").alias("exit_pos"), c("_us").alias("entry_us"), c("_exit.us").alias("exit_us"), "direction",
        c("_bar.close").alias("entry_close"), c("_exit.close").alias("exit_close"), "size_mult", (c("_exit.fund") - c("_bar.fund")).alias("funding_share"), "forced", c("_n").alias("n_bars"),
    )


class _Jumps:
    """A block's candidates with their jumps: the candidate that follows when a trade is over, doubled until all have left the block."""

    def __init__(self, pdf: pd.DataFrame, rows: int):
        self.entry, self.exit = pdf["entry_pos"].to_numpy(np.int64), pdf["exit_pos"].to_numpy(np.int64)
        self.start = int(pdf["_blk"].iloc[0]) * rows
        self.stop, self.n = self.start + rows, len(self.entry)
        after = np.where(pdf["forced"].to_numpy(bool), self.n, np.searchsorted(self.entry, self.exit))
        self.levels = [np.append(after, self.n)]
        while (self.levels[-1] < self.n).any():
            self.levels.append(self.levels[-1][self.levels[-1]])

    def left_over(self, offsets: np.ndarray) -> np.ndarray:
        """Bars of the next block that are not free yet, when ``offsets`` bars of this one are not."""
        free = self.start + offsets
        at = np.searchsorted(self.entry, free)
        for level in reversed(self.levels):
            at = np.where(level[at] < self.n, level[at], at)
        over = np.append(self.exit, 0)[at]
        return np.maximum(np.where(at < self.n, over, free) - self.stop, 0)

    def taken(self, offset: int) -> np.ndarray:
        """Candidates that become trades."""
        at = np.searchsorted(self.entry, self.start + offset)
        found = np.array([at] if at < self.n else [], np.int64)
        for level in reversed(self.levels):
            found = np.union1d(found, level[found])
            found = found[found < self.n]
        return found


def position_trades(df: DataFrame, s: Series, max_hold: int = 48) -> DataFrame:
    """Entry and exit of every trade per series: price-independent timing of the position machine.

    A position closes on an opposite signal or after ``max_hold`` bars and may reopen on the same bar.  What a trade would be is known for every bar
    (``candidates``); which bars start one follows from jumps to the next candidate once a trade is over.  A block is summarised by the bars of the next one that
    it leaves taken, for every number (0..max_hold) that it may find taken itself; these short tables are chained per series.
    """
    keys = list(s.keys)
    d = reliable_checkpoint(candidates(df, s, max_hold))
    lean = d.select(*keys, "_blk", "entry_pos", "exit_pos", "forced")
    typed = lambda names: [T.StructField(k, d.schema[k].dataType) for k in names]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        jumps = _Jumps(pdf.sort_values("entry_pos", ignore_index=True), s.rows)
        return pdf[[*keys, "_blk"]].head(1).assign(_left=[jumps.left_over(np.arange(max_hold + 1)).tolist()])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ignore_index=True)
        taken, at, found = 0, 0, []
        for blk, left in zip(pdf["_blk"], pdf["_left"]):
            taken = max(taken - (int(blk) - at) * s.rows, 0)  # blocks without candidates
            found.append(taken)
            taken, at = int(left[taken]), int(blk) + 1
        return pdf[[*keys, "_blk"]].assign(_taken=np.array(found, np.int64))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_pos", ignore_index=True)
        found = _Jumps(pdf, s.rows).taken(int(pdf["_taken"].iloc[0]))
        return pdf.iloc[found].assign(_segment=np.arange(len(found), dtype=np.int64) // SEGMENT)[[*keys, "_blk", "_segment", *_TIMED]]

    left = lean.groupBy(*keys, "_blk").applyInPandas(summarise, T.StructType([*typed([*keys, "_blk"]), T.StructField("_left", T.ArrayType(T.LongType()))]))
    starts = left.groupBy(*keys).applyInPandas(chain, T.StructType([*typed([*keys, "_blk"]), T.StructField("_taken", T.LongType())]))
    ready = d.join(starts, [*keys, "_blk"])
    out = T.StructType([*typed([*keys, "_blk"]), T.StructField("_segment", T.LongType()), *typed(_TIMED)])
    return ready.groupBy(*keys, "_blk").applyInPandas(replay, out).withColumns({"entry_ts": F.timestamp_micros("entry_us"), "exit_ts": F.timestamp_micros("exit_us")})


_SIZED = ["entry_price", "exit_price", "size", "fees", "funding", "pnl", "equity"]
# Equity at the start of all segments is settled when no start moves by more than this share, looked at after so many rounds.
SETTLED, ROUNDS = 1e-12, 4


def size_trades(
    trades: DataFrame, s: Series, initial: float = 10_000.0, share: float = 0.10, preset: str = "futures",
    slippage: float | None = None, depth: float = 50_000.0,
) -> DataFrame:
    """Prices after slippage, size, fees, funding, PnL and equity after each trade of ``position_trades``; nothing trades after ruin.

    Equity compounds: a trade's size, and with it its slippage, depends on all trades before.  A segment of trades multiplies equity by a factor that
    hardly depends on the equity it starts with, so all segments are followed at once from a guess; the running product of their factors gives better
    starts, until these stand still.  After k rounds the first k segments are exact whatever the guess, so this ends; flat slippage needs one.
    """
    keys = list(s.keys)
    maker, taker = FEE_PRESETS[preset]
    c = F.col

    def sized(before: Column, t: Callable[[str], Column]) -> dict[str, Column]:
        size = before * share * t("size_mult")
        slip = F.lit(slippage) if slippage is not None else F.least(F.lit(0.005), 0.001 * F.sqrt(F.greatest(size, F.lit(1.0)) / max(depth, 1.0)))
        entry, leave = t("entry_close") * (1 + slip * t("direction")), t("exit_close") * (1 - slip * t("direction"))
        fees, funding = size * taker + size * F.when(t("forced"), taker).otherwise(maker), t("funding_share") * size
        pnl = F.coalesce(F.try_divide(leave - entry, entry), F.lit(0.0)) * t("direction") * size - fees - funding
        return dict(zip(_SIZED, (entry, leave, size, fees, funding, pnl, before + pnl)))

    def after(before: Column, t: Column) -> Column:
        return F.when(before > 0, sized(before, lambda name: t[name])["equity"]).otherwise(before)

    d = trades.groupBy(*keys, "_blk", "_segment").agg(
        F.sort_array(F.collect_list(F.struct("entry_pos", *[x for x in trades.columns if x not in (*keys, "_blk", "_segment", "entry_pos")]))).alias("_trades")  # SEGMENT trades at most
    ).withColumn("_start", F.lit(float(initial)))
    # one narrow row for SEGMENT trades; the running product streams
    earlier = Window.partitionBy(*keys).orderBy("_blk", "_segment").rowsBetween(Window.unboundedPreceding, -1)
    factor = F.coalesce(F.try_divide(F.aggregate("_trades", c("_start"), after), c("_start")), F.lit(1.0))
    product = initial * F.coalesce(F.product("_factor").over(earlier), F.lit(1.0))
    moved = F.abs(c("_start") - c("_last")) > SETTLED * F.greatest(F.abs("_start"), F.lit(1.0))
    while True:
        for _ in range(ROUNDS):
            d = d.withColumn("_factor", factor).withColumns({"_last": c("_start"), "_start": product})
        d = reliable_checkpoint(d)
        if d.where(moved).isEmpty():
            break
    path = F.aggregate("_trades", F.array("_start"), lambda acc, t: F.concat(acc, F.array(after(F.element_at(acc, -1), t))))
    rows = d.select(*keys, "_blk", "_segment", path.alias("_path"), F.posexplode("_trades").alias("_i", "_t")).withColumn("_before", F.get("_path", c("_i")))
    rows = rows.where("_before > 0").select(*keys, "_blk", "_segment", "_t.*", "_before")
    return rows.withColumns(sized(c("_before"), c)).select(*trades.columns, *_SIZED)


def bar_equity(bars: DataFrame, trades: DataFrame, s: Series, initial: float = 10_000.0) -> DataFrame:
    """Equity at every bar: that of the last trade closed at or before it, the initial capital before any."""
    keys = list(s.keys)
    at = trades.groupBy(*keys, F.col("exit_pos").alias("_pos")).agg(F.max_by("equity", "entry_pos").alias("_eq"))
    numbered = bars if "_pos" in bars.columns else with_position(bars.select(*keys, *s.order), s)
    d = numbered.select(*keys, *s.order, "_pos").join(at, [*keys, "_pos"], "left")
    d = running(d, s, {"_last": ("last", F.col("_eq"))})
    return d.select(*keys, *s.order, F.coalesce("_last", F.lit(initial)).alias("equity"))


def at_exits(trades: DataFrame, s: Series, initial: float = 10_000.0, per_year: float = PER_YEAR) -> DataFrame:
    """The performance table of sized trades: equity only moves on bars on which a trade ends, so no curve over all bars is needed."""
    keys, c = list(s.keys), F.col
    by_bar = Series(s.keys, ("exit_pos",), _PositionCuts(s.rows), s.rows)
    curve = trades.groupBy(*keys, "exit_pos").agg(F.max_by("equity", "entry_pos").alias("equity"))
    curve = running(curve, by_bar, {"_before": ("last", c("equity")), "_peak": ("max", c("equity"))}, exclusive=True)
    start = F.lit(float(initial))
    curve = curve.withColumns({"_before": F.coalesce("_before", start), "_peak": F.greatest("equity", "_peak", start)})
    r = ratio("equity", "_before") - 1
    curve = curve.withColumn("_r", r).groupBy(*keys).agg(
        F.sum("_r").alias("_sum"), F.sum(c("_r") * c("_r")).alias("_squares"), F.stddev_samp(F.when(c("_r") < 0, c("_r"))).alias("_dn"),
        F.least(F.lit(0.0), F.min(F.try_divide(c("equity") - c("_peak"), "_peak"))).alias("max_drawdown"), F.max_by("equity", "exit_pos").alias("_last"),
    )
    bars = trades.groupBy(*keys).agg(F.max("n_bars").alias("_n"))
    m = c("_n") - 1
    curve = curve.join(bars, keys).withColumns({
        "_m": F.try_divide("_sum", m), "_sd": F.sqrt(F.greatest(F.try_divide(c("_squares") - c("_sum") * c("_sum") / m, m - 1), F.lit(0.0))), "_first": start,
    })
    return summary(trades, curve, keys, per_year)


class _PositionCuts:
    """Cuts of a trade table by bar position: at most two trades end on one bar."""

    def __init__(self, rows: int):
        self.rows = rows

    def apply(self, df: DataFrame, order: Sequence[str], out: str = "_cut") -> DataFrame:
        return df.withColumn(out, F.expr(f"`{order[0]}` div {self.rows}"))


def backtest(bars: DataFrame, s: Series, max_hold: int = 48, **sizing) -> tuple[DataFrame, DataFrame]:
    """(trades, performance table) of ``bars`` with a ``signal`` column, per series of ``s``; bars are read once."""
    trades = reliable_checkpoint(size_trades(position_trades(bars, s, max_hold), s, **sizing))
    return trades, at_exits(trades, s, sizing.get("initial", 10_000.0))


def walk_forward(bars: DataFrame, s: Series, n_folds: int = 5, max_hold: int = 48, **sizing) -> DataFrame:
    """Backtest on sequential windows per series: mean and deviation of Sharpe, mean PnL, consistency, decay.  Bars are read twice."""
    keys = list(s.keys)
    d = bars.withColumnRenamed("_n", "_total") if {"_pos", "_n"} <= set(bars.columns) else with_position(bars.drop("_pos"), s, size="_total")
    size = F.greatest(F.lit(48), F.expr(f"_total div {n_folds + 2}"))
    d = d.withColumn("_len", size).withColumn("fold", (F.expr("_pos div _len") - 1).cast("int")).where(f"fold between 0 and {n_folds - 1}")
    begin = (F.col("fold") + 1) * F.col("_len")
    d = d.withColumn("_n", F.least(begin + F.col("_len"), F.col("_total")) - begin).where("_n >= 20").withColumn("_pos", F.col("_pos") - begin)
    per_fold = Series((*s.keys, "fold"), s.order, s.cuts, s.rows)
    _, perf = backtest(d.drop("_len", "_total"), per_fold, max_hold, **sizing)
    f = d.select(*keys, "fold").distinct().join(perf, [*keys, "fold"], "left").withColumns({
        "sharpe": F.coalesce("sharpe", F.lit(0.0)), "total_pnl": F.coalesce("total_pnl", F.lit(0.0))
    })
    return f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.round(F.avg("sharpe"), 3).alias("wf_mean_sharpe"), F.round(F.stddev_pop("sharpe"), 3).alias("wf_std_sharpe"),
        F.round(F.avg("total_pnl"), 2).alias("wf_mean_pnl"), F.round(F.avg((F.col("total_pnl") > 0).cast("int")), 2).alias("wf_consistency"),
        F.round(F.max_by("total_pnl", "fold") - F.min_by("total_pnl", "fold"), 2).alias("wf_decay"),
    )
