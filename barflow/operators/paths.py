"""Path-dependent indicators: SuperTrend bands and ZigZag pivots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.operators.indicators import true_range
from barflow.plans.fold import fold_blocks, interval_apply, interval_summary
from barflow.plans.ordered import Series, running, windowed, with_position


def _band(df: DataFrame, s: Series, basic: str, out: str, sign: int) -> DataFrame:
    """Ratcheting band: the basic value if it is tighter or the previous close crossed, else the last band.

    ``sign`` -1 turns the lower band into the same rule on negated values.
    """

    def arrays(pdf):
        return sign * pdf[basic].to_numpy(float), sign * pdf["_prev"].to_numpy(float)

    def step(bu, prev):
        def go(v, i):
            if math.isnan(bu[i]):
                return v
            return float(bu[i]) if v is None or bu[i] < v or prev[i] > v else v

        return go

    def walk(pdf, state):
        bu, prev = arrays(pdf)
        go, v, path = step(bu, prev), state, np.full(len(bu), np.nan)
        for i in range(len(bu)):
            v = go(v, i)
            path[i] = np.nan if v is None else v
        return path, v

    def summarise(pdf):
        if pdf["_pos"].iloc[0] == 0:  # the series starts here, so its end state is known
            return {"end": walk(pdf, None)[1]}
        bu, prev = arrays(pdf)
        if np.isnan(bu).any():
            return {"end": walk(pdf, None)[1]} if np.isnan(bu).all() else _late(pdf)
        value = lambda i: float(bu[i])
        return interval_summary(prev, bu, value, value, step(bu, prev))

    def _late(pdf):
        """Warm-up still running: before the first band value there is nothing to carry."""
        return {"end": walk(pdf, None)[1]}

    def advance(summary, state):
        if "end" in summary:
            return summary["end"]
        return interval_apply(summary, state)[1]

    def replay(pdf, state):
        path, _ = walk(pdf, state)
        return pd.DataFrame({"_pos": pdf["_pos"], out: sign * path})

    schema = T.StructType([T.StructField("_pos", T.LongType()), T.StructField(out, T.DoubleType())])
    return fold_blocks(df, s, [basic, "_prev"], summarise, advance, replay, None, schema)


def supertrend(df: DataFrame, s: Series, period: int = 10, mult: float = 3.0) -> DataFrame:
    """Trailing stop line, direction and flip signal.

    Only the two bands are sequential; the direction is "the last band that was crossed".
    """
    had = "_pos" in df.columns
    d = df if had else with_position(df, s)

    def basics(x, b):
        x = x.withColumn("_tr", true_range(b)).withColumn("_prev", b.lag("close"))
        a, mid = mult * b.roll(F.avg, "_tr", period), (F.col("high") + F.col("low")) / 2
        return x.withColumns({"_bu": mid + a, "_bl": mid - a}).drop("_tr")

    d = windowed(d, s, basics, back=period + 1)
    keys = [*s.keys, "_pos"]
    d = d.join(_band(d, s, "_bu", "_fu", 1), keys).join(_band(d, s, "_bl", "_fl", -1), keys)
    clean = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    d = d.withColumns({"_fu": clean("_fu"), "_fl": clean("_fl")})
    d = windowed(
        d, s,
        lambda x, b: x.withColumn(
            "_cross", F.when(F.col("close") > b.lag("_fu"), 1).when(F.col("close") < b.lag("_fl"), -1)
        ),
        back=1,
    )
    d = running(d, s, {"_last": ("last", F.col("_cross")), "_old": ("last", F.when(F.col("_pos") == 0, 1))})
    d = d.withColumn("supertrend_dir", F.coalesce("_last", F.lit(1)).cast("double"))
    d = windowed(
        d, s,
        lambda x, b: x.withColumn(
            "signal_supertrend",
            F.when((F.col("supertrend_dir") == 1) & (b.lag("supertrend_dir") == -1), 1.0)
            .when((F.col("supertrend_dir") == -1) & (b.lag("supertrend_dir") == 1), -1.0).otherwise(0.0),
        ),
        back=1,
    )
    line = F.when(F.col("_pos") > 0, F.when(F.col("supertrend_dir") == 1, F.col("_fl")).otherwise(F.col("_fu")))
    d = d.withColumn("supertrend", line).drop("_bu", "_bl", "_prev", "_fu", "_fl", "_cross", "_last", "_old")
    return d if had else d.drop("_pos")


def zigzag(df: DataFrame, s: Series, deviation: float = 0.05) -> DataFrame:
    """Pivots (series, ts, price, kind): a move of ``deviation`` against the extreme confirms it; the last extreme is kept.

    State: [direction up?, pivot high, pivot low, pivot position, pivot time, kind].
    """
    up_limit, down_limit = 1 - deviation, 1 + deviation

    def cols(pdf):
        return (pdf["high"].to_numpy(float), pdf["low"].to_numpy(float), pdf["_pos"].to_numpy(np.int64), pdf["_us"].to_numpy(np.int64))

    def mark(c, i, up):
        return [bool(up), float(c[0][i]), float(c[1][i]), int(c[2][i]), int(c[3][i]), "high" if up else "low"]

    def step(c, emit=None):
        high, low = c[0], c[1]

        def go(st, i):
            if st[0]:
                if high[i] > st[1]:
                    return mark(c, i, True)
                if st[1] > low[i] / up_limit:
                    if emit is not None:
                        emit(st)
                    return mark(c, i, False)
                return st
            if low[i] < st[2]:
                return mark(c, i, False)
            if st[2] < high[i] / down_limit:
                if emit is not None:
                    emit(st)
                return mark(c, i, True)
            return st

        return go

    def first(c):
        st = mark(c, 0, True)
        st[5] = "unknown"
        return st

    def summarise(pdf):
        c = cols(pdf)
        go = step(c)
        if pdf["_pos"].iloc[0] == 0:
            st = first(c)
            for i in range(1, len(pdf)):
                st = go(st, i)
            return {"end": st}
        up = interval_summary(c[0], c[1] / up_limit, lambda i: mark(c, i, True), lambda i: mark(c, i, False), go)
        # falling: the pivot low survives while high/(1+d) <= low <= low[i]; below flips up, above makes a new low
        down = interval_summary_low(c, go)
        return {"up": up, "down": down}

    def interval_summary_low(c, go):
        # a new low has precedence over a reversal, so mirror the axis to test it first
        return interval_summary(-c[1], -c[0] / down_limit, lambda i: mark(c, i, False), lambda i: mark(c, i, True), go)

    def advance(summary, state):
        if "end" in summary:
            return summary["end"]
        known, value = interval_apply(summary["up"], state[1]) if state[0] else interval_apply(summary["down"], -state[2])
        return value if known else state

    def replay(pdf, state):
        c = cols(pdf)
        found: list = []
        go, begin = step(c, found.append), 0
        if pdf["_pos"].iloc[0] == 0:
            state, begin = first(c), 1
        for i in range(begin, len(pdf)):
            state = go(state, i)
        if pdf["_pos"].iloc[-1] == pdf["_n"].iloc[-1] - 1:
            found.append(state)
        return pd.DataFrame({
            "_us": pd.array([p[4] for p in found], dtype="int64"),
            "price": pd.array([p[2] if p[5] == "low" else p[1] for p in found], dtype="float64"),
            "kind": pd.array([p[5] for p in found], dtype="object"),
        })

    numbered = with_position(df, s, size="_n").withColumn("_us", F.unix_micros("ts"))
    schema = T.StructType([T.StructField("_us", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("kind", T.StringType())])
    d = fold_blocks(numbered, s, ["high", "low", "_us", "_n"], summarise, advance, replay, None, schema)
    return d.select(*s.keys, F.timestamp_micros("_us").alias("ts"), "price", "kind")
