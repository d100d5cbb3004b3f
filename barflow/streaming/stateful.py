"""Keyed state over streams: the online form of recurrences and position machines.

Each key carries a few numbers of state.  Within one micro-batch a key's rows are sorted by
time before they are applied: its columns that are needed are held as arrays (some tens of bytes
a row), all else goes through in chunks.  So size the trigger (``maxFilesPerTrigger`` or the
interval) to what one key may bring.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql import types as T

# Rows of a key that are applied and returned at once.
CHUNK = 20_000
_TYPES = {"double": T.DoubleType(), "bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def keyed_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], state: dict[str, str], step: Callable[[tuple | None, dict], tuple[tuple, dict]],
    out: dict[str, str], carry: Sequence[str] = (), reads: Sequence[str] | None = None,
) -> DataFrame:
    """``step(state, row) -> (state, output columns)`` over each key's rows in time order.

    ``state`` and ``out`` map names to double / bigint / string / boolean; ``carry`` columns pass through.  ``reads`` names the columns that
    ``step`` looks at (all if none are named); others are not sent to it.
    """
    keys, order, carry = list(keys), list(order), list(carry)
    needed = list(dict.fromkeys([*order, *carry, *(reads if reads is not None else df.columns)]))
    df = df.select(*dict.fromkeys([*keys, *needed]))
    fields = [df.schema[k] for k in keys] + [df.schema[c] for c in order if c not in keys] + [df.schema[c] for c in carry]
    schema = T.StructType([*fields, *[T.StructField(n, _TYPES[k]) for n, k in out.items()]])
    state_schema = T.StructType([T.StructField(n, _TYPES[k]) for n, k in state.items()])
    passed = [f.name for f in fields[len(keys):]]

    def run(key, batches, held: GroupState):
        current = held.get if held.exists else None
        pdf = pd.concat([b[needed] for b in batches], ignore_index=True)
        at = pdf[order].sort_values(order).index.to_numpy()
        for start in range(0, len(at), CHUNK):
            part = pdf.iloc[at[start : start + CHUNK]].reset_index(drop=True)
            results: dict[str, list] = {n: [] for n in out}
            for row in part.to_dict("records"):
                current, values = step(current, row)
                for n in out:
                    results[n].append(values[n])
            made = {k: [v] * len(part) for k, v in zip(keys, key)}
            made.update({c: part[c] for c in passed})
            made.update(results)
            if start + CHUNK >= len(at):
                held.update(tuple(current))
            yield pd.DataFrame(made)[[f.name for f in schema.fields]]

    return df.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def ema(df: DataFrame, col: str, alpha: float, keys=("symbol",), order=("ts", "id")) -> DataFrame:
    """Online exponential average."""

    def step(st, row):
        y = row[col] if st is None else (1 - alpha) * st[0] + alpha * row[col]
        return (float(y),), {"ema": float(y)}

    return keyed_fold(df, keys, order, {"y": "double"}, step, {"ema": "double"}, reads=[col])


def loss_streak(df: DataFrame, limit: int = 5, keys=("strategy",), order=("ts", "id")) -> DataFrame:
    """Consecutive losses after each closed trade and whether the limit is reached."""

    def step(st, row):
        n = 0 if row["pnl"] > 0 else (0 if st is None else st[0]) + 1
        return (int(n),), {"losses": int(n), "paused": bool(n >= limit)}

    return keyed_fold(df, keys, order, {"n": "bigint"}, step, {"losses": "bigint", "paused": "boolean"}, reads=["pnl"])


class _TrailingStops(StatefulProcessor):
    """Extremes of a trade since its entry; once stopped, only a mark that a timer removes."""

    def __init__(self, percent: float, keep_seconds: int, columns: list[str]):
        self.percent, self.keep_ms, self.columns = percent, keep_seconds * 1000, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("trade", "high double, low double, stopped boolean, last_us bigint")

    def handleInputRows(self, key, rows, timerValues):
        high, low, stopped, last = self.held.get() if self.held.exists() else (None, None, False, None)
        # one trade's prices of one micro-batch; what is not after the last price seen is late and left out
        d = list(rows)
        d = d[0] if len(d) == 1 else pd.concat(d, ignore_index=True)
        us = d["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        order = np.argsort(us, kind="stable")
        if last is not None:
            order = order[us[order] > last]
        if stopped or not len(order):
            return
        price, entry, long = (d[c].to_numpy(float)[order] for c in ("price", "entry_price", "direction"))
        long = long > 0
        highs = np.maximum.accumulate(np.maximum(price, np.concatenate([[entry[0] if high is None else high], np.full(len(order) - 1, -np.inf)])))
        lows = np.minimum.accumulate(np.minimum(price, np.concatenate([[entry[0] if low is None else low], np.full(len(order) - 1, np.inf)])))
        hit = np.where(long, price <= highs * (1 - self.percent / 100), price >= lows * (1 + self.percent / 100))
        n = int(np.argmax(hit)) + 1 if hit.any() else len(order)
        best, worst = highs / entry - 1, lows / entry - 1
        made = {"mfe_pct": 100 * np.maximum(np.where(long, best, -worst), 0.0), "mae_pct": 100 * np.minimum(np.where(long, worst, -best), 0.0), "stop_hit": hit}
        newest = int(us[order[-1]])
        self.held.update((float(highs[n - 1]), float(lows[n - 1]), bool(hit.any()), newest))
        if hit.any():
            self.handle.registerTimer(max(newest // 1000, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        # columns are put together once: a table of one trade is small, and each step on it costs more than its rows
        yield pd.DataFrame({**{c: d[c].array[order[:n]] for c in self.columns}, **{c: x[:n] for c, x in made.items()}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


# Timers and typed state variables need this store; set it before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def trailing_stop(df: DataFrame, percent: float = 2.0, key: str = "trade_id", keep_seconds: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """Best price, excursions and stop flag of open trades fed with prices ``(trade_id, ts, price, entry_price, direction)``.

    A trade's rows end with its stop.  Its state is then a mark that swallows later prices, and is removed ``keep_seconds`` of event time after.
    Prices that are not after the last one seen of their trade are late and left out.
    """
    columns = [key, "ts", "price", "entry_price", "direction"]
    d = df.select(*columns).withWatermark("ts", delay)
    schema = T.StructType([*d.schema.fields, T.StructField("mfe_pct", T.DoubleType()), T.StructField("mae_pct", T.DoubleType()), T.StructField("stop_hit", T.BooleanType())])
    df.sparkSession.conf.set(*STATE_STORE)
    return d.groupBy(key).transformWithStateInPandas(_TrailingStops(percent, keep_seconds, columns), schema, "append", "EventTime")


def supertrend(df: DataFrame, period: int = 10, mult: float = 3.0, keys=("symbol",), order=("ts",)) -> DataFrame:
    """Online SuperTrend; the true ranges of the last ``period`` bars are part of the state."""

    def number(x):
        return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)

    def step(st, row):
        prev, fu, fl, direction, text = (None, None, None, 1, "") if st is None else (number(st[0]), number(st[1]), number(st[2]), int(st[3]), st[4])
        ranges = [float(x) for x in text.split(" ")] if text else []
        tr = row["high"] - row["low"]
        if prev is not None:
            tr = max(tr, abs(row["high"] - prev), abs(row["low"] - prev))
        ranges = (ranges + [tr])[-period:]
        close, old = row["close"], direction
        if fu is not None and close > fu:
            direction = 1
        elif fl is not None and close < fl:
            direction = -1
        if len(ranges) == period:
            mid, a = (row["high"] + row["low"]) / 2, mult * sum(ranges) / period
            bu, bl = mid + a, mid - a
            fu = bu if fu is None or bu < fu or prev > fu else fu
            fl = bl if fl is None or bl > fl or prev < fl else fl
        line = None if st is None else fl if direction == 1 else fu
        flip = 0.0 if direction == old else float(direction)
        keep = (float(close), fu, fl, direction, " ".join(repr(float(x)) for x in ranges))
        return keep, {"supertrend": line, "supertrend_dir": float(direction), "signal_supertrend": flip}

    return keyed_fold(
        df, keys, order, {"prev": "double", "fu": "double", "fl": "double", "dir": "bigint", "ranges": "string"}, step,
        {"supertrend": "double", "supertrend_dir": "double", "signal_supertrend": "double"}, reads=["high", "low", "close"],
    )


def liveness(df: DataFrame, seconds: int, key: str = "agent", delay: str = "1 second") -> DataFrame:
    """One row whenever an agent has sent nothing for ``seconds`` of event time (state timers)."""
    schema = T.StructType([df.schema[key], T.StructField("last_us", T.LongType())])
    state_schema = T.StructType([T.StructField("last_us", T.LongType())])

    def run(k, batches, held: GroupState):
        if held.hasTimedOut:
            yield pd.DataFrame({key: [k[0]], "last_us": [held.get[0]]})
            held.remove()
            return
        newest = max(int(pd.to_datetime(b["ts"]).astype("int64").max() // 1000) if str(b["ts"].dtype).startswith("datetime64[ns") else int(b["ts"].astype("datetime64[us]").astype("int64").max()) for b in batches)
        last = max(newest, held.get[0]) if held.exists else newest
        held.update((last,))
        due = last // 1000 + seconds * 1000
        held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs() + 1))

    d = df.select(key, "ts").withWatermark("ts", delay)
    return d.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
