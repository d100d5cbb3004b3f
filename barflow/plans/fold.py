"""Exact sequential state machines, run block by block in parallel.

A state machine over a long series looks like one task per series.  Here each block
is first summarised as a function "state at its start -> state at its end"; the
(short) chain of summaries gives every block its true starting state; then all
blocks are replayed independently.  Nothing larger than a block is ever held.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.plans.ordered import Series, with_halo, with_position
from barflow.session import reliable_checkpoint

Summarise = Callable[[pd.DataFrame], object]
Advance = Callable[[object, object], object]
Replay = Callable[[pd.DataFrame, object], pd.DataFrame]


def fold_blocks(
    df: DataFrame, s: Series, columns: Sequence[str], summarise: Summarise, advance: Advance, replay: Replay,
    initial: object, out: T.StructType, back: int = 0,
) -> DataFrame:
    """Run a fold over every series; ``columns`` are the only ones shipped to Python.

    ``summarise(block)`` returns a JSON-able description of the block's state function,
    ``advance(summary, state)`` applies it, ``replay(block, state)`` returns output rows (the
    columns of ``out``).  Blocks are sorted by ``_pos`` and carry ``back`` halo rows with
    ``_core`` false; summaries only see core rows.
    """
    keys = list(s.keys)
    numbered = df if "_pos" in df.columns else with_position(df, s)
    lean = numbered.select(*keys, "_pos", *[c for c in columns if c not in keys])
    # read by the summaries and again by the replay: settle it instead of computing its inputs twice
    blocks = with_halo(reliable_checkpoint(lean), s, back)
    key_fields = [T.StructField(k, lean.schema[k].dataType) for k in keys]
    sum_schema = T.StructType([*key_fields, T.StructField("_blk", T.LongType()), T.StructField("_sum", T.StringType())])
    start_schema = T.StructType([*key_fields, T.StructField("_blk", T.LongType()), T.StructField("_start", T.StringType())])

    def head(pdf: pd.DataFrame) -> dict:
        return {c: [pdf[c].iloc[0]] for c in [*keys, "_blk"]}

    def do_summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        return pd.DataFrame({**head(pdf), "_sum": [json.dumps(summarise(pdf))]})

    def do_chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ignore_index=True)
        state, starts = initial, []
        for text in pdf["_sum"]:
            starts.append(json.dumps(state))
            state = advance(json.loads(text), state)
        return pdf[[*keys, "_blk"]].assign(_start=starts)

    names = [f.name for f in out.fields]

    def do_replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        rows = replay(pdf, json.loads(pdf["_start"].iloc[0]))
        for k in keys:
            rows[k] = pdf[k].iloc[0]
        return rows[[*keys, *names]]

    sums = blocks.where("_core").groupBy(*keys, "_blk").applyInPandas(do_summarise, sum_schema)
    starts = sums.groupBy(*keys).applyInPandas(do_chain, start_schema)
    ready = blocks.join(starts, [*keys, "_blk"])
    return ready.groupBy(*keys, "_blk").applyInPandas(do_replay, T.StructType([*key_fields, *out.fields]))


def interval_summary(lo: Sequence[float], hi: Sequence[float], left: Callable, right: Callable, step: Callable) -> dict:
    """State function of a fold whose unknown start value x survives row i while lo[i] <= x <= hi[i].

    Below lo[i] the state becomes ``left(i)``, above hi[i] ``right(i)``; from then on it is known and
    evolves by ``step(state, i)``.  Known states meet quickly, so few pieces remain.
    """
    lo, hi = [float(x) for x in lo], [float(x) for x in hi]
    bottom, top, alive = -math.inf, math.inf, True
    pieces: list[list] = []  # [from, to, closed_from, closed_to, state]
    for i in range(len(lo)):
        for p in pieces:
            p[4] = step(p[4], i)
        if alive:
            if lo[i] > bottom:
                end = min(lo[i], top)
                pieces.append([bottom, end, True, end < lo[i], left(i)])
                bottom = lo[i]
            if bottom <= top and hi[i] < top:
                begin = max(hi[i], bottom)
                pieces.append([begin, top, begin > hi[i], True, right(i)])
                top = hi[i]
            alive = bottom <= top
        if len(pieces) > 16:
            pieces = _merge(pieces)
    return {"pieces": _merge(pieces), "same": [bottom, top] if alive else None}


def _merge(pieces: list[list]) -> list[list]:
    """Join neighbouring pieces that ended in the same state."""
    out: list[list] = []
    for p in sorted(pieces, key=lambda q: (q[0], q[1])):
        if out and out[-1][4] == p[4] and out[-1][1] == p[0]:
            out[-1][1], out[-1][3] = p[1], p[3]
        else:
            out.append(list(p))
    return out


def interval_apply(summary: dict, x: float):
    """End state for start value x: (known, state); unknown means x itself survived."""
    same = summary["same"]
    if same is not None and same[0] <= x <= same[1]:
        return False, x
    for a, b, ca, cb, state in summary["pieces"]:
        if (x > a or (ca and x == a)) and (x < b or (cb and x == b)):
            return True, state
    raise ValueError(f"start value {x} is not covered by the block summary")
