"""First-order linear recurrences y(t) = a(t) y(t-1) + b(t) as window expressions.

Inside a haloed block a constant-decay average needs no loop: rows are grouped
into stretches over which the decay stays above exp(-345) (so that the rescaled
running sum stays inside the double range), each stretch is one running sum, and
the previous stretch enters through its last value.  The halo is long enough
that what lies before it weighs less than exp(-40) of one observation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.plans.ordered import Block, Series, running, windowed

_RANGE = 345.0
_TAIL = 40.0


def ewm_back(alpha: float) -> int:
    """Rows of history after which an observation no longer changes a double."""
    return 1 if alpha >= 1 else math.ceil(_TAIL / -math.log1p(-alpha))


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def decayed_scan(df: DataFrame, b: Block, p: Column, total: Callable[[Column], Column], gain: Column, out: str) -> DataFrame:
    """y(p) = sum over q <= p of gain(q) exp(-(total(p) - total(q))), null where p < 0.

    ``total`` maps a position to its accumulated decay and must grow by less than
    345 per row.
    """
    d = df.withColumns({"_p": p, "_sub": F.floor(total(p) / _RANGE)}).withColumns({
        "_o": total(F.col("_p")) - F.col("_sub") * _RANGE, "_end": F.floor(total(F.col("_p") + 1) / _RANGE) != F.col("_sub"),
        "_b": F.when(F.col("_p") < 0, 0.0).otherwise(gain),
    })
    inner = Window.partitionBy(*b.part, "_sub").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_y", F.sum(F.col("_b") * F.exp("_o")).over(inner) * F.exp(-F.col("_o")))
    ends = F.when(F.col("_end"), F.struct("_sub", "_y", "_o"))
    d = d.withColumn("_prior", F.last(ends, ignorenulls=True).over(b.frame(Window.unboundedPreceding, -1)))
    gap = F.col("_o") + _RANGE - F.col("_prior._o")
    carried = F.when(F.col("_prior._sub") == F.col("_sub") - 1, F.col("_prior._y") * F.exp(-gap)).otherwise(0.0)
    return d.withColumn(out, F.when(F.col("_p") >= 0, F.col("_y") + carried)).drop(
        "_p", "_sub", "_o", "_end", "_b", "_y", "_prior"
    )


def ewm(df: DataFrame, b: Block, col: str | Column, alpha: float, out: str, skip: int = 0) -> DataFrame:
    """Exponential average (no bias adjustment) started at position ``skip``; null before it.

    ``col`` must be non-null from ``skip`` on.
    """
    x = F.col(col) if isinstance(col, str) else col
    if alpha >= 1:
        return df.withColumn(out, F.when(F.col("_pos") >= skip, x))
    rate = -math.log1p(-alpha)
    p = F.col("_pos") - skip
    gain = F.when(p == 0, x).otherwise(x * alpha)
    return decayed_scan(df, b, p, lambda q: q * F.lit(rate), gain, out)


def ewm_series(df: DataFrame, s: Series, col: str, alpha: float, out: str) -> DataFrame:
    """Exponential average of a column over whole series."""
    return windowed(df, s, lambda d, b: ewm(d, b, col, alpha, out), back=ewm_back(alpha))


def linear_recurrence(df: DataFrame, s: Series, a: Column, b: Column, out: str) -> DataFrame:
    """y0 = b0, y(t) = a(t) y(t-1) + b(t) with 0 <= a <= 1 varying by row; a = 0 restarts.

    D = running sum of -ln a gives every row its total decay.  Rows are grouped by
    (restart count, floor(D / 345)); inside a group y is a rescaled running sum, and
    only the previous group of the same restart can still matter.
    """
    d = df.withColumn("_a", a.cast("double")).withColumn("_b", b.cast("double"))
    d = running(
        d, s,
        {
            "_d": ("sum", F.when(F.col("_a") > 0, -F.log("_a")).otherwise(0.0)),
            "_restart": ("sum", F.when(F.col("_a") > 0, 0).otherwise(1)),
        },
    )
    d = d.withColumn("_sub", F.floor(F.col("_d") / _RANGE)).withColumn("_o", F.col("_d") - F.col("_sub") * _RANGE)
    group = Series((*s.keys, "_restart", "_sub"), s.order, s.cuts, s.rows)
    d = running(d, group, {"_s": ("sum", F.col("_b") * F.exp("_o"))})
    d = d.withColumn("_y", F.col("_s") * F.exp(-F.col("_o")))
    at = F.struct(*s.order)
    ends = d.groupBy(*s.keys, "_restart", "_sub").agg(
        F.max_by("_y", at).alias("_py"), F.max("_d").alias("_pd")
    )
    # the previous non-empty group: a single very small a can jump over several
    order = Window.partitionBy(*s.keys, "_restart").orderBy("_sub")
    prior = ends.select(
        *s.keys, "_restart", "_sub", F.lag("_py").over(order).alias("_qy"), F.lag("_pd").over(order).alias("_qd")
    )
    d = d.join(prior, [*s.keys, "_restart", "_sub"])
    carried = F.coalesce(F.col("_qy") * F.exp(-(F.col("_d") - F.col("_qd"))), F.lit(0.0))
    return d.withColumn(out, F.col("_y") + carried).drop(
        "_a", "_b", "_d", "_restart", "_sub", "_o", "_s", "_y", "_qy", "_qd"
    )
