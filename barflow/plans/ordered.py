"""Ordered-series plans that do not put one series into one task.

A plain ``Window.partitionBy(symbol).orderBy(ts)`` sorts a whole symbol inside a
single task, so twenty symbols can use twenty cores however large the cluster is
and one hot symbol decides the run time.  Everything here instead works on
*cuts* (time slices of a series) and *blocks* (fixed row counts of a series):

``with_position``   global row number per series from per-cut row numbers plus
                    the running sum of the (tiny) table of cut sizes;
``with_halo``       equal-sized blocks, each carrying the rows its frames reach
                    back (or ahead) to, so bounded frames are exact;
``running``         unbounded running aggregates as "inside the cut" + "carry
                    from all earlier cuts".

No step needs a task to hold more than one cut or one block (plus halo).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


@dataclass(frozen=True)
class GridCuts:
    """Cuts for bars that lie on a regular grid: at most ``rows`` bars per series and cut.

    The bound holds by construction (one bar per step), so nothing is sampled.
    """

    step_seconds: float
    rows: int = BLOCK_ROWS

    def apply(self, df: DataFrame, order: Sequence[str], out: str = "_cut") -> DataFrame:
        width = int(self.step_seconds * self.rows * 1_000_000)
        return df.withColumn(out, F.expr(f"floor(unix_micros(`{order[0]}`) / {width}L)"))


# Sub-cuts that are compared at once when a row's sub-cut is looked up.
STRIDE = 48
# Quantiles of the tie-break column that one heavy instant can be cut at.
MOST_SUBCUTS = 2_048


@dataclass(frozen=True)
class DepthCuts:
    """Equal-depth cuts from sampled quantiles: any (series, cut) holds about 1/n of the rows.

    ``splits`` cut the time axis.  An instant that alone holds more than one cut's share is itself a split; ``ties`` has, for such
    instants, bounds of the tie-break column inside them, of that column's own type, so that they keep its order exactly.
    """

    splits: tuple[float, ...] = ()
    ties: tuple[tuple[float, tuple], ...] = field(default=())

    def apply(self, df: DataFrame, order: Sequence[str], out: str = "_cut") -> DataFrame:
        inf = float("inf")
        df = df.withColumn("_at", order_value(df, order[0]))
        if self.splits:
            df = Bucketizer(
                splits=[-inf, *self.splits, inf], inputCol="_at", outputCol="_slice", handleInvalid="keep"
            ).transform(df)
        else:
            df = df.withColumn("_slice", F.lit(0.0))
        sub = F.lit(0).cast("bigint")
        if len(order) > 1 and self.ties:
            # literal arrays by slice (a heavy instant is the first of its slice); the bounds of all instants lie end to end in one array
            inside = dict(self.ties)
            lists = [list(inside.get(at, ())) for at in (None, *self.splits)]
            coarse = [x[STRIDE - 1 :: STRIDE] for x in lists]
            heavy = _literal([at if at in inside else None for at in (None, *self.splits)], "double")
            at_slice = lambda parts: F.get(_literal(list(accumulate((len(x) for x in parts[:-1]), initial=0)), "int"), F.col("_slice").cast("int"))
            size = lambda parts: F.get(_literal([len(x) for x in parts], "int"), F.col("_slice").cast("int"))
            kind = df.schema[order[1]].dataType.simpleString()
            flat = lambda parts: _literal([b for x in parts for b in x], kind)
            below = lambda bounds: F.size(F.filter(bounds, lambda b: F.col("_cut_tie") >= b))
            df = df.withColumns({"_cut_heavy": F.get(heavy, F.col("_slice").cast("int")), "_cut_tie": F.col(order[1])})
            df = df.withColumn("_cut_skip", below(F.slice(flat(coarse), at_slice(coarse) + 1, size(coarse))) * STRIDE)
            own = F.col("_cut_skip") + below(F.slice(flat(lists), at_slice(lists) + F.col("_cut_skip") + 1, F.greatest(F.lit(0), F.least(F.lit(STRIDE), size(lists) - F.col("_cut_skip")))))
            # rows of the slice after the heavy instant sort behind its sub-cuts
            sub = F.when(F.col("_at") == F.col("_cut_heavy"), own.cast("bigint")).when(F.col("_at") > F.col("_cut_heavy"), F.lit(2**31)).otherwise(sub)
        return df.withColumn(out, F.col("_slice").cast("bigint") * 2**32 + sub).drop("_at", "_slice", "_cut_heavy", "_cut_tie", "_cut_skip")


Cuts = GridCuts | DepthCuts


def _literal(values: Sequence, kind: str) -> Column:
    """An array literal (one parsed text, not a column for each value)."""

    def text(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, str):
            return f"decode(unhex('{v.encode().hex()}'), 'utf-8')"
        if isinstance(v, (bytes, bytearray)):
            return f"unhex('{bytes(v).hex()}')"
        if isinstance(v, float):
            return f"double('{v!r}')"
        return f"'{v}'" if not isinstance(v, int) or isinstance(v, bool) else str(v)

    return F.expr(f"cast(array({', '.join(map(text, values))}) as array<{kind}>)")


def order_value(df: DataFrame, name: str) -> Column:
    """An order column as a double: microseconds for timestamps, the first six bytes for strings.  Only for the time axis; tie-breaks keep their type."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(name).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(name, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


# Sampled tie-break values for each bound in a heavy instant.
SAMPLED = 50


def depth_cuts(df: DataFrame, order: Sequence[str], n: int | None = None) -> DepthCuts:
    """Equal-depth cuts: quantiles of the order column by one column-pruned pass, and bounds of the tie-break column where an instant is heavy.

    Same idea as the sampling pass of a distributed sort; about ``n`` numbers come back to the driver.  Heavy instants take two more
    passes over their own rows: their sizes, then a sample of ``SAMPLED`` values a bound, sorted on the driver in the column's own type.
    """
    n = n or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n == 1:
        return DepthCuts()
    probe = df.select(order_value(df, order[0]).alias("_at"), *[F.col(c).alias("_tie") for c in order[1:2]])
    shares = Counter(probe.approxQuantile("_at", [i / n for i in range(1, n)], 0.25 / n))
    heavy = {at: count for at, count in shares.items() if count >= 2}
    ties = []
    if heavy and len(order) > 1:
        bounds = {at: min(MOST_SUBCUTS, count) for at, count in heavy.items()}
        those = probe.where(F.col("_tie").isNotNull()).join(F.broadcast(df.sparkSession.createDataFrame([(at, float(m)) for at, m in bounds.items()], "_at double, _m double")), "_at")  # n / 2 instants at most
        sizes = {r["_at"]: r["count"] for r in those.groupBy("_at").count().collect()}
        if sizes:
            rates = df.sparkSession.createDataFrame([(at, min(1.0, SAMPLED * bounds[at] / k)) for at, k in sizes.items()], "_at double, _rate double")
            picked = those.join(F.broadcast(rates), "_at").where(F.rand(17) < F.col("_rate")).select("_at", "_tie").collect()  # SAMPLED * n / 2 values or so
            sample: dict[float, list] = {}
            for r in picked:
                sample.setdefault(r["_at"], []).append(r["_tie"])
            for at, values in sample.items():
                values.sort()
                ties.append((at, tuple(sorted({values[i * len(values) // bounds[at]] for i in range(1, bounds[at])}))))
    return DepthCuts(tuple(sorted(shares)), tuple(sorted(ties, key=lambda t: t[0])))


@dataclass(frozen=True)
class Series:
    """Which columns identify a series, how its rows are ordered, and how it is cut."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    cuts: Cuts
    rows: int = BLOCK_ROWS

    @staticmethod
    def on_grid(keys: Sequence[str], ts: str, step_seconds: float, rows: int = BLOCK_ROWS) -> "Series":
        return Series(tuple(keys), (ts,), GridCuts(step_seconds, rows), rows)

    @staticmethod
    def sampled(
        df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None, rows: int = BLOCK_ROWS
    ) -> "Series":
        return Series(tuple(keys), tuple(order), depth_cuts(df, order, n), rows)

    def cut(self, df: DataFrame) -> DataFrame:
        return self.cuts.apply(df, self.order)


def with_position(df: DataFrame, s: Series, out: str = "_pos", size: str | None = None) -> DataFrame:
    """0-based row number of every row inside its series, without a per-series sort.

    ``size`` also attaches the number of rows of the series.  The second read of ``df``
    (for the cut sizes) only needs the key and order columns.
    """
    keys = [*s.keys, "_cut"]
    cut = s.cut(df)
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*s.keys).orderBy("_cut")
    whole = Window.partitionBy(*s.keys)
    starts = sizes.select(
        *keys, (F.sum("_n").over(upto) - F.col("_n")).alias("_start"),
        *([F.sum("_n").over(whole).alias(size)] if size else []),
    )
    inside = Window.partitionBy(*keys).orderBy(*s.order)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(starts, keys)
        .withColumn(out, F.col("_start") + F.col("_rn") - 1)
        .drop("_cut", "_rn", "_start")
    )


def with_halo(df: DataFrame, s: Series, back: int, ahead: int = 0) -> DataFrame:
    """Copy each positioned row into every block whose frames can see it.

    Adds ``_blk`` and ``_core`` (true for the one block that owns the row).
    """
    first = F.expr(f"greatest(0L, (_pos - {ahead}) div {s.rows})")
    last = F.expr(f"(_pos + {back}) div {s.rows}")
    return df.withColumn("_blk", F.explode(F.sequence(first, last))).withColumn(
        "_core", F.col("_blk") == F.expr(f"_pos div {s.rows}")
    )


@dataclass(frozen=True)
class Block:
    """Window vocabulary inside haloed blocks."""

    keys: tuple[str, ...]

    @property
    def part(self) -> tuple[str, ...]:
        return (*self.keys, "_blk")

    @property
    def w(self):
        return Window.partitionBy(*self.part).orderBy("_pos")

    def frame(self, lo: int, hi: int):
        return self.w.rowsBetween(lo, hi)

    def lag(self, col: str | Column, k: int = 1) -> Column:
        return F.lag(col, k).over(self.w)

    def lead(self, col: str | Column, k: int = 1) -> Column:
        return F.lead(col, k).over(self.w)

    def roll(self, fn: Callable, col: str | Column, n: int, min_periods: int | None = None) -> Column:
        """``fn`` over the last ``n`` rows, null until ``min_periods`` values are present."""
        c = F.col(col) if isinstance(col, str) else col
        w = self.frame(-(n - 1), 0)
        need = n if min_periods is None else min_periods
        return F.when(F.count(c).over(w) >= need, fn(c).over(w))


def windowed(
    df: DataFrame, s: Series, fn: Callable[[DataFrame, Block], DataFrame], back: int, ahead: int = 0,
) -> DataFrame:
    """Run ``fn`` over haloed blocks and keep each row once.

    A frame that already carries ``_pos`` is not numbered again and keeps it, so a chain
    of operators numbers its rows once and then costs one shuffle per step.
    """
    had = "_pos" in df.columns
    blocked = with_halo(df if had else with_position(df, s), s, back, ahead)
    out = fn(blocked, Block(s.keys)).where("_core").drop("_blk", "_core")
    return out if had else out.drop("_pos")


_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame, s: Series, aggs: dict[str, tuple[str, Column]], exclusive: bool = False, reverse: bool = False,
) -> DataFrame:
    """Unbounded running aggregates: ``{out: (kind, expr)}``, kind in sum/max/min/last.

    ``last`` is the last non-null value.  ``exclusive`` stops before the current row;
    ``reverse`` runs from the end of the series towards its start.
    """
    keys = [*s.keys, "_cut"]
    cut = s.cut(df)
    for name, (_, expr) in aggs.items():
        cut = cut.withColumn(f"_v_{name}", expr)
    hi = -1 if exclusive else Window.currentRow
    way = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    newest = F.min_by if reverse else F.max_by
    inside = Window.partitionBy(*keys).orderBy(*map(way, s.order)).rowsBetween(Window.unboundedPreceding, hi)
    earlier = Window.partitionBy(*s.keys).orderBy(way("_cut")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*[F.col(c) for c in s.order])

    totals, locals_ = [], []
    for name, (kind, _) in aggs.items():
        v = F.col(f"_v_{name}")
        if kind == "last":
            totals.append(newest(v, F.when(v.isNotNull(), at)).alias(f"_t_{name}"))
            locals_.append(F.last(v, ignorenulls=True).over(inside).alias(f"_l_{name}"))
        else:
            totals.append(_TOTAL[kind](v).alias(f"_t_{name}"))
            locals_.append(_TOTAL[kind](v).over(inside).alias(f"_l_{name}"))
    carry = cut.groupBy(*keys).agg(*totals)
    carry = carry.select(
        *keys,
        *[
            (F.last(f"_t_{n}", ignorenulls=True) if k == "last" else _TOTAL[k](f"_t_{n}")).over(earlier).alias(f"_c_{n}")
            for n, (k, _) in aggs.items()
        ],
    )
    out = cut.select("*", *locals_).join(carry, keys)
    for name, (kind, _) in aggs.items():
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            value = F.when(here.isNull() & before.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
            )
        elif kind == "max":
            value = F.greatest(here, before)
        elif kind == "min":
            value = F.least(here, before)
        else:
            value = F.coalesce(here, before)
        out = out.withColumn(name, value)
    drop = [f"_{p}_{n}" for n in aggs for p in ("v", "l", "c")]
    return out.drop("_cut", *drop)


def fill_gaps(df: DataFrame, s: Series, col: str, out: str) -> DataFrame:
    """Next known value, else the last known one (backward fill, then forward fill)."""
    keys = [*s.keys, "_cut"]
    cut = s.cut(df)
    v, at = F.col(col), F.struct(*s.order)
    known = F.when(v.isNotNull(), at)
    w = Window.partitionBy(*keys).orderBy(*s.order)
    by_cut = Window.partitionBy(*s.keys).orderBy("_cut")
    carry = cut.groupBy(*keys).agg(F.min_by(v, known).alias("_f"), F.max_by(v, known).alias("_l")).select(
        *keys,
        F.first("_f", ignorenulls=True).over(by_cut.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        F.last("_l", ignorenulls=True).over(by_cut.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )
    d = cut.withColumns({
        "_ahead": F.first(v, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "_back": F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }).join(carry, keys)
    return d.withColumn(out, F.coalesce("_ahead", "_after", "_back", "_before")).drop(
        "_cut", "_ahead", "_back", "_after", "_before"
    )


def runs(df: DataFrame, s: Series, state: Column, out: str = "run_id") -> DataFrame:
    """Number maximal stretches of equal ``state`` (gaps and islands) per series."""
    flagged = windowed(
        df.withColumn("_state", state), s,
        lambda d, b: d.withColumn("_new", F.when(b.lag("_state").eqNullSafe(F.col("_state")) & (F.col("_pos") > 0), 0).otherwise(1)),
        back=1,
    )
    return running(flagged, s, {out: ("sum", F.col("_new"))}).drop("_state", "_new")
