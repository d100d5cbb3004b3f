"""As-of joins by union, not by correlated lookup.

Both sides are stacked, cut by time, and each left row takes the last (next)
right row inside its cut or, failing that, the last (next) one of the nearest
earlier (later) cut.  One shuffle of the data; the carry table has one row per
series and cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.plans.ordered import Cuts, depth_cuts


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    *,
    right_tie: Sequence[str] = (),
    tolerance: Column | None = None,
    direction: str = "backward",
    prefer: str = "later",
    matched_ts: str | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Left join of each left row to one right row by time.

    ``direction``: ``backward`` (last right row at or before), ``forward`` (first at
    or after) or ``nearest`` (smaller distance; ``prefer`` says which one on a tie).  A matching
    right row wins even when its values are null.  ``tolerance`` is an interval
    column on the distance.  ``right_tie`` orders right rows with equal times.
    """
    keys = list(keys)
    tie = F.struct(*[F.col(c) for c in right_tie]) if right_tie else F.struct(F.lit(0).alias("z"))
    payload = F.struct(F.col(right_ts).cast("timestamp").alias("_rts"), *[F.col(c).alias(f"_val_{c}") for c in values])
    lrows = left.select(
        *keys, F.col(left_ts).cast("timestamp").alias("_ts"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    ).withColumn("_crowd", F.pmod(F.xxhash64("_left"), F.lit(1_000_000_000)) + 1)
    # one row per series and instant, combined before the shuffle: the first and the last of the right rows there
    rrows = right.select(*keys, F.col(right_ts).cast("timestamp").alias("_ts"), payload.alias("_v"), tie.alias("_tie")).where("_ts is not null")
    ends = {"backward": [("_late", F.max_by)], "forward": [("_early", F.min_by)], "nearest": [("_late", F.max_by), ("_early", F.min_by)]}[direction]
    rrows = rrows.groupBy(*keys, "_ts").agg(F.struct(F.col("_ts").alias("_at"), *[f("_v", "_tie").alias(n) for n, f in ends]).alias("_right"))
    # the left rows of a crowded instant spread over sub-cuts behind its right row
    both = lrows.unionByName(rrows.withColumn("_crowd", F.lit(0).cast("bigint")), allowMissingColumns=True)
    order = ["_ts", "_crowd"]
    if cuts is None:
        cuts = depth_cuts(both, order)
    both = cuts.apply(both, order)
    part = [*keys, "_cut"]
    back, ahead = direction != "forward", direction != "backward"
    at = F.when(F.col("_right").isNotNull(), F.col("_ts"))
    by_cut = Window.partitionBy(*keys).orderBy("_cut")
    carry = both.groupBy(*part).agg(F.max_by("_right", at).alias("_last"), F.min_by("_right", at).alias("_first")).select(
        *part, F.last("_last", ignorenulls=True).over(by_cut.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        *([F.first("_first", ignorenulls=True).over(by_cut.rowsBetween(1, Window.unboundedFollowing)).alias("_after")] if ahead else []),
    )
    upto = (Window.unboundedPreceding, Window.currentRow)
    w = Window.partitionBy(*part).orderBy("_ts", "_crowd").rowsBetween(*upto)
    scanned = both.withColumn("_lo", F.last("_right", ignorenulls=True).over(w))
    if ahead:
        later = Window.partitionBy(*part).orderBy(F.col("_ts").desc(), F.col("_crowd").desc()).rowsBetween(*upto)
        scanned = scanned.withColumn("_hi", F.last("_right", ignorenulls=True).over(later))
    hit = scanned.where(F.col("_left").isNotNull()).join(carry, part)
    # the last instant at or before the row, found inside the cut or carried from an earlier one; and the next one after it
    hit = hit.withColumns({"_b": F.coalesce("_lo", "_before"), **({"_a": F.coalesce("_hi", "_after")} if ahead else {})})
    if direction == "backward":
        match = F.col("_b._late")
    else:
        # an instant that is the row's own counts for both directions
        next_ = F.when(F.col("_b._at") == F.col("_ts"), F.col("_b._early")).otherwise(F.col("_a._early"))
        match = next_
        if back:
            gap_back = F.unix_micros("_ts") - F.unix_micros("_b._at")
            gap_ahead = F.unix_micros(next_["_rts"]) - F.unix_micros("_ts")
            closer = gap_ahead <= gap_back if prefer == "later" else gap_ahead < gap_back
            match = F.coalesce(F.when(F.col("_b").isNull() | closer, next_), F.col("_b._late"))
    hit = hit.withColumn("_m", match)
    if tolerance is not None:
        close = (F.col("_m._rts") + tolerance >= F.col("_ts")) & (F.col("_m._rts") - tolerance <= F.col("_ts"))
        hit = hit.withColumn("_m", F.when(close, F.col("_m")))
    out = hit.select("_left.*", *[F.col(f"_m._val_{c}").alias(c) for c in values],
                     *([F.col("_m._rts").alias(matched_ts)] if matched_ts else []))
    return out
