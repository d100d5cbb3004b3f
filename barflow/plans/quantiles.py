"""Exact quantiles of unbounded groups: by counting distinct values, never by collecting them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.plans.ordered import Series
from barflow.session import reliable_checkpoint


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weights: dict | None = None) -> DataFrame:
    """One row per (key, value): map-side combined, so ties and hot keys shrink before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[w.alias(n) for n, w in (weights or {"_n": F.count(F.lit(1))}).items()]
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles") -> DataFrame:
    """(keys, n, out ARRAY<DOUBLE>): linearly interpolated quantiles."""
    d = df.withColumn("_v", F.col(value).cast("double"))
    # distinct values with their counts: settled, because sizes, carries and ranks all read them
    return quantiles_of_counts(reliable_checkpoint(value_counts(d, keys, "_v")), keys, "_v", probs, out)


# Slices of the value axis: only those that hold a wanted rank are sorted.
SLICES = 64


def order_statistics(counts: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """(keys, ``_rank``, ``_value``): the values at 0-based ranks of settled ``value_counts``; ``ranks`` has (keys, ``_ranks`` ARRAY<BIGINT>).

    The counts of value slices tell in which slice a rank lies; the rows of all other slices are left out before anything is shuffled.
    """
    keys = list(keys)
    lean = counts.select(*keys, F.col(value).alias("_value"), "_n")
    n = max(SLICES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = Series.sampled(lean, keys, ["_value"], n).cut(lean)
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_cut").agg(F.sum("_n").alias("_size")).withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    here = F.filter(F.array_distinct("_ranks"), lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_size")))
    wanted = sizes.join(ranks, keys).withColumn("_here", here).where(F.size("_here") > 0).select(*keys, "_cut", "_start", "_here")
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, "_cut").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    d = cut.join(wanted, [*keys, "_cut"]).withColumn("_upto", upto)
    hit = F.filter("_here", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))
    return d.select(*keys, "_value", F.explode(hit).alias("_rank"))


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles") -> DataFrame:
    """(keys, n, out ARRAY<DOUBLE>): linearly interpolated quantiles from settled ``value_counts``."""
    keys = list(keys)
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    ranks = total.withColumn("_ranks", F.array(*[f(at(p)).cast("bigint") for p in probs for f in (F.floor, F.ceil)]))
    held = order_statistics(counts, keys, value, ranks.drop("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_held"))  # two a probability
    value_at = lambda rank: F.try_element_at("_held", rank.cast("bigint"))
    values = []
    for p in probs:
        low, high = value_at(F.floor(at(p))), value_at(F.ceil(at(p)))
        values.append(low + (high - low) * (at(p) - F.floor(at(p))))
    return held.join(total, keys).select(*keys, "n", F.array(*values).alias(out))
