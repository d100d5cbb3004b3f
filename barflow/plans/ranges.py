"""Extrema over ranges and first passages through a limit, by a pyramid of blocks instead of pairing rows with all bars they span.

A pyramid's level 0 has blocks of ``FAN`` neighbouring slots, level k blocks of ``FAN`` blocks of level k - 1 and is built from these.
A range meets two blocks a level at most; a first passage climbs until a block holds a hit and descends into it.  Every step
is an equi-join on (keys, block), so no task needs a series, and a crowded block is a skewed join key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.session import reliable_checkpoint

BITS = 6
FAN = 1 << BITS
_FOLD = {"max": (F.max, F.array_max), "min": (F.min, F.array_min)}


@dataclass(frozen=True)
class Pyramid:
    """``levels[k]``: keys, ``_block`` and ``_items``, an array of (k, value of each aggregate) by child.  Slots count from ``base``."""

    keys: tuple[str, ...]
    levels: tuple[DataFrame, ...]
    base: int
    slots: int


def _inside(slot: Column) -> Column:
    return slot.bitwiseAND(F.lit(FAN - 1))


def pyramid(bars: DataFrame, keys: Sequence[str], slot: Column, aggs: dict[str, tuple[str, str]]) -> Pyramid:
    """Pyramid over integer slots; ``aggs``: {name: ("max" | "min", column)}.  Slots without a bar are absent.

    Level 0 is settled, since the other levels and all descents read it; two numbers about it decide the number of levels.
    """
    keys = tuple(keys)
    rows = bars.select(*keys, slot.cast("bigint").alias("_slot"), *[F.col(c).alias(f"_a_{n}") for n, (_, c) in aggs.items()]).where("_slot is not null")
    one = rows.groupBy(*keys, "_slot").agg(*[_FOLD[k][0](f"_a_{n}").alias(n) for n, (k, _) in aggs.items()])

    def grouped(d: DataFrame) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct(_inside(F.col("_slot")).cast("int").alias("k"), *aggs)))  # FAN at most
        return d.groupBy(*keys, F.shiftright("_slot", BITS).alias("_block")).agg(items.alias("_items"))

    first = reliable_checkpoint(grouped(one))
    low, high = first.agg(F.min("_block"), F.max("_block")).first()
    low, high = (low, high) if low is not None else (0, 0)
    levels, blocks = [first.withColumn("_block", F.col("_block") - low)], high - low + 1
    while blocks > 1:
        up = levels[-1].select(*keys, F.col("_block").alias("_slot"), *[_FOLD[k][1](F.col(f"_items.{n}")).alias(n) for n, (k, _) in aggs.items()])
        levels.append(grouped(up))
        blocks = -(-blocks // FAN)
    return Pyramid(keys, tuple(levels), low << BITS, (high - low + 1) << BITS)


def first_passage(queries: DataFrame, p: Pyramid, start: Column, low: Column, high: Column, out: str) -> DataFrame:
    """Adds the first slot from ``start`` on whose ``lo`` is at most ``low`` or whose ``hi`` is at least ``high`` (null where there is none).

    ``p`` has the aggregates ``lo`` and ``hi``; a null limit is never met.
    """
    keys, c = list(p.keys), F.col
    d = queries.withColumns({"_at": F.greatest(start.cast("bigint") - p.base, F.lit(0)), "_low": low, "_high": high, "_node": F.lit(None).cast("bigint"), "_level": F.lit(-1)})
    # rows that are settled look for a block that does not exist, each its own, so that they stay spread
    idle = -1 - F.pmod(F.xxhash64("_at", "_low", "_high"), F.lit(1 << 30))

    def look(d: DataFrame, level: int, wanted: Column, block: Column, offset: Column) -> DataFrame:
        d = d.withColumn("_block", F.when(wanted, block).otherwise(idle)).join(p.levels[level], [*keys, "_block"], "left")
        hit = F.get(F.filter("_items", lambda i: (i["k"] >= offset) & (F.coalesce(i["lo"] <= c("_low"), F.lit(False)) | F.coalesce(i["hi"] >= c("_high"), F.lit(False)))), F.lit(0))["k"]
        return d.withColumn("_k", hit).drop("_items")

    for level in range(len(p.levels)):
        open_ = c("_node").isNull() & c("_at").isNotNull()
        d = look(d, level, open_, F.shiftright("_at", BITS), _inside(c("_at")))
        found = c("_node").isNull() & c("_k").isNotNull()
        d = d.withColumns({
            "_node": F.when(found, c("_block") * FAN + c("_k")).otherwise(c("_node")), "_level": F.when(found, level).otherwise(c("_level")), "_at": F.shiftright("_at", BITS) + 1,
        }).drop("_k", "_block")
    for level in range(len(p.levels) - 1, 0, -1):
        d = look(d, level - 1, c("_level") == level, c("_node"), F.lit(0))
        deeper = c("_level") == level
        d = d.withColumns({
            "_node": F.when(deeper, c("_block") * FAN + c("_k")).otherwise(c("_node")), "_level": F.when(deeper, level - 1).otherwise(c("_level")),
        }).drop("_k", "_block")
    return d.withColumn(out, c("_node") + p.base).drop("_at", "_low", "_high", "_node", "_level")


def range_extrema_of(ranges: DataFrame, p: Pyramid, start: Column, stop: Column, aggs: dict[str, tuple[str, str]], range_id: Sequence[str]) -> DataFrame:
    """For each range, the pyramid's aggregates over the slots start..stop (both included); ``range_id`` columns identify a range."""
    keys = list(p.keys)
    d = ranges.select(*dict.fromkeys([*keys, *range_id]), F.greatest(start.cast("bigint") - p.base, F.lit(0)).alias("_a"), F.least(stop.cast("bigint") - p.base, F.lit(p.slots - 1)).alias("_z"))
    pieces = []
    piece = lambda level, block, lo, hi: F.struct(F.lit(level).alias("_level"), block.alias("_block"), lo.cast("int").alias("_from"), hi.cast("int").alias("_to"))
    for level in range(len(p.levels)):
        a, z = F.col("_a"), F.col("_z")
        left, right = F.shiftright("_a", BITS), F.shiftright("_z", BITS)
        d = d.withColumn(f"_p{level}", F.when((a <= z) & (left == right), F.array(piece(level, left, _inside(a), _inside(z)))).when(
            a <= z, F.array(piece(level, left, _inside(a), F.lit(FAN - 1)), piece(level, right, F.lit(0), _inside(z)))
        )).withColumns({"_a": left + 1, "_z": right - 1})
        pieces.append(F.coalesce(F.col(f"_p{level}"), F.array()))
    need = d.select(*dict.fromkeys([*keys, *range_id]), F.explode(F.concat(*pieces)).alias("_c")).select(*dict.fromkeys([*keys, *range_id]), "_c.*")
    stacked = None
    for level, df in enumerate(p.levels):
        tagged = df.withColumn("_level", F.lit(level))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    part = F.filter("_items", lambda i: i["k"].between(F.col("_from"), F.col("_to")))
    met = need.join(stacked, [*keys, "_level", "_block"]).withColumn("_items", part)
    found = met.select(*range_id, *[_FOLD[k][1](F.col(f"_items.{n}")).alias(n) for n, (k, _) in aggs.items()]).groupBy(*range_id).agg(
        *[_FOLD[k][0](n).alias(n) for n, (k, _) in aggs.items()]
    )
    return ranges.join(found, list(range_id), "left")


def slot_of(ts: Column, step_seconds: float) -> Column:
    """Grid slot of a time."""
    return F.floor(F.unix_micros(ts) / F.lit(int(step_seconds * 1_000_000))).cast("bigint")


def range_extrema(
    ranges: DataFrame, bars: DataFrame, keys: Sequence[str], start: Column, stop: Column,
    step_seconds: float, aggs: dict[str, tuple[str, str]], range_id: Sequence[str],
) -> DataFrame:
    """For each range of times, max / min of bar columns over the grid slots start..stop (both included).

    ``aggs``: {out: ("max" | "min", column)}; ``range_id`` columns identify a range.
    """
    p = pyramid(bars, keys, slot_of(F.col("ts"), step_seconds), aggs)
    return range_extrema_of(ranges, p, slot_of(start, step_seconds), slot_of(stop, step_seconds), aggs, range_id)
