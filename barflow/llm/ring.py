"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells.  Every shard owns ``points`` virtual nodes on it, and a row belongs to the first node clockwise from the
hash of its key.  A shard holds a bounded number of rows: rows are placed clockwise from the ring's origin, and those that meet a full
shard continue clockwise to the next node whose shard has room.  So only counts decide where shards fill up: the counts of the cells (at most
``CELLS`` numbers) go to the driver, which walks the nodes once and returns at most ``shards * points + shards`` stretches of the ring order;
each row finds its place from its rank in that order.  Ranks are row numbers inside a cell plus the rows before it, so no task
sorts more than a cell, or a share of one where many rows have one key.

Ties: rows of one key are interchangeable; which of them gets which place is undefined, but each place is used once.  Null keys hash like any
other value, repeated rows are rows, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import settle

BITS = 16
# Cells of the ring; no more counts than these ever go to the driver.
CELLS = 1 << BITS
# Rows of one cell that are numbered together.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class Stretch:
    """Rows from ``rank`` of the ring order on (the first lies in ``cell``) go to ``shard``, the first to place ``slot`` there."""

    cell: int
    rank: int
    shard: int
    slot: int


def virtual_nodes(shards: int, points: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise.  The nodes of a shard do not depend on how many shards there are."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - BITS)
    return sorted((place(s, v), s) for s in range(shards) for v in range(points))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: without slack as equal as can be, else ``1 + slack`` times the mean, rounded up."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-(rows * (1 + slack)) // shards)] * shards


def walk(counts: Sequence[tuple[int, int]], nodes: Sequence[tuple[int, int]], room: Sequence[int]) -> list[Stretch]:
    """Stretches of the ring order for ``(cell, rows)`` in clockwise order."""
    places, used, room = [c for c, _ in nodes], [0] * len(room), list(room)

    def open_from() -> list[int]:
        """For every node the shard of the first node from it on that has room."""
        target, shard = [-1] * len(nodes), -1
        for j in [*range(len(nodes) - 1, -1, -1)] * 2:
            shard = nodes[j][1] if used[nodes[j][1]] < room[nodes[j][1]] else shard
            target[j] = shard
        return target

    target, found, rank = open_from(), [], 0
    for cell, rows in counts:
        home = bisect_left(places, cell) % len(nodes)
        while rows:
            shard = target[home]
            take = min(rows, room[shard] - used[shard])
            if not found or found[-1].shard != shard:
                found.append(Stretch(cell, rank, shard, used[shard]))
            used[shard] += take
            rank, rows = rank + take, rows - take
            if used[shard] == room[shard]:
                target = open_from()
    return found


def _numbers(values: Sequence[int]) -> Column:
    """A literal array of longs (one parsed text, not a column for each value)."""
    return F.expr(f"cast(array({', '.join(map(str, values))}) as array<bigint>)")


def _cells(counts: DataFrame, stretches: Sequence[Stretch], together: int) -> DataFrame:
    """Every cell with the rank of its first row, the number of shares it is numbered in, and the stretches that meet it.

    The windows without keys run over at most ``CELLS`` rows.
    """
    names = ("cell", "rank", "shard", "slot")
    rows = F.arrays_zip(*[_numbers([getattr(s, n) for s in stretches]).alias(n) for n in names])
    begun = counts.sparkSession.range(1).select(F.explode(rows).alias("s")).groupBy(F.col("s.cell").alias("_cell")).agg(
        F.sort_array(F.collect_list(F.struct("s.rank", "s.shard", "s.slot"))).alias("_begun")  # bounded: all stretches are shards * points + shards at most
    )
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    d = counts.join(begun, "_cell", "left").withColumns({
        "_start": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_carried": F.last(F.element_at("_begun", -1), ignorenulls=True).over(before),
        "_shares": F.ceil(F.col("_rows") / together).cast("bigint"),
    })
    met = F.concat(F.when(F.col("_carried").isNull(), F.array()).otherwise(F.array("_carried")), F.coalesce("_begun", F.array()))
    return d.select("_cell", "_start", "_shares", met.alias("_met"))


def assign(df: DataFrame, keys: Sequence[str], shards: int, points: int = 128, slack: float = 0.0, together: int = TOGETHER) -> DataFrame:
    """Adds ``shard`` and ``slot`` (0, 1, 2... inside the shard) to every row; columns of ``df`` with these names are replaced.

    ``slack`` 0 fills the shards to within one row of each other; a greater one moves fewer rows when a shard is added.
    ``df`` is written once (narrow it first) and read three times.
    """
    hashed = F.xxhash64(*[F.col(k) for k in keys])
    base = settle(df.drop("shard", "slot").withColumns({
        "_at": hashed, "_cell": F.shiftrightunsigned(hashed, 64 - BITS), "_row": F.monotonically_increasing_id(),
    }), "ring")
    counts = base.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"))
    known = sorted((r["_cell"], r["_rows"]) for r in counts.collect())  # CELLS rows at most
    stretches = walk(known, virtual_nodes(shards, points), capacities(sum(n for _, n in known), shards, slack))
    if not stretches:
        return base.drop("_at", "_cell", "_row").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")})
    cells = _cells(counts, stretches, together)
    shared = base.join(cells, "_cell").withColumn("_share", F.pmod(F.xxhash64("_row"), F.col("_shares")))
    earlier = Window.partitionBy("_cell").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shared.groupBy("_cell", "_share").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_cell", "_share", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy("_cell", "_share").orderBy("_at", "_row")
    ranked = shared.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["_cell", "_share"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_skip") + F.col("_rank"))
    own = F.element_at(F.filter("_met", lambda s: s["rank"] <= F.col("_rank")), -1)
    return ranked.withColumn("_own", own).select(
        *[c for c in base.columns if c not in ("_at", "_cell", "_row")], F.col("_own.shard").cast("int").alias("shard"),
        (F.col("_rank") - F.col("_own.rank") + F.col("_own.slot")).alias("slot"),
    )
