"""Best-fit packing of documents into fixed-length sequences, after Martello-Toth dominance reduction.

Only the number of pieces of each length (at most ``capacity`` numbers) goes to the driver, whatever the corpus size.
There, piece lengths are handled in bulk, the longest first:

* a piece with which no other fits is a sequence of its own;
* a piece and the longest piece that fits with it are fixed together if that pair dominates every other feasible set:
  the pair fills the sequence, or no two of the shortest other pieces fit with the piece, or no three of them do and no feasible
  two are together longer than the partner;
* what is fixed leaves the instance, and the rules are tried again on what is left.

The remainder goes by best fit, longest first.  The plan (runs of equal lengths with their places) is bounded by the
capacity, not by the corpus; executors look up the place of every piece by its length and its rank among equal lengths.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import begin_task, tidy, settle

# One bin: lengths in order as (length, repeats); a plan is a list of (bin, number of such bins).
Pattern = tuple[tuple[int, int], ...]


def _pair_sum(lengths: list[int], counts: dict[int, int], room: int) -> int:
    """Largest sum of two remaining pieces that fit into ``room`` together; 0 if no two do."""
    best, hi = 0, len(lengths) - 1
    for lo, a in enumerate(lengths):
        if 2 * a > room:
            break
        while hi > lo and a + lengths[hi] > room:
            hi -= 1
        b = lengths[hi] if hi > lo else a
        if b != a or counts[a] > 1:
            best = max(best, a + b)
    return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets that some optimal packing contains, with their numbers, and the counts of what remains."""
    left = {w: n for w, n in counts.items() if n > 0}
    fixed: list[tuple[Pattern, int]] = []
    again = True
    while again:
        again = False
        for w in sorted(left, reverse=True):
            while left.get(w, 0):
                lengths = sorted(left)
                room = capacity - w
                at = bisect.bisect_right(lengths, room)
                others = lengths[:at]
                if others and others[-1] == w and left[w] == 1:
                    others = others[:-1]
                if not others:
                    fixed.append((((w, 1),), left.pop(w)))
                    again = True
                    break
                k = others[-1]
                most = left[w] // 2 if k == w else min(left[w], left[k])
                if k < room:
                    smallest: list[int] = []
                    for x in others[:3]:
                        smallest += [x] * min(3, left[x] - (x == w))
                    smallest = sorted(smallest)[:3]
                    two = len(smallest) >= 2 and sum(smallest[:2]) <= room
                    three = len(smallest) >= 3 and sum(smallest) <= room
                    if two and (three or _pair_sum(others, {**left, w: left[w] - 1}, room) > k):
                        break
                    # away from an exact fill, each pair changes what is left: the rules hold while both lengths last
                    most = max(1, most)
                fixed.append((((w, 2),) if k == w else ((w, 1), (k, 1)), most))
                for x, n in ((w, most), (k, most)):
                    left[x] -= n
                    if not left[x]:
                        del left[x]
                again = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts of lengths."""
    rooms: dict[int, list[list]] = defaultdict(list)  # free room -> [pattern, number]
    order: list[int] = []  # rooms that have bins, ascending
    for w in sorted((x for x, n in counts.items() if n), reverse=True):
        n = counts[w]
        while n:
            at = bisect.bisect_left(order, w)
            room = order[at] if at < len(order) else capacity
            pattern, bins = rooms[room].pop() if at < len(order) else ((), -(-n // (capacity // w)))
            if at < len(order) and not rooms[room]:
                order.pop(at)
                del rooms[room]
            each = room // w
            full = min(bins, n // each)
            rest = n - full * each if full < bins else 0
            for number, take in ((full, each), (1 if rest else 0, rest), (bins - full - (1 if rest else 0), 0)):
                if number > 0:
                    free = room - take * w
                    if free not in rooms:
                        bisect.insort(order, free)
                    rooms[free].append([pattern + ((w, take),) if take else pattern, number])
            n -= full * each + rest
    return [(tuple(p), number) for bins in rooms.values() for p, number in bins if p]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns with their numbers for all pieces counted in ``counts``."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello-Toth bound L2: no packing has fewer sequences."""
    best = 0
    for alpha in {0, *(w for w in counts if 2 * w <= capacity)}:
        big = sum(n for w, n in counts.items() if w > capacity - alpha)
        middle = [(w, n) for w, n in counts.items() if 2 * w > capacity and w <= capacity - alpha]
        small = sum(w * n for w, n in counts.items() if alpha <= w and 2 * w <= capacity)
        n_middle = sum(n for _, n in middle)
        best = max(best, big + n_middle + max(0, -(-(small - (n_middle * capacity - sum(w * n for w, n in middle))) // capacity)))
    return best


def _places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Runs of ranks of one length, sorted by (length, first rank): where they go."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, number in patterns:
        offset = 0
        for w, times in pattern:
            rows.append((w, used[w], times, base, offset))
            used[w] += times * number
            offset += w * times
        base += number
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "base", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens: as few sequences as found, no gaps.

    Rows may repeat and other columns may be null; each row is placed.  A null length or one outside 1..capacity raises an error.
    The columns ``sequence_id`` and ``offset`` of the input, if any, are replaced.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    names, place = [*keep, "_part", "_rank"], keep.index(length_col)
    fields = [f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in keep]

    def number(batches):
        """Rank among the pieces of the same length in this partition."""
        begin_task()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            w = batch.column(place)
            if w.null_count or batch.num_rows and not (0 < w.to_numpy().min() and w.to_numpy().max() <= capacity):
                raise ValueError(f"a length is null or outside 1..{capacity}")
            w = w.to_numpy().astype(np.int64)
            order = np.argsort(w, kind="stable")
            ordered = w[order]
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(w) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(w)])
            rank = np.empty(len(w), np.int64)
            rank[order] = np.arange(len(w)) - np.repeat(starts, sizes) + seen[ordered]
            np.add.at(seen, w, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(w), part, np.int32)), pa.array(rank)], names)
            if batch.num_rows:
                tidy()

    numbered = settle(pieces.select(*keep).mapInArrow(number, ", ".join([*fields, "_part int", "_rank bigint"])), "pieces")
    w = F.col(length_col).cast("bigint")
    shares = numbered.groupBy("_part", w.alias("_length")).agg(F.count("*").alias("_n"))
    counts = {r["_length"]: r["_n"] for r in shares.groupBy("_length").agg(F.sum("_n").alias("_n")).collect()}  # capacity rows at most
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = shares.select("_part", "_length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = (
        numbered.withColumn("_length", w).join(first, ["_part", "_length"])
        .select(*keep, "_length", (F.col("_first") + F.col("_rank")).alias("_rank"))
    )
    at = _places(plan(counts, capacity))
    span = np.int64(max(counts.values(), default=0) + 1)
    starts = at["length"] * span + at["rank"]

    def put(batches):
        for batch in batches:
            length, rank = batch.column(len(keep)).to_numpy(), batch.column(len(keep) + 1).to_numpy()
            i = np.searchsorted(starts, length * span + rank, "right") - 1
            inside = rank - at["rank"][i]
            sequence, repeat = at["base"][i] + inside // at["times"][i], inside % at["times"][i]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sequence), pa.array(at["offset"][i] + repeat * length)], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(put, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))
