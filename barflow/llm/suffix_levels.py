"""Long repeated byte strings by a logarithmic family of suffix arrays.

A suffix array here is sparse: it holds the suffixes that start at content-chosen anchors (see :mod:`barflow.llm.anchors`), ordered by the
hash of their first bytes, then of their whole context, so that suffixes with a common beginning are neighbours; texts stay with
the documents.  A level of the family is such an array as a Parquet table; neighbours are found by counting these hashes, not by their
places in the order.  A new batch is

* turned into an array and scanned with all levels: neighbours that agree in their whole context settle the long matches of
  both; neighbours that agree in their beginning only are noted as unsettled;
* added as a level of its own size.  Before a batch is added, levels of equal size are merged, so that their number grows with the logarithm of
  the number of batches.

Unsettled neighbours are settled byte by byte: their contexts are sorted lexicographically (the suffixes, and the reversed prefixes),
and for each split of a run into a part before and a part from the anchor on, two contexts share that run just if the common
prefixes in both orders reach that far.

Groups of more than ``TOGETHER`` neighbours are never held by one task, but settled run by run: the runs through an anchor that start near it, and those
that start further before it, each have bytes in common; where unlike contexts share these, all runs of that half are hashed (96 bits) and counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.anchors import OCCURRENCE, Rolling, Runs, apart, at_texts, mix, own_spans, repeated, scan, text_key, whole_spans, with_spans
from barflow.llm.common import discard, kind, map_batches, settle

# Batches in which a table is added: with three, levels are merged (1 + 1) before the last batch meets them; every further one shuffles all older levels once more.
BATCHES = 3
# Contexts that are settled together by sorting, as whole groups; a gram with more unlike contexts is settled by counting.
TOGETHER = 20_000


def _ordered(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of zero-padded byte rows, and the common prefix of each with the one before it in that order."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    keys = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((sizes, *keys.T[::-1]))
    a = padded[order]
    differs = a[1:] != a[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(sizes[order][1:], sizes[order][:-1]))
    return order, np.r_[-1, common]


def settle_contexts(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """For each context, how far before and after its anchor runs that another context shares reach (0, 0: none).

    ``left`` holds the bytes before the anchor, nearest first; ``right`` those from it on; both zero-padded, with their numbers of bytes.
    """
    k = len(left)
    r_order, r_common = _ordered(right, n_right)
    l_order, l_common = _ordered(left, n_left)
    before, after = np.zeros(k, np.int32), np.zeros(k, np.int32)
    r_class, l_class = np.empty(k, np.int64), np.empty(k, np.int64)
    for x in range(min(runs.length - runs.gram, int(n_left.max(initial=0))) + 1):
        fits = np.flatnonzero((n_left >= x) & (n_right >= runs.length - x))
        if len(fits) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < runs.length - x)
        l_class[l_order] = np.cumsum(l_common < x)
        key = r_class[fits] * (k + 2) + l_class[fits]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = fits[order[np.r_[same, False] | np.r_[False, same]]]
        before[hit] = x
        after[hit[after[hit] == 0]] = runs.length - x
    return before, after


def _pieces(around: DataFrame, runs: Runs) -> DataFrame:
    """``large, g, c, tk, tl, lo, raw``: the context of each unsettled anchor, at ``lo``, or (``large``) both halves of the runs through it.

    A run through an anchor starts at most ``half`` bytes before it, or further.  All runs of the first half hold the bytes from the anchor to where the shortest of
    them ends, those of the second the bytes from where the latest starts to the end of the gram; ``g`` is then the hash of these bytes,
    and ``raw`` are the bytes that the runs of the half cover, from place ``lo`` on.
    """
    reach = runs.length - runs.gram
    half = reach // 2

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for tk, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for p in places:
                pos, tl = p["pos"], len(raw)
                if p["tl"] != tl:
                    continue
                if not p["large"]:
                    rows.append((False, p["g"], p["c"], tk, tl, pos, raw[max(0, pos - reach) : pos + runs.length]))
                    continue
                # (side, starts before the anchor from and to, bytes that all of these runs hold)
                for side, far, near, held in ((0, half, 0, (pos, pos + runs.length - half)), (1, reach, half + 1, (pos - half - 1, pos + runs.gram))):
                    first, last = max(0, pos - far), min(pos - near, tl - runs.length)
                    if first <= last:
                        h = xxhash.xxh64_intdigest(raw[held[0] : held[1]], seed=side) - 2**63
                        rows.append((True, h, p["c"], tk, tl, first, raw[first : last + runs.length]))
        types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["large", "g", "c", "tk", "tl", "lo", "raw"])

    return map_batches(around, fetch, "large boolean, g bigint, c bigint, tk bigint, tl int, lo int, raw binary")


def _windows(halves: DataFrame, runs: Runs) -> DataFrame:
    """``h1, h2, tk, tl, lo`` of all runs in ``raw``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = batch.column(3).to_pylist()
        values, ends = runs.tokens(raws)
        sizes = np.diff(ends) - runs.length + 1
        own = np.repeat(np.arange(len(raws)), sizes)
        step = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = ends[own] + step
        h1 = mix(Rolling(values)(at, at + runs.length)).view(np.int64)
        h2 = mix(Rolling(mix(values + np.uint64(1)))(at, at + runs.length)).astype(np.uint32).view(np.int32)
        tk, tl, lo = (batch.column(i).to_numpy()[own] for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, tk, tl, (lo + step).astype(np.int32))], ["h1", "h2", "tk", "tl", "lo"])

    return map_batches(halves.select("tk", "tl", "lo", "raw"), run, "h1 bigint, h2 int, tk bigint, tl int, lo int")


def _sorted(contexts: DataFrame, runs: Runs) -> DataFrame:
    """Spans ``tk, tl, lo, hi`` of contexts of small groups that share runs."""
    reach = runs.length - runs.gram

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            texts, tk = t["raw"].to_pylist(), t["tk"].to_numpy()
            pos, tl = t["lo"].to_numpy().astype(np.int64), t["tl"].to_numpy().astype(np.int64)
            n_left, n_right = np.minimum(pos, reach), np.minimum(tl - pos, runs.length)
            size = reach + runs.length
            # the anchor of every context at the same column
            joined = np.frombuffer(b"".join(b"\0" * (reach - a) + x + b"\0" * (size - reach - b) for x, a, b in zip(texts, n_left.tolist(), n_right.tolist(), strict=True)), np.uint8).reshape(-1, size)
            before, after = settle_contexts(joined[:, :reach][:, ::-1], n_left, joined[:, reach:], n_right, runs)
            hit = np.flatnonzero(after)
            columns = [tk[hit], tl[hit].astype(np.int32), (pos - before)[hit].astype(np.int32), (pos + after)[hit].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["tk", "tl", "lo", "hi"])

        n, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)  # copies of a context follow each other
            fresh = np.r_[last is None or bool((keys[0] != last).any()), (keys[1:] != keys[:-1]).any(axis=1)]
            batch, last = batch.filter(pa.array(fresh)), keys[-1]
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                g = part.column(0).to_numpy()
                if n >= TOGETHER:
                    # groups that have ended go; the last may go on
                    ends = np.flatnonzero(g != held[-1].column(0)[-1].as_py())
                    if len(ends):
                        yield spans([*held, part.slice(0, ends[0])])
                        part, held, n = part.slice(ends[0]), [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield spans(held)

    rows = contexts.select("g", "c", "tk", "tl", "lo", "raw").repartition("g").sortWithinPartitions("g", "c")
    return rows.mapInArrow(match, "tk bigint, tl int, lo int, hi int")


def _counted(halves: DataFrame, runs: Runs) -> DataFrame:
    """Spans ``tk, tl, lo, hi`` of runs that unlike contexts share: only halves whose common bytes are found in unlike contexts are hashed run by run."""
    shared = apart(halves.groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("g"))
    return repeated(_windows(halves.join(shared, "g"), runs), runs)


def _settled(unsettled: DataFrame, docs: DataFrame, runs: Runs, text_col: str, together: int) -> DataFrame:
    """Spans ``tk, tl, lo, hi`` of ``unsettled`` contexts (``g, c, tk, tl, pos``) that share runs."""
    large = settle(unsettled.select("g", "c").distinct().groupBy("g").count().where(F.col("count") > together).select("g"), "large")
    marked = unsettled.join(large.withColumn("large", F.lit(True)), "g", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    pieces = _pieces(at_texts(marked, docs, text_col), runs)
    if large.isEmpty():
        return _sorted(pieces, runs)
    pieces = settle(pieces, "pieces")
    return _sorted(pieces.where("not large"), runs).union(_counted(pieces.where("large"), runs))


@dataclass
class SuffixFamily:
    """The levels and what scans have found so far, all in written tables."""

    spark: SparkSession
    runs: Runs = field(default_factory=lambda: Runs(200, 32, False))
    levels: list[tuple[int, DataFrame]] = field(default_factory=list)
    found: list[DataFrame] = field(default_factory=list)
    together: int = TOGETHER

    def _merge(self) -> None:
        """Merge equal-sized levels, the smallest first, until all sizes differ."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            first = F.min(F.struct("tk", "tl", "pos"))
            merged = a.union(b).groupBy("g", "c").agg(first.alias("at"), F.sum("copies").cast("int").alias("copies")).select("g", "c", "at.tk", "at.tl", "at.pos", "copies")
            self.levels.append((n + m, settle(merged, "level")))
            discard(a.union(b))

    def add(self, batch: DataFrame, text_col: str = "text") -> None:
        """Merge-scan a batch of documents against the levels, then add it as a level."""
        self._merge()
        old = reduce(DataFrame.union, [level for _, level in self.levels]) if self.levels else None
        level, found = scan(self.runs.occurrences(batch, text_col), old)
        self.levels.append((1, level))
        self.found.append(found)

    def spans(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``tk, tl, lo, hi``: byte spans of texts covered by repeated strings; ``docs`` are all documents added."""
        found = self.found[0] if self.found else self.spark.createDataFrame([], "kind tinyint, " + OCCURRENCE)
        for more in self.found[1:]:
            found = found.union(more)
        unsettled = found.where("kind = 2").select("tk", "tl", "pos", "g", "c")
        return whole_spans(found, self.runs).union(_settled(unsettled, docs, self.runs, text_col, self.together))


def repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 32, batches: int = BATCHES, text_col: str = "text") -> DataFrame:
    """Byte spans covered by ``length``-byte strings that occur elsewhere, the documents added in ``batches`` by the hash of their text."""
    family = SuffixFamily(docs.sparkSession, Runs(length, gram, False))
    for i in range(batches):
        family.add(docs.where(F.pmod(text_key(text_col), F.lit(batches)) == i), text_col)
    return family.spans(docs, text_col)


def remove_bytes(docs: DataFrame, length: int = 200, gram: int = 32, batches: int = BATCHES, keep: list[str] | None = None, text_col: str = "text", as_text: bool = False) -> DataFrame:
    """``keep`` (default: all columns but the text), ``n_bytes``, ``spans`` and ``kept`` (binary) of every row.

    ``kept`` is the UTF-8 text without the bytes of ``spans`` (half-open, maximal, ascending); it may cut a character.  With ``as_text`` it is a string
    without the rests of cut characters.  A null text is empty.
    Matches never cross documents; a repeated row is a copy.  Clashing columns of the input are replaced.
    """
    new = ("n_bytes", "spans", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, *new)]
    fields = [f"`{c}` {kind(docs, c)}" for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, spans, kept = [], [], []
        for text, found in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
            raw = text.encode()
            own = own_spans(found, len(raw))
            edges = [0, *(e for span in own for e in span), len(raw)]
            n_bytes.append(len(raw))
            spans.append([{"lo": lo, "hi": hi} for lo, hi in own])
            rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n_bytes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())], [*keep, *new])

    found = with_spans(docs, repeated_bytes(docs, length, gram, batches, text_col), keep, text_col)
    return map_batches(found, run, ", ".join([*fields, "n_bytes bigint, spans array<struct<lo:int,hi:int>>", "kept string" if as_text else "kept binary"]))
