"""Where two texts can share a run of ``length`` tokens: content-chosen anchors and the contexts around them.

Every run of ``length`` tokens holds grams of ``gram`` tokens; its anchors are the grams whose hash is the run's smallest.  Equal runs have
equal anchors at equal places, so a run can only repeat if the gram of its anchor does.  An anchor's context is all that runs
through it can cover: ``length - gram`` tokens before it and ``length`` tokens from it on, as far as its text goes.

Texts are known by (``tk``, ``tl``), a hash and the number of tokens: what is removed from a text depends on the text alone,
so copies share their result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import map_batches, settle, text_of

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
OCCURRENCE = "g bigint, c bigint, tk bigint, tl int, pos int, copies int"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]))
        for i, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


class Rolling:
    """Rabin-Karp hashes of any ranges of a token sequence, from one prefix sum."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = powers(len(tokens))
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token values of the joined texts, and the tokens before each text (and all)."""
    ends = np.cumsum([0, *map(len, texts)])
    return BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)], ends


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text."""
    edge = np.diff(np.r_[True, _SPACES[np.frombuffer(raw, np.uint8)], True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts)
    starts, ends = word_bounds(joined)
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    values = mix(Rolling(BYTE_VALUES[np.frombuffer(joined, np.uint8)])(starts, ends) + (ends - starts).astype(np.uint64))
    return values, np.searchsorted(starts, places)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest (or largest) of each ``width`` neighbours, by prefix and suffix extremes of blocks."""
    n, op = len(values), np.minimum if least else np.maximum
    fill = np.uint64(2**64 - 1) if least else np.uint64(0)
    blocks = np.full(-(-n // width) * width, fill, np.uint64)
    blocks[:n] = values
    ahead = op.accumulate(blocks.reshape(-1, width), axis=1).ravel()
    behind = op.accumulate(blocks.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


@dataclass(frozen=True)
class Runs:
    """Runs of ``length`` tokens with grams of ``gram`` tokens; ``words``: tokens are words, else bytes."""

    length: int
    gram: int
    words: bool

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return word_tokens(texts) if self.words else byte_tokens(texts)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, tokens of it, place, gram hash, context hash) of every anchor."""
        values, ends = self.tokens(texts)
        width, sizes = self.length - self.gram + 1, np.diff(ends)
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if len(values) < self.length:
            return none
        roll = Rolling(values)
        starts = np.arange(len(values) - self.gram + 1)
        grams = mix(roll(starts, starts + self.gram)) | np.uint64(1)
        text = np.repeat(np.arange(len(texts)), sizes)
        least = _sliding(grams, width, True)
        least[ends[text[: len(least)] + 1] - starts[: len(least)] < self.length] = 0  # runs that would leave their text
        # largest minimum of the runs through each gram
        padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        padded[width - 1 : width - 1 + len(least)] = least
        at = np.flatnonzero(_sliding(padded, width, False)[: len(grams)] == grams)
        if not len(at):
            return none
        own = text[at]
        lo, hi = np.maximum(ends[own], at - (self.length - self.gram)), np.minimum(ends[own + 1], at + self.length)
        context = mix(roll(lo, hi) + mix(((at - lo) * (self.length + 1) + hi - at + 1).astype(np.uint64)))
        return own, sizes[own], at - ends[own], grams[at].view(np.int64), context.view(np.int64)

    def occurrences(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Anchors of all texts (``OCCURRENCE``); copies that meet in a slice of a task are one row with their number."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            tk, first, copies = np.unique(batch.column(1).to_numpy(), return_index=True, return_counts=True)
            texts = [x.encode() for x in batch.column(0).take(pa.array(first)).to_pylist()]
            own, tl, pos, g, c = self.find(texts)
            columns = [g, c, tk[own] if len(own) else tk[:0], tl.astype(np.int32), pos.astype(np.int32), copies[own].astype(np.int32) if len(own) else copies[:0].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["g", "c", "tk", "tl", "pos", "copies"])

        return map_batches(docs.select(text_of(text_col).alias("text"), text_key(text_col).alias("tk")), run, OCCURRENCE)


def text_key(text_col: str = "text") -> Column:
    return F.xxhash64(text_of(text_col))


def apart(keys: DataFrame) -> DataFrame:
    """Counted keys dealt out otherwise than by key: the join to their rows then shuffles both sides itself, and only such a join is split where it is crowded."""
    return keys.repartition(F.xxhash64(F.lit(1), *keys.columns))


def scan(occurrences: DataFrame, old: DataFrame | None = None, level: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """Tell what repeats: (distinct contexts of the new rows with their number of ``copies``, found).  Without ``level``, rows of grams that
    occur once are not written and the first is none.

    ``occurrences`` and ``old`` (rows of an existing index) have ``OCCURRENCE``.  ``found`` has rows of two kinds: 1, a text whose whole context there occurs
    elsewhere too; 2, a context with unlike contexts around the same gram (one of them new): these may share parts.

    No task holds the group of a gram: grams, then their contexts, are counted on the map side first, and the counts are joined to the rows, whose
    crowded partitions Spark can split.  Only rows of grams that occur twice go beyond the first join.
    """
    rows = occurrences.withColumn("old", F.lit(False))
    if old is not None:
        rows = rows.union(old.withColumn("old", F.lit(True)))
    twice = apart(rows.groupBy("g").agg(F.sum("copies").alias("n")).where("n > 1").select("g"))
    # an old row whose gram the new rows lack stays where it is
    told = settle(rows.join(twice.withColumn("again", F.lit(True)), "g", "left" if level else "inner").where("again or not old"), "grams")
    again = told.where("again")
    contexts = settle(
        again.groupBy("g", "c").agg(F.min(F.struct("tk", "tl", "pos")).alias("at"), F.sum("copies").cast("int").alias("copies"), F.max(~F.col("old")).alias("added"))
        .select("g", "c", "at.tk", "at.tl", "at.pos", "copies", "added"),
        "contexts",
    )
    columns = ["g", "c", "tk", "tl", "pos", "copies"]
    new = told.where("again is null and not old").select(*columns).union(contexts.where("added").select(*columns)) if level else None
    # a text that the index has counted as repeated needs no second mention
    whole = again.where("not (old and copies > 1)").join(contexts.where("copies > 1").select("g", "c"), ["g", "c"])
    unlike = apart(contexts.groupBy("g").agg(F.count("*").alias("n"), F.max("added").alias("new")).where("n > 1 and new").select("g"))
    found = whole.select(F.lit(1).cast("tinyint").alias("kind"), *columns).union(contexts.join(unlike, "g").select(F.lit(2).cast("tinyint").alias("kind"), *columns))
    return new, settle(found, "found")


def whole_spans(found: DataFrame, runs: Runs) -> DataFrame:
    """``tk, tl, lo, hi`` (tokens) of contexts that occur elsewhere as a whole and have room for a run."""
    lo, hi = F.greatest(F.lit(0), F.col("pos") - (runs.length - runs.gram)), F.least(F.col("tl"), F.col("pos") + runs.length)
    return found.where("kind = 1").select("tk", "tl", lo.alias("lo"), hi.alias("hi")).where(F.col("hi") - F.col("lo") >= runs.length)


def repeated(windows: DataFrame, runs: Runs) -> DataFrame:
    """Spans ``tk, tl, lo, hi`` of those ``windows`` (``h1, h2, tk, tl, lo``) whose hashes are found at two places."""
    place = F.struct("tk", "lo")
    twice = apart(windows.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h1", "h2"))
    return windows.join(twice, ["h1", "h2"]).select("tk", "tl", "lo", (F.col("lo") + runs.length).alias("hi"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as maximal ones."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``tk, text`` with copies that meet in an Arrow batch as one row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.take(pa.array(np.unique(batch.column(0).to_numpy(), return_index=True)[1]))

    return map_batches(docs.select(text_key(text_col).alias("tk"), text_of(text_col).alias("text")), run, "tk bigint, text string", 10_000)


def at_texts(places: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows ``tk, text, places`` of the texts that have rows in ``places`` (its other columns as structs)."""
    lists = places.groupBy("tk").agg(F.collect_set(F.struct(*[c for c in places.columns if c != "tk"])).alias("places"))
    return distinct_texts(docs, text_col).join(lists, "tk")


def _keyed(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    return docs.select(*keep, text_of(text_col).alias("_text"), text_key(text_col).alias("tk"))


def at_rows(places: DataFrame, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """As ``at_texts``, but ``tk, text, places, keep`` for every row of such a text, copies too: a function of Arrow batches that takes all of these columns
    reads the rows from the one shuffle that :func:`with_spans` of the same ``keep`` and query makes of them."""
    lists = places.groupBy("tk").agg(F.collect_set(F.struct(*[c for c in places.columns if c != "tk"])).alias("places"))
    return _keyed(docs, keep, text_col).join(lists, "tk").select("tk", F.col("_text").alias("text"), "places", *keep)


def with_spans(docs: DataFrame, spans: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, ``_text`` and ``_spans`` (null: none) for every row of ``docs``; spans are not merged yet."""
    lists = spans.groupBy("tk").agg(F.collect_set(F.struct("tl", "lo", "hi")).alias("_spans"))
    return _keyed(docs, keep, text_col).join(lists, "tk", "left").select(*keep, "_text", "_spans")


def own_spans(found: list[dict] | None, tokens: int) -> list[tuple[int, int]]:
    """Maximal spans of a text of so many tokens."""
    return merged([(s["lo"], s["hi"]) for s in found or () if s["tl"] == tokens])
