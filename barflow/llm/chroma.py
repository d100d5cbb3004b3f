"""Chroma audio fingerprints of a media column, and their alignment.

A recording (WAV bytes) becomes frames of energy in the 12 pitch classes.  An integral image over frames and classes gives the sums of
rectangles that 16 filters compare; each comparison is two bits, and a frame's 32 bits are its packed integer.  Recordings are aligned by the
halves of integers they share: the histogram of offsets between equal halves names the offsets that are measured, and the least share of
differing bits over the overlap at one of them is the distance.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import kind, map_batches, settle

CLASSES = 12
# (shape, first class, classes, frames): what of a rectangle is compared.  Shapes: 0 all against nothing, 1 upper and lower half, 2 first and second half,
# 3 diagonal quarters, 4 middle third of the classes against the rest, 5 middle third of the frames against the rest.
# fixed values: the filter table published with the open-source Chromaprint library, whose own source is under the MIT licence
FILTERS = [
    (0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
    (2, 6, 2, 16), (2, 1, 3, 2), (5, 10, 1, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14),
]
WIDEST = 16
# Bits of a part of an integer that votes for an offset if it is equal: with 15% differing bits, one of the 88 parts of 44 integers is equal in 99.9% of pairs.
PART = 16


@dataclass(frozen=True)
class Settings:
    """Sample rate to which recordings are brought, samples of a frame, samples between frames, lowest and highest frequency, band of the two-bit steps."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    low: float = 28.0
    high: float = 3520.0
    band: float = 0.35
    silence: float = 1e-4


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (-1 to 1, channels averaged) and rate of 8-, 16- or 32-bit PCM; null or unreadable bytes: no samples."""
    if not data:
        return np.zeros(0), 1
    try:
        with wave.open(io.BytesIO(data)) as w:
            raw, size, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), 1
    kinds = {1: ("u1", 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}
    if size not in kinds or not rate or not channels:
        return np.zeros(0), 1
    dtype, zero, scale = kinds[size]
    x = (np.frombuffer(raw[: len(raw) // (size * channels) * size * channels], dtype).astype(np.float64) - zero) / scale
    return x.reshape(-1, channels).mean(axis=1), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def chroma(samples: np.ndarray, rate: int, s: Settings) -> np.ndarray:
    """Energy of the pitch classes in every frame (rows), each row of length one; silent frames are zero."""
    if rate != s.rate and len(samples):
        n = int(len(samples) * s.rate / rate)
        samples = np.interp(np.arange(n) * (rate / s.rate), np.arange(len(samples)), samples)
    if len(samples) < s.frame:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, s.frame)[:: s.hop]
    frequency = np.fft.rfftfreq(s.frame, 1 / s.rate)
    used = (frequency >= s.low) & (frequency <= s.high)
    pitch = np.round(12 * np.log2(frequency[used] / 440.0)).astype(int) % CLASSES
    to_class = np.zeros((used.sum(), CLASSES), np.float32)
    to_class[np.arange(used.sum()), pitch] = 1
    out = np.concatenate([(np.abs(np.fft.rfft(frames[i : i + 256] * np.hanning(s.frame), axis=1)[:, used]) ** 2).astype(np.float32) @ to_class for i in range(0, len(frames), 256)])
    norm = np.linalg.norm(out, axis=1)
    return np.where((norm > s.silence * s.frame)[:, None], out / np.maximum(norm, 1e-12)[:, None], 0).astype(np.float64)


def _sums(image: np.ndarray, frame: np.ndarray, frames: tuple[float, float], classes: tuple[float, float], first: int) -> np.ndarray:
    """Sums of the rectangle frames x classes (relative bounds) at each start frame, classes counted round."""
    a, b = frame + int(frames[0]), frame + int(frames[1])
    c, d = first + int(classes[0]), first + int(classes[1])
    return image[b, d] - image[a, d] - image[b, c] + image[a, c]


def integers(image: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(first frame, packed integer) of every full window of chroma rows that is not all silent."""
    n = len(image) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 2 * CLASSES + 1))
    integral[1:, 1:] = np.concatenate([image, image], axis=1).cumsum(axis=0).cumsum(axis=1)
    frame, packed = np.arange(n), np.zeros(n, np.uint32)
    for shape, first, h, w in FILTERS:
        whole = _sums(integral, frame, (0, w), (0, h), first)
        if shape == 0:
            part = whole
            whole = part + w * h / CLASSES**0.5  # against an even spread
        elif shape == 1:
            part = _sums(integral, frame, (0, w), (0, h // 2), first) * h / max(1, h // 2) / 2
        elif shape == 2:
            part = _sums(integral, frame, (0, w // 2), (0, h), first)
        elif shape == 3:
            part = _sums(integral, frame, (0, w // 2), (0, h // 2), first) + _sums(integral, frame, (w // 2, w), (h // 2, h), first)
        elif shape == 4:
            part = 1.5 * _sums(integral, frame, (0, w), (h // 3, h - h // 3), first)
        else:
            part = 1.5 * _sums(integral, frame, (w // 3, w - w // 3), (0, h), first)
        value = np.log((1 + np.maximum(part, 0)) / (1 + np.maximum(whole - part, 0)))
        level = (value > -s.band).astype(np.uint32) + (value > 0) + (value > s.band)
        packed = packed << np.uint32(2) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ in one bit
    heard = integral[WIDEST:, CLASSES] - integral[:-WIDEST, CLASSES] > 0
    return frame[heard].astype(np.int32), packed[heard]


def fingerprints(media: DataFrame, id_col: str, audio_col: str = "audio", settings: Settings | None = None) -> DataFrame:
    """``id_col, frames, ints``: places and packed integers (as ints) of each recording, one row for each input row.

    Null, unreadable, silent and too short recordings have none; ids may be null or repeat; other columns are not carried.
    """
    s = settings or Settings()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [integers(chroma(*read_wav(x), s), s) for x in batch.column(1).to_pylist()]
        columns = [pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([b.view(np.int32) for _, b in found], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "frames", "ints"])

    return map_batches(media.select(id_col, audio_col), run, f"`{id_col}` {kind(media, id_col)}, frames array<int>, ints array<int>", 64)


# Votes that an offset needs before a pair is looked at.
LEAST_VOTES = 2
# Integers of the queries that one task holds at a time, of the recordings that one cell of a tile meets them with, and votes counted at once.
TILE, CELL, VOTES_AT_ONCE = 2**18, 2**16, 2**19


def _postings(prints: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(recording, frame, part and value) of the halves of integers that differ from the half before them."""
    sizes = np.array([len(x["ints"]) for x in prints])
    owner = np.repeat(np.arange(len(prints)), sizes)
    frame = np.concatenate([np.asarray(x["frames"], np.int64) for x in prints])
    ints = np.concatenate([np.asarray(x["ints"], np.int32) for x in prints]).view(np.uint32)
    found = []
    for i, shift in enumerate(range(0, 32, PART)):
        value = (ints >> np.uint32(shift) & np.uint32(2**PART - 1)).astype(np.int64)
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        found.append((owner[new], frame[new], value[new] + i * 2**PART))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


class Tile:
    """Queries that recordings are compared with: their postings in the order of their values."""

    def __init__(self, prints: list[dict]):
        self.prints = [(np.asarray(x["frames"], np.int64), np.asarray(x["ints"], np.int32).view(np.uint32)) for x in prints]
        owner, frame, value = _postings(prints)
        order = np.argsort(value, kind="stable")
        self.owner, self.frame, self.last = owner[order], frame[order], int(frame.max())
        self.starts = np.searchsorted(value[order], np.arange(2 * 2**PART + 1))

    def votes(self, prints: list[dict]) -> tuple[np.ndarray, ...]:
        """(recording, query, offset, votes) of all offsets with ``LEAST_VOTES`` or more."""
        owner, frame, value = _postings(prints)
        order = np.argsort(owner, kind="stable")
        owner, frame, value = owner[order], frame[order], value[order]
        n = self.starts[value + 1] - self.starts[value]
        offsets = self.last + int(frame.max()) + 1
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = np.cumsum(n)
        cuts = np.searchsorted(done, np.arange(VOTES_AT_ONCE, done[-1] + VOTES_AT_ONCE, VOTES_AT_ONCE), side="right")
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(n)], strict=True):
            some = n[lo:hi]
            if some.sum():
                at = np.repeat(self.starts[value[lo:hi]] - np.cumsum(some) + some, some) + np.arange(some.sum())
                key = (np.repeat(owner[lo:hi], some) * len(self.prints) + self.owner[at]) * offsets + np.repeat(frame[lo:hi], some) - self.frame[at] + self.last
                key, count = np.unique(key, return_counts=True)
                keys, which = np.unique(np.r_[keys, key], return_inverse=True)
                counts = np.bincount(which, np.r_[counts, count]).astype(np.int64)
        keys, counts = keys[counts >= LEAST_VOTES], counts[counts >= LEAST_VOTES]
        return keys // offsets // len(self.prints), keys // offsets % len(self.prints), keys % offsets - self.last, counts

    def links(self, prints: list[dict], most_errors: float, least_overlap: int) -> list[tuple]:
        """(recording, query, votes, offset, overlap, errors) of each pair with few enough errors at its best offset."""
        found, query, offset, votes = self.votes(prints)
        first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (query[1:] != query[:-1])][: len(found)])
        out, held, place = [], -1, np.zeros(0, np.int64)
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(found)][: len(first)], strict=True):
            f, (at, ints), best = int(found[lo]), self.prints[query[lo]], None
            if f != held:
                held, to, other = f, np.asarray(prints[f]["frames"], np.int64), np.asarray(prints[f]["ints"], np.int32).view(np.uint32)
                place = np.full(to[-1] + 1, -1)
                place[to] = np.arange(len(to))
            most = votes[lo:hi].max()
            for o, v in zip(offset[lo:hi].tolist(), votes[lo:hi].tolist(), strict=True):
                if v * 2 >= most:
                    moved = at + o
                    inside = (moved >= 0) & (moved <= to[-1])
                    inside[inside] = place[moved[inside]] >= 0
                    n = int(inside.sum())
                    if n >= least_overlap:
                        errors = float(np.bitwise_count(ints[inside] ^ other[place[moved[inside]]]).sum()) / (32 * n)
                        best = min(best or (2.0,), (errors, -v, abs(o), -o, n))
            if best and best[0] <= most_errors:
                out.append((f, int(query[lo]), -best[1], -best[3], best[4], best[0]))
        return out


def align(prints: DataFrame, wanted: DataFrame, id_col: str, most_errors: float = 0.15, least_overlap: int = 12) -> tuple[DataFrame, DataFrame]:
    """Align the recordings of ``wanted`` (ids) with all of ``prints``: (classes, links).

    ``classes`` has a row for each input row: ``id_col`` and ``class_id``, the smallest id with the same fingerprint (null: no fingerprint); equal recordings are
    aligned once.  ``links`` has a row for each pair of a wanted class ``query`` and another class ``found`` that overlaps at the best ``offset`` (frames of
    ``found`` minus frames of ``query``) in ``least_overlap`` frames or more with at most ``most_errors`` differing bits: ``errors`` is their share.  Halves of
    integers vote for offsets (runs of one half in a recording count once); offsets with at least two votes and at least half the votes of the first are
    measured, and the best has the fewest errors (then most votes, then the smallest offset).  A pair without two equal halves at its offset is not seen:
    unrelated recordings share one half by chance, but hardly ever two at one offset, so only likely pairs meet their fingerprints.
    Queries are dealt to tiles, recordings to shares, and each cell (tile, share) counts votes in its task: votes and pairs without a link are never rows.
    """
    rows = settle(prints, "prints")
    heard = rows.where(F.size("ints") > 0)
    key = F.struct("frames", "ints")
    classes = heard.groupBy(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2")).agg(F.min(id_col).alias("class_id"), F.min_by(key, id_col).alias("print"))
    classes = settle(classes, "classes")
    member = rows.join(classes.select("h1", "h2", "class_id"), (F.xxhash64(key) == F.col("h1")) & (F.hash(key) == F.col("h2")) & (F.size("ints") > 0), "left").select(id_col, "class_id")
    asked = member.join(wanted.select(id_col).distinct(), id_col, "left_semi").where(F.col("class_id").isNotNull()).select("class_id").distinct()
    known = classes.where("class_id is not null").select("class_id", "print")
    queries = settle(known.join(asked, "class_id", "left_semi"), "queries")
    # every query meets every recording in one cell: its tile's, of the recording's share
    size = F.coalesce(F.sum(F.size("print.ints").cast("bigint")), F.lit(0))
    (ints,), (asked_ints,) = known.agg(size).first(), queries.agg(size).first()
    shares, tiles = int(-(-ints // CELL)) or 1, int(-(-asked_ints // TILE)) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("print"), F.lit(n)).cast("int")
    dealt = (
        queries.select(of(tiles).alias("tile"), each(shares).alias("share"), F.lit(0).alias("side"), "class_id", "print")
        .union(known.select(each(tiles).alias("tile"), of(shares).alias("share"), F.lit(1).alias("side"), "class_id", "print"))
        .repartition("tile", "share").sortWithinPartitions("tile", "share", "side")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tile, held, names = None, None, [], []
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                ids, tracks = batch.column(3), batch.column(4).to_pylist()
                cells = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
                for lo in [i for i, x in enumerate(cells) if not i or x != cells[i - 1]]:
                    hi = next((i for i in range(lo, len(cells)) if cells[i] != cells[lo]), len(cells))
                    if cells[lo][:2] != cell:
                        cell, tile, held, names = cells[lo][:2], None, [], []
                    if not cells[lo][2]:
                        held += tracks[lo:hi]
                        names.append(ids.slice(lo, hi - lo))
                    elif held:
                        if tile is None:
                            tile, names = Tile(held), pa.concat_arrays(names)
                        met = [(lo + f, q, *x) for f, q, *x in tile.links(tracks[lo:hi], most_errors, least_overlap)]
                        if met:
                            found, query, votes, offset, overlap, errors = zip(*met, strict=True)
                            columns = [pa.array(votes, pa.int64()), pa.array(offset, pa.int32()), pa.array(overlap, pa.int32()), pa.array(errors, pa.float64())]
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids.take(pa.array(found)), *columns], ["query", "found", "votes", "offset", "overlap", "errors"])

    t = kind(prints, id_col)
    links = dealt.mapInArrow(compare, f"query {t}, found {t}, votes bigint, offset int, overlap int, errors double")
    return member, links.where("query <> found")
