"""Toxicity by compression distance: two zstandard dictionaries, trained on toxic and on ordinary text.

Every window of words is compressed with both dictionaries; the bytes that the toxic one saves over the ordinary one are the window's
evidence.  A text's score is the calibrated probability of the strongest evidence in it.

Words are written before compression as codes of their beginnings (a code for the first four letters, one for each further letter, one for the
end), so that words with a common stem share bytes and others do not, whatever letters they have in common.  The ordinary
dictionary holds the codes of the commonest words of ordinary text; the toxic one these and the stems that many toxic texts have, in ever
new surroundings, and ordinary ones lack.  The threshold comes from an isotonic fit of the labels on texts that trained no dictionary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import kind, map_batches, remembered, text_of

WORDS_A_WINDOW = 8
LEVEL = 6  # lower levels do not search the dictionary well enough for lengths to be comparable
LETTERS = (4, 12)  # shortest stem, longest
COMMON = 1500  # words of the ordinary dictionary
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def stems(word: str) -> list[str]:
    """Beginnings of a word that can be learned; the whole word ends in a blank."""
    return [word[:n] for n in range(LETTERS[0], min(len(word), LETTERS[1]) + 1)] + ([f"{word} "] if len(word) >= LETTERS[0] else [])


def code(word: str) -> bytes:
    """Bytes of a word (or of a stem: without the end code)."""
    bare = word.rstrip()
    if len(bare) < LETTERS[0]:
        return xxhash.xxh32_digest(bare)[:3]
    parts = [xxhash.xxh64_digest(bare[: LETTERS[0]])]
    parts += [xxhash.xxh32_digest(bare[:n]) for n in range(LETTERS[0] + 1, min(len(bare), LETTERS[1]) + 1)]
    return b"".join(parts) + (xxhash.xxh32_digest(word) if word.endswith(" ") else b"")


def _surroundings(texts: list[str], only: set[str]) -> dict[str, int]:
    """In how many different surroundings (neighbour words of the first use in a text) the stems ``only`` are found: copies count once."""
    seen = defaultdict(set)
    for text in texts:
        words, own = words_of(text), set()
        for i, w in enumerate(words):
            if w not in own:
                own.add(w)
                for s in stems(w):
                    if s not in own and s in only:
                        own.add(s)
                        seen[s].add(hash((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")))
    return {s: len(v) for s, v in seen.items()}


def learn_stems(toxic: list[str], ordinary: list[str], ratio: float = 25.0) -> list[str]:
    """Stems that are at least ``ratio`` times as frequent in toxic texts, the commonest last."""
    if not toxic or not ordinary:
        return []
    least = max(3, round(0.35 * len(toxic) ** 0.5))
    texts = Counter(s for text in toxic for s in {s for w in set(words_of(text)) for s in stems(w)})
    common = {s for s, n in texts.items() if n >= least}
    del texts
    t, o = _surroundings(toxic, common), _surroundings(ordinary, common)
    good = {s: n for s, n in t.items() if n >= least and n / len(toxic) >= ratio * (o.get(s, 0) + 0.2) / len(ordinary)}
    roots = {s for s in good if not any(s[:n] in good for n in range(LETTERS[0], len(s.rstrip())))}
    longest = set()
    for s in roots:  # a root goes on while nearly all its uses do
        while more := [x for x in good if len(x) == len(s) + 1 and x.startswith(s) and good[x] >= 0.9 * good[s]]:
            s = more[0]
        longest.add(s)
    return sorted(longest, key=lambda s: (good[s], s))


@dataclass(frozen=True)
class ToxicityModel:
    """Contents of the two dictionaries and the calibration (evidence, probability), ascending."""

    toxic: bytes
    ordinary: bytes
    evidence: tuple[float, ...]
    probability: tuple[float, ...]

    def scorer(self) -> Scorer:
        return remembered(("toxicity", zlib.crc32(self.toxic + self.ordinary)), lambda: Scorer(self))


class Scorer:
    """Compressors of a model, made once in each worker."""

    def __init__(self, model: ToxicityModel):
        self.model, self.codes = model, {}
        self.toxic, self.ordinary = (self._compress(x) for x in (model.toxic + model.ordinary, model.ordinary))

    @staticmethod
    def _compress(content: bytes):
        dictionary = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def evidence(self, text: str) -> float:
        """Bytes saved in the strongest window, and a fifth of those in the second."""
        codes = self.codes
        if len(codes) > REMEMBERED:
            codes.clear()
        coded = []
        for w in words_of(text):
            c = codes.get(w)
            if c is None:
                c = codes[w] = code(f"{w} ")
            coded.append(c)
        toxic, ordinary = self.toxic, self.ordinary
        first = second = 0
        for at in range(0, len(coded), WORDS_A_WINDOW):
            window = b"".join(coded[at : at + WORDS_A_WINDOW])
            saved = len(ordinary(window)) - len(toxic(window))
            if saved > second:
                first, second = max(first, saved), min(first, saved)
        return first + 0.2 * second

    def score(self, text: str) -> float:
        return float(np.interp(self.evidence(text), self.model.evidence, self.model.probability))


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Rising steps of the share of ones (with one half of each kind added to a step), by pooling neighbours."""
    blocks: list[list[float]] = []  # mean x, ones, rows
    for value in np.unique(x):
        here = y[x == value]
        blocks.append([float(value), float(here.sum()), float(len(here))])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a, b = blocks[-2:]
            blocks[-2:] = [[(a[0] * a[2] + b[0] * b[2]) / (a[2] + b[2]), a[1] + b[1], a[2] + b[2]]]
    share = np.maximum.accumulate([(ones + 0.25) / (rows + 0.5) for _, ones, rows in blocks])
    return tuple(b[0] for b in blocks), tuple(float(s) for s in share)


def fit(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Dictionaries from two of three texts, calibration from the rest."""
    train = [[t for i, t in enumerate(x) if i % 3 < 2] for x in (toxic, ordinary)]
    common = Counter(w for text in train[1] for w in words_of(text)).most_common(COMMON)
    content = b"".join(code(f"{w} ") for w, _ in reversed(common))
    learned = b"".join(code(s) for s in learn_stems(*train))
    model = ToxicityModel(learned, content, (0.0,), (0.0,))
    scorer = Scorer(model)
    held = [[scorer.evidence(t) for i, t in enumerate(x) if i % 3 == 2] for x in (toxic, ordinary)]
    if not held[0] or not held[1]:
        return ToxicityModel(learned, content, (0.0, 1.0), (0.0, 0.0))
    return ToxicityModel(learned, content, *_isotonic(np.array(held[0] + held[1]), np.repeat([1, 0], [len(held[0]), len(held[1])])))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = (2000, 5000), sample_chars: int = 32_000_000) -> ToxicityModel:
    """Fit on at most ``sample`` toxic and ordinary documents (the ids with the lowest hashes) and ``sample_chars`` characters of each kind.

    Rows of :func:`held_out`, without a label or without an id teach nothing.  Equal texts count once.  With no toxic (or no ordinary) text the
    model scores zero everywhere.  One task fits on the sample; the driver gets the model only.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: tuple[list[str], list[str]] = ([], [])
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kinds[toxic != 1].append(text)
        m = fit(*kinds)
        types = {"toxic": pa.binary(), "ordinary": pa.binary(), "evidence": pa.list_(pa.float64()), "probability": pa.list_(pa.float64())}
        yield pa.RecordBatch.from_arrays([pa.array([getattr(m, n)], k) for n, k in types.items()], list(types))

    order = F.xxhash64(F.col(id_col).cast("string"))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    parts = [known.where(F.col("_toxic") == toxic).orderBy(order, id_col).limit(n) for toxic, n in ((1, sample[0]), (0, sample[1]))]
    chosen = parts[0].union(parts[1])
    texts = docs.select(F.col(id_col), text_of(text_col).alias("_text")).join(F.broadcast(chosen), id_col)  # 7,000 ids at most by default
    once = texts.groupBy("_toxic", "_text").agg(F.min(order).alias("_order"))
    running = F.sum(F.length("_text")).over(Window.partitionBy("_toxic").orderBy("_order", "_text").rowsBetween(Window.unboundedPreceding, 0))
    rows = once.withColumn("_sum", running).where(F.col("_sum") <= sample_chars).repartition(1).sortWithinPartitions("_order", "_text").select(F.col("_toxic").cast("int"), "_text")
    found = rows.mapInArrow(learn, "toxic binary, ordinary binary, evidence array<double>, probability array<double>").collect()
    if not found:  # no rows may be no task
        return fit([], [])
    return ToxicityModel(bytes(found[0]["toxic"]), bytes(found[0]["ordinary"]), tuple(found[0]["evidence"]), tuple(found[0]["probability"]))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` (default: all columns) and ``toxicity`` (0 to 1) of every whole text; null and empty texts have the score of no evidence."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "toxicity"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = model.scorer()
        scores = [scorer.score(t) for t in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], [*keep, "toxicity"])

    fields = ", ".join([*(f"`{c}` {kind(docs, c)}" for c in keep), "toxicity double"])
    return map_batches(docs.select(*keep, text_of(text_col).alias("_text")), run, fields)
