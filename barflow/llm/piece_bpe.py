"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model asks (a leading word mark, blanks turned into word marks), cut into chunks that no
merge can cross, and every chunk is merged by a score-ordered agenda: adjacent symbol pairs that form a piece wait in
it, the best score (leftmost on ties) is merged first, and its new neighbours join the agenda.  Characters outside the
vocabulary fall back to byte pieces.

The agendas of all new chunks of a batch are worked together: those of chunks with equally many symbols are the rows of one array of
ranks, of which each step takes the least of every row.  A merge leaves one symbol less, so the rows then join the chunks of
the next length.  A long chunk, for which that would be a step for each of its symbols, has a heap of its own.

Every distinct chunk that a worker meets is also encoded and decoded by the sentencepiece library, in one call for each
Arrow batch; a difference fails the job.  As chunks are independent, this checks every whole text.
"""

from __future__ import annotations

import codecs
import heapq
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import kind, map_batches, text_of

MARK = "▁"
# Chunks whose encodings a worker remembers (about 250 bytes each), and the longest it remembers.
REMEMBERED = 700_000
LONGEST_REMEMBERED = 64
# Symbols up to which agendas are worked together.
TOGETHER = 48
_NEVER = np.iinfo(np.int32).max

_MODELS: dict[str, PieceModel] = {}


def _one_mark_per_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_mark_per_byte", _one_mark_per_byte)


class PairTable:
    """Symbols are the characters that pieces hold, and the longer pieces; the table has every parting of a piece into two symbols, by left * symbols + right."""

    def __init__(self, ids: dict[str, int], rank: dict[str, int]):
        symbols = [*sorted({c for p in ids for c in p}), *(p for p in ids if len(p) > 1)]
        number = {p: k for k, p in enumerate(symbols)}
        self.id_of = np.array([ids.get(p, -1) for p in symbols], np.int32)
        self.char_of = np.full(0x110000, -1, np.int32)
        for c in symbols:
            if len(c) == 1:
                self.char_of[ord(c)] = number[c]
        pairs = sorted(
            (number[p[:k]] * len(symbols) + number[p[k:]], rank[p], number[p]) for p in rank for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        )
        self.pair_key, pair_rank, pair_symbol = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(0, np.int64)] * 3
        self.pair_rank, self.pair_symbol = np.append(pair_rank, _NEVER).astype(np.int32), np.append(pair_symbol, -1).astype(np.int32)
        self.pair_key = np.append(self.pair_key, np.iinfo(np.int64).max)

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair of symbols in the pair table; the last place if it forms no piece."""
        n, none = len(self.id_of), len(self.pair_key) - 1
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * n + right, -1)
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, at, none)


class PieceModel:
    """Vocabulary tables of one model file, read once in each worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = [not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)) for i in range(len(pieces))]
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        scores = sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True)
        order = {score: r for r, score in enumerate(scores)}
        self.rank = {p: order[lib.get_score(i)] for p, i in self.ids.items()}
        self.control = {i for i in range(len(pieces)) if lib.is_control(i)}
        self.marked = {i for p, i in self.ids.items() if p[0] == MARK}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        self.raw = [p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        for value, i in self.byte_id.items():
            self.raw[i] = bytes([value])
        self.raw[lib.unk_id()] = " ⁇ ".encode()
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary has pieces that span words; chunks would not be independent")
        self.lines = not any("\n" in p for p in self.ids)  # line feeds part chunks too, unless a piece holds one
        self.chunks = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if self.lines else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.feed = lib.encode("\n")
        self.known: dict[str, bytes] = {}

    @cached_property
    def table(self) -> PairTable:
        """Pairs of symbols by rank, made when first asked for."""
        return PairTable(self.ids, self.rank)

    def merge_together(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of many chunks, as little-endian 32-bit numbers."""
        table = self.table
        out: list[bytes] = [b""] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            out[i] = np.array(self.merge(chunks[i]), "<i4").tobytes()
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum(sizes) - sizes
        names = table.char_of[points]
        apart = np.zeros(len(chunks), bool)  # chunks with a character that is not a piece: their bytes take its place
        apart[np.repeat(np.arange(len(chunks)), sizes)[np.append(table.id_of, -1)[names] < 0]] = True
        for i in np.flatnonzero(apart & (sizes <= TOGETHER)).tolist():
            out[i] = np.array(self.merge(chunks[i]), "<i4").tobytes()
        open_ = ~apart & (sizes <= TOGETHER)
        rows, held, ranks, places = np.zeros(0, np.int64), None, None, None
        for n in range(int(sizes[open_].max(initial=0)), 0, -1):
            mine = np.flatnonzero(open_ & (sizes == n))
            fresh = names[first[mine, None] + np.arange(n)]
            fresh_places = table.places(fresh[:, :-1], fresh[:, 1:])
            rows, held, places = (np.r_[rows, mine], np.r_[held, fresh], np.r_[places, fresh_places]) if len(rows) else (mine, fresh, fresh_places)
            if not len(rows):
                continue
            ranks = table.pair_rank[places]
            k = ranks.argmin(axis=1) if n > 1 else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            best = ranks[line, k] if n > 1 else np.full(len(rows), _NEVER)
            done = best == _NEVER
            if done.any():
                raw, step = np.ascontiguousarray(table.id_of[held[done]], "<i4").tobytes(), 4 * n
                for j, i in enumerate(rows[done].tolist()):
                    out[i] = raw[j * step : (j + 1) * step]
                rows, held, places, k = rows[~done], held[~done], places[~done], k[~done]
                line = np.arange(len(rows))
            if len(rows):
                held[line, k] = table.pair_symbol[places[line, k]]
                stay = np.ones(held.shape, bool)
                stay[line, k + 1] = False
                held = held[stay].reshape(len(rows), n - 1)
                stay = np.ones(places.shape, bool)
                stay[line, k] = False
                places = places[stay].reshape(len(rows), n - 2)
                inner = k > 0
                at, to = line[inner], k[inner]
                places[at, to - 1] = table.places(held[at, to - 1], held[at, to])
                inner = k < n - 2
                at, to = line[inner], k[inner]
                places[at, to] = table.places(held[at, to], held[at, to + 1])
        return out

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk by the agenda: numbers (rank of the score, then place), smallest first."""
        rank, symbols, n = self.rank, list(chunk), len(chunk)
        agenda = [r * n + i for i, r in enumerate(map(rank.get, map(str.__add__, symbols, symbols[1:]))) if r is not None]
        if agenda:
            heapq.heapify(agenda)
            pop, push, left, right = heapq.heappop, heapq.heappush, list(range(-1, n - 1)), list(range(1, n + 1))
            while agenda:
                r, i = divmod(pop(agenda), n)
                j = right[i]
                if j >= n or not symbols[i]:
                    continue
                pair = symbols[i] + symbols[j]
                if rank.get(pair) != r:
                    continue  # one of the two has been merged since
                symbols[i], symbols[j] = pair, ""
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    r = rank.get(pair + symbols[k])
                    if r is not None:
                        push(agenda, r * n + i)
                h = left[i]
                if h >= 0:
                    r = rank.get(symbols[h] + pair)
                    if r is not None:
                        push(agenda, r * n + h)
        ids, out = self.ids, []
        for s in symbols:
            if s:
                found = ids.get(s)
                if found is None:
                    out += [self.byte_id[b] for b in s.encode()]
                else:
                    out.append(found)
        return out

    def decode(self, ids) -> str:
        """Text of a sequence of ids: the blank of a leading word mark goes, bytes that form no character become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "one_mark_per_byte")
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first in self.marked else text

    def decode_rows(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """Texts of the sequences of ids that lie between consecutive ``cuts``."""
        ids = ids[cuts[0] : cuts[-1]].astype(np.int64)
        cuts = cuts - cuts[0]
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.raw):
            raise IndexError("an id is outside the vocabulary")
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        whole = self.raw_bytes[np.repeat(self.raw_first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.r_[0, ends][cuts].tolist()
        texts = []
        for first, last, lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), at, at[1:], strict=False):
            text = str(whole[lo:hi], "utf-8", "one_mark_per_byte")
            while first < last and ids[first] in self.control:
                first += 1
            texts.append(text[1:] if first < last and ids[first] in self.marked else text)
        return texts

    def code_new(self, words: list[str], check: bool) -> list[bytes]:
        """Ids of words as :meth:`cut` gives them, compared with the library's."""
        feed, lib = self.feed, self.library
        # What is merged: a word with a mark before it, or what follows a line feed.
        coded = self.merge_together([w[1:] if w[0] == "\n" else w if w[0] == MARK else MARK + w for w in words])
        line = np.array(feed[1:], "<i4").tobytes()
        coded = [line + ids if w[0] == "\n" else ids for w, ids in zip(words, coded, strict=True)]
        if check and words:
            # The library puts a mark before each text; before a line feed it stands alone.  Words that blanks part are coded as if alone, so
            # all of them are one text; chunks of several marks are texts of their own.
            head = np.array(feed[:1], "<i4").tobytes()
            plain = [(w, head + own if w[0] == "\n" else own) for w, own in zip(words, coded, strict=True) if w[0] != MARK]
            odd = [(w[1:], own) for w, own in zip(words, coded, strict=True) if w[0] == MARK and len(w) > 1]
            together = [(" ".join(w for w, _ in plain), b"".join(own for _, own in plain))] if plain else []
            for text, raw in [*together, *odd]:
                own = np.frombuffer(raw, "<i4").tolist()
                other = lib.encode(text, num_threads=1)
                if own != other:
                    wrong = [w for w, ids in plain if lib.encode(w) != np.frombuffer(ids, "<i4").tolist()][:3] or [text[:200]]
                    raise ValueError(f"encoding differs from the sentencepiece library for {wrong}")
                if self.decode_rows(np.frombuffer(raw, "<i4"), np.array([0, len(own)])) != [lib.decode(own)]:
                    raise ValueError(f"decoding differs from the sentencepiece library for {text[:200]!r}")
        return coded

    def cut(self, text: str) -> list[str]:
        """Words no merge can leave.  A word stands for itself with a mark before it, unless it begins with marks or a line feed."""
        if MARK not in text:
            words = text.replace("\n", " \n").split(" ") if self.lines else text.split(" ")
            if "" not in words:
                return words
        if not text:
            return []
        # runs of blanks: a chunk is the run and what follows it
        chunks = self.chunks.findall(MARK + text.replace(" ", MARK))
        out = []
        for c in chunks:
            if c[0] == MARK:
                out.append(c if c[1:2] in (MARK, "") or c[1:2] == "\n" else c[1:])
            elif out and out[-1] == "\n" and c != "\n":
                out[-1] = "\n" + c
            else:
                out.append(c)
        return out

    def encode_batch(self, texts: list[str], check: bool) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        cut = [self.cut(t) for t in texts]
        coded = [list(map(known.get, words)) for words in cut]
        new = list({w for words, codes in zip(cut, coded, strict=True) if None in codes for w, code in zip(words, codes, strict=True) if code is None})
        if new:
            fresh = dict(zip(new, self.code_new(new, check), strict=True))
            known.update((w, b) for w, b in fresh.items() if len(w) <= LONGEST_REMEMBERED)
            coded = [[fresh[w] if code is None else code for w, code in zip(words, codes, strict=True)] if None in codes else codes for words, codes in zip(cut, coded, strict=True)]
        return [b"".join(codes) for codes in coded]


def model_at(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """``id_col`` and ``ids`` array<int> of every whole text, one row for each input row.

    ``model_path`` is a file that every executor can read.  Null and empty texts have no ids; ids of rows may be null or
    repeated; other columns are not carried.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = model_at(model_path).encode_batch(batch.column(1).to_pylist(), check)
        offsets = np.zeros(len(coded) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(coded))])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [id_col, "ids"])

    return map_batches(docs.select(F.col(id_col), text_of(text_col).alias("text")), run, f"`{id_col}` {kind(docs, id_col)}, ids array<int>")


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` to rows with an array of ids (null: empty)."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields]
    place = coded.columns.index(ids_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = model_at(model_path)
        column = batch.column(place)
        if column.null_count:
            texts = [model.decode(ids or ()) for ids in column.to_pylist()]
        else:
            texts = model.decode_rows(column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return map_batches(coded, run, ", ".join([*fields, "decoded string"]))
