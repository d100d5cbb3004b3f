"""Substring removal: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

A window whose word sequence starts anywhere else is removed.  Windows around an anchor gram that occurs once cannot repeat (see
:mod:`barflow.llm.anchors`), and those inside a context that repeats as a whole do; both are settled by counting grams and contexts.
Every other window gets its Rabin-Karp hash (96 bits) and is counted by a grouped aggregate; repeated ones merge into maximal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.anchors import Rolling, Runs, at_rows, mix, own_spans, repeated, scan, whole_spans, with_spans
from barflow.llm.common import kind, map_batches


def _windows(around: DataFrame, runs: Runs) -> DataFrame:
    """``h1, h2, tk, tl, lo`` of every window that runs through an unsettled anchor of its text; copies of a text that meet in a slice of a task are hashed once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.take(pa.array(np.unique(batch.column(0).to_numpy(), return_index=True)[1]))
        tks, h1, h2, sizes, tls, los = [], [], [], [], [], []
        for tk, text, places in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            values, _ = runs.tokens([text.encode()])
            pos = np.array([p["pos"] for p in places if p["tl"] == len(values)], np.int64)
            lo = np.unique((pos[:, None] - np.arange(runs.length - runs.gram + 1)).ravel())
            lo = lo[(lo >= 0) & (lo <= len(values) - runs.length)]
            if len(lo):
                h1.append(mix(Rolling(values)(lo, lo + runs.length)).view(np.int64))
                h2.append(mix(Rolling(mix(values + np.uint64(1)))(lo, lo + runs.length)).astype(np.uint32).view(np.int32))
                los.append(lo.astype(np.int32))
                tks.append(tk)
                sizes.append(len(lo))
                tls.append(len(values))
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h1, np.int64), (h2, np.int32), (los, np.int32))]
        columns = [joined[0], joined[1], np.repeat(np.array(tks, np.int64), sizes), np.repeat(np.array(tls, np.int32), sizes), joined[2]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h1", "h2", "tk", "tl", "lo"])

    return map_batches(around, run, "h1 bigint, h2 int, tk bigint, tl int, lo int")


def repeated_spans(docs: DataFrame, window: int = 35, gram: int = 12, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``tk, tl, lo, hi``: word spans of each text that are covered by repeated windows (not merged).  ``keep``: columns that go with the texts (see ``at_rows``)."""
    runs = Runs(window, gram, True)
    _, found = scan(runs.occurrences(docs, text_col), level=False)
    windows = _windows(at_rows(found.where("kind = 2").select("tk", "tl", "pos"), docs, keep or [], text_col), runs)
    return whole_spans(found, runs).union(repeated(windows, runs))


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_removed, spans, kept`` for every row: word spans removed and the kept words joined by one space.

    Words are runs of anything but ASCII white space.  Windows are judged on the input.  A null or empty text has no words; ids
    may be null or repeat (a repeated row is a copy: its windows repeat); other columns are not carried.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, spans, kept = [], [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.encode().split()
            own = own_spans(found, len(words))
            n_words.append(len(words))
            n_removed.append(sum(hi - lo for lo, hi in own))
            spans.append([{"lo": lo, "hi": hi} for lo, hi in own])
            for lo, hi in reversed(own):
                del words[lo:hi]
            kept.append(b" ".join(words).decode())
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], [id_col, "n_words", "n_removed", "spans", "kept"])

    found = with_spans(docs, repeated_spans(docs, window, gram, text_col, [id_col]), [id_col], text_col)
    return map_batches(found, run, f"`{id_col}` {kind(docs, id_col)}, n_words bigint, n_removed bigint, spans array<struct<lo:int,hi:int>>, kept string")
