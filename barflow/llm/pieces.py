"""Documents as pieces of at most ``capacity`` tokens, ready for packing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import kind, map_batches, settle, text_of
from barflow.llm.word_ids import coder_at


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text: ``id_col, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A document is its ids and one ``end_id``; null and empty texts are that id alone.  Documents longer than ``capacity`` are cut every
    ``capacity`` tokens.  Repeated rows give repeated pieces; other columns are not carried.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, piece, size, crc, ids = [], [], [], [], []
        for i, coded in enumerate(coder_at(tokenizer_path).encode_batch(batch.column(1).to_pylist())):
            whole = coded + end
            for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                part = whole[at : at + 4 * capacity]
                rows.append(i)
                piece.append(k)
                size.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
        piece = np.array(piece, np.int32)
        columns = [batch.column(0).take(pa.array(rows)), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names)

    ids = ", ids array<int>" if with_ids else ""
    return map_batches(docs.select(F.col(id_col), text_of(text_col).alias("text")), run, f"`{id_col}` {kind(docs, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint{ids}")


def settled(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, **options) -> DataFrame:
    """:func:`cut_documents` as a written table: a step that numbers the pieces in Python then shares no task with it, so a core has one worker and not two."""
    return settle(cut_documents(docs, tokenizer_path, capacity, **options), "cut")
