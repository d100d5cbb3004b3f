"""What Python workers hold: they live through all stages, and several share an executor's memory."""

import gc

import pyarrow as pa

import corpus_pipeline
from barflow.llm import packing, pieces, toxicity, word_ids
from barflow.llm.common import map_batches
from barflow.llm.queries import SEQUENCE, op7, tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


class OneTask:
    """A frame whose mapInArrow runs as one task of this process."""

    def __init__(self, *texts):
        self.batches = [pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts]

    def mapInArrow(self, fn, schema):
        return list(fn(iter(self.batches)))


def held():
    gc.collect()
    return sum(isinstance(o, word_ids.WordCoder | toxicity.Scorer) for o in gc.get_objects())


def test_a_worker_forgets_what_another_stage_remembered():
    before, model = held(), toxicity.fit([], [])
    held_now = []

    def code(batch):
        word_ids.coder_at(PATH).encode_batch(batch.column(0).to_pylist())
        held_now.append(held())
        return batch

    def score(batch):
        model.scorer().score(batch.column(0)[0].as_py())
        held_now.append(held())
        return batch

    first = map_batches(OneTask("a b", "c"), code, "text string") and word_ids.coder_at(PATH)
    map_batches(OneTask(), lambda batch: batch, "text string")  # no rows
    map_batches(OneTask("d"), code, "text string")
    assert word_ids.coder_at(PATH) is first and {b"a", b"b"} <= {w.encode() for w in first.known}
    del first
    map_batches(OneTask("e"), score, "text string")
    map_batches(OneTask("f"), code, "text string")
    map_batches(OneTask("g"), lambda batch: held_now.append(held()) or batch, "text string")
    assert max(held_now) <= max(1, before)  # one memory at a time
    assert held() == 0


def test_a_long_text_is_many_calls_of_the_library(monkeypatch):
    coder, sizes, real = word_ids.WordCoder(PATH), [], word_ids.WordCoder.code_new
    monkeypatch.setattr(word_ids.WordCoder, "code_new", lambda self, words: sizes.append(len(words)) or real(self, words))
    text = " ".join(f"w{i}x" for i in range(5000))
    assert coder.encode_batch([text, "w1x", ""])[0] == b"".join(i.to_bytes(4, "little") for i in coder.library.encode(text, add_special_tokens=False).ids)
    assert sum(sizes) == 5000 and max(sizes) <= 1024


def test_words_are_coded_and_pieces_numbered_in_tasks_of_their_own(spark, monkeypatch, make, tmp_path):
    docs, seen, real = make([(i, "word " * i) for i in range(60)]), [], packing.pack

    def pack(cut, capacity):
        seen.append(cut._jdf.queryExecution().optimizedPlan().toString())
        return real(cut, capacity)

    monkeypatch.setattr(packing, "pack", pack)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [sorted(tuple(r)[:5] for r in df.collect()) for df in (op7(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path)))]
    assert rows == [sorted(map(tuple, pieces.cut_documents(docs, PATH, SEQUENCE).collect()))] * 2
    assert len(seen) == 2 and not any("MapInArrow" in plan for plan in seen)
