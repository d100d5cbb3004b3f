"""Quality rules, toxicity, SentencePiece coding and packing."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barflow.llm import packing, piece_bpe, pieces, quality, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))  # noqa: B905
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_rows(odd):
    empty = quality.DecisionList()
    got = quality.judge(odd, empty)
    assert {"tk", "spans", "kept"} <= set(got.columns)
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    for (_, text), r in by.items():
        want = brute_counts(text)
        assert tuple(r[c] for c in quality.BASE) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_counts_of_random_texts(make):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b ", "c\n", "#", " ", "é", "\x0b", "a b a\n"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    got = {r["doc_id"]: tuple(r[c] for c in quality.BASE) for r in quality.with_statistics(make(list(enumerate(texts)))).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_list_learns_a_conjunction():
    rng = np.random.default_rng(1)
    a, b, noise = (rng.random(3000) for _ in range(3))
    bad = ((a > 0.6) & (b < 0.5)) | (noise > 0.95)
    rules = quality.learn_list({"words": a, "word_length": b, "distinct_words": noise}, bad)
    hit = np.zeros(3000, bool)
    for rule in rules.rules:
        each = np.ones(3000, bool)
        for test in rule:
            each &= test.holds({"words": a, "word_length": b, "distinct_words": noise})
        hit |= each
    assert (hit == bad).mean() > 0.98 and "reject if" in str(rules)


def test_list_without_labels_keeps_all(spark, make):
    docs = make([(i, " ".join(f"w{j}" for j in range(60 + i))) for i in range(5)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rules = quality.fit_list(docs, none)
    assert rules.rules == [] and quality.judge(docs, rules).where("kept").count() == 5
    assert quality.judge(make([]), rules).count() == 0


def toxic_corpus(n=900):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "the", "ou", "re", "st", "ing", "le"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "schufty", "zwerglo"]) + rng.choice(["", "ing", "s", "!!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, make, odd):
    rows, labels = toxic_corpus()
    docs, table = make(rows, True), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_documents(docs, table)
    got = {r["doc_id"]: (r["toxicity"], r["h"]) for r in toxicity.score(docs, model, ["doc_id"]).withColumn("h", toxicity.held_out()).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, (_, h) in got.items())
    held = [(got[i][0] >= 0.7, bool(y)) for i, y in labels if got[i][1]]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    # labels of held-out rows change nothing
    flipped = [(i, 1 - y if got[i][1] else y) for i, y in labels] + [(None, 1), (10**6, None)]
    assert toxicity.fit_documents(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")) == model
    scores = [r["toxicity"] for r in toxicity.score(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s < 0.7 for s in scores)
    assert toxicity.score(make([]), model).count() == 0


def test_toxicity_without_labels(spark, make):
    model = toxicity.fit_documents(make([(1, "a b")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["toxicity"] for r in toxicity.score(make([(1, "a b"), (2, None)]), model).collect()] == [0.0, 0.0]


MODEL = tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(make, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n▁éx日😀<0x41>\x00s") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for docs in (make(list(enumerate(texts))), odd):
        rows = docs.select("doc_id", "text").collect()
        want = sorted(((r["doc_id"], library.encode(r["text"] or "")) for r in rows), key=str)
        coded = piece_bpe.decode(piece_bpe.encode(docs, MODEL), MODEL).collect()
        assert sorted(((r["doc_id"], list(r["ids"])) for r in coded), key=str) == want
        assert all(r["decoded"] == library.decode(list(r["ids"])) for r in coded)
    assert piece_bpe.encode(make([]), MODEL).count() == 0


def test_agendas_worked_together_equal_single_heaps():
    model, rng = piece_bpe.model_at(MODEL), random.Random(11)
    chunks = ["".join(rng.choice("aeiostnr\u2581é漢😀\x00Z'") for _ in range(rng.randint(0, 2 * piece_bpe.TOGETHER))) for _ in range(600)]
    assert model.merge_together(chunks) == [np.array(model.merge(c), "<i4").tobytes() for c in chunks]
    assert model.merge_together([]) == []


def test_rows_are_decoded_like_single_sequences():
    model, rng = piece_bpe.model_at(MODEL), random.Random(5)
    rows = [[rng.randrange(32_000 if rng.random() < 0.5 else 260) for _ in range(rng.randint(0, 9))] for _ in range(500)]
    cuts = np.cumsum([0, *map(len, rows)])
    texts = model.decode_rows(np.array([i for r in rows for i in r]), cuts)
    assert texts == [model.library.decode(r) for r in rows] == [model.decode(r) for r in rows]
    assert model.decode_rows(np.array([i for r in rows for i in r]), cuts[100:]) == texts[100:]
    with pytest.raises(IndexError):
        model.decode_rows(np.array([5, -1]), np.array([0, 2]))


def test_any_ids_decode_like_the_library():
    model, rng = piece_bpe.model_at(MODEL), random.Random(7)
    for _ in range(3000):
        ids = [rng.randint(3, 31999) if rng.random() < 0.5 else rng.randint(3, 300) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == model.library.decode(ids)


def test_a_difference_from_the_library_fails():
    model = piece_bpe.PieceModel(MODEL)
    model.rank = {}
    with pytest.raises(ValueError, match="differs"):
        model.encode_batch(["international relations"], True)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + items[i] <= capacity:
                at = bins.index(room)
                bins[at] += items[i]
                place(i + 1, bins)
                bins[at] -= items[i]
        bins.append(items[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(250):
        capacity = rng.choice([10, 17, 30, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        fixed, left = packing.reduce_dominated(dict(Counter(items)), capacity)
        rest = [w for w, n in left.items() for _ in range(n)]
        best = fewest(items, capacity)
        assert sum(n for _, n in fixed) + (fewest(rest, capacity) if rest else 0) == best >= packing.lower_bound(Counter(items), capacity)


@pytest.mark.parametrize("lengths", [[], [5] * 40, [16] * 3, "random"])
def test_packing_is_whole_and_gapless(spark, lengths):
    rng = random.Random(9)
    lengths = [rng.randint(1, 16) for _ in range(500)] if lengths == "random" else lengths
    rows = [(i % 7, n, "x") for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, offset string").repartition(5), 16).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter((i, n) for i, n, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    assert len(by) <= packing.lower_bound(Counter(lengths), 16) + 2


def test_packing_rejects_bad_lengths(spark):
    with pytest.raises(Exception, match="outside"):
        packing.pack(spark.createDataFrame([(1, 17)], "doc_id long, length long"), 16).collect()


def test_pieces_of_documents(odd):
    import tokenizers as library

    path = tokenizers.path("word_bpe_49k.json")
    coder, want = library.Tokenizer.from_file(path), []
    for r in odd.collect():
        ids = [*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k, 4096 * k, len(ids[4096 * k : 4096 * (k + 1)]), zlib.crc32(np.array(ids[4096 * k : 4096 * (k + 1)], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))]
    got = pieces.cut_documents(odd, path).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_toxicity_is_not_fitted_on_the_driver(spark, make, monkeypatch):
    texts = [(i, f"plain words about {i % 7} things and {i} more" + (f" vile{i % 3} scum" if i % 2 else "")) for i in range(400)]
    docs, labels = make(texts), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    used = sorted((i, t) for i, t in texts if (zlib.crc32(str(i).encode()) % 3) != 1)
    order = {r["doc_id"]: r["o"] for r in docs.selectExpr("doc_id", "xxhash64(cast(doc_id as string)) as o").collect()}
    used.sort(key=lambda x: order[x[0]])
    want = toxicity.fit([t for i, t in used if i % 2], [t for i, t in used if not i % 2])
    driver, real = os.getpid(), toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *kinds: real(*kinds) if os.getpid() != driver else pytest.fail("fitted on the driver"))
    assert toxicity.fit_documents(docs, labels) == want
