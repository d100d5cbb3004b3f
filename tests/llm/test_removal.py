"""Repeated bytes and repeated word windows against brute force."""

import random
from collections import Counter

import pytest

from barflow.llm.anchors import Runs, text_key
from barflow.llm.common import discard, settle
from barflow.llm.substring import remove_repeats
from barflow.llm.suffix_levels import SuffixFamily, remove_bytes


def spans_of(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append(spans)
    return out


def passages(seed, alphabet, n=40):
    """Texts that share passages, with changes inside and around them."""
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [make(rng.randint(5, 90)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared) if rng.random() < 0.6 else make(rng.randint(0, 40))
            if p and rng.random() < 0.4:
                i = rng.randrange(len(p))
                p = p[:i] + rng.choice(alphabet) + p[i + 1 :]
            parts.append(p)
        out.append("".join(parts))
    return out


def check_bytes(make, texts, batches, length=30, gram=8):
    got = {r["doc_id"]: r for r in remove_bytes(make(list(enumerate(texts))), length, gram, batches).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (b, spans) in enumerate(zip(raw, spans_of(raw, length), strict=True)):
        assert [[s["lo"], s["hi"]] for s in got[i]["spans"]] == spans, (i, b)
        left, at = b"", 0
        for lo, hi in spans:
            left, at = left + b[at:lo], hi
        assert bytes(got[i]["kept"]) == left + b[at:] and got[i]["n_bytes"] == len(b)


@pytest.mark.parametrize("seed,alphabet,batches", [(1, "abcdefghijklmnop ", 1), (2, "ab", 3), (3, "aé\x00", 2), (4, "a", 2), (5, "abcdefghij\n", 5)])
def test_bytes_against_brute_force(make, seed, alphabet, batches):
    check_bytes(make, passages(seed, alphabet), batches)


def test_bytes_of_odd_rows(odd):
    rows = odd.collect()
    raw = [(r["text"] or "").encode() for r in rows]
    want = sorted(((r["doc_id"], len(b), sum(hi - lo for lo, hi in s)) for r, b, s in zip(rows, raw, spans_of(raw, 200), strict=True)), key=str)
    got = sorted(((r["doc_id"], r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"])) for r in remove_bytes(odd, keep=["doc_id"]).collect()), key=str)
    assert got == want


def test_levels_merge_geometrically(spark, make):
    family = SuffixFamily(spark, Runs(30, 8, False))
    sizes = []
    for i in range(5):
        family.add(make(list(enumerate(passages(i, "abcdef", 6)))))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]]


def test_registered_uses_merge_levels(spark, make, monkeypatch):
    """The pipeline's stage and op4 add so many batches that levels are merged, with the spans of brute force."""
    import corpus_pipeline
    from barflow.llm import suffix_levels

    sizes, add = [], SuffixFamily.add
    monkeypatch.setattr(SuffixFamily, "add", lambda self, *a: add(self, *a) or sizes.append([n for n, _ in self.levels]))
    merged = []
    monkeypatch.setattr(suffix_levels, "settle", lambda df, name: merged.append(name == "level") or settle(df, name))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [" ".join(word() for _ in range(45)) for _ in range(6)]
    texts = [" ".join([word(), shared[i % 7] if i % 7 < 6 else word(), word()]) for i in range(40)]
    docs = make(list(enumerate(texts))).selectExpr("doc_id", "text", "'en' lang", "'web' source", "cast(length(text) as bigint) n_chars")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    assert sizes[-1] == [2, 1] and sum(merged) == 1
    for i, spans in enumerate(spans_of([t.encode() for t in texts], 200)):
        assert got[i] == "".join(c for k, c in enumerate(texts[i]) if not any(lo <= k < hi for lo, hi in spans))


def test_tables_of_merged_levels_are_deleted(spark, make, tmp_path):
    """Scratch tables only, never a given one."""
    given = spark.read.parquet(make([(1, "a")]).write.parquet(f"{tmp_path}/given") or f"{tmp_path}/given")
    mine = settle(given, "mine")
    discard(mine.union(given))
    assert given.count() == 1
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        mine.count()


@pytest.mark.parametrize("seed,words", [(1, 4), (2, 60), (3, 1)])
def test_words_against_brute_force(make, seed, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(words)]
    texts = [" \n".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(20)]
    texts += [" ".join(t.split()[3:]) + " tail" for t in texts[:8]]
    split = [tuple(t.split()) for t in texts]
    got = {r["doc_id"]: r for r in remove_repeats(make(list(enumerate(texts))), 6, 3).collect()}
    for i, (w, spans) in enumerate(zip(split, spans_of(split, 6), strict=True)):
        assert [[s["lo"], s["hi"]] for s in got[i]["spans"]] == spans
        kept = [x for k, x in enumerate(w) if not any(lo <= k < hi for lo, hi in spans)]
        assert got[i]["kept"] == " ".join(kept) and got[i]["n_words"] == len(w)


def test_words_of_odd_rows(odd):
    rows = odd.collect()
    split = [tuple((r["text"] or "").encode().split()) for r in rows]
    want = sorted(((r["doc_id"], len(w), sum(hi - lo for lo, hi in s)) for r, w, s in zip(rows, split, spans_of(split, 35), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(odd).collect()), key=str) == want


def largest_read(spark, run):
    """Most shuffled rows that one task reads while ``run`` runs, when Spark may split what is crowded."""
    split = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    split |= {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    was = {k: spark.conf.get(k, None) for k in split}
    sc = spark.sparkContext
    store, bus = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(30_000)
        all_of = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {all_of.apply(i).stageId(): all_of.apply(i).attemptId() for i in range(all_of.size())}

    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        before = stages()
        run()
        most = 0
        for k, attempt in stages().items():
            if k not in before:
                tasks = store.taskList(k, attempt, 10_000)
                found = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
                most = max([most, *(m.get().shuffleReadMetrics().recordsRead() for m in found if m.isDefined())])
        return most
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("remove", ["bytes", "words"])
def test_no_task_holds_all_texts_with_a_common_line(spark, make, remove):
    rng = random.Random(9)
    n, word = 4000, lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(14)]
    texts = [" ".join([*(word() for _ in range(40)), *line, *(word() for _ in range(40))]) for _ in range(n)]
    docs = make(list(enumerate(texts))).repartition(40).cache()
    docs.count()
    found = []

    def run():
        if remove == "bytes":
            family = SuffixFamily(spark, together=100)
            family.add(docs)
            found.extend(family.spans(docs).collect())
        else:
            found.extend(r for r in remove_repeats(docs).collect() if r["spans"])

    assert largest_read(spark, run) < n // 2
    docs.unpersist()
    assert not found  # the line is shorter than a run


def text_key_of(docs, i, seen={}):  # noqa: B006
    if not seen:
        seen.update({r["doc_id"]: r["tk"] for r in docs.select("doc_id", text_key().alias("tk")).collect()})
    return seen[i]


def test_runs_over_both_edges_of_a_shared_passage(make):
    rng = random.Random(10)
    some = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, texts = some(75), []
    for _ in range(60):
        a, b = rng.randint(0, 40), rng.randint(35, 75)
        texts.append(some(rng.randint(0, 50)) + passage[a:b] + some(rng.randint(0, 50)))
    docs, raw = make(list(enumerate(texts))), [t.encode() for t in texts]
    for length, gram in ((31, 8), (30, 29), (20, 20)):
        want = {(text_key_of(docs, i), at) for i, spans in enumerate(spans_of(raw, length)) for lo, hi in spans for at in range(lo, hi)}
        for together in (0, 5):
            family = SuffixFamily(docs.sparkSession, Runs(length, gram, False), together=together)
            family.add(docs.where("doc_id < 25"))
            family.add(docs.where("doc_id >= 25"))
            assert {(r["tk"], at) for r in family.spans(docs).collect() for at in range(r["lo"], r["hi"])} == want


def test_empty_tables(make):
    assert remove_bytes(make([])).count() == 0
    assert remove_repeats(make([])).count() == 0


def test_words_shuffle_the_texts_once(spark, make):
    """The windows' texts and the rows to be cut come from one exchange."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        texts = [" ".join(f"w{(i * j) % 13}" for j in range(90)) for i in range(20)]
        plan = remove_repeats(make(list(enumerate(texts))))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum("Exchange hashpartitioning(tk" in x and "Reused" not in x for x in _exchanges_of_texts(plan)) == 1


def _exchanges_of_texts(plan):
    """Exchanges whose child computes the text's key."""
    lines = plan.split("\n")
    return [a for i, a in enumerate(lines) if "Exchange hashpartitioning(tk" in a and any("xxhash64(coalesce(" in b for b in lines[i + 1 : i + 6])]
