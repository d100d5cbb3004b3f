"""SimHash near-duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from barflow.llm import simhash
from barflow.llm.components import components


def brute_fingerprint(text, width=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def noisy(rng, bases, n, most):
    out = []
    for _ in range(n):
        v = rng.choice(bases)
        for b in rng.sample(range(64), rng.randint(0, most)):
            v ^= 1 << b
        out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("threshold,blocks", [(4, 3), (3, 2), (5, 4)])
def test_linked_fingerprints_meet_at_a_home(threshold, blocks):
    rng = np.random.default_rng(threshold)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, threshold + 1), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    met = np.zeros(len(x), bool)
    for code in simhash.block_codes(threshold, blocks):
        row, anchor, home = code.anchors(x)
        homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
        assert len(homes) == len(x)
        seen = set(zip(*(v.tolist() for v in code.anchors(y)[:2]), strict=True))
        met |= np.array([(i, homes[i]) in seen for i in range(len(x))])
    assert met.all()


@pytest.mark.parametrize("crowd", [4096, 3])
def test_links_connect_what_brute_force_connects(spark, crowd):
    rng = random.Random(crowd)
    fps = noisy(rng, [rng.getrandbits(64) for _ in range(4)], 120, 7)
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in fps], "fp long")
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, crowd=crowd).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    want = brute_classes(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    pairs = {frozenset(p) for p in found}
    got = brute_classes(len(fps), lambda i, j: frozenset((fps[i], fps[j])) in pairs)
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_near_duplicates_of_odd_rows(odd):
    rows = odd.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    classes = brute_classes(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {}
    for r, c in zip(rows, classes, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f, least[c]) for r, f, c in zip(rows, fps, classes, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == want


def test_empty_tables(make):
    empty = make([])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    have = {frozenset(e) for e in edges}
    classes = brute_classes(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in have)
    least = {}
    for x, c in zip(nodes, classes, strict=True):
        least[c] = min(least.get(c, x), x)
    assert {x: got.get(x, x) for x in nodes} == {x: least[c] for x, c in zip(nodes, classes, strict=True)}


def test_one_of_each_similar_group_stays(make):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for i in rng.sample(range(300), 4):
                copy[i] = word()
            texts.append(" ".join(copy))
        far = list(base)
        for i in rng.sample(range(300), 60):
            far[i] = word()
        texts.append(" ".join(far))
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(texts[:10]))]
    linked = lambda i, j: simhash.similarity(rows[i][1], rows[j][1], 5) >= 0.8
    classes = brute_classes(len(rows), linked)
    want = sorted(min(i for (i, _), c in zip(rows, classes, strict=True) if c == k) for k in set(classes))
    got = sorted(r["doc_id"] for r in simhash.keep_one(make(rows + [rows[0]])).collect())
    assert got == want
