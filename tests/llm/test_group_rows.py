"""Rows made for large groups: near copies are told once, and votes for offsets are never rows."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from barflow.llm import chroma, simhash


@pytest.mark.parametrize("crowd", [4096, 100])
def test_a_group_of_near_copies_is_not_told_at_each_anchor(spark, monkeypatch, crowd):
    rng = np.random.default_rng(3)
    groups, size = 2, 400
    words = np.repeat(rng.integers(0, 2**63, (groups, 4), dtype=np.uint64), size, axis=0)
    for row in words:
        for bit in rng.choice(256, 8, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    words = np.concatenate([words, rng.integers(0, 2**63, (50, 4), dtype=np.uint64)])
    rows = spark.createDataFrame([tuple(map(int, r)) for r in words.view(np.int64)], "fp long, fp2 long, fp3 long, fp4 long")
    with monkeypatch.context() as patched:
        patched.setattr(DataFrame, "distinct", lambda self: self)  # so that rows are counted as they are made
        made = simhash.links(rows, **simhash.SIMILAR, crowd=crowd, stars=True).count()
    assert made <= 5 * len(words)
    at = {tuple(map(int, r[:2])): i for i, r in enumerate(words.view(np.int64))}
    root = list(range(len(words)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in simhash.links(rows, **simhash.SIMILAR, crowd=crowd, stars=True).collect():
        x, y = sorted((find(at[tuple(r["a"])]), find(at[tuple(r["b"])])))
        root[y] = x
    assert [find(i) for i in range(len(words))] == [*[0] * size, *[size] * size, *range(groups * size, len(words))]


def recordings(rng, n):
    """Random integers with a very common half, noisy and shifted copies."""
    out = []
    for i in range(n):
        x = rng.integers(0, 2**32, 30, dtype=np.uint64).astype(np.uint32)
        x[::7] = x[::7] & np.uint32(0xFFFF0000) | np.uint32(77)
        out.append((i, list(range(30)), x.view(np.int32).tolist()))
        if i % 5 == 0:
            flips = np.zeros(32 * 30, np.uint8)
            flips[rng.choice(len(flips), 90, replace=False)] = 1
            out.append((1000 + i, list(range(i % 4, 30 + i % 4)), (x ^ np.packbits(flips).view(np.uint32)).view(np.int32).tolist()))
    return out


def test_votes_for_offsets_are_not_joined_as_rows(spark, monkeypatch):
    df = spark.createDataFrame(recordings(np.random.default_rng(4), 60), "id long, frames array<int>, ints array<int>")
    wanted = df.where("id % 10 = 0").select("id")
    _, links = chroma.align(df, wanted, "id")
    assert "Join" not in links._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, links.collect()))
    assert len(want) >= 12 and {abs(q - f) for q, f, *_ in want} == {1000}
    # tiles, cells and portions of any size give the same
    for name, value in {"TILE": 100, "CELL": 170, "VOTES_AT_ONCE": 7}.items():
        monkeypatch.setattr(chroma, name, value)
    assert sorted(map(tuple, chroma.align(df, wanted, "id")[1].collect())) == want


def test_votes_by_brute_force(monkeypatch):
    prints = [{"frames": f, "ints": x} for _, f, x in recordings(np.random.default_rng(5), 20)]

    def halves(p, part):
        v = [x >> 16 * part & 0xFFFF for x in p["ints"]]
        return [(f, x) for i, (f, x) in enumerate(zip(p["frames"], v, strict=True)) if not i or v[i - 1] != x]

    want = {}
    for q in range(4):
        for f, other in enumerate(prints):
            for part in (0, 1):
                for at, x in halves(prints[q], part):
                    for to, y in halves(other, part):
                        if x == y:
                            want[f, q, to - at] = want.get((f, q, to - at), 0) + 1
    want = {(*k, n) for k, n in want.items() if n >= 2}
    for portion in (1, 50, 2**19):
        monkeypatch.setattr(chroma, "VOTES_AT_ONCE", portion)
        got = chroma.Tile(prints[:4]).votes(prints)
        assert {tuple(x) for x in zip(*(c.tolist() for c in got), strict=True)} == want
