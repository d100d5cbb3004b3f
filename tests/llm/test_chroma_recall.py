"""Links of noisy copies against all offsets by brute force."""

import numpy as np
import pytest

from barflow.llm import chroma

FRAMES, N = 44, 20


@pytest.mark.parametrize("share", [0.05, 0.10, 0.145])
def test_recall_at_independent_bit_errors(spark, share):
    rng = np.random.default_rng(int(share * 1000))
    originals = rng.integers(0, 2**32, (N, FRAMES), dtype=np.uint64).astype(np.uint32)
    prints, tracks = [], {}
    for i, x in enumerate(originals):
        flips = np.zeros(32 * FRAMES, np.uint8)
        flips[rng.choice(len(flips), int(share * len(flips)), replace=False)] = 1
        tracks[i] = (np.arange(FRAMES), x)
        tracks[100 + i] = (np.arange(FRAMES) + i % 7, x ^ np.packbits(flips).view(np.uint32))
    prints = [(k, a.tolist(), b.view(np.int32).tolist()) for k, (a, b) in tracks.items()]
    df = spark.createDataFrame(prints, "id long, frames array<int>, ints array<int>")
    _, links = chroma.align(df, df.where(f"id < {N}").select("id"), "id")
    got = {(r["query"], r["found"]): (r["offset"], round(r["errors"], 9)) for r in links.collect()}
    want = {}
    for q in range(N):
        for f, (to, other) in tracks.items():
            if f != q:
                tried = []
                for offset in range(-FRAMES, FRAMES + 7):
                    _, a, b = np.intersect1d(tracks[q][0] + offset, to, return_indices=True)
                    if len(a) >= 12:
                        tried.append((int(np.bitwise_count(tracks[q][1][a] ^ other[b]).sum()) / (32 * len(a)), abs(offset), offset))
                if tried and min(tried)[0] <= 0.15:
                    want[q, f] = (min(tried)[2], round(min(tried)[0], 9))
    assert len(want) == N and got == want
