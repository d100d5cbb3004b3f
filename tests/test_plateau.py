"""Nearest trials against all pairs, and the growth of the pairs that are compared."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import plateau as P

SCHEMA = "study string, trial long, a double, b double, c string, v double"


def pairs(rows, numeric, k):
    """(trial) -> its k nearest other trials, by comparing all of them."""
    x = {}
    for c in numeric:
        v = rows[c].to_numpy()
        lo, hi = np.nanmin(v), np.nanmax(v)
        x[c] = np.where(np.isnan(v), 0.5, (v - lo) / (hi - lo if hi > lo else 1.0))
    t, cat = rows.trial.to_numpy(), rows.c.to_numpy()
    out = {}
    for i in range(len(t)):
        d2 = sum((x[c][i] - x[c]) ** 2 for c in numeric) + np.where(cat == cat[i], 0.0, 2.0)
        order = [j for j in np.lexsort((t, d2)) if j != i][:k]
        out[t[i]] = [int(t[j]) for j in order]
    return out


def cloud(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.random(n), rng.random(n)
    if kind == "cluster":  # most trials close together, some copies, some far away
        a[: n * 2 // 3], b[: n * 2 // 3] = 0.3 + 0.002 * rng.normal(size=n * 2 // 3), 0.7 + 0.002 * rng.normal(size=n * 2 // 3)
        a[-n // 10 :], b[-n // 10 :] = a[0], b[0]
    c = {"spread": rng.choice(["x", "y"], n), "cluster": rng.choice(["x", "y"], n, p=[0.97, 0.03]), "alone": np.array([f"z{i % (n // 2)}" for i in range(n)])}[kind]
    return pd.DataFrame({"study": "s", "trial": rng.permutation(n), "a": a, "b": b, "c": c, "v": rng.normal(size=n)})


@pytest.mark.parametrize("kind", ["spread", "cluster", "alone"])
def test_nearest_trials_equal_all_pairs(spark, kind):
    rows = cloud(kind, 240)
    d = P.normalise_trials(spark.createDataFrame(rows, SCHEMA).withColumn("value", F.col("v")), ["study"], ["a", "b"], ["c"])
    got = {r["trial"]: [o["t"] for o in r["neighbours"]] for r in P.nearest_trials(d, ["study"], "trial", ["a", "b"], ["c"], 5).collect()}
    assert got == pairs(rows, ["a", "b"], 5)


def test_few_trials_have_few_neighbours(spark):
    rows = cloud("spread", 4)
    d = P.normalise_trials(spark.createDataFrame(rows, SCHEMA).withColumn("value", F.col("v")), ["study"], ["a", "b"], ["c"])
    got = {r["trial"]: [o["t"] for o in r["neighbours"]] for r in P.nearest_trials(d, ["study"], "trial", ["a", "b"], ["c"], 5).collect()}
    assert got == pairs(rows, ["a", "b"], 5)


def test_compared_pairs_grow_with_the_trials(spark):
    def compared(n):
        d = P.normalise_trials(spark.createDataFrame(cloud("spread", n), SCHEMA).withColumn("value", F.col("v")), ["study"], ["a", "b"], ["c"])
        points = P._points(d, ["study"], "trial", ["_x_a", "_x_b", "c"], 5)
        entries = P._entries(points, ["a", "b"], ["c"], 10)
        bounded = P._radius(points, entries, ["study"], ["a", "b"], ["c"], 5)
        return P._within(bounded, entries, ["study"], ["a", "b"], ["c"], 10).count()

    small, large = compared(2000), compared(32000)
    assert large < 20 * small and large < 32000 * 100


def test_tables_of_trials_are_not_broadcast(spark):
    d = P.normalise_trials(spark.createDataFrame(cloud("spread", 240), SCHEMA).withColumn("value", F.col("v")), ["study"], ["a", "b"], ["c"])
    points = P._points(d, ["study"], "trial", ["_x_a", "_x_b", "c"], 5)
    entries = P._entries(points, ["a", "b"], ["c"], 10)
    bounded = P._radius(points, entries, ["study"], ["a", "b"], ["c"], 5)
    near = P._within(bounded, entries, ["study"], ["a", "b"], ["c"], 10)
    near.count()
    plan = near._jdf.queryExecution().executedPlan().toString()
    # the bounds of a study's parameters are small and may be sent to all tasks; every join on trials or cells is sorted
    big = [line for line in plan.split("\n") if "Join [" in line and ("_id" in line or "_cell" in line)]
    assert big and all("SortMergeJoin" in line for line in big)
