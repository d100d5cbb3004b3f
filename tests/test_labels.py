"""Barrier edge cases, leakage guarantees of the splits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barflow.operators import labels as L
from barflow.plans.ordered import Series

S = Series.on_grid(["symbol"], "ts", 3600, rows=8)


def bars(spark, path, atr=1.0):
    n = len(path)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2025-01-01", periods=n, freq="1h"), "close": np.asarray(path, float)})
    pdf["high"], pdf["low"] = pdf.close + 0.5, pdf.close - 0.5
    if atr is not None:
        pdf["atr_14"] = atr
    return spark.createDataFrame(pdf)


def labels(df, **kw):
    return list(L.triple_barrier(df, S, **kw).orderBy("ts").toPandas()["label"])


UP, DOWN, FLAT = [100 + i for i in range(20)], [100 - i for i in range(20)], [100.0] * 20
CASES = [
    ("trend up", UP, {}, lambda x: x[0] == 1 and all(v in (0, 1) for v in x)),
    ("trend down", DOWN, {}, lambda x: x[0] == -1 and all(v in (0, -1) for v in x)),
    ("flat", FLAT, {}, lambda x: set(x) == {0}),
    ("last bar never resolves", UP, {}, lambda x: x[-1] == 0),
    ("one bar horizon", UP, {"max_bars": 1, "pt": 1.2, "sl": 5.0}, lambda x: x[:-1] == [1] * 19),
    ("both barriers, tighter stop", [100.0, 100.0], {"pt": 0.4, "sl": 0.3, "max_bars": 1}, lambda x: x == [-1, 0]),
    ("both barriers, equal", [100.0, 100.0], {"pt": 0.3, "sl": 0.3, "max_bars": 1}, lambda x: x == [1, 0]),
    ("single row", [100.0], {}, lambda x: x == [0]),
]


@pytest.mark.parametrize("name,path,kw,check", CASES, ids=[c[0] for c in CASES])
def test_barrier_cases(spark, name, path, kw, check):
    assert check(labels(bars(spark, path), **kw))


def test_empty_input_gives_empty_output(spark):
    assert L.triple_barrier(bars(spark, [1.0]).limit(0), S).count() == 0


def test_missing_ranges_are_filled_from_the_next_value(spark):
    df = bars(spark, UP).withColumn("atr_14", F.when(F.col("close") > 110, 1.0))
    assert labels(df)[0] == 1


def test_all_null_range_fails(spark):
    df = bars(spark, UP).withColumn("atr_14", F.lit(None).cast("double"))
    with pytest.raises(PySparkException):
        labels(df)


def test_without_range_column_true_range_is_used(spark):
    assert labels(bars(spark, UP, atr=None))[0] == 1


def test_timeout_time_is_clipped_to_the_series(spark):
    got = L.triple_barrier(bars(spark, FLAT), S, max_bars=12).orderBy("ts").toPandas()
    want = [got.ts[min(i + 12, 19)] for i in range(20)]
    assert list(got.t1) == want


def test_event_time_tail_is_zero(spark):
    got = L.event_time_labels(bars(spark, UP), S, horizon=5).orderBy("ts").toPandas()
    assert (got.label[-5:] == 0).all() and (got.label[:10] == 1).all()


def resolved(spark, n=200, hold=5):
    ts = pd.date_range("2025-01-01", periods=n, freq="1h")
    return spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": ts, "t1": ts + pd.Timedelta(hours=hold)}))


def test_walk_forward_never_trains_on_the_test_period(spark):
    df = resolved(spark)
    folds = L.walk_forward_folds(df, S, 5, 0.02).toPandas()
    rows = df.orderBy("ts").toPandas()
    assert sorted(folds.fold.unique()) == [1, 2, 3, 4]
    for _, g in folds.groupby("fold"):
        test = g[g.role == "test"].row
        train = g[g.role == "train"].row
        assert rows.t1[train].max() < rows.ts[test.min()]
        assert train.max() < test.min() - 4
    assert set(folds[folds.role == "test"].row) == set(range(40, 200))


def test_two_sided_folds_purge_both_sides(spark):
    folds = L.two_sided_folds(resolved(spark), S, 5, 0.02).toPandas()
    for k, g in folds.groupby("fold"):
        test, train = set(g[g.role == "test"].row), set(g[g.role == "train"].row)
        assert not test & train
        lo, hi = min(test), max(test)
        assert not {r for r in train if hi < r <= hi + 4 and hi + 5 < 200}
        assert {r for r in train if r < lo} == set(range(lo))


def test_purge_only_touches_leaking_series(spark):
    a = resolved(spark)
    b = a.withColumns({"symbol": F.lit("B"), "t1": F.col("ts")})
    end = F.lit("2025-01-04").cast("timestamp")
    audit = L.leak_audit(a.unionByName(b), end, end).toPandas().set_index("symbol")
    assert audit.loc["A", "n_violations"] > 0 and pd.isna(audit.loc["B", "first_violation"]) is False
    kept = L.purge_overlap(a, end, end)
    assert kept.where(F.col("t1") >= end).count() == 0
