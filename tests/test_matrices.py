"""Training matrices: every column equals the operator it comes from, and nothing is null."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from barflow.operators import indicators as I
from barflow.operators import labels as L
from barflow.operators import matrices as X
from barflow.operators import models as M
from barflow.plans.ordered import Series

S = Series.on_grid(["symbol"], "ts", 3600, rows=90)


@pytest.mark.parametrize("kind,checks", [
    ("futures", [(I.rsi(14), "rsi_14"), (I.fractional_diff(), "frac_diff_d40"), (I.funding_zscore(), "funding_z")]),
    ("scalping", [(I.rsi(7), "rsi_7"), (I.macd(5, 13, 3), "macd"), (I.bollinger(10), "bb_pb")]),
    ("base", [(I.rsi(14), "rsi_14"), (I.flow_imbalance(20), "ofi_z"), (I.trend_flags(), "trend_strength")]),
])
def test_matrix_columns(walk, kind, checks):
    df, _ = walk
    m = X.training_matrix(kind, df, S, "1h").toPandas().set_index(["symbol", "ts"]).sort_index()
    assert len(m) > 100 and set(m.target) == {0, 1} and not m[X.FEATURES[kind]].isna().any().any()
    for feature, column in checks:
        own = I.add_features(df, S, feature).toPandas().set_index(["symbol", "ts"])[column]
        name = "macd_fast" if column == "macd" and kind == "scalping" else column
        assert np.allclose(m[name], own.loc[m.index], atol=1e-7)
    pt, sl, horizon = X.BARRIERS[kind]
    lab = L.triple_barrier(I.add_features(df, S, I.atr()), S, pt, sl, horizon).toPandas().set_index(["symbol", "ts"])["label"]
    positive = -1 if kind == "futures" else 1
    assert ((lab.loc[m.index] == positive).astype(int) == m.target).all()


def test_trend_matrix_keeps_rows_that_only_lack_warm_up(walk):
    """A range and a label are needed; other unknown features are 0."""
    df, _ = walk
    m = X.training_matrix("trend", df, S, "1h").toPandas()
    columns = X.FEATURES["trend"]
    assert not m[columns].isna().any().any() and {"taker_buy_ratio", "avg_trade_size", "news_sentiment"} <= set(columns)
    atr = I.add_features(df, S, I.atr()).toPandas().set_index(["symbol", "ts"])["atr_14"]
    lab = L.triple_barrier(I.add_features(df, S, I.atr()), S, 4.0, 2.0, X.TREND_BARS["1h"]).toPandas().set_index(["symbol", "ts"])["label"]
    want = {k for k in lab.index if lab[k] != 0 and atr[k] == atr[k]}
    assert {tuple(x) for x in m[["symbol", "ts"]].to_numpy()} == {tuple(k) for k in want} and (m["frac_diff_d40"] == 0).any()


def test_base_matrix_has_the_market_context(walk):
    df, _ = walk
    m = X.training_matrix("base", df, S, "1h").toPandas()
    assert {"oi_change_pct", "fear_greed_norm"} <= set(m.columns) and set(m["fear_greed_norm"]) == {0.5} and set(m["oi_change_pct"]) == {0.0}


def test_broken_or_mismatched_model_blocks(spark):
    df = spark.range(5).withColumn("a", F.col("id").cast("double"))

    def broken(x):
        raise RuntimeError("no model")

    for predict, expected in ((broken, 1), (lambda x: x[:, 0], 2)):
        got = M.score_batches(df, predict, ["a"], expected=expected)
        assert got.where(F.col("p").isNotNull()).count() == 0
        assert {r["s"] for r in got.select(M.model_signal("p").alias("s")).collect()} == {0.0}


def test_regimes_are_ordered_by_volatility(spark):
    rng = np.random.default_rng(0)
    import pandas as pd

    parts = [pd.DataFrame({"rv": rng.normal(v, 0.02, 200), "trend_str": rng.normal(t, 0.1, 200), "atr_n": rng.normal(v / 10, 0.002, 200), "vol_z": rng.normal(0, 1, 200), "ret_ac1": rng.normal(0, 0.1, 200)})
             for v, t in ((0.2, 0.5), (0.6, 2.0), (1.5, 0.5))]
    df = spark.createDataFrame(pd.concat(parts, ignore_index=True))
    got = M.fit_regimes(df, components=3)(df).groupBy("regime").agg(F.avg("rv").alias("rv")).orderBy("regime").collect()
    assert [r["regime"] for r in got] == [0, 1, 2] and got[0]["rv"] < got[1]["rv"] < got[2]["rv"]


def test_classifier_takes_infinite_features(spark):
    rows = [("A", i, float("inf") if i % 50 == 7 else float("-inf") if i % 50 == 2 else None if i == 150 else float("nan") if i == 151 else float(i % 10), int(i % 10 > 4)) for i in range(200)]
    matrix = spark.createDataFrame(rows, "symbol string, row long, x double, target int")
    folds = spark.createDataFrame([("A", 1, "train" if i < 100 else "test", i) for i in range(200)], "symbol string, fold int, role string, row long")
    got = M.walk_forward_classifier(matrix, folds, ["x"], ["symbol"], iterations=2).collect()
    # all rows but the null and the NaN are scored, each on its side
    assert len(got) == 1 and got[0]["auc_roc"] == 1.0 and round(got[0]["win_rate_pct"] * 98 / 100) == 50


def test_classifier_without_folds_or_rows_to_learn_from(spark):
    """No fold at all gives no row; a fold whose train rows all lack a feature is skipped, the others are kept."""
    kinds = "symbol string, row long, x double, target int", "symbol string, fold int, role string, row long"
    matrix = spark.createDataFrame([("A", i, None if i < 100 else float(i % 10), int(i % 10 > 4)) for i in range(300)], kinds[0])
    none = M.walk_forward_classifier(matrix, spark.createDataFrame([], kinds[1]), ["x"], ["symbol"], iterations=2)
    assert none.columns == ["fold", "auc_roc", "win_precision", "win_rate_pct", "n_high_conf"] and none.collect() == []
    rows = [("A", 1, "train" if i < 100 else "test", i) for i in range(200)] + [("A", 2, "train" if i < 200 else "test", i) for i in range(300)]
    got = M.walk_forward_classifier(matrix, spark.createDataFrame(rows, kinds[1]), ["x"], ["symbol"], iterations=2).collect()
    assert [r["fold"] for r in got] == [2] and got[0]["auc_roc"] == 1.0


def test_classifier_query_over_bars_that_reach_no_barrier(spark, tmp_path):
    """Bars of one price never reach a barrier, so that the matrix has no row and there is no fold."""
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(minutes=15 * (i // 2), seconds=i % 2), i % 5, "a", 10.0 + i % 2, f'{{"k": {(i * 37) % 90 + 5}}}') for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, "profit gain", "en", "web", 11) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry_point.queries()["walk_forward_classifier"](spark, str(tmp_path))
    assert got.columns == ["fold", "auc_roc", "win_precision", "win_rate_pct", "n_high_conf"] and got.collect() == []
