"""Golden values and tables: quality, drift, gates, trades, store round trips."""

import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow import schemas
from barflow.functions import text as T
from barflow.functions.book import top_of_book
from barflow.functions.numeric import normal_cdf
from barflow.operators import bars as B
from barflow.operators import drift as D
from barflow.operators import quality as Q
from barflow.operators import ranking as K
from barflow.operators import stats as S
from barflow.operators import trades as Tr
from barflow.plans.ordered import Series
from barflow.sources import landing, store

HOURLY = Series.on_grid(["symbol"], "ts", 3600, rows=50)


def clean_bars(spark, n=240):
    i = np.arange(n)
    c = 100 + (i % 7) * 0.5
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2025-01-15", periods=n, freq="1h"), "id": i, "open": c - 0.1, "high": c + 0.3, "low": c - 0.4, "close": c, "volume": 1000.0})
    return pdf


def report(spark, pdf, **kw):
    return Q.validate_bars(spark.createDataFrame(pdf), HOURLY, "1h", **kw)[1].first()


def test_clean_bars_pass(spark):
    r = report(spark, clean_bars(spark))
    assert not r["hard_error"] and r["duplicates"] == r["gaps"] == r["spikes"] == r["zero_volume_runs"] == 0
    Q.enforce(Q.validate_bars(spark.createDataFrame(clean_bars(spark)), HOURLY, "1h")[1])


def test_each_defect_is_reported(spark):
    p = clean_bars(spark)
    p.loc[5, "high"] = p.loc[5, "low"] - 1
    p.loc[9, "volume"] = -1
    r = report(spark, p)
    assert r["high_below_low"] == 1 and r["high_below_body"] == 1 and r["negative_volume"] == 1 and r["hard_error"]
    with pytest.raises(Q.DataQualityError):
        Q.enforce(Q.validate_bars(spark.createDataFrame(p), HOURLY, "1h")[1])
    gap = clean_bars(spark).drop(index=range(50, 59))
    assert (report(spark, gap)["gaps"], report(spark, gap)["missing_bars"]) == (1, 9)
    twice = pd.concat([clean_bars(spark), clean_bars(spark).tail(1).assign(id=999)])
    assert report(spark, twice)["duplicates"] == 1
    silent = clean_bars(spark)
    silent.loc[100:170, "volume"] = 0
    assert report(spark, silent)["zero_volume_runs"] == 1
    jump = clean_bars(spark)
    jump.loc[50, ["open", "high", "low", "close"]] *= 1.6
    assert report(spark, jump)["spikes"] == 1
    late = clean_bars(spark)
    late.loc[3, "id"] = 1000
    assert not report(spark, late)["monotonic"]


def test_psi_grows_with_the_shift(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 5000)
    base = D.baseline(D.melt(spark.createDataFrame(pd.DataFrame({"cell": "c", "f": x})), ["cell"], ["f"]), ["cell"])
    value = lambda y: D.psi(base, D.melt(spark.createDataFrame(pd.DataFrame({"cell": "c", "f": y})), ["cell"], ["f"]), ["cell"]).first()["psi"]
    assert value(rng.normal(0, 1, 5000)) < 0.02
    assert value(x + 1) > 0.10
    assert value(x + 3) > 0.25


def test_kpi_gate_and_scores(spark):
    row = lambda day, win: ("m", "1h", pd.Timestamp(f"2025-01-0{day}").to_pydatetime(), win, "a.bin", None, False)
    cols = ["model", "tf", "ts", "wf_win_rate", "artifact_path", "error", "cancelled"]
    thresholds = spark.createDataFrame([("m", "wf_win_rate", 50.0)], ["model", "field", "bound"])
    schema = "model string, tf string, ts timestamp, wf_win_rate double, artifact_path string, error string, cancelled boolean"

    def gate(*wins):
        runs = spark.createDataFrame([row(i + 1, w) for i, w in enumerate(wins)], schema)
        d = K.threshold_misses(runs, thresholds, ["wf_win_rate"], ["model", "tf", "ts"])
        return K.kpi_gate(d, Series.sampled(runs, ["model", "tf"], ["ts"], n=1)).first()

    assert gate(45.0, 45.0, 45.0)["retire"] and gate(45.0, 45.0, None)["retire"]
    assert not gate(45.0, 55.0, 45.0)["retire"] and not gate(45.0, 45.0)["retire"]
    score = lambda a, u, w: spark.range(1).select(K.composite_score(*[F.lit(x).cast("double") for x in (a, u, w)])).first()[0]
    assert score(60, 0.6, 70) == pytest.approx(62.0)
    assert score(60, None, 70) == pytest.approx(62.857, abs=1e-3)
    assert score(None, None, None) is None
    assert cols


def test_book_functions(spark):
    lv = lambda *x: [{"price": float(p), "qty": float(q)} for p, q in x]
    kind = "array<struct<price:double,qty:double>>"
    df = spark.createDataFrame([(lv((100, 1), (99, 2), (98, 3)), lv((101, 0.5), (102, 1.5), (103, 2.5)))], f"bids {kind}, asks {kind}")
    top = top_of_book(df, 3).first()
    assert (top["v_bid"], top["v_ask"], top["p_bid"], top["p_ask"]) == (6.0, 4.5, 100.0, 101.0)
    asks = spark.createDataFrame([(lv((100, 0.5), (101, 1), (102, 2)),), ([],)], f"lv {kind}")
    got = asks.select(Tr.book_walk("lv", F.lit(1.0), F.lit(True), F.lit(99.5)).alias("f")).select("f.*").collect()
    assert got[0]["avg_price"] == 100.5 and got[0]["levels_used"] == 2
    assert got[1]["slippage_bps"] == 1e4
    one = spark.range(1)
    assert one.select(Tr.linear_slippage_bps(F.lit(1.0), F.lit(100.0))).first()[0] == pytest.approx(50.0)
    assert one.select(Tr.linear_slippage_bps(F.lit(1.0), F.lit(0.0))).first()[0] == 1e4


def test_order_flow_of_snapshots(spark):
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2025-01-01", periods=3, freq="s"), "p_bid": 100.0, "p_ask": 101.0, "v_bid": [10.0, 12, 11], "v_ask": [8.0, 8, 9]})
    got = B.book_flow(spark.createDataFrame(pdf), Series.on_grid(["symbol"], "ts", 1)).orderBy("ts").toPandas()
    assert list(got.ofi) == [0.0, 2.0, -2.0]


def test_resample_equals_pandas(walk):
    df, pdf = walk
    d = df.withColumns({"quote_volume": F.lit(1.0), "taker_buy_quote": F.lit(1.0)})
    got = B.resample_bars(d, "4h").where("symbol = 'HOT'").orderBy("ts").toPandas()
    g = pdf[pdf.symbol == "HOT"].set_index("ts").resample("4h")
    want = g.agg({"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"})
    assert np.allclose(got[["open", "high", "low", "close", "volume"]], want)
    weekly = B.resample_bars(d, "1w").toPandas()
    assert (weekly.ts.dt.dayofweek == 0).all()


def test_auc_and_normal_cdf(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    got = S.classifier_metrics(spark.createDataFrame(pd.DataFrame({"m": "a", "y": y, "p": p})), ["m"]).first()
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert got["auc_roc"] == pytest.approx(want)
    one = S.classifier_metrics(spark.createDataFrame(pd.DataFrame({"m": "a", "y": [1, 1], "p": [0.2, 0.9]})), ["m"]).first()
    assert one["auc_roc"] is None
    phi = spark.range(1).select(normal_cdf(F.lit(1.3))).first()[0]
    assert phi == pytest.approx(0.5 * (1 + math.erf(1.3 / math.sqrt(2))), abs=2e-7)


def test_text_rules(spark):
    df = spark.createDataFrame([("Bitcoin RALLY! Record high, but crash fears.",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.lexicon_tone("t")).collect()]
    assert got == [round((3 - 1) / 4, 3), 0.0, 0.0]
    tags = df.select(T.coin_tags("t")).first()[0]
    assert tags == ["ALL", "BTC"]
    assert df.select(T.coin_tags(F.lit("Canada news"))).first()[0] == ["ALL", "ADA"]
    sig = df.select(T.log_signature(F.lit("2025-01-01 10:00:00,123 - x - ERROR - BTC_USDT PID 77 took 1.5 s of 12345"))).first()[0]
    assert sig == "<TS> - x - ERROR - <SYM> <PID> took <NUM> s of <NUM>"


def write_csv(path, n=50, start="2025-01-15"):
    ts = pd.date_range(start, periods=n, freq="1h")
    i = np.arange(n)
    pd.DataFrame({"timestamp": ts.strftime("%Y-%m-%d %H:%M:%S"), "open": 100 + i, "high": 105 + i, "low": 95 + i, "close": 102 + i, "volume": 1000.0}).to_csv(path, index=False)


def test_csv_ingest_round_trip(spark, tmp_path):
    csv, out = str(tmp_path / "a.csv"), str(tmp_path / "store")
    write_csv(csv, 24 * 20)
    assert store.ingest_csv(spark, csv, out, "BTC_USDT", "1h") == 480
    assert store.ingest_csv(spark, csv, out, "BTC_USDT", "1h") == 0, "months already present are skipped"
    with open(csv, "rb") as f, gzip.open(csv + ".gz", "wb") as g:
        g.write(f.read())
    assert store.ingest_csv(spark, csv + ".gz", out, "ETH_USDT", "1h") == 480
    d = spark.read.parquet(out)
    at = lambda x: F.lit(x).cast("timestamp")
    cut = store.time_slice(d, at("2025-01-16"), at("2025-01-17"), {"symbol": "BTC_USDT"}, ["close"])
    assert cut.count() == 24 and cut.columns == ["ts", "close"]
    assert "PartitionFilters: [" in cut._jdf.queryExecution().toString() and "yyyymm" in cut._jdf.queryExecution().toString()
    status = store.series_status(d).toPandas().set_index("symbol")
    assert status.loc["BTC_USDT", "rows"] == 480 and status.loc["BTC_USDT", "partitions"] == 2
    assert store.file_sizes(spark, out, ["symbol", "yyyymm"]).count() == 4


def test_missing_table_is_empty(spark, tmp_path):
    assert store.scan(spark, str(tmp_path), "liquidations").count() == 0
    store.register(spark, str(tmp_path), ["fear_greed"])
    assert store.run_sql(spark, "SELECT * FROM fear_greed WHERE fear_greed > ?", [50]).count() == 0


def test_row_cap_unless_the_query_has_its_own(spark):
    spark.range(50).createOrReplaceTempView("many")
    assert store.run_sql(spark, "SELECT * FROM many", cap=10).count() == 10
    assert store.run_sql(spark, "SELECT * FROM many LIMIT 20", cap=10).count() == 20
    assert store.run_sql(spark, "SELECT * FROM many LIMIT 20 OFFSET 0 -- all", cap=10).count() == 20
    assert store.run_sql(spark, "SELECT * FROM many -- limit 5", cap=10).count() == 10
    assert store.run_sql(spark, "SELECT * FROM many").count() == 50


def test_upsert_rewrites_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda day, v: spark.createDataFrame([("A", pd.Timestamp(day).to_pydatetime(), float(v))], "symbol string, ts timestamp, x double")
    go = lambda df: store.upsert(spark, path, df, ["symbol", "ts"], ["symbol"], str(tmp_path / f"stage{np.random.randint(1e9)}"))
    go(rows("2025-01-01", 1).unionByName(rows("2025-02-01", 2)))
    go(rows("2025-02-01", 3).unionByName(rows("2025-02-02", 4)))
    got = {(r["ts"].month, r["ts"].day): r["x"] for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 3.0, (2, 2): 4.0}


def test_compaction_checks_counts(spark, tmp_path):
    src, dst = str(tmp_path / "s"), str(tmp_path / "d")
    df = spark.createDataFrame([("A", pd.Timestamp("2025-01-01").to_pydatetime(), i, float(i)) for i in (1, 2)] + [("A", pd.Timestamp("2025-01-02").to_pydatetime(), 3, 3.0)], "symbol string, ts timestamp, id long, x double")
    store.write_months(df, src, ["symbol"])
    report = store.compact(spark, src, dst, ["symbol", "ts"], ["symbol"], ["id"]).first()
    assert (report["rows_before"], report["rows_after"]) == (3, 2)
    assert sorted(r["x"] for r in spark.read.parquet(dst).collect()) == [1.0, 3.0]


def test_line_protocol_types(spark):
    df = spark.createDataFrame([('t,symbol=BTC a=1i,b=2.5,c="x",d=true,e=oops 1700000000000000000',), ("broken",), ("",)], "line string")
    rows = landing.line_protocol(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["table"], r["tags"], r["longs"], r["doubles"], r["strings"], r["flags"]) == ("t", {"symbol": "BTC"}, {"a": 1}, {"b": 2.5}, {"c": "x", "e": "oops"}, {"d": True})
    assert r["ts"].timestamp() == 1_700_000_000


def test_schema_coercion(spark):
    df = spark.createDataFrame([("1700000000", "abc", "1.5"), ("2024-01-01T00:00:00Z", "2", None)], "ts string, open string, close string")
    a, b = schemas.coerce(df, "market_data").collect()
    assert a["open"] is None and a["close"] == 1.5 and a["ts"].timestamp() == 1_700_000_000
    assert b["open"] == 2.0 and b["ts"].year == 2024
    z = schemas.coerce(df, "market_data", zero_fill=True).first()
    assert z["open"] == 0.0 and z["symbol"] == ""
    assert "yyyymm" in schemas.with_partitions(schemas.coerce(df, "market_data"), "market_data").columns


def test_mean_pairwise_correlation_equals_matrix(spark):
    rng = np.random.default_rng(123)
    base = rng.normal(0, 1, 500)
    cols = {"BTC": base, "ETH": 1.2 * base + rng.normal(0, 0.5, 500), "SOL": 1.5 * base + rng.normal(0, 1, 500), "LINK": 0.8 * base + rng.normal(0, 2, 500)}
    wide = pd.DataFrame(cols, index=pd.date_range("2025-01-01", periods=500, freq="1h"))
    long = wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="ret")
    df = spark.createDataFrame(long)
    c = wide.corr().to_numpy()
    assert S.mean_pairwise_correlation(df).first()["mean_corr"] == pytest.approx((c.sum() - 4) / 12)
    betas = {r["symbol"]: r["beta"] for r in S.factor_betas(df, "BTC").collect()}
    assert betas["BTC"] == 1.0 and betas["ETH"] == pytest.approx(1.2, abs=0.1)
