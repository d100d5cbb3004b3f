"""Streams over several micro-batches give the batch result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import paths
from barflow.operators.bars import bars_from_ticks
from barflow.plans.ordered import Series
from barflow.plans.recurrence import ewm_series
from barflow.queries.stream_queries import drain
from barflow.streaming import jobs, stateful


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    n = 300
    pdf = pd.DataFrame({
        "symbol": rng.choice(["HOT", "COLD"], n, p=[0.8, 0.2]), "ts": pd.date_range("2025-01-01", periods=n, freq="47s"), "id": range(n),
        "price": rng.normal(100, 3, n), "volume": rng.integers(1, 9, n).astype(float),
    })
    path = str(tmp_path_factory.mktemp("ticks"))
    df = spark.createDataFrame(pdf)
    for i in range(5):  # five files, one per micro-batch, in time order
        part = spark.createDataFrame(pdf.iloc[i * 60 : (i + 1) * 60])
        part.coalesce(1).write.mode("append").parquet(path)
    return path, df.schema, df


def stream(spark, landed):
    return jobs.read_files(spark, landed[0], landed[1], files_per_trigger=1)


def test_online_average_equals_batch(spark, landed):
    got = drain(stateful.ema(stream(spark, landed), "price", 0.2), "t-ema").select("id", "ema").orderBy("id").toPandas()
    s = Series.sampled(landed[2], ["symbol"], ["ts", "id"])
    want = ewm_series(landed[2], s, "price", 0.2, "ema").orderBy("id").toPandas()
    assert np.allclose(got["ema"], want["ema"])


def test_window_bars_equal_batch_up_to_the_watermark(spark, landed):
    got = drain(jobs.window_bars(stream(spark, landed), "5m", "1 minute"), "t-bars").orderBy("symbol", "ts").toPandas()
    want = bars_from_ticks(landed[2].withColumn("taker", F.lit(0.0)), "5m").orderBy("symbol", "ts").toPandas()
    last = landed[2].agg(F.max("ts")).first()[0] - pd.Timedelta(minutes=1)
    want = want[want.ts + pd.Timedelta(minutes=5) <= last].reset_index(drop=True)
    assert len(got) == len(want) > 10
    assert np.allclose(got[["open", "high", "low", "close", "volume"]], want[["open", "high", "low", "close", "volume"]])


def test_repeats_are_dropped_across_batches(spark, landed, tmp_path):
    twice = str(tmp_path / "twice")
    landed[2].coalesce(1).write.mode("append").parquet(twice)
    landed[2].coalesce(1).write.mode("append").parquet(twice)
    s = jobs.read_files(spark, twice, landed[1], files_per_trigger=1)
    assert drain(jobs.drop_late_repeats(s, ["symbol", "id"], "1 day"), "t-dup").count() == 300


def test_online_supertrend_equals_batch(spark, walk):
    from barflow.session import scratch_path

    df, _ = walk
    bars = df.select("symbol", "ts", "high", "low", "close")
    path = scratch_path(spark, "t-st")
    for lo, hi in (("2025-01-01", "2025-01-05"), ("2025-01-05", "2025-01-20"), ("2025-01-20", "2025-03-01")):
        bars.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(path)
    got = drain(stateful.supertrend(jobs.read_files(spark, path, bars.schema, files_per_trigger=1)), "t-st-out").orderBy("symbol", "ts").toPandas()
    want = paths.supertrend(bars, Series.on_grid(["symbol"], "ts", 3600, rows=80)).orderBy("symbol", "ts").toPandas()
    for c in ("supertrend", "supertrend_dir", "signal_supertrend"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_trailing_stop_ends_with_the_stop_and_its_mark_expires(spark, tmp_path):
    at = lambda h: (pd.Timestamp("2025-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    batches = [
        [(1, at(0), 101.0), (1, at(1), 105.0)], [(1, at(3), 102.0), (1, at(2), 104.0), (1, at(4), 90.0)],
        [(1, at(5), 200.0), (2, at(5), 100.0)],  # after the stop: swallowed
        [(2, at(90), 101.0)], [(2, at(91), 101.5)],  # time passes, the mark of trade 1 goes
        [(1, at(92), 99.0), (2, at(1), 500.0)],  # so the number can be used again; the other row is late
    ]
    path, schema = str(tmp_path / "p"), "trade_id long, ts timestamp, price double"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    prices = jobs.read_files(spark, path, schema, files_per_trigger=1).withColumns({"entry_price": F.lit(100.0), "direction": F.lit(1)})
    got = drain(stateful.trailing_stop(prices), "t-stop").orderBy("trade_id", "ts").toPandas()
    assert [(i, t.hour + 24 * (t.day - 1), s) for i, t, s in zip(got.trade_id, got.ts, got.stop_hit)] == [
        (1, 0, False), (1, 1, False), (1, 2, False), (1, 3, True), (1, 92, False), (2, 5, False), (2, 90, False), (2, 91, False)
    ]
    assert got.mfe_pct.iloc[3] == pytest.approx(5.0) and got.mae_pct.iloc[3] == 0.0 and got.mae_pct.iloc[4] == pytest.approx(-1.0)


def test_agents_time_out(spark, tmp_path):
    path = str(tmp_path / "hb")
    schema = "agent string, ts timestamp"
    for rows in ([("a", "2025-01-01 00:00:00"), ("b", "2025-01-01 00:00:01")], [("b", "2025-01-01 00:10:00")], [("b", "2025-01-01 00:10:01")]):
        spark.createDataFrame([(a, pd.Timestamp(t).to_pydatetime()) for a, t in rows], schema).coalesce(1).write.mode("append").parquet(path)
    got = drain(stateful.liveness(jobs.read_files(spark, path, schema, files_per_trigger=1), 60), "t-live").toPandas()
    assert set(got.agent) >= {"a"} and "b" not in set(got.agent[got.last_us > pd.Timestamp("2025-01-01 00:05").value // 1000])


def test_topic_replay_and_bad_rows(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(pd.Timestamp("2025-01-01").to_pydatetime(), "x"), (pd.Timestamp("2025-01-02").to_pydatetime(), "y")], "ts timestamp, v string")
    jobs.publish(df, root, "news")
    jobs.publish(df, root, "news")
    stats = jobs.topic_stats(spark, root, "news").first()
    assert stats["lines"] == 4 and stats["days"] == 2 and stats["bytes"] > 0
    for name in ("one", "two"):  # two consumers, each from the start
        assert drain(jobs.consume(spark, root, "news", "v string"), f"t-{name}").count() == 4
    ev = spark.createDataFrame([
        ('{"stream":"btcusdt@depth","data":{"E":1700000000000,"bids":[["1","2"]],"asks":[["1.1","3"]]}}',),
        ('{"stream":"btcusdt@depth","data":{"E":0,"bids":[["1","2"]],"asks":[["1.1","3"]]}}',), ("not json",),
    ], "value string")
    assert [r["reason"] for r in jobs.depth_snapshots(ev).collect()] == [None, "no time", "no symbol"]
    k = spark.createDataFrame([
        ('{"stream":"btcusdt@kline_1m","data":{"k":{"x":true,"t":1700000000000,"T":1700000059999,"o":"1","h":"2","l":"0.5","c":"1.5","v":"10","n":7,"V":"4","Q":"6"}}}',),
        ('{"stream":"btcusdt@kline_1m","data":{"k":{"x":false,"t":1700000000000,"o":"1","h":"2","l":"0.5","c":"1.5","v":"10","n":7}}}',),
    ], "value string")
    got = jobs.closed_bars(k).collect()
    assert len(got) == 1 and got[0]["symbol"] == "BTCUSDT" and got[0]["timeframe"] == "1m" and got[0]["taker_buy_base"] == 4.0


def test_live_news_view_keeps_the_last_hours(spark, tmp_path):
    from barflow.session import scratch_path

    path, schema = str(tmp_path / "n"), "ts timestamp, title string"
    for day in ("2025-01-01", "2025-01-03", "2025-01-04"):
        spark.createDataFrame([(pd.Timestamp(day).to_pydatetime(), day)], schema).coalesce(1).write.mode("append").parquet(path)
    q = jobs.live_news(jobs.read_files(spark, path, schema), "live_news", scratch_path(spark, "t-news"), scratch_path(spark, "t-news-out"), 48, every=None)
    q.awaitTermination()
    assert sorted(r["title"] for r in spark.table("global_temp.live_news").collect()) == ["2025-01-03", "2025-01-04"]


def test_live_news_view_exists_before_the_first_item(spark, tmp_path):
    from barflow.session import scratch_path

    (tmp_path / "n").mkdir()
    stream = jobs.read_files(spark, str(tmp_path / "n"), "ts timestamp, title string")
    jobs.live_news(stream, "no_news", scratch_path(spark, "t-news"), scratch_path(spark, "t-news-out"), 48, every=None).awaitTermination()
    assert spark.table("global_temp.no_news").columns == ["ts", "title"] and spark.table("global_temp.no_news").isEmpty()


@pytest.mark.parametrize("folder", [False, True])
def test_streamed_tables_may_be_files_or_folders(spark, tmp_path, folder):
    from barflow.queries.registry import QUERIES

    rows = spark.createDataFrame([(i, "x" * i) for i in range(1, 201)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / ("documents.parquet" if folder else "d")))
    if not folder:
        rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    got = sorted((r["id"], r["n"]) for r in QUERIES["stream_live_news"](spark, str(tmp_path)).collect())
    assert got == [(i, i) for i in range(134, 201)]  # 2580 seconds between items: 48 hours hold 66 before the newest


def test_one_key_is_folded_in_chunks(spark, tmp_path):
    """The state function's memory: about the arrays of the columns in use, not a Python object for each row and column."""
    n, path = 300_000, str(tmp_path / "n")
    # text that no step reads, and rows in no order
    ticks = spark.range(n).select(
        F.lit("a").alias("symbol"), F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(n))).alias("ts"), "id", F.col("id").cast("double").alias("price"), F.repeat(F.lit("x"), 500).alias("text"),
    )
    ticks.write.parquet(path)

    def step(st, row):
        import resource

        seen = 1 if st is None else st[0] + 1
        return (seen,), {"seen": seen, "width": len(row), "peak": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}

    d = stateful.keyed_fold(jobs.read_files(spark, path, ticks.schema), ["symbol"], ["ts", "id"], {"n": "bigint"}, step, {"seen": "bigint", "width": "bigint", "peak": "bigint"}, reads=["price"])
    got = drain(d, "chunks")
    first, last = got.orderBy("seen").select("ts", "peak").first(), got.orderBy(F.desc("seen")).select("ts", "peak").first()
    assert got.select("seen").distinct().count() == n and first["ts"] < last["ts"] and [r[0] for r in got.select("width").distinct().collect()] == [3]
    # folding the rows adds little to what the sorted columns took
    assert last["peak"] - first["peak"] < 150_000
