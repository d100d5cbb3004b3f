"""Registered queries: streams drained over the given tables and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow import schemas
from barflow.queries.base import SQL, TICKS_SQL, bars, bars_sql, query, r, show, sql_round, table, use_utc
from barflow.queries.path_queries import indicator_supertrend  # noqa: F401  (registers its SQL first)
from barflow.session import scratch_path
from barflow.streaming import jobs, stateful


def drain(stream: DataFrame, name: str, partition=()) -> DataFrame:
    """Run a stream over what is there now and return what its Parquet sink holds."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    q = jobs.partitioned_sink(stream, out, check, list(partition), every=None)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark, sf, name: str = "events") -> DataFrame:
    use_utc(spark)
    path = f"{sf}/{name}.parquet"
    there = spark.read.parquet(path)
    single = [f.rsplit("/", 1)[1] for f in there.inputFiles()] == [f"{name}.parquet"]  # a stream lists folders: that of the file, or the table's own
    d = jobs.read_files(spark, sf, there.schema, glob=f"{name}.parquet") if single else jobs.read_files(spark, path, there.schema)
    return d.withColumns({c: F.col(c).cast("timestamp") for c, k in d.dtypes if k == "timestamp_ntz"})


def tick_stream(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return event_stream(spark, sf).select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"), k.alias("volume"), (k * k / 100.0).alias("taker")
    )


@query("stream_window_bars", f"""WITH {TICKS_SQL}, {bars_sql('1h')} SELECT symbol, ts, {sql_round('open, high, low, close, volume')}, trades_count FROM bars
  WHERE ts + 3600000000 <= (SELECT max(us) // 1000 * 1000 FROM ticks) - 600000000""")
def stream_window_bars(spark, sf):
    """Bars whose end lies behind the final watermark; the rest stays in state for later data."""
    d = drain(jobs.window_bars(tick_stream(spark, sf), "1h"), "bars")
    return show(d, "open", "high", "low", "close", "volume", "trades_count")


@query("stream_sliding_mean", f"""WITH {TICKS_SQL}, w AS (SELECT symbol, price, unnest(range(us // 3600000000 * 3600000000 + 3600000000, us // 3600000000 * 3600000000 + 24 * 3600000000 + 1, 3600000000)) AS ts FROM ticks)
  SELECT symbol, ts, round(avg(price), 6) + 0.0 AS mean, count(*) AS n FROM w WHERE ts <= (SELECT max(us) // 1000 * 1000 FROM ticks) - 3600000000 GROUP BY 1, 2""")
def stream_sliding_mean(spark, sf):
    return show(drain(jobs.sliding_mean(tick_stream(spark, sf), "price"), "mean"), "mean", "n")


@query("stream_drop_repeats", "SELECT event_type AS symbol, epoch_us(ts) // 60000000 * 60000000 AS ts, count(*) AS kept FROM (SELECT DISTINCT event_type, epoch_us(ts) // 60000000 AS m, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type, m ORDER BY ts) = 1) GROUP BY 1, 2")
def stream_drop_repeats(spark, sf):
    us = F.unix_micros("ts")
    t = tick_stream(spark, sf).withColumn("ts", F.timestamp_micros(us - F.pmod(us, F.lit(60_000_000)))).select("symbol", "ts")
    d = drain(jobs.drop_late_repeats(t, ["symbol", "ts"]), "dedupe")
    return show(d.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("kept")), "kept")


@query("stream_closed_bars", f"WITH {TICKS_SQL} SELECT upper(symbol) AS symbol, '1m' AS timeframe, us // 1000 * 1000 AS ts, round(price, 6) + 0.0 AS close, CAST(volume AS BIGINT) AS trades_count FROM ticks WHERE volume > 30")
def stream_closed_bars(spark, sf):
    c = F.col
    k = F.struct((c("volume") > 30).alias("x"), F.floor(F.unix_micros("ts") / 1000).alias("t"), *[c("price").cast("string").alias(n) for n in "ohlc"], c("volume").cast("string").alias("v"), c("volume").cast("bigint").alias("n"))
    ev = tick_stream(spark, sf).select(F.to_json(F.struct(F.concat("symbol", F.lit("@kline_1m")).alias("stream"), F.struct(k.alias("k")).alias("data"))).alias("value"))
    return show(drain(jobs.closed_bars(ev), "klines", ["symbol"]), "close", "trades_count", keys=("symbol", "timeframe", "ts"))


@query("stream_depth_snapshots", f"""WITH {TICKS_SQL} SELECT coalesce(CASE WHEN volume < 5 THEN 'no time' WHEN volume > 95 THEN 'empty side' END, 'ok') AS reason, upper(symbol) AS symbol, count(*) AS n, round(sum(CASE WHEN volume > 95 OR volume < 5 THEN 0 ELSE price END), 4) + 0.0 AS bid_sum FROM ticks GROUP BY 1, 2""")
def stream_depth_snapshots(spark, sf):
    c = F.col
    lv = lambda p: F.array(F.array(p.cast("string"), c("volume").cast("string")), F.array((p * 1.01).cast("string"), F.lit("1.0")))
    data = F.struct(F.when(c("volume") >= 5, F.floor(F.unix_micros("ts") / 1000)).otherwise(0).alias("E"), lv(c("price")).alias("bids"), F.when(c("volume") <= 95, lv(c("price") + 1)).otherwise(F.array().cast("array<array<string>>")).alias("asks"))
    ev = tick_stream(spark, sf).select(F.to_json(F.struct(F.concat("symbol", F.lit("@depth")).alias("stream"), data.alias("data"))).alias("value"))
    good, bad, check = (scratch_path(spark, n) for n in ("book", "book-bad", "book-state"))
    jobs.split_sink(jobs.depth_snapshots(ev), good, bad, check, every=None).awaitTermination()
    both = spark.read.parquet(good).select("symbol", "p_bid", F.lit("ok").alias("reason")).unionByName(spark.read.parquet(bad).select("symbol", F.lit(0.0).alias("p_bid"), "reason"))
    return both.groupBy("reason", "symbol").agg(F.count(F.lit(1)).alias("n"), r(F.sum("p_bid"), 4).alias("bid_sum"))


@query("stream_ema", SQL["ema_over_ticks"])
def stream_ema(spark, sf):
    """Same result as the batch recurrence."""
    return show(drain(stateful.ema(tick_stream(spark, sf), "price", 0.1), "ema"), "ema", keys=("symbol", "ts", "id"))


@query("stream_loss_streak", f"""WITH {TICKS_SQL}, g AS (SELECT symbol AS strategy, us AS ts, id, price - 40 AS pnl, count(*) FILTER (price > 40) OVER (PARTITION BY symbol ORDER BY us, id) AS wins FROM ticks),
  k AS (SELECT *, row_number() OVER (PARTITION BY strategy, wins ORDER BY ts, id) - CASE WHEN wins > 0 THEN 1 ELSE 0 END AS losses FROM g) SELECT strategy, ts, id, losses, losses >= 5 AS paused FROM k""")
def stream_loss_streak(spark, sf):
    t = tick_stream(spark, sf).select(F.col("symbol").alias("strategy"), "ts", "id", (F.col("price") - 40).alias("pnl"))
    return show(drain(stateful.loss_streak(t), "streak"), "losses", "paused", keys=("strategy", "ts", "id"))


@query("stream_supertrend", SQL["indicator_supertrend"])
def stream_supertrend(spark, sf):
    """Bars are landed first, then streamed; same result as the batch operator."""
    landed = scratch_path(spark, "bars")
    b = bars(spark, sf).select("symbol", "ts", "high", "low", "close")
    b.write.parquet(landed)
    d = drain(stateful.supertrend(jobs.read_files(spark, landed, b.schema)), "supertrend")
    return show(d, "supertrend", "supertrend_dir", "signal_supertrend")


@query("stream_topic_stats", "SELECT count(*) AS lines, count(DISTINCT CAST(ts AS DATE)) AS days FROM events")
def stream_topic_stats(spark, sf):
    root = scratch_path(spark, "topics")
    jobs.publish(table(spark, sf, "events").select("event_id", "ts", "event_type", "value"), root, "events")
    return jobs.topic_stats(spark, root, "events").select("lines", "days")


@query("stream_bus_router", f"""WITH {TICKS_SQL} SELECT 'market_data' AS "table", symbol, count(*) AS n, round(sum(price), 4) + 0.0 AS total FROM ticks WHERE volume > 50 GROUP BY 2 UNION ALL SELECT 'trade_events', symbol, count(*), round(sum(price), 4) + 0.0 FROM ticks WHERE volume <= 50 GROUP BY 2""")
def stream_bus_router(spark, sf):
    c = F.col
    t = tick_stream(spark, sf)
    value = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "symbol", F.lit("1m").alias("timeframe"), c("price").cast("string").alias("close"), c("price").alias("exit_price")))
    root, check = scratch_path(spark, "bus"), scratch_path(spark, "bus-state")
    m = t.select(F.when(c("volume") > 50, "candles").otherwise("trades").alias("topic"), value.alias("value"))
    jobs.route_topics(m, {"candles": "market_data", "trades": "trade_events"}, root, check, every=None).awaitTermination()
    read = lambda n, v: spark.read.parquet(f"{root}/{n}").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.sum(v), 4).alias("total")).select(F.lit(n).alias("table"), "symbol", "n", "total")
    return read("market_data", "close").unionByName(read("trade_events", "exit_price"))


@query("rollover_day_rows", f"WITH {TICKS_SQL}, {bars_sql('1h')} SELECT symbol, ts, round(close, 6) + 0.0 AS close FROM bars WHERE ts >= epoch_us(TIMESTAMP '2024-01-12') AND ts < epoch_us(TIMESTAMP '2024-01-13')")
def rollover_day_rows(spark, sf):
    b = bars(spark, sf, "1h").withColumn("timeframe", F.lit("1h"))
    hot = b.withColumn("arrived", F.lit(1)).unionByName(b.withColumns({"arrived": F.lit(0), "close": F.lit(-1.0)}))
    return show(jobs.rollover_rows(hot, F.lit("2024-01-12").cast("timestamp")), "close")


@query("stale_agents", "SELECT user_id AS agent, epoch_us(max(ts)) AS last_ts, arg_max(event_type, ts) AS status, round((1706572800000000 - epoch_us(max(ts))) / 1e6, 3) + 0.0 AS lag_s, (1706572800000000 - epoch_us(max(ts))) / 1e6 > 36000 AS stale FROM events GROUP BY 1")
def stale_agents(spark, sf):
    hb = table(spark, sf, "events").select(F.col("user_id").alias("agent"), "ts", F.col("event_type").alias("status"))
    return show(jobs.stale_agents(hb, F.timestamp_micros(F.lit(1_706_572_800_000_000)), 36_000), "last_ts", "status", "lag_s", "stale", keys=("agent",), digits=3)


@query("stream_live_news", """WITH n AS (SELECT doc_id AS id, 1704067200000000 + doc_id * 2580000000 AS ts, length(text) AS n FROM documents)
  SELECT id, ts, n FROM n WHERE ts >= (SELECT max(ts) FROM n) - 172800000000""")
def stream_live_news(spark, sf):
    """The view over the last 48 hours of a news stream, after all of it has arrived."""
    d = event_stream(spark, sf, "documents")
    items = d.select(F.col("doc_id").alias("id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("doc_id") * 2_580_000_000).alias("ts"), F.length("text").cast("bigint").alias("n"))
    view = f"live_news_{abs(hash(scratch_path(spark, 'n')))}"
    jobs.live_news(items, view, scratch_path(spark, "live-news-state"), scratch_path(spark, "live-news"), 48, every=None).awaitTermination()
    return show(spark.table(f"global_temp.{view}"), "n", keys=("id", "ts"))


@query("stream_routed_tables", f"""WITH {TICKS_SQL} SELECT CASE WHEN volume > 50 THEN 'large' ELSE 'small' END AS kind, symbol, strftime(make_timestamp(us), '%Y-%m') AS yyyymm, count(*) AS n, round(sum(price), 4) + 0.0 AS total FROM ticks GROUP BY 1, 2, 3""")
def stream_routed_tables(spark, sf):
    """A tick stream split into two committed tables."""
    from barflow.sources.snapshots import SnapshotTable

    s = tick_stream(spark, sf)
    large, small = (SnapshotTable(spark, scratch_path(spark, k), s.schema) for k in ("large", "small"))
    jobs.snapshot_sink(s, [(large, lambda d: d.where("volume > 50")), (small, lambda d: d.where("volume <= 50"))], scratch_path(spark, "routed-state"), every=None).awaitTermination()
    both = large.read().withColumn("kind", F.lit("large")).unionByName(small.read().withColumn("kind", F.lit("small")))
    return both.groupBy("kind", "symbol", "yyyymm").agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), 4).alias("total"))


@query("stream_trailing_stop", """WITH p AS (SELECT user_id AS trade_id, epoch_us(ts) AS ts, value AS price, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS dir,
    greatest(50.0::DOUBLE, max(value) OVER w) AS hi, least(50.0::DOUBLE, min(value) OVER w) AS lo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  h AS (SELECT *, CASE WHEN dir > 0 THEN price <= hi * 0.01 ELSE price >= lo * 1.99 END AS stop_hit FROM p),
  e AS (SELECT trade_id, min(ts) FILTER (stop_hit) AS last FROM h GROUP BY 1)
  SELECT trade_id, ts, round(100 * greatest(CASE WHEN dir > 0 THEN hi / 50 - 1 ELSE 1 - lo / 50 END, 0), 6) + 0.0 AS mfe_pct, round(100 * least(CASE WHEN dir > 0 THEN lo / 50 - 1 ELSE 1 - hi / 50 END, 0), 6) + 0.0 AS mae_pct, stop_hit
  FROM h JOIN e USING (trade_id) WHERE last IS NULL OR ts <= last""")
def stream_trailing_stop(spark, sf):
    """Every user's events as the prices of one trade, followed until its stop at 99 percent."""
    d = event_stream(spark, sf).select(
        F.col("user_id").alias("trade_id"), "ts", F.col("value").alias("price"), F.lit(50.0).alias("entry_price"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("direction")
    )
    return show(drain(stateful.trailing_stop(d, 99.0), "trailing-stop"), "mfe_pct", "mae_pct", "stop_hit", keys=("trade_id", "ts"))
