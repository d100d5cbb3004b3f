"""Structured Streaming jobs: events to bars and snapshots, late data, sinks, topics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barflow import schemas
from barflow.functions.book import top_of_book
from barflow.operators.bars import TIMEFRAME_SECONDS
from barflow.operators.quality import keep_last
from barflow.sources.snapshots import SnapshotTable

DEPTH = "stream STRING, data STRUCT<E: BIGINT, bids: ARRAY<ARRAY<STRING>>, asks: ARRAY<ARRAY<STRING>>>"


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", glob: str | None = None,
               files_per_trigger: int | None = None) -> DataFrame:
    """File stream with an explicit schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def closed_bars(events: DataFrame, value: str = "value") -> DataFrame:
    """Finished candles of kline events ``btcusdt@kline_1m``; running candles are ignored.

    Fields differ only by case (v / V), so they are read by path instead of through a schema.
    """
    at = lambda path: F.get_json_object(value, f"$.{path}")
    k = lambda c: at(f"data.k.{c}")
    num = lambda c, n: k(c).try_cast("double").alias(n)
    d = events.where(k("x") == "true")
    return d.select(
        F.timestamp_millis(k("t").try_cast("bigint")).alias("ts"), F.upper(F.split_part(at("stream"), F.lit("@"), F.lit(1))).alias("symbol"),
        F.regexp_extract(at("stream"), r"@kline_(\w+)$", 1).alias("timeframe"), num("o", "open"), num("h", "high"), num("l", "low"),
        num("c", "close"), num("v", "volume"), k("n").try_cast("bigint").alias("trades_count"), num("V", "taker_buy_base"), num("Q", "taker_buy_quote"),
    )


def depth_snapshots(events: DataFrame, depth: int = 5, value: str = "value") -> DataFrame:
    """Top-of-book rows with a ``reason`` column: null for good rows, why a row is unusable otherwise."""
    d = events.select(F.from_json(value, DEPTH).alias("e"))
    levels = lambda side: F.transform(
        F.coalesce(F.col(f"e.data.{side}"), F.array().cast("array<array<string>>")),
        lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty")),
    )
    d = d.select(
        F.upper(F.split_part(F.col("e.stream"), F.lit("@"), F.lit(1))).alias("symbol"), F.col("e.data.E").alias("ts"),
        levels("bids").alias("bids"), levels("asks").alias("asks"),
    )
    d = top_of_book(d, depth)
    reason = (
        F.when(F.col("symbol").isNull() | (F.col("symbol") == ""), "no symbol").when(F.coalesce("ts", F.lit(0)) <= 0, "no time")
        .when(F.col("p_bid").isNull() | F.col("p_ask").isNull(), "empty side")
    )
    return d.select("ts", "symbol", "p_bid", "p_ask", "v_bid", "v_ask", "depth", reason.alias("reason"))


def partitioned_sink(df: DataFrame, path: str, checkpoint: str, partition: Sequence[str], every: str | None = "30 seconds") -> StreamingQuery:
    """Append to partitioned Parquet; the checkpoint makes it exactly-once.  ``every=None`` drains what is there and stops."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.partitionBy(*partition) if partition else w
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def split_sink(df: DataFrame, good_path: str, bad_path: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Good snapshots to month partitions, rejected ones to their own table; keyed by batch, so a retry overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id))
        good = batch.where("reason is null").drop("reason").withColumn("yyyymm", F.date_format(F.timestamp_millis("ts"), "yyyy-MM"))
        mode = lambda d: d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        mode(good).partitionBy("batch_id", "symbol", "yyyymm").parquet(good_path)
        mode(batch.where("reason is not null")).partitionBy("batch_id").parquet(bad_path)

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def drop_late_repeats(df: DataFrame, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """First arrival per key within the watermark; state is bounded by the delay."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def window_bars(ticks: DataFrame, timeframe: str, delay: str = "10 minutes", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Tumbling OHLCV bars, emitted once the watermark passes their end."""
    at = F.struct("ts", "id")
    agg = ticks.withWatermark("ts", delay).groupBy(*keys, F.window("ts", f"{TIMEFRAME_SECONDS[timeframe]} seconds").alias("_w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trades_count"),
    )
    return agg.select(*keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "trades_count")


def sliding_mean(df: DataFrame, value: str, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    agg = df.withWatermark("ts", delay).groupBy(*keys, F.window("ts", length, slide).alias("_w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return agg.select(*keys, F.col("_w.end").alias("ts"), "mean", "n")


# --- topics ---------------------------------------------------------------------------------------

def publish(df: DataFrame, root: str, topic: str) -> None:
    """Append rows to a topic as JSON lines in daily folders."""
    body = df.withColumn("day", F.date_format(F.coalesce(F.col("ts"), F.current_timestamp()), "yyyy-MM-dd"))
    body.write.mode("append").partitionBy("day").json(f"{root}/{topic}")


def consume(spark: SparkSession, root: str, topic: str, schema: T.StructType | str) -> DataFrame:
    """A topic as a stream; every consumer keeps its own checkpoint, a new checkpoint replays from the start."""
    return spark.readStream.schema(schema).json(f"{root}/{topic}")


def topic_stats(spark: SparkSession, root: str, topic: str) -> DataFrame:
    """Bytes, lines, days and last append of a topic, from its files."""
    d = spark.read.text(f"{root}/{topic}").select("day", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"), F.col("_metadata.file_modification_time").alias("m"))
    files = d.groupBy("f").agg(F.first("b").alias("b"), F.max("m").alias("m"), F.count(F.lit(1)).alias("n"), F.first("day").alias("day"))
    return files.agg(F.sum("b").alias("bytes"), F.sum("n").alias("lines"), F.count_distinct("day").alias("days"), F.max("m").alias("last_append"))


def route_topics(messages: DataFrame, routes: dict[str, str], root: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Bus messages ``(topic, value JSON)`` to the tables named in ``routes``; one pass over each batch.

    Output is keyed by batch id, so a replayed batch replaces what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for topic, table in routes.items():
                ddl = schemas.schema_of(table)
                rows = batch.where(F.col("topic") == topic).select(F.from_json("value", _loose(ddl)).alias("r")).select("r.*")
                typed = schemas.with_partitions(schemas.coerce(rows, table), table).withColumn("batch_id", F.lit(batch_id))
                typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *schemas.partitions_of(table)).parquet(f"{root}/{table}")
        finally:
            batch.unpersist()

    w = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _loose(schema: T.StructType) -> T.StructType:
    """All-string version of a schema: casting is left to the coercion rules."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


# --- scheduled batches ----------------------------------------------------------------------------

def rollover_rows(hot: DataFrame, day: Column) -> DataFrame:
    """Rows of one calendar day, one per series and time, ready for the cold store's upsert."""
    d = hot.where((F.col("ts") >= day) & (F.col("ts") < day + F.expr("INTERVAL 1 DAY")))
    return keep_last(d, ["symbol", "timeframe", "ts"], ["arrived"]) if "arrived" in hot.columns else d


def stale_agents(heartbeats: DataFrame, now: Column, seconds: float, key: str = "agent") -> DataFrame:
    """Newest heartbeat per agent and whether it is older than allowed."""
    d = heartbeats.groupBy(key).agg(F.max("ts").alias("last_ts"), F.max_by("status", "ts").alias("status"))
    lag = (F.unix_micros(now) - F.unix_micros("last_ts")) / 1_000_000
    return d.withColumn("lag_s", lag).withColumn("stale", F.col("lag_s") > seconds)


def snapshot_sink(stream: DataFrame, tables: Sequence[tuple[SnapshotTable, Callable[[DataFrame], DataFrame]]], checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """A stream into several tables, each with the part of the batch that its function picks.

    Every table commits a micro-batch by its number, so a batch that is replayed after a failure adds nothing where it had been committed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for target, pick in tables:
                target.append(pick(batch), f"{batch_id:020d}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def live_news(stream: DataFrame, view: str, checkpoint: str, path: str, hours: int = 48, every: str | None = "5 minutes") -> StreamingQuery:
    """Keep the global view ``global_temp.<view>`` over the last hours of news.

    Each refresh appends its batch to a snapshot table by month and re-points the view; the view opens only the months that its window touches.
    """
    spark = stream.sparkSession
    news = SnapshotTable(spark, path, T.StructType([*stream.schema.fields, T.StructField("_all", T.StringType())]), ["_all"])

    def point() -> None:
        months = [r["yyyymm"] for r in news.manifest().select("yyyymm").distinct().orderBy(F.desc("yyyymm")).where("yyyymm <> 'unknown'").limit(1).collect()]
        newest = news.read(where=lambda m: m.where(F.col("yyyymm").isin(months))).agg(F.max("ts")).first()[0] if months else None
        since = F.lit(newest).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
        window = news.read(where=news.months(since, F.lit(newest))) if newest else news.read()
        window.where(F.col("ts") >= since).select(*stream.columns).createOrReplaceGlobalTempView(view)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        news.append(batch.withColumn("_all", F.lit("news")), f"{batch_id:020d}")
        point()

    point()  # the view is there before the first batch, and after a restart without new items
    w = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
