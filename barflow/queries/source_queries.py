"""Registered queries: store access, ingestion rules and payload parsing on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.plans.ordered import Series
from barflow.queries.base import TICKS_SQL, bar_series, bars, bars_sql, micros, query, r, show, sql_round, table, ticks
from barflow.queries.join_queries import NEWS_SQL, news
from barflow.queries.quality_queries import DIRTY_SQL, dirty_bars
from barflow.session import scratch_path
from barflow.sources import landing, store
from barflow.sources.snapshots import SnapshotTable


@query("store_time_slice", f"WITH {TICKS_SQL}, {bars_sql('1h')} SELECT ts, {sql_round('close, volume')} FROM bars WHERE symbol = 'view' AND ts >= epoch_us(TIMESTAMP '2024-01-10') AND ts < epoch_us(TIMESTAMP '2024-01-20')")
def store_time_slice(spark, sf):
    b = bars(spark, sf, "1h").withColumn("yyyymm", F.date_format("ts", "yyyy-MM"))
    at = lambda x: F.lit(x).cast("timestamp")
    return show(store.time_slice(b, at("2024-01-10"), at("2024-01-20"), {"symbol": "view"}, ["close", "volume"]), "close", "volume", keys=("ts",))


@query("store_parameterised_sql", "SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events WHERE value > 25.0 GROUP BY 1")
def store_parameterised_sql(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("store_events")
    d = store.run_sql(spark, "SELECT event_type, count(*) AS n, avg(value) AS mean FROM store_events WHERE value > ? GROUP BY event_type", [25.0])
    return d.withColumn("mean", r("mean"))


@query("store_unified_market", f"""WITH {TICKS_SQL}, {bars_sql('1h')}, l AS (SELECT symbol, ts, close, '/data/' || symbol || CASE WHEN volume > 50 THEN '/1h' ELSE '' END || '/yyyymm=2024-01/part-0.parquet' AS p FROM bars)
  SELECT symbol, '4h' AS timeframe, ts, round(close, 6) + 0.0 AS close, round(0.0001, 6) + 0.0 AS funding_rate FROM bars UNION ALL SELECT symbol, CASE WHEN p LIKE '%/1h/%' THEN '1h' ELSE '1s' END, ts, round(close, 6) + 0.0, NULL FROM l""")
def store_unified_market(spark, sf):
    b = bars(spark, sf, "1h")
    new = b.select("ts", "symbol", F.lit("4h").alias("timeframe"), "close", F.lit(0.0001).alias("funding_rate"))
    path = F.concat(F.lit("/data/"), F.col("symbol"), F.when(F.col("volume") > 50, "/1h").otherwise(""), F.lit("/yyyymm=2024-01/part-0.parquet"))
    old = b.select("ts", "close", path.alias("file"))
    return show(store.unified_market(new, old, F.col("file")), "close", "funding_rate", keys=("symbol", "timeframe", "ts"))


@query("store_keep_largest_volume", f"""{DIRTY_SQL} SELECT symbol, ts, id, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume FROM (SELECT symbol, ts, id, close, coalesce(CASE WHEN volume < 0 THEN NULL ELSE volume END, 0) AS volume FROM dirty)
  QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY volume DESC, id DESC) = 1""")
def store_keep_largest_volume(spark, sf):
    d = dirty_bars(spark, sf).select("symbol", "ts", "id", "close", F.when(F.col("volume") >= 0, F.col("volume")).alias("volume"))
    high = F.col("close") > 40
    return show(store.merge_second_files([d.where(high), d.where(~high)]), "id", "close", "volume")


@query("store_upsert_merge", f"""WITH {TICKS_SQL}, {bars_sql('1h')} SELECT symbol, ts, round(CASE WHEN ts >= epoch_us(TIMESTAMP '2024-01-15') THEN close * 2 ELSE close END, 6) + 0.0 AS close FROM bars""")
def store_upsert_merge(spark, sf):
    b = bars(spark, sf, "1h").select("symbol", "ts", "close")
    cut = F.lit("2024-01-15").cast("timestamp")
    new = b.where(F.col("ts") >= cut).withColumn("close", F.col("close") * 2)
    old = b.where(F.col("ts") < F.lit("2024-01-18").cast("timestamp"))
    return show(store.upsert_merge(old, new, ["symbol", "ts"]), "close")


@query("store_dedup_report", f"{DIRTY_SQL} SELECT symbol, strftime(make_timestamp(ts), '%Y-%m') AS yyyymm, count(*) AS rows_before, count(DISTINCT ts) AS rows_after, count(*) - count(DISTINCT ts) AS duplicates FROM dirty GROUP BY 1, 2")
def store_dedup_report(spark, sf):
    d = dirty_bars(spark, sf).withColumn("yyyymm", F.date_format("ts", "yyyy-MM"))
    return store.dedup_report(d, ["symbol", "ts"], ["symbol", "yyyymm"])


@query("store_load_series", f"{DIRTY_SQL} SELECT symbol, ts, round(close, 6) + 0.0 AS close FROM clean")
def store_load_series(spark, sf):
    return show(store.load_series(dirty_bars(spark, sf), ["symbol", "ts"]), "close")


@query("store_recent_bars", f"WITH {TICKS_SQL}, {bars_sql()} SELECT symbol, ts, round(close, 6) + 0.0 AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100")
def store_recent_bars(spark, sf):
    return show(store.recent_bars(bars(spark, sf), bar_series(), 100), "close")


@query("store_recent_news", f"WITH {NEWS_SQL} SELECT id, ts AS news_ts FROM news WHERE ts >= 1704067200000000 + 400 * 2580000000 - 48 * 3600000000 AND ts <= 1704067200000000 + 400 * 2580000000")
def store_recent_news(spark, sf):
    n = news(spark, sf)
    mixed = n.select("id", F.when(F.col("score") > 0, F.col("ts")).alias("ts"), F.when(F.col("score") <= 0, (F.unix_micros("ts") / 1000).cast("bigint")).alias("published_at"))
    now = F.timestamp_micros(F.lit(1_704_067_200_000_000 + 400 * 2_580_000_000))
    return store.recent_news(mixed, now, 48).select("id", micros("news_ts").alias("news_ts"))


@query("store_scrub_gaps", f"{DIRTY_SQL} SELECT symbol, count(*) FILTER (volume >= 0) AS kept, count(*) FILTER (volume < 0) AS dropped FROM dirty GROUP BY 1")
def store_scrub_gaps(spark, sf):
    d = dirty_bars(spark, sf).withColumn("low", F.when(F.col("volume") >= 0, F.col("low")))
    return store.scrub_gaps(d, ["symbol"])[1]


@query("store_series_status", f"WITH {TICKS_SQL}, {bars_sql()} SELECT symbol, count(DISTINCT strftime(make_timestamp(ts), '%Y-%m')) AS partitions, count(*) AS rows, min(ts) AS earliest, max(ts) AS latest FROM bars GROUP BY 1")
def store_series_status(spark, sf):
    return show(store.series_status(bars(spark, sf), ["symbol"]), "partitions", "rows", "earliest", "latest", keys=("symbol",))


@query("store_month_backlog", """WITH s AS (SELECT o_orderpriority AS symbol, min(o_orderdate) AS listed, max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '2000-03-10') AS last FROM orders GROUP BY 1)
  SELECT symbol, strftime(m, '%Y-%m') AS yyyymm FROM (SELECT symbol, unnest(range(greatest(date_trunc('month', listed), date_trunc('month', last) + INTERVAL 1 MONTH)::TIMESTAMP, TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) AS m FROM s)""")
def store_month_backlog(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(
        F.min("o_orderdate").alias("listed_at"), F.max(F.when(F.col("o_orderdate") < F.lit("2000-03-10").cast("timestamp"), F.col("o_orderdate"))).alias("last_ts"))
    return store.month_backlog(o.select("symbol", "listed_at"), o.select("symbol", "last_ts"), F.lit("2001-06-15").cast("date"))


def _index(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("timeframe"), F.date_format("o_orderdate", "yyyy-MM").alias("yyyymm"), (F.col("o_totalprice") * 100).alias("bytes"))
    i = store.partition_index(f)
    i = store.mark_trained(i, "base", F.col("timeframe") != "P")
    i = store.mark_trained(i, "trend", F.col("yyyymm") >= "1998-01")
    old = (F.col("yyyymm") < "1996-01") & (F.col("timeframe") == "F")
    return i.withColumns({"archived": old, "archive_url": F.when(old & (F.col("yyyymm") < "1995-07"), F.lit("s3://cold"))})


INDEX_SQL = """WITH i AS (SELECT o_orderpriority AS symbol, o_orderstatus AS timeframe, strftime(o_orderdate, '%Y-%m') AS yyyymm, sum(o_totalprice * 100) AS size FROM orders GROUP BY 1, 2, 3),
  t AS (SELECT *, (timeframe <> 'P')::INT + (yyyymm >= '1998-01')::INT AS nm, yyyymm < '1996-01' AND timeframe = 'F' AS archived, yyyymm < '1995-07' AND timeframe = 'F' AS url FROM i)"""


@query("store_archive_eligible", INDEX_SQL + " SELECT symbol, timeframe, yyyymm, nm AS models FROM t WHERE NOT archived AND nm >= 1 AND yyyymm < '2000-01'")
def store_archive_eligible(spark, sf):
    return store.archive_eligible(_index(spark, sf), F.lit("2000-01")).select("symbol", "timeframe", "yyyymm", F.size("trained_on").cast("bigint").alias("models"))


@query("store_prune_list", INDEX_SQL + " SELECT symbol, timeframe, yyyymm FROM t WHERE archived AND url")
def store_prune_list(spark, sf):
    return store.prune_list(_index(spark, sf)).select("symbol", "timeframe", "yyyymm")


@query("store_index_stats", INDEX_SQL + " SELECT count(*) AS partitions, count(*) FILTER (nm > 0) AS trained, count(*) FILTER (archived) AS archived, ROUND(sum(size) / 1e9, 2) AS size_total_gb, ROUND(sum(CASE WHEN archived THEN size ELSE 0 END) / 1e9, 2) AS size_archived_gb FROM t")
def store_index_stats(spark, sf):
    return store.index_stats(_index(spark, sf))


@query("ingestion_status", """WITH e AS (SELECT DISTINCT c_mktsegment || '_' || c_nationkey || '.csv' AS filename FROM customer), l AS (SELECT c_mktsegment || '_' || c_nationkey || '.csv' AS filename, count(*) * 100 AS size FROM customer WHERE c_nationkey < 20 GROUP BY 1),
  g AS (SELECT c_mktsegment || '_' || c_nationkey || '.csv' AS filename, count(*) * CASE WHEN c_mktsegment = 'BUILDING' THEN 99 ELSE 100 END AS fs, count(*) AS rw FROM customer WHERE c_nationkey < 15 GROUP BY filename, c_mktsegment)
  SELECT e.filename, l.size IS NOT NULL AS "exists", l.size, g.fs IS NOT NULL AS ingested, coalesce(rw, 0) AS rows, coalesce(l.size = g.fs, FALSE) AS up_to_date FROM e LEFT JOIN l USING (filename) LEFT JOIN g USING (filename)""")
def ingestion_status(spark, sf):
    c = table(spark, sf, "customer").withColumn("filename", F.concat("c_mktsegment", F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(".csv")))
    listing = c.where("c_nationkey < 20").groupBy("filename").agg((F.count(F.lit(1)) * 100).alias("size"))
    log = c.where("c_nationkey < 15").groupBy("filename", "c_mktsegment").agg(F.count(F.lit(1)).alias("rows_written")).select(
        "filename", "rows_written", (F.col("rows_written") * F.when(F.col("c_mktsegment") == "BUILDING", 99).otherwise(100)).alias("file_size_bytes"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("2024-01-01").cast("timestamp").alias("last_bar_ts"))
    return store.ingestion_status(c.select("filename").distinct(), listing, log)


@query("ingestion_new_rows", f"""WITH {TICKS_SQL}, {bars_sql('1h')} SELECT symbol, ts FROM bars WHERE symbol NOT IN ('click', 'view') OR ts > CASE symbol WHEN 'click' THEN epoch_us(TIMESTAMP '2024-01-10') ELSE epoch_us(TIMESTAMP '2024-01-20') END""")
def ingestion_new_rows(spark, sf):
    b = bars(spark, sf, "1h").withColumn("timeframe", F.lit("1h"))
    at = F.when(F.col("symbol") == "click", F.lit("2024-01-10").cast("timestamp")).when(F.col("symbol") == "view", F.lit("2024-01-20").cast("timestamp"))
    log = b.select("symbol", "timeframe").distinct().withColumn("last_bar_ts", at).where(F.col("last_bar_ts").isNotNull())
    return show(store.new_rows(b, log), keys=("symbol", "ts"))


@query("landing_venue_candles", f"WITH {TICKS_SQL} SELECT symbol, us // 1000 * 1000 AS ts, round(price, 6) + 0.0 AS open, round(price + 1, 6) + 0.0 AS high, round(volume, 6) + 0.0 AS volume FROM ticks")
def landing_venue_candles(spark, sf):
    p, s = F.col("price"), lambda c: c.cast("string")
    row = F.array(s(F.floor(F.unix_micros("ts") / 1000)), s(p), s(p + 1), s(p), s(p), s(F.col("volume")), F.lit("1"))
    t = ticks(spark, sf).select("symbol", F.to_json(F.struct(F.struct(F.array(row).alias("list")).alias("result"))).alias("payload"))
    return show(landing.venue_candles(t), "open", "high", "volume")


@query("landing_macro_points", f"WITH {TICKS_SQL} SELECT symbol AS metric, us // 86400000000 * 86400000000 AS ts, round(price, 6) + 0.0 AS value FROM ticks WHERE volume <= 90")
def landing_macro_points(spark, sf):
    ob = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("volume") > 90, ".").otherwise(F.col("price").cast("string")).alias("value"))
    t = ticks(spark, sf).select(F.col("symbol").alias("metric"), F.to_json(F.struct(F.array(ob).alias("observations"))).alias("payload"))
    return show(landing.macro_points(t), "value", keys=("metric", "ts"))


@query("landing_series_points", f"WITH {TICKS_SQL} SELECT symbol AS metric, us // 1000000 * 1000000 AS ts, round(volume, 6) + 0.0 AS value FROM ticks")
def landing_series_points(spark, sf):
    pt = F.struct(F.floor(F.unix_micros("ts") / 1_000_000).cast("string").alias("date"), F.col("volume").cast("string").alias("tvl"))
    t = ticks(spark, sf).select(F.col("symbol").alias("metric"), F.to_json(F.array(pt)).alias("payload"))
    return show(landing.series_points(t), "value", keys=("metric", "ts"))


@query("landing_large_transfers", "SELECT 'x' || o_orderkey AS tx, epoch_us(o_orderdate) AS ts, round(o_totalprice / 1000, 5) + 0.0 AS amount FROM orders WHERE o_totalprice / 1000 >= 100")
def landing_large_transfers(spark, sf):
    tx = F.struct(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("hash"), F.unix_seconds("o_orderdate").cast("string").alias("timeStamp"), (F.col("o_totalprice") * 1e15).cast("decimal(38,0)").cast("string").alias("value"))
    t = table(spark, sf, "orders").select(F.to_json(F.struct(F.array(tx).alias("result"))).alias("payload"))
    return show(landing.large_transfers(t), "amount", keys=("tx", "ts"), digits=5)


@query("landing_news_items", f"WITH {NEWS_SQL} SELECT trim(title) AS title, 'u' || id AS url, source, lang AS language, ts // 1000000 * 1000000 AS ts FROM news WHERE trim(title) <> ''")
def landing_news_items(spark, sf):
    a = F.struct("title", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.floor(F.unix_micros("ts") / 1_000_000).cast("string").alias("published_on"), "source", "lang")
    n = news(spark, sf).select(F.to_json(F.struct(F.array(a).alias("Data"))).alias("payload"))
    return landing.news_items(n).select("title", "url", "source", "language", micros().alias("ts"))


@query("landing_archive_rows", f"WITH {TICKS_SQL} SELECT symbol, us // 1000 * 1000 AS ts, round(price, 6) + 0.0 AS close, CAST(volume AS BIGINT) AS trades_count, round(taker, 6) + 0.0 AS taker_buy_base FROM ticks WHERE volume < 95")
def landing_archive_rows(spark, sf):
    s = lambda c: F.col(c).cast("string")
    first = F.when(F.col("volume") >= 95, "open_time").otherwise(F.floor(F.unix_micros("ts") / 1000).cast("string"))
    line = F.concat_ws(",", first, s("price"), s("price"), s("price"), s("price"), s("volume"), F.lit("0"), F.lit("1.5"), F.col("volume").cast("bigint").cast("string"), s("taker"), F.lit("2.5"), F.lit("0"))
    return show(landing.archive_rows(ticks(spark, sf).select("symbol", line.alias("line"))), "close", "trades_count", "taker_buy_base")


@query("landing_line_protocol", f"WITH {TICKS_SQL} SELECT 'trades' AS \"table\", symbol, id, round(price, 6) + 0.0 AS price, volume > 50 AS big, 'n/a' AS note, us AS ts FROM ticks")
def landing_line_protocol(spark, sf):
    c = F.col
    line = F.concat(F.lit("trades,symbol="), c("symbol"), F.lit(" id="), c("id").cast("string"), F.lit("i,price="), c("price").cast("string"), F.lit(",big="), (c("volume") > 50).cast("string"),
                    F.lit(',note="n/a" '), (F.unix_micros("ts") * 1000).cast("string"))
    d = landing.line_protocol(ticks(spark, sf).select(line.alias("line")))
    return d.select("table", c("tags")["symbol"].alias("symbol"), c("longs")["id"].alias("id"), r(c("doubles")["price"]).alias("price"), c("flags")["big"].alias("big"), c("strings")["note"].alias("note"), micros().alias("ts"))


# --- stores on disk: written to the scratch folder from the given tables, and read back ------------

_OHLC = "open, high, low, close, volume"


def _stored(spark, name: str, rows) -> SnapshotTable:
    return SnapshotTable(spark, scratch_path(spark, name), rows.schema)


@query("store_scan_snapshot", f"WITH {TICKS_SQL}, {bars_sql('1h')} SELECT symbol, ts, {sql_round(_OHLC)} FROM bars")
def store_scan_snapshot(spark, sf):
    """Hourly bars appended in two batches (one of them twice) and scanned."""
    b = bars(spark, sf, "1h").select("symbol", "ts", *_OHLC.split(", "))
    t = _stored(spark, "scan", b)
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    t.append(b.where(~late), "a")
    t.append(b.where(late), "b")
    t.append(b.where(late), "b")  # a batch that is there changes nothing
    return show(t.read(), *_OHLC.split(", "))


@query("store_ingest_csv", f"WITH {TICKS_SQL.replace('event_type AS symbol', chr(39) + 'ALL' + chr(39) + ' AS symbol')}, {bars_sql('1h')} SELECT symbol, '1h' AS timeframe, ts, {sql_round(_OHLC)} FROM bars")
def store_ingest_csv(spark, sf):
    """Bars of all trades as CSV, ingested twice: months that are there are skipped."""
    from barflow.operators.bars import bars_from_ticks

    b = bars_from_ticks(ticks(spark, sf).withColumn("symbol", F.lit("ALL")), "1h")
    csv, path = scratch_path(spark, "csv"), scratch_path(spark, "ingested")
    b.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *_OHLC.split(", ")).write.option("header", True).csv(csv)
    store.ingest_csv(spark, csv, path, "ALL", "1h")
    store.ingest_csv(spark, csv, path, "ALL", "1h")
    return show(spark.read.parquet(path), *_OHLC.split(", "), keys=("symbol", "timeframe", "ts"))


@query("store_upsert_snapshot", f"""WITH {TICKS_SQL}, {bars_sql('1h')} SELECT symbol, ts, round(CASE WHEN ts >= epoch_us(TIMESTAMP '2024-01-15') THEN close * 3 ELSE close END, 6) + 0.0 AS close FROM bars""")
def store_upsert_snapshot(spark, sf):
    """Upsert into the stored months; of two new rows with one key the later arrival wins."""
    b = bars(spark, sf, "1h").select("symbol", "ts", "close", F.lit(0).alias("arrived"))
    t = _stored(spark, "upsert", b)
    t.append(b.where(F.col("ts") < F.lit("2024-01-18").cast("timestamp")))
    new = b.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp"))
    twice = new.withColumns({"close": F.col("close") * 3, "arrived": F.lit(2)}).unionByName(new.withColumns({"close": F.col("close") * 2, "arrived": F.lit(1)}))
    t.upsert(twice, ["symbol", "ts"], ["arrived"])
    return show(t.read(), "close")


@query("store_compaction", f"{DIRTY_SQL} SELECT symbol, ts, id, round(close, 6) + 0.0 AS close FROM dirty QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY id) = 1")
def store_compaction(spark, sf):
    d = dirty_bars(spark, sf).select("symbol", "ts", "id", "close")
    t = _stored(spark, "compact", d)
    t.append(d.where("id % 2 = 0"))
    t.append(d.where("id % 2 = 1"))
    t.compact(["symbol", "ts"], ["id"])
    return show(t.read(), "id", "close")


@query("store_manifest_rows", f"WITH {TICKS_SQL}, {bars_sql('1h')} SELECT symbol, strftime(make_timestamp(ts), '%Y-%m') AS yyyymm, count(*) AS rows, TRUE AS has_files FROM bars GROUP BY 1, 2")
def store_manifest_rows(spark, sf):
    """Rows of the stored months from the manifest, and whether file metadata shows files for them."""
    b = bars(spark, sf, "1h").select("symbol", "ts", "close")
    t = _stored(spark, "status", b)
    t.append(b)
    sizes = t.sizes().select("symbol", "yyyymm", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("has_files"))
    return t.manifest().groupBy("symbol", "yyyymm").agg(F.sum("_rows").alias("rows")).join(sizes, ["symbol", "yyyymm"], "left")
