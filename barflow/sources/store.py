"""Month-partitioned Parquet tables: scans, ingestion, upserts, compaction, status."""

from __future__ import annotations

import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from barflow import schemas
from barflow.functions.text import text_to_timestamp
from barflow.operators.indicators import recent_rows
from barflow.operators.quality import keep_last
from barflow.plans.ordered import Series

# fixed values: timeframe tokens that may appear as a directory of the store
TIMEFRAMES = ["1s", "1m", "5m", "15m", "1h", "4h", "1d", "1w", "1mo", "funding", "news"]


def scan(spark: SparkSession, root: str, table: str, merge: bool = True) -> DataFrame:
    """Read a named table; a table that was never written is empty, not an error."""
    schema = schemas.schema_of(table)
    full = T.StructType([*schema.fields, *[T.StructField(p, T.StringType()) for p in schemas.partitions_of(table) if p not in schema.names]])
    try:
        return spark.read.schema(full).option("mergeSchema", str(merge).lower()).parquet(f"{root}/{table}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], full)
        raise


def register(spark: SparkSession, root: str, tables: Sequence[str] | None = None) -> None:
    """Expose the store's tables as temporary views."""
    for t in tables or schemas.COLUMNS:
        scan(spark, root, t).createOrReplaceTempView(t)


def run_sql(spark: SparkSession, text: str, args: list | dict | None = None, cap: int | None = None) -> DataFrame:
    """Parameterised read query; ``cap`` limits the rows of a query that has no LIMIT of its own."""
    df = spark.sql(text, args=args)
    bare = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", text, flags=re.DOTALL)  # a LIMIT in a comment or a string is none
    return df if cap is None or re.search(r"\blimit\b", bare, re.IGNORECASE) else df.limit(cap)


def path_tokens(path: Column) -> tuple[Column, Column]:
    """(symbol, timeframe) from a store path ``.../SYM/TF/yyyymm=...`` (or ``.../SYM/yyyymm=...``, which is 1s)."""
    tf = "|".join(TIMEFRAMES)
    nested = rf"/([^/]+)/({tf})/yyyymm=[^/]+/"
    flat = r"/([^/]+)/yyyymm=[^/]+/"
    has = path.rlike(nested)
    return (
        F.when(has, F.regexp_extract(path, nested, 1)).otherwise(F.regexp_extract(path, flat, 1)),
        F.when(has, F.regexp_extract(path, nested, 2)).otherwise("1s"),
    )


def unified_market(new: DataFrame, legacy: DataFrame, path: Column | None = None) -> DataFrame:
    """UNION ALL of both stores; the legacy one has symbol and timeframe only in its paths and no funding rate."""
    symbol, tf = path_tokens(path if path is not None else F.col("_metadata.file_path"))
    old = legacy.withColumns({"symbol": symbol, "timeframe": tf})
    cols = schemas.schema_of("market_data").names
    keep = lambda d: d.select(*[c for c in cols if c in d.columns])
    return keep(new).unionByName(keep(old), allowMissingColumns=True)


def time_slice(
    df: DataFrame, start: Column, end: Column, where: dict | None = None, columns: Sequence[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Half-open [start, end) slice in time order; the month partition is pruned by a derived predicate."""
    d = df.where((F.col("ts") >= start) & (F.col("ts") < end))
    if "yyyymm" in df.columns:
        d = d.where((F.col("yyyymm") >= F.date_format(start, "yyyy-MM")) & (F.col("yyyymm") <= F.date_format(end, "yyyy-MM")))
    for k, v in (where or {}).items():
        d = d.where(F.col(k) == v)
    if columns:
        d = d.select(*dict.fromkeys(["ts", *columns]))
    d = d.orderBy("ts")
    return d.limit(limit) if limit else d


def write_months(df: DataFrame, path: str, keys: Sequence[str], mode: str = "append", zone: str = "yyyymm") -> None:
    """Write by (keys, month): rows of one month meet in a few tasks, sorted by time so that footers prune."""
    parts = [*keys, zone]
    d = df if zone in df.columns else df.withColumn(zone, F.date_format("ts", "yyyy-MM"))
    # a day is part of the shuffle key, so a single hot month still spreads over tasks
    (
        d.repartition(*parts, F.to_date("ts")).sortWithinPartitions(*parts, "ts").write.mode(mode)
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*parts).parquet(path)
    )


def existing_months(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    try:
        return spark.read.parquet(path).select(*keys, F.col("yyyymm").cast("string").alias("yyyymm")).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            fields = [T.StructField(k, T.StringType()) for k in [*keys, "yyyymm"]]
            return spark.createDataFrame([], T.StructType(fields))
        raise


def ingest_csv(spark: SparkSession, csv: str, path: str, symbol: str, timeframe: str, skip_existing: bool = True) -> int:
    """CSV (also gzip) to month partitions; months already present are skipped whole.  Returns rows written."""
    schema = "timestamp STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
    raw = spark.read.schema(schema).option("header", True).csv(csv)
    d = raw.select(F.try_to_timestamp("timestamp").alias("ts"), "open", "high", "low", "close", "volume").where(F.col("ts").isNotNull())
    d = d.withColumns({"symbol": F.lit(symbol), "timeframe": F.lit(timeframe), "yyyymm": F.date_format("ts", "yyyy-MM")})
    keys = ["symbol", "timeframe"]
    if skip_existing:
        d = d.join(existing_months(spark, path, keys), [*keys, "yyyymm"], "left_anti")
    watch = Observation()
    write_months(d.observe(watch, F.count(F.lit(1)).alias("rows")), path, keys)
    try:
        return int(watch.get["rows"])
    except Py4JJavaError:  # nothing was left to write: the optimiser removed the plan and its metrics
        return 0


def merge_second_files(frames: Sequence[DataFrame], keys: Sequence[str] = ("symbol", "ts"), arrival: str = "id") -> DataFrame:
    """One row per key from several sources: nulls become 0 and the row with the largest volume wins."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    numeric = [f.name for f in out.schema.fields if isinstance(f.dataType, (T.DoubleType, T.LongType)) and f.name not in keys and f.name != arrival]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)) for c in numeric})
    return keep_last(out, keys, ["volume", arrival])


def upsert_merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of both; for equal keys the new row wins (the last of several new ones by order of arrival)."""
    tag = lambda d, n: d.withColumn("_age", F.lit(n))
    both = tag(old, 0).unionByName(tag(new, 1), allowMissingColumns=True)
    return keep_last(both, keys, ["_age"]).drop("_age")


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partition: Sequence[str], staging: str) -> None:
    """Keyed upsert that rewrites only the touched partitions.

    The merged partitions go to ``staging`` first, since a plan must not overwrite what it reads.
    """
    parts = [*partition, "yyyymm"]
    d = new.withColumn("yyyymm", F.date_format("ts", "yyyy-MM"))
    d = keep_last(d.withColumn("_seq", F.monotonically_increasing_id()), keys, ["_seq"]).drop("_seq")
    try:
        touched = d.select(*parts).distinct()
        current = spark.read.parquet(path)
        current = current.withColumns({p: F.col(p).cast("string") for p in parts}).join(touched, parts, "left_semi")
        d = upsert_merge(current, d, keys)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    write_months(d, staging, partition, mode="overwrite")
    write_months(spark.read.parquet(staging).withColumns({p: F.col(p).cast("string") for p in parts}), path, partition, mode="overwrite")


def dedup_report(df: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Rows before and after dropping null keys and repeated keys, per partition."""
    after = df.dropna(subset=list(keys)).groupBy(*dict.fromkeys([*group, *keys])).agg(F.count(F.lit(1)).alias("_n"))
    a = after.groupBy(*group).agg(F.count(F.lit(1)).alias("rows_after"))
    b = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows_before"))
    d = b.join(a, list(group), "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
    return d.withColumn("duplicates", F.col("rows_before") - F.col("rows_after"))


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str], partition: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Deduplicated copy (first row per key) with few files per partition; returns the before / after report.

    The counts of the written copy are checked against the report.
    """
    d = spark.read.parquet(path)
    parts = [*partition, "yyyymm"]
    d = d.withColumns({p: F.col(p).cast("string") for p in parts})
    report = dedup_report(d, keys, parts)
    write_months(keep_last(d.dropna(subset=list(keys)), keys, arrival, first=True), target, partition, mode="overwrite")
    written = spark.read.parquet(target).withColumns({p: F.col(p).cast("string") for p in parts}).groupBy(*parts).agg(F.count(F.lit(1)).alias("_w"))
    wrong = report.join(written, parts, "left").where(~F.col("rows_after").eqNullSafe(F.coalesce("_w", F.lit(0)))).limit(1).count()
    if wrong:
        raise ValueError("compacted copy does not hold the expected rows")
    return report


def load_series(df: DataFrame, keys: Sequence[str] = ("symbol", "timeframe", "ts"), arrival: Sequence[str] = ("id",)) -> DataFrame:
    """Whole series without repeated times (the last arrival wins)."""
    return keep_last(df, keys, arrival)


def recent_bars(df: DataFrame, s: Series, n: int, since: Column | None = None) -> DataFrame:
    return recent_rows(df.where(F.col("ts") >= since) if since is not None else df, s, n)


def recent_news(df: DataFrame, now: Column, hours: int) -> DataFrame:
    """News of the last hours by whichever time column a row fills (ts, published_at, timestamp)."""
    found = []
    for c in ("ts", "published_at", "timestamp"):
        if c in df.columns:
            found.append(F.col(c) if dict(df.dtypes)[c].startswith("timestamp") else text_to_timestamp(c))
    at = F.coalesce(*found)
    d = df.withColumn("news_ts", at)
    return d.where((F.col("news_ts") >= now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("news_ts") <= now))


def scrub_gaps(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(bars with all prices, kept / dropped counts)."""
    prices = ["open", "high", "low", "close"]
    bad = F.lit(False)
    for p in prices:
        bad = bad | F.col(p).isNull()
    counts = df.groupBy(*group).agg(
        F.sum((~bad).cast("bigint")).alias("kept"), F.sum(bad.cast("bigint")).alias("dropped")
    )
    return df.dropna(subset=prices), counts


def series_status(df: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Partitions, rows and time range per series; ``_metadata`` sizes are added by :func:`file_sizes`."""
    return df.groupBy(*keys).agg(
        F.count_distinct(F.date_format("ts", "yyyy-MM")).alias("partitions"), F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("earliest"), F.max("ts").alias("latest"),
    )


def file_sizes(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Bytes and files per partition, from file metadata."""
    d = spark.read.parquet(path).select(*keys, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_size").alias("_b")).distinct()
    return d.groupBy(*keys).agg(F.sum("_b").alias("bytes"), F.count(F.lit(1)).alias("files"))


def pending_files(listing: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose name and size are not in the ingestion log yet."""
    return listing.join(log.select("filename", F.col("file_size_bytes").alias("size")).distinct(), ["filename", "size"], "left_anti")


def new_rows(rows: DataFrame, log: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Rows after the last bar the log knows of their series."""
    last = log.groupBy(*keys).agg(F.max("last_bar_ts").alias("_last"))
    return rows.join(last, list(keys), "left").where(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last")


def ingestion_status(expected: DataFrame, listing: DataFrame, log: DataFrame) -> DataFrame:
    """Expected file x (exists, size, ingested, rows, up to date)."""
    done = log.groupBy("filename").agg(
        F.sum("rows_written").alias("rows"), F.max_by("file_size_bytes", "ts").alias("logged_size"), F.max("last_bar_ts").alias("last_bar_ts")
    )
    d = expected.join(listing, "filename", "left").join(done, "filename", "left")
    return d.select(
        *expected.columns, F.col("size").isNotNull().alias("exists"), "size", F.col("logged_size").isNotNull().alias("ingested"),
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce(F.col("size") == F.col("logged_size"), F.lit(False)).alias("up_to_date"),
    )


def month_backlog(series: DataFrame, last: DataFrame, now: Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Months still to load: after the last stored month, from the listing date, up to the last completed month.

    ``series`` has ``listed_at``; ``last`` has ``last_ts``.
    """
    d = series.join(last, list(keys), "left")
    after = F.add_months(F.trunc("last_ts", "month"), 1)
    begin = F.greatest(F.trunc("listed_at", "month"), after)
    stop = F.add_months(F.trunc(now, "month"), -1)
    d = d.withColumn("_a", begin).where(F.col("_a") <= stop)
    months = F.explode(F.sequence("_a", stop, F.expr("interval 1 month")))
    return d.select(*keys, months.alias("_m")).select(*keys, F.date_format("_m", "yyyy-MM").alias("yyyymm"))


# --- partition index ------------------------------------------------------------------------------

def partition_index(files: DataFrame, keys: Sequence[str] = ("symbol", "timeframe", "yyyymm")) -> DataFrame:
    """One record per partition from file rows ``(keys, bytes)``; nothing trained or archived yet."""
    return files.groupBy(*keys).agg(F.sum("bytes").alias("size_bytes")).withColumns({
        "trained_on": F.array().cast("array<string>"), "archived": F.lit(False), "archive_url": F.lit(None).cast("string")
    })


def mark_trained(index: DataFrame, model: str, where: Column) -> DataFrame:
    return index.withColumn("trained_on", F.when(where, F.array_union("trained_on", F.array(F.lit(model)))).otherwise(F.col("trained_on")))


def archive_eligible(index: DataFrame, before_month: Column, min_models: int = 1) -> DataFrame:
    return index.where(~F.col("archived") & (F.size("trained_on") >= min_models) & (F.col("yyyymm") < before_month))


def prune_list(index: DataFrame) -> DataFrame:
    """Partitions that may be deleted locally (a report; deleting stays with the operator)."""
    return index.where(F.col("archived") & F.col("archive_url").isNotNull())


def index_stats(index: DataFrame) -> DataFrame:
    gb = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / 1e9, 2)
    return index.agg(
        F.count(F.lit(1)).alias("partitions"), F.sum((F.size("trained_on") > 0).cast("bigint")).alias("trained"),
        F.sum(F.col("archived").cast("bigint")).alias("archived"), gb(F.col("size_bytes")).alias("size_total_gb"),
        gb(F.when(F.col("archived"), F.col("size_bytes"))).alias("size_archived_gb"),
    )
