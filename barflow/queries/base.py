"""Shared inputs of the registered queries and the SQL text that mirrors them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators.bars import TIMEFRAME_SECONDS, bars_from_ticks
from barflow.plans.ordered import Series
from barflow.session import use_utc

# Both sides add this before rounding for comparison, so that a value that is an exact decimal tie
# (34.260625 at five digits) cannot fall to different sides because of the order of a sum.
# ``ROUND`` in upper case in SQL is a rounding that belongs to the operator and is left alone.
NUDGE = 3e-9

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` together with its DuckDB equivalent."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = re.sub(r"\bround\((?!3e-09)", f"round({NUDGE!r} + ", sql)
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def ticks(spark: SparkSession, sf: str, symbol: str = "event_type") -> DataFrame:
    """Trades: the event stream as (symbol, ts, id, price, volume, taker)."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select(
        F.col(symbol).alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"),
        k.alias("volume"), (k * k / 100.0).alias("taker"),
    )


def bars(spark: SparkSession, sf: str, timeframe: str = "15m", symbol: str = "event_type") -> DataFrame:
    return bars_from_ticks(ticks(spark, sf, symbol), timeframe)


def bar_series(timeframe: str = "15m") -> Series:
    return Series.on_grid(["symbol"], "ts", TIMEFRAME_SECONDS[timeframe])


def micros(c: str | Column = "ts") -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def r(c: str | Column, n: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(F.lit(NUDGE) + (F.col(c) if isinstance(c, str) else c), n) + 0.0


def show(df: DataFrame, *cols: str, digits: int = 6, keys: tuple = ("symbol", "ts")) -> DataFrame:
    """Keys (timestamps as epoch microseconds) plus rounded doubles and plain other columns."""
    kinds = dict(df.dtypes)
    out = []
    for c in (*keys, *cols):
        kind = kinds[c]
        if kind.startswith("timestamp"):
            out.append(micros(c).alias(c))
        elif kind in ("double", "float"):
            out.append(r(F.col(c).cast("double"), digits).alias(c))
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            out.append(F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


TICKS_SQL = """
ticks AS (
  SELECT event_type AS symbol, user_id, ts, epoch_us(ts) AS us, event_id AS id, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS taker
  FROM events)"""


def bars_sql(timeframe: str = "15m", name: str = "bars") -> str:
    """CTE of bars with bar start ``ts`` in epoch microseconds and row number ``i`` (from 0)."""
    if timeframe == "1mo":
        start = "epoch_us(date_trunc('month', ts))"
    elif timeframe == "1w":
        start = "epoch_us(date_trunc('week', ts))"
    else:
        width = TIMEFRAME_SECONDS[timeframe] * 1_000_000
        start = f"us - us % {width}"
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM (
    SELECT symbol, {start} AS ts, arg_min(price, us) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, us) AS close, sum(volume) AS volume, sum(price * volume) AS quote_volume,
           count(*) AS trades_count, sum(taker) AS taker_buy_base, sum(price * taker) AS taker_buy_quote
    FROM ticks GROUP BY 1, 2))"""


def sql_round(cols: str, digits: int = 6) -> str:
    """`a, b` -> rounded expressions with their names (``expr AS name`` is kept as name)."""
    out = []
    for c in (x.strip() for x in cols.split(",")):
        out.append(f"round({c}, {digits}) + 0.0 AS {c}")
    return ", ".join(out)
