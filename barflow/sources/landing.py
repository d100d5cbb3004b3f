"""Landed vendor payloads (JSON, CSV, line protocol) to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.text import epoch_to_timestamp, lexicon_tone, text_to_timestamp


def venue_candles(df: DataFrame, payload: str = "payload", path: str = "result.list") -> DataFrame:
    """Exchange candle lists ``[[ms, open, high, low, close, volume, quote], ...]`` nested under ``path``."""
    fields = path.split(".")
    ddl = "ARRAY<ARRAY<STRING>>"
    for f in reversed(fields[1:]):
        ddl = f"STRUCT<{f}: {ddl}>"
    parsed = F.from_json(payload, f"{fields[0]} {ddl}")
    node = parsed
    for f in fields:
        node = node[f]
    d = df.withColumn("_row", F.explode(node)).where(F.size("_row") >= 6)
    num = lambda i: F.get("_row", F.lit(i)).try_cast("double")
    return d.select(
        *[c for c in df.columns if c != payload], F.timestamp_millis(F.get("_row", F.lit(0)).try_cast("bigint")).alias("ts"),
        *[num(i + 1).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume", "quote_volume"))],
    ).where(F.col("ts").isNotNull())


def macro_points(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Observation lists ``{"observations": [{"date", "value"}]}``; values that do not parse (".") are skipped."""
    parsed = F.from_json(payload, "observations ARRAY<STRUCT<date: STRING, value: STRING>>")
    d = df.withColumn("_o", F.explode(parsed["observations"]))
    value = F.col("_o.value").try_cast("double")
    return d.select(*[c for c in df.columns if c != payload], F.try_to_timestamp("_o.date").alias("ts"), value.alias("value")).where(
        F.col("value").isNotNull() & F.col("ts").isNotNull()
    )


def series_points(df: DataFrame, payload: str = "payload", time_field: str = "date", value_field: str = "tvl") -> DataFrame:
    """Plain arrays of ``{time, value}`` objects with epoch or ISO times (locked value, on-chain metrics, indices)."""
    parsed = F.from_json(payload, f"ARRAY<STRUCT<`{time_field}`: STRING, `{value_field}`: STRING>>")
    d = df.withColumn("_o", F.explode(parsed))
    return d.select(
        *[c for c in df.columns if c != payload], text_to_timestamp(F.col("_o")[time_field]).alias("ts"),
        F.col("_o")[value_field].try_cast("double").alias("value"),
    ).where(F.col("ts").isNotNull() & F.col("value").isNotNull())


def large_transfers(df: DataFrame, payload: str = "payload", minimum: float = 100.0) -> DataFrame:
    """On-chain transfers: value in 1e-18 units, kept from ``minimum`` whole units on."""
    parsed = F.from_json(payload, "result ARRAY<STRUCT<hash: STRING, timeStamp: STRING, value: STRING>>")
    d = df.withColumn("_t", F.explode(parsed["result"]))
    amount = F.col("_t.value").try_cast("double") / 1e18
    return d.select(
        *[c for c in df.columns if c != payload], F.col("_t.hash").alias("tx"), epoch_to_timestamp(F.col("_t.timeStamp").try_cast("bigint")).alias("ts"),
        amount.alias("amount"),
    ).where(F.col("amount") >= minimum)


def news_items(df: DataFrame, payload: str = "payload", items: str = "Data") -> DataFrame:
    """Article lists with title, url, published_on; tone is scored on the full title."""
    parsed = F.from_json(payload, f"`{items}` ARRAY<STRUCT<title: STRING, url: STRING, published_on: STRING, source: STRING, lang: STRING>>")
    d = df.withColumn("_a", F.explode(parsed[items]))
    return d.select(
        *[c for c in df.columns if c != payload], text_to_timestamp("_a.published_on").alias("ts"), F.trim("_a.title").alias("title"),
        F.col("_a.url").alias("url"), F.col("_a.source").alias("source"), F.coalesce("_a.lang", F.lit("EN")).alias("language"),
        lexicon_tone("_a.title").alias("tone"),
    ).where((F.col("title") != "") & (F.col("url") != "") & F.col("ts").isNotNull())


def archive_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Exchange archive CSV rows: epoch-ms open time, then prices; columns 6 and 11 are dropped.

    Rows whose first field is not a number (headers) or that have fewer than 11 fields are ignored.
    """
    d = lines.withColumn("_f", F.split(line, ",")).where((F.size("_f") >= 11) & F.get("_f", F.lit(0)).rlike(r"^\d+$"))
    num = lambda i, n, k="double": F.get("_f", F.lit(i)).try_cast(k).alias(n)
    return d.select(
        *[c for c in lines.columns if c != line], F.timestamp_millis(F.get("_f", F.lit(0)).try_cast("bigint")).alias("ts"),
        num(1, "open"), num(2, "high"), num(3, "low"), num(4, "close"), num(5, "volume"), num(7, "quote_volume"),
        num(8, "trades_count", "bigint"), num(9, "taker_buy_base"), num(10, "taker_buy_quote"),
    )


def line_protocol(lines: DataFrame, line: str = "line") -> DataFrame:
    """``table,tag=v field=1i,field=2.5,field="s" 170...`` lines: (table, tags, longs, doubles, strings, flags, ts).

    Field values are typed by form: ``i`` suffix whole numbers, quoted strings, true / false, else doubles
    (text that is no number stays a string).  Time is epoch nanoseconds, null if absent.
    """
    d = lines.withColumn("_p", F.split(F.trim(line), " ")).where(F.size("_p") >= 2)
    head, body = F.split(F.get("_p", F.lit(0)), ","), F.split(F.get("_p", F.lit(1)), ",")
    pairs = lambda parts: F.transform(
        F.filter(parts, lambda x: F.contains(x, F.lit("="))),
        lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.regexp_replace(x, r"^[^=]*=", "").alias("v")),
    )
    d = d.withColumns({"_tags": pairs(F.slice(head, 2, F.size(head))), "_fields": pairs(body)})
    whole = lambda f: f["v"].rlike(r"^-?\d+i$")
    quoted = lambda f: f["v"].rlike('^".*"$')
    truth = lambda f: f["v"].isin("true", "false")
    number = lambda f: ~whole(f) & ~quoted(f) & ~truth(f) & f["v"].try_cast("double").isNotNull()
    other = lambda f: ~whole(f) & ~quoted(f) & ~truth(f) & f["v"].try_cast("double").isNull()
    as_map = lambda keep, value: F.map_from_entries(F.transform(F.filter("_fields", keep), lambda f: F.struct(f["k"], value(f))))
    nanos = F.get("_p", F.lit(2)).try_cast("bigint")
    return d.select(
        *[c for c in lines.columns if c != line], F.get(head, F.lit(0)).alias("table"),
        F.map_from_entries("_tags").alias("tags"),
        as_map(whole, lambda f: F.regexp_replace(f["v"], "i$", "").cast("bigint")).alias("longs"),
        as_map(number, lambda f: f["v"].cast("double")).alias("doubles"),
        as_map(lambda f: quoted(f) | other(f), lambda f: F.btrim(f["v"], F.lit('"'))).alias("strings"),
        as_map(truth, lambda f: f["v"] == "true").alias("flags"),
        F.timestamp_micros(F.call_function("div", nanos, F.lit(1000))).alias("ts"),
    )
