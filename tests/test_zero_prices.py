"""Prices of zero: columns against their SQL, where ratios become infinite."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry_point


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Events of two symbols, one each 15 minutes, some of them at zero."""
    path, start = str(tmp_path_factory.mktemp("zero")), datetime.datetime(2024, 1, 1)
    rows = []
    for n, symbol in enumerate(("a", "b")):
        for i in range(260):
            price = 0.0 if i in (3, 90, 91, 200) else 10.0 + (i * 7 + n) % 13
            rows.append((1000 * n + i, start + datetime.timedelta(minutes=15 * i, seconds=n), i % 5, symbol, price, f'{{"k": {(i * 37) % 90 + 5}}}'))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def both(spark, tables, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tables}/events.parquet/*.parquet'")
    res = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in res.description]
    got = entry_point.queries()[name](spark, tables).select(*names).collect()
    return sorted(map(str, map(tuple, got))), sorted(map(str, res.fetchall())), names


def test_price_shape_over_zero_levels(spark, tables):
    got, want, _ = both(spark, tables, "indicator_price_shape")
    assert got == want and any("inf" in x for x in want)


def test_volatility_with_a_return_to_zero(spark, tables):
    got, want, _ = both(spark, tables, "indicator_volatility_size")
    assert got == want and any("nan" in x for x in want)


def test_excursions_of_an_entry_at_zero(spark, tables):
    got, want, _ = both(spark, tables, "trade_excursions")
    assert got == want and any("inf" in x for x in want)


def test_excursions_of_repeated_trades_and_of_one_without_an_exit(spark, tmp_path):
    """Copies of an id are one trade where direction and price agree, else trades of their own; a missing volume leaves no exit."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i // 2, start + datetime.timedelta(minutes=15 * (i * 5 % 80)), 1, "ab"[i % 2], 10.0 + i // 4 % 3 + (i % 8 == 1), f'{{"k": {(i // 2 * 37) % 90 + 5}}}' if i != 9 else "{}") for i in range(80)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got, want, _ = both(spark, str(tmp_path), "trade_excursions")
    assert got == want and 40 < len(want) < 79
