"""Order-book level arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_of_book(df: DataFrame, depth: int) -> DataFrame:
    """Best prices and the summed quantity of the first ``depth`` levels of ``bids`` and ``asks``.

    Levels are ARRAY<STRUCT<price, qty>>, best first; an empty side gives null price and 0 volume.
    """
    qty = lambda side: F.aggregate(F.slice(f"{side}.qty", 1, depth), F.lit(0.0), lambda a, x: a + x)
    return df.withColumns({
        "p_bid": F.get("bids", F.lit(0))["price"], "p_ask": F.get("asks", F.lit(0))["price"],
        "v_bid": qty("bids"), "v_ask": qty("asks"),
        "depth": F.least(F.lit(depth), F.greatest(F.size("bids"), F.size("asks"))),
    })
