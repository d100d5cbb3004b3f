"""Row-wise derivations on bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.numeric import nonzero


def taker_features(df: DataFrame) -> DataFrame:
    """Taker-buy share (0.5 if unknown) and mean trade size (0 if unknown)."""
    share = F.col("taker_buy_base") / nonzero("volume", 1e-4) if "taker_buy_base" in df.columns else F.lit(0.5)
    size = F.col("volume") / nonzero("trades_count", 1.0) if "trades_count" in df.columns else F.lit(0.0)
    return df.withColumns({"taker_buy_ratio": share, "avg_trade_size": size})


def calendar(df: DataFrame) -> DataFrame:
    """Hour, weekday (Monday = 0) and their positions on the circle."""
    d = df.withColumns({"hour": F.hour("ts"), "day_of_week": F.weekday("ts")})
    angle = lambda c, n: 2 * math.pi * F.col(c) / n
    return d.withColumns({
        "hour_sin": F.sin(angle("hour", 24)), "hour_cos": F.cos(angle("hour", 24)),
        "dow_sin": F.sin(angle("day_of_week", 7)), "dow_cos": F.cos(angle("day_of_week", 7)),
    })
