import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("barflow-tests", "8", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def walk(spark):
    """Random-walk bars of two series (one much longer) as (Spark frame, pandas frame)."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    parts = []
    for sym, n in (("HOT", 700), ("COLD", 90)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        spread = np.abs(rng.normal(0, 0.5, n))
        volume = rng.integers(0, 100, n).astype(float)
        parts.append(pd.DataFrame({
            "symbol": sym, "ts": pd.date_range("2025-01-01", periods=n, freq="1h"), "open": close - 0.1, "high": close + spread,
            "low": close - spread, "close": close, "volume": volume, "trades_count": rng.integers(1, 20, n),
            "taker_buy_base": volume * rng.random(n), "funding_rate": rng.normal(0, 0.001, n),
        }))
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf), pdf
