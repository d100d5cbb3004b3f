"""A trade's prices cost one small table, not a chain of steps on tables."""

import numpy as np
import pandas as pd

from barflow.streaming.stateful import _TrailingStops


class Held:
    """State and timers of one trade."""

    value = timer = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timer = at

    def getCurrentWatermarkInMs(self):
        return 0


def test_trailing_stop_makes_one_table_a_trade(monkeypatch):
    def never(*_, **__):
        raise AssertionError("a step on a table for each trade")

    for name in ("assign", "sort_values"):
        monkeypatch.setattr(pd.DataFrame, name, never)
    stops, held = _TrailingStops(50.0, 10, ["id", "ts", "price", "entry_price", "direction"]), Held()
    stops.handle = stops.held = held
    seconds, price = [3, 1, 2, 2, 5, 4], [90.0, 110.0, 120.0, 80.0, 30.0, 60.0]
    rows = pd.DataFrame({"id": 7, "ts": pd.to_datetime(seconds, unit="s"), "price": price, "entry_price": 100.0, "direction": 1})
    (out,) = stops.handleInputRows((7,), iter([rows]), held)
    assert out["price"].tolist() == [110.0, 120.0, 80.0, 90.0, 60.0] and out["stop_hit"].tolist() == [False] * 4 + [True]
    assert np.allclose(out["mfe_pct"], [10, 20, 20, 20, 20]) and np.allclose(out["mae_pct"], [0, 0, -20, -20, -40])
    assert held.value == (120.0, 60.0, True, 5_000_000) and held.timer == 15_000
    assert list(stops.handleInputRows((7,), iter([rows]), held)) == []
