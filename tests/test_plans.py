"""The ordered-series plans against pandas, with blocks small enough that every border is crossed."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barflow.plans.asof import asof_join
from barflow.plans.ordered import DepthCuts, Series, depth_cuts, fill_gaps, running, runs, windowed, with_position
from barflow.plans.quantiles import exact_quantiles
from barflow.plans.ranges import range_extrema
from barflow.plans.recurrence import ewm, ewm_back, linear_recurrence

LOOSE = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, values, key="a"):
    n = len(values)
    pdf = pd.DataFrame({"k": key, "ts": pd.date_range("2024-01-01", periods=n, freq="37s"), "id": range(n), "x": np.asarray(values, float)})
    return spark.createDataFrame(pdf), pdf


def test_position_counts_rows_per_series(spark, walk):
    df, pdf = walk
    s = Series.on_grid(["symbol"], "ts", 3600, rows=37)
    got = with_position(df, s, size="n").select("symbol", "ts", "_pos", "n").toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    want = pdf.sort_values(["symbol", "ts"], ignore_index=True)
    assert (got["_pos"] == want.groupby("symbol").cumcount()).all()
    assert (got["n"] == want.groupby("symbol")["ts"].transform("count")).all()


def test_position_survives_one_instant_holding_a_third_of_the_rows(spark):
    pdf = pd.DataFrame({"k": "a", "ts": pd.to_datetime(["2024-01-01"] * 400 + ["2024-01-02"] * 400).append(pd.date_range("2024-01-03", periods=400, freq="s")), "id": range(1200)})
    df = spark.createDataFrame(pdf)
    s = Series.sampled(df, ["k"], ["ts", "id"], n=8)
    assert s.cuts.ties, "the heavy instants must be cut by the tie-break column"
    got = with_position(df, s).orderBy("ts", "id").toPandas()
    assert list(got["_pos"]) == list(range(1200))
    biggest = s.cut(df).groupBy("_cut").count().agg(F.max("count")).first()[0]
    assert biggest < 400


def test_cuts_balance_skewed_time(spark):
    ts = np.concatenate([np.zeros(0), np.arange(3000), [10_000_000]])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "ts": pd.to_datetime(ts, unit="s"), "id": range(len(ts))}))
    cuts = depth_cuts(df, ["ts", "id"], 6)
    sizes = [r["count"] for r in cuts.apply(df, ["ts", "id"]).groupBy("_cut").count().collect()]
    assert max(sizes) < 1500 and isinstance(cuts, DepthCuts)


@LOOSE
@given(alpha=st.sampled_from([0.001, 1 / 14, 2 / 13, 0.5, 0.9, 1.0]), n=st.integers(1, 1500), rows=st.sampled_from([64, 1000]))
def test_ewm_matches_pandas(spark, alpha, n, rows):
    x = np.random.default_rng(n).normal(100, 5, n)
    df, pdf = frame(spark, x)
    s = Series.on_grid(["k"], "ts", 37, rows=rows)
    got = windowed(df, s, lambda d, b: ewm(d, b, "x", alpha, "y"), back=ewm_back(alpha)).orderBy("ts").toPandas()["y"]
    want = pdf["x"].ewm(alpha=alpha, adjust=False).mean()
    assert np.abs(got - want).max() < 1e-7


@LOOSE
@given(seed=st.integers(0, 10_000), n=st.integers(1, 800))
def test_linear_recurrence_matches_loop(spark, seed, n):
    rng = np.random.default_rng(seed)
    a, b = rng.choice([0.0, 1e-200, 0.2, 0.9, 1.0], n), rng.normal(0, 1, n)
    df, pdf = frame(spark, b)
    df = spark.createDataFrame(pdf.assign(a=a))
    s = Series.sampled(df, ["k"], ["ts", "id"], n=5)
    got = linear_recurrence(df, s, F.col("a"), F.col("x"), "y").orderBy("ts").toPandas()["y"].to_numpy()
    y, want = 0.0, []
    for i in range(n):
        y = b[i] if i == 0 else a[i] * y + b[i]
        want.append(y)
    assert np.allclose(got, want, atol=1e-8)


@LOOSE
@given(seed=st.integers(0, 10_000))
def test_running_and_fill_match_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(300) < 0.4, np.nan, rng.normal(0, 1, 300))
    df, pdf = frame(spark, x)
    df = df.withColumn("x", F.nanvl("x", F.lit(None)))
    s = Series.sampled(df, ["k"], ["ts", "id"], n=7)
    got = running(df, s, {"c": ("sum", F.coalesce("x", F.lit(0.0))), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}).orderBy("ts").toPandas()
    assert np.allclose(got["c"], pdf["x"].fillna(0).cumsum())
    assert np.allclose(got["m"], pdf["x"].cummax().ffill(), equal_nan=True)
    assert np.allclose(got["l"], pdf["x"].ffill(), equal_nan=True)
    back = running(df, s, {"l": ("last", F.col("x"))}, reverse=True).orderBy("ts").toPandas()
    assert np.allclose(back["l"], pdf["x"].bfill(), equal_nan=True)
    filled = fill_gaps(df, s, "x", "f").orderBy("ts").toPandas()
    assert np.allclose(filled["f"], pdf["x"].bfill().ffill(), equal_nan=True)


def test_runs_number_islands(spark):
    state = np.repeat([0, 1, 0, 1], [5, 80, 3, 12])
    df, _ = frame(spark, state)
    s = Series.on_grid(["k"], "ts", 37, rows=16)
    got = [tuple(r) for r in runs(df, s, F.col("x")).groupBy("run_id").agg(F.first("x"), F.count("*")).orderBy("run_id").collect()]
    assert got == [(1, 0.0, 5), (2, 1.0, 80), (3, 0.0, 3), (4, 1.0, 12)]


@LOOSE
@given(seed=st.integers(0, 10_000), direction=st.sampled_from(["backward", "forward", "nearest"]))
def test_asof_matches_pandas(spark, seed, direction):
    rng = np.random.default_rng(seed)
    at = lambda n: pd.to_datetime(rng.integers(0, 500, n) * 1_000_000_000).astype("datetime64[us]")
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 120, p=[0.9, 0.1]), "ts": at(120)}).sort_values("ts", ignore_index=True).reset_index(names="row")
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 80), "ts": at(80)}).drop_duplicates(["k", "ts"]).sort_values("ts", ignore_index=True)
    right["v"] = np.where(rng.random(len(right)) < 0.2, np.nan, np.arange(len(right), dtype=float))
    want = pd.merge_asof(left, right, on="ts", by="k", direction=direction)
    r = spark.createDataFrame(right).withColumn("v", F.nanvl("v", F.lit(None)))
    got = asof_join(spark.createDataFrame(left), r, ["k"], "ts", "ts", ["v"], direction=direction, prefer="earlier").orderBy("row").toPandas()
    assert np.allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_range_extrema_equals_scan(spark):
    rng = np.random.default_rng(3)
    n = 400
    keep = rng.random(n) < 0.7
    bars = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="15min"), "high": rng.normal(0, 1, n), "low": rng.normal(0, 1, n)})[keep]
    a = rng.integers(0, n, 60)
    z = np.minimum(a + rng.integers(0, 300, 60), n - 1)
    grid = pd.date_range("2024-01-01", periods=n, freq="15min")
    ranges = pd.DataFrame({"id": range(60), "symbol": "A", "start": grid[a], "stop": grid[z]})
    got = range_extrema(spark.createDataFrame(ranges), spark.createDataFrame(bars), ["symbol"], F.col("start"), F.col("stop"), 900,
                        {"hi": ("max", "high"), "lo": ("min", "low")}, ["id"]).orderBy("id").toPandas()
    for r in got.itertuples():
        inside = bars[(bars.ts >= r.start) & (bars.ts <= r.stop)]
        if len(inside):
            assert (r.hi, r.lo) == (inside.high.max(), inside.low.min())
        else:
            assert pd.isna(r.hi)


def test_exact_quantiles_match_numpy_with_heavy_ties(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(500, 7.0), rng.normal(0, 5, 801)])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x}))
    probs = [0.0, 0.05, 0.5, 0.77, 0.99, 1.0]
    got = exact_quantiles(df, ["k"], "x", probs, "q").first()["q"]
    assert np.allclose(got, np.quantile(x, probs))


def test_result_does_not_depend_on_input_partitioning(spark, walk):
    df, _ = walk
    s = Series.on_grid(["symbol"], "ts", 3600, rows=50)
    run = lambda d: windowed(d, s, lambda x, b: ewm(x, b, "close", 0.1, "y"), back=ewm_back(0.1)).orderBy("symbol", "ts").toPandas()["y"]
    base = run(df)
    for n in (1, 7):
        assert np.allclose(run(df.repartition(n)), base, atol=1e-9)


def test_null_position_column_is_kept_when_present(spark, walk):
    df, _ = walk
    s = Series.on_grid(["symbol"], "ts", 3600, rows=50)
    d = windowed(with_position(df, s), s, lambda x, b: x, back=3)
    assert "_pos" in d.columns and d.count() == df.count()
    assert "_pos" not in windowed(df, s, lambda x, b: x, back=3).columns


def test_asof_with_a_crowded_instant(spark):
    """Most left rows share one time; they are split over cuts and still all match."""
    left = pd.DataFrame({"k": "a", "ts": pd.to_datetime(["2024-01-01"] * 20 + ["2024-01-02"] * 900 + ["2024-01-03"] * 20), "row": range(940)})
    right = pd.DataFrame({"k": "a", "ts": pd.to_datetime(["2023-12-31", "2024-01-02", "2024-01-04"]), "v": [1.0, 2.0, 3.0]})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "ts", "ts", ["v"]).toPandas()
    assert got.groupby("ts")["v"].agg(["min", "max", "count"]).to_numpy().tolist() == [[1, 1, 20], [2, 2, 900], [2, 2, 20]]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("crowded", ["left", "right", "both"])
def test_asof_with_three_quarters_at_one_instant(spark, direction, crowded):
    rng = np.random.default_rng(6)
    hot = pd.Timestamp("2024-01-05")

    def side(n, name):
        ts = pd.Series(pd.to_datetime(rng.integers(1_704_067_200, 1_704_900_000, n) // 600 * 600, unit="s"))
        if crowded in (name, "both"):
            ts[rng.random(n) < 0.75] = hot
        return pd.DataFrame({"k": "a", "ts": ts, "row": range(n)})

    left, right = side(800, "left"), side(700, "right").rename(columns={"row": "v"})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "ts", "ts", ["v"], right_tie=["v"], direction=direction, prefer="later").toPandas().set_index("row")["v"]
    times, last, first = np.sort(right.ts.unique()), right.groupby("ts")["v"].max(), right.groupby("ts")["v"].min()
    for r in left.itertuples():
        before, after = times[times <= r.ts], times[times >= r.ts]
        b, a = (before[-1] if len(before) else None), (after[0] if len(after) else None)
        if direction == "backward":
            want = None if b is None else last[b]
        elif direction == "forward":
            want = None if a is None else first[a]
        else:
            want = first[a] if b is None or (a is not None and a - r.ts <= r.ts - b) else last[b]
        assert (None if pd.isna(got[r.row]) else int(got[r.row])) == (None if want is None else int(want))


@pytest.mark.parametrize("tie", ["long", "string"])
@pytest.mark.parametrize("instants,n", [(1, 2400), (500, 2000)])
def test_crowded_instants_are_cut(spark, instants, n, tie):
    from barflow.plans.ordered import depth_cuts

    rows = 8000
    at = F.when(F.col("id") % 4 < 3, (F.col("id") % instants) * 1000).otherwise(F.col("id") * 7).cast("long")
    df = spark.range(rows).select(at.alias("ts"), F.concat(F.lit("https://www.example.org/it's/"), F.lpad(F.xxhash64("id").cast("string"), 20, "0")).alias("u") if tie == "string" else F.xxhash64("id").alias("u"))
    cut = depth_cuts(df, ["ts", "u"], n).apply(df, ["ts", "u"]).cache()
    assert cut.columns == ["ts", "u", "_cut"]
    # cuts follow the order, and none is much larger than its share
    got = [r["_cut"] for r in cut.orderBy("ts", "u").collect()]
    assert got == sorted(got)
    assert cut.groupBy("_cut").count().agg(F.max("count")).first()[0] <= max(60, 12 * rows / n)


@pytest.mark.parametrize("n", [50, 6000])
def test_first_passage_equals_scan(spark, n):
    from barflow.plans.ranges import first_passage, pyramid

    rng = np.random.default_rng(n)
    slots = np.sort(rng.choice(3 * n, n, replace=False)) + 1_000_000
    value = np.cumsum(rng.normal(0, 1, n))
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "slot": slots, "v": value}))
    p = pyramid(bars, ["symbol"], F.col("slot"), {"lo": ("min", "v"), "hi": ("max", "v")})
    assert len(p.levels) == (2 if n == 50 else 3)
    q = pd.DataFrame({"id": range(200), "symbol": ["A"] * 190 + ["B"] * 10, "at": rng.integers(slots[0] - 99, slots[-1] + 99, 200), "low": rng.choice(value, 200) - 5, "high": rng.choice(value, 200) + 5})
    low, high = F.when(F.col("id") % 3 != 0, F.col("low")), F.when(F.col("id") % 5 != 0, F.col("high"))
    got = {r["id"]: r["hit"] for r in first_passage(spark.createDataFrame(q), p, F.col("at"), low, high, "hit").collect()}
    assert len(got) == 200
    for r in q.itertuples():
        ok = (slots >= r.at) & (((value <= r.low) & (r.id % 3 != 0)) | ((value >= r.high) & (r.id % 5 != 0)))
        assert got[r.id] == (int(slots[ok][0]) if r.symbol == "A" and ok.any() else None)


def test_order_statistics_of_hot_and_narrow_groups(spark):
    from barflow.plans.quantiles import order_statistics, value_counts

    rng = np.random.default_rng(8)
    v = np.concatenate([np.round(rng.normal(0, 3, 3000), 2), np.full(2000, 1.25), rng.normal(1e6, 1e-3, 800)])
    g = np.array(["a"] * 5000 + ["b"] * 800)
    counts = value_counts(spark.createDataFrame(pd.DataFrame({"g": g, "v": v})), ["g"], "v").cache()
    ranks = {"a": [0, 4999, 2500, 17, 4000, 4001], "b": [0, 799, 400]}
    got = order_statistics(counts, ["g"], "v", spark.createDataFrame(list(ranks.items()), "g string, _ranks array<bigint>")).collect()
    assert {(r["g"], r["_rank"]): r["_value"] for r in got} == {(k, i): float(np.sort(v[g == k])[i]) for k, x in ranks.items() for i in x}


def test_wasserstein_equals_a_scan(spark):
    from barflow.operators import drift as D

    rng = np.random.default_rng(2)
    frames = {"shift": (rng.normal(0, 1, 900), rng.normal(0.7, 1.3, 700)), "ties": (rng.integers(0, 4, 500) * 1.0, rng.integers(1, 9, 300) * 1.0), "same": (np.full(50, 7.0), np.full(60, 7.0)), "apart": (rng.normal(0, 1, 400), rng.normal(50, 1, 100))}
    long = lambda i: spark.createDataFrame([("c", k, float(x)) for k, p in frames.items() for x in p[i]], "cell string, feature string, value double")
    base = D.baseline(long(0), ["cell"])
    got = {r["feature"]: r["wasserstein_rel"] for r in D.wasserstein_relative(base, long(1), ["cell"]).collect()}
    for b in base.collect():
        edges, u = np.array(b["bin_edges"]), np.array(b["bin_props"])
        mids, x = (edges[1:] + edges[:-1]) / 2, np.sort(frames[b["feature"]][1])
        points = np.sort(np.concatenate([mids, x]))
        at = points[:-1]
        f, h = np.array([u[mids <= p].sum() for p in at]), np.searchsorted(x, at, "right") / len(x)
        assert got[b["feature"]] == pytest.approx((np.abs(f - h) * np.diff(points)).sum() / (edges[-1] - edges[0]), rel=1e-6)


def test_tail_risk_spreads_its_scenarios(spark, monkeypatch):
    """The product of books and instants is not made in one task; unknown returns and weights count for nothing."""
    from barflow.operators import stats

    rng = np.random.default_rng(5)
    rets = [(f"s{k}", t, None if rng.random() < 0.2 else float(rng.normal())) for t in range(60) for k in range(3)] + [("s9", 99, 1.0)]
    weights = [(b, f"s{k}", None if (b, k) == (3, 1) else float(rng.random())) for b in range(20) for k in range(3) if (b + k) % 4]
    tasks, real = [], stats.reliable_checkpoint

    def kept(df):
        df = real(df)
        tasks.append(df.groupBy(F.spark_partition_id()).count().count())
        return df

    monkeypatch.setattr(stats, "reliable_checkpoint", kept)
    got = {r["book"]: r for r in stats.tail_risk(spark.createDataFrame(rets, "symbol string, ts long, ret double"), spark.createDataFrame(weights, "book long, symbol string, weight double")).collect()}
    for b in range(20):
        own = {s: w for x, s, w in weights if x == b and w is not None}
        x = {}
        for s, t, v in rets:
            if s in own and v is not None:
                x[t] = x.get(t, 0.0) + v * own[s]
        x = np.array(list(x.values()))
        var = np.quantile(x, 0.05)
        assert got[b]["n_scenarios"] == len(x)
        assert np.allclose([got[b]["var"], got[b]["cvar"], got[b]["expected_return"]], [var, x[x <= var].mean(), x.mean()])
    assert tasks[0] > 1


def test_drift_does_not_join_features_in_one_task(spark):
    """Values meet their feature's edges without a sort by the few (cell, feature) keys."""
    from barflow.operators import drift
    from barflow.session import reliable_checkpoint

    counts = spark.createDataFrame([("a", "f", float(i), 1) for i in range(50)], "cell string, feature string, value double, _n long")
    edges = spark.createDataFrame([("a", "f", [0.0, 20.0, 60.0])], "cell string, feature string, bin_edges array<double>")
    d = drift.bin_shares(reliable_checkpoint(counts), reliable_checkpoint(edges), ["cell", "feature"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and d.first()["bin_props"] == [0.4, 0.6]
