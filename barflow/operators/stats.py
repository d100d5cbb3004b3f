"""Cross-series statistics, calibration of mean reversion, and classifier / threshold metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.numeric import at_least, clip, flag, normal_cdf, ratio
from barflow.operators.indicators import bar_return, recent_rows
from barflow.plans.ordered import Series, running, windowed, with_position
from barflow.plans.quantiles import quantiles_of_counts, value_counts
from barflow.session import reliable_checkpoint


def returns(df: DataFrame, s: Series, col: str = "close", out: str = "ret") -> DataFrame:
    return windowed(df, s, lambda d, b: d.withColumn(out, bar_return(b, 1, col)), back=1)


def against_factor(rets: DataFrame, factor: str) -> DataFrame:
    """Every series' return next to the factor's return at the same time (at most one factor row per time)."""
    f = rets.where(F.col("symbol") == factor).select("ts", F.col("ret").alias("factor_ret"))
    return rets.join(f, "ts").where(F.col("ret").isNotNull() & F.col("factor_ret").isNotNull())


def factor_betas(rets: DataFrame, factor: str) -> DataFrame:
    """Slope of each series on the factor: 1 for the factor itself, 0 where the factor does not move."""
    d = against_factor(rets, factor).groupBy("symbol").agg(
        F.covar_pop("ret", "factor_ret").alias("_c"), F.var_pop("factor_ret").alias("_v"), F.count(F.lit(1)).alias("n")
    )
    beta = F.when(F.col("symbol") == factor, 1.0).otherwise(F.coalesce(F.try_divide("_c", "_v"), F.lit(0.0)))
    return d.select("symbol", "n", beta.alias("beta"))


def portfolio_beta(positions: DataFrame, betas: DataFrame, limit: float = 0.3, keys: Sequence[str] = ()) -> DataFrame:
    """Notional-weighted beta of positions ``(symbol, side, notional)`` per book, and whether it breaches the limit.

    Unknown symbols count with beta 1.  A hypothetical trade is one more position row.
    """
    signed = F.when(F.col("side") == "long", F.col("notional")).otherwise(-F.col("notional"))
    d = positions.join(betas.select("symbol", "beta"), "symbol", "left").withColumn("_s", signed)
    agg = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_positions"), F.sum(F.abs("_s")).alias("_gross"),
        F.sum(F.col("_s") * F.coalesce("beta", F.lit(1.0))).alias("_net"),
    )
    total = F.when(F.col("_gross") == 0, 1.0).otherwise(F.col("_gross"))
    d = agg.withColumn("aggregate_beta", F.col("_net") / total)
    return d.select(*keys, "n_positions", "aggregate_beta", (F.abs("aggregate_beta") > limit).alias("breach"))


def benchmark_correlation(df: DataFrame, s: Series, benchmark: str, bars: int = 168, floor: float = 0.3) -> DataFrame:
    """Correlation with the benchmark over the last ``bars`` bars; flags a breakdown below ``floor``."""
    rets = returns(recent_rows(df, s, bars), s)
    d = against_factor(rets, benchmark).where(F.col("symbol") != benchmark).groupBy("symbol").agg(
        F.corr("ret", "factor_ret").alias("corr"), F.count(F.lit(1)).alias("n")
    )
    return d.where("n >= 10").withColumn("breakdown", F.col("corr") < floor)


def mean_pairwise_correlation(rets: DataFrame) -> DataFrame:
    """Mean correlation over all pairs of series, without forming a pair.

    With z-scores over the times all series share, the sum of all correlations is the
    variance of the sum of z-scores; the n ones of the diagonal are taken out.
    """
    d = rets.where(F.col("ret").isNotNull())
    full = d.groupBy("ts").agg(F.count(F.lit(1)).alias("_n"))
    width = d.agg(F.count_distinct("symbol")).scalar()
    times = full.where(F.col("_n") == width).select("ts", F.col("_n").alias("_width"))
    d = d.join(times, "ts")
    moments = d.groupBy("symbol").agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"))
    z = d.join(moments, "symbol").withColumn("_z", F.try_divide(F.col("ret") - F.col("_m"), "_s"))
    per_ts = z.groupBy("ts").agg(F.sum("_z").alias("_sum"), F.first("_width").alias("_width"))
    n = F.first("_width")
    total = F.sum(F.col("_sum") * F.col("_sum")) / (F.count(F.lit(1)) - 1)
    return per_ts.agg(
        n.alias("n_series"), F.count(F.lit(1)).alias("n_times"), ((total - n) / (n * (n - 1))).alias("mean_corr")
    )


def risk_parity(assets: DataFrame, mean_corr: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Weights from conviction (prob - 0.5) * 2 over volatility, scaled by 1 - mean correlation, absolute sum 1."""
    penalty = mean_corr.select(F.greatest(1 - F.col("mean_corr"), F.lit(0.0))).scalar()
    d = assets.withColumn("_w", (F.col("prob") - 0.5) * 2 / F.greatest("vol", F.lit(eps)) * penalty)
    d = d.withColumn("_norm", d.agg(F.sum(F.abs("_w"))).scalar())
    return d.withColumn("weight", F.when(F.col("_norm") > eps, F.try_divide("_w", "_norm")).otherwise(F.col("_w"))).drop("_w", "_norm")


def ou_calibration(df: DataFrame, s: Series, dt: float = 1.0) -> DataFrame:
    """theta, mu, sigma and a +/-2 sigma signal per series from the AR(1) fit of its closes."""
    d = windowed(df, s, lambda x, b: x.withColumn("_x", b.lag("close")), back=1)
    pair = F.col("_x").isNotNull()
    y, x = F.when(pair, F.col("close")), F.col("_x")
    agg = d.groupBy(*s.keys).agg(
        F.covar_pop(y, x).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.avg(y).alias("_my"),
        F.avg(x).alias("_mx"), F.avg("close").alias("_mean"), F.stddev_pop("close").alias("_sd"),
        F.max_by("close", F.struct(*s.order)).alias("_last"), F.count(F.lit(1)).alias("n"),
    ).where("n >= 2")
    agg = agg.withColumn("_b", F.try_divide("_c", "_vx"))
    agg = agg.withColumn("_resid", F.sqrt(F.greatest(F.col("_vy") - F.col("_b") * F.col("_c"), F.lit(0.0))))
    ok = (F.col("_b") > 0) & (F.col("_b") < 1)
    theta = F.when(ok, -F.ln(F.when(ok, F.col("_b"))) / dt).otherwise(0.0)
    agg = agg.withColumn("theta", theta)
    mu = F.when(ok, (F.col("_my") - F.col("_b") * F.col("_mx")) / (1 - F.col("_b"))).otherwise(F.col("_mean"))
    sigma = F.when(
        ok, F.try_divide("_resid", F.sqrt(F.try_divide(1 - F.col("_b") * F.col("_b"), 2 * F.col("theta"))))
    ).otherwise(F.col("_sd"))
    agg = agg.withColumns({"mu": mu, "sigma": sigma})
    dev = F.col("_last") - F.col("mu")
    signal = F.when(~F.coalesce(ok, F.lit(False)), 0).when(dev > 2 * F.col("sigma"), -1).when(dev < -2 * F.col("sigma"), 1).otherwise(0)
    return agg.select(*s.keys, "n", "theta", "mu", "sigma", signal.alias("signal"))


def quant_matrix(df: DataFrame, s: Series, last: int = 200, min_rows: int = 50) -> DataFrame:
    """Per series over its last bars: deviation from the AR(1) mean in residual sigmas, volatility flag, signal.

    The slope divides the sample covariance by the population variance, as the matrix it reproduces does.
    """
    d = windowed(
        recent_rows(df, s, last), s,
        lambda x, b: x.withColumns({"_x": b.lag("close"), "_r": bar_return(b), "_at": F.col("_pos")}), back=1,
    )
    n = d.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    d = d.join(n, list(s.keys))
    tail = lambda k: F.stddev_samp(F.when(F.col("_at") >= F.col("n") - k, F.col("_r"))) * 100
    y = F.when(F.col("_x").isNotNull(), F.col("close"))
    agg = d.groupBy(*s.keys, "n").agg(
        F.covar_samp(y, "_x").alias("_cs"), F.covar_pop(y, "_x").alias("_cp"), F.var_pop("_x").alias("_vx"),
        F.var_pop(y).alias("_vy"), F.avg(y).alias("_my"), F.avg("_x").alias("_mx"), F.avg("close").alias("_mean"),
        F.max_by("close", F.struct(*s.order)).alias("_last"), tail(5).alias("vol5"),
        F.when(F.col("n") > 60, tail(60)).otherwise(0.0).alias("vol60"),
    )
    b = F.try_divide("_cs", "_vx")
    agg = agg.withColumn("_b", b)
    mu = F.when(F.abs(1 - F.col("_b")) > 1e-9, F.try_divide(F.col("_my") - F.col("_b") * F.col("_mx"), 1 - F.col("_b"))).otherwise(F.col("_mean"))
    var = F.col("_vy") - 2 * F.col("_b") * F.col("_cp") + F.col("_b") * F.col("_b") * F.col("_vx")
    agg = agg.withColumns({"_mu": mu, "_sg": F.sqrt(F.greatest(var, F.lit(0.0)))})
    dev = F.when(F.col("_sg") > 0, (F.col("_last") - F.col("_mu")) / F.col("_sg")).otherwise(0.0)
    agg = agg.withColumn("ou_dev", dev)
    return agg.select(
        *s.keys, "n", "ou_dev", "vol60", F.when(F.col("vol5") > F.col("vol60") * 1.8, "HIGH").otherwise("NORMAL").alias("vol_flag"),
        F.when(F.col("ou_dev") <= -2.5, "OVERSOLD").when(F.col("ou_dev") >= 2.5, "OVERBOUGHT").otherwise("NEUTRAL").alias("signal"),
    )


def pair_spread(df: DataFrame, asset_a: str, asset_b: str, min_rows: int = 30) -> DataFrame:
    """Hedge ratio of a on b at common times, z-score of the newest spread, and a +/-2 signal.

    The spread's moments follow from those of both legs, so the pair is aggregated once.
    """
    leg = lambda sym, out: df.where(F.col("symbol") == sym).select("ts", F.col("close").alias(out))
    d = leg(asset_a, "a").join(leg(asset_b, "b"), "ts")
    agg = d.agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("a", "b").alias("_c"), F.var_pop("b").alias("_vb"), F.var_pop("a").alias("_va"),
        F.avg("a").alias("_ma"), F.avg("b").alias("_mb"), F.max_by("a", "ts").alias("_la"), F.max_by("b", "ts").alias("_lb"),
    ).where(F.col("n") >= min_rows)
    agg = agg.withColumn("hedge_ratio", F.try_divide("_c", "_vb"))
    h = F.col("hedge_ratio")
    sd = F.sqrt(F.greatest(F.col("_va") - 2 * h * F.col("_c") + h * h * F.col("_vb"), F.lit(0.0)))
    z = (F.col("_la") - h * F.col("_lb") - (F.col("_ma") - h * F.col("_mb"))) / sd
    agg = agg.withColumn("z_score", F.when(sd > 0, z).otherwise(0.0))
    signal = F.when(F.col("z_score") > 2, -1).when(F.col("z_score") < -2, 1).otherwise(0)
    return agg.select("n", "hedge_ratio", "z_score", signal.alias("signal"))


def win_loss(trades: DataFrame, s: Series, last: int = 50) -> DataFrame:
    """Rolling win / loss ratio (1.5 below five trades or without both kinds, clipped to 0.5-5) and win rate."""

    def add(d, b):
        w = b.frame(-(last - 1), 0)
        win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, -F.col("pnl"))
        d = d.withColumns({
            "_w": F.avg(win).over(w), "_l": F.avg(loss).over(w), "_n": F.count(F.lit(1)).over(w),
            "win_rate": F.avg(flag(F.col("pnl") > 0)).over(w),
        })
        known = (F.col("_n") >= 5) & F.col("_w").isNotNull() & F.col("_l").isNotNull()
        value = F.when(known, clip(F.try_divide("_w", "_l"), 0.5, 5.0)).otherwise(1.5)
        return d.withColumn("win_loss_ratio", value).drop("_w", "_l", "_n")

    return windowed(trades, s, add, back=last)


def _scenarios(rets: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``_r``): weighted return of each book at each instant; null where none of its symbols has a known return.

    An instant's returns and a book's weights are one row each, so the product of both tables is made once and never grouped: tiles of books meet all instants.
    """
    n = int(rets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    instants = rets.where(F.col("ret").isNotNull()).groupBy("ts").agg(F.collect_list(F.struct("symbol", "ret")).alias("_x"))  # one a symbol
    held = weights.groupBy(*keys, "symbol").agg(F.sum("weight").alias("weight")).where("symbol is not null and weight is not null")
    books = held.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("symbol", "weight"))).alias("_w")).withColumn("_tile", F.pmod(F.xxhash64(*keys), F.lit(n)))
    tiles = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    part = lambda x: x["ret"] * F.try_element_at("_w", x["symbol"])
    total = F.aggregate("_x", F.lit(None).cast("double"), lambda a, x: F.coalesce(a + part(x), part(x), a))
    return instants.withColumn("_tile", tiles).repartition(n, "_tile").join(books, "_tile").select(*keys, total.alias("_r"))


def tail_risk(rets: DataFrame, weights: DataFrame, alpha: float = 0.05, keys: Sequence[str] = ("book",)) -> DataFrame:
    """Empirical VaR (alpha quantile) and CVaR (mean at or below it) of weighted scenario returns per book."""
    keys = list(keys)
    # one number per book and scenario, read by the quantile and the tail mean; equal ones need not be counted first
    scen = reliable_checkpoint(_scenarios(rets, weights, keys)).where("_r is not null").withColumn("_n", F.lit(1))
    q = quantiles_of_counts(scen, keys, "_r", [alpha], "_q").select(*keys, "n", F.get("_q", F.lit(0)).alias("var"))
    d = scen.join(q, keys)
    return d.groupBy(*keys).agg(
        F.first("n").alias("n_scenarios"), F.first("var").alias("var"),
        F.avg(F.when(F.col("_r") <= F.col("var"), F.col("_r"))).alias("cvar"), F.avg("_r").alias("expected_return"),
    )


def classifier_metrics(df: DataFrame, keys: Sequence[str], label: str = "y", score: str = "p", threshold: float = 0.6) -> DataFrame:
    """AUC, precision at the threshold (percent), win rate (percent) and confident count per model.

    AUC is the share of correctly ordered (positive, negative) pairs with ties at one half,
    from running negative counts over distinct scores.
    """
    keys = list(keys)
    pos, neg = flag(F.col(label) == 1), flag(F.col(label) != 1)
    counts = value_counts(df, keys, score, {"_p": F.sum(pos), "_n": F.sum(neg)})
    s = Series.sampled(df, keys, [score])
    below = running(counts, s, {"_below": ("sum", F.col("_n"))}, exclusive=True)
    auc = below.groupBy(*keys).agg(
        F.sum(F.col("_p") * (F.coalesce("_below", F.lit(0)) + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("_np"), F.sum("_n").alias("_nn")
    )
    high = F.col(score) >= threshold
    rest = df.groupBy(*keys).agg(
        F.sum(flag(high)).cast("bigint").alias("n_high_conf"), F.avg(F.when(high, pos)).alias("_prec"), (F.avg(pos) * 100).alias("win_rate_pct"),
    )
    d = auc.join(rest, keys)
    return d.select(
        *keys, F.try_divide(F.col("_u"), F.col("_np") * F.col("_nn")).alias("auc_roc"),
        (F.col("_prec") * 100).alias("win_precision"), "win_rate_pct", "n_high_conf",
    )


def threshold_grid(low: float = 0.5, high: float = 0.8, n: int = 30) -> list[float]:
    """Evenly spaced thresholds, both ends included."""
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def _grid_bins(df: DataFrame, keys: Sequence[str], grid: Sequence[float], strict: bool = True) -> DataFrame:
    """Per (keys, number of thresholds passed): moments of the return.  Nothing is expanded by the grid."""
    arr = F.array(*[F.lit(float(t)) for t in grid])
    passed = F.size(F.filter(arr, (lambda t: t < F.col("p")) if strict else (lambda t: t <= F.col("p"))))
    r = F.col("r")
    neg = F.least(r, F.lit(0.0))
    return df.withColumn("_bin", passed).groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("r").alias("_s1"), F.sum(r * r).alias("_s2"), F.sum(neg * neg).alias("_d2"),
        F.sum(flag(r < 0)).alias("_nn"), F.sum(neg).alias("_ns"),
    )


def _grid_scores(bins: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Suffix sums over the bins: totals of all rows passing each threshold, plus totals of the group."""
    keys = list(keys)
    sums = ["_n", "_s1", "_s2", "_d2", "_nn", "_ns"]
    # at most one row per threshold and group from here on
    full = bins.groupBy(*keys).agg(
        F.sum("_n").alias("_all"), F.collect_list(F.struct("_bin", *sums)).alias("_bins")
    )
    d = full.select(*keys, "_all", "_bins", F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("_j", "threshold"))
    taken = F.filter("_bins", lambda b: b["_bin"] > F.col("_j"))
    for c in sums:
        zero = F.lit(0).cast("bigint") if c in ("_n", "_nn") else F.lit(0.0)
        d = d.withColumn(c, F.aggregate(F.transform(taken, lambda b: b[c]), zero, lambda a, x: a + x))
    return d.drop("_bins")


def threshold_scores(df: DataFrame, keys: Sequence[str], metric: str = "sharpe", grid: Sequence[float] | None = None,
                     min_trades: int = 5) -> DataFrame:
    """Score of entering when p > threshold, for ``df(keys, p, r)``; rows not taken count as 0.

    ``metric``: sharpe, sortino or pnl.  Thresholds with too few trades have a null score.
    """
    grid = list(grid or threshold_grid())
    d = _grid_scores(_grid_bins(df, keys, grid), keys, grid)
    mean = F.col("_s1") / F.col("_all")
    d = d.withColumns({"pnl_mean": mean, "pnl_std": F.sqrt(F.greatest(F.col("_s2") / F.col("_all") - mean * mean, F.lit(0.0)))})
    score = {
        "sharpe": mean / (F.col("pnl_std") + 1e-9),
        "sortino": mean / (F.sqrt(F.col("_d2") / F.col("_all")) + 1e-9),
        "pnl": F.col("_s1"),
    }[metric]
    return d.select(
        *keys, "threshold", F.col("_n").alias("n_trades"), F.when(F.col("_n") >= min_trades, score).alias("score"), "pnl_mean", "pnl_std"
    )


def best_threshold(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest score, the lower threshold on a tie; 0.5 where no threshold had enough trades."""
    best = scores.groupBy(*keys).agg(
        F.max_by(F.struct("threshold", "score", "pnl_mean", "pnl_std", "n_trades"),
                 F.when(F.col("score").isNotNull(), F.struct("score", -F.col("threshold")))).alias("_b")
    )
    z = lambda c, v: F.coalesce(F.col(f"_b.{c}"), F.lit(v)).alias(c)
    return best.select(*keys, F.coalesce("_b.threshold", F.lit(0.5)).alias("best_threshold"), F.col("_b.score").alias("score"),
                       z("pnl_mean", 0.0), z("pnl_std", 0.0), z("n_trades", 0))


def rolling_threshold(df: DataFrame, s: Series, window: int = 1000, refit: int = 100) -> DataFrame:
    """Threshold in force at each row: refit every ``refit`` rows on the trailing ``window`` rows, 0.5 before.

    Rows are first reduced to histograms of ``refit``-row chunks; each refit adds up
    window / refit of them.
    """
    keys = list(s.keys)
    grid = threshold_grid()
    d = with_position(df, s)
    chunk = F.expr(f"_pos div {refit}")
    bins = _grid_bins(d.withColumn("_chunk", chunk), [*keys, "_chunk"], grid)
    span = window // refit
    # chunk c is inside the windows of refits that start at chunks c+1 .. c+span
    spread = bins.withColumn("_at", F.explode(F.sequence(F.col("_chunk") + 1, F.col("_chunk") + span))).where(F.col("_at") >= span)
    per_refit = spread.groupBy(*keys, "_at", "_bin").agg(*[F.sum(c).alias(c) for c in ("_n", "_s1", "_s2", "_d2", "_nn", "_ns")])
    mean = F.col("_s1") / F.col("_all")
    g = _grid_scores(per_refit, [*keys, "_at"], grid)
    sd = F.sqrt(F.greatest(F.col("_s2") / F.col("_all") - mean * mean, F.lit(0.0)))
    g = g.withColumn("score", F.when(F.col("_n") >= 5, mean / (sd + 1e-9))).withColumns(
        {"pnl_mean": mean, "pnl_std": sd, "n_trades": F.col("_n")}
    )
    best = best_threshold(g, [*keys, "_at"]).select(*keys, "_at", "best_threshold")
    d = d.withColumn("_at", chunk).join(best, [*keys, "_at"], "left")
    return d.withColumn(
        "dynamic_threshold", F.when(F.col("_pos") >= window, F.coalesce("best_threshold", F.lit(0.5))).otherwise(0.5)
    ).drop("_at", "best_threshold", "_pos")


def approval_sortino(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], min_trades: int = 10) -> DataFrame:
    """Annualised Sortino ratio of ``df(keys, p, signal, r)`` approved at p >= threshold with a non-zero signal."""
    d = df.where("signal <> 0").withColumn("r", F.col("r") * F.col("signal"))
    g = _grid_scores(_grid_bins(d, keys, thresholds, strict=False), keys, thresholds)
    mean = F.try_divide("_s1", "_n")
    neg_mean = F.try_divide("_ns", "_nn")
    neg_sd = F.sqrt(F.greatest(F.try_divide("_d2", "_nn") - neg_mean * neg_mean, F.lit(0.0)))
    value = (
        F.when(F.col("_n") < min_trades, 0.0).when(F.col("_nn") == 0, mean * math.sqrt(252) * 10)
        .when(neg_sd == 0, 0.0).otherwise(mean / neg_sd * math.sqrt(252))
    )
    return g.select(*keys, "threshold", F.col("_n").alias("n_trades"), value.alias("sortino"))


def probabilistic_sharpe(rets: DataFrame, keys: Sequence[str], benchmark: float = 0.0) -> DataFrame:
    """Probability that the true Sharpe ratio exceeds the benchmark, given skew and kurtosis of the returns."""
    d = rets.where(F.col("ret").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sr"),
        F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"),
    )
    under = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    z = (F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(under > 0, under))
    psr = F.when((F.col("n") <= 1) | (under <= 0), 0.0).otherwise(normal_cdf(z))
    return d.select(*keys, "n", "sr", psr.alias("psr"))


def classify_scenarios(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Market type per group of bars; groups below ten bars are COMPOSITE.

    ``keys`` must bound a group (a series and a window id): returns stay inside it.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    d = df.withColumn("_r", ratio("close", F.lag("close").over(w)) - 1).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("_r").alias("vol"), F.avg("funding_rate").alias("_f"),
        (F.try_divide(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("total_return"),
    )
    base = 0.01
    kind = (
        F.when(F.col("n") < 10, "COMPOSITE").when(F.abs("_f") > 0.0005, "FUNDING_SQUEEZE").when(F.col("vol") > base * 3, "VOLATILE")
        .when(F.col("total_return") > 0.05, "TRENDING_UP").when(F.col("total_return") < -0.05, "TRENDING_DOWN")
        .when(F.col("vol") < base * 0.5, "RANGING").otherwise("COMPOSITE")
    )
    return d.select(*keys, "n", "vol", "total_return", kind.alias("scenario"))
