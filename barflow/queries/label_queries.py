"""Registered queries: signals, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.numeric import nonzero, sign3
from barflow.operators import bars as B
from barflow.operators import indicators as I
from barflow.operators import labels as L
from barflow.operators import signals as S
from barflow.plans.ordered import with_position
from barflow.queries.base import bar_series, bars, micros, query, r, show, sql_round
from barflow.queries.indicator_queries import (
    BB_SQL, DON_SQL, ICHI_SQL, KELT_SQL, TR_SQL, VWAP_SQL, WITH_BARS, lag, recursive_ema, roll,
)


def funded_bars(spark, sf):
    """Bars with a funding rate (and a model vote and regime) derived from their own flow."""
    share = F.col("taker_buy_base") / nonzero("volume", 1.0)
    return bars(spark, sf).withColumns({
        "funding_rate": (share - 0.5) / 100,
        "vote": sign3(F.col("close") > F.col("open"), F.col("close") < F.col("open")) + sign3(share > 0.5, share < 0.3),
        "regime": F.when(F.col("volume") < 40, 0).when(F.col("volume") < 90, 1).otherwise(2),
    })


FUNDED_SQL = """fb AS (SELECT *, (taker_buy_base / CASE WHEN volume = 0 THEN 1 ELSE volume END - 0.5) / 100 AS funding_rate,
    sign(close - open) + CASE WHEN taker_buy_base / CASE WHEN volume = 0 THEN 1 ELSE volume END > 0.5 THEN 1
      WHEN taker_buy_base / CASE WHEN volume = 0 THEN 1 ELSE volume END < 0.3 THEN -1 ELSE 0 END AS vote,
    CASE WHEN volume < 40 THEN 0 WHEN volume < 90 THEN 1 ELSE 2 END AS regime FROM bars)"""


def s3(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1.0::DOUBLE WHEN {down} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"


SIGNALS = ["signal_rsi", "signal_macd", "signal_bb", "signal_ensemble", "signal_vwap", "signal_donchian", "signal_keltner",
           "signal_funding", "signal_ofi", "signal_ensemble_b", "signal_vol_breakout", "signal_elliott_proxy", "signal_ou_entry",
           "ou_filter", "signal_mtf_filter", "signal_ichimoku", "vol_size_mult"]

SIGNALS_SQL = f"""{WITH_BARS}, {FUNDED_SQL},
dd AS (SELECT *, close - {lag('close')} AS dd FROM bars), gl AS (SELECT *, greatest(dd, 0) AS g, greatest(-dd, 0) AS l FROM dd WHERE dd IS NOT NULL),
{recursive_ema('g14', 'gl', 'g', 1 / 14, 1)}, {recursive_ema('l14', 'gl', 'l', 1 / 14, 1)},
{recursive_ema('f12', 'bars', 'close', 2 / 13)}, {recursive_ema('s26', 'bars', 'close', 2 / 27)},
mline AS (SELECT b.symbol, b.i, f.y - s.y AS macd FROM bars b JOIN f12 f USING (symbol, i) JOIN s26 s USING (symbol, i)),
{recursive_ema('sig9', 'mline', 'macd', 2 / 10)}, {BB_SQL}, {VWAP_SQL}, {DON_SQL}, {KELT_SQL}, {ICHI_SQL},
oz0 AS (SELECT *, 2 * taker_buy_base - volume AS ofi FROM bars),
oz1 AS (SELECT *, {roll('avg(ofi)', 20)} AS m, {roll('stddev_samp(ofi)', 20)} AS sd FROM oz0),
oz AS (SELECT symbol, i, (ofi - m) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS z FROM oz1),
allc AS (SELECT fb.*, CASE WHEN l14.y = 0 AND g14.y > 0 THEN 100 WHEN l14.y = 0 THEN NULL ELSE 100 - 100 / (1 + g14.y / l14.y) END AS rsi,
  mline.macd - sig9.y AS hist, bb_pb, vwap_dist, don_pos_20, kc_pos, z, ichimoku_tenkan AS tk, ichimoku_kijun AS kj, ichimoku_senkou_a AS sa, ichimoku_senkou_b AS sb
  FROM fb LEFT JOIN g14 USING (symbol, i) LEFT JOIN l14 USING (symbol, i) JOIN mline USING (symbol, i) JOIN sig9 USING (symbol, i)
  JOIN bb ON bb.symbol = fb.symbol AND bb.i = fb.i JOIN vwd ON vwd.symbol = fb.symbol AND vwd.i = fb.i JOIN dn ON dn.symbol = fb.symbol AND dn.i = fb.i
  JOIN kc ON kc.symbol = fb.symbol AND kc.i = fb.i JOIN oz ON oz.symbol = fb.symbol AND oz.i = fb.i JOIN ic ON ic.symbol = fb.symbol AND ic.i = fb.i),
base AS (SELECT *, {s3('rsi < 30', 'rsi > 70')} AS signal_rsi, CASE WHEN hist > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal_macd, {s3('bb_pb < 0.1', 'bb_pb > 0.9')} AS signal_bb,
  {s3('vwap_dist < -0.005', 'vwap_dist > 0.005')} AS signal_vwap, {s3('don_pos_20 > 0.98', 'don_pos_20 < 0.02')} AS signal_donchian,
  {s3('kc_pos > 1', 'kc_pos < 0')} AS signal_keltner, {s3('funding_rate < -0.0005', 'funding_rate > 0.001')} AS signal_funding,
  {s3('z > 1.5', 'z < -1.5')} AS signal_ofi, {s3('close > greatest(sa, sb) AND tk > kj', 'close < least(sa, sb) AND tk < kj')} AS signal_ichimoku,
  coalesce(bb_pb < 0.15 AND kc_pos BETWEEN 0.1 AND 0.9, FALSE) AS squeeze, {lag('close')} AS prev, {lag('close', 5)} AS prev5,
  {roll('avg(volume)', 20, 5)} AS v20, {roll('avg(close)', 50, 10)} AS s50, {roll('avg(close)', 200, 50)} AS s200, {roll('stddev_samp(close)', 200, 50)} AS sd200,
  close / nullif({lag('close')}, 0) - 1 AS ret FROM allc),
sg AS (SELECT *, (signal_rsi + signal_macd + signal_bb) / 3 AS signal_ensemble,
  (signal_vwap + signal_donchian + signal_keltner + signal_funding + signal_ofi) / 5 AS signal_ensemble_b,
  coalesce({lag('squeeze')}, FALSE) AS was, (close - s200) / greatest(sd200, 1e-9) AS dev0, {roll('stddev_samp(ret)', 5, 2)} AS v5, {roll('stddev_samp(ret)', 60, 10)} AS v60 FROM base),
sgd AS (SELECT *, CASE WHEN sd200 IS NOT NULL THEN dev0 END AS dev FROM sg),
signals AS (SELECT *, {s3('was AND close > prev AND volume > v20 * 1.5', 'was AND close < prev AND volume > v20 * 1.5')} AS signal_vol_breakout,
  {s3('close / greatest(prev5, 1e-9) - 1 > 0.02 AND prev5 IS NOT NULL AND close > s50 AND vote > 0', 'close / greatest(prev5, 1e-9) - 1 < -0.02 AND prev5 IS NOT NULL AND close < s50 AND vote < 0')} AS signal_elliott_proxy,
  {s3('regime = 0 AND dev < -1.5', 'regime = 0 AND dev > 1.5')} AS signal_ou_entry, signal_ensemble_b * CASE WHEN abs(dev) < 2 THEN 1 ELSE 0 END AS ou_filter,
  CASE WHEN close > s200 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal_mtf_filter,
  CASE WHEN v60 IS NOT NULL AND v5 / greatest(v60, 1e-9) > 1.8 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS vol_size_mult FROM sgd)"""


@query("signals_all_rules", f"{SIGNALS_SQL} SELECT symbol, ts, {sql_round(', '.join(SIGNALS))} FROM signals")
def signals_all_rules(spark, sf):
    return show(S.signal_frame(funded_bars(spark, sf), bar_series(), "vote", "regime"), *SIGNALS)


@query("signals_trainer_donchian", f"{WITH_BARS}, {DON_SQL} SELECT symbol, ts, {s3('don_pos_20 > 0.95', 'don_pos_20 < 0.05')} AS signal_donchian FROM dn")
def signals_trainer_donchian(spark, sf):
    d = I.add_features(bars(spark, sf), bar_series(), I.donchian())
    return show(d.withColumn("signal_donchian", S.trainer_donchian()), "signal_donchian")


def _routed_case(codes: dict) -> str:
    parts = []
    for code, names in codes.items():
        sigs = [S.STRATEGY_SIGNAL[n] for n in names]
        arms = ""
        for j, (n, sg) in enumerate(zip(names, sigs)):
            stronger = " AND ".join([f"abs({sg}) > abs({o})" for o in sigs[:j]] + [f"abs({sg}) >= abs({o})" for o in sigs[j + 1:]] + [f"{sg} <> 0"])
            arms += f" WHEN {stronger} THEN {{{j}}}"
        parts.append((code, names, sigs, arms))
    name = " ".join(f"WHEN regime = {c} THEN CASE{a.format(*[repr(n) for n in ns])} ELSE 'Ensemble' END" for c, ns, sg, a in parts)
    val = " ".join(f"WHEN regime = {c} THEN CASE{a.format(*sg)} ELSE ({' + '.join(sg)}) / {len(sg)} END" for c, ns, sg, a in parts)
    return f"CASE {name} END AS strategy, round(CASE {val} END, 6) + 0.0 AS routed_signal"


@query("signals_regime_routed", f"{SIGNALS_SQL} SELECT symbol, ts, {_routed_case(S.REGIME_STRATEGIES)} FROM signals")
def signals_regime_routed(spark, sf):
    d = S.signal_frame(funded_bars(spark, sf), bar_series(), "vote", "regime")
    return show(S.route_by_regime(d), "strategy", "routed_signal")


@query("signals_cross_sectional_momentum", f"""{WITH_BARS}, rn AS (SELECT *, close / nullif({lag('close', 7)}, 0) - 1 AS rr FROM bars),
    rk AS (SELECT symbol, ts, rr, count(rr) OVER (PARTITION BY ts) AS n FROM rn),
    p AS (SELECT a.symbol, a.ts, a.n, a.rr, (SELECT count(*) FILTER (b.rr < a.rr) + (count(*) FILTER (b.rr = a.rr) + 1) / 2.0 FROM rk b WHERE b.ts = a.ts) / a.n AS pct FROM rk a)
    SELECT symbol, ts, round(CASE WHEN n < 3 OR rr IS NULL THEN 0 WHEN pct <= 0.3 THEN -(0.3 - pct) / 0.3 WHEN pct >= 0.7 THEN (pct - 0.7) / 0.3 ELSE 0 END, 6) + 0.0 AS momentum_signal FROM p""")
def signals_cross_sectional_momentum(spark, sf):
    return show(S.cross_sectional_momentum(bars(spark, sf), bar_series()), "momentum_signal")


@query("signals_alpha_decay", f"""{WITH_BARS}, a AS (SELECT *, sign(2 * taker_buy_base - volume) AS sg FROM bars),
    b AS (SELECT *, last_value(CASE WHEN sg <> 0 THEN sg END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS side FROM a),
    c AS (SELECT *, CASE WHEN side IS NOT NULL AND side IS DISTINCT FROM {lag('side')} THEN i END AS e FROM b),
    d AS (SELECT *, i - last_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS bars_held FROM c)
    SELECT symbol, ts, bars_held, round(side * exp(-0.1 * bars_held), 6) + 0.0 AS decayed_signal, abs(side * exp(-0.1 * bars_held)) < 0.2 AS should_exit FROM d""")
def signals_alpha_decay(spark, sf):
    d = bars(spark, sf).withColumn("sig", F.signum(2 * F.col("taker_buy_base") - F.col("volume")))
    return show(S.decay_signal(d, bar_series(), "sig"), "bars_held", "decayed_signal", "should_exit")


@query("signals_meta_filter", f"{WITH_BARS} SELECT symbol, ts, CASE WHEN taker_buy_base / nullif(volume, 0) >= 0.55 THEN sign(close - open) ELSE 0.0::DOUBLE END + 0.0 AS filtered FROM bars")
def signals_meta_filter(spark, sf):
    d = bars(spark, sf).withColumns({
        "sig": F.signum(F.col("close") - F.col("open")), "prob": F.try_divide("taker_buy_base", "volume")
    })
    return show(d.withColumn("filtered", S.vote_filter("sig", "prob")), "filtered")


# --- labels ---------------------------------------------------------------------------------------

LABEL_SQL = f"""{WITH_BARS}, {TR_SQL}, at0 AS (SELECT *, {roll('avg(tr)', 14)} AS atr_14 FROM trs),
at1 AS (SELECT *, coalesce(first_value(atr_14 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(atr_14 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts)) AS a, max(i) OVER (PARTITION BY symbol) AS last_i FROM at0),
hit AS (SELECT b.symbol, b.i, min(f.i) AS hi FROM at1 b JOIN bars f ON f.symbol = b.symbol AND f.i BETWEEN b.i + 1 AND b.i + 12
  AND (f.high >= b.close + 2.5 * a OR f.low <= b.close - 1.5 * a) GROUP BY 1, 2),
lab AS (SELECT b.*, CASE WHEN hit.hi IS NULL THEN 0 WHEN f.high >= b.close + 2.5 * a AND f.low <= b.close - 1.5 * a THEN -1
    WHEN f.high >= b.close + 2.5 * a THEN 1 ELSE -1 END AS label, t.ts AS t1
  FROM at1 b LEFT JOIN hit USING (symbol, i) LEFT JOIN bars f ON f.symbol = b.symbol AND f.i = hit.hi
  JOIN bars t ON t.symbol = b.symbol AND t.i = coalesce(hit.hi, least(b.i + 12, b.last_i)))"""


def labelled(spark, sf):
    numbered = with_position(bars(spark, sf), bar_series())
    return L.triple_barrier(I.add_features(numbered, bar_series(), I.atr()), bar_series())


@query("labels_triple_barrier", f"{LABEL_SQL} SELECT symbol, ts, CAST(label AS BIGINT) AS label, t1 FROM lab")
def labels_triple_barrier(spark, sf):
    return show(labelled(spark, sf), "label", "t1")


@query("labels_triple_barrier_without_atr", f"""{WITH_BARS}, {TR_SQL}, at1 AS (SELECT *, {roll('avg(tr)', 14, 1)} AS a FROM trs),
hit AS (SELECT b.symbol, b.i, min(f.i) AS hi FROM at1 b JOIN bars f ON f.symbol = b.symbol AND f.i BETWEEN b.i + 1 AND b.i + 48
  AND (f.high >= b.close + 2.0 * a OR f.low <= b.close - 2.0 * a) GROUP BY 1, 2)
SELECT b.symbol, b.ts, CAST(CASE WHEN hit.hi IS NULL THEN 0 WHEN f.high >= b.close + 2.0 * a THEN 1 ELSE -1 END AS BIGINT) AS label
FROM at1 b LEFT JOIN hit USING (symbol, i) LEFT JOIN bars f ON f.symbol = b.symbol AND f.i = hit.hi""")
def labels_triple_barrier_without_atr(spark, sf):
    return show(L.triple_barrier(bars(spark, sf), bar_series(), 2.0, 2.0, 48), "label")


@query("labels_event_time", f"""{LABEL_SQL.split('hit AS (')[0]}
vn AS (SELECT *, a / {roll('avg(a)', 100, 1)} AS vol_norm FROM at1),
hit AS (SELECT b.symbol, b.i, min(f.i) AS hi FROM vn b JOIN bars f ON f.symbol = b.symbol AND f.i BETWEEN b.i + 1 AND b.i + 240
  AND (f.high >= b.close + 2.0 * (a * vol_norm) OR f.low <= b.close - 2.0 * (a * vol_norm)) GROUP BY 1, 2)
SELECT b.symbol, b.ts, round(vol_norm, 6) + 0.0 AS vol_norm, CAST(CASE WHEN b.i + 240 > last_i OR hit.hi IS NULL THEN 0 WHEN f.high >= b.close + 2.0 * (a * vol_norm) THEN 1 ELSE -1 END AS BIGINT) AS label, t.ts AS t1
FROM vn b LEFT JOIN hit USING (symbol, i) LEFT JOIN bars f ON f.symbol = b.symbol AND f.i = hit.hi
JOIN bars t ON t.symbol = b.symbol AND t.i = coalesce(hit.hi, least(b.i + 240, b.last_i))""")
def labels_event_time(spark, sf):
    d = I.add_features(with_position(bars(spark, sf), bar_series()), bar_series(), I.atr())
    return show(L.event_time_labels(d, bar_series()), "vol_norm", "label", "t1")


@query("labels_distribution", f"""{LABEL_SQL} SELECT symbol, ROUND(avg(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS long_pct,
  ROUND(avg(CASE WHEN label = -1 THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS short_pct, ROUND(avg(CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS timeout_pct, count(*) AS total FROM lab GROUP BY 1""")
def labels_distribution(spark, sf):
    return L.label_shares(labelled(spark, sf))


@query("labels_binary_target", f"{LABEL_SQL} SELECT symbol, ts, CAST(label = 1 AS BIGINT) AS target FROM lab WHERE label <> 0")
def labels_binary_target(spark, sf):
    return show(L.binary_target(labelled(spark, sf)), "target")


_END = "2024-01-20 00:00:00"
_END_US = "epoch_us(TIMESTAMP '2024-01-20 00:00:00')"


@query("labels_leak_audit", f"""{LABEL_SQL} SELECT symbol, sum(CASE WHEN ts <= {_END_US} AND t1 >= {_END_US} THEN 1 ELSE 0 END)::BIGINT AS n_violations,
  arg_min(t1, ts) FILTER (ts <= {_END_US} AND t1 >= {_END_US}) AS first_violation,
  coalesce(max(t1) FILTER (ts <= {_END_US} AND t1 >= {_END_US}), max(t1) FILTER (ts <= {_END_US})) AS purge_until FROM lab GROUP BY 1""")
def labels_leak_audit(spark, sf):
    end = F.lit(_END).cast("timestamp")
    return show(L.leak_audit(labelled(spark, sf), end, end), "n_violations", "first_violation", "purge_until", keys=("symbol",))


@query("labels_purged_train", f"""{LABEL_SQL}, v AS (SELECT symbol, count(*) FILTER (ts <= {_END_US} AND t1 >= {_END_US}) AS n FROM lab GROUP BY 1)
  SELECT lab.symbol, ts, t1 FROM lab JOIN v USING (symbol) WHERE n = 0 OR t1 < {_END_US}""")
def labels_purged_train(spark, sf):
    end = F.lit(_END).cast("timestamp")
    return show(L.purge_overlap(labelled(spark, sf), end, end), "t1")


@query("splits_walk_forward", f"""{LABEL_SQL}, sz AS (SELECT symbol, count(*) AS n, count(*) // 5 AS len, CAST(floor(count(*) * 0.01) AS BIGINT) AS gap FROM lab GROUP BY 1),
  fs AS (SELECT sz.*, f AS fold, f * len AS a, CASE WHEN f = 4 THEN n ELSE (f + 1) * len END AS z FROM sz, range(5) t(f)),
  fe AS (SELECT fs.*, lab.ts AS first_ts FROM fs JOIN lab ON lab.symbol = fs.symbol AND lab.i = fs.a),
  tr AS (SELECT fe.symbol, fold, i FROM fe JOIN lab ON lab.symbol = fe.symbol AND lab.i < fe.a - gap AND lab.t1 < first_ts)
  SELECT symbol, fold, 'train' AS role, i AS row FROM tr UNION ALL
  SELECT fe.symbol, fold, 'test', i FROM fe JOIN lab ON lab.symbol = fe.symbol AND lab.i >= fe.a AND lab.i < z WHERE EXISTS (SELECT 1 FROM tr WHERE tr.symbol = fe.symbol AND tr.fold = fe.fold)""")
def splits_walk_forward(spark, sf):
    return show(L.walk_forward_folds(labelled(spark, sf), bar_series()), "fold", "role", "row", keys=("symbol",))


@query("splits_two_sided", f"""{LABEL_SQL}, lo AS (SELECT symbol, ts, t1, row_number() OVER (PARTITION BY symbol ORDER BY t1, ts) - 1 AS p FROM lab),
  sz AS (SELECT symbol, count(*) AS n, count(*) // 5 AS len, CAST(floor(count(*) * 0.01) AS BIGINT) AS gap FROM lab GROUP BY 1),
  fs AS (SELECT sz.*, f AS fold, f * len AS a, CASE WHEN f = 4 THEN n ELSE (f + 1) * len END AS z FROM sz, range(5) t(f)),
  fe AS (SELECT fs.*, l1.t1 AS ft, l2.t1 AS lt FROM fs JOIN lo l1 ON l1.symbol = fs.symbol AND l1.p = a JOIN lo l2 ON l2.symbol = fs.symbol AND l2.p = z - 1),
  c AS (SELECT fe.symbol, fold, p, CASE WHEN p >= a AND p < z THEN 'test' WHEN p < a AND t1 < ft THEN 'train'
    WHEN p >= z AND NOT (z + gap < n AND p < z + gap) AND t1 > lt THEN 'train' END AS role FROM fe JOIN lo ON lo.symbol = fe.symbol)
  SELECT symbol, fold, role, p AS row FROM c WHERE role IS NOT NULL""")
def splits_two_sided(spark, sf):
    return show(L.two_sided_folds(labelled(spark, sf), bar_series()), "fold", "role", "row", keys=("symbol",))


@query("labels_meta", f"""{LABEL_SQL}, p AS (SELECT symbol, ts, label, CASE WHEN taker_buy_base / nullif(volume, 0) > 0.52 THEN 1 WHEN taker_buy_base / nullif(volume, 0) < 0.48 THEN -1 ELSE 0 END AS side FROM lab)
  SELECT symbol, ts, CAST(side AS BIGINT) AS side, CAST(side = label AS BIGINT) AS meta FROM p WHERE side <> 0""")
def labels_meta(spark, sf):
    d = labelled(spark, sf).withColumn("prob", F.try_divide("taker_buy_base", "volume"))
    return show(L.meta_labels(d), "side", "meta")
