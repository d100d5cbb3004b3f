"""Registered queries: validation, coverage, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import drift as D
from barflow.operators import quality as Q
from barflow.operators import indicators as I
from barflow.plans.ordered import Series, with_position
from barflow.queries.base import TICKS_SQL, bar_series, bars, bars_sql, micros, query, r, show, sql_round, table, ticks
from barflow.queries.label_queries import LABEL_SQL, labelled


def dirty_bars(spark, sf):
    """Per-trade rows on five-minute times: duplicates, broken bounds, silent stretches and jumps included."""
    step = F.lit(300_000_000)
    us = F.unix_micros("ts")
    return ticks(spark, sf).select(
        "symbol", F.timestamp_micros(us - F.pmod(us, step)).alias("ts"), "id", (F.col("price") - 1).alias("open"),
        (F.col("price") + F.col("taker") / 10 - 1).alias("high"), (F.col("price") - (F.col("volume") - 3) / 50).alias("low"),
        F.col("price").alias("close"), F.when(F.col("volume") < 60, 0.0).when(F.col("volume") > 97, -1.0).otherwise(F.col("volume")).alias("volume"),
    )


DIRTY_SQL = f"""WITH {TICKS_SQL}, dirty AS (SELECT symbol, us - us % 300000000 AS ts, id, price - 1 AS open, price + taker / 10 - 1 AS high, price - (volume - 3) / 50 AS low,
  price AS close, CASE WHEN volume < 60 THEN 0.0 WHEN volume > 97 THEN -1.0 ELSE volume END AS volume FROM ticks),
clean AS (SELECT * FROM dirty QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY id DESC) = 1),
seq AS (SELECT *, lag(ts) OVER w AS pts, lag(close) OVER w AS pc, row_number() OVER w AS rn FROM clean WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
gaps AS (SELECT symbol, pts AS gap_start, ts AS gap_end, CAST(round_even((ts - pts) / 1000000.0 / 300, 0) - 1 AS BIGINT) AS missing_bars FROM seq WHERE (ts - pts) / 1000000.0 > 450),
zr AS (SELECT symbol, min(ts) AS run_start, max(ts) AS run_end, count(*) AS bars FROM (SELECT *, rn - row_number() OVER (PARTITION BY symbol ORDER BY ts) AS g FROM seq WHERE volume = 0) GROUP BY symbol, g HAVING count(*) >= 4)"""


def _s5():
    return Series.on_grid(["symbol"], "ts", 300)


@query("quality_report", DIRTY_SQL + """, a AS (SELECT symbol, count(*) AS n_rows_in, count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS bad_price,
  count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (high < greatest(open, close) - 1e-9) AS high_below_body,
  count(*) FILTER (low > least(open, close) + 1e-9) AS low_above_body FROM dirty GROUP BY 1),
  mo AS (SELECT symbol, count(*) FILTER (ts < p) = 0 AS monotonic FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY id) AS p FROM dirty) GROUP BY 1),
  b AS (SELECT symbol, count(*) AS n_rows_out, count(*) FILTER (abs(close / nullif(pc, 0) - 1) > 0.5) AS spikes FROM seq GROUP BY 1),
  g AS (SELECT symbol, count(*) AS gaps, sum(missing_bars)::BIGINT AS missing_bars FROM gaps GROUP BY 1), z AS (SELECT symbol, count(*) AS zero_volume_runs FROM zr GROUP BY 1)
  SELECT a.*, n_rows_out, n_rows_in - n_rows_out AS duplicates, monotonic, coalesce(gaps, 0) AS gaps, coalesce(missing_bars, 0) AS missing_bars, coalesce(zero_volume_runs, 0) AS zero_volume_runs, spikes,
    bad_price + negative_volume + high_below_low + high_below_body + low_above_body > 0 OR NOT monotonic AS hard_error
  FROM a JOIN mo USING (symbol) JOIN b USING (symbol) LEFT JOIN g USING (symbol) LEFT JOIN z USING (symbol)""")
def quality_report(spark, sf):
    return Q.validate_bars(dirty_bars(spark, sf), _s5(), "5m", max_zero_bars=4)[1]


@query("quality_clean_bars", DIRTY_SQL + f" SELECT symbol, ts, id, {sql_round('open, high, low, close, volume')} FROM clean")
def quality_clean_bars(spark, sf):
    clean = Q.keep_last(dirty_bars(spark, sf), ["symbol", "ts"], ["id"])
    return show(clean, "id", "open", "high", "low", "close", "volume")


@query("quality_gaps", DIRTY_SQL + " SELECT * FROM gaps")
def quality_gaps(spark, sf):
    clean = Q.keep_last(dirty_bars(spark, sf), ["symbol", "ts"], ["id"])
    return show(Q.bar_gaps(clean, _s5(), "5m"), "gap_start", "gap_end", "missing_bars", keys=("symbol",))


@query("quality_zero_volume_runs", DIRTY_SQL + " SELECT * FROM zr")
def quality_zero_volume_runs(spark, sf):
    clean = Q.keep_last(dirty_bars(spark, sf), ["symbol", "ts"], ["id"])
    return show(Q.zero_volume_runs(clean, _s5(), 4), "run_start", "run_end", "bars", keys=("symbol",))


@query("news_month_coverage", """SELECT source, min(strftime(t, '%Y-%m')) AS first_month, max(strftime(t, '%Y-%m')) AS last_month, count(DISTINCT strftime(t, '%Y-%m')) AS months, count(*) AS rows
  FROM (SELECT source, make_timestamp(1704067200000000 + doc_id * 2580000000) AS t FROM documents) GROUP BY 1""")
def news_month_coverage(spark, sf):
    from barflow.queries.join_queries import news

    return Q.month_coverage(news(spark, sf), ["source"])


def _price_long(spark, sf, early: bool):
    """Line prices and discounts per return flag, before and after 1999, as two samples."""
    cut = F.lit("1999-01-01").cast("timestamp")
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") < cut if early else F.col("l_shipdate") >= cut)
    d = li.select(
        F.col("l_returnflag").alias("cell"), F.col("l_extendedprice").alias("rsi_14"),
        (F.col("l_extendedprice") * (1 + F.col("l_quantity") / (200 if early else 60))).alias("macd_hist"),
        F.col("l_discount").alias("discount"), F.lit(7.0).alias("constant"),
    )
    return D.melt(d, ["cell"], ["rsi_14", "macd_hist", "discount", "constant"])


def _long_sql(name: str, cond: str, div: int) -> str:
    return f"""{name} AS (SELECT l_returnflag AS cell, unnest(['rsi_14', 'macd_hist', 'discount', 'constant']) AS feature,
      unnest([l_extendedprice, l_extendedprice * (1 + l_quantity / {div}), l_discount, 7.0]) AS value FROM lineitem WHERE l_shipdate {cond} TIMESTAMP '1999-01-01')"""


_QS = ", ".join(str(p) for p in [0.05, 0.95, *[i / 10 for i in range(11)]])
BASE_SQL = f"""WITH {_long_sql('bl', '<', 200)}, {_long_sql('ac', '>=', 60)},
q AS (SELECT cell, feature, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n, quantile_cont(value, [{_QS}]) AS qs FROM bl GROUP BY 1, 2),
ed AS (SELECT cell, feature, mean, std, n, qs[1] AS q05, qs[2] AS q95, list_sort(list_distinct(qs[3:13])) AS e FROM q),
base AS (SELECT * EXCLUDE (e), list_concat(e[1:greatest(len(e) - 1, 1)], [e[len(e)] + 1e-9]) AS edges FROM ed),
bins AS (SELECT cell, feature, unnest(range(len(edges) - 1)) AS bin FROM base),
bc AS (SELECT bl.cell, bl.feature, least(len(list_filter(edges, lambda e: e <= value)), len(edges) - 1) - 1 AS bin, count(*) AS c FROM bl JOIN base USING (cell, feature) GROUP BY 1, 2, 3),
bp AS (SELECT b.cell, b.feature, b.bin, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY b.cell, b.feature) AS q FROM bins b LEFT JOIN bc USING (cell, feature, bin))"""

PSI_SQL = BASE_SQL + """, acl AS (SELECT ac.cell, ac.feature, edges, greatest(edges[1] + greatest(1e-9, (edges[len(edges)] - edges[1]) * 1e-6), least(edges[len(edges)] - greatest(1e-9, (edges[len(edges)] - edges[1]) * 1e-6), value)) AS v
  FROM ac JOIN base USING (cell, feature)),
acn AS (SELECT cell, feature, least(len(list_filter(edges, lambda e: e <= v)), len(edges) - 1) - 1 AS bin, count(*) AS c FROM acl GROUP BY 1, 2, 3),
ap AS (SELECT cell, feature, bin, q, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY cell, feature) AS p FROM bp LEFT JOIN acn USING (cell, feature, bin)),
psi AS (SELECT cell, feature, sum((greatest(p, 1e-4) - greatest(q, 1e-4)) * ln(greatest(p, 1e-4) / greatest(q, 1e-4))) AS psi FROM ap GROUP BY 1, 2),
pts AS (SELECT bp.cell, bp.feature, (edges[bin + 1] + edges[bin + 2]) / 2 AS x, q AS u, 0.0::DOUBLE AS v FROM bp JOIN base USING (cell, feature)
  UNION ALL SELECT cell, feature, value, 0.0, 1.0::DOUBLE / count(*) OVER (PARTITION BY cell, feature) FROM ac),
pg AS (SELECT cell, feature, x, sum(u) AS u, sum(v) AS v FROM pts GROUP BY 1, 2, 3),
pc AS (SELECT cell, feature, x, sum(u - v) OVER w AS d, lead(x) OVER w AS nx FROM pg WINDOW w AS (PARTITION BY cell, feature ORDER BY x)),
wd AS (SELECT pc.cell, pc.feature, sum(abs(d) * (nx - x)) / any_value(edges[len(edges)] - edges[1]) AS wd FROM pc JOIN base USING (cell, feature) GROUP BY 1, 2)"""


@query("drift_baseline", BASE_SQL + f""" SELECT b.cell, b.feature, {sql_round('mean, std, q05, q95', 5)}, n, len(edges) AS n_edges, round(list_sum(edges), 4) + 0.0 AS edge_sum,
  round(pp.top, 6) + 0.0 AS top_share FROM base b JOIN (SELECT cell, feature, max(q) AS top FROM bp GROUP BY 1, 2) pp USING (cell, feature)""")
def drift_baseline(spark, sf):
    b = D.baseline(_price_long(spark, sf, True), ["cell"])
    d = b.withColumns({
        "n_edges": F.size("bin_edges"), "edge_sum": F.aggregate("bin_edges", F.lit(0.0), lambda a, x: a + x),
        "top_share": F.array_max("bin_props"),
    })
    return d.select("cell", "feature", *[r(c, 5).alias(c) for c in ("mean", "std", "q05", "q95")], "n", F.col("n_edges").cast("bigint").alias("n_edges"),
                    r("edge_sum", 4).alias("edge_sum"), r("top_share").alias("top_share"))


@query("drift_report", PSI_SQL + """ SELECT cell, feature, round(psi, 6) + 0.0 AS psi, round(wd, 6) + 0.0 AS wasserstein_rel, n_actual,
  feature IN ('rsi_14', 'macd_hist') AS is_hard, CASE WHEN psi >= 0.25 THEN CASE WHEN feature IN ('rsi_14', 'macd_hist') THEN 'pause' ELSE 'warn' END
    WHEN psi >= 0.1 OR wd >= 0.15 THEN 'warn' ELSE 'ok' END AS severity
  FROM psi JOIN wd USING (cell, feature) JOIN (SELECT cell, feature, count(*) AS n_actual FROM ac GROUP BY 1, 2) n USING (cell, feature) WHERE n_actual >= 30""")
def drift_report(spark, sf):
    base = D.baseline(_price_long(spark, sf, True), ["cell"])
    d = D.drift_report(base, _price_long(spark, sf, False), ["cell"])
    return show(d, "psi", "wasserstein_rel", "n_actual", "is_hard", "severity", keys=("cell", "feature"))


@query("drift_mean_shift", BASE_SQL + """, a AS (SELECT cell, feature, avg(value) AS m, count(*) AS n_actual FROM ac GROUP BY 1, 2 HAVING count(*) >= 10)
  SELECT cell, feature, n_actual, round(abs(m - mean) / (greatest(std, 1e-9) / sqrt(n_actual)), 5) + 0.0 AS z, abs(m - mean) / (greatest(std, 1e-9) / sqrt(n_actual)) > 2.58 AS drifted FROM a JOIN base USING (cell, feature)""")
def drift_mean_shift(spark, sf):
    long = _price_long(spark, sf, True)
    base = long.groupBy("cell", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return show(D.mean_shift(base, _price_long(spark, sf, False), ["cell"]), "n_actual", "z", "drifted", keys=("cell", "feature"), digits=5)


@query("drift_pause_state", f"""WITH {TICKS_SQL}, {bars_sql('1h')}, p AS (SELECT symbol, ts, CASE WHEN close > 40 THEN trades_count ELSE 0 END AS pc, CASE WHEN close > 120 THEN 1 ELSE 0 END AS ec FROM bars),
  c AS (SELECT symbol, max(ts) FILTER (pc = 0) AS clean, arg_max(pc, ts) AS pause_count, arg_max(ec, ts) AS ec FROM p GROUP BY 1),
  s AS (SELECT p.symbol, count(*) FILTER (clean IS NULL OR ts > clean) AS consecutive FROM p JOIN c USING (symbol) GROUP BY 1),
  t AS (SELECT symbol, pause_count, consecutive, CASE WHEN pause_count = 0 THEN 'clean' WHEN ec > 0 THEN 'immediate' WHEN consecutive >= 3 THEN 'confirmed' ELSE 'watch' END AS tier FROM c JOIN s USING (symbol))
  SELECT *, tier IN ('immediate', 'confirmed') AS paused FROM t""")
def drift_pause_state(spark, sf):
    polls = bars(spark, sf, "1h").select(
        "symbol", "ts", F.when(F.col("close") > 40, F.col("trades_count")).otherwise(0).alias("pause_count"),
        F.when(F.col("close") > 120, 1).otherwise(0).alias("enforce_pause_count"),
    )
    return D.pause_state(polls, ["symbol"])


@query("validation_gate", LABEL_SQL + """, fr AS (SELECT symbol, max(ts) < 1706648400000000 - 7200000000 AS stale FROM bars GROUP BY 1),
  cb AS (SELECT symbol, count(*) AS n_classes, min(n) / sum(n) AS minority_pct FROM (SELECT symbol, label, count(*) AS n FROM lab GROUP BY 1, 2) GROUP BY 1),
  nd AS (SELECT symbol, sum(CASE WHEN atr_14 IS NULL THEN 1 ELSE 0 END) / (count(*) * 2) AS nan_pct FROM lab GROUP BY 1),
  dr AS (SELECT symbol, CAST(avg(close) > 50 AS BIGINT) AS n_drifted FROM bars GROUP BY 1),
  g AS (SELECT symbol, CASE WHEN stale THEN 'stale data' WHEN n_classes < 2 THEN 'only one class' WHEN minority_pct < 0.1 THEN 'label imbalance' WHEN nan_pct > 0.05 THEN 'null density'
    WHEN n_drifted > 0 THEN 'distribution drift' END AS reason, minority_pct, nan_pct FROM fr LEFT JOIN cb USING (symbol) LEFT JOIN nd USING (symbol) LEFT JOIN dr USING (symbol))
  SELECT symbol, reason, CASE WHEN reason IS NULL THEN 'APPROVE' WHEN reason = 'distribution drift' THEN 'WARN' ELSE 'BLOCK' END AS decision, round(minority_pct, 6) + 0.0 AS minority_pct, round(nan_pct, 6) + 0.0 AS nan_pct FROM g""")
def validation_gate(spark, sf):
    lab = labelled(spark, sf)
    now = F.timestamp_micros(F.lit(1_706_648_400_000_000))
    drift = bars(spark, sf).groupBy("symbol").agg((F.avg("close") > 50).cast("bigint").alias("n_drifted"))
    d = Q.validation_gate(
        Q.freshness(bars(spark, sf), "15m", now, ["symbol"]), Q.class_balance(lab, "label", ["symbol"]),
        Q.null_density(lab, ["atr_14", "close"], ["symbol"]), drift, ["symbol"],
    )
    return show(d, "reason", "decision", "minority_pct", "nan_pct", keys=("symbol",))


@query("decision_summary", f"""WITH {TICKS_SQL}, {bars_sql('1h')}, c AS (SELECT symbol, count(*) AS rows, arg_max(close, ts) AS close, arg_max(volume, ts) AS volume, count(*) > 100 AS m, max(close) > 400 AS cb, stddev_samp(close) / 8 AS dd FROM bars GROUP BY 1),
  k AS (SELECT symbol, rows, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume, concat_ws('; ', CASE WHEN rows = 0 THEN 'no rows' END, CASE WHEN NOT m THEN 'model not trained' END, CASE WHEN cb THEN 'circuit breaker active' END, CASE WHEN dd > 5 THEN 'drawdown above limit' END) AS blockers FROM c)
  SELECT *, blockers = '' AS go FROM k""")
def decision_summary(spark, sf):
    b = bars(spark, sf, "1h")
    by = b.groupBy("symbol")
    cov = by.agg(F.count(F.lit(1)).alias("rows"))
    last = by.agg(F.max_by("close", "ts").alias("close"), F.max_by("volume", "ts").alias("volume"))
    models = by.agg((F.count(F.lit(1)) > 100).alias("model_exists"))
    risk = by.agg((F.max("close") > 400).alias("circuit_breaker"), (F.stddev_samp("close") / 8).alias("drawdown_pct"))
    d = Q.go_no_go(cov, last, models, risk, ["symbol"]).withColumn("blockers", F.array_join("blockers", "; "))
    return show(d, "rows", "close", "volume", "blockers", "go", keys=("symbol",))
