"""Registered queries: summaries, rankings, trades, sets and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow import schemas
from barflow.functions import text as T
from barflow.operators import quality as Q
from barflow.operators import ranking as K
from barflow.operators import reports as R
from barflow.operators import trades as D
from barflow.plans.ordered import Series
from barflow.session import spread
from barflow.queries.base import TICKS_SQL, bar_series, bars, bars_sql, micros, query, r, show, sql_round, table, ticks
from barflow.queries.join_queries import COVER_SQL, KW_TONE, NEWS_SQL, _any, _present, news

# --- inputs derived from the order tables ----------------------------------------------------------

RESULTS_SQL = """o AS (SELECT *, o_totalprice / 1000 - 250 AS x, CASE WHEN o_orderpriority < '3' THEN 'A_' ELSE 'B_' END || substr(o_orderpriority, 3) AS strategy,
    o_orderstatus AS symbol, CASE quarter(o_orderdate) WHEN 1 THEN '1h' WHEN 2 THEN '4h' WHEN 3 THEN '1d' ELSE '1w' END AS timeframe FROM orders),
  res AS (SELECT strategy, symbol, timeframe, count(*) AS n_trades, 100 * avg(CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate_pct, sum(x) AS total_pnl, sum(x) + count(*) * 2.5 AS gross_pnl, count(*) * 2.5::DOUBLE AS total_fees,
    avg(x) / stddev_samp(x) AS sharpe, avg(x) / stddev_samp(CASE WHEN x < 0 THEN x END) AS sortino, avg(x) / 100 AS calmar, min(x) / 10 AS max_drawdown_pct,
    sum(CASE WHEN x > 0 THEN x ELSE 0 END) / sum(CASE WHEN x < 0 THEN -x ELSE 0 END) AS profit_factor FROM o GROUP BY 1, 2, 3),
  wf AS (SELECT substr(strategy, 3) AS strategy, timeframe, symbol, avg(x) / stddev_samp(x) AS wf_mean_sharpe, avg(CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END) AS wf_consistency, max(epoch_us(o_orderdate)) + max(o_orderkey) AS ts
    FROM o WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND timeframe <> '1w' GROUP BY 1, 2, 3)"""


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    q = F.quarter("o_orderdate")
    return o.withColumns({
        "x": F.col("o_totalprice") / 1000 - 250,
        "strategy": F.concat(F.when(F.col("o_orderpriority") < "3", "A_").otherwise("B_"), F.expr("substr(o_orderpriority, 3)")),
        "symbol": F.col("o_orderstatus"),
        "timeframe": F.when(q == 1, "1h").when(q == 2, "4h").when(q == 3, "1d").otherwise("1w"),
    })


def results(spark, sf):
    x, win = F.col("x"), F.when(F.col("x") > 0, 1.0).otherwise(0.0)
    return _orders(spark, sf).groupBy("strategy", "symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("n_trades"), (100 * F.avg(win)).alias("win_rate_pct"), F.sum(x).alias("total_pnl"),
        (F.sum(x) + F.count(F.lit(1)) * 2.5).alias("gross_pnl"), (F.count(F.lit(1)) * 2.5).alias("total_fees"),
        F.try_divide(F.avg(x), F.stddev_samp(x)).alias("sharpe"), F.try_divide(F.avg(x), F.stddev_samp(F.when(x < 0, x))).alias("sortino"), (F.avg(x) / 100).alias("calmar"),
        (F.min(x) / 10).alias("max_drawdown_pct"),
        F.try_divide(F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))).alias("profit_factor"),
    )


def walk_forward(spark, sf):
    d = _orders(spark, sf).where((F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")) & (F.col("timeframe") != "1w"))
    return d.groupBy(F.expr("substr(strategy, 3)").alias("strategy"), "timeframe", "symbol").agg(
        F.try_divide(F.avg("x"), F.stddev_samp("x")).alias("wf_mean_sharpe"), F.avg(F.when(F.col("x") > 0, 1.0).otherwise(0.0)).alias("wf_consistency"),
        (F.max(F.unix_micros("o_orderdate")) + F.max("o_orderkey")).alias("ts"),
    )


@query("strategy_summary", f"""WITH {RESULTS_SQL}, a AS (SELECT substr(strategy, 3) AS strategy, sum(n_trades)::BIGINT AS n_trades, ROUND(sum(total_pnl), 2) AS total_pnl, ROUND(sum(gross_pnl), 2) AS gross_pnl, ROUND(sum(total_fees), 2) AS total_fees,
    ROUND(ROUND(avg(win_rate_pct), 3), 1) AS win_rate_pct, {', '.join(f'ROUND(avg({c}), 3) + 0.0 AS {c}' for c in R.RATIOS if c != 'win_rate_pct')}, count(DISTINCT symbol) AS symbols FROM res GROUP BY 1),
  w AS (SELECT strategy, round(arg_max(wf_mean_sharpe, ts), 6) + 0.0 AS wf_mean_sharpe, round(arg_max(wf_consistency, ts), 6) + 0.0 AS wf_consistency FROM wf GROUP BY 1)
  SELECT * FROM a LEFT JOIN w USING (strategy)""")
def strategy_summary(spark, sf):
    d = R.strategy_summary(results(spark, sf), walk_forward(spark, sf))
    return d.withColumns({c: r(c) for c in ("wf_mean_sharpe", "wf_consistency")})


CELL_SQL = RESULTS_SQL + """, m AS (SELECT {k}, count(*) AS n_cells, sum(n_trades)::BIGINT AS n_trades, ROUND(sum(total_pnl), 2) AS total_pnl, ROUND(avg(sharpe), 3) + 0.0 AS sharpe_avg, ROUND(avg(win_rate_pct), 3) + 0.0 AS win_rate_avg,
    ROUND(avg(max_drawdown_pct), 3) + 0.0 AS maxdd_avg, ROUND(avg(profit_factor), 3) + 0.0 AS profit_factor_avg FROM ({res}) GROUP BY {k}),
  v AS (SELECT {k}, ROUND(avg(wf_mean_sharpe), 3) + 0.0 AS wf_sharpe_avg, ROUND(avg(wf_consistency), 3) + 0.0 AS wf_consistency_avg FROM ({wf}) GROUP BY {k}), cells AS (SELECT * FROM m LEFT JOIN v USING ({k}))"""
STAB_SQL = CELL_SQL.format(k="strategy, timeframe", res="SELECT * REPLACE (substr(strategy, 3) AS strategy) FROM res", wf="SELECT * FROM wf")


@query("strategy_stability", f"WITH {STAB_SQL} SELECT * FROM cells")
def strategy_stability(spark, sf):
    return R.stability_matrix(results(spark, sf), walk_forward(spark, sf))


@query("strategy_best_timeframe", f"WITH {STAB_SQL} SELECT strategy, arg_max(timeframe, (coalesce(wf_sharpe_avg, sharpe_avg), timeframe)) AS best_timeframe, max(coalesce(wf_sharpe_avg, sharpe_avg)) AS score FROM cells GROUP BY 1")
def strategy_best_timeframe(spark, sf):
    return R.best_timeframes(R.stability_matrix(results(spark, sf), walk_forward(spark, sf)))


@query("strategy_stability_pivot", f"""WITH {STAB_SQL} SELECT strategy, max(sharpe_avg) FILTER (timeframe = '1h') AS "1h", max(sharpe_avg) FILTER (timeframe = '4h') AS "4h", max(sharpe_avg) FILTER (timeframe = '1d') AS "1d", max(sharpe_avg) FILTER (timeframe = '1w') AS "1w" FROM cells GROUP BY 1""")
def strategy_stability_pivot(spark, sf):
    return R.pivot_matrix(R.stability_matrix(results(spark, sf), walk_forward(spark, sf)), "sharpe_avg", ["1h", "4h", "1d", "1w"])


_REG = "(SELECT DISTINCT substr(strategy, 3) AS strategy, CASE WHEN substr(strategy, 3) IN ('HIGH', 'LOW') THEN 'ml_driven' ELSE 'pure_rule' END AS bucket FROM res)"


@query("strategy_bucket_compare", "WITH " + CELL_SQL.format(
    k="bucket", res=f"SELECT res.*, g.bucket FROM res JOIN {_REG} g ON g.strategy = substr(res.strategy, 3)", wf=f"SELECT wf.*, g.bucket FROM wf JOIN {_REG} g USING (strategy)")
    + """ SELECT b.bucket, coalesce(n_cells, 0) AS n_cells, coalesce(n_trades, 0) AS n_trades, coalesce(total_pnl, 0) AS total_pnl, sharpe_avg, win_rate_avg, maxdd_avg, profit_factor_avg, wf_sharpe_avg, wf_consistency_avg
    FROM (VALUES ('pure_rule'), ('ml_driven'), ('meta_filtered')) b(bucket) LEFT JOIN cells USING (bucket)""")
def strategy_bucket_compare(spark, sf):
    res = results(spark, sf)
    reg = res.select(R.plain_name().alias("strategy")).distinct().withColumn("uses_model", F.col("strategy").isin("HIGH", "LOW"))
    return R.bucket_compare(res, walk_forward(spark, sf), reg)


@query("group_means", f"WITH {RESULTS_SQL} SELECT strategy[1] AS \"group\", count(*) AS n, {sql_round('avg(sharpe)').split(' AS ')[0]} AS sharpe, round(avg(win_rate_pct), 6) + 0.0 AS win_rate_pct, round(avg(total_pnl), 4) + 0.0 AS total_pnl FROM res GROUP BY 1")
def group_means(spark, sf):
    return R.group_means(results(spark, sf)).withColumns({"sharpe": r("sharpe"), "win_rate_pct": r("win_rate_pct"), "total_pnl": r("total_pnl", 4)})


@query("ranked_strategies", f"""WITH {RESULTS_SQL}, q AS (SELECT *, max((n_trades >= 30)::INT) OVER () AS ok FROM res)
  SELECT strategy, symbol, timeframe, n_trades, row_number() OVER (ORDER BY sharpe DESC, profit_factor DESC NULLS LAST, strategy, symbol, timeframe) AS rank FROM q WHERE n_trades >= CASE WHEN ok = 1 THEN 30 ELSE 10 END""")
def ranked_strategies(spark, sf):
    return show(K.ranked_strategies(results(spark, sf)), "n_trades", "rank", keys=("strategy", "symbol", "timeframe"))


@query("series_inventory", COVER_SQL + " SELECT symbol, timeframe, rows, first_ts, last_ts FROM pr")
def series_inventory(spark, sf):
    out = None
    for tf in ("15m", "1h", "1d"):
        b = bars(spark, sf, tf).select("symbol", F.lit(tf).alias("timeframe"), "ts")
        out = b if out is None else out.unionByName(b)
    return show(R.series_inventory(out), "rows", "first_ts", "last_ts", keys=("symbol", "timeframe"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in _TABLES))
def table_row_counts(spark, sf):
    return R.row_counts({t: table(spark, sf, t) for t in _TABLES})


@query("latest_times", COVER_SQL + """ SELECT symbol, timeframe, last_ts, round((1706652000000000 - last_ts) / 3600000000.0::DOUBLE, 4) + 0.0 AS gap_hours,
  (1706652000000000 - last_ts) / 1000000.0 > 1.5 * CASE timeframe WHEN '15m' THEN 900 WHEN '1h' THEN 3600 ELSE 86400 END AS needs_recovery FROM pr""")
def latest_times(spark, sf):
    out = []
    for tf in ("15m", "1h", "1d"):
        out.append(bars(spark, sf, tf).select("symbol", F.lit(tf).alias("timeframe"), "ts"))
    return show(R.latest_times(out, F.timestamp_micros(F.lit(1_706_652_000_000_000))), "last_ts", "gap_hours", "needs_recovery", keys=("symbol", "timeframe"), digits=4)


@query("portfolio_snapshot", """WITH t AS (SELECT o_orderpriority AS mode, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' END AS st, o_totalprice - 250000 AS pnl, o_orderdate FROM orders)
  SELECT mode, count(*) FILTER (st = 'open') AS n_open, count(*) FILTER (st = 'closed') AS n_closed, round(sum(CASE WHEN st = 'open' THEN pnl ELSE 0 END), 3) + 0.0 AS live_pnl, round(sum(CASE WHEN st = 'closed' THEN pnl ELSE 0 END), 3) + 0.0 AS closed_pnl,
    round(sum(CASE WHEN st = 'closed' AND o_orderdate >= TIMESTAMP '2001-07-01' THEN pnl ELSE 0 END), 3) + 0.0 AS today_pnl FROM t GROUP BY 1""")
def portfolio_snapshot(spark, sf):
    o = table(spark, sf, "orders")
    pnl = F.col("o_totalprice") - 250000
    t = o.select(F.col("o_orderpriority").alias("mode"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").alias("status"),
                 pnl.alias("pnl"), pnl.alias("unrealized_pnl"), F.col("o_orderdate").alias("closed_at"))
    d = R.portfolio_snapshot(t, F.lit("2001-07-01").cast("timestamp"))
    return show(d, "n_open", "n_closed", "live_pnl", "closed_pnl", "today_pnl", keys=("mode",), digits=3)


LEDGER_SQL = """WITH ev AS (SELECT o_custkey AS account, epoch_us(o_orderdate) AS ts, o_orderkey * 2 AS id, 'deposit' AS kind, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_custkey, epoch_us(o_orderdate), o_orderkey * 2 + 1, 'revenue', o_totalprice - 250000 FROM orders WHERE o_orderstatus <> 'O')"""


def _ledger(spark, sf):
    o = table(spark, sf, "orders")
    sel = lambda cond, amount, odd: o.where(cond).select(
        F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") * 2 + odd).alias("id"), amount.alias("amount"))
    return R.balance_events(sel("o_orderstatus = 'O'", F.col("o_totalprice"), 0), sel("o_orderstatus <> 'O'", F.col("o_totalprice") - 250000, 1))


@query("balance_summary", LEDGER_SQL + """, g AS (SELECT account, sum(CASE WHEN kind = 'deposit' THEN amount ELSE 0 END) AS deposits_total, count(*) FILTER (kind = 'deposit') AS deposits_count, sum(CASE WHEN kind = 'revenue' THEN amount ELSE 0 END) AS revenue_total FROM ev GROUP BY 1)
  SELECT account, deposits_count, round(deposits_total, 3) + 0.0 AS deposits_total, round(revenue_total, 3) + 0.0 AS revenue_total, round(deposits_total + revenue_total, 3) + 0.0 AS equity, round(revenue_total, 3) + 0.0 AS pnl FROM g""")
def balance_summary(spark, sf):
    return show(R.balance_summary(_ledger(spark, sf)), "deposits_count", "deposits_total", "revenue_total", "equity", "pnl", keys=("account",), digits=3)


@query("balance_curve", LEDGER_SQL + " SELECT account, id, round(sum(amount) OVER (PARTITION BY account ORDER BY ts, id), 3) + 0.0 AS equity FROM ev")
def balance_curve(spark, sf):
    ev = _ledger(spark, sf)
    return show(R.balance_curve(ev, Series.sampled(ev, ["account"], ["ts", "id"])), "equity", keys=("account", "id"), digits=3)


@query("pattern_stats", """SELECT o_orderpriority AS model, o_orderstatus AS scenario, year(o_orderdate) AS pattern, count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS wins, count(*) FILTER (NOT o_totalprice > 250000) AS losses,
  ROUND(avg(o_totalprice - 250000), 4) AS avg_pnl, ROUND(avg((o_totalprice > 250000)::INT) * 100, 1) AS win_rate FROM orders GROUP BY 1, 2, 3""")
def pattern_stats(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("scenario"), F.year("o_orderdate").cast("bigint").alias("pattern"),
        (F.col("o_totalprice") > 250000).alias("won"), (F.col("o_totalprice") - 250000).alias("pnl"))
    return R.pattern_stats(o)


@query("training_summary", f"""WITH {TICKS_SQL} SELECT symbol AS model, sum(volume)::BIGINT AS bars_trained, count(*) AS cycles, max(us) AS last_trained, round(arg_max(taker / 100, us), 6) + 0.0 AS accuracy, round(arg_max(1 / (1 + price), us), 6) + 0.0 AS loss, round(arg_max(price / 100, us), 6) + 0.0 AS sharpe FROM ticks GROUP BY 1""")
def training_summary(spark, sf):
    t = ticks(spark, sf).select(F.col("symbol").alias("model"), "ts", "id", F.col("volume").cast("bigint").alias("bars_trained"),
                                (F.col("taker") / 100).alias("accuracy"), (1 / (1 + F.col("price"))).alias("loss"), (F.col("price") / 100).alias("sharpe"))
    return show(R.training_summary(t), "bars_trained", "cycles", "last_trained", "accuracy", "loss", "sharpe", keys=("model",))


@query("paper_summary", "SELECT count(*) AS total_trades, ROUND(sum(o_totalprice - 250000), 2) AS total_pnl, ROUND(avg(o_totalprice - 250000), 4) AS avg_pnl, epoch_us(max(o_orderdate)) AS last_exit FROM orders")
def paper_summary(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_totalprice") - 250000).alias("pnl"), F.col("o_orderdate").alias("exit_ts"))
    return R.paper_summary(o).withColumn("last_exit", micros("last_exit"))


LINES_SQL = """lines AS (SELECT event_type || '.log' AS file, epoch_us(ts) AS ts, event_id AS id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || ' - worker - ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'click' THEN 'CRITICAL' ELSE 'INFO' END
  || ' - order ' || CAST(user_id AS VARCHAR) || ' for BTC_USDT and ETH/USDT failed:  PID ' || CAST(event_id AS VARCHAR) || ' see https://x.test/' || props || ' after -12.5e+03 s or ' || CAST(event_id * 1000 AS VARCHAR) || ' ticks ' AS line FROM events)"""


def _lines(spark, sf):
    e = spread(table(spark, sf, "events"))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").when(F.col("event_type") == "click", "CRITICAL").otherwise("INFO")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.lpad(F.pmod(F.floor(F.unix_micros("ts") / 1000), F.lit(1000)).cast("string"), 3, "0"))
    line = F.concat(stamp, F.lit(" - worker - "), level, F.lit(" - order "), F.col("user_id").cast("string"), F.lit(" for BTC_USDT and ETH/USDT failed:  PID "),
                    F.col("event_id").cast("string"), F.lit(" see https://x.test/"), F.col("props"), F.lit(" after -12.5e+03 s or "), (F.col("event_id") * 1000).cast("string"), F.lit(" ticks "))
    return e.select(F.concat("event_type", F.lit(".log")).alias("file"), "ts", F.col("event_id").alias("id"), line.alias("line"))


def _sql_sig(col: str) -> str:
    s = f"trim({col})"
    for pattern, token in T.LOG_TOKENS:
        s = f"regexp_replace({s}, '{pattern}', '{token}', 'g')"
    return s


@query("log_error_signatures", f"""WITH {LINES_SQL}, k AS (SELECT *, CASE upper(regexp_extract(line, '{R.LEVEL_PATTERN}', 1)) WHEN 'ERROR' THEN 'critical' WHEN 'CRITICAL' THEN 'critical' WHEN 'FATAL' THEN 'critical' WHEN 'WARNING' THEN 'warning' END AS kind FROM lines)
  SELECT kind, file, {_sql_sig('line')} AS signature, count(*) AS "count", min(ts) AS first_seen, max(ts) AS last_seen, arg_max(trim(line), ts) AS sample FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3""")
def log_error_signatures(spark, sf):
    return show(R.error_signatures(_lines(spark, sf)), "count", "first_seen", "last_seen", "sample", keys=("kind", "file", "signature"))


# --- run histories ---------------------------------------------------------------------------------

RUNS_SQL = """runs AS (SELECT c_mktsegment AS model, substr(o_orderpriority, 3) AS tf, epoch_us(date_trunc('month', o_orderdate)) AS ts, min(o_orderkey) AS run_id, count(*) AS n,
    100 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS accuracy_test, 0.4 + avg(CASE WHEN o_totalprice > 200000 THEN 0.3::DOUBLE ELSE 0 END) AS auc_roc, 100 * avg(CASE WHEN o_totalprice > 250000 THEN 1.0::DOUBLE ELSE 0 END) AS win_precision,
    avg(o_totalprice - 250000) / stddev_samp(o_totalprice) AS wf_sharpe, 1 + stddev_pop(o_totalprice) / 500000 AS overfit_ratio, list(o_totalprice / 1000 ORDER BY o_orderkey) AS folds
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
  okr AS (SELECT *, row_number() OVER (PARTITION BY model, tf ORDER BY ts DESC) AS rk FROM runs WHERE n >= 2 AND accuracy_test > 0)"""
SCORE = """CASE WHEN {a} IS NOT NULL OR {u} IS NOT NULL OR {w} IS NOT NULL THEN (coalesce({a} * 0.5, 0) + coalesce((50 + ({u} - 0.5) * 100) * 0.3, 0) + coalesce({w} * 0.2, 0))
  / (CASE WHEN {a} IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN {u} IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN {w} IS NOT NULL THEN 0.2 ELSE 0 END) END"""
SCORE_SQL = SCORE.format(a="nullif(accuracy_test, 0)", u="nullif(auc_roc, 0)", w="nullif(win_precision, 0)")


def run_history(spark, sf):
    """Monthly training runs per (segment, priority): metrics are shares and moments of that month's orders."""
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    p = F.col("o_totalprice")
    runs = d.groupBy(F.col("c_mktsegment").alias("model"), F.expr("substr(o_orderpriority, 3)").alias("tf"), F.date_trunc("month", "o_orderdate").alias("ts")).agg(
        F.min("o_orderkey").alias("run_id"), F.count(F.lit(1)).alias("n"),
        (100 * F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))).alias("accuracy_test"),
        (0.4 + F.avg(F.when(p > 200000, 0.3).otherwise(0.0))).alias("auc_roc"), (100 * F.avg(F.when(p > 250000, 1.0).otherwise(0.0))).alias("win_precision"),
        F.try_divide(F.avg(p - 250000), F.stddev_samp(p)).alias("wf_sharpe"), (1 + F.stddev_pop(p) / 500000).alias("overfit_ratio"),
    )
    runs = runs.withColumns({
        "error": F.when(F.col("n") < 2, "too few rows"), "artifact_path": F.when(F.col("accuracy_test") > 0, F.concat("model", F.lit(".bin"))), "cancelled": F.lit(False),
        "score": K.composite_score(K.present("accuracy_test"), K.present("auc_roc"), K.present("win_precision")),
        "hp": F.create_map(F.lit("depth"), F.col("n").cast("string"), F.lit("rate"), F.col("run_id").cast("string")),
    })
    return runs


def _cells_series(spark, sf, runs):
    return Series.sampled(runs, ["model", "tf"], ["ts"])


@query("runs_latest", f"WITH {RUNS_SQL} SELECT model, tf, ts, run_id FROM runs ORDER BY ts DESC, run_id DESC LIMIT 50")
def runs_latest(spark, sf):
    return show(K.latest_rows(run_history(spark, sf), 50, ["ts", "run_id"]), "run_id", keys=("model", "tf", "ts"))


@query("runs_last_successful", f"WITH {RUNS_SQL} SELECT model, tf, ts, run_id FROM okr WHERE rk <= 3")
def runs_last_successful(spark, sf):
    h = run_history(spark, sf)
    return show(K.last_successful(h, _cells_series(spark, sf, h), 3), "run_id", keys=("model", "tf", "ts"))


@query("runs_composite_score", f"WITH {RUNS_SQL} SELECT model, tf, ts, round({SCORE_SQL}, 6) + 0.0 AS score FROM runs")
def runs_composite_score(spark, sf):
    return show(run_history(spark, sf), "score", keys=("model", "tf", "ts"))


@query("runs_ranking", f"""WITH {RUNS_SQL}, l AS (SELECT model AS key, tf AS timeframe, ROUND({SCORE_SQL}, 3) AS score FROM okr WHERE rk = 1),
  k AS (SELECT *, row_number() OVER (ORDER BY score DESC, key, timeframe) AS rank, row_number() OVER (ORDER BY score, key DESC, timeframe DESC) AS b FROM l WHERE score IS NOT NULL)
  SELECT key, timeframe, score, rank, CASE WHEN rank <= 5 THEN 'TOP_' || rank END AS top_badge, CASE WHEN b <= 5 THEN 'BOT_' || b END AS bottom_badge FROM k""")
def runs_ranking(spark, sf):
    h = run_history(spark, sf)
    d = K.last_successful(h, _cells_series(spark, sf, h), 1).select(F.col("model").alias("key"), F.col("tf").alias("timeframe"), "score")
    return K.rankings(d).withColumn("rank", F.col("rank").cast("bigint"))


@query("runs_bake_off", f"""WITH {RUNS_SQL}, l AS (SELECT c.model, c.tf, r.wf_sharpe, c.n > 8 AS retired FROM (SELECT model, tf, max(n) AS n FROM runs GROUP BY 1, 2) c LEFT JOIN (SELECT * FROM okr WHERE rk = 1) r USING (model, tf)),
  k AS (SELECT *, row_number() OVER (ORDER BY wf_sharpe DESC NULLS LAST, model, tf) AS rank, count(wf_sharpe) OVER () AS np FROM l)
  SELECT model, tf, round(wf_sharpe, 6) + 0.0 AS wf_sharpe, rank, CASE WHEN retired THEN 'retire' WHEN wf_sharpe IS NULL THEN 'review' WHEN rank > floor(np * 0.8) AND rank <= np THEN 'retire' ELSE 'keep' END AS recommendation FROM k""")
def runs_bake_off(spark, sf):
    h = run_history(spark, sf)
    last = K.last_successful(h, _cells_series(spark, sf, h), 1).select("model", "tf", "wf_sharpe")
    cells = h.groupBy("model", "tf").agg((F.max("n") > 8).alias("retired")).join(last, ["model", "tf"], "left")
    return show(K.bake_off(cells, "wf_sharpe"), "wf_sharpe", "rank", "recommendation", keys=("model", "tf"))


@query("runs_kpi_gate", f"""WITH {RUNS_SQL}, m AS (SELECT model, tf, rk, list_filter([CASE WHEN accuracy_test IS NULL OR accuracy_test < 40 THEN 'accuracy_test' END, CASE WHEN overfit_ratio IS NULL OR overfit_ratio > 1.3 THEN 'overfit_ratio' END,
    CASE WHEN wf_sharpe IS NULL OR wf_sharpe < 0 THEN 'wf_sharpe' END], lambda x: x IS NOT NULL) AS missed FROM okr WHERE rk <= 3),
  g AS (SELECT model, tf, count(*) AS n_runs, count(*) FILTER (len(missed) > 0) AS n_failures, list_sort(list_distinct(flatten(list(missed)))) AS a FROM m GROUP BY 1, 2)
  SELECT model, tf, n_runs, n_failures, n_runs >= 3 AND n_failures >= 3 AS retire, CASE WHEN n_runs >= 3 AND n_failures >= 3 THEN array_to_string(a, ',') ELSE '' END AS missed_fields FROM g""")
def runs_kpi_gate(spark, sf):
    h = run_history(spark, sf)
    rules = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(b).alias("bound")) for f, b in (("accuracy_test", 40.0), ("overfit_ratio", 1.3), ("wf_sharpe", 0.0))])
    thresholds = h.select("model").distinct().select("model", F.explode(rules).alias("_r")).select("model", "_r.field", "_r.bound")
    d = K.threshold_misses(h, thresholds, ["accuracy_test", "overfit_ratio", "wf_sharpe"], ["model", "tf", "ts"])
    return K.kpi_gate(d, _cells_series(spark, sf, h))


@query("runs_fold_slope", f"""WITH m AS (SELECT o_orderpriority AS model, o_orderstatus AS tf, year(o_orderdate) AS y, month(o_orderdate) AS mo, avg(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2, 3, 4),
  f AS (SELECT model, tf, y, list(v ORDER BY mo) AS folds FROM m GROUP BY 1, 2, 3), e AS (SELECT model, tf, y, folds, unnest(folds) AS v, unnest(range(len(folds))) AS x FROM f),
  s AS (SELECT model, tf, y, any_value(folds) AS folds, regr_slope(v, x) AS b, avg(v) AS a FROM e GROUP BY 1, 2, 3)
  SELECT model, tf, y, len(folds) >= 3 AND a > 0 AND b / a < -0.02 AND folds[len(folds)] < folds[1] AS missed FROM s""")
def runs_fold_slope(spark, sf):
    """Twelve monthly fold scores at most per (priority, status, year)."""
    m = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("tf"), F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").alias("mo")
    ).agg((F.avg("o_totalprice") / 1000).alias("v"))
    f = m.groupBy("model", "tf", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("mo", "v"))), lambda s: s["v"]).alias("folds"))
    return f.select("model", "tf", "y", K.slope_missed("folds").alias("missed"))


@query("runs_winning_parameters", f"""WITH {RUNS_SQL}, s AS (SELECT *, {SCORE_SQL} AS score FROM runs) SELECT model, tf, round(max(score), 6) + 0.0 AS score, CAST(arg_max(n, (score, ts)) AS VARCHAR) AS depth, CAST(arg_max(run_id, (score, ts)) AS VARCHAR) AS rate FROM s WHERE score IS NOT NULL GROUP BY 1, 2""")
def runs_winning_parameters(spark, sf):
    d = K.winning_parameters(run_history(spark, sf))
    return d.select("model", "tf", r("score").alias("score"), F.col("hp")["depth"].alias("depth"), F.col("hp")["rate"].alias("rate"))


@query("runs_model_grid", f"""WITH {RUNS_SQL}, md AS (SELECT DISTINCT model FROM runs), g AS (SELECT model, t AS tf, t IN ('1w', 'LOW') AS experimental FROM md, (VALUES ('LOW'), ('HIGH'), ('URGENT'), ('1w')) v(t))
  SELECT g.model, g.tf, experimental, r.run_id, round(r.accuracy_test, 6) + 0.0 AS accuracy_test, coalesce(x.retired, FALSE) AS retired FROM g LEFT JOIN (SELECT * FROM okr WHERE rk = 1) r USING (model, tf)
  LEFT JOIN (SELECT model, tf, TRUE AS retired FROM runs GROUP BY 1, 2 HAVING max(n) > 8) x USING (model, tf)""")
def runs_model_grid(spark, sf):
    h = run_history(spark, sf)
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    models = h.select("model").distinct().select("model", lit("LOW", "HIGH", "URGENT").alias("applicable"), lit("1w", "LOW").alias("experimental"))
    latest = K.last_successful(h, _cells_series(spark, sf, h), 1).select("model", "tf", "run_id", "accuracy_test")
    retired = h.groupBy("model", "tf").agg(F.max("n").alias("n")).where("n > 8").select("model", "tf")
    return show(K.model_grid(models, latest, retired), "experimental", "run_id", "accuracy_test", "retired", keys=("model", "tf"))


@query("runs_baseline_deltas", f"""WITH {RUNS_SQL}, s AS (SELECT *, {SCORE_SQL} AS score FROM runs), b AS (SELECT model, tf, arg_min(run_id, ts) AS baseline_run, {', '.join(f'arg_min({f}, ts) AS b_{f}' for f in (*K.DELTA_FIELDS, 'score'))} FROM s GROUP BY 1, 2)
  SELECT model, tf, ts, run_id, baseline_run, run_id = baseline_run AS is_baseline, {', '.join(f'round(CASE WHEN run_id <> baseline_run THEN {f} - b_{f} END, 6) + 0.0 AS d_{f}' for f in (*K.DELTA_FIELDS, 'score'))} FROM s JOIN b USING (model, tf)""")
def runs_baseline_deltas(spark, sf):
    d = K.with_baseline_deltas(run_history(spark, sf))
    return show(d, "run_id", "baseline_run", "is_baseline", "d_accuracy_test", "d_auc_roc", "d_win_precision", "d_score", keys=("model", "tf", "ts"))


@query("strategy_regressions", f"""WITH {RESULTS_SQL}, b AS (SELECT strategy, avg(sharpe) AS old FROM res WHERE timeframe IN ('1h', '4h') GROUP BY 1), a AS (SELECT strategy, avg(sharpe) AS new FROM res WHERE timeframe IN ('1d', '1w') GROUP BY 1)
  SELECT strategy, round(old, 6) + 0.0 AS old, round(new, 6) + 0.0 AS new, new < CASE WHEN old > 0 THEN old * 0.9 ELSE old - 0.1 END AS regressed FROM b JOIN a USING (strategy)""")
def strategy_regressions(spark, sf):
    res = results(spark, sf)
    half = lambda *tf: res.where(F.col("timeframe").isin(*tf)).groupBy("strategy").agg(F.avg("sharpe").alias("value"))
    return show(K.regressions(half("1h", "4h"), half("1d", "1w")), "old", "new", "regressed", keys=("strategy",))


@query("strategy_pins", f"""WITH {STAB_SQL}, au AS (SELECT strategy, arg_max(timeframe, (coalesce(wf_sharpe_avg, sharpe_avg), timeframe)) AS auto FROM cells WHERE strategy <> 'HIGH' GROUP BY 1),
  mn AS (SELECT DISTINCT strategy, CASE WHEN strategy = 'LOW' THEN '15m' ELSE '' END AS manual FROM cells WHERE strategy IN ('LOW', 'HIGH'))
  SELECT coalesce(au.strategy, mn.strategy) AS strategy, coalesce(auto, '') AS auto, coalesce(manual, '') AS manual, coalesce(nullif(manual, ''), nullif(auto, ''), '1h') AS effective FROM au FULL JOIN mn ON au.strategy = mn.strategy""")
def strategy_pins(spark, sf):
    m = R.stability_matrix(results(spark, sf), walk_forward(spark, sf))
    auto = R.best_timeframes(m).where("strategy <> 'HIGH'").select("strategy", F.col("best_timeframe").alias("timeframe"))
    manual = m.where(F.col("strategy").isin("LOW", "HIGH")).select("strategy").distinct().withColumn("timeframe", F.when(F.col("strategy") == "LOW", "15m").otherwise(""))
    return K.resolve_pins(auto, manual)


# --- trades ----------------------------------------------------------------------------------------

TRADES_SQL = """tr AS (SELECT o_orderkey AS id, o_orderpriority AS strategy, epoch_us(o_orderdate) AS ts, o_totalprice / 1000 AS entry_price, mx / 300 AS exit_price, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS direction, q AS size, q * 0.001 AS fees, q * 0.0001 AS funding
  FROM orders JOIN (SELECT l_orderkey, max(l_extendedprice) AS mx, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
  pn AS (SELECT *, (exit_price - entry_price) / entry_price * direction * size - fees - funding AS pnl FROM tr)"""


def trade_table(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("mx"), F.sum("l_quantity").alias("size"))
    d = table(spark, sf, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 1000).alias("entry_price"),
                    (F.col("mx") / 300).alias("exit_price"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("direction"), "size",
                    (F.col("size") * 0.001).alias("fees"), (F.col("size") * 0.0001).alias("funding"))


@query("trade_pnl", f"WITH {TRADES_SQL} SELECT id, round(pnl, 6) + 0.0 AS pnl, round(CASE WHEN size > 0 THEN pnl / size ELSE 0 END, 6) + 0.0 AS return_pct FROM pn")
def trade_pnl(spark, sf):
    return show(D.with_pnl(trade_table(spark, sf)), "pnl", "return_pct", keys=("id",))


EQ_SQL = TRADES_SQL + """, eq AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY strategy ORDER BY ts, id) AS equity FROM pn)"""


@query("strategy_performance", f"""WITH {EQ_SQL}, r1 AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY ts, id) AS peak, equity / nullif(lag(equity) OVER (PARTITION BY strategy ORDER BY ts, id), 0) - 1 AS rr FROM eq),
  g AS (SELECT strategy, count(*) AS n, sum(pnl) AS tp, sum(fees + funding) AS tf, avg((pnl > 0)::INT) * 100 AS wr, avg(rr) AS m, stddev_samp(rr) AS sd, stddev_samp(CASE WHEN rr < 0 THEN rr END) AS dn, min((equity - peak) / peak) AS mdd,
    arg_min(equity, (ts, id)) AS fe, arg_max(equity, (ts, id)) AS le, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gw, abs(sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END)) AS gl FROM r1 GROUP BY 1)
  SELECT strategy, n AS n_trades, ROUND(tp, 2) AS total_pnl, ROUND(tp + tf, 2) AS gross_pnl, ROUND(tf, 2) AS total_fees, ROUND(wr, 1) AS win_rate_pct, ROUND(CASE WHEN sd > 0 THEN sqrt(8760) * m / sd ELSE 0 END, 3) AS sharpe,
    ROUND(CASE WHEN dn > 0 THEN sqrt(8760) * m / dn ELSE 0 END, 3) AS sortino, ROUND(CASE WHEN mdd <> 0 THEN ((le / fe) ** (8760.0 / n) - 1) / abs(mdd) ELSE 0 END, 3) AS calmar, ROUND(mdd * 100, 2) AS max_drawdown_pct,
    CASE WHEN gl > 0 THEN ROUND(gw / gl, 2) ELSE 'inf'::DOUBLE END AS profit_factor FROM g""")
def strategy_performance(spark, sf):
    t = D.with_pnl(trade_table(spark, sf))
    s = Series.sampled(t, ["strategy"], ["ts", "id"])
    return D.performance(t, D.equity_curve(t, s), s)


@query("trade_cost_columns", f"""WITH {TRADES_SQL}, c AS (SELECT *, size * 40 AS bookv, CASE WHEN direction > 0 THEN 'buy' ELSE 'sell' END AS side FROM pn),
  e AS (SELECT *, 0.5 * size / greatest(bookv, 1e-12) * 1e4 AS lin, 0.5 * size / greatest(bookv, 1e-12) * 1e4 + 4 AS cost FROM c)
  SELECT id, {sql_round('lin, cost')}, round(least(0.005, 0.001 * sqrt(greatest(size, 1) / greatest(bookv, 1))), 8) + 0.0 AS impact, round(CASE WHEN side = 'buy' THEN entry_price * (1 + cost / 1e4) ELSE entry_price * (1 - cost / 1e4) END, 6) + 0.0 AS executed,
    round(pnl - 2 * (cost / 1e4) * abs(pnl), 6) + 0.0 AS net_pnl, round(CASE WHEN direction > 0 THEN entry_price * (1 - 1 / 5.0::DOUBLE + 0.0004) / (1 - 0.005 - 0.0004) ELSE entry_price * (1 + 1 / 5.0::DOUBLE - 0.0004) / (1 + 0.005 + 0.0004) END, 6) + 0.0 AS liq_price,
    round(CASE WHEN (p * 2.5 - 1) / 1.5 <= 0 THEN 0 ELSE greatest(0.005, least((p * 2.5 - 1) / 1.5 * 0.5, 0.25)) END, 8) + 0.0 AS kelly, ROUND(20 / abs(entry_price - exit_price) * entry_price, 2) AS stop_size,
    round(entry_price - size * 0.1 * 0.04, 6) + 0.0 AS reserve FROM (SELECT *, least(size / 300, 1) AS p FROM e)""")
def trade_cost_columns(spark, sf):
    t = D.with_pnl(trade_table(spark, sf)).withColumns({"bookv": F.col("size") * 40, "side": F.when(F.col("direction") > 0, "buy").otherwise("sell")})
    c = F.col
    t = t.withColumns({"lin": D.linear_slippage_bps(c("size"), c("bookv")), "cost": D.total_cost_bps(c("size"), c("bookv"))})
    q = D.maker_quotes(c("entry_price"), c("size"), F.lit(0.2))
    t = t.withColumns({
        "impact": D.impact_slippage(c("size"), c("bookv")), "executed": D.executed_price(c("entry_price"), c("side"), c("cost")),
        "net_pnl": D.pnl_after_cost(c("pnl"), c("cost"), c("bookv")), "liq_price": D.liquidation_price(c("entry_price"), F.lit(5.0), c("direction") > 0),
        "kelly": D.kelly_fraction(F.least(c("size") / 300, F.lit(1.0)), F.lit(1.5)), "stop_size": D.size_from_stop(c("entry_price"), c("exit_price"), F.lit(20.0)), "reserve": q["reservation_price"],
    })
    return t.select("id", r("lin").alias("lin"), r("cost").alias("cost"), r("impact", 8).alias("impact"), r("executed").alias("executed"), r("net_pnl").alias("net_pnl"),
                    r("liq_price").alias("liq_price"), r("kelly", 8).alias("kelly"), "stop_size", r("reserve").alias("reserve"))


@query("book_walk_fills", f"""WITH {TICKS_SQL}, lv AS (SELECT id, taker AS size, price AS mid, volume > 50 AS buy, unnest(range(5)) AS j, unnest([price * (1 + 0.001 * g) for g in range(5)]) AS up, unnest([price * (1 - 0.001 * g) for g in range(5)]) AS dn, unnest([(volume + g) / 6 for g in range(5)]) AS qty FROM ticks),
  c AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lv),
  k AS (SELECT *, greatest(least(qty, size - before), 0) AS take, (size > before)::INT AS used, CASE WHEN buy THEN up ELSE dn END AS p FROM c),
  g AS (SELECT id, any_value(size) AS size, any_value(mid) AS mid, any_value(buy) AS buy, sum(take) AS f, sum(take * p) AS nt, sum(used) AS u FROM k GROUP BY 1)
  SELECT id, round(CASE WHEN size <= 0 OR f <= 0 THEN 0 ELSE f END, 6) + 0.0 AS fill_size, round(CASE WHEN size <= 0 OR f <= 0 THEN 0 ELSE nt / f END, 6) + 0.0 AS avg_price,
    round(CASE WHEN size <= 0 THEN 0 WHEN f <= 0 THEN 10000 WHEN buy THEN (nt / f / mid - 1) * 1e4 ELSE (1 - nt / f / mid) * 1e4 END, 5) + 0.0 AS slippage_bps, CASE WHEN size <= 0 THEN 0 ELSE u END::BIGINT AS levels_used FROM g""")
def book_walk_fills(spark, sf):
    buy = F.col("volume") > 50
    lv = F.array(*[F.struct(
        F.when(buy, F.col("price") * (1 + 0.001 * j)).otherwise(F.col("price") * (1 - 0.001 * j)).alias("price"), ((F.col("volume") + j) / 6).alias("qty")) for j in range(5)])
    t = spread(ticks(spark, sf)).withColumn("levels", lv)
    d = t.select("id", D.book_walk("levels", F.col("taker"), buy, F.col("price")).alias("_f")).select("id", "_f.*")
    return d.select("id", r("fill_size").alias("fill_size"), r("avg_price").alias("avg_price"), r("slippage_bps", 5).alias("slippage_bps"), F.col("levels_used").cast("bigint").alias("levels_used"))


@query("book_top_levels", f"""WITH {TICKS_SQL} SELECT id, round(price, 6) + 0.0 AS p_bid, round(price * 1.001, 6) + 0.0 AS p_ask, round((volume + volume + 1 + volume + 2) / 6, 6) + 0.0 AS v_bid, round((taker + taker + 1 + taker + 2) / 6, 6) + 0.0 AS v_ask FROM ticks""")
def book_top_levels(spark, sf):
    from barflow.functions.book import top_of_book

    # an array of ten expressions, not a function of the level: that would parse the event's JSON again for each level
    side = lambda f, q: F.array(*[F.struct((F.col("price") * f * (1 + 0.001 * j)).alias("price"), ((F.col(q) + j) / 6).alias("qty")) for j in range(10)])
    t = spread(ticks(spark, sf)).select("id", side(1.0, "volume").alias("bids"), side(1.001, "taker").alias("asks"))
    d = top_of_book(t, 3)
    return show(d, "p_bid", "p_ask", "v_bid", "v_ask", keys=("id",))


@query("trailing_stops", f"""WITH {TICKS_SQL}, {bars_sql()}, t AS (SELECT id, symbol, us - us % 900000000 AS eb, price AS e, CASE WHEN taker > 25 THEN 1 ELSE -1 END AS dir FROM ticks),
  p AS (SELECT t.id, t.e, t.dir, f.ts, f.close, greatest(e, max(f.close) OVER w) AS hi, least(e, min(f.close) OVER w) AS lo FROM t JOIN bars b ON b.symbol = t.symbol AND b.ts = t.eb JOIN bars f ON f.symbol = b.symbol AND f.i > b.i
    WINDOW w AS (PARTITION BY t.id ORDER BY f.ts)),
  h AS (SELECT id, min(ts) AS stop_ts FROM p WHERE CASE WHEN dir > 0 THEN close <= hi * 0.98 ELSE close >= lo * 1.02 END GROUP BY 1),
  q AS (SELECT p.id, any_value(e) AS e, any_value(dir) AS dir, max(hi) AS hi, min(lo) AS lo, any_value(stop_ts) AS stop_ts, max(CASE WHEN ts = stop_ts THEN close END) AS stop_price FROM p LEFT JOIN h USING (id) WHERE stop_ts IS NULL OR ts <= stop_ts GROUP BY 1)
  SELECT t.id, stop_ts, round(stop_price, 6) + 0.0 AS stop_price, round(coalesce(100 * greatest(CASE WHEN q.dir > 0 THEN hi / q.e - 1 ELSE -(lo / q.e - 1) END, 0), 0), 6) + 0.0 AS mfe_pct,
    round(coalesce(100 * least(CASE WHEN q.dir > 0 THEN lo / q.e - 1 ELSE -(hi / q.e - 1) END, 0), 0), 6) + 0.0 AS mae_pct FROM t LEFT JOIN q USING (id)""")
def trailing_stops(spark, sf):
    us = F.unix_micros("ts")
    t = ticks(spark, sf).select("id", "symbol", F.timestamp_micros(us - F.pmod(us, F.lit(900_000_000))).alias("entry_bar"), F.col("price").alias("entry_price"), F.when(F.col("taker") > 25, 1).otherwise(-1).alias("direction"))
    return show(D.trailing_stops(t, bars(spark, sf), bar_series()), "stop_ts", "stop_price", "mfe_pct", "mae_pct", keys=("id",))


@query("trades_closed", f"""WITH {TRADES_SQL}, c AS (SELECT id, CASE WHEN direction < 0 THEN entry_price - exit_price ELSE exit_price - entry_price END * size AS pnl, size * entry_price AS inv FROM tr)
  SELECT id, round(pnl, 5) + 0.0 AS pnl, round(pnl / nullif(inv, 0) * 100, 5) + 0.0 AS pnl_percent, CASE WHEN pnl > 0 THEN 'TP' WHEN pnl < 0 THEN 'SL' ELSE 'flat' END AS exit_reason FROM c""")
def trades_closed(spark, sf):
    t = trade_table(spark, sf).withColumns({"side": F.when(F.col("direction") < 0, "SHORT"), "amount": F.col("size"), "invested": F.col("size") * F.col("entry_price"), "exit_reason": F.lit(None).cast("string")})
    return show(D.close_trades(t), "pnl", "pnl_percent", "exit_reason", keys=("id",), digits=5)


@query("trades_backfilled", """SELECT o_orderkey AS id, CASE WHEN o_orderpriority < '3' THEN 'live' ELSE 'testnet' END AS mode, o_orderpriority >= '3' AS mode_inferred, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_totalprice > 400000 THEN 'unknown' WHEN o_totalprice > 200000 THEN 'TP' WHEN o_totalprice < 200000 THEN 'SL' ELSE 'flat' END AS exit_reason FROM orders""")
def trades_backfilled(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") < "3", "live").alias("mode"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status"),
        F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice") - 200000).alias("pnl"), F.lit(None).cast("string").alias("exit_reason"), F.lit(None).cast("double").alias("mfe_pct"), F.lit(None).cast("double").alias("mae_pct"))
    return D.backfill_trades(o).select("id", "mode", "mode_inferred", "exit_reason")


@query("strategy_pnl_history", f"WITH {TRADES_SQL} SELECT strategy, id, round(sum(pnl) OVER (PARTITION BY strategy ORDER BY ts, id), 5) + 0.0 AS cumulative FROM pn WHERE ts >= epoch_us(TIMESTAMP '2000-01-01')")
def strategy_pnl_history(spark, sf):
    t = D.with_pnl(trade_table(spark, sf))
    s = Series.sampled(t, ["strategy"], ["ts", "id"])
    return show(D.pnl_history(t, s, F.lit("2000-01-01").cast("timestamp")), "cumulative", keys=("strategy", "id"), digits=5)


@query("sharpe_degradation", f"""WITH {TRADES_SQL}, l AS (SELECT * FROM pn QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY ts DESC, id DESC) <= 100), v AS (SELECT strategy, count(*) AS n, CASE WHEN count(*) >= 10 AND stddev_pop(pnl) > 0 THEN sqrt(8760) * avg(pnl) / stddev_pop(pnl) ELSE 0 END AS ls FROM l GROUP BY 1),
  b AS (SELECT strategy, sqrt(8760) * avg(pnl) / stddev_pop(pnl) AS bs FROM pn GROUP BY 1) SELECT b.strategy, n, round(bs, 6) + 0.0 AS backtest_sharpe, round(coalesce(ls, 0), 6) + 0.0 AS live_sharpe, bs > 0 AND coalesce(ls, 0) < bs * 0.5 AS degraded FROM b LEFT JOIN v USING (strategy)""")
def sharpe_degradation(spark, sf):
    t = D.with_pnl(trade_table(spark, sf))
    s = Series.sampled(t, ["strategy"], ["ts", "id"])
    base = t.groupBy("strategy").agg((8760**0.5 * F.avg("pnl") / F.stddev_pop("pnl")).alias("backtest_sharpe"))
    return show(D.sharpe_degradation(t, base, s), "n", "backtest_sharpe", "live_sharpe", "degraded", keys=("strategy",))


@query("breaker_state", f"""WITH {TICKS_SQL}, t AS (SELECT symbol, us AS ts, id, price - 45 AS pnl, volume * 6 AS latency_ms FROM ticks), e AS (SELECT symbol, max(ts) AS en, max(CASE WHEN pnl > 0 THEN ts END) AS win, count(*) AS n_trades FROM t GROUP BY 1),
  a AS (SELECT t.symbol, any_value(n_trades) AS n_trades, sum(CASE WHEN ts // 86400000000 = en // 86400000000 THEN pnl ELSE 0 END) / 100 AS daily_r, count(*) FILTER (win IS NULL OR ts > win) AS losses, quantile_cont(CASE WHEN ts >= en - 300000000 THEN latency_ms END, 0.99) AS latency_p99 FROM t JOIN e USING (symbol) GROUP BY 1),
  c AS (SELECT symbol, ts, 10000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY ts) AS eq FROM t), d AS (SELECT symbol, max((pk - eq) / pk) AS drawdown FROM (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM c) GROUP BY 1),
  b AS (SELECT symbol, avg(volume) / 50 AS bz FROM ticks GROUP BY 1),
  j AS (SELECT *, CASE WHEN daily_r <= -3 THEN 'daily_loss' WHEN losses >= 5 THEN 'consecutive_losses' WHEN latency_p99 > 500 THEN 'latency_p99' WHEN drawdown >= 0.08 THEN 'drawdown' WHEN abs(bz) >= 2 THEN 'calibration' END AS trigger FROM a JOIN d USING (symbol) JOIN b USING (symbol))
  SELECT symbol, n_trades, {sql_round('daily_r, latency_p99, drawdown')}, losses, trigger, trigger IS NOT NULL AS paused FROM j""")
def breaker_state(spark, sf):
    t = ticks(spark, sf).select("symbol", "ts", "id", (F.col("price") - 45).alias("pnl"), (F.col("volume") * 6).alias("latency_ms"), "volume")
    s = Series.sampled(t, ["symbol"], ["ts", "id"])
    brier = t.groupBy("symbol").agg((F.avg("volume") / 50).alias("brier_z"))
    return show(D.breaker_state(t, s, brier), "n_trades", "daily_r", "losses", "latency_p99", "drawdown", "trigger", "paused", keys=("symbol",))


# --- sets, parsing, text ---------------------------------------------------------------------------

@query("union_stores", f"""WITH {TICKS_SQL}, {bars_sql('1h', 'a')}, {bars_sql('1d', 'b')} SELECT symbol, '1h' AS timeframe, ts, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume FROM a UNION ALL SELECT symbol, '1d', ts, round(close, 6) + 0.0, NULL FROM b""")
def union_stores(spark, sf):
    a = bars(spark, sf, "1h").select("symbol", F.lit("1h").alias("timeframe"), "ts", "close", "volume")
    b = bars(spark, sf, "1d").select("symbol", F.lit("1d").alias("timeframe"), "ts", "close")
    return show(a.unionByName(b, allowMissingColumns=True), "close", "volume", keys=("symbol", "timeframe", "ts"))


@query("distinct_months", "SELECT DISTINCT event_type AS symbol, strftime(ts, '%Y-%m') AS yyyymm, strftime(ts, '%Y%m%d') AS yyyymmdd, strftime(ts, '%Y') AS yyyy FROM events")
def distinct_months(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), *[F.date_format("ts", f).alias(n) for n, f in (("yyyymm", "yyyy-MM"), ("yyyymmdd", "yyyyMMdd"), ("yyyy", "yyyy"))]).distinct()


@query("dedupe_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id, round(arg_min(value, event_id), 6) + 0.0 AS value FROM events GROUP BY 1, 2")
def dedupe_keep_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return show(Q.keep_last(e, ["user_id", "event_type"], ["event_id"], first=True), "event_id", "value", keys=("user_id", "event_type"))


@query("news_dedupe", "SELECT min(doc_id) AS doc_id, text AS title, source FROM documents GROUP BY text, source")
def news_dedupe(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"), "source")
    return Q.keep_last(d, ["title", "source"], ["doc_id"], first=True)


@query("missing_months", """WITH k AS (SELECT DISTINCT event_type AS symbol FROM events), m AS (SELECT symbol, strftime(d, '%Y-%m') AS yyyymm FROM k, range(TIMESTAMP '2023-11-01', TIMESTAMP '2024-04-01', INTERVAL 1 MONTH) t(d)) SELECT * FROM m WHERE (symbol, yyyymm) NOT IN (SELECT (event_type, strftime(ts, '%Y-%m')) FROM events)""")
def missing_months(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM").alias("yyyymm")).distinct()
    months = F.explode(F.transform(F.expr("sequence(date'2023-11-01', date'2024-03-01', interval 1 month)"), lambda d: F.date_format(d, "yyyy-MM")))
    return e.select("symbol").distinct().select("symbol", months.alias("yyyymm")).join(e, ["symbol", "yyyymm"], "left_anti")


WORDS = r"list_distinct(list_transform(regexp_split_to_array(trim(text), '\s+'), lambda w: lower(trim(w, '.,!?:;''""()'))))"


def _lst(v):
    return "[" + ", ".join(f"'{x}'" for x in v) + "]"


TEXT_OUT = lambda d, key: d.select(
    F.col(key).alias("id"), T.lexicon_tone("text").alias("lexicon"), r(T.keyword_tone("text")).alias("keyword"), T.channel_signal("text").alias("channel"),
    T.category_match(F.col("text"), "er, Ation,the rest").alias("matches"), F.size(T.words("text")).cast("bigint").alias("n_words"))


def _text_sql(src: str, key: str) -> str:
    return f"""WITH d AS (SELECT {key} AS id, text, text AS title, {WORDS} AS w FROM {src}), c AS (SELECT *, len(list_filter(w, lambda x: list_contains({_lst(T.POSITIVE_WORDS)}, x))) AS p, len(list_filter(w, lambda x: list_contains({_lst(T.NEGATIVE_WORDS)}, x))) AS n FROM d)
  SELECT id, CASE WHEN p + n = 0 THEN 0 ELSE ROUND((p - n)::DOUBLE / greatest(p + n, 1), 3) END AS lexicon, round({KW_TONE}, 6) + 0.0 AS keyword, CASE WHEN {_any('lower(text)', T.CHANNEL_BULL)} THEN 1.0::DOUBLE WHEN {_any('lower(text)', T.CHANNEL_BEAR)} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS channel,
    {_any('lower(text)', ['er', 'ation', 'the rest'])} AS matches, len(w)::BIGINT AS n_words FROM c"""


@query("text_tone_documents", _text_sql("documents", "doc_id"))
def text_tone_documents(spark, sf):
    return TEXT_OUT(spread(table(spark, sf, "documents")), "doc_id")


@query("text_tone_conversations", _text_sql("(SELECT conv_id * 1000000 + turn AS k, text FROM conversations)", "k"))
def text_tone_conversations(spark, sf):
    return TEXT_OUT(spread(table(spark, sf, "conversations")).withColumn("k", F.col("conv_id") * 1_000_000 + F.col("turn")), "k")


@query("label_tone", """SELECT doc_id, CASE WHEN toxic = 1 THEN -ROUND(q, 3) WHEN quality = 1 THEN ROUND(q, 3) ELSE 0.0::DOUBLE END AS tone FROM (SELECT *, n_chars / (n_chars + 700.0::DOUBLE) AS q FROM documents JOIN labels USING (doc_id))""")
def label_tone(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    lab = F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "LABEL_2 bullish").otherwise("neutral")
    return d.select("doc_id", T.label_tone(lab, F.col("n_chars") / (F.col("n_chars") + 700.0)).alias("tone"))


@query("symbol_parsing", """WITH s AS (SELECT c_custkey, lower(c_mktsegment) || CASE WHEN c_nationkey < 12 THEN '/usdt' ELSE ' €uro' END AS raw FROM customer)
  SELECT c_custkey, CASE WHEN regexp_full_match(upper(regexp_replace(trim(raw), '[/ ,]', '_', 'g')), '[A-Z0-9_.\\-]+') THEN upper(regexp_replace(trim(raw), '[/ ,]', '_', 'g')) END AS symbol, split_part(upper(replace(raw, '/', '_')), '_', 1) AS coin FROM s""")
def symbol_parsing(spark, sf):
    raw = F.concat(F.lower("c_mktsegment"), F.when(F.col("c_nationkey") < 12, "/usdt").otherwise(" €uro"))
    return table(spark, sf, "customer").select("c_custkey", T.safe_symbol(raw).alias("symbol"), T.coin_token(raw).alias("coin"))


@query("epoch_parsing", """SELECT event_id, CASE WHEN value < 20 THEN us // 1000000 * 1000000 WHEN value < 50 THEN us // 1000 * 1000 ELSE us END AS parsed FROM (SELECT event_id, value, epoch_us(ts) AS us FROM events)""")
def epoch_parsing(spark, sf):
    us = F.unix_micros("ts")
    raw = F.when(F.col("value") < 20, F.floor(us / 1_000_000)).when(F.col("value") < 50, F.floor(us / 1000)).otherwise(us * 1000)
    return table(spark, sf, "events").select("event_id", micros(T.epoch_to_timestamp(raw.cast("bigint"))).alias("parsed"))


@query("calendar_features", f"""WITH {TICKS_SQL}, {bars_sql()} SELECT symbol, ts, hour(make_timestamp(ts)) AS hour, isodow(make_timestamp(ts)) - 1 AS day_of_week, round(sin(2 * pi() * hour(make_timestamp(ts)) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(make_timestamp(ts)) / 24), 6) + 0.0 AS hour_cos,
  round(sin(2 * pi() * (isodow(make_timestamp(ts)) - 1) / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(make_timestamp(ts)) - 1) / 7), 6) + 0.0 AS dow_cos, round(taker_buy_base / CASE WHEN volume = 0 THEN 0.0001 ELSE volume END, 6) + 0.0 AS taker_buy_ratio, round(volume / CASE WHEN trades_count = 0 THEN 1 ELSE trades_count END, 6) + 0.0 AS avg_trade_size FROM bars""")
def calendar_features(spark, sf):
    from barflow.operators.derive import calendar, taker_features

    return show(taker_features(calendar(bars(spark, sf))), "hour", "day_of_week", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "taker_buy_ratio", "avg_trade_size")


@query("schema_coercion", f"""WITH {TICKS_SQL} SELECT us AS ts, symbol, NULL::VARCHAR AS timeframe, CASE WHEN volume > 90 THEN 0 ELSE round(price, 6) END + 0.0 AS open, round(price, 6) + 0.0 AS close FROM ticks""")
def schema_coercion(spark, sf):
    t = ticks(spark, sf)
    raw = t.select(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("ts"), "symbol", F.when(F.col("volume") > 90, "n/a").otherwise(F.col("price").cast("string")).alias("open"), F.col("price").cast("string").alias("close"))
    d = schemas.coerce(raw, "market_data").withColumn("open", F.coalesce("open", F.lit(0.0)))
    return show(d, "symbol", "timeframe", "open", "close", keys=("ts",))


@query("news_clean", """WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, source, lang FROM documents) SELECT doc_id, t AS title, 'https://news.test/' || doc_id AS url, 'feed' AS source, lang AS language, source AS domain, 'ALL' AS coin, 1704067200000000 + doc_id * 2580000000 // 1000000 * 1000000 AS ts FROM d WHERE t <> '' AND lang <> 'de'""")
def news_clean(spark, sf):
    d = news(spark, sf)
    url = F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit("https://news.test/"), F.col("id").cast("string")))
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    out = T.clean_news(d, "feed", F.col("title"), url, F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.col("lang"), F.col("source"), F.lit("ALL"), T.lexicon_tone("title"))
    return out.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "title", "url", "source", "language", "domain", "coin", micros().alias("ts"))


@query("json_array_functions", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, len(v) AS n, round(list_sum(list_transform(v, lambda x: x * x)), 6) + 0.0 AS sq, round(v[1], 6) + 0.0 AS first_value,
  round(list_max(v), 6) + 0.0 AS max_value, round(v[64] - v[1], 6) + 0.0 AS span FROM v""")
def json_array_functions(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    named = F.map_from_arrays(F.array(F.lit("first"), F.lit("last")), F.array(F.get("v", F.lit(0)), F.element_at("v", -1)))
    return e.withColumn("m", named).select(
        "vec_id", F.size("v").cast("bigint").alias("n"), r(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)).alias("sq"),
        r(F.col("m")["first"]).alias("first_value"), r(F.array_max("v")).alias("max_value"), r(F.col("m")["last"] - F.col("m")["first"]).alias("span"))


@query("json_payload_access", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_array_length(json_keys(props)::JSON)::BIGINT AS n_keys FROM events""")
def json_payload_access(spark, sf):
    e = table(spark, sf, "events")
    parsed = F.from_json("props", "k BIGINT")
    return e.select("event_id", parsed["k"].alias("k"), F.size(F.expr("json_object_keys(props)")).cast("bigint").alias("n_keys"))


@query("news_backfilled_columns", "SELECT page_id, CASE WHEN length(url) > 40 THEN url ELSE html END AS title, '' AS summary FROM pages")
def news_backfilled_columns(spark, sf):
    p = table(spark, sf, "pages")
    even = F.length("url") > 40
    d = p.select("page_id", F.when(even, F.col("url")).otherwise("  ").alias("title"), F.when(~even, F.col("html")).alias("headline"))
    return T.backfill_columns(d, {"title": ["news_title", "headline"], "summary": ["description"]}).select("page_id", "title", "summary")
