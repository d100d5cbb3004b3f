"""Registered queries: as-of, band, range and calendar joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions import text as T
from barflow.functions.numeric import nonzero
from barflow.operators import alignment as A
from barflow.operators import bars as B
from barflow.plans.asof import asof_join
from barflow.plans.ordered import Series
from barflow.session import spread
from barflow.queries.base import TICKS_SQL, bar_series, bars, bars_sql, micros, query, r, show, sql_round, table, ticks


def of_type(spark, sf, kind):
    return table(spark, sf, "events").where(F.col("event_type") == kind).select("event_id", "ts", "user_id", "value")


ASOF_BASE = """WITH p AS (SELECT event_id, epoch_us(ts) AS us, ts, user_id, value FROM events WHERE event_type = 'purchase'),
v AS (SELECT event_id AS v_id, epoch_us(ts) AS v_us, ts AS v_ts, user_id, value AS quote FROM events WHERE event_type = 'view')"""


def _quotes(spark, sf):
    return of_type(spark, sf, "view").select("user_id", "ts", F.col("event_id").alias("v_id"), F.col("value").alias("quote"))


def _asof_out(d):
    return d.select("event_id", "user_id", micros().alias("ts"), r("quote").alias("quote"), micros("quote_ts").alias("quote_ts"))


@query("asof_backward", ASOF_BASE + """ SELECT p.event_id, p.user_id, p.us AS ts, round(v.quote, 6) + 0.0 AS quote, v.v_us AS quote_ts
  FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.v_ts""")
def asof_backward(spark, sf):
    return _asof_out(asof_join(of_type(spark, sf, "purchase"), _quotes(spark, sf), ["user_id"], "ts", "ts", ["quote"],
                               right_tie=["v_id"], matched_ts="quote_ts"))


@query("asof_forward", ASOF_BASE + """ SELECT p.event_id, p.user_id, p.us AS ts, round(v.quote, 6) + 0.0 AS quote, v.v_us AS quote_ts
  FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.v_ts""")
def asof_forward(spark, sf):
    return _asof_out(asof_join(of_type(spark, sf, "purchase"), _quotes(spark, sf), ["user_id"], "ts", "ts", ["quote"],
                               right_tie=["v_id"], matched_ts="quote_ts", direction="forward"))


@query("asof_nearest", ASOF_BASE + """, b AS (SELECT p.event_id, v.v_us AS bu, v.quote AS bq FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.v_ts),
  f AS (SELECT p.event_id, v.v_us AS fu, v.quote AS fq FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.v_ts)
  SELECT p.event_id, p.user_id, p.us AS ts, round(CASE WHEN bu IS NULL OR fu - us <= us - bu THEN fq ELSE bq END, 6) + 0.0 AS quote,
    CASE WHEN bu IS NULL OR fu - us <= us - bu THEN fu ELSE bu END AS quote_ts FROM p JOIN b USING (event_id) JOIN f USING (event_id)""")
def asof_nearest(spark, sf):
    return _asof_out(asof_join(of_type(spark, sf, "purchase"), _quotes(spark, sf), ["user_id"], "ts", "ts", ["quote"],
                               right_tie=["v_id"], matched_ts="quote_ts", direction="nearest"))


@query("asof_tolerance", ASOF_BASE + """, j AS (SELECT p.event_id, p.user_id, p.us AS ts, v.quote, v.v_us FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.v_ts)
  SELECT event_id, user_id, ts, round(CASE WHEN ts - v_us <= 28800000000 THEN quote END, 6) + 0.0 AS quote, CASE WHEN ts - v_us <= 28800000000 THEN v_us END AS quote_ts FROM j""")
def asof_tolerance(spark, sf):
    return _asof_out(asof_join(of_type(spark, sf, "purchase"), _quotes(spark, sf), ["user_id"], "ts", "ts", ["quote"],
                               right_tie=["v_id"], matched_ts="quote_ts", tolerance=F.expr("INTERVAL 8 HOURS")))


def funding(spark, sf):
    """Eight-hourly funding points per symbol, from the flow of the eight-hour window."""
    b = bars(spark, sf, "4h")
    return b.select("symbol", "ts", ((F.col("taker_buy_base") / nonzero("volume", 1.0) - 0.5) / 100).alias("funding_rate"))


FUND_SQL = f"""WITH {TICKS_SQL}, {bars_sql()}, {bars_sql('4h', 'b4')},
fnd AS (SELECT symbol, ts AS f_ts, (taker_buy_base / CASE WHEN volume = 0 THEN 1 ELSE volume END - 0.5) / 100 AS funding_rate FROM b4)"""


@query("join_funding", FUND_SQL + " SELECT b.symbol, b.ts, round(coalesce(f.funding_rate, 0), 8) + 0.0 AS funding_rate FROM bars b ASOF LEFT JOIN fnd f ON b.symbol = f.symbol AND b.ts >= f.f_ts")
def join_funding(spark, sf):
    return show(A.merge_funding(bars(spark, sf), funding(spark, sf)), "funding_rate", digits=8)


@query("join_funding_tolerance", FUND_SQL + """ SELECT b.symbol, b.ts, round(CASE WHEN b.ts - f.f_ts <= 3600000000 THEN f.funding_rate END, 8) + 0.0 AS funding_rate
  FROM bars b ASOF LEFT JOIN fnd f ON b.symbol = f.symbol AND b.ts >= f.f_ts""")
def join_funding_tolerance(spark, sf):
    d = A.merge_funding(bars(spark, sf), funding(spark, sf), fill=False, tolerance=F.expr("INTERVAL 1 HOUR"))
    return show(d, "funding_rate", digits=8)


@query("trade_signal_audit", """WITH t AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id AS strategy FROM events WHERE event_type = 'purchase'),
  s AS (SELECT event_id AS id, ts, epoch_us(ts) AS us, user_id AS strategy FROM events WHERE event_type = 'click'),
  m AS (SELECT user_id AS strategy, epoch_us(min(ts)) AS trained FROM events WHERE event_type = 'signup' GROUP BY 1),
  c AS (SELECT t.event_id, s.id, row_number() OVER (PARTITION BY t.event_id ORDER BY abs(t.us - s.us), s.us, s.id) AS rk FROM t JOIN s ON s.strategy = t.strategy AND abs(t.us - s.us) <= 21600000000),
  x AS (SELECT t.*, c.id AS signal_id, trained FROM t LEFT JOIN c ON c.event_id = t.event_id AND c.rk = 1 LEFT JOIN m USING (strategy)),
  g AS (SELECT strategy, count(*) AS n_trades, count(*) FILTER (signal_id IS NULL) AS n_untraced, count(*) FILTER (trained IS NULL) AS n_missing_model,
    count(*) FILTER (us < trained) AS n_before_training, count(DISTINCT signal_id) AS n_signals_used FROM x GROUP BY 1),
  o AS (SELECT strategy, count(*) AS n_orphans FROM s WHERE id NOT IN (SELECT signal_id FROM x WHERE signal_id IS NOT NULL) GROUP BY 1)
  SELECT coalesce(g.strategy, o.strategy) AS strategy, coalesce(n_trades, 0) AS n_trades, coalesce(n_untraced, 0) AS n_untraced, coalesce(n_missing_model, 0) AS n_missing_model,
    coalesce(n_before_training, 0) AS n_before_training, coalesce(n_signals_used, 0) AS n_signals_used, coalesce(n_orphans, 0) AS n_orphans FROM g FULL JOIN o ON g.strategy = o.strategy""")
def trade_signal_audit(spark, sf):
    trades = of_type(spark, sf, "purchase").withColumnRenamed("user_id", "strategy")
    signals = of_type(spark, sf, "click").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("strategy"))
    models = of_type(spark, sf, "signup").groupBy(F.col("user_id").alias("strategy")).agg(F.min("ts").alias("trained_at"))
    return A.audit_trades(A.trace_trades(trades, signals, models, 6 * 3600), signals)


@query("join_open_interest", f"""WITH {TICKS_SQL}, {bars_sql('1h', 'bars')},
  oi AS (SELECT symbol, ts, quote_volume AS v, lag(quote_volume) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars WHERE trades_count > 1)
  SELECT b.symbol, b.ts, round(coalesce(CASE WHEN v / nullif(p, 0) - 1 > 1 THEN 1 WHEN v / nullif(p, 0) - 1 < -1 THEN -1 ELSE v / nullif(p, 0) - 1 END, 0), 6) + 0.0 AS oi_change
  FROM bars b LEFT JOIN oi USING (symbol, ts)""")
def join_open_interest(spark, sf):
    b = bars(spark, sf, "1h")
    oi = b.where("trades_count > 1").select("symbol", "ts", F.col("quote_volume").alias("open_interest"))
    return show(A.merge_open_interest(b, oi, bar_series("1h"), "1h"), "oi_change")


@query("join_fear_greed", f"""WITH {TICKS_SQL}, {bars_sql('1d')},
  fg AS (SELECT ts // 86400000000 AS d, avg(volume) / count(*) AS v FROM bars GROUP BY 1)
  SELECT b.symbol, b.ts, round(coalesce(v / 100, 0.5), 6) + 0.0 AS fear_greed FROM bars b LEFT JOIN (SELECT * FROM fg WHERE v < 250) g ON g.d = b.ts // 86400000000""")
def join_fear_greed(spark, sf):
    b = bars(spark, sf, "1d")
    idx = b.groupBy("ts").agg((F.avg("volume") / F.count(F.lit(1))).alias("value")).where("value < 250")
    return show(A.merge_fear_greed(b, idx), "fear_greed")


def news(spark, sf):
    """Documents as a news feed: one every 43 minutes, title = whole text, score from its length."""
    d = spread(table(spark, sf, "documents"))
    return d.select(
        F.col("doc_id").alias("id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("doc_id") * 2_580_000_000).alias("ts"),
        F.col("text").alias("title"), "source", "lang", ((F.col("n_chars") - 1500) / 1000.0).alias("score"),
    )


NEWS_SQL = """news AS (SELECT doc_id AS id, 1704067200000000 + doc_id * 2580000000 AS ts, text AS title, source, lang, (n_chars - 1500) / 1000.0::DOUBLE AS score FROM documents)"""


def _contains_sum(col: str, kws) -> str:
    return " + ".join(f"CAST(contains({col}, '{k}') AS INT)" for k in kws)


KW_TONE = f"""CASE WHEN ({_contains_sum('lower(title)', T.BULL_KEYWORDS)}) + ({_contains_sum('lower(title)', T.BEAR_KEYWORDS)}) > 0
  THEN (({_contains_sum('lower(title)', T.BULL_KEYWORDS)}) - ({_contains_sum('lower(title)', T.BEAR_KEYWORDS)}))::DOUBLE
     / (({_contains_sum('lower(title)', T.BULL_KEYWORDS)}) + ({_contains_sum('lower(title)', T.BEAR_KEYWORDS)})) ELSE 0.0::DOUBLE END"""

for _name, _shift in (("join_news_sentiment", 0), ("join_news_sentiment_causal", 3_600_000_000)):
    query(_name, f"""WITH {TICKS_SQL}, {bars_sql()}, {NEWS_SQL}, sc AS (SELECT ts, {KW_TONE} AS kw FROM news),
    h AS (SELECT ts - ts % 3600000000 + {_shift} AS hour, avg(kw) AS s FROM sc GROUP BY 1), l AS (SELECT max(hour) AS last FROM h)
    SELECT b.symbol, b.ts, round(coalesce(s, 0), 6) + 0.0 AS news_sentiment FROM bars b, l LEFT JOIN h ON h.hour = least(b.ts - b.ts % 3600000000, l.last)""")(
        lambda spark, sf, _c=bool(_shift): show(A.merge_news_sentiment(bars(spark, sf), news(spark, sf).drop("score"), causal=_c), "news_sentiment")
    )


@query("join_news_scores", f"""WITH {TICKS_SQL}, {bars_sql()}, {NEWS_SQL},
    h AS (SELECT ts - ts % 3600000000 AS hour, avg(tanh(score / 50)) AS s FROM news GROUP BY 1), l AS (SELECT max(hour) AS last FROM h)
    SELECT b.symbol, b.ts, round(coalesce(s, 0), 6) + 0.0 AS news_sentiment FROM bars b, l LEFT JOIN h ON h.hour = least(b.ts - b.ts % 3600000000, l.last)""")
def join_news_scores(spark, sf):
    return show(A.merge_news_sentiment(bars(spark, sf), news(spark, sf)), "news_sentiment")


def symbol_news(spark, sf):
    """Ticks as scored items of their symbol."""
    return ticks(spark, sf).select("symbol", "ts", "id", (F.col("price") / 100).alias("score"))


N24_SQL = """n24 AS (SELECT symbol, us AS n_ts, id, avg(price / 100) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS news_24h FROM ticks)"""


@query("trailing_day_mean", f"WITH {TICKS_SQL}, {N24_SQL} SELECT symbol, n_ts AS ts, id, round(news_24h, 6) + 0.0 AS news_24h FROM n24")
def trailing_day_mean(spark, sf):
    d = symbol_news(spark, sf)
    s = Series.sampled(d, ["symbol"], ["ts", "id"])
    return show(A.trailing_mean(d, s, "score", 86_400, "news_24h"), "news_24h", keys=("symbol", "ts", "id"))


METRICS = ("click", "purchase", "signup")


@query("training_frame_aligned", f"""{FUND_SQL.replace('WITH ', 'WITH ', 1)}, {N24_SQL}, {bars_sql('1h', 'bh')},
  macro AS (SELECT ts AS m_ts, avg(close) FILTER (symbol = 'click') AS click, avg(close) FILTER (symbol = 'purchase') AS purchase, avg(close) FILTER (symbol = 'signup') AS signup
    FROM bh WHERE symbol IN ('click', 'purchase', 'signup') GROUP BY 1),
  mf AS (SELECT m_ts, last_value(click IGNORE NULLS) OVER (ORDER BY m_ts) AS click, last_value(purchase IGNORE NULLS) OVER (ORDER BY m_ts) AS purchase, last_value(signup IGNORE NULLS) OVER (ORDER BY m_ts) AS signup FROM macro),
  a AS (SELECT b.symbol, b.ts, b.close, f.funding_rate FROM bars b ASOF LEFT JOIN fnd f ON b.symbol = f.symbol AND b.ts >= f.f_ts),
  c AS (SELECT a.*, n.news_24h FROM a ASOF LEFT JOIN n24 n ON a.symbol = n.symbol AND a.ts >= n.n_ts)
  SELECT c.symbol, c.ts, {sql_round('close, news_24h, click, purchase, signup')}, round(funding_rate, 8) + 0.0 AS funding_rate FROM c ASOF LEFT JOIN mf ON c.ts >= mf.m_ts""")
def training_frame_aligned(spark, sf):
    macro = bars(spark, sf, "1h").where(F.col("symbol").isin(*METRICS)).select(F.col("symbol").alias("metric"), "ts", F.col("close").alias("value"))
    d = A.training_frame(bars(spark, sf), funding(spark, sf), symbol_news(spark, sf), macro, METRICS)
    return d.select(
        "symbol", micros().alias("ts"), r("close").alias("close"), r("news_24h").alias("news_24h"),
        *[r(m).alias(m) for m in METRICS], r("funding_rate", 8).alias("funding_rate"),
    )


def _any(col: str, kws) -> str:
    return "(" + " OR ".join(f"contains({col}, '{k}')" for k in kws) + ")"


@query("join_channel_signal", f"""WITH {TICKS_SQL}, {bars_sql()}, {NEWS_SQL},
  m AS (SELECT ts AS m_ts, CASE WHEN {_any('lower(title)', T.CHANNEL_BULL)} THEN 1.0::DOUBLE WHEN {_any('lower(title)', T.CHANNEL_BEAR)} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sig FROM news)
  SELECT b.symbol, b.ts, coalesce(sig, 0.0::DOUBLE) AS channel_signal FROM bars b ASOF LEFT JOIN m ON b.ts >= m.m_ts""")
def join_channel_signal(spark, sf):
    return show(A.merge_channel_signal(bars(spark, sf), news(spark, sf).withColumnRenamed("title", "text")), "channel_signal")


_COINS = " ".join(f"UNION ALL SELECT id, '{c}' FROM n WHERE {_any('t', [c.lower(), *k])}" for c, k in T.COIN_KEYWORDS.items())


@query("news_coin_tags", f"WITH {NEWS_SQL}, n AS (SELECT id, lower(title) AS t FROM news) SELECT id, 'ALL' AS coin FROM n {_COINS}")
def news_coin_tags(spark, sf):
    return A.tag_coins(news(spark, sf)).select("id", "coin")


@query("news_bar_features", f"""WITH {TICKS_SQL}, {bars_sql('1h', 'bars')},
  a AS (SELECT symbol, us - us % 3600000000 AS bar, avg(price / 500 - 0.1) AS m, max(abs(price / 500 - 0.1)) AS x, count(*) AS n FROM ticks WHERE volume > 50 GROUP BY 1, 2),
  j AS (SELECT b.symbol, b.ts, b.i, coalesce(m, 0) AS news_mean, coalesce(x, 0) AS news_max_abs, coalesce(n, 0) AS news_count FROM bars b LEFT JOIN a ON a.symbol = b.symbol AND a.bar = b.ts),
  z AS (SELECT *, count(*) OVER w AS c, avg(news_mean) OVER w AS mu, stddev_samp(news_mean) OVER w AS sd FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)),
  q AS (SELECT *, CASE WHEN c >= 2 THEN (news_mean - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END END AS zz,
    {', '.join(f'lag(news_mean, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS l{k}' for k in range(1, 7))} FROM z)
  SELECT symbol, ts, {sql_round('news_mean, news_max_abs')}, news_count, round(greatest(-5, least(5, coalesce(zz, 0))), 6) + 0.0 AS news_z24,
    round(coalesce(({' + '.join(f'coalesce(l{k}, 0) * {0.5**k!r}' for k in range(1, 7))}) / nullif({' + '.join(f'CASE WHEN i >= {k} THEN {0.5**k!r} ELSE 0 END' for k in range(1, 7))}, 0), 0), 6) + 0.0 AS news_decayed FROM q""")
def news_bar_features(spark, sf):
    n = ticks(spark, sf).where("volume > 50").select("symbol", "ts", (F.col("price") / 500 - 0.1).alias("tone"))
    return show(B.news_features(n, bars(spark, sf, "1h"), "1h"), "news_mean", "news_max_abs", "news_count", "news_z24", "news_decayed")


TFS = ("15m", "1h", "1d")


def _present(spark, sf):
    out = None
    for tf in TFS:
        p = bars(spark, sf, tf).groupBy("symbol").agg(
            F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
        ).withColumn("timeframe", F.lit(tf))
        out = p if out is None else out.unionByName(p)
    return out


COVER_SQL = f"""WITH {TICKS_SQL}, {bars_sql('15m', 'b1')}, {bars_sql('1h', 'b2')}, {bars_sql('1d', 'b3')},
  pr AS (SELECT symbol, '15m' AS timeframe, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM b1 GROUP BY 1
    UNION ALL SELECT symbol, '1h', count(*), min(ts), max(ts) FROM b2 GROUP BY 1 UNION ALL SELECT symbol, '1d', count(*), min(ts), max(ts) FROM b3 GROUP BY 1),
  sy AS (SELECT DISTINCT event_type AS symbol FROM events UNION SELECT DISTINCT o_orderpriority FROM orders),
  cells AS (SELECT sy.symbol, tf.timeframe, rows, first_ts, last_ts, (1706652000000000 - last_ts) / 1000000.0::DOUBLE AS lag_s,
    CASE WHEN last_ts IS NULL THEN 'missing' WHEN (1706652000000000 - last_ts) / 1000000.0 > 3 * tf.s THEN 'stale' ELSE 'present' END AS status
    FROM sy CROSS JOIN (VALUES ('15m', 900), ('1h', 3600), ('1d', 86400)) tf(timeframe, s) LEFT JOIN pr ON pr.symbol = sy.symbol AND pr.timeframe = tf.timeframe)"""


def _cells(spark, sf):
    symbols = table(spark, sf, "events").select(F.col("event_type").alias("symbol")).union(
        table(spark, sf, "orders").select("o_orderpriority")).distinct()
    now = F.timestamp_micros(F.lit(1_706_652_000_000_000))
    return A.coverage_gaps(A.coverage_grid(symbols, TFS), _present(spark, sf), now)


@query("coverage_matrix", COVER_SQL + " SELECT symbol, timeframe, rows, first_ts, last_ts, round(lag_s, 3) + 0.0 AS lag_s, status FROM cells")
def coverage_matrix(spark, sf):
    return show(_cells(spark, sf), "rows", "first_ts", "last_ts", "lag_s", "status", keys=("symbol", "timeframe"), digits=3)


@query("coverage_summary", COVER_SQL + """ SELECT count(*) AS total, count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'stale') AS stale,
  count(*) FILTER (status = 'missing') AS missing, ROUND(100.0::DOUBLE * count(*) FILTER (status = 'present') / count(*), 1) AS pct_present FROM cells""")
def coverage_summary(spark, sf):
    return A.coverage_summary(_cells(spark, sf))


@query("trade_excursions", f"""WITH {TICKS_SQL}, {bars_sql()},
  t AS (SELECT id AS trade_id, symbol, us AS entry, us + CAST(volume AS BIGINT) * 3600000000 AS exit, price AS entry_price, CASE WHEN taker > 25 THEN 1 ELSE -1 END AS direction FROM ticks)
  SELECT t.trade_id, round(greatest(0, CASE WHEN direction > 0 THEN max(high) / entry_price - 1 ELSE -(min(low) / entry_price - 1) END), 6) + 0.0 AS mfe,
    round(least(0, CASE WHEN direction > 0 THEN min(low) / entry_price - 1 ELSE -(max(high) / entry_price - 1) END), 6) + 0.0 AS mae
  FROM t JOIN bars b ON b.symbol = t.symbol AND b.ts BETWEEN entry - entry % 900000000 AND exit GROUP BY t.trade_id, direction, entry_price""")
def trade_excursions(spark, sf):
    t = ticks(spark, sf).select(
        F.col("id").alias("trade_id"), "symbol", F.col("ts").alias("entry_ts"), F.col("price").alias("entry_price"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("volume").cast("bigint") * 3_600_000_000).alias("exit_ts"),
        F.when(F.col("taker") > 25, 1).otherwise(-1).alias("direction"),
    )
    return show(A.excursions(t, bars(spark, sf), 900), "mfe", "mae", keys=("trade_id",))
