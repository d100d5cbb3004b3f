"""Typed tables of the store and the partition columns they are written with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"ts": T.TimestampType(), "i": T.LongType(), "f": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType()}

# fixed values: columns of each table (t = timestamp, i = long, f = double, s = string, b = boolean)
COLUMNS = {
    "market_data": "ts:ts symbol:s timeframe:s open:f high:f low:f close:f volume:f funding_rate:f",
    "model_signals": "ts:ts symbol:s signal_rsi:f signal_macd:f signal_bb:f signal_ensemble:f signal_vwap:f signal_donchian:f "
    "signal_keltner:f signal_funding:f signal_vol_breakout:f signal_supertrend:f signal_ml_long:f signal_ml_short:f signal_scalping:f "
    "signal_trend:f signal_meta:f regime:i meta_label:i meta_prob:f garch_vol:f ou_zscore:f close:f",
    "training_telemetry": "ts:ts model:s run_id:s hardware:s epoch:i train_loss:f val_loss:f accuracy:f sharpe:f learning_rate:f "
    "batch_size:i seq_len:i n_samples:i",
    "agent_heartbeats": "ts:ts agent:s status:s current_task:s cpu_pct:f mem_mb:f",
    "news_sentiment": "ts:ts source:s sentiment:s coins:s score:f headline:s url:s",
    "trade_events": "ts:ts trade_id:s symbol:s strategy:s market:s direction:i entry_price:f exit_price:f size_usd:f pnl_usd:f "
    "fees_usd:f bars_held:i is_live:b",
    "strategy_performance": "ts:ts strategy:s symbol:s is_live:b balance:f total_pnl:f pnl_pct:f win_rate:f n_trades:i n_wins:i "
    "sharpe:f wf_mean_sharpe:f wf_consistency:f",
    "backtest_results": "ts:ts run_id:s strategy:s symbol:s total_pnl:f gross_pnl:f total_fees:f sharpe:f win_rate:f max_drawdown:f "
    "n_trades:i wf_mean_sharpe:f wf_consistency:f wf_decay:f",
    "csv_ingestion_log": "ts:ts filename:s source_path:s symbol:s timeframe:s rows_written:i file_size_bytes:i first_bar_ts:ts last_bar_ts:ts",
    "training_runs": "ts:ts run_id:s model_name:s strategy:s symbol:s timeframe:s trigger:s start_ts:ts end_ts:ts duration_secs:f "
    "train_rows:i val_rows:i n_wf_folds:i best_epoch:i final_train_loss:f final_val_loss:f early_stopped:b oos_sharpe:f oos_win_rate:f "
    "oos_max_drawdown:f n_oos_trades:i hyperparams_json:s feature_list_json:s notes:s",
    "model_wf_folds": "ts:ts run_id:s model_name:s fold_index:i train_start:ts train_end:ts test_start:ts test_end:ts train_rows:i "
    "test_rows:i oos_sharpe:f oos_pnl:f oos_win_rate:f oos_max_dd:f n_trades:i",
    "testnet_trades": "ts:ts trade_id:s symbol:s strategy:s model:s exit_reason:s direction:i is_live:b entry_ts:ts exit_ts:ts "
    "entry_price:f exit_price:f size_usd:f pnl_usd:f fees_usd:f funding_pnl:f net_pnl:f bars_held:i meta_label:i regime:i "
    "garch_vol_at_entry:f stop_loss:f take_profit:f meta_prob:f signal_strength:f",
    "testnet_session_stats": "ts:ts session_id:s strategy:s symbol:s balance:f total_pnl:f unrealized_pnl:f n_open_trades:i "
    "n_closed_trades:i win_rate:f sharpe:f max_drawdown:f funding_collected:f",
    "open_interest": "ts:ts symbol:s oi_base:f oi_usdt:f",
    "fear_greed": "ts:ts fear_greed:i fg_label:s",
    "liquidations": "ts:ts symbol:s liq_long_usd:f liq_short_usd:f liq_total_usd:f",
    "l2_snapshots": "ts:i symbol:s p_bid:f p_ask:f v_bid:f v_ask:f depth:i",
    "metric_points": "ts:ts metric:s value:f",
}
# fixed values: partition columns per table (everything else is partitioned by month)
PARTITIONS = {
    "market_data": ["symbol", "timeframe", "yyyymm"],
    "model_signals": ["symbol", "yyyymm"],
    "training_telemetry": ["model", "yyyymm"],
    "agent_heartbeats": ["yyyymmdd"],
    "news_sentiment": ["source", "yyyymm"],
    "csv_ingestion_log": ["yyyy"],
    "open_interest": ["symbol", "yyyymm"],
    "liquidations": ["symbol", "yyyymm"],
    "l2_snapshots": ["symbol", "yyyymm"],
}
PARTITION_FORMAT = {"yyyymm": "yyyy-MM", "yyyymmdd": "yyyyMMdd", "yyyy": "yyyy"}


def schema_of(table: str) -> T.StructType:
    fields = [c.split(":") for c in COLUMNS[table].split()]
    return T.StructType([T.StructField(n, TYPES[k]) for n, k in fields])


def partitions_of(table: str) -> list[str]:
    return PARTITIONS.get(table, ["yyyymm"])


def coerce(df: DataFrame, table: str, zero_fill: bool = False) -> DataFrame:
    """Cast whatever arrives to the table's schema; unparsable values become null (or zero / empty)."""
    from barflow.functions.text import text_to_timestamp

    out: list[Column] = []
    for f in schema_of(table).fields:
        if f.name not in df.columns:
            v = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.TimestampType):
            v = F.col(f.name) if dict(df.dtypes)[f.name].startswith("timestamp") else text_to_timestamp(f.name)
        elif isinstance(f.dataType, T.LongType):
            # through double, so that "3.0" and 3.7 keep their whole part
            v = F.col(f.name).try_cast("double").try_cast("bigint")
        else:
            v = F.col(f.name).try_cast(f.dataType.simpleString())
        if zero_fill and isinstance(f.dataType, (T.LongType, T.DoubleType)):
            v = F.coalesce(v, F.lit(0).cast(f.dataType))
        elif zero_fill and isinstance(f.dataType, T.StringType):
            v = F.coalesce(v, F.lit(""))
        out.append(v.alias(f.name))
    return df.select(*out)


def with_partitions(df: DataFrame, table: str) -> DataFrame:
    """Add the derived date partition column of a table."""
    for p in partitions_of(table):
        if p in PARTITION_FORMAT:
            ts = F.col("ts") if not dict(df.dtypes)["ts"].endswith("int") else F.timestamp_millis("ts")
            df = df.withColumn(p, F.date_format(ts, PARTITION_FORMAT[p]))
    return df
