"""Queries over the library's own operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import conditions, scores
from tidewright.operators import indicators, overfitting, ranking, reconcile, screening, simulation, timeseries, trades
from tidewright.sources import market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Quotients of two counts are the same everywhere, and may lie halfway between two rounded values.
EXACT = ("win_rate", "score")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of floats depend on their order in the last digits: these are rounded off. No zero is negative."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" and c not in EXACT else F.col(c) for c, t in df.dtypes])


def rounded_in_floats(column: Column, digits: int) -> Column:
    """As SQL rounds a double: scaled, rounded to a whole number and scaled back. Beyond some 1e12 that changes the last digit."""
    scaled = column * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(column)


BARS = """WITH k AS (
 SELECT event_type AS symbol, (epoch_us(ts) // 3600000000) * 3600000 AS open_time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, (epoch_us(ts) // 3600000000) * 3600000 + 3599999 AS close_time
 FROM events GROUP BY 1, 2, 8)"""
TRADES = """WITH t AS (
 SELECT l_suppkey AS run_id, l_returnflag AS symbol, CASE WHEN l_linestatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS direction, epoch_ms(l_shipdate) AS exit_time,
        CAST(l_linenumber * 24 AS DOUBLE) AS hours, l_quantity AS quantity, l_extendedprice AS notional, l_extendedprice * l_tax * 0.01 AS fee,
        l_extendedprice * (l_discount - 0.05) AS net_pnl, l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id, l_shipdate
 FROM lineitem),
e AS (SELECT *, 100000 + sum(net_pnl) OVER w AS equity FROM t WINDOW w AS (PARTITION BY run_id ORDER BY exit_time, order_id, line, part_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY run_id ORDER BY exit_time, order_id, line, part_id ROWS UNBOUNDED PRECEDING)) AS peak FROM e)"""
RESULTS = TRADES + """,
x AS (SELECT run_id, count(*) AS n, avg(net_pnl / notional) AS mean, stddev_samp(net_pnl / notional) AS dev, stddev_samp(CASE WHEN net_pnl < 0 THEN net_pnl / notional END) AS down,
        sum(net_pnl / notional) AS total_return, max((peak - equity) / peak) AS max_drawdown,
        sum(CASE WHEN net_pnl > 0 THEN net_pnl ELSE 0 END) / sum(CASE WHEN net_pnl < 0 THEN -net_pnl ELSE 0 END) AS profit_factor,
        count(*) FILTER (net_pnl > 0) / count(*) AS win_rate FROM d GROUP BY run_id),
r AS (SELECT run_id, n, CASE WHEN dev > 1e-10 THEN mean / dev * sqrt(n) ELSE 0 END AS sharpe, CASE WHEN down > 1e-10 THEN mean / down * sqrt(n) ELSE 0 END AS sortino,
        total_return, max_drawdown, profit_factor, win_rate FROM x)"""


@query(BARS + """,
a AS (SELECT *, CASE WHEN count(*) OVER w5 >= 5 THEN avg(close) OVER w5 END AS fast, CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 END AS slow, close / lag(close) OVER w - 1 AS move
      FROM k WINDOW w AS (PARTITION BY symbol ORDER BY open_time), w5 AS (PARTITION BY symbol ORDER BY open_time ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY open_time ROWS 19 PRECEDING)),
b AS (SELECT *, coalesce(fast > slow AND lag(fast) OVER w <= lag(slow) OVER w, false) AS crossed, CASE WHEN coalesce(lag(fast > slow) OVER w, false) THEN move ELSE 0 END AS gain
      FROM a WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
c AS (SELECT *, 1 + sum(gain) OVER w AS equity FROM b WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(1, max(equity) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING)) AS peak FROM c)
SELECT symbol, open_time, round(close, 6) AS close, round(fast, 6) AS fast, round(slow, 6) AS slow, crossed, round(equity, 6) AS equity, round((peak - equity) / peak, 6) AS drawdown FROM p""")
def flagship_crossover_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, crossings of two averages, and the equity and drawdown of holding above."""
    by, sofar = indicators.by_time(), indicators.by_time().rowsBetween(Window.unboundedPreceding, 0)
    bars = market.klines(spark, sf_dir).withColumns({"fast": indicators.sma(5), "slow": indicators.sma(20), "move": F.col("close") / F.lag("close").over(by) - 1})
    above = F.col("fast") > F.col("slow")
    rows = bars.withColumns({"crossed": conditions.crosses_above("fast", "slow"), "gain": F.when(F.coalesce(F.lag(above).over(by), F.lit(False)), F.col("move")).otherwise(0.0)})
    rows = rows.withColumn("equity", F.sum("gain").over(sofar) + 1).withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(sofar)))
    return rounded(rows.select("symbol", "open_time", "close", "fast", "slow", "crossed", "equity", ((F.col("peak") - F.col("equity")) / F.col("peak")).alias("drawdown")))


@query(BARS + " SELECT symbol, open_time, open, high, low, close, volume, close_time FROM k")
def klines_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.klines(spark, sf_dir)


RESAMPLED = """ SELECT symbol, {time} AS open_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume,
 {close} AS close_time FROM k GROUP BY symbol, open_time // 14400000"""


@query(BARS + RESAMPLED.format(time="min(k.open_time)", close="max(close_time)"))
def resample_catalog_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.resample(market.klines(spark, sf_dir), 4 * market.HOUR)


@query(BARS + RESAMPLED.format(time="(open_time // 14400000) * 14400000", close="CASE WHEN count(*) = 1 THEN (k.open_time // 14400000) * 14400000 + 14399999 ELSE max(close_time) END"))
def resample_browse_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.resample(market.klines(spark, sf_dir), 4 * market.HOUR, browse=True)


@query(BARS + """, g AS (SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS gap_start, open_time AS gap_end FROM k)
SELECT symbol, gap_start, gap_end, (gap_end - gap_start) // 60000 AS minutes FROM g WHERE gap_end - gap_start > 60 * 60000""")
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.gaps(market.klines(spark, sf_dir), 60)


def broken_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars some of which break the rules: highs of every seventh hour are halved."""
    return market.klines(spark, sf_dir).withColumn("high", F.when(F.col("open_time") / market.HOUR % 7 == 0, F.col("high") / 2).otherwise(F.col("high")))


BROKEN = BARS + ", h AS (SELECT * REPLACE (CASE WHEN (open_time // 3600000) % 7 = 0 THEN high / 2 ELSE high END AS high) FROM k)"


@query(BROKEN + """ SELECT symbol, open_time, 'high < low' AS message FROM h WHERE high < low UNION ALL SELECT symbol, open_time, 'high < open' FROM h WHERE high < open
UNION ALL SELECT symbol, open_time, 'high < close' FROM h WHERE high < close UNION ALL SELECT symbol, open_time, 'low > open' FROM h WHERE low > open UNION ALL SELECT symbol, open_time, 'low > close' FROM h WHERE low > close""")
def ohlc_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.violations(broken_bars(spark, sf_dir))


@query(BROKEN + """ SELECT symbol, count(*) AS bars, count(*) FILTER (high < low OR close <= 0 OR volume < 0 OR open <= 0) AS bad,
 CAST(greatest(0, 1 - least(1, count(*) FILTER (high < low OR close <= 0 OR volume < 0 OR open <= 0) / 100)) AS DOUBLE) AS score FROM h GROUP BY symbol""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeseries.quality_score(broken_bars(spark, sf_dir)))


@query(BARS + """ SELECT symbol, strftime(make_timestamp(open_time * 1000), '%Y-%m') AS month, count(*) AS bars, min(open_time) AS first, max(open_time) AS last,
 any_value(day(last_day(make_timestamp(open_time * 1000)))) * 24 AS expected, count(*) >= 0.9 * any_value(day(last_day(make_timestamp(open_time * 1000)))) * 24 AS covered
 FROM k GROUP BY 1, 2""")
def month_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.coverage(market.klines(spark, sf_dir), "1h")


@query(BARS + """, d AS (SELECT symbol, max(close_time) AS close_time, arg_max(close, open_time) AS day_close FROM k GROUP BY symbol, open_time // 86400000)
SELECT k.symbol, k.open_time, k.close, d.day_close FROM k ASOF LEFT JOIN d ON k.symbol = d.symbol AND k.close_time >= d.close_time""")
def asof_daily_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = market.klines(spark, sf_dir)
    return timeseries.latest_closed(bars, timeseries.resample(bars, 24 * market.HOUR), F.col("close"), "day_close").select("symbol", "open_time", "close", "day_close")


_W = "(PARTITION BY symbol ORDER BY open_time ROWS {} PRECEDING)"


def _full_sql(value: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER {_W.format(n - 1)} >= {n} THEN {value} END"


@query(BARS + f""",
tp AS (SELECT *, (high + low + close) / 3 AS tp, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS n FROM k),
q AS (SELECT *, sign(tp - lag(tp) OVER (PARTITION BY symbol ORDER BY open_time)) AS up, coalesce(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) * volume, 0) AS step,
  min(low) OVER {_W.format(13)} AS l14, max(high) OVER {_W.format(13)} AS h14, min(low) OVER {_W.format(19)} AS l20, max(high) OVER {_W.format(19)} AS h20,
  avg(close) OVER {_W.format(19)} AS m20, stddev_pop(close) OVER {_W.format(19)} AS s20, avg(tp) OVER {_W.format(19)} AS tm20, list(tp) OVER {_W.format(19)} AS tps,
  list(close) OVER {_W.format(13)} AS c14, max(high) OVER {_W.format(8)} + min(low) OVER {_W.format(8)} AS hl9, max(high) OVER {_W.format(25)} + min(low) OVER {_W.format(25)} AS hl26, max(high) OVER {_W.format(51)} + min(low) OVER {_W.format(51)} AS hl52 FROM tp),
s AS (SELECT *, CASE WHEN n >= 14 AND h14 <> l14 THEN (close - l14) * 100 / (h14 - l14) END AS raw,
  sum(CASE WHEN up = 1 THEN tp * volume ELSE 0 END) OVER {_W.format(13)} AS gain, sum(CASE WHEN up = -1 THEN tp * volume ELSE 0 END) OVER {_W.format(13)} AS loss, count(up) OVER {_W.format(13)} AS ups FROM q),
t AS (SELECT *, CASE WHEN count(raw) OVER {_W.format(2)} = 3 THEN avg(raw) OVER {_W.format(2)} END AS stoch_k FROM s)
SELECT symbol, open_time, round({_full_sql(f'avg(close) OVER {_W.format(13)}', 14)}, 6) AS sma,
 round(CASE WHEN n >= 14 THEN list_sum(list_transform(c14, lambda x, i: x * i)) / 105 END, 6) AS wma,
 round(CASE WHEN lag(close, 10) OVER (PARTITION BY symbol ORDER BY open_time) <> 0 THEN (close - lag(close, 10) OVER (PARTITION BY symbol ORDER BY open_time)) * 100 / lag(close, 10) OVER (PARTITION BY symbol ORDER BY open_time) END, 6) AS roc,
 round(CASE WHEN n >= 14 AND h14 <> l14 THEN (h14 - close) * -100 / (h14 - l14) END, 6) + 0.0 AS willr,
 round(CASE WHEN n >= 20 THEN (tp - tm20) / (0.015 * list_avg(list_transform(tps, lambda x: abs(x - tm20)))) END, 6) AS cci,
 round(CASE WHEN n >= 20 THEN m20 + 2 * s20 END, 6) AS bb_upper, round(CASE WHEN n >= 20 THEN m20 END, 6) AS bb_middle, round(CASE WHEN n >= 20 THEN m20 - 2 * s20 END, 6) AS bb_lower,
 round(CASE WHEN n >= 20 THEN CASE WHEN s20 > 0 THEN (close - (m20 - 2 * s20)) / (4 * s20) ELSE 0.5 END END, 6) AS bb_percent, round(CASE WHEN n >= 20 THEN CASE WHEN m20 > 0 THEN 4 * s20 / m20 ELSE 0 END END, 6) AS bb_width,
 round(CASE WHEN n >= 20 THEN h20 END, 6) AS dc_upper, round(CASE WHEN n >= 20 THEN (h20 + l20) / 2 END, 6) AS dc_middle, round(CASE WHEN n >= 20 THEN l20 END, 6) AS dc_lower,
 round(CASE WHEN n >= 20 THEN CASE WHEN h20 > l20 THEN (close - l20) / (h20 - l20) ELSE 0.5 END END, 6) AS dc_position,
 round(CASE WHEN n >= 9 THEN hl9 / 2 END, 6) AS ich_conversion, round(CASE WHEN n >= 26 THEN hl26 / 2 END, 6) AS ich_base, round(CASE WHEN n >= 26 THEN (hl9 / 2 + hl26 / 2) / 2 END, 6) AS ich_span_a, round(CASE WHEN n >= 52 THEN hl52 / 2 END, 6) AS ich_span_b,
 round(sum(step) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING), 6) AS obv,
 round(sum(tp * volume) OVER (PARTITION BY symbol, open_time // 86400000 ORDER BY open_time ROWS UNBOUNDED PRECEDING) / sum(volume) OVER (PARTITION BY symbol, open_time // 86400000 ORDER BY open_time ROWS UNBOUNDED PRECEDING), 6) AS vwap,
 round({_full_sql(f'avg(volume) OVER {_W.format(19)}', 20)}, 6) AS volsma,
 round(CASE WHEN ups >= 14 THEN CASE WHEN gain + loss = 0 THEN 50 ELSE gain * 100 / (gain + loss) END END, 6) AS mfi, round(stoch_k, 6) AS stoch_k,
 round(CASE WHEN count(stoch_k) OVER {_W.format(2)} = 3 THEN avg(stoch_k) OVER {_W.format(2)} END, 6) AS stoch_d FROM t""")
def window_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.with_window_indicators(market.klines(spark, sf_dir)).drop("open", "high", "low", "close", "volume", "close_time"))



@query()
def sweep_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a grid of RSI levels: each bar meets each combination in its own task, the indicators are
    made once, and each combination and symbol is simulated apart."""
    bars = indicators.with_recursive_indicators(market.klines(spark, sf_dir)).select("symbol", "open_time", "open", "high", "low", "close", "close_time", "rsi")
    levels = [(low, high) for low in (25.0, 30.0, 35.0, 40.0) for high in (60.0, 65.0, 70.0, 75.0)]
    grid = F.explode(F.array(*[F.struct(F.lit(int(low * 100 + high)).cast("long").alias("param_id"), F.lit(low).alias("low_level"), F.lit(high).alias("high_level")) for low, high in levels]))
    rows = bars.withColumn("p", grid).select("*", "p.*").drop("p")
    signal = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns({"long_entry": signal(F.col("rsi") < F.col("low_level")), "short_entry": signal(F.col("rsi") > F.col("high_level")), "long_exit": signal(F.col("rsi") > 50), "short_exit": signal(F.col("rsi") < 50)})
    return simulation.simulate(rows.drop("rsi", "low_level", "high_level"))


@query(TRADES + " SELECT run_id, exit_time, order_id, line, part_id, round(equity, 4) AS equity, round((peak - equity) / peak, 10) AS drawdown FROM d")
def equity_and_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.equity_curve(market.trades(spark, sf_dir))
    return rows.select("run_id", "exit_time", "order_id", "line", "part_id", F.round("equity", 4).alias("equity"), F.round("drawdown", 10).alias("drawdown"))


@query(TRADES + """, i AS (SELECT *, sign(net_pnl) AS s, row_number() OVER (PARTITION BY run_id ORDER BY exit_time, order_id, line, part_id) - row_number() OVER (PARTITION BY run_id, sign(net_pnl) ORDER BY exit_time, order_id, line, part_id) AS g FROM t),
c AS (SELECT run_id, s, g, count(*) AS n FROM i GROUP BY ALL)
SELECT run_id, coalesce(max(n) FILTER (s = 1), 0) AS max_wins, coalesce(max(n) FILTER (s = -1), 0) AS max_losses FROM c GROUP BY run_id""")
def win_loss_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.streaks(market.trades(spark, sf_dir))


@query(TRADES + " SELECT run_id, strftime(l_shipdate, '%Y-%m') AS month, round(sum(net_pnl) / 100000 * 100, 8) AS percent FROM t GROUP BY ALL")
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.monthly_returns(market.trades(spark, sf_dir)), 8)


@query(TRADES + """ SELECT run_id, count(*) AS n, count(*) FILTER (net_pnl > 0) AS wins, count(*) FILTER (net_pnl < 0) AS losses, round(sum(fee), 4) AS fees, round(sum(net_pnl), 4) AS net,
 round(max(net_pnl) FILTER (net_pnl > 0), 4) AS largest_win, round(min(net_pnl) FILTER (net_pnl < 0), 4) AS largest_loss, round(avg(net_pnl) FILTER (net_pnl > 0), 4) AS avg_win, round(avg(net_pnl) FILTER (net_pnl < 0), 4) AS avg_loss,
 round(avg(hours), 4) AS avg_hours, count(*) FILTER (net_pnl > 0) / count(*) AS win_rate, round(sum(net_pnl) FILTER (net_pnl > 0) / -sum(net_pnl) FILTER (net_pnl < 0), 4) AS profit_factor FROM t GROUP BY run_id""")
def trade_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.totals(market.trades(spark, sf_dir)), 4)


@query(TRADES + """, m AS (SELECT run_id, count(*) AS n, skewness(net_pnl / notional) AS skewness, kurtosis(net_pnl / notional) + 3 AS kurtosis FROM t GROUP BY run_id)
SELECT run_id, n, round(CASE WHEN n >= 4 THEN skewness ELSE 0 END, 4) AS skewness, round(CASE WHEN n >= 4 THEN kurtosis ELSE 3 END, 4) AS kurtosis FROM m""")
def return_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.moments(market.trades(spark, sf_dir)), 4)


@query(RESULTS + " SELECT run_id, n, round(sharpe, 6) + 0.0 AS sharpe, round(sortino, 6) + 0.0 AS sortino, round(total_return, 6) + 0.0 AS total_return, round(max_drawdown, 6) AS max_drawdown, round(profit_factor, 6) AS profit_factor, win_rate FROM r")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.run_results(market.trades(spark, sf_dir)))


@query(RESULTS + " SELECT run_id, round(sharpe, 6) + 0.0 AS sharpe FROM r WHERE NOT sharpe < 0 AND NOT profit_factor < 1 AND NOT max_drawdown > 0.3 AND n >= 10")
def metric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.filtered(trades.run_results(market.trades(spark, sf_dir))).select("run_id", "sharpe"))


@query(RESULTS + " SELECT run_id, round(sharpe, 6) + 0.0 AS sharpe, row_number() OVER (ORDER BY sharpe DESC, run_id) AS rank FROM r")
def rank_by_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.ranked(trades.run_results(market.trades(spark, sf_dir))))


@query(RESULTS + """ SELECT run_id FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.sharpe >= a.sharpe AND 1 - b.max_drawdown >= 1 - a.max_drawdown AND b.profit_factor >= a.profit_factor
 AND (b.sharpe > a.sharpe OR 1 - b.max_drawdown > 1 - a.max_drawdown OR b.profit_factor > a.profit_factor))""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = trades.run_results(market.trades(spark, sf_dir)).withColumn("kept", 1 - F.col("max_drawdown"))
    return screening.pareto_front(results, ["sharpe", "kept", "profit_factor"])


@query("""WITH s AS (SELECT l_suppkey AS run_id, avg((l_discount - 0.05)) / stddev_samp(l_discount - 0.05) * sqrt(count(*)) AS sharpe, sum(l_discount - 0.05) AS total_return, l_linestatus AS g FROM lineitem GROUP BY l_suppkey, l_linestatus),
p AS (SELECT a.run_id, a.sharpe AS ss, a.total_return AS sr, b.sharpe AS vs, b.total_return AS vr FROM s a JOIN s b ON a.run_id = b.run_id AND a.g = 'F' AND b.g = 'O'),
l AS (SELECT run_id, (ss - vs) / abs(ss) AS a, (sr - vr) / abs(sr) AS b FROM p)
SELECT run_id, round(a, 4) + 0.0 AS sharpe_loss, round(b, 4) + 0.0 AS return_loss, a > 0.5 OR b > 0.5 AS sensitive FROM l""")
def screening_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = market.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_discount") - 0.05).alias("x"), "l_linestatus")
    half = lambda g: screening.returns_by_run(own.where(F.col("l_linestatus") == g))
    losses = [(rounded_in_floats(F.col(c), 4) + 0.0).alias(c) for c in ("sharpe_loss", "return_loss")]
    return screening.consistency(half("F"), half("O")).select("run_id", *losses, "sensitive")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders)
SELECT c_custkey AS strategy_id, n_name AS venue, o_orderkey AS best_run, coalesce(o_totalprice, 0) AS score FROM customer LEFT JOIN (SELECT * FROM b WHERE n = 1) ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def runs_with_best_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy (customer) with its venue and best run: left joins with a first row per key."""
    orders, customers, nations = (market.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    best = screening.best_per_key(orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")])
    rows = customers.join(best, customers["c_custkey"] == best["o_custkey"], "left").join(nations, customers["c_nationkey"] == nations["n_nationkey"], "left")
    return rows.select(F.col("c_custkey").alias("strategy_id"), F.col("n_name").alias("venue"), F.col("o_orderkey").alias("best_run"), F.coalesce("o_totalprice", F.lit(0.0)).alias("score"))


@query("SELECT event_type AS event, count(*) AS n, count(DISTINCT user_id) AS runs, epoch_us(min(ts)) // 1000 AS first, epoch_us(max(ts)) // 1000 AS last, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = market.table(spark, sf_dir, "events")
    rows = events.withColumns({"time": market.epoch_ms(events, "ts"), "k": F.get_json_object("props", "$.k").cast("long")})
    return rows.groupBy(F.col("event_type").alias("event")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("runs"), F.min("time").alias("first"), F.max("time").alias("last"), F.sum("k").alias("k"))


@query("""WITH w AS (SELECT CAST(s AS DATE) AS train_start FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 30 DAY) g(s))
SELECT CAST(train_start AS VARCHAR) AS train_start, CAST(train_start + 269 AS VARCHAR) AS train_end, CAST(train_start + 270 AS VARCHAR) AS test_start, CAST(train_start + 359 AS VARCHAR) AS test_end FROM w WHERE train_start + 359 <= DATE '2001-12-31'""")
def walk_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overfitting.walk_forward_windows(spark, "1995-01-01", "2001-12-31")
    return rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])


@query("""WITH w AS (SELECT CAST(s AS DATE) AS train_start FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 90 DAY) g(s)),
v AS (SELECT train_start, train_start + 270 AS test_start, train_start + 359 AS test_end FROM w WHERE train_start + 359 <= DATE '2001-12-31')
SELECT CAST(v.train_start AS VARCHAR) AS train_start, count(*) AS n, round(sum(l_extendedprice * (l_discount - 0.05)), 4) AS net FROM lineitem JOIN v ON CAST(l_shipdate AS DATE) BETWEEN test_start AND test_end GROUP BY v.train_start""")
def trades_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = overfitting.walk_forward_windows(spark, "1995-01-01", "2001-12-31", step=90)
    rows = market.trades(spark, sf_dir).withColumn("day", F.timestamp_millis("exit_time").cast("date"))
    return rounded(overfitting.in_windows(rows, "day", windows).groupBy(F.col("train_start").cast("string").alias("train_start")).agg(F.count(F.lit(1)).alias("n"), F.sum("net_pnl").alias("net")), 4)


@query("""WITH f AS (SELECT CAST(i AS INTEGER) AS fold, i * (n // 5) AS test_from, CASE WHEN i = 4 THEN n ELSE (i + 1) * (n // 5) END AS test_to, n FROM range(5) r(i), (SELECT count(*) AS n FROM orders))
SELECT fold, test_from, test_to, greatest(0, test_from - 50) AS before_to, least(n, test_to + 10) AS after_from FROM f""")
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overfitting.purged_folds(spark, market.table(spark, sf_dir, "orders").count())


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run the interval of its Sharpe ratio from the return of each trade."""
    own = market.trades(spark, sf_dir).withColumn("return", F.try_divide("net_pnl", "notional"))
    return overfitting.bootstrap_rows(own, "return", market.TRADE_ORDER)


E_MAX_100 = scores.expected_maximum(100)


@query(RESULTS + f""", m AS (SELECT run_id, skewness(net_pnl / notional) AS g, kurtosis(net_pnl / notional) + 3 AS k FROM t GROUP BY run_id)
SELECT run_id, round((sharpe / sqrt(n) - {E_MAX_100!r} / sqrt(n - 1)) / sqrt((1 + (k / 4 - 0.25) * (sharpe * sharpe / n) - g * sharpe / sqrt(n)) / (n - 1)), 4) AS z FROM r JOIN m USING (run_id)""")
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = market.trades(spark, sf_dir)
    rows = trades.ratios(own).withColumn("per_trade", F.col("sharpe") / F.sqrt("n")).join(trades.moments(own).drop("n"), "run_id")
    return rounded(rows.select("run_id", scores.deflated_sharpe_z(F.col("per_trade"), 100, F.col("n"), F.col("skewness"), F.col("kurtosis")).alias("z")), 4)


@query(RESULTS + """ SELECT run_id, round(least(greatest((sharpe + 1) / 5, 0), 1) * 0.35 + least(greatest(1 - max_drawdown, 0), 1) * 0.25 + least(greatest(profit_factor / 5, 0), 1) * 0.2 + least(greatest((total_return + 1) / 3, 0), 1) * 0.2, 6) AS fitness FROM r""")
def fitness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.run_results(market.trades(spark, sf_dir))
    return rounded(rows.select("run_id", scores.fitness(F.col("sharpe"), F.col("max_drawdown"), F.col("profit_factor"), F.col("total_return")).alias("fitness")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate IS NOT NULL AS known, round(0.05 + CASE WHEN l_quantity > 0 AND l_tax <> 0 THEN 0.1 * l_tax * sqrt(l_quantity / 1000) ELSE 0 END, 8) AS slip,
 floor(least(100000 * 0.02 / abs(l_extendedprice / l_quantity * 0.05), 100000 * 0.5 / (l_extendedprice / l_quantity), 100000 * 3 / (l_extendedprice / l_quantity)) * 1000) / 1000 AS size FROM lineitem""")
def fills_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = market.table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    raw = scores.atr_size(F.lit(100000.0), 0.02, price, 0.05)
    slip = scores.slippage(F.lit(0.1), F.col("l_tax"), F.col("l_quantity"), F.lit(1000.0))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").isNotNull().alias("known"), F.round(slip, 8).alias("slip"), scores.limited_size(raw, F.lit(100000.0), price, 0.5, 3, 3).cast("double").alias("size"))


@query()
def reconcile_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd ticks as two sets of trades, matched one to one within two minutes."""
    rows = market.ticks(spark, sf_dir).select(F.col("event_id").alias("id"), "symbol", "time")
    return reconcile.match(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


@query("""WITH n AS (SELECT event_type, count(*) AS c FROM events GROUP BY event_type), p AS (SELECT c / sum(c) OVER () AS p FROM n)
SELECT round(-sum(p * log2(p)) / log2(count(*)), 8) AS entropy FROM p""")
def symbol_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.entropy(market.ticks(spark, sf_dir), ["symbol"]).select(F.round("entropy", 8).alias("entropy"))


@query(BARS + """, r AS (SELECT symbol, open_time // 604800000 AS week, (arg_max(close, open_time) - arg_min(open, open_time)) / arg_min(open, open_time) AS r FROM k GROUP BY ALL)
SELECT symbol, week, CAST(CASE WHEN abs(r) < 0.05 THEN 0 ELSE sign(r) END AS INTEGER) AS regime FROM r""")
def weekly_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.regimes(market.klines(spark, sf_dir), 604_800_000).withColumnRenamed("period", "week")
