"""Queries over risk states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import risk
from tidewright.queries import BARS, TRADES, query, rounded
from tidewright.sources import market
from tidewright.sources.scratch import scratch
from tidewright.streaming import live, timers

_O = "ORDER BY exit_time, order_id, line, part_id"
STATES = TRADES + f""", z AS (SELECT *, exit_time // 86400000 AS day, sum((net_pnl >= 0)::INT) OVER (PARTITION BY run_id {_O} ROWS UNBOUNDED PRECEDING) AS g, row_number() OVER (PARTITION BY run_id {_O}) AS i FROM d),
s AS (SELECT *, sum((net_pnl < 0)::INT) OVER (PARTITION BY run_id, g {_O} ROWS UNBOUNDED PRECEDING) AS loss_streak, sum(net_pnl) OVER (PARTITION BY run_id, day {_O} ROWS UNBOUNDED PRECEDING) AS daily_pnl, (peak - equity) / peak AS drawdown FROM z)"""


@query(STATES + " SELECT run_id, order_id, line, part_id, CAST(loss_streak AS BIGINT) AS loss_streak, round(daily_pnl, 4) + 0.0 AS daily_pnl, round(equity - daily_pnl, 4) + 0.0 AS day_start_equity, round(drawdown, 4) + 0.0 AS drawdown FROM s")
def daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.daily_state(market.trades(spark, sf_dir)).select("run_id", "order_id", "line", "part_id", "loss_streak", "daily_pnl", "day_start_equity", "drawdown"), 4)


@query(STATES + """ SELECT run_id, order_id, line, part_id, round(CASE WHEN drawdown <= 0 THEN 1 WHEN drawdown < 0.1 THEN 1 - drawdown / 0.1 * 0.5 WHEN drawdown < 0.2 THEN 0.5 * (1 - (drawdown - 0.1) / 0.1) ELSE 0 END, 4) + 0.0 AS scale FROM s""")
def drawdown_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.daily_state(market.trades(spark, sf_dir))
    return rounded(rows.select("run_id", "order_id", "line", "part_id", risk.drawdown_scale(F.col("drawdown"), 0.1, 0.2).alias("scale")), 4)


BREAKER = STATES.replace("WITH t", "WITH RECURSIVE t") + """, b AS (SELECT run_id, i, exit_time, order_id, line, part_id, CASE WHEN drawdown >= 0.3 THEN 'drawdown' WHEN daily_pnl < 0 AND -daily_pnl / nullif(greatest(equity - daily_pnl, 0), 0) >= 0.02 THEN 'daily_loss' WHEN loss_streak >= 4 THEN 'consecutive_losses' END AS rule FROM s),
m AS (SELECT run_id, i, CASE WHEN rule IS NOT NULL THEN exit_time END AS halted, rule AS reason FROM b WHERE i = 1
 UNION ALL SELECT b.run_id, b.i, CASE WHEN halted IS NOT NULL AND exit_time - halted < 2592000000 THEN halted WHEN rule IS NOT NULL THEN exit_time END, CASE WHEN halted IS NOT NULL AND exit_time - halted < 2592000000 THEN NULL ELSE rule END FROM m JOIN b ON b.run_id = m.run_id AND b.i = m.i + 1)
SELECT m.run_id, order_id, line, part_id, CASE WHEN halted IS NULL THEN 'ACTIVE' ELSE 'HALTED' END AS state, reason FROM m JOIN b USING (run_id, i)"""


@query(BREAKER)
def strategy_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs halted by drawdown, a day's loss or a streak of losses, for thirty days each time."""
    rows = risk.strategy_breaker(risk.daily_state(market.trades(spark, sf_dir)), 0.3, 0.02, 4, 720.0)
    return rows.select("run_id", "order_id", "line", "part_id", "state", "reason")


@query(BREAKER)
def streamed_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of trades, whose number a run is their order."""
    path = scratch(spark, "trades")
    by = risk.Window.partitionBy("run_id").orderBy(*market.TRADE_ORDER)
    rows = market.trades(spark, sf_dir).withColumn("seq", F.row_number().over(by).cast("long")).select("run_id", "seq", "exit_time", "net_pnl", "order_id", "line", "part_id")
    rows.write.parquet(f"{path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    live.go_on(live.live_breaker(source, max_drawdown=0.3, max_streak=4, cooldown_hours=720.0, keep=["order_id", "line", "part_id"]), f"{path}/out", f"{path}/checkpoint", None).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("run_id", "order_id", "line", "part_id", "state", "reason")


@query("""WITH RECURSIVE p AS (SELECT l_returnflag AS portfolio, epoch_ms(l_shipdate) AS time, sum(l_extendedprice) / 1e6 AS exposure, avg(l_discount) * 2 AS drawdown FROM lineitem GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY time) AS i, CASE WHEN drawdown >= 0.15 THEN 'drawdown' WHEN exposure >= 1 THEN 'exposure' END AS rule FROM p),
m AS (SELECT portfolio, i, CASE WHEN rule IS NULL THEN 'ACTIVE' ELSE 'HALTED' END AS state, time AS since, rule AS reason FROM b WHERE i = 1
 UNION ALL SELECT portfolio, i, CASE WHEN now <> 'HALTED' AND rule IS NOT NULL THEN 'HALTED' ELSE now END, CASE WHEN now <> 'HALTED' AND rule IS NOT NULL OR now <> state AND now = 'COOLDOWN' THEN time ELSE since END, CASE WHEN now <> 'HALTED' THEN rule END FROM
  (SELECT b.portfolio, b.i, b.time, b.rule, m.state, m.since, CASE WHEN state = 'HALTED' AND time - since >= 172800000 THEN 'COOLDOWN' WHEN state = 'COOLDOWN' AND time - since >= 172800000 THEN 'ACTIVE' ELSE state END AS now FROM m JOIN b ON b.portfolio = m.portfolio AND b.i = m.i + 1))
SELECT m.portfolio, time, state, CASE state WHEN 'ACTIVE' THEN 1.0 WHEN 'COOLDOWN' THEN 0.5 ELSE 0.0 END::DOUBLE AS size_scale, reason FROM m JOIN b USING (portfolio, i)""")
def portfolio_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios halted by drawdown or exposure, that go on with half of the size at first."""
    items = market.table(spark, sf_dir, "lineitem")
    rows = items.groupBy(F.col("l_returnflag").alias("portfolio"), market.epoch_ms(items, "l_shipdate").alias("time")).agg((F.sum("l_extendedprice") / 1e6).alias("exposure"), (F.avg("l_discount") * 2).alias("drawdown"))
    return risk.portfolio_breaker(rows, {"drawdown": 0.15, "exposure": 1.0}, 48.0).drop("exposure", "drawdown")


@query(BARS + """, p AS (SELECT *, symbol || '-' || open_time // 1814400000 AS position_id, CASE WHEN open_time // 1814400000 % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction FROM k),
l AS (SELECT *, CASE WHEN direction = 'LONG' THEN close - 2 * (high - low) ELSE -(close + 2 * (high - low)) END AS level FROM p),
s AS (SELECT *, max(level) OVER (PARTITION BY position_id ORDER BY open_time) AS best, max(level) OVER (PARTITION BY position_id ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM l)
SELECT position_id, open_time, round(CASE WHEN direction = 'LONG' THEN best ELSE -best END, 6) + 0.0 AS stop, coalesce(CASE WHEN direction = 'LONG' THEN close ELSE -close END <= prior, false) AS stopped FROM s""")
def trailing_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of three weeks, long and short by turns; a bar's range stands for its ATR."""
    turn = F.floor(F.col("open_time") / 1_814_400_000)
    rows = market.klines(spark, sf_dir).withColumns({"position_id": F.concat("symbol", F.lit("-"), turn.cast("string")), "direction": F.when(turn % 2 == 0, "LONG").otherwise("SHORT"), "atr": F.col("high") - F.col("low")})
    return rounded(risk.trailing_stops(rows).select("position_id", "open_time", "stop", "stopped"))


COUNTED = BREAKER.replace("'consecutive_losses' END AS rule", "'consecutive_losses' WHEN line >= 7 THEN 'position_count' END AS rule")


@query(COUNTED)
def position_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the rule on open positions; a trade's line number stands for how many there are."""
    rows = risk.daily_state(market.trades(spark, sf_dir)).withColumn("positions", F.col("line"))
    return risk.strategy_breaker(rows, 0.3, 0.02, 4, 720.0, max_positions=7).select("run_id", "order_id", "line", "part_id", "state", "reason")


@query(COUNTED.rsplit("SELECT m.run_id", 1)[0] + """SELECT run_id, i AS seq, exit_time AS time, CASE WHEN halted IS NULL THEN 'ACTIVE' ELSE 'HALTED' END AS state, reason FROM m JOIN b USING (run_id, i)
UNION ALL SELECT run_id, 0, halted + 2592000000, 'ACTIVE', 'cooldown' FROM m WHERE reason IS NOT NULL AND halted + 2592000000 < (SELECT max(exit_time) - 43200000 FROM b)""")
def timed_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream in two runs, with a row (seq 0) for each halt that ends, by a trade or by the watermark."""
    path = scratch(spark, "timed")
    by = risk.Window.partitionBy("run_id").orderBy(*market.TRADE_ORDER)
    rows = market.trades(spark, sf_dir).withColumn("seq", F.row_number().over(by).cast("long")).select("run_id", "seq", "exit_time", "net_pnl", F.col("line").cast("long").alias("positions"))
    own = timers.with_timers(spark)
    for part in (F.col("exit_time") < 800_000_000_000, F.col("exit_time") >= 800_000_000_000):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        source = own.readStream.schema(rows.schema).parquet(f"{path}/in")
        found = timers.timed_breaker(source, max_drawdown=0.3, max_streak=4, max_positions=7, cooldown_hours=720.0, delay="12 hours")
        live.go_on(found, f"{path}/out", f"{path}/checkpoint", None).awaitTermination()
    return spark.read.parquet(f"{path}/out").fillna(0, ["seq"])
