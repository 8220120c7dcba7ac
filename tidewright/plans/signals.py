"""Queries over conditions and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import conditions as c
from tidewright.functions import dates
from tidewright.operators import indicators
from tidewright.queries import BARS, query, rounded
from tidewright.sources import market

_W = "(PARTITION BY symbol ORDER BY open_time)"
AVERAGES = BARS + f""",
a AS (SELECT *, CASE WHEN count(*) OVER w5 >= 5 THEN avg(close) OVER w5 END AS fast, CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 END AS slow FROM k
      WINDOW w5 AS (PARTITION BY symbol ORDER BY open_time ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY open_time ROWS 19 PRECEDING)),
b AS (SELECT *, lag(fast) OVER {_W} AS pf, lag(slow) OVER {_W} AS ps, lag(close) OVER {_W} AS pc FROM a)"""


def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.klines(spark, sf_dir).withColumns({"fast": indicators.sma(5), "slow": indicators.sma(20)})


@query(AVERAGES + """ SELECT symbol, open_time, coalesce(fast > slow AND pf <= ps, false) AS above, coalesce(fast < slow AND pf >= ps, false) AS below, coalesce(close > slow AND close <= ps, false) AS price_compat,
 coalesce(close > slow AND pc <= ps, false) AS price_exact, close BETWEEN 20 AND 80 AS inside, coalesce(fast > 40 AND pf <= 40, false) AS over_40, coalesce(close >= fast, false) AS not_under, coalesce(fast IS NOT NULL AND slow IS NOT NULL, false) AS ready,
 CASE WHEN coalesce(close > fast AND fast > slow, false) THEN 'LONG' WHEN coalesce(close < fast AND fast < slow, false) THEN 'SHORT' END AS side FROM b""")
def condition_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of averages, prices and numbers, ranges and both sides of a strategy."""
    long, short = (c.every([c.compare("close", sign, "fast"), c.compare("fast", sign, "slow")]) for sign in "><")
    return averages(spark, sf_dir).select(
        "symbol", "open_time", c.crosses_above("fast", "slow").alias("above"), c.crosses_below("fast", "slow").alias("below"), c.crosses_above("close", "slow").alias("price_compat"),
        c.crosses_above("close", "slow", compat=False).alias("price_exact"), c.between("close", 20, 80).alias("inside"), c.crosses_above("fast", 40).alias("over_40"), c.compare("close", ">=", "fast").alias("not_under"),
        c.ready(["fast", "slow"]).alias("ready"), c.side(long, short).alias("side"),
    )


@query(BARS + """ SELECT symbol, level AS close_30_threshold, count(*) FILTER (close < level) AS below, count(*) AS bars FROM k, (VALUES (20.0::DOUBLE), (30.0::DOUBLE), (40.0::DOUBLE)) v(level) GROUP BY ALL""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of a condition as a parameter of a grid: each bar meets each value in its own task."""
    name = c.threshold_name("close", 30)
    rows = market.klines(spark, sf_dir).withColumn(name, F.explode(F.array(*[F.lit(v) for v in (20.0, 30.0, 40.0)])))
    return rows.groupBy("symbol", name).agg(F.count_if(F.col("close") < c.threshold("close", 30, rows.columns)).alias("below"), F.count(F.lit(1)).alias("bars"))


NEW_YORK = "make_timestamp(open_time * 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'"


@query(BARS + f""", t AS (SELECT symbol, open_time, make_timestamp(open_time * 1000) AS u, CAST({NEW_YORK} AS TIME) AS ny FROM k)
SELECT symbol, open_time, isodow(u) >= 6 AS weekend, ny BETWEEN TIME '09:30:00' AND TIME '16:00:00' OR CAST(u AS TIME) >= TIME '22:00:00' OR CAST(u AS TIME) <= TIME '02:00:00' AS open,
 hour(u) IN (0, 8, 16) AND minute(u) < 15 OR hour(u) IN (23, 7, 15) AND minute(u) >= 30 AS funding FROM t""")
def time_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekends, two sessions (one over midnight) and times of funding."""
    time = F.col("open_time")
    sessions = [("09:30", "16:00", "America/New_York"), ("22:00", "02:00", "UTC")]
    return market.klines(spark, sf_dir).select("symbol", "open_time", c.blocked_weekday(time, [5, 6]).alias("weekend"), c.in_sessions(time, sessions).alias("open"), c.near_funding(time, 30, 15).alias("funding"))


_P = "(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(AVERAGES + f""", g AS (SELECT *, isodow(make_timestamp(open_time * 1000)) < 6 AND fast IS NOT NULL AND slow IS NOT NULL AS gate FROM a),
h AS (SELECT *, last_value(CASE WHEN gate THEN fast END IGNORE NULLS) OVER {_P} AS gf, last_value(CASE WHEN gate THEN slow END IGNORE NULLS) OVER {_P} AS gs FROM g)
SELECT symbol, open_time, gate, gate AND coalesce(fast > slow AND gf <= gs, false) AS crossed FROM h""")
def gated_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings that look at the last bar that passed the gate of time and readiness."""
    rows = averages(spark, sf_dir).withColumn("gate", ~c.blocked_weekday(F.col("open_time"), [5, 6]) & c.ready(["fast", "slow"]))
    return rows.select("symbol", "open_time", "gate", (F.col("gate") & c.crosses_above("fast", "slow", gate=F.col("gate"))).alias("crossed"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(60 + o_orderkey % 100 AS INTEGER) AS b FROM orders)
SELECT o_orderkey, greatest((b - a) * 1440 // 240, 1) AS bars, CAST(a + CAST(greatest(1, floor((b - a) * 0.7::DOUBLE)) AS INTEGER) AS VARCHAR) AS split, len(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS months,
 CAST(CAST(a + INTERVAL 5 MONTH AS DATE) AS VARCHAR) AS shifted, CAST(CAST(a - INTERVAL 3 YEAR AS DATE) AS VARCHAR) AS before, strftime(a, '%Y-%m-%dT00:00:01.000005+00:00') AS iso FROM o""")
def date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a range, its split and months, shifts by months and years, and times as text."""
    a, days = F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 100 + 60).cast("int")
    rows = market.table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), F.date_add(a, days).alias("b"))
    minutes = dates.interval_minutes(F.lit("4h"))
    return rows.select(
        "o_orderkey", dates.bar_count(F.col("a"), F.col("b"), minutes).alias("bars"), dates.split_at(F.col("a"), F.col("b"), 0.7).cast("string").alias("split"), F.size(dates.months_between(F.col("a"), F.col("b"))).cast("long").alias("months"),
        dates.shifted(F.col("a"), 5).cast("string").alias("shifted"), dates.years_ago(F.col("a"), 3).cast("string").alias("before"), dates.iso_of_ns(F.unix_date("a").cast("long") * 86_400_000_000_000 + 1_000_005_999).alias("iso"),
    )


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, 60 + o_orderkey % 100 AS d FROM orders)
SELECT o_orderkey, CAST(w AS INTEGER) AS window, CAST(a + CAST(w * (d // 4) AS INTEGER) AS VARCHAR) AS window_start, CAST(a + CAST(CASE WHEN w = 3 THEN d ELSE (w + 1) * (d // 4) END AS INTEGER) AS VARCHAR) AS window_end FROM o, range(4) r(w)""")
def equal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_orderdate").cast("date")
    rows = market.table(spark, sf_dir, "orders").select("o_orderkey", a.alias("start"), F.date_add(a, (F.col("o_orderkey") % 100 + 60).cast("int")).alias("end"))
    return dates.windows_of(rows, 4).select("o_orderkey", "window", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query(BARS + """, x AS (SELECT symbol, open_time, close, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS before FROM k)
SELECT symbol, open_time, round(close / before - 1, 6) AS move, replace(symbol, 'e', '') AS plain, CASE WHEN symbol LIKE '%ch' THEN left(symbol, length(symbol) - 2) || '-ch' ELSE symbol END AS dashed FROM x""")
def moves_and_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.klines(spark, sf_dir).withColumn("move", F.col("close") / c.previous(F.col("close")) - 1)
    return rounded(rows.select("symbol", "open_time", "move", dates.plain_symbol(F.replace("symbol", F.lit("e"), F.lit("-"))).alias("plain"), dates.dashed_symbol(F.col("symbol"), "ch").alias("dashed")))
