"""Analytics of closed trades: equity, drawdown, streaks, monthly returns, totals and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.prefixes import carried, deviation, in_turn, longest_runs
from tidewright.sources.market import TRADE_ORDER

START = 100_000.0
#: Trades in order of entry.
ENTRY_ORDER = ["entry_time", *TRADE_ORDER]


def _by(order: list[str]):  # noqa: ANN202
    return Window.partitionBy("run_id").orderBy(*order)


def equity_curve(trades: DataFrame, start: float = START, order: list[str] = TRADE_ORDER) -> DataFrame:
    """trades with equity after each, its running peak (start included) and drawdown from that."""
    rows = carried(
        trades, ["run_id"], order, lambda w: [{"__sum": F.sum("net_pnl").over(w)}, {"__top": F.max("__sum").over(w)}],
        {"__total": F.sum("net_pnl"), "__peak": F.max("__top")}, lambda w: [{"__start": F.coalesce(F.sum("__total").over(w), F.lit(0.0)) + start}, {"__before": F.greatest(F.lit(float(start)), F.max(F.col("__start") + F.col("__peak")).over(w))}],
    )
    rows = rows.withColumns({"equity": F.col("__start") + F.col("__sum"), "peak": F.greatest(F.col("__before"), F.col("__start") + F.col("__top"))})
    return rows.drop("__sum", "__top", "__start", "__before").withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def equity_points(trades: DataFrame, start: float = START, order: list[str] = TRADE_ORDER) -> DataFrame:
    """run_id, place, time and equity of a run's curve: the starting balance at the first closed trade's
    entry (place 0), then the equity after each trade."""
    rows = equity_curve(trades, start, order).withColumn("place", F.row_number().over(_by(order)))
    first = rows.where("place = 1").select("run_id", F.lit(0).alias("place"), F.col("entry_time").alias("time"), F.lit(float(start)).alias("equity"))
    return first.unionByName(rows.select("run_id", "place", F.col("exit_time").alias("time"), "equity"))


def max_drawdown(trades: DataFrame, start: float = START, order: list[str] = TRADE_ORDER) -> DataFrame:
    """The largest drawdown of each run; 0 for a starting balance that is not positive. Screening orders
    trades by their end, validation by their beginning (ENTRY_ORDER)."""
    if start <= 0:
        return trades.groupBy("run_id").agg(F.lit(0.0).alias("max_drawdown"))
    return equity_curve(trades, start, order).groupBy("run_id").agg(F.max("drawdown").alias("max_drawdown"))


def streaks(trades: DataFrame, order: list[str] = TRADE_ORDER) -> DataFrame:
    """Per run the longest runs of wins and of losses; a trade of zero breaks both."""
    return longest_runs(trades, "run_id", order, F.signum("net_pnl").cast("int"))


def monthly_returns(trades: DataFrame, start: float = START) -> DataFrame:
    """Percent of the starting balance by run and month of exit."""
    month = F.date_format(F.timestamp_millis("exit_time"), "yyyy-MM")
    return trades.groupBy("run_id", month.alias("month")).agg((F.sum("net_pnl") / start * 100).alias("percent"))


def totals(trades: DataFrame) -> DataFrame:
    win, loss = F.col("net_pnl") > 0, F.col("net_pnl") < 0
    rows = trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), F.sum(F.abs("fee")).alias("fees"), F.sum("net_pnl").alias("net"),
        F.max(F.when(win, F.col("net_pnl"))).alias("largest_win"), F.min(F.when(loss, F.col("net_pnl"))).alias("largest_loss"), F.avg(F.when(win, F.col("net_pnl"))).alias("avg_win"), F.avg(F.when(loss, F.col("net_pnl"))).alias("avg_loss"),
        F.avg("hours").alias("avg_hours"), F.sum(F.when(win, F.col("net_pnl")).otherwise(0.0)).alias("gained"), F.sum(F.when(loss, -F.col("net_pnl")).otherwise(0.0)).alias("lost"),
    )
    factor = F.when(F.col("lost") > 1e-9, F.col("gained") / F.col("lost")).otherwise(F.when(F.col("gained") > 0, float("inf")).otherwise(0.0))
    return rows.withColumn("win_rate", F.col("wins") / F.col("n")).withColumn("profit_factor", factor).drop("gained", "lost")


def moments(trades: DataFrame, value: Column | None = None) -> DataFrame:
    """Bias-corrected skewness and kurtosis (3 for normal) of returns; (0, 3) for fewer than four or
    equal ones."""
    x = value if value is not None else F.when(F.col("notional") > 0, F.col("net_pnl") / F.col("notional"))
    rows = trades.withColumn("__x", x).groupBy("run_id").agg(F.count("__x").alias("n"), F.skewness("__x").alias("g1"), F.kurtosis("__x").alias("g2"))
    n, known = F.col("n"), (F.col("n") >= 4) & F.col("g1").isNotNull() & ~F.isnan(F.coalesce("g1", F.lit(0.0)))
    skew = F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1)) * F.col("g1")
    kurt = (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1)) * ((n + 1) * F.col("g2") + 6) + 3
    return rows.select("run_id", "n", F.when(known, skew).otherwise(0.0).alias("skewness"), F.when(known, kurt).otherwise(3.0).alias("kurtosis"))


def ratios(trades: DataFrame) -> DataFrame:
    """Sharpe and Sortino ratio of a run's trade returns times the root of their number. Returns are summed in the
    order in which they are read, so that runs of equal trades have equal ratios."""
    x = F.col("net_pnl") / F.col("notional")
    rows = in_turn(trades.select("run_id", "net_pnl", "notional"), "run_id").groupBy("run_id").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), deviation(x).alias("dev"), deviation(F.when(x < 0, x)).alias("down"), F.sum(x).alias("total_return"))
    ratio = lambda by: F.when(F.col(by) > 1e-10, F.col("mean") / F.col(by) * F.sqrt("n")).otherwise(0.0)
    return rows.select("run_id", "n", ratio("dev").alias("sharpe"), ratio("down").alias("sortino"), "total_return")


def run_results(trades: DataFrame) -> DataFrame:
    """One row per run: sharpe, sortino, total_return, max_drawdown, profit_factor, win_rate, trades."""
    return ratios(trades).join(max_drawdown(trades), "run_id").join(totals(trades).select("run_id", "profit_factor", "win_rate"), "run_id")


def projected(trades: DataFrame) -> DataFrame:
    """Trades as a report shows them: return in per cent of the notional, half of the fee at either end,
    profit before fees, and constants for what is not simulated."""
    return trades.withColumns(
        {
            "roi_percent": F.when(F.col("notional") > 0, F.col("net_pnl") / F.col("notional") * 100).otherwise(0.0), "entry_fee": F.col("fee") / 2, "exit_fee": F.col("fee") / 2,
            "gross_pnl": F.col("net_pnl") + F.col("fee"), "funding": F.lit(0.0), "exit_reason": F.lit("signal"),
        }
    )


def extended(trades: DataFrame, start: float = START) -> DataFrame:
    """Per run its return, days from first entry to last exit (1 at least), cagr, volatility_annual of trade
    returns other than 0 (as many a year as their mean duration allows), and calmar_ratio."""
    roi = F.when(F.col("notional") > 0, F.col("net_pnl") / F.col("notional"))
    hours = (F.col("exit_time") - F.col("entry_time")) / 3_600_000.0
    rows = trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("net_pnl") / start).alias("total_return"), F.min("entry_time").alias("first"), F.max_by("exit_time", F.struct(*ENTRY_ORDER)).alias("last"),
        F.var_samp(F.when(roi != 0, roi)).alias("variance"), F.avg(F.when(hours >= 0, hours)).alias("avg_hours"),
    ).join(max_drawdown(trades, start, ENTRY_ORDER), "run_id")
    days, total = F.greatest((F.col("last") - F.col("first")) / 86_400_000.0, F.lit(1.0)), F.col("total_return")
    cagr = F.when(total == 0, 0.0).when(total == -1, -1.0).when(total > -1, F.pow(F.greatest(total + 1, F.lit(0.0)), 365.0 / days) - 1).otherwise(0.0)
    a_year = F.coalesce(365.0 / F.greatest(F.col("avg_hours") / 24, F.lit(0.01)), F.lit(252.0))
    rows = rows.withColumns({"days": days, "cagr": cagr, "volatility_annual": F.coalesce(F.sqrt(F.col("variance") * a_year), F.lit(0.0))})
    calmar = F.when((F.col("max_drawdown") > 0) & (F.col("cagr") != 0), F.col("cagr") / F.when(F.col("max_drawdown") > 0, F.col("max_drawdown"))).otherwise(0.0)
    return rows.select("run_id", "n", "total_return", "days", "avg_hours", "max_drawdown", "cagr", "volatility_annual", calmar.alias("calmar_ratio"))


def compounded(trades: DataFrame, order: list[str] = TRADE_ORDER) -> DataFrame:
    """trades with the product of 1 + return so far, its running peak and the drawdown from that. The sum
    of logarithms stands for the product; a loss of everything is minus infinity and stays so."""
    sofar = _by(order).rowsBetween(Window.unboundedPreceding, 0)
    growth = F.col("net_pnl") / F.col("notional") + 1
    log = F.when(growth > 0, F.log(F.when(growth > 0, growth))).otherwise(F.lit(float("-inf")))
    rows = trades.withColumn("growth", F.exp(F.sum(log).over(sofar)))
    rows = rows.withColumn("growth_peak", F.max("growth").over(sofar))
    return rows.withColumn("growth_drawdown", F.coalesce(F.try_divide(F.col("growth_peak") - F.col("growth"), F.col("growth_peak")), F.lit(0.0)))


def simulated(trades: DataFrame, order: list[str] = TRADE_ORDER) -> DataFrame:
    """Per run the metrics of a simulation: Sharpe and Sortino ratio, compounded return and its largest
    drawdown, profit factor (infinite without losses) and win rate."""
    own = compounded(trades, order).groupBy("run_id").agg((F.max_by("growth", F.struct(*order)) - 1).alias("compounded_return"), F.max("growth_drawdown").alias("growth_drawdown"))
    return ratios(trades).drop("total_return").join(own, "run_id").join(totals(trades).select("run_id", "profit_factor", "win_rate"), "run_id")


def market_stats(bars: DataFrame, volume: float = 1000.0, volatility: float = 0.02) -> DataFrame:
    """Per symbol the mean of positive volumes and the deviation of the logarithms of moves between positive
    closes; the given values where there are none, or no moves."""
    positive = bars.where("close > 0")
    move = F.log(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("open_time")))
    moves = positive.select("symbol", move.alias("move")).groupBy("symbol").agg(F.stddev_samp("move").alias("dev"))
    rows = bars.groupBy("symbol").agg(F.avg(F.when(F.col("volume") > 0, F.col("volume"))).alias("mean")).join(moves, "symbol", "left")
    return rows.select("symbol", F.coalesce("mean", F.lit(volume)).alias("avg_volume"), F.coalesce(F.when(F.col("dev") > 0, F.col("dev")), F.lit(volatility)).alias("volatility"))


def exposure(positions: DataFrame, equity: float, stop: float = 0.02) -> DataFrame:
    """Per symbol the sum of absolute notionals in shares of equity; of all symbols together; and the heat,
    what all lose at stops of 2 %. Nothing for an equity that is not positive. All symbols are one row."""
    if equity <= 0:
        return positions.select("symbol").distinct().select("symbol", *[F.lit(0.0).alias(c) for c in ("exposure", "total", "heat")])
    own = positions.groupBy("symbol").agg((F.sum(F.abs("notional")) / equity).alias("exposure"))
    every = own.agg(F.sum("exposure").alias("total")).withColumn("__k", F.lit(0))
    return own.withColumn("__k", F.lit(0)).join(every, "__k").select("symbol", "exposure", "total", (F.col("total") * stop).alias("heat"))
