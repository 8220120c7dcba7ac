"""Queries over runs, their results, trades and windows."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import scores, sizers
from tidewright.operators import overfitting, reconcile, runs, screening, timeseries, trades
from tidewright.queries import BARS, RESULTS, TRADES, query, rounded, rounded_in_floats
from tidewright.sources import market

YEAR = "year(l_shipdate)"
#: Results of each run and year; run_id is ten thousand times the run, and the year.
YEARLY = RESULTS.replace("l_suppkey AS run_id", f"l_suppkey * 10000 + {YEAR} AS run_id") + """,
y AS (SELECT run_id // 10000 AS run_id, CAST(run_id % 10000 AS INTEGER) AS year, n, sharpe, sortino, total_return, max_drawdown, profit_factor, win_rate FROM r)"""


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.trades(spark, sf_dir).withColumn("run_id", F.col("run_id") * 10_000 + F.year(F.timestamp_millis("exit_time")))
    found = trades.run_results(rows)
    return found.withColumn("year", (F.col("run_id") % 10_000).cast("int")).withColumn("run_id", F.floor(F.col("run_id") / 10_000))


def orders_as_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("strategy_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("created_at"))


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("net"))


ORDERS = "WITH s AS (SELECT l_orderkey AS run_id, count(*) AS n, sum(l_extendedprice * (l_discount - 0.05)) AS net FROM lineitem GROUP BY 1)"


@query(ORDERS + " SELECT c_custkey AS strategy_id, c_name AS name, count(*) AS runs, round(sum(net), 4) + 0.0 AS net FROM s JOIN orders ON o_orderkey = run_id JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def sweeps_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined with their runs and these with their strategies."""
    strategies = market.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("strategy_id"), F.col("c_name").alias("name"))
    rows = runs.with_runs(order_results(spark, sf_dir), orders_as_runs(spark, sf_dir), strategies)
    return rounded(rows.groupBy("strategy_id", "name").agg(F.count(F.lit(1)).alias("runs"), F.sum("net").alias("net")), 4)


@query(ORDERS + " SELECT run_id, n, round(net, 4) + 0.0 AS net, o_orderstatus AS status FROM s JOIN orders ON o_orderkey = run_id WHERE o_custkey = 7 ORDER BY run_id DESC LIMIT 5")
def newest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.newest_results(order_results(spark, sf_dir), orders_as_runs(spark, sf_dir), 7, 5).select("run_id", "n", "net", "status"), 4)


@query("SELECT o_orderkey AS run_id, o_custkey AS strategy_id FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-12-31'")
def run_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.filtered_runs(orders_as_runs(spark, sf_dir), status="F", since="1996-03-01", until="1996-12-31").select("run_id", "strategy_id")


@query(TRADES + " SELECT run_id, order_id, line, part_id, round(net_pnl, 4) + 0.0 AS net_pnl FROM t WHERE symbol = 'A' AND direction = 'SHORT'")
def trade_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.filtered_trades(market.trades(spark, sf_dir), "A", "SHORT").select("run_id", "order_id", "line", "part_id", "net_pnl"), 4)


@query("""WITH r AS (SELECT o_custkey % 10 AS champion, o_orderstatus AS w, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS v FROM orders WHERE o_custkey % 3 = 1)
SELECT champion, round(avg(v) FILTER (w = 'F'), 4) AS "F", round(avg(v) FILTER (w = 'O'), 4) AS "O", round(avg(v) FILTER (w = 'P'), 4) AS "P" FROM r GROUP BY champion""")
def campaign_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Champions by windows of the campaign that the runs' JSON names; half of the runs have no result."""
    orders = market.table(spark, sf_dir, "orders")
    own = orders.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 10).alias("champion"), F.col("o_orderstatus").alias("window"), F.to_json(F.struct((F.col("o_custkey") % 3).cast("string").alias("campaign_id"))).alias("config"))
    found = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("sharpe"))
    return rounded(runs.campaign_matrix(own, found, "1", windows=["F", "O", "P"]), 4)


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results with JSON notes; every fifth is broken, and every seventh has none."""
    key = F.col("o_orderkey")
    windows = F.array(*[F.struct((key % 4 * k / 4).alias("sharpe"), (key % 9 - 4.0).alias("return_pct"), F.lit(0.1).alias("max_dd"), key.alias("trades")) for k in (1, 2)])
    best = F.struct(F.concat(F.lit("s"), key.cast("string")).alias("name"), F.when(key % 3 == 0, 0).otherwise(key % 50).alias("trades"), (key % 10 / 10).alias("score"), F.struct(windows.alias("windows")).alias("cross_window"), F.struct((key % 8 / 8).alias("sharpe_consistency")).alias("wfa"))
    notes = F.to_json(F.struct(F.array(best).alias("top_strategies"), F.array(F.lit(-3), F.lit(6)).alias("cross_window_months"), F.lit(0.6).alias("cross_window_min_sharpe"), F.struct((key % 5 / 5).alias("lower"), F.lit(2.0).alias("upper"), F.lit(0.95).alias("level")).alias("bootstrap_ci")))
    return market.table(spark, sf_dir, "orders").select(key.alias("run_id"), F.when(key % 7 == 0, None).when(key % 5 == 0, "{broken").otherwise(notes).alias("notes"))


@query("""WITH x AS (SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0 ORDER BY 1 DESC LIMIT 10)
SELECT run_id, 's' || run_id AS name FROM x WHERE run_id % 5 <> 0 ORDER BY run_id % 3 <> 0 AND run_id % 50 > 0 DESC, run_id DESC LIMIT 1""")
def latest_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = orders_as_runs(spark, sf_dir).withColumn("status", F.when(F.col("status") == "F", "completed").otherwise("open"))
    return runs.latest_with_trades(own, _noted(spark, sf_dir)).select("run_id", F.col("strategies")[0]["name"].alias("name"))


@query("""SELECT o_orderkey AS run_id, CASE WHEN ok THEN 2 END AS windows, CASE WHEN ok THEN 6 END AS offset_2, CASE WHEN ok THEN o_orderkey % 4 * 2 / 4 END AS sharpe_2, CASE WHEN ok THEN o_orderkey % 4 / 4 >= 0.6 END AS passed_1,
 CASE WHEN ok THEN o_orderkey % 8 / 8 END AS wfa_consistency, CASE WHEN ok THEN o_orderkey % 5 / 5 END AS bootstrap_lower, CASE WHEN ok THEN 0.95::DOUBLE END AS bootstrap_level FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE true END AS ok FROM orders)""")
def noted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.noted_fields(_noted(spark, sf_dir))
    w = F.col("cross_window")
    return rows.select("run_id", F.when(w.isNotNull(), F.size(w)).alias("windows"), F.get(w, F.lit(1))["offset"].alias("offset_2"), F.get(w, F.lit(1))["sharpe"].alias("sharpe_2"), F.get(w, F.lit(0))["passed"].alias("passed_1"), "wfa_consistency", "bootstrap_lower", "bootstrap_level")


@query("SELECT o_orderkey AS run_id, CAST(NULL AS BOOLEAN) AS passed_dsr, CAST(NULL AS BOOLEAN) AS passed_wfa, CAST(NULL AS BOOLEAN) AS passed_cv FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2)")
def promoted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweeps = market.table(spark, sf_dir, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("run_id"))
    return runs.promoted(orders_as_runs(spark, sf_dir).select("run_id"), sweeps)


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trades.run_results(market.trades(spark, sf_dir))
    dsr, wfa = found.select("run_id", (F.col("sharpe") > 0).alias("passed")), found.where("run_id % 4 > 0").select("run_id", (F.col("max_drawdown") < 0.2).alias("passed"))
    return runs.filter_chain(found.select("run_id", "sharpe"), dsr, wfa)


CHAIN = RESULTS + ", f AS (SELECT run_id, sharpe, sharpe > 0 AS passed_dsr, CASE WHEN run_id % 4 > 0 THEN max_drawdown < 0.2 ELSE false END AS passed_wfa, CAST(NULL AS BOOLEAN) AS passed_cv FROM r)"


@query(CHAIN + " SELECT run_id, round(sharpe, 6) + 0.0 AS sharpe, passed_dsr, passed_wfa, passed_cv, passed_dsr AND passed_wfa AS passed_all FROM f")
def overfit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of three filters, of which one was not asked for."""
    return rounded(_chain(spark, sf_dir))


@query(CHAIN + " SELECT count(*) AS candidates, count(*) FILTER (passed_dsr) AS passed_dsr, count(*) FILTER (passed_wfa) AS passed_wfa, count(*) FILTER (passed_cv) AS passed_cv, count(*) FILTER (passed_dsr AND passed_wfa) AS passed_all FROM f")
def overfit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.chain_counts(_chain(spark, sf_dir))


@query(CHAIN + " SELECT run_id, 'all' AS needed FROM f WHERE passed_dsr AND passed_wfa UNION ALL SELECT run_id, 'any' FROM f WHERE passed_dsr OR passed_wfa")
def overfit_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _chain(spark, sf_dir)
    return runs.survivors(chain).select("run_id", F.lit("all").alias("needed")).unionByName(runs.survivors(chain, False).select("run_id", F.lit("any").alias("needed")))


#: The expected maximum of as many trials as the test tables have suppliers.
E_MAX = "CASE n_all " + " ".join(f"WHEN {n} THEN {scores.expected_maximum(n)!r}" for n in (10, 100, 1000)) + " END"
MOMENTS = ", m AS (SELECT run_id, skewness(net_pnl / notional) AS g, kurtosis(net_pnl / notional) + 3 AS kt FROM t GROUP BY run_id)"
#: Half less the integral of the normal density from 0 to |z|, as a power series of odd double factorials.
P_VALUE = "CASE WHEN z < 0 THEN 1 - tail ELSE tail END"
TAIL = "CASE WHEN z = 0 THEN 0.5 ELSE 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80), lambda k: exp((2 * k + 1) * ln(abs(z)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))) END"


@query(RESULTS + MOMENTS + f""", v AS (SELECT r.*, g, kt, sharpe / sqrt(n) AS per_trade, count(*) OVER () AS n_all, var_samp(sharpe / sqrt(n)) OVER () AS variance FROM r JOIN m USING (run_id)),
z AS (SELECT run_id, (per_trade - sqrt(variance) * {E_MAX}) / sqrt((1 + (kt / 4 - 0.25) * per_trade * per_trade - g * per_trade) / (greatest(n, 30) - 1)) AS z FROM v)
SELECT run_id, round(z, 4) + 0.0 AS z FROM z WHERE z > {NormalDist().inv_cdf(1 - 0.999)!r}""")
def deflated_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose Sharpe ratio of a trade is more than the best of all runs' would be by chance, loosely."""
    own = market.trades(spark, sf_dir)
    rows = trades.ratios(own).withColumn("sharpe", F.col("sharpe") / F.sqrt("n")).join(trades.moments(own).drop("n"), "run_id")
    return rounded(runs.deflated_filter(rows, rows, significance=0.999).select("run_id", "z"), 4)


@query(RESULTS + MOMENTS + f""", z AS (SELECT run_id, greatest(-5, least(5, (sharpe / sqrt(n) - 0.02) / sqrt((1 + (kt / 4 - 0.25) * (sharpe * sharpe / n) - g * sharpe / sqrt(n)) / (n - 1)))) AS z FROM r JOIN m USING (run_id)), q AS (SELECT *, {TAIL} AS tail FROM z)
SELECT run_id, round({P_VALUE}, 6) + 0.0 AS p, round(1 - ({P_VALUE}), 6) + 0.0 AS confidence, {P_VALUE} < 0.5 AS significant FROM q""")
def sharpe_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure it is that a run's Sharpe ratio of a trade is above 0.02, with its skewness and kurtosis."""
    own = market.trades(spark, sf_dir)
    rows = trades.ratios(own).withColumn("x", F.col("sharpe") / F.sqrt("n")).join(trades.moments(own).drop("n"), "run_id")
    spread = (1 + (F.col("kurtosis") / 4 - 0.25) * F.col("x") * F.col("x") - F.col("skewness") * F.col("x")) / (F.col("n") - 1)
    z = scores.clamp((F.col("x") - 0.02) / F.sqrt(spread), -5.0, 5.0)
    return rounded(rows.withColumn("z", z).select("run_id", scores.normal_tail(F.col("z")).alias("p"), scores.deflated_confidence(F.col("z")).alias("confidence"), scores.deflated_passes(F.col("z"), 0.5).alias("significant")))


@query(RESULTS + """ SELECT run_id, concat_ws(',', CASE WHEN n < 580 THEN 'trades' END, CASE WHEN total_return < 0 THEN 'return' END, CASE WHEN run_id % 12 > 8 THEN 'complexity' END, CASE WHEN sharpe < -1 THEN 'dsr' END) AS reasons,
 n >= 580 AND total_return >= 0 AND run_id % 12 <= 8 AND sharpe >= -1 AS passed FROM r""")
def guardrail_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.run_results(market.trades(spark, sf_dir)).withColumn("genes", F.col("run_id") % 12)
    checks = {"dsr": F.col("sharpe") >= -1, "bootstrap": F.lit(None).cast("boolean")}
    return runs.guardrails(rows, 580, 0.0, 8, checks).select("run_id", F.concat_ws(",", "reasons").alias("reasons"), "passed")


@query(YEARLY + """, o AS (SELECT run_id, min(n2) AS least, sum(n2) AS n, avg(sharpe) AS sharpe, max(max_drawdown) AS dd, sum(profit_factor * n2) / nullif(sum(n2), 0) AS pf, avg(total_return) AS ret FROM (SELECT *, CASE WHEN run_id % 9 = 0 AND year = 1995 THEN 0 ELSE n END AS n2 FROM y) GROUP BY run_id)
SELECT run_id, CAST(CASE WHEN least = 0 THEN 0 ELSE n END AS BIGINT) AS n, round(CASE WHEN least = 0 THEN -1 ELSE sharpe END, 6) + 0.0 AS sharpe, round(CASE WHEN least = 0 THEN 1 ELSE dd END, 6) + 0.0 AS max_drawdown, round(CASE WHEN least = 0 THEN 0 ELSE pf END, 6) + 0.0 AS profit_factor,
 round(CASE WHEN least = 0 THEN 0 ELSE ret END, 6) + 0.0 AS total_return FROM o""")
def over_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year stands for a window; some runs have one without trades."""
    rows = yearly(spark, sf_dir).withColumns({"n": F.when((F.col("run_id") % 9 == 0) & (F.col("year") == 1995), 0).otherwise(F.col("n")), "skewness": F.lit(0.0), "kurtosis": F.lit(3.0)})
    return rounded(runs.over_windows(rows).drop("skewness", "kurtosis").withColumn("n", F.col("n").cast("long")))


@query(YEARLY + """, w AS (SELECT run_id // 10000 AS run_id, CAST(run_id % 10000 AS INTEGER) AS year, count(*) FILTER (net_pnl > 0) AS wins, sum(abs(fee)) AS fees, max(net_pnl) FILTER (net_pnl > 0) AS lw, min(net_pnl) FILTER (net_pnl < 0) AS ll FROM t GROUP BY ALL)
SELECT run_id, count(*) AS windows, round(product(1 + total_return / 100) - 1, 6) + 0.0 AS total_return, round(sum(sharpe * n) / sum(n), 6) + 0.0 AS sharpe, round(sum(sortino * n) / sum(n), 6) + 0.0 AS sortino, round(sum(profit_factor * n) / sum(n), 6) AS profit_factor,
 round(max(max_drawdown), 6) AS max_drawdown, CAST(sum(wins) AS BIGINT) / CAST(sum(n) AS BIGINT) AS win_rate, CAST(sum(n) AS BIGINT) AS n, round(sum(fees), 6) AS fees, round(max(lw), 6) AS largest_win, round(min(ll), 6) AS largest_loss FROM y JOIN w USING (run_id, year) GROUP BY run_id""")
def walked_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = market.trades(spark, sf_dir).withColumn("run_id", F.col("run_id") * 10_000 + F.year(F.timestamp_millis("exit_time")))
    more = trades.totals(keyed).select((F.col("run_id") % 10_000).cast("int").alias("year"), F.floor(F.col("run_id") / 10_000).alias("run_id"), "wins", "fees", "largest_win", "largest_loss")
    rows = yearly(spark, sf_dir).withColumn("total_return", F.col("total_return") / 100).drop("win_rate").join(more, ["run_id", "year"])
    return rounded(runs.walked_forward(rows))


@query(YEARLY + " SELECT run_id, count(*) AS windows, count(*) FILTER (total_return > 0) AS profitable, count(*) FILTER (sharpe > 0) AS sharpe_positive, count(*) FILTER (total_return > 0) / count(*) AS consistency, count(*) FILTER (sharpe > 0) / count(*) AS sharpe_consistency, count(*) FILTER (total_return > 0) >= 0.5 * count(*) AS passed FROM y GROUP BY run_id")
def rolling_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rolling_consistency(yearly(spark, sf_dir), 0.5)


@query(YEARLY + " SELECT run_id, count(*) AS windows, count(*) FILTER (total_return > 0 AND sharpe >= 0.5) AS windows_passed, count(*) FILTER (total_return > 0 AND sharpe >= 0.5) >= 2 AS passed FROM y GROUP BY run_id")
def cross_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cross_windows(yearly(spark, sf_dir))


@query("SELECT o_orderkey AS run_id, m AS \"offset\", CAST(CAST(CAST(o_orderdate AS DATE) + to_months(m) AS DATE) AS VARCHAR) AS start, CAST(CAST(CAST(o_orderdate AS DATE) + 31 + to_months(m) AS DATE) AS VARCHAR) AS \"end\" FROM orders, (VALUES (0), (-7), (5)) v(m)")
def shifted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_orderdate").cast("date")
    rows = market.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), a.alias("start"), F.date_add(a, 31).alias("end"))
    return runs.month_shifts(rows, [-7, 5]).select("run_id", "offset", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


@query(YEARLY + " SELECT a.run_id, round(a.sharpe, 6) + 0.0 AS train_sharpe, round(b.sharpe, 6) + 0.0 AS holdout_sharpe, round(coalesce((a.sharpe - b.sharpe) / abs(nullif(a.sharpe, 0)) * 100, 0), 4) + 0.0 AS degradation FROM y a JOIN y b ON a.run_id = b.run_id AND a.year = 1996 AND b.year = 1997")
def holdout_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly(spark, sf_dir)
    found = runs.holdout(rows.where("year = 1996"), rows.where("year = 1997"))
    return rounded(found.withColumn("degradation", rounded_in_floats(F.col("degradation"), 4)))


@query(YEARLY + """, s AS (SELECT *, year - 1995 AS shift, CAST((run_id + year) % 3 - 1 AS INTEGER) AS regime FROM y), o AS (SELECT run_id, coalesce(max(regime) FILTER (shift = 0), 0) AS own FROM s GROUP BY 1)
SELECT run_id, any_value(own) AS regime, any_value(own) = 0 OR coalesce(bool_or(shift <> 0 AND s.regime <> 0 AND s.regime <> own AND sharpe >= 1.5 AND total_return > 0), false) AS passed FROM s JOIN o USING (run_id) GROUP BY run_id""")
def regime_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly(spark, sf_dir).withColumns({"shift": F.col("year") - 1995, "regime": ((F.col("run_id") + F.col("year")) % 3 - 1).cast("int")})
    return runs.regime_gate(rows, 1.5)


_FIT = "greatest(0, least(greatest((sharpe + 1) / 5, 0), 1) * 0.35 + least(greatest(1 - max_drawdown, 0), 1) * 0.25 + least(greatest(profit_factor / 5, 0), 1) * 0.2 + least(greatest((total_return + 1) / 3, 0), 1) * 0.2 - 0.5)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = scores.fitness(F.col("sharpe"), F.col("max_drawdown"), F.col("profit_factor"), F.col("total_return"))
    return yearly(spark, sf_dir).withColumn("score", F.greatest(F.lit(0.0), fit - 0.5))


@query(YEARLY + f", q AS (SELECT *, {_FIT} AS score FROM y) SELECT year AS generation, count(*) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean, round(min(score), 6) + 0.0 AS worst, round(median(score), 6) + 0.0 AS median, round(stddev_pop(score), 6) AS deviation, count(*) FILTER (score <= 0) AS zeros FROM q GROUP BY year")
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.generation_stats(_scored(spark, sf_dir).withColumnRenamed("year", "generation")))


@query("SELECT event_type AS indicator, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1")
def indicator_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.shares(market.table(spark, sf_dir, "events").select(F.col("event_type").alias("indicator")), "indicator")


@query(TRADES + """, b AS (SELECT symbol AS search, year(l_shipdate) * 12 + month(l_shipdate) AS generation, floor(max(net_pnl) / 100) AS best FROM t GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY generation) AS i FROM b)
SELECT search, CAST(generation AS INTEGER) AS generation, CAST(best AS BIGINT) AS best, i - 1 - coalesce((SELECT max(p.i) FROM n p WHERE p.search = n.search AND p.i < n.i AND p.best < n.best), 0) AS stagnant,
 CASE WHEN i >= 6 THEN (SELECT max(p.best) FROM n p WHERE p.search = n.search AND p.i BETWEEN n.i - 2 AND n.i) <= (SELECT max(p.best) FROM n p WHERE p.search = n.search AND p.i < n.i - 2) ELSE false END AS converged FROM n""")
def search_stagnation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months stand for generations of a search, symbols for searches."""
    time = F.timestamp_millis("exit_time")
    best = market.trades(spark, sf_dir).groupBy(F.col("symbol").alias("search"), (F.year(time) * 12 + F.month(time)).alias("generation")).agg(F.floor(F.max("net_pnl") / 100).alias("best"))
    return runs.stagnation(best, 3).withColumn("stagnant", F.col("stagnant").cast("long"))


@query(YEARLY + f""", q AS (SELECT *, {_FIT} AS score, run_id % 7 AS group_id FROM y)
SELECT group_id, count(*) AS n, count(DISTINCT year) AS seeds, round(avg(sharpe), 6) + 0.0 AS mean, round(median(sharpe), 6) + 0.0 AS median, round(min(sharpe), 6) AS low, round(max(sharpe), 6) AS high, round(stddev_samp(sharpe), 6) AS deviation, count(*) FILTER (sharpe IS NULL) AS failed,
 arg_max(run_id, (score, -run_id)) AS representative FROM q GROUP BY 1""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select((F.col("run_id") % 7).alias("group_id"), F.col("year").alias("seed"), F.col("run_id").alias("strategy"), "sharpe", "score")
    return rounded(runs.seed_summary(rows))


@query(RESULTS + " SELECT count(*) AS n, round(avg(sharpe), 6) + 0.0 AS mean, round(median(sharpe), 6) + 0.0 AS median, round(stddev_pop(sharpe), 6) AS deviation, round(quantile_cont(sharpe, 0.05), 6) AS p5, round(quantile_cont(sharpe, 0.95), 6) AS p95, round(avg((sharpe >= 1)::INT), 6) AS share_1, round(avg((sharpe >= 2)::INT), 6) AS share_2, round(avg((sharpe >= 3)::INT), 6) AS share_3 FROM r")
def monte_carlo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.monte_carlo(trades.run_results(market.trades(spark, sf_dir))))


@query("""SELECT o_custkey AS run_id, o_orderkey AS sweep_id, o_totalprice AS sharpe, o_orderstatus = 'F' AS pareto FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i = 1""")
def best_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_sweep(_sweeps(spark, sf_dir))


def _sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("sweep_id"), F.col("o_totalprice").alias("sharpe"), (F.col("o_orderstatus") == "F").alias("pareto"))


@query("SELECT o_orderkey AS sweep_id, o_totalprice AS sharpe FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def sweep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sweep_rows(_sweeps(spark, sf_dir), 7, True).select("sweep_id", "sharpe")


PAIRS = """WITH s AS (SELECT l_suppkey AS run_id, avg((l_discount - 0.05)) / stddev_samp(l_discount - 0.05) * sqrt(count(*)) AS sharpe, sum(l_discount - 0.05) AS total_return, l_linestatus AS g FROM lineitem GROUP BY l_suppkey, l_linestatus),
p AS (SELECT a.run_id, (a.sharpe - b.sharpe) / abs(a.sharpe) AS x, (a.total_return - b.total_return) / abs(a.total_return) AS y FROM s a JOIN s b ON a.run_id = b.run_id AND a.g = 'F' AND b.g = 'O')"""


@query(PAIRS + " (SELECT run_id, 'sensitive' AS list FROM p WHERE x > 0.5 OR y > 0.5 ORDER BY x DESC, run_id LIMIT 20) UNION ALL (SELECT run_id, 'improved' FROM p WHERE x < 0 ORDER BY x, run_id LIMIT 20)")
def sensitive_and_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = market.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_discount") - 0.05).alias("x"), "l_linestatus")
    half = lambda g: screening.returns_by_run(own.where(F.col("l_linestatus") == g))
    pairs = screening.consistency(half("F"), half("O"))
    return runs.most_sensitive(pairs).select("run_id", F.lit("sensitive").alias("list")).unionByName(runs.improved(pairs).select("run_id", F.lit("improved").alias("list")))


@query("""WITH f AS (SELECT CAST(i AS INTEGER) AS fold, i * (n // 5) AS a, CASE WHEN i = 4 THEN n ELSE (i + 1) * (n // 5) END AS b FROM range(5) r(i), (SELECT count(*) AS n FROM orders))
SELECT fold, epoch_ms(min(o_orderdate)) AS first, epoch_ms(max(o_orderdate)) AS last, count(*) AS n FROM orders JOIN f ON o_orderkey >= a AND o_orderkey < b GROUP BY fold""")
def fold_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = market.table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("position"), market.epoch_ms(orders, "o_orderdate").alias("time"))
    return runs.fold_dates(rows, overfitting.purged_folds(spark, orders.count(), purge=0, embargo=0))


@query(YEARLY + """, w AS (SELECT a.year, avg(a.total_return) AS train_return, avg(a.sharpe) AS train_sharpe, avg(b.total_return) AS test_return, avg(b.sharpe) AS test_sharpe FROM y a JOIN y b ON a.run_id = b.run_id AND b.year = a.year + 1 GROUP BY a.year),
s AS (SELECT count(*) AS n, avg(train_return) AS train, avg(test_return) AS test, avg(test_sharpe) AS sharpe, avg((test_return > 0)::INT) AS consistency, avg(train_sharpe - test_sharpe) AS degradation FROM w), ef AS (SELECT *, CASE WHEN train < 0.001 THEN 0 ELSE least(test / train, 5) END AS efficiency FROM s)
SELECT n, round(train, 6) + 0.0 AS train, round(test, 6) + 0.0 AS test, round(sharpe, 6) + 0.0 AS sharpe, round(consistency, 6) + 0.0 AS consistency, round(degradation, 6) + 0.0 AS degradation, round(efficiency, 6) + 0.0 AS efficiency, consistency > 0.5 AND efficiency > 0.5 AS robust FROM ef""")
def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year trains for the next."""
    rows = yearly(spark, sf_dir)
    test = rows.select("run_id", (F.col("year") - 1).alias("year"), F.col("total_return").alias("test_return"), F.col("sharpe").alias("test_sharpe"))
    pairs = rows.select("run_id", "year", F.col("total_return").alias("train_return"), F.col("sharpe").alias("train_sharpe")).join(test, ["run_id", "year"])
    return rounded(overfitting.walk_forward_summary(pairs.groupBy("year").agg(*[F.avg(c).alias(c) for c in ("train_return", "train_sharpe", "test_return", "test_sharpe")])))


@query(YEARLY + ", f AS (SELECT year, avg(sharpe) AS sharpe FROM y GROUP BY year) SELECT round(avg(sharpe), 6) + 0.0 AS mean, round(stddev_samp(sharpe), 6) AS dev, avg(sharpe) > 0.5 AND stddev_samp(sharpe) < 1 AS robust FROM f")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overfitting.fold_summary(yearly(spark, sf_dir).groupBy("year").agg(F.avg("sharpe").alias("sharpe"))))


@query("""WITH w AS (SELECT CAST(s AS DATE) AS a FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1997-12-31', INTERVAL 90 DAY) g(s))
SELECT CAST(a AS VARCHAR) AS train_start, CAST(a + 270 AS VARCHAR) AS train_end, CAST(a + 270 AS VARCHAR) AS test_start, CAST(a + 360 AS VARCHAR) AS test_end FROM w WHERE a + 360 <= DATE '1997-12-31'""")
def touching_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overfitting.walk_forward_windows(spark, "1995-01-01", "1997-12-31", step=90, touching=True)
    return rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])


@query(TRADES + """ SELECT symbol, round(sum(abs(notional)) / 1e9, 6) AS exposure, round(sum(sum(abs(notional))) OVER () / 1e9, 6) AS total, round(sum(sum(abs(notional))) OVER () / 1e9 * 0.02, 6) AS heat FROM t GROUP BY symbol""")
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.exposure(market.trades(spark, sf_dir), 1e9))


@query(TRADES + " SELECT run_id, order_id, line, part_id, round(net_pnl / notional * 100, 9) + 0.0 AS roi_percent, round(fee / 2, 9) AS entry_fee, round(fee / 2, 9) AS exit_fee, round(net_pnl + fee, 9) + 0.0 AS gross_pnl, 0.0::DOUBLE AS funding, 'signal' AS exit_reason FROM t")
def trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.projected(market.trades(spark, sf_dir))
    return rounded(rows.select("run_id", "order_id", "line", "part_id", "roi_percent", "entry_fee", "exit_fee", "gross_pnl", "funding", "exit_reason"), 9)


ENTRY = """, q AS (SELECT *, exit_time - CAST(hours * 3600000 AS BIGINT) AS entry_time FROM t), qe AS (SELECT *, 100000 + sum(net_pnl) OVER (PARTITION BY run_id ORDER BY entry_time, exit_time, order_id, line, part_id ROWS UNBOUNDED PRECEDING) AS eq FROM q),
qd AS (SELECT *, greatest(100000, max(eq) OVER (PARTITION BY run_id ORDER BY entry_time, exit_time, order_id, line, part_id ROWS UNBOUNDED PRECEDING)) AS pk FROM qe)"""


@query(TRADES + ENTRY + """, x AS (SELECT run_id, count(*) AS n, sum(net_pnl) / 100000 AS total_return, greatest((arg_max(exit_time, (entry_time, exit_time, order_id, line, part_id)) - min(entry_time)) / 86400000.0, 1) AS days, avg((exit_time - entry_time) / 3600000.0) AS avg_hours,
 var_samp(CASE WHEN net_pnl <> 0 THEN net_pnl / notional END) AS v, max((pk - eq) / pk) AS max_drawdown FROM qd GROUP BY run_id), c AS (SELECT *, CASE WHEN total_return = 0 THEN 0 WHEN total_return = -1 THEN -1 WHEN total_return > -1 THEN pow(1 + total_return, 365.0 / days) - 1 ELSE 0 END AS cagr FROM x)
SELECT run_id, n, round(total_return, 6) + 0.0 AS total_return, round(days, 6) AS days, round(avg_hours, 6) AS avg_hours, round(max_drawdown, 6) AS max_drawdown, round(cagr, 6) + 0.0 AS cagr, round(sqrt(v * 365.0 / greatest(avg_hours / 24, 0.01)), 6) AS volatility_annual,
 round(CASE WHEN max_drawdown > 0 AND cagr <> 0 THEN cagr / max_drawdown ELSE 0 END, 6) + 0.0 AS calmar_ratio FROM c""")
def extended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.extended(market.trades(spark, sf_dir)))


@query(TRADES + """, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY exit_time, order_id, line, part_id) AS INTEGER) AS place FROM e)
SELECT run_id, place, exit_time AS time, round(equity, 4) AS equity FROM n UNION ALL SELECT run_id, 0, exit_time - CAST(hours * 3600000 AS BIGINT), 100000 FROM n WHERE place = 1""")
def equity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.equity_points(market.trades(spark, sf_dir)), 4)


@query(TRADES + """, g AS (SELECT *, exp(sum(ln(1 + net_pnl / notional)) OVER w) AS growth FROM t WINDOW w AS (PARTITION BY run_id ORDER BY exit_time, order_id, line, part_id ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, max(growth) OVER (PARTITION BY run_id ORDER BY exit_time, order_id, line, part_id ROWS UNBOUNDED PRECEDING) AS top FROM g)
SELECT run_id, round(arg_max(growth, (exit_time, order_id, line, part_id)) - 1, 6) + 0.0 AS compounded_return, round(max((top - growth) / top), 6) AS growth_drawdown, count(*) AS n FROM h GROUP BY run_id""")
def compounded_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.simulated(market.trades(spark, sf_dir)).select("run_id", "compounded_return", "growth_drawdown", "n"))


@query(BARS + """, m AS (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) AS m FROM k WHERE close > 0), s AS (SELECT symbol, stddev_samp(m) AS d FROM m GROUP BY symbol)
SELECT k.symbol, round(avg(volume) FILTER (volume > 0), 6) AS avg_volume, round(any_value(d), 6) AS volatility FROM k JOIN s ON s.symbol = k.symbol GROUP BY k.symbol""")
def market_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades.market_stats(market.klines(spark, sf_dir)))


@query(RESULTS + """, s AS (SELECT *, least(0.3, greatest(0, (n * 10 - 500) / 100.0 * 0.05)) AS p1, least(0.1, greatest(0, (run_id % 9 - 2) * 0.02)) AS p2, CASE WHEN (run_id % 20) / 2.0 > 5 THEN least(0.15, ((run_id % 20) / 2.0 - 5) * 0.02) ELSE 0 END AS p3 FROM r)
SELECT run_id, round(CASE WHEN n < 50 OR total_return <= 0 THEN 0 ELSE greatest(0, 0.8 - p1 - p2 - p3) END, 6) AS adjusted FROM s""")
def adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.run_results(market.trades(spark, sf_dir))
    penalties = [scores.overtrade_penalty(F.col("n") * 10, F.lit("15m")), scores.complexity_penalty(F.col("run_id") % 9), scores.stop_imbalance_penalty((F.col("run_id") % 20).cast("double"), F.lit(2.0))]
    return rounded(rows.select("run_id", scores.adjusted_score(F.lit(0.8), penalties, F.col("n"), F.col("total_return"), 50).alias("adjusted")))


@query(RESULTS + """, s AS (SELECT run_id, sharpe * 3 AS sharpe, max_drawdown * 4 - 0.2 AS dd, profit_factor - 0.95 AS pf, CASE run_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 40 END AS n, total_return FROM r)
SELECT run_id, concat_ws(',', CASE WHEN dd < 0 THEN 'drawdown below 0' END, CASE WHEN dd > 1 THEN 'drawdown above 1' END, CASE WHEN pf < 0 THEN 'profit factor below 0' END, CASE WHEN n = 0 AND sharpe <> 0 THEN 'Sharpe ratio without trades' END, CASE WHEN n = 0 AND total_return <> 0 THEN 'return without trades' END,
 CASE WHEN n = 0 AND pf <> 0 THEN 'profit factor without trades' END, CASE WHEN n > 10 AND total_return > 0.1 AND pf < 0.8 THEN 'gain with a low profit factor' END, CASE WHEN n > 10 AND total_return < -0.1 AND pf > 1.5 THEN 'loss with a high profit factor' END, CASE WHEN n < 30 AND sharpe > 5 THEN 'high Sharpe ratio of few trades' END) AS found FROM s""")
def suspicious_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades.run_results(market.trades(spark, sf_dir))
    n = F.when(F.col("run_id") % 3 == 0, 0).when(F.col("run_id") % 3 == 1, 20).otherwise(40)
    found = scores.suspicions(F.col("sharpe") * 3, F.col("max_drawdown") * 4 - 0.2, F.col("profit_factor") - 0.95, n, F.col("total_return"))
    return rows.select("run_id", F.concat_ws(",", found).alias("found"))


_PRICE = "(l_extendedprice / l_quantity)"


@query(f"""WITH i AS (SELECT *, {_PRICE} AS price, l_linestatus = 'O' AS long, {_PRICE} * 0.01 * l_linenumber AS atr FROM lineitem), s AS (SELECT *, CASE WHEN long THEN price - 2 * atr ELSE price + 2 * atr END AS stop FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN long THEN price - price * 0.02 ELSE price + price * 0.02 END, 6) AS fixed_stop, round(stop, 6) AS atr_stop, round(CASE WHEN long THEN price + abs(price - stop) * 1.5 ELSE price - abs(price - stop) * 1.5 END, 6) AS target,
 round(CASE WHEN long THEN price + price * 0.03 ELSE price - price * 0.03 END, 6) AS fixed_target, round(least(greatest((0.55 - 0.45 / 1.5) * 0.5, 0), 1) * 100000 / price, 6) AS kelly, round(greatest(least(2000 / abs(price - stop), 50000 / price), 1000 / price), 6) AS size, round(0.001 * price * abs(l_quantity), 6) AS cost FROM s""")
def stops_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = market.table(spark, sf_dir, "lineitem").withColumns({"price": F.col("l_extendedprice") / F.col("l_quantity"), "long": F.col("l_linestatus") == "O"}).withColumn("atr", F.col("price") * 0.01 * F.col("l_linenumber"))
    price, long = F.col("price"), F.col("long")
    rows = items.withColumn("stop", scores.stop_price("atr_fixed", price, long, 2, F.col("atr")))
    return rounded(rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scores.stop_price("fixed_pct", price, long, 2).alias("fixed_stop"), F.col("stop").alias("atr_stop"), scores.target_price("risk_reward", price, long, 1.5, stop=F.col("stop")).alias("target"),
        scores.target_price("fixed_pct", price, long, 3).alias("fixed_target"), scores.kelly_size(scores.kelly_fraction(F.lit(0.55), F.lit(1.5)), F.lit(100_000.0), price).alias("kelly"), scores.strategy_size(F.lit(100_000.0), price, F.col("stop")).alias("size"),
        scores.slippage_cost(F.lit(0.001), price, F.col("l_quantity")).alias("cost"),
    ))


@query(f"""WITH i AS (SELECT *, {_PRICE} AS price FROM lineitem), s AS (SELECT *, 100000 * 0.5::DOUBLE / price AS cap, price * (1 - l_discount) AS stop FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN stop = price THEN 0 ELSE floor(least(100000 * 0.02::DOUBLE / abs(price - stop), cap) * 1000) / 1000 END AS fixed, floor(least(least(greatest((0.6::DOUBLE - 0.4::DOUBLE / (1 + l_linenumber)) * 0.5, 0), 1) * 100000 / price, cap) * 1000) / 1000 AS kelly,
 CASE WHEN l_tax = 0 THEN 0 ELSE floor(least(100000 * 0.01::DOUBLE / (price * l_tax * 2), 100000 * 0.25::DOUBLE / price) * 100) / 100 END AS ranged FROM s""")
def sized_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sizers over the same prices."""
    items = market.table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    price, equity = F.col("price"), F.lit(100_000.0)
    own = {
        "fixed": sizers.FixedFraction(0.02, price * (1 - F.col("l_discount"))), "kelly": sizers.Kelly(F.lit(0.6), (1 + F.col("l_linenumber")).cast("double")),
        "ranged": sizers.TrueRange(0.01, price * F.col("l_tax"), 2.0, sizers.Limits(0.25, 3.0, 2)),
    }
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[s.size(equity, price).alias(name) for name, s in own.items()])


@query(RESULTS + " SELECT run_id, round(sharpe, 6) + 0.0 AS sharpe FROM r WHERE NOT sharpe < -9 AND NOT profit_factor < 0 AND NOT max_drawdown > 1 AND n >= 10 AND run_id % 2 = 0")
def own_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric filter with a condition of the caller's."""
    return rounded(screening.filtered(trades.run_results(market.trades(spark, sf_dir)), -9.0, 0.0, 1.0, test=lambda df: df["run_id"] % 2 == 0).select("run_id", "sharpe"))


@query(TRADES + " SELECT CAST(year(l_shipdate) - 1996 AS INTEGER) AS \"window\", count(*) AS n, round(sum(net_pnl), 4) + 0.0 AS net FROM t WHERE year(l_shipdate) BETWEEN 1996 AND 1998 GROUP BY ALL")
def trades_of_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = market.trades(spark, sf_dir)
    windows = [own.where(F.year(F.timestamp_millis("exit_time")) == year) for year in (1996, 1997, 1998)]
    return rounded(runs.trades_of_windows(windows).groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.sum("net_pnl").alias("net")), 4)


@query("""WITH l AS (SELECT user_id AS position_id, event_id AS seq, epoch_us(ts) // 1000 AS time, CASE event_type WHEN 'click' THEN 'OPEN' WHEN 'view' THEN 'CLOSE' END AS event, value AS price FROM events WHERE event_type IN ('click', 'view')),
p AS (SELECT *, lag(event) OVER w AS before, lag(time) OVER w AS t0, lag(price) OVER w AS p0 FROM l WINDOW w AS (PARTITION BY position_id ORDER BY time, seq))
SELECT position_id, t0 AS entry_time, time AS exit_time, p0 AS entry_price, price AS exit_price FROM p WHERE event = 'CLOSE' AND before = 'OPEN'""")
def paired_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings and closings of positions paired in log order, with other events between them."""
    events = market.table(spark, sf_dir, "events")
    event = F.when(F.col("event_type") == "click", "OPEN").when(F.col("event_type") == "view", "CLOSE").otherwise("FILL")
    log = events.select(F.col("user_id").alias("position_id"), F.col("event_id").alias("seq"), market.epoch_ms(events, "ts").alias("time"), event.alias("event"), F.col("value").alias("price"))
    return reconcile.paired_events(log, "time")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Even and odd orders as two sets of trades, and matches of neighbours, two of three of them."""
    orders = market.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "LONG").otherwise("SHORT").alias("direction"), F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 100).alias("pnl"))
    left, right = orders.where("id % 2 = 0"), orders.where("id % 2 = 1")
    matches = left.where("id % 3 > 0").select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id")).join(right.select(F.col("id").alias("right_id")), "right_id", "left_semi")
    return left, right, matches


MATCHED = "WITH m AS (SELECT a.o_orderkey AS left_id, b.o_orderkey AS right_id, a.o_totalprice AS ap, b.o_totalprice AS bp, a.o_orderstatus = 'O' AS al, b.o_orderstatus = 'O' AS bl FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0 AND a.o_orderkey % 3 > 0)"


@query(MATCHED + """ SELECT 'matched' AS side, left_id, right_id FROM m UNION ALL SELECT 'left_only', o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT left_id FROM m)
UNION ALL SELECT 'right_only', NULL, o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey NOT IN (SELECT right_id FROM m)""")
def reconciled_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.three_way(*_sides(spark, sf_dir)).select("side", "left_id", "right_id")


@query(MATCHED + " SELECT count(*) AS matched, round(avg((ap - bp) * CASE WHEN al THEN 1 ELSE -1 END), 4) + 0.0 AS mean_slippage, round(avg(ap / 100 - bp / 100), 4) + 0.0 AS mean_pnl_delta, count(*) FILTER (al <> bl) AS side_disagreements FROM m")
def reconciled_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconcile.differences(*_sides(spark, sf_dir)), 4)


@query(MATCHED + """, c AS (SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) - (SELECT count(*) FROM m) AS left_only, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1) - (SELECT count(*) FROM m) AS right_only)
SELECT *, round(matched / (matched + left_only + right_only), 6) AS parity FROM c""")
def reconciled_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconcile.parity(*_sides(spark, sf_dir)))


@query(BARS + """, r AS (SELECT symbol, open_time // 172800000 AS period, (arg_max(close, open_time) - arg_min(open, open_time)) / arg_min(open, open_time) AS r FROM k GROUP BY ALL)
SELECT symbol, period, CAST(CASE WHEN abs(r) < 0.05 THEN 0 ELSE sign(r) END AS INTEGER) AS regime FROM r""")
def two_day_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.regimes(market.klines(spark, sf_dir), 172_800_000)
