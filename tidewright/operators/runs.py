"""Results of runs: joins with their runs and strategies, flags of the overfitting filters and their chain,
guardrails, and what several windows, folds, seeds or generations say together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import scores
from tidewright.operators.folds import Step, array_fold
from tidewright.operators.scans import written
from tidewright.operators.selection import percentiles

#: Flags of the filters for overfitting: true, false, or null where a filter was not asked for.
FLAGS = ("passed_dsr", "passed_wfa", "passed_cv")


def with_runs(results: DataFrame, runs: DataFrame, strategies: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Results with their runs by run_id and, where given, these with their strategies by strategy_id."""
    rows = results.join(runs, "run_id", how)
    return rows if strategies is None else rows.join(strategies, "strategy_id", how)


def newest_results(results: DataFrame, runs: DataFrame, strategy_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Results of all runs or of one strategy's, the newest first."""
    own = runs if strategy_id is None else runs.where(F.col("strategy_id") == strategy_id)
    rows = results.join(own, "run_id").orderBy(F.desc("run_id"))
    return rows if limit is None else rows.limit(limit)


def filtered_runs(runs: DataFrame, strategy_id: int | None = None, status: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Runs of a strategy, a status and days of creation (text; both inclusive)."""
    day = F.substring(F.col("created_at").cast("string"), 1, 10)
    tests = [F.col("strategy_id") == strategy_id if strategy_id is not None else None, F.col("status") == status if status else None, day >= since if since else None, day <= until if until else None]
    return reduce(lambda df, test: df.where(test), [t for t in tests if t is not None], runs)


def filtered_trades(trades: DataFrame, symbol: str | None = None, direction: str | None = None) -> DataFrame:
    rows = trades if symbol is None else trades.where(F.col("symbol") == symbol)
    return rows if direction is None else rows.where(F.col("direction") == direction)


def campaign_matrix(runs: DataFrame, results: DataFrame, campaign: str, champions: str = "champion", windows: list[str] | None = None, value: str = "sharpe") -> DataFrame:
    """A row per champion and a column per window of a campaign, which the runs' JSON `config` names; runs
    without a result leave null."""
    own = runs.where(F.get_json_object("config", "$.campaign_id") == campaign)
    rows = own.join(results, "run_id", "left").groupBy(champions)
    return (rows.pivot("window", windows) if windows else rows.pivot("window")).agg(F.avg(value))


def latest_with_trades(runs: DataFrame, results: DataFrame, newest: int = 10) -> DataFrame:
    """Of the newest finished runs with notes the latest some of whose strategies traded, else the latest
    with strategies at all: run_id and strategies. notes is JSON; what does not parse is passed over."""
    shape = "top_strategies array<struct<name string, trades bigint, score double>>"
    rows = results.where(F.col("notes").isNotNull() & (F.col("notes") != "")).join(runs.where("status = 'completed'").select("run_id"), "run_id").orderBy(F.desc("run_id")).limit(newest)
    own = rows.select("run_id", F.from_json("notes", shape)["top_strategies"].alias("strategies")).where(F.col("strategies").isNotNull())
    traded = F.exists("strategies", lambda s: F.coalesce(s["trades"], F.lit(0)) > 0)
    return own.orderBy(F.desc(traded), F.desc("run_id")).limit(1)


def promoted(results: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Results of runs that have no sweep rows yet, with the flags of the filters unset: rows to append."""
    rows = results.join(sweeps.select("run_id").distinct(), "run_id", "left_anti")
    return rows.withColumns({flag: F.lit(None).cast("boolean") for flag in FLAGS})


def noted_fields(results: DataFrame) -> DataFrame:
    """results with the fields that their JSON `notes` hold of the first strategy: cross_window (offset,
    sharpe, return_pct, max_dd, trades, passed), wfa_consistency, and the bounds and level of the
    bootstrap. Missing or broken notes leave nulls."""
    window = "struct<sharpe double, return_pct double, max_dd double, trades bigint>"
    interval = "struct<lower double, upper double, level double>"
    shape = f"top_strategies array<struct<cross_window struct<windows array<{window}>>, wfa struct<sharpe_consistency double>, bootstrap_ci {interval}>>, cross_window_months array<int>, cross_window_min_sharpe double, bootstrap_ci {interval}"
    rows = results.withColumn("__n", F.from_json("notes", shape)).withColumn("__best", F.try_element_at("__n.top_strategies", F.lit(1)))
    least = F.coalesce("__n.cross_window_min_sharpe", F.lit(0.5))
    mapped = F.transform(
        F.col("__best.cross_window.windows"),
        lambda w, i: F.struct(F.get("__n.cross_window_months", i).alias("offset"), w["sharpe"].alias("sharpe"), w["return_pct"].alias("return_pct"), w["max_dd"].alias("max_dd"), w["trades"].alias("trades"), F.coalesce(w["sharpe"] >= least, F.lit(False)).alias("passed")),
    )
    boot = F.coalesce(F.col("__n.bootstrap_ci"), F.col("__best.bootstrap_ci"))
    new = {"cross_window": mapped, "wfa_consistency": F.col("__best.wfa.sharpe_consistency"), "bootstrap_lower": boot["lower"], "bootstrap_upper": boot["upper"], "bootstrap_level": boot["level"]}
    return rows.withColumns(new).drop("__n", "__best")


def survivors(candidates: DataFrame, require_all: bool = True) -> DataFrame:
    """Candidates that pass: all flags true or unset, or else any flag true. The best Sharpe ratio first."""
    passes = [F.coalesce(F.col(f), F.lit(require_all)) for f in FLAGS]
    test = reduce((lambda a, b: a & b) if require_all else (lambda a, b: a | b), passes)
    return candidates.where(test).orderBy(F.desc_nulls_last("sharpe"), "run_id")


def filter_chain(candidates: DataFrame, dsr: DataFrame | None = None, wfa: DataFrame | None = None, cv: DataFrame | None = None) -> DataFrame:
    """candidates with three flags and passed_all. Each filter is a table of run_id and passed; one that is
    not given leaves its flag unset, and a run that it does not hold has failed it."""
    rows = candidates
    for flag, found in zip(FLAGS, (dsr, wfa, cv), strict=True):
        if found is None:
            rows = rows.withColumn(flag, F.lit(None).cast("boolean"))
        else:
            rows = rows.join(found.select("run_id", F.col("passed").alias(flag)), "run_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return rows.withColumn("passed_all", reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(True)) for f in FLAGS]))


def chain_counts(chain: DataFrame) -> DataFrame:
    """One row: candidates, and how many passed each filter and all."""
    return chain.agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in (*FLAGS, "passed_all")])


def deflated_filter(results: DataFrame, kept: DataFrame, n_obs: int | None = None, significance: float = 0.05) -> DataFrame:
    """The rows of kept (run_id, sharpe, n, skewness, kurtosis) whose Sharpe ratio passes the deflated test.
    The trials are all results, whose number and variance are one aggregate; observations are n_obs, or
    the trades and 30 at least. A single row in kept is not tested."""
    row = results.agg(F.count(F.lit(1)).alias("trials"), F.var_samp("sharpe").alias("variance")).first()  # two numbers
    if kept.limit(2).count() <= 1:
        return kept
    seen = F.lit(n_obs) if n_obs else F.greatest("n", F.lit(30))
    z = scores.deflated_sharpe_z(F.col("sharpe"), row["trials"], seen, F.col("skewness"), F.col("kurtosis"), None if row["variance"] is None else F.lit(row["variance"]))
    return kept.withColumn("z", z).where(scores.deflated_passes(F.col("z"), significance))


def guardrails(rows: DataFrame, min_trades: int = 50, min_return: float = 0.0, max_genes: int = 8, checks: dict[str, Column] | None = None) -> DataFrame:
    """rows (n, total_return, genes) with passed and reasons, an array. Checks that are null were not asked
    for; the others, in order, have to hold."""
    own = {"trades": F.col("n") >= min_trades, "return": F.col("total_return") >= min_return, "complexity": F.col("genes") <= max_genes} | (checks or {})
    failed = [F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in own.items()]
    return rows.withColumn("reasons", F.array_compact(F.array(*failed))).withColumn("passed", F.size("reasons") == 0)


def guarded(rows: DataFrame, hard: list[str]) -> DataFrame:
    """The rows that passed the guardrails. Where none did: none if any failed a hard check, else all."""
    hits = rows.agg(F.count_if("passed").alias("passed"), F.count_if(F.arrays_overlap("reasons", F.array(*[F.lit(h) for h in hard]))).alias("hard")).first()  # two numbers
    if hits["passed"] or hits["hard"]:
        return rows.where("passed")
    return rows


def over_windows(results: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per candidate from its windows' results: a candidate with a window without trades fails
    (sharpe -1, drawdown 1, nothing else); of the others trades are summed, Sharpe ratio, return and
    skewness averaged, drawdown and kurtosis the largest, the profit factor weighted by trades."""
    rows = results.groupBy(key).agg(
        F.min("n").alias("least"), F.sum("n").alias("n"), F.avg("sharpe").alias("sharpe"), F.max("max_drawdown").alias("max_drawdown"),
        F.try_divide(F.sum(F.col("profit_factor") * F.col("n")), F.sum("n")).alias("profit_factor"), F.avg("total_return").alias("total_return"),
        F.avg("skewness").alias("skewness"), F.max("kurtosis").alias("kurtosis"),
    )
    failed = {"n": 0, "sharpe": -1.0, "max_drawdown": 1.0, "profit_factor": 0.0, "total_return": 0.0, "skewness": 0.0, "kurtosis": 3.0}
    return rows.select(key, *[F.when(F.col("least") == 0, v).otherwise(F.col(c)).alias(c) for c, v in failed.items()])


def walked_forward(results: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run from its windows: the return compounded, ratios weighted by trades, counts and
    costs summed, extremes taken."""
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n")), F.lit(0.0)).alias(c)
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("windows"), (F.product(F.col("total_return") + 1) - 1).alias("total_return"), weighted("sharpe"), weighted("sortino"), weighted("profit_factor"),
        F.max("max_drawdown").alias("max_drawdown"), F.coalesce(F.try_divide(F.sum("wins"), F.sum("n")), F.lit(0.0)).alias("win_rate"), F.sum("n").alias("n"), F.sum("fees").alias("fees"),
        F.max("largest_win").alias("largest_win"), F.min("largest_loss").alias("largest_loss"),
    )


def trades_of_windows(windows: list[DataFrame]) -> DataFrame:
    """The trades of all windows, each with its window's number; columns are matched by name."""
    numbered = [df.withColumn("window", F.lit(i)) for i, df in enumerate(windows)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def rolling_consistency(windows: DataFrame, least: float = 0.75, key: str = "run_id") -> DataFrame:
    """Per candidate the share of windows with a gain, and with a positive Sharpe ratio, and whether the
    first is enough. Unknown returns and ratios count as none."""
    known = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) > 0
    rows = windows.groupBy(key).agg(F.count(F.lit(1)).alias("windows"), F.count_if(known("total_return")).alias("profitable"), F.count_if(known("sharpe")).alias("sharpe_positive"))
    return rows.select("*", (F.col("profitable") / F.col("windows")).alias("consistency"), (F.col("sharpe_positive") / F.col("windows")).alias("sharpe_consistency"), (F.col("profitable") >= F.col("windows") * least).alias("passed"))


def cross_windows(windows: DataFrame, min_sharpe: float = 0.5, least: int = 2, key: str = "run_id") -> DataFrame:
    """Per candidate how many of its windows gain with a Sharpe ratio of min_sharpe, and whether at least
    so many do."""
    ok = F.coalesce((F.col("total_return") > 0) & (F.col("sharpe") >= min_sharpe), F.lit(False))
    return windows.groupBy(key).agg(F.count(F.lit(1)).alias("windows"), F.count_if(ok).alias("windows_passed")).withColumn("passed", F.col("windows_passed") >= least)


def month_shifts(windows: DataFrame, offsets: list[int]) -> DataFrame:
    """Each window (start, end) itself and shifted by each number of months: offset, start, end."""
    every = windows.withColumn("offset", F.explode(F.array(F.lit(0), *[F.lit(m) for m in offsets])))
    return every.withColumns({"start": F.add_months("start", F.col("offset")), "end": F.add_months("end", F.col("offset"))})


def holdout(train: DataFrame, held: DataFrame, key: str = "run_id") -> DataFrame:
    """Per candidate its Sharpe ratios in training and on held-out data, and the loss in per cent."""
    rows = train.select(key, F.col("sharpe").alias("train_sharpe")).join(held.select(key, F.col("sharpe").alias("holdout_sharpe")), key)
    loss = F.when(F.col("train_sharpe") != 0, (F.col("train_sharpe") - F.col("holdout_sharpe")) / F.abs(F.when(F.col("train_sharpe") != 0, F.col("train_sharpe"))) * 100)
    return rows.withColumn("degradation", F.coalesce(loss, F.lit(0.0)))


def regime_gate(windows: DataFrame, min_sharpe: float = 0.5, key: str = "run_id") -> DataFrame:
    """Whether a candidate held in the opposite market. windows: per candidate its own window (shift 0) and
    shifted ones with regime (-1, 0, 1), sharpe and total_return. A neutral own window passes; else a
    shifted window of the other sign has to gain with a Sharpe ratio of min_sharpe."""
    own = F.max(F.when(F.col("shift") == 0, F.col("regime"))).over(Window.partitionBy(key))
    rows = windows.withColumn("__own", F.coalesce(own, F.lit(0)))
    held = (F.col("shift") != 0) & (F.col("regime") != 0) & (F.col("regime") != F.col("__own")) & (F.col("sharpe") >= min_sharpe) & (F.col("total_return") > 0)
    return rows.groupBy(key).agg(F.max("__own").alias("regime"), F.max(F.coalesce(held, F.lit(False))).alias("__held")).select(key, "regime", ((F.col("regime") == 0) | F.col("__held")).alias("passed"))


def generation_stats(scored: DataFrame, by: str = "generation") -> DataFrame:
    """Per generation of scores: best, mean, worst, median, population deviation, and how many are 0."""
    scored = written(scored.select(by, "score"), "scored")
    rows = scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.avg("score").alias("mean"), F.min("score").alias("worst"),
        F.stddev_pop("score").alias("deviation"), F.count_if(F.col("score") <= 0).alias("zeros"),
    )
    return rows.join(percentiles(scored, [by], "score", {"median": 0.5}), by)


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Each value's count and share of all rows."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))  # one row
    return counts.withColumn("__k", F.lit(0)).join(total.withColumn("__k", F.lit(0)), "__k").select(column, "n", (F.col("n") / F.col("__total")).alias("share"))


def stagnation(generations: DataFrame, patience: int, by: str = "generation", key: str = "search") -> DataFrame:
    """Per generation of a search: for how many generations right before it nothing was worse, and whether
    the best of the last `patience` is no better than all before (of twice as many at least). A search's
    generations stream by; what is held are those that a later one may yet find to be the last that was worse."""
    w = Window.partitionBy(key).orderBy(by)
    recent, before = F.max("best").over(w.rowsBetween(-(patience - 1), 0)), F.max("best").over(w.rowsBetween(Window.unboundedPreceding, -patience))
    rows = generations.withColumn("converged", F.when(F.row_number().over(w) >= 2 * patience, recent <= before).otherwise(False))

    def start() -> Step:
        stack: list[tuple[float, int]] = []  # bests that rise, with their places
        seen = 0

        def step(x: dict) -> dict:
            import numpy as np

            nonlocal seen
            out = np.zeros(len(x["__best"]), np.int64)
            for i, best in enumerate(x["__best"].tolist()):
                while stack and not stack[-1][0] < best:
                    stack.pop()
                out[i] = seen - (stack[-1][1] if stack else 0)
                seen += 1
                stack.append((best, seen))
            return {"stagnant": out}

        return step

    return array_fold(rows.withColumn("__best", F.col("best").cast("double")), [key], [by], start, ["__best"], "stagnant int").drop("__best")


def seed_summary(found: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups of alike strategies over all seeds, ranked by median Sharpe ratio: its spread, the number of
    seeds, how many of its runs failed (no Sharpe ratio), and the strategy with the highest score. What was found is
    computed once and written."""
    found = written(found.select(group, "seed", "strategy", "sharpe", "score"), "found")
    rows = found.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seed").alias("seeds"), F.avg("sharpe").alias("mean"), F.min("sharpe").alias("low"), F.max("sharpe").alias("high"), F.count_if(F.col("sharpe").isNull()).alias("failed"),
        F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("deviation"), F.max_by("strategy", F.struct("score", -F.col("strategy"))).alias("representative"),
    )
    return rows.join(percentiles(found, [group], "sharpe", {"median": 0.5}), group).orderBy(F.desc("median"), group)


def monte_carlo(samples: DataFrame, value: str = "sharpe") -> DataFrame:
    """One row: mean, median, population deviation, 5th and 95th percentile, and the shares of 1, 2, 3 or more."""
    samples = written(samples.select(value), "samples")
    more = [F.avg((F.col(value) >= k).cast("double")).alias(f"share_{k}") for k in (1, 2, 3)]
    ranks = percentiles(samples, [], value, {"median": 0.5, "p5": 0.05, "p95": 0.95})
    row = samples.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), *more)
    return row.withColumn("__k", F.lit(0)).join(ranks.withColumn("__k", F.lit(0)), "__k").drop("__k")  # a row each


def best_sweep(sweeps: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run the sweep row to show: of the Pareto front if any, then the highest Sharpe ratio."""
    return sweeps.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pareto"), F.desc_nulls_last("sharpe"), "sweep_id"))).where("__n = 1").drop("__n")


def sweep_rows(sweeps: DataFrame, run_id: int, pareto_only: bool = False) -> DataFrame:
    rows = sweeps.where(F.col("run_id") == run_id)
    return (rows.where("pareto") if pareto_only else rows).orderBy(F.desc_nulls_last("sharpe"), "sweep_id")


def most_sensitive(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """Pairs of results that lost too much, those that lost most of their Sharpe ratio first."""
    return pairs.where("sensitive").orderBy(F.desc("sharpe_loss"), "run_id").limit(limit)


def improved(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """Pairs whose validation was better, the largest gain first."""
    return pairs.where("sharpe_loss < 0").orderBy("sharpe_loss", "run_id").limit(limit)


def fold_dates(rows: DataFrame, folds: DataFrame, time: str = "time") -> DataFrame:
    """First and last time of each fold's test rows. rows have `position`, their number in order of time.
    Folds, as few as the caller says, are found by their bounds in an array."""
    bounds = folds.select("fold", "test_from", "test_to").orderBy("fold").collect()  # a row per fold
    own = F.filter(F.array(*[F.struct(F.lit(b["fold"]).alias("fold"), F.lit(b["test_from"]).alias("a"), F.lit(b["test_to"]).alias("b")) for b in bounds]), lambda x: (F.col("position") >= x["a"]) & (F.col("position") < x["b"]))
    return rows.withColumn("fold", F.get(own, F.lit(0))["fold"]).where(F.col("fold").isNotNull()).groupBy("fold").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
