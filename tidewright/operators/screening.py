"""Sweeps: parameter grids, filters, ranking and the Pareto front; pairs of runs compared."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.prefixes import deviation, in_turn
from tidewright.operators.scans import numbered

def grid(spark: SparkSession, sweep: dict[str, list[float]]) -> DataFrame:
    """A row per combination, and one without columns' values for an empty sweep. Made by exploding
    one list after another: a grid is as large as the caller's lists say."""
    rows = spark.range(1).withColumnRenamed("id", "grid")
    for name, values in sweep.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return rows


def filtered(results: DataFrame, sharpe: float = 0.0, factor: float = 1.0, drawdown: float = 0.3, trades: int = 10, test: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Results that no limit excludes; a NaN is below no limit and passes. A caller's own test gives one more
    condition."""
    if test is not None:
        results = results.where(test(results))
    below = lambda c, v: ~F.isnan(c) & (F.col(c) < v)
    above = ~F.isnan("max_drawdown") & (F.col("max_drawdown") > drawdown)
    return results.where(~below("sharpe", sharpe) & ~below("profit_factor", factor) & ~above & (F.col("n") >= trades))


def ranked(results: DataFrame, key: str = "run_id") -> DataFrame:
    """A rank by Sharpe ratio, ties in order of the key: numbered within ranges of a sort, which is written, so
    that no task has all rows and results are computed once."""
    ordered = results.select(key, "sharpe").withColumn("__k", F.lit(0))
    return numbered(ordered, ["__k"], [F.desc("sharpe"), F.col(key)]).select(key, "sharpe", (F.col("__row") + 1).alias("rank"))


def pareto_front(results: DataFrame, objectives: list[str], key: str = "run_id") -> DataFrame:
    """Keys of the rows that no other row equals or beats in all objectives and beats in one (all are
    maximised). Each task drops what its own rows dominate; what is left, which grows far more slowly
    than the input, is merged in a tree of ever fewer tasks. No pair of rows is ever made."""
    rows = results.select(key, *[F.col(c).cast("double").alias(f"o{i}") for i, c in enumerate(objectives)])
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def local(batches: Iterator) -> Iterator:
        import pandas as pd

        front = None
        for batch in batches:
            front = _undominated(batch if front is None else pd.concat([front, batch]))
        if front is not None:
            yield front

    left, tasks = rows.mapInPandas(local, kinds), int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 1:
        tasks = -(-tasks // 16)
        left = left.repartition(tasks).mapInPandas(local, kinds)
    return left.select(key)


class Staircase:
    """Of points that come by falling first objective, those of the others that no other equals or beats. Of two others
    they are steps: kept by rising first of the two, the second falls, so one search finds a dominator. Of
    more than two all points are compared."""

    def __init__(self) -> None:
        self.xs: list[float] = []
        self.ys: list[float] = []
        self.points: list[list[float]] = []

    def dominates(self, rest: list[float]) -> bool:
        """Whether a point is as large in all objectives."""
        if len(rest) > 2:
            return any(all(p >= v for p, v in zip(point, rest, strict=True)) for point in self.points)
        x, y = (*rest, 0.0, 0.0)[:2]
        at = bisect.bisect_left(self.xs, x)
        return at < len(self.xs) and self.ys[at] >= y

    def add(self, rest: list[float]) -> None:
        """A point that none here dominates; those that it equals or beats go."""
        if len(rest) > 2:
            self.points = [p for p in self.points if any(v > w for v, w in zip(p, rest, strict=True))] + [rest]
            return
        x, y = (*rest, 0.0, 0.0)[:2]
        end = bisect.bisect_right(self.xs, x)
        start = end
        while start and self.ys[start - 1] <= y:
            start -= 1
        self.xs[start:end], self.ys[start:end] = [x], [y]


def _undominated(rows):  # noqa: ANN001, ANN202
    import numpy as np

    x = rows.iloc[:, 1:].to_numpy()
    whole = ~np.isnan(x).any(1)  # NaN compares with nothing
    order = np.flatnonzero(whole)[np.lexsort(-x[whole].T[::-1])]
    front, kept, last, held = Staircase(), np.flatnonzero(~whole).tolist(), None, False
    for i, point in zip(order.tolist(), x[order].tolist(), strict=True):
        if point != last:
            last, held = point, not front.dominates(point[1:])
            if held:
                front.add(point[1:])
        if held:
            kept.append(i)
    return rows.iloc[sorted(kept)]


def returns_by_run(rows: DataFrame) -> DataFrame:
    """Sharpe ratio and sum of each run's returns x, summed in the order in which they are read."""
    return in_turn(rows.select("run_id", "x"), "run_id").groupBy("run_id").agg((F.avg("x") / deviation(F.col("x")) * F.sqrt(F.count("x"))).alias("sharpe"), F.sum("x").alias("total_return"))


def degradation(screened: Column, validated: Column) -> Column:
    """(screened - validated) / |screened|; for zero the sign of what was lost."""
    return F.when(screened == 0, -F.signum(validated)).otherwise((screened - validated) / F.abs(F.when(screened != 0, screened)))


def consistency(screening: DataFrame, validation: DataFrame, key: str = "run_id", limit: float = 0.5) -> DataFrame:
    """Pairs of a run's results, how much of Sharpe ratio and return was lost, and whether too much."""
    left, right = (d.select(key, F.col("sharpe").alias(f"{s}_sharpe"), F.col("total_return").alias(f"{s}_return")) for d, s in ((screening, "s"), (validation, "v")))
    rows = left.join(right, key).withColumn("sharpe_loss", degradation(F.col("s_sharpe"), F.col("v_sharpe"))).withColumn("return_loss", degradation(F.col("s_return"), F.col("v_return")))
    return rows.withColumn("sensitive", (F.col("sharpe_loss") > limit) | (F.col("return_loss") > limit))


def best_per_key(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__n = 1").drop("__n")
