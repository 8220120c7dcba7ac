"""Two sets of trades matched one to one by nearest entry time, and what their differences say."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_MS = 120_000


def paired_events(log: DataFrame, time: str = "ts") -> DataFrame:
    """Open and close events of a position put together in log order: a later open replaces an earlier
    one, a close takes the open and further closes find none. Other events may stand between."""
    w = Window.partitionBy("position_id").orderBy(time, "seq")
    rows = log.where(F.col("event").isin("OPEN", "CLOSE") & F.col(time).isNotNull() & F.col("price").isNotNull()).withColumn("__before", F.lag("event").over(w)).withColumn("__open", F.lag(F.struct(time, "price")).over(w))
    return rows.where("event = 'CLOSE' AND __before = 'OPEN'").select("position_id", F.col(f"__open.{time}").alias("entry_time"), F.col(time).alias("exit_time"), F.col("__open.price").alias("entry_price"), F.col("price").alias("exit_price"))


def match(left: DataFrame, right: DataFrame, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """Each left trade in order of entry takes the nearest free right one of its symbol within the
    tolerance (equal distances: the earlier): left_id, right_id, distance. Both hold id, symbol, time.

    Trades more than a tolerance apart can't be matched, nor influence each other, so every symbol falls
    into clusters at such gaps, and clusters are matched side by side. A cluster streams through its task:
    held are the left trades that wait for later right ones, and the free right ones, within a tolerance."""
    both = left.select("id", "symbol", "time", F.lit(0).alias("side")).unionByName(right.select("id", "symbol", "time", F.lit(1).alias("side")))
    w = Window.partitionBy("symbol").orderBy("time", "side", "id")
    first = (F.col("time") - F.lag("time").over(w) > tolerance).cast("int")
    rows = both.withColumn("__new", F.coalesce(first, F.lit(1))).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sorted_ = rows.drop("__new").repartition("symbol", "cluster").sortWithinPartitions("symbol", "cluster", "time", "side", "id")

    def run(batches: Iterator) -> Iterator:
        from bisect import bisect_left
        from collections import deque

        import pandas as pd

        waiting: deque[tuple] = deque()
        free: list[tuple] = []  # (time, id) in order
        at = None

        def settle(until: float) -> None:
            """Match the waiting left trades that no right trade from `until` on can reach."""
            while waiting and waiting[0][0] + tolerance < until:
                time, id_ = waiting.popleft()
                del free[: bisect_left(free, (time - tolerance,))]
                k = bisect_left(free, (time,))
                near = [k] if k < len(free) else []
                if k:
                    near.append(bisect_left(free, (free[k - 1][0],)))
                best = min(near, key=lambda i: (abs(free[i][0] - time), *free[i]), default=None)
                if best is not None and abs(free[best][0] - time) <= tolerance:
                    out.append((id_, free[best][1], abs(free[best][0] - time)))
                    free.pop(best)

        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                if (row.symbol, row.cluster) != at:
                    settle(float("inf"))
                    free.clear()
                    at = (row.symbol, row.cluster)
                settle(row.time)
                if row.side == 0:
                    waiting.append((row.time, row.id))
                else:
                    if not waiting:
                        del free[: bisect_left(free, (row.time - tolerance,))]
                    free.append((row.time, row.id))
            yield pd.DataFrame(out, columns=["left_id", "right_id", "distance"])
        out = []
        settle(float("inf"))
        yield pd.DataFrame(out, columns=["left_id", "right_id", "distance"])

    return sorted_.mapInPandas(run, "left_id long, right_id long, distance long")


def three_way(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """Every trade once: side (matched, left_only, right_only), left_id and right_id."""
    both = matches.select(F.lit("matched").alias("side"), "left_id", "right_id")
    one = left.join(matches, left["id"] == matches["left_id"], "left_anti").select(F.lit("left_only").alias("side"), F.col("id").alias("left_id"), F.lit(None).cast("long").alias("right_id"))
    other = right.join(matches, right["id"] == matches["right_id"], "left_anti").select(F.lit("right_only").alias("side"), F.lit(None).cast("long").alias("left_id"), F.col("id").alias("right_id"))
    return both.unionByName(one).unionByName(other)


def differences(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """One row over the matches: mean slippage of entry prices (against the trade's direction), mean
    difference of profits, and how many disagree about the direction. Trades hold id, direction, price, pnl."""
    own, other = (df.select(F.col("id").alias(f"{k}_id"), *[F.col(c).alias(f"{k}_{c}") for c in ("direction", "price", "pnl")]) for df, k in ((left, "left"), (right, "right")))
    rows = matches.join(own, "left_id").join(other, "right_id")
    worse = (F.col("left_price") - F.col("right_price")) * F.when(F.col("left_direction") == "SHORT", -1).otherwise(1)
    return rows.agg(
        F.count(F.lit(1)).alias("matched"), F.coalesce(F.avg(worse), F.lit(0.0)).alias("mean_slippage"), F.coalesce(F.avg(F.col("left_pnl") - F.col("right_pnl")), F.lit(0.0)).alias("mean_pnl_delta"),
        F.count_if(F.col("left_direction") != F.col("right_direction")).alias("side_disagreements"),
    )


def parity(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """matched, left_only, right_only and parity = matched / all three (1 for nothing at all)."""
    sides = left.join(matches, left["id"] == matches["left_id"], "left").agg(F.count("left_id").alias("matched"), F.count_if(F.col("left_id").isNull()).alias("left_only"))
    other = right.join(matches.select("right_id"), right["id"] == F.col("right_id"), "left_anti").agg(F.count(F.lit(1)).alias("right_only"))
    total = F.col("matched") + F.col("left_only") + F.col("right_only")
    # Both tables are aggregates of one row.
    row = sides.withColumn("k", F.lit(0)).join(other.withColumn("k", F.lit(0)), "k").drop("k")
    return row.withColumn("parity", F.when(total == 0, 1.0).otherwise(F.col("matched") / total))
