"""Values carried along a key's ordered rows, in two levels: within parts of a key's range side by side, and from part
to part over one row for each. A key with a third of all rows is as many tasks' work as it has parts; all is columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of a part.
SPAN = 30 * 86_400_000

Columns = dict[str, Column]


def carried(df: DataFrame, keys: list[str], order: list[str], local: Callable[[object], list[Columns]], totals: Columns, starts: Callable[[object], list[Columns]], span: int = SPAN) -> DataFrame:
    """df with the columns of local(w), w being the rows so far of a row's part, and of starts(w), w being the totals of
    the parts before it. order begins with a time in ms, whose spans are the parts; a null time comes before all. What
    local and starts give is made in steps, each of which sees the one before."""
    # Keys as one struct are equal where both are null; so is a part of no time, which is before all others.
    part = F.coalesce(F.floor(F.col(order[0]) / span), F.lit(-(2**62)))
    rows = df.withColumns({"__key": F.struct(*keys), "__part": part})
    for step in local(Window.partitionBy("__key", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)):
        rows = rows.withColumns(step)
    sums = rows.groupBy("__key", "__part").agg(*[c.alias(n) for n, c in totals.items()])
    new: list[str] = []
    for step in starts(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)):
        sums, new = sums.withColumns(step), [*new, *step]
    return rows.join(sums.select("__key", "__part", *new), ["__key", "__part"]).drop("__key", "__part")


def longest_runs(df: DataFrame, key: str, order: list[str], sign: Column, span: int = SPAN) -> DataFrame:
    """Per key the longest runs of signs 1 and -1 in a row: max_wins and max_losses. A part of a key's range gives its
    longest runs, its first and its last one; a fold over the parts joins those that meet."""
    part = F.coalesce(F.floor(F.col(order[0]) / span), F.lit(-(2**62)))
    rows = df.select(F.col(key), part.alias("__part"), sign.alias("__sign"), *[c for c in order if c != key])
    # One sort for all: where a run begins, how long it is so far, and where the second one begins.
    by = Window.partitionBy(key, "__part").orderBy(*order)
    rows = rows.withColumns({"__at": F.row_number().over(by).cast("long"), "__new": (F.row_number().over(by) == 1) | ~F.lag("__sign").over(by).eqNullSafe(F.col("__sign"))})
    rows = rows.withColumn("__n", F.col("__at") + 1 - F.max(F.when(F.col("__new"), F.col("__at"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = lambda n: F.struct(F.col("__sign").alias("sign"), n.alias("n"))
    most = lambda s: F.coalesce(F.max(F.when(F.col("__sign") == s, F.col("__n"))), F.lit(0).cast("long"))
    parts = rows.groupBy(key, "__part").agg(
        F.min_by("__sign", "__at").alias("first"), F.coalesce(F.min(F.when(F.col("__new") & (F.col("__at") > 1), F.col("__at"))) - 1, F.count(F.lit(1))).alias("n"),
        F.max_by(run(F.col("__n")), "__at").alias("tail"), (F.count_if("__new") == 1).alias("whole"), most(1).alias("wins"), most(-1).alias("losses"),
    ).withColumn("head", F.struct(F.col("first").alias("sign"), "n"))
    each = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__part", "head", "tail", "whole", "wins", "losses"))).alias("parts"))

    def follow(state: Column, x: Column) -> Column:
        met = x["head"]["n"] + F.when(x["head"]["sign"].eqNullSafe(state["sign"]), state["n"]).otherwise(0)
        longest = lambda name, s: F.greatest(state[name], x[name], F.when(x["head"]["sign"] == s, met).otherwise(0))
        return F.struct(
            x["tail"]["sign"].alias("sign"), F.when(x["whole"], met).otherwise(x["tail"]["n"]).alias("n"), longest("wins", 1).alias("wins"), longest("losses", -1).alias("losses")
        )

    none = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("int").alias("sign"), none.alias("n"), none.alias("wins"), none.alias("losses"))
    folded = each.select(key, F.aggregate("parts", start, follow).alias("s"))
    return folded.select(key, F.col("s.wins").alias("max_wins"), F.col("s.losses").alias("max_losses"))


#: Rows of one key that a task takes in turn.
LONGEST = 1_000_000


def in_turn(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by key, and those of a key in the order in which they are read. Sums of floats over them then do
    not depend on where files are split, and keys with equal rows have equal sums. A key with more than LONGEST rows, of
    which a thousand at most are told apart, stays in as many parts as tasks read it, and its sums are those of the parts."""
    placed, n, long = rows.withColumn("__at", F.monotonically_increasing_id()), rows.count(), []
    if n > LONGEST:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        long = [r[0] for r in counts.where(F.col("__n") > max(LONGEST, n // 1000)).select(key).collect()]
    # In whole parts of the input: the upper bits are the number of the task that reads a row.
    part = [F.when(F.col(key).isin(long), F.shiftright("__at", 33)).otherwise(-1)] if long else []
    return placed.repartition(key, *part).sortWithinPartitions(key, "__at").drop("__at")


def deviation(x: Column) -> Column:
    """The sample's standard deviation, to the last digit as SQL has it for rows in one order: from the products of a value's
    differences from the mean before and after it, which is how covar_samp goes on and stddev_samp does not."""
    return F.sqrt(F.covar_samp(x, x))
