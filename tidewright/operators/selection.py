"""Exact order statistics of groups of any size, by rounds of histograms.

Groups of at most BUFFER values are sorted in one buffer. For larger ones each wanted rank starts with the range of
all values; a round counts that range's values in BUCKETS parts and goes on with the part that holds the rank, between the
least and the greatest value found there, until it holds no more than BUFFER values, or equal ones alone.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.scans import written

#: Values sorted in one buffer, and parts of a range.
BUFFER, BUCKETS = 100_000, 1024
LARGEST = 1.7976931348623157e308


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], buffer: int = BUFFER) -> DataFrame:
    """by and, under each name, the percentile 0..1 of value, interpolated between neighbours. Nulls and NaN take no part; a
    group without others has nulls. Infinite values count as the largest doubles. All groups and ranks go through a round together."""
    held = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col(value).cast("double")))
    # Written, as each round reads the values and they may be long to compute.
    rows = written(df.select(*by, F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), held).alias("__v")), "values")
    counts = written(rows.groupBy(*by).agg(F.count("__v").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")), "counts")
    large = counts.where(F.col("__n") > buffer)
    direct = [F.percentile("__v", p).alias(name) for name, p in wanted.items()]
    if not large.limit(1).count():
        return rows.groupBy(*by).agg(*direct)
    key = lambda d: d.withColumn("__g", F.lit(0)) if not by else d
    keys = by or ["__g"]
    rows, counts, large = key(rows), key(counts), key(large)
    small = rows.join(large.select(*keys), keys, "left_anti").groupBy(*keys).agg(*direct)
    place = lambda p: (F.col("__n") - 1) * F.lit(p)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in wanted.values()])))
    state = large.select(*keys, F.explode(ranks).alias("__rank"), F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__m"), "__low", "__high")
    done: list[DataFrame] = []
    while True:
        state = written(state, "ranks")
        done.append(state.where((F.col("__low") == F.col("__high")) | (F.col("__m") <= buffer)))
        state = state.where((F.col("__low") < F.col("__high")) & (F.col("__m") > buffer))
        if not state.limit(1).count():
            break
        # Halves, as the difference of two doubles may be none. Both ends are in parts of their own, so ranges shrink.
        share = (F.col("__v") / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2)
        part = F.when(F.col("__v") == F.col("__high"), BUCKETS - 1).otherwise(F.least(F.lit(BUCKETS - 2), F.floor(share * (BUCKETS - 1)))).cast("int")
        inside = rows.join(state, keys).where(F.col("__v").between(F.col("__low"), F.col("__high")))
        parts = inside.groupBy(*keys, "__rank", "__below", part.alias("__part")).agg(F.count(F.lit(1)).alias("__m"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        sofar = Window.partitionBy(*keys, "__rank").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("__below", F.col("__below") + F.coalesce(F.sum("__m").over(sofar), F.lit(0)))
        state = parts.where((F.col("__rank") >= F.col("__below")) & (F.col("__rank") < F.col("__below") + F.col("__m"))).select(*keys, "__rank", "__below", "__m", "__low", "__high")
    ends = functools.reduce(DataFrame.unionByName, done)
    one = ends.where(F.col("__low") == F.col("__high")).select(*keys, "__rank", F.col("__low").alias("__x"))
    few = ends.where(F.col("__low") < F.col("__high"))
    values = rows.join(few, keys).where(F.col("__v").between(F.col("__low"), F.col("__high"))).groupBy(*keys, "__rank", "__below").agg(F.sort_array(F.collect_list("__v")).alias("__vs"))
    found = one.unionByName(values.select(*keys, "__rank", F.get("__vs", (F.col("__rank") - F.col("__below")).cast("int")).alias("__x")))
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__at")).join(large.select(*keys, "__n"), keys)

    def between(p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        x, y = F.element_at("__at", low), F.element_at("__at", high)
        return F.when(low == high, x).otherwise((high - place(p)) * x + (place(p) - low) * y)

    big = at.select(*keys, *[between(p).alias(name) for name, p in wanted.items()])
    return small.unionByName(big).drop("__g")
