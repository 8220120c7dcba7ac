"""Candles: resampling, gaps, checks and coverage, and the join of each bar with the latest closed bar
of a longer period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.prefixes import carried

MINUTE = 60_000
#: Rows of a full day by interval.
PER_DAY = {"1s": 86400, "5s": 17280, "1m": 1440, "5m": 288, "15m": 96, "1h": 24, "4h": 6}


def resample(bars: DataFrame, period: int, browse: bool = False) -> DataFrame:
    """Bars of a longer period in ms. Catalogue rule: open_time is the first row's. Browse rule:
    open_time is the bucket's start, and a bucket of one row closes at its end."""
    bucket = (F.floor(F.col("open_time") / period) * period).alias("bucket")
    out = bars.groupBy("symbol", bucket).agg(
        F.min("open_time").alias("first_time"), F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        F.round(F.sum("volume"), 8).alias("volume"), F.max("close_time").alias("last_close"), F.count(F.lit(1)).alias("n"),
    )
    if browse:
        close_time = F.when(F.col("n") == 1, F.col("bucket") + period - 1).otherwise(F.col("last_close"))
        return out.select("symbol", F.col("bucket").alias("open_time"), "open", "high", "low", "close", "volume", close_time.alias("close_time"))
    return out.select("symbol", F.col("first_time").alias("open_time"), "open", "high", "low", "close", "volume", F.col("last_close").alias("close_time"))


def gaps(bars: DataFrame, max_minutes: int = 5) -> DataFrame:
    """Neighbouring bars further apart than max_minutes: symbol, gap_start, gap_end, minutes."""
    lag = lambda w: F.max("open_time").over(w.rowsBetween(-1, -1))
    rows = carried(bars.select("symbol", "open_time"), ["symbol"], ["open_time"], lambda w: [{"__here": lag(w)}], {"__last": F.max("open_time")}, lambda w: [{"__before": F.max("__last").over(w)}])
    apart = F.col("open_time") - F.col("gap_start")
    return rows.select("symbol", "open_time", F.coalesce("__here", "__before").alias("gap_start")).where(apart > max_minutes * MINUTE).select("symbol", "gap_start", F.col("open_time").alias("gap_end"), F.expr(f"(open_time - gap_start) div {MINUTE}").alias("minutes"))


def violations(bars: DataFrame) -> DataFrame:
    """A row per broken rule of a bar: symbol, open_time, message."""
    rules = [("high < low", "high < low"), ("high < open", "high < open"), ("high < close", "high < close"), ("low > open", "low > open"), ("low > close", "low > close")]
    found = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(message)) for rule, message in rules]))
    return bars.select("symbol", "open_time", F.explode(found).alias("message"))


def quality_score(bars: DataFrame) -> DataFrame:
    """Per symbol the number of bars with impossible values, and 1 - min(1, n / 100)."""
    bad = F.expr("high < low OR close <= 0 OR volume < 0 OR open <= 0")
    n = F.count_if(bad)
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), n.alias("bad"), F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), n / 100)).alias("score"))


def coverage(bars: DataFrame, interval: str, threshold: float = 0.9) -> DataFrame:
    """Per symbol and month the bars there are, those expected, and whether enough are there: never, and
    none expected, for an interval without a known number a day."""
    month = F.trunc(F.timestamp_millis("open_time"), "month")
    rows = bars.groupBy("symbol", month.alias("month")).agg(F.count(F.lit(1)).alias("bars"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    expected = F.dayofmonth(F.last_day("month")) * F.lit(PER_DAY.get(interval, 0))
    return rows.select("symbol", F.date_format("month", "yyyy-MM").alias("month"), "bars", "first", "last", expected.cast("long").alias("expected"), (F.lit(interval in PER_DAY) & (F.col("bars") >= expected * threshold)).alias("covered"))


def bad_bars(bars: DataFrame, limit: int = 50) -> DataFrame:
    """The first rows, of each symbol, of quality_score()'s bars with impossible values, a row per broken
    rule: a report, cut at limit rows."""
    rules = [("high < low", "high < low"), ("close <= 0", "close <= 0"), ("volume < 0", "volume < 0"), ("open <= 0", "open <= 0")]
    found = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(message)) for rule, message in rules]))
    return bars.select("symbol", "open_time", F.explode(found).alias("message")).orderBy("symbol", "open_time", "message").limit(limit)


def regimes(bars: DataFrame, period: int, threshold: float = 0.05) -> DataFrame:
    """Per symbol and period (ms) the sign of its move from first open to last close: 0 below the threshold."""
    r = (F.max_by("close", "open_time") - F.min_by("open", "open_time")) / F.min_by("open", "open_time")
    rows = bars.groupBy("symbol", F.floor(F.col("open_time") / period).alias("period")).agg(r.alias("r"))
    return rows.select("symbol", "period", F.when(F.abs("r") < threshold, 0).otherwise(F.signum("r")).cast("int").alias("regime"))


def event_summary(events: DataFrame) -> DataFrame:
    """One row per run of a log of events (run_id, event, time): events, first and last time, kinds."""
    return events.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.countDistinct("event").alias("kinds"))


def event_counts(events: DataFrame) -> DataFrame:
    """Events of each kind."""
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def latest_closed(primary: DataFrame, higher: DataFrame, value: Column, name: str) -> DataFrame:
    """As-of join: each primary bar with `value` of the latest higher bar that closed no later.

    Both tables are put in one order by close time; the value is carried on within spans of time and from
    span to span. No bar is joined with another, so there is no row count to grow, and one of equal time counts as closed."""
    left = primary.select("symbol", F.col("close_time").alias("__t"), F.lit(1).alias("__side"), F.struct(*primary.columns).alias("__row"), F.lit(None).cast("double").alias("__v"))
    right = higher.select("symbol", F.col("close_time").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(dict(left.dtypes)["__row"]).alias("__row"), value.cast("double").alias("__v"))
    last = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct("__t", "__side")))
    rows = carried(left.unionByName(right), ["symbol"], ["__t", "__side"], lambda w: [{"__here": F.last("__v", ignorenulls=True).over(w)}], {"__last": last}, lambda w: [{"__before": F.last("__last", ignorenulls=True).over(w)}])
    return rows.where("__side = 1").withColumn(name, F.coalesce("__here", "__before")).select("__row.*", name)
