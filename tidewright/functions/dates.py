"""Intervals, date ranges and times as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of an interval's suffix.
SUFFIX_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def interval_seconds(interval: Column) -> Column:
    """5s, 1m, 4h, 1d in seconds. Another suffix is an error."""
    text = F.lower(F.trim(interval))
    unit = F.substring(text, -1, 1)
    count = F.regexp_extract(text, "^([0-9]+).$", 1).try_cast("long")
    scale = F.lit(None).cast("long")
    for suffix, seconds in SUFFIX_SECONDS.items():
        scale = F.when(unit == suffix, F.lit(seconds).cast("long")).otherwise(scale)
    wrong = F.raise_error(F.concat(F.lit("unknown interval "), interval)).cast("long")
    return F.when(interval.isNull(), F.lit(None).cast("long")).when(scale.isNull() | count.isNull(), wrong).otherwise(count * scale)


def interval_minutes(interval: Column) -> Column:
    """The same in minutes; 0 for intervals of seconds."""
    return F.when(F.lower(F.trim(interval)).endswith("s"), F.lit(0).cast("long")).otherwise(F.floor(interval_seconds(interval) / 60))


def bar_count(start: Column, end: Column, minutes: Column) -> Column:
    """Bars between two dates, one at least; null where a date or the interval is unknown."""
    n = F.floor(F.datediff(end, start) * 1440 / F.when(minutes > 0, minutes))
    return F.when(n.isNotNull(), F.greatest(n, F.lit(1)))


def split_at(start: Column, end: Column, ratio: float) -> Column:
    """The day on which the first part, ratio of the days and one at least, ends and the second begins."""
    if not 0 < ratio < 1:
        raise ValueError(f"not a share: {ratio}")
    days = F.datediff(end, start)
    first = F.greatest(F.lit(1), F.floor(days * F.lit(ratio))).cast("int")
    return F.when(days < 2, F.raise_error(F.lit("fewer than two days to split")).cast("date")).otherwise(F.date_add(start, first))


def windows_of(ranges: DataFrame, n: int, start: str = "start", end: str = "end") -> DataFrame:
    """n windows of equal length for each row, the last with what is left: window, window_start and
    window_end, where one ends the next begins. Ranges of fewer than 7 * n days are an error."""
    if n < 2:
        raise ValueError("two windows at least")
    days = F.datediff(F.col(end), F.col(start))
    size = F.when(days < 7 * n, F.raise_error(F.lit(f"a range too short for {n} windows")).cast("int")).otherwise(F.floor(days / n).cast("int"))
    rows = ranges.withColumn("__size", size).withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    last = F.when(F.col("window") == n - 1, F.col(end)).otherwise(F.date_add(F.col(start), (F.col("window") + 1) * F.col("__size")))
    return rows.withColumns({"window_start": F.date_add(F.col(start), F.col("window") * F.col("__size")), "window_end": last}).drop("__size")


def months_between(start: Column, end: Column) -> Column:
    """The first days of all months from that of start to that of end."""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))


def shifted(day: Column, months: Column | int) -> Column:
    """months later, on the last day of that month where it is too short."""
    return F.add_months(day, months)


def years_ago(day: Column, years: int) -> Column:
    """The same day years ago; 28 February for 29 February."""
    return F.add_months(day, -12 * years)


def iso_of_ns(ns: Column) -> Column:
    """Nanoseconds since 1970 as ISO 8601 in UTC; microseconds only where there are any."""
    # Exact: a whole number of thousands is divided, and the quotient is rounded to the whole number that it is.
    total = F.round((ns - F.pmod(ns, F.lit(1000))) / 1000).cast("long")
    micros = F.pmod(total, F.lit(1_000_000))
    second = F.round((total - micros) / 1_000_000).cast("long")
    part = lambda div, mod: F.lpad((F.floor(F.pmod(second, F.lit(86400)) / div) % mod).cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(second / 86400).cast("int")).cast("string")
    whole = F.concat(day, F.lit("T"), F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60)))
    return F.concat(whole, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def plain_symbol(symbol: Column) -> Column:
    """BTC-USD as BTCUSD."""
    return F.replace(symbol, F.lit("-"), F.lit(""))


def dashed_symbol(symbol: Column, quote: str = "USD") -> Column:
    """BTCUSD as BTC-USD, and what has a dash or another quote as it is."""
    return F.when(symbol.endswith(quote) & ~symbol.contains("-"), F.concat(F.regexp_replace(symbol, f"{quote}$", ""), F.lit(f"-{quote}"))).otherwise(symbol)
