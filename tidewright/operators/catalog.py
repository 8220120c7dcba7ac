"""The catalogue of candles: footers, rebuilding of all intervals, coverage and verification reports,
sessions and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import timeseries

MINUTE = 60_000
#: Intervals that a catalogue holds besides that of its input, in ms.
INTERVALS = {"5m": 5 * MINUTE, "15m": 15 * MINUTE, "1h": 60 * MINUTE, "4h": 240 * MINUTE}


def footer_summary(spark: SparkSession, path: str, time_col: str = "ts_event") -> DataFrame:
    """n, first and last of a Parquet table, from the statistics in its files' footers: no data page is
    read where all files have them."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.min(time_col).alias("first"), F.max(time_col).alias("last"))


def rebuild(bars: DataFrame, intervals: dict[str, int] | None = None, known: list[str] | None = None) -> DataFrame:
    """Candles of every interval in one job: the columns of bars and `interval`. Each input row goes to one
    bucket per interval and is merged there before the shuffle. Symbols that are not known are left out."""
    periods = INTERVALS if intervals is None else intervals
    rows = bars if known is None else bars.where(F.col("symbol").isin(known))
    names = F.array(*[F.struct(F.lit(k).alias("interval"), F.lit(v).cast("long").alias("period")) for k, v in periods.items()])
    each = rows.withColumn("__i", F.explode(names)).select("*", "__i.interval", (F.floor(F.col("open_time") / F.col("__i.period"))).alias("__bucket"))
    return each.groupBy("symbol", "interval", "__bucket").agg(
        F.min("open_time").alias("open_time"), F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"), F.round(F.sum("volume"), 8).alias("volume"), F.max("close_time").alias("close_time"),
    ).drop("__bucket")


def write_catalog(bars: DataFrame, path: str) -> None:
    """Candles by symbol and interval; what a partition held before is replaced."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "interval").parquet(path)


def catalog_bars(spark: SparkSession, path: str, symbol: str, interval: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Candles of one partition between two times, both inclusive, in order."""
    rows = spark.read.parquet(path).where((F.col("symbol") == symbol) & (F.col("interval") == interval))
    if start is not None:
        rows = rows.where(F.col("open_time") >= start)
    if end is not None:
        rows = rows.where(F.col("open_time") <= end)
    return rows.orderBy("open_time")


def to_precision(column: Column, digits: int) -> Column:
    """Rounded half to even, as prices and sizes are written."""
    return F.bround(column, digits)


def bars_of_klines(klines: DataFrame, price_digits: int = 2, size_digits: int = 8) -> DataFrame:
    """Candles as a catalogue stores them: prices and volume to their digits, times in ns."""
    prices = [to_precision(F.col(c), price_digits).alias(c) for c in ("open", "high", "low", "close")]
    return klines.select("symbol", *prices, to_precision(F.col("volume"), size_digits).alias("volume"), (F.col("open_time") * 1_000_000).alias("ts_event"), (F.col("close_time") * 1_000_000).alias("ts_init"))


def preview(bars: DataFrame, symbols: list[str], start: str, end: str, per_day: int = 1440, enough: float = 0.9) -> DataFrame:
    """For every symbol and month from start to end the rows there are and should be, and a status. All of
    one symbol and month are counted before they meet the caller's list of symbols."""
    month = F.date_format(F.trunc(F.timestamp_millis("open_time"), "month"), "yyyy-MM")
    counts = bars.where(F.col("symbol").isin(symbols)).groupBy("symbol", month.alias("month")).agg(F.count(F.lit(1)).alias("bars"))
    first = F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.trunc(F.lit(end).cast("date"), "month"), F.expr("INTERVAL 1 MONTH")))
    asked = bars.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string").select("symbol", first.alias("first"))
    rows = asked.select("symbol", F.date_format("first", "yyyy-MM").alias("month"), (F.dayofmonth(F.last_day("first")) * per_day).cast("long").alias("expected")).join(counts, ["symbol", "month"], "left").na.fill(0, ["bars"])
    status = F.when(F.col("bars") >= F.col("expected") * enough, "Archived").when(F.col("bars") > 0, "Partial").otherwise("Will download")
    return rows.select("symbol", "month", "bars", "expected", status.alias("status"))


def coverage_report(klines: DataFrame, bars: DataFrame, funding: DataFrame) -> DataFrame:
    """Per symbol the number and range of klines, and the numbers of catalogue bars and funding rates."""
    own = klines.groupBy("symbol").agg(F.count(F.lit(1)).alias("klines"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    count = lambda df, name: df.groupBy("symbol").agg(F.count(F.lit(1)).alias(name))
    return own.join(count(bars, "bars"), "symbol", "left").join(count(funding, "funding"), "symbol", "left").na.fill(0, ["bars", "funding"])


def download_history(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Per symbol and interval the range, number and latest time of download, the latest first."""
    own = rows.groupBy("symbol", "interval").agg(F.min("open_time").alias("first"), F.max("open_time").alias("last"), F.count(F.lit(1)).alias("n"), F.max("downloaded_at").alias("downloaded_at"))
    return own.orderBy(F.desc("downloaded_at"), "symbol", "interval").limit(limit)


def row_count_ok(actual: Column, expected: Column, tolerance: float = 0.01) -> Column:
    """Whether actual is within a share of expected; of nothing expected, nothing."""
    return F.when(expected == 0, actual == 0).otherwise(F.abs(actual - expected) / F.when(expected != 0, expected) <= tolerance)


def verify(bars: DataFrame, max_minutes: int = 5) -> DataFrame:
    """Gaps and broken candles in one table: symbol, kind, open_time, detail."""
    gaps = timeseries.gaps(bars, max_minutes).select("symbol", F.lit("gap").alias("kind"), F.col("gap_end").alias("open_time"), F.concat(F.col("minutes").cast("string"), F.lit(" minutes")).alias("detail"))
    broken = timeseries.violations(bars).select("symbol", F.lit("candle").alias("kind"), "open_time", F.col("message").alias("detail"))
    return gaps.unionByName(broken)


def latest_sessions(log: DataFrame, limit: int = 20, key: str = "session_id", order: str = "seq") -> DataFrame:
    """The latest entry of each session of an append-only log, the newest sessions first."""
    columns = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__last"))
    return last.select(key, "__last.*").orderBy(F.desc(key)).limit(limit)


def beyond_newest(rows: DataFrame, keep: int = 100, key: str = "id") -> DataFrame:
    """The rows that go when the `keep` newest stay; only that many keys are ever sorted together."""
    newest = rows.select(key).orderBy(F.desc(key)).limit(keep)
    return rows.join(newest, key, "left_anti")


def stale(jobs: DataFrame, now_ms: Column, seconds: int = 120) -> DataFrame:
    """Running jobs (status, started, heartbeat in ms) whose last heartbeat, or start if there was none, is
    longer ago than so many seconds; those with neither too."""
    seen = F.coalesce("heartbeat", "started")
    return jobs.where((F.col("status") == "RUNNING") & (seen.isNull() | (now_ms - seen > seconds * 1000)))


def catch_up_from(stored: DataFrame, step_ms: int = MINUTE) -> DataFrame:
    """Per symbol the time from which rows are missing: one step after the last that is there."""
    return stored.groupBy("symbol").agg((F.max("open_time") + step_ms).alias("from_time"))


def missing_rows(incoming: DataFrame, stored: DataFrame, step_ms: int = MINUTE) -> DataFrame:
    """Rows of incoming from each symbol's high-water mark on; all of a symbol that has none."""
    marks = catch_up_from(stored, step_ms)
    return incoming.join(marks, "symbol", "left").where(F.col("from_time").isNull() | (F.col("open_time") >= F.col("from_time"))).drop("from_time")


def append_checked(rows: DataFrame, path: str, allowed: list[str]) -> None:
    """Append rows, of which no column may be unknown."""
    if unknown := sorted(set(rows.columns) - set(allowed)):
        raise ValueError(f"unknown columns {unknown}")
    rows.write.mode("append").parquet(path)


def export_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV files with headers; rows in order within and across the files."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)

