"""Market tables: scans with the bound rules of each caller, ticks, candles and trades of the test
tables, and sinks (idempotent append, partition replacement, event log)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970 of a timestamp column with or without time zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)") / 1000).cast("long")
    return F.unix_millis(F.col(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, time (ms), price, size and event_id, by which equal times are ordered."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("symbol"), epoch_ms(events, "ts").alias("time"), F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id", "ts")


def klines(spark: SparkSession, sf_dir: str, period: int = HOUR) -> DataFrame:
    """Candles of ticks: symbol, open_time, open, high, low, close, volume, close_time."""
    key = F.struct("ts", "event_id")
    bars = ticks(spark, sf_dir).groupBy("symbol", (F.floor(F.col("time") / period) * period).alias("open_time")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("size").alias("volume")
    )
    return bars.withColumn("close_time", F.col("open_time") + period - 1)


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding rates: every eight hours the move of a symbol's candle of that length."""
    bars = klines(spark, sf_dir, 8 * HOUR)
    return bars.select("symbol", F.col("open_time").alias("funding_time"), ((F.col("close") - F.col("open")) / F.col("open") / 100).alias("rate"))


#: What orders the trades of the test tables without ties.
TRADE_ORDER = ["exit_time", "order_id", "line", "part_id", "run_id"]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: line items as closed positions of a run (supplier)."""
    items = table(spark, sf_dir, "lineitem")
    pnl = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    return items.select(
        F.col("l_suppkey").alias("run_id"), F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("direction"),
        epoch_ms(items, "l_shipdate").alias("exit_time"), (epoch_ms(items, "l_shipdate") - F.col("l_linenumber") * 24 * HOUR).alias("entry_time"), (F.col("l_linenumber") * 24).cast("double").alias("hours"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"),
        F.col("l_extendedprice").alias("notional"), (F.col("l_extendedprice") * F.col("l_tax") * 0.01).alias("fee"), pnl.alias("net_pnl"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
    )


def scan(df: DataFrame, time_col: str, start: int | None = None, end: int | None = None, half_open: bool = False) -> DataFrame:
    """Rows between start and end, both inclusive, or without end where half_open. The bounds reach
    the scan as pushed filters."""
    if start is not None:
        df = df.where(F.col(time_col) >= start)
    if end is not None:
        df = df.where(F.col(time_col) < end if half_open else F.col(time_col) <= end)
    return df


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The rows of incoming that an idempotent append adds: keys that exist are left, and of incoming
    rows with one key the first to arrive is taken."""
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(arrival))).where("__n = 1").drop("__n")
    return first.join(existing.select(*keys), keys, "left_anti")


def valid_bars(df: DataFrame) -> DataFrame:
    """Bars that a sink writes: those with positive times."""
    return df.where("ts_event > 0 AND ts_init > 0")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write df so that only the partitions which it has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run_group(groups: int) -> Column:
    """Which of so many groups of an event log a run_id is in."""
    return (F.crc32(F.col("run_id").cast("string").cast("binary")) % groups).cast("int")


def write_events(rows: DataFrame, path: str, groups: int | None = None) -> None:
    """Add rows (ts, event, run_id, strategy, data) to an event log of JSON lines, a folder for each run. A folder and a file
    cost milliseconds: for many runs, `groups` gives a folder for each run_group() instead, with the run in each line, and
    a run's rows of one write in one file."""
    if groups:
        rows.withColumn("run_group", run_group(groups)).repartition("run_group").write.mode("append").partitionBy("run_group").json(path)
    else:
        rows.write.mode("append").partitionBy("run_id").json(path)


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs that an event log with a folder for each holds, in order: names of its folders, from the list of its files. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(path).select("path")
    name = F.url_decode(F.replace(F.regexp_extract("path", r"/run_id=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
    return files.select(name.alias("run_id")).where("run_id <> ''").distinct().orderBy("run_id")


EVENT = "ts string, event string, run_id string, strategy string, data map<string,string>"


def read_events(spark: SparkSession, path: str, event: str | None = None) -> DataFrame:
    """Rows of an event log of JSON lines, in folders of runs or of groups; lines that are no JSON are left out."""
    rows = spark.read.schema(EVENT + ", _corrupt_record string").json(path).drop("run_group")
    rows = rows.where(F.col("_corrupt_record").isNull() & F.col("event").isNotNull()).drop("_corrupt_record")
    return (rows if event is None else rows.where(F.col("event") == event)).orderBy("ts")


def read_kline_csv(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Candles of exported CSV files between two times, both inclusive, in order; header lines and others
    whose first field is no number go."""
    names = ["open_time", "open", "high", "low", "close", "volume", "close_time"]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path).where(F.col("open_time").rlike("^[0-9]+$"))
    rows = raw.select(*[F.col(n).cast("long" if "time" in n else "double").alias(n) for n in names])
    return scan(rows, "open_time", start, end).orderBy("open_time")
