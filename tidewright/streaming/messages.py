"""Messages of a market data feed as typed rows. A message is JSON text in `value` with its `channel`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.dates import plain_symbol

PRICE = "decimal(38,18)"


def _read(messages: DataFrame, channel: str, shape: str) -> DataFrame:
    """Messages of one channel as rows; what does not parse, or has no symbol, is left out."""
    rows = messages.where(F.col("channel") == channel).select(F.from_json("value", f"symbol string, timestamp bigint, {shape}").alias("m")).select("m.*")
    return rows.where(F.col("symbol").isNotNull()).withColumns({"symbol": plain_symbol(F.col("symbol")), "time": F.coalesce("timestamp", F.lit(0).cast("long"))}).drop("timestamp")


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("0")).cast(PRICE)


def book_depth(messages: DataFrame) -> DataFrame:
    """symbol, time, bids and asks: arrays of price and size in the feed's order."""
    levels = lambda c: F.transform(F.coalesce(c, F.array().cast("array<array<string>>")), lambda x: F.struct(x[0].cast(PRICE).alias("price"), x[1].cast(PRICE).alias("size"))).alias(c)
    return _read(messages, "BookDepth", "bids array<array<string>>, asks array<array<string>>").select("symbol", "time", levels("bids"), levels("asks"))


def market_prices(messages: DataFrame) -> DataFrame:
    """symbol, time, price and size; 0 for what is missing."""
    return _read(messages, "MarketPrice", "price string, size string").select("symbol", "time", _number("price").alias("price"), _number("size").alias("size"))


def funding_rates(messages: DataFrame) -> DataFrame:
    """symbol, time, rate, mark_price and the next time of funding (null if unknown)."""
    rows = _read(messages, "FundingRate", "fundingRate string, markPrice string, nextFundingTime bigint")
    return rows.select("symbol", "time", _number("fundingRate").alias("rate"), _number("markPrice").alias("mark_price"), F.when(F.col("nextFundingTime") != 0, F.col("nextFundingTime")).alias("next_time"))
