"""Sums of floats that do not depend on how files are split."""

from pyspark.sql import functions as F

from tidewright import plans
from tidewright.operators import prefixes, trades
from tidewright.sources import market

COPIES = 6


def copies(spark, tmp_path):
    """Line items repeated with shifted keys, in one file of many row groups that fall on other rows of each copy."""
    items = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").coalesce(1)
    every = None
    for i in range(COPIES):
        own = items.withColumns({"l_suppkey": F.col("l_suppkey") + 100 * i, "l_orderkey": F.col("l_orderkey") + 1_000_000 * i})
        every = own if every is None else every.unionByName(own)
    every.coalesce(1).write.option("parquet.block.size", 1 << 19).parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def small_splits(spark, f):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        return f()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_equal_runs_have_equal_ratios(spark, tmp_path):
    folder = copies(spark, tmp_path)

    def found():
        assert market.trades(spark, folder).rdd.getNumPartitions() > 3
        ratios = trades.ratios(market.trades(spark, folder)).groupBy(F.col("run_id") % 100).agg(*[F.count_distinct(c).alias(c) for c in ("sharpe", "sortino", "total_return")])
        ranks = {r.run_id: r.rank for r in plans.QUERIES["rank_by_sharpe"](spark, folder).collect()}
        return [tuple(r)[1:] for r in ratios.collect()], ranks

    ratios, ranks = small_splits(spark, found)
    assert ratios == [(1, 1, 1)] * 100
    # Ties go by the run's number: the copies of a run follow each other.
    assert all(ranks[run + 100 * i] == ranks[run] + i for run in range(100) for i in range(COPIES))


def test_a_long_key_stays_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "LONGEST", 1000)
    rows = spark.range(0, 9000, 1, 6).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("run_id"), (F.col("id") * 1.0).alias("x"))
    placed = prefixes.in_turn(rows, "run_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join parts as small as these
    try:
        assert placed.where("run_id = 1").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, rows.collect()))
    got = {r.run_id: r.total_return for r in placed.groupBy("run_id").agg(F.sum("x").alias("total_return")).where("run_id IN (1, 9)").collect()}
    assert got == {1: float(sum(i for i in range(9000) if i % 3)), 9: 9.0}


def test_windows_of_equal_runs_are_counted_alike(spark, tmp_path):
    folder = copies(spark, tmp_path)
    rows = small_splits(spark, lambda: plans.QUERIES["rolling_consistency"](spark, folder).collect())
    found = {r.run_id: (r.windows, r.profitable, r.sharpe_positive) for r in rows}
    assert all(found[run + 100 * i] == found[run] for run in range(100) for i in range(COPIES))
