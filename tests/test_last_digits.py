"""Results to the last digit as SQL on one thread has them, also where a ratio is the noise of sums."""

import duckdb
from pyspark.sql import functions as F

from test_sums_in_turn import copies, small_splits
from tidewright import plans
from tidewright.operators import screening
from tidewright.queries import rounded_in_floats
from tidewright.sources import market


def test_halves_of_equal_runs_are_equal(spark, tmp_path):
    folder = copies(spark, tmp_path)

    def found():
        rows = market.table(spark, folder, "lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("run_id"), (F.col("l_discount") - 0.05).alias("x"))
        return screening.returns_by_run(rows).groupBy(F.col("run_id") % 100).agg(F.count_distinct("sharpe"), F.count_distinct("total_return")).collect()

    assert [tuple(r)[1:] for r in small_splits(spark, found)] == [(1, 1)] * 100


def test_rounding_in_floats(spark):
    values = [6.2077584256285864e16, 2817488472239900.5, 1.00005, -0.00005, 1e306, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded_in_floats(F.col("x"), 4)).collect()]
    assert got == [6.207758425628587e16, 2817488472239900.5, 1.0001, -0.0001, 1e306, float("inf"), None]


def sql_and_query(spark, name):
    sf_dir, con = "/root/testdata/sf0.1", duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf_dir}/lineitem.parquet')")
    asked = con.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in asked.description]
    return sorted(asked.fetchall()), sorted(map(tuple, plans.QUERIES[name](spark, sf_dir).select(*columns).collect()))


def test_screening_equals_sql_to_the_last_digit(spark):
    sql, found = sql_and_query(spark, "screening_consistency")
    assert found == sql


def test_holdout_loss_equals_sql_to_the_last_digit(spark):
    sql, found = sql_and_query(spark, "holdout_loss")
    assert found == sql
