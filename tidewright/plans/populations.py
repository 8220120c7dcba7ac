"""Queries over populations of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import ranking, trades
from tidewright.operators.scans import written
from tidewright.operators.selection import percentiles
from tidewright.plans.results import YEARLY, yearly
from tidewright.queries import RESULTS, query, rounded
from tidewright.sources import market


@query(YEARLY.replace("WITH t", "WITH RECURSIVE t") + """, o AS MATERIALIZED (SELECT year AS generation, run_id, sharpe AS a, 1 - max_drawdown AS b, profit_factor AS c FROM y),
ed AS MATERIALIZED (SELECT u.generation, u.run_id AS better, v.run_id FROM o u JOIN o v ON u.generation = v.generation AND u.a >= v.a AND u.b >= v.b AND u.c >= v.c AND (u.a > v.a OR u.b > v.b OR u.c > v.c)),
h AS (SELECT generation, run_id, 0 AS depth FROM o UNION SELECT ed.generation, ed.run_id, depth + 1 FROM h JOIN ed ON ed.generation = h.generation AND ed.better = h.run_id)
SELECT generation, run_id, max(depth) AS pareto_rank FROM h GROUP BY ALL""")
def pareto_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts within each year's population of all runs."""
    rows = yearly(spark, sf_dir).select(F.col("year").alias("generation"), "run_id", "sharpe", (1 - F.col("max_drawdown")).alias("kept"), "profit_factor")
    return ranking.pareto_ranks(rows, ["sharpe", "kept", "profit_factor"])


@query(RESULTS + " SELECT run_id, round(sharpe, 6) + 0.0 AS score FROM r ORDER BY sharpe DESC, run_id LIMIT 5")
def elites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.elites(trades.ratios(market.trades(spark, sf_dir)).select("run_id", F.col("sharpe").alias("score")), 5)).withColumn("score", F.round("score", 6) + 0.0)


@query("""WITH RECURSIVE p AS (SELECT o_orderpriority AS generation, o_orderkey AS run_id, o_totalprice AS score, o_custkey % 100 / 100 AS f0, o_orderkey % 37 / 37 AS f1, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders),
g AS (SELECT generation, CAST(1 AS BIGINT) AS i, [{'id': run_id, 's': score, 'a': f0, 'b': f1}] AS taken FROM p WHERE i = 1
 UNION ALL SELECT p.generation, p.i, CASE WHEN len(list_filter(taken, lambda x: (abs(x.a - f0) + abs(x.b - f1)) / 2 < 0.15)) = 0 THEN list_append(taken, {'id': run_id, 's': score, 'a': f0, 'b': f1}) ELSE taken END FROM g JOIN p ON p.generation = g.generation AND p.i = g.i + 1 WHERE len(taken) < 5),
l AS (SELECT generation, arg_max(taken, len(taken)) AS taken FROM g GROUP BY generation)
SELECT generation, t.x.id AS run_id, t.x.s AS score, CAST(t.place AS INTEGER) AS place FROM l, LATERAL (SELECT unnest(taken) AS x, generate_subscripts(taken, 1) AS place) t""")
def diverse_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per priority five orders of the highest price that differ enough from one another."""
    rows = market.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("generation"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("score"), (F.col("o_custkey") % 100 / 100).alias("f0"), (F.col("o_orderkey") % 37 / 37).alias("f1"))
    return ranking.diverse(rows, ["f0", "f1"])


@query("""WITH RECURSIVE p AS MATERIALIZED (SELECT c_custkey AS run_id, c_acctbal AS score, c_nationkey / 25 AS a, c_custkey % 37 / 37 AS b, c_mktsegment AS m, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer),
g AS (SELECT CAST(1 AS BIGINT) AS i, [{'i': i, 'a': a, 'b': b, 'm': m}] AS taken FROM p WHERE i = 1
 UNION ALL SELECT p.i, CASE WHEN len(list_filter(taken, lambda x: (abs(x.a - p.a) + abs(x.b - p.b) + CASE WHEN x.m = p.m THEN 0 ELSE 1 END) / 3 < 0.15)) = 0 THEN list_append(taken, {'i': p.i, 'a': p.a, 'b': p.b, 'm': p.m}) ELSE taken END FROM g JOIN p ON p.i = g.i + 1),
f AS (SELECT unnest(arg_max(taken, i)) AS t FROM g),
s AS (SELECT p.run_id, p.score, min(t.i) AS i FROM p JOIN f ON (abs(t.a - p.a) + abs(t.b - p.b) + CASE WHEN t.m = p.m THEN 0 ELSE 1 END) / 3 < 0.15 GROUP BY ALL)
SELECT p.run_id AS founder, count(*) AS n, round(median(s.score), 4) + 0.0 AS median_score FROM s JOIN p USING (i) GROUP BY p.run_id""")
def similarity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in groups around the first of each by balance, with the median of each group."""
    rows = market.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("score"), (F.col("c_nationkey") / 25).alias("a"), (F.col("c_custkey") % 37 / 37).alias("b"), "c_mktsegment")
    groups = written(ranking.groups_of_near(rows, ["a", "b"], ["c_mktsegment"], block=64), "groups")
    middle = percentiles(groups, ["founder"], "score", {"median_score": 0.5})
    return rounded(groups.groupBy("founder").agg(F.count(F.lit(1)).alias("n")).join(middle, "founder"), 4)


#: Ranges of the parameters of indicators that stand for return flags.
PARAMETERS = {"A": {"discount": (0.0, 0.1)}, "N": {"discount": (0.0, 0.1), "tax": (0.0, 0.08)}}


def _gene() -> Column:
    return F.struct(
        F.col("l_returnflag").alias("indicator"), F.col("l_linestatus").alias("condition"), F.col("l_quantity").alias("threshold"),
        F.create_map(F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax")).alias("parameters"),
    )


_LINES = "(PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)"


@query(f"""WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_returnflag AS f, l_linestatus AS c, l_discount AS d, l_tax AS x, lag(l_returnflag) OVER {_LINES} AS f0, lag(l_linestatus) OVER {_LINES} AS c0, lag(l_quantity) OVER {_LINES} AS q0, lag(l_discount) OVER {_LINES} AS d0, lag(l_tax) OVER {_LINES} AS x0 FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, q, round((CASE WHEN f = f0 THEN 0 ELSE 2 END + CASE WHEN c = c0 THEN 0 ELSE 1 END + CASE WHEN f = f0 THEN least(1, abs(q - q0) / CASE WHEN f = 'A' THEN 50 ELSE 100 END) ELSE 1 END
 + CASE WHEN f <> f0 THEN 1 WHEN f = 'A' THEN abs(d - d0) / 0.1 WHEN f = 'N' THEN (abs(d - d0) / 0.1 + abs(x - x0) / 0.08) / 2 ELSE 0.5 END) / 5, 6) AS distance FROM g WHERE f0 IS NOT NULL""")
def gene_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gower distances of neighbouring lines of a supplier, as genes."""
    before = F.lag("gene").over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    rows = market.table(spark, sf_dir, "lineitem").withColumn("gene", _gene()).withColumn("before", before).where(F.col("before").isNotNull())
    distance = ranking.gene_distance(F.col("before"), F.col("gene"), {"A": 50.0}, PARAMETERS)
    return rounded(rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), distance.alias("distance")))


@query("""WITH c AS (SELECT event_type AS v, count(*) AS c, 'a' AS locus FROM events GROUP BY 1 UNION ALL SELECT CAST(user_id % 4 AS VARCHAR), count(*), 'b' FROM events GROUP BY 1 UNION ALL SELECT CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR), count(*), 'c' FROM events GROUP BY 1),
p AS (SELECT locus, c / sum(c) OVER (PARTITION BY locus) AS p FROM c), h AS (SELECT -sum(p * log2(p)) / log2(count(*)) AS h FROM p GROUP BY locus) SELECT round(avg(h), 6) AS entropy FROM h""")
def population_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("b"), F.floor(F.col("value") / 50).alias("c"))
    return rounded(ranking.entropy(rows, ["event_type", "b", "c"]))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS indicator, l_quantity AS threshold FROM lineitem")
def genomes_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes written as JSON text and read again."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = market.table(spark, sf_dir, "lineitem").select(*keys, F.col("l_returnflag").alias("indicator"), F.col("l_quantity").alias("threshold"))
    text = ranking.chromosome_json(rows, ["indicator", "threshold"]).select(*keys, "genome")
    return ranking.from_chromosome_json(text, "indicator string, threshold double").drop("genome")
