"""The library's own operators against DuckDB on the smallest tables, against plain loops where SQL has
no words for them, and on known small cases."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewright import plans as queries
from tidewright.functions import scores
from tidewright.operators import indicators, overfitting, reconcile, screening, simulation, timeseries, trades
from tidewright.sources import market
from tidewright.streaming import bars as stream

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows, names):
    key = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(key(dict(zip(names, r, strict=True))[n]) for n in sorted(names)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(map(tuple, got.collect()), got.columns) == plain(want.fetchall(), names)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_resample_of_known_bars(spark):
    # A bar a minute from a price that climbs by 7 a minute, of which the third dips by 40.
    rows = [("S", i * 60_000, 100.0 + 7 * i, 109.0 + 7 * i, 95.0 + 7 * i - 40 * (i == 2), 104.0 + 7 * i, 3.0 + i, i * 60_000 + 59_999) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, open_time long, open double, high double, low double, close double, volume double, close_time long")
    want = (rows[0][2], max(r[3] for r in rows), min(r[4] for r in rows), rows[-1][5], sum(r[6] for r in rows))
    assert want == (100, 137, 69, 132, 25) and [tuple(r)[2:7] for r in timeseries.resample(df, 300_000).collect()] == [want]
    assert timeseries.gaps(df, 1).count() == 0 and timeseries.violations(df).count() == 0
    assert timeseries.resample(df.where("false"), 300_000).count() == 0
    assert [r.covered for r in timeseries.coverage(df, "7m").collect()] == [False]


def test_recursive_indicators_equal_textbook(spark):
    bars = market.klines(spark, SMALL).where("symbol = 'click'")
    rows = sorted(indicators.with_recursive_indicators(bars).collect(), key=lambda r: r.open_time)
    close = [r.close for r in rows]

    def ema(xs, n):
        out, value = [None] * (n - 1), sum(xs[:n]) / n
        out.append(value)
        for x in xs[n:]:
            value = value + 2 / (n + 1) * (x - value)
            out.append(value)
        return out

    for r, e in zip(rows, ema(close, 14), strict=True):
        assert r.ema is None if e is None else math.isclose(r.ema, e, rel_tol=1e-9)
    gain = loss = 0.0
    moves = [b - a for a, b in zip(close, close[1:])]  # noqa: B905
    gain, loss = sum(max(m, 0) for m in moves[:14]) / 14, sum(max(-m, 0) for m in moves[:14]) / 14
    assert math.isclose(rows[14].rsi, 100 * gain / (gain + loss), rel_tol=1e-9)
    for i in range(14, len(moves)):
        gain, loss = (gain * 13 + max(moves[i], 0)) / 14, (loss * 13 + max(-moves[i], 0)) / 14
        assert math.isclose(rows[i + 1].rsi, 100 * gain / (gain + loss), rel_tol=1e-6)
    fast, slow = ema(close, 12), ema(close, 26)
    assert all(math.isclose(r.macd, f - s, rel_tol=1e-6, abs_tol=1e-9) for r, f, s in zip(rows, fast, slow, strict=True) if s is not None)


def test_simulation_tests_the_stop_first(spark):
    def bar(i, o, h, lo, c, **signals):
        return (1, "S", i, o, h, lo, c, i + 1, *(signals.get(k, False) for k in ("long_entry", "short_entry", "long_exit", "short_exit")))

    rows = [bar(0, 100.0, 101.0, 99.0, 100.0, long_entry=True), bar(10, 100.0, 110.0, 90.0, 100.0, short_entry=True), bar(20, 100.0, 100.5, 99.5, 100.0), bar(30, 100.0, 100.0, 95.0, 96.0, long_entry=True), bar(40, 96.0, 97.0, 95.5, 96.5)]
    df = spark.createDataFrame(rows, "param_id long, symbol string, open_time long, open double, high double, low double, close double, close_time long, long_entry boolean, short_entry boolean, long_exit boolean, short_exit boolean")
    got = sorted(simulation.simulate(df, stop=0.02, take=0.04, fee=0.0).collect(), key=lambda r: r.entry_time)
    assert [(r.direction, r.entry_time, r.exit_price, r.reason) for r in got] == [("LONG", 10, 98.0, "stop"), ("SHORT", 20, 96.0, "target"), ("LONG", 40, 96.5, "end")]
    assert simulation.simulate(df.where("false")).count() == 0


def test_reconcile_equals_greedy(spark):
    import random

    rng = random.Random(3)
    left, right = ([(i, rng.choice("AB"), rng.randrange(4_000_000)) for i in range(n)] for n in (150, 140))
    schema = "id long, symbol string, time long"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    free, want = set(range(len(right))), set()
    for i, s, t in sorted(left, key=lambda r: (r[1], r[2], r[0])):
        near = sorted((abs(right[j][2] - t), right[j][2], j) for j in free if right[j][1] == s and abs(right[j][2] - t) <= 120_000)
        if near:
            free.discard(near[0][2])
            want.add((i, near[0][2]))
    got = reconcile.match(a, b)
    assert {(r.left_id, r.right_id) for r in got.collect()} == want
    row = reconcile.parity(a, b, got).first()
    assert (row.matched, row.left_only, row.right_only) == (len(want), 150 - len(want), 140 - len(want))
    assert reconcile.parity(a.where("false"), b.where("false"), got.where("false")).first().parity == 1.0


def test_reconcile_streams_one_large_cluster(spark):
    import time

    a = spark.range(40_000).select("id", F.lit("S").alias("symbol"), (F.col("id") * 13_000).alias("time"))
    began = time.time()
    got = reconcile.match(a, a.withColumn("time", F.col("time") + 4000)).agg(F.count(F.lit(1)), F.count_if(F.col("left_id") == F.col("right_id")), F.max("distance")).first()
    assert tuple(got) == (40_000, 40_000, 4000) and time.time() - began < 20


def test_open_and_close_events_pair_in_order(spark):
    log = [("p", 1, "OPEN", 10.0), ("p", 2, "OPEN", 11.0), ("p", 3, "FILL", 5.0), ("p", 4, "CLOSE", 12.0), ("p", 5, "CLOSE", 13.0), ("q", 1, "CLOSE", 1.0), ("r", 1, "OPEN", 1.0), ("s", 1, "OPEN", None), ("s", 2, "CLOSE", 2.0)]
    df = spark.createDataFrame([(p, t, t, e, x) for p, t, e, x in log], "position_id string, ts long, seq long, event string, price double")
    assert [tuple(r) for r in reconcile.paired_events(df).collect()] == [("p", 2, 4, 11.0, 12.0)]


def test_pareto_front_equals_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(i, *(float(rng.randrange(12)) for _ in range(3))) for i in range(300)]
    want = {r[0] for r in rows if not any(all(x >= y for x, y in zip(s[1:], r[1:], strict=True)) and s[1:] != r[1:] for s in rows)}
    df = spark.createDataFrame(rows, "run_id long, a double, b double, c double").repartition(4)
    assert {r.run_id for r in screening.pareto_front(df, ["a", "b", "c"]).collect()} == want


def test_idempotent_append_takes_the_first(spark):
    new = spark.createDataFrame([("S", 1, 5.0, 0), ("S", 1, 6.0, 1), ("S", 2, 7.0, 2)], "symbol string, open_time long, close double, n long")
    old = spark.createDataFrame([("S", 2)], "symbol string, open_time long")
    assert [r.close for r in market.new_rows(new, old, ["symbol", "open_time"], "n").collect()] == [5.0]


def test_event_log_and_csv(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "t1", "event": "OPEN", "run_id": "r", "data": {"x": "1"}}\nnot json\n{"ts": "t2", "event": "CLOSE"}\n')
    assert market.read_events(spark, f"file://{tmp_path}/log.jsonl").count() == 2
    assert market.read_events(spark, f"file://{tmp_path}/log.jsonl", "OPEN").count() == 1
    (tmp_path / "k.csv").write_text("open_time,open,high,low,close,volume,close_time\n1,2,3,1,2,5,9\n")
    assert [tuple(r) for r in market.read_kline_csv(spark, f"file://{tmp_path}/k.csv").collect()] == [(1, 2.0, 3.0, 1.0, 2.0, 5.0, 9)]


def test_bootstrap_and_folds(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.1, 0.3, 0.2, 0.1]), (2, [0.1]), (3, [0.0] * 8)], "run_id long, returns array<double>")
    got = {r.run_id: r for r in overfitting.bootstrap_sharpe(df).collect()}
    assert got[1].passed and 0 < got[1].low < got[1].high
    assert got[2].low == float("-inf") and not got[2].passed and got[3].low == got[3].high == 0.0
    folds = overfitting.purged_folds(spark, 103, 5, 5, 3).collect()
    assert [(f.test_from, f.test_to, f.before_to, f.after_from) for f in folds] == [(0, 20, 0, 23), (20, 40, 15, 43), (40, 60, 35, 63), (60, 80, 55, 83), (80, 103, 75, 103)]


def test_bootstrap_takes_all_resamples_and_the_least_sharpe(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, 300)
    z = (z - z.mean()) / z.std(ddof=1)
    own = {1: z + 0.15, 2: z + 0.25, 3: z[:5]}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in own.items()], "run_id long, returns array<double>")
    got = {r.run_id: r for r in overfitting.bootstrap_sharpe(df).collect()}
    for k, x in own.items():
        drawn = x[np.random.default_rng(42).integers(0, len(x), (10_000, len(x)))]
        low, high = np.percentile(drawn.mean(1) / drawn.std(1, ddof=1) * len(x) ** 0.5, [2.5, 97.5])
        assert math.isclose(got[k].low, low, rel_tol=1e-9) and math.isclose(got[k].high, high, rel_tol=1e-9)
        assert got[k].passed == (low >= 1.0)
    assert 0 < got[1].low < 1 and not got[1].passed and got[2].passed
    # The query resamples trades: a run's interval is that of all its trades' returns.
    runs = {r.run_id: r for r in queries.QUERIES["bootstrap_intervals"](spark, SMALL).collect()}
    trade = market.trades(spark, SMALL).where("run_id = 1").orderBy(*market.TRADE_ORDER).selectExpr("net_pnl / notional AS r").collect()
    x = np.array([r.r for r in trade])
    drawn = x[np.random.default_rng(42).integers(0, len(x), (10_000, len(x)))]
    assert math.isclose(runs[1].low, np.percentile(drawn.mean(1) / drawn.std(1, ddof=1) * len(x) ** 0.5, 2.5), rel_tol=1e-9)


def test_streak_moments_of_odd_runs(spark):
    rows = [(1, i, 0, 0, 0, x, 10.0) for i, x in enumerate([1.0, 2.0, 0.0, 3.0, -1.0, -1.0, -1.0])] + [(2, 0, 0, 0, 0, 5.0, 10.0)]
    df = spark.createDataFrame([(a, b, c, d, e, f, g) for a, b, c, d, e, f, g in rows], "run_id long, exit_time long, order_id long, line long, part_id long, net_pnl double, notional double")
    assert {r.run_id: (r.max_wins, r.max_losses) for r in trades.streaks(df).collect()} == {1: (2, 3), 2: (1, 0)}
    assert {r.run_id: (r.skewness, r.kurtosis) for r in trades.moments(df).collect()}[2] == (0.0, 3.0)


def test_scores(spark):
    row = spark.range(1).select(scores.kelly_fraction(F.lit(0.6), F.lit(2.0)).alias("k"), scores.slippage(F.lit(0.2), F.lit(0.0), F.lit(5.0), F.lit(10.0)).alias("s"), scores.stop_imbalance_penalty(F.lit(10.0), F.lit(1.0)).alias("p")).first()
    assert math.isclose(row.k, 0.2) and row.s == 0.1 and math.isclose(row.p, 0.1)


def test_streams(spark, tmp_path):
    ticks = market.ticks(spark, SMALL).select("symbol", F.timestamp_millis("time").alias("ts"), "price", "size", "event_id")
    ticks.write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(ticks.schema).parquet(f"file://{tmp_path}/in")
    for name, df in (("streamed_bars", stream.stream_bars(source)), ("unique_ticks", stream.without_repeats(source, ["event_id"]))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = {(r.symbol, r.open_time): r.close for r in market.klines(spark, SMALL).collect()}
    got = {(r.symbol, r.open_time): r.close for r in spark.table("streamed_bars").collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())
    assert spark.table("unique_ticks").count() == ticks.count()


def test_holdout_loss_is_rounded_once(spark):
    # -389.06114... is -389.06115 to six digits, and -389.0611 to four.
    rows = {r.run_id: r.degradation for r in queries.QUERIES["holdout_loss"](spark, "/root/testdata/sf0.1").where("run_id IN (140, 417)").collect()}
    assert rows == {140: -389.0611, 417: -147.6093}
