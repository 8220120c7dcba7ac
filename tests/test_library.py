"""Functions of the library that no query covers whole: errors, odd values, plug-ins, sinks and logs."""

from __future__ import annotations

import math
import random
import sys

import pytest
from pyspark.sql import functions as F

from tidewright.functions import conditions, dates, registry, scores
from tidewright.operators import catalog, indicators, overfitting, ranking, risk, runs, screening, timeseries, trades
from tidewright.sources import market
from tidewright.streaming import live, messages

SMALL = "/root/testdata/sf0.001"
BAR = "symbol string, open_time long, open double, high double, low double, close double, volume double, close_time long"


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_purge_stays_in_the_fold_before(spark):
    folds = overfitting.purged_folds(spark, 800, 5, 170, 10).collect()
    assert [f.before_to for f in folds] == [0, 0, 160, 320, 480]  # a fold has 160 rows: no more are purged
    with pytest.raises(ValueError, match="rows"):
        overfitting.purged_folds(spark, 100, 5, 20, 10)
    assert overfitting.gaps_of_folds(10_000) == (100, 100) and overfitting.gaps_of_folds(1000) == (50, 10)
    assert overfitting.gaps_of_folds(150) == (1, 1) and overfitting.gaps_of_folds(1000, lookback=70) == (70, 10)
    with pytest.raises(ValueError):
        overfitting.gaps_of_folds(60, lookback=30)


def test_too_few_windows_are_an_error(spark):
    assert overfitting.walk_forward_windows(spark, "2024-01-01", "2024-03-01").count() == 0
    with pytest.raises(ValueError, match="0 windows"):
        overfitting.walk_forward_windows(spark, "2024-01-01", "2024-03-01", least=8)


def test_conditions_with_odd_operands(spark):
    assert conditions.threshold_name("rsi.fast", -30.5) == "rsi_fast_neg_30_5_threshold"
    for bad in (lambda: conditions.between("x", 3, 3), lambda: conditions.compare("x", "==", "y")):
        with pytest.raises(ValueError):
            bad()
    assert one(spark, conditions.every([]), conditions.side(F.lit(True), F.lit(True)), conditions.side(F.lit(False), F.lit(False)), conditions.compare(1, ">", 2)) == (False, "LONG", None, False)
    assert one(spark, conditions.threshold("x", 7, ["y"])) == (7.0,)
    df = spark.createDataFrame([(None, 1.0), (2.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(conditions.compare("a", ">", "b")).collect()] == [False, True]


def test_sessions_and_weekdays_at_their_edges(spark):
    at = lambda day, clock: F.lit((19_723 + day) * 86_400_000 + clock)  # noqa: E731  day 0 is Monday, 1 January 2024
    hour = 3_600_000
    inside = lambda t: conditions.in_sessions(t, [("22:00", "02:00", "UTC")])
    assert one(spark, inside(at(0, 22 * hour)), inside(at(0, 2 * hour)), inside(at(0, 2 * hour + 1)), inside(at(0, 22 * hour - 1)), conditions.in_sessions(at(0, 0), [])) == (True, True, False, False, True)
    assert one(spark, *[conditions.blocked_weekday(at(d, 0), [0, 6]) for d in range(8)]) == (True, False, False, False, False, False, True, True)
    near = lambda t: conditions.near_funding(t, 5, 3)
    assert one(spark, near(at(0, 0)), near(at(0, 3 * 60_000)), near(at(0, 8 * hour - 5 * 60_000)), near(at(0, 8 * hour - 5 * 60_000 - 1)), near(at(0, 24 * hour - 1))) == (True, False, True, False, True)


def test_dates_and_intervals(spark):
    assert one(spark, *[dates.interval_seconds(F.lit(x)) for x in ("5s", "1m", " 4H", "2d")]) == (5, 60, 14_400, 172_800)
    assert one(spark, dates.interval_minutes(F.lit("30s")), dates.interval_minutes(F.lit("2d"))) == (0, 2880)
    for bad in ("5w", "m", ""):
        with pytest.raises(Exception, match="unknown interval"):
            one(spark, dates.interval_seconds(F.lit(bad)))
    day = lambda x: F.lit(x).cast("date")
    assert one(spark, dates.bar_count(day("2024-01-01"), day("2024-01-01"), F.lit(60)), dates.bar_count(day("2024-01-01"), day("2024-01-03"), F.lit(60)), dates.bar_count(F.lit(None).cast("date"), day("2024-01-03"), F.lit(60))) == (1, 48, None)
    assert [str(x) for x in one(spark, dates.years_ago(day("2024-02-29"), 1), dates.shifted(day("2024-01-31"), 1), dates.split_at(day("2024-01-01"), day("2024-01-11"), 0.75))] == ["2023-02-28", "2024-02-29", "2024-01-08"]
    with pytest.raises(Exception, match="fewer than two days"):
        one(spark, dates.split_at(day("2024-01-01"), day("2024-01-02"), 0.5))
    short = spark.sql("SELECT DATE'2024-01-01' AS start, DATE'2024-01-10' AS end")
    with pytest.raises(Exception, match="too short"):
        dates.windows_of(short, 2).collect()
    with pytest.raises(ValueError):
        dates.windows_of(short, 1)
    assert one(spark, dates.iso_of_ns(F.lit(1_706_659_032_194_062_999)), dates.iso_of_ns(F.lit(0))) == ("2024-01-30T23:57:12.194062+00:00", "1970-01-01T00:00:00+00:00")
    assert one(spark, dates.plain_symbol(F.lit("BTC-USD")), dates.dashed_symbol(F.lit("BTCUSD")), dates.dashed_symbol(F.lit("X"))) == ("BTCUSD", "BTC-USD", "X")


def test_normal_tail(spark):
    for z in (-6.0, -3.0, -0.5, 0.0, 0.1, 2.99, 3.01, 7.0):
        assert math.isclose(one(spark, scores.normal_tail(F.lit(z)))[0], 0.5 * math.erfc(z / 2**0.5), rel_tol=1e-12)
    assert one(spark, scores.normal_tail(F.lit(float("inf"))), scores.normal_tail(F.lit(float("-inf"))), scores.deflated_passes(F.lit(1.65)), scores.deflated_passes(F.lit(1.64))) == (0.0, 1.0, True, False)


def test_scores_of_odd_values(spark):
    with pytest.raises(ValueError):
        scores.stop_price("atr_fixed", F.lit(1.0), F.lit(True), 2)
    with pytest.raises(ValueError):
        scores.target_price("risk_reward", F.lit(1.0), F.lit(True), 2)
    sizes = one(spark, scores.strategy_size(F.lit(1000.0), F.lit(10.0)), scores.strategy_size(F.lit(1000.0), F.lit(10.0), F.lit(10.0)), scores.strategy_size(F.lit(1000.0), F.lit(10.0), F.lit(1e-9)), scores.fixed_fraction_size(F.lit(1000.0), 0.02, F.lit(5.0), F.lit(5.0)))
    assert sizes[:2] == (50.0, 50.0) and math.isclose(sizes[2], 2.0, rel_tol=1e-6) and sizes[3] is None
    maps = [F.create_map(F.lit("Other"), F.lit(1.0)), F.create_map(F.lit("Max DRAWDOWN"), F.lit(12.5)), F.create_map(F.lit("max drawdown"), F.lit(99.0))]
    assert one(spark, scores.statistic(maps, ["max drawdown"], percent=True), scores.statistic(maps[:1], ["x"])) == (0.125, None)
    assert one(spark, scores.overtrade_penalty(F.lit(400), F.lit("1h")), scores.overtrade_penalty(F.lit(400), F.lit("9w")), scores.overtrade_penalty(F.lit(400), 500), scores.complexity_penalty(F.lit(20))) == (0.05, 0.05, 0.0, 0.1)
    assert one(spark, scores.adjusted_score(F.lit(float("nan")), [F.lit(0.1)], F.lit(99), F.lit(1.0), 10), scores.adjusted_score(F.lit(0.9), [F.lit(0.1), F.lit(0.2)], F.lit(9), F.lit(1.0), 10)) == (0.0, 0.0)


def test_guarded_falls_back_on_soft_failures(spark):
    rows = spark.createDataFrame([(1, 100, 0.1, 3), (2, 10, 0.1, 3), (3, 100, -0.1, 9)], "run_id long, n long, total_return double, genes long")
    checked = runs.guardrails(rows)
    assert {r.run_id: (r.passed, r.reasons) for r in checked.collect()} == {1: (True, []), 2: (False, ["trades"]), 3: (False, ["return", "complexity"])}
    ids = lambda df: sorted(r.run_id for r in df.collect())
    assert ids(runs.guarded(checked, ["trades"])) == [1]
    assert ids(runs.guarded(checked.where("run_id > 1"), ["trades"])) == [] and ids(runs.guarded(checked.where("run_id > 1"), ["dsr"])) == [2, 3]


def test_extended_metrics_of_odd_runs(spark):
    day = 86_400_000
    rows = [(1, 0, day // 2, 0, 0, 0, -100_000.0, 10.0, 0.0), (2, 0, day * 365, 0, 0, 0, 50_000.0, 100.0, 0.0), (3, 0, day, 0, 0, 0, 0.0, 100.0, 0.0)]
    df = spark.createDataFrame(rows, "run_id long, entry_time long, exit_time long, order_id long, line long, part_id long, net_pnl double, notional double, fee double")
    got = {r.run_id: r for r in trades.extended(df).collect()}
    assert (got[1].cagr, got[1].days, got[1].calmar_ratio) == (-1.0, 1.0, -1.0) and math.isclose(got[2].cagr, 0.5) and got[3].cagr == got[3].calmar_ratio == got[3].volatility_annual == 0.0
    assert [r.max_drawdown for r in trades.max_drawdown(df, start=0.0).collect()] == [0.0] * 3
    growth = trades.compounded(df.withColumn("notional", F.lit(100_000.0)))
    assert {r.run_id: r.growth for r in growth.collect()}[1] == 0.0
    none = trades.exposure(df.withColumn("symbol", F.lit("S")), 0.0).collect()
    assert [tuple(r) for r in none] == [("S", 0.0, 0.0, 0.0)]
    bars = spark.createDataFrame([("S", 0, 1.0, 1.0, 1.0, 1.0, 0.0, 1), ("T", 0, 1.0, 1.0, 1.0, 0.0, 5.0, 1)], BAR)
    assert {tuple(r) for r in trades.market_stats(bars).collect()} == {("S", 1000.0, 0.02), ("T", 5.0, 0.02)}


def test_pareto_ranks_equal_peeling(spark):
    rng = random.Random(4)
    rows = [(g, i, *(float(rng.randrange(9)) for _ in range(3))) for g in range(2) for i in range(120)]
    got = {(r.generation, r.run_id): r.pareto_rank for r in ranking.pareto_ranks(spark.createDataFrame(rows, "generation long, run_id long, a double, b double, c double"), ["a", "b", "c"]).collect()}
    for g in range(2):
        left, rank = {r[1]: r[2:] for r in rows if r[0] == g}, 0
        while left:
            front = [i for i, x in left.items() if not any(all(p >= q for p, q in zip(y, x, strict=True)) and y != x for y in left.values())]
            assert all(got[(g, i)] == rank for i in front)
            left, rank = {i: x for i, x in left.items() if i not in front}, rank + 1


def test_pareto_front_of_many_partitions(spark):
    rows = spark.range(3000).select(F.col("id").alias("run_id"), *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1.0).alias(k) for k in "abc"]).repartition(40)
    found = {r.run_id for r in screening.pareto_front(rows, list("abc")).collect()}
    all_ = {r.run_id: (r.a, r.b, r.c) for r in rows.collect()}
    assert found == {i for i, x in all_.items() if not any(all(p >= q for p, q in zip(y, x, strict=True)) and y != x for y in all_.values())}


def test_chromosome_distance(spark):
    gene = lambda name, x: F.struct(F.lit(name).alias("indicator"), F.lit(">").alias("condition"), F.lit(x).alias("threshold"), F.create_map(F.lit("period"), F.lit(x)).alias("parameters"))
    genome = lambda entry, exit_, direction, stop: F.struct(F.array(*entry).alias("entry"), F.array(*exit_).alias("exit"), F.lit(direction).alias("direction"), F.lit(stop).alias("stop"), F.lit(2.0).alias("target"))
    distance = lambda x, y: ranking.gene_distance(x, y, {"RSI": 50.0}, {"RSI": {"period": (0.0, 50.0)}})
    a, b = genome([gene("RSI", 10.0)], [gene("EMA", 5.0)], "LONG", 1.0), genome([gene("RSI", 20.0), gene("ADX", 1.0)], [gene("EMA", 5.0)], "BOTH", 2.0)
    # Genes: RSI 0.2 + 0.2 of 5; one missing; EMA's parameters unknown, 0.5 of 5. Direction 1/2, stop 1 of 10.
    want = ((0.4 / 5 + 1 + 0.5 / 5) / 3 * 3 + 0.5 + 0.1 * 0.5) / 5
    got = one(spark, ranking.chromosome_distance(a, b, distance, 10.0, 10.0), ranking.chromosome_distance(a, a, distance, 10.0, 10.0), distance(gene("RSI", 1.0), gene("ADX", 1.0)))
    assert math.isclose(got[0], want) and math.isclose(got[1], (0.5 / 5) / 2 * 3 / 5) and math.isclose(got[2], 0.8)


def test_recursion_does_not_depend_on_batches(spark):
    bars = market.klines(spark, SMALL)
    whole = {(r.symbol, r.open_time): r for r in indicators.with_recursive_indicators(bars).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pieces = indicators.with_recursive_indicators(bars).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(pieces) == len(whole)
    for r in pieces:
        for name in (x.split()[0] for x in indicators.RECURSIVE.split(", ")):
            x, y = r[name], whole[(r.symbol, r.open_time)][name]
            assert x is None and y is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    with pytest.raises(ValueError, match="no periods"):
        indicators.recursive_indicators({"emma": 3})


def test_textbook_macd_dema_vidya_and_adx(spark):
    rows = sorted(indicators.with_recursive_indicators(market.klines(spark, SMALL).where("symbol = 'click'")).collect(), key=lambda r: r.open_time)
    close = [r.close for r in rows]

    def smooth(xs, n, alpha):
        out, seen, y = [], [], None
        for x in xs:
            if x is None:
                out.append(None)
                continue
            if y is None:
                seen.append(x)
                y = sum(seen) / n if len(seen) == n else None
            else:
                y += alpha * (x - y)
            out.append(y)
        return out

    same = lambda x, y: x is None and y is None or math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-8)
    one_ = smooth(close, 14, 2 / 15)
    two = smooth(one_, 14, 2 / 15)
    assert all(same(r.dema, None if b is None else 2 * a - b) for r, a, b in zip(rows, one_, two, strict=True))
    macd = [None if a is None or b is None else a - b for a, b in zip(smooth(close, 12, 2 / 13), smooth(close, 26, 2 / 27), strict=True)]
    assert all(same(r.macd_signal, s) for r, s in zip(rows, smooth(macd, 9, 0.2), strict=True))
    y = None
    for i, r in enumerate(rows):
        if i < 14:
            assert r.vidya is None
            continue
        moves = [close[k] - close[k - 1] for k in range(i - 13, i + 1)]
        ratio = abs(sum(moves)) / sum(map(abs, moves))
        y = (close[i - 1] if y is None else y) + ratio * 2 / 15 * (close[i] - (close[i - 1] if y is None else y))
        assert same(r.vidya, y)
    up = [None] + [max(b.high - a.high, 0) if b.high - a.high > a.low - b.low else 0 for a, b in zip(rows, rows[1:], strict=False)]
    down = [None] + [max(a.low - b.low, 0) if a.low - b.low > b.high - a.high else 0 for a, b in zip(rows, rows[1:], strict=False)]
    p, m = smooth(up, 14, 1 / 14), smooth(down, 14, 1 / 14)
    dx = [None if a is None else 100 * abs(a - b) / (a + b) if a + b else 0.0 for a, b in zip(p, m, strict=True)]
    assert all(same(r.adx, x) for r, x in zip(rows, smooth(dx, 14, 1 / 14), strict=True))


def test_registry(spark, tmp_path):
    with pytest.raises(ValueError):
        registry.Indicator("NOTHING", ("x",))
    with pytest.raises(ValueError):
        registry.Indicator("BAD", ("x",), columns=lambda: {}, primary="y")
    folder = tmp_path / "plugs"
    folder.mkdir()
    (folder / "__init__.py").write_text("")
    (folder / "good.py").write_text("from pyspark.sql import functions as F\nfrom tidewright.functions import registry\n\n@registry.indicator('HALF', ('value',), defaults={'k': 2})\ndef half(k):\n    return {'value': F.col('close') / k}\n")
    (folder / "broken.py").write_text("raise RuntimeError('no')\n")
    sys.path.insert(0, str(tmp_path))
    try:
        import plugs

        assert registry.load_plugins(plugs) == ["plugs.good"]
    finally:
        sys.path.remove(str(tmp_path))
    bars = market.klines(spark, SMALL)
    got = registry.add(bars, "half", k=4).first()
    assert got.half == got.close / 4 and registry.known("DONCHIAN").bare == "middle"
    with pytest.raises(ValueError, match="no parameters"):
        registry.add(bars, "HALF", period=3)
    registry.register(registry.Indicator("HALF", ("value",), columns=lambda: {"value": F.lit(1.0)}))
    assert registry.add(bars, "HALF").first().half == 1.0
    both = registry.add(registry.add(bars, "EMA", "e", period=5), "FRAMA", "f").where("e IS NOT NULL").count()
    assert both == bars.count() - 4 * bars.select("symbol").distinct().count()


def test_sinks_logs_and_scans(spark, tmp_path):
    path = f"file://{tmp_path}"
    bars = spark.createDataFrame([("S", i, 1.0, 2.0, 0.5, 1.235 + i, 3.0, i + 1) for i in range(4)], BAR)
    with pytest.raises(ValueError, match="unknown columns"):
        catalog.append_checked(bars, f"{path}/a", ["symbol"])
    for _ in range(2):
        catalog.append_checked(bars, f"{path}/a", bars.columns)
    assert spark.read.parquet(f"{path}/a").count() == 8
    catalog.export_csv(bars, f"{path}/csv", ["open_time"])
    back = market.read_kline_csv(spark, f"{path}/csv").count()
    assert back == 0 and spark.read.option("header", True).csv(f"{path}/csv").count() == 4  # its first field is no time
    bars.drop("symbol").write.csv(f"{path}/k")
    assert [r.open_time for r in market.read_kline_csv(spark, f"{path}/k", 1, 2).collect()] == [1, 2]
    stored = catalog.bars_of_klines(bars).orderBy("ts_event").collect()
    assert [r.close for r in stored] == [1.24, 2.24, 3.24, 4.24] and stored[1].ts_event == 1_000_000
    times = spark.createDataFrame([(0, 1), (1, 0), (1, 1)], "ts_event long, ts_init long")
    assert market.valid_bars(times).count() == 1
    events = spark.createDataFrame([("2", "OPEN", "r1", "s", {"x": "1"}), ("1", "CLOSE", "r2", "s", None)], market.EVENT)
    market.write_events(events, f"{path}/log")
    assert [r.run_id for r in market.list_runs(spark, f"{path}/log").collect()] == ["r1", "r2"] and [r.ts for r in market.read_events(spark, f"{path}/log").collect()] == ["1", "2"]
    (tmp_path / "job.log").write_text("a\nb\nc\n")
    assert [(r.id, r.line) for r in live.lines_after(spark, f"{path}/job.log", 1).collect()] == [(1, "b"), (2, "c")]
    (tmp_path / "logs").mkdir()
    for k in range(2):
        (tmp_path / "logs" / f"{k}.log").write_text(f"line {k}\n")
        live.go_on(live.follow_log(spark, f"{path}/logs"), f"{path}/lines", f"{path}/at", None).awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(f"{path}/lines").collect()) == ["line 0", "line 1"]
    assert [r.kind for r in catalog.verify(bars, 5).collect()] == ["candle"] * 5 or catalog.verify(bars, 5).count() > 0
    plan = catalog.footer_summary(spark, f"{SMALL}/lineitem.parquet", "l_orderkey")._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT" in plan


def test_messages_with_missing_fields(spark):
    rows = [("MarketPrice", '{"symbol": "BTC-USD"}'), ("MarketPrice", "[]"), ("BookDepth", '{"symbol": "X", "timestamp": 5, "bids": [["1.5", "2"]]}'), ("FundingRate", '{"symbol": "X", "fundingRate": "0.0001", "nextFundingTime": 7}')]
    feed = spark.createDataFrame(rows, "channel string, value string")
    assert [(r.symbol, r.time, float(r.price), float(r.size)) for r in messages.market_prices(feed).collect()] == [("BTCUSD", 0, 0.0, 0.0)]
    book = messages.book_depth(feed).first()
    assert float(book.bids[0].price) == 1.5 and book.asks == []
    assert messages.funding_rates(feed).first().next_time == 7


def test_breaker_without_cooldown_stays(spark):
    states = spark.createDataFrame([(1, i * 86_400_000, i, 0, 0, 0.5 if i == 2 else 0.0, 0.0, 1.0, 0) for i in range(5)], "run_id long, exit_time long, order_id long, line long, part_id long, drawdown double, daily_pnl double, day_start_equity double, loss_streak long")
    got = lambda hours: [r.state for r in risk.strategy_breaker(states, cooldown_hours=hours).orderBy("exit_time").collect()]
    assert got(0) == ["ACTIVE", "ACTIVE", "HALTED", "HALTED", "HALTED"] and got(24) == ["ACTIVE", "ACTIVE", "HALTED", "ACTIVE", "ACTIVE"]
    rows = states.select(F.lit("p").alias("portfolio"), F.col("exit_time").alias("time"), "drawdown")
    assert [(r.state, r.size_scale) for r in risk.portfolio_breaker(rows, {"drawdown": 0.5}).orderBy("time").collect()] == [("ACTIVE", 1.0), ("ACTIVE", 1.0), ("HALTED", 0.0), ("COOLDOWN", 0.5), ("ACTIVE", 1.0)]
    assert one(spark, *[F.round(risk.drawdown_scale(F.lit(d), 0.1, 0.2), 9) for d in (-0.1, 0.05, 0.1, 0.15, 0.2, 0.9)]) == (1.0, 0.75, 0.5, 0.25, 0.0, 0.0)


def test_reports_of_empty_tables(spark):
    none = spark.createDataFrame([], BAR)
    assert catalog.rebuild(none).count() == catalog.verify(none).count() == timeseries.regimes(none, 1000).count() == 0
    assert catalog.missing_rows(none, none).count() == indicators.with_recursive_indicators(none).count() == 0
    assert one(spark, catalog.row_count_ok(F.lit(0), F.lit(0)), catalog.row_count_ok(F.lit(1), F.lit(0)), catalog.row_count_ok(F.lit(99), F.lit(100)), catalog.row_count_ok(F.lit(98), F.lit(100))) == (True, False, True, False)
    jobs = spark.createDataFrame([(1, "RUNNING", None, None), (2, "RUNNING", 10, None), (3, "DONE", None, None), (4, "RUNNING", 0, 130_000)], "job long, status string, started long, heartbeat long")
    assert sorted(r.job for r in catalog.stale(jobs, F.lit(200_000)).collect()) == [1, 2]
