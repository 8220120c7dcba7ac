"""All indicators by name, stops that trail, and runs listed from file names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import registry
from tidewright.operators import indicators, prefixes, risk, trades
from tidewright.sources import market

SMALL = "/root/testdata/sf0.001"
ALL = "RSI EMA SMA WMA DEMA TEMA MACD STOCH CCI WILLR ROC ADX ATR BBANDS KC DONCHIAN OBV VWAP MFI ICHIMOKU VOLSMA KAMA VIDYA FRAMA ADAPTIVE_RSI".split()


def test_all_indicators_have_names(spark):
    assert set(ALL) <= set(registry.names())
    bars = market.klines(spark, SMALL)
    wide = indicators.with_window_indicators(indicators.with_recursive_indicators(bars))
    want = {(r.symbol, r.open_time): r for r in wide.collect()}
    for name, column in (("KC", "kc_middle"), ("ADX", "adx"), ("VWAP", "vwap"), ("STOCH", "stoch_k"), ("DONCHIAN", "dc_middle"), ("MACD", "macd"), ("CCI", "cci")):
        got = registry.add(bars.withColumn(column, F.lit(1.0)), name, "x").collect()
        assert len(got) == len(want)
        for r in got:
            assert r.x is None and want[r.symbol, r.open_time][column] is None or r.x == pytest.approx(want[r.symbol, r.open_time][column], rel=1e-9, abs=1e-9), name
    with pytest.raises(ValueError, match="no parameters"):
        registry.add(bars, "KC", periods=3)


def test_stops_trail_and_never_loosen(spark):
    rng = random.Random(1)
    rows = [(p, d, t * 86_400_000, 100 + rng.random() * 10, 1.0) for p, d in ((1, "LONG"), (2, "SHORT")) for t in range(100)]
    got = {(r.position_id, r.open_time): r for r in risk.trailing_stops(spark.createDataFrame(rows, "position_id long, direction string, open_time long, close double, atr double")).collect()}
    for p, side in ((1, 1), (2, -1)):
        best = None
        for _, _, t, close, _ in (r for r in rows if r[0] == p):
            r = got[p, t]
            assert r.stopped == (best is not None and side * close <= best)
            best = max(x for x in (best, side * close - 2) if x is not None)
            assert r.stop == pytest.approx(side * best)


def test_runs_from_file_names(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    market.write_events(spark.createDataFrame([("1", "x", r) for r in ("007", "a b", "r+1", "r%2")], "ts string, event string, run_id string"), path)
    listing = market.list_runs(spark, path)
    assert [r.run_id for r in listing.collect()] == sorted(["007", "a b", "r+1", "r%2"])
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "content" not in plan


@pytest.mark.parametrize("span", [prefixes.SPAN, 1000, 10**15])
def test_values_carried_from_part_to_part(spark, monkeypatch, span):
    """Equity, peaks, drawdown and streaks of runs cut into many parts, into one, with null keys and times."""
    rng = random.Random(2)
    rows = [(r, rng.choice([None, rng.randrange(20_000)]), i, 0, 0, float(rng.choice([-2, -1, 0, 1, 2, 3]))) for r in (1, 2, None) for i in range(80)]
    df = spark.createDataFrame(rows, "run_id long, exit_time long, order_id long, line long, part_id long, net_pnl double")
    monkeypatch.setattr(prefixes.carried, "__defaults__", (span,))
    monkeypatch.setattr(prefixes.longest_runs, "__defaults__", (span,))
    got = trades.equity_curve(df, 10.0).collect()
    streaks = {r.run_id: (r.max_wins, r.max_losses) for r in trades.streaks(df).collect()}
    assert len(got) == len(rows)
    for run in (1, 2, None):
        equity, peak, run_of, best = 10.0, 10.0, (0, 0), {1: 0, -1: 0}
        own = {r.order_id: r for r in got if r.run_id == run}
        for _, _, i, _, _, pnl in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            equity += pnl
            peak = max(peak, equity)
            assert (own[i].equity, own[i].peak) == (equity, peak) and own[i].drawdown == pytest.approx((peak - equity) / peak)
            sign = (pnl > 0) - (pnl < 0)
            run_of = (sign, run_of[1] + 1 if sign == run_of[0] else 1)
            if sign:
                best[sign] = max(best[sign], run_of[1])
        assert streaks[run] == (best[1], best[-1])
