"""Recursions in chunks against the same in one piece, and against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bench import many_bars
from tidewright.operators import indicators, scans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(many_bars(spark, SMALL).collect())


def same_rows(a, b, names, keys=("symbol", "open_time")):
    a, b = ({tuple(r[k] for k in keys): r for r in x} for x in (a, b))
    assert a.keys() == b.keys()
    for k, r in a.items():
        for n in names:
            x, y = r[n], b[k][n]
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (k, n, x, y)


@pytest.mark.parametrize("rows", [64, 500])
def test_indicators_do_not_depend_on_chunks(spark, bars, rows):
    for whole, pieces, names in (
        (indicators.with_window_indicators(bars), indicators.with_window_indicators(bars, rows=rows), indicators.WindowIndicators.names),
        (indicators.with_recursive_indicators(bars), indicators.with_recursive_indicators(bars, rows=rows), [x.split()[0] for x in indicators.RECURSIVE.split(", ")]),
    ):
        assert pieces.columns == whole.columns
        same_rows(whole.collect(), pieces.collect(), names)


def test_drifting_averages_that_hardly_move(spark):
    """VIDYA's weight may be zero for long, so nothing of an early state may be lost."""
    rng = random.Random(1)
    rows = [("s", i, 1.0, 1.0, 1.0, 10.0 + (i % 2 if i > 100 else rng.random()), 1.0, i) for i in range(900)]
    flat = spark.createDataFrame(rows, "symbol string, open_time long, open double, high double, low double, close double, volume double, close_time long")
    same_rows(indicators.with_recursive_indicators(flat).collect(), indicators.with_recursive_indicators(flat, rows=64).collect(), ["vidya", "kama", "adaptive_rsi", "adx"])


def test_numbers_of_rows(spark):
    """Keys within a part, over several parts, null keys, and rows that repeat."""
    rows = [(k, i) for k, n in ((None, 40), ("a", 700), ("b", 1), ("c", 3), ("d", 300)) for i in range(n)] + [("c", 1)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long").repartition(5)
    for batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = scans.numbered(df, ["k"], ["i"]).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        by = {}
        for r in got:
            by.setdefault(r.k, []).append((r["__row"], r.i))
        want = {}
        for k, i in sorted(rows, key=lambda r: r[1]):
            want.setdefault(k, []).append(i)
        assert {k: [i for _, i in sorted(v)] for k, v in by.items()} == want and all(sorted(n for n, _ in v) == list(range(len(v))) for v in by.values())


def test_rolling_extremes():
    rng = np.random.default_rng(0)
    for size in (0, 1, 5, 9, 10, 11, 57):
        x = rng.random(size)
        got = indicators._rolling(x, 5, np.maximum)
        assert [None if math.isnan(v) else v for v in got.tolist()] == [max(x[i - 4 : i + 1]) if i >= 4 else None for i in range(size)]


def test_chunks_that_are_too_short(spark, bars):
    with pytest.raises(ValueError, match="too short"):
        indicators.with_window_indicators(bars, rows=20)
    assert indicators.with_window_indicators(bars.where("1 = 0")).count() == 0
    assert "__row" not in indicators.with_window_indicators(bars.withColumn("extra", F.lit(1)), rows=200).columns
