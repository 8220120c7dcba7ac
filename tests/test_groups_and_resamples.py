"""Groups of near rows by rounds, and bootstraps of runs cut into chunks."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from tidewright.operators import overfitting, ranking


def _loop(rows, distance):
    founders, out = [], {}
    for key, _, a, b, m in sorted(rows, key=lambda r: (-r[1], r[0])):
        near = [k for k, x, y, w in founders if (abs(x - a) + abs(y - b) + (w != m)) / 3 < distance]
        if not near:
            founders.append((key, a, b, m))
        out[key] = near[0] if near else key
    return out


@pytest.mark.parametrize(("block", "n", "distance"), [(1, 40, 0.3), (7, 2000, 0.3), (4096, 2000, 0.05)])
def test_groups_equal_the_loop(spark, block, n, distance):
    rng = random.Random(block)
    rows = [(k, float(rng.randrange(50)), rng.random(), rng.random(), rng.choice("xy")) for k in range(n)]
    rows += [(n + k, 9.0, 0.5, 0.5, "x") for k in range(n)]  # repeated rows
    df = spark.createDataFrame(rows, "run_id long, score double, a double, b double, m string")
    assert {r.run_id: r.founder for r in ranking.groups_of_near(df, ["a", "b"], ["m"], distance, block=block).collect()} == _loop(rows, distance)


def test_groups_of_odd_rows(spark):
    schema = "run_id long, score double, a double"
    df = spark.createDataFrame([(1, 2.0, None), (2, 1.0, None), (3, None, 0.5), (4, 0.5, 0.5)], schema)
    assert {r.run_id: r.founder for r in ranking.groups_of_near(df, ["a"]).collect()} == {1: 1, 2: 2, 3: 4, 4: 4}
    assert ranking.groups_of_near(df.limit(0), ["a"]).count() == 0


def test_chunks_of_a_run_give_the_interval_of_the_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.1, 1.0, 1050)
    rows = [(1, i, float(v)) for i, v in enumerate(x)] + [(1, 5000, None)] + [(2, i, float(v)) for i, v in enumerate(x[:90])] + [(3, i, 0.25) for i in range(300)] + [(4, 0, None)]
    df = spark.createDataFrame(rows, "run_id long, at long, r double")
    got = {r.run_id: r for r in overfitting.bootstrap_rows(df, "r", ["at"], chunk=100).collect()}
    drawn = x[np.random.default_rng(8).integers(0, len(x), (10_000, len(x)))]
    ratios = drawn.mean(1) / drawn.std(1, ddof=1) * len(x) ** 0.5
    low, high = np.quantile(ratios, [0.025, 0.975])
    # Ends of two bootstraps of 10,000 resamples differ by some hundredths of the ratio's deviation of about 1.
    assert abs(got[1].low - low) < 0.12 and abs(got[1].high - high) < 0.12 and got[1].passed == (got[1].low >= 1.0)
    small = x[:90][np.random.default_rng(42).integers(0, 90, (10_000, 90))]
    assert np.isclose(got[2].low, np.quantile(small.mean(1) / small.std(1, ddof=1) * 90**0.5, 0.025))
    assert (got[3].low, got[3].high) == (0.0, 0.0) and got[4].low == float("-inf") and not got[4].passed
    again = {r.run_id: r for r in overfitting.bootstrap_rows(df.repartition(7), "r", ["at"], chunk=100).collect()}
    assert np.isclose(again[1].low, got[1].low, rtol=1e-9)


def test_runs_of_one_length_share_their_draws(spark):
    rng, n = np.random.default_rng(5), 300
    first = np.arange(n) == 0
    odd = [rng.normal(0, 0.03, n), np.full(n, 0.1), np.where(first, 1e6, rng.normal(1, 1, n)), np.where(first, 1.0, 0.3), np.where(first, np.nan, rng.normal(size=n)), rng.integers(0, 3, n) * 1.0, rng.normal(0, 1e-11, n)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(odd)] + [(90, odd[0][:5].tolist()), (91, [None, *odd[0][:7].tolist(), None])], "run_id long, returns array<double>")
    got = {r.run_id: (r.low, r.high) for r in overfitting.bootstrap_sharpe(df).collect()}
    for name, x in [*enumerate(odd), (90, odd[0][:5]), (91, odd[0][:7])]:
        drawn = x[np.random.default_rng(42).integers(0, len(x), (10_000, len(x)))]
        dev = drawn.std(1, ddof=1)
        want = np.quantile(np.where(dev < 1e-10, 0.0, drawn.mean(1) / np.where(dev < 1e-10, 1.0, dev) * len(x) ** 0.5), [0.025, 0.975])
        assert np.allclose(np.array(got[name], float), want, rtol=1e-9, atol=0, equal_nan=True)
    # 128 runs take the draws of one: far less than 128 times its seconds.
    spent = []
    for m in (1, 128):
        began = time.process_time()
        overfitting._intervals(rng.normal(0, 1, (m, n)), 10_000, 0.95, 42)
        spent.append(time.process_time() - began)
    assert spent[1] < 40 * spent[0]
