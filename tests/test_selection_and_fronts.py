"""Order statistics by rounds, fronts by staircases and streaks by a stack, against plain loops."""

from __future__ import annotations

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from tidewright.operators import ranking, runs, screening, selection


def test_percentiles_of_large_groups(spark):
    """Spread over many powers of ten, ties, negative and infinite values, nulls, and groups of few."""
    rng = random.Random(6)
    data = {"wide": [10 ** rng.uniform(-9, 9) * rng.choice([-1, 1]) for _ in range(3001)], "ties": [float(rng.randrange(4)) for _ in range(2500)], "same": [7.0] * 900, "few": [1.0, 2.0, 4.0], "one": [5.0], "none": []}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [(g, None) for g in data] + [("few", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    wanted = {"median": 0.5, "p5": 0.05, "p95": 0.95, "least": 0.0}
    for buffer in (10, 500, 10**6):
        got = {r.g: r for r in selection.percentiles(df, ["g"], "v", wanted, buffer).collect()}
        assert got.keys() == data.keys()
        for g, vs in data.items():
            for name, p in wanted.items():
                assert got[g][name] is None if not vs else abs(got[g][name] - np.quantile(vs, p)) <= 1e-9 * abs(np.quantile(vs, p)), (buffer, g, name)
    whole = [v for _, v in rows if v is not None and v == v]
    assert abs(selection.percentiles(df, [], "v", {"m": 0.5}, 50).first().m - statistics.median(whole)) < 1e-12
    ends = spark.createDataFrame([("x", float(v)) for v in [*range(300), "inf", "-inf"]], "g string, v double")
    assert selection.percentiles(ends, ["g"], "v", {"m": 0.5}, 20).first().m == 149.5
    assert selection.percentiles(df.limit(0), ["g"], "v", wanted, 10).count() == 0


def peeled(points):
    rank, left, k = {}, dict(points), 0
    while left:
        front = [i for i, p in left.items() if not any(all(a >= b for a, b in zip(q, p)) and any(a > b for a, b in zip(q, p)) for q in left.values())]  # noqa: B905
        for i in front:
            rank[i] = k
            del left[i]
        k += 1
    return rank


def test_ranks_of_fronts_equal_peeling(spark):
    rng = random.Random(7)
    for width in (1, 2, 3, 4):
        points = [(i, [rng.choice([rng.random(), rng.randrange(3) / 2]) for _ in range(width)]) for i in range(150)]
        names = list("abcd")[:width]
        df = spark.createDataFrame([(1, i, *p) for i, p in points] + [(2, 999, *[float("nan")] * width), (2, 998, *[0.0] * width)], "generation long, run_id long, " + ", ".join(f"{n} double" for n in names)).repartition(5)
        got = {r.run_id: r.pareto_rank for r in ranking.pareto_ranks(df, names).collect()}
        assert got == peeled(points) | {999: 0, 998: 0}
        front = {r.run_id for r in screening.pareto_front(df.where("generation = 1"), names).collect()}
        assert front == {i for i, k in got.items() if k == 0 and i < 900}


def test_a_hundred_thousand_points_on_an_anticorrelated_front(spark):
    x = F.rand(3)
    df = spark.range(100_000).select(F.lit(1).alias("generation"), F.col("id").alias("run_id"), x.alias("a"), (1 - x + 0.001 * F.rand(4)).alias("b"), F.rand(5).alias("c"))
    assert ranking.pareto_ranks(df, ["a", "b", "c"]).agg(F.max("pareto_rank"), F.count("*")).first()[1] == 100_000


def test_stagnation_by_a_stack_equals_loops(spark):
    rng = random.Random(8)
    rows = [(s, g, float(rng.randrange(9))) for s in "xyz" for g in range(60)]
    got = {(r.search, r.generation): (r.stagnant, r.converged) for r in runs.stagnation(spark.createDataFrame(rows, "search string, generation long, best double"), 3).collect()}
    for s in "xyz":
        best = [b for t, _, b in rows if t == s]
        for g in range(60):
            n = 0
            while g - 1 - n >= 0 and best[g - 1 - n] >= best[g]:
                n += 1
            assert got[s, g] == (n, g + 1 >= 6 and max(best[g - 2 : g + 1]) <= max(best[: g - 2])), (s, g)


def test_ranks_of_a_sort_are_whole(spark):
    df = spark.createDataFrame([(i, float(i % 17)) for i in range(500)], "run_id long, sharpe double").repartition(9)
    got = {r.run_id: r["rank"] for r in screening.ranked(df).collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((-float(i % 17), i) for i in range(500)), 1)}
