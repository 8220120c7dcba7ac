"""Steps whose work must not grow faster than their input: logs of many runs, streaks, summaries over what is long to compute."""

from __future__ import annotations

import os
import random
import statistics

from tidewright.operators import prefixes, runs
from tidewright.sources import market
from tidewright.streaming import live


def test_a_log_of_many_runs_has_few_folders(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:04d}", "error" if i % 3 else "fill", f"r {i % 300}", "s", {"id": str(i)}) for i in range(900)], market.EVENT)
    market.write_events(rows.repartition(7), f"file://{tmp_path}/log", groups=8)
    market.write_events(rows.where("run_id = 'r 5'"), f"file://{tmp_path}/log", groups=8)
    folders = [f for f in os.listdir(tmp_path / "log") if f.startswith("run_group=")]
    files = [f for g in folders for f in os.listdir(tmp_path / "log" / g) if f.endswith(".json")]
    assert 1 < len(folders) <= 8 and len(files) == len(folders) + 1
    got = market.read_events(spark, f"file://{tmp_path}/log")
    assert got.columns == rows.columns and got.count() == 903 and {r.run_id for r in got.collect()} == {f"r {i}" for i in range(300)}
    assert market.read_events(spark, f"file://{tmp_path}/log", "fill").count() == 300 + (3 if 5 % 3 == 0 else 0)


def test_streaks_sort_their_rows_once(spark):
    rng = random.Random(3)
    rows = [(k, None if rng.random() < 0.02 else rng.randrange(400), i, rng.choice([-1, -1, 0, 1, 1, 1, None])) for k in range(12) for i in range(rng.choice([1, 2, 300]))]
    df = spark.createDataFrame(rows, "k long, t long, i long, s int")
    found = prefixes.longest_runs(df, "k", ["t", "i"], df["s"], span=25)
    want = {}
    for k in range(12):
        best, last, n = {1: 0, -1: 0}, 7, 0
        for s in [r[3] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]:
            n = n + 1 if s == last else 1
            last = s
            if s in best:
                best[s] = max(best[s], n)
        want[k] = (best[1], best[-1])
    assert {r.k: (r.max_wins, r.max_losses) for r in found.collect()} == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") >= 1
    initial = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert initial.count("Sort [") == 1, initial


def test_summaries_compute_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(i % 3, i % 5, i, (i * 37 % 101) / 10, float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "group_id long, seed long, strategy long, sharpe double, score double")
    got = {r.group_id: r.median for r in runs.seed_summary(df.mapInPandas(count, df.schema)).collect()}
    assert got == {g: statistics.median([r[3] for r in rows if r[0] == g]) for g in range(3)} and seen.value == len(rows)
    for f in (lambda d: runs.monte_carlo(d), lambda d: runs.generation_stats(d, "group_id")):
        before = seen.value
        f(df.mapInPandas(count, df.schema)).collect()
        assert seen.value - before == len(rows)


def test_breaker_takes_columns_along(spark, tmp_path):
    schema = "run_id long, seq long, exit_time long, net_pnl double, note string, n int"
    batches = [[(1, 2, 86_400_000, -9_000.0, "b", 2), (1, 1, 0, 5.0, "a", 1), (2, 1, 0, 1.0, None, 5)], [(1, 2, 86_400_000, -9_000.0, "again", 9), (1, 3, 86_400_001, 1.0, "c", 3), (1, 3, 86_400_001, 1.0, "c", 3)], [(1, 1, 0, 5.0, "late", 9)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        found = live.live_breaker(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), keep=["note", "n"])
        live.go_on(found, f"file://{tmp_path}/out", f"file://{tmp_path}/at", None).awaitTermination()
    got = sorted((r.run_id, r.seq, r.state, r.reason, r.note, r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [(1, 1, "ACTIVE", None, "a", 1), (1, 2, "HALTED", "daily_loss", "b", 2), (1, 3, "HALTED", None, "c", 3), (2, 1, "ACTIVE", None, None, 5)]
