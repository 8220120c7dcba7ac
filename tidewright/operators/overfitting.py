"""Checks for overfitting: walk-forward windows, purged folds, bootstrap intervals and their totals."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.scans import numbered, written

def walk_forward_windows(spark: SparkSession, start: str, end: str, train: int = 270, test: int = 90, step: int = 30, touching: bool = False, least: int = 0) -> DataFrame:
    """Windows of `train` and `test` days every `step` days as long as the test fits before end. Dates
    are inclusive; where touching, a part ends on the day that the next begins. Fewer windows than `least`
    are an error."""
    first, last_day = date.fromisoformat(start), date.fromisoformat(end)
    over = 0 if touching else 1
    n = max(0, ((last_day - first).days - (train + test - over)) // step + 1)
    if n < least:
        raise ValueError(f"{n} windows between {start} and {end}, {least} wanted")
    rows = spark.range(n).select(F.date_add(F.lit(first), (F.col("id") * step).cast("int")).alias("train_start"))
    return rows.select("train_start", F.date_add("train_start", train - over).alias("train_end"), F.date_add("train_start", train).alias("test_start"), F.date_add("train_start", train + test - over).alias("test_end"))


def in_windows(rows: DataFrame, day: str, windows: DataFrame) -> DataFrame:
    """Each row with every window whose test part holds its day. Windows are exploded into days, of
    which there are few, so that this is an equi-join and not a range join."""
    days = windows.select("*", F.explode(F.sequence("test_start", "test_end")).alias("__day"))
    return rows.join(days, F.col(day) == F.col("__day")).drop("__day")


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    """One row of train_return, train_sharpe, test_return, test_sharpe of windows: their means, the mean loss
    of Sharpe ratio, efficiency, consistency, robust."""
    row = windows.agg(F.avg(F.col("train_sharpe") - F.col("test_sharpe")).alias("degradation"), F.count(F.lit(1)).alias("n"), F.avg("train_return").alias("train"), F.avg("test_return").alias("test"), F.avg("test_sharpe").alias("sharpe"), F.avg((F.col("test_return") > 0).cast("double")).alias("consistency"))
    efficiency = F.when(F.col("train") < 0.001, 0.0).otherwise(F.least(F.col("test") / F.when(F.col("train") >= 0.001, F.col("train")), F.lit(5.0)))
    return row.withColumn("efficiency", efficiency).withColumn("robust", (F.col("consistency") > 0.5) & (F.col("efficiency") > 0.5))


#: Rows of a fold at least, and rows that are purged by default where there are enough.
FOLD_ROWS, PURGED = 10, 50


def gaps_of_folds(n: int, k: int = 5, lookback: int | None = None, purge: float = 0.01, embargo: float = 0.01) -> tuple[int, int]:
    """Rows to purge before a test fold and to leave out after it. The look-back of the indicators sets the
    first; else it is a share of the rows, and PURGED at least where folds still have enough rows then.
    Too few rows for the folds and their gaps are an error."""
    after = int(n * embargo)
    before = lookback or int(n * purge)
    if not lookback and 0 < purge and before < PURGED <= max(before, (n - k * FOLD_ROWS) // max(1, k - 1) - after):
        before = PURGED
    needed = k * FOLD_ROWS + (before + after) * (k - 1)
    if n < needed:
        raise ValueError(f"{n} rows, {needed} wanted for {k} folds with gaps of {before} and {after}")
    return before, after


def purged_folds(spark: SparkSession, n: int, k: int = 5, purge: int = 50, embargo: int = 10) -> DataFrame:
    """fold, and per fold the bounds of its test rows [test_from, test_to) and of the rows to train on
    before [0, before_to) and after it [after_from, n). A row's part follows from its number. The purge
    takes rows of the fold right before only, and the embargo of the fold right after."""
    needed = k * FOLD_ROWS + (purge + embargo) * (k - 1)
    if n < needed:
        raise ValueError(f"{n} rows, {needed} wanted for {k} folds with gaps of {purge} and {embargo}")
    size = n // k
    rows = spark.range(k).select(F.col("id").cast("int").alias("fold"), (F.col("id") * size).alias("test_from"), F.when(F.col("id") == k - 1, n).otherwise((F.col("id") + 1) * size).cast("long").alias("test_to"))
    before_end = F.when(F.col("fold") == 0, F.lit(0)).otherwise(F.greatest(F.col("test_from") - size, F.col("test_from") - purge))
    next_end = F.when(F.col("fold") >= k - 2, F.lit(n)).otherwise(F.col("test_to") + size)
    return rows.select("*", before_end.cast("long").alias("before_to"), F.least(next_end, F.col("test_to") + embargo).cast("long").alias("after_from"))


def fold_summary(folds: DataFrame) -> DataFrame:
    row = folds.agg(F.avg("sharpe").alias("mean"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("dev"))
    return row.withColumn("robust", (F.col("mean") > 0.5) & (F.col("dev") < 1.0))


#: Tasks that runs of one length are dealt to at most, and runs that are resampled together.
SHARES, TOGETHER = 32, 128


def _intervals(x, resamples: int, level: float, seed: int):  # noqa: ANN001, ANN202
    """Low and high ends for each row of x, runs of one length. Draws depend on seed and length alone, so these rows share them: how
    often each place was drawn, times values and their squares, gives all their sums. Where a sum of squares cancels
    or is not finite, the drawn values themselves are taken."""
    import numpy as np

    m, n = x.shape
    with np.errstate(all="ignore"):
        centre = x.mean(1)
        apart = x - centre[:, None]
        both = np.concatenate([apart, apart * apart]).T
        equal = x.max(1) == x.min(1)
        rng, ratios, at = np.random.default_rng(seed), np.empty((m, resamples)), 0
        while at < resamples:  # a few million draws at a time
            some = min(resamples - at, max(1, 2_000_000 // n))
            places = rng.integers(0, n, (some, n)) + np.arange(some)[:, None] * n
            times = np.bincount(places.ravel(), minlength=some * n).reshape(some, n)
            sums = times.astype(float) @ both
            s, q = sums[:, :m].T, sums[:, m:].T
            square = q - s * s / n
            found = (centre[:, None] + s / n) / np.sqrt(square / (n - 1)) * n**0.5
            found[np.sqrt(square / (n - 1)) < 1e-10] = 0.0
            for i in np.flatnonzero(~(square > 1e-4 * q).all(1) & ~equal):
                rows = np.flatnonzero(~(square[i] > 1e-4 * q[i]))
                drawn = np.broadcast_to(x[i], (len(rows), n)).ravel().repeat(times[rows].ravel()).reshape(len(rows), n)
                dev = drawn.std(1, ddof=1)
                found[i, rows] = np.where(dev < 1e-10, 0.0, drawn.mean(1) / np.where(dev < 1e-10, 1.0, dev) * n**0.5)
            found[equal] = 0.0
            ratios[:, at : at + some] = found
            at += some
        return np.quantile(ratios, [(1 - level) / 2, (1 + level) / 2], axis=1)


def bootstrap_sharpe(returns: DataFrame, key: str = "run_id", resamples: int = 10_000, level: float = 0.95, seed: int = 42, min_sharpe: float = 1.0) -> DataFrame:
    """Per row of (key, returns array) the interval of the Sharpe ratio over resamples drawn with
    replacement; without bounds for fewer than five returns. passed says that low is min_sharpe at least.
    Runs are dealt out again, as their arrays are small and the resampling is long: by their lengths, as runs of one length
    have the same draws, which a task makes once; a common length is SHARES tasks' work."""
    kind, parts = dict(returns.dtypes)[key], int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def found(names: list, held: list):  # noqa: ANN202
            low, high = _intervals(np.stack(held), resamples, level, seed) if len(held[0]) >= 5 else (np.full(len(held), -np.inf), np.full(len(held), np.inf))
            return pd.DataFrame({key: names, "low": low, "high": high, "passed": (low >= min_sharpe)})

        names, held = [], []
        for batch in batches:
            for name, own in zip(batch[key], batch["returns"], strict=True):
                x = np.asarray(own, float)
                if held and (len(x) != len(held[0]) or len(held) >= TOGETHER or len(held) * len(x) > 2_000_000):
                    yield found(names, held)
                    names, held = [], []
                names.append(name)
                held.append(x)
        if held:
            yield found(names, held)

    rows = returns.select(key, F.array_compact("returns").alias("returns")).withColumn("__n", F.size("returns"))
    dealt = rows.repartition(parts, "__n", F.pmod(F.xxhash64(key), F.lit(SHARES))).sortWithinPartitions("__n").select(key, "returns")
    return dealt.mapInPandas(run, f"`{key}` {kind}, low double, high double, passed boolean")


#: Returns of a run that one task resamples.
RUN_ROWS = 100_000


def bootstrap_rows(rows: DataFrame, value: str, order: list[str], key: str = "run_id", resamples: int = 10_000, level: float = 0.95, seed: int = 42, min_sharpe: float = 1.0, chunk: int = RUN_ROWS) -> DataFrame:
    """bootstrap_sharpe of each key's values, a row for each, in total order; nulls take no part.

    A run of more than `chunk` values is cut into chunks. How many of a resample's draws fall into each is
    multinomial: halves of the chunks split a number of draws by a binomial with a seed of their own, so that each chunk
    finds its numbers alone, and all of a resample add up to n. A chunk draws its own and gives sums and sums of
    squares of differences from the run's mean, which are added up for each resample."""
    own = rows.select(key, *order, F.col(value).cast("double").alias("__x"))
    counts = written(own.groupBy(key).agg(F.count("__x").alias("__n"), F.avg("__x").alias("__mean")), "counts")
    large = counts.where(F.col("__n") > chunk)
    hot = bool(large.limit(1).count())
    few = own.join(large.select(key), key, "left_anti") if hot else own
    small = bootstrap_sharpe(few.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col("__x").alias("x")))), lambda r: r["x"]).alias("returns")), key, resamples, level, seed, min_sharpe)
    if not hot:
        return small
    kind, parts = dict(rows.dtypes)[key], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def draw(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, at, n, mean, values in zip(batch[key], batch["__chunk"], batch["__n"], batch["__mean"], batch["xs"], strict=True):
                x, low, high = np.asarray(values, float) - mean, 0, -(-n // chunk)
                wanted = np.full(resamples, n)
                while high - low > 1:
                    middle, end = (low + high) // 2, min(n, high * chunk)
                    left = np.random.default_rng([seed, low, high]).binomial(wanted, (middle - low) * chunk / (end - low * chunk))
                    low, high, wanted = (low, middle, left) if at < middle else (middle, high, wanted - left)
                rng, sums, squares, done = np.random.default_rng([seed, at]), np.zeros(resamples), np.zeros(resamples), 0
                while done < resamples:  # a few million draws at a time
                    some = slice(done, done + max(1, 4_000_000 // chunk))
                    starts, any_ = np.cumsum(wanted[some]) - wanted[some], wanted[some] > 0
                    drawn = x[rng.integers(0, len(x), int(wanted[some].sum()), dtype=np.uint32)]
                    if len(drawn):
                        sums[some][any_] = np.add.reduceat(drawn, starts[any_])
                        squares[some][any_] = np.add.reduceat(drawn * drawn, starts[any_])
                    done = some.stop
                yield pd.DataFrame({key: [name] * resamples, "__r": np.arange(resamples), "__s": sums, "__q": squares})

    cut = numbered(own.where("__x IS NOT NULL").join(large.select(key), key, "left_semi"), [key], order).withColumn("__chunk", F.floor(F.col("__row") / chunk))
    arrays = cut.groupBy(key, "__chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("__row", "__x"))), lambda r: r["__x"]).alias("xs")).join(large, key)
    drawn = arrays.repartition(parts, key, "__chunk").mapInPandas(draw, f"`{key}` {kind}, __r long, __s double, __q double")
    each = drawn.groupBy(key, "__r").agg(F.sum("__s").alias("s"), F.sum("__q").alias("q")).join(large, key)
    n = F.col("__n")
    dev = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)))
    ratio = F.when(dev < 1e-10, 0.0).otherwise((F.col("__mean") + F.col("s") / n) / F.when(dev >= 1e-10, dev) * F.sqrt(n))
    ends = each.groupBy(key).agg(F.percentile(ratio, (1 - level) / 2).alias("low"), F.percentile(ratio, (1 + level) / 2).alias("high"))
    return small.unionByName(ends.withColumn("passed", F.col("low") >= min_sharpe))
