"""Streams with a state per key: signals over rolling buffers of closes, and risk breakers that react to
closed trades; logs that are followed; queries that go on where they stopped."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_crossings(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """symbol, open_time, fast and slow averages of each bar of a stream, and whether the fast one crossed
    above. A symbol's state is its last `slow` closes and where the averages stood; bars of a micro-batch
    are taken in order of time, and one no later than the last is left out."""

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        last, below, closes = state.get if state.exists else (-1, None, [])
        rows = pd.concat(list(frames)).sort_values("open_time").drop_duplicates("open_time")
        rows = rows[rows["open_time"] > last]
        if not len(rows):
            return
        own = np.append(np.array(closes, float), rows["close"].to_numpy(float))
        sums, ends = np.append(0.0, np.cumsum(own)), np.arange(len(closes), len(own)) + 1

        def mean(n: int):  # noqa: ANN202
            return np.where(ends >= n, (sums[ends] - sums[np.maximum(ends - n, 0)]) / n, np.nan)

        a, b = mean(fast), mean(slow)
        under = np.where(np.isnan(b), np.nan, a <= b)
        before = np.append(np.nan if below is None else float(below), under[:-1])
        # Only as many closes are held as the slow average needs.
        state.update((int(rows["open_time"].iloc[-1]), None if np.isnan(under[-1]) else bool(under[-1]), own[-slow:].tolist()))
        found = pd.DataFrame({"symbol": key[0], "open_time": rows["open_time"].to_numpy(), "fast": a, "slow": b, "crossed": (a > b) & (before == 1.0)})
        yield found.astype(object).where(found.notna(), None).astype({"open_time": "int64", "crossed": bool})

    return bars.select("symbol", "open_time", "close").groupBy("symbol").applyInPandasWithState(
        step, "symbol string, open_time long, fast double, slow double, crossed boolean", "last long, below boolean, closes array<double>", "append", GroupStateTimeout.NoTimeout
    )


def live_breaker(trades: DataFrame, start: float = 100_000.0, max_drawdown: float = 0.15, max_daily_loss: float = 0.02, max_streak: int = 10, cooldown_hours: float = 24.0, keep: list[str] | None = None) -> DataFrame:
    """run_id, seq and state (ACTIVE or HALTED) after each closed trade (run_id, seq, exit_time, net_pnl) of a
    stream, and the rule that halted a run just then. The rules are those of operators.risk; a run's
    state are eight numbers. Columns of trades named in `keep` go along, so that results need no join with them."""
    kept = keep or []

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        last, equity, peak, streak, day, daily, began, halted = state.get if state.exists else (-1, start, start, 0, -1, 0.0, start, -1)
        held, states, reasons = list(frames), [], []
        rows = held[0] if len(held) == 1 else pd.concat(held)
        seqs, columns = rows["seq"].to_numpy(), ["seq", "exit_time", "net_pnl", *kept]
        at = np.argsort(seqs, kind="stable")
        # A place is taken once, and none of those before.
        at = at[(seqs[at] > last) & np.append(True, np.diff(seqs[at]) != 0)]
        values = {c: rows[c].to_numpy()[at] for c in columns}
        for time, pnl in zip(values["exit_time"].tolist(), values["net_pnl"].tolist(), strict=True):
            if time // 86_400_000 != day:
                day, daily, began = time // 86_400_000, 0.0, equity
            equity, daily = equity + pnl, daily + pnl
            streak, peak = (streak + 1 if pnl < 0 else 0), max(peak, equity)
            if halted >= 0 and cooldown_hours > 0 and time - halted >= cooldown_hours * 3_600_000:
                halted = -1
            reason = None
            if halted < 0:
                if (peak - equity) / peak >= max_drawdown:
                    reason = "drawdown"
                elif daily < 0 < began and -daily / began >= max_daily_loss:
                    reason = "daily_loss"
                elif streak >= max_streak:
                    reason = "consecutive_losses"
                halted = time if reason else -1
            states.append("HALTED" if halted >= 0 else "ACTIVE")
            reasons.append(reason)
        if states:
            state.update((int(values["seq"][-1]), float(equity), float(peak), int(streak), int(day), float(daily), float(began), int(halted)))
        yield pd.DataFrame({"run_id": np.full(len(at), key[0]), "seq": values["seq"], "state": np.array(states, object), "reason": np.array(reasons, object), **{c: values[c] for c in kept}})

    kinds = dict(trades.dtypes)
    return trades.select("run_id", "seq", "exit_time", "net_pnl", *kept).groupBy("run_id").applyInPandasWithState(
        step, "run_id long, seq long, state string, reason string" + "".join(f", `{c}` {kinds[c]}" for c in kept), "last long, equity double, peak double, streak long, day long, daily double, began double, halted long", "append", GroupStateTimeout.NoTimeout
    )


def follow_log(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the log files in a folder, with the file's name: as a stream, whose checkpoint remembers
    what has been read."""
    return spark.readStream.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def lines_after(spark: SparkSession, path: str, last_id: int = 0) -> DataFrame:
    """The lines of one log file from number last_id on (from 0), each with its number. A file is one task's,
    as its lines are numbered in order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("id", "line"))
    return rows.where(F.col("id") >= last_id)


def go_on(stream: DataFrame, path: str, checkpoint: str, seconds: int | None = 60) -> StreamingQuery:
    """Write a stream to Parquet from where the checkpoint says it stopped: every so many seconds, or for
    None once with all that there is."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def follow_until(stream: Callable[[], DataFrame], path: str, checkpoint: str, terminal: str, seconds: float = 1.0, polls: int | None = None, pause: Callable[[float], None] = time.sleep) -> bool:
    """Take what a stream has every so many seconds, until a row that the condition `terminal` holds for has been
    written, and say whether one was; without, polls end the wait. It may begin again at the same checkpoint."""
    made = 0
    while True:
        go_on(stream(), path, checkpoint, None).awaitTermination()
        made += 1
        if SparkSession.active().read.parquet(path).where(terminal).limit(1).count():
            return True
        if made == polls:
            return False
        pause(seconds)
