"""Risk states of strategies and portfolios over their closed trades: streaks and daily losses as windows,
circuit breakers as folds, scaling of sizes by drawdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.folds import Step, array_fold
from tidewright.operators.prefixes import carried
from tidewright.operators.trades import START, equity_curve
from tidewright.sources.market import TRADE_ORDER

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def daily_state(trades: DataFrame, start: float = START, order: list[str] = TRADE_ORDER) -> DataFrame:
    """trades with equity, peak and drawdown after each, the streak of losses up to it (any other trade
    ends one), the UTC day's profit so far, and the equity at which the day began."""
    rows = equity_curve(trades, start, order)
    by = Window.partitionBy("run_id").orderBy(*order)
    sofar = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__resets", F.sum((F.col("net_pnl") >= 0).cast("int")).over(sofar)).withColumn("day", F.floor(F.col("exit_time") / DAY_MS))
    streak = F.sum((F.col("net_pnl") < 0).cast("int")).over(Window.partitionBy("run_id", "__resets").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    daily = F.sum("net_pnl").over(Window.partitionBy("run_id", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"loss_streak": streak, "daily_pnl": daily})
    return rows.withColumn("day_start_equity", F.col("equity") - F.col("daily_pnl")).drop("__resets")


def drawdown_scale(drawdown: Column, scale_at: float, stop_at: float) -> Column:
    """The factor of a position's size: from 1 without drawdown straight to 1/2 at scale_at, and on to 0 at stop_at."""
    rest = stop_at - scale_at
    beyond = (1 - (drawdown - scale_at) / rest) * 0.5 if rest > 0 else F.lit(0.0)
    return F.when(drawdown <= 0, 1.0).when(drawdown < scale_at, 1 - drawdown / scale_at * 0.5).when(drawdown < stop_at, beyond).otherwise(0.0)


ACTIVE, HALTED, COOLDOWN = "ACTIVE", "HALTED", "COOLDOWN"


def strategy_breaker(states: DataFrame, max_drawdown: float = 0.15, max_daily_loss: float = 0.02, max_streak: int = 10, cooldown_hours: float = 24.0, order: list[str] = TRADE_ORDER, max_positions: int | None = None) -> DataFrame:
    """daily_state()'s rows with the state after each trade and the rule that halted the strategy, if one
    did then. Rules are looked at in order: drawdown, loss of the day, streak of losses, and, where max_positions
    is given, the column `positions` of those that are open. A halted strategy
    looks at none until cooldown_hours have passed (0: for good), and then at all again."""

    def start() -> Step:
        halted_at: int | None = None

        def step(x: dict) -> dict:
            import numpy as np

            nonlocal halted_at
            lost = -x["daily_pnl"] / np.where(x["day_start_equity"] > 0, x["day_start_equity"], np.inf)
            many = x["positions"] >= max_positions if max_positions is not None else np.zeros(len(lost), bool)
            broken = np.select([x["drawdown"] >= max_drawdown, (x["daily_pnl"] < 0) & (lost >= max_daily_loss), x["loss_streak"] >= max_streak, many], [1, 2, 3, 4], 0)
            times, state, reason = x["exit_time"], np.full(len(broken), ACTIVE, object), np.full(len(broken), None, object)
            names = (None, "drawdown", "daily_loss", "consecutive_losses", "position_count")
            at = 0
            while at < len(times):
                if halted_at is not None:
                    # Rows until the cooldown ends are halted all at once.
                    end = len(times) if cooldown_hours <= 0 else at + int(np.searchsorted(times[at:], halted_at + cooldown_hours * HOUR_MS))
                    state[at:end] = HALTED
                    at = end
                    if at < len(times):
                        halted_at = None
                    continue
                hit = np.flatnonzero(broken[at:])
                if not len(hit):
                    break
                at += int(hit[0])
                state[at], reason[at], halted_at = HALTED, names[broken[at]], int(times[at])
                at += 1
            return {"state": state, "reason": reason}

        return step

    return array_fold(states, ["run_id"], list(order), start, ["exit_time", "drawdown", "daily_pnl", "day_start_equity", "loss_streak", *(["positions"] if max_positions is not None else [])], "state string, reason string")


def portfolio_breaker(states: DataFrame, limits: dict[str, float], cooldown_hours: float = 24.0, cooldown_scale: float = 0.5, key: str = "portfolio", time: str = "time") -> DataFrame:
    """states with state, size_scale and reason. A measure (a column of limits) at its limit or above halts
    the portfolio; after cooldown_hours it goes on with smaller sizes, and after as many more in full.
    Limits count in both, and of several the first named is the reason."""
    names = list(limits)

    def start() -> Step:
        now, since = ACTIVE, 0

        def step(x: dict) -> dict:
            import numpy as np

            nonlocal now, since
            over = np.stack([x[c] >= limits[c] for c in names], 1)
            first = np.where(over.any(1), over.argmax(1), -1).tolist()
            state, reason = [], []
            for t, rule in zip(x[time].tolist(), first, strict=True):
                why = None
                done = cooldown_hours > 0 and t - since >= cooldown_hours * HOUR_MS
                if now == HALTED and done:
                    now, since, done = COOLDOWN, t, False
                if now == COOLDOWN and done:
                    now = ACTIVE
                if now != HALTED and rule >= 0:
                    now, since, why = HALTED, t, names[rule]
                state.append(now)
                reason.append(why)
            scale = [{ACTIVE: 1.0, COOLDOWN: cooldown_scale, HALTED: 0.0}[s] for s in state]
            return {"state": np.array(state, object), "size_scale": np.array(scale, float), "reason": np.array(reason, object)}

        return step

    return array_fold(states, [key], [time], start, [time, *names], "state string, size_scale double, reason string")


def trailing_stops(rows: DataFrame, k: float = 2.0, key: str = "position_id", time: str = "open_time") -> DataFrame:
    """rows (close, atr and direction of each bar of a position) with `stop`, which only ever comes nearer: of a long
    position the highest close - k * atr since its entry, of a short one the lowest close + k * atr; and `stopped`: whether
    the close is at or beyond the stop of the bars before. A position's bars are cut by time, see prefixes."""
    long = F.col("direction") == "LONG"
    level = F.when(long, F.col("close") - F.col("atr") * k).otherwise(-(F.col("close") + F.col("atr") * k))
    best = carried(
        rows.withColumn("__level", level), [key], [time], lambda w: [{"__here": F.max("__level").over(w), "__prior": F.max("__level").over(w.rowsBetween(Window.unboundedPreceding, -1))}],
        {"__best": F.max("__level")}, lambda w: [{"__before": F.max("__best").over(w)}],
    )
    both = best.withColumns({"__stop": F.greatest("__here", "__before"), "__last": F.greatest("__prior", "__before")})
    price = F.when(long, F.col("close")).otherwise(-F.col("close"))
    out = both.withColumns({"stop": F.when(long, F.col("__stop")).otherwise(-F.col("__stop")), "stopped": F.coalesce(price <= F.col("__last"), F.lit(False))})
    return out.drop("__level", "__here", "__prior", "__before", "__stop", "__last")
