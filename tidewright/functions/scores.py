"""Scalar formulas as columns: sizes, fills, fitness, penalties and the deflated Sharpe ratio."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def kelly_fraction(win_rate: Column, ratio: Column, share: float = 0.5) -> Column:
    return F.when(ratio > 0, clamp((win_rate - (1 - win_rate) / ratio) * share, 0.0, 1.0)).otherwise(0.0)


def fixed_fraction_size(equity: Column, risk: float, entry: Column, stop: Column) -> Column:
    return F.try_divide(equity * risk, F.abs(entry - stop))


def atr_size(equity: Column, risk: float, atr: Column, k: float) -> Column:
    return F.try_divide(equity * risk, atr * k)


def kelly_size(fraction: Column, equity: Column, price: Column) -> Column:
    return F.try_divide(fraction * equity, price)


def strategy_size(equity: Column, price: Column, stop: Column | None = None, risk: float = 0.02, most: float = 0.5, least: float = 0.01) -> Column:
    """The size that loses `risk` of equity at the stop (without one, 2 % from the price), of `most` of
    equity at most and `least` of it at least."""
    distance = F.abs(price - stop) if stop is not None else price * 0.02
    distance = F.when(distance > 0, distance).otherwise(price * 0.02)
    return F.greatest(F.least(F.try_divide(equity * risk, distance), F.try_divide(equity * most, price)), F.try_divide(equity * least, price))


def stop_price(kind: str, entry: Column, long: Column, value: float, atr: Column | None = None) -> Column:
    """The price of a stop below a long entry or above a short one: value in per cent (fixed_pct), or in
    average true ranges (atr_fixed, atr_trailing)."""
    if kind not in ("fixed_pct", "atr_fixed", "atr_trailing") or kind != "fixed_pct" and atr is None:
        raise ValueError(f"no stop {kind!r}")
    away = entry * (value / 100) if kind == "fixed_pct" else atr * value
    return F.when(long, entry - away).otherwise(entry + away)


def target_price(kind: str, entry: Column, long: Column, value: float, atr: Column | None = None, stop: Column | None = None) -> Column:
    """The price of a target on the other side: fixed_pct, atr_fixed, or risk_reward, value times as far
    as the stop."""
    if kind == "risk_reward":
        if stop is None:
            raise ValueError("risk_reward needs the stop")
        away = F.abs(entry - stop) * value
        return F.when(long, entry + away).otherwise(entry - away)
    return stop_price(kind, entry, ~long, value, atr)


def limited_size(raw: Column, equity: Column, price: Column, share: float, leverage: float, digits: int) -> Column:
    """The smallest of raw, a share of equity and leverage, cut to so many digits."""
    return F.floor(F.least(raw, equity * share / price, equity * leverage / price) * 10**digits) / 10**digits


def slippage(spread: Column, volatility: Column, size: Column, volume: Column, k: float = 0.1) -> Column:
    """Half the spread, and the square-root impact where volume and volatility are known."""
    return spread / 2 + F.when((volume > 0) & (volatility != 0), volatility * k * F.sqrt(F.try_divide(F.abs(size), volume))).otherwise(0.0)


def slippage_cost(factor: Column, price: Column, size: Column) -> Column:
    return factor * price * F.abs(size)


def fitness(sharpe: Column, drawdown: Column, profit_factor: Column, total_return: Column) -> Column:
    """Weighted sum of parts that are scaled to 0..1: Sharpe -1..4, drawdown, factor 0..5, return -1..2."""
    return (
        clamp((sharpe + 1) / 5, 0.0, 1.0) * 0.35 + clamp(1 - drawdown, 0.0, 1.0) * 0.25 + clamp(profit_factor / 5, 0.0, 1.0) * 0.2 + clamp((total_return + 1) / 3, 0.0, 1.0) * 0.2
    )


def complexity_penalty(genes: Column) -> Column:
    return clamp((genes - 2) * 0.02, 0.0, 0.1)


#: Trades above which there are too many, by time frame, and for all others.
MANY_TRADES, MANY_TRADES_ELSE = {"1m": 3000, "5m": 1000, "15m": 500, "1h": 300, "4h": 300, "1d": 150}, 300


def overtrade_penalty(n_trades: Column, threshold: float | Column) -> Column:
    """threshold is a number of trades, or the column of the time frame that sets it."""
    if isinstance(threshold, Column):
        many = F.lit(float(MANY_TRADES_ELSE))
        for frame, n in MANY_TRADES.items():
            many = F.when(threshold == frame, float(n)).otherwise(many)
        threshold = many
    return clamp((n_trades - threshold) / 100 * 0.05, 0.0, 0.3)


def stop_imbalance_penalty(stop: Column, take: Column) -> Column:
    ratio = F.try_divide(stop, take)
    return F.when(ratio > 5, F.least(F.lit(0.15), (ratio - 5) * 0.02)).otherwise(0.0)


def adjusted_score(raw: Column, penalties: list[Column], n_trades: Column, total_return: Column, min_trades: int) -> Column:
    total = sum(penalties[1:], penalties[0])
    return F.when((n_trades < min_trades) | (total_return <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.nanvl(raw, F.lit(0.0)) - total))


def expected_maximum(n_trials: int) -> float:
    """Of the maximum of n standard normal draws, about."""
    if n_trials < 2:
        return 0.0
    quantile = NormalDist().inv_cdf
    return (1 - EULER) * quantile(1 - 1 / n_trials) + EULER * quantile(1 - 1 / (n_trials * math.e))


def deflated_sharpe_z(sharpe: Column, n_trials: int, n_obs: Column, skew: Column, kurtosis: Column, variance: Column | None = None) -> Column:
    """How many deviations the Sharpe ratio is above what the best of n_trials would show by chance.
    Infinite, with the sign of the difference, where the variance is not positive."""
    best = expected_maximum(n_trials)
    chance = F.sqrt(variance) * best if variance is not None else F.lit(best) / F.sqrt(n_obs - 1)
    spread = (1 + (kurtosis / 4 - 0.25) * sharpe * sharpe - skew * sharpe) / (n_obs - 1)
    over = sharpe - chance
    return F.when(spread > 0, over / F.sqrt(F.when(spread > 0, spread).otherwise(1.0))).otherwise(F.when(over > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))


def suspicions(sharpe: Column, drawdown: Column, profit_factor: Column, n_trades: Column, total_return: Column) -> Column:
    """The names of the rules of plausibility that a result breaks, as an array."""
    none = n_trades == 0
    rules = {
        "drawdown below 0": drawdown < 0, "drawdown above 1": drawdown > 1, "profit factor below 0": profit_factor < 0,
        "Sharpe ratio without trades": none & (sharpe != 0) & (sharpe != float("-inf")), "return without trades": none & (total_return != 0), "profit factor without trades": none & (profit_factor != 0),
        "gain with a low profit factor": (n_trades > 10) & (total_return > 0.1) & (profit_factor < 0.8), "loss with a high profit factor": (n_trades > 10) & (total_return < -0.1) & (profit_factor > 1.5),
        "high Sharpe ratio of few trades": (n_trades < 30) & (sharpe > 5),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def statistic(sources: list[Column], keys: list[str], percent: bool = False) -> Column:
    """The first value that one of the maps (text to number) has under one of the keys, whatever the case
    of letters; where percent, as a fraction."""
    wanted = [k.lower() for k in keys]
    found = [F.element_at(F.map_values(F.map_filter(source, lambda k, v: F.lower(k).isin(*wanted) & v.isNotNull())), 1) for source in sources]
    safe = [F.when(F.size(F.map_filter(source, lambda k, v: F.lower(k).isin(*wanted) & v.isNotNull())) > 0, x) for source, x in zip(sources, found, strict=True)]
    return F.coalesce(*safe) / (100.0 if percent else 1.0)


def normal_tail(z: Column) -> Column:
    """The chance that a standard normal draw exceeds z; 0 or 1 for infinite z. Below 3 a power series,
    beyond it a continued fraction: both are folds over a short array, in built-in arithmetic."""
    x = F.least(F.abs(z), F.lit(40.0))
    steps = F.sequence(F.lit(1), F.lit(60))
    # phi(x) * (x + x^3 / 3 + x^5 / (3 * 5) + ...) lies between 0 and x.
    series = F.aggregate(
        steps, F.struct(x.alias("term"), x.alias("sum")),
        lambda a, k: F.struct((a["term"] * x * x / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * x * x / (2 * k + 1)).alias("sum")), lambda a: a["sum"],
    )
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    fraction = F.aggregate(F.reverse(steps), x, lambda a, k: x + k / F.when(a > 0, a).otherwise(1.0))
    tail = F.when(x < 3, 0.5 - density * series).otherwise(density / F.when(fraction > 0, fraction).otherwise(1.0))
    return F.when(F.isnan(z), F.lit(float("nan"))).when(z < 0, 1 - tail).otherwise(tail)


def deflated_confidence(z: Column) -> Column:
    """1 - p: how sure it is that the Sharpe ratio is more than the best of the trials by chance."""
    return 1 - normal_tail(z)


def deflated_passes(z: Column, significance: float = 0.05) -> Column:
    """Whether p < significance, by the quantile: no tail has to be computed."""
    return z > NormalDist().inv_cdf(1 - significance)
