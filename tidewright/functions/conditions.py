"""Conditions of strategies as columns: comparisons, crossings, ranges, thresholds of a grid, and the
gates by time of day and week. A condition is never null: what is not known does not hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Columns of a candle that are prices or volume, and so no indicators.
PRICES = ("close", "open", "high", "low", "volume")
DAY_MS = 86_400_000
#: Hours (UTC) at which funding is paid.
FUNDING_HOURS = (0, 8, 16)


def by_bar() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time")


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def operand(name: str | float) -> Column:
    """A number, a price, or an indicator's column; the output b of an indicator a is a_b."""
    try:
        return F.lit(float(name))
    except ValueError:
        return F.col(str(name).replace(".", "_"))


def _varies(name: str | float) -> bool:
    """Whether an operand is an indicator, which has a value of the bar before."""
    try:
        float(name)
    except ValueError:
        return name not in PRICES
    return False


def compare(left: str | float, sign: str, right: str | float) -> Column:
    a, b = operand(left), operand(right)
    kinds = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}
    if sign not in kinds:
        raise ValueError(f"no comparison {sign!r}")
    return holds(kinds[sign])


def previous(column: Column, window: WindowSpec | None = None, gate: Column | None = None) -> Column:
    """The value of the bar before; with a gate, of the last bar before that passed it."""
    window = window or by_bar()
    if gate is None:
        return F.lag(column).over(window)
    return F.last(F.when(gate, column), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))


def _crosses(left: str | float, right: str | float, up: bool, compat: bool, window: WindowSpec | None, gate: Column | None) -> Column:
    a, b = operand(left), operand(right)

    def before(name: str | float, now: Column) -> Column:
        price = isinstance(name, str) and name in PRICES
        return previous(now, window, gate) if _varies(name) or price and not compat else now

    pa, pb = before(left, a), before(right, b)
    return holds((a > b) & (pa <= pb) if up else (a < b) & (pa >= pb))


def crosses_above(left: str | float, right: str | float, compat: bool = True, window: WindowSpec | None = None, gate: Column | None = None) -> Column:
    """left is above right now and was not on the bar before, for which indicators must have values.
    With compat a price has no value before: its value now stands for it."""
    return _crosses(left, right, True, compat, window, gate)


def crosses_below(left: str | float, right: str | float, compat: bool = True, window: WindowSpec | None = None, gate: Column | None = None) -> Column:
    return _crosses(left, right, False, compat, window, gate)


def between(name: str | float, low: float, high: float) -> Column:
    """Both bounds count; low has to be below high."""
    if not low < high:
        raise ValueError(f"an empty range: {low} to {high}")
    return holds(operand(name).between(low, high))


def every(conditions: list[Column]) -> Column:
    """All conditions of a side; a side without any never fires."""
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(False)


def side(long: Column, short: Column) -> Column:
    """LONG where the long side fires, else SHORT where the short side does, else null."""
    return F.when(long, "LONG").when(short, "SHORT")


def threshold_name(left: str, value: float) -> str:
    """The column of a grid that stands for a number in a condition: <left>_<value>_threshold."""
    return f"{left}_{value}_threshold".replace(".", "_").replace("-", "neg_")


def threshold(left: str, value: float, columns: list[str]) -> Column:
    """The number of a condition, or what a parameter grid joined to the rows has in its place."""
    name = threshold_name(left, value)
    return F.coalesce(F.col(name), F.lit(float(value))) if name in columns else F.lit(float(value))


def blocked_weekday(time_ms: Column, days: list[int]) -> Column:
    """Whether the UTC weekday (Monday is 0) is one of days."""
    return F.pmod(F.floor(time_ms / DAY_MS) + 3, F.lit(7)).isin(days) if days else F.lit(False)  # day 0 was a Thursday


def in_sessions(time_ms: Column, sessions: list[tuple[str, str, str]]) -> Column:
    """Whether the time lies in one of the sessions (from HH:MM, to HH:MM, time zone), both ends included.
    A session that begins later than it ends goes over midnight. Without sessions all times count."""
    if not sessions:
        return F.lit(True)

    def inside(start: str, end: str, zone: str) -> Column:
        local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MILLISECOND", time_ms, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")))
        clock = (F.hour(local) * 60 + F.minute(local)) * 60_000 + (F.second(local) * 1000 + F.pmod(time_ms, F.lit(1000)))
        a, b = (int(x[:2]) * 3_600_000 + int(x[3:5]) * 60_000 for x in (start, end))
        return clock.between(a, b) if a <= b else (clock >= a) | (clock <= b)

    return reduce(lambda x, y: x | y, [inside(*s) for s in sessions])


def near_funding(time_ms: Column, minutes_before: int, minutes_after: int) -> Column:
    """Whether funding is paid within minutes_before (of the hour before) or was within minutes_after."""
    minute_of_day = F.floor(F.pmod(time_ms, F.lit(DAY_MS)) / 60_000)
    hour, minute = F.floor(minute_of_day / 60), minute_of_day % 60
    after = hour.isin(*FUNDING_HOURS) & (minute < minutes_after)
    before = hour.isin(*[(h - 1) % 24 for h in FUNDING_HOURS]) & (minute >= 60 - minutes_before)
    return after | before


def ready(columns: list[str]) -> Column:
    """Whether every indicator has a value."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
