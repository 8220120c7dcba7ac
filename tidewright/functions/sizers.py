"""Ways to size a position, as columns: a sizer says what size it would take, and common limits cut it."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import scores


@dataclass(frozen=True)
class Limits:
    """Share of equity in a position at most, leverage, and digits to which sizes are cut."""

    share: float = 0.5
    leverage: float = 3.0
    digits: int = 3


class Sizer(ABC):
    """A subclass gives raw(), the size before limits, from the columns that it needs."""

    def __init__(self, limits: Limits | None = None) -> None:
        self.limits = limits or Limits()

    @abstractmethod
    def raw(self, equity: Column, price: Column) -> Column: ...

    def size(self, equity: Column, price: Column) -> Column:
        """The limited size: 0 where none can be said or a price or equity is not positive."""
        own = scores.limited_size(self.raw(equity, price), equity, price, self.limits.share, self.limits.leverage, self.limits.digits)
        return F.when((price > 0) & (equity > 0) & self.raw(equity, price).isNotNull(), own.cast("double")).otherwise(0.0)


class FixedFraction(Sizer):
    """What loses a fraction of equity at the stop."""

    def __init__(self, risk: float, stop: Column, limits: Limits | None = None) -> None:
        super().__init__(limits)
        self.risk, self.stop = risk, stop

    def raw(self, equity: Column, price: Column) -> Column:
        return scores.fixed_fraction_size(equity, self.risk, price, self.stop)


class Kelly(Sizer):
    def __init__(self, win_rate: Column, ratio: Column, share: float = 0.5, limits: Limits | None = None) -> None:
        super().__init__(limits)
        self.fraction = scores.kelly_fraction(win_rate, ratio, share)

    def raw(self, equity: Column, price: Column) -> Column:
        return scores.kelly_size(self.fraction, equity, price)


class TrueRange(Sizer):
    """What loses a fraction of equity when the price moves by k average true ranges."""

    def __init__(self, risk: float, atr: Column, k: float = 2.0, limits: Limits | None = None) -> None:
        super().__init__(limits)
        self.risk, self.atr, self.k = risk, atr, k

    def raw(self, equity: Column, price: Column) -> Column:
        return scores.atr_size(equity, self.risk, self.atr, self.k)
