"""Indicators by name: what a plug-in registers, which output a bare name means, and derived outputs."""

from __future__ import annotations

import importlib
import logging
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field
from types import ModuleType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


@dataclass
class Indicator:
    """columns gives the outputs as columns of a bar's window; fold_step a recursion over arrays (see
    operators.folds) whose outputs are columns of doubles; recurrence one in chunks (operators.scans), of whose columns
    sources names that of each output. One of the three is there at least."""

    name: str
    outputs: tuple[str, ...]
    columns: Callable[..., dict[str, Column]] | None = None
    fold_step: Callable[[dict], Callable[[dict], dict]] | None = None
    recurrence: Callable[[dict], object] | None = None
    sources: dict[str, str] = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)
    primary: str | None = None
    derived: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.columns is None and self.fold_step is None and self.recurrence is None:
            raise ValueError(f"{self.name}: neither columns nor a fold")
        if not self.outputs or self.primary is not None and self.primary not in self.outputs:
            raise ValueError(f"{self.name}: no such output")

    @property
    def bare(self) -> str:
        """The output that the bare name means: the primary one, else the first."""
        return self.primary or self.outputs[0]


_known: dict[str, Indicator] = {}


def names() -> list[str]:
    return sorted(_known)


def register(spec: Indicator) -> Indicator:
    """A later registration takes the place of an earlier one."""
    _known[spec.name.upper()] = spec
    return spec


def indicator(name: str, outputs: tuple[str, ...], **how):  # noqa: ANN003, ANN201
    """Register the decorated function as the columns of an indicator."""
    return lambda f: (register(Indicator(name, outputs, columns=f, **how)), f)[1]


def known(name: str) -> Indicator:
    return _known[name.upper()]


def load_plugins(package: ModuleType) -> list[str]:
    """Import all modules of a package, which register what they have. One that fails is logged and passed over."""
    loaded = []
    for found in pkgutil.iter_modules(package.__path__, package.__name__ + "."):
        try:
            importlib.import_module(found.name)
            loaded.append(found.name)
        except Exception:  # noqa: BLE001
            log.warning("plug-in %s failed", found.name, exc_info=True)
    return loaded


#: Outputs made of others, by name: share of the band's width, width of the band, place in the channel.
DERIVED: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "percent_b": lambda close, upper, middle, lower: F.when(upper > lower, (close - lower) / F.when(upper > lower, upper - lower)).otherwise(0.5),
    "bandwidth": lambda close, upper, middle, lower: F.when(middle > 0, (upper - lower) / F.when(middle > 0, middle)).otherwise(0.0),
    "position": lambda close, upper, middle, lower: F.when(upper > lower, (close - lower) / F.when(upper > lower, upper - lower)).otherwise(0.5),
}


def add(bars: DataFrame, name: str, alias: str | None = None, **parameters) -> DataFrame:  # noqa: ANN003
    """bars with the outputs of a registered indicator as alias_output, the bare one as alias, and derived ones."""
    from tidewright.operators.folds import array_fold
    from tidewright.operators.scans import scan

    spec, alias = known(name), alias or name.lower()
    if unknown := set(parameters) - set(spec.defaults):
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    chosen = spec.defaults | parameters
    if spec.columns is not None:
        found = spec.columns(**chosen)
        out = bars.withColumns({f"{alias}_{o}": found[o] for o in spec.outputs})
    elif spec.recurrence is not None:
        recurrence = spec.recurrence(chosen)
        added = {x.split()[0] for x in recurrence.schema.split(", ")}
        made = scan(bars.withColumnsRenamed({c: f"__bar_{c}" for c in bars.columns if c in added}), ["symbol"], ["open_time"], recurrence)
        out = made.select(*[F.col(f"__bar_{c}" if f"__bar_{c}" in made.columns else c).alias(c) for c in bars.columns], *[F.col(c).alias(f"{alias}_{o}") for o, c in spec.sources.items()])
    else:
        made = array_fold(bars, ["symbol"], ["open_time"], lambda: spec.fold_step(chosen), ["open", "high", "low", "close", "volume"], ", ".join(f"{o} double" for o in spec.outputs))
        out = made.withColumnsRenamed({o: f"{alias}_{o}" for o in spec.outputs})
    if spec.derived:
        parts = [F.col("close"), *[F.col(f"{alias}_{o}") for o in ("upper", "middle", "lower")]]
        out = out.withColumns({f"{alias}_{d}": F.when(parts[2].isNotNull(), DERIVED[d](*parts)) for d in spec.derived})
    return out.withColumn(alias, F.col(f"{alias}_{spec.bare}"))
