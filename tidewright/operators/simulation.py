"""Positions from signals: a long or short position is opened at the next bar's open, closed by its
stop, its target or the exit signal; the stop is tested first. A fold over each symbol's bars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

TRADE = "param_id long, symbol string, direction string, entry_time long, exit_time long, entry_price double, exit_price double, net_return double, reason string"


def positions(params: tuple[float, float, float]) -> Callable[[dict], dict | None]:
    """From a bar with long_entry, short_entry, long_exit, short_exit to the trade that it closes. params:
    stop and target in shares of the entry price, fee per side."""
    stop, take, fee = params
    state: dict = {"side": 0, "due": 0, "entry": 0.0, "since": 0}

    def step(bar: dict) -> dict | None:
        closed = None
        if state["due"]:
            state.update(side=state["due"], due=0, entry=bar["open"], since=bar["open_time"])
        side = state["side"]
        if side:
            entry = state["entry"]
            low, high = entry * (1 - side * stop), entry * (1 + side * take)
            hit_stop = bar["low"] <= low if side > 0 else bar["high"] >= low
            hit_take = bar["high"] >= high if side > 0 else bar["low"] <= high
            leave = bar["long_exit"] if side > 0 else bar["short_exit"]
            price, reason = (low, "stop") if hit_stop else (high, "target") if hit_take else (bar["close"], "signal") if leave else (None, "")
            if price is not None:
                closed = {"direction": "LONG" if side > 0 else "SHORT", "entry_time": state["since"], "exit_time": bar["close_time"], "entry_price": entry, "exit_price": price, "net_return": side * (price / entry - 1) - 2 * fee, "reason": reason}
                state["side"] = 0
        if not state["side"] and not state["due"]:
            state["due"] = 1 if bar["long_entry"] else -1 if bar["short_entry"] else 0
        state["last"] = bar
        return closed

    step.state = state  # type: ignore[attr-defined]
    return step


def simulate(signals: DataFrame, stop: float = 0.02, take: float = 0.04, fee: float = 0.0005) -> DataFrame:
    """Trades of each (param_id, symbol); a position still open ends at the last close. Each pair's
    bars stream through one task in order, with a few numbers of state; pairs run side by side."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in TRADE.split(", ")]
        key, step = None, None

        def ended() -> list:
            state = step.state if step else {"side": 0}
            if not state["side"]:
                return []
            last, side = state["last"], state["side"]
            return [{"param_id": key[0], "symbol": key[1], "direction": "LONG" if side > 0 else "SHORT", "entry_time": state["since"], "exit_time": last["close_time"], "entry_price": state["entry"], "exit_price": last["close"], "net_return": side * (last["close"] / state["entry"] - 1) - 2 * fee, "reason": "end"}]

        for batch in batches:
            out = []
            for bar in batch.to_dict("records"):
                if (own := (bar["param_id"], bar["symbol"])) != key:
                    out += ended()
                    key, step = own, positions((stop, take, fee))
                closed = step(bar)
                if closed:
                    out.append({"param_id": key[0], "symbol": key[1], **closed})
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(ended(), columns=names)

    ordered = signals.repartition("param_id", "symbol").sortWithinPartitions("param_id", "symbol", "open_time")
    return ordered.mapInPandas(run, TRADE)
