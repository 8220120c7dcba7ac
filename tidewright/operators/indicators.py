"""Technical indicators: single ones of finite look-back as window columns; all of them, and those that recur, over chunks
of a symbol's bars side by side (see scans). What recurs is affine in its state, so a chunk's effect on it is a matrix and a vector."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import registry
from tidewright.operators.scans import CHUNK, Recurrence, scan


def by_time():  # noqa: ANN201
    """A symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("open_time")


def _frame(n: int):  # noqa: ANN202
    return by_time().rowsBetween(-(n - 1), 0)


def _full(value: Column, n: int) -> Column:
    """Null until n rows are there."""
    return F.when(F.count(F.lit(1)).over(_frame(n)) >= n, value)


def sma(n: int = 14, column: str = "close") -> Column:
    return _full(F.avg(column).over(_frame(n)), n)


def wma(n: int = 14, column: str = "close") -> Column:
    """Weights 1..n, the latest bar the heaviest."""
    terms = sum((F.lag(column, n - k).over(by_time()) * k for k in range(1, n)), F.col(column) * n)
    return terms / (n * (n + 1) / 2)


def roc(n: int = 10) -> Column:
    before = F.lag("close", n).over(by_time())
    return F.try_divide((F.col("close") - before) * 100, before)


def willr(n: int = 14) -> Column:
    high, low = F.max("high").over(_frame(n)), F.min("low").over(_frame(n))
    return _full(F.try_divide((high - F.col("close")) * -100, high - low), n)


def stoch_raw(n: int = 14) -> Column:
    high, low = F.max("high").over(_frame(n)), F.min("low").over(_frame(n))
    return _full(F.try_divide((F.col("close") - low) * 100, high - low), n)


def cci(n: int = 20) -> Column:
    """(typical price - mean) / (0.015 * mean absolute deviation)."""
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows, mean = F.collect_list(price).over(_frame(n)), F.avg(price).over(_frame(n))
    deviation = F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return _full(F.try_divide(price - mean, deviation * 0.015), n)


def bands(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Bollinger bands with percent_b (0.5 without width) and bandwidth (0 without a middle)."""
    mean, dev = F.avg("close").over(_frame(n)), F.stddev_pop("close").over(_frame(n))
    upper, lower = mean + dev * k, mean - dev * k
    return {
        "bb_upper": _full(upper, n), "bb_middle": _full(mean, n), "bb_lower": _full(lower, n),
        "bb_percent": _full(F.when(dev > 0, (F.col("close") - lower) / (upper - lower)).otherwise(0.5), n), "bb_width": _full(F.when(mean > 0, (upper - lower) / mean).otherwise(0.0), n),
    }


def donchian(n: int = 20) -> dict[str, Column]:
    upper, lower = F.max("high").over(_frame(n)), F.min("low").over(_frame(n))
    position = F.when(upper > lower, (F.col("close") - lower) / (upper - lower)).otherwise(0.5)
    return {"dc_upper": _full(upper, n), "dc_middle": _full((upper + lower) / 2, n), "dc_lower": _full(lower, n), "dc_position": _full(position, n)}


def vwap() -> Column:
    """Of the UTC day so far."""
    day = Window.partitionBy("symbol", F.floor(F.col("open_time") / 86_400_000)).orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.try_divide(F.sum(price * F.col("volume")).over(day), F.sum("volume").over(day))


def ichimoku(a: int = 9, b: int = 26, c: int = 52) -> dict[str, Column]:
    middle = lambda n: _full((F.max("high").over(_frame(n)) + F.min("low").over(_frame(n))) / 2, n)
    return {"ich_conversion": middle(a), "ich_base": middle(b), "ich_span_a": (middle(a) + middle(b)) / 2, "ich_span_b": middle(c)}


def _rolling(x, n: int, op):  # noqa: ANN001, ANN202
    """op (maximum or minimum) of each n values in a row, in three steps a value whatever n is: from blocks'
    starts forwards, from their ends backwards, and one of each. NaN until n are there."""
    import numpy as np

    out, m = np.full(len(x), np.nan), len(x) - n + 1
    if m > 0:
        blocks = np.pad(x, (0, -len(x) % n), mode="edge").reshape(-1, n)
        forward = op.accumulate(blocks, axis=1).reshape(-1)
        backward = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        out[n - 1 :] = op(backward[:m], forward[n - 1 : n - 1 + m])
    return out


def _windows(x, n: int, f):  # noqa: ANN001, ANN202
    """f of a matrix of each n values in a row; NaN until n are there."""
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = f(sliding_window_view(x, n))
    return out


def _divided(a, b):  # noqa: ANN001, ANN202
    import numpy as np

    return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


class WindowIndicators(Recurrence):
    """All indicators of finite look-back, at their default periods but for those given, and two running sums: OBV, and VWAP, which
    starts anew each UTC day. State: OBV, the last bar's day, its sums of price times volume and of volume."""

    inputs = ["open_time", "high", "low", "close", "volume"]
    names = [
        "sma", "wma", "roc", "willr", "cci", "bb_upper", "bb_middle", "bb_lower", "bb_percent", "bb_width", "dc_upper", "dc_middle", "dc_lower", "dc_position",
        "ich_conversion", "ich_base", "ich_span_a", "ich_span_b", "obv", "vwap", "volsma", "mfi", "stoch_k", "stoch_d",
    ]
    schema = ", ".join(f"{n} double" for n in names)

    def __init__(self, stoch: int = 14, smooth: int = 3, mfi: int = 14) -> None:
        self.stoch, self.smooth, self.mfi = stoch, smooth, mfi
        self.lookback = max(51, stoch + 2 * smooth, mfi + 1)

    def neutral(self):  # noqa: ANN201
        import numpy as np

        return np.array([0.0, np.nan, 0.0, 0.0, np.nan])

    def merge(self, state, more):  # noqa: ANN001, ANN201
        import numpy as np

        same = more[4] == more[1] == state[1]  # all of the chunk is in the day that was
        return np.array([state[0] + more[0], more[1], more[2] + same * state[2], more[3] + same * state[3], state[4]])

    def run(self, x: dict, halo: int, state):  # noqa: ANN001, ANN201
        import numpy as np

        high, low, close, volume = (np.asarray(x[c], float) for c in ("high", "low", "close", "volume"))
        price = (high + low + close) / 3
        top, bottom = {n: _rolling(high, n, np.maximum) for n in (9, 14, 20, 26, 52)}, {n: _rolling(low, n, np.minimum) for n in (9, 14, 20, 26, 52)}
        average = lambda v, n: _windows(v, n, lambda w: w.mean(1))
        before = np.append(np.full(min(10, len(close)), np.nan), close[:-10])
        flat = lambda v, n: _rolling(v, n, np.maximum) == _rolling(v, n, np.minimum)
        mean = average(close, 20)
        spread = np.where(flat(close, 20), 0.0, _windows(close, 20, lambda w: w.std(1)))
        upper, lower = mean + 2 * spread, mean - 2 * spread
        typical = average(price, 20)
        deviation = np.where(flat(price, 20), 0.0, _windows(price, 20, lambda w: np.abs(w - w.mean(1)[:, None]).mean(1)))
        width = top[20] - bottom[20]
        middle = {n: (top[n] + bottom[n]) / 2 for n in (9, 26, 52)}
        raw_top, raw_bottom = _rolling(high, self.stoch, np.maximum), _rolling(low, self.stoch, np.minimum)
        k = average(_divided((close - raw_bottom) * 100, raw_top - raw_bottom), self.smooth)
        sign = np.sign(np.diff(price, prepend=np.nan))
        gain, loss = (_windows(np.where(np.isnan(sign), np.nan, np.where(sign == s, price * volume, 0.0)), self.mfi, lambda w: w.sum(1)) for s in (1, -1))
        running, amounts, totals, after = self._sums(x, halo, state)
        with np.errstate(invalid="ignore", divide="ignore"):
            found = {
                "sma": average(close, 14), "wma": _windows(close, 14, lambda w: w @ np.arange(1, 15) / 105), "roc": _divided((close - before) * 100, before),
                "willr": _divided((top[14] - close) * -100, top[14] - bottom[14]), "cci": _divided(price - typical, deviation * 0.015),
                "bb_upper": upper, "bb_middle": mean, "bb_lower": lower, "bb_percent": np.where(np.isnan(mean), np.nan, np.where(spread > 0, (close - lower) / (upper - lower), 0.5)), "bb_width": np.where(np.isnan(mean), np.nan, np.where(mean > 0, (upper - lower) / mean, 0.0)),
                "dc_upper": top[20], "dc_middle": (top[20] + bottom[20]) / 2, "dc_lower": bottom[20], "dc_position": np.where(np.isnan(width), np.nan, np.where(width > 0, (close - bottom[20]) / width, 0.5)),
                "ich_conversion": middle[9], "ich_base": middle[26], "ich_span_a": (middle[9] + middle[26]) / 2, "ich_span_b": middle[52],
                "volsma": average(volume, 20), "mfi": np.where(gain + loss == 0, 50.0, gain * 100 / (gain + loss)), "stoch_k": k, "stoch_d": average(k, self.smooth),
            }
        return {n: v[halo:] for n, v in found.items()} | {"obv": running, "vwap": _divided(amounts, totals)}, after

    def summary(self, level: int, x: dict, halo: int, state):  # noqa: ANN001, ANN201
        return self._sums(x, halo, None)[-1]

    def _sums(self, x: dict, halo: int, state):  # noqa: ANN001, ANN202
        """OBV, the day's price times volume and volume so far, and the state after the last row."""
        import numpy as np

        obv, day, amount, total, _ = self.neutral() if state is None else state
        high, low, close, volume = (np.asarray(x[c], float) for c in ("high", "low", "close", "volume"))
        days = np.asarray(x["open_time"])[halo:] // 86_400_000
        running = obv + np.cumsum(np.nan_to_num(np.sign(np.diff(close, prepend=np.nan)) * volume)[halo:])
        cuts = np.flatnonzero(days[1:] != days[:-1]) + 1
        amounts, totals = (np.concatenate([np.cumsum(v) for v in np.split(value[halo:], cuts)]) + np.where(days == day, carried, 0.0) for value, carried in (((high + low + close) / 3 * volume, amount), (volume, total)))
        return running, amounts, totals, np.array([running[-1], days[-1], amounts[-1], totals[-1], days[0]])


def with_window_indicators(bars: DataFrame, rows: int = CHUNK) -> DataFrame:
    """bars with every indicator of finite look-back at its default period; chunks of so many bars are computed side by side."""
    return scan(bars, ["symbol"], ["open_time"], WindowIndicators(), rows)


class Smooth:
    """y += alpha * (x - y), begun with the mean of the first n values, over arrays that go on from call to
    call. NaN before it has begun; x may begin with NaN."""

    def __init__(self, n: int, alpha: float) -> None:
        self.n, self.alpha, self.seen, self.value = n, alpha, [], None

    def __call__(self, x):  # noqa: ANN001, ANN204
        import numpy as np
        import pandas as pd

        out, at = np.full(len(x), np.nan), 0
        if self.value is None:
            for at, v in enumerate(x.tolist(), 1):
                if not math.isnan(v):
                    self.seen.append(v)
                    if len(self.seen) == self.n:
                        self.value = out[at - 1] = math.fsum(self.seen) / self.n
                        break
        if self.value is not None and at < len(x):
            out[at:] = pd.Series(np.append(self.value, x[at:])).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[1:]
            self.value = float(out[-1])
        return out


def ema(n: int) -> Smooth:
    return Smooth(n, 2 / (n + 1))


def wilder(n: int) -> Smooth:
    return Smooth(n, 1 / n)


class Tail:
    """The last n rows before each run of rows, for what looks back: an array with up to n rows in front."""

    def __init__(self, n: int) -> None:
        self.n, self.rows = n, None

    def __call__(self, x):  # noqa: ANN001, ANN204
        import numpy as np

        whole = x if self.rows is None else np.concatenate([self.rows, x])
        self.rows = whole[-self.n :].copy() if self.n else whole[:0]
        return whole


def drifting(x, alpha, before: float) -> list[float]:  # noqa: ANN001
    """y += alpha[i] * (x[i] - y) from `before`."""
    out = []
    for v, a in zip(x.tolist(), alpha.tolist(), strict=True):
        before += a * (v - before)
        out.append(before)
    return out


class Drift:
    """A moving average whose weight depends on the last n + 1 closes, begun at the close before its first."""

    def __init__(self, n: int, weight: Callable) -> None:
        self.n, self.weight, self.tail, self.value, self.decay = n, weight, Tail(n), None, 1.0

    def __call__(self, close):  # noqa: ANN001, ANN204
        import numpy as np

        whole = self.tail(close)
        out, m = np.full(len(close), np.nan), len(whole) - self.n
        if m > 0:
            path = np.convolve(np.abs(np.diff(whole)), np.ones(self.n), "valid")
            alpha = self.weight(whole[self.n :] - whole[:m], path)
            self.decay = float(np.prod(1 - alpha))
            before = whole[self.n - 1] if self.value is None else self.value
            found = drifting(whole[self.n :], alpha, float(before))
            out[len(close) - m :], self.value = found, found[-1]
        return out


def _ratio(move, path):  # noqa: ANN001, ANN202
    import numpy as np

    return np.where(path > 1e-300, np.abs(move) / np.where(path > 1e-300, path, 1.0), 0.0)


class Frama:
    """Ehlers' fractal average of an even period n: the ranges of a window's halves against that of the whole
    give the dimension of the path in 1..2, and exp(-4.6 * (dimension - 1)), 0.01 at least, the weight.
    Begun with the close of the first whole window."""

    def __init__(self, n: int) -> None:
        self.n = max(2, n - n % 2)
        self.tail, self.value, self.decay = Tail(self.n - 1), None, 1.0

    def __call__(self, high, low, close):  # noqa: ANN001, ANN204
        import numpy as np
        from numpy.lib.stride_tricks import sliding_window_view as windows

        both = self.tail(np.stack([high, low, close], 1))
        out, m, half = np.full(len(close), np.nan), len(both) - self.n + 1, self.n // 2
        if m > 0:
            top, bottom = windows(both[:, 0], half).max(1), windows(both[:, 1], half).min(1)
            older, newer = slice(0, m), slice(half, half + m)
            halves = (top[older] - bottom[older] + top[newer] - bottom[newer]) / half
            each = np.minimum(top[older] - bottom[older], top[newer] - bottom[newer])
            whole = (np.maximum(top[older], top[newer]) - np.minimum(bottom[older], bottom[newer])) / self.n
            some = (each > 0) & (whole > 0)
            dimension = np.where(some, np.log2(np.where(some, halves, 1.0) / np.where(some, whole, 1.0)), 1.0)
            alpha = np.maximum(np.exp(-4.6 * (np.clip(dimension, 1.0, 2.0) - 1)), 0.01)
            own, self.decay = both[self.n - 1 :, 2], float(np.prod(1 - alpha))
            if self.value is None:
                alpha[0], self.value = 1.0, float(own[0])
            found = drifting(own, alpha, self.value)
            out[len(close) - m :], self.value = found, found[-1]
        return out


class AdaptiveRsi:
    """RSI whose gains and losses are smoothed by a constant between 2 / (n + 1) and 2 / (2 n + 1), by Kaufman's
    efficiency, to the power 1 / alpha; begun with the means of the first n; 100 without losses."""

    def __init__(self, n: int, alpha: float) -> None:
        self.n, self.power, self.tail, self.seen, self.value, self.decay = n, 1 / max(alpha, 0.01), Tail(n), [], None, 1.0

    def __call__(self, close):  # noqa: ANN001, ANN204
        import numpy as np

        n, before = self.n, self.tail.rows
        whole = self.tail(close)
        moves = np.diff(close if before is None or not len(before) else np.append(before[-1], close))
        out, skip = np.full(len(close), np.nan), len(close) - len(moves)
        smooth, m = np.full(len(moves), np.nan), len(whole) - n
        if m > 0:
            path = np.convolve(np.abs(np.diff(whole)), np.ones(n), "valid")
            fast, slow = 2 / (n + 1), 2 / (2 * n + 1)
            own = (_ratio(whole[n:] - whole[:m], path) * (fast - slow) + slow) ** self.power
            smooth[len(moves) - m :], self.decay = own, float(np.prod(1 - own))
        for i, (move, k) in enumerate(zip(moves.tolist(), smooth.tolist(), strict=True)):
            gain, loss = max(move, 0.0), max(-move, 0.0)
            if self.value is None:
                self.seen.append((gain, loss))
                if len(self.seen) < n:
                    continue
                self.value = tuple(math.fsum(x) / n for x in zip(*self.seen, strict=True))
            else:
                self.value = (self.value[0] * (1 - k) + gain * k, self.value[1] * (1 - k) + loss * k)
            up, down = self.value
            out[skip + i] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        return out


#: Default periods of the recursive indicators.
PERIODS = {"ema": 14, "dema": 14, "tema": 14, "rsi": 14, "macd_fast": 12, "macd_slow": 26, "macd_signal": 9, "atr": 14, "adx": 14, "kc": 20, "kc_width": 2.0, "kama": 10, "vidya": 14, "frama": 16, "adaptive_rsi": 14, "adaptive_alpha": 0.5}
RECURSIVE = (
    "ema double, dema double, tema double, rsi double, macd double, macd_signal double, macd_histogram double, atr double, adx double, kc_upper double, kc_middle double, kc_lower double, "
    "kama double, vidya double, frama double, adaptive_rsi double"
)


class Machine:
    """A step of all recursive indicators over arrays of high, low and close, that remembers what it needs.
    Warm-up is NaN. periods override PERIODS."""

    def __init__(self, periods: dict | None = None) -> None:
        p = self.p = PERIODS | (periods or {})
        if unknown := set(p) - set(PERIODS):
            raise ValueError(f"no periods {sorted(unknown)}")
        self.one, self.double, self.triple = ema(p["ema"]), [ema(p["dema"]) for _ in range(2)], [ema(p["tema"]) for _ in range(3)]
        self.up, self.down, self.tr, self.plus, self.minus, self.dx = wilder(p["rsi"]), wilder(p["rsi"]), wilder(p["atr"]), wilder(p["adx"]), wilder(p["adx"]), wilder(p["adx"])
        self.fast, self.slow, self.signal, self.mid, self.width = ema(p["macd_fast"]), ema(p["macd_slow"]), ema(p["macd_signal"]), ema(p["kc"]), ema(p["kc"])
        self.kama = Drift(p["kama"], lambda move, path: (_ratio(move, path) * (2 / 3 - 2 / 31) + 2 / 31) ** 2)
        self.vidya = Drift(p["vidya"], lambda move, path: _ratio(move, path) * 2 / (p["vidya"] + 1))
        self.frama, self.adaptive, self.last = Frama(p["frama"]), AdaptiveRsi(p["adaptive_rsi"], p["adaptive_alpha"]), Tail(1)
        #: What smooths at a steady weight; then what drifts; then the two means of the adaptive RSI, and the ADX.
        self.steady = [self.one, *self.double, *self.triple, self.up, self.down, self.tr, self.plus, self.minus, self.fast, self.slow, self.signal, self.mid, self.width]
        self.drifts = [self.kama, self.vidya, self.frama]

    def state(self):  # noqa: ANN201
        import numpy as np

        values = [*[s.value for s in self.steady], *[d.value for d in self.drifts], *(self.adaptive.value or (None, None)), self.dx.value]
        return np.array([np.nan if v is None else v for v in values])

    def go_on(self, state, before) -> None:  # noqa: ANN001
        """From a state, after rows of high, low and close."""
        for part, value in zip([*self.steady, *self.drifts], state.tolist(), strict=False):
            part.value = None if math.isnan(value) else value
        up, down, dx = state[-3:].tolist()
        self.adaptive.value, self.dx.value = None if math.isnan(up) else (up, down), None if math.isnan(dx) else dx
        for d in (self.kama, self.vidya, self.adaptive):
            d.tail.rows = before[-d.tail.n :, 2].copy()
        self.frama.tail.rows, self.last.rows = before[-self.frama.tail.n :].copy(), before[-1:].copy()

    def homogeneous(self):  # noqa: ANN201
        """One bar's effect on the states of steady weights: what remains of each, and what passes to those
        that smooth another."""
        import numpy as np

        size = len(self.steady) + len(self.drifts) + 3
        matrix, at = np.zeros((size, size)), {id(s): i for i, s in enumerate(self.steady)}
        for s, i in zip(self.steady, range(size)):  # noqa: B905
            matrix[i, i] = 1 - s.alpha
        for chain in (self.double, self.triple):
            for below, s in zip(chain, chain[1:]):  # noqa: B905
                matrix[at[id(s)]] += s.alpha * matrix[at[id(below)]]
        matrix[at[id(self.signal)]] += self.signal.alpha * (matrix[at[id(self.fast)]] - matrix[at[id(self.slow)]])
        return matrix

    def __call__(self, x: dict) -> dict:
        import numpy as np

        p = self.p
        high, low, close = (np.asarray(x[c], float) for c in ("high", "low", "close"))
        whole = self.last(np.stack([high, low, close], 1))
        first = len(whole) == len(close)  # no bar before: the first has no move
        d = np.diff(whole, axis=0)
        own = slice(1, None) if first else slice(None)
        true_range = high - low
        before = whole[:-1, 2]
        true_range[own] = np.maximum(true_range[own], np.maximum(np.abs(high[own] - before), np.abs(low[own] - before)))

        def moves(values):  # noqa: ANN001, ANN202
            return np.append(np.nan, values) if first else values

        gain, loss = self.up(moves(np.maximum(d[:, 2], 0))), self.down(moves(np.maximum(-d[:, 2], 0)))
        rise, fall = d[:, 0], -d[:, 1]
        plus, minus = self.plus(moves(np.where((rise > fall) & (rise > 0), rise, 0.0))), self.minus(moves(np.where((fall > rise) & (fall > 0), fall, 0.0)))
        with np.errstate(invalid="ignore", divide="ignore"):
            rsi = np.where(gain + loss == 0, 50.0, 100 * gain / (gain + loss))
            directed = np.where(plus + minus == 0, 0.0, 100 * np.abs(plus - minus) / (plus + minus))
        a = self.double[0](close)
        b = self.double[1](a)
        t1 = self.triple[0](close)
        t2 = self.triple[1](t1)
        t3 = self.triple[2](t2)
        macd = self.fast(close) - self.slow(close)
        sig, middle, spread = self.signal(macd), self.mid(close), self.width(true_range) * p["kc_width"]
        return {
            "ema": self.one(close), "dema": 2 * a - b, "tema": 3 * t1 - 3 * t2 + t3, "rsi": rsi, "macd": macd, "macd_signal": sig, "macd_histogram": macd - sig, "atr": self.tr(true_range), "adx": self.dx(directed),
            "kc_upper": middle + spread, "kc_middle": middle, "kc_lower": middle - spread, "kama": self.kama(close), "vidya": self.vidya(close), "frama": self.frama(high, low, close), "adaptive_rsi": self.adaptive(close),
        }


def recursive_indicators(periods: dict | None = None) -> Machine:
    """A step of all recursive indicators from a symbol's first bar on."""
    return Machine(periods)


class RecursiveIndicators(Recurrence):
    """All recursive indicators. A chunk's bars change the states to A @ state + b: b is what they make of states of
    zero, A what a state of steady weight leaves after as many bars, and the product of what remains for weights that drift.
    The ADX smooths a ratio of smoothed moves, so its own state takes a second round."""

    inputs, schema, levels = ["high", "low", "close"], RECURSIVE, 2

    def __init__(self, periods: dict | None = None) -> None:
        self.periods, p = periods, Machine(periods).p
        self.lookback = max(p["kama"], p["vidya"], p["adaptive_rsi"], p["frama"], 2)
        self.begun = max(3 * p["tema"], 2 * p["dema"], max(p["macd_slow"], p["macd_fast"]) + p["macd_signal"], 2 * p["adx"] + 1, p["rsi"] + 1, p["ema"], p["atr"], p["kc"])

    def least(self) -> int:
        return self.lookback + self.begun

    def _machine(self, x: dict, halo: int, state) -> Machine:  # noqa: ANN001
        import numpy as np

        m = Machine(self.periods)
        if state is not None:
            m.go_on(state, np.stack([np.asarray(x[c][:halo], float) for c in self.inputs], 1))
        return m

    def run(self, x: dict, halo: int, state):  # noqa: ANN001, ANN201
        m = self._machine(x, halo, state)
        return m({c: v[halo:] for c, v in x.items()}), m.state()

    def summary(self, level: int, x: dict, halo: int, state):  # noqa: ANN001, ANN201
        import numpy as np

        n = len(x["close"]) - halo
        if level:
            _, after = self.run(x, halo, np.append(state[:-1], 0.0))
            return np.array([(1 - 1 / Machine(self.periods).p["adx"]) ** n, after[-1]])
        m = Machine(self.periods)
        size = len(m.state())
        m = self._machine(x, halo, np.zeros(size))
        m({c: v[halo:] for c, v in x.items()})
        whole = np.linalg.matrix_power(m.homogeneous(), n)
        for k, part in enumerate([*m.drifts, m.adaptive, m.adaptive], len(m.steady)):
            whole[k, k] = part.decay
        return np.concatenate([whole.reshape(-1), m.state()])

    def follow(self, level: int, state, summary):  # noqa: ANN001, ANN201
        import numpy as np

        if level:
            return np.append(state[:-1], summary[0] * state[-1] + summary[1])
        size = len(state)
        return summary[: size * size].reshape(size, size) @ state + summary[size * size :]

    def known(self, level: int, before, state):  # noqa: ANN001, ANN201
        import numpy as np

        return np.append(before[:-1], state[-1])


def with_recursive_indicators(bars: DataFrame, periods: dict | None = None, rows: int = CHUNK) -> DataFrame:
    """bars with all recursive indicators; null while they warm up. Chunks of so many bars are computed side by side."""
    return scan(bars, ["symbol"], ["open_time"], RecursiveIndicators(periods), rows)


#: What a chart asks for where it names no period: fixed values that differ from those of strategies.
CHART_PERIODS = {"sma": 20, "ema": 20, "wma": 20, "dema": 20, "tema": 20, "cci": 14, "roc": 14, "kc": 20, "kc_width": 1.5}


def chart_series(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Indicators at a chart's periods in long form: symbol, time, name, value; what is not finite is null."""
    c = CHART_PERIODS
    rows = with_recursive_indicators(bars, {k: c[k] for k in ("ema", "dema", "tema", "kc", "kc_width")}).withColumns({"sma": sma(c["sma"]), "wma": wma(c["wma"]), "cci": cci(c["cci"]), "roc": roc(c["roc"])})
    wanted = names or ["sma", "wma", "cci", "roc", "ema", "dema", "tema", "rsi", "atr", "kc_upper", "kc_middle", "kc_lower"]
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), finite(n).alias("value")) for n in wanted]))
    return rows.select("symbol", F.col("open_time").alias("time"), each.alias("x")).select("symbol", "time", "x.*")


@registry.indicator("SMA", ("value",), defaults={"period": 14})
def _sma(period: int) -> dict[str, Column]:
    return {"value": sma(period)}


@registry.indicator("WMA", ("value",), defaults={"period": 14})
def _wma(period: int) -> dict[str, Column]:
    return {"value": wma(period)}


@registry.indicator("BBANDS", ("upper", "middle", "lower"), defaults={"period": 20, "width": 2.0}, primary="middle", derived=("percent_b", "bandwidth"))
def _bands(period: int, width: float) -> dict[str, Column]:
    found = bands(period, width)
    return {k: found[f"bb_{k}"] for k in ("upper", "middle", "lower")}


@registry.indicator("DONCHIAN", ("upper", "middle", "lower"), defaults={"period": 20}, primary="middle", derived=("position",))
def _channel(period: int) -> dict[str, Column]:
    found = donchian(period)
    return {k: found[f"dc_{k}"] for k in ("upper", "middle", "lower")}


@registry.indicator("CCI", ("value",), defaults={"period": 20})
def _cci(period: int) -> dict[str, Column]:
    return {"value": cci(period)}


@registry.indicator("ROC", ("value",), defaults={"period": 10})
def _roc(period: int) -> dict[str, Column]:
    return {"value": roc(period)}


@registry.indicator("WILLR", ("value",), defaults={"period": 14})
def _willr(period: int) -> dict[str, Column]:
    return {"value": willr(period)}


@registry.indicator("VOLSMA", ("value",), defaults={"period": 20})
def _volsma(period: int) -> dict[str, Column]:
    return {"value": sma(period, "volume")}


@registry.indicator("ICHIMOKU", ("conversion", "base", "span_a", "span_b"), defaults={"conversion": 9, "base": 26, "span": 52})
def _ichimoku(conversion: int, base: int, span: int) -> dict[str, Column]:
    return {k.removeprefix("ich_"): c for k, c in ichimoku(conversion, base, span).items()}


def _in_chunks(name: str, columns: dict[str, str], recurrence: Callable[[dict], Recurrence], defaults: dict, primary: str | None = None) -> None:
    registry.register(registry.Indicator(name, tuple(columns), recurrence=recurrence, sources=columns, defaults=defaults, primary=primary))


for _name, _column in (("EMA", "ema"), ("DEMA", "dema"), ("TEMA", "tema"), ("RSI", "rsi"), ("ATR", "atr"), ("ADX", "adx"), ("KAMA", "kama"), ("VIDYA", "vidya"), ("FRAMA", "frama")):
    _in_chunks(_name, {"value": _column}, lambda p, c=_column: RecursiveIndicators({c: p["period"]}), {"period": PERIODS[_column]})
_in_chunks("ADAPTIVE_RSI", {"value": "adaptive_rsi"}, lambda p: RecursiveIndicators({"adaptive_rsi": p["period"], "adaptive_alpha": p["alpha"]}), {"period": 14, "alpha": 0.5})
_in_chunks("MACD", {"macd": "macd", "signal": "macd_signal", "histogram": "macd_histogram"}, lambda p: RecursiveIndicators({f"macd_{k}": v for k, v in p.items()}), {"fast": 12, "slow": 26, "signal": 9})
_in_chunks("KC", {"upper": "kc_upper", "middle": "kc_middle", "lower": "kc_lower"}, lambda p: RecursiveIndicators({"kc": p["period"], "kc_width": p["width"]}), {"period": 20, "width": 2.0}, "middle")
_in_chunks("STOCH", {"k": "stoch_k", "d": "stoch_d"}, lambda p: WindowIndicators(stoch=p["period"], smooth=p["smooth"]), {"period": 14, "smooth": 3})
_in_chunks("MFI", {"value": "mfi"}, lambda p: WindowIndicators(mfi=p["period"]), {"period": 14})
for _name in ("OBV", "VWAP"):
    _in_chunks(_name, {"value": _name.lower()}, lambda p: WindowIndicators(), {})
