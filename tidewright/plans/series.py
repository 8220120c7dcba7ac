"""Queries over indicators that recur, at several periods, in a chart's form, and by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.functions import registry
from tidewright.operators import indicators
from tidewright.queries import BARS, query, rounded
from tidewright.sources import market

#: Bars numbered, with moves and true ranges, for recursions over the number.
NUMBERED = BARS.replace("WITH k", "WITH RECURSIVE k") + """,
x AS (SELECT *, row_number() OVER w AS i, greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss,
      greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM k WINDOW w AS (PARTITION BY symbol ORDER BY open_time))"""


def _smooth(name: str, value: str, n: int, first: int, alpha: str, of: str = "x") -> str:
    """A recursion begun at bar number `first` with the mean of the n values up to it."""
    return (
        f"{name} AS (SELECT symbol, CAST({first} AS BIGINT) AS i, avg({value}) AS y FROM {of} WHERE i > {first - n} AND i <= {first} GROUP BY symbol HAVING count(*) = {n} "
        f"UNION ALL SELECT s.symbol, s.i, {name}.y + {alpha} * (s.{value} - {name}.y) FROM {name} JOIN {of} s ON s.symbol = {name}.symbol AND s.i = {name}.i + 1)"
    )


_ALL = NUMBERED.replace(
    "tr FROM k",
    """tr, CASE WHEN high - lag(high) OVER w > greatest(lag(low) OVER w - low, 0) THEN high - lag(high) OVER w ELSE 0 END AS rise, CASE WHEN lag(low) OVER w - low > greatest(high - lag(high) OVER w, 0) THEN lag(low) OVER w - low ELSE 0 END AS fall,
      lag(close) OVER w AS was, abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 10) OVER w) AS move10, abs(close - lag(close, 14) OVER w) AS move14 FROM k""",
)
_PARTS = [
    _smooth("e1", "close", 14, 14, "(2 / 15)"), _smooth("e2", "y", 14, 27, "(2 / 15)", "e1"), _smooth("e3", "y", 14, 40, "(2 / 15)", "e2"),
    _smooth("up", "gain", 14, 15, "(1 / 14)"), _smooth("dn", "loss", 14, 15, "(1 / 14)"), _smooth("av14", "tr", 14, 14, "(1 / 14)"), _smooth("fa", "close", 12, 12, "(2 / 13)"), _smooth("sl", "close", 26, 26, "(2 / 27)"),
    "mc AS (SELECT symbol, i, fa.y - sl.y AS y FROM fa JOIN sl USING (symbol, i))", _smooth("sg", "y", 9, 34, "(2 / 10)", "mc"),
    _smooth("pl", "rise", 14, 15, "(1 / 14)"), _smooth("mi", "fall", 14, 15, "(1 / 14)"),
    "dx AS (SELECT symbol, i, CASE WHEN pl.y + mi.y = 0 THEN 0 ELSE 100 * abs(pl.y - mi.y) / (pl.y + mi.y) END AS y FROM pl JOIN mi USING (symbol, i))", _smooth("ad", "y", 14, 28, "(1 / 14)", "dx"),
    _smooth("md", "close", 20, 20, "(2 / 21)"), _smooth("wd", "tr", 20, 20, "(2 / 21)"),
    """p AS (SELECT *, CASE WHEN sum(step) OVER w10 > 0 THEN move10 / sum(step) OVER w10 ELSE 0 END AS k10, CASE WHEN sum(step) OVER w14 > 0 THEN move14 / sum(step) OVER w14 ELSE 0 END AS k14, (max(high) OVER a8 - min(low) OVER a8) / 8 AS n1, (max(high) OVER b8 - min(low) OVER b8) / 8 AS n2, (max(high) OVER w16 - min(low) OVER w16) / 16 AS n3
     FROM x WINDOW w10 AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING), a8 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 15 PRECEDING AND 8 PRECEDING), b8 AS (PARTITION BY symbol ORDER BY i ROWS 7 PRECEDING), w16 AS (PARTITION BY symbol ORDER BY i ROWS 15 PRECEDING))""",
    """q AS (SELECT *, pow(k10 * (2 / 3 - 2 / 31) + 2 / 31, 2) AS ak, k14 * 2 / 15 AS av, pow(k14 * (2 / 15 - 2 / 29) + 2 / 29, 2) AS ar, greatest(0.01, exp(-4.6 * (CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN greatest(1, least(2, log2((n1 + n2) / n3))) ELSE 1 END - 1))) AS af FROM p)""",
    "ka AS (SELECT symbol, i, was + ak * (close - was) AS y FROM q WHERE i = 11 UNION ALL SELECT q.symbol, q.i, y + ak * (close - y) FROM ka JOIN q ON q.symbol = ka.symbol AND q.i = ka.i + 1)",
    "vi AS (SELECT symbol, i, was + av * (close - was) AS y FROM q WHERE i = 15 UNION ALL SELECT q.symbol, q.i, y + av * (close - y) FROM vi JOIN q ON q.symbol = vi.symbol AND q.i = vi.i + 1)",
    "fr AS (SELECT symbol, i, close AS y FROM q WHERE i = 16 UNION ALL SELECT q.symbol, q.i, y + af * (close - y) FROM fr JOIN q ON q.symbol = fr.symbol AND q.i = fr.i + 1)",
    "rs AS (SELECT symbol, CAST(15 AS BIGINT) AS i, avg(gain) AS g, avg(loss) AS l FROM x WHERE i BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT q.symbol, q.i, g * (1 - ar) + gain * ar, l * (1 - ar) + loss * ar FROM rs JOIN q ON q.symbol = rs.symbol AND q.i = rs.i + 1)",
]


@query(
    _ALL + ", " + ", ".join(_PARTS)
    + """ SELECT x.symbol, open_time, round(e1.y, 6) AS ema, round(2 * e1.y - e2.y, 6) AS dema, round(3 * e1.y - 3 * e2.y + e3.y, 6) AS tema, round(CASE WHEN up.y + dn.y = 0 THEN 50 ELSE 100 * up.y / (up.y + dn.y) END, 6) AS rsi,
 round(mc.y, 6) + 0.0 AS macd, round(sg.y, 6) + 0.0 AS macd_signal, round(mc.y - sg.y, 6) + 0.0 AS macd_histogram, round(av14.y, 6) AS atr, round(ad.y, 6) AS adx, round(md.y + 2 * wd.y, 6) AS kc_upper, round(md.y, 6) AS kc_middle, round(md.y - 2 * wd.y, 6) + 0.0 AS kc_lower,
 round(ka.y, 6) AS kama, round(vi.y, 6) AS vidya, round(fr.y, 6) AS frama, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS adaptive_rsi FROM x """
    + " ".join(f"LEFT JOIN {n} USING (symbol, i)" for n in ("e1", "e2", "e3", "up", "dn", "mc", "sg", "av14", "ad", "md", "wd", "ka", "vi", "fr", "rs"))
)
def recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that recurs, against recursive SQL."""
    return rounded(indicators.with_recursive_indicators(market.klines(spark, sf_dir)).drop("open", "high", "low", "close", "volume", "close_time"))


@query(
    NUMBERED + ", " + ", ".join([_smooth("e14", "close", 14, 14, "(2 / 15)"), _smooth("e5", "close", 5, 5, "(2 / 6)"), _smooth("up", "gain", 14, 15, "(1 / 14)"), _smooth("dn", "loss", 14, 15, "(1 / 14)"), _smooth("a14", "tr", 14, 14, "(1 / 14)"), _smooth("fa", "close", 12, 12, "(2 / 13)"), _smooth("sl", "close", 26, 26, "(2 / 27)")])
    + """ SELECT x.symbol, open_time, round(e14.y, 6) AS ema, round(CASE WHEN up.y + dn.y = 0 THEN 50 ELSE 100 * up.y / (up.y + dn.y) END, 6) AS rsi, round(a14.y, 6) AS atr, round(fa.y - sl.y, 6) + 0.0 AS macd FROM x
LEFT JOIN e14 USING (symbol, i) LEFT JOIN up USING (symbol, i) LEFT JOIN dn USING (symbol, i) LEFT JOIN a14 USING (symbol, i) LEFT JOIN fa USING (symbol, i) LEFT JOIN sl USING (symbol, i)"""
)
def smoothed_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages, RSI and true ranges that recur, against recursive SQL."""
    return rounded(indicators.with_recursive_indicators(market.klines(spark, sf_dir)).select("symbol", "open_time", "ema", "rsi", "atr", "macd"))


@query(NUMBERED + ", " + _smooth("e5", "close", 5, 5, "(2 / 6)") + ", " + _smooth("up", "gain", 7, 8, "(1 / 7)") + ", " + _smooth("dn", "loss", 7, 8, "(1 / 7)") + " SELECT x.symbol, open_time, round(e5.y, 6) AS ema, round(CASE WHEN up.y + dn.y = 0 THEN 50 ELSE 100 * up.y / (up.y + dn.y) END, 6) AS rsi FROM x LEFT JOIN e5 USING (symbol, i) LEFT JOIN up USING (symbol, i) LEFT JOIN dn USING (symbol, i)")
def indicators_at_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.with_recursive_indicators(market.klines(spark, sf_dir), {"ema": 5, "rsi": 7}).select("symbol", "open_time", "ema", "rsi"))




@query(
    NUMBERED.replace("tr FROM k", "tr, lag(close) OVER w AS was, abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 10) OVER w) AS move FROM k")
    + """, p AS (SELECT *, CASE WHEN sum(step) OVER w10 > 0 THEN move / sum(step) OVER w10 ELSE 0 END AS er FROM x WINDOW w10 AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING)),
ka AS (SELECT symbol, i, was + pow(er * (2 / 3 - 2 / 31) + 2 / 31, 2) * (close - was) AS y FROM p WHERE i = 11 UNION ALL SELECT p.symbol, p.i, y + pow(er * (2 / 3 - 2 / 31) + 2 / 31, 2) * (close - y) FROM ka JOIN p ON p.symbol = ka.symbol AND p.i = ka.i + 1)
SELECT p.symbol, open_time, round(ka.y, 6) AS kama FROM p LEFT JOIN ka USING (symbol, i)"""
)
def kaufman_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.with_recursive_indicators(market.klines(spark, sf_dir)).select("symbol", "open_time", "kama"))


_H = "(PARTITION BY symbol ORDER BY i ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"


@query(
    NUMBERED + f""", f AS (SELECT *, (max(high) OVER {_H.format(15, 8)} - min(low) OVER {_H.format(15, 8)}) / 8 AS n1, (max(high) OVER {_H.format(7, 0)} - min(low) OVER {_H.format(7, 0)}) / 8 AS n2, (max(high) OVER {_H.format(15, 0)} - min(low) OVER {_H.format(15, 0)}) / 16 AS n3 FROM x),
g AS (SELECT *, greatest(0.01, exp(-4.6 * (CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN greatest(1, least(2, log2((n1 + n2) / n3))) ELSE 1 END - 1))) AS alpha FROM f),
fr AS (SELECT symbol, i, close AS y FROM g WHERE i = 16 UNION ALL SELECT g.symbol, g.i, alpha * close + (1 - alpha) * y FROM fr JOIN g ON g.symbol = fr.symbol AND g.i = fr.i + 1)
SELECT x.symbol, open_time, round(fr.y, 6) AS frama FROM x LEFT JOIN fr USING (symbol, i)"""
)
def fractal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.with_recursive_indicators(market.klines(spark, sf_dir)).select("symbol", "open_time", "frama"))


@query(
    NUMBERED.replace("tr FROM k", "tr, abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 14) OVER w) AS move FROM k")
    + """, p AS (SELECT *, pow(CASE WHEN sum(step) OVER w14 > 0 THEN move / sum(step) OVER w14 ELSE 0 END * (2 / 15 - 2 / 29) + 2 / 29, 2) AS sc FROM x WINDOW w14 AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING)),
ar AS (SELECT symbol, CAST(15 AS BIGINT) AS i, avg(gain) AS g, avg(loss) AS l FROM x WHERE i BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT p.symbol, p.i, g * (1 - sc) + gain * sc, l * (1 - sc) + loss * sc FROM ar JOIN p ON p.symbol = ar.symbol AND p.i = ar.i + 1)
SELECT x.symbol, open_time, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS adaptive_rsi FROM x LEFT JOIN ar USING (symbol, i)"""
)
def adaptive_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.with_recursive_indicators(market.klines(spark, sf_dir)).select("symbol", "open_time", "adaptive_rsi"))


@query(
    NUMBERED + ", " + _smooth("e20", "close", 20, 20, "(2 / 21)") + """, s AS (SELECT symbol, open_time, i, CASE WHEN i >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) END AS sma FROM x)
SELECT symbol, open_time AS time, 'sma' AS name, round(sma, 6) AS value FROM s UNION ALL SELECT x.symbol, open_time, 'ema', round(y, 6) FROM x LEFT JOIN e20 USING (symbol, i)"""
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.chart_series(market.klines(spark, sf_dir), ["sma", "ema"]))


@query(BARS + """, a AS (SELECT *, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM k WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS 9 PRECEDING))
SELECT symbol, open_time, round(CASE WHEN n = 10 THEN m END, 6) AS bb, round(CASE WHEN n = 10 THEN m + 2 * s END, 6) AS bb_upper, round(CASE WHEN n = 10 THEN CASE WHEN s > 0 THEN (close - m + 2 * s) / (4 * s) ELSE 0.5 END END, 6) AS bb_percent_b,
 round(CASE WHEN n = 10 THEN CASE WHEN m > 0 THEN 4 * s / m ELSE 0 END END, 6) AS bb_bandwidth FROM a""")
def registered_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indicator by name: its bare output is the middle, and others are derived from its bands."""
    return rounded(registry.add(market.klines(spark, sf_dir), "BBANDS", "bb", period=10).select("symbol", "open_time", "bb", "bb_upper", "bb_percent_b", "bb_bandwidth"))


@query(
    NUMBERED + ", " + ", ".join([_smooth("md", "close", 10, 10, "(2 / 11)"), _smooth("wd", "tr", 10, 10, "(2 / 11)"), _smooth("up", "gain", 7, 8, "(1 / 7)"), _smooth("dn", "loss", 7, 8, "(1 / 7)")])
    + """, s AS (SELECT symbol, i, CASE WHEN i >= 5 THEN (close - min(low) OVER w) * 100 / nullif(max(high) OVER w - min(low) OVER w, 0) END AS raw, CASE WHEN i >= 9 THEN (max(high) OVER c + min(low) OVER c) / 2 END AS conversion FROM x
 WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING), c AS (PARTITION BY symbol ORDER BY i ROWS 8 PRECEDING)),
k AS (SELECT *, CASE WHEN count(raw) OVER w = 2 THEN avg(raw) OVER w END AS k FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 1 PRECEDING))
SELECT x.symbol, open_time, round(md.y, 6) AS kc, round(md.y + 1.5 * wd.y, 6) AS kc_upper, round(CASE WHEN up.y + dn.y = 0 THEN 50 ELSE 100 * up.y / (up.y + dn.y) END, 6) AS rsi, round(k.k, 6) + 0.0 AS stoch, round(k.conversion, 6) AS ichimoku
FROM x LEFT JOIN md USING (symbol, i) LEFT JOIN wd USING (symbol, i) LEFT JOIN up USING (symbol, i) LEFT JOIN dn USING (symbol, i) LEFT JOIN k USING (symbol, i)""".replace("k AS (SELECT *", "kk AS (SELECT *").replace("LEFT JOIN k USING", "LEFT JOIN kk USING").replace("k.k,", "kk.k,").replace("k.conversion,", "kk.conversion,")
)
def registered_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators by name at periods of their own; a bare name is the middle of a channel, else the first output."""
    bars = market.klines(spark, sf_dir)
    for name, how in (("KC", {"period": 10, "width": 1.5}), ("RSI", {"period": 7}), ("STOCH", {"period": 5, "smooth": 2}), ("ICHIMOKU", {})):
        bars = registry.add(bars, name, **how)
    return rounded(bars.select("symbol", "open_time", "kc", "kc_upper", "rsi", "stoch", "ichimoku"))
