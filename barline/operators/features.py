"""Technical features of cleaned bars: moments by running sums, recursive means by one pass."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import Moment, correlation, moments
from ..functions.windows import past, per, require
from . import clean, days, rolling, scan
from .kernels import ema
from .passes import Rows, Step, by_group, floats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

YEAR = 252


def half(n: int) -> int:
    return max(2, n // 2)


def _volatility(df: DataFrame, windows: tuple[int, ...], column: str) -> dict[str, Moment]:
    require(df, column)
    return {f"vol_{n}d": Moment(column, n, half(n), "std") for n in windows}


def _annual(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    # windows of the same returns in another order differ in the last bits only: ranks should see them as equal
    out = df.withColumns({f"vol_{n}d": F.round(f"vol_{n}d", 12) for n in windows})
    return out.withColumns({f"vol_{n}d_annual": F.col(f"vol_{n}d") * F.sqrt(F.lit(float(YEAR))) for n in windows})


def volatility(df: DataFrame, windows: tuple[int, ...] = (5, 21, 63), column: str = "returns") -> DataFrame:
    return _annual(moments(df, _volatility(df, windows, column)), windows)


def _volume(df: DataFrame, n: int) -> dict[str, Moment]:
    require(df, "close", "volume")
    least = half(n)
    return {"_mean_volume": Moment("volume", n, least), "_traded": Moment("_turnover", n, 1, "sum"), "_volume": Moment("volume", n, least, "sum")}


def _ratios(df: DataFrame, n: int) -> DataFrame:
    v, c = F.col("volume"), F.col("close")
    out = df.withColumns({f"vol_ratio_{n}": per(v, F.col("_mean_volume")), f"vwap_{n}d": per(F.col("_traded"), F.col("_volume"))})
    return out.withColumn("vwap_dev", per(c - F.col(f"vwap_{n}d"), c)).drop("_mean_volume", "_traded", "_volume", "_turnover")


def _turnover(df: DataFrame) -> DataFrame:
    return df.withColumn("_turnover", F.col("close") * F.col("volume"))


def volume(df: DataFrame, n: int = 20) -> DataFrame:
    wanted = _volume(df, n)
    return _ratios(moments(_turnover(df), wanted), n)


def _bollinger(df: DataFrame, n: int, column: str) -> dict[str, Moment]:
    require(df, column)
    return {"bb_middle": Moment(column, n, half(n)), "_bb_std": Moment(column, n, half(n), "std")}


def _bands(df: DataFrame, width: float, column: str) -> DataFrame:
    mid, std = F.col("bb_middle"), F.col("_bb_std")
    out = df.withColumns({"bb_upper": mid + width * std, "bb_lower": mid - width * std}).drop("_bb_std")
    spread = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumns({"bb_width": per(spread, F.col("bb_middle")), "bb_pct": per(F.col(column) - F.col("bb_lower"), spread)})


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0, column: str = "close") -> DataFrame:
    return _bands(moments(df, _bollinger(df, n, column)), width, column)


def _zscores(df: DataFrame, windows: tuple[int, ...], column: str) -> dict[str, Moment]:
    require(df, column)
    return {f"{name}_{n}": Moment(column, n, half(n), kind) for n in windows for name, kind in (("_z_mean", "mean"), ("_z_std", "std"))}


def _scores(df: DataFrame, windows: tuple[int, ...], column: str) -> DataFrame:
    z = {f"z_price_{n}d": per(F.col(column) - F.col(f"_z_mean_{n}"), F.col(f"_z_std_{n}")) for n in windows}
    return df.withColumns(z).drop(*[f"{name}_{n}" for n in windows for name in ("_z_mean", "_z_std")])


def zscores(df: DataFrame, windows: tuple[int, ...] = (20, 60), column: str = "close") -> DataFrame:
    return _scores(moments(df, _zscores(df, windows, column)), windows, column)


def true_range(df: DataFrame) -> DataFrame:
    require(df, "high", "low", "close")
    h, low, before = F.col("high"), F.col("low"), past(F.col("close"))
    return df.withColumn("tr", F.greatest(h - low, F.abs(h - before), F.abs(low - before)))


def _recursive(rsi: int = 14, atr: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> Step:
    names = [f"rsi_{rsi}", f"atr_{atr}", f"ema_{fast}", f"ema_{slow}", "macd_line", "macd_signal", "macd_histogram"]

    def run(bars: pa.Table) -> dict[str, np.ndarray]:
        close = floats(bars, "close")
        move = np.diff(close, prepend=np.nan)
        gain, loss = ema(np.where(move < 0, 0.0, move), 1 / rsi, rsi), ema(np.where(move > 0, 0.0, -move), 1 / rsi, rsi)
        with np.errstate(divide="ignore", invalid="ignore"):
            index = np.where(np.isnan(loss), np.nan, np.where(loss == 0, 100.0, np.clip(100 - 100 / (1 + gain / loss), 0, 100)))
        quick, late = ema(close, 2 / (fast + 1), fast), ema(close, 2 / (slow + 1), slow)
        line = quick - late
        smooth = ema(line, 2 / (signal + 1), signal)
        return dict(zip(names, [index, ema(floats(bars, "tr"), 1 / atr, atr), quick, late, line, smooth, line - smooth], strict=True))

    return Step(dict.fromkeys(names, "double"), run)


def averages(df: DataFrame, rsi: int = 14, atr: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """RSI, ATR and MACD: all recursive means of a symbol in one pass. ``scan.averages``
    makes the same columns of series that are too long for a task."""
    require(df, "close", "tr")
    return by_group(df, [_recursive(rsi, atr, fast, slow, signal)])


def all_features(df: DataFrame, block_days: int | None = None, vol: tuple[int, ...] = (5, 21, 63), z: tuple[int, ...] = (20, 60), band: tuple[int, float] = (20, 2.0), also: dict[str, Moment] | None = None, rows: Rows | None = None) -> DataFrame:
    """All families, by their windows: recursive means, moments and those asked for ``also``
    in one pass over a symbol, of the ``rows`` that its bars become where these are given;
    or, by blocks of so many days, the means by blocks and the moments as window
    expressions. All moments share their sums."""
    seen = rows or df
    wanted = _volatility(seen, vol, "returns") | _volume(seen, 20) | _bollinger(seen, band[0], "close") | _zscores(seen, z, "close")
    if block_days is None:
        out = by_group(df if rows else _turnover(true_range(df)), [_recursive(), rolling.step(wanted), *([rolling.step(also)] if also else [])], rows=rows)
    else:
        out = moments(_turnover(scan.averages(df, block_days)), wanted)
        out = moments(out, also) if also else out
    return _scores(_bands(_ratios(_annual(out, vol), 20), band[1], "close"), z, "close")


def of_bars(bars: DataFrame) -> DataFrame:
    """All families of bars that are not cleaned yet: the days between them, the windows of
    cleaning and those of the features in one pass over a symbol, which many symbols are
    through soonest."""
    bars = clean.standardise(bars)
    if not days.fits(bars):
        return clean.normed(all_features(clean.moved(clean.filled(bars)), also=clean.NORM))
    return clean.normed(all_features(bars, also=clean.NORM, rows=days.daily(bars)))


def report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing_pct, mean, std, min, q25, median, q75, max) over all rows."""
    def quartile(c: str, p: float):  # noqa: ANN202
        return F.percentile(c, F.lit(p))

    stats = [F.struct(F.lit(c).alias("feature"), (F.count_if(F.col(c).isNull()) / F.count("*") * 100).alias("missing_pct"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *[quartile(c, p).alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))], F.max(c).alias("max")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, over the rows where both are known."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("corr")) for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")
